"""Every query with SQL gives the rows of its SQL."""

import pandas as pd
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def rows_of(frame: pd.DataFrame) -> list:
    def value(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        return f"{v:.9g}" if isinstance(v, float) else str(v.tolist() if hasattr(v, "tolist") else v)

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(value, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_epub_documents(spark):
    """Pages with enough text and their first heading, by the standard library's parser."""
    import html.parser
    import re

    class Reader(html.parser.HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=False)
            self.text, self.skip, self.heading, self.title = "", 0, 0, None

        def handle_starttag(self, tag, attrs):
            self.text += " "
            self.skip += tag in ("script", "style", "head")
            if tag in ("h1", "h2", "h3") and self.title is None:
                self.heading, self.title = 1, ""

        def handle_endtag(self, tag):
            self.text += " "
            self.skip -= tag in ("script", "style", "head")
            self.heading = 0 if tag in ("h1", "h2", "h3") else self.heading

        def put(self, data):
            self.text += "" if self.skip else data
            if self.heading:
                self.title += data

        handle_data = put

        def handle_entityref(self, name):
            self.put(f"&{name};")

        def handle_charref(self, name):
            self.put(f"&#{name};")

    expected = {}
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        reader = Reader()
        reader.feed(r.html or "")
        n = len(re.sub(r"\s+", " ", reader.text).strip())
        if n >= 100:
            expected[r.page_id] = ((reader.title or "").strip(), n)
    assert {r.page_id: (r.title, r.n_chars) for r in QUERIES["scan_epub"](spark, DATA).collect()} == expected


def test_token_sort_ratio_of_parts(spark):
    from marquee.functions.names import lcs_ratio

    sort = lambda x: " ".join(sorted(x.split()))
    parts = spark.read.parquet(f"{DATA}/part.parquet").collect()
    expected = {p.p_partkey: lcs_ratio(sort(p.p_name), sort(f"{p.p_type} {p.p_name.split(' ')[-1]}")) for p in parts}
    found = {r.p_partkey: r.ratio for r in QUERIES["fn_token_sort_ratio"](spark, DATA).collect()}
    assert found == expected


def test_ocr_corrections_of_parts(spark):
    names = {r.p_partkey: r.p_name for r in spark.read.parquet(f"{DATA}/part.parquet").collect()}
    found = {r.p_partkey: r.text for r in QUERIES["fn_ocr_correct"](spark, DATA).collect()}
    assert found == {k: f"Arming OPEN CARLO live late Warehouse {n.replace('rn', 'm')}" for k, n in names.items()}


def test_embeddings_are_unit_vectors_of_the_text(spark):
    from marquee.sources.providers import hash_vector

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["fn_embed"](spark, DATA).collect()
    assert {r.doc_id: r.embedding for r in rows} == {i: hash_vector(t or "", 64) for i, t in texts.items()}
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-9 for r in rows)


def test_few_texts_are_embedded_at_once(spark):
    from marquee.sources.providers import embed

    rows = spark.range(3000).selectExpr("id", "if(id % 7 = 0, null, concat('t', id)) as t").coalesce(1)
    found = embed(rows, "id", "t", 2, lambda texts: [[float(len(texts)), float(len(t))] for t in texts]).collect()
    assert {r.id: r.embedding[1] for r in found} == {i: 0.0 if i % 7 == 0 else len(f"t{i}") for i in range(3000)}
    assert max(r.embedding[0] for r in found) <= 256


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
