"""Every stage carries foreign columns, whatever their names are."""

import pytest
from pyspark.sql import functions as F

from marquee.llm import decontaminate, quality, simhash, suffix_dedup

NAMES = ["__id", "__hash", "__held", "__doc", "__sub", "__note", "__row", "__ranges", "__at_doc", "row", "rest", "fp", "component", "won", "c0", "a.b", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    line = "Every stage of this corpus keeps what it is given and carries the other columns along, number {}. "
    texts = [line.format(i) + " ".join(f"w{i}x{j}" for j in range(40)) + "." for i in range(6)]
    texts += [texts[0], texts[1][:150] + " and then it goes on with words of its own here."]
    texts += ["The river Elbe is 1094 kilometres long and flows through Hamburg into the sea near Cuxhaven today."]
    rows = [(i, t, *[f"{n}{i}" for n in NAMES[:-1]], len(t)) for i, t in enumerate(texts)]
    kinds = ", ".join(f"`{n}` string" for n in NAMES[:-1])
    return spark.createDataFrame(rows, f"doc_id long, text string, {kinds}, n_chars int").repartition(3)


def stages(spark):
    bench = spark.createDataFrame([(1, "The river Elbe is 1094 kilometres long and flows through Hamburg into the sea near Cuxhaven today.")], "item_id long, text string")
    return {
        "quality": quality.clean_lines,
        "simhash": simhash.drop_near_duplicates,
        "suffix": suffix_dedup.drop_repeats,
        "decontaminate": lambda d: decontaminate.drop_contaminated(d, bench),
    }


@pytest.mark.parametrize("name", ["quality", "simhash", "suffix", "decontaminate"])
def test_foreign_columns_are_carried(spark, docs, name):
    stage = stages(spark)[name]
    got = stage(docs)
    assert got.schema.simpleString() == docs.schema.simpleString()
    plain = {r.doc_id: r.text for r in stage(docs.select("doc_id", "text")).collect()}
    rows = got.collect()
    assert {r.doc_id: r.text for r in rows} == plain and 0 < len(rows)
    for r in rows:
        assert [r[n] for n in NAMES[:-1]] == [f"{n}{r.doc_id}" for n in NAMES[:-1]]
    if name == "decontaminate":
        assert 8 not in plain and len(plain) == 8
    if name == "simhash":
        assert sorted(plain) == [0, 1, 2, 3, 4, 5, 7, 8]


@pytest.mark.parametrize("name", ["quality", "simhash", "suffix", "decontaminate"])
def test_empty_tables_with_foreign_columns(spark, docs, name):
    empty = docs.where(F.lit(False))
    got = stages(spark)[name](empty)
    assert got.columns == docs.columns and got.count() == 0
