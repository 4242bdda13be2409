"""Scalar functions on hand-made values."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marquee.functions import dates, domain, names, periods, text, urls
from marquee.operators import fuzzy, graph, vectors


def column(spark, values, build):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in rows.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


def test_names(spark):
    given_names = ["  DJ  rush ", "aphex-twin", "o'brien", "carl   cox", "", None, "djavan"]
    assert column(spark, given_names, names.normalize_name) == ["Rush", "Aphex-Twin", "O'Brien", "Carl Cox", "", None, "Djavan"]
    assert column(spark, ["Carl Cox b2b Adam Beyer, Nina & X feat. Y vs Z", "Solo", ""], names.split_artists) == [
        ["Carl Cox", "Adam Beyer", "Nina", "X", "Y", "Z"], ["Solo"], []
    ]


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_lcs_ratio(a, b):
    expected = 1.0 if not a and not b else 2 * slow_lcs(a, b) / (len(a) + len(b))
    assert names.lcs_ratio(a, b) == expected


def test_periods(spark):
    found = column(spark, ["the second summer of love", "1987 – 1989", "the 90s", "back to 05's", "1990s", "in 1994", "junk", None], periods.detect_period)
    assert found == ["1988-1989", "1987-1989", "1990s", "2005s", "1990s", "1994", None, None]
    parsed = column(spark, ["1990s", "1987-1989", "1994", "in 1994", None], periods.parse_period)
    assert [p and (p.start, p.end) for p in parsed] == [(1990, 1999), (1987, 1989), (1994, 1994), None, None]
    assert column(spark, ["1990s", "1980s", "x", None], lambda c: periods.periods_overlap(c, F.lit("1999-2001"))) == [True, False, False, False]


def test_text(spark):
    assert column(spark, ["Arrning 0PEN CARL0 1ive |ate VVarp"], text.correct_ocr) == ["Arming OPEN CARLO live late Warp"]
    assert column(spark, ["[a=Name] on [l=Label] [a12] [r=3] [url=u]site[/url] [b]x[/b]", None], text.clean_markup) == ["Name on Label site x", ""]
    assert column(spark, ["[00:15:22] hello  there.\nInterviewer: what?"], text.clean_transcript) == ["hello there.\n\nwhat?"]
    assert column(spark, ["abc"], text.rolling_hash) == [f"{96354:08x}"]
    assert column(spark, ['Sure ```json\n{"a": 1}\n``` ok', 'x {"b": {}} y', "none"], text.outer_json) == ['{"a": 1}', '{"b": {}}', ""]
    assert column(spark, ["Fabric, London", "Berghain - Berlin", "X, UK", "Plain"], text.city_hint) == ["London", "Berlin", None, None]


def test_chunks():
    assert text.chunk_text(None) == [] and text.chunk_text(" \n\n ") == []
    random.seed(3)
    paragraphs = [" ".join("w" * random.randint(1, 9) for _ in range(random.randint(1, 400))) + "." for _ in range(40)]
    chunks = text.chunk_text("\n\n".join(paragraphs))
    assert all(p in "\n\n".join(chunks) or len(p) // 4 > 500 for p in paragraphs)
    assert text.sentences("Prof. X met Dr. No. e.g. this! Ok") == ["Prof. X met Dr. No. e.g.", "this!", "Ok"]
    assert text.sentences("It cost approx. 5. The dept. of St. Mary vs. us? Yes") == ["It cost approx. 5.", "The dept. of St. Mary vs. us?", "Yes"]
    assert text.sentences("no end") == ["no end"] and text.sentences("v1.5 is out.") == ["v1.5 is out."]


def slow_sentences(value):
    """Character by character."""
    out, held = [], ""
    for i, c in enumerate(value):
        held += c
        after = value[i + 1] if i + 1 < len(value) else " "
        short = c == "." and any(held.endswith(a + ".") for a in text.ABBREVIATIONS)
        if c in ".!?" and after.isspace() and not short:
            out.append(held.strip())
            held = ""
    return [s for s in [*out, held.strip()] if s] or [value]


def slow_chunks(value, most=500, overlap=100):
    tokens = lambda units: sum(len(u) // 4 for u in units)

    def pack(units, joiner):
        chunks, current = [], []
        for unit in units:
            if current and tokens([*current, unit]) > most:
                chunks.append(joiner.join(current))
                fits = [k for k in range(len(current) + 1) if all(tokens(current[j:]) <= overlap for j in range(k, len(current)))]
                current = current[min(fits) :]
            current = [*current, unit]
        return chunks + [joiner.join(current)] * bool(current)

    out, run = [], []
    for paragraph in (p.strip() for p in re.split(r"\n\s*\n", value)):
        if len(paragraph) // 4 > most:
            out += pack(run, "\n\n") + pack(slow_sentences(paragraph), " ")
            run = []
        elif paragraph:
            run.append(paragraph)
    return out + pack(run, "\n\n")


def test_sentences_and_chunks_against_brute_force(spark):
    from tests.conftest import DATA

    import __spark_entry__ as entry

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    random.seed(4)
    made = ["".join(random.choice(["Dr", "x", ".", "! ", "? ", " ", "\n", "vs", "no", "St"]) for _ in range(40)) for _ in range(300)]
    for value in [*texts.values(), *made]:
        assert text.sentences(value) == slow_sentences(value)
        assert text.chunk_text(value, 40, 10) == slow_chunks(value, 40, 10)
    split = {}
    for r in entry.queries()["fn_split_sentences"](spark, DATA).collect():
        split.setdefault(r.doc_id, {})[r.n] = r.sentence
    assert {i: list(dict(sorted(x.items())).values()) for i, x in split.items()} == {i: slow_sentences(v) for i, v in texts.items()}
    chunks = {}
    for r in entry.queries()["fn_chunk"](spark, DATA).collect():
        chunks.setdefault(r.source_id, {})[r.ordinal] = r.chunk
    assert {i: [x[k] for k in sorted(x)] for i, x in chunks.items()} == {i: slow_chunks(v) for i, v in texts.items() if v.strip()}


def test_like_strings_are_all_found(spark):
    random.seed(6)
    words = ["".join(random.choice("abcx ") for _ in range(random.randint(0, 14))) for _ in range(120)] + ["carl cox", "cox carl", "0rbital", "orbital", ""]
    frame = spark.createDataFrame([(w,) for w in words] + [(None,)], "name string")
    edit = lambda a, b: 1.0 if not (a or b) else 1 - slow_edit(a, b) / max(len(a), len(b))
    for kind, ratio in (("edit", edit), ("indel", names.lcs_ratio)):
        found = {(r.asked, r.known): round(r.ratio, 9) for r in fuzzy.like_pairs(frame, frame, 0.75, kind).collect()}
        assert found == {(a, b): round(ratio(a, b), 9) for a in words for b in words if ratio(a, b) >= 0.75}


def slow_edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def slow_resolve(rows, threshold):
    known, out = [], {}
    for order, name in sorted(rows):
        key = " ".join(sorted((name or "").lower().split()))
        if name is None:
            out[order] = None
            continue
        best = max(((names.lcs_ratio(key, k), -i) for i, k in enumerate(known)), default=(0, 0))
        if best[0] < threshold:
            known.append(key)
        out[order] = known[-best[1]] if best[0] >= threshold else key
    return out


def test_resolving_is_as_in_order(spark):
    random.seed(7)
    base = ["orbital", "carl cox", "the orb", "aphex twin", "underworld", "x", ""]
    rows = [(i, "".join(c if random.random() > 0.12 else random.choice("abo ") for c in random.choice(base))) for i in range(250)]
    rows += [(300, "0rbital"), (301, "COX CARL"), (302, None), (303, "a" * 20), (304, "a" * 23), (305, "a" * 26), (306, "a" * 20)]
    frame = spark.createDataFrame(rows, "o long, n string")
    for threshold in (0.8, 0.85):
        assert {r.o: r.canonical for r in graph.resolve(frame, "n", "o", threshold).collect()} == slow_resolve(rows, threshold)


def test_registered_resolutions_against_brute_force(spark):
    from tests.conftest import DATA

    import __spark_entry__ as entry

    parts = [(r.p_partkey, r.p_name, r.p_size) for r in spark.read.parquet(f"{DATA}/part.parquet").collect()]
    found = {r.p_partkey: r.canonical for r in entry.queries()["resolve_fuzzy"](spark, DATA).collect()}
    assert found == slow_resolve([(k, n) for k, n, _ in parts], 0.85)
    slow, expected = slow_resolve([(-s * 100000 + k, n) for k, n, s in parts], 0.8), {}
    name = {-s * 100000 + k: n for k, n, s in parts}
    for o in sorted(slow):
        first, n = expected.get(slow[o], (name[o], 0))
        expected[slow[o]] = (first, n + 1)
    assert {r.canonical: (r.p_name, r.n) for r in entry.queries()["dedup_ocr_fuzzy"](spark, DATA).collect()} == expected
    sort = lambda x: " ".join(sorted(x.lower().split()))
    known = {sort(n) for _, n, _ in parts}
    best = {}
    for k, n, _ in parts:
        asked = sort(" ".join(reversed(n.split())).replace("l", "1"))
        ratio, like = min((-names.lcs_ratio(asked, b), b) for b in known)
        if -ratio >= 0.8:
            best[k] = (like, round(-ratio, 9))
    assert {r.p_partkey: (r.best, round(r.ratio, 9)) for r in entry.queries()["join_token_sort"](spark, DATA).collect()} == best


def test_domain_tables(spark):
    genres = ["house", "acid house", "techno", "dub", "dub techno", "house techno club"]
    values = ["Acid House", "acid house and house", "warehouse", "dub-techno dub techno", "acid house techno club", "", None]
    found = column(spark, values, lambda c: domain.extract_genres(c, genres))
    assert found == [["acid house"], ["acid house", "house"], [], ["dub", "dub techno", "techno"], ["house techno club"], [], []]
    names_ = spark.createDataFrame([("AFX",), ("b",), ("Twin",)], "name string")
    table = spark.createDataFrame([("Twin", "AFX"), ("Twin", "Blue")], "canonical string, alias string")
    assert {r.name: r.names for r in domain.expand_aliases(names_, "name", table).collect()} == {"AFX": ["AFX", "Blue", "Twin"], "b": ["b"], "Twin": ["AFX", "Blue", "Twin"]}
    hits = column(spark, ["who is it", "AFX", "afx live", "by Orbital!", "none", None], lambda c: domain.is_artist_query(c, "(?i)^who is", ["AFX", "Orbital"]))
    assert [bool(h) for h in hits] == [True, True, False, True, False, False]


def test_dates(spark):
    given = ["Sat, March 4th, 1995 at", "doors 3/4/95", "1995-03-04", "am 04.03.95", "4th of Mar. '95", "3/4/05", "99/99/2024", "no", None]
    assert [d and str(d) for d in column(spark, given, dates.parse_date)] == ["1995-03-04"] * 5 + ["2005-03-04", None, None, None]


def test_numbers_of_few_keys(spark):
    from marquee.operators import ranking

    rows = spark.createDataFrame([(i % 2 if i % 5 else None, i, i % 7) for i in range(500)], "k long, o long, v long").repartition(6)
    found = {r.o: r.total for r in ranking.running_sum(rows, ["k"], ["o"], F.col("v")).collect()}
    expected, totals = {}, {}
    for i in range(500):
        k = i % 2 if i % 5 else None
        totals[k] = totals.get(k, 0) + i % 7
        expected[i] = totals[k]
    assert found == expected
    assert sorted(r.number for r in ranking.numbered(rows, [], ["o"]).collect()) == list(range(1, 501))


def test_urls(spark):
    many = ["https://ra.co/x", "http://discogs.com/forum/1", "http://discogs.com/a", "http://a.org", "https://www.RA.co/dj"]
    assert column(spark, many, lambda u: urls.first_match(u, urls.CITATION_TIERS, 1, 5)) == [5, 6, 4, 5, 5]
    assert column(spark, many, lambda u: urls.first_match(u, urls.RESEARCH_TIERS, 1, 6)) == [1, 3, 3, 6, 1]
    assert column(spark, many, urls.domain) == ["ra.co", "discogs.com", "discogs.com", "a.org", "ra.co"]


def test_hashes(spark):
    assert column(spark, ["ffffffffffffffff", "0000000000000000", "8000000000000001"], vectors.hex_to_long) == [-1, 0, -(1 << 63) + 1]
    random.seed(1)
    hashes = [random.getrandbits(64) for _ in range(40)]
    hashes += [h ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for h in hashes]
    signed = [(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(hashes)]
    pairs = vectors.hash_neighbours(spark.createDataFrame(signed, "k long, h long"), "k", "h", 3).collect()
    expected = {(i, j) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and (a ^ b).bit_count() <= 3}
    assert {(p.a, p.b) for p in pairs} == expected
