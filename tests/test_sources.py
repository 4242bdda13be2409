"""Readers, writers, hooks and caches."""

import pytest
from pyspark.sql import functions as F

from marquee.operators import history, vectors
from marquee.sources import files, providers
from marquee.streaming import jobs


def test_text_files(spark, tmp_path):
    for name, body in (("a.txt", "one"), ("b.txt", "two\nlines")):
        (tmp_path / name).write_text(body)
    every = files.read_text_files(spark, str(tmp_path))
    assert sorted(r.text for r in every.collect()) == ["one", "two\nlines"]
    known = every.where("text = 'one'").select("source_id")
    assert [r.text for r in files.read_text_files(spark, str(tmp_path), known).collect()] == ["two\nlines"]


def test_xml_dump_drops_records_without_id_or_name(spark, tmp_path):
    rows = "<artist><id>1</id><name>A</name></artist><artist><name>B</name></artist><artist><id>3</id></artist>"
    (tmp_path / "d.xml").write_text(f"<artists>{rows}</artists>")
    found = files.read_xml_dump(spark, str(tmp_path / "d.xml"), "artist", "id long, name string").collect()
    assert [(r.id, r.name) for r in found] == [(1, "A")]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("x", "one", 1), ("y", "two", 2)], "cluster string, line string, v int")
    files.write_text_by(rows, "cluster", "line", f"{tmp_path}/text")
    assert (tmp_path / "text" / "cluster=x").is_dir()
    files.write_jsonl(rows, f"{tmp_path}/json")
    assert spark.read.schema(rows.schema).json(f"{tmp_path}/json").count() == 2
    changes = spark.createDataFrame([("x", "new", 3)], "cluster string, line string, v int")
    files.upsert_parquet(rows, changes, ["cluster"], "v", f"{tmp_path}/out")
    assert {(r.cluster, r.line) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("x", "new"), ("y", "two")}


def test_crawl_depth(spark):
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 0), (1, 0)], "source long, target long")
    assert {(r.page, r.depth) for r in files.crawl(links, [0], 2).collect()} == {(0, 0), (1, 1), (2, 2)}


def test_hash_vectors_and_search(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["acid", "house", "acid", None])], "i long, t string")
    embedded = providers.embed(rows, "i", "t", 32)
    found = vectors.search(embedded, "embedding", "i", providers.hash_vector("acid", 32), 2).collect()
    assert [r.i for r in found] == [0, 2] and found[0].similarity == pytest.approx(1)
    queries = spark.createDataFrame([(7, providers.hash_vector("house", 32))], "query_id long, qvec array<double>")
    assert [r.i for r in vectors.search_many(embedded, queries, "embedding", "i", 1).collect()] == [1]


def test_filters():
    both = providers.Filters(frozenset({"a", "b"}), most_tier=4).merge(providers.Filters(not_types=frozenset({"a"}), most_tier=2))
    assert (both.types, both.most_tier) == (frozenset({"b"}), 2)
    assert providers.Filters(frozenset({"a"})).merge(providers.Filters(frozenset({"b"}))) is None
    with pytest.raises(LookupError):
        providers.Providers().call("ocr", None)


def test_jaccard_pairs_are_exact(spark):
    import random

    r = random.Random(5)
    base = [[r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice("abcd") for _ in range(r.randint(0, 25))] for _ in range(40)]
    texts = ["a b c d e f g h i j", "a b c d e f g h i k", "a b c d e f g h i j", "z", "z", "", "a b"]
    texts += [" ".join(words) for words in base] + [" ".join(words[1:] + [r.choice("xyz")]) for words in base] + [" ".join(words[:-1]) for words in base]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    tokens = F.filter(F.split("t", " "), lambda w: w != "")
    found = {r.k: (r.class_id, r.n_links) for r in vectors.near_token_sets(rows, "k", tokens, 0.8).collect()}
    sets = [frozenset(t.split()) for t in texts]
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(s or i, i)
    for i, s in enumerate(sets):
        like = {first[o] for o in sets if s and o and o != s and len(s & o) / len(s | o) > 0.8}
        assert found[i] == (first[s or i], len(like))


def test_sets_that_share_a_rare_word_are_not_compared(spark):
    """A word that two sets alone share makes them meet; they are compared if they share more at their beginnings."""
    sets = spark.range(40).selectExpr("id", "transform(sequence(0, 99), i -> if(i = 0, -1 - id div 2, 1000 * id + i)) t")
    sets = sets.unionByName(spark.range(100, 102).selectExpr("id", "transform(sequence(0, 99), i -> if(i = 0, -id, 10000000 + i)) t"))
    found = vectors.jaccard_pairs(sets, "id", 0.8)
    compared = [f for f in found.inputFiles() if "/pairs-" in f]
    assert compared and spark.read.parquet(*compared).count() == 1
    assert [(r.a, r.b, round(r.jaccard, 9)) for r in found.collect()] == [(100, 101, round(99 / 101, 9))]


def test_bands_of_sizes_hold_all_near_ones():
    for threshold in (0.5, 0.7, 0.8, 0.9, 0.95):
        low = vectors._bands(threshold)
        band = lambda n: sum(x <= n for x in low)  # noqa: B023, E731
        assert all(band(m) - band(n) in (0, 1) for n in range(1, 300) for m in range(n, int(n / threshold + 1e-9) + 1))


def test_nested_children_are_empty_not_null(spark):
    parents = spark.createDataFrame([(1,), (2,)], "k long")
    children = spark.createDataFrame([(1, "b", 2), (1, "a", 1)], "k long, n string, v int")
    rows = {r.k: r.c for r in history.nested(parents, children, "k", "c", ["n", "v"]).collect()}
    assert [tuple(x) for x in rows[1]] == [("a", 1), ("b", 2)] and rows[2] == []


def test_cache_follows_the_version(spark):
    cache, built = jobs.VersionedCache(most=1), []

    def build():
        built.append(1)
        return spark.range(3)

    for version in ("a", "a", "b"):
        cache.get("x", version, build)
    cache.get("y", "a", build)
    assert len(built) == 3


@pytest.mark.parametrize("most,blocks", [(3, None), (10, None), (10, 2), (10, 3), (7, 5), (0, None)])
def test_hash_neighbours_are_exact_for_any_blocks(spark, monkeypatch, most, blocks):
    """Whatever the blocks, all pairs within the distance and no others."""
    import random

    rng = random.Random(most)
    middles = [rng.getrandbits(64) for _ in range(6)]
    hashes = [m ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 8))) for m in middles for _ in range(8)] + [0, 2**64 - 1, 1 << 63]
    if blocks:
        cuts, near = [64 * i // blocks for i in range(blocks + 1)], most // blocks
        monkeypatch.setattr(vectors, "block_plan", lambda rows, bits: [(a, b - a, (near + 1) // 2, near // 2) for a, b in zip(cuts, cuts[1:])])
    rows = [(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(hashes)]
    got = {tuple(r) for r in vectors.hash_neighbours(spark.createDataFrame(rows, "k long, h long"), "k", "h", most).collect()}
    far = lambda a, b: (hashes[a] ^ hashes[b]).bit_count()
    assert got == {(a, b, far(a, b)) for a in range(len(hashes)) for b in range(a + 1, len(hashes)) if far(a, b) <= most}


def test_event_corpus_is_told_whole(spark, tmp_path):
    """The parts of a type are its blocks in order of time; an event without a user has no text but counts."""
    from datetime import datetime, timedelta

    import __spark_entry__ as entry

    first = datetime(2024, 1, 1)
    rows = [(i, first + timedelta(minutes=(i * 7919) % 2500), None if i == 5 else i % 9, "ab"[i % 5 == 0], 1.0, "{}") for i in range(2600)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    found = sorted(entry.queries()["sink_event_corpus"](spark, str(tmp_path)).collect(), key=lambda r: (r.event_type, r.part))
    assert [(r.event_type, r.part, r.n) for r in found] == [("a", 0, 1000), ("a", 1, 1000), ("a", 2, 80), ("b", 0, 520)]
    for kind in "ab":
        texts = [f"Event: {i} {u}" for i, _, u, k, *_ in sorted(rows, key=lambda r: (r[1], r[0])) if k == kind and u is not None]
        assert "\n---\n".join(r.body for r in found if r.event_type == kind) == "\n---\n".join(texts)


def test_shared_events_keep_their_first_by_any_rank(spark, monkeypatch):
    """Repeated line-up rows, ranks beside the event; pairs are dealt to tasks by the number of rows
    and reduced once, without sorting where the rank is one column."""
    import random
    from itertools import combinations

    from marquee.operators import history

    rng = random.Random(4)
    rows = [(rng.randrange(40), rng.randrange(12), rng.choice([None, 1, 2, 3])) for _ in range(300)]
    table = spark.createDataFrame(rows + [(None, 1, 1), (None, 2, 1)], "e int, a int, r int")
    monkeypatch.setattr(history, "ROWS_A_TASK", 20)
    for rank in (["e"], ["r", "e"], ["r"]):
        expected = {}
        for event in {e for e, _, _ in rows}:
            least = {}
            for e, a, r in rows:
                if e == event:
                    value = tuple({"e": (True, e), "r": (r is not None, r or 0)}[c] for c in rank)
                    least[a] = min(least.get(a, value), value)
            for a, b in combinations(sorted(least), 2):
                n, first = expected.get((a, b), (0, least[a]))
                expected[a, b] = (n + 1, min(first, least[a]))
        found = history.shared_event_pairs(table, ["e"], "a", rank)
        got = {(x.artist_a, x.artist_b): (x.shared, tuple((x[c] is not None, x[c] or 0) for c in rank)) for x in found.collect()}
        assert got == expected
    plan = history.shared_event_pairs(table, ["e"], "a", ["e"])._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "SortAggregate" not in plan and "hashpartitioning(artist_a#" in plan


def test_hashes_of_one_key_are_linked_each(spark):
    """Keys may be shared by different hashes: a pair of hashes is a link, whatever its keys and distance."""
    rows = [(1, 0), (2, 0b11 << 40), (2, 0b11 << 20), (3, 0), (3, -1)]
    found = sorted(tuple(r) for r in vectors.near_hashes(spark.createDataFrame(rows, "k long, h long"), "k", "h", 4).collect())
    assert found == [(1, 1, 2), (1, 3, 2), (2, 2, 2), (2, 2, 2), (3, 3, 0)]


def test_blocks_of_hashes_are_not_broadcast(spark):
    """A file of hashes is small, its blocks are not."""
    rows = spark.range(200).select("id", vectors.F.xxhash64("id").alias("h"))
    plan = vectors.hash_neighbours(rows, "id", "h", 10)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_blocks_widen_with_the_rows():
    widths = [vectors.block_plan(n, 10)[0][1] for n in (1_000, 1_000_000, 10_000_000_000)]
    assert widths == sorted(widths) and widths[-1] == 32
