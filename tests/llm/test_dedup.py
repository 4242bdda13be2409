"""SimHash components and repeated passages against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from marquee.llm import simhash, suffix_dedup
from marquee.llm.shared import connected_components
from marquee.llm.suffixes import deep_shallow_order


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    ids, f = np.array([i for i, _ in prints]), np.array([p for _, p in prints], np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 2
    label = ids.copy()
    while (new := np.where(near, label[None, :], 1 << 60).min(1)).tolist() != label.tolist():
        label = new
    return dict(zip(ids.tolist(), label.tolist()))


def corpus(seed=5):
    random.seed(seed)
    words = ["alpha", "Beta", "gamma", "dELTA", "é", "zeta", "eta x"]
    texts = [" ".join(random.choice(words) for _ in range(random.randint(0, 60))) for _ in range(40)]
    texts += [t + " tail" for t in texts[:20]] + texts[:10] + ["", None, " \n\t ", "one", "one two", "two one"]
    texts += ["w " * 40000]
    return list(enumerate(texts))


@pytest.mark.parametrize("cap", [1, simhash.BUCKET_CAP])
def test_simhash_components(docs_of, cap):
    rows = corpus()
    found = simhash.near_duplicates(docs_of(rows), cap).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in found} == {i: slow_fingerprint(t) for i, t in rows}
    assert {r.doc_id: r.component_id for r in found} == slow_components([(i, slow_fingerprint(t)) for i, t in rows])


def test_simhash_of_near_fingerprints(spark):
    """Hot buckets: many fingerprints within few bits, chained."""
    random.seed(2)
    base = random.getrandbits(64)
    prints = {base}
    for _ in range(300):
        prints.add(random.choice(sorted(prints)) ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)))
    prints |= {random.getrandbits(64) for _ in range(200)}
    rows = list(enumerate(sorted(prints)))
    frame = spark.createDataFrame([(simhash._signed(p),) for _, p in rows], "fp long")
    for cap in (8, 64, 10_000):
        labels = {r.u & (1 << 64) - 1: r.component for r in connected_components(simhash.links(frame, cap)).collect()}
        groups = {}
        for i, p in rows:
            groups.setdefault(labels.get(p, ("alone", p)), set()).add(i)
        expected = {}
        for i, c in slow_components(rows).items():
            expected.setdefault(c, set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_pivots_find_and_discard(spark):
    """Candidates come from the table's coordinates; nearly all of the wrong ones go by them."""
    random.seed(3)
    base = random.getrandbits(64)
    prints = {base ^ sum(1 << random.randrange(64) for _ in range(k % 9)) & (1 << 64) - 1 for k in range(300)}
    prints |= {random.getrandbits(64) for _ in range(200)}
    near = sum((a ^ b).bit_count() <= 2 for i, a in enumerate(sorted(prints)) for b in sorted(prints)[:i])
    frame = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    counts = simhash.pair_counts(frame, 10_000).first()
    assert counts.linked == near and counts.considered == counts.discarded + counts.verified
    assert counts.discarded > 0.9 * (counts.considered - counts.linked) and counts.considered < len(prints) ** 2 / 4
    table = {r.fp: r.distances for r in simhash.pivot_table(frame).collect()}
    pivots = simhash.pivots()
    assert len(set(pivots)) == 61
    assert all(d == [((p & (1 << 64) - 1) ^ q).bit_count() for q in pivots] for p, d in table.items())


def test_simhash_edges(docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0
    rows = [(3, "a b c d"), (3, "a b c d"), (1, "a b c d"), (None, "x y z q")]
    found = simhash.near_duplicates(docs_of(rows)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in found) == [(-1, -1), (1, 1), (3, 1), (3, 1)]
    frame = docs_of([(3, "a b c d"), (1, "a b c d"), (1, "a b c d"), (7, "")])
    kept = simhash.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 7]


def test_dropping_near_duplicates_keeps_null_and_repeated_ids(docs_of):
    alone = ["one text of its own here", "and a second that differs much", "the third is not like these"]
    rows = [(None, alone[0]), (None, alone[1]), (5, alone[2]), (5, "words with the same number but unlinked")]
    rows += [(None, "a b c d"), (9, "a b c d"), (None, "only null ids here now"), (None, "only null ids here now"), (9, "w x y z")]
    kept = simhash.drop_near_duplicates(docs_of(rows)).collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == sorted((i or -1, t) for i, t in {*rows} - {(None, "a b c d")})


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(400)] + [(1000, 1001), (5, 5)], "u long, v long")
    labels = {r.u: r.component for r in connected_components(edges).collect()}
    assert len({labels[i] for i in range(401)}) == 1 and labels[1000] == labels[1001] != labels[0]


def test_deep_shallow_order():
    random.seed(4)
    for _ in range(800):
        strings = [bytes(random.choice(b"ab") for _ in range(random.choice([0, 3, 30, 60]))) for _ in range(random.randint(1, 9))]
        if random.random() < 0.5:
            strings = [b"q" * 30 + s for s in strings]
        assert [strings[i] for i in deep_shallow_order(strings)] == sorted(strings)


def slow_repeats(rows):
    """By row: (doc_id, text) -> result; null ids come last, equal ids are ordered by the text's hash."""
    first, out = {}, {}
    order = suffix_order(rows)
    for n, (doc, text) in enumerate(order):
        data = (text or "").encode()
        for p in range(len(data) - 99):
            first.setdefault(data[p : p + 100], (n, p))
    for n, (doc, text) in enumerate(order):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if first[data[p : p + 100]] < (n, p):
                gone[p : p + 100] = b"\1" * 100
        kept = bytes(c for c, g in zip(data, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[doc, text] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def suffix_order(rows):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    keyed = suffix_dedup._keyed(spark.createDataFrame(sorted(set(rows), key=str), "doc_id long, text string"))
    return [(r.doc_id, r.text) for r in sorted(keyed.collect(), key=lambda r: (r["__doc"], r["__sub"]))]


def passages():
    random.seed(9)
    base = "".join(random.choice("abcdefgh é") for _ in range(3000))
    rows = []
    for i in range(150):
        t = list(base[random.randint(0, 2000) :][: random.randint(50, 900)])
        for _ in range(random.randint(0, 4)):
            t[random.randrange(len(t))] = random.choice("xyzü")
        rows.append((i, "".join(t)))
    return rows + [(500, "a" * 1000), (501, "ab" * 400), (502, "a" * 99), (503, ""), (504, "abc" * 300), (505, "abc" * 300 + "x"), (506, None)]


def reported(docs):
    found = {}
    for r, text in ((r, r.text) for r in suffix_dedup.repeat_report(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()):
        found[r.doc_id, text] = (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
    return found


@pytest.mark.parametrize("cap", [1, suffix_dedup.GROUP_CAP])
def test_repeats(docs_of, monkeypatch, cap):
    plain = suffix_dedup.repeated_windows
    monkeypatch.setattr(suffix_dedup, "repeated_windows", lambda docs, buckets: plain(docs, buckets, cap))
    rows = passages()
    assert reported(docs_of(rows, 5)) == slow_repeats(rows)


def test_texts_longer_than_a_step(docs_of, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "POSITION_BITS", 10)
    monkeypatch.setattr(suffix_dedup, "MOST_PARTITIONS", 3)
    rows = [(i, t) for i, t in passages() if t] + [(900, passages()[0][1] * 9), (901, "ab" * 3000)]
    assert reported(docs_of(rows, 2)) == slow_repeats(rows)


def test_bytes_decide_not_hashes(docs_of, monkeypatch):
    """With a content hash that is always the same, and few anchors, results do not change."""
    monkeypatch.setattr(suffix_dedup.xxhash, "xxh3_64_intdigest", lambda _: 7)
    rows = passages()
    lots = [(i, 0, 0, (t or "").encode()) for i, t in rows if len((t or "").encode()) >= 100]
    records, _, _ = suffix_dedup._cut(lots)
    assert (records["content"] == 7).all()
    blobs = list(suffix_dedup._find_segments(iter([suffix_dedup.pa.record_batch(
        [[i for i, *_ in lots], [0] * len(lots), [t.decode() for *_, t in lots]], names=["__doc", "__sub", "text"])]), 4))
    ranges = suffix_dedup._records([b.column("blob")[0].as_py() for b in blobs if b.column("kind")[0].as_py() == suffix_dedup.RANGES], suffix_dedup.RANGE)
    data, first = {i: t for i, _, _, t in lots}, {}
    for i in sorted(data):
        for p in range(len(data[i]) - 99):
            first.setdefault(data[i][p : p + 100], (i, p))
    for doc, _, lo, hi in ranges.tolist():
        assert all(first[data[doc][p : p + 100]] < (doc, p) for p in range(lo, hi + 1))


def test_rows_with_one_id_are_told_apart(docs_of):
    random.seed(8)
    x, y = ("".join(random.choice("abcdefgh ") for _ in range(300)) for _ in range(2))
    rows = [(1, x), (4, y), (4, x + y), (None, y + x), (None, x), (7, y), (4, y)]
    expected = slow_repeats(rows)
    docs = docs_of(rows)
    report = suffix_dedup.repeat_report(docs).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in report) == sorted((i or -1, *expected[i, t][:2]) for i, t in rows)
    kept = " ".join(r.text for r in suffix_dedup.drop_repeats(docs).collect())
    assert x in kept and y in kept


def test_repeat_edges(docs_of):
    assert suffix_dedup.repeat_report(docs_of([])).count() == 0
    random.seed(1)
    long = "".join(random.choice("abcdefgh ") for _ in range(300))
    rows = docs_of([(4, long), (4, long), (None, long), (9, "é" + long), (None, None), (None, None)])
    found = sorted((r.doc_id or -1, r.n_removed) for r in suffix_dedup.repeat_report(rows).collect())
    assert found == [(-1, 0), (-1, 0), (-1, 300), (4, 0), (4, 0), (9, 300)]
    frame = docs_of([(1, long), (2, "début " + long), (3, long)])
    kept = {r.doc_id: r for r in suffix_dedup.drop_repeats(frame).collect()}
    assert kept.keys() == {1, 2} and kept[2].text == "début " and kept[2].n_chars == 6


def test_without_spans_keeps_characters():
    text = "é" * 80
    assert suffix_dedup.without_spans(text, [(1, 9)]) == "é" + "é" * (80 - 54)
