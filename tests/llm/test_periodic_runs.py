import hashlib
import random
import zlib

import numpy as np
import pytest

from marquee.llm import periodic_runs as pr


def slow_runs(words):
    """Every maximal repetition of every period, kept if the period is its smallest."""
    n, found = len(words), []

    def smallest(s, e):
        return next(q for q in range(1, e - s + 1) if all(words[i] == words[i + q] for i in range(s, e - q)))

    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            e = i + q
            if e - s >= max(6, 4 * q) and smallest(s, e) == q:
                found.append((s, e - s, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def slow_row(doc_id, text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = None
    for s, m, q in runs:
        if best is None or m * best[2] > best[1] * q:
            best = (s, m, q)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id,
        len(runs),
        *(best or (None,) * 3),
        best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def made(rng):
    """Nested, adjoining and broken repeats over few letters."""
    out = []
    while len(out) < rng.randint(6, 90):
        unit = [rng.choice("ab" if rng.random() < 0.5 else "abcd") for _ in range(rng.randint(1, 7))]
        if rng.random() < 0.4:
            unit = unit * rng.randint(1, 6) + [rng.choice("abc")]
        out += unit * rng.randint(1, 7) + [rng.choice("abcde") for _ in range(rng.randint(0, 3))]
    return out


@pytest.mark.parametrize("seed", range(300))
def test_runs_against_brute_force(seed):
    words = made(random.Random(seed))
    ids = np.array([ord(w) for w in words], np.int64)
    assert pr.find_runs(ids) == slow_runs(words)


def test_one_word_and_long_periods():
    assert pr.find_runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    long = np.concatenate([np.tile(np.arange(9_999), 5), [3]])
    assert pr.find_runs(long) == [(0, 5 * 9_999, 9_999)]
    assert pr.find_runs(np.zeros(5, np.int64)) == []
    assert pr.find_runs(np.zeros(6, np.int64)) == [(0, 6, 1)]
    assert pr.find_runs(np.array([1, 2] * 4)) == [(0, 8, 2)]
    assert pr.find_runs(np.array([1, 2] * 3 + [1])) == []


def test_report_against_brute_force(docs_of):
    rng = random.Random(7)
    rows = [(i, " ".join(made(rng))) for i in range(200)]
    rows += [(None, "x " * 9), (None, None), (201, None), (202, ""), (203, " \t\n "), (204, "a a " * 6), (205, "É é " * 8)]
    rows += [rows[3], rows[3], (10, rows[3][1]), (206, "w" * 50_000), (207, " ".join("ab" * 3_000))]
    got = sorted((tuple(r) for r in pr.run_report(docs_of(rows), pr.with_planted_runs).collect()), key=repr)
    assert got == sorted((slow_row(*r) for r in rows), key=repr)


def test_collapsed_text_and_spans(docs_of):
    row = pr.runs_and_rest(docs_of([(1, "head one two one two one two one two tail")])).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 8, 2)]
    assert row["collapsed"] == "head one two tail" and row["n_words"] == 10


def test_empty_table(docs_of):
    empty = docs_of([(1, "x")]).where("doc_id < 0")
    assert pr.run_report(empty).count() == 0
