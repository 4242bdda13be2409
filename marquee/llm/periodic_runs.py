"""Stretches of a text that repeat one block of words: found exactly, collapsed to one copy.

A run is a stretch of consecutive words with smallest period q that no neighbouring
word extends. Runs of at least four periods (and six words) are found scale by scale.
At scale k, for periods from 2^k to below 2^(k+1), every such run holds a block of 2^k
words that begins at a multiple of 2^k, and again one period later. So the aligned blocks
are keys of an automaton over word numbers (pyahocorasick, integer sequences), the text is
searched for them, and an occurrence whose distance fits the scale is a seed that is
extended word by word to both sides.

What cannot be part of a run is left out first, without losing one: each word of a run
but for its last period has its next copy within a period, so blocks outside long
stretches of such words are no keys, nor are blocks all of whose seeds lie in a run
of a smaller scale with a period that divides the distance.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LEAST_WORDS, LEAST_PERIODS = 6, 4

Run = tuple[int, int, int]


def _agreeing(left: np.ndarray, right: np.ndarray) -> int:
    """How many leading words two sequences share, read in growing chunks."""
    n, at, chunk = min(len(left), len(right)), 0, 32
    while at < n:
        differ = left[at : min(n, at + chunk)] != right[at : min(n, at + chunk)]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at, chunk = at + chunk, chunk * 2
    return n


def _extended(ids: np.ndarray, i: int, j: int, size: int) -> tuple[int, int]:
    """The longest stretch [start, end) with period j - i around equal blocks at i and j."""
    end = j + size + _agreeing(ids[i + size :], ids[j + size :])
    return i - _agreeing(ids[:i][::-1], ids[:j][::-1]), end


def _smaller_period(ids: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether a proper divisor of the period is a period too (in a stretch of two
    periods and more, the smallest period divides every other)."""
    rest, r = period, 2
    while rest > 1:
        if r * r > rest:
            r = rest
        if rest % r == 0:
            q = period // r
            if np.array_equal(ids[start : end - q], ids[start + q : end]):
                return True
            while rest % r == 0:
                rest //= r
        r += 1
    return False


class _Known:
    """The runs of one scale. None lies in another, so both ends ascend."""

    def __init__(self, runs: list[Run]):
        self.starts, self.ends, self.periods = (np.array(c, np.int64) for c in zip(*((s, s + n, q) for s, n, q in sorted(runs))))

    def holding(self, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the last run that starts at or before `at` reaches `end`, and its period."""
        last = np.searchsorted(self.starts, at, "right") - 1
        return (last >= 0) & (self.ends[last] >= end), self.periods[last]


def _seeds(ids: np.ndarray, size: int, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block, occurrence) pairs at distances from `size` to below twice that, by block."""
    n = len(ids)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    own: dict[tuple[int, ...], list[int]] = {}
    for b in blocks.tolist():
        own.setdefault(tuple(ids[b : b + size].tolist()), []).append(b)
    for number, key in enumerate(own):
        automaton.add_word(key, number)
    automaton.make_automaton()
    met: list[list[int]] = [[] for _ in own]
    cuts = np.flatnonzero(np.diff(blocks) > 3 * size) + 1
    for zone in np.split(blocks, cuts):
        low, high = int(zone[0]), min(n, int(zone[-1]) + 3 * size)
        for last, number in automaton.iter(tuple(ids[low:high].tolist())):
            met[number].append(low + last - size + 1)
    firsts: list[int] = []
    seconds: list[int] = []
    for mine, there in zip(own.values(), met):
        for b in mine:
            near = there[bisect_left(there, b + size) : bisect_left(there, b + 2 * size)]
            firsts += [b] * len(near)
            seconds += near
    first, second = np.array(firsts, np.int64), np.array(seconds, np.int64)
    order = np.argsort(first, kind="stable")
    return first[order], second[order]


def find_runs(ids: np.ndarray) -> list[Run]:
    """All runs (start, length, period) of a sequence of word numbers, by start, then period."""
    n = len(ids)
    if n < LEAST_WORDS:
        return []
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    to_next = np.full(n, n, np.int64)
    to_next[order[:-1][same]] = (order[1:] - order[:-1])[same]
    known: list[_Known] = []
    found: list[Run] = []
    size = 1
    while LEAST_PERIODS * size <= n:
        breaks = np.flatnonzero(to_next >= 2 * size)
        edges = np.concatenate(([-1], breaks, [n]))
        least = max(LEAST_WORDS, LEAST_PERIODS * size) - size
        wide = np.flatnonzero(np.diff(edges) > least)
        if len(wide):
            blocks = np.concatenate([np.arange(-(-(edges[w] + 1) // size) * size, edges[w + 1] - size + 1, size) for w in wide])
            for runs in known:
                inside, period = runs.holding(blocks, np.minimum(blocks + 3 * size, n))
                blocks = blocks[~(inside & (period <= size))]
            here: set[Run] = set()
            if len(blocks):
                first, second = _seeds(ids, size, blocks)
                for runs in known:
                    inside, period = runs.holding(first, second + size)
                    fresh = ~(inside & ((second - first) % period == 0))
                    first, second = first[fresh], second[fresh]
                reached: dict[int, int] = {}
                for i, j in zip(first.tolist(), second.tolist()):
                    period = j - i
                    if j + size <= reached.get(period, 0):
                        continue
                    start, end = _extended(ids, i, j, size)
                    reached[period] = end
                    enough = end - start >= max(LEAST_WORDS, LEAST_PERIODS * period)
                    if enough and not _smaller_period(ids, start, end, period):
                        here.add((start, end - start, period))
            if here:
                known.append(_Known(list(here)))
                found += here
        size *= 2
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words: list[str], runs: list[Run]) -> list[str]:
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]


def as_written(doc_id: int | None, words: list[str]) -> list[str]:
    return words


def with_planted_runs(doc_id: int | None, words: list[str]) -> list[str]:
    """The words of a tenth of the documents, chosen by crc32 of the decimal doc_id, with
    a tail that repeats (a null doc_id is never chosen)."""
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def runs_and_rest(docs: DataFrame, words_of: Callable[[int | None, list[str]], list[str]] = as_written) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of `docs`.

    runs: array of (start, length, period) by start, then period, in words from 0;
    collapsed: the kept words joined by one space. Words are what stands between ASCII
    white space; `words_of` may change them first. Null and empty texts have no words, no
    runs and an empty rest. Rows are judged one by one, so repeated rows and equal or null
    doc_ids stay rows; other columns are not read; an empty table gives no rows. A text
    is held by one task; memory and time grow with its length, not with its repeats.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found, rests = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(doc_id, WORDS.findall(text or ""))
                numbers: dict[str, int] = {}
                ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
                runs = find_runs(ids)
                counts.append(len(words))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                rests.append(" ".join(collapsed(words, runs)))
            yield pa.record_batch(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(found, RUNS), pa.array(rests, pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    )


def _strongest(runs: Column) -> Column:
    """The run of the greatest exact length / period; of equals the first by start, then period."""

    def better(best: Column, run: Column) -> Column:
        return F.when(best["length"] * run["period"] >= run["length"] * best["period"], best).otherwise(run)

    return F.when(F.size(runs) > 0, F.reduce(runs, runs[0], better))


def run_report(docs: DataFrame, words_of: Callable[[int | None, list[str]], list[str]] = as_written) -> DataFrame:
    """Digest of `runs_and_rest`: number of runs, the strongest one, and checksums."""
    best = F.col("best")
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return (
        runs_and_rest(docs, words_of)
        .withColumn("best", _strongest(F.col("runs")))
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            best["start"].alias("start"),
            best["length"].alias("length"),
            best["period"].alias("period"),
            F.expr("1000 * best.length div best.period").alias("exponent_milli"),
            F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
            F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )
