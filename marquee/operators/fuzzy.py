"""Joins of strings by similarity, without blocks by name.

Two strings are `like` above a threshold t if either 1 - Levenshtein / longer length
("edit") or twice the longest common subsequence over both lengths ("indel") reaches
it. Both bound the edits by the lengths. The longer string of a pair is cut into one
segment more than there can be edits, so the shorter one holds a segment whole. Of
the segments it holds, one lies so that the edits before it are fewer than the
segments before it, and those behind it likewise; that leaves few places to look.
What meets by a segment is compared by its letters (a bitmap of which letter stands
how often, and one of its pairs of neighbours; the edits bound the bits that differ),
then by its Levenshtein distance before it leaves the join, and only the rest as
strings. Exact.

"indel" allows so many edits that segments are two letters long and a quarter of all
pairs meets, each at the price of a joined row. Its pairs are told apart by the same
bitmaps without a join: names are dealt to groups of a bounded size, each two groups
are a cell, and in a cell bitmaps are compared as arrays, the few pairs left by their
longest common subsequences, many pairs at a time. Exact too.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import ceil, floor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.names import edit_ratio, lcs_ratio
from marquee.operators.tables import written

#: Below this a string may lose all of its letters.
LEAST = 0.7
#: Longs of a bitmap of letters, and of one of pairs of letters.
WORDS = 4
PAIR_WORDS = 2
#: Names of a group, on average; groups that fewer names make nevertheless, of MIN_GROUP names; tasks at most.
GROUP = 32768
MIN_GROUPS = 14
MIN_GROUP = 256
MOST_TASKS = 10_000
#: Names whose bitmaps are compared at once, of either side; entries of the table of their letters.
LEFT, RIGHT = 256, 1024
TABLE = 1 << 21


def _edits(shorter: str, longer: str, kind: str, threshold: float) -> str:
    """The most edits of a like pair of these lengths, in SQL."""
    if threshold < LEAST:
        raise ValueError(f"threshold must be {LEAST} or more")
    both = longer if kind == "edit" else f"({shorter} + {longer})"
    return f"cast(floor({both} * {1 - threshold!r}D + 1e-9D) as int)"


def _cuts(length: str, parts: str) -> str:
    """The segments (number, first place, place behind) of a string of this length, in SQL."""
    cut = lambda i: f"cast(floor({i} * {length} / {parts}) as int)"
    return f"transform(sequence(0, {parts} - 1), i -> named_struct('i', i, 'from', {cut('i')}, 'to', {cut('(i + 1)')}))"


def segments(kind: str, threshold: float) -> Column:
    """Hashes of the segments of the string `name`, for pairs in which it is the longer one."""
    n = "length(name)"
    cuts = _cuts(n, f"({_edits(n, n, kind, threshold)} + 1)")
    return F.expr(f"if({n} > 0, transform({cuts}, s -> xxhash64({n}, s.i, substring(name, s.from + 1, s.to - s.from))), null)")


def probes(kind: str, threshold: float, longer_by: int = 0) -> Column:
    """Hashes of what the segments of strings like `name` that are longer by `longer_by` or more may be."""
    n = "length(name)"
    least = f"({n} + {longer_by})"
    most = f"cast(floor({n} * {1 / threshold if kind == 'edit' else (2 - threshold) / threshold!r}D + 1e-9D) as int)"
    lengths = f"transform(sequence({least}, greatest({least}, {most})), b -> named_struct('b', b, 'parts', {_edits('b', 'b', kind, threshold)} + 1))"
    behind = f"s.from - (x.b - {n})"
    window = f"""named_struct('i', s.i, 'size', s.to - s.from, 'first', greatest(0, s.from - s.i, {behind} - (x.parts - 1 - s.i)),
        'last', least({n} - (s.to - s.from), s.from + s.i, {behind} + (x.parts - 1 - s.i)))"""
    hashes = "transform(sequence(w.first, w.last), q -> xxhash64(x.b, w.i, substring(name, q + 1, w.size)))"
    windows = f"filter(transform({_cuts('x.b', 'x.parts')}, s -> {window}), w -> w.last >= w.first)"
    found = f"flatten(transform({lengths}, x -> flatten(transform({windows}, w -> {hashes}))))"
    return F.expr(f"if({n} > 0 and {most} >= {least}, array_distinct({found}), null)")


def letters(name: Column) -> Column:
    """Places of a string's letters in a bitmap, the first, second, ... of each has its own (some share one)."""
    until = lambda i: F.substring(name, 1, i)
    time = lambda i, c: F.length(until(i)) - F.length(F.replace(until(i), c, F.lit("")))
    place = lambda i, c: F.pmod(F.xxhash64(c, time(i, c)), F.lit(64 * WORDS))
    return F.when(F.length(name) > 0, F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: place(i, F.substring(name, i, 1))))


def letter_pairs(name: Column) -> Column:
    """Places of a string's pairs of neighbouring letters in a bitmap."""
    place = lambda i: F.pmod(F.xxhash64(F.substring(name, i, 2)), F.lit(64 * PAIR_WORDS))
    return F.when(F.length(name) > 1, F.transform(F.sequence(F.lit(1), F.length(name) - 1), place))


def bitmap(places: Column, words: int = WORDS) -> Column:
    """The bitmap of these places: two strings' bitmaps differ in no more bits than letters (or
    pairs) that one string has and the other lacks."""
    none = F.lit(0).cast("long")
    bit = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int"))
    word = lambda w: F.aggregate(F.filter(places, lambda b: F.shiftright(b, 6) == w), none, lambda a, b: a.bitwiseOR(bit(b)))
    # never null, or the join's filter for nulls is pushed down and computes all of this once more in the scan
    return F.struct(*[F.coalesce(word(w), none).alias(f"w{w}") for w in range(words)])


def _differing(a: str, b: str, words: int) -> Column:
    """Bits in which two bitmaps differ."""
    bits = [F.bit_count(F.col(f"{a}.w{w}").bitwiseXOR(F.col(f"{b}.w{w}"))) for w in range(words)]
    return reduce(Column.__add__, bits)


def _candidates(short: DataFrame, long: DataFrame, threshold: float, kind: str, longer_by: int = 0) -> DataFrame:
    """(short, long) of the pairs that meet by a segment and may be like by their letters and their
    Levenshtein distance, which neither kind's edits fall below; pairs may repeat.

    The explodes are outer, as inner ones compute the keys twice. A name has hundreds of probes,
    which no estimate knows, and its bytes say nothing of the meetings: keys are dealt to a given
    number of tasks and joined by sorting, so neither side is sent to all or held as a whole."""
    tasks = int(short.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = short.select(F.col("name").alias("short"), F.col("bits").alias("a"), F.col("pairs").alias("c"), F.length("name").alias("m"), F.explode_outer(probes(kind, threshold, longer_by)).alias("k"))
    right = long.select(F.col("name").alias("long"), F.col("bits").alias("b"), F.col("pairs").alias("d"), F.length("name").alias("n"), F.explode_outer(segments(kind, threshold)).alias("k"))
    left, right = (side.where("k is not null").repartition(tasks, "k") for side in (left, right))
    edits = _edits("m", "n", kind, threshold)
    # a letter lost or put in makes three pairs differ, one changed four
    letters_differ = _differing("a", "b", WORDS) <= F.expr(f"2 * {edits}" if kind == "edit" else edits)
    pairs_differ = _differing("c", "d", PAIR_WORDS) <= F.expr(f"{4 if kind == 'edit' else 3} * {edits}")
    near = (F.col("short") != F.col("long")) & F.expr(f"levenshtein(short, long, {edits}) >= 0")
    met = left.join(right.hint("merge"), "k").where(letters_differ & pairs_differ & near)
    return met.select("short", "long")


def _met(asked: DataFrame, known: DataFrame, threshold: float, kind: str) -> DataFrame:
    """(asked, known) of the different strings that are compared as strings; pairs may repeat.
    Of one table with itself a pair has one of its two orders."""
    a = _names(asked)
    names = lambda x, y: [F.col(x).alias("asked"), F.col(y).alias("known")]
    if asked is known:
        # strings of one length meet in both orders
        return _candidates(a, a, threshold, kind).where("length(short) < length(long) or short < long").select(*names("short", "long"))
    b = _names(known)
    pairs = _candidates(a, b, threshold, kind).select(*names("short", "long"))
    return pairs.unionByName(_candidates(b, a, threshold, kind, 1).select(*names("long", "short")))


def _both_orders(pairs: DataFrame) -> DataFrame:
    more = [c for c in pairs.columns if c not in ("asked", "known")]
    order = lambda x, y: F.struct(F.col(x).alias("asked"), F.col(y).alias("known"))
    return pairs.select(F.explode(F.array(order("asked", "known"), order("known", "asked"))).alias("p"), *more).select("p.asked", "p.known", *more)


def candidates(asked: DataFrame, known: DataFrame, threshold: float, kind: str = "edit") -> DataFrame:
    """(asked, known) of the different strings that are compared as strings, each pair once."""
    pairs = _met(asked, known, threshold, kind).distinct()
    return _both_orders(pairs) if asked is known else pairs


def _names(table: DataFrame) -> DataFrame:
    """Different names and their bitmaps. A few bytes of names are much work, so they are spread
    over a given number of tasks, by a hash of their own, as else the distinct's are joined by size."""
    names = table.select("name").where("name is not null").distinct()
    spread = names.repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("name"))
    return spread.withColumn("places", letters(F.col("name"))).select("name", bitmap(F.col("places")).alias("bits"), bitmap(letter_pairs(F.col("name")), PAIR_WORDS).alias("pairs"))


def _common(masks: np.ndarray, of: np.ndarray, letters_: np.ndarray, length: int) -> np.ndarray:
    """Lengths of longest common subsequences as in lcs_ratio, of many pairs at once: `masks` has
    for each string of `length` letters the places of each letter, `of` is a pair's string, `letters_` the other's letters."""
    full = np.uint64((1 << length) - 1)
    row, flat, begin = np.full(len(of), full), masks.ravel(), of * masks.shape[1]
    for letter in letters_:
        hit = flat.take(begin + letter)
        hit &= row
        less = row - hit
        row += hit
        row |= less
    return length - np.bitwise_count(row & full).astype(np.int64)


class _Side:
    """The names of one side of a cell by length: their numbers, bitmaps and letters."""

    def __init__(self, table: pa.Table, known_letters: Callable[[list[str]], np.ndarray]):
        self.names = table["name"].to_pylist()
        words = lambda c, n: np.stack([table[f"{c}{w}"].to_numpy().view(np.uint64) for w in range(n)])
        self.bits, self.pairs = words("b", WORDS), words("p", PAIR_WORDS)
        self.folded = np.bitwise_or.reduce(self.bits, axis=0)
        lengths = np.array([len(x) for x in self.names], dtype=np.int64)
        self.by_length = {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths) if n}
        self.letters = {n: known_letters([self.names[i] for i in at]).reshape(len(at), n).T.copy() for n, at in self.by_length.items()}


def _like_in_cell(cell: pa.Table, threshold: float) -> pa.Table:
    """(asked, known, ratio) of the pairs of a cell: a name of one side, one of the other; if the
    cell is of one group with itself, each two of its names."""
    left = cell.filter(cell["left"])
    one_group = bool(cell["same"][0].as_py())
    points = lambda names: np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    alphabet = np.unique(points(cell["name"].to_pylist()))
    places = lambda names: np.searchsorted(alphabet, points(names))
    a = _Side(left, places)
    b = a if one_group else _Side(cell.filter(pc.invert(cell["left"])), places)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    # the shorter string's letters are looked up, so each side is the shorter one once; names of one length meet once
    for short, long, swapped in ((a, b, False),) if one_group else ((a, b, False), (b, a, True)):
        for m, rows in short.by_length.items():
            step = max(1, min(LEFT, TABLE // len(alphabet)))
            for at in range(0, len(rows), step):
                one = rows[at : at + step]
                masks = None
                for n, others in long.by_length.items():
                    edits = floor((m + n) * (1 - threshold) + 1e-9)
                    edits -= (m + n - edits) % 2  # letters of both less those common to both, twice
                    if n < m or n - m > edits or (n == m and swapped):
                        continue
                    for begin in range(0, len(others), RIGHT):
                        two = others[begin : begin + RIGHT]
                        near = np.bitwise_count(short.folded[one][:, None] ^ long.folded[two][None, :]) <= edits
                        i, j = np.divmod(np.flatnonzero(near), len(two))
                        for x, y, most in ((short.bits, long.bits, edits), (short.pairs, long.pairs, 3 * edits)):
                            u, v, differ = one[i], two[j], np.zeros(len(i), dtype=np.uint16)
                            for of_x, of_y in zip(x, y):
                                differ += np.bitwise_count(of_x.take(u) ^ of_y.take(v))
                            left_over = np.flatnonzero(differ <= most)
                            i, j = i[left_over], j[left_over]
                        if one_group and n == m:
                            i, j = i[one[i] < two[j]], j[one[i] < two[j]]
                        if not len(i):
                            continue
                        if m < 64:
                            if masks is None:
                                masks = np.zeros((len(one), len(alphabet)), dtype=np.uint64)
                                of = short.letters[m][:, at : at + step]
                                for k in range(m):
                                    masks[np.arange(len(one)), of[k]] |= np.uint64(1 << k)
                            ratio = 2 * _common(masks, i, long.letters[n][:, begin + j], m) / (m + n)
                        else:
                            ratio = np.array([lcs_ratio(short.names[x], long.names[y]) for x, y in zip(one[i], two[j])])
                        like = (ratio >= threshold) & (ratio < 1)
                        x, y = one[i[like]], two[j[like]]
                        found.append((y, x, ratio[like]) if swapped else (x, y, ratio[like]))
    x, y, ratio = (np.concatenate(c) if found else np.array([], dtype=np.int64) for c in (zip(*found) if found else ((), (), ())))
    names = lambda side, at: pa.array([side.names[k] for k in at], pa.string())
    return pa.table({"asked": names(a, x), "known": names(b, y), "ratio": pa.array(ratio, pa.float64())})


def _like_in_cells(asked: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """(asked, known, ratio) of the different strings that are like by "indel", each pair once; of one
    table with itself in one of its two orders. A name goes to as many cells as the other side has groups."""
    _edits("1", "1", "indel", threshold)
    flat = ["name", *[F.col(f"bits.w{w}").alias(f"b{w}") for w in range(WORDS)], *[F.col(f"pairs.w{w}").alias(f"p{w}") for w in range(PAIR_WORDS)]]
    sides = [written(_names(t).select(*flat), "names") for t in ([asked] if asked is known else [asked, known])]
    groups = [max(1, ceil(n / GROUP), min(MIN_GROUPS, ceil(n / MIN_GROUP))) for n in (side.count() for side in sides)]
    in_group = [side.withColumn("g", F.pmod(F.xxhash64(F.lit("group"), "name"), F.lit(of))) for side, of in zip(sides, groups)]
    other = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of - 1).cast("long"))).alias("o")
    if asked is known:
        both = in_group[0].select("*", other(groups[0]))
        first = F.col("g") <= F.col("o")
        rows = both.select(*both.columns[:-2], F.least("g", "o").alias("i"), F.greatest("g", "o").alias("j"), first.alias("left"), (F.col("g") == F.col("o")).alias("same"))
        cells = groups[0] * (groups[0] + 1) // 2
    else:
        a, b = in_group[0].select("*", other(groups[1])), in_group[1].select("*", other(groups[0]))
        rows = a.withColumnsRenamed({"g": "i", "o": "j"}).withColumn("left", F.lit(True)).unionByName(b.withColumnsRenamed({"g": "j", "o": "i"}).withColumn("left", F.lit(False)))
        rows, cells = rows.withColumn("same", F.lit(False)), groups[0] * groups[1]
    # a given number of tasks, as a cell's few bytes are much work
    dealt = rows.repartition(min(cells, MOST_TASKS), "i", "j")
    return dealt.groupBy("i", "j").applyInArrow(lambda cell: _like_in_cell(cell, threshold), "asked string, known string, ratio double")


def like_pairs(asked: DataFrame, known: DataFrame, threshold: float, kind: str = "edit") -> DataFrame:
    """(asked, known, ratio) of all strings of the column `name` of both that are like each other,
    each pair once. Nulls are like nothing; equal strings, empty ones too, have the ratio 1."""
    a, b = (t.select("name").where("name is not null").distinct() for t in (asked, known))
    if kind == "edit":
        ratio = edit_ratio(F.col("asked"), F.col("known"))
        other = _met(asked, known, threshold, kind).distinct().withColumn("ratio", ratio).where(F.col("ratio") >= threshold)
    else:
        other = _like_in_cells(asked, known, threshold)
    other = _both_orders(other) if asked is known else other
    same = a.join(b, "name").select(F.col("name").alias("asked"), F.col("name").alias("known"), F.lit(1.0).alias("ratio"))
    return same.unionByName(other)


def best_matches(asked: DataFrame, known: DataFrame, threshold: float, kind: str = "edit") -> DataFrame:
    """(name, best, ratio): for each asked name the known one that is most like it, the first by
    name of several; names like none do not appear."""
    first = F.min(F.struct((-F.col("ratio")).alias("r"), "known")).alias("b")
    found = like_pairs(asked, known, threshold, kind).groupBy(F.col("asked").alias("name")).agg(first)
    return found.select("name", F.col("b.known").alias("best"), (-F.col("b.r")).alias("ratio"))
