"""Names of a large dictionary found in texts by hash joins of word n-grams.

A text's words and a name's words are cut alike. For every length that a name has, the
text's n-grams of that length that begin with some name's first word meet the names in
one join on their hash (and their words), so the cost follows the text and the number of lengths, not the number of names. From the
matches of a text the leftmost is taken, of those the longest, and so on behind it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
#: Words of a text that are cut out together.
BLOCK = 32
#: First words of names that are broadcast; of a larger dictionary all n-grams are joined.
BROADCAST_FIRSTS = 500_000


def words(text: Column) -> Column:
    """Lower-case words of letters and digits, in order; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def _places(docs: DataFrame, key: str, text: str, more: int) -> DataFrame:
    """(key, first, t, local, word): every word of every text, at `local` in a block of BLOCK words
    from place `first` on; t are the block's words and `more` behind. So a row carries a few
    words and not its text. Before inner explodes the words would be cut out twice."""
    cut = docs.select(F.col(key).alias("key"), words(F.col(text)).alias("t"))
    block = lambda i: F.struct(i.alias("first"), F.slice("t", i + 1, BLOCK + more).alias("t"))
    blocks = F.when(F.size("t") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size("t") - 1, F.lit(0)), F.lit(BLOCK)), block))
    blocks = cut.select("key", F.explode_outer(blocks).alias("b")).select("key", "b.first", "b.t")
    return blocks.select("key", "first", "t", F.posexplode_outer(F.slice("t", 1, BLOCK)).alias("local", "word")).where("word is not null")


def all_matches(docs: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """(key, start, length, name) of every name at every place, in words from 0; names that
    have the same words are one, by the least spelling. Names without a word match nothing."""
    known = names.select(words(F.col(name)).alias("w"), F.col(name).alias("name")).where(F.size("w") > 0)
    known = known.groupBy("w").agg(F.min("name").alias("name")).withColumn("length", F.size("w"))
    lengths = sorted(r[0] for r in known.select("length").distinct().collect())  # few: the lengths of names
    if not lengths:
        cut = docs.select(F.col(key).alias("key"))
        return cut.select("key", F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("name")).limit(0)
    placed = _places(docs, key, text, lengths[-1] - 1)
    firsts = known.select(F.col("w")[0].alias("word")).distinct()
    if firsts.limit(BROADCAST_FIRSTS + 1).count() <= BROADCAST_FIRSTS:
        placed = placed.join(F.broadcast(firsts), "word", "left_semi")
    gram = lambda n: F.when(F.size("t") - F.col("local") >= n, F.slice("t", F.col("local") + 1, n))
    grams = placed.select("key", (F.col("first") + F.col("local")).alias("start"), F.explode(F.array(*[gram(n) for n in lengths])).alias("w"))
    hashed = grams.where("w is not null").withColumn("h", F.xxhash64("w"))
    return hashed.join(known.withColumn("h", F.xxhash64("w")), ["h", "w"]).select("key", "start", "length", "name")


def leftmost_longest(matches: DataFrame) -> DataFrame:
    """Of overlapping matches of a key the leftmost, then the longest. A key's matches meet in one row."""
    ordered = F.sort_array(F.collect_list(F.struct("start", (-F.col("length")).alias("back"), "name")))
    grouped = matches.groupBy("key").agg(ordered.alias("m"))
    kind = matches.schema["key"].dataType.simpleString()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("m")
            start, back, name = lists.flatten().flatten()
            ends, row, taken, end = np.cumsum(lists.value_lengths().to_numpy()).tolist(), 0, [], 0
            for i, (first, less) in enumerate(zip(start.to_pylist(), back.to_pylist())):
                while i >= ends[row]:
                    row, end = row + 1, 0
                if first >= end:
                    end = first - less
                    taken.append(i)
            at, taken = pa.array(np.searchsorted(ends, taken, "right"), pa.int64()), pa.array(taken, pa.int64())
            columns = [batch.column("key").take(at), start.take(taken), pc.negate(back.take(taken)), name.take(taken)]
            yield pa.record_batch(columns, names=["key", "start", "length", "name"])

    return grouped.mapInArrow(choose, f"key {kind}, start int, length int, name string")


def extract_names(docs: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """(key, start, length, name): the names in each text, none overlapping another. Keys are
    taken to be unique: rows with the same key are one text's. Texts without names have no row."""
    return leftmost_longest(all_matches(docs, key, text, names, name))
