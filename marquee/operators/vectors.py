"""Vector search and near-duplicate signatures."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.operators.ranking import top_per_key
from marquee.operators.tables import written


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity between 0 and 1 (negative ones are 0; zero vectors have none)."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v
    )
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, F.least(F.greatest(dot(a, b) / norms, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def search(vectors: DataFrame, embedding: str, key: str, query: list[float], k: int) -> DataFrame:
    """The k nearest vectors with `similarity`; equal ones by key. The query is a
    literal, so the scan scores rows where they are and keeps k of each task."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.withColumn("similarity", cosine(F.col(embedding), literal)).drop(embedding)
    return scored.orderBy(F.desc("similarity"), key).limit(k)


def search_capped(vectors: DataFrame, embedding: str, key: str, source: str, query: list[float], per_source: int, k: int) -> DataFrame:
    """As `search`, with at most `per_source` rows of each source."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.withColumn("similarity", cosine(F.col(embedding), literal)).drop(embedding)
    capped = top_per_key(scored, [source], [F.desc("similarity"), key], per_source)
    return capped.orderBy(F.desc("similarity"), key).limit(k)


def search_many(vectors: DataFrame, queries: DataFrame, embedding: str, key: str, k: int) -> DataFrame:
    """(query_id, key, similarity): the k nearest of each query (query_id, qvec). The
    queries are a stated set; they are the side that is sent to all tasks."""
    scored = vectors.crossJoin(F.broadcast(queries)).select("query_id", key, cosine(F.col(embedding), F.col("qvec")).alias("similarity"))
    return top_per_key(scored, ["query_id"], [F.desc("similarity"), key], k)


def sign_hash(embedding: str) -> Column:
    """A 64-bit hash of the signs of 64 dimensions."""
    bits = [F.when(F.get(embedding, i) > 0, F.lit(-(1 << 63) if i == 63 else 1 << i)).otherwise(F.lit(0)).cast("long") for i in range(64)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hex_to_long(h: Column) -> Column:
    """Up to 16 hexadecimal digits as a signed 64-bit integer."""
    return F.conv(h, 16, -10).cast("long")


#: What a key costs, in meetings of two hashes.
KEY = 20
#: Classes of words by which token sets are ordered: a table of 16 MB.
BUCKETS = 1 << 22
#: Rows whose tokens a worker orders at once.
SLICE = 1_000
#: Tokens that two sets must share in their beginnings to be compared.
SHARED = 4


def _ball(width: int, bits: int) -> int:
    return sum(math.comb(width, n) for n in range(bits + 1))


def block_plan(rows: int, most_bits: int) -> list[tuple[int, int, int, int]]:
    """(shift, width, near on one side, near on the other) of each block that 64-bit hashes are cut
    into. Of b blocks one differs in most_bits // b bits at most, of which each side takes its
    half. Few narrow blocks have few keys and many chance meetings, wide ones the reverse; the
    number of blocks is that of the least of both for so many rows, where a key, which is
    shuffled and sorted, counts as `KEY` meetings, which are not."""

    def plan(blocks: int) -> list[tuple[int, int, int, int]]:
        cuts, near = [64 * i // blocks for i in range(blocks + 1)], most_bits // blocks
        return [(a, b - a, (near + 1) // 2, near // 2) for a, b in zip(cuts, cuts[1:])]

    def cost(blocks: int) -> float:
        keys = sum(_ball(w, x) + _ball(w, y) for _, w, x, y in plan(blocks))
        met = sum(_ball(w, x) * _ball(w, y) / 2.0**w for _, w, x, y in plan(blocks))
        return KEY * rows * keys + rows * rows * met / 2

    return plan(min(range(2, 9), key=cost))


def _around(block: Column, width: int, bits: int) -> Column:
    """A block and all blocks within `bits` of it."""
    masks = [sum(1 << i for i in c) for n in range(bits + 1) for c in combinations(range(width), n)]
    return F.transform(F.split(F.lit(",".join(map(str, masks))), ",").cast("array<long>"), block.bitwiseXOR)


def hash_neighbours(rows: DataFrame, key: str, h: str, most_bits: int) -> DataFrame:
    """Pairs (a, b, distance), a < b, of 64-bit hashes within `most_bits`.

    Exact: the blocks of `block_plan` are joined on, each side giving all blocks near its own.
    The width of the blocks follows the number of rows, which is counted first. Two rows of one
    key have a pair each. A row has hundreds of blocks, which no estimate knows from the size of
    the file, so rows are dealt out before, and the join is told to be one by sorting: neither
    side is sent to all or held as a whole.
    """
    spark = rows.sparkSession
    rows = written(rows.select(key, h), "hashes")
    spread = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), h)
    plan = block_plan(max(rows.count(), 2), most_bits)

    def of_block(number: int, shift: int, width: int, near: int) -> Column:
        own = F.shiftrightunsigned(F.col(h), shift).bitwiseAND(F.lit((1 << width) - 1))
        return F.transform(_around(own, width, near), lambda z: F.struct(F.lit(number).alias("n"), z.alias("z")))

    def keyed(side: str, which: int) -> DataFrame:
        keys = [of_block(number, shift, width, near[which]) for number, (shift, width, *near) in enumerate(plan)]
        return spread.select(F.col(key).alias(side), F.col(h).alias(f"h{side}"), F.explode(F.concat(*keys)).alias("block"))

    distance = hamming(F.col("ha"), F.col("hb"))
    met = keyed("a", 0).join(keyed("b", 1).hint("merge"), "block").where((F.col("a") < F.col("b")) & (distance <= most_bits))
    return met.select("a", "b", "ha", "hb").distinct().select("a", "b", distance.alias("distance"))


def _word_counts(sets: DataFrame) -> np.ndarray:
    """How often words of each of BUCKETS classes of words occur: a table of fixed size, whatever the vocabulary."""
    buckets = sets.select(F.explode("t").alias("w")).groupBy(F.pmod("w", F.lit(BUCKETS)).cast("int").alias("i")).agg(F.count("*").alias("n"))
    found = buckets.select("i", F.least("n", F.lit((1 << 31) - 1)).cast("int").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int32)
    counts[found["i"].to_numpy()] = found["n"].to_numpy()
    return counts


def _rare_first(sets: DataFrame, key: str, counts: np.ndarray) -> DataFrame:
    """`sets` with the tokens of t ordered by the counts of their classes, then by themselves."""
    sent = sets.sparkSession.sparkContext.broadcast(counts)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                part = batch.slice(first, SLICE)
                lists = part.column("t")
                words, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
                at = np.lexsort((words, sent.value[words % BUCKETS], np.repeat(np.arange(len(sizes)), sizes)))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                ordered = pa.ListArray.from_arrays(pa.array(offsets), pa.array(words[at]))
                yield pa.record_batch([part.column(key), ordered], names=[key, "t"])

    return sets.select(key, "t").mapInArrow(order, f"`{key}` {sets.schema[key].dataType.simpleString()}, t array<bigint>")


def _bands(threshold: float) -> list[int]:
    """The least size of each band of sizes; a set within the threshold of a larger one is in its band or the one below."""
    least = [1]
    while least[-1] < 1 << 30:
        least.append(math.floor(least[-1] / threshold + 1e-9) + 1)
    return least


def jaccard_pairs(sets: DataFrame, key: str, threshold: float, counted: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b, jaccard), a < b, of rows of `sets` (key, t: distinct longs) above the threshold.

    Prefix filtering: with tokens in one order, about from rare to frequent (as `counted`, or
    `sets`, has them), two sets that share s tokens share SHARED of the first that have
    s - SHARED + 1 left from there on, in either set. So only those beginnings are joined, pairs are
    counted by what they share there, and only pairs that share so many have their tokens
    compared. Sizes differ by the threshold at most: tokens are joined by size band too, which
    splits frequent ones. The Jaccard of the survivors is exact.
    """
    ordered = written(_rare_first(sets, key, _word_counts(sets if counted is None else counted)), "ordered")
    lows = F.split(F.lit(",".join(map(str, _bands(threshold)))), ",").cast("array<int>")
    sized = ordered.select(F.col(key), F.size("t").alias("n"), "t").withColumn("band", F.size(F.filter(lows, lambda low: low <= F.col("n"))))

    def beginning(least_other: Column) -> Column:
        """Tokens from which on enough is left, if the other set has so many."""
        least = F.lit(threshold / (1 + threshold)) * (F.col("n") + least_other)
        return F.slice("t", F.lit(1), F.least(F.col("n"), F.floor(F.col("n") - least + SHARED + 1e-9).cast("int")))

    heads = sized.select(F.col(key), "n", "band", F.posexplode(beginning(F.col("n"))).alias("at", "w"))
    low = F.get(lows, F.col("band") - 1)
    smallest = F.ceil(F.lit(threshold) * F.col("n") - 1e-9)
    same = sized.select(F.col(key), "n", "band", F.posexplode(beginning(F.greatest(smallest, low))).alias("at", "w"))
    below = sized.where(smallest < low).select(F.col(key), "n", (F.col("band") - 1).alias("band"), F.posexplode(beginning(smallest)).alias("at", "w"))
    other = same.unionByName(below).withColumnsRenamed({key: f"{key}2", "n": "n2", "at": "at2"})
    smaller = (F.col("n") < F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col(key) < F.col(f"{key}2")))
    least = F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("n2"))
    room = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))
    met = heads.join(other.hint("merge"), ["w", "band"]).where(smaller & (F.col("n2") * threshold < F.col("n") + 1e-9) & (room > least - SHARED + 1 - 1e-9))
    need = F.least(F.lit(SHARED), F.ceil(least - 1e-9))
    pairs = met.groupBy(F.least(key, f"{key}2").alias("a"), F.greatest(key, f"{key}2").alias("b")).agg(F.count("*").alias("c"), F.max(need).alias("need"))
    pairs = written(pairs.where("c >= need").select("a", "b"), "pairs")
    left, right = ordered.withColumnsRenamed({key: "a", "t": "ta"}), ordered.withColumnsRenamed({key: "b", "t": "tb"})
    shared = F.size(F.array_intersect("ta", "tb"))
    similarity = shared / (F.size("ta") + F.size("tb") - shared)
    return pairs.join(left, "a").join(right, "b").select("a", "b", similarity.alias("jaccard")).where(F.col("jaccard") > threshold)


def linked_classes(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """`members` (key, class_id) with n_links, the number of other classes that theirs
    is paired with. Equal rows are one class, so copies are never expanded to pairs."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class_id"))
    counts = ends.groupBy("class_id").agg(F.count("*").alias("n_links"))
    return members.join(counts, "class_id", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))


def near_hashes(rows: DataFrame, key: str, h: str, most_bits: int) -> DataFrame:
    """(key, class_id, n_links): rows of one hash are a class named by its least key; a
    class links to those whose hashes differ in at most `most_bits`."""
    classes = rows.groupBy(h).agg(F.min(key).alias("class_id"))
    members = rows.join(classes, h).select(key, "class_id")
    return linked_classes(members, hash_neighbours(classes, "class_id", h, most_bits))


def near_token_sets(docs: DataFrame, key: str, tokens: Column, threshold: float) -> DataFrame:
    """(key, class_id, n_links): rows of one token set are a class; a class links to
    those with a Jaccard similarity above the threshold. Rows without tokens are
    classes of their own."""
    hashed = F.sort_array(F.array_distinct(F.transform(tokens, lambda w: F.xxhash64(w))))
    sets = written(docs.select(key, hashed.alias("t")), "sets")
    # the digest is of the set, not of its 64-bit hash: classes are not joined by chance
    digest = F.when(F.size("t") > 0, F.sha2(F.array_join(F.transform("t", lambda w: w.cast("string")), " "), 256)).otherwise(F.concat(F.lit("empty "), key))
    named = sets.select(key, digest.alias("d"))
    classes = written(named.groupBy("d").agg(F.min(key).alias("class_id")), "classes")
    members = named.join(classes, "d").select(key, "class_id")
    # sets of fewer tokens are above the threshold with themselves only
    least = math.ceil(threshold / (1 - threshold) - 1e-9) if threshold < 1 else 1 << 30
    heads = sets.where(F.size("t") >= least).join(classes.select(F.col("class_id").alias(key)), key, "left_semi")
    return linked_classes(members, jaccard_pairs(heads, key, threshold, sets))
