"""SimHash near-duplicates through a pivot distance table.

Each document gets a 64-bit SimHash of its 3-word shingles. For each distinct
fingerprint a row of the pivot table is computed once: its Hamming distances to 61
reference fingerprints, which are 0 and, in each of four 16-bit blocks, the 15 Walsh
functions of that block.

1. Candidates. A pair within 2 bits is equal in two blocks at least, and there its
   distances to the block's pivots, less that to 0, are the same. Rows of the table
   are equi-joined on these coordinates for each of the six choices of two blocks.
2. Discarding. By the triangle inequality fingerprints within 2 bits differ by at
   most 2 in every coordinate; a pair with a larger difference is discarded. (Within
   a block of many differing bits some Walsh function always shows one.)
3. Verifying. Survivors are compared bit by bit.

A bucket of more than `bucket_cap` fingerprints forms no pairs. It gets pivots of its
own: the strings within 1 bit of its members. Two members within 2 bits have one of
them in common, at a distance of 1 at most from both; by the triangle inequality all
members that near to a pivot are within 2 bits of each other, and there are at most
65. So they link as a star, and the bucket's work is linear. No link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.shared import connected_components, materialize, merged, packed, slices, unpacked, utf8

SHINGLE_WORDS = 3
MAX_BITS = 2
BUCKET_CAP = 64
BLOCKS, BLOCK_BITS = 4, 16


def fingerprint(text: bytes) -> int:
    """Unsigned SimHash of one text: lower-case A-Z, words between ASCII white
    space, 3-word shingles with repeats; fewer words make one shingle, none give 0."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE_WORDS:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: -SHINGLE_WORDS]))
        view, digest = memoryview(line), xxhash.xxh64_intdigest
        hashes = [digest(view[a:b], 42) for a, b in zip(starts.tolist(), (ends[SHINGLE_WORDS - 1 :] - 1).tolist())]
    ones = np.zeros(64, np.int64)
    array = np.array(hashes, dtype="<u8")
    for k in range(0, len(array), 65536):  # bounded memory for very long texts
        part = array[k : k + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(array), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        values = np.array([fingerprint(t) for t in utf8(batch.column("text").to_pylist())], dtype=np.uint64)
        yield pa.record_batch([batch.column("doc_id"), pa.array(values.view(np.int64))], names=["doc_id", "fp"])


def _hashed_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        for out in _fingerprints(iter([batch])):
            yield pa.record_batch([*out.columns, batch.column("__hash")], names=["doc_id", "fp", "__hash"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def pivots() -> list[int]:
    """The fingerprints that distances are taken to: 0, then block by block 15 Walsh functions.
    Any two of a block differ in half of its bits. Bit 0 of a block is in none of them, so
    fingerprints that differ there only have the same coordinates but for pivot 0; they meet, as keys only get wider by it."""
    walsh = [sum(1 << i for i in range(BLOCK_BITS) if (i & j).bit_count() & 1) for j in range(1, BLOCK_BITS)]
    return [0] + [row << BLOCK_BITS * block for block in range(BLOCKS) for row in walsh]


def pivot_table(distinct: DataFrame) -> DataFrame:
    """(fp, distances): the Hamming distances of each fingerprint to the pivots, a byte each."""
    distance = lambda p: F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p)))).cast("byte")
    return distinct.select("fp", F.array(*map(distance, pivots())).alias("distances"))


def _bucket_keys() -> Column:
    """For each two blocks a hash of the row's coordinates there, less that of pivot 0."""
    at = lambda block: range(1 + (BLOCK_BITS - 1) * block, 1 + (BLOCK_BITS - 1) * (block + 1))
    keys = [
        F.xxhash64(F.lit(n), *[F.col("distances")[k] - F.col("distances")[0] for b in pair for k in at(b)])
        for n, pair in enumerate(combinations(range(BLOCKS), 2))
    ]
    return F.explode(F.array(*keys))


def _buckets(distinct: DataFrame) -> DataFrame:
    """(key, fp, n, distances) of buckets of n > 1 fingerprints."""
    table = materialize(pivot_table(distinct), "pivots")
    keyed = materialize(table.select(_bucket_keys().alias("key"), "fp"), "keyed")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return materialize(keyed.join(merged(sizes), "key").join(merged(table), "fp"), "members")


def _candidates(small: DataFrame) -> DataFrame:
    """(u, v, discarded, bits) of the pairs of each bucket; a pair may be in several. bits is
    null for what the coordinates discard."""
    far = F.exists(F.zip_with("a.distances", "b.distances", lambda x, y: F.abs(x - y)), lambda d: d > MAX_BITS)
    bits = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp")))
    return (
        small.alias("a")
        .join(merged(small.alias("b")), (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")))
        .select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"), far.alias("discarded"), F.when(~far, bits).alias("bits"))
    )


def pair_counts(distinct: DataFrame, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """(considered, discarded, verified, linked): how many pairs of the buckets up to
    `bucket_cap` are looked at, go by the coordinates, are compared, and link."""
    members = _buckets(distinct)
    return (
        _candidates(members.where(F.col("n") <= bucket_cap))
        .distinct()
        .agg(
            F.count("*").alias("considered"), F.count_if("discarded").alias("discarded"), F.count("bits").alias("verified"),
            F.count_if(F.col("bits") <= MAX_BITS).alias("linked"),
        )
    )


def links(distinct: DataFrame, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of distinct `fp` values
    within 2 bits. Pairs of small buckets are all there; those of a large bucket
    as stars around pivots that are within 1 bit."""
    members = _buckets(distinct)
    small, large = members.where(F.col("n") <= bucket_cap), members.where(F.col("n") > bucket_cap)
    pairs = _candidates(small).where(~F.col("discarded") & (F.col("bits") <= MAX_BITS)).select("u", "v")
    near = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)]
    stars = (
        large.select("fp")
        .distinct()
        .select("fp", F.explode(F.array(*near)).alias("pivot"))
        .groupBy("pivot")
        .agg(F.sort_array(F.collect_list("fp")).alias("fps"))  # at most 65
        .where(F.size("fps") > 1)
        .select(F.col("fps")[0].alias("u"), F.explode(F.slice("fps", 2, 64)).alias("v"))
    )
    return pairs.unionByName(stars)


def _members(prints: DataFrame, bucket_cap: int) -> DataFrame:
    """(fp, component, component_id) of every fingerprint; component is not null and
    the same for two fingerprints exactly if they are connected."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    labels = connected_components(links(distinct, bucket_cap)).withColumnRenamed("u", "fp")
    labelled = materialize(distinct.join(merged(labels), "fp", "left"), "labelled")
    least = materialize(
        labelled.where("component is not null").groupBy("component").agg(F.min("first_id").alias("least_id")), "least"
    )
    alone = F.col("component").isNull()
    component = F.struct(alone.alias("alone"), F.coalesce("component", "fp").alias("label")).alias("component")
    return materialize(
        labelled.join(merged(least), "component", "left").select("fp", component, F.coalesce("least_id", "first_id").alias("component_id")),
        "components",
    )


def near_duplicates(docs: DataFrame, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs` (doc_id, text).

    Documents link at 2 or fewer differing fingerprint bits; component_id is the
    least doc_id reachable. Null, empty and wordless texts have fingerprint 0 and
    link like any other. Rows with the same doc_id are one vertex per row and come
    out once per row; other columns are not read. An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs), "prints")
    return prints.join(merged(_members(prints, bucket_cap)), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Keep one row of each group of linked fingerprints: that of the least doc_id, and
    of the least text hash where rows share it. Null comes after every doc_id; rows
    with a null or a repeated doc_id go only if they are linked. Columns are those of
    `docs`; no name of theirs has a meaning here but doc_id and text.
    """
    given, docs = docs, packed(docs)
    text_hash = F.xxhash64("text").alias("__hash")
    full = docs.select("*", F.col("doc_id").cast("long").alias("__id"), text_hash)
    rows = full.select(F.col("__id").alias("doc_id"), "text", "__hash")
    prints = materialize(rows.mapInArrow(_hashed_fingerprints, "doc_id long, fp long, __hash long"), "prints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("__id"), F.col("__hash").alias("__hash"))
    copies = prints.select("fp", order.alias("row")).groupBy("fp", "row").agg(F.count("*").alias("copies"))
    winners = materialize(
        copies.join(merged(_members(prints, BUCKET_CAP)), "fp")
        .groupBy("component")
        .agg(F.min(F.struct("row", "copies")).alias("first"))
        .select(F.col("first.row.__id").alias("won"), F.col("first.row.__hash").alias("won_hash"), F.col("first.copies").alias("copies")),
        "winners",
    )
    same = (F.col("__hash") == F.col("won_hash")) & F.col("__id").eqNullSafe(F.col("won"))
    kept = full.join(winners.where("copies = 1").select("won", "won_hash"), same, "left_semi").select(docs.columns)
    again = winners.where("copies > 1").select("won", "won_hash")
    if again.isEmpty():
        return unpacked(kept, given)
    once = (
        full.join(again, same, "left_semi")
        .groupBy("__id", "__hash")
        .agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("__row"))
        .select("__row.*")
    )
    return unpacked(kept.unionByName(once), given)
