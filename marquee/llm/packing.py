"""Best-fit packing of documents into training sequences, with conflicts.

A bin is a sequence of `capacity` tokens. Bins are kept in order of their residual;
a bin carries a bitmap of its sources (in `max_per_source` layers) and one of its
duplicate clusters. An item, the largest first, looks for the successor of its size
among the residuals and goes on until the tightest bin that has room, does not hold
its duplicate cluster and holds its source fewer than `max_per_source` times. None:
it opens a bin.

Lengths are token ids of the tokenizer with the end id. Texts longer than a bin are
cut: full pieces are bins of their own, the rest is an item. Items are dealt to
shards by a hash of their row and piece, whatever their id, source or cluster, so
none of these can be hot; a shard has about `shard_items` items and is packed on its
own.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.bitplane import token_lengths
from marquee.llm.shared import materialize

CAPACITY = 2048
MAX_PER_SOURCE = 4
SHARD_ITEMS = 20_000


def pack(sizes: list[int], sources: list, clusters: list, capacity: int, max_per_source: int = MAX_PER_SOURCE) -> list[tuple[int, int]]:
    """(bin, start) of each item; sizes are 0 to capacity. Items of one size are placed
    in the order given. A null source or cluster conflicts with nothing."""
    source_bit = {s: 1 << k for k, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    shared = [c for c, n in Counter(c for c in clusters if c is not None).items() if n > 1]
    cluster_bit = {c: 1 << k for k, c in enumerate(shared)}
    residuals: list[tuple[int, int]] = []
    source_maps: list[list[int]] = []  # per bin: bit set in layer l if the source is there more than l times
    cluster_maps: list[int] = []
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        source, cluster = source_bit.get(sources[i], 0), cluster_bit.get(clusters[i], 0)
        at = bisect_left(residuals, (sizes[i], -1))
        while at < len(residuals):
            number = residuals[at][1]
            if not (cluster_maps[number] & cluster or source_maps[number][-1] & source):
                break
            at += 1
        if at < len(residuals):
            residual, number = residuals.pop(at)
        else:
            residual, number = capacity, len(cluster_maps)
            source_maps.append([0] * max_per_source)
            cluster_maps.append(0)
        layers = source_maps[number]
        for layer in range(max_per_source):
            if not layers[layer] & source:
                layers[layer] |= source
                break
        cluster_maps[number] |= cluster
        out[i] = (number, capacity - residual)
        insort(residuals, (residual - sizes[i], number))
    return out


OUT = "doc_id long, piece int, shard long, bin long, start long, n_tokens long"


def _pack_shard(capacity: int, max_per_source: int):
    def run(items: pa.Table) -> pa.Table:
        order = [("n_tokens", "descending"), *((c, "ascending") for c in ("doc_id", "piece", "cluster", "row"))]
        items = items.sort_by(order)
        sizes, sources, clusters = (items.column(c).to_pylist() for c in ("n_tokens", "source", "cluster"))
        placed = pack(sizes, sources, clusters, capacity, max_per_source)
        kept = [items.column(c) for c in ("doc_id", "piece", "shard")]
        bins, starts = pa.array([b for b, _ in placed], pa.int64()), pa.array([s for _, s in placed], pa.int64())
        return pa.table([*kept, bins, starts, items.column("n_tokens")], names=[c.split()[0] for c in OUT.split(", ")])

    return run


def duplicate_cluster(text: Column) -> Column:
    """Hash of the text in lower case with single spaces: equal texts are a cluster."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")))


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    length: Column | None = None,
    cluster: Column | None = None,
    capacity: int = CAPACITY,
    max_per_source: int = MAX_PER_SOURCE,
    shard_items: int = SHARD_ITEMS,
) -> DataFrame:
    """(doc_id, piece, shard, bin, start, n_tokens): where each piece of each row of
    `docs` (doc_id, text, source) lies; a sequence is named by shard and bin.

    Lengths are those of the tokenizer at `tokenizer_path`, or `length` where that is
    given. Null and empty texts are items of their end mark alone. Repeated rows are
    packed each, copies never into one bin. A null doc_id, source or cluster is allowed
    (the latter two conflict with nothing), and ids come out as they went in. Items of
    one length are placed in the order of doc_id, null last. An empty table gives no
    rows. Other columns are not read.
    """
    if (length is None) == (tokenizer_path is None):
        raise ValueError("give either tokenizer_path or length")
    cluster = duplicate_cluster(F.col("text")) if cluster is None else cluster
    about = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), cluster.alias("cluster")]
    if length is None:
        items = token_lengths(docs.select(*about, "text"), tokenizer_path)
    else:
        items = docs.select(*about, length.cast("long").alias("n_tokens"))
    # written once, so that a row keeps its number when a task runs again
    items = materialize(items.where("n_tokens > 0").withColumn("row", F.monotonically_increasing_id()), "items")
    full = F.floor((F.col("n_tokens") - 1) / capacity)
    pieces = items.withColumn("piece", F.explode(F.sequence(F.lit(0), full.cast("int")))).withColumn(
        "n_tokens", F.least(F.col("n_tokens") - F.col("piece").cast("long") * capacity, F.lit(capacity).cast("long"))
    )
    n = items.agg(F.sum(full + 1)).first()[0] or 0
    shards = max(1, -(-n // shard_items))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_pack_shard(capacity, max_per_source), OUT)
