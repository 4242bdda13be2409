"""Removal of repeated passages: each byte in a 100-byte string that starts earlier too.

A suffix array of the whole corpus is neither needed nor affordable, a sparse one is
enough. Of every 64 neighbouring 37-byte strings the one with the least hash is an
anchor; a 100-byte window has one anchor, and equal windows have equal anchors at
the same place. The windows of one anchor form a segment.

1. Hashes only partition. Anchors meet in buckets; segments whose anchor is met once
   have nothing to be compared with. Within a task a segment whose bytes are those of
   an earlier one is settled at once, so however common a passage is, a task sends it
   on once.
2. Of the anchors met more than once the segments' bytes are fetched. The suffixes
   behind the anchor, and the reversed prefixes before it, are put in order by
   deep-shallow sorting; two windows are equal where both orders' common prefixes
   reach far enough. All that is removed is removed because bytes were compared.
3. An anchor with more than `group_cap` different segments is too much for one group.
   Its windows are groups of their own: the whole window takes the anchor's place, and
   they are spread over all buckets and put in order alike.

Rows, not ids, are compared: a row is its doc_id and a hash of its text. Every window
is compared, none is sampled: results are those of a full suffix array.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.shared import materialize, packed, slices, unpacked, utf8
from marquee.llm.suffixes import common_prefix, deep_shallow_order

WINDOW = 100
GRAM, SPAN = 37, 64  # GRAM + SPAN - 1 == WINDOW
#: Text to a bucket, and to one vectorised step (positions must fit POSITION_BITS).
BUCKET_MB, POSITION_BITS = 16, 22
#: Partitions of the shuffles; beyond, a task works through several buckets in a row.
MOST_PARTITIONS = 20_000
GROUP_CAP = 4096
#: Segments that a task holds before it settles repeats among them.
HELD_SEGMENTS = 4_000_000

#: doc and sub name a row: its doc_id and the hash that sets it apart from others with that id. A
#: segment's shape is the distance from lo to its anchor (6 bits), from lo to hi (6 bits), and LARGE.
SEGMENT = np.dtype([("anchor", "<u8"), ("content", "<u4"), ("doc", "<i8"), ("sub", "<i8"), ("lo", "<i4"), ("shape", "<u2")])
LARGE = 1 << 12
RANGE = np.dtype([("doc", "<i8"), ("sub", "<i8"), ("lo", "<i4"), ("hi", "<i4")])
SEGMENTS, RANGES, PAYLOADS = range(3)
MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every GRAM bytes, by doubling."""
    base, mask = 0x100000001B3, (1 << 64) - 1
    power = base
    size, hashes = 1, data.astype(np.uint64) + np.uint64(1)
    single = hashes
    for bit in bin(GRAM)[3:]:
        hashes = hashes[:-size] * np.uint64(power) + hashes[size:]
        size, power = 2 * size, power * power & mask
        if bit == "1":
            hashes = hashes[:-1] * np.uint64(base) + single[size : size + len(hashes) - 1]
            size, power = size + 1, power * base & mask
    hashes = (hashes ^ (hashes >> np.uint64(32))) * MIX
    return hashes ^ (hashes >> np.uint64(29))


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of concatenated texts: first window, last window, anchor, anchor hash.

    `ends` are the texts' ends in `data`; no window crosses one. len(data) is at
    most 2**POSITION_BITS.
    """
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return none, none, none, np.zeros(0, np.uint64)
    hashes = gram_hashes(data)
    low = np.uint64((1 << POSITION_BITS) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)  # ties: the leftmost
    step = 1
    while step < SPAN:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    anchor = (least & low).astype(np.int64)
    valid = np.ones(len(anchor), bool)
    starts = np.concatenate(([0], ends[:-1]))
    for lo, hi in zip(np.maximum(ends - WINDOW + 1, starts), ends):
        valid[lo:hi] = False
    position = np.flatnonzero(valid)
    if not len(position):
        return none, none, none, np.zeros(0, np.uint64)
    anchor = anchor[position]
    cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(position) != 1)) + 1
    first = np.concatenate(([0], cut))
    last = np.concatenate((cut - 1, [len(position) - 1]))
    return position[first], position[last], anchor[first], hashes[anchor[first]]


Lot = list[tuple[int, int, int, bytes]]


def _pieces(docs: list[int], subs: list[int], texts: list[bytes]) -> Iterator[Lot]:
    """Texts in lots (doc, sub, start, bytes) for one step; a longer text in pieces, each
    window in one of them."""
    lot, size, most = [], 0, 1 << POSITION_BITS
    for doc, sub, text in zip(docs, subs, texts):
        if len(text) < WINDOW:
            continue
        for at in range(0, len(text) - WINDOW + 1, most - WINDOW):
            piece = text[at : at + most - 1] if len(text) > most else text
            if size + len(piece) > most:
                yield lot
                lot, size = [], 0
            lot.append((doc, sub, at, piece))
            size += len(piece)
            if len(text) <= most:
                break
    if lot:
        yield lot


def _cut(lot: Lot) -> tuple[np.ndarray, bytes, np.ndarray]:
    """The segments of one lot as records, the lot's bytes, and where in them each segment starts."""
    joined = b"".join(p for *_, p in lot)
    ends = np.cumsum([len(p) for *_, p in lot])
    lo, hi, at, anchor = segments(np.frombuffer(joined, np.uint8), ends)
    text = np.searchsorted(ends, lo, side="right")
    shift = (np.array([a for _, _, a, _ in lot]) - np.concatenate(([0], ends[:-1])))[text]
    out = np.empty(len(lo), SEGMENT)
    view, digest = memoryview(joined), xxhash.xxh3_64_intdigest
    out["content"] = np.fromiter(
        (digest(view[a : b + WINDOW]) & 0xFFFFFFFF for a, b in zip(lo.tolist(), hi.tolist())), np.uint32, len(lo)
    )
    out["anchor"] = anchor
    out["doc"], out["sub"] = np.array([d for d, *_ in lot])[text], np.array([x for _, x, *_ in lot])[text]
    out["lo"], out["shape"] = lo + shift, at - lo | hi - lo << 6
    return out, joined, lo


def _order(a: np.ndarray, *keys: str) -> np.ndarray:
    return np.lexsort([a[k] for k in reversed(keys)])


def _alike(records: np.ndarray, *same: str) -> np.ndarray:
    """For sorted records the place of the first of those that are equal in the columns `same`."""
    new = np.ones(len(records), bool)
    new[1:] = np.logical_or.reduce([records[k][1:] != records[k][:-1] for k in same])
    return np.maximum.accumulate(np.where(new, np.arange(len(records)), 0)) if len(records) else np.zeros(0, np.int64)


def _merged(ranges: np.ndarray) -> np.ndarray:
    """Ranges of windows with neighbours joined."""
    ranges = ranges[_order(ranges, "doc", "sub", "lo")]
    if len(ranges) < 2:
        return ranges
    gap = (ranges["doc"][1:] != ranges["doc"][:-1]) | (ranges["sub"][1:] != ranges["sub"][:-1]) | (ranges["lo"][1:] != ranges["hi"][:-1] + 1)
    first, last = np.concatenate(([True], gap)), np.concatenate((gap, [True]))
    out = ranges[first]
    out["hi"] = ranges["hi"][last]
    return out


def _reach(shape: np.ndarray) -> np.ndarray:
    """Distance from lo to hi."""
    return (shape >> 6 & 63).astype(np.int32)


def _ranges(records: np.ndarray) -> np.ndarray:
    out = np.empty(len(records), RANGE)
    for k in ("doc", "sub", "lo"):
        out[k] = records[k]
    out["hi"] = records["lo"] + _reach(records["shape"])
    return out


def _blobs(kind: int, buckets: np.ndarray, records: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Records by bucket, stored by column."""
    order = np.argsort(buckets, kind="stable")
    buckets, records = buckets[order], records[order]
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    for part, bucket in zip(np.split(records, cuts), buckets[np.concatenate(([0], cuts))] if len(buckets) else ()):
        yield int(bucket), kind, b"".join(np.ascontiguousarray(part[k]).tobytes() for k in part.dtype.names)


def _records(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    """The records of column-wise blobs."""
    out = np.empty(sum(len(b) for b in blobs) // kind.itemsize, kind)
    row = 0
    for blob in blobs:
        n, at = len(blob) // kind.itemsize, 0
        for k in kind.names:
            out[k][row : row + n] = np.frombuffer(blob, kind[k], n, at)
            at += n * kind[k].itemsize
        row += n
    return out


BLOB_SCHEMA = "bucket int, kind int, blob binary"


def _blob_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [(), (), ()]
    kinds = (pa.int32(), pa.int32(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "kind", "blob"])


def _find_segments(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    def settle(held: list[tuple[np.ndarray, bytes, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        records = np.concatenate([r for r, _, _ in held])
        lot = np.repeat(np.arange(len(held)), [len(r) for r, _, _ in held])
        start = np.concatenate([x for _, _, x in held])
        order = _order(records, "anchor", "content", "shape", "doc", "sub", "lo")
        records, lot, start = records[order], lot[order], start[order]
        first = _alike(records, "anchor", "content", "shape")
        other = np.flatnonzero(first != np.arange(len(records)))
        # equal hashes propose, equal bytes decide; the same window of a repeated row repeats nothing
        lots = [x for _, x, _ in held]
        length = _reach(records["shape"]) + WINDOW
        place = zip(other.tolist(), lot[other].tolist(), start[other].tolist(), lot[first[other]].tolist(), start[first[other]].tolist(), length[other].tolist())
        equal = np.zeros(len(records), bool)
        equal[[i for i, l, a, m, b, n in place if lots[l][a : a + n] == lots[m][b : b + n]]] = True
        same = np.logical_and.reduce([records[k] == records[k][first] for k in ("doc", "sub", "lo")])
        found, rest = _merged(_ranges(records[equal & ~same])), records[~equal]
        rest = rest[_order(rest, "doc", "sub", "lo")]
        for rows in (
            _blobs(RANGES, (found["doc"] % buckets).astype(np.int64), found),
            _blobs(SEGMENTS, ((rest["anchor"] >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64), rest),
        ):
            for row in rows:
                yield _blob_batch([row])

    held, n = [], 0
    for batch in slices(batches, 1024):
        docs, subs, texts = (batch.column(c).to_pylist() for c in ("__doc", "__sub", "text"))
        for lot in _pieces(docs, subs, utf8(texts)):
            held.append(_cut(lot))
            n += len(held[-1][0])
            if n >= HELD_SEGMENTS:
                yield from settle(held)
                held, n = [], 0
    if held:
        yield from settle(held)


FOUND_SCHEMA = "doc long, sub long, lo int, hi int, shape short"


def _found(records: np.ndarray) -> pa.RecordBatch:
    """Ranges (no shape) or segments (no hi) as rows."""
    columns = {
        k: pa.array(np.ascontiguousarray(records[k])) if k in records.dtype.names else pa.nulls(len(records), pa.int32())
        for k in ("doc", "sub", "lo", "hi")
    }
    shape = pa.array(records["shape"].astype(np.int16)) if "shape" in records.dtype.names else pa.nulls(len(records), pa.int16())
    return pa.record_batch([*columns.values(), shape], names=[*columns, "shape"])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, list[bytes]]]:
    """The blobs of one bucket after the other, by kind; rows come sorted by bucket."""
    found: dict[int, list[bytes]] = {}
    current = None
    for batch in batches:
        for bucket, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "blob"))):
            if bucket != current and found:
                yield found
                found = {}
            current = bucket
            found.setdefault(kind, []).append(blob)
    if found:
        yield found


def _match_segments(batches: Iterator[pa.RecordBatch], group_cap: int) -> Iterator[pa.RecordBatch]:
    """Repeats settled before, and the segments of anchors met more than once."""
    for blobs in _by_bucket(batches):
        yield _found(_records(blobs.pop(RANGES, []), RANGE))
        records = _records(blobs.pop(SEGMENTS, []), SEGMENT)
        records = records[_order(records, "anchor", "content", "shape", "doc", "sub", "lo")]
        if not len(records):
            continue
        # repeated rows of one document are one segment
        again = _alike(records, "anchor", "content", "shape", "doc", "sub", "lo") != np.arange(len(records))
        records = records[~again]
        of_anchor = _alike(records, "anchor")
        sizes = np.bincount(of_anchor, minlength=len(records))[of_anchor]
        content = _alike(records, "anchor", "content", "shape") == np.arange(len(records))
        different = np.bincount(of_anchor[content], minlength=len(records))[of_anchor]
        several = sizes > 1
        chosen = records[several]
        chosen["shape"] |= np.where(different[several] > group_cap, LARGE, 0).astype(np.uint16)
        yield _found(chosen[["doc", "sub", "lo", "shape"]])


PAYLOAD_HEAD = np.dtype([("doc", "<i8"), ("sub", "<i8"), ("lo", "<i4"), ("shape", "<u2")])


def _anchor(shape: int, part: bytes) -> bytes:
    """What a segment is grouped by: its anchor's bytes, or the whole window of a large anchor."""
    return part if shape & LARGE else part[shape & 63 : (shape & 63) + GRAM]


def _packed(rows: list[tuple[tuple[int, int, int, int], bytes]]) -> bytes:
    """Segments (doc, sub, lo, shape), their bytes: heads by column, then all bytes."""
    heads = np.array([h for h, _ in rows], PAYLOAD_HEAD)
    columns = (np.ascontiguousarray(heads[k]).tobytes() for k in PAYLOAD_HEAD.names)
    return zstandard.compress(b"".join([len(rows).to_bytes(4, "little"), *columns, *(x for _, x in rows)]), 3)


def _unpacked(blob: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    blob = zstandard.decompress(blob)
    n = int.from_bytes(blob[:4], "little")
    at = 4 + n * PAYLOAD_HEAD.itemsize
    heads = _records([blob[4:at]], PAYLOAD_HEAD)
    for doc, sub, lo, shape in heads.tolist():
        size = (shape >> 6 & 63) + WINDOW
        yield doc, sub, lo, shape, blob[at : at + size]
        at += size


def _fetch(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments, or of a large anchor's windows; what a task has met
    before is settled there and not sent on again."""
    seen: dict[tuple[int, bytes], tuple[int, int, int]] = {}
    for batch in batches:
        rows: dict[int, list[tuple[tuple[int, int, int, int], bytes]]] = {}
        repeats: list[tuple[int, int, int, int]] = []

        def put(doc: int, sub: int, lo: int, shape: int, part: bytes) -> None:
            here, first = (doc, sub, lo), seen.get((shape, part))
            if first is not None and first <= here:
                if first < here:
                    repeats.append((doc, sub, lo, lo + (shape >> 6 & 63)))
                return
            if len(seen) < HELD_SEGMENTS // 8:
                seen[shape, part] = here
            bucket = xxhash.xxh3_64_intdigest(_anchor(shape, part)) % buckets
            rows.setdefault(bucket, []).append(((*here, shape), part))

        for doc, sub, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("__doc", "__sub", "text", "__wanted"))):
            data = (text or "").encode("utf-8", "surrogatepass")
            for w in wanted:
                lo, shape = w["lo"], w["shape"]
                hi = lo + (shape >> 6 & 63)
                if hi + WINDOW > len(data):  # another row under the same hash
                    continue
                if not shape & LARGE:
                    put(doc, sub, lo, shape, data[lo : hi + WINDOW])
                    continue
                for p in range(lo, hi + 1):
                    put(doc, sub, p, LARGE, data[p : p + WINDOW])
        out = [(b, PAYLOADS, _packed(x)) for b, x in rows.items()]
        ranges = _merged(np.array(repeats, RANGE))
        for row in [*out, *_blobs(RANGES, (ranges["doc"] % buckets).astype(np.int64), ranges)]:
            yield _blob_batch([row])


Segment = tuple[tuple[int, int], int, int, int, bytes]


def match_group(group: list[Segment]) -> list[tuple[int, int, int, int]]:
    """Ranges of repeated windows among segments of one anchor.

    A segment is (row, lo, hi, at, bytes of lo .. hi + WINDOW), where a row is (doc, sub); a
    range (doc, sub, lo, hi).
    """
    group = sorted(group)
    # of segments of equal bytes the earliest stands for all
    first: dict[tuple[int, bytes], int] = {}
    out, kept = [], []
    for i, (row, lo, hi, at, part) in enumerate(group):
        j = first.setdefault((at - lo, part), i)
        if j == i:
            kept.append(group[i])
        elif (group[j][0], group[j][3]) != (row, at):
            out.append((*row, lo, hi))
    return out + _different(kept) if len(kept) > 1 else out


def _different(group: list[Segment]) -> list[tuple[int, int, int, int]]:
    """Ranges of repeated windows among different segments of one anchor, in sorted order."""
    behind = [g[4][g[3] - g[1] :] for g in group]
    before = [g[4][: g[3] - g[1]][::-1] for g in group]
    n, out = len(group), []
    orders = [deep_shallow_order(x) for x in (behind, before)]
    shared = [[common_prefix(x[i], x[j]) for i, j in zip(o, o[1:])] for x, o in zip((behind, before), orders)]
    if n <= 4:
        places = [{i: k for k, i in enumerate(o)} for o in orders]
        for j in range(1, n):
            row, lo, hi, at, _ = group[j]
            for i in range(j):
                reach = []
                for place, common in zip(places, shared):
                    a, b = sorted((place[i], place[j]))
                    reach.append(min(common[a:b]))
                # a window that starts t before the anchor needs t bytes before it, WINDOW - t behind
                most, least = min(reach[1], at - lo), max(WINDOW - reach[0], at - hi)
                if least <= most and (group[i][0], group[i][3]) != (row, at):
                    out.append((*row, at - most, at - least))
        return out
    lo, hi, at = (np.array([g[k] for g in group]) for k in (1, 2, 3))
    rows = [g[0] for g in group]
    row_number = np.cumsum([0, *(a != b for a, b in zip(rows, rows[1:]))])
    before_anchor = np.arange(int((at - hi).min()), int((at - lo).max()) + 1)
    classes = []
    for order, common, need in zip(orders, shared, (WINDOW - before_anchor, before_anchor)):
        ranks = np.zeros((len(need), n), np.int64)
        ranks[:, 1:] = np.cumsum(np.array(common)[None, :] < need[:, None], axis=1)
        by_item = np.empty_like(ranks)
        by_item[:, order] = ranks
        classes.append(by_item)
    window = at[None, :] - before_anchor[:, None]
    valid = (window >= lo) & (window <= hi)
    key = (np.arange(len(before_anchor))[:, None] * n + classes[0]) * n + classes[1]
    steps, columns = np.nonzero(valid)  # step by step, so in the order of the group
    keys = key[steps, columns]
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    earliest = columns[first][inverse]
    again = (row_number[earliest] != row_number[columns]) | (at[earliest] != at[columns])
    return [(*rows[c], w, w) for c, w in zip(columns[again].tolist(), window[steps, columns][again].tolist())]


def _match_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for blobs in _by_bucket(batches):
        yield _found(_records(blobs.pop(RANGES, []), RANGE))
        groups: dict[bytes, list[Segment]] = {}
        for blob in blobs.pop(PAYLOADS, []):
            for doc, sub, lo, shape, part in _unpacked(blob):
                segment = ((doc, sub), lo, lo + (shape >> 6 & 63), lo + (shape & 63), part)
                groups.setdefault(_anchor(shape, part), []).append(segment)
        found = [r for group in groups.values() if len(group) > 1 for r in match_group(group)]
        if found:
            yield _found(_merged(np.array(found, RANGE)))


def _keyed(docs: DataFrame) -> DataFrame:
    """`docs` with what names a row: __doc, its doc_id (null after all others), and __sub. Texts
    without a window are compared with nothing; a number of their own deals them anywhere,
    however many nulls and stubs there are."""
    windowed = F.coalesce(F.octet_length("text"), F.lit(0)) >= WINDOW
    text_hash = F.xxhash64("text", F.col("doc_id").isNull())
    return docs.withColumns(
        {
            "__doc": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)),
            "__sub": F.when(windowed, text_hash).otherwise(F.monotonically_increasing_id()),
        }
    )


def bucket_count(docs: DataFrame) -> int:
    """Buckets of about BUCKET_MB of the texts' bytes."""
    size = docs.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(32, -(-size // (BUCKET_MB << 20)))


def repeated_windows(placed: DataFrame, buckets: int, group_cap: int = GROUP_CAP) -> DataFrame:
    """(doc, sub, lo, hi): the windows starting at bytes lo .. hi of the row also start
    earlier, in a row before it or further ahead in the same. `placed` is from _keyed(), in
    partitions by __doc and __sub."""
    parts = min(buckets, MOST_PARTITIONS)
    found = materialize(
        placed.select("__doc", "__sub", "text")
        .mapInArrow(partial(_find_segments, buckets=buckets), BLOB_SCHEMA)
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(partial(_match_segments, group_cap=group_cap), FOUND_SCHEMA),
        "segments",
    )
    wanted = (
        found.where("shape is not null")
        .repartition(parts, "doc", "sub")
        .groupBy("doc", "sub")
        .agg(F.collect_list(F.struct("lo", "shape")).alias("__wanted"))
        .withColumnsRenamed({"doc": "__at_doc", "sub": "__at_sub"})
    )
    borders = (
        placed.join(wanted, (F.col("__doc") == F.col("__at_doc")) & (F.col("__sub") == F.col("__at_sub")))
        .mapInArrow(partial(_fetch, buckets=buckets), BLOB_SCHEMA)
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_match_windows, FOUND_SCHEMA)
    )
    ranges = found.where("shape is null").unionByName(borders)
    return ranges.select("doc", "sub", "lo", "hi")


def spans(ranges: list[tuple[int, int]], n_bytes: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by windows that start in any of the ranges."""
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if hi + WINDOW > n_bytes:
            continue
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + WINDOW)
        else:
            out.append([lo, hi + WINDOW])
    return [(a, b) for a, b in out]


def _with_ranges(docs: DataFrame) -> DataFrame:
    """Rows of `docs` with the ranges of their windows. The texts are shuffled once: fetching
    segments and cutting spans use the same exchange, so both take all columns."""
    keyed = _keyed(docs)
    buckets = bucket_count(keyed)
    parts = min(buckets, MOST_PARTITIONS)
    placed = keyed.repartition(parts, "__doc", "__sub")
    found = (
        repeated_windows(placed, buckets)
        .repartition(parts, "doc", "sub")
        .groupBy("doc", "sub")
        .agg(F.collect_list(F.struct("lo", "hi")).alias("__ranges"))
        .withColumnsRenamed({"doc": "__at_doc", "sub": "__at_sub"})
    )
    same = (F.col("__doc") == F.col("__at_doc")) & (F.col("__sub") == F.col("__at_sub"))
    return placed.join(found, same, "left")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    for batch in slices(batches):
        rows = []
        for doc, text, ranges in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "__ranges"))):
            data = (text or "").encode("utf-8", "surrogatepass")
            cut = spans([(r["lo"], r["hi"]) for r in ranges or ()], len(data))
            digest, at = sha256(), 0
            for a, b in cut:
                digest.update(data[at:a])
                at = b
            digest.update(data[at:])
            rows.append((doc, len(data), sum(b - a for a, b in cut), len(cut), digest.hexdigest()))
        yield pa.record_batch([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for _, k in kinds], names=[n for n, _ in kinds])


def repeat_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of `docs`.

    Null text is empty. Texts under 100 bytes lose nothing. Rows with equal doc_id
    and text count as one document and get equal results. Rows with the same doc_id
    and different texts are documents of their own, ordered by a hash of the text; a
    null doc_id comes after all others. Other columns are not read.
    """
    return _with_ranges(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(
        _digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def without_spans(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without its repeated bytes; a character only partly repeated stays."""
    data = text.encode("utf-8", "surrogatepass")
    kept, at = [], 0
    for a, b in spans(ranges, len(data)):
        while a < len(data) and data[a] & 0xC0 == 0x80:
            a += 1
        while b < len(data) and b > a and data[b] & 0xC0 == 0x80:
            b -= 1
        kept.append(data[at:a])
        at = max(at, b)
    return b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [
            without_spans(t, [(r["lo"], r["hi"]) for r in ranges]) if t and ranges else t
            for t, ranges in zip(batch.column("text").to_pylist(), batch.column("__ranges").to_pylist())
        ]
        yield pa.record_batch([pa.array(texts, pa.string()), batch.column("rest")], names=["text", "rest"])


def drop_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with repeated passages cut out of text (and n_chars set anew where it is
    a column). Rows are told apart as in repeat_report(). A document left without a word goes.
    Other columns are carried whatever their names."""
    rows = packed(docs)
    schema = f"text string, rest {rows.schema['rest'].dataType.simpleString()}"
    cut = unpacked(_with_ranges(rows).mapInArrow(_texts, schema), docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return cut.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select([f"`{c}`" for c in docs.columns])
