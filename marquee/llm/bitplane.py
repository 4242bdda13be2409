"""Token ids as bit planes.

File format. A store is a Parquet table whose rows are chunks; the columns beside
the payload are the chunk index, which a reader can scan without the payload.

    shard long        number of the shard, ascending with doc_id
    chunk long        number of the chunk in its shard
    first_id long     ids before this chunk in its shard
    n_ids long        ids in this chunk
    block_ids int     ids to a block; the last block is filled up with zeros
    width int         planes that are not all zero
    plane_bytes array<int>   compressed length of each plane
    doc_ids array<long>, doc_tokens array<long>   the documents in the chunk, in order
    planes binary     the planes' zstandard frames, lowest bit first

A chunk holds whole documents, so each can be read alone. Its ids are cut into
fixed-size blocks; a block is transposed so that bit `b` of all its ids lies
together, and plane `b` of a chunk is that of its blocks one after another. Ids
are unsigned 32-bit integers; planes above the largest id are not stored.
"""

from __future__ import annotations

import gc
import json
import os
import re
import sys
from collections.abc import Iterator
from functools import partial
from itertools import chain
from operator import attrgetter
from types import ModuleType
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_IDS = 4096
CHUNK_IDS = 262_144
END_ID = 2
#: Text to a shard, and shards at most; beyond, the shards grow (a task holds one chunk at a time).
SHARD_MB, MOST_SHARDS = 20, 20_000

SCHEMA = T.StructType(
    [
        T.StructField("shard", T.LongType()),
        T.StructField("chunk", T.LongType()),
        T.StructField("first_id", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("block_ids", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("plane_bytes", T.ArrayType(T.IntegerType())),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("doc_tokens", T.ArrayType(T.LongType())),
        T.StructField("planes", T.BinaryType()),
    ]
)
ARROW = pa.schema(
    [
        ("shard", pa.int64()),
        ("chunk", pa.int64()),
        ("first_id", pa.int64()),
        ("n_ids", pa.int64()),
        ("block_ids", pa.int32()),
        ("width", pa.int32()),
        ("plane_bytes", pa.list_(pa.int32())),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_tokens", pa.list_(pa.int64())),
        ("planes", pa.binary()),
    ]
)


#: A run of Latin letters with at most one mark behind it: two pieces for the tokenizer.
PLAIN = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[.,]?")


class _Numbers(dict):
    """Numbers pieces as they are first met."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.fresh.append(piece)
        self[piece] = n = len(self)
        return n


class PieceEncoder:
    """Whole-text encoding by a byte-level BPE file, with a memory of pieces.

    The tokenizer's own pattern never joins what a single space separates: a piece
    between single spaces (with its leading space) is encoded alike wherever it
    stands, and so is what a single line feed separates. Texts with any other white
    space are handed to the tokenizer whole. A new piece of letters goes straight
    to the tokenizer's BPE model, any other through all of it; either way all ids
    come from the tokenizers library. The memory is emptied at `most_pieces`. All this
    holds for the byte-level pattern alone; with a file that splits, normalises or
    merges differently every text is encoded whole.
    """

    def __init__(self, path: str, most_pieces: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.by_pieces = self._byte_level(json.loads(self.tokenizer.to_str()))
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.most_pieces = most_pieces
        self.line_feed = self._whole("\n").tolist()
        self.space, self.feed = (self.bytes.pre_tokenize_str(c)[0][0] for c in " \n")
        self.marks = {"": [], **{m: self._whole(m).tolist() for m in ".,"}}
        self._forget()

    @staticmethod
    def _byte_level(settings: dict) -> bool:
        """Whether texts are split by the byte-level pattern and nothing else touches them."""
        split, model = settings.get("pre_tokenizer") or {}, settings["model"]
        plain = not settings.get("normalizer") and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        special = all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) and " " not in t["content"] for t in settings["added_tokens"])
        return plain and special and model["type"] == "BPE" and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]

    def _forget(self) -> None:
        self.number = _Numbers()
        self.flat = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    @staticmethod
    def _pieces(text: str) -> list[str] | None:
        """The pieces of a text, None unless its white space is single spaces and
        line feeds between other characters. The first piece is marked by \x01,
        the first of another line by its line feed."""
        words, gaps = text.split(), text.count(" ") + text.count("\n")
        if not words or len(words) != gaps + 1 or sum(map(len, words)) + gaps != len(text) or "\x01" in text:
            return None
        return ("\x01" + text).replace("\n", " \n").split(" ")

    def _words(self, bodies: list[str]) -> list[list[int]]:
        """Ids of bodies that are letters, with a space before or not: one BPE word each."""
        space = self.space
        mapped = [space + b[1:] if b[0] == " " else b for b in bodies]
        wide = [i for i, b in enumerate(bodies) if not b.isascii()]
        if wide:  # bytes beyond ASCII get the library's stand-in characters
            joined = self.bytes.pre_tokenize_str("\n".join([bodies[i] for i in wide]))[0][0]
            for i, m in zip(wide, joined.split(self.feed)):
                mapped[i] = m
        tokenize, number = self.tokenizer.model.tokenize, attrgetter("id")
        return [list(map(number, tokenize(m))) for m in mapped]

    def _learn(self) -> None:
        fresh, self.number.fresh = self.number.fresh, []
        bodies = [p[1:] if p[0] in "\x01\n" else " " + p for p in fresh]
        plain = [PLAIN.fullmatch(b) is not None for b in bodies]
        marked = [b[-1] if ok and b[-1] in ".," else "" for b, ok in zip(bodies, plain)]
        cores = [b[:-1] if m else b for b, m in zip(bodies, marked)]
        unique = list(dict.fromkeys(c for c, ok in zip(cores, plain) if ok))
        known = dict(zip(unique, self._words(unique)))
        other = [b for b, ok in zip(bodies, plain) if not ok]
        known_other = dict(zip(other, (e.ids for e in self.tokenizer.encode_batch(other, add_special_tokens=False))))
        marks, feed = self.marks, self.line_feed
        ids = [
            (feed if p[0] == "\n" else []) + (known[c] + marks[m] if ok else known_other[b])
            for p, b, c, m, ok in zip(fresh, bodies, cores, marked, plain)
        ]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))])

    def _numbered(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The numbers of each text's pieces; None for a text to be encoded whole."""
        if len(self.number) > self.most_pieces:
            self._forget()
        numbered: list[np.ndarray | None] = []
        for text in texts:
            pieces = [] if not text else self._pieces(text) if self.by_pieces else None
            at = None if pieces is None else np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
            numbered.append(at)
        if self.number.fresh:
            collecting = gc.isenabled()
            gc.disable()  # many small lists and no cycles
            self._learn()
            if collecting:
                gc.enable()
        return numbered

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each whole text; null is empty."""
        out = []
        for text, at in zip(texts, self._numbered(texts)):
            if at is None:
                out.append(self._whole(text))
                continue
            lengths = self.lengths[at]
            ends = np.cumsum(lengths)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.flat[np.repeat(self.starts[at] - ends + lengths, lengths) + np.arange(total)])
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        """How many ids each whole text has."""
        return [len(self._whole(t)) if at is None else int(self.lengths[at].sum()) for t, at in zip(texts, self._numbered(texts))]


def worker_encoder(path: str) -> PieceEncoder:
    """The encoder that this process keeps: a worker is used for many tasks."""
    kept = sys.modules.setdefault("_marquee_encoders", ModuleType("_marquee_encoders")).__dict__
    if path not in kept:
        kept[path] = PieceEncoder(path)
    return kept[path]


def to_planes(ids: np.ndarray, block_ids: int = BLOCK_IDS) -> list[bytes]:
    """The uncompressed bit planes of `ids`, lowest first."""
    filled = np.zeros(-(-len(ids) // block_ids) * block_ids, np.uint32)
    filled[: len(ids)] = ids
    width = int(filled.max(initial=0)).bit_length()
    return [np.packbits((filled >> np.uint32(b)).astype(np.uint8) & 1).tobytes() for b in range(width)]


def from_planes(planes: list[bytes], n_ids: int) -> np.ndarray:
    """The ids of `to_planes`."""
    ids = np.zeros(n_ids, np.uint32)
    for b, plane in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n_ids).astype(np.uint32) << np.uint32(b)
    return ids


def _chunk_batch(shard: int, chunk: int, first: int, docs: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    ids = np.concatenate([x for _, x in docs])
    frames = [zstandard.ZstdCompressor(level=3).compress(p) for p in to_planes(ids)]
    row = {
        "shard": shard, "chunk": chunk, "first_id": first, "n_ids": len(ids), "block_ids": BLOCK_IDS,
        "width": len(frames), "plane_bytes": [len(f) for f in frames], "doc_ids": [d for d, _ in docs],
        "doc_tokens": [len(x) for _, x in docs], "planes": b"".join(frames),
    }
    return pa.RecordBatch.from_pylist([row], schema=ARROW)


def _encode_shard(batches: Iterator[pa.RecordBatch], tokenizer_path: str, chunk_ids: int) -> Iterator[pa.RecordBatch]:
    encoder = worker_encoder(tokenizer_path)
    shard = TaskContext.get().partitionId()
    chunk = first = held = 0
    docs: list[tuple[int, np.ndarray]] = []
    for batch in batches:
        doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for at in range(0, len(texts), 512):
            for doc_id, ids in zip(doc_ids[at : at + 512], encoder.encode(texts[at : at + 512])):
                docs.append((doc_id, np.append(ids, np.uint32(END_ID))))
                held += len(ids) + 1
                if held >= chunk_ids:
                    yield _chunk_batch(shard, chunk, first, docs)
                    chunk, first, held, docs = chunk + 1, first + held, 0, []
    if docs:
        yield _chunk_batch(shard, chunk, first, docs)


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, shards: int | None = None, chunk_ids: int = CHUNK_IDS) -> None:
    """Encode `docs` (doc_id, text) and write a store in ascending doc_id order.

    Documents are range-partitioned by doc_id, so shard after shard and chunk after
    chunk the ids are in that order. Null text gives the end id alone. Rows with
    the same doc_id stand in the order of a hash of their texts, which also deals them
    to shards if they are many; repeated rows are all written. Null doc_ids come
    first. An empty table gives an empty store. Other columns are not read.
    """
    if shards is None:
        size = docs.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        shards = min(MOST_SHARDS, max(1, -(-size // (SHARD_MB << 20))))
    (
        docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("__hash"))
        .repartitionByRange(shards, "doc_id", "__hash")
        .sortWithinPartitions("doc_id", "__hash", "text")
        .select("doc_id", "text")
        .mapInArrow(partial(_encode_shard, tokenizer_path=tokenizer_path, chunk_ids=chunk_ids), SCHEMA)
        .write.option("compression", "none")
        .parquet(path)
    )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def decode_chunk(row: dict) -> np.ndarray:
    """The ids of one chunk row."""
    planes, at = [], 0
    for n in row["plane_bytes"]:
        planes.append(zstandard.ZstdDecompressor().decompress(row["planes"][at : at + n]))
        at += n
    return from_planes(planes, row["n_ids"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = decode_chunk(row).astype("<u4")
            ends = np.cumsum(row["doc_tokens"])
            sums = [crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), row["doc_tokens"])]
            n = len(sums)
            yield pa.record_batch(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array([row["shard"]] * n, pa.int64()),
                    pa.array(row["first_id"] + ends - row["doc_tokens"], pa.int64()),
                    pa.array(row["doc_tokens"], pa.int64()),
                    pa.array(sums, pa.int64()),
                ],
                names=["doc_id", "shard", "in_shard", "n_tokens", "ids_crc32"],
            )


def digest_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the planes of a store.

    Shard totals come from the chunk index alone; they are one row a shard.
    """
    store = read_store(spark, path)
    totals = store.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    before, starts = 0, []
    for shard, n in totals:
        starts.append((shard, before))
        before += n
    found = store.mapInArrow(_digest, "doc_id long, shard long, in_shard long, n_tokens long, ids_crc32 long")
    offsets = spark.createDataFrame(starts, "shard long, shard_start long")
    return found.join(F.broadcast(offsets), "shard").select(
        "doc_id", (F.col("shard_start") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32"
    )


def _lengths(batches: Iterator[pa.RecordBatch], tokenizer_path: str) -> Iterator[pa.RecordBatch]:
    encoder = worker_encoder(tokenizer_path)
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts = batch.column(at)  # few of them are Python objects at a time
        counts = [n + 1 for k in range(0, len(texts), 512) for n in encoder.count(texts.slice(k, 512).to_pylist())]
        rest = [i for i in range(batch.num_columns) if i != at]
        yield pa.record_batch(
            [*(batch.column(i) for i in rest), pa.array(counts, pa.int64())], names=[*(batch.schema.names[i] for i in rest), "n_tokens"]
        )


def token_lengths(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """`docs` with `n_tokens`, the ids of the text with the end id, in place of `text`."""
    rest = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*rest, T.StructField("n_tokens", T.LongType())])
    return docs.mapInArrow(partial(_lengths, tokenizer_path=tokenizer_path), schema)
