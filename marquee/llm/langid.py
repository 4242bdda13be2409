"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A
trigram is bound from the vectors of its three letters, the first permuted twice
(rotated), the second once. A text bundles (adds up) the vectors of its trigrams, a
language the bundles of its documents, each divided by its number of trigrams so that
all weigh the same. A document gets the language whose prototype has the largest cosine to it.

Bundles are exact integers, so results do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
FOLDS = 5
SEED = 7
#: A training document's bundle is divided by its trigrams in units of one to this.
DOC_WEIGHT = 1 << 24
#: Letters held at once (a longer text is worked on in parts), and trigrams whose vectors are held at once.
BATCH_LETTERS, BATCH_TRIGRAMS = 1 << 20, 4096


def letter_table() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class Letters:
    """Vectors of letters, made from their code points when first needed."""

    def __init__(self, dimensions: int):
        self.dimensions, self.known = dimensions, {}

    def vectors(self, points: np.ndarray) -> np.ndarray:
        for p in set(points.tolist()) - self.known.keys():
            self.known[p] = np.random.default_rng((SEED, p)).integers(0, 2, self.dimensions, np.int8) * 2 - 1
        unique, inverse = np.unique(points, return_inverse=True)
        return np.stack([self.known[p] for p in unique.tolist()])[inverse]

    def trigrams(self, codes: np.ndarray) -> np.ndarray:
        """Bound vectors of trigrams packed by 21 bits to a letter."""
        a, b, c = (self.vectors((codes >> np.uint64(s)).astype(np.int64) & 0x1FFFFF) for s in (42, 21, 0))
        return (np.roll(a, 2, axis=1) * np.roll(b, 1, axis=1) * c).astype(np.float32)


def pack_trigrams(text: str, is_letter: np.ndarray) -> np.ndarray:
    """One trigram for every letter but the first and last character of `text`, which is in
    lower case: what stands before it, it, what stands behind; anything but letters is
    a space."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letters = np.where(is_letter[points], points, 32).astype(np.uint64)
    packed = (letters[:-2] << np.uint64(42)) | (letters[1:-1] << np.uint64(21)) | letters[2:]
    return packed[letters[1:-1] != 32]


def text_trigrams(text: str | None, is_letter: np.ndarray) -> Iterator[np.ndarray]:
    """The trigrams of a whole text, part by part; neighbouring parts overlap by two
    characters, so the parts' trigrams are those of the text."""
    padded, step = f" {(text or '').lower()} ", BATCH_LETTERS // 2
    for at in range(0, len(padded) - 2, step):
        yield pack_trigrams(padded[at : at + step + 2], is_letter)


def bundles(texts: list[str | None], letters: Letters, is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the bundle of its trigrams and their number, as exact integers."""
    sums, counts = np.zeros((len(texts), letters.dimensions), np.int64), np.zeros(len(texts), np.int64)
    held: list[tuple[int, np.ndarray]] = []

    def add() -> None:
        codes = np.concatenate([x for _, x in held])
        local, row = np.unique(np.array([i for i, _ in held]), return_inverse=True)
        row = np.repeat(row, [len(x) for _, x in held])
        order = np.argsort(codes)
        codes, row = codes[order], row[order]
        first = np.concatenate(([True], codes[1:] != codes[:-1]))
        number, unique = np.cumsum(first) - 1, codes[first]
        for at in range(0, len(unique), BATCH_TRIGRAMS):
            lo, hi = np.searchsorted(number, (at, at + BATCH_TRIGRAMS))
            vectors = letters.trigrams(unique[at : at + BATCH_TRIGRAMS])
            cells = row[lo:hi] * len(vectors) + number[lo:hi] - at
            table = np.bincount(cells, minlength=len(local) * len(vectors)).reshape(len(local), -1)
            # sums below 2**24 are exact in single precision
            sums[local] += (table.astype(np.float32) @ vectors).astype(np.int64)
        counts[local] += np.bincount(row, minlength=len(local))
        held.clear()

    room = 0
    for i, text in enumerate(texts):
        for codes in text_trigrams(text, is_letter):
            if len(codes):
                held.append((i, codes))
                room += len(codes)
            if room >= BATCH_LETTERS or len(held) >= 128:
                add()
                room = 0
    if held:
        add()
    return sums, counts


def weighted(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bundles divided by their texts' trigrams, in units of 1 / DOC_WEIGHT."""
    return np.rint(sums * (DOC_WEIGHT / np.maximum(counts, 1))[:, None]).astype(np.int64)


def _learn(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[pa.RecordBatch]:
    letters, is_letter = Letters(dimensions), letter_table()
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        rows = weighted(*bundles(batch.column("text").to_pylist(), letters, is_letter))
        for lang in sorted(set(langs)):
            total[lang] = total.get(lang, 0) + rows[[i for i, x in enumerate(langs) if x == lang]].sum(0)
    if total:
        names = sorted(total)
        values = pa.array([total[n].tolist() for n in names], pa.list_(pa.int64()))
        yield pa.record_batch([pa.array(names, pa.string()), values], names=["lang", "bundle"])


@dataclass(frozen=True)
class Prototypes:
    """Unit vectors of the learned languages, by name."""

    langs: list[str]
    vectors: np.ndarray


def learn_prototypes(docs: DataFrame, dimensions: int = DIMENSIONS) -> Prototypes:
    """Prototypes from the (text, lang) rows of `docs` with a lang.

    Each task bundles its documents; bundles are added up by language and
    dimension, in decimals of 38 digits, so no number of documents overflows. What reaches
    the driver is a vector for each language.
    """
    parts = docs.where("lang is not null and text is not null").select("lang", "text")
    rows = (
        parts.mapInArrow(partial(_learn, dimensions=dimensions), "lang string, bundle array<long>")
        .select("lang", F.posexplode("bundle"))
        .groupBy("lang", "pos")
        .agg(F.sum(F.col("col").cast("decimal(28,0)")).alias("col"))
        .collect()
    )
    langs = sorted({r.lang for r in rows})
    vectors = np.zeros((len(langs), dimensions))
    at = {lang: i for i, lang in enumerate(langs)}
    for r in rows:
        vectors[at[r.lang], r.pos] = float(r.col)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Prototypes(langs, vectors / np.where(norms > 0, norms, 1))


def _predict(batches: Iterator[pa.RecordBatch], prototypes: Prototypes) -> Iterator[pa.RecordBatch]:
    letters, is_letter = Letters(prototypes.vectors.shape[1]), letter_table()
    names = np.array([*prototypes.langs, "und"], object)
    for batch in batches:
        sums, counts = bundles(batch.column("text").to_pylist(), letters, is_letter)
        norms = np.linalg.norm(sums.astype(np.float64), axis=1)
        best, score = np.full(len(sums), len(names) - 1), np.zeros(len(sums))
        if prototypes.langs and len(sums):
            cosines = (sums @ prototypes.vectors.T) / np.where(norms > 0, norms, 1)[:, None]
            known = counts > 0
            best[known] = cosines.argmax(1)[known]
            score[known] = np.clip(cosines.max(1), 0, 1)[known]
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(score, pa.float64())],
            names=["doc_id", "lang_pred", "score"],
        )


def fold(doc_id_column: str = "doc_id", folds: int = FOLDS):
    """crc32 of the id's text modulo `folds`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id_column).cast("string"), F.lit(""))) % folds


def identify(docs: DataFrame, prototypes: Prototypes) -> DataFrame:
    """(doc_id, lang_pred, score) for every row: `und` with score 0 if the text is
    null or has no letter (or nothing was learned), else the nearest prototype and
    its cosine, 0 at least. Equal cosines go to the first language by name."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        partial(_predict, prototypes=prototypes), "doc_id long, lang_pred string, score double"
    )


def predict_languages(docs: DataFrame) -> DataFrame:
    """Learn from the rows outside fold 0 and predict all: (doc_id, held_out,
    lang_pred, score). Repeated rows are predicted each; extra columns are not
    read; an empty table gives no rows."""
    found = identify(docs, learn_prototypes(docs.where(fold() != 0)))
    return found.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")
