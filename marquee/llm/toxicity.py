"""A toxicity classifier with a counterfactual penalty.

A logistic regression over the presence of words and word beginnings. For every
labelled training text that mentions an identity term a counterfactual is made by
swapping each term for the next one of its group; training minimises

    log loss + l2 * |w|^2 + penalty * (logit(text) - logit(counterfactual))^2

so that a mention of a group does not move the score, whatever the labels of the
texts that happen to mention it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 22
PREFIXES = (3, 4, 5, 6)
HELD_OUT, FOLDS = 2, 4
THRESHOLD = 0.3

#: Terms that may stand for each other in a counterfactual.
IDENTITY_GROUPS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "catholic", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "catholics", "atheists"),
    ("black", "white", "asian", "latino", "hispanic", "arab", "african", "european", "indigenous"),
    ("gay", "lesbian", "straight", "bisexual", "heterosexual", "homosexual", "queer"),
    ("woman", "man", "girl", "boy"),
    ("women", "men", "girls", "boys"),
    ("female", "male", "transgender", "cisgender", "nonbinary"),
    ("immigrant", "refugee", "foreigner", "citizen", "migrant"),
    ("immigrants", "refugees", "foreigners", "citizens", "migrants"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young", "elderly", "teenage"),
    ("mexican", "american", "chinese", "german", "french", "spanish", "russian", "turkish", "polish"),
    ("muslime", "christen", "juden", "ausländer", "deutsche", "türken"),
    ("musulmans", "chrétiens", "juifs", "étrangers", "arabes"),
    ("musulmanes", "cristianos", "judíos", "extranjeros", "gitanos"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)
SWAP = {term: group[(i + 1) % len(group)] for group in IDENTITY_GROUPS for i, term in enumerate(group)}


@dataclass(frozen=True)
class Training:
    """Bounds and strengths. `most_rows` bounds each label's expected share of the
    sample that is fitted; labelled rows beyond it are left to chance by the hash of
    their id, and the log loss weighs the two labels back to their true shares.
    `most_features` is the size of the model: the features that tell the sample's labels
    apart best, and with them those of the identity terms that its counterfactuals hold."""

    most_rows: int = 6000
    most_features: int = 6000
    least_texts: int = 4
    l2: float = 2e-5
    penalty: float = 1.0
    passes: int = 25
    rate: float = 0.3
    batch: int = 64


def word_features(word: str) -> list[int]:
    """Hashed features of one word: itself and its beginnings."""
    found = [crc32(b"=" + word.encode()) % BUCKETS]
    found += [crc32(b"^" + word[:n].encode()) % BUCKETS for n in PREFIXES if len(word) >= n]
    return found


def features(words: set[str]) -> list[int]:
    return sorted({f for w in words for f in word_features(w)})


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of texts and, where identity terms occur, of their counterfactuals."""
    for batch in batches:
        own, swapped = [], []
        for text in batch.column("text").to_pylist():
            words = set(WORD.findall((text or "").lower()))
            own.append(features(words))
            terms = words & SWAP.keys()
            swapped.append(features((words - terms) | {SWAP[t] for t in terms}) if terms else None)
        yield pa.record_batch(
            [batch.column("toxic"), pa.array(own, pa.list_(pa.int32())), pa.array(swapped, pa.list_(pa.int32()))],
            names=["toxic", "own", "swapped"],
        )


@dataclass(frozen=True)
class Model:
    """Weights of the chosen features, by bucket."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def logit(self, chosen: list[int]) -> float:
        return self.bias + float(self.weights[chosen].sum())


def choose(
    examples: list[np.ndarray], swapped: list[np.ndarray | None], labels: np.ndarray, weights: np.ndarray, training: Training
) -> np.ndarray:
    """The features that tell the labels apart best, by weighted chi-square, and all in which a
    text and its counterfactual differ: those are what the penalty is about."""
    sums = np.zeros((2, BUCKETS), np.float64)  # by label; as large as the hash, whatever the texts
    texts = np.zeros(BUCKETS, np.int32)
    for x, y, w in zip(examples, labels, weights):
        sums[y, x] += w
        texts[x] += 1
    buckets = np.flatnonzero(texts >= training.least_texts)
    clean, toxic = sums[:, buckets]
    n_toxic, n_clean = weights[labels == 1].sum(), weights[labels == 0].sum()
    total, seen = n_toxic + n_clean, toxic + clean
    spread = seen * (total - seen) * n_toxic * n_clean
    chi = np.where(spread > 0, total * (toxic * n_clean - clean * n_toxic) ** 2 / np.maximum(spread, 1e-9), 0)
    best = np.lexsort((buckets, -chi))[: training.most_features]
    pairs = [np.setxor1d(x, y) for x, y in zip(examples, swapped) if y is not None]
    return np.unique(np.concatenate([buckets[best[chi[best] > 0]], *pairs]).astype(np.int64))


def fit(examples: list[np.ndarray], swapped: list[np.ndarray | None], labels: np.ndarray, weights: np.ndarray, training: Training) -> Model:
    """Adagrad on the penalised loss; `weights` are the texts' weights in the log loss."""
    empty = Model(np.zeros(0, np.int64), np.zeros(0), -4.0)
    if not len(labels) or not (0 < labels.sum() < len(labels)):
        return empty if not len(labels) or not labels.sum() else Model(empty.buckets, empty.weights, 4.0)
    # an identity term gets a weight to be penalised even where only counterfactuals have it
    chosen = choose(examples, swapped, labels, weights, training)
    own = [np.searchsorted(chosen, np.intersect1d(x, chosen)) for x in examples]
    other = [None if x is None else np.searchsorted(chosen, np.intersect1d(x, chosen)) for x in swapped]
    share = (weights * labels).sum() / weights.sum()
    w, bias = np.zeros(len(chosen)), float(np.log(share / (1 - share)))
    past, past_bias = np.full(len(chosen), 1e-6), 1e-6
    random = np.random.default_rng(11)
    for _ in range(training.passes):
        order = random.permutation(len(own))
        for lo in range(0, len(order), training.batch):
            part = order[lo : lo + training.batch]
            step, step_bias = np.zeros(len(chosen)), 0.0
            for i in part:
                z = bias + w[own[i]].sum()
                error = weights[i] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i])
                step[own[i]] += error
                step_bias += error
                if other[i] is not None:
                    gap = 2 * training.penalty * (w[own[i]].sum() - w[other[i]].sum())
                    step[own[i]] += gap
                    step[other[i]] -= gap
            step = step / len(part) + 2 * training.l2 * w
            past += step**2
            w -= training.rate * step / np.sqrt(past)
            past_bias += (step_bias / len(part)) ** 2
            bias -= training.rate * step_bias / len(part) / np.sqrt(past_bias)
    return Model(chosen, w, bias)


def _arrays(column: pa.ListArray) -> list[np.ndarray | None]:
    """Views of a list column's rows."""
    flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
    null = column.is_null().to_numpy(zero_copy_only=False)
    return [None if n else flat[a:b] for n, a, b in zip(null, ends[:-1], ends[1:])]


def train(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> Model:
    """Fit on rows of `labels` (doc_id, toxic) joined with `docs` (doc_id, text).

    Null labels are not used. The rows for the driver are bounded by
    `most_rows` a label; features are made on the executors.
    """
    known = labels.where("toxic in (0, 1)").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rate = {y: min(1.0, training.most_rows / n) for y, n in counts.items()}
    place = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 62) - 1)) / float(1 << 62)
    limit = F.when(F.col("toxic") == 1, rate.get(1, 0.0)).otherwise(rate.get(0, 0.0))
    sample = known.where((F.lit(min(rate.values(), default=1.0)) >= 1.0) | (place < limit))
    rows = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .join(F.broadcast(sample), "doc_id")  # 2 * most_rows rows are expected
        .select("text", "toxic")
        .mapInArrow(_examples, "toxic int, own array<int>, swapped array<int>")
        .toArrow()
    )
    own, swapped = (_arrays(rows.column(c).combine_chunks()) for c in ("own", "swapped"))
    y = rows.column("toxic").to_numpy()
    order = sorted(range(len(own)), key=lambda i: (int(y[i]), crc32(own[i].tobytes())))  # whatever order tasks end in
    weights = np.array([1 / rate[int(v)] for v in y])
    weights = weights / weights.mean() if len(weights) else weights
    return fit([own[i] for i in order], [swapped[i] for i in order], y[order], weights[order], training)


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    place = {int(b): i for i, b in enumerate(model.buckets)}
    known: dict[str, tuple[int, ...]] = {}
    for batch in batches:
        scores = []
        for text in batch.column("text").to_pylist():
            chosen: set[int] = set()
            for word in set(WORD.findall((text or "").lower())):
                found = known.get(word)
                if found is None:
                    if len(known) > 500_000:
                        known.clear()
                    known[word] = found = tuple(place[f] for f in word_features(word) if f in place)
                if found:
                    chosen.update(found)
            scores.append(1 / (1 + np.exp(-np.clip(model.logit(sorted(chosen)), -30, 30))))
        yield pa.record_batch([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row from its whole text; null is an empty text."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        partial(_score, model=model), "doc_id long, score double"
    )


def predict_toxicity(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `docs`.

    Labels of the held-out fold (crc32 of the id's text mod 4 is 2; a null id counts
    as empty text) are never read. Rows with the same doc_id are scored each, and each
    teaches with each label of its id; equal texts have equal scores. Features that tell the
    labels apart alike are taken in the order of their hash. Null and empty texts have the
    score of no feature; whole texts are read, however long. Extra columns are not read.
    Without labels every score is low, without texts of one label it is that of the
    other; an empty table gives no rows.
    """
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS
    model = train(docs, labels.where(fold != HELD_OUT), training)
    return score(docs, model).select(
        "doc_id", (fold == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
