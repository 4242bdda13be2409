"""What lies outside the engine, behind hooks with deterministic stand-ins.

A hook is a function of a DataFrame, so a plan never hides a network call: a real
provider is passed in by the caller, the stand-in needs nothing but the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Hook = Callable[[DataFrame], DataFrame]
#: Texts that are embedded at once.
MOST_TEXTS = 256


def hash_vector(text: str, dimensions: int) -> list[float]:
    """A unit vector drawn from SHA-256 of the text."""
    data, values = text.encode(), []
    block = sha256(data).digest()
    while len(values) < dimensions:
        values += [b / 127.5 - 1 for b in block]
        block = sha256(block + data).digest()
    values = values[:dimensions]
    norm = sum(v * v for v in values) ** 0.5 or 1.0
    return [v / norm for v in values]


def embed(rows: DataFrame, key: str, text: str, dimensions: int = 128, batch: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """(key, embedding) by a batch function of texts; without one, by `hash_vector`. The function
    gets at most `MOST_TEXTS` at once, and a worker never holds more of them as Python objects."""
    encode = batch or (lambda texts: [hash_vector(t, dimensions) for t in texts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, MOST_TEXTS):
                part = whole.slice(at, MOST_TEXTS)
                vectors = encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.record_batch([part.column(0), pa.array(vectors, pa.list_(pa.float64()))], names=["key", "embedding"])

    kind = rows.schema[key].dataType.simpleString()
    found = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, embedding array<double>")
    return found.withColumnRenamed("key", key)


@dataclass(frozen=True)
class Filters:
    """Filters of a search; None is no filter."""

    types: frozenset[str] | None = None
    not_types: frozenset[str] = frozenset()
    most_tier: int | None = None

    def merge(self, other: Filters) -> Filters | None:
        """Both filters at once; None if no type is left, which skips the tier."""
        types = self.types if other.types is None else other.types if self.types is None else self.types & other.types
        excluded = self.not_types | other.not_types
        if types is not None:
            types = types - excluded
            if not types:
                return None
        tiers = [t for t in (self.most_tier, other.most_tier) if t is not None]
        return Filters(types, excluded, min(tiers) if tiers else None)

    def apply(self, rows: DataFrame, kind: str, tier: str | None = None) -> DataFrame:
        if self.types is not None:
            rows = rows.where(F.col(kind).isin(sorted(self.types)))
        if self.not_types:
            rows = rows.where(~F.col(kind).isin(sorted(self.not_types)))
        return rows.where(F.col(tier) <= self.most_tier) if tier and self.most_tier is not None else rows


@dataclass
class Providers:
    """Readers of other formats, searches, models: by name, set by the caller."""

    hooks: dict[str, Hook] = field(default_factory=dict)

    def call(self, name: str, rows: DataFrame) -> DataFrame:
        if name not in self.hooks:
            raise LookupError(f"no provider for {name}; pass one in, the engine makes no calls of its own")
        return self.hooks[name](rows)
