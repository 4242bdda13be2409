"""A partitioned index of vectors: inverted lists around trained centroids.

Vectors are scaled to length one. Centroids are trained on a bounded sample; every row
is then filed in the list of its nearest centroid, and each list knows its radius, the
largest angle of a row to its centroid. A search reads the lists nearest to the query
first (only those folders, with column filters pushed to the scan). What it has found
then bounds the rest: by the triangle inequality on angles a list whose nearest possible
row is farther than the k-th found cannot matter. An exact search reads the lists that
remain; so it also does where a filter leaves fewer than k rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators.ranking import top_per_key

#: Angles are widened by this much, far above the rounding of their cosines.
SLACK = 1e-6
FOUND = "query_id long, key long, similarity double"


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero."""
    norms = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def train(sample: np.ndarray, lists: int, rounds: int) -> np.ndarray:
    """Unit centroids of unit vectors by spherical k-means from evenly spaced rows."""
    lists = max(1, min(lists, len(sample)))
    centroids = sample[np.linspace(0, len(sample) - 1, lists).astype(int)] if len(sample) else np.zeros((1, sample.shape[1]))
    for _ in range(rounds):
        own = (sample @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        moved = unit_rows(sums)
        centroids = np.where((moved != 0).any(1, keepdims=True), moved, centroids)
    return centroids


def _matrix(column: pa.Array | pd.Series, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else np.concatenate([*column]) if len(column) else np.zeros(0)
    return flat.astype(np.float64).reshape(-1, dims)


@dataclass(frozen=True)
class VectorIndex:
    """An index written under `path`: folders `rows/list=N`, and what the driver needs to
    choose among them, a row a list."""

    path: str
    schema: str
    centroids: np.ndarray
    radii: np.ndarray
    counts: np.ndarray
    most_rows: int = field(default=50_000)

    @staticmethod
    def build(
        vectors: DataFrame, key: str, embedding: str, path: str, *, dims: int, keep: tuple[str, ...] = (), lists: int | None = None, sample_rows: int = 20_000, rounds: int = 8
    ) -> VectorIndex:
        """Index every row whose vector has `dims` non-null components.

        `keep` names columns that searches may filter by. At most `sample_rows` rows, chosen
        by the hash of their key, train the centroids; there are about sqrt(n) of these.
        """
        usable = vectors.where((F.size(embedding) == dims) & ~F.exists(embedding, lambda x: x.isNull()) & F.col(key).isNotNull())
        plain = usable.select(F.col(key).cast("long").alias("key"), F.col(embedding).cast("array<double>").alias("v"), *keep)
        n = plain.count()
        share = min(1.0, 1.2 * sample_rows / max(n, 1))
        drawn = plain.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("key", "v")
        rows = drawn.orderBy(F.xxhash64("key"), "key").limit(sample_rows).collect()
        sample = unit_rows(np.array([r["v"] for r in rows], np.float64).reshape(-1, dims))
        centroids = train(sample, lists or max(4, min(4096, round(math.sqrt(n)))), rounds)

        def file_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit = unit_rows(_matrix(batch.column("v"), dims))
                cosines = unit @ centroids.T
                own = cosines.argmax(1)
                angle = np.arccos(np.clip(cosines[np.arange(len(own)), own], -1, 1))
                columns = [batch.column(i) for i in range(batch.num_columns)]
                columns[1] = pa.ListArray.from_arrays(np.arange(0, len(unit) * dims + 1, dims, dtype=np.int32), unit.ravel())
                yield pa.record_batch(columns + [pa.array(own, pa.int32()), pa.array(angle)], names=[*batch.schema.names, "list", "angle"])

        kinds = ", ".join(f"`{c}` {plain.schema[c].dataType.simpleString()}" for c in plain.columns)
        filed = plain.mapInArrow(file_rows, f"{kinds}, list int, angle double")
        # a large list is dealt to several tasks by the hash of the key
        dealt = filed.repartition("list", F.pmod(F.xxhash64("key"), F.lit(8)))
        dealt.write.partitionBy("list").parquet(f"{path}/rows")
        schema = f"{kinds}, angle double, list int"
        stats = vectors.sparkSession.read.schema(schema).parquet(f"{path}/rows").groupBy("list").agg(F.max("angle").alias("r"), F.count("*").alias("n"))
        radii, counts = np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
        for r in stats.collect():  # a row a list
            radii[r["list"]], counts[r["list"]] = r["r"] + SLACK, r["n"]
        return VectorIndex(path, schema, centroids, radii, counts)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def _nearest(self, probes: int, reach: bool):
        """For each query (query_id, q[, best]) the lists to read: its `probes` nearest, or all others that may hold a row at `best` or above."""
        centroids, radii, some = self.centroids, self.radii, self.counts > 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit = unit_rows(_matrix(batch.column("q"), centroids.shape[1]))
                angles = np.arccos(np.clip(unit @ centroids.T, -1, 1))
                place = np.where(some, angles, np.inf).argsort(1, kind="stable").argsort(1, kind="stable")
                chosen = some & (place < probes)
                if reach:
                    nearest_possible = np.cos(np.maximum(angles - radii, 0))
                    best = np.array(batch.column("best"))[:, None]
                    chosen = some & (place >= probes) & (np.maximum(nearest_possible, 0) >= best)
                at, number = np.nonzero(chosen)
                yield pa.record_batch(
                    [batch.column("query_id").take(pa.array(at)), pa.array(number.astype(np.int32))], names=["query_id", "list"]
                )

        return run

    def _scored(self, queries: DataFrame, wanted: DataFrame, k: int, only: Column | None) -> DataFrame:
        """(query_id, key, similarity): of each wanted (query_id, list) the k best rows of every part of the list.

        Rows and queries of a list meet in groups of at most about `most_rows` rows, for which
        a matrix product gives all similarities; each group tells k rows a query.
        """
        spark, dims = queries.sparkSession, self.centroids.shape[1]
        parts = F.array(*[F.lit(int(max(1, -(-c // self.most_rows)))) for c in self.counts])
        of_list = F.get(parts, F.col("list"))
        read = self.rows(spark)
        lists = sorted(r[0] for r in wanted.select("list").distinct().collect())  # at most the number of lists
        held = read.where(F.col("list").isin(lists)).where(F.lit(True) if only is None else only)
        left = held.select("list", F.pmod(F.xxhash64("key"), of_list).cast("int").alias("part"), "key", "v")
        right = wanted.join(queries.select("query_id", "q"), "query_id").select("list", F.explode(F.sequence(F.lit(0), of_list - 1)).alias("part"), "query_id", "q")

        def best(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(rows) and len(asked):
                keys, matrix = rows["key"].to_numpy(), _matrix(rows["v"], dims)
                for at in range(0, len(asked), 256):
                    some = asked.iloc[at : at + 256]
                    table = np.clip(unit_rows(_matrix(some["q"], dims)) @ matrix.T, 0, 1)
                    for query, line in zip(some["query_id"], table):
                        first = np.lexsort((keys, -line))[:k] if len(keys) <= 4 * k else _best(keys, line, k)
                        out.append(pd.DataFrame({"query_id": query, "key": keys[first], "similarity": line[first]}))
            return pd.concat(out) if out else pd.DataFrame({"query_id": [], "key": [], "similarity": []}).astype({"query_id": "int64", "key": "int64"})

        return left.groupBy("list", "part").cogroup(right.groupBy("list", "part")).applyInPandas(best, FOUND)

    def search(self, queries: DataFrame, k: int, *, probes: int = 4, only: Column | None = None, exact: bool = True) -> DataFrame:
        """(query_id, key, similarity): the k rows of greatest cosine (negative ones count as 0)
        for each of `queries` (query_id, q), equal ones by key.

        only: a condition on kept columns. exact: read on until no other row can be
        among the k; else the rows of the `probes` nearest lists are all that is seen.
        """
        from marquee.operators.tables import written

        order = [F.desc("similarity"), "key"]
        asked = written(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<double>").alias("q")), "queries")
        near = asked.mapInArrow(self._nearest(probes, False), "query_id long, list int")
        found = top_per_key(self._scored(asked, near, k, only), ["query_id"], order, k)
        if not exact:
            return found
        found = written(found, "found")
        kth = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("similarity").alias("s"))
        bounded = asked.join(kth, "query_id", "left").select("query_id", "q", F.when(F.col("n") >= k, F.col("s")).otherwise(0.0).alias("best"))
        rest = written(bounded.mapInArrow(self._nearest(probes, True), "query_id long, list int"), "rest")
        return top_per_key(found.unionByName(self._scored(asked, rest, k, only)), ["query_id"], order, k)


def _best(keys: np.ndarray, line: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest values, equal ones by key."""
    least = np.partition(line, len(line) - k)[len(line) - k]
    at = np.flatnonzero(line >= least)
    return at[np.lexsort((keys[at], -line[at]))][:k]


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact (query_id, key) rows that were found."""
    both = exact.select("query_id", "key").distinct().join(found.select("query_id", "key").distinct().withColumn("hit", F.lit(1)), ["query_id", "key"], "left")
    n, hits = both.agg(F.count("*"), F.sum("hit")).first()
    return (hits or 0) / n if n else 1.0
