"""Centroid clustering of integer vectors with Hamerly's bounds.

Each vector keeps one upper bound of the distance to its own centroid and one lower
bound of the distance to the second nearest. When centroids have moved, the bounds are
loosened by how far; only a vector whose bounds then meet is looked at: its upper bound
is made exact, and if that does not part them it gets a full scan of all centroids in
integers. Bounds are floats rounded to the safe side, so they only decide what is not
scanned; every assignment is that of exact integer distances, ties to the smaller number.

The state is one written table a round, a row a vector. Vectors are never shuffled: a
round reads its rows where they lie and sums them by cluster on the map side. The driver
sees the centroids and their sums only, `Clustering.k` rows of `dims` numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.shared import materialize

#: Largest component whose squared distances surely fit a long.
LARGEST = 1 << 27
UP, DOWN = 1 + 2.0**-50, 1 - 2.0**-50


@dataclass(frozen=True)
class Clustering:
    """Number of centroids and components, scale of the integers, rounds of moving, seed of the start."""

    k: int = 16
    dims: int = 64
    scale: int = 64
    rounds: int = 3
    seed: int = 1


def integer_vectors(embeddings: DataFrame, plan: Clustering) -> DataFrame:
    """(vec_id, v): the vectors of exactly `dims` finite components as floor(scale * x)."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    finite = F.forall(x, lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)) & ~F.isnan(e))
    whole = lambda e: F.when(
        F.abs(e) * plan.scale <= LARGEST, F.floor(e * plan.scale)
    ).otherwise(F.raise_error(F.lit("a component is too large for exact squared distances in a long")))
    return embeddings.where((F.size("embedding") == plan.dims) & finite).select(
        F.col("vec_id").cast("long"), F.transform(x, whole).alias("v")
    )


def first_centroids(vectors: DataFrame, plan: Clustering) -> np.ndarray:
    """The k vectors whose sha256 of `seed:vec_id` is smallest (then by components); k rows reach the driver."""
    named = F.sha2(F.concat(F.lit(f"{plan.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(named.alias("h"), "v").orderBy("h", "v").limit(plan.k).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(-1, plan.dims)


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row a vector, a column a centroid."""
    return (vectors * vectors).sum(1)[:, None] - 2 * (vectors @ centroids.T) + (centroids * centroids).sum(1)


def half_gaps(centroids: np.ndarray) -> np.ndarray:
    """Half the distance of each centroid to the nearest other one, rounded down."""
    if len(centroids) < 2:
        return np.full(len(centroids), np.inf)
    between = squared(centroids, centroids).astype(np.float64)
    np.fill_diagonal(between, np.inf)
    return np.sqrt(between.min(1)) * 0.5 * DOWN


def drifts(before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each centroid moved, and how far the farthest of the others did, rounded up."""
    own = np.sqrt(((after - before) ** 2).sum(1).astype(np.float64)) * UP
    others = np.array([np.delete(own, c).max(initial=0.0) for c in range(len(own))])
    return own, others


def assign(
    vectors: np.ndarray,
    centroids: np.ndarray,
    moved: tuple[np.ndarray, np.ndarray] | None,
    cluster: np.ndarray,
    upper: np.ndarray,
    lower: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroids, new bounds, and which vectors got a full scan (all, if nothing is known yet)."""
    scan = np.ones(len(vectors), bool)
    if moved is not None:
        own, others = moved
        upper = (upper + own[cluster]) * UP
        lower = (lower - others[cluster]) - np.abs(lower) * 2.0**-50
        apart = np.maximum(lower, half_gaps(centroids)[cluster])
        scan = ~(upper < apart)
        at = np.flatnonzero(scan)
        exact = ((vectors[at] - centroids[cluster[at]]) ** 2).sum(1)
        upper[at] = np.sqrt(exact.astype(np.float64)) * UP
        scan[at] = ~(upper[at] < apart[at])
    at = np.flatnonzero(scan)
    if len(at):
        table = squared(vectors[at], centroids)
        cluster[at] = nearest = table.argmin(1)
        rows = np.arange(len(at))
        upper[at] = np.sqrt(table[rows, nearest].astype(np.float64)) * UP
        if table.shape[1] > 1:
            lower[at] = np.sqrt(np.partition(table, 1, axis=1)[:, 1].astype(np.float64)) * DOWN
    return cluster, upper, lower, scan


STATE = "vec_id long, v array<long>, cluster int, distance long, upper double, lower double, scanned boolean"


def _round(state: DataFrame, centroids: np.ndarray, moved: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            vectors = batch.column("v").flatten().to_numpy().reshape(n, dims)
            if moved is None:
                held = np.zeros(n, np.int32), np.zeros(n), np.full(n, np.inf)
            else:
                held = tuple(np.array(batch.column(c)) for c in ("cluster", "upper", "lower"))
            cluster, upper, lower, scanned = assign(vectors, centroids, moved, *held)
            distance = ((vectors - centroids[cluster]) ** 2).sum(1)
            kinds = [(cluster, pa.int32()), (distance, pa.int64()), (upper, pa.float64()), (lower, pa.float64()), (scanned, pa.bool_())]
            yield pa.record_batch(
                [batch.column("vec_id"), batch.column("v"), *(pa.array(c, k) for c, k in kinds)],
                names=["vec_id", "v", "cluster", "distance", "upper", "lower", "scanned"],
            )

    return materialize(state.mapInArrow(run, STATE), "clusters")


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Exact floors of the means; a centroid without vectors stays."""
    dims = centroids.shape[1]
    sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dims)]
    after = centroids.copy()
    for row in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        after[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dims)]
    return after


def cluster_vectors(embeddings: DataFrame, plan: Clustering = Clustering()) -> tuple[DataFrame, np.ndarray]:
    """The written state (a row a kept vector) and the centroids it was last assigned to.

    Vectors of another length, null ones and those with a null or non-finite component
    are left out. Repeated rows and vec_ids are vectors of their own; a null vec_id is an
    empty decimal in the starting order, where equal hashes go by components. With fewer
    vectors than centroids there are as many centroids as vectors; without vectors the
    state is empty. Other columns are not read. A component beyond 2^27 after scaling
    is an error, as no long holds its squared distances.
    """
    vectors = integer_vectors(embeddings, plan)
    centroids = first_centroids(vectors, plan)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], STATE), centroids
    state = _round(vectors, centroids, None)
    for _ in range(plan.rounds):
        after = _moved(state, centroids)
        state = _round(state, after, drifts(centroids, after))
        centroids = after
    return state, centroids


def cluster_report(embeddings: DataFrame, plan: Clustering = Clustering()) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    state, centroids = cluster_vectors(embeddings, plan)
    sums = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of_cluster = lambda values, kind: F.array(*[F.lit(x).cast(kind) for x in values] or [F.lit(None).cast(kind)])[F.col("cluster")]
    return state.select(
        "vec_id",
        "cluster",
        "distance",
        of_cluster([sums.get(c, 0) for c in range(len(names))], "long").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"),
        of_cluster(names, "string").alias("centroid_sha256"),
    )


def oracle_sql(plan: Clustering = Clustering()) -> str:
    """DuckDB SQL of the same rows, by full scans."""
    dims = f"range(1, {plan.dims + 1})"
    steps = [
        f"""vecs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
    list_transform(embedding, lambda x: CAST(floor({plan.scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {plan.dims}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {plan.dims})""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{plan.seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS k, v AS c
  FROM vecs QUALIFY k < {plan.k})""",
    ]
    for r in range(plan.rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT rid, vec_id, v, k, d FROM (
    SELECT rid, vec_id, v, k, CAST(list_sum(list_transform({dims}, lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS d
    FROM vecs, c{r})
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, k) = 1)""")
        if r < plan.rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c{r}.k, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
    SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
      SELECT k, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, (SELECT unnest({dims}) AS i) GROUP BY k, i)
    GROUP BY k) m ON m.k = c{r}.k)""")
    last = plan.rounds
    return f"""WITH {",\n".join(steps)}
SELECT a.vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{last} a JOIN c{last} c ON c.k = a.k"""
