"""The vector index against scans of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.operators import vector_index as vi
from tests.conftest import DATA


def slow(rows, queries, k, only=lambda label: True):
    out = set()
    for q, v in queries:
        v = np.array(v) / (np.linalg.norm(v) or 1)
        scored = []
        for key, e, label in rows:
            norm = np.linalg.norm(e)
            if only(label):
                scored.append((-round(float(np.clip(np.dot(e, v) / norm if norm else 0, 0, 1)), 9), key))
        out |= {(q, key, -s) for s, key in sorted(scored)[:k]}
    return out


def rounded(found):
    return {(r.query_id, r.key, round(r.similarity, 9)) for r in found.collect()}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    middles = rng.normal(0, 1, (12, 6))
    rows = [(i, (middles[i % 12] + rng.normal(0, 0.15, 6)).round(6).tolist(), i % 5) for i in range(600)]
    rows += [(600, [0.0] * 6, 0), (601, rows[3][1], 1), (602, rows[3][1], 2)]
    table = spark.createDataFrame(rows + [(603, None, 0), (604, [1.0], 0), (605, [None] * 6, 0), (None, [1.0] * 6, 0)], "id long, e array<double>, label int")
    index = vi.VectorIndex.build(table, "id", "e", f"{tmp_path_factory.mktemp('index')}/i", dims=6, keep=("label",), lists=12, sample_rows=300)
    queries = [(i, rows[i][1]) for i in range(0, 600, 40)] + [(900, [0.0] * 6), (901, (-np.array(rows[7][1])).tolist())]
    return rows, index, queries, spark.createDataFrame(queries, "query_id long, q array<double>")


def test_exact_search(made):
    rows, index, queries, asked = made
    assert index.counts.sum() == len(rows)
    for probes in (1, 3):
        assert rounded(index.search(asked, 7, probes=probes)) == slow(rows, queries, 7)


def test_filters_are_pushed_and_fall_back(made):
    rows, index, queries, asked = made
    few = index.search(asked, 7, probes=1, only=F.col("label") == 3)
    assert rounded(few) == slow(rows, queries, 7, lambda label: label == 3)
    none = index.search(asked, 7, probes=1, only=F.col("label") == 99)
    assert none.count() == 0
    plan = index.rows(asked.sparkSession).where(F.col("list").isin([1, 2]) & (F.col("label") == 3))._jdf.queryExecution().toString()
    assert "PartitionFilters: [list" in plan and "PushedFilters: [IsNotNull(label), EqualTo(label,3)" in plan


def test_lists_out_of_reach_are_not_read(made):
    _, index, queries, asked = made
    bounded = asked.where("query_id < 600").withColumn("best", F.lit(0.97))
    rest = bounded.mapInArrow(index._nearest(2, True), "query_id long, list int").count()
    assert rest < bounded.count() * 4


def test_groups_of_a_large_list(made):
    rows, index, queries, asked = made
    small = vi.VectorIndex(index.path, index.schema, index.centroids, index.radii, index.counts, most_rows=10)
    assert rounded(small.search(asked, 7, probes=2)) == slow(rows, queries, 7)


def test_recall_of_few_lists(spark, tmp_path):
    """All rows whose id is divisible by 100 as queries, against all rows."""
    table = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/embeddings.parquet")
    index = vi.VectorIndex.build(table, "vec_id", "embedding", f"{tmp_path}/i", dims=64, lists=16)
    asked = table.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    exact = index.search(asked, 20)
    assert exact.count() == 20 * asked.count()
    assert vi.recall(index.search(asked, 20, probes=10, exact=False), exact) >= 0.9


def test_empty_table(spark, tmp_path):
    table = spark.createDataFrame([], "id long, e array<double>")
    index = vi.VectorIndex.build(table, "id", "e", f"{tmp_path}/i", dims=3)
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id long, q array<double>")
    assert index.search(asked, 3).count() == 0
