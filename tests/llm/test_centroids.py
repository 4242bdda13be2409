import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.llm import centroids as ct

FEW = ct.Clustering(k=5, dims=4, rounds=3)


def slow_report(rows, plan):
    kept = [
        (i, [math.floor(plan.scale * x) for x in e])
        for i, e in rows
        if e is not None and len(e) == plan.dims and all(x is not None and math.isfinite(x) for x in e)
    ]
    name = lambda i: hashlib.sha256(f"{plan.seed}:{'' if i is None else i}".encode()).hexdigest()
    middles = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[: plan.k]]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))

    def nearest():
        return [min(range(len(middles)), key=lambda k: (far(v, middles[k]), k)) for _, v in kept]

    for _ in range(plan.rounds):
        own = nearest()
        for k in range(len(middles)):
            if mine := [v for (_, v), c in zip(kept, own) if c == k]:
                middles[k] = [sum(x) // len(mine) for x in zip(*mine)]
    own = nearest()
    distance = [far(v, middles[k]) for (_, v), k in zip(kept, own)]
    return [
        (i, k, d, sum(x for x, c in zip(distance, own) if c == k), sum(distance), hashlib.sha256(",".join(map(str, middles[k])).encode()).hexdigest())
        for (i, _), k, d in zip(kept, own, distance)
    ]


def rows_of(seed, n=150):
    rng = random.Random(seed)
    at = [[rng.uniform(-2, 2) for _ in range(4)] for _ in range(6)]
    rows = [(i, [round(x + rng.gauss(0, 0.3), 2) for x in at[rng.randrange(6)]]) for i in range(n)]
    rows += [rows[3], (rows[4][0], rows[5][1]), (None, [0.0] * 4), (n, None), (n + 1, []), (n + 2, [1.0] * 3), (n + 3, [1.0] * 5)]
    return rows + [(n + 4, [1.0, None, 0.0, 0.0]), (n + 5, [math.nan, 0.0, 0.0, 0.0]), (n + 6, [math.inf, 0.0, 0.0, 0.0])]


def frame(spark, rows, kind="double"):
    data = [(i, e, 1, 0, "x", 1.0) for i, e in rows]
    return spark.createDataFrame(data, f"vec_id long, embedding array<{kind}>, label int, cluster int, v string, upper double").repartition(3)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = rows_of(seed)
    got = sorted((tuple(r) for r in ct.cluster_report(frame(spark, rows), FEW).collect()), key=repr)
    assert got == sorted(slow_report(rows, FEW), key=repr)


def test_ties_and_equal_vectors(spark):
    rows = [(i, [float(i % 2), 0.0, 0.0, 0.0]) for i in range(40)] + [(40, [0.5, 0.0, 0.0, 0.0])]
    got = sorted(tuple(r) for r in ct.cluster_report(frame(spark, rows), FEW).collect())
    assert got == sorted(slow_report(rows, FEW))


def test_few_and_no_vectors(spark):
    rows = [(1, [1.0, -0.01, 0.0, 0.0]), (2, [3.0, 0.0, 0.0, 0.0])]
    assert sorted(tuple(r) for r in ct.cluster_report(frame(spark, rows), FEW).collect()) == sorted(slow_report(rows, FEW))
    one = rows[:1]
    assert [tuple(r) for r in ct.cluster_report(frame(spark, one), FEW).collect()] == slow_report(one, FEW)
    assert ct.cluster_report(frame(spark, [(1, None)]), FEW).collect() == []


def test_bounds_hold_and_spare_scans(spark):
    rng = np.random.default_rng(5)
    at = rng.normal(0, 3, (5, 4))
    rows = [(i, (at[i % 5] + rng.normal(0, 0.1, 4)).tolist()) for i in range(500)]
    state, centroids = ct.cluster_vectors(frame(spark, rows, "float"), FEW)
    for r in state.collect():
        apart = sorted(math.dist(r["v"], c) for c in centroids.tolist())
        assert r["upper"] >= apart[0] and r["lower"] <= apart[1]
    assert state.where("scanned").count() < 250


def test_too_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        ct.cluster_report(frame(spark, [(1, [1e300, 0.0, 0.0, 0.0])]), FEW).collect()


def test_sql_against_brute_force(spark):
    rows = rows_of(9, 60)
    con = duckdb.connect()
    con.register("t", frame(spark, rows).select("vec_id", "embedding").toArrow())
    con.sql("create view embeddings as select * from t")
    assert sorted(con.sql(ct.oracle_sql(FEW)).fetchall(), key=repr) == sorted(slow_report(rows, FEW), key=repr)
