"""What the driver holds for the pipeline's joins: few broadcasts and small plans, however small the tables are."""

import re

import corpus_pipeline
from marquee.llm import shared
from tests.conftest import DATA


def planned(spark, job):
    """(broadcasts, exchanges) of each executed plan of the job, as its final plan says."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    seen = store.executionsList().size()
    job()
    bus.waitUntilEmpty()
    found = store.executionsList()
    plans = [found.apply(i).physicalPlanDescription().split("== Initial Plan ==")[0] for i in range(seen, found.size())]
    assert plans
    tree = lambda kind, plan: len(re.findall(rf"\b{kind} \(\d+\)$", plan, re.M))
    return [(tree("BroadcastExchange", p), tree("(?:Broadcast)?Exchange", p)) for p in plans]


def test_components_need_no_broadcast(spark):
    edges = spark.range(200).selectExpr("id as u", "id + 1 as v")
    found = []
    plans = planned(spark, lambda: found.extend(shared.connected_components(edges).collect()))
    assert len(found) == 201 and len({r.component for r in found}) == 1
    assert sum(b for b, _ in plans) == 0 < sum(e for _, e in plans)


def test_stages_broadcast_little_and_plan_piece_by_piece(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    near = planned(spark, lambda: corpus_pipeline.near_duplicates(spark, docs, DATA).collect())
    assert sum(b for b, _ in near) <= 2  # the rows that stay
    held = planned(spark, lambda: corpus_pipeline.decontamination(spark, docs, DATA).collect())
    assert sum(b for b, _ in held) <= 8  # indexes and ids under a measured bound
    assert max(e for _, e in held) <= 12
