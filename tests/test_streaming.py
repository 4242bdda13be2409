"""Streaming jobs over the event table, file by file."""

import threading

import pytest
from pyspark.sql import functions as F

from marquee.streaming import jobs
from marquee.streaming.batches import BatchJobs, Status
from marquee.streaming.sessions import expired_sessions, from_micros, merged
from marquee.streaming.upserts import AppendLog, BucketTable
from tests.conftest import DATA


def test_incremental_days_drop_overlaps(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    cut = "timestamp_ntz '2024-01-15'"
    events.where(f"ts < {cut}").coalesce(1).write.parquet(f"{tmp_path}/in")
    again = events.where(f"ts >= timestamp_ntz '2024-01-14'").coalesce(1)
    again.write.mode("append").parquet(f"{tmp_path}/in")
    got = []
    stream = jobs.incremental_days(jobs.event_stream(spark, f"{tmp_path}/in", 10), "40 days")
    jobs.run_available(stream, "update", f"{tmp_path}/cp", lambda df, n: got.extend(df.collect()))
    last = {(r.day.start, r.event_type): r.n for r in got}
    expected = events.groupBy(F.to_date("ts").alias("d"), "event_type").count().collect()
    assert sum(last.values()) == sum(r["count"] for r in expected)


def test_latest_status(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(3, "event_id").write.parquet(f"{tmp_path}/in")
    got = {}
    stream = jobs.latest_status(jobs.event_stream(spark, f"{tmp_path}/in"))
    jobs.run_available(stream, "update", f"{tmp_path}/cp", lambda df, n: got.update({r.user_id: r.event_id for r in df.collect()}))
    expected = events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("e")).collect()
    assert got == {r.user_id: r.e for r in expected}


def slow_sessions(rows, ttl, clock):
    """(key, start, end, n) of the sessions that ended more than `ttl` before `clock`."""
    out = []
    for key in {k for k, _ in rows}:
        times = sorted(t for k, t in rows if k == key)
        groups = [[times[0]]]
        for t in times[1:]:
            if t - groups[-1][-1] > ttl:
                groups.append([])
            groups[-1].append(t)
        out += [(key, g[0], g[-1], len(g)) for g in groups if g[-1] + ttl < clock]
    return sorted(out)


HOUR = 3_600_000_000


def test_merged_sessions():
    assert merged([(0, 5, 2), (9, 9, 1), (20, 20, 1)], 4) == [(0, 9, 3), (20, 20, 1)]
    assert merged([(10, 10, 1), (0, 0, 1), (5, 5, 1)], 5) == [(0, 10, 3)]
    assert merged([], 5) == []


def test_sessions_expire_and_go_on_after_a_restart(spark, tmp_path):
    """Files come one by one, the job is stopped and started between them; an event fills
    the gap between two sessions, another comes too late and is left out."""
    files = [
        [("a", HOUR), ("a", 10 * HOUR), ("b", 1 * HOUR), (None, 2 * HOUR)],
        [("a", 150 * HOUR), ("b", 60 * HOUR), ("c", 150 * HOUR)],
        [("a", 80 * HOUR), ("c", 400 * HOUR), ("c", 400 * HOUR)],
        [("b", 20 * HOUR), ("d", 401 * HOUR)],
        [("c", 600 * HOUR)],
    ]
    schema = "event_id long, ts timestamp_ntz, user_id string"
    for i, rows in enumerate(files):
        frame = spark.createDataFrame([(k, t) for k, t in rows], "k string, us long")
        frame.select(F.lit(0).cast("long").alias("event_id"), from_micros("us").alias("ts"), F.col("k").alias("user_id")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        with jobs.state_settings(spark, 2):
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            over = expired_sessions(stream, "user_id", "ts", "72 hours", "100 hours")
            jobs.run_available(over, "append", f"{tmp_path}/cp", jobs.numbered_sink(f"{tmp_path}/out"))
    got = sorted((r.session_key, r.started, r.ended, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    rows = [r for f in files for r in f if r[0] and r != ("b", 20 * HOUR)]  # 20 h is behind the clock of 300 h
    assert got == slow_sessions(rows, 72 * HOUR, 500 * HOUR)
    assert ("a", HOUR, 150 * HOUR, 4) in got


def items(spark, n):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 3).alias("v"))


def doubled(batch):
    return batch.select("k", (F.col("v") * 2).alias("w"), F.when(F.col("v") == 0, "zero").alias("error"))


RESULT = "k long, w long, error string"


def test_job_is_paused_resumed_and_done_once(spark, tmp_path):
    table = BatchJobs(spark, f"{tmp_path}/jobs")
    job = table.create(items(spark, 90), "k", 5)
    assert table.status(job) == Status(job, "queued", 90, 0, 0)
    second = threading.Event()
    query = table.start(job, doubled, lambda number: second.set() if number == 1 else None)
    while query.isActive and not second.wait(0.1):
        pass
    table.pause(job)
    half = table.status(job)
    assert half.state == "paused" and 0 < half.done + half.failed < 90
    again = BatchJobs(spark, f"{tmp_path}/jobs")  # as after a new start of the driver
    again.start(job, doubled)
    assert again.wait(job) == Status(job, "completed", 90, 60, 30)
    assert sorted(r.k for r in again.results(job, RESULT).collect()) == list(range(90))
    again.cancel(job)
    assert again.status(job).state == "completed"


def test_slices_of_many_items_are_several_files(spark, tmp_path, monkeypatch):
    """A slice is a batch however many files it is, and no file is larger than some items."""
    from marquee.streaming import batches

    monkeypatch.setattr(batches, "ITEMS_A_FILE", 10)
    table, told = BatchJobs(spark, f"{tmp_path}/jobs"), []
    job = table.create(items(spark, 300), "k", 3)
    sizes = [r.n for r in spark.read.parquet(table._path(job, "items")).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 20 and max(sizes) < 40
    table.start(job, doubled, told.append)
    assert table.wait(job) == Status(job, "completed", 300, 200, 100)
    assert told == [0, 1, 2]


def test_cancelled_job_shows_nothing(spark, tmp_path):
    table = BatchJobs(spark, f"{tmp_path}/jobs")
    job = table.create(items(spark, 30), "k", 3)
    first = threading.Event()
    query = table.start(job, doubled, lambda number: first.set())
    while query.isActive and not first.wait(0.1):
        pass
    table.cancel(job)
    assert table.status(job) == Status(job, "cancelled", 30, 0, 0) and table.results(job, RESULT).count() == 0
    with pytest.raises(ValueError):
        table.start(job, doubled)


def test_job_of_failures_and_a_broken_process(spark, tmp_path):
    table = BatchJobs(spark, f"{tmp_path}/jobs")
    job = table.create(items(spark, 9).where("v = 0"), "k", 2)
    table.start(job, doubled)
    assert table.wait(job).state == "failed"
    broken = table.create(items(spark, 9), "k", 2)
    table.start(broken, lambda batch: batch.select(F.raise_error(F.lit("broken")).alias("error")))
    with pytest.raises(Exception, match="broken"):
        table.wait(broken)
    assert table.status(broken).state == "failed"
    empty = table.create(items(spark, 0), "k", 2)
    table.start(empty, doubled)
    assert table.wait(empty).state == "completed"


def test_upserts_touch_their_buckets_and_repeat_safely(spark, tmp_path):
    schema = "k string, at int, v string"
    table = BucketTable(spark, f"{tmp_path}/t", schema, ["k"], ["at"], 8)
    batches = [
        [("a", 1, "x"), ("b", 1, "x"), ("a", 2, "y"), (None, 9, "z")],
        [("a", 1, "late"), ("c", 1, "x")],
        [],
        [("b", 5, "new"), ("b", 5, "new")],
    ]
    best = {}
    for number, rows in enumerate(batches):
        before = table.versions()
        batch = spark.createDataFrame(rows, schema)
        table.merge(batch, number)
        table.merge(batch, number)
        for k, at, v in rows:
            if k is not None:
                best[k] = max(best.get(k, (k, at, v)), (k, at, v))
        assert sorted(map(tuple, table.latest().collect())) == sorted(best.values())
        changed = {b for b, v in table.versions().items() if before.get(b) != v}
        assert len(changed) <= len({k for k, _, _ in rows if k})
    table.merge(spark.createDataFrame([("d", 1, "x")], schema), 3)  # the batch came again with other rows
    assert sorted(r.k for r in table.latest().collect()) == ["a", "b", "c", "d"]
    assert {r.k: r.v for r in table.latest().collect()}["b"] == "x"


def test_feed_has_as_many_files_as_asked_for(spark, tmp_path):
    """Batches are counted in files, so their number must not follow the partitions of the table."""
    rows = spark.range(0, 1000, 1, 16).selectExpr("id", "timestampadd(MINUTE, id * 37 % 1000, timestamp_ntz '2024-01-01') as ts")
    path = jobs.feed(rows, "ts", 4, f"{tmp_path}/feed", 2)
    files = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.min("ts"), F.max("ts"), F.count("*").alias("n")).collect()
    assert len(files) == 8 and sum(r.n for r in files) == 1000 and min(r.n for r in files) > 50


def test_cache_forgets_after_its_time(spark):
    now, built = [0.0], []
    cache = jobs.VersionedCache(most=2, ttl=10.0, clock=lambda: now[0])

    def build():
        built.append(1)
        return spark.range(3)

    for at in (0.0, 9.0, 10.5, 12.0):
        now[0] = at
        cache.get("x", "a", build)
    assert len(built) == 2
    cache.get("y", "a", build)
    cache.get("z", "a", build)
    assert not cache.holds("x", "a") and cache.holds("y", "a") and cache.holds("z", "a")


def test_appended_batches_replace_themselves(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, v string")
    log = AppendLog(spark, f"{tmp_path}/log", rows.schema)
    assert log.rows().count() == 0
    for number, part in ((0, rows), (1, rows.where("k = 1")), (1, rows.where("k = 2")), (2, rows.limit(0))):
        log.append(part, number)
    assert sorted(map(tuple, log.rows().collect())) == [(1, "a"), (2, "b"), (2, "b"), (2, "b"), (2, "b")]
