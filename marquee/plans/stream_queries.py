"""Streams over the event table, run to their end.

The table is written out as files that arrive in time order, in `SLICES` parts; a stream
reads them file by file, and the query returns what its sink holds after the last one.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators.tables import new_path
from marquee.plans.registry import Tables, query
from marquee.streaming import jobs
from marquee.streaming.batches import BatchJobs
from marquee.streaming.sessions import EXPIRED, expired_sessions, from_micros, micros
from marquee.streaming.upserts import BucketTable

SLICES, STATE_PARTITIONS = 4, 8
#: Events of a file of a slice, about.
EVENTS_A_FILE = 500_000
#: Within a slice files come in any order, so an event may be late by a slice of the month.
LATE = "8 days"


def _fed(t: Tables, *again: str) -> tuple[str, int]:
    """The events as a folder to be streamed, and once more those of each condition; and the files
    of a slice, which follow the number of events, so that the number of batches does not. State is
    dealt to more partitions likewise."""
    events = t.events
    path = new_path(events.sparkSession, "feed")
    files = events.count() // (SLICES * EVENTS_A_FILE) + 1
    jobs.feed(events, "ts", SLICES, path, files)
    for condition in again:
        events.where(condition).repartition(files).write.mode("append").parquet(path)
    return path, files


@query("st_incremental_months", "select strftime(ts, '%Y-%m') as month, event_type, count(distinct event_id) as n, round(sum(value), 2) as total from events group by 1, 2")
def st_incremental_months(t: Tables) -> DataFrame:
    """Overlapping pulls (every fifth event comes twice) count once; days are kept by the sink and added to months."""
    path, files = _fed(t, "event_id % 5 = 0")
    spark = t.events.sparkSession
    days = BucketTable(spark, new_path(spark, "days"), "day long, event_type string, n long, total double", ["day", "event_type"], ["n"])
    with jobs.state_settings(spark, STATE_PARTITIONS * files):
        rows = spark.readStream.schema(jobs.EVENTS).option("maxFilesPerTrigger", 2 * files).parquet(path)
        timed = rows.withColumn("ts", F.timestamp_micros(micros("ts")))
        counted = jobs.incremental_days(timed, "40 days").select(F.unix_micros("day.start").alias("day"), "event_type", "n", "total")
        jobs.run_available(counted, "update", new_path(spark, "progress"), days.merge)
    month = F.date_format(from_micros("day"), "yyyy-MM").alias("month")
    return days.latest().groupBy(month, "event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


@query("st_progress_push", "select user_id, arg_max(event_type, (ts, event_id)) as status, max(ts) as ts from events group by 1")
def st_progress_push(t: Tables) -> DataFrame:
    """Each batch pushes the users whose last event changed to a table of latest rows."""
    path, files = _fed(t)
    spark = t.events.sparkSession
    told = BucketTable(spark, new_path(spark, "status"), "user_id long, status string, ts timestamp_ntz, event_id long", ["user_id"], ["ts", "event_id"])
    with jobs.state_settings(spark, STATE_PARTITIONS * files):
        rows = spark.readStream.schema(jobs.EVENTS).option("maxFilesPerTrigger", 2 * files).parquet(path)
        latest = jobs.latest_status(rows).withColumnRenamed("event_type", "status")
        jobs.run_available(latest, "update", new_path(spark, "progress"), told.merge)
    return told.latest().select("user_id", "status", "ts")


@query(
    "st_session_ttl",
    """with stamped as (select user_id, epoch_us(ts) as us, lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as before from events),
    numbered as (select *, sum((before is null or us - before > 259200000000)::int) over (partition by user_id order by us rows unbounded preceding) as session from stamped),
    sessions as (select user_id, min(us) as a, max(us) as b, count(*) as n from numbered group by user_id, session)
    select user_id::varchar as session_key, make_timestamp(a) as started, make_timestamp(b) as ended, n from sessions
    where b // 1000 + 259200000 < (select max(epoch_us(ts)) // 1000 from events) - 691200000""",
)
def st_session_ttl(t: Tables) -> DataFrame:
    """Sessions that the clock of the stream has ended: 72 hours without an event."""
    path, files = _fed(t)
    spark = t.events.sparkSession
    out = new_path(spark, "expired")
    with jobs.state_settings(spark, STATE_PARTITIONS * files):
        rows = spark.readStream.schema(jobs.EVENTS).option("maxFilesPerTrigger", files).parquet(path)
        over = expired_sessions(rows, "user_id", "ts", "72 hours", LATE)
        jobs.run_available(over, "append", new_path(spark, "progress"), jobs.numbered_sink(out))
    told = spark.read.schema(EXPIRED).parquet(out)
    return told.select("session_key", from_micros("started").alias("started"), from_micros("ended").alias("ended"), "n")


@query("st_feedback_loop", "select user_id, arg_max(event_type, (ts, event_id)) as event_type, arg_max(value, (ts, event_id)) as value, max(ts) as ts from events where user_id is not null group by 1")
def st_feedback_loop(t: Tables) -> DataFrame:
    """Results re-enter a table as upserts by user; pulls overlap, and the last batch comes twice."""
    path, files = _fed(t, "event_id % 7 = 0")
    spark = t.events.sparkSession
    table = BucketTable(spark, new_path(spark, "corpus"), jobs.EVENTS, ["user_id"], ["ts", "event_id"])
    numbers: list[int] = []

    def twice(batch: DataFrame, number: int) -> None:
        table.merge(batch, number)
        table.merge(batch, number)
        numbers.append(number)

    rows = spark.readStream.schema(jobs.EVENTS).option("maxFilesPerTrigger", files).parquet(path)
    jobs.run_available(rows, "append", new_path(spark, "progress"), twice)
    return table.latest().select("user_id", "event_type", "value", "ts")


@query(
    "st_batch_job",
    """select doc_id, case when n > 0 then n end as n_words, case when n > 0 then null else 'no words' end as error from
    (select doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda w: w <> '')) as n from documents)""",
)
def st_batch_job(t: Tables) -> DataFrame:
    """Words of every document by a job that is paused after its first slice and resumed."""
    docs = t.documents
    spark = docs.sparkSession
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t\\n\\r]+"), lambda w: w != "")).cast("long")

    def count(batch: DataFrame) -> DataFrame:
        counted = batch.select("doc_id", words.alias("n"))
        return counted.select("doc_id", F.when(F.col("n") > 0, F.col("n")).alias("n_words"), F.when(F.col("n") == 0, "no words").alias("error"))

    batch_jobs = BatchJobs(spark, new_path(spark, "jobs"))
    job = batch_jobs.create(docs.select("doc_id", "text"), "doc_id", SLICES)
    first = threading.Event()
    query_ = batch_jobs.start(job, count, lambda number: first.set())
    while query_.isActive and not first.wait(0.2):
        pass
    batch_jobs.pause(job)
    batch_jobs.start(job, count)
    batch_jobs.wait(job)
    return batch_jobs.results(job, "doc_id long, n_words long, error string")


CACHE = jobs.VersionedCache(most=4, ttl=30.0)


@query("st_ttl_cache", "select event_type, count(*) as n, count(distinct user_id) as users from events group by 1")
def st_ttl_cache(t: Tables) -> DataFrame:
    """Statistics kept for half a minute, as long as the table is the same files."""
    events = t.events
    version = "|".join([events.sparkSession.sparkContext.applicationId, *sorted(events.inputFiles())])
    return CACHE.get("stats", version, lambda: events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users")))
