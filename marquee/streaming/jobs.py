"""Streaming forms of incremental ingestion, progress and sessions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of event files as a stream; `ts` is the event time."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def incremental_days(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events once by id, though pulls overlap, counted by day and type; state older
    than the watermark goes."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", "1 day").alias("day"), "event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    )


def latest_status(events: DataFrame) -> DataFrame:
    """The last event of each user, for update mode."""
    last = F.max(F.struct("ts", "event_id", "event_type"))
    return events.groupBy("user_id").agg(last.alias("l")).select("user_id", "l.ts", "l.event_id", "l.event_type")


def feed(rows: DataFrame, ts: str, slices: int, path: str, files: int = 1) -> str:
    """Write `rows` as a folder of files that arrive in the order of `ts`, to be streamed; a slice
    is `files` files, however many tasks read the rows."""
    first, last = rows.agg(F.min(ts), F.max(ts)).first()
    if first is None:
        rows.limit(0).write.parquet(path)
        return path
    step = (last - first) / slices
    for i in range(slices):
        later = F.col(ts) >= F.lit(first + step * i) if i else F.lit(True)
        before = F.col(ts) < F.lit(first + step * (i + 1)) if i < slices - 1 else F.lit(True)
        rows.where(later & before).repartition(files).write.mode("append").parquet(path)
    return path


def numbered_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Each batch in a folder of its number, so that one that comes again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


@contextmanager
def state_settings(spark: SparkSession, partitions: int) -> Iterator[None]:
    """State in RocksDB, dealt to `partitions`; a stream keeps what it was started with."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.shuffle.partitions": str(partitions)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_available(rows: DataFrame, mode: str, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process what is there and stop; `write` gets each batch with its number and, as
    batches can come again after a failure, must be idempotent by that number."""
    query = (
        rows.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    return query


class VersionedCache:
    """Results by the version of their input, for `ttl` seconds: kept while both hold, dropped
    after. At most `most` are held; the oldest goes first."""

    def __init__(self, most: int = 16, ttl: float = 3600.0, clock: Callable[[], float] = time.monotonic):
        self.most, self.ttl, self._clock = most, ttl, clock
        self._kept: dict[str, tuple[str, float, DataFrame]] = {}

    def drop(self, name: str) -> None:
        if known := self._kept.pop(name, None):
            known[2].unpersist()

    def holds(self, name: str, version: str) -> bool:
        known = self._kept.get(name)
        return known is not None and known[0] == version and self._clock() - known[1] < self.ttl

    def get(self, name: str, version: str, build: Callable[[], DataFrame]) -> DataFrame:
        if not self.holds(name, version):
            self.drop(name)
            for old in [n for n, (v, _, _) in self._kept.items() if not self.holds(n, v)]:
                self.drop(old)
            while len(self._kept) >= self.most:
                self.drop(next(iter(self._kept)))
            self._kept[name] = (version, self._clock(), build().persist())
        return self._kept[name][2]
