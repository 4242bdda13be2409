"""Long jobs over many items that can be paused, resumed and cancelled.

A job's items are written once in numbered slices; a stream reads them, a slice a batch.
Its checkpoint tells which slices are done, so a job goes on after a pause, a lost driver
or a new session where it stopped. A slice's results go to a folder of its number, which a
repeated batch overwrites: every item is done once. All Spark work of a job has its tag.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Process = Callable[[DataFrame], DataFrame]
QUEUED, RUNNING, PAUSED, CANCELLED, COMPLETED, FAILED = "queued", "running", "paused", "cancelled", "completed", "failed"

#: Items of a file, about.
ITEMS_A_FILE = 10_000


@dataclass(frozen=True)
class Status:
    job_id: str
    state: str
    total: int
    done: int
    failed: int


class BatchJobs:
    """The table of jobs under a shared folder.

    `process` gets a slice of the items and returns rows with a column `error`, null for
    an item that went well. An item with an error counts as failed and the job goes on; a
    job all of whose items failed has failed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._queries: dict[str, StreamingQuery] = {}
        self._stopping: dict[str, threading.Event] = {}

    # -- what is kept of a job ------------------------------------------------
    def _path(self, job_id: str, part: str) -> str:
        return f"{self.root}/job={job_id}/{part}"

    def _put(self, job_id: str, state: str, **more: object) -> None:
        row = json.dumps(more | {"job_id": job_id, "state": state})
        self.spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(self._path(job_id, "state"))

    def _get(self, job_id: str) -> dict:
        return json.loads(self.spark.read.text(self._path(job_id, "state")).first()[0])

    # -- life of a job -------------------------------------------------------
    def create(self, items: DataFrame, key: str, slices: int) -> str:
        """Queue a job over `items`, dealt to `slices` by key. A slice is one file or more, each of
        some `ITEMS_A_FILE` items, so that no task takes a whole slice of many."""
        job_id = uuid.uuid4().hex
        files = items.count() // (slices * ITEMS_A_FILE) + 1
        items.repartition(slices * files, key).write.option("maxRecordsPerFile", 0).parquet(self._path(job_id, "items"))
        total = self.spark.read.parquet(self._path(job_id, "items")).count()
        self._put(job_id, QUEUED, total=total, schema=items.schema.json(), files=files)
        return job_id

    def start(self, job_id: str, process: Process, after_slice: Callable[[int], None] | None = None) -> StreamingQuery:
        """Run a queued or paused job in the background; `after_slice` hears each finished slice."""
        from pyspark.sql.types import StructType

        known = self._get(job_id)
        if known["state"] not in (QUEUED, PAUSED):
            raise ValueError(f"job {job_id} is {known['state']}")
        stop = self._stopping[job_id] = threading.Event()
        rows = (
            self.spark.readStream.schema(StructType.fromJson(json.loads(known["schema"])))
            .option("maxFilesPerTrigger", known.get("files", 1))
            .parquet(self._path(job_id, "items"))
        )

        def run(batch: DataFrame, number: int) -> None:
            if stop.is_set():
                raise InterruptedError(f"job {job_id} was stopped before slice {number}")
            batch.sparkSession.sparkContext.addJobTag(job_id)
            process(batch).write.mode("overwrite").parquet(self._path(job_id, f"out/slice={number}"))
            if after_slice:
                after_slice(number)

        self._put(job_id, RUNNING, total=known["total"], schema=known["schema"], files=known.get("files", 1))
        query = (
            rows.writeStream.foreachBatch(run)
            .option("checkpointLocation", self._path(job_id, "checkpoint"))
            .trigger(availableNow=True)
            .queryName(f"job-{job_id}")
            .start()
        )
        self._queries[job_id] = query
        return query

    def wait(self, job_id: str) -> Status:
        """Until the job ends or is stopped."""
        query = self._queries[job_id]
        try:
            query.awaitTermination()
        except Exception:
            if not self._stopping[job_id].is_set():
                self._settle(job_id, FAILED)
                raise
        if not self._stopping[job_id].is_set():
            status = self.status(job_id)
            self._settle(job_id, FAILED if status.total and status.failed == status.total else COMPLETED)
        return self.status(job_id)

    def _settle(self, job_id: str, state: str) -> None:
        known = self._get(job_id)
        self._put(job_id, state, total=known["total"], schema=known["schema"], files=known.get("files", 1))

    def _halt(self, job_id: str) -> None:
        self._stopping.setdefault(job_id, threading.Event()).set()
        self.spark.sparkContext.cancelJobsWithTag(job_id)
        if query := self._queries.get(job_id):
            query.stop()

    def pause(self, job_id: str) -> None:
        """Stop now; the slice at work is done again after `start`. A job that is over stays so."""
        if self._get(job_id)["state"] in (QUEUED, RUNNING):
            self._halt(job_id)
            self._settle(job_id, PAUSED)

    def cancel(self, job_id: str) -> None:
        """Stop for good; nothing of the job's results stays visible. A job that is over stays so."""
        if self._get(job_id)["state"] in (QUEUED, RUNNING, PAUSED):
            self._halt(job_id)
            self._settle(job_id, CANCELLED)

    # -- what is told of a job -----------------------------------------------
    def results(self, job_id: str, schema: str) -> DataFrame:
        """Rows of all finished slices; none of a cancelled job."""
        empty = self.spark.createDataFrame([], schema)
        known = self._get(job_id)
        if known["state"] == CANCELLED:
            return empty
        try:
            return self.spark.read.schema(schema).parquet(self._path(job_id, "out")).select(empty.columns)
        except Exception as missing:
            if "PATH_NOT_FOUND" in str(missing):
                return empty
            raise

    def status(self, job_id: str) -> Status:
        known = self._get(job_id)
        counts = self.results(job_id, "error string").agg(F.count("*").alias("n"), F.count("error").alias("e")).first()
        return Status(job_id, known["state"], known["total"], counts["n"] - counts["e"], counts["e"])
