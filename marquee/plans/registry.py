"""Named queries: each binds an operator to the driver's tables.

In the driver's tables an order plays a flier (or story, submission), its line items
the lineup, a part an artist or release, a supplier a label, a customer a promoter, a
nation a city; documents are corpus chunks with source as source_id and lang as
source_type; events are ratings, snapshots or sessions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def query(name: str, oracle: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable]:
    """Register a function of the tables under a name, with its SQL."""

    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if oracle:
            ORACLES[name] = oracle
        return build

    return add
