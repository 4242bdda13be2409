"""A table of latest rows by key that batches of a stream are merged into.

Rows live in buckets by the hash of their key. A batch rewrites the buckets that it
touches and no other, into a folder of its number; a manifest, written last, tells which
folder each bucket is in. A batch that comes again starts from the manifest before it
and so ends in the same rows, and a reader never sees half a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "bucket int, version long"


class BucketTable:
    """`key` columns and the columns that order a key's rows; of equal rows one stays."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], order: list[str], buckets: int = 16):
        self.spark, self.path, self.schema, self.key, self.order, self.buckets = spark, path, schema, key, order, buckets

    def _manifest(self, before: int | None = None) -> dict[int, int]:
        """Folder of each bucket, of the last batch (before a number); at most `buckets` rows."""
        try:
            all_of = self.spark.read.schema(f"{MANIFEST}, batch long").parquet(f"{self.path}/manifest")
        except Exception as missing:
            if "PATH_NOT_FOUND" in str(missing):
                return {}
            raise
        if before is not None:
            all_of = all_of.where(F.col("batch") < before)
        last = all_of.agg(F.max("batch")).first()[0]
        return {} if last is None else {r["bucket"]: r["version"] for r in all_of.where((F.col("batch") == last) & (F.col("bucket") >= 0)).collect()}

    def _rows(self, manifest: dict[int, int], only: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/rows/version={v}/bucket={b}" for b, v in manifest.items() if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)  # folders of buckets, so no partition column

    def latest(self) -> DataFrame:
        return self._rows(self._manifest())

    def versions(self) -> dict[int, int]:
        """The batch that last wrote each bucket."""
        return self._manifest()

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, touched: list[int], before: dict[int, int], number: int) -> None:
        """Rows of the touched buckets, then the manifest."""
        if touched:
            parted = rows.withColumn("bucket", self._bucket()).repartition(len(touched), "bucket")
            parted.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/version={number}")
            kept = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.path}/rows/version={number}")
            held = [r[0] for r in kept.select("bucket").distinct().collect()]  # a bucket may have lost all its rows
            before = {b: v for b, v in before.items() if b not in touched} | dict.fromkeys(held, number)
        told = self.spark.createDataFrame(list(before.items()) or [(-1, -1)], MANIFEST).coalesce(1)
        told.write.mode("overwrite").parquet(f"{self.path}/manifest/batch={number}")

    def merge(self, batch: DataFrame, number: int) -> None:
        """Upsert a batch, for `foreachBatch`. Rows without a key are left out."""
        columns = self.latest().columns
        keyed = batch.select(columns).dropna(subset=self.key)
        touched = [r[0] for r in keyed.select(self._bucket()).distinct().collect()]  # at most `buckets`
        before = self._manifest(number)
        window = Window.partitionBy(*self.key).orderBy(*[F.desc_nulls_last(c) for c in self.order], *[F.desc_nulls_last(c) for c in columns])
        both = keyed.unionByName(self._rows(before, touched))
        newest = both.withColumn("_place", F.row_number().over(window)).where("_place = 1").drop("_place")
        self._write(newest, touched, before, number)

    def _change(self, only: Column, number: int, change: dict[str, Column] | None) -> int:
        before = self._manifest(number)
        rows = self._rows(before)
        met = rows.where(only).groupBy(self._bucket().alias("b")).agg(F.count("*").alias("n")).collect()  # at most `buckets`
        touched = [r["b"] for r in met]
        held = self._rows(before, touched)
        hit = F.coalesce(only, F.lit(False))
        kept = held.where(~hit) if change is None else held.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in change.items()})
        self._write(kept, touched, before, number)
        return sum(r["n"] for r in met)

    def delete(self, only: Column, number: int) -> int:
        """Delete the rows that meet a condition, as batch `number`; how many they were. Buckets
        without such a row are not rewritten."""
        return self._change(only, number, None)

    def update(self, only: Column, change: dict[str, Column], number: int) -> int:
        """Set columns of the rows that meet a condition; keys are not to change."""
        if set(change) & set(self.key):
            raise ValueError("keys do not change in place")
        return self._change(only, number, change)


class AppendLog:
    """Rows that are only added, a folder for each batch: one that comes again replaces itself."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def append(self, batch: DataFrame, number: int) -> None:
        """For `foreachBatch`."""
        batch.select(self.schema.names).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path).select(self.schema.names)
        except Exception as missing:
            if "PATH_NOT_FOUND" in str(missing):
                return self.spark.createDataFrame([], self.schema)
            raise
