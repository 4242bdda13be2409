"""Names as written postings, so that a suggestion reads a few keys instead of all names.

Every name is posted under the beginnings of its lower-case form (up to three letters,
marked by `^`) and under all one-, two- and three-letter pieces of it. Postings lie in
folders by the hash of their key; a call reads the folders of two keys, with the keys
pushed to the scan, and checks the names there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Postings:
    """Postings under `path`, in `buckets` folders."""

    path: str
    buckets: int

    @staticmethod
    def build(names: DataFrame, name: str, path: str, buckets: int = 64) -> Postings:
        """Post every distinct non-null name. A piece that many names share is dealt to several tasks."""
        low = F.lower("name")
        pieces = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(n)))
        heads = F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.concat(F.lit("^"), F.substring(low, F.lit(1), n)))
        grams = F.array_distinct(F.concat(heads, *[pieces(n) for n in range(1, GRAM + 1)], F.array(F.lit("^"))))
        rows = names.select(F.col(name).alias("name")).where("name is not null").distinct().select("name", F.explode(grams).alias("gram"))
        dealt = rows.withColumn("bucket", _bucket(F.col("gram"), buckets)).repartition("bucket", F.pmod(F.xxhash64("name"), F.lit(4)))
        dealt.sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(path)
        return Postings(path, buckets)

    def _posted(self, spark: SparkSession, gram: str) -> DataFrame:
        bucket = spark.range(1).select(_bucket(F.lit(gram), self.buckets)).first()[0]
        rows = spark.read.schema("name string, gram string, bucket int").parquet(self.path)
        return rows.where((F.col("bucket") == bucket) & (F.col("gram") == gram)).select("name")

    def suggest(self, spark: SparkSession, typed: str, most: int) -> DataFrame:
        """(name, rank): names that begin with what was typed (0), then those that contain it (1),
        each by name; case does not count. Nothing typed begins every name."""
        low = typed.lower()
        name = F.lower("name")
        begin = self._posted(spark, "^" + low[:GRAM]).where(F.startswith(name, F.lit(low)))
        found = begin.select("name", F.lit(0).alias("rank"))
        if low:
            inside = self._posted(spark, low[:GRAM]).where(F.contains(name, F.lit(low)) & ~F.startswith(name, F.lit(low)))
            found = found.unionByName(inside.select("name", F.lit(1).alias("rank")))
        return found.orderBy("rank", "name").limit(most)
