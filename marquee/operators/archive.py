"""Tables packed as an archive, and taken back only whole.

An archive is a folder of parquet files and a manifest, written last, with the path, size
and SHA-256 of each. Without a manifest there is no archive. An import recomputes every
digest where the files lie and reads nothing before all agree.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "table string, path string, bytes long, sha256 string"


class BrokenArchive(ValueError):
    """An archive that is not what its manifest says."""


def _files(spark: SparkSession, root: str) -> DataFrame:
    """(path below the root, bytes, sha256) of the data files. A digest reads a whole file in one
    task, so tables are written in files of bounded rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(f"{root}/data")
    below = F.regexp_extract("path", r"/(data/[^/]+/[^/]+)$", 1)
    return files.select(below.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def export_tables(tables: dict[str, DataFrame], root: str, rows_per_file: int = 1_000_000) -> None:
    """Write the tables under `root`, then their manifest. An older archive there is replaced:
    its manifest goes first, so that a half-written one is never taken for whole."""
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([], MANIFEST).write.mode("overwrite").json(f"{root}/manifest")
    for name, table in tables.items():
        if not name.replace("_", "").isalnum():
            raise ValueError(f"no name of a table: {name!r}")
        table.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{root}/data/{name}")
    told = _files(spark, root).select(F.split_part("path", F.lit("/"), F.lit(2)).alias("table"), "path", "bytes", "sha256")
    told.coalesce(1).write.mode("overwrite").json(f"{root}/manifest")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{root}/manifest")


def safe(path: str) -> bool:
    """Whether a manifest's path is a data file below the archive, and nothing else."""
    parts = path.split("/")
    return posixpath.normpath(path) == path and ":" not in path and "\\" not in path and len(parts) == 3 and parts[0] == "data" and ".." not in parts


def verify(spark: SparkSession, root: str) -> list[str]:
    """The archive's tables. A missing manifest, a path that leads elsewhere, and a missing,
    added or changed file raise BrokenArchive."""
    told = manifest(spark, root)
    paths = [r["path"] or "" for r in told.select("path").collect()]  # a row a file of many rows
    if not paths:
        raise BrokenArchive("the archive has no manifest, or an empty one")
    if outside := sorted(p for p in paths if not safe(p)):
        raise BrokenArchive(f"paths outside the archive: {outside[:5]}")
    if twice := len(paths) - len(set(paths)):
        raise BrokenArchive(f"{twice} paths are told twice")
    ours = _files(spark, root).select("path", F.struct("bytes", "sha256").alias("ours"))
    both = told.select("path", F.struct("bytes", "sha256").alias("theirs")).join(ours, "path", "full")
    wrong = [r["path"] for r in both.where(~F.col("ours").eqNullSafe(F.col("theirs"))).select("path").orderBy("path").limit(5).collect()]
    if wrong:
        raise BrokenArchive(f"files are missing, added or changed: {wrong}")
    return sorted({p.split("/")[1] for p in paths})


def import_tables(spark: SparkSession, root: str, target: str) -> list[str]:
    """Verify an archive and write its tables as folders of `target`; their names."""
    names = verify(spark, root)
    for name in names:
        spark.read.parquet(f"{root}/data/{name}").write.mode("overwrite").parquet(f"{target}/{name}")
    return names
