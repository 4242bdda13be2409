"""What several corpus operators need: tables in the shared folder, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where no folder is set and all runs on one machine (tests) one is made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='marquee-')}"
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_root(spark)}/marquee-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(conf).deleteOnExit(hadoop_path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there, so a
    lost executor costs a reread, and both joins and planning see true sizes."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rest): all columns but text in one struct, under names of no meaning, so
    that no column of `docs` can clash with one that an operator adds."""
    rest = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"])
    return docs.select("doc_id", "text", rest.alias("rest"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows (text, rest) of a packed table with the columns of `docs`."""
    return rows.select(*[F.col("text" if c == "text" else f"rest.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def merged(df: DataFrame) -> DataFrame:
    """`df` for a join that stays a sort-merge join. A broadcast takes some MB of the driver's
    heap however few its rows are, until the driver collects its garbage; steps that join again
    and again fill it on small tables, where every join would be a broadcast."""
    return df.hint("merge")


def rows_in(df: DataFrame) -> int:
    """Row count of a written table (answered from the file footers)."""
    return df.count()


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the graph with edges (u long, v long): rows (u, component).

    `component` is the same for two vertices exactly if they are connected; it has
    no other meaning. Vertices without an edge do not appear.

    Randomised contraction. In each round every vertex is renamed by a fresh
    64-bit bijection (XXH64 of one long is one) and picks the least new name in its
    closed neighbourhood; edges are contracted to the picked names. A constant
    fraction of the vertices goes in each round, whatever the graph looks like, so
    long chains do not need as many rounds as links. All state is in written
    tables; nothing is collected.
    """
    current = materialize(
        edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges"
    )
    picks: list[DataFrame] = []
    while rows_in(current):
        # a constant beside the long makes the next bijection of the family
        renamed = lambda c, n=len(picks): F.xxhash64(F.col(c).bitwiseXOR(F.lit(n * 0x9E3779B97F4A7C1 & 0x7FFFFFFFFFFFFFFF)))
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        pick = materialize(
            both.groupBy("u").agg(F.min(renamed("v")).alias("least")).select("u", F.least("least", renamed("u")).alias("r")),
            "pick",
        )
        picks.append(pick)
        of_u, of_v = pick.select("u", F.col("r").alias("ru")), pick.select(F.col("u").alias("v"), F.col("r").alias("rv"))
        contracted = (
            current.join(merged(of_u), "u")
            .join(merged(of_v), "v")
            .where("ru <> rv")
            .select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
            .distinct()
        )
        current = materialize(contracted, "edges")
    if not picks:
        return current.select("u", F.col("v").alias("component"))
    labels = picks.pop().withColumnRenamed("r", "component")
    while picks:
        later = labels.withColumnRenamed("u", "r")
        labels = materialize(
            picks.pop().join(merged(later), "r", "left").select("u", F.coalesce("component", "r").alias("component")), "labels"
        )
    return labels


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows, so that a worker never holds many texts as Python objects."""
    for batch in batches:
        if not batch.num_rows:
            yield batch
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8(texts: Iterable[str | None]) -> list[bytes]:
    """Whole texts as UTF-8; null is empty."""
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
