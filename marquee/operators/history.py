"""Flier history: lineups, snapshots, ratings, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of line-ups for each task that reduces their pairs.
ROWS_A_TASK = 500_000


def name_key(name: str | Column) -> Column:
    """A name as it is compared: trimmed, lower case."""
    return F.lower(F.trim(F.col(name) if isinstance(name, str) else name))


def co_appearances(lineup: DataFrame, fliers: DataFrame, seeds: list) -> DataFrame:
    """Artists that share a flier with a seed artist, seeds excluded.

    lineup: flier_id, artist; fliers: flier_id, event, venue. One row per artist
    (times_seen, seeds, events, venues), most seen first. The lineup is filtered to
    the seeds' fliers by a semi-join before it is joined with itself; flier ids
    appear once a seed, so the join does not grow with the square of a lineup.
    """
    seeded = lineup.where(F.col("artist").isin(seeds)).select("flier_id", F.col("artist").alias("seed")).distinct()
    others = lineup.where(~F.col("artist").isin(seeds)).select("flier_id", "artist").distinct()
    joined = others.join(seeded, "flier_id").join(fliers, "flier_id")
    text = lambda c: F.array_join(F.sort_array(F.collect_set(F.col(c).cast("string"))), ",")
    return joined.groupBy("artist").agg(
        F.count_distinct("flier_id").alias("times_seen"),
        text("seed").alias("seeds"),
        text("event").alias("events"),
        text("venue").alias("venues"),
    ).orderBy(F.desc("times_seen"), "artist")


def shared_event_pairs(lineup: DataFrame, event: list[str], artist: str, rank: list[str], most: int | None = None) -> DataFrame:
    """Unordered pairs of artists with a common event, and the first such event.

    A lineup is a bounded list by nature, so pairs are formed within one event only;
    they are reduced to one row a pair by the least `rank`. `most` keeps the first
    pairs by rank, as the feature asks.
    """
    extra = [c for c in rank if c not in (*event, artist)]
    rows = lineup.select(*event, artist, *extra)
    rows = rows.groupBy(*event, artist).agg(F.min(F.struct(*extra)).alias("extra")) if extra else rows.distinct()
    first = [F.col(f"extra.{c}") if c in extra else F.col(c) for c in rank]
    a = rows.select(*event, F.col(artist).alias("artist_a"), *[c.alias(f"first{i}") for i, c in enumerate(first)])
    b = rows.select(*event, F.col(artist).alias("artist_b"))
    firsts = [f"first{i}" for i in range(len(rank))]
    pairs = a.join(b, event).where("artist_a < artist_b").select("artist_a", "artist_b", *firsts)
    # a plain column is aggregated without sorting; those of the event are never null here
    least = F.min("first0") if len(rank) == 1 and not extra else F.min(F.struct(*firsts))
    # an artist is in an event once, so a pair's rows are its events; a task gets a bounded share of them
    tasks = max(int(lineup.sparkSession.conf.get("spark.sql.shuffle.partitions")), lineup.count() // ROWS_A_TASK + 1)
    found = pairs.repartition(tasks, "artist_a", "artist_b").groupBy("artist_a", "artist_b").agg(F.count("*").alias("shared"), least.alias("first"))
    told = [(F.col("first") if not extra and len(rank) == 1 else F.col(f"first.first{i}")).alias(c) for i, c in enumerate(rank)]
    out = found.select("artist_a", "artist_b", "shared", *told)
    return out.orderBy(*rank, "artist_a", "artist_b").limit(most) if most else out


def snapshots(versions: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """All versions with their revision (1 is the oldest) and is_active for the last."""
    window = Window.partitionBy(*key).orderBy(*order)
    return versions.withColumn("revision", F.row_number().over(window)).withColumn(
        "is_active", F.lead(F.lit(1)).over(window).isNull()
    )


def latest(versions: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last version by key: an upsert applied."""
    window = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return versions.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")


def first_kept(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row by key: later ones are ignored."""
    window = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")


def latest_value(rows: DataFrame, key: list[str], value: str, order: Column) -> DataFrame:
    """An upsert of one value as an aggregation: partial on the map side, no sort."""
    return rows.groupBy(*key).agg(F.max_by(value, order).alias(value), F.max(order).alias("updated_at"))


def page(rows: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    """One page of rows; `order` must be total for pages to be disjoint."""
    return rows.orderBy(*order).offset(offset).limit(size)


def nested(parents: DataFrame, children: DataFrame, key: str, name: str, fields: list[str]) -> DataFrame:
    """Parents with their children as a sorted array, empty where there are none."""
    lists = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, F.filter(F.array(F.struct(*[F.lit(None).cast(children.schema[f].dataType).alias(f) for f in fields])), lambda x: F.lit(False))))


def update_status(rows: DataFrame, ids: Column, status: str, to: str, only: str) -> DataFrame:
    """Rows with `status` set to `to` where the id is meant and the status is `only`."""
    return rows.withColumn(status, F.when(ids & (F.col(status) == only), F.lit(to)).otherwise(F.col(status)))


def dismiss(edges: DataFrame, source: str, target: str, kind: str) -> DataFrame:
    """Edges with dismissed set where all three keys agree whatever their case."""
    same = (name_key("source") == source.lower()) & (name_key("target") == target.lower()) & (name_key("kind") == kind.lower())
    return edges.withColumn("dismissed", F.coalesce("dismissed", F.lit(False)) | same)
