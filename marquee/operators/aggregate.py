"""Aggregations of corpora, ratings, graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.operators.tables import written


def facets(rows: DataFrame, columns: dict[str, Column], most: dict[str, int]) -> DataFrame:
    """(facet, value, n): counts of all facets in one pass over the rows.

    `columns` gives each facet a column; arrays count for each element. `most` keeps
    a facet's commonest values (ties by value), by a top-k of its own: no task sorts
    the values of a facet.
    """
    parts = []
    for name, column in columns.items():
        kind = rows.select(column.alias("c")).schema["c"].dataType.typeName()
        values = F.transform(column, lambda x: x.cast("string")) if kind == "array" else F.array(column.cast("string"))
        named = F.lit(name).alias("facet")
        parts.append(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(named, v.alias("value"))))  # noqa: B023
    counted = (
        rows.select(F.explode(F.concat(*parts)).alias("f"))
        .where("f.value is not null")
        .groupBy("f.facet", "f.value")
        .agg(F.count("*").alias("n"))
    )
    if not most:
        return counted
    counted = written(counted, "facets")
    whole = counted.where(~F.col("facet").isin(list(most)))
    tops = [counted.where(F.col("facet") == name).orderBy(F.desc("n"), "value").limit(k) for name, k in most.items()]
    return reduce(DataFrame.unionByName, tops, whole)


def rating_summary(ratings: DataFrame, kind: str, rating: str) -> DataFrame:
    """Totals, positives and negatives by kind, with a row 'ALL' for the whole."""
    return ratings.rollup(kind).agg(
        F.count("*").alias("total"),
        F.sum(F.when(F.col(rating) > 0, 1).otherwise(0)).alias("positive"),
        F.sum(F.when(F.col(rating) < 0, 1).otherwise(0)).alias("negative"),
    ).withColumn(kind, F.coalesce(kind, F.lit("ALL")))


def negative_keys(ratings: DataFrame, key: list[str], rating: str, prefix: str = "") -> DataFrame:
    """Keys whose ratings add up to less than zero; the last key may need a prefix."""
    kept = ratings.where(F.col(key[-1]).cast("string").startswith(prefix)) if prefix else ratings
    return kept.groupBy(*key).agg(F.sum(rating).alias("score")).where("score < 0")


def status_counts(rows: DataFrame, status: str, values: list[str]) -> DataFrame:
    """One row: the count of each given status (0 where absent) and of all rows."""
    return rows.agg(
        *[F.count(F.when(F.col(status) == v, 1)).alias(v.lower()) for v in values], F.count("*").alias("total")
    )


def weighted_confidence(rows: DataFrame, key: list[str], score: str, weight: str) -> DataFrame:
    """Weighted mean of scores by key, between 0 and 1; 0 where the weights add up to 0."""
    total = F.sum(weight)
    mean = F.when(total == 0, F.lit(0.0)).otherwise(F.try_divide(F.sum(F.col(score) * F.col(weight)), total))
    return rows.groupBy(*key).agg(F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0)).alias("confidence"))


def majority(rows: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """The commonest value by key where at least `share` of the non-null ones have it
    (the least of equally common ones)."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    window = Window.partitionBy(key)
    ranked = counts.withColumn("total", F.sum("n").over(window)).withColumn(
        "r", F.row_number().over(window.orderBy(F.desc("n"), value))
    )
    return ranked.where((F.col("r") == 1) & (F.col("n") >= share * F.col("total"))).select(key, value, "n", "total")


def top_values(rows: DataFrame, key: list[str], value: str, most: int, name: str) -> DataFrame:
    """The `most` commonest values by key as one comma-joined string, ties by value."""
    counts = rows.groupBy(*key, value).agg(F.count("*").alias("n"))
    window = Window.partitionBy(*key).orderBy(F.desc("n"), value)
    return (
        counts.withColumn("r", F.row_number().over(window))
        .where(F.col("r") <= most)
        .groupBy(*key)
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", value))), lambda x: x[value]), ",").alias(name))
    )


def graph_edges(edges: DataFrame) -> DataFrame:
    """Edges of many analyses as one: mean confidence, occurrences, sessions, the
    longest details (the least of equally long ones). Dismissed edges are left out
    of all analyses by their keys."""
    keys = ["source", "target", "kind"]
    gone = edges.where("dismissed").select(*keys).distinct()
    return (
        edges.join(gone, keys, "left_anti")
        .groupBy(*keys)
        .agg(
            F.bround(F.avg("confidence"), 3).alias("avg_confidence"),
            F.count("*").alias("occurrences"),
            F.count_distinct("session").alias("sessions"),
            F.min(F.struct((-F.length("details")).alias("l"), F.col("details").alias("d")))["d"].alias("details"),
        )
    )


def graph_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes of many analyses by lower-case name and type: appearances, first name."""
    return nodes.groupBy(F.lower(F.trim("name")).alias("node"), "kind").agg(
        F.count_distinct("session").alias("appearances"), F.min("name").alias("name")
    )
