"""Ranking: top-k, caps, budgets, sections, suggestions, boosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.operators.tables import written


def top_per_key(rows: DataFrame, key: list[str], order: list, most: int) -> DataFrame:
    """The first `most` rows by key; the plan limits each group before the sort's exchange."""
    window = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(window)).where(F.col("__r") <= most).drop("__r")


def running_sum(rows: DataFrame, key: list[str], order: list[str], value: Column) -> DataFrame:
    """`rows` with `total`, the running sum of `value` by key in ascending order (to be unique), for
    keys of many rows: ranges of rows are summed on their own, and each starts from the
    sums of the ranges before it, which are one row a range and key."""
    ranged = rows.repartitionByRange(*key, *order).withColumn("__value", value)
    placed = written(ranged.withColumn("__range", F.spark_partition_id()), "ranges")
    same = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"__{k}") for k in key]
    sums = placed.groupBy("__range", *key).agg(F.sum("__value").alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(*key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("__range", *same, F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.sum("__value").over(Window.partitionBy("__range", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = placed.select("*", own.alias("__own"), *same).join(starts, ["__range", *[f"__{k}" for k in key]])
    return joined.withColumn("total", F.col("__own") + F.col("__before")).select(*rows.columns, "total")


def numbered(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """`rows` with `number`, from 1 by key in ascending order; see running_sum."""
    return running_sum(rows, key, order, F.lit(1).cast("long")).withColumnRenamed("total", "number")


def sections(rows: DataFrame, key: list[str], order: str, starts: Column) -> DataFrame:
    """Rows with the number of section starts up to and with them, by key."""
    window = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.sum(starts.cast("int")).over(window))


def within_budget(rows: DataFrame, key: list[str], order: list, size: str, budget: int) -> DataFrame:
    """By key the rows in order until their sizes would exceed the budget. Sizes are not
    negative, so each key's sum is cut by ranges of rows."""
    return running_sum(rows, key, order, F.col(size)).where(F.col("total") <= budget).withColumnRenamed("total", "used")


def any_contains(tags: Column, part: str) -> Column:
    return F.exists(tags, lambda t: F.contains(F.lower(t), F.lit(part.lower())))


def genre_filter(tags: Column, genres: list[str]) -> Column:
    """Several genres: one of the tags is one of them. One: a tag contains it or is
    contained in it. Case does not count."""
    lowered = F.transform(tags, F.lower)
    if len(genres) > 1:
        return F.arrays_overlap(lowered, F.array(*[F.lit(g.lower()) for g in genres]))
    one = F.lit(genres[0].lower())
    return F.exists(lowered, lambda t: F.contains(t, one) | F.contains(one, t))


def suggest(names: DataFrame, name: str, typed: str, most: int) -> DataFrame:
    """(name, rank): names that begin with what was typed, then those that contain it."""
    typed = typed.lower()
    rows = names.where(F.contains(F.lower(name), F.lit(typed)))
    rank = F.when(F.startswith(F.lower(name), F.lit(typed)), 0).otherwise(1)
    return rows.select(name, rank.alias("rank")).orderBy("rank", name).limit(most)


def boosted(similarity: Column, tier: Column, in_text: Column, label: Column, genre: Column, overlap: Column, geo: Column) -> Column:
    """The reranked score: similarity plus boosts, 1 at most. `genre` is the sum of the
    genre boosts; the other arguments are conditions (tier and label: values)."""
    flag = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0.0))
    score = (
        similarity + F.greatest(F.lit(0.0), (6 - tier) * 0.024) + flag(in_text, 0.03)
        + F.when(label == "exchange", 0.06).when(label == "book", 0.04).otherwise(0.0)
        + genre + flag(overlap, 0.04) + flag(geo, 0.03)
    )
    return F.least(F.lit(1.0), score)


def merge_by_priority(rows: DataFrame, name: str, priority: str, strength: str, times: str, most: int) -> DataFrame:
    """One row by lower-case name, of the best priority; the best `most` rows."""
    keyed = rows.withColumn("__k", F.lower(F.trim(name)))
    best = top_per_key(keyed, ["__k"], [priority, F.desc(strength), F.desc(times), name], 1).drop("__k")
    return best.orderBy(priority, F.desc(strength), F.desc(times), name).limit(most)


def unseen_by_tier(rows: DataFrame, source: str, tier: str) -> DataFrame:
    """Rows of the best tier their source has: later tiers skip sources seen before,
    within a tier a source may come several times."""
    return rows.withColumn("__t", F.min(tier).over(Window.partitionBy(source))).where(F.col(tier) == F.col("__t")).drop("__t")
