"""Domain knowledge as functions of given tables: genres, scenes, aliases, artist queries.

The tables (genres and their neighbours, scenes and cities, artists and aliases) are the
caller's: short ones as dicts and lists, which become literals, long ones as DataFrames,
which are joined.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEFORE, BEHIND = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"


def extract_genres(text: Column, genres: list[str]) -> Column:
    """The genres in a text, sorted, as whole words and whatever their case. Longer names are
    taken first, and what one has taken no other can: `acid house` is not also `house`."""
    longest = sorted((g.lower() for g in genres), key=lambda g: (-len(g), g))
    low = F.lower(text)
    there = F.array_compact(F.array(*[F.when(low.rlike(BEFORE + re.escape(g) + BEHIND), F.lit(g)) for g in longest]))
    pattern = lambda g: F.concat(F.lit(BEFORE + r"\Q"), g, F.lit(r"\E" + BEHIND))

    def take(state: Column, g: Column) -> Column:
        found = F.when(F.regexp_like(state["t"], pattern(g)), F.array_append(state["found"], g)).otherwise(state["found"])
        return F.struct(F.regexp_replace(state["t"], pattern(g), F.lit("\x00")).alias("t"), found.alias("found"))

    start = F.struct(low.alias("t"), F.array().cast("array<string>").alias("found"))
    return F.sort_array(F.aggregate(there, start, take, lambda s: s["found"]))


def adjacent_genres(genres: DataFrame, genre: str, neighbours: DataFrame) -> DataFrame:
    """(genre, adjacent): for each genre its neighbours by the table (genre, neighbour), sorted;
    outer spaces and case do not count, an unknown genre has none."""
    key = F.lower(F.trim(genre))
    known = neighbours.groupBy(F.lower("genre").alias("__g")).agg(F.sort_array(F.collect_set("neighbour")).alias("adjacent"))
    rows = genres.withColumn("__g", key).join(known, "__g", "left")
    return rows.select(F.col(genre).alias("genre"), F.coalesce("adjacent", F.array().cast("array<string>")).alias("adjacent"))


def scene_cities(text: Column, scenes: dict[str, list[str]]) -> Column:
    """The cities of all scenes that a text names, sorted, once each."""
    low = F.lower(text)
    none = F.array().cast("array<string>")
    cities = [F.when(F.contains(low, F.lit(s)), F.array(*[F.lit(c) for c in places])).otherwise(none) for s, places in scenes.items()]
    return F.sort_array(F.array_distinct(F.flatten(F.array(*cities)))) if cities else none


def expand_aliases(names: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """`names` with `names`: the canonical name and all aliases of an artist, sorted, by the table
    (canonical, alias), whether `name` is the one or the other; an unknown name alone. An alias
    of several artists counts for the last by name."""
    own = aliases.select("canonical", F.col("canonical").alias("n")).unionByName(aliases.select("canonical", F.col("alias").alias("n")))
    is_own = F.col("canonical") == F.col("n")
    of = own.groupBy(F.lower("n").alias("__n")).agg(F.max(F.struct(is_own.alias("own"), "canonical"))["canonical"].alias("__c"))
    groups = own.groupBy(F.col("canonical").alias("__c")).agg(F.sort_array(F.collect_set("n")).alias("__all"))
    rows = names.withColumn("__n", F.lower(F.trim(name))).join(of, "__n", "left").join(groups, "__c", "left")
    return rows.withColumn("names", F.coalesce("__all", F.array(name))).drop("__n", "__c", "__all")


def is_artist_query(query: Column, pattern: str, names: list[str]) -> Column:
    """Whether a query has the form of one for artists, is the name of an artist, or has one of
    more than four letters in it."""
    low, known = F.lower(F.trim(query)), sorted({n.lower() for n in names})
    named = [low.isin(known)] if known else [F.lit(False)]
    return F.coalesce(query.rlike(pattern), F.lit(False)) | named[0] | F.exists(
        F.array(*[F.lit(n) for n in known if len(n) > 4]).cast("array<string>"), lambda n: F.contains(low, n)
    )
