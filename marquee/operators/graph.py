"""Entity resolution by fuzzy matching in order, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.operators.fuzzy import like_pairs
from marquee.operators.tables import written


def sorted_words(name: Column) -> Column:
    """The words in lower case, sorted, with single spaces."""
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(name), r"\s+"), lambda w: w != "")), " ")


def _leaders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes (key) that are like no leader before them; `edges` (early, late) are like pairs in
    order. Each round settles every node whose earlier neighbours are settled, so rounds
    are few unless long chains of names stand in order."""
    undecided, leaders = nodes.select("key"), []
    while not undecided.isEmpty():
        early, late = undecided.withColumnRenamed("key", "early"), undecided.withColumnRenamed("key", "late")
        open_edges = edges.join(early, "early", "left_semi").join(late, "late", "left_semi")
        new = written(undecided.join(open_edges.select(F.col("late").alias("key")), "key", "left_anti"), "leaders")
        leaders.append(new)
        covered = edges.join(new.withColumnRenamed("key", "early"), "early", "left_semi").select(F.col("late").alias("key"))
        undecided = written(undecided.join(new.unionByName(covered), "key", "left_anti"), "undecided")
    out = leaders[0] if leaders else nodes.select("key")
    for more in leaders[1:]:
        out = out.unionByName(more)
    return out


def resolve(rows: DataFrame, name: str, order: str, threshold: float) -> DataFrame:
    """(order, name, canonical) as if names were taken in order: a name is compared by its
    sorted words with every canonical name before it and gets the most similar one, the
    earliest of several; like none, it becomes canonical itself.

    Which names are canonical follows from the similar pairs alone, so these are found by
    a join and settled in rounds; no names are gathered in blocks. `order` must be unique;
    null names are not compared and have no canonical name.
    """
    keyed = rows.select(order, name, sorted_words(F.col(name)).alias("key"))
    nodes = written(keyed.where("key is not null").groupBy("key").agg(F.min(order).alias("o")), "names")
    names = nodes.select(F.col("key").alias("name"))
    pairs = written(like_pairs(names, names, threshold, "indel"), "pairs")
    first = nodes.select(F.col("key").alias("asked"), F.col("o").alias("asked_o"))
    then = nodes.select(F.col("key").alias("known"), F.col("o").alias("known_o"))
    edges = written(
        pairs.join(first, "asked").join(then, "known").where("asked_o < known_o").select(F.col("asked").alias("early"), F.col("known").alias("late")),
        "edges",
    )
    leaders = _leaders(nodes, edges).join(nodes, "key").select(F.col("key").alias("known"), F.col("o").alias("known_o"))
    choices = pairs.join(leaders, "known").select(F.col("asked").alias("key"), "known", "known_o", "ratio")
    best = F.min(F.struct((-F.col("ratio")).alias("r"), "known_o", "known")).alias("best")
    chosen = keyed.join(choices, "key").where(F.col("known_o") <= F.col(order)).groupBy(order).agg(best)
    return keyed.join(chosen.select(order, F.col("best.known").alias("canonical")), order, "left").select(order, name, "canonical")


def resolve_exact(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Canonical names by equality of trimmed lower-case names: the first by order."""
    key = F.lower(F.trim(name))
    firsts = rows.groupBy(key.alias("__k")).agg(F.min_by(name, order).alias("canonical"))
    return rows.withColumn("__k", key).join(firsts, "__k").select(order, name, "canonical")


def incident(edges: DataFrame, node: str) -> DataFrame:
    """Edges that start or end at a node."""
    return edges.where((F.col("source") == node) | (F.col("target") == node))
