"""Best-first crawls of a link graph: a global choice of pages, level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.operators.tables import written

HREF = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)[^>]*>(.*?)</a>"""


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def resolved(base: Column, href: Column) -> Column:
    """A link as an absolute address without its fragment: absolute, `//host/..`, `/path` and
    relative ones; null for other schemes and bare fragments."""
    plain = F.regexp_replace(href, r"#.*$", "")
    scheme, root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "")
    return (
        F.when(plain == "", None)
        .when(plain.rlike(r"^(?i:https?)://"), plain)
        .when(plain.startswith("//"), F.concat(scheme, plain))
        .when(plain.startswith("/"), F.concat(root, plain))
        .when(plain.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .otherwise(F.concat(folder, F.lit("/"), plain))
    )


def page_links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(source, target, anchor): the links of pages with the text between their tags."""
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(HREF), 1).alias("href"), F.regexp_extract_all(html, F.lit(HREF), 2).alias("anchor"))
    found = pages.select(F.col(url).alias("source"), F.explode(pairs).alias("l"))
    anchor = F.trim(F.regexp_replace(F.regexp_replace("l.anchor", r"<[^>]*>", " "), r"\s+", " "))
    return found.select("source", resolved(F.col("source"), F.col("l.href")).alias("target"), anchor.alias("anchor")).where("target is not null")


def relevance(link: DataFrame, words: list[str]) -> DataFrame:
    """Links with `score`: how many of the words their address or anchor holds."""
    text = F.lower(F.concat_ws(" ", "target", "anchor"))
    hits = [F.when(F.contains(text, F.lit(w.lower())), 1).otherwise(0) for w in words]
    return link.withColumn("score", sum(hits, F.lit(0)).cast("int"))


def best_first(links: DataFrame, pages: DataFrame, seeds: list[str], *, max_depth: int, max_pages: int, least: int = 0, same_host: bool = True) -> DataFrame:
    """(page, depth, score): the pages that a crawl of at most `max_pages` takes.

    links: source, target, score; pages: page, those that can be fetched. The seeds are taken
    first, in their order. Of all links out of a level those that score `least` or more, lead
    to a page of a seed's host and were not taken before are the next level; where they are
    more than the budget, the best by score, then address, are taken. A level is a join, an
    anti-join and one bounded top-k; the levels are bounded by `max_depth`.
    """
    spark = links.sparkSession
    known = spark.createDataFrame([(s, i) for i, s in enumerate(dict.fromkeys(seeds))], "page string, place int")
    level = known.join(pages.select("page").distinct(), "page", "left_semi").orderBy("place").limit(max_pages)
    taken = written(level.select("page", F.lit(0).alias("depth"), F.lit(None).cast("int").alias("score")), "crawl")
    graph = links.groupBy("source", "target").agg(F.max("score").alias("score")).where(F.col("score") >= least)
    if same_host:
        hosts = taken.select(host_of(F.col("page")).alias("host")).distinct()
        graph = graph.withColumn("host", host_of(F.col("target"))).join(F.broadcast(hosts), "host", "left_semi").drop("host")
    graph = written(graph.join(pages.select(F.col("page").alias("target")).distinct(), "target", "left_semi"), "links")
    frontier, n = taken, taken.count()
    for depth in range(1, max_depth + 1):
        if n >= max_pages:
            break
        out = frontier.select(F.col("page").alias("source")).join(graph, "source").groupBy(F.col("target").alias("page")).agg(F.max("score").alias("score"))
        fresh = out.join(taken.select("page"), "page", "left_anti")
        best = fresh.orderBy(F.desc("score"), "page").limit(max_pages - n).select("page", F.lit(depth).alias("depth"), "score")
        frontier = written(best, "crawl")
        if not (more := frontier.count()):
            break
        taken, n = taken.unionByName(frontier), n + more
    return taken
