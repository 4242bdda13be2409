"""Graph aggregation, style maps, weighted scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators import aggregate as ag
from marquee.operators import graph as gr
from marquee.plans.registry import Tables, query


def edges(t: Tables) -> DataFrame:
    """A line item as an edge from supplier to part in the session of its order."""
    return t.lineitem.select(
        F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 50).alias("target"), F.col("l_returnflag").alias("kind"),
        F.col("l_orderkey").alias("session"), (F.col("l_quantity") / 64).alias("confidence"),
        F.concat_ws(" ", "l_linestatus", "l_linenumber", F.floor("l_quantity")).alias("details"),
        ((F.col("l_suppkey") == 3) & (F.col("l_linenumber") == 7)).alias("dismissed"),
    )


_EDGES = """(select l_suppkey as source, l_partkey % 50 as target, l_returnflag as kind, l_orderkey as session, l_quantity / 64 as confidence,
    concat_ws(' ', l_linestatus, l_linenumber, floor(l_quantity)::bigint) as details, l_suppkey = 3 and l_linenumber = 7 as dismissed from lineitem)"""


@query(
    "agg_graph_edges",
    f"""with e as {_EDGES} select source, target, kind, round_even(avg(confidence), 3) as avg_confidence, count(*) as occurrences, count(distinct session) as sessions,
    arg_min(details, (-length(details), details)) as details from e where (source, target, kind) not in (select source, target, kind from e where dismissed) group by 1, 2, 3""",
)
def agg_graph_edges(t: Tables) -> DataFrame:
    return ag.graph_edges(edges(t))


@query(
    "agg_graph_nodes",
    """select lower(trim(name)) as node, kind, count(distinct session) as appearances, min(name) as name from
    (select p_name as name, 'artist' as kind, l_orderkey as session from lineitem join part on p_partkey = l_partkey
    union all select s_name, 'label', l_orderkey from lineitem join supplier on s_suppkey = l_suppkey) group by 1, 2""",
)
def agg_graph_nodes(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey")
    artists = lines.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_name").alias("name"), F.lit("artist").alias("kind"), F.col("l_orderkey").alias("session"))
    labels = lines.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("s_name").alias("name"), F.lit("label").alias("kind"), F.col("l_orderkey").alias("session"))
    return ag.graph_nodes(artists.unionByName(labels))


@query("agg_graph_stats", "select l_returnflag as kind, count(*) as edges, count(distinct l_suppkey) as sources from lineitem group by 1")
def agg_graph_stats(t: Tables) -> DataFrame:
    return edges(t).groupBy("kind").agg(F.count("*").alias("edges"), F.count_distinct("source").alias("sources"))


@query("agg_node_detail", f"select source, target, kind, count(*) as n from {_EDGES} where source = 7 or target = 7 group by 1, 2, 3")
def agg_node_detail(t: Tables) -> DataFrame:
    return gr.incident(edges(t), 7).groupBy("source", "target", "kind").agg(F.count("*").alias("n"))


@query(
    "agg_style_map",
    "select l_suppkey as label, string_agg(distinct p_type, ',' order by p_type) as styles from lineitem join part on p_partkey = l_partkey where p_brand = 'Brand#7' group by 1",
)
def agg_style_map(t: Tables) -> DataFrame:
    releases = t.part.where("p_brand = 'Brand#7'").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    rows = t.lineitem.select("l_suppkey", "l_partkey").join(releases, "l_partkey")
    return rows.groupBy(F.col("l_suppkey").alias("label")).agg(F.array_join(F.sort_array(F.collect_set("p_type")), ",").alias("styles"))


@query(
    "agg_weighted_confidence",
    "select l_suppkey, round(least(greatest(case when sum(l_quantity) = 0 then 0 else sum(l_discount * l_quantity) / sum(l_quantity) end, 0), 1), 8) as confidence from lineitem group by 1",
)
def agg_weighted_confidence(t: Tables) -> DataFrame:
    rows = ag.weighted_confidence(t.lineitem, ["l_suppkey"], "l_discount", "l_quantity")
    return rows.withColumn("confidence", F.round("confidence", 8))


@query(
    "agg_majority_city",
    """select o_custkey, o_orderstatus, n, total from (select *, sum(n) over (partition by o_custkey)::bigint as total, row_number() over (partition by o_custkey order by n desc, o_orderstatus) r from
    (select o_custkey, o_orderstatus, count(*) as n from orders group by 1, 2)) where r = 1 and n >= 0.5 * total""",
)
def agg_majority_city(t: Tables) -> DataFrame:
    return ag.majority(t.orders, "o_custkey", "o_orderstatus", 0.5)


@query(
    "agg_top_genres",
    """select l_suppkey, string_agg(p_type, ',' order by r) as genres from (select l_suppkey, p_type, row_number() over (partition by l_suppkey order by count(*) desc, p_type) r
    from lineitem join part on p_partkey = l_partkey group by 1, 2) where r <= 5 group by 1""",
)
def agg_top_genres(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_suppkey", "l_partkey").join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    return ag.top_values(rows, ["l_suppkey"], "p_type", 5, "genres")


@query(
    "agg_group_promoter",
    "select coalesce(c_mktsegment, 'Unknown Promoter') as promoter, count(*) over (partition by coalesce(c_mktsegment, 'Unknown Promoter')) as n, c_custkey as id from (select c_custkey, case when c_custkey % 5 > 0 then c_mktsegment end as c_mktsegment from customer)",
)
def agg_group_promoter(t: Tables) -> DataFrame:
    """Groups by promoter, a row a member with the size of its group; no group meets in one row or task."""
    promoter = F.coalesce(F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")), F.lit("Unknown Promoter")).alias("promoter")
    rows = t.customer.select(promoter, F.col("c_custkey").alias("id"))
    return rows.join(rows.groupBy("promoter").agg(F.count("*").alias("n")), "promoter").select("promoter", "n", "id")


@query("resolve_canonical", "select p_partkey, p_name, first_value(p_name) over (partition by lower(trim(p_name)) order by p_partkey) as canonical from part")
def resolve_canonical(t: Tables) -> DataFrame:
    return gr.resolve_exact(t.part.select("p_partkey", "p_name"), "p_name", "p_partkey")


@query("resolve_fuzzy")
def resolve_fuzzy(t: Tables) -> DataFrame:
    return gr.resolve(t.part.select("p_partkey", "p_name"), "p_name", "p_partkey", 0.85)


@query("dedup_ocr_fuzzy")
def dedup_ocr_fuzzy(t: Tables) -> DataFrame:
    """Readings of one name in a supplier's parts: the most confident of like ones stays."""
    rows = t.part.select((-F.col("p_size") * 100000 + F.col("p_partkey")).alias("o"), "p_name")
    found = gr.resolve(rows, "p_name", "o", 0.8)
    return found.groupBy("canonical").agg(F.min_by("p_name", "o").alias("p_name"), F.count("*").alias("n"))


@query(
    "join_citation_known",
    """select p_partkey, p_name from part where exists (select 1 from (values ('red'), ('blue bolt and more'), ('ring')) k(s)
    where contains(p_name, s) or contains(s, p_name))""",
)
def join_citation_known(t: Tables) -> DataFrame:
    """The known sources are a short given list, so the test is a column expression."""
    known = ["red", "blue bolt and more", "ring"]
    hit = F.exists(F.array(*[F.lit(k) for k in known]), lambda k: F.contains("p_name", k) | F.contains(k, F.col("p_name")))
    return t.part.where(hit).select("p_partkey", "p_name")


@query(
    "cmp_edges_build",
    "select l_suppkey as source, l_partkey as target, least(greatest(l_discount * 15, 0), 1) as confidence, case when l_linestatus = 'O' then 'event' else 'press' end as kind from lineitem where l_suppkey % 10 <> 0",
)
def cmp_edges_build(t: Tables) -> DataFrame:
    source = F.trim(F.when(F.col("l_suppkey") % 10 != 0, F.col("l_suppkey").cast("string")).otherwise(" "))
    rows = t.lineitem.select(source.alias("s"), "l_partkey", "l_discount", "l_linestatus").where("s <> ''")
    kind = F.when(F.concat(F.lit("[RA-"), "l_linestatus", F.lit("]")).rlike(r"^\[RA-O"), "event").otherwise("press")
    return rows.select(
        F.col("s").cast("long").alias("source"), F.col("l_partkey").alias("target"),
        F.least(F.greatest(F.coalesce(F.col("l_discount") * 15, F.lit(0.5)), F.lit(0.0)), F.lit(1.0)).alias("confidence"), kind.alias("kind"),
    )


@query("cmp_warnings", "select 'order ' || o_orderkey as warning from orders where o_totalprice > 490000 union all select 'customer ' || c_custkey || ': balance' from customer where c_acctbal < 0")
def cmp_warnings(t: Tables) -> DataFrame:
    a = t.orders.where("o_totalprice > 490000").select(F.concat(F.lit("order "), "o_orderkey").alias("warning"))
    return a.unionByName(t.customer.where("c_acctbal < 0").select(F.concat(F.lit("customer "), "c_custkey", F.lit(": balance")).alias("warning")))


@query(
    "cmp_artist_match",
    """select p_name, least(1.0, max(c) + least(0.2, count(*) * 0.05) * (count(*) >= 2)::int)::double as confidence, count(*) as providers from
    (select p_name, p_type, round(max(p_size / 60.0), 6) as c from part group by 1, 2 having max(p_size / 60.0) >= 0.7) group by 1""",
)
def cmp_artist_match(t: Tables) -> DataFrame:
    best = t.part.groupBy("p_name", "p_type").agg(F.round(F.max(F.col("p_size") / 60.0), 6).alias("c")).where("c >= 0.7D")
    n = F.count("*")
    bonus = F.when(n >= 2, F.least(F.lit(0.2), n * 0.05)).otherwise(0.0)
    return best.groupBy("p_name").agg(F.least(F.lit(1.0), F.max("c") + bonus).alias("confidence"), n.alias("providers"))


@query(
    "cmp_research_context",
    "select n_regionkey, string_agg('[' || (n_nationkey + 1) || '] ' || n_name, chr(10) order by n_nationkey) as context from nation group by 1",
)
def cmp_research_context(t: Tables) -> DataFrame:
    line = F.concat(F.lit("["), F.col("n_nationkey") + 1, F.lit("] "), "n_name")
    lists = t.nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", line.alias("l")))).alias("x"))
    return lists.select("n_regionkey", F.array_join(F.transform("x", lambda v: v["l"]), "\n").alias("context"))
