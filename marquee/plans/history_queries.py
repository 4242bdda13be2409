"""Queries over flier history, ratings, sessions and submissions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators import aggregate as ag
from marquee.operators import history as hi
from marquee.operators.archive import export_tables, import_tables
from marquee.operators.tables import new_path
from marquee.plans.registry import Tables, query
from marquee.streaming.upserts import AppendLog, BucketTable

SEEDS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
IN_SEEDS = ", ".join(map(str, SEEDS))


def lineup(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("flier_id"), F.col("l_partkey").alias("artist"))


def ratings(t: Tables) -> DataFrame:
    """Events as ratings: +1 for values of 50 and more, else -1."""
    return t.events.select(
        "event_id", "ts", "user_id", F.upper("event_type").alias("item_type"),
        F.get_json_object("props", "$.k").alias("item_key"), F.when(F.col("value") >= 50, 1).otherwise(-1).alias("rating"),
    )


RATINGS = """(select event_id, ts, user_id, upper(event_type) as item_type, json_extract_string(props, '$.k') as item_key,
    case when value >= 50 then 1 else -1 end as rating from events)"""


@query(
    "join_co_appearance",
    f"""
    with lineup as (select distinct l_orderkey as f, l_partkey as a from lineitem),
    seeded as (select f, a as seed from lineup where a in ({IN_SEEDS})),
    j as (select o.a, o.f, s.seed, ord.o_orderpriority as event, ord.o_orderstatus as venue
        from lineup o join seeded s using (f) join orders ord on ord.o_orderkey = o.f where o.a not in ({IN_SEEDS}))
    select a as artist, count(distinct f) as times_seen,
        string_agg(distinct seed::varchar, ',' order by seed::varchar) as seeds,
        string_agg(distinct event, ',' order by event) as events, string_agg(distinct venue, ',' order by venue) as venues
    from j group by a""",
)
def join_co_appearance(t: Tables) -> DataFrame:
    fliers = t.orders.select(
        F.col("o_orderkey").alias("flier_id"), F.col("o_orderpriority").alias("event"), F.col("o_orderstatus").alias("venue")
    )
    return hi.co_appearances(lineup(t), fliers, SEEDS)


@query(
    "join_event_pairs",
    """
    with l as (select distinct l_orderkey, l_partkey from lineitem),
    p as (select a.l_partkey as artist_a, b.l_partkey as artist_b, a.l_orderkey as k
        from l a join l b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey)
    select artist_a, artist_b, count(distinct k) as shared, min(k) as flier_id from p group by 1, 2""",
)
def join_event_pairs(t: Tables) -> DataFrame:
    return hi.shared_event_pairs(lineup(t), ["flier_id"], "artist", ["flier_id"])


@query(
    "join_snapshot_flier",
    """
    select o_orderkey, c_name, c_mktsegment, o_orderdate from orders join customer on o_custkey = c_custkey
    where o_orderstatus = 'O' order by o_orderdate desc, o_orderkey desc limit 50 offset 20""",
)
def join_snapshot_flier(t: Tables) -> DataFrame:
    rows = t.orders.where("o_orderstatus = 'O'").join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select("o_orderkey", "c_name", "c_mktsegment", "o_orderdate")
    return hi.page(rows, [F.desc("o_orderdate"), F.desc("o_orderkey")], 20, 50)


@query(
    "join_snapshot_dismissals",
    """
    select o_orderkey, coalesce(n, 0) as n_dismissals, coalesce(d, '') as dismissals from orders left join (
        select l_orderkey, count(*) as n, string_agg(l_linenumber || ':' || l_partkey, ';' order by l_linenumber, l_partkey) as d
        from lineitem where l_returnflag = 'R' group by l_orderkey) on l_orderkey = o_orderkey""",
)
def join_snapshot_dismissals(t: Tables) -> DataFrame:
    gone = t.lineitem.where("l_returnflag = 'R'").withColumnRenamed("l_orderkey", "o_orderkey")
    rows = hi.nested(t.orders.select("o_orderkey"), gone, "o_orderkey", "gone", ["l_linenumber", "l_partkey"])
    text = F.transform("gone", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"]))
    return rows.select("o_orderkey", F.size("gone").cast("long").alias("n_dismissals"), F.array_join(text, ";").alias("dismissals"))


@query("join_story_metadata", "select d.doc_id, d.source, l.quality, l.toxic from documents d left join labels l using (doc_id)")
def join_story_metadata(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left").select("doc_id", "source", "quality", "toxic")


@query(
    "join_story_tag_filter",
    """select doc_id, lang, n_chars from documents where doc_id in (select doc_id from labels where quality = 1)
    order by n_chars desc, doc_id desc""",
)
def join_story_tag_filter(t: Tables) -> DataFrame:
    tagged = t.labels.where("quality = 1")
    rows = t.documents.select("doc_id", "lang", "n_chars").join(tagged, "doc_id", "left_semi")
    return rows.orderBy(F.desc("n_chars"), F.desc("doc_id"))


@query("join_tags_approved", "select distinct lang as tag from documents join labels using (doc_id) where quality = 1 order by 1")
def join_tags_approved(t: Tables) -> DataFrame:
    approved = t.labels.where("quality = 1").select("doc_id")
    return t.documents.join(approved, "doc_id", "left_semi").select(F.col("lang").alias("tag")).distinct().orderBy("tag")


@query(
    "join_label_mates",
    """
    with mine as (select distinct l_suppkey from lineitem where l_partkey in (1, 2, 3)),
    mates as (select l_partkey as artist, count(distinct l_suppkey) as n from lineitem
        where l_suppkey in (select l_suppkey from mine) and l_partkey not in (1, 2, 3) group by 1)
    select artist, n, least(1.0::double, n * 0.3::double + 0.2::double) as strength from mates""",
)
def join_label_mates(t: Tables) -> DataFrame:
    seeds = [1, 2, 3]
    releases = t.lineitem.select("l_suppkey", F.col("l_partkey").alias("artist"))
    labels = releases.where(F.col("artist").isin(seeds)).select("l_suppkey").distinct()
    mates = releases.where(~F.col("artist").isin(seeds)).join(labels, "l_suppkey", "left_semi")
    counted = mates.groupBy("artist").agg(F.count_distinct("l_suppkey").alias("n"))
    return counted.withColumn("strength", F.least(F.lit(1.0), F.col("n") * 0.3 + 0.2))


@query(
    "join_exclusion_anti",
    """select p_partkey, p_name from part where lower(trim(p_name)) not in
    (select lower(trim(p_name)) from part where p_brand = 'Brand#1' and p_size < 20)""",
)
def join_exclusion_anti(t: Tables) -> DataFrame:
    gone = t.part.where("p_brand = 'Brand#1' and p_size < 20").select(hi.name_key("p_name").alias("k")).distinct()
    rows = t.part.select("p_partkey", "p_name", hi.name_key("p_name").alias("k"))
    return rows.join(gone, "k", "left_anti").select("p_partkey", "p_name")


@query(
    "join_style_map_semi",
    """select s.p_partkey, s.p_name, m.styles from part s join (select lower(trim(p_name)) as k,
    string_agg(distinct p_type, ',' order by p_type) as styles from part where p_size > 25 group by 1) m on lower(trim(s.p_name)) = m.k
    where s.p_size <= 25""",
)
def join_style_map_semi(t: Tables) -> DataFrame:
    styles = t.part.where("p_size > 25").groupBy(hi.name_key("p_name").alias("k")).agg(
        F.array_join(F.sort_array(F.collect_set("p_type")), ",").alias("styles")
    )
    return t.part.where("p_size <= 25").withColumn("k", hi.name_key("p_name")).join(styles, "k").select("p_partkey", "p_name", "styles")


@query(
    "join_alias_lookup",
    """select c.c_custkey, n.n_name as canonical from customer c join nation n
    on lower('nation_' || c.c_nationkey) = lower(n.n_name)""",
)
def join_alias_lookup(t: Tables) -> DataFrame:
    alias = t.customer.select("c_custkey", F.lower(F.concat(F.lit("nation_"), "c_nationkey")).alias("k"))
    return alias.join(t.nation.select(F.lower("n_name").alias("k"), F.col("n_name").alias("canonical")), "k").drop("k")


def _store(t: Tables, schema: str, key: list[str], order: list[str]) -> BucketTable:
    spark = t.nation.sparkSession
    return BucketTable(spark, new_path(spark, "store"), schema, key, order)


def _chunks(t: Tables) -> BucketTable:
    """The documents as a written chunk table."""
    table = _store(t, "doc_id long, lang string, source string", ["doc_id"], ["source", "lang"])
    table.merge(t.documents, 0)
    return table


@query(
    "sink_upsert_chunks",
    "select event_id, user_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r = 1",
)
def sink_upsert_chunks(t: Tables) -> DataFrame:
    """Written in three batches that overlap, the second one twice; the table is read back."""
    events = t.events
    table = _store(t, "event_id long, user_id long, event_type string, ts timestamp_ntz", ["user_id"], ["ts", "event_id"])
    for number, only in enumerate(("event_id % 3 <> 1", "event_id % 3 <> 0", "event_id % 3 <> 0", "event_id % 3 = 1")):
        table.merge(events.where(only), number)
    return table.latest().drop("ts")


@query(
    "sink_versioned_snapshot",
    """select event_id, user_id, row_number() over w as revision, lead(1) over w is null as is_active
    from events window w as (partition by user_id order by ts, event_id)""",
)
def sink_versioned_snapshot(t: Tables) -> DataFrame:
    rows = hi.snapshots(t.events.select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"])
    return rows.select("event_id", "user_id", F.col("revision").cast("long").alias("revision"), "is_active")


@query(
    "sink_upsert_rating",
    f"""select user_id, item_type, item_key, arg_max(rating, (ts, event_id))::bigint as rating from {RATINGS} group by 1, 2, 3""",
)
def sink_upsert_rating(t: Tables) -> DataFrame:
    """Ratings of two batches, the older ones last; a later rating of a key stays."""
    rows = ratings(t).withColumn("rating", F.col("rating").cast("long"))
    schema = "event_id long, ts timestamp_ntz, user_id long, item_type string, item_key string, rating long"
    table = _store(t, schema, ["user_id", "item_type", "item_key"], ["ts", "event_id"])
    table.merge(rows.where("event_id % 2 = 1"), 0)
    table.merge(rows.where("event_id % 2 = 0"), 1)
    return table.latest().select("user_id", "item_type", "item_key", "rating")


@query(
    "sink_insert_ignore",
    "select event_id, user_id, event_type from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) r from events) where r = 1",
)
def sink_insert_ignore(t: Tables) -> DataFrame:
    return hi.first_kept(t.events.select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query(
    "sink_upsert_narrative",
    """select o_orderpriority as event_name, yr as event_year, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as narrative from
    (select *, case when o_orderstatus <> 'P' then year(o_orderdate) end as yr from orders) group by 1, 2""",
)
def sink_upsert_narrative(t: Tables) -> DataFrame:
    year = F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate")).cast("long")
    rows = t.orders.withColumn("event_year", year)  # grouping takes null years as equal
    found = hi.latest_value(rows, ["o_orderpriority", "event_year"], "o_orderkey", F.struct("o_orderdate", "o_orderkey"))
    return found.select(F.col("o_orderpriority").alias("event_name"), "event_year", F.col("o_orderkey").alias("narrative"))


@query("sink_delete_source", "select doc_id, source from documents where source <> 'src3'")
def sink_delete_source(t: Tables) -> DataFrame:
    table = _chunks(t)
    table.delete(F.col("source") == "src3", 1)
    return table.latest().select("doc_id", "source")


@query("sink_delete_type", "select lang, count(*) as n from documents where lang <> 'de' group by lang")
def sink_delete_type(t: Tables) -> DataFrame:
    table = _chunks(t)
    table.delete(F.col("lang") == "de", 1)
    return table.latest().groupBy("lang").agg(F.count("*").alias("n"))


@query("sink_update_metadata", "select doc_id, case when doc_id = 7 then 'patched' else source end as source from documents")
def sink_update_metadata(t: Tables) -> DataFrame:
    table = _chunks(t)
    table.update(F.col("doc_id") == 7, {"source": F.lit("patched")}, 1)
    return table.latest().select("doc_id", "source")


@query(
    "sink_log_flier",
    """select o_orderkey as flier_id, l_linenumber as position, p_name as artist_name, lower(trim(p_name)) as artist_key
    from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey""",
)
def sink_log_flier(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(t.orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    named = lines.join(t.part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return named.select(
        F.col("o_orderkey").alias("flier_id"), F.col("l_linenumber").alias("position"),
        F.col("p_name").alias("artist_name"), hi.name_key("p_name").alias("artist_key"),
    )


@query(
    "sink_update_status",
    "select o_orderkey, case when o_orderstatus = 'P' and o_orderpriority = '1-URGENT' then 'A' else o_orderstatus end as status from orders",
)
def sink_update_status(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderpriority", F.col("o_orderstatus").alias("status"))
    return hi.update_status(rows, F.col("o_orderpriority") == "1-URGENT", "status", "A", "P").drop("o_orderpriority")


@query(
    "sink_dismiss_edge",
    """select n_name as source, r_name as target, 'in' as kind, lower(n_name) = 'nation_3' and lower(r_name) = 'asia' as dismissed
    from nation join region on n_regionkey = r_regionkey""",
)
def sink_dismiss_edge(t: Tables) -> DataFrame:
    edges = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("source"), F.col("r_name").alias("target"), F.lit("in").alias("kind"), F.lit(False).alias("dismissed")
    )
    return hi.dismiss(edges, "Nation_3", "Asia", "IN")


@query(
    "sink_session_kv",
    """select user_id, event_id as state from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r,
    max(ts) over () as now from events) where r = 1 and ts >= now - interval 72 hours""",
)
def sink_session_kv(t: Tables) -> DataFrame:
    now = t.events.agg((F.max("ts") - F.expr("interval 72 hours")).alias("since"))
    last = hi.latest(t.events.select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"])
    return last.join(F.broadcast(now), F.col("ts") >= F.col("since")).select("user_id", F.col("event_id").alias("state"))


@query(
    "agg_rating_summary",
    f"""select coalesce(item_type, 'ALL') as item_type, count(*) as total, sum((rating > 0)::int)::bigint as positive,
    sum((rating < 0)::int)::bigint as negative from {RATINGS} group by rollup (item_type)""",
)
def agg_rating_summary(t: Tables) -> DataFrame:
    return ag.rating_summary(ratings(t), "item_type", "rating")


@query(
    "agg_having_negative",
    f"select item_type, item_key, sum(rating)::bigint as score from {RATINGS} where starts_with(item_key, '1') group by 1, 2 having sum(rating) < 0",
)
def agg_having_negative(t: Tables) -> DataFrame:
    return ag.negative_keys(ratings(t), ["item_type", "item_key"], "rating", "1")


@query(
    "filt_negative_feedback",
    f"""select doc_id, source from documents where (doc_id % 100)::varchar not in
    (select item_key from {RATINGS} where item_type = 'CLICK' group by 1 having sum(rating) < 0)""",
)
def filt_negative_feedback(t: Tables) -> DataFrame:
    bad = ag.negative_keys(ratings(t).where("item_type = 'CLICK'"), ["item_key"], "rating")
    docs = t.documents.select("doc_id", "source", (F.col("doc_id") % 100).cast("string").alias("item_key"))
    return docs.join(bad, "item_key", "left_anti").select("doc_id", "source")


@query(
    "agg_events_by_story",
    """select o_orderpriority as event, year(o_orderdate) as yr, count(*) as n, min(o_orderstatus) as city from orders
    where o_orderstatus <> 'P' group by 1, 2 order by n desc, event""",
)
def agg_events_by_story(t: Tables) -> DataFrame:
    rows = t.orders.where("o_orderstatus <> 'P'").groupBy(
        F.col("o_orderpriority").alias("event"), F.year("o_orderdate").cast("long").alias("yr")
    ).agg(F.count("*").alias("n"), F.min("o_orderstatus").alias("city"))
    return rows.orderBy(F.desc("n"), "event", "yr")


@query(
    "agg_story_stats",
    """select quality, toxic, count(*) as n, count(distinct lang) as langs, count(distinct source) as sources
    from documents join labels using (doc_id) group by 1, 2""",
)
def agg_story_stats(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id").groupBy("quality", "toxic").agg(
        F.count("*").alias("n"), F.count_distinct("lang").alias("langs"), F.count_distinct("source").alias("sources")
    )


@query(
    "agg_status_counts",
    """select count(*) filter (o_orderstatus = 'O') as o, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus = 'P') as p,
    count(*) filter (o_orderstatus = 'X') as x, count(*) as total from orders""",
)
def agg_status_counts(t: Tables) -> DataFrame:
    return ag.status_counts(t.orders, "o_orderstatus", ["O", "F", "P", "X"])


@query("agg_count", "select count(*) as fliers, count(*) filter (o_orderstatus = 'O') as active from orders")
def agg_count(t: Tables) -> DataFrame:
    return t.orders.agg(F.count("*").alias("fliers"), F.count(F.when(F.col("o_orderstatus") == "O", 1)).alias("active"))


@query("lk_ratings_by_session", f"select event_id, item_type, item_key, rating::bigint as rating from {RATINGS} where user_id = 5 order by ts desc, event_id desc")
def lk_ratings_by_session(t: Tables) -> DataFrame:
    rows = ratings(t).where("user_id = 5").orderBy(F.desc("ts"), F.desc("event_id"))
    return rows.select("event_id", "item_type", "item_key", F.col("rating").cast("long").alias("rating"))


@query(
    "lk_dismissals",
    """select l_linenumber, l_partkey, l_shipdate from lineitem join orders on o_orderkey = l_orderkey
    where o_custkey = 7 and l_returnflag = 'R' order by l_shipdate desc, l_partkey""",
)
def lk_dismissals(t: Tables) -> DataFrame:
    mine = t.orders.where("o_custkey = 7").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = t.lineitem.where("l_returnflag = 'R'").join(mine, "l_orderkey", "left_semi")
    return rows.select("l_linenumber", "l_partkey", "l_shipdate").orderBy(F.desc("l_shipdate"), "l_partkey")


@query(
    "lk_annotations",
    """select o_orderkey, o_orderdate, o_totalprice from orders where o_custkey = 11 order by o_orderdate desc, o_orderkey desc""",
)
def lk_annotations(t: Tables) -> DataFrame:
    rows = t.orders.where("o_custkey = 11").select("o_orderkey", "o_orderdate", "o_totalprice")
    return rows.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))


@query("lk_pending", "select o_orderkey, o_orderdate from orders where o_orderstatus = 'P' order by o_orderdate desc, o_orderkey desc limit 20 offset 40")
def lk_pending(t: Tables) -> DataFrame:
    rows = t.orders.where("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate")
    return hi.page(rows, [F.desc("o_orderdate"), F.desc("o_orderkey")], 40, 20)


@query(
    "lk_event_stories",
    """select doc_id, lang, source, first_value(source) over (order by doc_id) as city from documents
    join labels using (doc_id) where quality = 1 and lang = 'en' order by doc_id""",
)
def lk_event_stories(t: Tables) -> DataFrame:
    rows = t.documents.where("lang = 'en'").select("doc_id", "lang", "source").join(t.labels.where("quality = 1"), "doc_id", "left_semi")
    city = rows.agg(F.min_by("source", "doc_id").alias("city"))
    return rows.crossJoin(F.broadcast(city)).orderBy("doc_id")  # one row beside each


@query(
    "lk_narrative",
    """select lang, n as story_count, n >= 3 and n = kept as valid from (select lang, count(*) as n from documents group by lang)
    join (select lang, count(*) as kept from documents join labels using (doc_id) group by lang) using (lang)""",
)
def lk_narrative(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "lang")
    now = docs.groupBy("lang").agg(F.count("*").alias("story_count"))
    stored = docs.join(t.labels.select("doc_id"), "doc_id").groupBy("lang").agg(F.count("*").alias("kept"))
    return now.join(stored, "lang").select("lang", "story_count", ((F.col("story_count") >= 3) & (F.col("story_count") == F.col("kept"))).alias("valid"))


@query(
    "lk_story_public",
    """select o_orderkey, string_agg(p_name, ',' order by p_name) filter (p_type = 'PROMO') as promo,
    string_agg(p_name, ',' order by p_name) filter (p_type = 'SMALL') as small from orders join lineitem on l_orderkey = o_orderkey
    join part on p_partkey = l_partkey where o_orderstatus = 'F' and p_type in ('PROMO', 'SMALL') group by 1""",
)
def lk_story_public(t: Tables) -> DataFrame:
    shown = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    tags = t.part.where("p_type in ('PROMO', 'SMALL')").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    rows = t.lineitem.select("l_orderkey", "l_partkey").join(shown, "l_orderkey").join(tags, "l_partkey")
    wide = rows.groupBy(F.col("l_orderkey").alias("o_orderkey")).pivot("p_type", ["PROMO", "SMALL"]).agg(F.sort_array(F.collect_list("p_name")))
    text = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    return wide.select("o_orderkey", text("PROMO").alias("promo"), text("SMALL").alias("small"))


@query(
    "cmp_feedback_filter",
    f"""select p_partkey, p_name from part where 'artist::release::' || (p_partkey % 100) not in
    (select 'artist::release::' || item_key from {RATINGS} where item_type = 'VIEW' group by item_key having sum(rating) < 0)""",
)
def cmp_feedback_filter(t: Tables) -> DataFrame:
    bad = ag.negative_keys(ratings(t).where("item_type = 'VIEW'"), ["item_key"], "rating")
    bad = bad.select(F.concat(F.lit("artist::release::"), "item_key").alias("k"))
    rows = t.part.select("p_partkey", "p_name", F.concat(F.lit("artist::release::"), F.col("p_partkey") % 100).alias("k"))
    return rows.join(bad, "k", "left_anti").select("p_partkey", "p_name")


@query(
    "cmp_shared_flier",
    f"""with l as (select distinct l_orderkey f, l_partkey a from lineitem)
    select a as artist, count(distinct f) as n, least(1.0::double, count(distinct f) * 0.2::double + 0.3::double) as strength from l
    where a not in ({IN_SEEDS}) and f in (select f from l where a in ({IN_SEEDS})) group by a""",
)
def cmp_shared_flier(t: Tables) -> DataFrame:
    rows = lineup(t).distinct()
    seeded = rows.where(F.col("artist").isin(SEEDS)).select("flier_id").distinct()
    seen = rows.where(~F.col("artist").isin(SEEDS)).join(seeded, "flier_id", "left_semi").groupBy("artist").agg(F.count("*").alias("n"))
    return seen.withColumn("strength", F.least(F.lit(1.0), F.col("n") * 0.2 + 0.3))


@query(
    "cmp_shared_context",
    """with l as (select distinct l_orderkey k, l_partkey a from lineitem), p as (select x.a as artist_a, y.a as artist_b, x.k
        from l x join l y on x.k = y.k and x.a < y.a)
    select artist_a, artist_b, string_agg('[RA-' || r || '] ' || k, '; ' order by r) as context from
        (select *, row_number() over (partition by artist_a, artist_b order by k) as r from p) group by 1, 2""",
)
def cmp_shared_context(t: Tables) -> DataFrame:
    rows = lineup(t).distinct()
    pairs = rows.withColumnRenamed("artist", "artist_a").join(rows.withColumnRenamed("artist", "artist_b"), "flier_id").where("artist_a < artist_b")
    lists = pairs.groupBy("artist_a", "artist_b").agg(F.sort_array(F.collect_list("flier_id")).alias("k"))
    text = F.transform("k", lambda x, i: F.concat(F.lit("[RA-"), i + 1, F.lit("] "), x))
    return lists.select("artist_a", "artist_b", F.array_join(text, "; ").alias("context"))


@query(
    "cmp_progress_anti",
    """select event_id, user_id from events where event_type = 'view' and user_id not in
    (select user_id from events where event_type = 'purchase' and value > 100)""",
)
def cmp_progress_anti(t: Tables) -> DataFrame:
    done = t.events.where("event_type = 'purchase' and value > 100").select("user_id").distinct()
    return t.events.where("event_type = 'view'").select("event_id", "user_id").join(done, "user_id", "left_anti").select("event_id", "user_id")


@query(
    "agg_batch_progress",
    """select user_id, count(*) filter (event_type = 'purchase') as completed, count(*) filter (event_type = 'error') as failed,
    round(100.0 * count(*) filter (event_type in ('purchase', 'error')) / count(*), 1)::double as percent from events group by 1""",
)
def agg_batch_progress(t: Tables) -> DataFrame:
    count = lambda *kinds: F.count(F.when(F.col("event_type").isin(*kinds), 1))
    return t.events.groupBy("user_id").agg(
        count("purchase").alias("completed"), count("error").alias("failed"),
        F.round(F.lit(100.0) * count("purchase", "error") / F.count("*"), 1).alias("percent"),
    )


@query(
    "lk_scrape_status",
    """with kinds as (select unnest(['click', 'view', 'error', 'missing']) as city)
    select city, coalesce(n, 0) as n_events, first_day, last_day from kinds left join
    (select event_type, count(*) as n, strftime(min(ts), '%Y-%m-%d') as first_day, strftime(max(ts), '%Y-%m-%d') as last_day from events group by 1) on event_type = city""",
)
def lk_scrape_status(t: Tables) -> DataFrame:
    seen = t.events.groupBy(F.col("event_type").alias("city")).agg(
        F.count("*").alias("n"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day")
    )
    cities = t.events.sparkSession.createDataFrame([(c,) for c in ("click", "view", "error", "missing")], "city string")
    return cities.join(seen, "city", "left").select("city", F.coalesce("n", F.lit(0).cast("long")).alias("n_events"), "first_day", "last_day")


@query(
    "lk_area_discovery",
    "select n_nationkey as area, count(c_custkey) as total from nation left join customer on c_nationkey = n_nationkey group by 1 having count(c_custkey) > 0",
)
def lk_area_discovery(t: Tables) -> DataFrame:
    counts = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("total"))
    return t.nation.join(counts, F.col("n_nationkey") == F.col("c_nationkey")).where("total > 0").select(F.col("n_nationkey").alias("area"), "total")


@query("sink_annotation", "select o_orderkey, o_custkey, 'note ' || o_orderpriority as note from orders union all select l_orderkey, 0, 'line ' || l_linenumber from lineitem where l_returnflag = 'R'")
def sink_annotation(t: Tables) -> DataFrame:
    kept = t.orders.select("o_orderkey", "o_custkey", F.concat(F.lit("note "), "o_orderpriority").alias("note"))
    added = t.lineitem.where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("o_orderkey"), F.lit(0).cast("long").alias("o_custkey"), F.concat(F.lit("line "), "l_linenumber").alias("note")
    )
    return kept.unionByName(added)


@query("sink_jsonl_checkpoint", "select p_partkey, p_name, p_size from part where p_size > 10")
def sink_jsonl_checkpoint(t: Tables) -> DataFrame:
    """Rows written as JSON lines and read back, the schema given."""
    from marquee.operators.tables import new_path
    from marquee.sources.files import write_jsonl

    kept = t.part.where("p_size > 10").select("p_partkey", "p_name", "p_size")
    path = new_path(kept.sparkSession, "checkpoint")
    write_jsonl(kept, path)
    return kept.sparkSession.read.schema("p_partkey long, p_name string, p_size int").json(path)


@query("lk_dump_status", "select p_type as dump, count(*) as n, round(sum(length(p_name)) / 1024.0, 3)::double as kb from part group by 1")
def lk_dump_status(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_type").alias("dump")).agg(F.count("*").alias("n"), F.round(F.sum(F.length("p_name")) / 1024.0, 3).alias("kb"))


@query(
    "cmp_recommend_quick",
    f"""with l as (select distinct l_orderkey f, l_partkey a from lineitem)
    select a as artist, count(*) as n, 'Played with your artists ' || count(*) || ' times' as reason from l
    where a not in ({IN_SEEDS}) and f in (select f from l where a in ({IN_SEEDS})) group by a order by n desc, a limit 10""",
)
def cmp_recommend_quick(t: Tables) -> DataFrame:
    rows = lineup(t).distinct()
    seeded = rows.where(F.col("artist").isin(SEEDS)).select("flier_id").distinct()
    seen = rows.where(~F.col("artist").isin(SEEDS)).join(seeded, "flier_id", "left_semi").groupBy("artist").agg(F.count("*").alias("n"))
    best = seen.orderBy(F.desc("n"), "artist").limit(10)
    return best.withColumn("reason", F.concat(F.lit("Played with your artists "), "n", F.lit(" times")))


@query(
    "cmp_shared_lineup",
    """with texts as (select l_orderkey, string_agg(p_name, ', ' order by l_linenumber, l_partkey) as line from lineitem join part on p_partkey = l_partkey group by 1),
    names as (select l_orderkey, unnest(string_split(line, ', ')) as name from texts where contains(line, 'red'))
    select name, count(distinct l_orderkey) as times, 0.4::double as strength from names where not contains(name, 'red') group by 1""",
)
def cmp_shared_lineup(t: Tables) -> DataFrame:
    """Names on the `Artists:` lines of texts that mention a seed; fixed strength."""
    named = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    lines = named.groupBy("l_orderkey").agg(
        F.concat(F.lit("Artists: "), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_name"))), lambda x: x["p_name"]), ", ")).alias("text")
    )
    hits = lines.where(F.contains("text", F.lit("red")))
    parsed = hits.select("l_orderkey", F.explode(F.split(F.regexp_extract("text", r"(?m)^Artists: (.*)$", 1), ", ")).alias("name"))
    return parsed.where(~F.contains("name", F.lit("red"))).groupBy("name").agg(F.count_distinct("l_orderkey").alias("times"), F.lit(0.4).alias("strength"))


@query("sink_archive", "select 'supplier' as name, s_suppkey as key, s_name as label, s_acctbal as amount from supplier union all select 'customer', c_custkey, c_name, c_acctbal from customer")
def sink_archive(t: Tables) -> DataFrame:
    """Two tables packed, verified by their manifest, and read from where they were taken back to."""
    spark = t.supplier.sparkSession
    root, target = new_path(spark, "archive"), new_path(spark, "imported")
    export_tables({"supplier": t.supplier, "customer": t.customer}, root)
    names = import_tables(spark, root, target)
    parts = {"supplier": "s", "customer": "c"}
    ids = {"supplier": "s_suppkey", "customer": "c_custkey"}
    return reduce(
        DataFrame.unionByName,
        [
            spark.read.parquet(f"{target}/{n}").select(
                F.lit(n).alias("name"), F.col(ids[n]).alias("key"), F.col(f"{parts[n]}_name").alias("label"), F.col(f"{parts[n]}_acctbal").alias("amount")
            )
            for n in names
        ],
    )


@query("sink_feedback", "select event_id, user_id as session_id, event_type as target, value >= 50 as useful, ts from events where event_type in ('click', 'view', 'purchase')")
def sink_feedback(t: Tables) -> DataFrame:
    """Feedback rows appended in three batches, one of which comes twice, and read back."""
    rows = t.events.where("event_type in ('click', 'view', 'purchase')").select(
        "event_id", F.col("user_id").alias("session_id"), F.col("event_type").alias("target"), (F.col("value") >= 50).alias("useful"), "ts"
    )
    log = AppendLog(t.events.sparkSession, new_path(t.events.sparkSession, "feedback"), rows.schema)
    for number in (0, 1, 1, 2):
        log.append(rows.where(F.pmod("event_id", F.lit(3)) == number), number)
    return log.rows()
