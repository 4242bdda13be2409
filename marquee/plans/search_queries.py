"""Vector search, reranking, ranked merges, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators import ranking as rk
from marquee.operators import vectors as ve
from marquee.operators.tables import new_path
from marquee.operators.vector_index import VectorIndex
from marquee.plans.registry import Tables, query

#: A fixed query vector of the table's 64 dimensions.
QUERY = [round(((i * 37) % 64 - 31.5) / 32, 4) for i in range(64)]
_Q = "[" + ", ".join(map(str, QUERY)) + "]::double[]"
_SIM = f"least(greatest(list_cosine_similarity(embedding::double[], {_Q}), 0), 1)"


def scored(t: Tables) -> DataFrame:
    literal = F.array(*[F.lit(x) for x in QUERY])
    return t.embeddings.select("vec_id", "label", F.bround(ve.cosine(F.col("embedding"), literal), 6).alias("similarity"))


_SCORED = f"(select vec_id, label, round_even({_SIM}, 6) as similarity from embeddings)"


@query("topk_vector", f"select vec_id, label, similarity from {_SCORED} order by similarity desc, vec_id limit 20")
def topk_vector(t: Tables) -> DataFrame:
    found = ve.search(t.embeddings, "embedding", "vec_id", QUERY, 20)
    return found.withColumn("similarity", F.bround("similarity", 6))


def _index(t: Tables) -> VectorIndex:
    return VectorIndex.build(t.embeddings, "vec_id", "embedding", new_path(t.embeddings.sparkSession, "index"), dims=64, keep=("label",))


_ALL_PAIRS = "select q.vec_id as query_id, e.vec_id, round(least(greatest(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 0), 1), 6) as similarity, row_number() over (partition by q.vec_id order by least(greatest(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 0), 1) desc, e.vec_id) as r from embeddings e, embeddings q where q.vec_id % 100 = 0"


@query("topk_vector_index", f"select query_id, vec_id, similarity from ({_ALL_PAIRS}) where r <= 20")
def topk_vector_index(t: Tables) -> DataFrame:
    """The 20 nearest of every hundredth vector, exactly, over an index of all rows."""
    asked = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = _index(t).search(asked, 20)
    return found.select("query_id", F.col("key").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


@query("topk_vector_filtered", f"select query_id, vec_id, similarity from ({_ALL_PAIRS.replace('where', 'where e.label in (1, 3) and')}) where r <= 5")
def topk_vector_filtered(t: Tables) -> DataFrame:
    """As before among two labels, a condition that the scan of the lists is given."""
    asked = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = _index(t).search(asked, 5, only=F.col("label").isin(1, 3))
    return found.select("query_id", F.col("key").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


@query("fn_cosine", f"select vec_id, similarity from {_SCORED}")
def fn_cosine(t: Tables) -> DataFrame:
    return scored(t).select("vec_id", "similarity")


@query(
    "win_topn_per_source",
    f"select vec_id, label, similarity from (select *, row_number() over (partition by label order by similarity desc, vec_id) r from {_SCORED}) where r <= 3 order by similarity desc, vec_id limit 15",
)
def win_topn_per_source(t: Tables) -> DataFrame:
    capped = rk.top_per_key(scored(t), ["label"], [F.desc("similarity"), "vec_id"], 3)
    return capped.orderBy(F.desc("similarity"), "vec_id").limit(15)


@query("win_cap5_per_source", f"select vec_id, label, similarity from (select *, row_number() over (partition by label order by similarity desc, vec_id) r from {_SCORED}) where r <= 5")
def win_cap5_per_source(t: Tables) -> DataFrame:
    return rk.top_per_key(scored(t), ["label"], [F.desc("similarity"), "vec_id"], 5)


@query("win_corpus_refs", f"select vec_id, label, similarity from (select *, row_number() over (partition by label order by similarity desc, vec_id) r from {_SCORED} where similarity >= 0.1) where r <= 3")
def win_corpus_refs(t: Tables) -> DataFrame:
    return rk.top_per_key(scored(t).where("similarity >= 0.1D"), ["label"], [F.desc("similarity"), "vec_id"], 3)


@query("win_entity_cap", f"select vec_id, label from (select *, row_number() over (partition by label order by similarity desc, vec_id) r from {_SCORED}) where r <= 4")
def win_entity_cap(t: Tables) -> DataFrame:
    return rk.top_per_key(scored(t), ["label"], [F.desc("similarity"), "vec_id"], 4).select("vec_id", "label")


@query("filt_min_similarity", f"select vec_id, least(1, similarity + 0.024 * (5 - label % 6))::double as score from {_SCORED} where least(1, similarity + 0.024 * (5 - label % 6)) >= 0.2")
def filt_min_similarity(t: Tables) -> DataFrame:
    score = F.least(F.lit(1.0), F.col("similarity") + 0.024 * (5 - F.col("label") % 6))
    return scored(t).select("vec_id", score.alias("score")).where("score >= 0.2D")


@query("lk_story_search", f"select vec_id, similarity from {_SCORED} where label = 3 order by similarity desc, vec_id limit 10")
def lk_story_search(t: Tables) -> DataFrame:
    return scored(t).where("label = 3").select("vec_id", "similarity").orderBy(F.desc("similarity"), "vec_id").limit(10)


@query("lk_feeder_search", f"select vec_id, label, similarity from {_SCORED} where label in (1, 2) and similarity >= 0.05 order by similarity desc, vec_id limit 10")
def lk_feeder_search(t: Tables) -> DataFrame:
    return scored(t).where("label in (1, 2) and similarity >= 0.05D").orderBy(F.desc("similarity"), "vec_id").limit(10)


@query("cmp_dim_check", "select len(embedding)::bigint as dim, count(*) as n, len(embedding) = 64 as ok from embeddings group by 1, 3")
def cmp_dim_check(t: Tables) -> DataFrame:
    return t.embeddings.groupBy(F.size("embedding").cast("long").alias("dim")).agg(F.count("*").alias("n")).withColumn("ok", F.col("dim") == 64)


_HASH = "list_reduce(list_transform(range(64), lambda i: case when embedding[i + 1] > 0 then (1::hugeint << i) else 0::hugeint end), lambda a, b: a + b)"


@query(
    "join_phash_near_dup",
    f"""with o as (select vec_id, {_HASH} as h from embeddings),
    h as (select * from o union all select vec_id + 100000, xor(h, 5::hugeint) from o union all select vec_id + 200000, h from o where vec_id % 4 = 0),
    c as (select h, min(vec_id) as class_id from h group by h),
    p as (select a.class_id as class_id from c a join c b on a.class_id <> b.class_id and bit_count(xor(a.h, b.h)) <= 10)
    select vec_id, class_id, coalesce(n, 0) as n_links from h join c using (h) left join (select class_id, count(*) as n from p group by 1) using (class_id)""",
)
def join_phash_near_dup(t: Tables) -> DataFrame:
    """Each hash, a copy of it with two bits changed, and of every fourth an equal one."""
    rows = t.embeddings.select("vec_id", ve.sign_hash("embedding").alias("h"))
    changed = rows.select((F.col("vec_id") + 100000).alias("vec_id"), F.col("h").bitwiseXOR(F.lit(5)).alias("h"))
    equal = rows.where("vec_id % 4 = 0").select((F.col("vec_id") + 200000).alias("vec_id"), "h")
    return ve.near_hashes(rows.unionByName(changed).unionByName(equal), "vec_id", "h", 10)


@query("fn_hamming", f"with h as (select vec_id, {_HASH} as h from embeddings) select a.vec_id, bit_count(xor(a.h, b.h))::int as distance from h a, h b where b.vec_id = 0")
def fn_hamming(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", ve.sign_hash("embedding").alias("h"))
    first = rows.where("vec_id = 0").select(F.col("h").alias("h0"))
    return rows.crossJoin(F.broadcast(first)).select("vec_id", ve.hamming(F.col("h"), F.col("h0")).alias("distance"))


@query(
    "dedup_jaccard",
    """with d as (select doc_id, list_sort(list_distinct(list_transform(list_filter(string_split(lower(text), ' '), lambda w: w <> ''), lambda w: hash(w)))) as t from documents),
    c as (select t, min(doc_id) as class_id from d where len(t) > 0 group by t),
    p as (select a.class_id from c a join c b on a.class_id <> b.class_id and least(len(a.t), len(b.t)) >= 0.8 * greatest(len(a.t), len(b.t))
        where len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) > 0.8)
    select doc_id, coalesce(class_id, doc_id) as class_id, coalesce(n, 0) as n_links from d left join c using (t)
    left join (select class_id, count(*) as n from p group by 1) using (class_id)""",
)
def dedup_jaccard(t: Tables) -> DataFrame:
    tokens = F.filter(F.split(F.lower("text"), " "), lambda w: w != "")
    return ve.near_token_sets(t.documents, "doc_id", tokens, 0.8)


@query(
    "rerank_boost",
    """select doc_id, round(least(1.0::double, 0.3::double + greatest(0, (6 - (doc_id % 6 + 1)) * 0.024) + case when contains(text, 'tion') then 0.03 else 0 end
    + case source when 'src1' then 0.06 when 'src2' then 0.04 else 0 end + case when lang = 'en' then 0.05 when lang = 'fr' then 0.03 else 0 end
    + case when doc_id % 4 = 0 then 0.04 else 0 end + case when doc_id % 5 = 0 then 0.03 else 0 end), 6) as score from documents""",
)
def rerank_boost(t: Tables) -> DataFrame:
    label = F.when(F.col("source") == "src1", "exchange").when(F.col("source") == "src2", "book").otherwise("")
    genre = F.when(F.col("lang") == "en", 0.05).when(F.col("lang") == "fr", 0.03).otherwise(0.0)
    score = rk.boosted(
        F.lit(0.3), F.col("doc_id") % 6 + 1, F.contains("text", F.lit("tion")), label, genre, F.col("doc_id") % 4 == 0, F.col("doc_id") % 5 == 0
    )
    return t.documents.select("doc_id", F.round(score, 6).alias("score"))


@query(
    "win_budget_prefix",
    "select doc_id, used from (select doc_id, sum(n_chars) over (order by n_chars, doc_id rows unbounded preceding)::bigint as used from documents where lang = 'es') where used <= 20000",
)
def win_budget_prefix(t: Tables) -> DataFrame:
    rows = t.documents.where("lang = 'es'").select("lang", "doc_id", "n_chars")
    return rk.within_budget(rows, ["lang"], ["n_chars", "doc_id"], "n_chars", 20000).select("doc_id", "used")


@query("win_running_section", "select user_id, event_id, sum((event_type = 'signup')::int) over (partition by user_id order by event_id rows unbounded preceding)::bigint as section from events")
def win_running_section(t: Tables) -> DataFrame:
    return rk.sections(t.events.select("user_id", "event_id", "event_type"), ["user_id"], "event_id", F.col("event_type") == "signup").drop("event_type")


@query("win_latest_active", "select user_id, event_id, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events where event_type <> 'error') where r = 1")
def win_latest_active(t: Tables) -> DataFrame:
    rows = t.events.where("event_type <> 'error'").select("user_id", "event_id", "value", "ts")
    return rk.top_per_key(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")], 1).drop("ts")


@query(
    "win_source_index",
    "select source, row_number() over (order by first) as idx from (select source, min(doc_id) as first from documents group by source)",
)
def win_source_index(t: Tables) -> DataFrame:
    """Numbers of sources by first occurrence; the sources are aggregated before they are ordered."""
    firsts = t.documents.groupBy("source").agg(F.min("doc_id").alias("first"))
    return rk.numbered(firsts, [], ["first"]).select("source", F.col("number").alias("idx"))


_MERGE = """select * from (select p_name as name, 0 as priority, p_size * 0.01 as strength, p_size as times from part where p_brand = 'Brand#1'
    union all select upper(p_name), 1, 0.9, 1 from part where p_brand in ('Brand#1', 'Brand#2') union all select p_type, 2, 0.5, 2 from part where p_brand = 'Brand#3')"""


@query(
    "win_merge_priority",
    f"""select name, priority, strength::double as strength, times from (select *, row_number() over (partition by lower(trim(name)) order by priority, strength desc, times desc, name) r
    from ({_MERGE})) where r = 1 order by priority, strength desc, times desc, name limit 10""",
)
def win_merge_priority(t: Tables) -> DataFrame:
    a = t.part.where("p_brand = 'Brand#1'").select(F.col("p_name").alias("name"), F.lit(0).alias("priority"), (F.col("p_size") * 0.01).alias("strength"), F.col("p_size").alias("times"))
    b = t.part.where("p_brand in ('Brand#1', 'Brand#2')").select(F.upper("p_name").alias("name"), F.lit(1).alias("priority"), F.lit(0.9).alias("strength"), F.lit(1).alias("times"))
    c = t.part.where("p_brand = 'Brand#3'").select(F.col("p_type").alias("name"), F.lit(2).alias("priority"), F.lit(0.5).alias("strength"), F.lit(2).alias("times"))
    return rk.merge_by_priority(a.unionByName(b).unionByName(c), "name", "priority", "strength", "times", 10)


@query(
    "win_best_ocr",
    """select l_orderkey, coalesce(arg_min(l_linenumber, (l_linenumber, l_partkey)) filter (l_discount >= 0.08), arg_max(l_linenumber, (l_discount, -l_linenumber, -l_partkey))) as best
    from lineitem group by 1""",
)
def win_best_ocr(t: Tables) -> DataFrame:
    good = F.when(F.col("l_discount") >= 0.08, F.struct("l_linenumber", "l_partkey"))
    best = F.coalesce(F.min(good)["l_linenumber"], F.max_by("l_linenumber", F.struct("l_discount", -F.col("l_linenumber"), -F.col("l_partkey"))))
    return t.lineitem.groupBy("l_orderkey").agg(best.alias("best"))


@query("win_batch_of_n", "select event_id, ((row_number() over (partition by event_type order by ts, event_id)) - 1) // 8 as batch from events")
def win_batch_of_n(t: Tables) -> DataFrame:
    rows = rk.numbered(t.events.select("event_id", "event_type", "ts"), ["event_type"], ["ts", "event_id"])
    return rows.select("event_id", F.floor((F.col("number") - 1) / 8).alias("batch"))


@query(
    "agg_tag_union",
    """select event_type, batch, min(ts) as first_ts, max(ts) as last_ts, array_to_string(list_sort(list(distinct user_id)), ',') as tags from
    (select *, ((row_number() over (partition by event_type order by ts, event_id)) - 1) // 8 as batch from events) group by 1, 2""",
)
def agg_tag_union(t: Tables) -> DataFrame:
    rows = rk.numbered(t.events.select("event_id", "event_type", "ts", "user_id"), ["event_type"], ["ts", "event_id"])
    rows = rows.select("event_type", "ts", "user_id", F.floor((F.col("number") - 1) / 8).alias("batch"))
    tags = F.transform(F.sort_array(F.collect_set("user_id")), lambda x: x.cast("string"))
    return rows.groupBy("event_type", "batch").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.array_join(tags, ",").alias("tags"))


@query(
    "topk_supplement",
    """with main as (select doc_id, source from documents where lang = 'es' and source = 'src7')
    select doc_id, source, false as supplement from main union all select doc_id, source, true from documents
    where (select count(*) from main) between 1 and 14 and lang = 'en' and source not in (select source from main)""",
)
def topk_supplement(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "source", "lang")
    main = docs.where("lang = 'es' and source = 'src7'")
    few = main.agg(F.count("*").between(1, 14).alias("few")).where("few").drop("few")
    more = docs.where("lang = 'en'").join(main.select("source").distinct(), "source", "left_anti").crossJoin(F.broadcast(few))
    pick = lambda df, flag: df.select("doc_id", "source", F.lit(flag).alias("supplement"))
    return pick(main, False).unionByName(pick(more, True))


@query(
    "topk_synthesis_context",
    """with r as (select doc_id, lang, row_number() over (partition by lang = 'es' order by n_chars desc, doc_id) r from documents)
    select doc_id, lang from r where (lang <> 'es' and r <= 8) or (lang = 'es' and r <= 3)""",
)
def topk_synthesis_context(t: Tables) -> DataFrame:
    order = [F.desc("n_chars"), "doc_id"]
    rows = t.documents.select("doc_id", "lang", "n_chars")
    main, events = rows.where("lang <> 'es'").orderBy(*order).limit(8), rows.where("lang = 'es'").orderBy(*order).limit(3)
    return main.unionByName(events).select("doc_id", "lang")


@query(
    "join_query_broadcast_filters",
    """with tiers as (select doc_id, source, case lang when 'en' then 1 when 'fr' then 2 else 3 end as tier from documents)
    select doc_id, source, tier from (select *, min(tier) over (partition by source) m from tiers) where tier = m""",
)
def join_query_broadcast_filters(t: Tables) -> DataFrame:
    tier = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "fr", 2).otherwise(3)
    return rk.unseen_by_tier(t.documents.select("doc_id", "source", tier.alias("tier")), "source", "tier")


@query(
    "cmp_recommend",
    """with mates as (select l_partkey as artist, 1 as tier, least(1.0, count(distinct l_suppkey) * 0.3 + 0.2) as strength from lineitem
        where l_suppkey in (select l_suppkey from lineitem where l_partkey in (1, 2)) and l_partkey not in (1, 2) group by 1),
    fliers as (select l_partkey as artist, 0 as tier, least(1.0, count(distinct l_orderkey) * 0.2 + 0.3) as strength from lineitem
        where l_orderkey in (select l_orderkey from lineitem where l_partkey in (1, 2)) and l_partkey not in (1, 2) group by 1),
    u as (select *, row_number() over (partition by artist order by tier, strength desc) r from (select * from mates union all select * from fliers))
    select artist, tier, strength::double as strength from u where r = 1 order by tier, strength desc, artist limit 10""",
)
def cmp_recommend(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_suppkey", F.col("l_partkey").alias("artist"))
    seeds = F.col("artist").isin(1, 2)

    def candidates(via: str, tier: int, factor: float, base: float) -> DataFrame:
        mine = lines.where(seeds).select(via).distinct()
        met = lines.where(~seeds).join(mine, via, "left_semi").groupBy("artist").agg(F.count_distinct(via).alias("n"))
        return met.select("artist", F.lit(tier).alias("tier"), F.least(F.lit(1.0), F.col("n") * factor + base).alias("strength"))

    every = candidates("l_suppkey", 1, 0.3, 0.2).unionByName(candidates("l_orderkey", 0, 0.2, 0.3))
    best = rk.top_per_key(every, ["artist"], ["tier", F.desc("strength")], 1)
    return best.orderBy("tier", F.desc("strength"), "artist").limit(10)
