"""Scalar and table functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions import dates as da
from marquee.functions import domain as do
from marquee.functions import names as na
from marquee.functions import periods as pe
from marquee.functions import scores as sc
from marquee.functions import text as tx
from marquee.functions import urls as ur
from marquee.operators import dictionary as di
from marquee.operators import fuzzy as fz
from marquee.operators import graph as gr
from marquee.operators import history as hi
from marquee.operators.tables import new_path
from marquee.plans.registry import Tables, query

_INITCAP = "array_to_string(list_transform(string_split(x, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


@query("fn_normalize_name", f"select p_partkey, {_INITCAP} as name from (select p_partkey, p_name as x from part)")
def fn_normalize_name(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", na.normalize_name(F.concat(F.lit("  dj   "), F.upper("p_name"), F.lit(" "))).alias("name"))


@query(
    "fn_split_artists",
    """select p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array(p_name || ' b2b ' || p_type || ', ' || p_brand || ' feat. X',
    '(?i)\\s+b2b\\s+|\\s+feat\\.?\\s+|,\\s*'), lambda x: trim(x)), lambda x: x <> ''), '|') as artists from part""",
)
def fn_split_artists(t: Tables) -> DataFrame:
    raw = F.concat("p_name", F.lit(" b2b "), "p_type", F.lit(", "), "p_brand", F.lit(" feat. X"))
    return t.part.select("p_partkey", F.array_join(na.split_artists(raw), "|").alias("artists"))


@query("fn_token_sort_ratio")
def fn_token_sort_ratio(t: Tables) -> DataFrame:
    names = t.part.select("p_partkey", "p_name", F.concat_ws(" ", "p_type", F.reverse(F.split("p_name", " "))[0]).alias("other"))
    return names.select("p_partkey", na.token_sort_ratio_udf("p_name", "other").alias("ratio"))


@query(
    "fn_fuzz_ratio",
    "select p_partkey, case when greatest(length(p_name), length(p_brand)) = 0 then 1.0 else 1 - levenshtein(p_name, p_brand) / greatest(length(p_name), length(p_brand)) end as ratio from part",
)
def fn_fuzz_ratio(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", na.edit_ratio(F.col("p_name"), F.col("p_brand")).alias("ratio"))


@query(
    "join_fuzzy",
    """with k as (select distinct p_name from part), a as (select distinct p_name || 's' as name from part),
    s as (select name, p_name as best, 1 - levenshtein(name, p_name) / greatest(length(name), length(p_name)) as ratio from a, k),
    m as (select * from (select *, row_number() over (partition by name order by ratio desc, best) r from s) where r = 1 and ratio >= 0.8)
    select p_partkey, best, ratio from part join m on name = p_name || 's'""",
)
def join_fuzzy(t: Tables) -> DataFrame:
    """Every name is matched with all known ones, whatever they begin with."""
    asked = t.part.select("p_partkey", F.concat("p_name", F.lit("s")).alias("name"))
    return asked.join(fz.best_matches(asked, t.part.select(F.col("p_name").alias("name")), 0.8), "name").select("p_partkey", "best", "ratio")


def openings(t: Tables) -> DataFrame:
    """(id, name): the first three words of every turn of a conversation, names whose number
    grows with the table; letters beyond ASCII are one mark, as the SQL's distance counts bytes."""
    first = F.regexp_replace(F.regexp_extract(F.lower("text"), r"^\s*(\S+(?:\s+\S+){0,2})", 1), r"[^\x20-\x7e]", "~")
    return t.conversations.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("id"), first.alias("name")).where("name <> ''")


_OPENINGS = r"""select conv_id * 1000000 + turn as id, regexp_replace(regexp_extract(lower(text), '^\s*(\S+(?:\s+\S+){0,2})', 1), '[^\x20-\x7e]', '~', 'g') as name
    from conversations"""


@query(
    "join_fuzzy_openings",
    f"""with o as (select * from ({_OPENINGS}) where name <> ''), k as (select distinct name from o),
    a as (select distinct substr(name, 1, 3) || substr(name, 5) as name from o),
    s as (select a.name, k.name as best, 1 - levenshtein(a.name, k.name) / greatest(length(a.name), length(k.name)) as ratio from a, k),
    m as (select * from (select *, row_number() over (partition by name order by ratio desc, best) r from s) where r = 1 and ratio >= 0.8)
    select id, best, ratio from o join m on m.name = substr(o.name, 1, 3) || substr(o.name, 5)""",
)
def join_fuzzy_openings(t: Tables) -> DataFrame:
    """Openings with their fourth letter lost, matched with all openings there are."""
    known = openings(t)
    asked = known.select("id", F.concat(F.substring("name", 1, 3), F.substring("name", 5, 1 << 20)).alias("name"))
    return asked.join(fz.best_matches(asked, known, 0.8), "name").select("id", "best", "ratio")


@query("resolve_openings")
def resolve_openings(t: Tables) -> DataFrame:
    """Openings of turns resolved in order of the turns."""
    return gr.resolve(openings(t), "name", "id", 0.8).select("id", "name", "canonical")


@query("join_token_sort")
def join_token_sort(t: Tables) -> DataFrame:
    """Names with their words in another order and a letter misread, matched by their sorted words."""
    read = F.regexp_replace(F.concat_ws(" ", F.reverse(F.split("p_name", " "))), "l", "1")
    asked = t.part.select("p_partkey", gr.sorted_words(read).alias("name"))
    known = t.part.select(gr.sorted_words(F.col("p_name")).alias("name"))
    return asked.join(fz.best_matches(asked, known, 0.8, "indel"), "name").select("p_partkey", "best", "ratio")


@query(
    "fn_detect_period",
    """select o_orderkey, case o_orderkey % 5 when 0 then '1988-1992' when 1 then case when year(o_orderdate) % 100 >= 50 then '19' else '20' end || substr(year(o_orderdate)::varchar, 3, 1) || '0s'
    when 2 then year(o_orderdate) || '-' || (year(o_orderdate) + 2) when 3 then year(o_orderdate)::varchar end as period from orders""",
)
def fn_detect_period(t: Tables) -> DataFrame:
    year = F.year("o_orderdate")
    kind = F.col("o_orderkey") % 5
    text = (
        F.when(kind == 0, F.lit("the Early Rave years"))
        .when(kind == 1, F.concat(F.lit("back in the "), F.substring(year.cast("string"), 3, 1), F.lit("0s")))
        .when(kind == 2, F.concat(F.lit("from "), year, F.lit(" – "), year + 2))
        .when(kind == 3, F.concat(F.lit("in "), year, F.lit(".")))
        .otherwise(F.lit("no date"))
    )
    return t.orders.select("o_orderkey", pe.detect_period(text).alias("period"))


@query(
    "fn_parse_period",
    """select o_orderkey, case o_orderkey % 4 when 0 then y // 10 * 10 when 3 then null else y end as start_year,
    case o_orderkey % 4 when 0 then y // 10 * 10 + 9 when 1 then y + 3 when 2 then y end as end_year from (select o_orderkey, year(o_orderdate) as y from orders)""",
)
def fn_parse_period(t: Tables) -> DataFrame:
    year, kind = F.year("o_orderdate"), F.col("o_orderkey") % 4
    text = (
        F.when(kind == 0, F.concat(F.substring(year.cast("string"), 1, 3), F.lit("0s")))
        .when(kind == 1, F.concat(year, F.lit("-"), year + 3))
        .when(kind == 2, year.cast("string"))
        .otherwise(F.lit("junk 1994"))
    )
    found = t.orders.select("o_orderkey", pe.parse_period(text).alias("p"))
    return found.select("o_orderkey", F.col("p.start").cast("long").alias("start_year"), F.col("p.end").cast("long").alias("end_year"))


@query("fn_count_tokens", "select doc_id, length(text)::bigint // 4 as tokens from documents")
def fn_count_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.count_tokens(F.col("text")).alias("tokens"))


@query("fn_split_paragraphs", "select doc_id, len(list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\\n\\s*\\n'), lambda p: trim(p)), lambda p: p <> ''))::bigint as n from documents")
def fn_split_paragraphs(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(tx.split_paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")))).cast("long").alias("n"))


@query("fn_truncate_tokens", "select doc_id, case when length(text) <= 300 then text else regexp_replace(substr(text, 1, 300), '\\s\\S*\\z', '') end as head from documents")
def fn_truncate_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.truncate_chars(F.col("text"), 300).alias("head"))


@query("fn_chunk")
def fn_chunk(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("doc_id").alias("source_id"), "text")
    chunks = rows.mapInArrow(tx.chunk_batches, "source_id long, ordinal int, chunk string")
    return chunks.withColumn("chunk_id", F.sha2(F.concat_ws("|", "source_id", "ordinal"), 256))


@query("fn_sha256", "select page_id, sha256(url) as id from pages")
def fn_sha256(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.sha2("url", 256).alias("id"))


@query(
    "fn_js_hash",
    """select p_partkey, lpad(lower(to_hex(abs(case when h >= 2147483648 then h - 4294967296 else h end))), 8, '0') as h from
    (select p_partkey, list_reduce(list_prepend(0::bigint, list_transform(string_split(p_name, ''), lambda c: ord(c)::bigint)), lambda a, c: (a * 31 + c) & 4294967295) as h from part)""",
)
def fn_js_hash(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", tx.rolling_hash(F.col("p_name")).alias("h"))


@query(
    "fn_citation_tier",
    f"""select page_id, {ur.first_match_sql("u", ur.CITATION_TIERS, 1, 5)} as citation, {ur.first_match_sql("u", ur.RESEARCH_TIERS, 1, 6)} as research,
    {ur.first_match_sql("u", ur.ARTICLE_TIERS, 1, "article")} as kind from (select page_id, url || (case page_id % 6 when 0 then '/djmag.com' when 1 then '/discogs.com/forum'
    when 2 then '/ra.co' when 3 then '/en.wikipedia.org' when 4 then '/x.com' else '' end) as u from pages)""",
)
def fn_citation_tier(t: Tables) -> DataFrame:
    parts = ["/djmag.com", "/discogs.com/forum", "/ra.co", "/en.wikipedia.org", "/x.com", ""]
    url = F.concat("url", F.get(F.array(*[F.lit(p) for p in parts]), (F.col("page_id") % 6).cast("int")))
    return t.pages.select(
        "page_id", ur.first_match(url, ur.CITATION_TIERS, 1, 5).alias("citation"),
        ur.first_match(url, ur.RESEARCH_TIERS, 1, 6).alias("research"), ur.first_match(url, ur.ARTICLE_TIERS, 1, "article").alias("kind"),
    )


@query(
    "fn_confidence_level",
    """select l_orderkey, l_linenumber, l_partkey, case when l_discount * 10 >= 0.8 then 'high' when l_discount * 10 >= 0.5 then 'medium' when l_discount * 10 >= 0.3 then 'low' else 'uncertain' end as four,
    case when l_discount * 10 >= 0.8 then 'very_high' when l_discount * 10 >= 0.6 then 'high' when l_discount * 10 >= 0.4 then 'medium' when l_discount * 10 >= 0.2 then 'low' else 'very_low' end as five from lineitem""",
)
def fn_confidence_level(t: Tables) -> DataFrame:
    score = F.col("l_discount") * 10
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", sc.level_of(score, *sc.FOUR_LEVELS).alias("four"), sc.level_of(score, *sc.FIVE_LEVELS).alias("five"))


@query("fn_merge_confidence", "select l_orderkey, l_linenumber, l_partkey, round(least(greatest(l_discount * (1 - least(l_tax * 20, 1)) + 0.9 * least(l_tax * 20, 1), 0), 1), 6) as c from lineitem")
def fn_merge_confidence(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(sc.blend(F.col("l_discount"), F.lit(0.9), F.col("l_tax") * 20), 6).alias("c"))


@query(
    "fn_edge_adjust",
    """select l_orderkey, l_linenumber, l_partkey, round(case l_linestatus when 'O' then greatest(0, b - 0.4) else greatest(0, b - 0.2) end, 6) as c from
    (select *, case when l_linenumber = 1 then greatest(a, 0.6) else a end as b from (select *, case when l_returnflag = 'R' then greatest(0, l_discount * 10 - 0.3) else l_discount * 10 end as a from lineitem))""",
)
def fn_edge_adjust(t: Tables) -> DataFrame:
    mismatch = F.when(F.col("l_linestatus") == "O", "both").otherwise("one")
    c = sc.adjusted_edge(F.col("l_discount") * 10, F.col("l_returnflag") == "R", F.col("l_linenumber") == 1, mismatch)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(c, 6).alias("c"))


@query("fn_parse_date", "select o_orderkey, case when o_orderkey % 7 < 6 then strftime(o_orderdate, '%Y-%m-%d') end as d from orders")
def fn_parse_date(t: Tables) -> DataFrame:
    """Dates as fliers print them, within other text."""
    kind, at = F.col("o_orderkey") % 7, F.col("o_orderdate")
    text = (
        F.when(kind == 0, F.concat(F.date_format(at, "EEEE, MMMM d"), F.lit("th, "), F.year(at), F.lit(" at the hall, 10pm")))
        .when(kind == 1, F.concat(F.lit("doors "), F.date_format(at, "M/d/yyyy")))
        .when(kind == 2, F.date_format(at, "yyyy-MM-dd"))
        .when(kind == 3, F.concat(F.lit("live: "), F.date_format(at, "M/d/yy"), F.lit(", all night")))
        .when(kind == 4, F.concat(F.lit("Sat "), F.date_format(at, "d MMM yyyy")))
        .when(kind == 5, F.concat(F.lit("am "), F.date_format(at, "dd.MM.yy")))
        .otherwise(F.lit("soon, 99/99/2024"))
    )
    return t.orders.select("o_orderkey", F.date_format(da.parse_date(text), "yyyy-MM-dd").alias("d"))


@query("fn_city_hint", "select c_custkey, 'City ' || c_nationkey as city from customer")
def fn_city_hint(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", tx.city_hint(F.concat("c_name", F.lit(" - Hall, City "), "c_nationkey")).alias("city"))


@query("fn_domain", "select page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', '') as domain from pages")
def fn_domain(t: Tables) -> DataFrame:
    return t.pages.select("page_id", ur.domain(F.col("url")).alias("domain"))


@query(
    "fn_snippet",
    """select doc_id, case when length(s) <= 500 then s else regexp_replace(substr(s, 1, 500), '\\s\\S*\\z', '') end as snippet from (select doc_id, array_to_string(list_filter(
    string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: contains(lower(s), 'tion') or contains(lower(s), 'sch')), ' ') as s from documents)""",
)
def fn_snippet(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.snippet(F.col("text"), ["tion", "Sch"]).alias("snippet"))


@query("fn_parse_event_block", "select event_id, event_type as title, strftime(ts, '%Y-%m-%d') as event_date from events")
def fn_parse_event_block(t: Tables) -> DataFrame:
    block = F.concat(F.lit("Event: "), "event_type", F.lit("\nDate: "), F.date_format("ts", "yyyy-MM-dd"), F.lit("\nId: "), "event_id")
    path = new_path(t.events.sparkSession, "blocks")
    t.events.select(F.concat(block, F.lit("\n---\n")).alias("value")).write.text(path)
    # blocks are records of the files: a listing of any length is read by many tasks
    one = t.events.sparkSession.read.option("lineSep", "\n---\n").text(path).select(F.col("value").alias("b"))
    field = lambda k: F.regexp_extract("b", rf"(?m)^{k}: (.*)$", 1)
    return one.where(F.col("b").contains("Id: ")).select(field("Id").cast("long").alias("event_id"), field("Event").alias("title"), field("Date").alias("event_date"))


@query("fn_parse_llm_json", "select event_id, json_extract_string(props, '$.k')::bigint as k from events")
def fn_parse_llm_json(t: Tables) -> DataFrame:
    reply = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("Result "), "props", F.lit(" ok")))
    return t.events.select("event_id", F.from_json(tx.outer_json(reply), "k long")["k"].alias("k"))


@query("fn_parse_sections", "select s_suppkey, s_name as history, 'Nation ' || s_nationkey as events from supplier")
def fn_parse_sections(t: Tables) -> DataFrame:
    reply = F.concat(F.lit("HISTORY: "), "s_name", F.lit("\nNOTABLE_EVENTS:\nNation "), "s_nationkey", F.lit("\n"))
    section = lambda k: F.trim(F.regexp_replace(F.regexp_extract("r", rf"(?is){k}:\s*(.*?)(?=\n[A-Z_]+:|\z)", 1), r"\s+$", ""))
    return t.supplier.select("s_suppkey", reply.alias("r")).select("s_suppkey", section("HISTORY").alias("history"), section("NOTABLE_EVENTS").alias("events"))


@query("fn_clean_markup", "select p_partkey, p_name || ' on ' || p_brand || ' is bold see site' as prose from part")
def fn_clean_markup(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("[a="), "p_name", F.lit("] on  [l="), "p_brand", F.lit("] is [b]bold[/b] [r=12][a674] see [url=http://x]site[/url] "))
    return t.part.select("p_partkey", tx.clean_markup(raw).alias("prose"))


@query("fn_match_clusters", "select p_partkey, array_to_string(list_filter(['small', 'large'], lambda k: (k = 'small' and p_type in ('SMALL', 'ECONOMY')) or (k = 'large' and p_type in ('LARGE', 'ECONOMY'))), ',') as clusters from part")
def fn_match_clusters(t: Tables) -> DataFrame:
    clusters = {"small": ["SMALL", "ECONOMY"], "large": ["LARGE", "ECONOMY"]}
    hit = [F.when(F.arrays_overlap(F.array("p_type"), F.array(*[F.lit(s) for s in styles])), F.lit(k)) for k, styles in clusters.items()]
    return t.part.select("p_partkey", F.array_join(F.array_compact(F.array(*hit)), ",").alias("clusters"))


@query("fn_release_artist", "select p_partkey, p_brand as artist from part")
def fn_release_artist(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.split(F.concat("p_brand", F.lit(" - "), "p_name", F.lit(" - live")), " - ", 2)[0].alias("artist"))


@query("fn_filename_meta", "select page_id, 'Title ' || page_id as title, 'Author' as author, case when page_id % 2 = 0 then 1990 + page_id % 30 else 2000 end as year from pages")
def fn_filename_meta(t: Tables) -> DataFrame:
    year = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" -- "), 1990 + F.col("page_id") % 30)).otherwise("")
    name = F.concat(F.lit("Title "), "page_id", F.lit(" -- Author"), year, F.lit(".txt"))
    parts = F.split(F.regexp_replace(name, r"\.\w+$", ""), " -- ")
    found = F.coalesce(F.try_to_number(F.get(parts, 2), F.lit("9999")).cast("long"), F.lit(2000).cast("long"))
    return t.pages.select("page_id", parts[0].alias("title"), parts[1].alias("author"), found.alias("year"))


@query("fn_sanitize_html", "select page_id, trim(regexp_replace(html, '<[^>]+>', '', 'g'), ' ') as text from pages")
def fn_sanitize_html(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.strip_tags(F.col("html")).alias("text"))


@query("fn_redact", "select doc_id, replace(replace(text, 'the', '[REDACTED]'), 'que', '[REDACTED]') as text from documents")
def fn_redact(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.redact(F.col("text"), F.array(F.lit("the"), F.lit("x"), F.lit("que"))).alias("text"))


@query("fn_story_validate", "select doc_id, len(string_split(text, ' ')) >= 10 and length(text) <= 15000 and source is not null as valid from documents")
def fn_story_validate(t: Tables) -> DataFrame:
    valid = (F.size(F.split("text", " ")) >= 10) & (F.length("text") <= 15000) & F.col("source").isNotNull()
    return t.documents.select("doc_id", valid.alias("valid"))


@query("fn_cache_key", "select doc_id, substr(sha256(lower(trim(source)) || '|' || lower(trim(lang))), 1, 32) as k from documents")
def fn_cache_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.cache_key(F.col("source"), F.col("lang")).alias("k"))


GENRES = ("techno", "detroit techno", "house", "acid house", "dub", "dub techno", "house techno club")
_LONGEST = sorted(GENRES, key=lambda g: (-len(g), g))


def _genres_sql() -> str:
    """Longest first, each taken out before the next is looked for (twice, as neighbours share a space)."""
    steps, found = "select doc_id, lower(x) as t0 from named", []
    for k, g in enumerate(_LONGEST):
        hit = rf"(^|[^\p{{L}}\p{{N}}]){g}($|[^\p{{L}}\p{{N}}])"
        out = f"t{k}"
        for _ in range(2):
            out = rf"regexp_replace({out}, '{hit}', '\1' || chr(1) || '\2', 'g')"
        steps = f"select *, regexp_matches(t{k}, '{hit}') as f{k}, {out} as t{k + 1} from ({steps})"
        found.append(f"case when f{k} then '{g}' end")
    return f"""with named as (select doc_id, text || ' ' || (['', 'Acid House, house', 'DETROIT techno dub techno', 'warehouse house techno club', 'dub house'])[doc_id % 5 + 1] as x from documents)
    select doc_id, array_to_string(list_sort(list_filter([{", ".join(found)}], lambda g: g is not null)), ',') as genres from ({steps})"""


@query("fn_extract_genres", _genres_sql())
def fn_extract_genres(t: Tables) -> DataFrame:
    more = ["", "Acid House, house", "DETROIT techno dub techno", "warehouse house techno club", "dub house"]
    text = F.concat_ws(" ", "text", F.get(F.array(*[F.lit(m) for m in more]), (F.col("doc_id") % 5).cast("int")))
    return t.documents.select("doc_id", F.array_join(do.extract_genres(text, list(GENRES)), ",").alias("genres"))


_NAMED = "['red', 'widget', 'small ring', 'the', 'the and', 'de la', 'que de la', 'der die', 'and the', 'of the', 'en el']"


@query(
    "fn_dictionary_names",
    rf"""with recursive cut as materialized (select doc_id, regexp_extract_all(lower(coalesce(text, '') || ' ' || p_name), '[\p{{L}}\p{{N}}]+') as t
        from documents join part on p_partkey = doc_id % 200 + 1),
    known as materialized (select distinct name, regexp_extract_all(lower(name), '[\p{{L}}\p{{N}}]+') as w from (select unnest({_NAMED}) as name union all select p_name from part)),
    m as materialized (select doc_id, i as start, len(w)::int as length, name from (select doc_id, t, unnest(range(0, len(t)))::int as i from cut) join known on t[i + 1] = w[1] and t[i + 1 : i + len(w)] = w),
    walk as (select doc_id, min((start, -length, name)) as x from m group by doc_id
        union all select m.doc_id, min((m.start, -m.length, m.name)) from walk join m on m.doc_id = walk.doc_id and m.start >= x[1] - x[2] group by m.doc_id)
    select doc_id, count(*) as n_names, string_agg(x[3], ',' order by x[1]) as names from walk where x is not null group by 1""",
)
def fn_dictionary_names(t: Tables) -> DataFrame:
    """All part names and some phrases in all texts: joined by n-grams, leftmost and longest first."""
    named = F.explode(F.array(*[F.lit(n) for n in _NAMED.strip("[]").replace("'", "").split(", ")]))
    names = t.part.select(F.col("p_name").alias("name")).unionByName(t.part.sparkSession.range(1).select(named.alias("name"))).distinct()
    docs = t.documents.join(t.part, F.col("p_partkey") == F.col("doc_id") % 200 + 1).select("doc_id", F.concat_ws(" ", F.coalesce("text", F.lit("")), "p_name").alias("text"))
    found = di.extract_names(docs, "doc_id", "text", names, "name")
    ordered = F.array_sort(F.collect_list(F.struct("start", "name")))
    return found.groupBy(F.col("key").alias("doc_id")).agg(F.count("*").alias("n_names"), F.array_join(F.transform(ordered, lambda x: x["name"]), ",").alias("names"))


@query(
    "fn_expand_aliases",
    """with al as (select n_name as canonical, 'N' || n_nationkey as alias from nation where n_regionkey = 1 union all select n_name, 'Land ' || n_nationkey from nation where n_regionkey = 1)
    select n_nationkey, coalesce((select string_agg(x, ',' order by x) from (select canonical as x from al where canonical = n_name union select alias from al where canonical = n_name)),
    case when n_nationkey % 2 = 0 then n_name else 'n' || n_nationkey end) as names from nation""",
)
def fn_expand_aliases(t: Tables) -> DataFrame:
    """Every second nation is asked by its name, the others by an alias in lower case."""
    own = t.nation.where("n_regionkey = 1")
    aliases = own.select(F.col("n_name").alias("canonical"), F.concat(F.lit("N"), "n_nationkey").alias("alias"))
    aliases = aliases.unionByName(own.select(F.col("n_name").alias("canonical"), F.concat(F.lit("Land "), "n_nationkey").alias("alias")))
    asked = t.nation.select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lit("n"), "n_nationkey")).alias("asked"))
    return do.expand_aliases(asked, "asked", aliases).select("n_nationkey", F.array_join("names", ",").alias("names"))


@query(
    "fn_adjacent_genres",
    """with nb as (select distinct p_type as genre, p_brand as neighbour from part where p_type <> 'PROMO')
    select p_type as genre, coalesce(string_agg(neighbour, ',' order by neighbour), '') as adjacent from (select distinct p_type from part) left join nb on genre = p_type group by 1""",
)
def fn_adjacent_genres(t: Tables) -> DataFrame:
    """The table has the brands of a type as its neighbours; one type is not in it."""
    neighbours = t.part.where("p_type <> 'PROMO'").select(F.lower("p_type").alias("genre"), F.col("p_brand").alias("neighbour"))
    found = do.adjacent_genres(t.part.select(F.concat(F.lit(" "), "p_type").alias("g")).distinct(), "g", neighbours)
    return found.select(F.trim("genre").alias("genre"), F.array_join("adjacent", ",").alias("adjacent"))


SCENES = {"auto": ["Detroit", "Windsor"], "house": ["Chicago", "Detroit"], "build": ["Berlin"], "household": ["Leeds"]}


@query(
    "fn_scene_geo",
    "select c_custkey, array_to_string(list_sort(list_distinct(flatten(["
    + ", ".join(f"case when contains(lower(c_mktsegment), '{s}') then {c} else [] end" for s, c in SCENES.items())
    + "]))), ',') as cities from customer",
)
def fn_scene_geo(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.array_join(do.scene_cities(F.col("c_mktsegment"), SCENES), ",").alias("cities"))


@query(
    "fn_is_artist_query",
    "select doc_id, regexp_matches(text, '(?i)^(?:who is|the )') or lower(trim(text)) in ('tion', 'thention') or contains(lower(trim(text)), 'thention') as hit from documents",
)
def fn_is_artist_query(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", do.is_artist_query(F.col("text"), r"(?i)^(?:who is|the )", ["Tion", "Thention"]).alias("hit"))


_RAW = "'[00:15:22]' || text || '(1:05)[LAUGHTER]'"


@query("fn_preprocess_transcript", f"select conv_id, turn, regexp_replace({tx.replace_all_sql(_RAW, tx.TRANSCRIPT)}, '^\\s+|\\s+$', '', 'g') as text from conversations")
def fn_preprocess_transcript(t: Tables) -> DataFrame:
    marked = F.concat(F.lit("[00:15:22]"), "text", F.lit("(1:05)[LAUGHTER]"))
    return t.conversations.select("conv_id", "turn", tx.clean_transcript(marked).alias("text"))


@query("fn_ocr_correct")
def fn_ocr_correct(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", tx.correct_ocr(F.concat(F.lit("Arrning 0PEN CARL0 1ive |ate VVarehouse "), "p_name")).alias("text"))


@query("cmp_entities_build", "select l_orderkey as flier_id, lower(trim(p_name)) as artist, max(l_discount) as confidence from lineitem join part on p_partkey = l_partkey group by 1, 2")
def cmp_entities_build(t: Tables) -> DataFrame:
    named = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    return named.groupBy(F.col("l_orderkey").alias("flier_id"), hi.name_key("p_name").alias("artist")).agg(F.max("l_discount").alias("confidence"))


@query("agg_research_confidence", "select c_custkey, round((least(1, n * 0.1) * 3.0 + least(1, n * 0.2) * 2.0) / 5.0, 6) as confidence from (select c_custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by 1)")
def agg_research_confidence(t: Tables) -> DataFrame:
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = t.customer.select("c_custkey").join(n, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("c_custkey", F.round(sc.research_confidence([(F.col("n"), 0.1, 3.0), (F.col("n"), 0.2, 2.0)]), 6).alias("confidence"))


@query("fn_embed")
def fn_embed(t: Tables) -> DataFrame:
    from marquee.sources.providers import embed

    return embed(t.documents, "doc_id", "text", 64)


@query("fn_split_sentences")
def fn_split_sentences(t: Tables) -> DataFrame:
    split = F.udf(tx.sentences, "array<string>", useArrow=True)
    return t.documents.select("doc_id", F.posexplode(split("text")).alias("n", "sentence"))


@query("fn_merge_filters", "select doc_id, lang from documents where lang in ('fr') and doc_id % 6 <= 3")
def fn_merge_filters(t: Tables) -> DataFrame:
    from marquee.sources.providers import Filters

    user, tier = Filters(frozenset({"en", "fr"}), most_tier=4), Filters(frozenset({"fr", "en"}), frozenset({"en"}), 3)
    rows = t.documents.select("doc_id", "lang", (F.col("doc_id") % 6).alias("tier"))
    return user.merge(tier).apply(rows, "lang", "tier").select("doc_id", "lang")


@query(
    "agg_ocr_merge",
    "select l_orderkey, avg(q) as confidence, count(*) as n from (select l_orderkey, l_partkey, max(l_quantity / 64) as q from lineitem where l_quantity / 64 >= 0.15 group by 1, 2) group by 1",
)
def agg_ocr_merge(t: Tables) -> DataFrame:
    """Passes of one flier: weak regions go, of equal ones the most confident stays."""
    q = F.col("l_quantity") / 64
    regions = t.lineitem.where(q >= 0.15).groupBy("l_orderkey", "l_partkey").agg(F.max(q).alias("q"))
    return regions.groupBy("l_orderkey").agg(F.avg("q").alias("confidence"), F.count("*").alias("n"))
