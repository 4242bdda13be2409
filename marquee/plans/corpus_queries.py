"""Queries over the corpus: scans, filters, projections, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions import text as tx
from marquee.functions import urls as ur
from marquee.operators import aggregate as ag
from marquee.operators import history as hi
from marquee.operators import ranking as rk
from marquee.operators import vectors as ve
from marquee.operators.postings import Postings
from marquee.operators.tables import new_path, written
from marquee.plans.registry import Tables, query
from marquee.sources import files as sf
from marquee.sources import frontier as fr
from marquee.sources import listings as li
from marquee.sources.articles import read_articles
from marquee.sources.books import HEADINGS, book_sections, paged_sections
from marquee.streaming.upserts import BucketTable

#: A fixed query vector of the table's 64 dimensions.
QUERY = [round(((i * 37) % 64 - 31.5) / 32, 4) for i in range(64)]
QUERY_SQL = "[" + ", ".join(map(str, QUERY)) + "]::double[]"


#: Documents in a file of the shelf, conversations in a paged one.
PER_FILE, PER_VOLUME = 25, 10
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_HEADING = " or ".join(f"regexp_matches({_STRIP.format('line')}, '{h}')" for h in HEADINGS)


def _shelf_sql(line: str) -> str:
    return f"(select doc_id // {PER_FILE} as b, string_agg({line}, chr(10) order by doc_id) || chr(10) as text from documents group by 1)"


def _shelf(t: Tables, line: F.Column) -> DataFrame:
    """Text files written from the documents, `PER_FILE` in each, as the reader finds them."""
    docs = t.documents
    path = new_path(docs.sparkSession, "shelf")
    sf.write_files(docs.select(F.floor(F.col("doc_id") / PER_FILE).alias("b"), "doc_id", line.alias("line")), "b", "doc_id", "line", path)
    return sf.read_text_files(docs.sparkSession, path)


_TEXT = "coalesce(text, '')"


@query("scan_text_dir", f"select sha256(text) as source_id, length(text)::bigint as n from {_shelf_sql(_TEXT)} where b % 5 <> 0 order by n, source_id")
def scan_text_dir(t: Tables) -> DataFrame:
    """Files of a folder, small ones first; every fifth is known already and left out."""
    files = _shelf(t, F.coalesce("text", F.lit("")))
    known = files.where(F.regexp_extract("path", r"b=(\d+)", 1).cast("long") % 5 == 0)
    rows = sf.unseen(files, known, "source_id").select("source_id", F.length("text").cast("long").alias("n"))
    return rows.orderBy("n", "source_id")


@query("scan_article_file", f"select sha256(text) as source_id, length(text)::bigint // 4 as token_count from {_shelf_sql(_TEXT)}")
def scan_article_file(t: Tables) -> DataFrame:
    return _shelf(t, F.coalesce("text", F.lit(""))).select("source_id", tx.count_tokens(F.col("text")).alias("token_count"))


@query(
    "scan_article_url",
    f"""select page_id, sha256(url) as source_id, {ur.first_match_sql("url", ur.ARTICLE_TIERS, 1, "article")} as source_type,
    {ur.first_match_sql("url", ur.ARTICLE_TIERS, 2, 5)} as tier from pages""",
)
def scan_article_url(t: Tables) -> DataFrame:
    url = F.col("url")
    return t.pages.select(
        "page_id", F.sha2("url", 256).alias("source_id"),
        ur.first_match(url, ur.ARTICLE_TIERS, 1, "article").alias("source_type"), ur.first_match(url, ur.ARTICLE_TIERS, 2, 5).alias("tier"),
    )


_CHAPTER = "'Chapter ' || doc_id || chr(10) || '[p. ' || (doc_id * 3) || '] ' || coalesce(text, '')"


@query(
    "scan_book",
    rf"""with books as {_shelf_sql(_CHAPTER)},
    lines as (select b, sha256(text) as source_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from books),
    parts as (select *, sum(({_HEADING})::int) over (partition by b order by i) as s from lines),
    told as (select b, source_id, s, {_STRIP.format("string_agg(line, chr(10) order by i)")} as x from parts group by 1, 2, 3)
    select source_id, (row_number() over (partition by b order by s) - 1)::int as section, nullif(regexp_extract(x, '(?i)\[p(?:age)?\.?\s*(\d+)\]', 1), '') as page,
    length(x)::bigint as n_chars, sha256(x) as text_sha256 from told where x <> ''""".replace("\\\\", "\\"),
)
def scan_book(t: Tables) -> DataFrame:
    """Books of many chapters, read from files and cut at their headings."""
    title = F.concat(F.lit("Chapter "), "doc_id", F.lit("\n[p. "), F.col("doc_id") * 3, F.lit("] "), F.coalesce("text", F.lit("")))
    found = book_sections(_shelf(t, title).select("source_id", "text"))
    return found.select("source_id", "section", "page", F.length("section_text").cast("long").alias("n_chars"), F.sha2("section_text", 256).alias("text_sha256"))


_PAGE = f"case when turn = 0 and conv_id // {PER_VOLUME} % 2 = 0 then 'Part ' || (conv_id + 1) || chr(10) else '' end || coalesce(text, '') || chr(12)"


@query(
    "scan_pdf",
    rf"""with volumes as (select conv_id // {PER_VOLUME} as v, string_agg({_PAGE}, chr(10) order by conv_id, turn) || chr(10) as text from conversations group by 1),
    pages as (select v, sha256(text) as source_id, generate_subscripts(string_split(text, chr(12)), 1) as n, {_STRIP.format("unnest(string_split(text, chr(12)))")} as x from volumes),
    flagged as (select *, row_number() over (partition by v order by n) - 1 as k,
        len(list_filter(string_split(x, chr(10))[1:5], lambda line: {_HEADING})) > 0 as head from pages where x <> ''),
    parts as (select *, case when max(head::int) over (partition by v) = 1 then sum(head::int) over (partition by v order by n) else k // 10 end as s from flagged),
    told as (select v, source_id, s, min(n)::int as first_page, count(*)::int as n_pages, string_agg(x, chr(10) || chr(10) order by n) as x from parts group by 1, 2, 3)
    select source_id, (row_number() over (partition by v order by s) - 1)::int as section, first_page, n_pages, length(x)::bigint as n_chars, sha256(x) as text_sha256 from told""",
)
def scan_pdf(t: Tables) -> DataFrame:
    """Paged documents, a turn a page; every second one has headings, the others are cut by pages."""
    talks = t.conversations
    head = F.when((F.col("turn") == 0) & (F.floor(F.col("conv_id") / PER_VOLUME) % 2 == 0), F.concat(F.lit("Part "), F.col("conv_id") + 1, F.lit("\n"))).otherwise("")
    lines = talks.select(
        F.floor(F.col("conv_id") / PER_VOLUME).alias("v"), F.struct("conv_id", "turn").alias("at"), F.concat(head, F.coalesce("text", F.lit("")), F.lit("\f")).alias("line")
    )
    path = new_path(talks.sparkSession, "volumes")
    sf.write_files(lines, "v", "at", "line", path)
    found = paged_sections(sf.read_text_files(talks.sparkSession, path).select("source_id", "text"))
    return found.select(
        "source_id", "section", "first_page", "n_pages", F.length("section_text").cast("long").alias("n_chars"), F.sha2("section_text", 256).alias("text_sha256")
    )


@query("scan_html_plain", sf.main_text_sql("html"))
def scan_html_plain(t: Tables) -> DataFrame:
    """The text by patterns alone, without leaving the JVM."""
    return t.pages.select("page_id", sf.main_text(F.col("html")).alias("text"))


@query(
    "scan_html_text",
    f"""select page_id, text, nullif(trim(regexp_replace({sf.decoded_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '\\s+', ' ', 'g')), '') as title,
    cast(null as varchar) as author, cast(null as date) as published from ({sf.main_text_sql("html")}) join pages using (page_id)""",
)
def scan_html_text(t: Tables) -> DataFrame:
    """Text, title, author and date of each page, parsed once (these pages name no author and no date)."""
    return read_articles(t.pages, "page_id", "html")


@query("scan_epub")
def scan_epub(t: Tables) -> DataFrame:
    """Documents of at least 100 characters with the text of their first heading."""
    return sf.html_documents(t.pages, least_chars=100)


@query("scan_corpus_metadata", "select doc_id, lang, source, n_chars from documents where lang = 'en' order by doc_id")
def scan_corpus_metadata(t: Tables) -> DataFrame:
    return t.documents.where("lang = 'en'").select("doc_id", "lang", "source", "n_chars").orderBy("doc_id")


LISTING_FIRST, LISTING_WINDOWS, LISTING_DAYS = "2024-01-01", 4, 7


@query(
    "scan_event_listings",
    """select event_id, event_type as area, coalesce(json_extract_string(props, '$.title'), 'Untitled') as title, strftime(ts, '%Y-%m-%d') as event_date,
    coalesce(json_extract_string(props, '$.k')::int, 0) as attending from events where ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-30'""",
)
def scan_event_listings(t: Tables) -> DataFrame:
    """Four weeks of all areas, pulled page by page from a service whose windows reach a day on."""
    events = t.events
    spark = events.sparkSession
    root = new_path(spark, "pages")
    li.serve_pages(
        events, "event_id", "event_type", "ts", "props", root, first=LISTING_FIRST, windows=LISTING_WINDOWS, days=LISTING_DAYS, overlap=1, page_rows=500
    )
    areas = ",".join(sorted(r[0] for r in events.select("event_type").distinct().collect()))  # a service has few areas
    return li.listings(
        spark, lambda options: li.folder_client(options["root"]), root=root, areas=areas, start=LISTING_FIRST, end="2024-01-29", windowDays=LISTING_DAYS
    )


@query(
    "scan_listing_props",
    """select event_id, coalesce(json_extract_string(props, '$.k')::int, 0) as attending, coalesce(json_extract_string(props, '$.title'), 'Untitled') as title,
    strftime(ts, '%Y-%m-%d') as event_date from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-12'""",
)
def scan_listing_props(t: Tables) -> DataFrame:
    window = t.events.where("ts >= timestamp_ntz '2024-01-05' and ts < timestamp_ntz '2024-01-12'")
    return sf.parse_listing(window, "event_id", "ts", "props")


@query(
    "scan_web_archive_index",
    """select distinct rtrim(url, '/') as url from pages where regexp_matches(url, '/\\d+') and not regexp_matches(url, '\\?|\\.css|\\.js|#')""",
)
def scan_web_archive_index(t: Tables) -> DataFrame:
    return sf.archive_index(t.pages, "url", r"/\d+", r"\?|\.css|\.js|#")


CRAWL_WORDS, CRAWL_DEPTH, CRAWL_PAGES = ["e", "th", "de", "on"], 3, 60


def _crawl_sql() -> str:
    """The levels of the crawl one by one."""
    host = "lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
    score = " + ".join(f"contains(lower(target || ' ' || anchor), '{w}')::int" for w in CRAWL_WORDS)
    hrefs = r"""regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)[^>]*>(.*?)</a>', {})"""
    root = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
    levels = ["t0 as (select distinct url as page, 0 as depth, cast(null as int) as score from (select url from pages order by page_id limit 10))"]
    for d in range(1, CRAWL_DEPTH + 1):
        levels.append(f"""f{d} as materialized (select target as page, {d} as depth, max(score) as score from graph where source in (select page from t{d - 1} where depth = {d - 1})
            and target not in (select page from t{d - 1}) group by 1 qualify row_number() over (order by max(score) desc, target) <= {CRAWL_PAGES} - (select count(*) from t{d - 1})),
            t{d} as materialized (select * from t{d - 1} union all select * from f{d})""")
    return rf"""with {levels[0]}, raw as (select url, {root} || h as hub, trim(regexp_replace(regexp_replace(a, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) as anchor
        from (select url, unnest({hrefs.format(1)}) as h, unnest({hrefs.format(2)}) as a from pages) where starts_with(h, '/')),
    found as (select url as source, hub as target, anchor from raw union all select hub, url, anchor from raw),
    graph as materialized (select source, target, max({score}) as score from found
        where {host.format("target")} in (select {host.format("page")} from t0) group by 1, 2 having score >= 1), {", ".join(levels[1:])}
    select page, depth, score from t{CRAWL_DEPTH}"""


@query("scan_crawl", _crawl_sql())
def scan_crawl(t: Tables) -> DataFrame:
    """From the first ten pages over the hrefs of all pages, on their hosts. A path that pages link to is a listing of
    its host, which links back to them; so the graph has links to follow."""
    pages = t.pages
    links = fr.page_links(pages, "url", "html")
    back = links.select(F.col("target").alias("source"), F.col("source").alias("target"), "anchor")
    both = written(fr.relevance(links.unionByName(back), CRAWL_WORDS), "links")
    known = pages.select(F.col("url").alias("page")).unionByName(both.select(F.col("target").alias("page")))
    seeds = [r[0] for r in pages.orderBy("page_id").select("url").limit(10).collect()]
    return fr.best_first(both, known, seeds, max_depth=CRAWL_DEPTH, max_pages=CRAWL_PAGES, least=1)


@query(
    "scan_crawl_levels",
    """with recursive links as (select n_nationkey as a, (n_nationkey * 3 + k) % 25 as b from nation, range(0, 3) r(k)),
    reached as (select 0::bigint as page, 0 as depth union select b, depth + 1 from reached join links on a = page where depth < 3)
    select page, min(depth) as depth from reached group by page""",
)
def scan_crawl_levels(t: Tables) -> DataFrame:
    keys = t.nation.select(F.col("n_nationkey").cast("long").alias("source"))
    links = keys.select("source", F.explode(F.array(*[(F.col("source") * 3 + k) % 25 for k in range(3)])).alias("target"))
    return sf.crawl(links, seeds=[0], max_depth=3)


@query("scan_music_db", "select s_suppkey as label_id, p_partkey as release_id, p_name as title, p_type as style from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey where s_suppkey = 7 group by all")
def scan_music_db(t: Tables) -> DataFrame:
    sold = t.lineitem.where("l_suppkey = 7").select("l_suppkey", "l_partkey").distinct()
    known = sold.join(t.supplier.select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return known.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("s_suppkey").alias("label_id"), F.col("p_partkey").alias("release_id"), F.col("p_name").alias("title"), F.col("p_type").alias("style")
    )


@query("scan_xml_dump", "select p_partkey as id, p_name as name, [p_type, p_brand] as styles from part where p_partkey % 7 <> 0")
def scan_xml_dump(t: Tables) -> DataFrame:
    """Records written as XML files and read by the dump reader; every seventh lacks its id and is dropped."""
    xml = F.concat(
        F.lit("<release>"), F.when(F.col("p_partkey") % 7 != 0, F.concat(F.lit("<id>"), "p_partkey", F.lit("</id>"))).otherwise(""),
        F.lit("<name>"), "p_name", F.lit("</name><style>"), "p_type", F.lit("</style><style>"), "p_brand", F.lit("</style></release>"),
    )
    spark = t.part.sparkSession
    path = new_path(spark, "dump")
    file = F.floor(F.col("p_partkey") / 1000).alias("file")
    records = t.part.select(file, F.col("p_partkey").alias("at"), xml.alias("line"))
    ends = t.part.select(file).distinct().select("file", F.explode(F.array(F.struct(F.lit(-1).alias("at"), F.lit("<releases>").alias("line")), F.struct(F.lit((1 << 31) - 1).alias("at"), F.lit("</releases>").alias("line")))).alias("e"))
    sf.write_files(records.unionByName(ends.select("file", "e.at", "e.line")), "file", "at", "line", path)
    found = sf.read_xml_dump(spark, path, "release", "id long, name string, style array<string>")
    return found.select("id", "name", F.col("style").alias("styles"))


@query("filt_store_where", "select doc_id, lang, source from documents where n_chars <= 2000 and lang in ('en', 'fr') and source not in ('src1', 'src2')")
def filt_store_where(t: Tables) -> DataFrame:
    kept = t.documents.where("n_chars <= 2000 and lang in ('en', 'fr') and source not in ('src1', 'src2')")
    return kept.select("doc_id", "lang", "source")


@query("filt_tag_contains", "select doc_id from documents where len(list_filter(string_split(text, ' '), lambda w: contains(lower(w), 'tion'))) > 0")
def filt_tag_contains(t: Tables) -> DataFrame:
    return t.documents.where(rk.any_contains(F.split("text", " "), "TION")).select("doc_id")


@query("filt_genre_any", "select p_partkey, p_type from part where lower(p_type) in ('promo', 'small')")
def filt_genre_any(t: Tables) -> DataFrame:
    return t.part.where(rk.genre_filter(F.array("p_type"), ["Promo", "SMALL"])).select("p_partkey", "p_type")


@query("filt_genre_one", "select p_partkey, p_type from part where contains(lower(p_type), 'promo') or contains('promo', lower(p_type))")
def filt_genre_one(t: Tables) -> DataFrame:
    return t.part.where(rk.genre_filter(F.array("p_type"), ["Promo"])).select("p_partkey", "p_type")


@query(
    "filt_time_overlap",
    """select o_orderkey from orders where (case when o_orderkey % 3 = 0 then year(o_orderdate) // 10 * 10 <= 1998 and year(o_orderdate) // 10 * 10 + 9 >= 1997
    when o_orderkey % 3 = 1 then year(o_orderdate) between 1997 and 1998 else false end)""",
)
def filt_time_overlap(t: Tables) -> DataFrame:
    from marquee.functions.periods import periods_overlap

    year = F.year("o_orderdate").cast("string")
    period = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.substring(year, 1, 3), F.lit("0s"))).when(F.col("o_orderkey") % 3 == 1, year).otherwise(F.lit("junk"))
    return t.orders.where(periods_overlap(period, F.lit("1997-1998"))).select("o_orderkey")


@query("filt_exclude_type", "select doc_id, lang from documents where lang <> 'es'")
def filt_exclude_type(t: Tables) -> DataFrame:
    return t.documents.where("lang <> 'es'").select("doc_id", "lang")


@query(
    "filt_before_date",
    """select o_orderkey, yr from (select o_orderkey, case when o_orderstatus <> 'P' then year(o_orderdate) end as yr from orders)
    where yr is null or yr <= 1997""",
)
def filt_before_date(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate")).cast("long").alias("yr"))
    return rows.where(F.col("yr").isNull() | (F.col("yr") <= 1997))


@query(
    "filt_music_relevance",
    f"""select page_id from pages where regexp_matches(url, '(?i){ur.MUSIC_DOMAINS}') or
    regexp_matches(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1) || ' ' || url, '(?i){ur.MUSIC_TERMS}')""",
)
def filt_music_relevance(t: Tables) -> DataFrame:
    return t.pages.where(ur.is_music_relevant(F.col("url"), sf.html_title(F.col("html")), F.col("url"))).select("page_id")


_SLUGS = "[" + ", ".join(f"'{k}'" for k in sorted(ur.GENRE_KEYWORDS)) + "]"


@query(
    "filt_url_slug_keywords",
    f"""select page_id, array_to_string(k, ',') as matched from (select page_id, list_filter({_SLUGS}, lambda k: contains(s, k)) as k from
    (select page_id, lower(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '([^/]*)$', 1)) || '-' || ({_SLUGS})[page_id % {len(ur.GENRE_KEYWORDS) + 9} + 1] as s from pages)) where len(k) > 0""",
)
def filt_url_slug_keywords(t: Tables) -> DataFrame:
    """URLs whose last part names one of the table's keywords; one in so many gets none."""
    name = F.get(F.array(*[F.lit(k) for k in sorted(ur.GENRE_KEYWORDS)]), (F.col("page_id") % (len(ur.GENRE_KEYWORDS) + 9)).cast("int"))
    url = F.concat(F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"/+$", ""), F.lit("-"), name)
    matched = F.when(name.isNotNull(), ur.keywords_in(ur.last_segment(url)))
    return t.pages.select("page_id", matched.alias("k")).where(F.size("k") > 0).select("page_id", F.array_join("k", ",").alias("matched"))


_KEYS = "[" + ", ".join(f"'{k}'" for k in sorted(ur.GENRE_KEYWORDS)) + "]"
_NAMED = f"text || ' ' || ({_KEYS})[doc_id % {len(ur.GENRE_KEYWORDS)} + 1] || ' ' || case when doc_id % 3 > 0 then ({_KEYS})[doc_id * 7 % {len(ur.GENRE_KEYWORDS)} + 1] || '/deep house' else '' end"


@query("filt_content_keywords", f"select doc_id, n from (select doc_id, len(list_filter({_KEYS}, lambda k: contains(lower(x), k))) as n from (select doc_id, {_NAMED} as x from documents)) where n >= 3")
def filt_content_keywords(t: Tables) -> DataFrame:
    """Texts with keywords of the table behind them, as their words are invented."""
    keys, n = F.array(*[F.lit(k) for k in sorted(ur.GENRE_KEYWORDS)]), len(ur.GENRE_KEYWORDS)
    at = lambda x: F.get(keys, (x % n).cast("int"))
    more = F.when(F.col("doc_id") % 3 > 0, F.concat(at(F.col("doc_id") * 7), F.lit("/deep house"))).otherwise("")
    text = F.concat_ws(" ", "text", at(F.col("doc_id")), more)
    rows = t.documents.select("doc_id", F.size(ur.keywords_in(text)).cast("long").alias("n"))
    return rows.where(F.col("n") >= ur.LEAST_KEYWORDS)


@query("filt_style_membership", "select p_partkey from part where p_brand <> 'Brand#1' and p_type in ('PROMO', 'LARGE')")
def filt_style_membership(t: Tables) -> DataFrame:
    wanted = F.array(F.lit("PROMO"), F.lit("LARGE"))
    return t.part.where((F.col("p_brand") != "Brand#1") & F.arrays_overlap(F.array("p_type"), wanted)).select("p_partkey")


@query("filt_useful_artist", "select s_suppkey, s_name from supplier where s_acctbal / 10000 >= 0.3 and not regexp_matches(s_name, '(?i)unknown|#0000000[0-2]9$')")
def filt_useful_artist(t: Tables) -> DataFrame:
    kept = (F.col("s_acctbal") / 10000 >= 0.3) & ~F.col("s_name").rlike(r"(?i)unknown|#0000000[0-2]9$")
    return t.supplier.where(kept).select("s_suppkey", "s_name")


@query("filt_low_confidence_edge", "select l_orderkey, l_linenumber, l_partkey, l_discount from lineitem where l_discount * 2 >= 0.15")
def filt_low_confidence_edge(t: Tables) -> DataFrame:
    return t.lineitem.where("l_discount * 2 >= 0.15D").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")


@query(
    "proj_format_citation",
    "select doc_id, concat_ws(', ', source, case when lang = 'en' then lang end, 'p.' || (case when doc_id % 2 = 0 then doc_id end), '[Tier ' || (doc_id % 6 + 1) || ']') as citation from documents",
)
def proj_format_citation(t: Tables) -> DataFrame:
    author = F.when(F.col("lang") == "en", F.col("lang"))
    page = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))
    none = F.lit(None).cast("string")
    return t.documents.select("doc_id", tx.format_citation(F.col("source"), author, page, none, F.col("doc_id") % 6 + 1).alias("citation"))


@query(
    "proj_citation_style",
    """select doc_id, case when doc_id % 6 = 0 then source || ' (book)' when doc_id % 6 <= 2 then '"' || source || '", ' || lang
    when doc_id % 6 <= 4 then source || ' [database]' else source || ' (web)' end as citation from documents""",
)
def proj_citation_style(t: Tables) -> DataFrame:
    tier, source = F.col("doc_id") % 6, F.col("source")
    text = (
        F.when(tier == 0, F.concat(source, F.lit(" (book)")))
        .when(tier <= 2, F.concat(F.lit('"'), source, F.lit('", '), "lang"))
        .when(tier <= 4, F.concat(source, F.lit(" [database]")))
        .otherwise(F.concat(source, F.lit(" (web)")))
    )
    return t.documents.select("doc_id", text.alias("citation"))


@query(
    "proj_event_text",
    """select event_id, concat_ws(chr(10), 'Event: ' || event_type, 'Date: ' || strftime(ts, '%Y-%m-%d'), 'Attending: ' || format('{:,}', (event_id * 7)::bigint)) as text from events""",
)
def proj_event_text(t: Tables) -> DataFrame:
    return t.events.select("event_id", sf.event_text(F.col("event_type"), F.col("ts"), F.col("event_id") * 7).alias("text"))


@query("proj_prose", "select p_partkey, p_name || ' is a ' || lower(p_type) || ' release on ' || p_brand || '. Styles: ' || p_size || '.' as prose from part")
def proj_prose(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat("p_name", F.lit(" is a "), F.lower("p_type"), F.lit(" release on "), "p_brand", F.lit(". Styles: "), "p_size", F.lit(".")).alias("prose"))


@query(
    "proj_output_document",
    """select o_orderkey, '{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '","preview":"' || substr(o_orderpriority, 1, 5) || '"}' as doc from orders""",
)
def proj_output_document(t: Tables) -> DataFrame:
    doc = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.substring("o_orderpriority", 1, 5).alias("preview"))
    return t.orders.select("o_orderkey", F.to_json(doc).alias("doc"))


@query(
    "proj_entity_node",
    """select name, kind from (select *, row_number() over (partition by lower(name) order by o, name) r from
    (select n_name as name, 'nation' as kind, 0 as o from nation union all select r_name, 'region', 1 from region union all select upper(n_name), 'dup', 2 from nation)) where r = 1""",
)
def proj_entity_node(t: Tables) -> DataFrame:
    rows = t.nation.select(F.col("n_name").alias("name"), F.lit("nation").alias("kind"), F.lit(0).alias("o"))
    rows = rows.unionByName(t.region.select(F.col("r_name").alias("name"), F.lit("region").alias("kind"), F.lit(1).alias("o")))
    rows = rows.unionByName(t.nation.select(F.upper("n_name").alias("name"), F.lit("dup").alias("kind"), F.lit(2).alias("o")))
    return hi.first_kept(rows.withColumn("k", F.lower("name")), ["k"], ["o", "name"]).select("name", "kind")


@query(
    "agg_corpus_stats",
    """select count(*) as chunks, count(distinct source) as sources, count(distinct lang) as types, sum(n_chars)::bigint as chars,
    array_to_string(list_sort(list(distinct lang)), ',') as tags from documents""",
)
def agg_corpus_stats(t: Tables) -> DataFrame:
    return t.documents.agg(
        F.count("*").alias("chunks"), F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("types"),
        F.sum("n_chars").alias("chars"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("tags"),
    )


@query("agg_corpus_by_type", "select lang, count(*) as chunks, count(distinct source) as sources from documents group by lang")
def agg_corpus_by_type(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.count("*").alias("chunks"), F.count_distinct("source").alias("sources"))


@query("agg_distinct_sources", "select distinct source from documents where lang = 'fr'")
def agg_distinct_sources(t: Tables) -> DataFrame:
    return t.documents.where("lang = 'fr'").select("source").distinct()


#: What stands for the tags of a chunk: words by their form.
FACETS = {"entity": (30, "length(w) >= 9"), "place": (20, "w ~ '^[A-Z]' and length(w) <= 4"), "genre": (None, "w in ('the', 'der', 'de', 'las', 'and', 'und', 'et', 'que')")}


def _facets_sql() -> str:
    words = "select doc_id, unnest(list_distinct(string_split(coalesce(text, ''), ' '))) as w from pool"
    tags = [f"select '{f}' as facet, w as value, count(*) as n from ({words}) where {c.replace(' ~ ', ' similar to ').replace('^[A-Z]', '[A-Z].*')} group by 2" for f, (_, c) in FACETS.items()]
    limits = " ".join(f"when '{f}' then {k}" for f, (k, _) in FACETS.items() if k)
    return f"""with pool as (select d.* from documents d join (select vec_id from embeddings order by list_cosine_similarity(embedding::double[], {QUERY_SQL}) desc, vec_id limit 500) on vec_id = doc_id),
    counts as (select 'type' as facet, lang as value, count(*) as n from pool where lang is not null group by 2
        union all select 'tier', 'T' || (doc_id % 6 + 1), count(*) from pool group by 2
        union all select 'period', (1960 + doc_id % 6 * 10) || 's', count(*) from pool group by 2 union all {" union all ".join(tags)})
    select facet, value, n from (select *, row_number() over (partition by facet order by n desc, value) r from counts) where r <= case facet {limits} else 1000000 end"""


@query("agg_facets", _facets_sql())
def agg_facets(t: Tables) -> DataFrame:
    """Six facets of the pool that a search of 500 finds: types, genres, periods, entities (30), places (20), tiers."""
    found = ve.search(t.embeddings.select("vec_id", "embedding"), "embedding", "vec_id", QUERY, 500)
    pool = t.documents.join(F.broadcast(found.select(F.col("vec_id").alias("doc_id"))), "doc_id")
    words = F.array_distinct(F.split(F.coalesce("text", F.lit("")), " "))
    own = {"entity": lambda w: F.length(w) >= 9, "place": lambda w: w.rlike("^[A-Z]") & (F.length(w) <= 4), "genre": lambda w: w.isin("the", "der", "de", "las", "and", "und", "et", "que")}
    tagged = pool.select("doc_id", "lang", words.alias("w")).select("doc_id", "lang", *[F.filter("w", keep).alias(f) for f, keep in own.items()])
    columns = {f: F.col(f) for f in own} | {
        "type": F.col("lang"), "tier": F.concat(F.lit("T"), F.col("doc_id") % 6 + 1), "period": F.concat(1960 + F.col("doc_id") % 6 * 10, F.lit("s")),
    }
    return ag.facets(tagged, columns, {f: k for f, (k, _) in FACETS.items() if k})


@query(
    "agg_source_summary",
    "select source, arg_min(lang, doc_id) as type, min(doc_id) as first_id, count(*) as chunk_count from documents group by source order by source",
)
def agg_source_summary(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(
        F.min_by("lang", "doc_id").alias("type"), F.min("doc_id").alias("first_id"), F.count("*").alias("chunk_count")
    ).orderBy("source")


@query("agg_collect_citations", "select source, lang, min(doc_id) as first_id from documents group by 1, 2 order by first_id")
def agg_collect_citations(t: Tables) -> DataFrame:
    return t.documents.groupBy("source", "lang").agg(F.min("doc_id").alias("first_id")).orderBy("first_id")


@query("lk_source_detail", "select source, count(*) over () as n, doc_id as chunk_id from documents where source = 'src4' order by doc_id")
def lk_source_detail(t: Tables) -> DataFrame:
    """A source's chunks, a row each, with their number."""
    rows = t.documents.where("source = 'src4'").select("source", "doc_id")
    total = rows.agg(F.count("*").alias("n"))
    return rows.crossJoin(F.broadcast(total)).select("source", "n", F.col("doc_id").alias("chunk_id")).orderBy("chunk_id")


@query("sort_citations", "select doc_id, tier, yr from (select doc_id, doc_id % 6 + 1 as tier, case when doc_id % 4 > 0 then n_chars end as yr from documents) order by tier, yr desc nulls last, doc_id")
def sort_citations(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", (F.col("doc_id") % 6 + 1).alias("tier"), F.when(F.col("doc_id") % 4 > 0, F.col("n_chars")).alias("yr"))
    return rows.orderBy("tier", F.col("yr").desc_nulls_last(), "doc_id")


@query("page_offset", "select doc_id, total, true as has_more from (select doc_id, count(*) over () as total from documents where lang = 'en') order by doc_id limit 20 offset 40")
def page_offset(t: Tables) -> DataFrame:
    rows = t.documents.where("lang = 'en'").select("doc_id")
    total = rows.agg(F.count("*").alias("total"))
    return hi.page(rows, ["doc_id"], 40, 20).crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > 60)


@query("sort_multi_key", "select doc_id, n_chars from documents order by n_chars desc, doc_id desc")
def sort_multi_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), F.desc("doc_id"))


@query("sort_ra_first", "select page_id, url from pages order by not contains(url, '.org'), page_id")
def sort_ra_first(t: Tables) -> DataFrame:
    return t.pages.select("page_id", "url").orderBy(~F.contains("url", F.lit(".org")), "page_id")


@query(
    "topk_suggest",
    """select name, rank from (select name, case when starts_with(lower(name), 're') then 0 else 1 end as rank from
    (select distinct p_name as name from part where contains(lower(p_name), 're'))) order by rank, name limit 20""",
)
def topk_suggest(t: Tables) -> DataFrame:
    """Read from postings by key; `ranking.suggest` is the scan that gives the same."""
    spark = t.part.sparkSession
    return Postings.build(t.part, "p_name", new_path(spark, "postings")).suggest(spark, "re", 20)


@query("set_union_providers", "select s_name as name, 'supplier' as provider from supplier union all select c_name, 'customer' from customer")
def set_union_providers(t: Tables) -> DataFrame:
    a = t.supplier.select(F.col("s_name").alias("name"), F.lit("supplier").alias("provider"))
    return a.unionByName(t.customer.select(F.col("c_name").alias("name"), F.lit("customer").alias("provider")))


@query("set_dedup_first", "select min(doc_id) as doc_id from documents group by lower(trim(text))")
def set_dedup_first(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.sha2(F.lower(F.trim("text")), 256).alias("k")).agg(F.min("doc_id").alias("doc_id")).drop("k")


@query("set_difference", "select c_nationkey from customer except select s_nationkey from supplier where s_acctbal < 2000")
def set_difference(t: Tables) -> DataFrame:
    gone = t.supplier.where("s_acctbal < 2000").select(F.col("s_nationkey").alias("c_nationkey"))
    return t.customer.select("c_nationkey").subtract(gone)


@query("set_intersection", "select c_nationkey from customer intersect select s_nationkey from supplier where s_acctbal < 2000")
def set_intersection(t: Tables) -> DataFrame:
    return t.customer.select("c_nationkey").intersect(t.supplier.where("s_acctbal < 2000").select(F.col("s_nationkey").alias("c_nationkey")))


@query("sink_prose_files", "select p_type as cluster, count(*) as n, sum(length(p_name))::bigint as n_chars from part group by 1")
def sink_prose_files(t: Tables) -> DataFrame:
    """Texts written to a folder for each cluster, and what the folders hold."""
    rows = t.part.select(F.col("p_type").alias("cluster"), "p_name")
    path = new_path(rows.sparkSession, "prose")
    sf.write_text_by(rows, "cluster", "p_name", path)
    back = rows.sparkSession.read.schema("value string, cluster string").text(path)
    return back.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("n_chars"))


#: Blocks of a part of the event corpus.
PER_PART = 1000


@query(
    "sink_event_corpus",
    f"""select event_type, (r - 1) // {PER_PART} as part, count(*) as n, strftime(min(ts), '%Y-%m-%d') as first_day,
    sum(length('Event: ' || event_id || ' ' || user_id || chr(10) || '---'))::bigint as n_chars,
    string_agg('Event: ' || event_id || ' ' || user_id, chr(10) || '---' || chr(10) order by r) as body
    from (select *, row_number() over (partition by event_type order by ts, event_id) as r from events) group by 1, 2""",
)
def sink_event_corpus(t: Tables) -> DataFrame:
    """Files of event blocks in order of time, written and read back. A type's events are dealt to
    files by ranges of time, so a hot type is many files; its text is told in parts of a thousand
    blocks, which follow each other."""
    rows = rk.numbered(t.events.select("event_type", "ts", "event_id", "user_id"), ["event_type"], ["ts", "event_id"])
    event = F.concat(F.lit("Event: "), "event_id", F.lit(" "), "user_id")
    day = F.concat(F.lit("Date: "), F.date_format("ts", "yyyy-MM-dd"))
    block = F.concat_ws("\n", event, day, F.concat(F.lit("Number: "), "number"), F.lit("---"))
    path = new_path(rows.sparkSession, "corpus")
    sf.write_event_corpus(rows, "event_type", "ts", "event_id", block, path)
    found = sf.read_event_corpus(rows.sparkSession, path, "event_type")
    text = F.concat(F.lit("Event: "), "event")
    ordered = F.sort_array(F.collect_list(F.when(F.col("event").isNotNull(), F.struct("number", text.alias("text")))))
    parts = found.groupBy("event_type", F.floor((F.col("number") - 1) / PER_PART).alias("part")).agg(
        F.count("*").alias("n"), F.min("date").alias("first_day"), F.sum(F.length(F.concat(text, F.lit("\n---")))).alias("n_chars"), ordered.alias("blocks")
    )
    body = F.when(F.size("blocks") > 0, F.array_join(F.transform("blocks", lambda b: b["text"]), "\n---\n"))
    return parts.select("event_type", "part", "n", "first_day", "n_chars", body.alias("body"))


@query(
    "sink_article_corpus",
    """select doc_id, grp, ((row_number() over (partition by grp order by doc_id)) - 1) // 50 + 1 as part from
    (select doc_id, case when contains(text, 'tion') then 'a' when contains(text, 'sch') then 'b' else 'general' end as grp from documents)""",
)
def sink_article_corpus(t: Tables) -> DataFrame:
    group = F.when(F.contains("text", F.lit("tion")), "a").when(F.contains("text", F.lit("sch")), "b").otherwise("general")
    rows = t.documents.select("doc_id", group.alias("grp"))
    return rk.numbered(rows, ["grp"], ["doc_id"]).select("doc_id", "grp", (F.floor((F.col("number") - 1) / 50) + 1).alias("part"))


_PARAGRAPHS = r"list_filter(list_transform(regexp_split_to_array(coalesce({}, ''), '\n\s*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '')"


def _rows_sql(type_: str, id_: str, text: str, table: str) -> str:
    return f"select '{type_}' as source_type, sha256('{type_}:' || {id_}) as source_id, {_PARAGRAPHS.format(text)} as p from {table}"


def _chunks_of(rows: DataFrame, type_: F.Column, id_: F.Column, text: F.Column) -> DataFrame:
    """Paragraphs of a text with an identity that no other source's can be."""
    source_id = F.sha2(F.concat(type_, F.lit(":"), id_.cast("string")), 256)
    cut = rows.select(type_.alias("source_type"), source_id.alias("source_id"), F.posexplode(tx.split_paragraphs(F.coalesce(text, F.lit("")))).alias("at", "text"))
    chunk_id = F.sha2(F.concat_ws(":", "source_id", "at"), 256)
    return cut.select("source_type", "source_id", chunk_id.alias("chunk_id"), F.length("text").cast("long").alias("n_chars"))


_CUT_SQL = "select source_type, source_id, sha256(source_id || ':' || (i - 1)) as chunk_id, length(p[i])::bigint as n_chars from (select *, unnest(range(1, len(p) + 1)) as i from ({}))"


@query(
    "cmp_rebuild",
    _CUT_SQL.format(" union all ".join((
        _rows_sql("reference", "doc_id", "replace(text, chr(10), chr(10) || chr(10))", "documents"), _rows_sql("transcript", "conv_id || '/' || turn", "text", "conversations"),
        _rows_sql("article", "page_id", "text", f"({sf.main_text_sql('html')})"),
    ))),
)
def cmp_rebuild(t: Tables) -> DataFrame:
    """All sources cut to chunks anew; ids are made of type and id, so those of three tables do not clash."""
    blank = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    parts = [
        _chunks_of(t.documents, F.lit("reference"), F.col("doc_id"), blank),
        _chunks_of(t.conversations, F.lit("transcript"), F.concat_ws("/", "conv_id", "turn"), F.col("text")),
        _chunks_of(t.pages, F.lit("article"), F.col("page_id"), sf.main_text(F.col("html"))),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "cmp_reingest",
    _CUT_SQL.format("select case when source in ('src1', 'src2') then 'event' else lang end as source_type, sha256(case when source in ('src1', 'src2') then 'event' else lang end || ':' || doc_id) as source_id,"
    + _PARAGRAPHS.format("replace(text, chr(10), chr(10) || chr(10))") + " as p from documents"),
)
def cmp_reingest(t: Tables) -> DataFrame:
    """Chunks of two wrongly typed sources are deleted from the written table and ingested anew as events."""
    spark = t.documents.sparkSession
    wrong = F.col("source").isin("src1", "src2")
    blank = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    table = BucketTable(spark, new_path(spark, "chunks"), "chunk_id string, source_id string, source_type string, n_chars long", ["chunk_id"], ["source_id"])
    table.merge(_chunks_of(t.documents, F.col("lang"), F.col("doc_id"), blank), 0)
    gone = t.documents.where(wrong).select(F.sha2(F.concat("lang", F.lit(":"), "doc_id"), 256).alias("source_id"))
    kept = table.latest().join(gone, "source_id", "left_anti")
    again = _chunks_of(t.documents.where(wrong), F.lit("event"), F.col("doc_id"), blank)
    return kept.unionByName(again).select("source_type", "source_id", "chunk_id", "n_chars")


@query(
    "cmp_episode_index",
    """select key, arg_min(page_id, page_id) as page_id, regexp_extract(key, '/(\\d+)', 1) as number from
    (select page_id, lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '')) as key from pages) group by key""",
)
def cmp_episode_index(t: Tables) -> DataFrame:
    rows = t.pages.select("page_id", ur.normal_url(F.col("url")).alias("key"))
    return rows.groupBy("key").agg(F.min("page_id").alias("page_id")).withColumn("number", F.regexp_extract("key", r"/(\d+)", 1))


_LIKE = "least(greatest(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 0), 1)"


def _tags_sql(keep: str) -> str:
    once = "list_filter(string_split(coalesce(text, ''), ' '), lambda w: {})".format(keep)
    return f"list_filter({once}, lambda w, i: list_position({once}, w) = i)"


@query(
    "cmp_web_enrich",
    f"""with ranked as (select q.vec_id as query_id, e.vec_id as doc_id, row_number() over (partition by q.vec_id order by {_LIKE} desc, e.vec_id) as r
        from embeddings e join documents d on d.doc_id = e.vec_id, embeddings q where q.vec_id % 100 = 0),
    tagged as (select query_id, r, {_tags_sql("length(w) >= 9")}[1:2] || {_tags_sql("w in ('the', 'der', 'de', 'las')")}[1:1] as tags from ranked join documents using (doc_id) where r <= 5),
    every as (select query_id, flatten(list(tags order by r)) as tags from tagged group by 1)
    select query_id, array_to_string(list_filter([['q' || query_id], list_filter(tags, lambda w, i: list_position(tags, w) = i)[1:4], ['electronic music']].flatten(), lambda w: w <> ''), ' ') as enriched from every""",
)
def cmp_web_enrich(t: Tables) -> DataFrame:
    """Searches enriched by the tags of their five best chunks: two entities and a genre of each, in
    order of rank, four different ones in all."""
    from marquee.operators.vector_index import VectorIndex

    docs, vectors = t.documents, t.embeddings
    known = vectors.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    index = VectorIndex.build(known, "vec_id", "embedding", new_path(docs.sparkSession, "index"), dims=64)
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    words = F.array_distinct(F.split(F.coalesce("text", F.lit("")), " "))
    tags = F.concat(F.slice(F.filter(words, lambda w: F.length(w) >= 9), 1, 2), F.slice(F.filter(words, lambda w: w.isin("the", "der", "de", "las")), 1, 1))
    best = index.search(asked, 5).join(docs.select(F.col("doc_id").alias("key"), tags.alias("tags")), "key")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("s"), "key", "tags")))  # five a query
    four = F.slice(F.array_distinct(F.flatten(F.transform(ranked, lambda x: x["tags"]))), 1, 4)
    return best.groupBy("query_id").agg(F.array_join(F.concat(F.array(F.concat(F.lit("q"), F.first("query_id"))), four, F.array(F.lit("electronic music"))), " ").alias("enriched"))


@query(
    "cmp_analysis_rows",
    """select o_orderkey, 'artist' as kind, p_name as tag from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey
    union all select o_orderkey, 'promoter', c_name from orders join customer on c_custkey = o_custkey
    union all select o_orderkey, 'narrative', o_orderpriority from orders""",
)
def cmp_analysis_rows(t: Tables) -> DataFrame:
    few = t.orders
    row = lambda df, kind, tag: df.select("o_orderkey", F.lit(kind).alias("kind"), F.col(tag).alias("tag"))
    lines = few.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    promoters = few.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    return row(lines, "artist", "p_name").unionByName(row(promoters, "promoter", "c_name")).unionByName(row(few, "narrative", "o_orderpriority"))
