"""Sources: text, pages, listings, dumps, link graphs; and the sinks that mirror them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators.tables import written


def read_text_files(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """Whole files of a folder (path, source_id, n_bytes, text), known source_ids left
    out; any store that Spark reads."""
    files = spark.read.format("binaryFile").load(path)
    rows = files.select(
        "path", F.sha2("content", 256).alias("source_id"), F.col("length").alias("n_bytes"), F.decode("content", "UTF-8").alias("text")
    )
    return rows if known is None else unseen(rows, known, "source_id")


def read_xml_dump(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Records of a catalogue dump; those without id or name are dropped."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).where("id is not null and name is not null")


def unseen(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key).distinct(), key, "left_anti")


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line) of every line, numbered from 0."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?s)<title[^>]*>(.*?)</title>", 1))


#: Elements that are no text of the article.
FURNITURE = ("script", "style", "noscript", "template", "head", "nav", "header", "footer", "aside", "form")
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&amp;", "&"))


def main_text(html: Column) -> Column:
    """The article's text (that of the page without an article or main element) without
    furniture and tags, references decoded, white space as single spaces."""
    page = F.coalesce(html, F.lit(""))
    for tag in FURNITURE:
        page = F.regexp_replace(page, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    article = [F.regexp_extract(page, rf"(?is)<{tag}\b[^>]*>(.*)</{tag}>", 1) for tag in ("article", "main")]
    body = F.coalesce(*[F.when(a != "", a) for a in article], page)
    text = F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->", " "), r"<[^>]+>", " ")
    for name, character in REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(character))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def decoded_sql(text: str) -> str:
    """A text with its references decoded, as SQL."""
    for name, character in REFERENCES:
        text = "replace({}, '{}', '{}')".format(text, name, character.replace("'", "''"))
    return text


def main_text_sql(html: str) -> str:
    """`main_text` as SQL."""
    page = f"coalesce({html}, '')"
    for tag in FURNITURE:
        page = rf"regexp_replace({page}, '(?is)<{tag}\b.*?</{tag}>', ' ', 'g')"
    article = [rf"nullif(regexp_extract(page, '(?is)<{tag}\b[^>]*>(.*)</{tag}>', 1), '')" for tag in ("article", "main")]
    text = rf"regexp_replace(regexp_replace(body, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')"
    text = decoded_sql(text)
    return f"""select page_id, trim(regexp_replace({text}, '\\s+', ' ', 'g')) as text from
        (select page_id, coalesce({', '.join(article)}, page) as body from (select page_id, {page} as page from pages))"""


def html_documents(pages: DataFrame, least_chars: int) -> DataFrame:
    """(page_id, title, n_chars): pages with enough text and their first heading."""
    plain = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style|head)\b.*?</\1>", " "), r"<[^>]+>", " ")
    text = F.trim(F.regexp_replace(plain, r"\s+", " "))
    heading = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>", 1), r"<[^>]+>", ""))
    rows = pages.select("page_id", heading.alias("title"), F.length(text).alias("n_chars"))
    return rows.where(F.col("n_chars") >= least_chars)


def parse_listing(rows: DataFrame, key: str, ts: str, props: str) -> DataFrame:
    """Event listings from JSON with defaults for what is missing."""
    found = F.from_json(props, "k int, title string")
    return rows.select(
        key, F.coalesce(found["k"], F.lit(0)).alias("attending"), F.coalesce(found["title"], F.lit("Untitled")).alias("title"),
        F.date_format(ts, "yyyy-MM-dd").alias("event_date"),
    )


def archive_index(rows: DataFrame, url: str, include: str, exclude: str) -> DataFrame:
    """Distinct URLs without trailing slashes that match one pattern and not the other."""
    plain = F.regexp_replace(url, r"/+$", "")
    kept = rows.where(F.col(url).rlike(include) & ~F.col(url).rlike(exclude))
    return kept.select(plain.alias("url")).distinct()


def crawl(links: DataFrame, seeds: list, max_depth: int) -> DataFrame:
    """(page, depth) of the pages within `max_depth` links (source, target) of the seeds.

    Breadth first: a join for each level, whose number is a parameter, and an
    anti-join against what was reached before.
    """
    spark = links.sparkSession
    kind = links.schema["source"].dataType.simpleString()
    reached = spark.createDataFrame([(s, 0) for s in seeds], f"page {kind}, depth int")
    frontier = reached
    links = written(links.select("source", "target").distinct(), "links")
    for depth in range(1, max_depth + 1):
        following = frontier.join(links, F.col("page") == F.col("source")).select(F.col("target").alias("page")).distinct()
        # a level is written, so that the next ones do not compute it again
        frontier = written(following.join(reached.select("page"), "page", "left_anti").withColumn("depth", F.lit(depth)), "level")
        reached = reached.unionByName(frontier)
    return reached


def parse_release_xml(rows: DataFrame, xml: str) -> DataFrame:
    """(id, name, styles) of records; those without an id or a name are dropped."""
    found = F.from_xml(xml, "id long, name string, style array<string>")
    parsed = rows.select(found.alias("r")).select("r.id", "r.name", F.col("r.style").alias("styles"))
    return parsed.where("id is not null and name is not null")


def event_text(title: Column, ts: Column, attending: Column) -> Column:
    """An event as key: value lines."""
    return F.concat_ws(
        "\n", F.concat(F.lit("Event: "), title), F.concat(F.lit("Date: "), F.date_format(ts, "yyyy-MM-dd")),
        F.concat(F.lit("Attending: "), F.format_number(attending, 0)),
    )


def write_event_corpus(rows: DataFrame, key: str, ts: str, tie: str, block: Column, path: str) -> None:
    """Event blocks in text files by key, in order of time within a file and over a key's files."""
    dealt = rows.select(key, ts, tie, block.alias("value")).repartitionByRange(key, ts, tie).sortWithinPartitions(key, ts, tie)
    dealt.select(key, "value").write.mode("overwrite").partitionBy(key).text(path)


def read_event_corpus(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, number, event, date) of the numbered blocks between `---` lines, null where a block
    has no such line; a file of any length is read by many tasks."""
    blocks = spark.read.schema(f"value string, {key} string").option("lineSep", "\n---\n").text(path)
    field = lambda k: F.nullif(F.regexp_extract("value", rf"(?m)^{k}: (.*)$", 1), F.lit(""))
    found = blocks.select(key, field("Number").cast("long").alias("number"), field("Event").alias("event"), field("Date").alias("date"))
    return found.where("number is not null")


def write_jsonl(df: DataFrame, path: str) -> None:
    """A checkpoint as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_text_by(df: DataFrame, cluster: str, text: str, path: str) -> None:
    """Texts in a folder for each cluster."""
    df.select(cluster, F.col(text).alias("value")).write.mode("overwrite").partitionBy(cluster).text(path)


def write_files(rows: DataFrame, cluster: str, order: str, line: str, path: str) -> None:
    """One text file for each cluster, its lines in order; clusters are files, so bounded."""
    dealt = rows.repartition(cluster).sortWithinPartitions(cluster, order)
    dealt.select(cluster, F.col(line).alias("value")).write.mode("overwrite").partitionBy(cluster).text(path)


def upsert_parquet(current: DataFrame, changes: DataFrame, key: list[str], version: str, path: str) -> None:
    """The newest version of each key of both tables, written to a new path."""
    from marquee.operators.history import latest

    latest(current.unionByName(changes, allowMissingColumns=True), key, [version]).write.mode("overwrite").parquet(path)
