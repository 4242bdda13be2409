"""Benchmark decontamination by template canonicalisation, in DataFrame operations.

Texts become tokens: numbers, mid-sentence names and units after numbers turn into
typed placeholders (slots), other words are lower-cased. Windows of five tokens of
documents and benchmark items are hash-joined. A document holds an item if one
occurrence has at least 80 % of the item's windows and consistent slot values: each
value of the item is bound to one value of the document. Occurrences are judged one
by one, however many there are, so a question that was re-parameterised is found
like one that was copied. Windows that are spread over a document count too, if each
value of the item is bound to two values at most.

Texts are cut into blocks of BLOCK windows before windows become rows, so a row
carries a few tokens and not its text, however long that is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.shared import materialize, merged, packed, unpacked

WINDOW = 5
CONTAINMENT = 0.8
#: Windows that hold fewer plain words say little about an item and are not used.
PLAIN_WORDS = 2
#: Values of the document to each value of the item where its windows are spread;
#: no bound on a document that holds the item in one occurrence.
MAX_BINDINGS = 2
#: Benchmark windows that are broadcast; a larger index is joined by shuffling.
BROADCAST_WINDOWS = 500_000
#: Document ids that are broadcast; more of them are joined by shuffling.
BROADCAST_IDS = 1_000_000
#: Item texts that are looked for by their words, and words of each. With more texts, or one
#: without such words, all documents are read; the results are the same.
WORD_ITEMS = 64
ITEM_WORDS = 4
BLOCK = 32

UNITS = (
    "km|kms|cm|mm|nm|m|meters?|metres?|kilometers?|kilometres?|miles?|mi|feet|foot|ft|inch|inches|yards?|kg|kgs|g|grams?|"
    "mg|lbs?|pounds?|oz|ounces?|tons?|tonnes?|l|liters?|litres?|ml|gallons?|seconds?|secs?|s|ms|minutes?|mins?|hours?|hrs?|"
    "h|days?|weeks?|months?|years?|mph|kph|kmh|hz|khz|mhz|ghz|kw|kwh|mw|watts?|volts?|v|amps?|j|joules?|cal|kcal|degrees?|"
    "percent|dollars?|euros?|eur|usd|gbp|cents?|bytes?|kb|mb|gb|tb"
)
NAME_MARK, UNIT_MARK = "\x01", "\x02"
NAME = r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*"
MARK_NAMES = rf"([\p{{Ll}}0-9,;] )({NAME})"
#: Names at every position, sentences' first words too.
MARK_EVERY = rf"((?<!\p{{L}}))({NAME})"
NO_NAMES = r"(\x01)(\x01)"
MARK_UNITS = rf"([0-9] ?)({UNITS})\b"
TOKEN = rf"{NAME_MARK}{NAME}|{UNIT_MARK}\p{{L}}+|\p{{L}}+|[0-9]+(?:[.,:/][0-9]+)*"


def _flat(pattern: str) -> str:
    """The pattern with its repeated groups, which end all they stand in, possessive: the same matches. Java takes
    a piece of stack for each turn of a greedy one, so some thousand names or numbers in a row end the executor."""
    return pattern.replace("+)*", "+)*+")


def tokens(text: Column, names: str = MARK_NAMES) -> Column:
    """Words and numbers of a text, names and units behind a mark."""
    given = F.coalesce(text, F.lit(""))
    # marks are hardly ever in a text, and translate() looks up each letter
    torn = F.contains(given, F.lit(NAME_MARK)) | F.contains(given, F.lit(UNIT_MARK))
    plain = F.when(torn, F.translate(given, NAME_MARK + UNIT_MARK, "")).otherwise(given)
    marked = F.regexp_replace(plain, _flat(names), f"$1{NAME_MARK}$2")
    return F.regexp_extract_all(F.regexp_replace(marked, MARK_UNITS, f"$1{UNIT_MARK}$2"), F.lit(_flat(TOKEN)), F.lit(0))


def _is_slot(token: Column) -> Column:
    """Names and units carry their mark, numbers a digit in front; both sort before letters."""
    return token <= ":"


def _canonical(token: Column) -> Column:
    """Told by its first character: words' ones sort behind digits, the marks before all others."""
    return (
        F.when(token >= ":", F.lower(token))
        .when(token < UNIT_MARK, F.lit("<name>"))
        .when(token < "0", F.lit("<unit>"))
        .otherwise(F.lit("<number>"))
    )


def _blocks(table: DataFrame, arrays: list[str], overlap: int, least: int) -> DataFrame:
    """A row for each BLOCK tokens, `first` being its first one's place: the arrays' slices with
    `overlap` more tokens. Texts of fewer than `least` tokens have none.

    All explodes are outer: before an inner one the optimizer filters by the arrays'
    size, which computes the arrays once more, and in lambdas over and over."""
    others = [c for c in table.columns if c not in arrays]
    n = F.size(arrays[0])
    cut = lambda s: F.struct(s.alias("first"), *[F.slice(a, s + 1, BLOCK + overlap).alias(a) for a in arrays])
    blocks = F.when(n >= least, F.transform(F.sequence(F.lit(0), F.greatest(n - least, F.lit(0)), F.lit(BLOCK)), cut))
    return table.select(*others, F.explode_outer(blocks).alias("block")).where("block is not null").select(*others, "block.*")


def windows(table: DataFrame, key: str, names: str = MARK_NAMES) -> DataFrame:
    """(key, row, size, t, first, local, h) of every window: `row` is a hash of the text's tokens,
    `size` their number, t a block's tokens from place `first` on, the window starts at `local`
    in it, h is the hash of its canonical tokens. Tokens are hashed once, windows are hashes
    of five of these."""
    base = table.select(F.col(key).cast("long").alias(key), tokens(F.col("text"), names).alias("t"))
    base = base.select(key, F.xxhash64("t").alias("row"), F.size("t").alias("size"), "t", F.transform("t", lambda x: F.xxhash64(_canonical(x))).alias("c"))
    cut = _blocks(base, ["t", "c"], WINDOW - 1, WINDOW)
    # places are exploded and hashed behind that, both in generated code: a block's arrays are copied for no window but hits
    placed = cut.select(key, "row", "size", "t", "first", "c", F.explode_outer(F.sequence(F.lit(0), F.size("c") - WINDOW)).alias("local"))
    h = F.xxhash64(*[F.get("c", F.col("local") + k) for k in range(WINDOW)])
    return placed.select(key, "row", "size", "t", "first", "local", h.alias("h"))


def window_tokens() -> Column:
    return F.slice("t", F.col("local") + 1, WINDOW)


def slots(window: Column | str) -> Column:
    """The slot values of a window, in order."""
    return F.filter(window, _is_slot)


def index(benchmark: DataFrame, names: str = MARK_NAMES) -> DataFrame:
    """(item_id, h, q, item_row, item_tokens, last, row_windows, item_slots, n_windows):
    the windows of each item with enough plain words, at each place q of each of the
    item's texts; item_slots are the slot values of the window's first place by value."""
    found = windows(benchmark, "item_id", names).select(
        "item_id", "h", (F.col("first") + F.col("local")).alias("q"), F.col("row").alias("item_row"), slots(window_tokens()).alias("slots"),
        window_tokens().alias("item_tokens"), (F.col("size") - 1).alias("last"),
    )
    # written, as four readers would each cut the benchmark into windows, all in one plan
    places = materialize(found.where(WINDOW - F.size("slots") >= PLAIN_WORDS).dropDuplicates(["item_id", "item_row", "q"]), "places")
    once = places.groupBy("item_id", "h").agg(F.min("slots").alias("item_slots"))
    counts = once.groupBy("item_id").agg(F.count("*").alias("n_windows"))
    rows = places.groupBy("item_id", "item_row").agg(F.count("*").alias("row_windows"))
    return places.drop("slots").join(merged(once), ["item_id", "h"]).join(merged(counts), "item_id").join(merged(rows), ["item_id", "item_row"])


def _bound_values() -> Column:
    """(a, b) of a window's slots: the item's value and the document's. The item's
    outermost tokens bind nothing, as names next to them may run on in the document."""
    at = F.sequence(F.lit(0), F.lit(WINDOW - 1))
    pairs = F.zip_with(at, F.arrays_zip(F.col("item_tokens").alias("a"), F.col("doc_tokens").alias("b")), lambda i, p: F.struct(i.alias("i"), p.alias("p")))
    inner = lambda x: _is_slot(x["p"]["a"]) & ((F.col("q") + x["i"]) > 0) & ((F.col("q") + x["i"]) < F.col("last"))
    return F.transform(F.filter(pairs, inner), lambda x: x["p"])


def _occurrences(hits: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows) that an occurrence shows: windows at one distance
    (place in the document minus place in the item), or in the item's order where
    something was put in between."""
    text = ["doc_id", "doc_row", "item_id", "item_row", "n_windows", "row_windows"]
    order = Window.partitionBy(*text).orderBy("at", "q")
    back = F.coalesce(F.col("q") <= F.lag("q").over(order), F.lit(True)).cast("long")
    aligned = hits.select(*text, "h", "q", "at", _bound_values().alias("bound"), (F.col("at") - F.col("q")).cast("long").alias("run"), F.lit(0).alias("way"))
    ordered = aligned.withColumn("__back", back).withColumn("run", F.sum("__back").over(order)).drop("__back").withColumn("way", F.lit(1))
    per_run = (
        aligned.unionByName(ordered)
        .select(*text, "way", "run", "h", "q", F.explode_outer("bound").alias("p"))
        .groupBy(*text, "way", "run")
        .agg(
            F.count_distinct("q").alias("places"), F.count_distinct("p.a").alias("values"),
            F.count_distinct("p.a", "p.b").alias("bindings"), F.collect_set("h").alias("hs"),
        )
        .where((F.col("places") >= CONTAINMENT * F.col("row_windows")) & (F.col("bindings") == F.col("values")))
    )
    shown = per_run.select("doc_id", "item_id", "n_windows", F.explode("hs").alias("h")).groupBy("doc_id", "item_id", "n_windows")
    return shown.agg(F.count_distinct("h").alias("n")).where(F.col("n") >= CONTAINMENT * F.col("n_windows")).drop("n")


def _hits(docs: DataFrame, known: DataFrame, names: str) -> DataFrame:
    """The documents' windows that are in the written index `known`, written."""
    if known.count() <= BROADCAST_WINDOWS:
        known = F.broadcast(known)
    # equal hashes propose, equal canonical windows decide; token by token, as a lambda in the
    # join's condition would keep the join out of generated code and copy every window's block
    same = [_canonical(F.get("t", F.col("local") + k)) == _canonical(F.get("item_tokens", F.lit(k))) for k in range(WINDOW)]
    hits = windows(docs, "doc_id", names).join(known, "h").where(reduce(Column.__and__, same)).withColumn("doc_tokens", window_tokens())
    hits = hits.withColumn("at", F.col("first") + F.col("local")).withColumn("doc_slots", slots("doc_tokens"))
    return materialize(hits.withColumnRenamed("row", "doc_row").drop("t", "first", "local", "size"), "hits")


def _held(hits: DataFrame, only_occurrences: bool = False) -> DataFrame:
    """The rows of contamination() that the hits show: occurrences, and windows that are spread."""
    # a row for each bound pair, and one without a pair for a window without slots
    pairs = F.zip_with("item_slots", "doc_slots", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    bound = (
        hits.select("doc_id", "item_id", "n_windows", "h", F.explode_outer(pairs).alias("p"))
        .groupBy("doc_id", "item_id", "n_windows", "h", "p.a", "p.b")
        .agg(F.lit(1).alias("one"))
    )
    bound = materialize(bound, "bound")
    item = ["doc_id", "item_id", "n_windows"]
    widest = bound.groupBy(*item, "a").agg(F.count_distinct("b").alias("b")).groupBy(*item).agg(F.max("b").alias("widest"))
    per_item = bound.groupBy(*item).agg(
        F.count_distinct("h").alias("n_matched"),
        F.max(F.coalesce(F.col("a") != F.col("b"), F.lit(False))).alias("reparameterised"),
    ).join(merged(widest), item)
    shown = materialize(_occurrences(hits).select("doc_id", "item_id", F.lit(True).alias("shown")), "shown")
    if only_occurrences:
        per_item = per_item.withColumn("widest", F.lit(None).cast("long"))
    spread = (F.col("n_matched") >= CONTAINMENT * F.col("n_windows")) & (F.col("widest") <= MAX_BINDINGS)
    return per_item.join(merged(shown), ["doc_id", "item_id"], "left").where(F.coalesce(spread, F.lit(False)) | F.coalesce("shown", F.lit(False))).select(
        "doc_id", "item_id", "n_windows", "n_matched",
        (F.col("n_matched") / F.col("n_windows")).alias("containment"), "reparameterised",
    )


def _bounded(ids: DataFrame) -> DataFrame:
    """Written ids, broadcast if they are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _words_needed(known: DataFrame) -> list[list[str]] | None:
    """For each item's text words of which a document that holds it lacks none: those in more
    places of the text than may be missing. None if a text has no such word, or texts are many.
    Words are compared as parts of the lower-case text, which is sure for ASCII letters."""
    text = ["item_id", "item_row", "row_windows"]
    places = known.select(*text, "q", F.explode("item_tokens").alias("word")).where(~_is_slot(F.col("word")))
    places = places.groupBy(*text, F.lower("word").alias("word")).agg(F.count_distinct("q").alias("n"))
    may_miss = F.col("row_windows") - F.ceil(F.lit(CONTAINMENT) * F.col("row_windows") - 1e-9)
    needed = F.when((F.col("n") > may_miss) & F.col("word").rlike("^[a-z]+$"), F.struct(F.length("word").alias("l"), "word"))
    longest = F.slice(F.sort_array(F.collect_list(needed), asc=False), 1, ITEM_WORDS)
    rows = places.groupBy(*text).agg(longest.alias("words")).select("words.word").limit(WORD_ITEMS + 1).collect()
    return None if len(rows) > WORD_ITEMS or not all(r.word for r in rows) else [r.word for r in rows]


def _may_hold(docs: DataFrame, known: DataFrame, inside_hits: DataFrame) -> DataFrame:
    """All rows of the documents that may hold an item of `known`, the index by every name.

    A window without a name is the same in both readings. Where more of an item's windows
    are without a name than may be missing, a document that holds it has at least the
    difference among the hits of the other reading. Of other items it has the needed words.
    """
    nameless = ~F.exists("item_tokens", lambda x: F.substring(x, 1, 1) == NAME_MARK)
    counted = known.groupBy("item_id", "n_windows").agg(
        F.count_distinct("h").alias("all"), F.count_distinct(F.when(nameless, F.col("h"))).alias("plain")
    )
    missing = F.col("all") - F.ceil(F.lit(CONTAINMENT) * F.col("n_windows") - 1e-9)
    least = materialize(counted.select("item_id", (F.col("plain") - missing).alias("least")), "least-hits")
    words = _words_needed(known.join(least.where("least <= 0"), "item_id", "left_semi"))
    if words is None:
        return docs
    plain = known.where(nameless).select("item_id", "h").distinct().join(least.where("least > 0"), "item_id")
    met = inside_hits.select("doc_id", "item_id", "h").join(F.broadcast(plain) if plain.count() <= BROADCAST_WINDOWS else plain, ["item_id", "h"])
    ids = met.groupBy("doc_id", "item_id", "least").agg(F.count_distinct("h").alias("n")).where("n >= least").select("doc_id")
    if words:
        low = F.lower("text")
        every = [reduce(Column.__and__, [F.contains(low, F.lit(w)) for w in of_text]) for of_text in words]
        # marks are taken out of a text before it is read, so words in it may be torn
        torn = F.contains("text", F.lit(NAME_MARK)) | F.contains("text", F.lit(UNIT_MARK))
        ids = ids.unionByName(docs.where(reduce(Column.__or__, every, torn)).select(F.col("doc_id").cast("long").alias("doc_id")))
    ids = materialize(ids.select(F.col("doc_id").alias("__id")).distinct(), "may-hold")
    return docs.join(_bounded(ids), F.col("doc_id").cast("long") == F.col("__id"), "left_semi")


def _held_by_every_name(docs: DataFrame, benchmark: DataFrame, inside: DataFrame, inside_hits: DataFrame) -> DataFrame:
    """The rows of contamination() with names read at every position; only occurrences count, and
    an item has as many windows as it has in the other reading (the index `inside`) at least.
    Only documents that may hold an item are read again."""
    least = inside.select("item_id", F.col("n_windows").alias("at_least")).distinct()
    enough = F.greatest("n_windows", F.coalesce("at_least", "n_windows"))
    known = index(benchmark, MARK_EVERY).join(merged(least), "item_id", "left").withColumn("n_windows", enough).drop("at_least")
    known = materialize(known, "items-every-name")
    return _held(_hits(_may_hold(docs, known, inside_hits), known, MARK_EVERY), only_occurrences=True)


def _short_items(benchmark: DataFrame, known: DataFrame) -> DataFrame:
    """(item_id, words): texts of items without a window in the written index `known`, as lower-case tokens."""
    held = known.select("item_id").distinct()
    words = F.transform(tokens(F.col("text"), NO_NAMES), lambda x: F.lower(F.translate(x, UNIT_MARK, "")))
    whole = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words.alias("words"))
    return whole.where(F.size("words") > 0).join(merged(held), "item_id", "left_anti").distinct()


def _held_whole(docs: DataFrame, short: DataFrame, lengths: list[int], longest: int) -> DataFrame:
    """The rows of contamination() for items without a window: all tokens of each of the
    item's texts in a row, unchanged but for case. The texts count as windows. An item is
    looked up by its first `lengths` tokens; `longest` is the longest item's size."""
    words = F.transform(tokens(F.col("text"), NO_NAMES), lambda x: F.lower(F.translate(x, UNIT_MARK, "")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("t"))
    cut = _blocks(texts, ["t"], longest - 1, min(lengths))
    heads = []
    for n in lengths:
        starts = F.sequence(F.lit(0), F.greatest(F.least(F.size("t") - n, F.lit(BLOCK - 1)), F.lit(0)))
        head = lambda i: F.struct(F.xxhash64(F.lit(n), *[F.get("t", i + k) for k in range(n)]).alias("h"), i.alias("at"))  # noqa: B023, E731
        heads.append(F.when(F.size("t") >= n, F.transform(starts, head)).otherwise(F.array().cast("array<struct<h:bigint,at:int>>")))
    found = cut.select("doc_id", "t", F.explode_outer(F.concat(*heads)).alias("w")).select("doc_id", "t", "w.h", "w.at")
    counts = short.groupBy("item_id").agg(F.count("*").alias("n_windows"))
    by_length = F.coalesce(*[
        F.when(F.least(F.size("words"), F.lit(WINDOW)) == n, F.xxhash64(F.lit(n), *[F.get("words", F.lit(k)) for k in range(n)])) for n in lengths
    ])
    known = short.join(merged(counts), "item_id").withColumn("h", by_length)
    known = materialize(known, "short-index")
    if known.count() <= BROADCAST_WINDOWS:
        known = F.broadcast(known)
    hits = found.join(known, "h").where(F.slice("t", F.col("at") + 1, F.size("words")) == F.col("words"))
    per_item = hits.groupBy("doc_id", "item_id", "n_windows").agg(F.count_distinct("words").alias("n_matched"))
    return per_item.where(F.col("n_matched") >= CONTAINMENT * F.col("n_windows")).select(
        "doc_id", "item_id", "n_windows", "n_matched",
        (F.col("n_matched") / F.col("n_windows")).alias("containment"), F.lit(False).alias("reparameterised"),
    )


def _classes(benchmark: DataFrame) -> DataFrame:
    """(item_id, texts, first): an item's different texts and the least item with the same ones."""
    text = F.sort_array(F.collect_set(F.coalesce("text", F.lit("")))).alias("texts")
    items = benchmark.groupBy(F.col("item_id").cast("long").alias("item_id")).agg(text)
    return materialize(items.withColumn("first", F.min("item_id").over(Window.partitionBy("texts"))), "classes")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, containment, reparameterised), a row for
    each document and benchmark item it holds.

    docs has doc_id and text, benchmark item_id and text; null is an empty text, other
    columns are not read. Names are read in two ways: as capitalised words within a
    sentence (these figures come out where both hold), and at every position. Items
    without a window (fewer than five tokens, or no window of two plain words) are
    held where all their tokens stand in a row. Rows with the same doc_id count as one
    document, rows with the same item_id as one item; a null id is in no row. n_matched
    counts windows of the whole document, and `reparameterised` tells that a slot value
    differs anywhere in it. Without documents or items there are no rows. Items with the
    same texts are judged once, so hits grow with different items only.
    """
    docs, classes = docs.where("doc_id is not null"), _classes(benchmark.where("item_id is not null"))
    benchmark = classes.where("item_id = first").select("item_id", F.explode("texts").alias("text"))
    known = materialize(index(benchmark), "items")
    hits = _hits(docs, known, MARK_NAMES)
    inside = _held(hits)
    ways = [inside, _held_by_every_name(docs, benchmark, known, hits)]
    short = materialize(_short_items(benchmark, known), "short-items")
    sizes = short.groupBy(F.least(F.size("words"), F.lit(WINDOW)).alias("n")).agg(F.max(F.size("words")).alias("longest")).collect()
    if sizes:  # WINDOW rows at most
        ways.append(_held_whole(docs, short, sorted(r.n for r in sizes), max(r.longest for r in sizes)))
    # each written for itself: in one plan their exchanges would be planned and held by the driver at once
    every = [materialize(w.withColumn("way", F.lit(k)), "held") for k, w in enumerate(ways)]
    row = F.min_by(F.struct(*inside.columns), "way")
    found = reduce(DataFrame.unionByName, every).groupBy("doc_id", "item_id").agg(row.alias("row")).select("row.*")
    named = found.withColumnRenamed("item_id", "first").join(merged(classes.select("first", "item_id")), "first")
    return named.select(*inside.columns)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the rows that hold a benchmark item. Rows are judged by themselves
    (as doc_id and text), so one with a null doc_id, or that of another row, goes only if
    its own text holds an item. Other columns are carried whatever their names."""
    given, docs = docs, packed(docs)
    row = F.xxhash64("doc_id", "text")
    held = contamination(docs.select(row.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("__held")).distinct()
    return unpacked(docs.join(_bounded(materialize(held, "held")), row == F.col("__held"), "left_anti"), given)


_SQL_TOKENS = f"""regexp_extract_all(regexp_replace(regexp_replace(
    translate(coalesce(text, ''), chr(1) || chr(2), ''), '{MARK_NAMES}', '\\1' || chr(1) || '\\2', 'g'),
    '{MARK_UNITS}', '\\1' || chr(2) || '\\2', 'g'), '{TOKEN.replace(NAME_MARK, "\\x01").replace(UNIT_MARK, "\\x02")}')"""
_SQL_SLOT = "regexp_matches(x, '^[\\x01\\x020-9]')"


def _sql_windows(table: str, key: str) -> str:
    return f"""
    select {key}, array_to_string(list_transform(w, lambda x: case when x[1] = chr(1) then '<name>' when x[1] = chr(2)
        then '<unit>' when regexp_matches(x[1], '[0-9]') then '<number>' else lower(x) end), ' ') as h,
        list_filter(w, lambda x: {_SQL_SLOT}) as slots
    from (select {key}, unnest(list_transform(range(len(t) - {WINDOW - 1}), lambda i: t[i + 1 : i + {WINDOW}])) as w
        from (select {key}, {_SQL_TOKENS} as t from {table}) where len(t) >= {WINDOW})"""


ORACLE_SQL = f"""
with item_windows as ({_sql_windows("benchmark", "item_id")}),
once as (select item_id, h, min(slots) as item_slots from item_windows
    where {WINDOW} - len(slots) >= {PLAIN_WORDS} group by item_id, h),
items as (select *, count(*) over (partition by item_id) as n_windows from once),
hits as (select doc_id, item_id, n_windows, h, item_slots, slots from ({_sql_windows("documents", "doc_id")}) join items using (h)),
pairs as (select doc_id, item_id, unnest(item_slots) as a, unnest(slots) as b from hits where len(slots) > 0),
bound as (select doc_id, item_id, max(n) as widest, bool_or(differs) as differs from (select doc_id, item_id, a,
    count(distinct b) as n, bool_or(a <> b) as differs from pairs group by doc_id, item_id, a) group by doc_id, item_id),
matched as (select doc_id, item_id, n_windows, count(distinct h) as n_matched from hits group by doc_id, item_id, n_windows)
select doc_id, item_id, n_windows, n_matched, n_matched / n_windows as containment,
    coalesce(differs, false) as reparameterised
from matched left join bound using (doc_id, item_id)
where n_matched >= {CONTAINMENT} * n_windows and coalesce(widest, 0) <= {MAX_BINDINGS}
"""
