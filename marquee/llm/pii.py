"""Personal data: e-mail and network addresses, card and phone numbers, by gradient-boosted candidates.

High-recall generators propose spans of each kind, and they may overlap. A base span is a
proposal that its kind's format check accepts; it always stays. All others are scored by
boosted trees of depth two over format and context features, and added where the score
reaches the kind's calibrated threshold.

The trees learn from the corpus itself. Base spans are positive, as they stand and with
the mark that makes them certain taken away (the plus of a phone, the check digit of a
card, an address spelled out); all other proposals count as negative. So a proposal is
added only where its features are those of base spans far more often than of anything
else. The training table has a row for each vector of features met, with counts over all
documents, so its size is bounded by the features and not by the corpus.

Only built-in functions and SQL run on the executors. A document's spans stay arrays in
its row, so finding and scoring them shuffles nothing; running sums over an array go in
chunks, so the cost of a long text grows little faster than its number of spans.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.shared import materialize

KINDS = ("email", "ip", "card", "phone")
MATCH = "struct<start:long,end:long,kind:int,base:boolean,m:string,before:string,after:string>"
CHUNK = 128

#: Leftmost matches of the base forms. Possessive parts and look-behinds keep the matches
#: of the plain forms but never try a run of characters twice.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
AT, DOT = r"(?i:\x20?[\[({<]\x20?at\x20?[\])}>]\x20?)", r"(?i:\x20?[\[({<]\x20?dot\x20?[\])}>]\x20?)"
#: Further proposals of each kind, wider than the base forms.
WIDE = {
    "email": rf"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:(?:{AT}|\x20?@\x20?)[A-Za-z0-9-]++(?:(?:\.|{DOT}|(?i:\x20dot\x20))[A-Za-z0-9-]++)++"
    r"|(?i:\x20at\x20)[A-Za-z0-9-]++(?:(?i:\x20dot\x20)[A-Za-z0-9-]++)++)",
    "ip": r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])",
    "card": r"(?=[0-9])(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[0-9]{0,3}|[\x20-]?[0-9]{6}[\x20-]?[0-9]{5})(?![0-9])",
    "phone": r"(?=[+(0-9])(?<![0-9A-Za-z+.(])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[\x20().-]{1,2}[0-9]{2,5}){1,5}(?![0-9A-Za-z])",
}
#: What a text must hold for a kind's patterns to match at all, beside a digit (an address: beside `@` or its words).
NEEDED = {"ip": r"[0-9]\.[0-9]|:[0-9A-Fa-f]{0,4}:", "card": r"[0-9][\x20-]?[0-9]", "phone": r"[0-9]{2}|\+[0-9]"}
BYTE = r"0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
IP = rf"^{BYTE}(?:\.{BYTE}){{3}}$"


@dataclass(frozen=True)
class Boosting:
    """Size and step of the model, rows that either side of a split has; the precision that thresholds must reach on held-out documents."""

    trees: int = 10
    step: float = 0.4
    smoothing: float = 1.0
    least_rows: int = 20
    precision: float = 0.95
    least_positives: int = 5
    held_out_of: int = 5


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """An expression that uses `value` several times and computes it once."""
    return F.transform(F.array(value), then)[0]


def running(values: Column, merge: Callable[[Column, Column], Column], zero: int) -> Column:
    """Inclusive running merges over an array of longs, by chunks and then over the chunks."""
    none = F.array().cast("array<long>")
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(zero).cast("long"))
    grow = lambda a, x: F.concat(a, F.array(merge(last(a), x)))
    inner = lambda v: F.transform(
        F.sequence(F.lit(0), (F.size(v) / CHUNK).cast("int")), lambda c: F.reduce(F.slice(v, c * CHUNK + 1, CHUNK), none, grow)
    )
    shift = lambda part, before: F.transform(part, lambda x: merge(before, x))

    def joined(parts: Column) -> Column:
        before = F.reduce(parts, F.array(F.lit(zero).cast("long")), lambda a, p: grow(a, last(p)))
        return F.flatten(F.zip_with(parts, F.slice(before, 1, F.size(parts)), shift))

    return let(let(values, inner), joined)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check-digit sum."""
    at = lambda i: F.ascii(F.substr(number, F.length(number) - i, F.lit(1))) - 48
    doubled = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    total = F.reduce(
        F.sequence(F.lit(0), F.length(number) - 1),
        F.lit(0),
        lambda s, i: s + F.when(i % 2 == 0, at(i)).otherwise(doubled(at(i))),
    )
    return (F.length(number) > 0) & (total % 10 == 0)


def _is_base(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    if kind == "ip":
        return m.rlike(IP)
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits(m))).otherwise(F.lit(False))
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _cue(words: str) -> Callable[[Column, Column, Column], Column]:
    return lambda m, before, after: before.rlike(rf"(?i)(?<![a-z])(?:{words})[^a-z0-9]{{0,4}}$")


def _size(least: int, most: int) -> Callable[[Column, Column, Column], Column]:
    return lambda m, before, after: F.length(digits(m)).between(least, most)


def _form(pattern: str) -> Callable[[Column, Column, Column], Column]:
    return lambda m, before, after: m.rlike(pattern)


#: Yes-no features of a match, the 24 characters before it and the 8 after it; a bit each.
FEATURES: dict[str, Callable[[Column, Column, Column], Column]] = {
    "digits_7_9": _size(7, 9),
    "digits_10_12": _size(10, 12),
    "digits_13_15": _size(13, 15),
    "digits_16_19": _size(16, 19),
    "plus": _form(r"^(?:\+|00)"),
    "parentheses": _form(r"\("),
    "solid": lambda m, before, after: ~m.rlike(r"[^0-9+]"),
    "dotted": _form(r"^[0-9]++(?:\.[0-9]++)++$"),
    "date": _form(r"^(?:[0-9]{4}([-. ])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-. ])[0-9]{2}\2[0-9]{4})$"),
    "check_digit": lambda m, before, after: F.when(F.length(digits(m)).between(13, 19), luhn(digits(m))).otherwise(F.lit(False)),
    "at_sign": _form("@"),
    "spelled": _form(rf"{AT}|{DOT}"),
    "plain_words": _form(r"(?i)\x20(?:at|dot)\x20"),
    "top_level": _form(r"(?i)[a-z]{2,6}$"),
    "local_digit": _form(r"^[^@ \[({<]{0,64}[0-9._]"),
    "eight_groups": _form("^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$"),
    "clock": _form("^[0-9]{1,2}(?::[0-9]{2}){1,2}$"),
    "glued_before": lambda m, before, after: before.rlike(r"[^\s(\[<\"':;,|]$"),
    "glued_after": lambda m, before, after: after.rlike(r"^[^\s)\]>\"':;,.!?|]"),
    "phone_cue": _cue("tel|telephone|phone|mobile|mob|cell|call|fax|telefon|tél|teléfono|whatsapp"),
    "card_cue": _cue("card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta"),
    "mail_cue": _cue("e-?mail|mail|contact|write to|kontakt|correo|courriel"),
    "address_cue": _cue("ip|host|server|address|adresse|from"),
    "number_cue": _cue("token|key|hash|id|isbn|version|order|invoice|no|nr|ref|doi|page|article"),
}
BIT = {name: 1 << i for i, name in enumerate(FEATURES)}
#: The mark of certainty that a kind's positives are also learned without, and what stands for it.
MASKED = {
    "email": (BIT["at_sign"], BIT["spelled"]),
    "ip": (0, 0),
    "card": (BIT["check_digit"], 0),
    "phone": (BIT["plus"], 0),
}


def _bits(m: Column, before: Column, after: Column) -> Column:
    on = [F.when(test(m, before, after), BIT[name]).otherwise(0).cast("long") for name, test in FEATURES.items()]
    return reduce(Column.__add__, on)


def _matches(text: Column, pattern: str, span: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """Spans of the leftmost non-overlapping matches, with their offsets in code points.

    The text split at the matches gives the gaps, and running lengths of both the offsets.
    """

    def placed(found: Column) -> Column:
        gaps, hits = found["gaps"], found["hits"]
        lengths = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, m: (F.length(g) + F.length(m)).cast("long"))
        return F.zip_with(
            F.arrays_zip(hits.alias("m"), running(lengths, Column.__add__, 0).alias("end")),
            F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("before"), F.slice(gaps, 2, F.size(hits)).alias("after")),
            lambda hit, gap: span(
                hit["m"],
                hit["end"],
                F.right(gap["before"], F.lit(24)),
                F.left(gap["after"], F.lit(8)),
            ),
        )

    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("hits"))
    return let(found, placed)


def _flags(text: Column) -> dict[str, Column]:
    """Cheap tests that spare most texts the patterns."""
    at = text.contains("@")
    return {"digit": text.rlike("[0-9]"), "at": at, "spelled": at | text.contains(" dot ") | text.contains(" DOT ") | text.rlike(r"[aA][tT]\x20?[\])}>]")}


def _spans(text: Column, kind: str, base: bool) -> Column:
    """The base spans of a kind, or its further proposals; needs the columns of `_flags`."""
    number = KINDS.index(kind)

    def span(m: Column, end: Column, before: Column, after: Column) -> Column:
        fields = [end - F.length(m), end, F.lit(number), _is_base(kind, m) if base else F.lit(False), m, before, after]
        return F.struct(*[f.alias(n) for f, n in zip(fields, ("start", "end", "kind", "base", "m", "before", "after"))]).cast(MATCH)

    all_spans = _matches(text, (BASE if base else WIDE)[kind], span)
    kept = F.filter(all_spans, lambda s: s["base"]) if base else all_spans
    may = F.col("at" if base else "spelled") if kind == "email" else F.col("digit") & text.rlike(NEEDED[kind])
    return F.when(may, kept).otherwise(F.array().cast(f"array<{MATCH}>"))


def _clear_of_base(spans: Column) -> Column:
    """The proposals of a start-ordered array that overlap no base span of it."""
    nowhere = (1 << 62) - 1
    ends = F.transform(spans, lambda s: F.when(s["base"], s["end"]).otherwise(-1).cast("long"))
    starts = F.transform(spans, lambda s: F.when(s["base"], -s["start"]).otherwise(-nowhere).cast("long"))
    reached = running(ends, F.greatest, -1)
    following = F.reverse(running(F.reverse(starts), F.greatest, -nowhere))
    marked = F.zip_with(spans, F.arrays_zip(reached.alias("r"), following.alias("f")), lambda s, x: F.struct(s.alias("s"), x.alias("x")))
    free = F.filter(marked, lambda y: ~y["s"]["base"] & (y["x"]["r"] <= y["s"]["start"]) & (-y["x"]["f"] >= y["s"]["end"]))
    return F.transform(free, lambda y: y["s"])


def propose(docs: DataFrame, held_out_of: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """The written table (carried columns, doc_id, held, base, proposed): arrays of spans of each row."""
    text = F.col("text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % held_out_of == 0, F.lit(False))
    own = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)] or [F.lit(0).alias("none")])
    texts = docs.select(
        own.alias("carried"),
        F.col("doc_id").cast("long").alias("doc_id"),
        held.alias("held"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = texts.withColumns(_flags(text)).select(
        "carried",
        "doc_id",
        "held",
        F.concat(*[_spans(text, k, base) for base in (True, False) for k in KINDS]).alias("found"),
    )
    seen = lambda s: F.struct(*[s[n].alias(n) for n in ("start", "end", "kind", "base")], _bits(s["m"], s["before"], s["after"]).alias("bits"))
    spans = rows.select("carried", "doc_id", "held", F.transform("found", seen).alias("found"))
    clear = F.when(F.exists("found", lambda s: ~s["base"]), let(F.array_sort("found"), _clear_of_base)).otherwise(F.slice("found", 1, 0))
    return materialize(
        spans.select("carried", "doc_id", "held", F.filter("found", lambda s: s["base"]).alias("base"), clear.alias("proposed")), "spans"
    )


def training_table(spans: DataFrame) -> DataFrame:
    """(kind, bits, held, pos, neg): counts of each vector of features, over all documents."""
    kind, bits = F.col("s.kind"), F.col("s.bits")
    masked = reduce(
        lambda rest, k: F.when(kind == KINDS.index(k), bits.bitwiseAND(~MASKED[k][0]).bitwiseOR(MASKED[k][1])).otherwise(rest), KINDS, bits
    )
    base = spans.select("held", F.explode("base").alias("s"))
    rows = (
        base.select("held", kind.alias("kind"), bits.alias("bits"), F.lit(1).alias("pos"))
        .unionByName(base.select("held", kind.alias("kind"), masked.alias("bits"), F.lit(1).alias("pos")))
        .unionByName(spans.select("held", F.explode("proposed").alias("s")).select("held", kind.alias("kind"), bits.alias("bits"), F.lit(0).alias("pos")))
    )
    counts = rows.groupBy("kind", "bits", "held").agg(F.sum("pos").alias("pos"), F.sum(1 - F.col("pos")).alias("neg"))
    return materialize(counts, "training")


#: A tree of depth two: the root's bit, and for either side a bit and the values without and with it.
Tree = tuple[int, tuple[tuple[int, float, float], tuple[int, float, float]]]


def leaf(bits: Column, tree: Tree) -> Column:
    """The value of the leaf that a vector of features reaches."""
    has = lambda b: bits.bitwiseAND(b) != 0
    root, sides = tree
    without, within = (F.when(has(b), F.lit(on)).otherwise(F.lit(off)) for b, off, on in sides)
    return F.when(has(root), within).otherwise(without)


def by_kind(kind: Column, values: dict[int, Column], rest: Column) -> Column:
    return reduce(lambda other, k: F.when(kind == k, values[k]).otherwise(other), values, rest)


def probability(margin: Column) -> Column:
    """From 0 to 1, on a grid of 1/1000."""
    return F.round(1 / (1 + F.exp(-margin)), 3)


@dataclass(frozen=True)
class Model:
    """Trees of each kind, and the score from which a kind's proposals are kept."""

    trees: dict[int, list[Tree]]
    thresholds: dict[int, float]

    def score(self, bits: Column, kind: Column) -> Column:
        margins = {k: reduce(Column.__add__, [leaf(bits, t) for t in trees], F.lit(0.0)) for k, trees in self.trees.items()}
        return probability(by_kind(kind, margins, F.lit(0.0)))

    def keeps(self, span: Column) -> Column:
        """Whether a proposal's score reaches its kind's threshold."""
        least = by_kind(span["kind"], {k: F.lit(t) for k, t in self.thresholds.items()}, F.lit(2.0))
        return self.score(span["bits"], span["kind"]) >= least


#: Gradient, curvature and number of rows.
Sums = tuple[float, float, int]


def _best_split(total: Sums, within: dict[int, Sums], plan: Boosting) -> tuple[float, tuple[int, float, float]]:
    """Gain of the feature that parts a node best (bit 0: none does), and the values without and with it."""
    worth = lambda s: s[0] ** 2 / (s[1] + plan.smoothing)
    value = lambda s: plan.step * s[0] / (s[1] + plan.smoothing)
    best = (worth(total), (0, value(total), value(total)))
    for b, on in sorted(within.items()):
        off = tuple(x - y for x, y in zip(total, on))
        if min(on[2], off[2]) >= plan.least_rows and (gain := worth(off) + worth(on)) > best[0] + 1e-9:
            best = (gain, (b, value(off), value(on)))
    return best


def _best_tree(sums: dict[tuple[int, int], Sums], plan: Boosting) -> Tree:
    """The tree of depth two with the greatest gain. sums: of the rows that have both
    features; (0, 0) all rows, (b, b) those with one."""
    zero = (0.0, 0.0, 0)
    found: tuple[float, Tree] | None = None
    for root in [0, *BIT.values()]:
        inner = sums.get((root, root), zero) if root else zero
        outer = tuple(x - y for x, y in zip(sums[0, 0], inner))
        if root and min(inner[2], outer[2]) < plan.least_rows:
            continue
        on = {b: sums.get((root, b), zero) if root else zero for b in BIT.values() if b != root}
        off = {b: tuple(x - y for x, y in zip(sums.get((b, b), zero), on[b])) for b in on}
        (g0, left), (g1, right) = _best_split(outer, off, plan), _best_split(inner, on, plan)
        if found is None or g0 + g1 > found[0] + 1e-9:
            found = (g0 + g1, (root, (left, right)))
    return found[1]


def fit(counts: DataFrame, plan: Boosting = Boosting()) -> Model:
    """Boosted trees of depth two a kind, and thresholds from the held-out documents.

    A tree takes one aggregation of the training table: sums of gradient and curvature for
    every pair of features, in whole millionths so that their order is of no account. The
    driver sees a row for each kind and pair.
    """
    whole = lambda x: F.round(x * 1_000_000).cast("decimal(20,0)")
    pair = F.array(*[F.lit(b).cast("long") for b in BIT.values()])
    own = F.filter(pair, lambda b: F.col("bits").bitwiseAND(b) != 0)
    pairs = F.concat(
        F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))),
        F.flatten(F.transform(own, lambda a: F.transform(own, lambda b: F.struct(a.alias("a"), b.alias("b"))))),
    )
    learn = counts.where("not held").withColumn("margin", F.lit(0.0))
    trees: dict[int, list[Tree]] = {k: [] for k in range(len(KINDS))}
    p, n = 1 / (1 + F.exp(-F.col("margin"))), F.col("pos") + F.col("neg")
    for _ in range(plan.trees):
        graded = learn.select(
            "kind", (whole(1 - p) * F.col("pos") - whole(p) * F.col("neg")).alias("g"), (whole(p * (1 - p)) * n).alias("h"), n.alias("n"), F.explode(pairs).alias("x")
        )
        sums: dict[int, dict[tuple[int, int], Sums]] = {}
        for r in graded.groupBy("kind", "x.a", "x.b").agg(*[F.sum(c).alias(c) for c in "ghn"]).collect():
            sums.setdefault(r["kind"], {})[r["a"], r["b"]] = (float(r["g"]) / 1e6, float(r["h"]) / 1e6, r["n"])
        grown = {k: _best_tree(s, plan) for k, s in sums.items()}
        for k, tree in grown.items():
            trees[k].append(tree)
        step = by_kind(F.col("kind"), {k: leaf(F.col("bits"), t) for k, t in grown.items()}, F.lit(0.0))
        learn = materialize(learn.withColumn("margin", F.col("margin") + step), "margins")
    model = Model(trees, {})
    return Model(trees, _thresholds(counts.where("held"), model, plan))


def _thresholds(held: DataFrame, model: Model, plan: Boosting) -> dict[int, float]:
    """For each kind the least score such that of the held-out rows that reach it, the share
    of positives is `precision`. A kind with few positives gets none and adds nothing."""
    scored = held.withColumn("score", model.score(F.col("bits"), F.col("kind")))
    found: dict[int, float] = {}
    seen: dict[int, tuple[int, int]] = {}
    bins = scored.groupBy("kind", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()  # 1,001 scores a kind
    for r in sorted(bins, key=lambda r: -r["score"]):
        pos, neg = seen.get(r["kind"], (0, 0))
        pos, neg = seen[r["kind"]] = pos + r["pos"], neg + r["neg"]
        if pos >= plan.least_positives and pos >= plan.precision * (pos + neg):
            found[r["kind"]] = r["score"]
    return found


def find_private(docs: DataFrame, plan: Boosting = Boosting(), carried: tuple[str, ...] = ()) -> DataFrame:
    """(carried, doc_id, base, spans) of every row: its base spans, and those with the added ones by kind and start.

    Spans are (start, end, kind, base, bits) in code points, end exclusive. Added spans
    overlap no base span; added spans of different kinds may overlap each other. Null
    texts are empty and have none. Repeated rows, equal and null doc_ids are judged row by
    row (a row without doc_id is never held out); other columns are not read.
    Without base spans in the corpus nothing is learned and nothing added.
    """
    spans = propose(docs, plan.held_out_of, carried)
    model = fit(training_table(spans), plan)
    key = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s.alias("s"))
    added = F.filter("proposed", model.keeps)
    ordered = F.transform(F.array_sort(F.transform(F.concat("base", added), key)), lambda x: x["s"])
    return spans.select("carried", "doc_id", "base", ordered.alias("spans"))


def _listed(spans: Column) -> Column:
    name = lambda k: F.array(*map(F.lit, KINDS))[k]
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")


def private_report(docs: DataFrame, plan: Boosting = Boosting()) -> DataFrame:
    """Counts and checksum of the base spans and the list of all spans, a row a document."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return find_private(docs, plan).select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, plan: Boosting = Boosting()) -> DataFrame:
    """`docs` with every span of `text` replaced by its kind in brackets; overlapping spans
    become one, named after the first. Columns, also those with names used here, are kept."""
    found = find_private(docs, plan, tuple(docs.columns))
    own = {c: F.col(f"carried.c{i}") for i, c in enumerate(docs.columns)}
    text = own["text"].cast("string")

    def pieces(spans: Column) -> Column:
        ends = F.transform(spans, lambda s: s["end"])
        before = running(ends, F.greatest, 0)
        told = F.zip_with(spans, F.concat(F.array(F.lit(0).cast("long")), F.slice(before, 1, F.size(spans) - 1)), lambda s, b: F.struct(s.alias("s"), b.alias("b")))
        fresh = F.filter(told, lambda x: (x["s"]["start"] >= x["b"]) | (x["b"] == 0))
        cut = lambda x: F.concat(
            F.substr(text, (x["b"] + 1).cast("int"), (x["s"]["start"] - x["b"]).cast("int")),
            F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])[x["s"]["kind"]],
        )
        rest = F.substr(text, (F.array_max(ends) + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(F.transform(fresh, cut), ""), rest)

    clean = F.when(F.size("spans") > 0, let(F.array_sort("spans"), pieces)).otherwise(text)
    return found.select(*[(clean if c == "text" else own[c]).alias(c) for c in docs.columns])
