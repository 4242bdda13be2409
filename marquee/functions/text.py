"""Text: citations, cleaning, chunking, hashes, parsing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markup of catalogue profiles and what replaces it, in order. Fixed values.
MARKUP = (
    (r"\[a=([^\]]+)\]", "$1"),
    (r"\[l=([^\]]+)\]", "$1"),
    (r"\[[alrm]\d+\]", ""),
    (r"\[[rmalRMAL]=\d+\]", ""),
    (r"\[url=[^\]]*\](.*?)\[/url\]", "$1"),
    (r"\[/?[biu]\]", ""),
)
#: Characters that OCR confuses, in order. Fixed values.
OCR_FIXES = (
    (r"(?<=[a-zA-Z])rn(?=[a-zA-Z])", "m"),
    (r"\b0(?=[a-zA-Z]{2,})", "O"),
    (r"(?<=[a-zA-Z][a-zA-Z])0\b", "O"),
    (r"\b1(?=[a-zA-Z]{2,})", "l"),
    (r"\|(?=[a-zA-Z])", "l"),
    (r"\bVV", "W"),
)
#: Artifacts of transcripts and what replaces them, in order. Fixed values.
TRANSCRIPT = (
    (r"\[\d{1,2}:\d{2}(?::\d{2})?\]", ""),
    (r"(?m)^\d{1,2}:\d{2}(?::\d{2})?\s*[-–—]?\s*", ""),
    (r"\(\d{1,2}:\d{2}(?::\d{2})?\)", ""),
    (
        r"\[(?:INAUDIBLE|CROSSTALK|LAUGHTER|MUSIC|APPLAUSE|SILENCE|PAUSE|BACKGROUND NOISE|OVERLAPPING|UNINTELLIGIBLE"
        r"|FOREIGN LANGUAGE|inaudible|crosstalk|laughter|music|applause)\]",
        "",
    ),
    (r"(?m)^[ \t]*[A-Z][A-Za-z'\-.]+(?:\s+[A-Za-z'\-.]+){0,3}\s*:\s*", "\n\n"),
    (r"\n{3,}", "\n\n"),
    (r"[ \t]{2,}", " "),
)


def replace_all(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def replace_all_sql(text: str, rules: tuple[tuple[str, str], ...]) -> str:
    """`replace_all` as SQL."""
    for pattern, replacement in rules:
        text = "regexp_replace({}, '{}', '{}', 'g')".format(text, pattern.replace("'", "''"), replacement.replace("$", "\\"))
    return text


def clean_markup(text: Column) -> Column:
    """A profile without markup, single spaces; null is empty."""
    return F.trim(F.regexp_replace(replace_all(F.coalesce(text, F.lit("")), MARKUP), r"\s+", " "))


def correct_ocr(text: Column) -> Column:
    return replace_all(text, OCR_FIXES)


def clean_transcript(text: Column) -> Column:
    """A transcript without times, noise marks and speaker labels."""
    return F.regexp_replace(replace_all(text, TRANSCRIPT), r"^\s+|\s+$", "")


def count_tokens(text: Column) -> Column:
    """The estimate of a token for four characters."""
    return F.floor(F.length(text) / 4).cast("long")


def split_paragraphs(text: Column) -> Column:
    """Paragraphs between blank lines, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def truncate_chars(text: Column, most: int) -> Column:
    """At most `most` characters, cut back to the last white space."""
    return F.when(F.length(text) <= most, text).otherwise(F.regexp_replace(F.substring(text, 1, most), r"\s\S*\z", ""))


def snippet(text: Column, words: list[str], most: int = 500) -> Column:
    """The sentences that have one of the words, whatever its case, up to `most` characters, cut at a space."""
    named = lambda s: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower(s), w))
    return truncate_chars(F.array_join(F.filter(F.split(text, r"(?<=[.!?])\s+"), named), " "), most)


def format_citation(title: Column, author: Column, page: Column, year: Column, tier: Column) -> Column:
    """Title, author, page, year, tier joined by commas; nulls are left out."""
    return F.concat_ws(", ", title, author, F.concat(F.lit("p."), page), year, F.concat(F.lit("[Tier "), tier, F.lit("]")))


def rolling_hash(text: Column) -> Column:
    """The signed 32-bit hash h * 31 + c over UTF-16 units below U+10000, its absolute
    value in hexadecimal, eight digits at least."""
    units = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(units, F.lit(0).cast("long"), lambda a, c: (a * 31 + c).bitwiseAND(F.lit(4294967295)))
    magnitude = F.abs(F.when(h >= 2147483648, h - 4294967296).otherwise(h))
    return F.lower(F.lpad(F.hex(magnitude), 8, "0"))


def cache_key(*fields: Column) -> Column:
    """32 hexadecimal digits that name the fields whatever their case and outer spaces."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.lower(F.trim(F.coalesce(f, F.lit("")))) for f in fields]), 256), 1, 32)


def redact(text: Column, secrets: Column) -> Column:
    """Each secret of more than one character as [REDACTED]."""
    return F.aggregate(F.filter(secrets, lambda s: F.length(s) > 1), text, lambda t, s: F.replace(t, s, F.lit("[REDACTED]")))


def strip_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"<[^>]+>", ""))


def outer_json(text: Column) -> Column:
    """The JSON of a reply: what a fence holds, else from the first brace to the last."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    found = F.when(fenced != "", fenced).otherwise(F.regexp_extract(text, r"(?s)(\{.*\})", 1))
    return F.regexp_replace(found, r"^\s+|\s+$", "")


def city_hint(line: Column) -> Column:
    """What follows the last comma or dash of a venue line, if longer than two characters."""
    last = F.trim(F.element_at(F.split(line, r",| - |–|—"), -1))
    return F.when((F.size(F.split(line, r",| - |–|—")) > 1) & (F.length(last) > 2), last)


#: Words whose period ends no sentence; case counts. Fixed values.
ABBREVIATIONS = (
    "Dr", "Mr", "Mrs", "Ms", "Prof", "Jr", "Sr", "St", "Ave", "Blvd", "Vol", "No", "vs", "etc", "approx", "dept", "est", "govt", "inc", "ltd",
    "co", "ft",
)
_ABBREVIATED = re.compile(rf"(?:{'|'.join(ABBREVIATIONS)})\.")
_SENTENCE_END = re.compile(r"[.!?](?=\s|\Z)")


def sentences(text: str) -> list[str]:
    """Sentences end at .!? before white space or the end, but not at the period of an
    abbreviation (nor of a word that ends like one). A text without any is its own sentence."""
    held = {m.end() - 1 for m in _ABBREVIATED.finditer(text)}
    ends = [m.end() for m in _SENTENCE_END.finditer(text) if m.start() not in held]
    parts = [text[a:b].strip() for a, b in zip([0, *ends], [*ends, len(text)])]
    return [p for p in parts if p] or [text]


def pack_units(units: list[str], joiner: str, most: int, overlap: int) -> list[str]:
    """Units packed greedily up to `most` tokens; each chunk starts with the longest
    tail of the one before that has at most `overlap` tokens."""
    chunks, held, size = [], [], 0
    for unit in units:
        n = len(unit) // 4
        if held and size + n > most:
            chunks.append(joiner.join(held))
            tail, room = [], 0
            for u in reversed(held):
                if room + len(u) // 4 > overlap:
                    break
                tail.insert(0, u)
                room += len(u) // 4
            held, size = tail, room
        held.append(unit)
        size += n
    if held:
        chunks.append(joiner.join(held))
    return chunks


def chunk_text(text: str | None, most: int = 500, overlap: int = 100) -> list[str]:
    """Chunks of a text by paragraphs; a paragraph of more than `most` tokens by sentences."""
    out: list[str] = []
    held: list[str] = []
    for paragraph in (p.strip() for p in re.split(r"\n\s*\n", text or "")):
        if not paragraph:
            continue
        if len(paragraph) // 4 > most:
            out += pack_units(held, "\n\n", most, overlap)
            held = []
            out += pack_units(sentences(paragraph), " ", most, overlap)
        else:
            held.append(paragraph)
    return out + pack_units(held, "\n\n", most, overlap)


def chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source_id, text) to (source_id, ordinal, chunk), for mapInArrow."""
    for batch in batches:
        chunks = [chunk_text(t) for t in batch.column("text").to_pylist()]
        source = pa.array([i for i, c in enumerate(chunks) for _ in c], pa.int64())
        ordinals = pa.array([k for c in chunks for k in range(len(c))], pa.int32())
        texts = pa.array([x for c in chunks for x in c], pa.string())
        yield pa.record_batch([batch.column("source_id").take(source), ordinals, texts], names=["source_id", "ordinal", "chunk"])
