"""Line-first cleaning of documents.

Rules look at one line at a time: punctuation (symbols, shouting), navigation
(menus, separators, stubs without an end mark) and boilerplate (phrases of site
furniture, lines seen before in the same text). Failing lines are removed; a
document that loses too much of its text this way is rejected. Base statistics
over the whole text reject very short and very repetitive documents first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.shared import slices

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
END_MARKS = ".!?:;…。！？\"'”’)]»"
SEPARATORS = re.compile(r"(?:^|\s)(?:\||»|›|>|•|·|/)(?=\s|$)")
BOILERPLATE = re.compile(
    r"all rights reserved|cookie (?:policy|settings)|we use cookies|privacy policy|terms of (?:use|service)|"
    r"subscribe (?:now|to)|sign (?:in|up)\b|log ?in\b|click here|read more|share (?:this|on)|skip to (?:main )?content|"
    r"enable javascript|back to top|powered by|newsletter",
    re.I,
)


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of the verdict on a document."""

    min_words: int = 10
    max_repeat_percent: int = 20
    max_symbol_share: float = 0.08
    max_shout_share: float = 0.5
    boilerplate_words: int = 25
    max_stutter_share: float = 0.3
    stub_words: int = 3
    max_lost_share: float = 0.5


def line_fault(line: str, words: list[str], rules: Rules) -> str | None:
    """The first rule that a line with words breaks, or None."""
    chars = sum(map(len, words))
    if sum(line.count(c) for c in SYMBOLS) > rules.max_symbol_share * chars:
        return "symbols"
    if len(words) >= 3:
        shouted = sum(1 for w in words if w.endswith("!!") or (len(w) > 3 and w.isupper()))
        if shouted > rules.max_shout_share * len(words):
            return "shouting"
    if len(SEPARATORS.findall(line)) * 3 >= len(words) > 1:
        return "navigation"
    if len(words) <= rules.stub_words and words[-1][-1] not in END_MARKS:
        return "navigation"
    if len(words) >= 5 and sum(map(str.__eq__, words[1:], words)) > rules.max_stutter_share * len(words):
        return "boilerplate"
    if len(words) <= rules.boilerplate_words and BOILERPLATE.search(line):
        return "boilerplate"
    return None


def repeated_words(words: list[str]) -> int:
    """How many words lie in 5-word windows that occur twice or more, first included.

    Exact: windows are numbered by packing word numbers into one integer, in two
    steps where five of them do not fit 63 bits.
    """
    n = len(words)
    if n < 6:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    m = len(number)
    if m == n:
        return 0
    if m**5 < 1 << 63:
        code = (((ids[:-4] * m + ids[1:-3]) * m + ids[2:-2]) * m + ids[3:-1]) * m + ids[4:]
    else:
        pairs, pair = np.unique(ids[:-1] * m + ids[1:], return_inverse=True)
        fours, four = np.unique(pair[:-2] * len(pairs) + pair[2:], return_inverse=True)
        code = four[:-1] * m + ids[4:]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    twice = np.zeros(len(code), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    edges = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + 5, -1)
    return int((np.cumsum(edges[:n]) > 0).sum())


def assess(text: str | None, rules: Rules) -> tuple:
    """Statistics, verdict and cleaned text of one document."""
    text = text or ""
    words = WORDS.findall(text)
    n_words = len(words)
    word_chars = len(text) - sum(text.count(c) for c in SPACES)
    n_symbols = sum(text.count(c) for c in SYMBOLS)
    n_repeat = repeated_words(words)
    seen: set[str] = set()
    kept_lines: list[str] = []
    duplicates = lost = 0
    for line in text.split("\n"):
        own = WORDS.findall(line)
        if not own:
            kept_lines.append(line)
            continue
        if repeat := line in seen:
            duplicates += 1
        seen.add(line)
        if repeat or line_fault(line, own, rules):
            lost += sum(map(len, own))
        else:
            kept_lines.append(line)
    base_failed = n_words < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * n_words
    kept = not base_failed and lost <= rules.max_lost_share * word_chars
    return n_words, word_chars, n_symbols, duplicates, n_repeat, base_failed, kept, lost, "\n".join(kept_lines) if lost else text


FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, lost_chars long"
)


def _assessed(rules: Rules, with_text: bool):
    names = [f.split()[0] for f in FIELDS.split(", ")] + ["clean_text"] * with_text
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] + [pa.string()] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            rows = [assess(t, rules)[: len(names)] for t in batch.column(at).to_pylist()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.record_batch(
                [batch.column(i) for i in rest] + columns, names=[batch.schema.names[i] for i in rest] + names
            )

    return run


def quality_report(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(doc_id, statistics, base_failed, kept, lost_chars) for every row of `docs`.

    Null text has no words (base_failed). Repeated rows and equal doc_ids are
    judged row by row; other columns are not read; an empty table gives no rows.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _assessed(rules, with_text=False), f"doc_id long, {FIELDS}"
    )


def clean_lines(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The kept documents, their failing lines removed, with the columns of `docs`.

    n_chars, where it is a column, is set to the new length. A column that has the
    name of a statistic is carried through untouched.
    """
    carried = [c for c in docs.columns if c != "text"]
    renamed = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)]
    schema = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carried))
    found = docs.select(*renamed, "text").mapInArrow(
        _assessed(rules, with_text=True), ", ".join(filter(None, [schema, FIELDS, "clean_text string"]))
    )
    back = {c: F.col(f"c{i}").alias(c) for i, c in enumerate(carried)} | {"text": F.col("clean_text").alias("text")}
    if "n_chars" in back:
        kind = docs.schema["n_chars"].dataType
        back["n_chars"] = F.char_length("clean_text").cast(kind).alias("n_chars")
    return found.where("kept").select([back[c] for c in docs.columns])
