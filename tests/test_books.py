"""Sections of books and paged documents, and tables written, changed and read back."""

import re

import pytest
from pyspark.sql import functions as F

from marquee.sources import books
from marquee.streaming.upserts import BucketTable

PATTERNS = [re.compile(p) for p in books.HEADINGS]
BOOKS = {
    "preface": "before\n\nChapter 1\none [p.7] two [page 8]\n\n  PART IV \nfour\nTHE END\nlast words",
    "none": "  no headings here [P 12] \n at all ",
    "numbered": "1. First\nx\n2. Second\n\n10.  Third\ny",
    "only": "Chapter 9",
    "blank": " \n\t\n",
    "empty": "",
    "null": None,
    "close": "Chapter 1\nChapter 2\n\nABCD\nABCDE",
}


def slow_book(text):
    lines = (text or "").split("\n")
    at = [i for i, line in enumerate(lines) if any(p.search(line.strip()) for p in PATTERNS)]
    cuts = [0, *[i for i in at if i > 0], len(lines)]
    parts = ["\n".join(lines[a:b]).strip() for a, b in zip(cuts, cuts[1:])]
    mark = lambda t: (re.search(books.PAGE_MARK, t) or [None, None])[1]
    return [(i, mark(t), t) for i, t in enumerate(p for p in parts if p)]


def test_books(spark):
    frame = spark.createDataFrame(list(BOOKS.items()), "name string, text string")
    got = sorted(tuple(r) for r in books.book_sections(frame).select("name", "section", "page", "section_text").collect())
    assert got == sorted((n, *s) for n, t in BOOKS.items() for s in slow_book(t))
    assert [s[2] for s in slow_book(BOOKS["preface"])][:2] == ["before", "Chapter 1\none [p.7] two [page 8]"]


def slow_pages(text):
    pages = [(i + 1, p.strip()) for i, p in enumerate((text or "").split("\f")) if p.strip()]
    at = [k for k, (_, t) in enumerate(pages) if any(p.search(line.strip()) for line in t.split("\n")[:5] for p in PATTERNS)]
    cuts = [0, *[k for k in at if k > 0], len(pages)] if at else [*range(0, len(pages), 10), len(pages)]
    return [(i, pages[a][0], b - a, "\n\n".join(t for _, t in pages[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))] if pages else []


def test_paged_documents(spark):
    texts = {
        "plain": "\f".join(f"page {i}" for i in range(23)),
        "heads": "intro\f\fChapter 1\nx\fy\f  \na\nb\nc\nPART II\nz\f1\n2\n3\n4\n5\nChapter 7",
        "first": "Chapter 1\fx",
        "blank": "\f \f",
        "null": None,
    }
    frame = spark.createDataFrame(list(texts.items()), "name string, text string")
    got = sorted(tuple(r) for r in books.paged_sections(frame).select("name", "section", "first_page", "n_pages", "section_text").collect())
    assert got == sorted((n, *s) for n, t in texts.items() for s in slow_pages(t))
    assert [s[1:3] for s in slow_pages(texts["heads"])] == [(1, 1), (3, 2), (5, 2)]


def test_deletes_and_updates_rewrite_only_their_buckets(spark, tmp_path):
    table = BucketTable(spark, f"{tmp_path}/t", "k long, source string, tags array<string>", ["k"], ["source"], 8)
    rows = spark.range(40).select(F.col("id").alias("k"), F.concat(F.lit("s"), F.col("id") % 20).alias("source"), F.array(F.lit("a")).alias("tags"))
    table.merge(rows, 0)
    before = table.versions()
    assert table.delete(F.col("source") == "s3", 1) == 2 and table.delete(F.col("source") == "s3", 1) == 2
    assert table.delete(F.col("source") == "none", 2) == 0
    assert sorted(r.k for r in table.latest().collect()) == [k for k in range(40) if k % 20 != 3]
    assert 0 < sum(before[b] != v for b, v in table.versions().items()) <= 2
    assert table.update(F.col("k") == 7, {"source": F.lit("new"), "tags": F.array(F.lit("b"), F.lit("c"))}, 3) == 1
    assert {r.k: (r.source, r.tags) for r in table.latest().collect()}[7] == ("new", ["b", "c"])
    with pytest.raises(ValueError):
        table.update(F.lit(True), {"k": F.lit(1)}, 4)
    assert table.delete(F.lit(True), 4) == 38 and table.latest().count() == 0 and table.versions() == {}
    table.merge(rows.where("k < 3"), 5)
    assert table.latest().count() == 3
