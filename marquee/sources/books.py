"""Books and paged documents cut into sections at their headings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a heading line looks like, and a page mark in running text.
HEADINGS = (
    r"(?i)^Chapter\s+\d+",
    r"(?i)^PART\s+[IVXLCDM\d]+",
    r"^\d+\.\s+\S",
    r"^[A-Z][A-Z\s]{4,}$",
)
PAGE_MARK = r"(?i)\[p(?:age)?\.?\s*(\d+)\]"
#: Pages of a section where a document has no headings, and lines of a page that may hold one.
PAGES_PER_SECTION, HEADING_LINES = 10, 5


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_heading(line: Column) -> Column:
    plain = stripped(line)
    found = F.lit(False)
    for pattern in HEADINGS:
        found = found | plain.rlike(pattern)
    return found


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """An expression that uses `value` several times and computes it once."""
    return F.transform(F.array(value), then)[0]


def _cut(parts: Column, starts: Column) -> Column:
    """Slices (at, parts) of an array from each start to the next; what stands before the first is one too."""
    begins = F.when(F.size(starts) == 0, F.array(F.lit(0))).when(F.get(starts, F.lit(0)) > 0, F.concat(F.array(F.lit(0)), starts)).otherwise(starts)

    def slices(first: Column) -> Column:
        ends = F.concat(F.slice(first, 2, F.size(first)), F.array(F.size(parts)))
        return F.zip_with(first, ends, lambda a, b: F.struct(a.alias("at"), F.slice(parts, a + 1, b - a).alias("parts")))

    return _let(begins, slices)


def _places(parts: Column, test: Callable[[Column], Column]) -> Column:
    """Numbers, from 0, of the elements that meet a test."""
    flagged = F.filter(F.transform(parts, lambda x, i: F.struct(i.alias("i"), test(x).alias("t"))), lambda x: x["t"])
    return F.transform(flagged, lambda x: x["i"])


def book_sections(files: DataFrame, text: str = "text") -> DataFrame:
    """Rows of `files` with (section, page, section_text): a section begins with each heading line;
    a text without headings is one. page is the first page mark's number or null. Sections
    without text are left out and not counted. A file stays in its row; nothing is shuffled."""
    keep = [c for c in files.columns if c != text]
    mark = lambda t: F.nullif(F.regexp_extract(t, PAGE_MARK, 1), F.lit(""))

    def sections(lines: Column) -> Column:
        cut = _let(_places(lines, is_heading), lambda at: _cut(lines, at))
        joined = F.transform(cut, lambda s: stripped(F.array_join(s["parts"], "\n")))
        return F.transform(F.filter(joined, lambda t: t != ""), lambda t: F.struct(mark(t).alias("page"), t.alias("section_text")))

    told = _let(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), sections)
    return files.select(*keep, F.posexplode(told).alias("section", "s")).select(*keep, "section", "s.*")


def paged_sections(files: DataFrame, text: str = "text", page_break: str = "\f") -> DataFrame:
    """Rows of `files` with (section, first_page, n_pages, section_text). Pages are numbered from 1
    and blank ones left out. A page with a heading in its first lines begins a section;
    without any heading, sections have ten pages each."""
    keep = [c for c in files.columns if c != text]
    numbered = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), page_break), lambda p, i: F.struct((i + 1).alias("n"), stripped(p).alias("t")))
    begins = lambda page: F.exists(F.slice(F.split(page["t"], "\n"), 1, HEADING_LINES), is_heading)

    def sections(pages: Column) -> Column:
        tens = F.sequence(F.lit(0), F.greatest(F.size(pages) - 1, F.lit(0)), F.lit(PAGES_PER_SECTION))
        cut = _let(_places(pages, begins), lambda at: _cut(pages, F.when(F.size(at) > 0, at).otherwise(tens)))
        told = lambda s: F.struct(
            F.get(s["parts"], F.lit(0))["n"].alias("first_page"),
            F.size(s["parts"]).alias("n_pages"),
            F.array_join(F.transform(s["parts"], lambda p: p["t"]), "\n\n").alias("section_text"),
        )
        return F.filter(F.transform(cut, told), lambda s: s["n_pages"] > 0)

    told = _let(F.filter(numbered, lambda p: p["t"] != ""), sections)
    return files.select(*keep, F.posexplode(told).alias("section", "s")).select(*keep, "section", "s.*")
