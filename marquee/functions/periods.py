"""Time periods in text, as strings and as year intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named eras. Fixed values.
NAMED_ERAS = {
    "second summer of love": "1988-1989",
    "summer of love": "1988-1989",
    "early rave": "1988-1992",
    "old school": "1988-1995",
    "old skool": "1988-1995",
    "golden era": "1993-1997",
    "golden age": "1993-1997",
    "early techno": "1988-1992",
    "classic house": "1986-1992",
    "classic techno": "1988-1995",
    "classic jungle": "1992-1997",
    "classic drum and bass": "1995-2000",
    "early house": "1984-1990",
    "early jungle": "1991-1994",
    "early dubstep": "2001-2006",
    "early grime": "2002-2006",
    "first wave rave": "1988-1992",
    "second wave rave": "1992-1996",
    "acid era": "1987-1991",
    "uk garage era": "1997-2002",
    "nuum": "1990-2010",
}
#: How a year, a range of years, a decade and a short decade are written.
YEAR = r"(?:19|20)\d{2}"
YEAR_RANGE = rf"({YEAR})\s*[-–—]\s*({YEAR})"
SHORT_THE = r"(?i)\bthe\s+(\d{2})['’]?s\b"
SHORT = r"(?i)\b(\d{2})['’]?s\b"
DECADE = rf"\b({YEAR})s\b"
SINGLE = rf"\b({YEAR})\b"


def detect_period(text: Column) -> Column:
    """The first period that a text names: an era (the longest name first), a range of
    years, a short decade (50 and more is 19xx), a decade, a year; else null."""
    lowered = F.lower(F.trim(text))
    cases = F.when(F.lit(False), F.lit(None).cast("string"))
    for era in sorted(NAMED_ERAS, key=len, reverse=True):
        cases = cases.when(F.contains(lowered, F.lit(era)), F.lit(NAMED_ERAS[era]))
    span = rf"\b{YEAR_RANGE}\b"
    found = lambda p: F.regexp_extract(text, p, 1)

    def decade(pattern: str) -> Column:
        digits = found(pattern)
        return F.concat(F.when(digits >= "50", F.lit("19")).otherwise(F.lit("20")), digits, F.lit("s"))

    return (
        cases.when(text.rlike(span), F.concat_ws("-", found(span), F.regexp_extract(text, span, 2)))
        .when(text.rlike(SHORT_THE), decade(SHORT_THE))
        .when(text.rlike(SHORT), decade(SHORT))
        .when(text.rlike(DECADE), F.concat(found(DECADE), F.lit("s")))
        .when(text.rlike(SINGLE), found(SINGLE))
    )


def parse_period(period: Column) -> Column:
    """struct(start, end), a closed interval of years; null if it is none."""
    period = F.trim(period)
    span = rf"^{YEAR_RANGE}$"
    interval = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    first = F.when(period.rlike(rf"^{YEAR}"), F.substring(period, 1, 4).cast("int"))
    return (
        F.when(period.rlike(rf"^{YEAR}s$"), interval(first, first + 9))
        .when(period.rlike(span), interval(first, F.when(period.rlike(span), F.right(period, F.lit(4)).cast("int"))))
        .when(period.rlike(rf"^{YEAR}$"), interval(first, first))
    )


def periods_overlap(a: Column, b: Column) -> Column:
    """Whether two period strings share a year; false if either is none."""
    x, y = parse_period(a), parse_period(b)
    return F.coalesce((x["start"] <= y["end"]) & (y["start"] <= x["end"]), F.lit(False))
