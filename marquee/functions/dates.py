"""Dates in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
#: What a date looks like, and how its parts (pattern groups) are ordered: year, month, day.
FORMS = (
    (r"(?<!\d)(\d{4})-(\d{1,2})-(\d{1,2})(?!\d)", (1, 2, 3)),
    (r"(?<!\d)(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})(?!\d)", (3, 1, 2)),
    (r"(?<!\d)(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})(?!\d)", (3, 2, 1)),
    (rf"(?i)(?<!\p{{L}})({_MONTH})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+'?(\d{{4}}|\d{{2}})(?!\d)", (3, 1, 2)),
    (rf"(?i)(?<!\d)(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?({_MONTH})\.?,?\s+'?(\d{{4}}|\d{{2}})(?!\d)", (3, 2, 1)),
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Two digits from here on are of the 1900s.
PIVOT = 51


def parse_date(text: Column) -> Column:
    """The first date of a text as date, tried form by form: ISO, month/day/year, day.month.year, and
    with names of months; null if there is none that exists."""

    def read(pattern: str, order: tuple[int, int, int]) -> Column:
        year, month, day = (F.regexp_extract(text, pattern, g) for g in order)
        short = year.try_cast("int") + F.when(year.try_cast("int") >= PIVOT, 1900).otherwise(2000)
        full = F.when(F.length(year) == 2, short).otherwise(year.try_cast("int"))
        made = F.concat_ws("-", F.lpad(full.cast("string"), 4, "0"), F.lpad(_month_number(month).cast("string"), 2, "0"), F.lpad(day, 2, "0"))
        return F.when(year != "", F.try_to_timestamp(made, F.lit("yyyy-MM-dd")).cast("date"))

    return F.coalesce(*[read(*form) for form in FORMS])


def _month_number(month: Column) -> Column:
    """1 to 12 from digits or the first three letters of a name."""
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(month, 1, 3)))
    return F.when(month.rlike(r"^\d+$"), month.try_cast("int")).otherwise(at.cast("int"))
