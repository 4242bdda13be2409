"""Names: normalising, splitting, comparing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What separates several artists in one string. Fixed value.
SEPARATORS = r"(?i)\s+b2b\s+|\s+vs\.?\s+|\s+&\s+|\s+feat\.?\s+|\s+ft\.?\s+|\s+featuring\s+|,\s*"


def normalize_name(name: Column) -> Column:
    """Trimmed, without a leading DJ, single spaces, each run of letters capitalised.

    Every letter that follows a non-letter is upper case (`aphex-twin` gives
    `Aphex-Twin`), which `initcap` does for spaces only.
    """
    plain = F.regexp_replace(F.regexp_replace(F.trim(name), r"^[Dd][Jj]\s+", ""), r"\s+", " ")
    runs = F.regexp_extract_all(plain, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 20)))), "")


def split_artists(raw: Column) -> Column:
    """The artists of a line-up string, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(raw, SEPARATORS), lambda x: F.trim(x)), lambda x: x != "")


def lcs_ratio(a: str, b: str) -> float:
    """Indel similarity: twice the longest common subsequence over both lengths."""
    if not a and not b:
        return 1.0
    # bit-parallel: a bit of `row` is 0 where the subsequence grows
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & full
    common = len(a) - row.bit_count()
    return 2 * common / (len(a) + len(b))


def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """lcs_ratio of the strings with their words sorted; case counts; null gives null."""
    sort = lambda x: " ".join(sorted(x.split()))
    return pd.Series(
        [None if x is None or y is None else lcs_ratio(sort(x), sort(y)) for x, y in zip(a, b)], dtype="float64"
    )


token_sort_ratio_udf = F.pandas_udf(token_sort_ratio, T.DoubleType())


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance over the longer length, on the JVM; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)
