"""Confidence scores and levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def level_of(score: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """The name of the first step that the score reaches, steps from high to low."""
    case = F.when(score >= steps[0][0], steps[0][1])
    for least, name in steps[1:]:
        case = case.when(score >= least, name)
    return case.otherwise(otherwise)


#: Two scales of confidence. Fixed values.
FOUR_LEVELS = [(0.8, "high"), (0.5, "medium"), (0.3, "low")], "uncertain"
FIVE_LEVELS = [(0.8, "very_high"), (0.6, "high"), (0.4, "medium"), (0.2, "low")], "very_low"


def blend(old: Column, new: Column, weight: Column) -> Column:
    """The new score with a weight between 0 and 1, the old with the rest, clamped."""
    w = clamp(weight)
    return clamp(old * (1 - w) + new * w)


def adjusted_edge(confidence: Column, uncertain: Column, event_backed: Column, mismatch: Column) -> Column:
    """An edge's confidence: 0.3 off if uncertain, then 0.6 at least if events back it,
    then 0.4 (`both`) or 0.2 (`one`) off for a city mismatch; never below 0."""
    less = lambda c, v: F.greatest(F.lit(0.0), c - v)
    first = F.when(uncertain, less(confidence, 0.3)).otherwise(confidence)
    second = F.when(event_backed, F.greatest(first, F.lit(0.6))).otherwise(first)
    return F.when(mismatch == "both", less(second, 0.4)).when(mismatch == "one", less(second, 0.2)).otherwise(second)


def research_confidence(found: list[tuple[Column, float, float]]) -> Column:
    """Weighted mean of count scores: (count, factor, weight) gives min(1, count * factor)."""
    total = sum(w for _, _, w in found)
    return sum((F.least(F.lit(1.0), n * k) * w for n, k, w in found[1:]), F.least(F.lit(1.0), found[0][0] * found[0][1]) * found[0][2]) / total
