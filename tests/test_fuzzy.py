"""Fuzzy joins against comparing all with all, and how many pairs they compare."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marquee.functions import names
from marquee.operators import fuzzy
from marquee.plans.function_queries import openings
from marquee.plans.registry import Tables
from tests.conftest import DATA
from tests.test_functions import slow_edit, slow_resolve


def ratio(kind, a, b):
    if kind == "indel":
        return names.lcs_ratio(a, b)
    return 1 - slow_edit(a, b) / max(len(a), len(b)) if a or b else 1.0


def changed(word, edits, letters):
    for _ in range(edits):
        i, c = random.randint(0, len(word)), random.choice(letters)
        word = random.choice([word[:i] + c + word[i:], word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :]])
    return word


@pytest.mark.parametrize("threshold", [0.7, 0.8, 0.9])
def test_two_tables_against_all_pairs(spark, threshold):
    """Strings at and beside the threshold, few letters and many, longer on either side."""
    random.seed(int(threshold * 100))
    base = ["".join(random.choice(a) for _ in range(n)) for a in ("ab", "abcdefgh", "xyé😀 ") for n in (1, 2, 5, 9, 14, 20, 31)]
    asked = [*base, "", "aaaa", "aaaaa"]
    known = [changed(w, e, "abxé😀") for w in base for e in range(10)] + ["", "aaaa"]
    left, right = (spark.createDataFrame([(w,) for w in t] + [(None,)], "name string") for t in (asked, known))
    for kind in ("edit", "indel"):
        rows = fuzzy.like_pairs(left, right, threshold, kind).collect()
        found = {(r.asked, r.known): round(r.ratio, 9) for r in rows}
        assert len(rows) == len(found)
        expected = {(a, b): round(ratio(kind, a, b), 9) for a in set(asked) for b in set(known) if ratio(kind, a, b) >= threshold}
        assert found == expected


def test_bitmaps_differ_in_no_more_bits_than_letters(spark):
    from collections import Counter

    random.seed(3)
    words = ["".join(random.choice("abcdé😀 ") for _ in range(random.randint(1, 30))) for _ in range(60)]
    rows = spark.createDataFrame([(w,) for w in words], "name string").select("name", fuzzy.bitmap(fuzzy.letters(F.col("name"))).alias("b")).collect()
    for x in rows:
        for y in rows:
            a, b = Counter(x.name), Counter(y.name)
            differ = sum(((p ^ q) & ((1 << 64) - 1)).bit_count() for p, q in zip(x.b, y.b))
            assert differ <= sum(((a - b) + (b - a)).values())


def test_few_pairs_are_compared(spark):
    """Names that grow with the table: under a hundredth of all pairs reach the comparison."""
    known = openings(Tables(spark, DATA)).select("name").distinct().cache()
    n = known.count()
    for kind in ("edit", "indel"):
        assert fuzzy.candidates(known, known, 0.8, kind).count() < 0.01 * n * n


def test_few_pairs_leave_the_join_of_many_names(spark):
    """Letters alone let 0.8 % of the pairs pass; keys are dealt out, whatever the size looks like."""
    known = openings(Tables(spark, DATA.replace("sf0.001", "sf0.01"))).select("name").distinct().cache()
    n = known.count()
    found = fuzzy.candidates(known, known, 0.8, "indel")
    assert found.count() < 0.001 * n * n
    assert "SortMergeJoin [k" in found._jdf.queryExecution().toString()


def test_indel_cells_against_all_pairs(spark, monkeypatch):
    """Several groups on both sides, strings about the length of a machine word, letters beyond 16 bits;
    pairs are compared as arrays, no joined row for each meeting of two names."""
    monkeypatch.setattr(fuzzy, "MIN_GROUP", 32)
    random.seed(5)
    base = ["".join(random.choice("abcé😀 x") for _ in range(n)) for n in (1, 2, 5, 9, 14, 20, 31, 62, 63, 64, 65, 90) for _ in range(6)]
    near = [changed(w, random.randint(0, 12), "abx😀") for w in base for _ in range(3)] + ["", *base[:20]]
    left, right = (spark.createDataFrame([(w,) for w in t] + [(None,)], "name string") for t in ([*base, ""], near))
    for a, b, x, y in ((left, right, [*base, ""], near), (right, left, near, [*base, ""]), (right, right, near, near)):
        pairs = fuzzy.like_pairs(a, b, 0.8, "indel")
        rows = pairs.collect()
        found = {(r.asked, r.known): r.ratio for r in rows}
        assert len(rows) == len(found)
        assert found == {(p, q): r for p in set(x) for q in set(y) if (r := names.lcs_ratio(p, q)) >= 0.8}
        plan = pairs._jdf.queryExecution().toString()
        assert "FlatMapGroupsInArrow" in plan and "levenshtein" not in plan


def test_resolved_openings_against_brute_force(spark):
    rows = [(r.id, r.name) for r in openings(Tables(spark, DATA)).collect()]
    found = {r.id: r.canonical for r in entry.queries()["resolve_openings"](spark, DATA).collect()}
    assert len(rows) > 50 and found == slow_resolve(rows, 0.8)
