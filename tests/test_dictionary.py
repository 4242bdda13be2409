"""Dictionary matches against a scan of every name at every place."""

import random
import re

import pytest

from marquee.operators import dictionary as di


def cut(text):
    return [w.lower() for w in re.findall(r"[^\W_]+", text or "")]


def slow(docs, names):
    known = {}
    for n in sorted(x for x in names if x is not None):
        if cut(n):
            known.setdefault(tuple(cut(n)), n)
    out = set()
    for key, text in docs:
        t, i = cut(text), 0
        while i < len(t):
            best = max((w for w in known if tuple(t[i : i + len(w)]) == w), key=len, default=None)
            if best:
                out.add((key, i, len(best), known[best]))
                i += len(best)
            else:
                i += 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    letters = ["acid", "house", "deep", "Techno", "dub", "éclair", "9", "x"]
    name = lambda most: rng.choice([" ", "-", "  "]).join(rng.choice(letters) for _ in range(rng.randint(1, most)))
    names = [name(4) for _ in range(40)] + ["Acid House", "acid  house", "", "--", None]
    docs = [(i, ", ".join(name(6) for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(100, None), (101, ""), (102, "HOUSE!house?House")]
    got = di.extract_names(spark.createDataFrame(docs, "k long, t string"), "k", "t", spark.createDataFrame([(n,) for n in names], "n string"), "n")
    assert {tuple(r) for r in got.collect()} == slow(docs, names)


def test_empty_sides(spark):
    docs, names = spark.createDataFrame([(1, "acid house")], "k long, t string"), spark.createDataFrame([("acid",)], "n string")
    assert di.extract_names(docs, "k", "t", names.where("false"), "n").collect() == []
    assert di.extract_names(docs.where("false"), "k", "t", names, "n").collect() == []


def test_names_are_joined_not_scanned(spark):
    """The plan is the same for one name and for 100,000: a join, no pattern a name."""
    docs = spark.createDataFrame([(1, "name 77777 and name 5")], "k long, t string")
    many = spark.range(100_000).selectExpr("concat('name ', id) as n")
    got = di.extract_names(docs, "k", "t", many, "n")
    assert sorted(r.name for r in got.collect()) == ["name 5", "name 77777"]
    assert "Join" in got._jdf.queryExecution().toString() and "RLIKE" not in got._jdf.queryExecution().toString().upper()


def test_names_over_blocks_of_words(spark):
    """Texts of many blocks, names that cross their borders; only n-grams that begin like a name are hashed."""
    rng = random.Random(9)
    names = ["a b c d e", "b", "c d", "e a a", "zz"]
    docs = [(i, " ".join(rng.choice("abcde") for _ in range(n))) for i, n in enumerate([1, 4, 31, 32, 33, 36, 64, 65, 100, 400])]
    docs += [(100 + i, "x " * i + "a b c d e") for i in range(25, 36)]
    name_rows = spark.createDataFrame([(n,) for n in names], "n string")
    got = di.extract_names(spark.createDataFrame(docs, "k long, t string"), "k", "t", name_rows, "n")
    assert {tuple(r) for r in got.collect()} == slow(docs, names)
    assert "LeftSemi" in got._jdf.queryExecution().toString()


def test_a_dictionary_with_many_first_words(spark, monkeypatch):
    monkeypatch.setattr(di, "BROADCAST_FIRSTS", 2)
    names, docs = ["a b", "b", "c d e"], [(1, "a b c d e b a"), (2, "d e"), (3, None)]
    got = di.extract_names(spark.createDataFrame(docs, "k long, t string"), "k", "t", spark.createDataFrame([(n,) for n in names], "n string"), "n")
    assert {tuple(r) for r in got.collect()} == slow(docs, names)
