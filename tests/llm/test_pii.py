import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from marquee.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, m):
    number = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(number[::-1])]
        return 16 <= len(number) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind == "email" or 8 <= len(number) <= 15


def slow_base(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "", re.A) if passes(k, m[0])]


def slow_row(doc_id, text):
    base = slow_base(text)
    listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
    return (doc_id, *(sum(b[0] == k for b in base) for k in PLAIN), hashlib.sha256(listed.encode()).hexdigest())


def check_digit(head):
    return next(d for d in "0123456789" if passes("card", head + d))


def person(rng):
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    card = d(15)
    card += check_digit(card)
    return rng.choice(
        [
            f"{rng.choice(['ann', 'bo.li', 'c+d'])}{d(2)}@mail{d(1)}.example.com",
            f"{rng.randint(0, 255)}.{rng.randint(0, 300)}.7.{rng.randint(0, 255)}",
            card,
            f"{card[:4]} {card[4:8]}-{card[8:12]} {card[12:]}",
            d(16),
            f"{d(16)} {d(16)}",
            f"+1 ({d(3)}) {d(3)}-{d(4)}",
            f"+{d(2)} {d(9)}",
            f"{d(4)}-{d(2)}-{d(2)}",
            d(rng.randint(1, 20)),
        ]
    )


def hostile(rng):
    pieces = ["a@b", ".c", "@", "_x@y.z", "1.2.3.4", ".5", "+1", " 2", "(", ")", "-", "é", "😀", "\n", "999.1.1.1", "00001.2.3.255", "4111 1111 1111 1111", "0", "+", "%", " "]
    return "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = "the of and über señor naïve 文字 a 12 go".split()
    text = lambda: " ".join(person(rng) if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randint(0, 60)))
    out = [(i, text()) for i in range(250)] + [(250 + i, hostile(rng)) for i in range(250)]
    out += [(None, None), (900, None), (901, ""), (None, "x@y.com"), out[5], out[5], (out[6][0], out[7][1])]
    return out + [(902, "1 " * 3_000), (903, "x" * 3_000 + "@"), (904, "a@b" + ".c" * 20_000), (905, "9" * 2_000), (906, "+1" + "." * 50_000), (907, "u@v.w 1.2.3.4 " * 700)]


@pytest.fixture(scope="module")
def report(rows, docs_of):
    return pii.private_report(docs_of(rows)).collect()


def test_base_against_brute_force(rows, report):
    got = sorted((tuple(r)[:6] for r in report), key=repr)
    assert got == sorted((slow_row(*r) for r in rows), key=repr)


def test_spans_keep_the_base(rows, report):
    base = {(i, t): [f"{k}:{s}:{e}" for k, s, e in slow_base(t)] for i, t in rows}
    by_id = {i: b for (i, t), b in base.items() if i and i not in (5, rows[6][0])}
    for r in report:
        if r["doc_id"] in by_id:
            spans = [x for x in r["spans"].split(",") if x]
            assert [x for x in spans if x in set(by_id[r["doc_id"]])] == by_id[r["doc_id"]]
            place = [(pii.KINDS.index(k), int(s)) for k, s, e in (x.split(":") for x in spans)]
            assert place == sorted(place)


def corpus():
    rng = random.Random(3)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows = []
    for i in range(600):
        filler = " ".join(rng.choice("lorem ipsum dolor sit amet".split()) for _ in range(20))
        rows.append((i, f"{filler} user{d(2)}@mail{d(1)}.example.com {filler} +1 ({d(3)}) {d(3)}-{d(4)} {filler} on 20{d(2)}-{d(2)}-{d(2)} {filler}"))
    rows.append((1000, "write to jane7 [at] mail3 [dot] example [dot] com now"))
    rows.append((1001, "call 1 (499) 555-6503 now"))
    rows.append((1002, "on 2024-01-15 look at this. That is 12:30:45 of version 3.4"))
    return rows


def test_disguised_spans_are_added_and_plain_numbers_are_not(docs_of):
    got = {r["doc_id"]: r["spans"] for r in pii.private_report(docs_of(corpus())).where("doc_id >= 1000").collect()}
    assert got == {1000: "email:9:49", 1001: "phone:5:21", 1002: ""}


def test_redaction(docs_of):
    docs = docs_of(corpus())
    out = pii.redact(docs)
    assert out.schema.names == docs.schema.names
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[1000] == "write to [EMAIL] now" and texts[1001] == "call [PHONE] now"
    assert texts[1002] == corpus()[-1][1] and "@" not in texts[5] and texts[5].count("[PHONE]") == 1


def test_fit_against_brute_force(spark):
    """One round of boosting against sums made by hand."""
    bit = list(pii.BIT.values())
    table = [(3, bit[0], 40, 1), (3, bit[1], 20, 12), (3, bit[0] | bit[2], 20, 20), (3, 0, 1, 20)]
    rows = [(k, b, held, p, n) for k, b, p, n in table for held in (False, True)]
    counts = spark.createDataFrame(rows, "kind int, bits long, held boolean, pos long, neg long")
    model = pii.fit(counts, pii.Boosting(trees=1, step=1.0, least_rows=1, smoothing=0.01))

    def value(chosen):
        g = sum(0.5 * p - 0.5 * n for _, b, p, n in table if chosen(b))
        h = sum(0.25 * (p + n) for _, b, p, n in table if chosen(b))
        return g / (h + 0.01)

    root, (off, on) = model.trees[3][0]
    assert root == bit[0] and off[0] == bit[1] and on[0] == bit[2]
    assert off[2] == pytest.approx(value(lambda b: b == bit[1])) and off[1] == pytest.approx(value(lambda b: b == 0))
    assert on[2] == pytest.approx(value(lambda b: b == bit[0] | bit[2])) and on[1] == pytest.approx(value(lambda b: b == bit[0]))
    scored = {r["bits"]: r["s"] for r in counts.select("bits", model.score(F.col("bits"), F.col("kind")).alias("s")).collect()}
    assert model.thresholds[3] == scored[bit[0]] == max(scored.values())


def test_empty_table_and_nothing_to_learn(docs_of):
    assert pii.private_report(docs_of([(1, "x")]).where("doc_id < 0")).collect() == []
    assert tuple(pii.private_report(docs_of([(1, "no data")])).first()) == (1, 0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")
