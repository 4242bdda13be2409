"""Token planes, languages, quality, packing, decontamination, licenses, toxicity, pages."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.llm import bitplane, decontaminate, langid, licenses, packing, quality, toxicity, wrappers
from marquee.llm.queries import tokenizer_path
from marquee.llm.shared import shared_path

ODD = ["", None, " ", "\n\n", "a\tb", " lead", "trail ", "a  b", "x y", "don't stop, it's 3.5%", "é" * 3, "<|endoftext|> a", "Ab, cd. Ef!\nGh", "\x01 z"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_pieces_encode_like_whole_texts(tokenizer):
    encoder, random_ = bitplane.PieceEncoder(tokenizer_path(), most_pieces=50), random.Random(6)
    parts = ["a", "b'll", " ", "\n", "\t", "é", "1", "!!", "  ", " \n", " ", "word,", "Word.", "'s", " ", "\x1c", "xyz", "\r", "²", "中"]
    texts = ODD + ["".join(random_.choice(parts) for _ in range(random_.randint(0, 9))) for _ in range(3000)]
    for at in range(0, len(texts), 100):
        for text, ids in zip(texts[at : at + 100], encoder.encode(texts[at : at + 100])):
            assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)
        assert encoder.count(texts[at : at + 100]) == [len(x) for x in encoder.encode(texts[at : at + 100])]


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(tokenizer_path()) as f:
        settings = json.load(f)
    settings["pre_tokenizer"]["add_prefix_space"] = True
    path = str(tmp_path / "other.json")
    with open(path, "w") as f:
        json.dump(settings, f)
    encoder, other = bitplane.PieceEncoder(path), Tokenizer.from_file(path)
    assert not encoder.by_pieces and bitplane.PieceEncoder(tokenizer_path()).by_pieces
    for text, ids in zip(ODD, encoder.encode(ODD)):
        assert ids.tolist() == (other.encode(text, add_special_tokens=False).ids if text else [])


def test_planes_round_trip():
    for n, top in ((0, 1), (1, 1), (5, 1 << 32), (4097, 50257), (9000, 3)):
        ids = np.random.default_rng(n).integers(0, top, n, dtype=np.uint32)
        assert bitplane.from_planes(bitplane.to_planes(ids), n).tolist() == ids.tolist()


def test_store(spark, docs_of, tokenizer):
    rows = list(enumerate(ODD)) + [(100, "long text " * 3000), (101, "one"), (101, "two"), (101, "one"), (None, "null id"), (None, "another"), (None, None)]
    path = shared_path(spark, "test")
    bitplane.write_ids(docs_of(rows), path, tokenizer_path(), shards=3, chunk_ids=500)
    found = sorted(map(tuple, bitplane.digest_store(spark, path).collect()), key=lambda r: r[1])
    start, expected = 0, []
    order = docs_of(rows).select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    for doc, text, _ in sorted(order, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h)):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        expected.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert found == expected
    empty = shared_path(spark, "empty")
    bitplane.write_ids(docs_of([]), empty, tokenizer_path())
    assert bitplane.digest_store(spark, empty).count() == 0


def language(seed, letters, n):
    r = random.Random(seed)
    return [" ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(r.randint(5, 40))) for _ in range(n)]


def test_languages(spark):
    rows = [(i, t, "aa") for i, t in enumerate(language(1, "abcde", 60))] + [(100 + i, t, "bb") for i, t in enumerate(language(2, "cdefgh", 60))]
    rows += [(300, None, "aa"), (301, "123 !!", "bb"), (302, "abc " * 300_000, None), (303, "ABCDE abc", None), (None, "abcab", "aa")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, score string, bundle int").repartition(4)
    found = {r.doc_id: r for r in langid.predict_languages(frame).collect()}
    assert len(found) == len(rows)
    held = [(found[i], lang) for i, _, lang in rows if i is not None and lang and i < 300 and found[i].held_out]
    assert sum(r.lang_pred == lang for r, lang in held) >= 0.9 * len(held)
    assert (found[300].lang_pred, found[300].score, found[301].lang_pred) == ("und", 0.0, "und")
    assert found[302].lang_pred == "aa" and all(0 <= r.score <= 1 for r in found.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items() if i is not None)
    nothing = langid.predict_languages(frame.where("lang is null"))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert langid.predict_languages(frame.limit(0)).count() == 0


def slow_bundle(text, letters):
    """Trigram by trigram, by the letters' vectors."""
    total, n, table = np.zeros(letters.dimensions, np.int64), 0, collections.Counter()
    line = f" {''.join(c if c.isalpha() else ' ' for c in (text or '').lower())} "
    table.update(line[i : i + 3] for i in range(len(line) - 2) if line[i + 1] != " ")
    for gram, times in table.items():
        a, b, c = (letters.vectors(np.array([ord(x)]))[0].astype(np.int64) for x in gram)
        total += times * np.roll(a, 2) * np.roll(b, 1) * c
        n += times
    return total, n


def test_bundles_are_sums_of_trigram_vectors():
    letters, table, r = langid.Letters(64), langid.letter_table(), random.Random(4)
    long = "".join(r.choice("abcdé ÄöΣ12.\n") for _ in range(2_000_000))
    texts = ["Ab1 c" * 50, None, "", "a", "İx", long, "12 !", "x" * (langid.BATCH_LETTERS // 2), long[:30]]
    sums, counts = langid.bundles(texts, letters, table)
    for text, found, n in zip(texts, sums, counts):
        total, expected = slow_bundle(text, letters)
        assert found.tolist() == total.tolist() and n == expected


def test_prototypes_and_predictions_against_brute_force(spark):
    r = random.Random(6)
    rows = [(i, t, lang) for k, lang in enumerate(("aa", "bb", "cc")) for i, t in enumerate(language(k, "abcdefgh"[k : k + 5], 30), 100 * k)]
    rows += [(900, "ab c" * 5_000_000, "aa"), (901, "ba " * 600_000, None), (5, rows[5][1], "aa"), (5, rows[5][1], "aa"), (902, None, "bb"), (903, "", None)]
    r.shuffle(rows)
    letters = langid.Letters(langid.DIMENSIONS)
    bundle = {t: slow_bundle(t, letters) for _, t, _ in rows}
    sums = {lang: np.zeros(langid.DIMENSIONS) for lang in ("aa", "bb", "cc")}
    for i, t, lang in rows:
        if lang and t and zlib.crc32(str(i).encode()) % 5:
            sums[lang] += np.rint(bundle[t][0] * (langid.DOC_WEIGHT / bundle[t][1]))
    unit = {lang: v / np.linalg.norm(v) for lang, v in sums.items()}
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    learned = langid.learn_prototypes(frame.where(langid.fold() != 0))
    assert learned.langs == ["aa", "bb", "cc"] and all(np.allclose(unit[x], v) for x, v in zip(learned.langs, learned.vectors))
    without = langid.learn_prototypes(frame.where((langid.fold() != 0) & (F.col("doc_id") != 900)))
    assert zlib.crc32(b"900") % 5 == 0 or not np.allclose(without.vectors[0], learned.vectors[0], atol=1e-12)
    found = langid.predict_languages(frame).collect()
    assert len(found) == len(rows)
    text = {i: t for i, t, _ in rows}
    for x in found:
        total, n = bundle[text[x.doc_id]]
        cosines = {lang: float(total @ v) / np.linalg.norm(total) for lang, v in unit.items()} if n else {}
        best = max(cosines, key=cosines.get) if n else "und"
        assert x.lang_pred == best and abs(x.score - max(0, cosines.get(best, 0))) < 1e-9


def slow_repeated(words):
    seen = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(covered)


def test_repeated_words():
    r = random.Random(8)
    for k in range(600):
        words = [r.choice("ab" if k % 2 else "abcdefghijklmnop") for _ in range(r.randint(0, 40))]
        assert quality.repeated_words(words) == slow_repeated(words)
    many = [str(r.randrange(9000)) for _ in range(12000)]
    assert quality.repeated_words(many + many[:50]) == slow_repeated(many + many[:50])


PROSE = "The night began slowly, with a long set of warm records.\nPeople came in from the rain and stayed until the morning light."


def test_quality(docs_of):
    rows = [
        (1, PROSE), (2, None), (3, ""), (4, "too short"), (5, "all of | these | words | stand | here | like | menus | do | in | rows |"),
        (6, "GO!! NOW!! BUY!! THIS!! THING!! HERE!! FAST!! AND!! TELL!! ALL!! YOUR!! FRIENDS!!"), (7, "spam spam " * 200),
        (8, PROSE + "\nHome\nRead more\nHome"), (9, "a$$$ b%%% c### d*** e&&& f$$$ g%%% h### i*** j&&& k$$$ l%%%"), (1, PROSE),
    ]
    frame = docs_of(rows)
    found = sorted(quality.quality_report(frame).collect())
    assert [(r.doc_id, r.kept) for r in found] == [(1, True), (1, True), (2, False), (3, False), (4, False), (5, False), (6, False), (7, False), (8, True), (9, False)]
    eight = found[8]
    assert (eight.n_dup_lines, eight.base_failed) == (1, False)
    for r in found:
        text = dict(rows)[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert r.n_repeat_words == slow_repeated(words)
    cleaned = quality.clean_lines(frame)
    assert cleaned.columns == frame.columns
    assert {r.doc_id: r.text for r in cleaned.collect()} == {1: PROSE, 8: PROSE}
    assert quality.clean_lines(docs_of([])).count() == quality.quality_report(docs_of([])).count() == 0


def test_packing(spark):
    r = random.Random(3)
    rows = [(i, "w " * r.randint(0, 90), f"s{r.randrange(3) if r.random() < 0.5 else 0}", r.randrange(30)) for i in range(400)]
    rows += [(1000, "w " * 1000, "s1", None), (1001, None, None, None), (1001, None, None, None), (None, "a b", "s2", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, group long").repartition(3)
    out = packing.pack_documents(frame, length=F.size(F.split(F.coalesce("text", F.lit("")), " ")), cluster=F.col("group"), capacity=128, shard_items=150).collect()
    words = collections.Counter()
    for doc, text, _, _ in rows:
        words[doc] += (text or "").count(" ") + 1
    got, bins = collections.Counter(), collections.defaultdict(list)
    for p in out:
        got[p.doc_id] += p.n_tokens
        bins[p.shard, p.bin].append(p)
    assert got == words
    about = {doc: (s, g) for doc, _, s, g in rows}
    for pieces in bins.values():
        pieces.sort(key=lambda p: p.start)
        assert all(a.start + a.n_tokens == b.start for a, b in zip(pieces, pieces[1:])) and pieces[0].start == 0
        assert pieces[-1].start + pieces[-1].n_tokens <= 128
        sources = collections.Counter(about[p.doc_id][0] for p in pieces if about[p.doc_id][0])
        clusters = collections.Counter(about[p.doc_id][1] for p in pieces if about[p.doc_id][1] is not None)
        assert max(sources.values(), default=0) <= packing.MAX_PER_SOURCE and max(clusters.values(), default=0) <= 1
    assert packing.pack_documents(frame.limit(0).drop("group"), tokenizer_path()).count() == 0


def test_packing_keeps_ids_and_takes_token_lengths(docs_of, tokenizer):
    big = 1152921504606846977
    rows = [(big, "one text"), (big + 2, "other text, longer"), (None, "text of a null id"), (None, "text of a null id"), (3, None), (4, ""), (5, "x" * 30_000)]
    rows += [(7, "the same"), (7, "the same"), (7, "not the same")]
    out = packing.pack_documents(docs_of(rows), tokenizer_path(), shard_items=4).collect()
    expected, found = collections.Counter(), collections.Counter()
    for doc, text in rows:
        expected[doc] += len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
    for p in out:
        found[p.doc_id] += p.n_tokens
    assert found == expected and len({(p.shard, p.bin, p.start) for p in out}) == len(out)
    room = collections.Counter()
    for p in out:
        room[p.shard, p.bin] += p.n_tokens
    assert max(room.values()) <= packing.CAPACITY


def slow_pack(sizes, sources, clusters, capacity, most):
    bins, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [
            (capacity - sum(sizes[j] for j in b), n) for n, b in enumerate(bins)
            if sum(sizes[j] for j in b) + sizes[i] <= capacity and clusters[i] not in [clusters[j] for j in b]
            and [sources[j] for j in b].count(sources[i]) < most
        ]
        if fits:
            n = min(fits)[1]
        else:
            n = len(bins)
            bins.append([])
        bins[n].append(i)
        out[i] = n
    return out


def test_pack_is_best_fit():
    r = random.Random(12)
    for _ in range(60):
        n = r.randint(0, 60)
        sizes, sources, clusters = ([r.randint(a, b) for _ in range(n)] for a, b in ((0, 40), (0, 2), (0, 12)))
        assert {i: b for i, (b, _) in enumerate(packing.pack(sizes, sources, clusters, 50, 2))} == slow_pack(sizes, sources, clusters, 50, 2)


QUESTION = "A train leaves Boston at 40 km per hour and Alice counts 17 apples while Bob eats 3 of them before noon"


def test_decontamination(spark, docs_of):
    items = [(1, QUESTION), (2, None), (3, "too short"), (4, "plain words only in this second question of the set"), (4, "other text under the same number again")]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, h string")
    rows = [
        (1, "Intro. " + QUESTION + ". Outro"),
        (2, "Intro. A train leaves Paris at 55 km per hour and Carol counts 12 apples while Dave eats 4 of them before noon. Ok"),
        (3, None), (4, ""), (5, "a train leaves nothing here and nobody counts apples at 3 km per hour"),
        (6, "He said plain words only in this second question of the set and other text under the same number again"), (None, QUESTION),
        (7, "word " * 60000),
    ]
    found = {(r.doc_id, r.item_id): r for r in decontaminate.contamination(docs_of(rows), bench).collect()}
    assert found.keys() == {(1, 1), (2, 1), (6, 4)}
    assert not found[1, 1].reparameterised and found[2, 1].reparameterised
    kept = decontaminate.drop_contaminated(docs_of(rows), bench)
    assert kept.columns == docs_of(rows).columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [3, 4, 5, 7]
    twins = docs_of([(None, "a text of its own"), (9, QUESTION), (9, "not that question"), (9, "not that question"), (None, None)])
    assert sorted(((r.doc_id or -1), r.text or "") for r in decontaminate.drop_contaminated(twins, bench).collect()) == [
        (-1, ""), (-1, "a text of its own"), (9, "not that question"), (9, "not that question"),
    ]
    assert decontaminate.contamination(docs_of([]), bench).count() == 0
    assert decontaminate.contamination(docs_of(rows), bench.limit(0)).count() == 0


def test_inconsistent_slots_are_no_match(spark, docs_of):
    item = "we take 5 red balls and then 5 blue balls and then 5 green balls and 5 more at last"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    mixed = "we take 5 red balls and then 6 blue balls and then 7 green balls and 8 more at last"
    same = "we take 9 red balls and then 9 blue balls and then 9 green balls and 9 more at last"
    found = decontaminate.contamination(docs_of([(1, mixed), (2, same), (3, item)]), bench).collect()
    assert {r.doc_id for r in found} == {2, 3}


def test_each_value_is_judged_by_itself(spark, docs_of):
    """Other slots do not offset a value that is bound to many."""
    item = "we take 5 red balls with Alice Smith and then 5 blue balls with Bob Jones and then 5 green balls with Carol King and 5 more with Dan Hill at 90 kg"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    torn = item.replace("5", "{}").format(1, 2, 3, 4)
    long = " ".join(["filler words that go on"] * 3000)
    found = decontaminate.contamination(docs_of([(1, torn), (2, item.replace("5", "8")), (3, long + " " + item + " " + long)]), bench).collect()
    assert {r.doc_id for r in found} == {2, 3}


def test_equal_hashes_are_compared(spark, docs_of, monkeypatch):
    bench = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    monkeypatch.setattr(decontaminate.F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    docs = docs_of([(1, QUESTION), (2, "an unlike text of enough words to have windows")])
    found = decontaminate._hits(docs, decontaminate.index(bench), decontaminate.MARK_NAMES)
    assert {r.doc_id for r in found.collect()} <= {1}


def test_an_occurrence_among_variants_is_held(spark, docs_of):
    variants = [
        QUESTION.replace("Alice", a).replace("Bob", b).replace("40", f"{k}1").replace("17", f"{k}2").replace("3", f"{k}3")
        for k, (a, b) in enumerate([("Carol", "Dave"), ("Erin", "Frank"), ("Grace", "Henry"), ("Ida", "John")], 4)
    ]
    recurring = " and ".join(f"then we take {k} red balls from box {k}" for k in (5, 6, 7, 8))
    bench = spark.createDataFrame([(1, QUESTION), (2, recurring)], "item_id long, text string")
    torn = " and ".join(f"then we take {k} red balls from box {k + 3}" for k in range(1, 10))
    apart = QUESTION.replace(" and ", " and also ", 1)
    rows = [
        (1, ". ".join([*variants, QUESTION])), (2, ". ".join(variants)), (3, f"{recurring}. {recurring}"), (4, torn),
        (5, ". ".join([*[v.split(" and ")[0] for v in variants], *variants[:1]])), (6, ". ".join(v.split(" while ")[0] for v in variants)),
        (7, ". ".join([*variants, apart])),
    ]
    found = {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs_of(rows), bench).collect()}
    assert found == {(1, 1), (2, 1), (3, 2), (5, 1), (7, 1)}


def test_names_at_every_position_and_short_items(spark, docs_of):
    alice = "Alice has 3 apples. Alice gives 2 to Bob. How many apples does Alice have?"
    items = [(1, alice), (2, "What is the boiling point of water"), (3, "What is 12 + 7?"), (4, "12 + 7 * 3 - 5 = 28")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [
        (1, alice.replace("Alice", "Carol").replace("Bob", "Dan")), (2, "then it asks, the What is the boiling point of water"),
        (3, "so what is 12 + 7? ok"), (4, "so what is 12 + 8? ok"), (5, "sum: 12 + 7 * 3 - 5 = 28."), (6, "12 + 7 * 3 - 5 = 29"),
        (7, "Carol has 3 apples. Dan gives 2 to Carol. How many apples does Erin have?"), (8, None),
    ]
    found = {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs_of(rows), bench).collect()}
    assert found == {(1, 1), (2, 2), (3, 3), (5, 4)}


def test_items_full_of_names_are_looked_for_everywhere(spark, docs_of):
    """No window of the item is without a name, so no hit of the other reading leads to it."""
    item = "Alice went home early. Bob came back late. Carol left it open. Dan read some books."
    bench = spark.createDataFrame([(1, item), (2, QUESTION)], "item_id long, text string")
    other = "Paul went home early. Quinn came back late. Rosa left it open. Sam read some books."
    found = decontaminate.contamination(docs_of([(1, other), (2, "nothing here"), (3, "Well, " + QUESTION)]), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (3, 2)}


def test_documents_that_may_hold_an_item(spark, docs_of, monkeypatch):
    """Reading these again gives what reading all again gives, with ids broadcast or not."""
    item = "Alice went home early. Bob came back late. Carol left it open. Dan read some books."
    other = "Paul went home early. Quinn came back late. Rosa left it open. Sam read some books."
    both = [item.replace(". Bob came back late", ""), "Rosa left it open. Sam read some books. Paul went home early. Quinn came back late."]
    bench = spark.createDataFrame([(1, item), (2, QUESTION), (3, "Alice sold 3 red hats to us. Alice kept 2 blue hats at home.")], "item_id long, text string")
    rows = [
        (1, other), (2, other.upper()), (3, other.replace("early", "ea\x01rly").replace("late", "la\x02te")), (4, "nothing here"), (5, None),
        (6, "Well, " + QUESTION), (7, "Carol sold 8 red hats to us. Carol kept 9 blue hats at home."), (8, both[0]), (8, both[1]), (None, other),
        (9, other + " It is so. " + other), (10, "went home early came back late left it open read some books"),
    ]
    docs = docs_of(rows)
    got = lambda: sorted(map(tuple, decontaminate.contamination(docs, bench).collect()))
    first = got()
    assert {(1, 1), (3, 1), (6, 2), (7, 3), (9, 1)} <= {(r[0], r[1]) for r in first}
    known = decontaminate.index(bench, decontaminate.MARK_EVERY)
    hits = decontaminate._hits(docs, decontaminate.index(bench), decontaminate.MARK_NAMES)
    again = {r.doc_id for r in decontaminate._may_hold(docs.where("doc_id is not null"), known, hits).collect()}
    assert {1, 3, 7, 9} <= again and not again & {4, 5}
    monkeypatch.setattr(decontaminate, "BROADCAST_IDS", 0)
    assert got() == first
    monkeypatch.setattr(decontaminate, "WORD_ITEMS", 0)
    assert decontaminate._words_needed(known) is None
    monkeypatch.setattr(decontaminate, "_may_hold", lambda docs, known, hits: docs)
    assert got() == first


def test_a_shuffled_index_gives_the_same(spark, docs_of, monkeypatch):
    bench = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    frame = docs_of([(1, QUESTION), (2, "nothing of the kind is in this text")])
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert [r.doc_id for r in decontaminate.contamination(frame, bench).collect()] == [1]


def test_names_and_numbers_of_any_length(spark, docs_of):
    """Thousands of names or numbers in a row, of unlike lengths: a greedy group's stack ended the executor."""
    draw = random.Random(1)
    names = " ".join("A" + "a" * draw.randint(1, 9) for _ in range(20000))
    numbers = ",".join(str(draw.randint(0, 10 ** draw.randint(1, 6))) for _ in range(20000))
    bench = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    rows = [(1, f"so {names}. {QUESTION}"), (2, f"so {numbers} is. {QUESTION}"), (3, names), (4, numbers)]
    assert {r.doc_id for r in decontaminate.contamination(docs_of(rows), bench).collect()} == {1, 2}
    for text, n in ((f"so {names}", 2), (f"so {numbers}", 2), (f"Aa 1,2 {names}", 3)):
        assert spark.createDataFrame([(text,)], "text string").select(F.size(decontaminate.tokens(F.col("text"))).alias("n")).head().n == n


def test_items_with_the_same_texts_are_judged_once(spark, docs_of, monkeypatch):
    """Each has its row, but hits are those of different items."""
    copies, short = range(5, 25), [(30, "What is"), (31, "What is")]
    items = [(i, t) for i in copies for t in (QUESTION, "plain words only in this second question of the set")] + short + [(40, QUESTION)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    taken = []
    plain = decontaminate._hits
    monkeypatch.setattr(decontaminate, "_hits", lambda *a: taken.append(plain(*a)) or taken[-1])
    text = QUESTION + ". And plain words only in this second question of the set"
    found = decontaminate.contamination(docs_of([(1, text), (2, "What is it?")]), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [*((1, i) for i in copies), (1, 40), (2, 30), (2, 31)]
    assert len({tuple(r)[2:] for r in found if r.item_id in copies}) == 1
    assert all({r.item_id for r in hits.select("item_id").collect()} == {5, 40} for hits in taken)


def slow_licenses(text):
    """Counts of windows by notice: every notice in every window, the best at each start."""
    split = lambda t: re.findall(r"[^\W_]+(?:[.\-][^\W_]+)*", (t or "").lower())
    words, found = split(text), collections.Counter()
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    notices = [split(notice) for _, notice in licenses.NOTICES]
    for at in range(0, len(words), licenses.STRIDE):
        here = []
        for number, own in enumerate(notices):
            share = len(grams(words[at : at + len(own) + 3]) & grams(own)) / len(grams(own))
            if share >= 0.8:
                here.append((-share, -len(grams(own)), number))
        if here:
            found[min(here)[2]] += 1
    return found


def test_licenses(docs_of):
    r = random.Random(7)
    rows = [(1, None), (2, ""), (3, "no such thing, licensed or not"), (4, "released under the mit license"), (4, "released under the mit license")]
    rows += [(None, "Licensed under CC BY 4.0."), (5, "lorem ipsum " * 30_000 + licenses.NOTICES[3][1] + " dolor" * 30_000), (6, "mit license")]
    for i in range(150):
        filler = ["lorem"] * r.randint(0, 30)
        notice = r.choice(licenses.NOTICES)[1].split()
        if r.random() < 0.4:
            notice[r.randrange(len(notice))] = "changed"
        rows.append((10 + i, " ".join(filler + notice + filler[:3])))
    found, expected = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for m in licenses.license_matches(docs_of(rows)).collect():
        found[m.doc_id][m.notice] = m.n_windows
    for i, t in rows:
        expected[i].update(slow_licenses(t))
    assert found == {i: c for i, c in expected.items() if c}
    assert licenses.license_matches(docs_of([])).count() == 0


def test_sibling_licenses_are_told_apart(docs_of):
    rows = [(i, f"Intro. {notice} Outro.") for i, (_, notice) in enumerate(licenses.NOTICES)]
    found = collections.defaultdict(set)
    for m in licenses.license_matches(docs_of(rows)).collect():
        found[m.doc_id].add(m.license)
    assert found == {i: {name} for i, (name, _) in enumerate(licenses.NOTICES)}


def test_bands_retrieve(spark):
    """Without bands nothing is retrieved; with them candidates are few."""
    known = licenses.templates(spark)
    sizes = {r.n for r in known.collect()}
    assert all(1 - (1 - licenses.least_similarity(n)) ** licenses.BANDS > 0.999998 for n in sizes)
    docs = spark.createDataFrame([(1, "some words that are in no notice " * 50 + licenses.NOTICES[0][1])], "row long, text string")
    assert licenses.retrieved(docs, known.withColumn("tbands", F.array().cast("array<bigint>"))).count() == 0
    assert 0 < licenses.retrieved(docs, known).count() < 20


def test_toxicity(spark):
    r = random.Random(5)
    words, bad = [f"w{c}{d}x" for c in "abcdefghij" for d in "klmnop"], ["vilestem", "vilestone", "grubby"]
    rows, labels = [], []
    for i in range(1200):
        text = [r.choice(words) for _ in range(25)]
        toxic = r.random() < 0.25
        if toxic:
            text[r.randrange(25)] = r.choice(bad)
        if r.random() < (0.5 if toxic else 0.05):  # the labels' bias
            text[r.randrange(25)] = "muslim"
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    neutral, plain = " ".join(words[:20]) + " muslim", " ".join(words[:20])
    rows += [(5000, neutral), (5001, plain), (5002, None), (5003, ""), (None, "vilestem")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, score int").repartition(3)
    marks = spark.createDataFrame([*labels, (7000, 1), (3, None)], "doc_id long, toxic int")
    found = {x.doc_id: x for x in toxicity.predict_toxicity(docs, marks).collect()}
    assert len(found) == len(rows)
    held = [(found[i], y) for i, y in labels if found[i].held_out]
    assert sum(x.predicted == y for x, y in held) >= 0.95 * len(held)
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, x in found.items() if i is not None)
    free = toxicity.predict_toxicity(docs, marks, toxicity.Training(penalty=0.0)).where("doc_id in (5000, 5001)").collect()
    gap = abs(found[5000].score - found[5001].score)
    assert gap < abs(free[0].score - free[1].score) and found[5000].predicted == 0
    none = toxicity.predict_toxicity(docs, marks.limit(0)).collect()
    assert len(none) == len(rows) and not any(x.predicted for x in none)


def slow_logit(text, model):
    """The sum of the weights of the text's distinct features, one by one."""
    weight, met = dict(zip(model.buckets.tolist(), model.weights.tolist())), set()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        met.add(zlib.crc32(b"=" + word.encode()) % toxicity.BUCKETS)
        met.update(zlib.crc32(b"^" + word[:n].encode()) % toxicity.BUCKETS for n in (3, 4, 5, 6) if len(word) >= n)
    return model.bias + sum(weight.get(f, 0.0) for f in sorted(met))


def test_toxicity_scores_against_brute_force(spark):
    r = random.Random(9)
    texts = [" ".join(r.choice(["fine", "good", "Vile", "grim", "muslim", "woman", "ok"]) for _ in range(12)) for _ in range(60)]
    rows = [*enumerate(texts), (3, texts[3]), (3, "another row"), (70, "vile " * 400_000 + "woman"), (71, None), (None, None)]
    labels = [(i, int("vile" in t.lower())) for i, t in enumerate(texts)] + [(3, 1), (3, 1), (4, None), (999, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = toxicity.train(docs, marks.where(fold != 2))
    terms = {b for w in ("muslim", "woman", toxicity.SWAP["muslim"], toxicity.SWAP["woman"]) for b in toxicity.word_features(w)}
    assert zlib.crc32(b"=muslim") % toxicity.BUCKETS in model.buckets and terms & set(model.buckets.tolist())
    found = toxicity.predict_toxicity(docs, marks).collect()
    assert len(found) == len(rows)
    expected = collections.Counter(round(1 / (1 + np.exp(-slow_logit(t, model))), 9) for _, t in rows)
    assert collections.Counter(round(x.score, 9) for x in found) == expected
    assert all(x.predicted == (x.score >= 0.3) for x in found)
    assert toxicity.predict_toxicity(docs.limit(0), marks).count() == 0


ARTICLE = "<article><h1>Head &amp; tail</h1><p>One <b>two</b>\n three<br>four<p>Five &lt;six&gt;.</p><div class=ad>Buy</div></article>"
PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><p>Site</p></header><nav><ul><li><a href=x>Home</a></li>"
    "<li><a>B</a></li></ul></nav>" + ARTICLE + "<script>var t='</p>';</script><!-- c --><form><p>Mail</p></form><aside><p>Side</p></aside>"
    "<section class='comments'><p>said</p></section><footer>F</footer></body></html>"
)


def test_pages(spark):
    rows = [(1, "http://a.org/1", PAGE), (2, "http://a.org/2", PAGE.replace("Five", "Six")), (3, None, None), (4, "x", ""), (5, "http://b.org", "<p>just text<p>a < b")]
    rows += [(6, "http://c.org", "<div><div class=menu>m</div><div><p>long text here we go</p><p>again</p></div></div>"), (7, "http://a.org/3", "<<<>&&"), (1, "http://a.org/1", PAGE)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, wrapper string")
    found = {r.page_id: r.text for r in wrappers.main_texts(frame).collect()}
    head = "Head & tail\nOne two three four\n"
    assert found == {1: head + "Five <six>.", 2: head + "Six <six>.", 3: "", 4: "", 5: "just text\na < b", 6: "long text here we go\nagain", 7: "<<<>&&"}
    assert all(r.n_chars == len(r.text) for r in wrappers.main_texts(frame).collect())
    assert wrappers.main_texts(frame.limit(0)).count() == 0


def test_template_text_is_left_out(spark):
    page = "<body><div><p class=by>Shared by Site</p><div><h2>T{i}</h2><p>text {i}</p><p>more {i}</p></div>{x}</div></body>"
    odd = {3: "<blockquote>once</blockquote><pre>code</pre><h2>Conclusion</h2>", 5: "<h2>Conclusion</h2>"}
    pages = [(i, "http://a.org/x", page.format(i=i, x=odd.get(i, ""))) for i in range(12)]
    pages += [(100 + i, "http://few.org/x", page.format(i=i, x="")) for i in range(3)]
    pages += [(200 + i, "http://art.org/x", f"<article><p>Constant</p><p>text {i}</p></article>") for i in range(12)]
    pages += [(300 + i, "http://copies.org/x", page.format(i=0, x="")) for i in range(30)]
    found = []
    for parts in (1, 7):
        frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(parts)
        found.append({r.page_id: r.text for r in wrappers.main_texts(frame).collect()})
    assert found[0] == found[1]
    for i, text in found[0].items():
        own = f"T{i % 100}\ntext {i % 100}\nmore {i % 100}"
        if i < 12:
            rest = {3: "\nonce\ncode\nConclusion", 5: "\nConclusion"}.get(i, "")
            assert text == own + rest
        elif i < 200:
            assert text == "Shared by Site\n" + own
        elif i < 300:
            assert text == f"Constant\ntext {i - 200}"
        else:
            assert text == "Shared by Site\nT0\ntext 0\nmore 0"


def test_repeated_groups_fold(spark):
    assert wrappers.places(["h2", "p", "h2", "p", "x"]) == [("h2", 0), ("p", 0), ("h2", 0), ("p", 0), ("x", 0)]
    assert wrappers.places(["p", "p", "h2", "p"]) == [("p", 0), ("p", 0), ("h2", 0), ("p", 1)]
    pages = [(1, "//h", "<h1>a</h1><p>b</p><p>c</p>"), (2, "//h", "<h1>a</h1><p>d</p><div>e</div>")]
    wrapper = wrappers.infer_wrappers(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert sorted(r.token for r in wrappers.expressions(wrapper).collect()) == ["#+", "=", "=", "div?", "h1", "p+"]


def test_articles_keep_their_own_parts():
    page = (
        "<body><header><p>Site</p></header><article><header class='entry-header'><h1>Title</h1></header><div class='related-work'><p>Work</p></div>"
        "<p>Press <button>Go</button> and <math><mi>x</mi></math> in <svg><text>fig</text></svg> or <object>obj</object>.</p>"
        "<div class='ad-box'>Buy</div><form><p>Mail</p></form><section id=comments><p>said</p></section><p class=notice>Note</p></article></body>"
    )
    assert wrappers.extract(page) == "Title\nWork\nPress Go and x in fig or obj."


ARTICLE = "<article><h1>Title</h1><p>All of the text that this page is about.</p></article>"


@pytest.mark.parametrize(
    "page",
    [
        f'<form id="aspnetForm"><nav><p>menu</p></nav>{ARTICLE}<input></form>',
        f'<div class="content-sidebar-wrap"><main>{ARTICLE}</main><div class="sidebar"><p>side</p></div></div>',
        f'<div id="page" class="site has-sidebar">{ARTICLE}<aside><article class="teaser"><p>next</p></article></aside></div>',
        f'<div class="nav-open menu">{ARTICLE}</div>',
        f'<body class="comments-open"><div id="comments-page">{ARTICLE}</div></body>',
        f'{ARTICLE}<article class="advert"><p>buy</p></article><div id="comments"><article class="comment"><p>nice</p></article></div>',
        ARTICLE.replace("<p>", '<section id="sharing"><p>').replace("</p>", "</p></section>"),
        ARTICLE.replace("<article>", '<article class="post tag-sharing category-social has-comments">'),
    ],
)
def test_furniture_names_lose_no_article(page):
    assert wrappers.extract(page) == "Title\nAll of the text that this page is about."


def test_forms_around_pages_without_articles():
    body = "<h1>Title</h1><p>All of the text that this page is about, in some words.</p>"
    assert wrappers.extract(f"<form><div>{body}</div><nav><a href=x>menu</a></nav></form>").startswith("Title\nAll of")
    assert wrappers.extract(f"<div>{body}</div><form><p>Your mail</p></form>").endswith("in some words.")
    assert wrappers.extract(f"<div>{body}</div><div class=comments><p>{'said by a reader ' * 20}</p></div>").endswith("in some words.")
    assert wrappers.extract("<nav>" * 5_000 + "<p>menu" + "<article>" * 5_000 + "x") is not None


def test_hostile_pages_take_linear_time():
    import time

    began = time.perf_counter()
    deep = "<article>" + "<div>" * 50_000 + "<p>deep</p>" + "<nav><p>menu</p></nav>" + "</div>" * 50_000 + "<p>end</p></article>"
    assert wrappers.extract(deep) == "deep\nend"
    assert wrappers.extract("<p>" + "<a " * 350_000).startswith("<a")
    assert wrappers.extract("<p>x</p>" + "<a x='" * 170_001 + ">\"").startswith("x")
    assert wrappers.extract("<p>x" + "<a ='\"" * 100_000 + "<b>y</b>").startswith("x")
    assert wrappers.extract("<!--" * 200_000 + "<p>x") == "" and wrappers.extract("<script>" * 100_000) == ""
    assert wrappers.extract("<article><p>don't <b title=it's>stop</b> it's</p></article>") == "don't stop it's"
    unlike = "<article>" + "".join(f"<div class='k{chr(97 + i % 26)}{i:x}'><p>{i}</p></div>" for i in range(20_000)) + "</article>"
    assert wrappers.extract(unlike).count("\n") == 19_999
    assert wrappers.extract("<table>" + "<td>a<li>b" * 20_000).count("\n") > 1000
    assert wrappers.extract("</div>" * 200_000 + "<p>x") == "x"
    site = wrappers.Wrapper()
    for page in (deep, unlike, unlike):
        site.add(page)
    assert time.perf_counter() - began < 60


def slow_main_text(page):
    """By the standard library's parser: the article's texts but for furniture elements."""
    import html.parser

    class Reader(html.parser.HTMLParser):
        blocks, run, inside, skip, script = None, "", 0, 0, 0

        def flush(self):
            text = re.sub(r"\s+", " ", self.run).strip()
            self.run = ""
            if text:
                self.blocks.append(text)

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.run += " "
            elif tag != "b":
                self.flush()
            self.inside += tag == "article"
            self.skip += tag in ("nav", "aside", "footer", "form") or dict(attrs).get("class") in ("ad", "comments")
            self.script += tag in ("script", "style")

        def handle_endtag(self, tag):
            if tag != "b":
                self.flush()
            self.inside -= tag == "article"
            self.skip -= tag in ("nav", "aside", "footer", "form", "div", "section")
            self.script -= tag in ("script", "style")

        def handle_data(self, data):
            if self.inside and not self.skip and not self.script:
                self.run += data

    reader = Reader()
    reader.blocks = []
    reader.feed(page)
    reader.flush()
    return "\n".join(reader.blocks)


def test_pages_against_brute_force(spark):
    from tests.conftest import DATA

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    found = {r.page_id: r.text for r in wrappers.main_texts(pages).collect()}
    assert found == {i: slow_main_text(p or "") for i, p in html.items()}


def test_windows_meet_items_in_generated_code(spark, monkeypatch):
    """No lambda is in the join's condition, so no window's block is copied but for hits."""
    from marquee.llm import decontaminate as de

    items = spark.createDataFrame([(1, "the old train left Paris at 9 km from here")], "item_id long, text string")
    docs = spark.createDataFrame([(5, "so the old train left Rome at 12 km from here")], "doc_id long, text string")
    known = de.materialize(de.index(items), "items")
    monkeypatch.setattr(de, "materialize", lambda frame, name: frame)
    hits = de._hits(docs, known, de.MARK_NAMES)
    joins = [line for line in hits._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert joins and not any("lambda" in line for line in joins)
    assert hits.count() > 0


def test_canonical_tokens_by_their_first_character(spark):
    from marquee.llm import decontaminate as de

    values = {"Word": "word", "éa": "éa", "\x01Paris": "<name>", "\x02km": "<unit>", "0": "<number>", "9:30": "<number>", "12.5": "<number>", "zz": "zz"}
    rows = spark.createDataFrame([(v,) for v in values], "t string").select("t", de._canonical(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in rows} == values
