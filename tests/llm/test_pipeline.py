"""The pipeline's stages, one after the other, against brute-force versions of each."""

import re

import duckdb
from tokenizers import Tokenizer

import corpus_pipeline
from marquee.llm import decontaminate, packing, quality
from marquee.llm.queries import tokenizer_path
from tests.conftest import DATA
from tests.llm.test_dedup import slow_components, slow_fingerprint
from tests.llm.test_text_ops import slow_pack, slow_repeated


def slow_line_fails(line, words):
    symbols = sum(c in "#*$%&|<>" for c in line)
    if symbols > 0.08 * sum(len(w) for w in words):
        return True
    shouted = sum(w.endswith("!!") or len(w) > 3 and w.upper() == w and w.lower() != w for w in words)
    if len(words) >= 3 and shouted > 0.5 * len(words):
        return True
    marks = sum(w in ("|", "»", "›", ">", "•", "·", "/") for w in words)
    if len(words) > 1 and 3 * marks >= len(words):
        return True
    if len(words) <= 3 and words[-1][-1] not in quality.END_MARKS:
        return True
    if len(words) >= 5 and sum(a == b for a, b in zip(words, words[1:])) > 0.3 * len(words):
        return True
    return len(words) <= 25 and quality.BOILERPLATE.search(line) is not None


def slow_quality(docs):
    out = {}
    for doc, text in docs.items():
        words, seen, kept, lost = re.findall(r"[^\x20\x09-\x0D]+", text or ""), set(), [], 0
        for line in (text or "").split("\n"):
            own = re.findall(r"[^\x20\x09-\x0D]+", line)
            if own and (line in seen or slow_line_fails(line, own)):
                lost += sum(map(len, own))
            else:
                kept.append(line)
            seen.add(line)
        if len(words) >= 10 and 100 * slow_repeated(words) <= 20 * len(words) and lost <= 0.5 * sum(map(len, words)):
            out[doc] = "\n".join(kept)
    return out


def slow_near_duplicates(docs):
    component = slow_components([(i, slow_fingerprint(t)) for i, t in docs.items()])
    return {i: t for i, t in docs.items() if component[i] == i}


def slow_repeated_passages(docs):
    first, out = {}, {}
    data = {i: t.encode() for i, t in sorted(docs.items())}
    for i, d in data.items():
        for p in range(len(d) - 99):
            first.setdefault(d[p : p + 100], (i, p))
    for i, d in data.items():
        gone = [False] * len(d)
        for p in range(len(d) - 99):
            if first[d[p : p + 100]] < (i, p):
                gone[p : p + 100] = [True] * 100
        at, kept = 0, []
        for c in docs[i]:  # a character goes if all its bytes do
            n = len(c.encode())
            kept += [] if all(gone[at : at + n]) else [c]
            at += n
        if "".join(kept).strip(" \t\n\r\x0b\x0c"):
            out[i] = "".join(kept)
    return out


def slow_decontamination(docs):
    import pandas as pd

    base = duckdb.connect()
    documents = pd.DataFrame({"doc_id": list(docs), "text": list(docs.values())})
    base.register("documents", documents)
    base.sql(f"create view benchmark as select * from '{DATA}/benchmark.parquet'")
    held = {r[0] for r in base.sql(f"select doc_id from ({decontaminate.ORACLE_SQL})").fetchall()}
    return {i: t for i, t in docs.items() if i not in held}


def slow_packing(docs, source):
    tokenizer, items = Tokenizer.from_file(tokenizer_path()), []
    for i, t in docs.items():
        n, piece = len(tokenizer.encode(t, add_special_tokens=False).ids) + 1, 0
        while n > 0:
            items.append((min(n, packing.CAPACITY), i, piece, " ".join(t.lower().split())))
            n, piece = n - packing.CAPACITY, piece + 1
    items.sort(key=lambda x: (-x[0], x[1], x[2]))
    bins = slow_pack([x[0] for x in items], [source[x[1]] for x in items], [x[3] for x in items], packing.CAPACITY, packing.MAX_PER_SOURCE)
    filled, rows = {}, set()
    for k, (n, i, piece, _) in enumerate(items):
        start = filled.get(bins[k], 0)
        rows.add((i, piece, 0, bins[k], start, n))
        filled[bins[k]] = start + n
    return rows


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    rows = docs.collect()
    texts, source = {r.doc_id: r.text for r in rows}, {r.doc_id: r.source for r in rows}
    slow = [slow_quality, slow_near_duplicates, slow_repeated_passages, slow_decontamination]
    for (name, stage), brute in zip(corpus_pipeline.STAGES[:-1], slow):
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        before, texts = len(texts), brute(texts)
        assert {r.doc_id: r.text for r in docs.collect()} == texts, name
        assert all(r.n_chars == len(r.text) for r in docs.collect())
        assert 0.5 * before < len(texts) <= before, name
    assert {tuple(r) for r in corpus_pipeline.run(spark, DATA).collect()} == slow_packing(texts, source)


def test_stages_of_odd_rows(spark, docs_of):
    prose = "The night began slowly, with a long set of warm records that nobody in the small room had heard before."
    rows = [(None, None), (None, ""), (None, prose), (None, prose), (1, prose + " " + prose[::-1]), (1, "x " * 50_000), (2, "word " * 3)]
    for docs in (docs_of(rows), docs_of([])):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, DATA)
            assert out.columns == docs.columns, name
            kept = out.collect()
            if docs.count():
                assert any(prose in (r.text or "") for r in kept), name
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
        assert len({(p.shard, p.bin, p.start) for p in packed}) == len(packed) >= docs.count()
