"""License scans with MinHash over overlapping text windows, in DataFrame operations.

A notice of n words lies in a window of n + 3 words whose start is a multiple of 4,
wherever it stands. Window and notice are sets of 5-word shingles; the least of
their hashes under each of 48 hash functions is a band of one row. A notice's band is
the hash of one of its shingles, so a window can only collide where that shingle
stands:

1. The documents' shingles are hash-joined with the notices' bands. The windows around
   a match are candidates, whatever the number of notices.
2. A candidate is retrieved if the least hash of the whole window is the notice's in
   one of the bands.
3. Retrieved windows are verified by exact shingle containment of 80 %.
4. Of the notices that are verified at one place (one start of a window) the best
   contained is reported, so a sibling's notice does not stand for another license.

A window that reaches the threshold collides in a band with a probability of its
Jaccard similarity j, so in one of 48 with 1 - (1 - j)**48. The least j is that of a
notice of five words (one shingle of the window's four): 1/4, hence 0.999999; for
longer notices at 80 % containment it is 0.4 and more (least_similarity()).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.llm.shared import materialize

SHINGLE = 5
STRIDE = 4
BANDS = 48
CONTAINMENT = 0.8
#: Shingles of a text in one row while windows are looked for.
BLOCK = 32

#: Notices by license; a license may have several. Fixed values.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
     "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
     "any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
     "that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
     "products derived from this software without specific prior written permission."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) "
     "any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
     "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
     "option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
     "liable for any damages arising from the use of this software."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
WORD = r"[\p{L}\p{Nd}]+(?:[.\-][\p{L}\p{Nd}]+)*"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column) -> Column:
    """Hashes of the 5-word shingles in order, from those of the words; fewer words make one
    shingle of all, none make none."""
    short = F.when(F.size(hashes) > 0, F.array(F.xxhash64(hashes)))
    at = F.sequence(F.lit(0), F.size(hashes) - SHINGLE)
    long = F.transform(at, lambda i: F.xxhash64(F.array(*[F.get(hashes, i + k) for k in range(SHINGLE)])))
    return F.when(F.size(hashes) >= SHINGLE, long).otherwise(short)


def bands(shingles: Column) -> Column:
    """For each hash function the shingle of the least hash: that under function j is the
    shingle's hash mixed with j."""
    least = lambda j: F.array_min(F.transform(shingles, lambda h: F.struct(F.xxhash64(h, j).alias("least"), h.alias("h"))))["h"]
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), least)


def least_similarity(n: int) -> float:
    """The least Jaccard similarity of a notice of n words and a window that contains it to 80 %."""
    own, window = max(1, n - SHINGLE + 1), max(1, n + STRIDE - SHINGLE)
    shared = -(-own * 4 // 5)
    return shared / (own + window - shared)


def templates(spark: SparkSession, notices=NOTICES) -> DataFrame:
    """(notice, license, n, tset, tbands) of each notice."""
    table = spark.createDataFrame(
        [(i, name, text) for i, (name, text) in enumerate(notices)], "notice int, license string, text string"
    )
    table = table.select("notice", "license", word_hashes(F.col("text")).alias("t"))
    table = table.select("notice", "license", F.size("t").alias("n"), F.array_distinct(shingle_hashes(F.col("t"))).alias("tset"))
    return table.withColumn("tbands", bands(F.col("tset")))


def _starts(at: str, n: str) -> Column:
    """Starts of the windows of n + 3 words that hold the shingle at `at`."""
    low = F.greatest(F.col(at) + SHINGLE - F.col(n) - (STRIDE - 1), F.lit(0))
    return F.sequence(F.floor((low + STRIDE - 1) / STRIDE) * STRIDE, F.floor(F.col(at) / STRIDE) * STRIDE, F.lit(STRIDE).cast("long"))


def retrieved(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(row, notice, start): the candidate windows. `docs` is (row, text), `known` from templates()."""
    hashed = docs.select("row", word_hashes(F.col("text")).alias("w")).select("row", shingle_hashes(F.col("w")).alias("s"))
    cut = lambda i: F.struct(i.alias("first"), F.slice("s", i + 1, BLOCK).alias("s"))
    blocks = F.when(F.size("s") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size("s") - 1, F.lit(0)), F.lit(BLOCK)), cut))
    # explodes are outer: before an inner one the optimizer computes the arrays once more for their size
    rows = hashed.select("row", F.explode_outer(blocks).alias("b")).select("row", "b.first", F.posexplode_outer("b.s").alias("local", "h"))
    band = known.select("notice", "n", F.explode(F.array_distinct("tbands")).alias("h"))
    met = rows.join(F.broadcast(band), "h").select("row", "notice", "n", (F.col("first") + F.col("local")).alias("at"))
    return met.select("row", "notice", F.explode(_starts("at", "n")).alias("start")).distinct()


def license_matches(docs: DataFrame, notices=NOTICES) -> DataFrame:
    """(doc_id, license, notice, n_windows, containment): a row for each document and
    notice it holds, with the number of verified windows where no other notice is
    contained better, and the best containment. Of equally contained ones at one place
    the longest counts, then the first.

    Null and empty texts hold none. Rows with the same doc_id count together, repeated
    rows each; a null doc_id is kept as one. An empty table gives no rows. Other
    columns are not read. Whole texts are searched.
    """
    # the list of notices is fixed, and so is the size of what is broadcast
    known = materialize(templates(docs.sparkSession, notices), "notices")
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("row"))
    candidates = materialize(retrieved(base.select("row", "text"), known), "candidates")
    starts = candidates.groupBy("row").agg(F.collect_list(F.struct("start", "notice")).alias("windows"))
    longest = known.agg(F.max("n")).first()[0] or 0
    # a window's row carries its own words, however long the text is
    cut = lambda x: F.struct("row", x["start"].alias("start"), x["notice"].alias("at"), F.slice("w", (x["start"] + 1).cast("int"), longest + STRIDE - 1).alias("v"))
    found = base.join(starts, "row").select("doc_id", "row", "windows", word_hashes(F.col("text")).alias("w"))
    found = found.select("doc_id", F.explode_outer(F.transform("windows", cut)).alias("x")).select("doc_id", "x.*")
    found = found.join(F.broadcast(known), F.col("at") == F.col("notice")).withColumn("v", F.slice("v", F.lit(1), F.col("n") + STRIDE - 1))
    # exploding one element keeps the optimizer from moving the shingles into the bands' lambdas
    sets = found.withColumn("wset", F.explode_outer(F.array(F.array_distinct(shingle_hashes(F.col("v")))))).drop("v", "at")
    collided = sets.where(F.exists(F.zip_with(bands(F.col("wset")), "tbands", lambda a, b: a == b), lambda x: x))
    shared = F.size(F.array_intersect("wset", "tset")) / F.size("tset")
    verified = collided.withColumn("containment", shared).where(F.col("containment") >= CONTAINMENT)
    place = Window.partitionBy("row", "start").orderBy(F.desc("containment"), F.desc(F.size("tset")), "notice")
    return (
        verified.withColumn("rank", F.dense_rank().over(place))
        .where("rank = 1")
        .groupBy("doc_id", "license", "notice")
        .agg(F.count("*").alias("n_windows"), F.max("containment").alias("containment"))
    )


def _sql_words(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '{WORD}')"


def _sql_shingles(words: str) -> str:
    return (
        f"list_distinct(list_transform(range(greatest(len({words}) - {SHINGLE}, 0) + 1), "
        f"lambda k: array_to_string({words}[k + 1 : k + {SHINGLE}], ' ')))"
    )


def oracle_sql(notices=NOTICES) -> str:
    """Exact containment of every notice in every window, without retrieval."""
    rows = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(notices))
    return f"""
    with notices as (select notice, license, {_sql_words("text")} as t from (values {rows}) v(notice, license, text)),
    known as (select notice::int as notice, license, len(t) as n, {_sql_shingles("t")} as tset from notices),
    docs as (select doc_id, row_number() over () as row, {_sql_words("text")} as w from documents),
    windows as (select doc_id, row, n, unnest(list_transform(range(0, len(w), {STRIDE}), lambda i: {{'i': i, 'v': w[i + 1 : i + n + {STRIDE - 1}]}})) as x
        from docs, (select distinct n from known) where len(w) > 0),
    sets as (select doc_id, row, n, x.i as i, {_sql_shingles("x.v")} as wset from windows),
    found as (select doc_id, row, i, license, notice, len(tset) as own, len(list_intersect(wset, tset)) / len(tset) as containment
        from sets join known using (n)),
    ranked as (select *, row_number() over (partition by row, i order by containment desc, own desc, notice) as place
        from found where containment >= {CONTAINMENT})
    select doc_id, license, notice, count(*) as n_windows, max(containment) as containment from ranked
    where place = 1 group by doc_id, license, notice"""
