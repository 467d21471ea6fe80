"""License scans by MinHash bands over overlapping windows (DataFrame operations only).

Texts are cut into overlapping windows of words. A window's word shingles, as far as any template
has them, are signed with MinHash, and bands of the signatures retrieve templates from a broadcast
table of fixed size; the exact share of a template's shingles that the window holds decides.
A window full of other templates' shingles is little similar to a short one that it holds, so
bands are relied on only for templates that they miss there with a chance below ``MISS``; the
others are retrieved by shingles of their own, so many that a window without any of them holds too
few (see ``by_shingles``).

Texts that lack certain words of every template are skipped first: the words are chosen so that
too few of a template's shingles are left without one to reach the containment (see ``anchors``).

Templates too long for a window, such as whole license texts, have windows of as many strides as
they need. Their shingles are posted one by one, and what the windows hold is added up over the
places where a shingle comes into reach and leaves it (see ``_scan_long``).
"""

from __future__ import annotations

import re
from collections import Counter
from math import ceil
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Sentences of public licenses and the lines that announce them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "All-rights-reserved": "All rights reserved.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "Apache-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
}
SHINGLE, WINDOW, STRIDE = 3, 64, 32
BANDS, ROWS = 64, 1
#: Share of a template's shingles that a window must hold, in percent.
PERCENT = 80
#: Chance, at most, that bands miss a window that holds just enough of a template.
MISS = 1e-9
WORD = "[a-z0-9]+"


def template_shingles(templates: dict[str, str]) -> dict[str, list[str]]:
    out = {}
    for name, text in templates.items():
        words = re.findall(WORD, text.lower())
        if len(words) < SHINGLE:
            raise ValueError(f"template {name} has {len(words)} words")
        out[name] = sorted({" ".join(words[k : k + SHINGLE]) for k in range(len(words) - SHINGLE + 1)})
    return out


def whole_texts() -> dict[str, str]:
    """The license texts beside this file, by names that end in ``-text``."""
    return {f"{p.stem}-text": p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def strides(text: str) -> int:
    """How many strides a window must have to hold a template wherever it starts."""
    words = len(re.findall(WORD, text.lower()))
    return max(WINDOW // STRIDE, ceil((words - SHINGLE + 1) / STRIDE) + 1)


def anchors(shingles: list[str], percent: int = PERCENT, frequent: bool = False) -> set[str]:
    """Words without any of which a text holds too few of the shingles; long words come first, or
    words of six letters and more that many of the shingles have."""
    left, chosen = list(shingles), set()
    need = ceil(percent * len(shingles) / 100)
    counts = Counter(w for s in shingles for w in set(s.split()))
    for word in sorted(counts, key=lambda w: (len(w) < 6, -counts[w], w) if frequent else (-len(w), w)):
        if len(left) < need:
            break
        if any(word in s.split() for s in left):
            chosen.add(word)
            left = [s for s in left if word not in s.split()]
    return chosen


def by_shingles(shingles: list[str], percent: int = PERCENT) -> list[str]:
    """The shingles that retrieve a template exactly, none where bands do."""
    need = max(1, ceil(percent * len(shingles) / 100))
    similarity = need / (len(shingles) + WINDOW - SHINGLE + 1 - need)
    if (1 - similarity**ROWS) ** BANDS <= MISS:
        return []
    return shingles[: len(shingles) - need + 1]


def _hash(words: list[Column]) -> Column:
    return F.xxhash64(F.concat_ws(" ", *words))


def _bands(shingles: Column) -> Column:
    """Array of the band keys of a set of shingle hashes."""
    seeds = F.array([F.lit(k) for k in range(BANDS * ROWS)])
    minima = F.transform(seeds, lambda k: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, k))))

    def keys(m: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(F.slice(m, b * ROWS + 1, ROWS)).alias("key")))

    # bound to a variable, the minima are computed once a set
    return F.transform(F.array(minima), keys)[0]


def scan_licenses(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", templates: dict[str, str] | None = None, percent: int = PERCENT) -> DataFrame:
    """A row per row of ``docs`` and license found in it: id, ``license_id``, ``n_windows`` that hold
    it, ``first_word`` (where the first of them starts) and ``shingles_found`` of ``shingles_all``,
    at best.

    Words are runs of a-z and 0-9 after lower-casing. Null and empty texts hold none. Whole texts
    are read. Rows that repeat an id and a text give one row a license; a null id is an id like
    another. Other columns are ignored; an empty table gives an empty table.
    """
    given = templates or TEMPLATES
    long = {n: t for n, t in given.items() if strides(t) > WINDOW // STRIDE}
    short = {n: t for n, t in given.items() if n not in long}
    parts = [scan(docs, text_col, id_col, chosen, percent) for scan, chosen in ((_scan_short, short), (_scan_long, long)) if chosen]
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0]


def _shingled(docs: DataFrame, text_col: str, id_col: str, words_needed: list[str]) -> DataFrame:
    """(id, mark, pos, h): shingles of the texts that hold one of the words."""

    def mentioned(text: Column) -> Column:
        found = F.lit(False)
        for w in words_needed:
            found = found | F.contains(text, F.lit(w))
        return found

    t = F.col(text_col).cast("string")
    gated = docs.select(F.col(id_col).alias("id"), t.alias("t")).where(F.exists(F.array(F.lower("t")), mentioned))
    words = gated.select("id", F.xxhash64("t").alias("mark"), F.regexp_extract_all(F.lower("t"), F.lit(WORD), F.lit(0)).alias("w")).where(F.size("w") >= SHINGLE)
    parts = [F.slice("w", k + 1, F.size("w") - SHINGLE + 1) for k in range(SHINGLE)]
    hashed = words.select("id", "mark", F.posexplode(F.arrays_zip(*[p.alias(f"w{k}") for k, p in enumerate(parts)])).alias("pos", "s"))
    return hashed.select("id", "mark", "pos", _hash([F.col("s")[f"w{k}"] for k in range(SHINGLE)]).alias("h"))


def _scan_long(docs: DataFrame, text_col: str, id_col: str, templates: dict[str, str], percent: int) -> DataFrame:
    """Templates longer than ``WINDOW`` allows. Window w of a template starts at word w * STRIDE and
    has ``strides`` strides: a shingle lies in a range of windows, and the ranges of its repeats are
    cut so that each window counts it once."""
    known = template_shingles(templates)
    # as many rows as the templates have shingles, whatever the input
    rows = [(n, strides(templates[n]), len(own), s) for n, own in known.items() for s in own]
    posted = F.broadcast(docs.sparkSession.createDataFrame(rows, "license_id string, strides int, of int, shingle string").withColumn("h", F.xxhash64("shingle")).drop("shingle"))
    met = _shingled(docs, text_col, id_col, sorted({w for own in known.values() for w in anchors(own, percent, frequent=True)})).join(posted, "h")
    last = F.floor(F.col("pos") / STRIDE)
    earlier = F.lag("last").over(Window.partitionBy("id", "mark", "license_id", "h").orderBy("pos"))
    reach = met.withColumn("last", last).withColumn("first", F.greatest(F.ceil((F.col("pos") + SHINGLE) / STRIDE) - F.col("strides"), F.lit(0), F.coalesce(earlier + 1, F.lit(0)))).where("first <= last")
    steps = (
        reach.select("id", "mark", "license_id", "of", F.explode(F.array(F.struct(F.col("first").alias("window"), F.lit(1).alias("d")), F.struct((F.col("last") + 1).alias("window"), F.lit(-1).alias("d")))).alias("s"))
        .groupBy("id", "mark", "license_id", "of", "s.window")
        .agg(F.sum("s.d").alias("d"))
    )
    order = Window.partitionBy("id", "mark", "license_id").orderBy("window")
    held = steps.select("id", "mark", "license_id", "of", "window", F.sum("d").over(order).alias("n"), F.lead("window").over(order).alias("next")).where(100 * F.col("n") >= percent * F.col("of")).where("n > 0")
    return held.groupBy(F.col("id").alias(id_col), "mark", "license_id").agg(
        F.sum(F.col("next") - F.col("window")).alias("n_windows"),
        (F.min("window") * STRIDE).cast("long").alias("first_word"),
        F.max("n").cast("long").alias("shingles_found"),
        F.max("of").cast("long").alias("shingles_all"),
    ).drop("mark")


def _scan_short(docs: DataFrame, text_col: str, id_col: str, templates: dict[str, str], percent: int) -> DataFrame:
    spark = docs.sparkSession
    known = template_shingles(templates)
    # as many rows as the templates have shingles, whatever the input
    table = spark.createDataFrame([(n, s) for n, own in known.items() for s in own], "license_id string, shingle string").select("license_id", F.xxhash64("shingle").alias("h"))
    wanted = table.groupBy("license_id").agg(F.array_sort(F.collect_set("h")).alias("wanted"))
    universe = F.broadcast(table.select("h").distinct())
    exact = [(n, s) for n, own in known.items() for s in by_shingles(own, percent)]
    whole = wanted.join(spark.createDataFrame(exact, "license_id string, shingle string"), "license_id").select("license_id", "wanted", F.lit(-1).alias("band"), F.xxhash64("shingle").alias("key"))
    banded = wanted.where(~F.col("license_id").isin(sorted({n for n, _ in exact}))).select("license_id", "wanted", F.explode(_bands(F.col("wanted"))).alias("b"))
    posted = F.broadcast(banded.select("license_id", "wanted", "b.band", "b.key").union(whole))
    met = _shingled(docs, text_col, id_col, sorted({w for own in known.values() for w in anchors(own, percent)})).join(universe, "h")
    last = F.floor(F.col("pos") / STRIDE).cast("int")
    windows = (
        met.select("id", "mark", "pos", "h", F.explode(F.array(last, last - 1)).alias("window"))
        .where((F.col("window") >= 0) & (F.col("pos") + SHINGLE <= F.col("window") * STRIDE + WINDOW))
        .groupBy("id", "mark", "window")
        .agg(F.collect_set("h").alias("own"))
    )
    found = (
        windows.select("id", "mark", "window", "own", F.explode(F.concat(_bands(F.col("own")), F.transform("own", lambda h: F.struct(F.lit(-1).alias("band"), h.alias("key"))))).alias("b"))
        .select("id", "mark", "window", "own", "b.band", "b.key")
        .join(posted, ["band", "key"])
        .select("id", "mark", "window", "license_id", F.size(F.array_intersect("own", "wanted")).alias("n"), F.size("wanted").alias("of"))
        .where(100 * F.col("n") >= percent * F.col("of"))
    )
    return found.groupBy(F.col("id").alias(id_col), "mark", "license_id").agg(
        F.count_distinct("window").alias("n_windows"),
        (F.min("window") * STRIDE).cast("long").alias("first_word"),
        F.max("n").cast("long").alias("shingles_found"),
        F.max("of").cast("long").alias("shingles_all"),
    ).drop("mark")


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), templates=TEMPLATES | whole_texts())


def _values() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({quote(n)}, {quote(s)})" for n, own in template_shingles(TEMPLATES).items() for s in own)


#: Every window against every sentence of TEMPLATES, without signatures; whole texts are left to tests.
OP7_SQL = f"""
WITH template(license_id, shingle) AS (VALUES {_values()}),
total AS (SELECT license_id, count(*) AS n_of FROM template GROUP BY ALL),
word AS (SELECT doc_id, hash(text) AS mark, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents GROUP BY ALL),
spread AS (SELECT doc_id, mark, w, unnest(range(0, len(w) - {SHINGLE - 1})) AS pos FROM word),
shingled AS (SELECT doc_id, mark, pos, array_to_string(w[pos + 1:pos + {SHINGLE}], ' ') AS shingle FROM spread),
met AS (SELECT doc_id, mark, pos, license_id, shingle FROM shingled JOIN template USING (shingle)),
placed AS (SELECT *, unnest([pos // {STRIDE}, pos // {STRIDE} - 1]) AS win FROM met),
held AS (SELECT doc_id, mark, license_id, win, count(DISTINCT shingle) AS n FROM placed
         WHERE win >= 0 AND pos + {SHINGLE} <= win * {STRIDE} + {WINDOW} GROUP BY ALL)
SELECT doc_id, license_id, count(*) AS n_windows, min(win) * {STRIDE} AS first_word,
       max(n) AS shingles_found, any_value(n_of) AS shingles_all
FROM held JOIN total USING (license_id) WHERE 100 * n >= {PERCENT} * n_of GROUP BY doc_id, mark, license_id
"""
