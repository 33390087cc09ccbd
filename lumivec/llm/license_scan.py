"""License scans by diagonal voting.

Templates are notices and phrases with a label. All rolling word k-grams of a
text are joined with the places where templates hold them; a pair of places
votes for its diagonal, the text's place less the template's. Votes are added up
by diagonal, diagonals within DRIFT words of each other (words left out or put
in) are merged, and what could be a notice is verified word by word.

1. One pass hashes the words and all their k-grams (GRAM words; all words of a
   shorter template). Of up to SIEVE_GRAMS different template grams, a k-gram that
   no template has is dropped before the join: it could not join. More templates
   than that have no sieve, the join is the same. Word hashes go along for texts
   that hold as many grams of notices as some notice needs.
2. Spark joins k-grams and template places and adds up votes for each text,
   template and diagonal, first inside the tasks.
3. A diagonal's band is all diagonals with votes within DRIFT of it; bands that
   have the most votes among their neighbours and enough for a notice are verified:
   a word of the template counts as found if one of the band's diagonals has
   votes and the text has the word there. From MATCH of the template's words on, its
   label is given, and that share is the span's score. Of notices that begin within
   SAME words of each other (licenses share sentences) that with most words found counts.
4. A phrase is a template that must stand as it is; its one gram is the whole of
   it, so each of its votes is a place.

Defined results: null and empty texts have no words and no label, score 0; a
text's score is that of its best span, 1 for a phrase; equal rows are judged
one by one; of several templates of one label the best counts. Hashes have 64
bits. A text is held whole, at about 30 bytes a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import LOWER, NOT_ALNUM, cut, gram_hash, id_text, long_array, map_arrow, row_starts, span_hash, utf8, words

GRAM = 4
DRIFT = 4
MATCH = 0.6
LEAST_VOTES = 0.25  # of a notice's grams
SAME = 16
SIEVE_GRAMS = 1_000_000  # 8 bytes each

# The phrases that always count, and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Notices of well-known licenses, as published, and their labels.
NOTICES = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so", "mit"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache"),
    ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "apache"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "lgpl"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mpl"),
    ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "unlicense"),
    ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so", "bsl"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa"),
]


def default_templates(spark: SparkSession) -> DataFrame:
    """text, label, phrase (boolean) of the fixed phrases and notices."""
    return spark.createDataFrame([(t, k, True) for t, k in PHRASES] + [(t, k, False) for t, k in NOTICES], "text string, label string, phrase boolean")


def _hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, off = utf8(batch)
    starts, ends, first = words(data, off, NOT_ALNUM)
    return span_hash(LOWER[data], starts, ends), first


def _grams(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place (among all words) and row of every gram of `size` words; grams of different sizes differ."""
    at, row = row_starts(first, size)
    return gram_hash(h, size, seed=100 + size)[at] if len(at) else np.zeros(0, np.uint64), at, row


_LISTS = pa.list_(pa.int64())


def _listed(values: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """Values (sorted by row) as one list a row."""
    off = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), long_array(values))


def _template_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Per template its words (hashes) and grams (in order of place)."""
    h, first = _hashes(batch)
    size = np.diff(first)
    phrase = batch.column("phrase").to_numpy(zero_copy_only=False).astype(bool)
    grams = []
    for a, n, whole in zip(first[:-1], size, phrase):
        k = int(n) if whole else min(GRAM, int(n))
        grams.append(gram_hash(h[a : a + n], k, seed=100 + k).view(np.int64).tolist() if n else [])
    sizes = [int(n) if whole else min(GRAM, int(n)) for n, whole in zip(size, phrase)]
    return pa.RecordBatch.from_pydict({"template": batch.column("doc_id"), "label": batch.column("label"), "phrase": batch.column("phrase"), "k": pa.array(sizes, pa.int64()), "words": _listed(h, np.repeat(np.arange(len(size)), size), len(size)), "grams": pa.array(grams, _LISTS)})


def _templates(templates: DataFrame) -> DataFrame:
    """template (a number by content), label, phrase, k, words, grams of every different template with a word."""
    rows = templates.select(F.coalesce("text", F.lit("")).alias("text"), "label", F.coalesce("phrase", F.lit(False)).alias("phrase")).distinct()
    rows = rows.withColumn("doc_id", F.xxhash64("text", "label", "phrase"))
    return cut(map_arrow(rows, _template_rows, "template long, label string, phrase boolean, k long, words array<long>, grams array<long>").filter("k > 0"))


class _Sieve:
    """The template grams, for each gram the places in notices and the least votes that a notice with it needs, and the sizes of grams."""

    def __init__(self, grams: np.ndarray, times: np.ndarray, least: np.ndarray, sizes: list[int]):
        order = np.argsort(grams)
        self.grams, self.times, self.least, self.sizes = grams[order], times[order], least[order], sizes


def _row_grams(batch: pa.RecordBatch, sieve: _Sieve) -> pa.RecordBatch:
    """Per text: n_words, places and hashes of grams to join, and all word hashes if a notice may be there."""
    h, first = _hashes(batch)
    n = batch.num_rows
    hashes, places, rows = [], [], []
    close = np.zeros(n, bool)
    for size in sieve.sizes:
        g, at, row = _grams(h, first, size)
        if len(sieve.grams):
            k = np.minimum(np.searchsorted(sieve.grams, g), len(sieve.grams) - 1)
            known = sieve.grams[k] == g
            g, at, row, k = g[known], at[known], row[known], k[known]
            close |= np.bincount(row, sieve.times[k], n) >= _least_by_row(row, sieve.least[k], n)
        else:
            close[row] = True
        hashes.append(g), places.append(at), rows.append(row)
    g, at, row = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, places, rows))
    order = np.argsort(row, kind="stable")
    g, at, row = g[order], at[order], row[order]
    held = np.repeat(close, np.diff(first))
    own = np.repeat(np.arange(n), np.diff(first))
    lists = [_listed(at - first[row], row, n), _listed(g, row, n), _listed(h[held], own[held], n)]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), long_array(np.diff(first)), *lists], names=["doc_id", "n_words", "places", "grams", "words"])


def _least_by_row(row: np.ndarray, least: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the least votes among a text's grams of notices; more than any text has without one."""
    out = np.full(n, 1 << 62)
    some = least > 0
    np.minimum.at(out, row[some], least[some])
    return out


def _votes_needed(grams):
    return F.greatest(F.lit(1), F.ceil(grams * F.lit(LEAST_VOTES) - F.lit(1e-9))).cast("long")


def votes(rows: DataFrame, places: DataFrame) -> DataFrame:
    """rid, template, label, phrase, k, diagonal, votes, first and last (places in the text) of all pairs of equal grams."""
    each = rows.select("rid", F.explode(F.arrays_zip("places", "grams")).alias("x")).select("rid", F.col("x.places").alias("at"), F.col("x.grams").alias("gram"))
    met = each.join(places, "gram")
    return met.groupBy("rid", "template", "label", "phrase", "k", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"), F.min("at").alias("first"), F.max("at").alias("last"))


def _verified(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The words of each template that a band's diagonals find in its text, and their share."""
    hits, size = [], []
    for text, own, band in zip(*(batch.column(c).to_pylist() for c in ("words", "template_words", "band"))):
        text, own = np.array(text, np.int64), np.array(own, np.int64)
        found = np.zeros(len(own), bool)
        for d in band:
            at = np.arange(len(own)) + d
            ok = (at >= 0) & (at < len(text))
            found[ok] |= text[at[ok]] == own[ok]
        hits.append(int(found.sum()))
        size.append(len(own))
    keep = [batch.column(c) for c in ("rid", "label", "first", "last")]
    hits = np.array(hits, np.int64)
    return pa.RecordBatch.from_arrays([*keep, pa.array(hits), pa.array(hits / np.array(size, np.float64))], names=["rid", "label", "first", "last", "found", "score"])


def _notices(rows: DataFrame, found: DataFrame, known: DataFrame) -> DataFrame:
    """rid, label, first, last, score of every verified notice: the words from first to last. known: see _templates()."""
    near = Window.partitionBy("rid", "template").orderBy("diagonal").rangeBetween(-DRIFT, DRIFT)
    band = found.withColumn("band", F.collect_list("diagonal").over(near)).withColumn("total", F.sum("votes").over(near))
    band = band.withColumn("from", F.min("first").over(near)).withColumn("to", F.max("last").over(near))
    best = F.max(F.struct("total", (-F.col("diagonal")).alias("d"))).over(near)
    peaks = band.withColumn("best", best).filter(F.col("best.d") == -F.col("diagonal"))
    told = known.select("template", F.col("words").alias("template_words"), _votes_needed(F.size("grams")).alias("needed"))
    peaks = peaks.join(told, "template").filter(F.col("total") >= F.col("needed"))
    texts = peaks.join(rows.select("rid", "words"), "rid")
    # only the words that the band can meet go on
    start = F.greatest(F.lit(0), F.array_min("band"))
    part = F.slice("words", (start + 1).cast("int"), (F.size("template_words") + 2 * DRIFT + 1).cast("int")).alias("words")
    texts = texts.select("rid", "label", F.col("from").alias("first"), (F.col("to") + F.col("k") - 1).alias("last"), F.transform("band", lambda d: d - start).alias("band"), "template_words", part)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                yield _verified(batch.slice(at, 64))

    checked = texts.mapInArrow(run, "rid long, label string, first long, last long, found long, score double")
    beside = Window.partitionBy("rid").orderBy("first").rangeBetween(-SAME, SAME)
    return checked.filter(F.col("score") >= MATCH).withColumn("best", F.max(F.struct("found", "score")).over(beside)).filter(F.struct("found", "score") == F.col("best")).drop("best", "found")


def scan(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, spans (array of label, phrase, first, last, score; words from 0) for every row."""
    spark = docs.sparkSession
    known = _templates(templates if templates is not None else default_templates(spark))
    grams = known.select("template", "label", "phrase", "k", F.size("grams").alias("n"), F.posexplode("grams").alias("place", "gram"))
    sizes = [r["k"] for r in known.select("k").distinct().collect()]  # one for each length of phrase, and up to GRAM
    notice = ~F.col("phrase")
    by_gram = grams.groupBy("gram").agg(F.min(F.when(notice, _votes_needed(F.col("n")))).alias("least"), F.sum(notice.cast("long")).alias("times"))
    few = by_gram.limit(SIEVE_GRAMS + 1).toArrow()
    if few.num_rows > SIEVE_GRAMS:
        few = few.slice(0, 0)
    bounded = F.broadcast if few.num_rows else lambda table: table
    sieve = spark.sparkContext.broadcast(_Sieve(few.column("gram").to_numpy().view(np.uint64), few.column("times").to_numpy(), few.column("least").fill_null(0).to_numpy(), sorted(sizes)))
    rows = map_arrow(id_text(docs), lambda b: _row_grams(b, sieve.value), "doc_id long, n_words long, places array<long>, grams array<long>, words array<long>")
    rows = cut(rows).withColumn("rid", F.monotonically_increasing_id())

    found = cut(votes(rows, bounded(grams.select("template", "label", "phrase", "k", "gram", "place"))))
    span = lambda phrase, score: F.struct("label", F.lit(phrase).alias("phrase"), "first", "last", score.alias("score"))
    stated = found.filter("phrase").select("rid", "label", "first", (F.col("first") + F.col("k") - 1).alias("last"))
    spans = stated.select("rid", span(True, F.lit(1.0)).alias("span"))
    noticed = _notices(rows, found.filter("not phrase"), bounded(known.filter("not phrase")))
    spans = spans.unionByName(noticed.select("rid", span(False, F.col("score")).alias("span")))
    lists = spans.groupBy("rid").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    kind = lists.schema["spans"].dataType
    return rows.select("rid", "doc_id", "n_words").join(lists, "rid", "left").select("doc_id", "n_words", F.coalesce("spans", F.array().cast(kind)).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns from scan() with the default templates."""
    found = scan(docs)
    base = F.filter("spans", lambda s: s["phrase"])
    first = F.transform(base, lambda s: s["first"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    best = F.array_max(F.transform("spans", lambda s: s["score"]))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), F.coalesce(best, F.lit(0.0)).alias("score"),
    )
