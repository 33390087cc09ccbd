"""Line deduplication over overlapping windows of consecutive lines.

Every window of WINDOW lines of a document is hashed (96 bits). A window that
occurs more than once in the corpus keeps its first occurrence, by doc_id and
then by place; each later occurrence is removed, that is all lines it covers.
Overlapping removals merge. Lines are what `\\n` separates, compared byte by byte.

Plan: one map pass hashes windows and notes repeats inside a document; the
windows go to the checkpoint folder; smallest and largest doc_id of every window
are aggregated with map-side combining, so a window that a third of all
documents share is a few rows by then; the repeated ones (a small table) are
joined back, which Spark broadcasts if small and otherwise splits where skewed;
removed windows are gathered by document, never more than a document's own lines.

Defined results: texts of fewer than WINDOW lines, null texts included, stay as
they are; windows without any character but white space are never removed; a
null doc_id sorts first; rows with the same doc_id count as one document, so what
they share with each other stays, unless it repeats inside a single text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import KEYS, SPACE, cut, gram_hash, map_arrow, row_key, row_starts, span_hash, utf8, words

WINDOW = 3
_B = np.arange(256)
NEWLINE = _B == 10


def _windows(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    data, off = utf8(batch)
    starts, ends, _ = words(data, off, NEWLINE)
    newline = np.flatnonzero(NEWLINE[data])
    count = np.diff(np.searchsorted(newline, off)) + 1
    first = np.concatenate(([0], np.cumsum(count)))
    begin = np.zeros(first[-1], np.int64)
    head = np.zeros(first[-1], bool)
    head[first[:-1]] = True
    begin[head], begin[~head] = off[:-1], newline + 1
    h = np.full(len(begin), 0x1234567, np.uint64)
    blank = np.ones(len(begin), bool)
    solid = np.concatenate(([0], np.cumsum(~SPACE[data])))
    # a line that has bytes begins where a run does; an empty line before it begins there never
    row = np.searchsorted(off, starts, "right") - 1
    line = first[row] + np.searchsorted(newline, starts) - np.searchsorted(newline, off[row])
    h[line] = span_hash(data, starts, ends)
    blank[line] = solid[ends] == solid[starts]
    at, doc = row_starts(first, window)
    empty = np.concatenate(([0], np.cumsum(~blank)))
    some = empty[at + window] > empty[at]
    at, doc = at[some], doc[some]
    key = gram_hash(h, window)[at] if len(at) else np.zeros(0, np.uint64)
    more = (gram_hash(h, window, seed=99)[at] >> np.uint64(33)).astype(np.int32) if len(at) else np.zeros(0, np.int32)
    order = np.lexsort((at, key, doc))
    same = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    take = pa.array(doc)
    return pa.RecordBatch.from_arrays(
        [*(batch.column(k).take(take) for k in KEYS), pa.array(key.view(np.int64)), pa.array(more), pa.array((at - first[doc]).astype(np.int32)), pa.array(again)],
        names=[*KEYS, "h", "g", "at", "again"],
    )


def removed_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """k_id, k_hash, k_crc, at: every occurrence of a window after its first."""
    source = docs.select(*row_key(docs), F.col("text").cast("string").alias("text")).filter(F.col("text").contains("\n"))
    rows = cut(map_arrow(source, lambda b: _windows(b, window), "k_id long, k_hash long, k_crc long, h long, g int, at int, again boolean"))
    once = rows.filter("not again")
    first = cut(once.groupBy("h", "g").agg(F.min("k_id").alias("first"), F.max("k_id").alias("last")).filter("first < last").select("h", "g", "first"))
    later = once.join(first, ["h", "g"]).filter("k_id > first")
    return later.select(*KEYS, "at").unionByName(rows.filter("again").select(*KEYS, "at"))


def _kept_runs(places: pd.Series, n_lines: pd.Series, window: pd.Series) -> pd.Series:
    """Runs of lines (from 1) that no removed window covers."""
    out = []
    for at, n, w in zip(places, n_lines, window):
        if at is None:  # nothing is removed
            out.append(None)
            continue
        gone = np.zeros(n + 2, bool)
        gone[[0, n + 1]] = True
        for k in range(w):
            gone[np.asarray(at) + 1 + k] = True
        edge = np.flatnonzero(gone[1:] != gone[:-1]) + 1
        out.append([{"start": int(a), "length": int(b - a)} for a, b in zip(edge[::2], edge[1::2])])
    return pd.Series(out)


def cut_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """row (all columns of docs, text replaced), n_lines and n_removed (of the text before) for every row."""
    gone = removed_windows(docs, window).groupBy(*KEYS).agg(F.collect_set("at").alias("places"))
    packed = docs.select(*row_key(docs), F.struct(*docs.columns).alias("row"))
    text = F.col("row")["text"]
    lines = F.split(text, "\n", -1)
    n_lines = F.when(F.length(text) > 0, F.size(lines)).otherwise(0).cast("long")
    kept_runs = F.pandas_udf(_kept_runs, "array<struct<start:int,length:int>>")
    runs = kept_runs("places", F.coalesce(F.size(lines), F.lit(0)), F.lit(window))
    packed = packed.join(gone, KEYS, "left").withColumn("runs", runs)
    kept = F.flatten(F.transform("runs", lambda r: F.slice(lines, r["start"], r["length"])))
    n_kept = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["length"])
    hit = F.col("runs").isNotNull()
    row = F.struct(*(F.when(hit, F.array_join(kept, "\n")).otherwise(text).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
    return packed.select(row.alias("row"), n_lines.alias("n_lines"), F.when(hit, n_lines - n_kept).otherwise(0).cast("long").alias("n_removed"))


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All rows and columns of docs with text replaced, and n_lines, n_removed; columns of these names in docs stay the user's."""
    taken = {c.lower() for c in docs.columns}
    return cut_lines(docs, window).select("row.*", *(c for c in ("n_removed", "n_lines") if c not in taken))


def report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_lines, n_removed and the digest of the text left, for every row."""
    return dedup_lines(docs.select("doc_id", "text"), window).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
