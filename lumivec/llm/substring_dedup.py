"""Removal of repeated byte strings by distributed prefix doubling.

Every byte that lies in a LENGTH-byte string that also starts anywhere else, in
the same or another document, is removed. Strings get names by doubling: the
name of 2k bytes is made of the names of its two halves (8, 16, 32, ... bytes;
a 64-bit hash of the pair stands for the pair's rank, since only equality of
ranks is used), and Spark sorts places by their names at growing lengths:

0. 32 bytes. Of the places in a LENGTH-byte window, the one with the smallest
   name stands for the window, so equal windows have equal anchors at equal
   offsets, and one row stands for all consecutive windows with one anchor.
   Anchors whose name is unique go: none of their windows can repeat.
1. Rows whose windows' union has an equal are past the threshold: all is
   covered. The others are cut into blocks of BLOCK offsets and sorted by the
   part that all windows of a block share; unique ones go, blocks whose union
   has an equal are covered.
2. What is left is sorted window by window; a window that occurs twice is
   covered.

At every step a row that is already covered stays as one representative where
rows of its group are still open, as windows may match it. Whole copies of a
document are covered at once, and one of them goes through the steps, so large
groups of copies cost one row each. Places return to their documents as lists
of spans, broadcast if there are few, else joined by shuffle.

Defined results: null and empty texts have no bytes; texts shorter than LENGTH
lose nothing; repeated rows are copies of each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import _U, KEYS, covered, cut, keys, long_array, map_arrow, mix, row_key, row_starts, runs, tidy, utf8

LENGTH = 200
SEED = 32  # bytes of an anchor
BLOCK = 12
BROADCAST_PLACES = 50_000  # 8 bytes each, and 24 for each document
_PAIR = keys(2, 77)
_KEYS = "k_id long, k_hash long, k_crc long"


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _PAIR[0] + b * _PAIR[1])


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place as a number (zeros behind the end)."""
    raw = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data),), "<u8", raw.tobytes(), strides=(1,))


def names(eights: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The names of `length` bytes (8 or more) from given places."""
    if length == 8:
        return mix(eights[at])
    half = 1 << ((length - 1).bit_length() - 1)
    return _pair(names(eights, at, half), names(eights, at + length - half, half))


def all_names(data: np.ndarray, length: int = SEED) -> np.ndarray:
    """The names of `length` (a power of two) bytes from every place that has so many."""
    h, n = mix(_eights(data))[: max(len(data) - 7, 0)], 8
    while n < length:
        h = _pair(h[:-n], h[n:]) if len(h) > n else h[:0]
        n *= 2
    return h


def _rows(batch: pa.RecordBatch, row: np.ndarray, **columns) -> pa.RecordBatch:
    take = pa.array(row)
    return pa.RecordBatch.from_pydict({k: batch.column(k).take(take) for k in KEYS} | {k: long_array(v) for k, v in columns.items()})


def _anchors(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """core (the anchor's name), whole (name of its windows' union) and the place: first window, last window, anchor."""
    data, off = utf8(batch)
    at, row = row_starts(off, LENGTH)
    if not len(at):
        return None
    h = all_names(data)
    # the smaller name, then the place; the upper half of a name decides, the same for every slice
    low = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=_U)
    span, width = 1, LENGTH - SEED + 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    anchor = (low[at] & _U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))))
    a, b, p, row = at[first], at[np.append(first[1:], len(at)) - 1], anchor[first], row[first]
    eights = _eights(data)
    whole = _pair(_pair(names(eights, a, LENGTH), names(eights, b, LENGTH)), (b - a).astype(_U))
    return _rows(batch, row, core=h[p], whole=whole, start=a - off[row], stop=b - off[row] + LENGTH, anchor=p - off[row])


def _blocks(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """Of the open places (anchor, first and last offset), every block of offsets: shared part, union (0 where it leaves the document)."""
    data, off = utf8(batch)
    place, row = _places(batch)
    if not len(place):
        return None
    p, lo, hi = place >> 16, place >> 8 & 255, place & 255
    count = hi // BLOCK - lo // BLOCK + 1
    row, p = np.repeat(row, count), np.repeat(p, count)
    j = np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo // BLOCK, count)
    size = off[row + 1] - off[row]
    late, early = p - j * BLOCK, p - j * BLOCK - BLOCK + 1  # the block's last and first window
    inside = (early >= 0) & (late + LENGTH <= size)
    part = (late >= 0) & (early + LENGTH <= size)  # the shared part lies in the document
    row, p, j, late, early, inside = row[part], p[part], j[part], late[part], early[part], inside[part]
    eights = _eights(data)
    core = _pair(names(eights, off[row] + late, LENGTH - BLOCK + 1), j.astype(_U))
    whole = np.zeros(len(core), _U)
    whole[inside] = names(eights, off[row][inside] + early[inside], LENGTH + BLOCK - 1) | _U(1)
    return _rows(batch, row, core=core, whole=whole, start=early, stop=late + LENGTH, anchor=p)


def _windows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """Every window of the open blocks, by name."""
    data, off = utf8(batch)
    place, row = _places(batch)
    if not len(place):
        return None
    x = np.repeat(place, BLOCK) + np.tile(np.arange(BLOCK), len(place))
    row = np.repeat(row, BLOCK)
    ok = (x >= 0) & (x + LENGTH <= off[row + 1] - off[row])
    x, row = x[ok], row[ok]
    _, one = np.unique(x + off[row], return_index=True)  # blocks of two anchors may overlap
    x, row = x[one], row[one]
    return _rows(batch, row, name=names(_eights(data), off[row] + x, LENGTH), start=x)


def _places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column("places")
    return lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))


def _sorted_out(rows: DataFrame) -> DataFrame:
    """Rows that have an equal core, with `done` (their whole has an equal) and `open` (goes on to the next length)."""
    core = Window.partitionBy("core")
    whole = Window.partitionBy("core", "whole")
    # by core first: rows dealt by core need no other exchange for (core, whole)
    found = rows.withColumn("n", F.count(F.lit(1)).over(core)).filter("n > 1")
    found = found.withColumn("same", F.when(F.col("whole") == 0, F.lit(1)).otherwise(F.count(F.lit(1)).over(whole)))
    found = found.withColumn("nth", F.when(F.col("whole") == 0, F.lit(1)).otherwise(F.row_number().over(whole.orderBy(*KEYS, "start"))))
    found = found.withColumn("least", F.min("same").over(core)).withColumn("kinds", F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).over(core))
    done, go = F.col("same") > 1, (F.col("least") == 1) & (F.col("kinds") > 1) & (F.col("nth") == 1)
    return found.filter(done | go).select(*KEYS, "start", "stop", "anchor", done.alias("done"), go.alias("open"))


def _with_places(source: DataFrame, rows: DataFrame, place) -> DataFrame:
    """The documents of rows, with their places as a list; the lists are broadcast if there are few."""
    rows = rows.select(*KEYS, place.alias("p"))
    n = rows.count()
    lists = rows.groupBy(*KEYS).agg(F.collect_set("p").alias("places"))
    return source.join(F.broadcast(lists) if n <= BROADCAST_PLACES else lists, KEYS)


def _merge(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = []
    for spans in batch.column("spans").to_pylist():
        merged: list[list[int]] = []
        for code in sorted(spans):
            start, end = code >> 32, (code >> 32) + (code & 0xFFFFFFFF)
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end])
        out.append([{"start": a, "stop": b} for a, b in merged])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEYS), pa.array(out, kind)], names=[*KEYS, "gone"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """k_id, k_hash, k_crc, gone: the maximal runs of removed bytes of every document that has some (whole copies: one run)."""
    source = docs.select(*row_key(docs), F.col("text").cast("string").alias("text")).filter(F.octet_length("text") >= LENGTH)
    same = ["h", "size"]
    known = cut(source.select(*KEYS, F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("size")))
    groups = known.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min("k_id").alias("first")).filter("n > 1")
    copies = cut(known.join(cut(groups), same))
    # by (id, checksum) the first of each group of copies goes through the steps
    others = copies.filter("k_id > first").select(*KEYS).distinct()
    n = others.count()
    single = source.join(F.broadcast(others) if n <= BROADCAST_PLACES else others, KEYS, "left_anti")

    fields = f"{_KEYS}, core long, whole long, start long, stop long, anchor long"
    zero = cut(_sorted_out(map_arrow(single, _anchors, fields)))
    tidy(docs.sparkSession)
    place = F.shiftleft("anchor", 16) + F.shiftleft(F.col("anchor") - (F.col("stop") - LENGTH), 8) + (F.col("anchor") - F.col("start"))
    one = cut(_sorted_out(map_arrow(_with_places(single, zero.filter("open"), place), _blocks, fields)))
    tidy(docs.sparkSession)
    two = map_arrow(_with_places(single, one.filter("open"), F.col("start")), _windows, f"{_KEYS}, name long, start long")
    two = two.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("name"))).filter("n > 1")

    code = lambda start, size: (F.shiftleft(start, 32) + size).alias("code")
    spans = two.select(*KEYS, code(F.col("start"), F.lit(LENGTH)))
    for rows in (zero, one):
        spans = spans.unionByName(rows.filter("done").select(*KEYS, code(F.col("start"), F.col("stop") - F.col("start"))))
    spans = spans.unionByName(copies.select(*KEYS, F.col("size").alias("code")))
    lists = spans.groupBy(*KEYS).agg(F.collect_set("code").alias("spans"))

    def merge(batches):
        yield from map(_merge, batches)

    found = cut(lists.mapInArrow(merge, f"{_KEYS}, gone array<struct<start:long,stop:long>>"))
    tidy(docs.sparkSession)
    return found


def _kept(batch: pa.RecordBatch, with_bytes: bool) -> pa.RecordBatch:
    """Counts, the digest of the bytes left, and if asked for these bytes, of every row."""
    data, off = utf8(batch)
    start, end, size = [], [], []
    for i, spans in enumerate(batch.column("gone").to_pylist()):
        for s in spans or ():
            start.append(s["start"] + off[i])
            size.append(s["stop"] - s["start"])
    gone = covered(len(data), np.array(start, np.int64), np.array(size, np.int64)) if start else np.zeros(len(data), bool)
    total = np.concatenate(([0], np.cumsum(gone)))
    _, _, row = runs(gone, off)
    left = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(off[:-1], off[1:])]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), long_array(np.diff(off)), long_array(total[off[1:]] - total[off[:-1]]), long_array(np.bincount(row, minlength=batch.num_rows)), pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())]
        + [pa.array(left, pa.binary())] * with_bytes,
        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_bytes,
    )


def remove_repeats(docs: DataFrame, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (binary: a cut may fall inside a character) for every row."""
    gone = repeated_spans(docs)
    n = gone.agg(F.coalesce(F.sum(F.size("gone") + 2), F.lit(0))).first()[0]
    source = docs.select(*row_key(docs), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = source.join(F.broadcast(gone) if n <= BROADCAST_PLACES else gone, KEYS, "left").select("doc_id", "text", "gone")
    return map_arrow(joined, lambda b: _kept(b, with_bytes), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes)


def report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, with_bytes=False)
