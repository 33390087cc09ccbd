"""Benchmark decontamination with suffix arrays over training shards.

A shard is a slice of documents. Its suffix array holds the word suffixes,
sorted as big-endian strings of word hashes. Only suffixes whose first words
also begin some benchmark suffix are sorted (SIEVE words, or a whole shorter
item): no other can match a window, so this sieve loses nothing. Every benchmark
suffix is binary-searched in every shard; the two ends of its range give all
places. Windows that follow each other both in a document and in an item are one
longer match; a shorter one shows when the shard's suffixes are searched among
the benchmark's sorted ones, as the words shared with either neighbour.

The benchmark goes out in blocks of about BLOCK_WORDS words. One block makes the
job map-only; of several, each is broadcast, searched, its findings are
checkpointed (rows with a match only) and released before the next is built, so
that what the driver, a broadcast or a worker holds doesn't grow with the
benchmark; findings are then joined to the documents.

Defined results: null, empty or separator-only texts have no words and are
clean; a benchmark item without words has no window; repeated document rows
are judged one by one; equal items both count. The longest match is a run of
words that stands as such in one item (longest_item, one of them); of equally
long ones the first in the document; 0 words without a match of SIEVE words or a
whole shorter item. A text is held whole, at about 60 bytes a word.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import KEYS, LOWER, NOT_ALNUM, covered, cut, gram_hash, id_text, long_array, map_arrow, row_key, runs, span_hash, utf8, words

WINDOW = 10
SIEVE = 3
BLOCK_WORDS = 1_000_000

_SPAN = "array<struct<start:int,length:int>>"
_FOUND = f"doc_id long, n_words long, hits {_SPAN}, items array<long>, longest_words int, longest_start int, longest_item long"


def _word_hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, off = utf8(batch)
    starts, ends, first = words(data, off, NOT_ALNUM)
    return span_hash(LOWER[data], starts, ends) | np.uint64(1), first  # never 0, which pads


def _suffix_rows(h: np.ndarray, at: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """The first `width` word hashes from each place up to its document's end, as byte strings that sort like the words."""
    out = np.zeros((len(at), width), ">u8")
    for i in range(width):
        ok = at + i < end
        out[ok, i] = h[at[ok] + i]
    return out.view(f"S{8 * width}").ravel()


class Tests:
    """The suffixes of one block of benchmark items, and the windows among them."""

    def __init__(self, items: pa.Table, window: int):
        batch = items.combine_chunks().to_batches()
        h, first = _word_hashes(batch[0]) if batch else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        self.item_ids = items.column("doc_id").to_pylist()
        self.window = window
        size = np.diff(first)
        item = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(h))
        end = first[item + 1] if len(h) else at
        self.words = np.minimum(end - at, window)  # of each suffix, as far as it is compared
        self.is_window = (self.words == window) | ((size[item] < window) & (at == first[item])) if len(h) else np.zeros(0, bool)
        self.item = item
        self.suffix = _suffix_rows(h, at, end, window)
        self.order = np.argsort(self.suffix, kind="stable")
        self.begin = {}  # by depth: how suffixes begin that can match
        for depth in range(1, SIEVE + 1):
            long_enough = size[item] >= depth if depth == SIEVE else size[item] == depth
            some = at[long_enough & (at + depth <= end)] if len(h) else at
            if len(some):
                self.begin[depth] = np.unique(gram_hash(h, depth)[some])


def _common_words(a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    x = np.frombuffer(a.tobytes(), ">u8").reshape(-1, window)
    y = np.frombuffer(b.tobytes(), ">u8").reshape(-1, window)
    same = (x == y) & (x != 0)
    return np.where(same.all(1), window, np.argmin(same, 1))


def _sieved(h: np.ndarray, t: Tests) -> np.ndarray:
    """Places where a suffix begins that may match; documents' ends are respected later, by padding."""
    may = np.zeros(len(h), bool)
    for depth, begin in t.begin.items():
        grams = gram_hash(h, depth)
        may[: len(grams)] |= begin[np.minimum(np.searchsorted(begin, grams), len(begin) - 1)] == grams
    return np.flatnonzero(may)


def _chains(place: np.ndarray, test: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """owner, first place, first test suffix and words of every maximal match, from all places of whole windows."""
    order = np.lexsort((place, place - test))
    place, test, owner = place[order], test[order], owner[order]
    head = np.ones(len(place), bool)
    head[1:] = (np.diff(place) != 1) | (np.diff(test) != 1) | (np.diff(owner) != 0)
    at = np.flatnonzero(head)
    return owner[at], place[at], test[at], np.diff(np.append(at, len(place))) + window - 1


def _search(batch: pa.RecordBatch, t: Tests) -> pa.RecordBatch:
    """One block against one shard."""
    h, first = _word_hashes(batch)
    n, window = batch.num_rows, t.window
    sieve = _sieved(h, t)
    doc = np.searchsorted(first, sieve, "right") - 1
    end = first[doc + 1]
    rows = _suffix_rows(h, sieve, end, window)
    order = np.argsort(rows, kind="stable")
    array, place, owner = rows[order], sieve[order], doc[order]

    hit = np.zeros(len(h), bool)
    pairs = np.zeros((0, 2), np.int64)
    best = np.zeros((3, n), np.int64)
    best[2] = -1
    if len(array) and len(t.suffix):
        low = np.searchsorted(array, t.suffix, "left")
        # the range ends before the first suffix that is larger in the compared words: pad with the largest words
        top = np.frombuffer(t.suffix.tobytes(), ">u8").reshape(-1, window).copy()
        for i in range(window):
            top[t.words <= i, i] = np.uint64(0xFFFFFFFFFFFFFFFF)
        high = np.searchsorted(array, top.astype(">u8").view(f"S{8 * window}").ravel(), "right")
        take = np.flatnonzero(t.is_window & (high > low))
        count = (high - low)[take]
        at = np.repeat(low[take], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        of = np.repeat(take, count)
        hit = covered(len(h), place[at], t.words[of])
        pairs = np.unique(np.stack([owner[at], t.item[of]], 1), axis=0)
        # longest matches: chains of whole windows; every place's neighbours among the test suffixes for what is shorter
        whole = t.words[of] == window
        found = [_chains(place[at][whole], of[whole], owner[at][whole], window)]
        at = np.searchsorted(t.suffix[t.order], array)
        near, test = np.tile(np.arange(len(array)), 2), np.concatenate((at - 1, at))
        ok = (test >= 0) & (test < len(t.suffix))
        near, test = near[ok], t.order[test[ok]]
        got = _common_words(array[near], t.suffix[test], window)
        some = (got < window) & (got >= SIEVE) | (got == t.words[test]) & t.is_window[test]
        found.append((owner[near[some]], place[near[some]], test[some], got[some]))
        whose, where, test, size = (np.concatenate(x) for x in zip(*found))
        rank = np.lexsort((test, where, -size, whose))
        d, at = np.unique(whose[rank], return_index=True)
        k = rank[at]
        best[:, d] = size[k], where[k] - first[d], t.item[test[k]]
    items = [set() for _ in range(n)]
    for r, i in pairs.tolist():
        items[r].add(t.item_ids[i])
    ids = [t.item_ids[i] if i >= 0 else None for i in best[2]]
    s, e, row = runs(hit, first)
    spans = [[] for _ in range(n)]
    for a, b, r in zip(s.tolist(), e.tolist(), row.tolist()):
        spans[r].append({"start": a - int(first[r]), "length": b - a})
    found = [long_array(np.diff(first)), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))), pa.array([list(x) for x in items], pa.list_(pa.int64())), pa.array(best[0], pa.int32()), pa.array(best[1], pa.int32()), pa.array(ids, pa.int64())]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *found], names=["doc_id", "n_words", "hits", "items", "longest_words", "longest_start", "longest_item"])


def _blocks(benchmark: DataFrame, block_words: int):
    """The benchmark in blocks of bounded size, each read from Spark one partition at a time."""
    rows, size = [], 0
    for r in benchmark.toLocalIterator():
        rows.append((r["doc_id"], r["text"]))
        size += len(r["text"] or "") // 2 + 1  # at least the number of words
        if size >= block_words:
            yield rows
            rows, size = [], 0
    yield rows


def _block_tests(items: DataFrame, block_words: int, window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    for rows in _blocks(items, block_words):
        yield Tests(pa.Table.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], schema=schema), window)


def _merged(spans: pd.Series) -> pd.Series:
    """Spans that several blocks found, as the maximal runs that they cover."""
    out = []
    for found in spans:
        start, length = (np.array([x[k] for x in found], np.int64) for k in ("start", "length"))
        n = int((start + length).max()) if len(start) else 0
        s, e, _ = runs(covered(n, start, length), np.array([0, n]))
        out.append([{"start": int(a), "length": int(z - a)} for a, z in zip(s, e)])
    return pd.Series(out)


def _by_blocks(docs: DataFrame, blocks) -> DataFrame:
    """KEYS, hits, items, longest of all rows with a match, the blocks one after another."""
    source = docs.select(*row_key(docs), "doc_id", F.col("text").cast("string").alias("text"))
    names = ["hits", "items", "longest_words", "longest_start", "longest_item"]
    parts = []
    for tests in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(tests)

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            found = _search(batch, shared.value)
            out = pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEYS), *(found.column(c) for c in names)], names=KEYS + names)
            return out.filter(pc.greater(found.column("longest_words"), 0))

        schema = f"k_id long, k_hash long, k_crc long, {_FOUND.split('n_words long, ')[1]}"
        parts.append(cut(map_arrow(source, run, schema)).withColumn("block", F.lit(len(parts))))
        shared.destroy()
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    longest = F.max(F.struct("longest_words", (-F.col("longest_start")).alias("start"), (-F.col("block")).alias("block"), "longest_item"))
    spans = F.pandas_udf(_merged, _SPAN)
    found = found.dropDuplicates([*KEYS, "block"]).groupBy(KEYS).agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), longest.alias("best"))
    return cut(found.select(*KEYS, spans("hits").alias("hits"), "items", F.col("best.longest_words").alias("longest_words"), (-F.col("best.start")).alias("longest_start"), F.col("best.longest_item").alias("longest_item")))


def _first_or_all(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, item_col: str):
    """The broadcast of the only block and None, or None and the findings of all blocks."""
    blocks = _block_tests(id_text(benchmark, item_col).filter("text is not null"), block_words, window)
    tests, more = next(blocks), next(blocks, None)
    if more is None:
        return docs.sparkSession.sparkContext.broadcast(tests), None
    return None, _by_blocks(docs, itertools.chain([tests, more], blocks))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, item_col: str = "item_id") -> DataFrame:
    """Per document row: doc_id, n_words, hits (spans of hit words), items (ids whose windows occur), and the longest match."""
    docs = id_text(docs)
    shared, found = _first_or_all(docs, benchmark, window, block_words, item_col)
    if found is None:
        return map_arrow(docs, lambda b: _search(b, shared.value), _FOUND)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in [*KEYS, "doc_id"]), long_array(np.diff(_word_hashes(batch)[1]))], names=[*KEYS, "doc_id", "n_words"])

    rows = map_arrow(docs.select(*row_key(docs), "doc_id", "text"), count, "k_id long, k_hash long, k_crc long, doc_id long, n_words long").join(found, KEYS, "left")
    none = {"hits": F.array().cast(_SPAN), "items": F.array().cast("array<long>"), "longest_words": F.lit(0), "longest_start": F.lit(0)}
    return rows.select("doc_id", "n_words", *(F.coalesce(c, none[c]).alias(c) for c in none), "longest_item")


def hit_words(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, s: n + s["length"])


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The digest of matches(): counts, the digest of item ids and the verdict."""
    m = matches(docs, benchmark, window)
    ids = F.array_sort(F.transform(F.col("items"), lambda i: i.cast("string")))
    return m.select(
        "doc_id", "n_words", hit_words(F.col("hits")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without any hit, with all their columns; one map-only pass over the texts if the benchmark is one block."""
    shared, found = _first_or_all(docs, benchmark, window, block_words, "item_id")
    if found is None:
        return map_arrow(docs, lambda b: b.filter(pa.array(_clean_mask(b, shared.value))), docs.schema)
    gone = found.filter(F.size("hits") > 0).select(KEYS)
    return docs.select(*row_key(docs), F.struct(*docs.columns).alias("row")).join(gone, KEYS, "left_anti").select("row.*")


def _clean_mask(batch: pa.RecordBatch, t: Tests) -> np.ndarray:
    found = _search(pa.RecordBatch.from_arrays([batch.column("text")] * 2, names=["doc_id", "text"]), t)
    return pc.equal(pc.list_value_length(found.column("hits")), 0).to_numpy(zero_copy_only=False)
