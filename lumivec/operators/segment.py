"""Vocabulary-driven segmentation of normalised text: greedy longest matches.

The vocabulary (at most MAX_SURFACES entries, else an error) goes to every task as
a trie in flat arrays; texts are segmented in Arrow batches without a shuffle,
many places of a slice walking the trie together, byte by byte. segment_by_joins() is the same as a relational plan, whose
vocabulary may have any size, for short texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans as sp
from ..sources.scratch import cut
from . import vocabulary as voc

MAX_SURFACES = 1 << 18
SLICE_BYTES = 1 << 21
STRIDE = 128
CHARACTER = np.select([np.arange(256) < 0xC0, np.arange(256) < 0xE0, np.arange(256) < 0xF0], [1, 2, 3], 4)  # bytes of one, by its first


def surfaces(vocabulary: DataFrame) -> DataFrame:
    """surface, token: what each entry looks like in normalised text.

    A q-gram stands for itself, a word for `~word~`; of clashing entries the
    word wins. `~e:` is added for specials outside the vocabulary when `~e:~` is
    a surface and `~e:` is not.
    """
    is_q = F.col("token").startswith("q:")
    t = vocabulary.select("token", F.when(is_q, F.expr("substring(token, 3)")).otherwise(F.concat(F.lit("~"), "token", F.lit("~"))).alias("surface"), is_q.alias("_q"))
    best = Window.partitionBy("surface").orderBy("_q", "token")
    t = t.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("surface", "token")
    special = t.filter(F.col("surface") == "~e:~").select(F.lit("~e:").alias("surface"), "token")
    return t.unionByName(special.join(t.filter(F.col("surface") == "~e:").select("surface"), "surface", "left_anti"))


class Trie:
    """Surfaces as a trie over UTF-8 bytes, in flat arrays: edges (node, byte) in an open hash table, and the surface that ends in a node."""

    def __init__(self, known: list[str]):
        raw = [k.encode() for k in known]
        size = np.array([len(b) for b in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        first = np.cumsum(size) - size
        node, nodes, keys = np.zeros(len(raw), np.int64), 1, []
        ends = [np.full(1, -1, np.int32)]
        alive = np.flatnonzero(size > 0)
        depth = 0
        while len(alive):
            key, at = np.unique((node[alive] << 8) | data[first[alive] + depth], return_inverse=True)
            keys.append(key)
            node[alive] = nodes + at
            done = alive[size[alive] == depth + 1]
            end = np.full(len(key), -1, np.int32)
            end[node[done] - nodes] = done
            ends.append(end)
            nodes += len(key)
            depth += 1
            alive = alive[size[alive] > depth]
        self.end = np.concatenate(ends)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.root = np.zeros(256, np.int32)
        top = keys < 256
        self.root[keys[top]] = np.flatnonzero(top) + 1
        self._place(keys[~top], np.flatnonzero(~top) + 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _place(self, keys: np.ndarray, children: np.ndarray) -> None:
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.child = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            _, one = np.unique(slot[free], return_index=True)
            some = free[one]
            self.keys[slot[some]], self.child[slot[some]] = keys[some], children[some]
            placed = np.zeros(len(keys), bool)
            placed[some] = True
            left = left[~placed[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The children of nodes below the root; 0 for none."""
        key = (node.astype(np.int64) << 8) | byte
        slot = self._slots(key)
        out = np.zeros(len(key), np.int32)
        held = self.keys[slot]
        hit = held == key
        out[hit] = self.child[slot[hit]]
        left = np.flatnonzero(~hit & (held >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[left]]
            hit = held == key[left]
            out[left[hit]] = self.child[slot[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out


def _walk(data: np.ndarray, start: np.ndarray, stop: np.ndarray, trie: Trie) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From every start, all one byte further together: how far the text is a prefix of some surface, where its longest surface ends, and which it is (-1: none)."""
    far, end, which = start.copy(), start.copy(), np.full(len(start), -1, np.int32)
    node = trie.root[data[start]]
    live = np.flatnonzero(node)
    node, at = node[live], start[live] + 1
    while len(live):
        far[live] = at
        found = trie.end[node]
        hit = found >= 0
        done = live[hit]
        end[done], which[done] = at[hit], found[hit]
        inside = at < stop[live]
        if not inside.all():
            live, node, at = live[inside], node[inside], at[inside]
        node = trie.step(node, data[at])
        some = node > 0
        live, node, at = live[some], node[some], at[some] + 1
    return far, end, which


def _jump(data: np.ndarray, start: np.ndarray, stop: np.ndarray, far: np.ndarray, end: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The next start after every start; the row's end where the segmentation ends.

    After a match the next start is its end, one earlier if it has two
    characters or more and ends in `~`, so that neighbours share that boundary.
    Without a match all characters walked over are skipped, by the same rule; if
    there were none, one is. A walk that reaches the end of the text gives its
    match and ends the segmentation.
    """
    to = np.where(which >= 0, end, far)
    shared = (to - start >= 2) & (data[to - 1] == ord("~"))
    out = np.where(to == start, start + CHARACTER[data[start]], to - shared)
    return np.where(far >= stop, stop, out)


def segments(data: np.ndarray, off: np.ndarray, trie: Trie) -> tuple[np.ndarray, np.ndarray]:
    """Which surface every segment is, and each row's offsets among the segments.

    Chains of jumps begin every STRIDE bytes and go on together until they meet
    a start that some chain has been at; those of a row fall into one soon. What
    is asked for is the chain from the row's beginning.
    """
    none = np.zeros(0, np.int32), np.zeros(len(off), np.int64)
    if not len(data):
        return none
    lead = (data & 0xC0) != 0x80
    begin = None if lead.all() else np.append(np.maximum.accumulate(np.where(lead, np.arange(len(data)), 0)), len(data))
    count = -(-np.diff(off) // STRIDE)
    row = np.repeat(np.arange(len(count)), count)
    at = off[row] + STRIDE * (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count))
    stop = off[row + 1]
    if begin is not None:
        at = begin[at]
    after, surface = np.zeros(len(data), np.int64), np.full(len(data), -1, np.int32)
    while True:
        new = at < stop
        new[new] = after[at[new]] == 0
        at, stop = at[new], stop[new]
        if not len(at):
            break
        far, end, which = _walk(data, at, stop, trie)
        if begin is not None:  # a walk that ends inside a character has not taken it
            far = begin[far]
        surface[at] = which
        after[at] = to = _jump(data, at, stop, far, end, which)
        at = to
    been = np.flatnonzero(after)
    place = np.searchsorted(been, after[been]).tolist()
    first = np.searchsorted(been, off).tolist()
    seen = []
    for k, z in zip(first[:-1], first[1:]):
        while k < z:
            seen.append(k)
            k = place[k]
    seen = been[np.array(seen, np.int64)]
    seen = seen[surface[seen] >= 0]
    return surface[seen], np.searchsorted(seen, off)


class Listed:
    """Surfaces that all are a word between two separators: segments are then the words of the text that are listed, without a walk."""

    def __init__(self, known: list[str]):
        raw = [k.encode() for k in known]
        self.words = pa.array([k[1:-1] for k in known], pa.string())
        self.size = np.zeros(max(map(len, raw), default=0) + 1, bool)
        self.size[[len(b) - 2 for b in raw]] = True
        self.ends = np.zeros(1 << 16, bool)  # first and last byte
        self.ends[[b[1] << 8 | b[-2] for b in raw]] = True

    @staticmethod
    def fits(known: list[str]) -> bool:
        return all(len(k) > 2 and k[0] == k[-1] == "~" and "~" not in k[1:-1] for k in known)

    def segments(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As segments()."""
        start, end, row = sp.words(data, off)
        size = end - start
        some = np.flatnonzero(self.size[np.minimum(size, len(self.size) - 1)])
        some = some[self.ends[data[start[some]].astype(np.int64) << 8 | data[end[some] - 1]]]
        found = pc.index_in(sp.gather(data, start[some], end[some], np.zeros(len(some), bool), b""), value_set=self.words)
        which = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int32)
        return which[which >= 0], np.searchsorted(row[some][which >= 0], np.arange(len(off)))


class _Known:
    """Surfaces and their tokens; a worker builds the trie, or the list, once for itself."""

    def __init__(self, surface: list[str], token: list[str]):
        self.surface, self.token, self.find = surface, token, None

    def parts(self, column: pa.Array, names: bool) -> Iterator[pa.Array]:
        """Slice by slice, so that a worker holds one slice's segments and not a batch's."""
        if self.find is None:
            if Listed.fits(self.surface):
                self.find = Listed(self.surface).segments
            else:
                trie = Trie(self.surface)
                self.find = lambda data, off: segments(data, off, trie)
            self.values = {False: pa.array(self.surface, pa.string()), True: pa.array(self.token, pa.string())}
        for part in sp.slices(column, SLICE_BYTES):
            which, first = self.find(*sp.utf8(part))
            yield pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), self.values[names].take(pa.array(which)))

    def segments(self, column: pa.Array, names: bool) -> pa.Array:
        out = list(self.parts(column, names))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))


def segmenter(table: DataFrame, names: bool = True):
    """A function from normalised text (Column) to tokens, for a surface table of at most MAX_SURFACES rows."""
    rows = table.limit(MAX_SURFACES + 1).collect()
    if len(rows) > MAX_SURFACES:
        raise ValueError(f"a vocabulary for segmentation has at most {MAX_SURFACES} entries: keep the most frequent (top_k)")
    shared = table.sparkSession.sparkContext.broadcast(_Known([r["surface"] for r in rows], [r["token"] for r in rows]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield from shared.value.parts(texts, names)

    # as deterministic, Spark would push a filter on the segments below them and find them twice
    return lambda norm: F.arrow_udf(run, "array<string>").asNondeterministic()(norm)


def segment(docs: DataFrame, norm: Column, vocabulary: DataFrame) -> DataFrame:
    """docs with tokens: the segments' vocabulary names."""
    return docs.withColumn("tokens", segmenter(surfaces(vocabulary))(norm))


def second_vocabulary(docs: DataFrame, norm: Column, first: DataFrame, k: int) -> DataFrame:
    """Recount on the segments that the first vocabulary gives; keep the k most frequent."""
    return voc.build_vocabulary(segment(docs, norm, first), F.col("tokens"), k)


def segment_by_joins(docs: DataFrame, norm: Column, vocabulary: DataFrame) -> DataFrame:
    """docs with tokens, as segment() gives them, without a broadcast: a row for each start and length of a text, so for short texts.

    Every substring is joined with the prefixes of surfaces. The longest prefix
    and the longest surface of each start then give its jump, and a fold over the
    starts keeps the matches on the chain of jumps.
    """
    s = cut(surfaces(vocabulary).withColumn("size", F.length("surface")))
    longest = s.agg(F.max("size")).first()[0] or 0
    each = s.select("token", "size", F.explode(F.transform(F.sequence(F.lit(1), "size"), lambda n: F.substring("surface", F.lit(1), n))).alias("part"))
    prefixes = each.groupBy("part").agg(F.max(F.when(F.length("part") == F.col("size"), F.col("token"))).alias("token"))
    rows = cut(docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(norm, F.lit("")).alias("_norm"))).withColumn("_id", F.monotonically_increasing_id())
    starts = rows.select("_id", "_norm", F.length("_norm").alias("_n")).filter("_n > 0").select("_id", "_n", F.explode(F.sequence(F.lit(1), "_n")).alias("s"), "_norm")
    lengths = F.sequence(F.lit(1), F.least(F.lit(max(longest, 1)), F.col("_n") - F.col("s") + 1))
    parts = starts.select("_id", "_n", "s", F.explode(F.transform(lengths, lambda k: F.substring("_norm", F.col("s"), k))).alias("part"))
    match = F.col("token").isNotNull()
    walked = parts.join(prefixes.withColumn("known", F.lit(1)), "part", "left").groupBy("_id", "_n", "s").agg(
        F.coalesce(F.max(F.when(F.col("known") == 1, F.struct(F.length("part").alias("n"), F.col("part").endswith("~").alias("tail")))), F.struct(F.lit(0).alias("n"), F.lit(False).alias("tail"))).alias("far"),
        F.max(F.when(match, F.struct(F.length("part").alias("n"), F.col("part").endswith("~").alias("tail"), "token"))).alias("end"),
    )
    size = F.coalesce("end.n", "far.n")
    shared = (size >= 2) & F.coalesce("end.tail", "far.tail")
    jump = F.when(F.col("s") + F.col("far.n") > F.col("_n"), F.col("_n") + 1).when(size == 0, F.col("s") + 1).otherwise(F.col("s") + size - shared.cast("int"))
    chain = walked.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("s", jump.alias("to"), F.col("end.token").alias("token")))).alias("starts"))
    state = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("tokens"))
    step = lambda a, x: F.when(a["at"] == x["s"], F.struct(x["to"].alias("at"), F.when(x["token"].isNull(), a["tokens"]).otherwise(F.concat(a["tokens"], F.array(x["token"]))).alias("tokens"))).otherwise(a)
    tokens = chain.select("_id", F.aggregate("starts", state, step)["tokens"].alias("_tokens"))
    return rows.join(tokens, "_id", "left").select("_row.*", F.coalesce("_tokens", F.array().cast("array<string>")).alias("tokens"))
