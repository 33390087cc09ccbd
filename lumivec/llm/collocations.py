"""Phrase collocations by vertically partitioned, depth-truncated suffix trees.

Texts are cut into pieces and words; a word's name is 64 bits of the word and its
language, a phrase's 64 bits of its words' names. Phrases of 2 to DEPTH words
that occur LEAST times or more in a language are candidates.

1. Prefixes. A first pass counts phrases of one and two words, in map windows of
   WINDOW_WORDS words, packed as sorted arrays by buckets of names (as many as
   the input needs at BUCKET_BYTES of text each). Each bucket is added up in one
   task. Only prefixes with LEAST occurrences stay: no other begins a candidate
   or is part of one.
2. Vertical partitioning. Two-word prefixes are the roots of subtrees. Their
   occurrences are summed by ranges of names, and neighbouring ranges are grouped
   up to a budget of suffixes; a prefix beyond the budget by itself is extended
   by a word, so that its subtrees are dealt out too.
3. Subtrees. A second pass cuts out the suffix from every place that begins with
   such a prefix (tested against a bit table of bounded size, which may let more
   pass but none fewer), up to DEPTH words and as long as every two neighbours are
   one, adds equal ones up in its window and sends them to their group. In a
   group suffixes are sorted, which is the order of the leaves; a node is a run of
   leaves, and its count the sum of theirs.
4. Counts of all candidates are then joined by name: the parts of every cut, and
   for containment the largest count of a longer candidate around each phrase.
   Scores use decimals of 38 digits.

Defined results: null and empty texts have no words; a null language is `und`,
and counts together with texts of a language of that name; ties of score and
count go by the phrase's bytes; a language without a candidate has no rows;
repeated rows count again. Names are exact up to collisions of 64 bits. A text
is held whole, at about 100 bytes a word. A group's memory is its budget of
combined suffixes; only a three-word prefix is never split further (its
suffixes have been added up in windows before).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import _U, LOWER, cut, gram_hash, long_array, mix, release, slices, small_batches, span_hash, utf8, words

DEPTH = 4
LEAST = 30
TOP = 2000
SCALE = 2_000_000
CONTAINED = 80  # percent

WINDOW_WORDS = 2_000_000
BUCKET_BYTES = 4 << 20  # of text
GROUP_SUFFIXES = 500_000  # 36 bytes each
RANGE_BITS = 20  # at most so many ranges of prefix names are summed on the driver
TABLE_BITS = 27  # of the table of prefixes: 16 MB at most
SALTS = 16

_B = np.arange(256)
_PIECE = np.isin(_B, [ord(c) for c in ".,;:!?\n\x0b\x0c\r"])
_SEPARATOR = _PIECE | (_B == 32) | (_B == 9)


# ---------------------------------------------------------------- texts

def _language(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("und"))


def _word_names(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Names of all words; how many words each piece has from each word on (capped at DEPTH); each word's row; and the bytes and spans."""
    data, off = utf8(batch)
    starts, ends, first = words(data, off, _SEPARATOR)
    data = LOWER[data]
    row = np.repeat(np.arange(batch.num_rows), np.diff(first))
    lang, lang_off = utf8(batch, "lang")
    seeds = np.full(batch.num_rows, 1, _U)  # an empty language's
    some = lang_off[1:] > lang_off[:-1]
    seeds[some] = span_hash(lang, lang_off[:-1][some], lang_off[1:][some])
    h = mix(span_hash(data, starts, ends) ^ (seeds[row] * _U(0x9E3779B97F4A7C15))) if len(starts) else np.zeros(0, _U)
    ends_piece = np.ones(len(h), bool)
    if len(h) > 1:
        marks = np.concatenate(([0], np.cumsum(_PIECE[data])))
        ends_piece[:-1] = (row[1:] != row[:-1]) | (marks[starts[1:]] != marks[ends[:-1]])
    left = np.full(len(h), DEPTH, np.int8)
    reach = ends_piece.copy()
    for k in range(1, DEPTH):
        left[reach & (left == DEPTH)] = k
        reach = np.concatenate((reach[1:], [True]))[: len(h)]
    return h, left, row, (data, starts, ends)


def _grams(h: np.ndarray, left: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of all phrases of `size` words inside pieces, and their places."""
    if size == 1:
        return h, np.arange(len(h))
    g = gram_hash(h, size, seed=200 + size)
    at = np.flatnonzero(left[: len(g)] >= size)
    return g[at], at


def _summed(names: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different names, ascending, with the sums of times."""
    order = np.argsort(names)
    names, times = names[order], times[order]
    head = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))) if len(names) else np.zeros(0, np.int64)
    return names[head], np.add.reduceat(times, head) if len(head) else times


def _bytes(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Consecutive parts of an array as binary values."""
    raw = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer((edges * raw.itemsize).astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())


def _map_windows(docs: DataFrame, read, pack, schema: str) -> DataFrame:
    """pack(results) of windows of about WINDOW_WORDS words; read(slice of a batch) -> result, number of words."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch):
                got, n = read(part)
                held.append(got)
                size += n
                if size >= WINDOW_WORDS:
                    yield from pack(held)
                    held, size = [], 0
        if held:
            yield from pack(held)
        del held
        release()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


# ---------------------------------------------------------------- prefixes

_PACKED = "bucket int, size int, names binary, times binary, lang string, n long"


def _count_prefixes(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed counts of one- and two-word phrases by bucket of names, and words (n) by language."""

    def read(part):
        h, left, row, _ = _word_names(part)
        found = [_grams(h, left, size)[0] for size in (1, 2)]
        n = pa.table({"lang": part.column("lang"), "n": np.bincount(row, minlength=part.num_rows)})
        return (found, n.group_by("lang").aggregate([("n", "sum")])), len(h)

    def pack(held):
        for size in (1, 2):
            names = np.concatenate([found[size - 1] for found, _ in held])
            names, times = _summed(names, np.ones(len(names), np.int64))
            # buckets are ranges of names
            bucket = ((names >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int32)
            head = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(names) else np.zeros(0, np.int64)
            edges = np.append(head, len(names))
            for at in range(0, len(head), 512):
                some = edges[at : at + 513]
                k = len(some) - 1
                yield pa.RecordBatch.from_arrays([pa.array(bucket[some[:-1]]), pa.array(np.full(k, size, np.int32)), _bytes(names[some[0] : some[-1]], some - some[0]), _bytes(times[some[0] : some[-1]].astype(np.uint32), some - some[0]), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64())], names=_names(_PACKED))
        by_lang = pa.concat_tables([n for _, n in held]).group_by("lang").aggregate([("n_sum", "sum")])
        k = by_lang.num_rows
        yield pa.RecordBatch.from_arrays([*(pa.nulls(k, t) for t in (pa.int32(), pa.int32(), pa.binary(), pa.binary())), by_lang.column("lang").combine_chunks(), by_lang.column("n_sum_sum").combine_chunks().cast(pa.int64())], names=_names(_PACKED))

    return _map_windows(docs, read, pack, _PACKED)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _frequent(least: int):
    def run(table: pa.Table) -> pa.Table:
        out = {"size": [np.zeros(0, np.int32)], "name": [np.zeros(0, _U)], "f": [np.zeros(0, np.int64)]}
        sizes = table.column("size").to_numpy()
        for size in np.unique(sizes):
            part = table.filter(pa.array(sizes == size))
            read = lambda c, kind: np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in part.column(c)])  # noqa: B023, E731
            names, times = _summed(read("names", _U), read("times", np.uint32).astype(np.int64))
            keep = times >= least
            for c, v in (("size", np.full(int(keep.sum()), size, np.int32)), ("name", names[keep]), ("f", times[keep])):
                out[c].append(v)
        return pa.table({"size": np.concatenate(out["size"]), "name": long_array(np.concatenate(out["name"])), "f": np.concatenate(out["f"])})

    return run


def prefixes(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(size, name, f) of all phrases of one and two words that occur `least` times, and (lang, n)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = cut(_count_prefixes(docs, max(16, -(-size // BUCKET_BYTES))))
    found = rows.filter("bucket is not null").select("bucket", "size", "names", "times").groupBy("bucket").applyInArrow(_frequent(least), "size int, name long, f long")
    n = rows.filter("bucket is null").groupBy("lang").agg(F.sum("n").alias("n"))
    return cut(found), cut(n)


# ---------------------------------------------------------------- vertical partitioning

class _Groups:
    """Which group of subtrees a suffix goes to."""

    def __init__(self, bits: int, group_of_range: np.ndarray, split: np.ndarray):
        self.bits, self.group_of_range, self.split = bits, group_of_range, split
        self.groups = int(group_of_range.max()) + 1 if len(group_of_range) else 1

    def of(self, two: np.ndarray, three: np.ndarray) -> np.ndarray:
        """By the names of the first two and three words."""
        name = two
        if len(self.split):
            large = self.split[np.minimum(np.searchsorted(self.split, two), len(self.split) - 1)] == two
            name = np.where(large, three, two)
        return self.group_of_range[(name >> _U(64 - self.bits)).astype(np.int64)]


def _grouped(two: DataFrame, budget: int) -> _Groups:
    """Neighbouring ranges of prefix names together up to a budget of suffixes; prefixes beyond it are split."""
    total = two.agg(F.sum("f")).first()[0] or 0
    bits = min(RANGE_BITS, max(4, int(16 * total // budget).bit_length()))
    # at most total / budget of them
    split = np.sort(np.array([r["name"] for r in two.filter(F.col("f") > budget).select("name").collect()], np.int64).view(_U))
    spread = two.filter(F.col("f") > budget).agg(F.sum("f")).first()[0] or 0
    place = F.shiftrightunsigned("name", 64 - bits).cast("long")
    load = np.full(1 << bits, spread / (1 << bits))
    for r in two.filter(F.col("f") <= budget).groupBy(place.alias("r")).agg(F.sum("f").alias("f")).toLocalIterator():
        load[r["r"]] += r["f"]
    group = (np.cumsum(load) - load) // budget
    return _Groups(bits, np.unique(group, return_inverse=True)[1].astype(np.int32), split)


class _Table:
    """A bit table of names with two probes; it may hold more names than were put in."""

    def __init__(self, bits: int, cells: np.ndarray):
        self.bits, self.cells = bits, cells

    def holds(self, names: np.ndarray) -> np.ndarray:
        mask = _U((1 << self.bits) - 1)
        ok = np.ones(len(names), bool)
        for at in (names & mask, (names >> _U(32)) & mask):
            ok &= (self.cells[at >> _U(6)] >> (at & _U(63))) & _U(1) == 1
        return ok


def _bit_table(names: DataFrame) -> _Table:
    bits = min(TABLE_BITS, max(10, int(16 * names.count()).bit_length()))
    mask = (1 << bits) - 1
    at = F.explode(F.array(F.col("name").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("name", 32).bitwiseAND(F.lit(mask)))).alias("at")
    cells = names.select(at).groupBy(F.shiftright("at", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    found = cells.toArrow()  # at most 2^(TABLE_BITS - 6) rows
    table = np.zeros(1 << (bits - 6), _U)
    table[found.column("cell").to_numpy()] = found.column("bits").to_numpy().view(_U)
    return _Table(bits, table)


# ---------------------------------------------------------------- subtrees

_SUFFIXES = f"grp int, {', '.join(f'w{k} binary' for k in range(1, DEPTH + 1))}, times binary, word long, written string, lang string"


def _cut_suffixes(docs: DataFrame, table, groups) -> DataFrame:
    """Packed suffixes by group, and the words of frequent two-word phrases as written."""

    def read(part):
        h, left, row, (data, starts, ends) = _word_names(part)
        two, at = _grams(h, left, 2)
        begins = np.zeros(len(h) + DEPTH, bool)
        begins[at] = table.value.holds(two)
        # words behind the second: as long as every two neighbours are frequent
        depth = np.full(len(h), 2, np.int8)
        for k in range(1, DEPTH - 1):
            depth += (depth == k + 1) & begins[k : k + len(h)]
        place = np.flatnonzero(begins[: len(h)])
        rows = np.zeros((len(place), DEPTH), _U)
        for k in range(DEPTH):
            some = depth[place] > k
            rows[some, k] = h[place[some] + k]
        used = np.unique(np.concatenate((place, place + 1)))
        one = used[np.unique(h[used], return_index=True)[1]]
        written = pa.array([data[a:b].tobytes().decode() for a, b in zip(starts[one].tolist(), ends[one].tolist())], pa.string())
        return (rows, pa.table({"word": long_array(h[one]), "written": written, "lang": part.column("lang").take(pa.array(row[one]))})), len(h)

    def pack(held):
        rows = np.concatenate([r for r, _ in held])
        two, whole = gram_hash_rows(rows, 2), gram_hash_rows(rows, DEPTH)
        group = groups.value.of(two, gram_hash_rows(rows, 3))
        order = np.lexsort((whole, two, group))  # equal ones together; inside a group any order will do
        whole, group, rows = whole[order], group[order], rows[order]
        head = np.flatnonzero(np.concatenate(([True], (whole[1:] != whole[:-1]) | (group[1:] != group[:-1])))) if len(rows) else np.zeros(0, np.int64)
        times = np.diff(np.append(head, len(rows))).astype(np.uint32)
        rows, group = rows[head], group[head]
        edges = np.append(np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))), len(group)) if len(group) else np.zeros(1, np.int64)
        for at in range(0, len(edges) - 1, 64):
            some = edges[at : at + 65]
            a, z, k = some[0], some[-1], len(some) - 1
            packed = [_bytes(rows[a:z, i], some - a) for i in range(DEPTH)]
            yield pa.RecordBatch.from_arrays([pa.array(group[some[:-1]]), *packed, _bytes(times[a:z], some - a), pa.nulls(k, pa.int64()), pa.nulls(k, pa.string()), pa.nulls(k, pa.string())], names=_names(_SUFFIXES))
        known = pa.concat_tables([t for _, t in held]).group_by("word", use_threads=False).aggregate([("written", "min"), ("lang", "min")])
        for batch in known.combine_chunks().to_batches(max_chunksize=20_000):
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int32()), *[pa.nulls(k, pa.binary())] * (DEPTH + 1), *(batch.column(c) for c in ("word", "written_min", "lang_min"))], names=_names(_SUFFIXES))

    return _map_windows(docs, read, pack, _SUFFIXES)


def gram_hash_rows(rows: np.ndarray, size: int, start: int = 0) -> np.ndarray:
    """The names of `size` words from column `start` on, row by row; the same as in running text."""
    flat = np.ascontiguousarray(rows[:, start : start + size])
    if size == 1 or not len(flat):
        return flat[:, 0] if len(flat) else np.zeros(0, _U)
    return gram_hash(flat.ravel(), size, seed=200 + size)[::size]


_NODES = f"size int, f long, name long, {', '.join(f'w{k} long' for k in range(1, DEPTH + 1))}, parts array<struct<k:int,first:long,rest:long>>, inner array<long>"


def _lists(columns: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Row-wise lists of equally long columns."""
    n = len(columns[0])
    flat = np.stack(columns, 1).ravel() if columns else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(columns)), pa.array(flat, kind))


def _phrases(rows: np.ndarray, size: int, f: np.ndarray) -> pa.Table:
    """Nodes of one depth: name, words, the names of both parts of every cut, and of what of two words and more lies inside."""
    name = lambda start, length: gram_hash_rows(rows, length, start).view(np.int64)
    cuts = range(1, size)
    part = [pa.array(np.tile(np.array(list(cuts), np.int32), len(rows)))] + [
        pa.array(np.stack(x, 1).ravel()) for x in ([name(0, k) for k in cuts], [name(k, size - k) for k in cuts])
    ]
    parts = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * (size - 1)), pa.StructArray.from_arrays(part, ["k", "first", "rest"]))
    inside = [name(a, n) for n in range(2, size) for a in range(size - n + 1)]
    inner = _lists(inside, pa.int64()) if inside else pa.array([[]] * len(rows), pa.list_(pa.int64()))
    columns = {"size": np.full(len(rows), size, np.int32), "f": f, "name": name(0, size)} | {f"w{k}": rows[:, k - 1].view(np.int64) * (k <= size) for k in range(1, DEPTH + 1)}
    return pa.table(columns | {"parts": parts, "inner": inner})


def _subtrees(least: int, groups):
    """Nodes of two words and more of one group's subtrees, with their leaf totals."""

    def run(table: pa.Table) -> pa.Table:
        read = lambda c, kind: np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in table.column(c)])
        rows = np.stack([read(f"w{k}", _U) for k in range(1, DEPTH + 1)], 1)
        times = read("times", np.uint32).astype(np.int64)
        order = np.lexsort(rows.T[::-1])  # the leaves, from left to right
        rows, times = rows[order], times[order]
        new = np.ones(len(rows), bool)
        new[1:] = rows[1:, 0] != rows[:-1, 0]
        out = []
        for size in range(2, DEPTH + 1):
            new[1:] |= rows[1:, size - 1] != rows[:-1, size - 1]
            head = np.flatnonzero(new)
            total = np.add.reduceat(times, head)
            keep = total >= least
            if size == 2:  # split prefixes have leaves in several groups
                keep |= np.isin(gram_hash_rows(rows[head], 2), groups.value.split)
            keep &= rows[head, size - 1] > 0
            out.append(_phrases(rows[head[keep]], size, total[keep]))
        return pa.concat_tables(out)

    return run


# ---------------------------------------------------------------- phrases

def candidates(docs: DataFrame, least: int = LEAST, budget: int = GROUP_SUFFIXES) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Candidates (size, f, name, w1 .. w4, parts, inner), counts (name, f) of their parts, words (word, written, lang), and (lang, n)."""
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), _language(F.col("lang")).alias("lang"))
    short, n = prefixes(source, least)
    two = short.filter("size = 2").select("name", "f")
    table, groups = spark.sparkContext.broadcast(_bit_table(two)), spark.sparkContext.broadcast(_grouped(two, budget))
    rows = cut(_cut_suffixes(source, table, groups))
    known = rows.filter("word is not null").groupBy("word").agg(F.min("written").alias("written"), F.min("lang").alias("lang"))
    columns = ["grp", *(f"w{k}" for k in range(1, DEPTH + 1)), "times"]
    nodes = cut(rows.filter("grp is not null").select(*columns).groupBy("grp").applyInArrow(_subtrees(least, groups), _NODES))
    longer = nodes.filter("size > 2")
    # counts of two words are those of the first pass; a split prefix stands in several groups
    pairs = nodes.filter("size = 2").drop("f").dropDuplicates(["name"]).join(two, "name").select(longer.columns)
    counts = short.select("name", "f").unionByName(longer.filter(F.col("size") < DEPTH).select("name", "f"))
    return cut(pairs.unionByName(longer)), counts, cut(known), n


def scored(found: DataFrame, counts: DataFrame) -> DataFrame:
    """name, l, r, score, inside (the largest count of a longer candidate around it, or null) of every candidate."""
    each = found.select("name", F.col("f").alias("a"), F.explode("parts").alias("p")).select("name", "a", F.col("p.k").alias("k"), F.explode(F.array(F.struct(F.lit(True).alias("head"), F.col("p.first").alias("part")), F.struct(F.lit(False).alias("head"), F.col("p.rest").alias("part")))).alias("x"))
    met = each.select("name", "a", "k", "x.*").join(counts.select(F.col("name").alias("part"), "f"), "part")
    both = met.groupBy("name", "a", "k").agg(F.max(F.when(F.col("head"), F.col("f"))).alias("l"), F.max(F.when(~F.col("head"), F.col("f"))).alias("r"))
    value = F.expr(f"cast(cast(a as decimal(20,0)) * {SCALE} div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
    lowest = both.groupBy("name").agg(F.min(F.struct(value.alias("score"), "k", "l", "r")).alias("x")).select("name", "x.score", "x.l", "x.r")
    around = found.select(F.explode("inner").alias("name"), F.col("f").alias("longer")).groupBy("name").agg(F.max("longer").alias("inside"))
    return lowest.join(around, "name", "left")


def mine(docs: DataFrame, top: int = TOP, least: int = LEAST, budget: int = GROUP_SUFFIXES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language."""
    found, counts, known, n = candidates(docs, least, budget)
    marks = scored(found, counts)
    words = [f"w{k}" for k in range(1, DEPTH + 1)]
    kept = found.select("name", F.col("f").alias("a"), "size", *words).join(marks, "name")
    kept = kept.filter(F.col("inside").isNull() | (F.col("inside").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * CONTAINED))
    kept = kept.join(known.select(F.col("word").alias("w1"), "lang"), "w1")
    # ties go by the phrase as written, so all that tie with the last one go on; first inside salted shares of a language
    best = [F.desc("score"), F.desc("a")]
    share = Window.partitionBy("lang", F.pmod("name", F.lit(SALTS))).orderBy(*best)
    kept = kept.withColumn("rank", F.rank().over(share)).filter(F.col("rank") <= top)
    kept = cut(kept.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top))
    each = kept.select("name", F.posexplode(F.slice(F.array(*words), F.lit(1), F.col("size"))).alias("at", "word")).join(known.select("word", "written"), "word")
    phrase = each.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "written"))), lambda x: x["written"]), " ").alias("phrase"))
    last = Window.partitionBy("lang").orderBy(*best, "phrase")
    ranked = kept.drop("rank").join(phrase, "name").withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
