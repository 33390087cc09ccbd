"""Self-join of documents on the Jaccard similarity of their word shingles.

Two documents link when 100 * |A and B| >= 75 * |A or B|. The join is exact: no
cap on partners, candidates or groups.

1. One pass computes every document's set size and class (documents with equal
   sets), and counts shingles inside each map window; those that occur in
   several classes there are the frequent ones (at most FREQUENT of them are
   broadcast). They only shape the token orders; any order is right.
2. Order A: rising (logarithmic) frequency, then hash. Two linked sets share a
   shingle among the first p(n) = n - ceil(3n/4) + 1 of each, and one among the
   first n - ceil(6n/7) + 1 of the smaller. One document a class deals out its
   prefix by shingle; shingles that only one class has go. Infrequent prefix
   shingles that no other class has bound a pair too: a class with z of them
   overlaps any class whose prefix reaches the frequent ones by n - z at most.
3. Groups of up to SMALL classes form pairs. A pair goes on if it shares enough
   prefix shingles under order A and then under each of ORDERS other global
   orders (c shared ones bound the overlap by c plus what follows the
   prefixes). These filters are joined on prefixes of two bytes a shingle, and
   intersected before any whole set is moved.
4. Larger groups form no pairs of all. What a class with few prefix shingles in
   them (light) can link to has one of a few sizes: it meets one class of each, that
   with most such shingles, and later what all links so far leave unconnected
   (components are met before their members). The others are gathered by a centre, the class with the largest share of such
   shingles; a member meets the centre alone and keeps its difference to it,
   delta = (what it adds, what it lacks). Where members are not linked to that
   centre, the median takes its place: the member whose differences to all others
   have the least sum. It lies nearest to the text that they were copied from, so
   that deltas are short and share little. For two members, |x xor y| = |dx| +
   |dy| - 2 |dx and dy|, so a link between members of which one is not linked to
   the centre (`apart`) needs at least (7 (|dx| + |dy|) - n - m) / 14 > 0 common
   delta shingles. Pairs must share prefix shingles of their deltas under ORDERS +
   1 orders of the group (by rising frequency in it; the others additions first), all
   of them, and are
   verified on deltas. Members apart are often copies of another text, or of a
   part: those of equal marks (least hashes of deltas) meet one of them before, and
   what is connected is compared no more.
5. Whole sets of what is left of (3) are compared: first every class with the
   candidate that has most candidates; then the pairs that these links leave unconnected.
6. Links between classes give components by alternating stars (_graph).

Defined results: null and empty texts and texts without words have the empty set,
0 shingles, and are their own component; a text with fewer words than a shingle
has one shingle, all its words; rows that repeat a document are one class; a
null doc_id takes part in links, but is never a component's id unless no other
id is there (then the component's id is null). Texts are held whole in a task,
at about 30 bytes a word beside the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import KEYS, LOWER, SPACE, cut, gram_hash, long_array, map_arrow, mix, release, row_key, small_batches, slices, span_hash, tidy, utf8, words
from ._graph import components

SHINGLE = 5
SMALL = 32
LIGHT = 10  # a class with fewer than n / LIGHT prefix shingles in large groups is light
FREQUENT = 200_000
LOCAL_COUNT = 3  # classes of one map window that make a shingle frequent
LOCAL_TOKENS = 2_000_000
ORDERS = 2  # besides order A
MARKS = 8
SALTS = 64  # frequent shingles are dealt out over so many partitions
BROADCAST_ROWS = 1_000_000  # 16 bytes each
FACTORS = [1, *(int(k) for k in mix(np.arange(1, ORDERS + 1, dtype=np.uint64)) | np.uint64(1))]


def prefix_size(n):
    """Shingles of which a set of size n shares one with any linked set's prefix."""
    return n - (3 * n + 3) // 4 + 1


def short_size(n):
    """The same for the smaller set of a pair."""
    return n - (6 * n + 6) // 7 + 1


def shingle_sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every row."""
    data, off = utf8(batch)
    starts, ends, first = words(data, off, SPACE)
    h = span_hash(LOWER[data], starts, ends)
    grams = gram_hash(h, SHINGLE)
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
        if z - a >= SHINGLE:
            out.append(np.unique(grams[a : z - SHINGLE + 1]))
        else:
            out.append(mix(gram_hash(h[a:z], z - a) + np.uint64(z - a)) if z > a else grams[:0])
    return out


def set_class(s: np.ndarray) -> int:
    """A 64-bit name of a set; 0 for the empty one."""
    if not len(s):
        return 0
    name = mix(np.array([s.sum() + np.uint64(len(s)), np.bitwise_xor.reduce(mix(s))], np.uint64))
    return int((name[:1] ^ (name[1:] * np.uint64(3))).view(np.int64)[0]) or 1


def _profile(batches):
    """Per row its class; per map window the shingles of several documents."""
    schema = pa.schema([("k_id", pa.int64()), ("k_hash", pa.int64()), ("k_crc", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("token", pa.int64()), ("times", pa.int64())])
    held, size, seen = [], 0, set()

    def frequent():
        t, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        t, c = t[c >= LOCAL_COUNT], c[c >= LOCAL_COUNT]
        none = pa.nulls(len(t), pa.int64())
        return pa.RecordBatch.from_arrays([*[none] * (len(schema) - 2), long_array(t), long_array(c)], schema=schema)

    for batch in batches:
        for part in slices(batch):
            sets = shingle_sets(part)
            cls = [set_class(s) for s in sets]
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in KEYS), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.int64()), none, none], schema=schema)
            for c, s in zip(cls, sets):
                if c not in seen:
                    seen.add(c)
                    held.append(s)
                    size += len(s)
            if size >= LOCAL_TOKENS:
                yield frequent()
                held, size, seen = [], 0, set()
    if held:
        yield frequent()
        del held
    release()


def levels(s: np.ndarray, late: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How frequent each shingle of a set is: 0, or for the frequent ones the binary logarithm of their counts."""
    token, level = late
    if not len(token):
        return np.zeros(len(s), np.uint8)
    at = np.minimum(np.searchsorted(token, s), len(token) - 1)
    return np.where(token[at] == s, level[at], 0)


def ordered(s: np.ndarray, late: tuple[np.ndarray, np.ndarray], factor: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """A set in a global order, and its levels: rising frequency, and among equals the hash times an odd factor."""
    level = levels(s, late)
    order = np.lexsort((s * np.uint64(factor), level))
    return s[order], level[order]


def frequent_shingles(profile: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most counted shingles (at most FREQUENT of them) in ascending order, and their levels."""
    counted = profile.filter("cls is null").groupBy("token").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "token").limit(FREQUENT).collect()
    token = np.array([r["token"] for r in counted], np.int64).view(np.uint64)
    level = np.log2(np.array([r["times"] for r in counted], np.float64)).astype(np.uint8)
    order = np.argsort(token)
    return token[order], level[order]


def _picked(source: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """Rows whose key is, or is not, among the given ones (a checkpointed table); those are broadcast if few."""
    return source.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, on, how)


def _arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """fn(pa.RecordBatch) -> pa.RecordBatch over tables without texts."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)
        release()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def _sets(batch: pa.RecordBatch, name: str, kind=np.uint64) -> list[np.ndarray]:
    return [np.frombuffer(v, kind) for v in batch.column(name).to_pylist()]


def _packed(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([v.tobytes() for v in arrays], pa.binary())


def _common(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def _pair(x: str = "cls1", y: str = "cls2") -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _both(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b) with columns of table (by cls) for both: named c1 and c2."""
    for k, v in (("1", "a"), ("2", "b")):
        pairs = pairs.join(table.select(F.col("cls").alias(v), *(F.col(c).alias(c + k) for c in columns)), v)
    return pairs


def _prefix_rows(apart: DataFrame, late) -> tuple[DataFrame, DataFrame]:
    """Prefix shingles under order A that several classes have: cold (infrequent) and hot rows.

    token, cls, n, short, most, df, centre. short: the shingle is among those of
    the smaller set of a pair; most: the largest size that a class can link to
    through a frequent shingle; centre: the class that gathers a large group.
    """

    def prefixes(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens, cls, packed = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s in shingle_sets(batch):
            if len(s):
                head, level = (x[: prefix_size(len(s))] for x in ordered(s, late.value))
                hot = (level > 0).astype(np.int64)
                tokens.append(head)
                cls.append(np.full(len(head), set_class(s)))
                short = (np.arange(len(head)) < short_size(len(s))).astype(np.int64)
                packed.append(hot + 2 * short + 4 * (len(hot) - hot.sum()) + (len(s) << 32))
        return pa.RecordBatch.from_pydict({"token": long_array(np.concatenate(tokens)), "cls": np.concatenate(cls), "packed": np.concatenate(packed)})

    hot = F.col("packed") % 2 == 1
    # frequent shingles need no count here, so that none is one task's work
    salt = F.when(hot, F.pmod("cls", F.lit(SALTS))).otherwise(0)
    same = Window.partitionBy("token", "salt")
    held = map_arrow(apart, prefixes, "token long, cls long, packed long").withColumn("salt", salt)
    held = held.withColumn("df", F.count(F.lit(1)).over(same)).withColumn("centre", F.min("cls").over(same)).filter(hot | (F.col("df") > 1))
    # own: infrequent shingles in the prefix; n: the set's size
    held = cut(held.select("token", "cls", F.shiftright("packed", 32).alias("n"), (F.shiftright("packed", 1) % 2 == 1).alias("short"), hot.alias("hot"), (F.shiftright("packed", 2) % (1 << 30)).alias("own"), "df", "centre"))
    cold = held.filter("not hot")
    met = cold.groupBy("cls").agg(F.count(F.lit(1)).alias("met"))
    rows = held.filter("hot").join(met, "cls", "left").withColumn("z", F.col("own") - F.coalesce("met", F.lit(0)))
    rows = rows.withColumn("most", F.floor((F.col("n") - F.col("z")) * 7 / F.lit(3.0) + F.lit(1e-9)).cast("long") - F.col("n"))
    rows = cut(rows.filter(F.col("most") * 4 >= F.col("n") * 3).select("token", "cls", "n", "short", "most", (F.col("z") / F.col("n")).alias("share")))
    of_token = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min(F.struct("share", "cls"))["cls"].alias("centre")).filter("df > 1")
    columns = ["token", "cls", "n", "short", "most", "df", "centre"]
    return cold.withColumn("most", F.col("n") * 2).select(*columns), cut(rows.join(of_token, "token").select(*columns))


def _need(n1: Column, n2: Column) -> Column:
    """Prefix shingles that two linked sets of these sizes have in common at least."""
    return F.ceil((n1 + n2) * 3 / F.lit(7.0) - F.lit(1e-9)) - F.ceil(F.greatest(n1, n2) * 3 / F.lit(4.0)) + 1


def _small_pairs(held: DataFrame, in_large: DataFrame) -> DataFrame:
    """(a, b) from groups of up to SMALL classes that may share enough prefix shingles under order A.

    c shared ones of small groups, and as many of large ones as either has, bound what they share.
    """
    few = held.filter(F.col("df") <= SMALL)
    side = lambda k: few.select("token", *(F.col(c).alias(f"{c}{k}") for c in ("cls", "n", "most", "short")))
    first_smaller = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("cls1") < F.col("cls2")))
    fits = (F.col("n1") * 4 >= F.col("n2") * 3) & (F.col("n2") <= F.col("most1")) & (F.col("n1") <= F.col("most2"))
    shared = side(1).join(side(2).drop("short2"), "token").filter(first_smaller & fits)
    shared = shared.groupBy("cls1", "cls2", "n1", "n2").agg(F.count(F.lit(1)).alias("c"), F.max("short1").alias("near"))
    for k in (1, 2):
        shared = shared.join(in_large.select(F.col("cls").alias(f"cls{k}"), F.col("m").alias(f"m{k}")), f"cls{k}", "left")
    large = F.least(F.coalesce("m1", F.lit(0)), F.coalesce("m2", F.lit(0)))
    return shared.filter((F.col("near") | (large > 0)) & (F.col("c") + large >= _need(F.col("n1"), F.col("n2")))).select(*_pair())


def _light_sizes(large: DataFrame) -> DataFrame:
    """(centre, cls1, n1, m1, n2): the sizes of what a class can link to that has few shingles of large groups (m) for its size.

    What they share under order A lies in large groups alone here (else small
    groups have the pair), so m is at least _need(): the partner's size is within
    about 3 m of the most or the least that can link.
    """
    room = F.col("m") * 28 / F.lit(9.0) + 4
    above = F.sequence(F.floor(F.col("n") * 4 / F.lit(3.0) - room), F.floor(F.col("n") * 4 / F.lit(3.0)))
    below = F.sequence(F.floor(F.col("n") * 3 / F.lit(4.0)), F.floor((F.col("n") + room) * 3 / F.lit(4.0)))
    sizes = F.explode(F.array_distinct(F.concat(above, below))).alias("n2")
    light = large.filter(F.col("m") * LIGHT < F.col("n")).select("centre", F.col("cls").alias("cls1"), F.col("n").alias("n1"), F.col("m").alias("m1"), sizes)
    known = large.select("centre", F.col("n").alias("n2")).distinct()
    fits = (F.col("n1") * 4 >= F.col("n2") * 3) & (F.col("n2") * 4 >= F.col("n1") * 3)
    return light.join(known, ["centre", "n2"]).filter(fits)


def _met(sizes: DataFrame, partners: DataFrame) -> DataFrame:
    """(a, b): classes (centre, cls1, n1, m1, n2, ..) with partners of the group (centre, n2, cls2, m2, ..) that may share enough."""
    both = ["centre", "n2", *(["top2"] if "top2" in partners.columns else [])]
    fits = (F.col("cls1") != F.col("cls2")) & (_need(F.col("n1"), F.col("n2")) <= F.least("m1", "m2"))
    return sizes.join(partners, both).filter(fits).select(*_pair())


def _light_first(sizes: DataFrame, large: DataFrame) -> DataFrame:
    """(a, b): every light class with one class of each fitting size: that with most shingles of large groups."""
    best = large.groupBy("centre", F.col("n").alias("n2")).agg(F.max(F.struct(F.col("m").alias("m2"), F.col("cls").alias("cls2"))).alias("x")).select("centre", "n2", "x.*")
    return _met(sizes, best)


def _light_rest(sizes: DataFrame, large: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b): light classes with all of fitting sizes that links don't connect to them already.

    A class meets the components of a size first, one row each, so that what is
    connected costs no row for each pair.
    """
    root = components(links).select(F.col("v").alias("cls"), "root")
    top = lambda df, cls, name: df.join(root.withColumnRenamed("cls", cls), cls, "left").withColumn(name, F.coalesce("root", cls)).drop("root")
    sizes = top(sizes, "cls1", "top1")
    partners = cut(top(large.select("centre", F.col("cls").alias("cls2"), F.col("n").alias("n2"), F.col("m").alias("m2")), "cls2", "top2"))
    apart = sizes.join(partners.groupBy("centre", "n2", "top2").agg(F.max("m2").alias("most")), ["centre", "n2"])
    apart = apart.filter((F.col("top1") != F.col("top2")) & (_need(F.col("n1"), F.col("n2")) <= F.least("m1", "most"))).drop("top1", "most")
    return _met(cut(apart), partners)


def _class_sets(source: DataFrame, one: DataFrame, classes: DataFrame, late) -> DataFrame:
    """cls, n, s (the whole set) and head1 .. (prefixes under the other orders, two bytes a shingle) of the given classes."""
    wanted = cut(classes.join(one, "cls").select(*KEYS).distinct())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch)
        out = {"cls": pa.array([set_class(s) for s in sets], pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()), "s": _packed(sets)}
        for k, factor in enumerate(FACTORS[1:], 1):
            out[f"head{k}"] = _packed([np.unique((ordered(s, late.value, factor)[0][: prefix_size(len(s))] >> np.uint64(48)).astype(np.uint16)) for s in sets])
        return pa.RecordBatch.from_pydict(out)

    heads = "".join(f", head{k} binary" for k in range(1, ORDERS + 1))
    return cut(map_arrow(_picked(source, wanted, KEYS, "left_semi"), run, "cls long, n long, s binary" + heads))


def _filtered(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs that share enough prefix shingles under every further order.

    Two bytes can make different shingles one: as many as a set lost that way
    count as shared, so that no pair is dropped wrongly.
    """
    names = [f"head{k}" for k in range(1, ORDERS + 1)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n1, n2 = (batch.column(c).to_numpy() for c in ("n1", "n2"))
        p1, p2 = prefix_size(n1), prefix_size(n2)
        need = np.maximum(1, -(-3 * (n1 + n2) // 7) - np.maximum(n1 - p1, n2 - p2))
        ok = np.ones(len(n1), bool)
        for name in names:
            x, y = _sets(batch, f"{name}1", np.uint16), _sets(batch, f"{name}2", np.uint16)
            for i in np.flatnonzero(ok).tolist():
                ok[i] = _common(x[i], y[i]) + min(p1[i] - len(x[i]), p2[i] - len(y[i])) >= need[i]
        return batch.select(["a", "b"]).filter(pa.array(ok))

    return cut(_arrow(_both(pairs, sets, "n", *names).select("a", "b", "n1", "n2", *(n + k for n in names for k in "12")), run, "a long, b long"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a checkpointed table) those whose whole sets link."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = []
        for x, y in zip(_sets(batch, "s1"), _sets(batch, "s2")):
            both = _common(x, y)
            ok.append(100 * both >= 75 * (len(x) + len(y) - both))
        return batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    classes = cut(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct())
    return cut(_arrow(_both(pairs, _picked(sets.select("cls", "s"), classes, ["cls"], "left_semi"), "s").select("a", "b", "s1", "s2"), run, "a long, b long"))


def _delta_order(adds: np.ndarray, lacks: np.ndarray, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """A difference in a global order of its group, additions (which are rare) first, and each shingle's place in it."""
    token = np.concatenate((adds, lacks))
    order = np.lexsort((token * np.uint64(factor), np.repeat([False, True], (len(adds), len(lacks)))))
    place = np.empty(len(token), np.int64)
    place[order] = np.arange(len(token))
    return token[order], place


DELTAS = "centre long, cls long, n long, m long, d long, apart boolean, adds binary, lacks binary, marks array<long>" + "".join(f", head{k} binary" for k in range(1, ORDERS + 1))
MARK_FACTORS = mix(np.arange(1, MARKS + 1, dtype=np.uint64) << np.uint64(20)) | np.uint64(1)


def _delta_rows(batch: pa.RecordBatch, n: np.ndarray, m: np.ndarray, adds: list[np.ndarray], lacks: list[np.ndarray]) -> pa.RecordBatch:
    """centre and cls of the batch, n, m (the centre's size), d (size of the difference), apart, adds, lacks, marks.

    marks: the first shingle of the difference under each of MARKS orders of
    hashes; head1 ..: the difference in the order of every further factor, what it
    adds first, two bytes a shingle.
    """
    d = np.array([len(x) + len(y) for x, y in zip(adds, lacks)], np.int64)
    heads = {f"head{k}": _packed([(_delta_order(x, y, factor)[0] >> np.uint64(48)).astype(np.uint16) for x, y in zip(adds, lacks)]) for k, factor in enumerate(FACTORS) if k}
    marks = [[int((np.concatenate(both) * np.uint64(k)).min().view(np.int64)) for k in MARK_FACTORS] if len(both[0]) + len(both[1]) else [] for both in zip(adds, lacks)]
    return pa.RecordBatch.from_pydict({"centre": batch.column("centre"), "cls": batch.column("cls"), "n": n, "m": m, "d": d, "apart": 7 * d > n + m, "adds": _packed(adds), "lacks": _packed(lacks), "marks": pa.array(marks, pa.list_(pa.int64()))} | heads)


def _deltas(members: DataFrame, sets: DataFrame) -> DataFrame:
    """DELTAS for every member but the centre."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        adds, lacks, n, m = [], [], [], []
        for x, c in zip(_sets(batch, "s"), _sets(batch, "sc")):
            adds.append(np.setdiff1d(x, c, assume_unique=True))
            lacks.append(np.setdiff1d(c, x, assume_unique=True))
            n.append(len(x))
            m.append(len(c))
        return _delta_rows(batch, np.array(n, np.int64), np.array(m, np.int64), adds, lacks)

    few = lambda name, as_: _picked(sets.select(F.col("cls").alias(name), F.col("s").alias(as_)), cut(members.select(name).distinct()), [name], "left_semi")
    rows = members.filter("cls <> centre").join(few("cls", "s"), "cls").join(few("centre", "sc"), "centre").select("centre", "cls", "s", "sc")
    return cut(_arrow(rows, run, DELTAS))


def _delta_shingles(deltas: DataFrame) -> DataFrame:
    """centre, cls, token, f: every shingle of a difference, and of how many differences in its group it is one."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = [np.concatenate(x) for x in zip(_sets(batch, "adds"), _sets(batch, "lacks"))]
        size = [len(x) for x in both]
        return pa.RecordBatch.from_pydict({k: np.repeat(batch.column(k).to_numpy(), size) for k in ("centre", "cls")} | {"token": long_array(np.concatenate(both))})

    rows = cut(_arrow(deltas.select("centre", "cls", "adds", "lacks"), run, "centre long, cls long, token long"))
    often = cut(rows.groupBy("centre", "token").agg(F.count(F.lit(1)).alias("f")).filter("f > 1"))
    rows = rows.join(F.broadcast(often) if often.count() <= BROADCAST_ROWS else often, ["centre", "token"], "left")
    return rows.withColumn("f", F.coalesce("f", F.lit(1)))


def _from_median(deltas: DataFrame) -> DataFrame:
    """DELTAS of the members of every group to its median, those of the former centre left out.

    The sum of a member's differences to all is, but for a constant, the sum over
    its delta of N - 2 f: N members, of whose deltas f have the shingle; 0 for the
    centre. One row a shingle of a delta, whatever the group's size.
    """

    more = _delta_shingles(deltas).filter("f > 1").groupBy("centre", "cls").agg(F.sum(F.col("f") - 1).alias("more"))
    members = deltas.groupBy("centre").agg((F.count(F.lit(1)) + 1).alias("members"), F.first("m").alias("m"))
    of_all = deltas.select("centre", "cls", "d").join(more, ["centre", "cls"], "left").join(members, "centre")
    of_all = of_all.withColumn("sum", F.col("d") * (F.col("members") - 2) - 2 * F.coalesce("more", F.lit(0)))
    best = of_all.groupBy("centre").agg(F.min(F.struct("sum", "cls")).alias("x")).select("centre", F.when(F.col("x.sum") < 0, F.col("x.cls")).otherwise(F.col("centre")).alias("median"))
    at = deltas.select("centre", F.col("cls").alias("median"), F.col("n").alias("nc"), F.col("adds").alias("more_c"), F.col("lacks").alias("less_c"))
    best = cut(best.join(members, "centre").join(at, ["centre", "median"], "left").select("centre", "median", F.coalesce("nc", "m").alias("nc"), *(F.coalesce(c, F.lit(b"")).alias(c) for c in ("more_c", "less_c"))))

    def moved(batch: pa.RecordBatch) -> pa.RecordBatch:
        adds, lacks = [], []
        for more, less, more_c, less_c in zip(*(_sets(batch, c) for c in ("adds", "lacks", "more_c", "less_c"))):
            adds.append(np.concatenate((np.setdiff1d(more, more_c, assume_unique=True), np.setdiff1d(less_c, less, assume_unique=True))))
            lacks.append(np.concatenate((np.setdiff1d(less, less_c, assume_unique=True), np.setdiff1d(more_c, more, assume_unique=True))))
        return _delta_rows(batch, batch.column("n").to_numpy(), batch.column("m").to_numpy(), adds, lacks)

    moves = deltas.select("centre", "cls", "n", "adds", "lacks").join(best, "centre").filter("cls <> median")
    moves = moves.select(F.col("median").alias("centre"), "cls", "n", F.col("nc").alias("m"), "adds", "lacks", "more_c", "less_c")
    return cut(_arrow(moves, moved, DELTAS).dropDuplicates(["centre", "cls"]))  # groups may have one median


def _delta_verified(pairs: DataFrame, deltas: DataFrame) -> DataFrame:
    """Those pairs (centre, cls_x, cls_y) that link, by their differences to the centre."""

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, d = (sum(batch.column(f"{c}_{k}").to_numpy() for k in "xy") for c in ("n", "d"))
        both = [_common(a, b) + _common(c, e) for a, b, c, e in zip(*(_sets(batch, f"{c}_{k}") for c in ("adds", "lacks") for k in "xy"))]
        return batch.select(["centre", "cls_x", "cls_y"]).filter(pa.array(7 * (d - 2 * np.array(both)) <= n))

    for k in "xy":
        pairs = pairs.join(deltas.select("centre", *(F.col(c).alias(f"{c}_{k}") for c in ("cls", "n", "d", "adds", "lacks"))), ["centre", f"cls_{k}"])
    return cut(_arrow(pairs.select("centre", "cls_x", "cls_y", *(f"{c}_{k}" for c in ("n", "d", "adds", "lacks") for k in "xy")), verify, "centre long, cls_x long, cls_y long"))


def _delta_links(deltas: DataFrame) -> DataFrame:
    """Links that connect what is linked in large groups, where one of two members is apart from the first centre.

    The median becomes the centre. A member apart from it first meets, for each of its marks, the nearest to the centre
    of the members that have the same: copies of another text, or of a part of
    the centre's, are connected by then, to each other or to the centre. Then
    all that these links leave unconnected meet by prefixes.
    """
    deltas = _from_median(cut(deltas.join(deltas.filter("apart").select("centre").distinct(), "centre", "left_semi")))
    near = deltas.filter("not apart").select(*_pair("centre", "cls"))
    deltas = cut(deltas.join(deltas.filter("apart").select("centre").distinct(), "centre", "left_semi"))
    marked = deltas.select("centre", "cls", "d", "apart", F.posexplode("marks").alias("k", "mark"))
    first = marked.groupBy("centre", "k", "mark").agg(F.min(F.struct("apart", "d", "cls"))["cls"].alias("cls_y"))
    stars = marked.filter("apart").join(first, ["centre", "k", "mark"]).filter("cls <> cls_y").select("centre", F.col("cls").alias("cls_x"), "cls_y").distinct()
    starred = _delta_verified(stars, deltas)
    known = starred.join(deltas.select("centre", F.col("cls").alias("cls_y"), F.col("apart").alias("away")), ["centre", "cls_y"])
    up = cut(known.groupBy("centre", F.col("cls_x").alias("cls")).agg(F.min(F.struct("away", F.when(F.col("away"), F.col("cls_y")).otherwise(F.col("centre")).alias("up")))["up"].alias("up")))
    top = up.join(up.select("centre", F.col("cls").alias("up"), F.col("up").alias("top")), ["centre", "up"], "left").select("centre", "cls", F.coalesce("top", "up").alias("top"))
    deltas = cut(deltas.join(top, ["centre", "cls"], "left").withColumn("top", F.when(F.col("apart"), F.coalesce("top", "cls")).otherwise(F.col("centre"))).drop("marks"))

    shingles = _delta_shingles(deltas).withColumn("r", F.row_number().over(Window.partitionBy("centre", "cls").orderBy("f", "token")) - 1)
    rows = shingles.join(deltas.select("centre", "cls", "n", "m", "d", "top", "apart"), ["centre", "cls"])
    whoever = F.ceil((7 * F.col("d") - F.col("n") - F.col("m")) / F.lit(14.0) - F.lit(1e-9))  # common ones with any partner
    away = F.floor((7 * F.col("d") - F.col("n") + F.col("m")) / F.lit(14.0) + F.lit(1e-9)) + 1  # with any that is apart
    rows = rows.withColumn("as_x", F.col("apart") & (F.col("r") <= F.col("d") - F.greatest(F.lit(1), whoever))).withColumn("as_y", F.col("r") <= F.col("d") - F.greatest(F.lit(1), away))
    rows = cut(rows.filter("as_x or as_y").drop("f", "m"))
    side = lambda role, k: rows.filter(role).select("centre", "token", *(F.col(c).alias(f"{c}_{k}") for c in ("cls", "n", "d", "top", "apart", "r")))
    # both in the prefix that this pair needs: n - common + 1 of either
    common = F.ceil((7 * (F.col("d_x") + F.col("d_y")) - F.col("n_x") - F.col("n_y")) / F.lit(14.0) - F.lit(1e-9))
    within = (F.col("r_x") <= F.col("d_x") - common) & (F.col("r_y") <= F.col("d_y") - common)
    once = (F.col("top_x") != F.col("top_y")) & (~F.col("apart_y") | (F.col("cls_x") < F.col("cls_y")))
    pairs = side("as_x", "x").join(side("as_y", "y"), ["centre", "token"]).filter(once & within).select("centre", "cls_x", "cls_y").distinct()
    heads = [f"head{k}" for k in range(1, ORDERS + 1)]

    def shared(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Which pairs share a shingle in the prefixes of every further order (of two bytes, so some more do)."""
        n, d = (sum(batch.column(f"{c}_{k}").to_numpy() for k in "xy") for c in ("n", "d"))
        common = -(-(7 * d - n) // 14)
        upto = {k: np.maximum(batch.column(f"d_{k}").to_numpy() - common + 1, 0) for k in "xy"}
        ok = np.ones(len(n), bool)
        for name in heads:
            x, y = (_sets(batch, f"{name}_{k}", np.uint16) for k in "xy")
            for i in np.flatnonzero(ok).tolist():
                ok[i] = len(np.intersect1d(x[i][: upto["x"][i]], y[i][: upto["y"][i]])) > 0
        return batch.select(["centre", "cls_x", "cls_y"]).filter(pa.array(ok))

    columns = ["n", "d", *heads]
    for k in "xy":
        pairs = pairs.join(deltas.select("centre", *(F.col(c).alias(f"{c}_{k}") for c in ("cls", *columns))), ["centre", f"cls_{k}"])
    pairs = cut(_arrow(pairs.select("centre", "cls_x", "cls_y", *(f"{c}_{k}" for c in columns for k in "xy")), shared, "centre long, cls_x long, cls_y long"))
    return near.unionByName(starred.unionByName(_delta_verified(pairs, deltas)).select(*_pair("cls_x", "cls_y")))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))


def _all(spark: SparkSession, links: list[DataFrame]) -> DataFrame:
    found = links[0] if links else spark.createDataFrame([], "a long, b long")
    for more in links[1:]:
        found = found.unionByName(more)
    return found


def _pair_links(pairs: DataFrame, sets: DataFrame, known: list[DataFrame]) -> list[DataFrame]:
    """Tables of links among the pairs that, with those known, connect all of them that link."""
    pairs = _filtered(pairs, sets)
    if pairs.isEmpty():
        return []
    # every class meets its most central candidate; then what these links leave apart
    edges = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rank = edges.groupBy("b").agg((-F.count(F.lit(1))).alias("rank"))
    best = edges.join(rank, "b").groupBy("a").agg(F.min(F.struct("rank", "b"))["b"].alias("b"))
    first = cut(best.select(*_pair("a", "b")).distinct())
    found = [_verified(first, sets)]
    known = [*known[:1], *found]
    up = cut(_all(pairs.sparkSession, known).groupBy(F.col("b").alias("v")).agg(F.min("a").alias("up")))
    top = up.join(up.select(F.col("v").alias("up"), F.col("up").alias("top")), "up", "left").select("v", F.coalesce("top", "up").alias("top"))
    rest = pairs.join(first, ["a", "b"], "left_anti")
    for k in ("a", "b"):
        rest = rest.join(top.select(F.col("v").alias(k), F.col("top").alias(f"top_{k}")), k, "left")
    rest = cut(rest.filter(F.coalesce("top_a", "a") != F.coalesce("top_b", "b")).select("a", "b"))
    return found if rest.isEmpty() else [*found, _verified(rest, sets)]


def link_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k_id, k_hash, k_crc, n, cls) of every row, and (a, b): verified links between classes that connect all that are linked."""
    spark = docs.sparkSession
    source = docs.select(*row_key(docs), F.col("text").cast("string").alias("text"))
    small_batches(spark)
    profile = cut(source.mapInArrow(_profile, "k_id long, k_hash long, k_crc long, n long, cls long, token long, times long"))
    rows = profile.filter("cls is not null").select(*KEYS, "n", "cls")
    late = spark.sparkContext.broadcast(frequent_shingles(profile))

    # one document stands for each class
    full = rows.filter("cls <> 0")
    one = full.groupBy("cls").agg(F.min(F.struct("k_id", "k_hash", "k_crc")).alias("k")).select("cls", "k.*")
    others = cut(full.join(one, ["k_id", "k_hash", "k_crc", "cls"], "left_anti").select(*KEYS).distinct())
    cold, hot = _prefix_rows(_picked(source, others, KEYS, "left_anti"), late)
    held = cold.unionByName(hot)
    in_large = cut(held.filter(F.col("df") > SMALL).groupBy("cls").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n")))
    large = cut(held.filter(F.col("df") > SMALL).select("centre", "cls").distinct().join(in_large, "cls"))
    sizes = cut(_light_sizes(large))
    pairs = cut(_small_pairs(held, in_large).unionByName(_light_first(sizes, large)).distinct())
    tidy(spark)
    heavy = large.filter(F.col("m") * LIGHT >= F.col("n"))
    centres = heavy.groupBy("centre").agg(F.min(F.struct(-F.col("m") / F.col("n"), "cls"))["cls"].alias("own"))
    members = cut(heavy.join(centres, "centre").select(F.col("own").alias("centre"), "cls").distinct())
    sets = _class_sets(source, one, _ends(pairs).unionByName(members.select("cls")).distinct(), late)
    tidy(spark)

    links = []
    if not members.isEmpty():
        deltas = _deltas(members, sets)
        links += [deltas.filter("not apart").select(*_pair("centre", "cls")), _delta_links(deltas)]
    links += _pair_links(pairs, sets, links)
    tidy(spark)
    if not sizes.isEmpty():
        more = cut(_light_rest(sizes, large, _all(spark, links)).join(pairs, ["a", "b"], "left_anti").distinct())
        if not more.isEmpty():
            links += _pair_links(more, _class_sets(source, one, _ends(more).distinct(), late), links)
        tidy(spark)
    late.unpersist()
    return rows, _all(spark, links)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """k_id, k_hash, k_crc, doc_id, n_shingles, component_id and the component's internal root (null for empty sets) for every row."""
    rows, links = link_classes(docs)
    root = components(links).withColumnRenamed("v", "cls")
    alone = F.when(F.col("cls") == 0, F.lit(None)).otherwise(F.coalesce("root", "cls"))
    rows = cut(rows.join(root, "cls", "left").select(*KEYS, F.col("n").alias("n_shingles"), alone.alias("root")))
    real = F.when(F.col("k_id") != F.lit(-(1 << 63)), F.col("k_id"))
    lowest = cut(rows.filter("root is not null").groupBy("root").agg(F.min(real).alias("component_id")))
    named = rows.join(lowest, "root", "left").withColumn("k_real", real)
    return named.select(*KEYS, F.col("k_real").alias("doc_id"), "n_shingles", F.when(F.col("root").isNull(), F.col("k_real")).otherwise(F.col("component_id")).alias("component_id"), "root")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """All columns of one row of each component, of those with the component's id; rows with the empty set all stay."""
    found = near_duplicates(docs)
    one = found.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "k_id", "k_hash", "k_crc")).alias("k")).select("k.k_id", "k.k_hash", "k.k_crc")
    stay = cut(found.join(one, KEYS, "left_semi").unionByName(found.filter("root is null")).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("times"), F.max(F.col("root").isNotNull()).alias("single")))
    kept = docs.select(*row_key(docs), F.struct(*docs.columns).alias("_row")).join(stay, KEYS)
    again = F.col("single") & (F.col("times") > 1)  # repeated rows of one key
    if stay.filter(again).isEmpty():
        return kept.select("_row.*")
    return kept.filter(~again).select("_row.*").unionByName(kept.filter(again).dropDuplicates(KEYS).select("_row.*"))
