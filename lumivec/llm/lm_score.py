"""Language-model scores from a log-bilinear model trained with noise-contrastive estimation.

Tokens are lower-cased words and one end mark for each text. The most frequent
ones (all that occur twice or more, MODEL_WORDS at most) have vectors of their
own. A context of two tokens is mapped linearly to a vector; its product with a
group's vector and then with those of the group's members (batched matrix
products) gives scores, and two softmaxes normalised log-probabilities: groups
are MEMBERS tokens of neighbouring frequency, and one more group, shared out by
smoothed counts, is all other tokens. So every token has a probability, and they
add up to 1.

1. Counts of all training tokens: summed in numpy inside map windows, then by
   Spark over the whole corpus.
2. Training: the training texts are dealt out by a hash of id and text into
   shards of about SHARD_TOKENS, in the order of that hash, so that the result
   doesn't depend on how the input is partitioned (but for rounding). Every
   shard runs stochastic gradient steps of noise-contrastive estimation over all
   its texts from the same start, at both levels; the parameters are averaged,
   weighted by tokens (Spark sums arrays of a fixed number).
3. Scoring: counts of at least HOT_WORDS' rank go to all tasks (HOT_WORDS
   entries of 16 bytes at most); tokens outside are joined with their counts by
   shuffle and summed by document, so nothing is dropped and no hot word is
   shuffled.

Defined results: a null or empty text is the end mark alone; without training
texts c, N and V are 0 and the model is uniform over its single group; repeated
rows are scored one by one; a null id belongs to no fold: it is neither held
out nor learned from; equally frequent tokens rank by their hash. A text is held
whole, at about 100 bytes a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import KEYS, LOWER, SPACE, cut, fold, long_array, map_arrow, release, row_key, slices, small_batches, span_hash, utf8, words

MODEL_WORDS = 1 << 12
MEMBERS = 64
HOT_WORDS = 1_000_000
DIMS = 16
NOISE, WORD_NOISE = 24, 8
BATCH = 16384
RATE = 0.06
SHARD_TOKENS = 4_000_000
WINDOW_TOKENS = 4_000_000
END = np.uint64(1)  # the end mark's name; words' names are odd and larger, see _tokens
_WIDE = 256


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of all tokens, each text's end mark included, their rows, and the rows' offsets."""
    data, off = utf8(batch)
    starts, ends, first = words(data, off, SPACE)
    h = span_hash(LOWER[data], starts, ends) | np.uint64(1 << 63)
    row = np.repeat(np.arange(batch.num_rows), np.diff(first))
    out = np.full(len(h) + batch.num_rows, END, np.uint64)
    out[np.arange(len(h)) + row] = h
    count = np.diff(first) + 1
    return out, np.repeat(np.arange(batch.num_rows), count), np.concatenate(([0], np.cumsum(count)))


def token_counts(train: DataFrame) -> DataFrame:
    """h, c: how often each token occurs in the training texts."""

    def run(batches):
        held, size = [], 0

        def counted():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_pydict({"h": long_array(h), "c": long_array(c)})

        for batch in batches:
            for part in slices(batch):
                held.append(_tokens(part)[0])
                size += len(held[-1])
                if size >= WINDOW_TOKENS:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    small_batches(train.sparkSession)
    return train.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Model:
    """Token and group tables, parameters, and the counts that are known everywhere."""

    def __init__(self, hot: np.ndarray, count: np.ndarray, total: int, kinds: int):
        self.hot, self.count, self.total, self.kinds = hot, count, total, kinds
        ranked = np.lexsort((hot, -count))
        ranked = ranked[count[ranked] > 1][:MODEL_WORDS]
        n = len(ranked)
        self.rank_of = np.argsort(hot[ranked])
        self.top = hot[ranked][self.rank_of]
        self.rest, self.start = n, n + 1  # as contexts: all other tokens, and what stands before a text
        own = count[ranked].astype(np.float64)
        self.groups = -(-n // MEMBERS)  # the group after the last is all other tokens
        self.rest_total, self.rest_kinds = int(total - own.sum()), kinds - n
        padded = np.zeros(self.groups * MEMBERS)
        padded[:n] = own + 1.0
        table = padded.reshape(self.groups, MEMBERS)
        shares = np.append(table.sum(1), self.rest_total + 1.0)
        self.noise = shares / shares.sum()
        self.word_noise = table / np.maximum(table.sum(1, keepdims=True), 1e-9)
        self.padding = padded == 0
        self.word_steps = np.minimum(np.cumsum(self.word_noise, 1), 1 - 1e-12)
        self.word_steps[:, -1] = 1.0
        self.word_base = np.log(WORD_NOISE * np.maximum(self.word_noise.ravel(), 1e-9)).astype(np.float32)
        r = np.random.default_rng(13)
        small = lambda *shape: r.normal(0, 0.1, shape).astype(np.float32)
        self.p = {
            "r": small(n + 2, DIMS), "q": small(self.groups + 1, DIMS), "b": np.log(self.noise).astype(np.float32),
            "w": small(len(padded), DIMS), "d": np.log(np.maximum(self.word_noise.ravel(), 1e-9)).astype(np.float32),
            "c1": np.eye(DIMS, dtype=np.float32) * np.float32(0.7), "c2": np.eye(DIMS, dtype=np.float32) * np.float32(0.3),
        }

    def ranks(self, h: np.ndarray) -> np.ndarray:
        if not len(self.top):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.top, h), len(self.top) - 1)
        return np.where(self.top[at] == h, self.rank_of[at], self.rest)

    def group(self, rank: np.ndarray) -> np.ndarray:
        return np.where(rank == self.rest, self.groups, rank // MEMBERS)

    def contexts(self, rank: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens before each token, and those before these."""
        one = np.concatenate(([self.start], rank[:-1]))
        one[first[:-1]] = self.start
        two = np.concatenate(([self.start], one[:-1]))
        two[first[:-1]] = self.start
        return one, two

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = flat[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n

    def step(self, rank: np.ndarray, one: np.ndarray, two: np.ndarray, r: np.random.Generator, memory: dict[str, np.ndarray]) -> None:
        """One gradient step; the noise is shared by the batch: some groups, and some members of each group."""
        p, group = self.p, self.group(rank)
        a, b = p["r"][one], p["r"][two]
        v = a @ p["c1"] + b @ p["c2"]
        noise = r.choice(len(self.noise), NOISE, p=self.noise)
        base = np.log(NOISE * self.noise).astype(np.float32)
        gt = -_sigmoid(-((v * p["q"][group]).sum(1) + p["b"][group] - base[group]))
        gf = _sigmoid(v @ p["q"][noise].T + (p["b"] - base)[noise])
        dv = gt[:, None] * p["q"][group] + gf @ p["q"][noise]
        g = {k: np.zeros_like(x) for k, x in p.items()}
        np.add.at(g["q"], noise, gf.T @ v)
        np.add.at(g["b"], noise, gf.sum(0))
        g["q"] += _scatter(group, gt[:, None] * v, len(p["q"]))
        g["b"] += np.bincount(group, gt, len(p["b"]))
        order = np.argsort(group, kind="stable")
        edge = np.searchsorted(group[order], np.arange(self.groups + 1))
        word_gt = np.zeros(len(rank), np.float32)
        drawn, base = r.random((self.groups, WORD_NOISE)), self.word_base
        for k in np.flatnonzero(np.diff(edge)).tolist():
            at = order[edge[k] : edge[k + 1]]
            false = np.searchsorted(self.word_steps[k], drawn[k]) + k * MEMBERS
            some, wrong = v[at], p["w"][false]
            gf = _sigmoid(some @ wrong.T + (p["d"] - base)[false])
            dv[at] += gf @ wrong
            np.add.at(g["w"], false, gf.T @ some)
            np.add.at(g["d"], false, gf.sum(0))
        known = rank < self.rest
        mine = rank[known]
        right = p["w"][mine]
        word_gt[known] = -_sigmoid(-((v[known] * right).sum(1) + (p["d"] - base)[mine]))
        dv[known] += word_gt[known, None] * right
        g["w"] += _scatter(mine, word_gt[known, None] * v[known], len(p["w"]))
        g["d"] += np.bincount(mine, word_gt[known], len(p["d"]))
        g["c1"], g["c2"] = a.T @ dv, b.T @ dv
        g["r"] = _scatter(one, dv @ p["c1"].T, len(p["r"])) + _scatter(two, dv @ p["c2"].T, len(p["r"]))
        for name, x in g.items():  # Adagrad
            memory[name] += x * x
            p[name] -= np.float32(RATE) * x / np.sqrt(memory[name] + np.float32(1e-6))

    def log_probabilities(self, rank: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """log10 of each token's probability given its context, for all other tokens that of their group; equal contexts are worked out once."""
        n = self.start + 1
        code, at = np.unique(one * n + two, return_inverse=True)
        p = {k: x.astype(np.float64) for k, x in self.p.items()}  # so that a text's score doesn't depend on its slice
        out, group = np.empty(len(rank)), self.group(rank)
        v = p["r"][code // n] @ p["c1"] + p["r"][code % n] @ p["c2"]
        norm = np.empty(len(code))
        for i in range(0, len(code), 4096):
            norm[i : i + 4096] = _log_sum(v[i : i + 4096] @ p["q"].T + p["b"])
        order = np.argsort(group, kind="stable")
        edge = np.searchsorted(group[order], np.arange(self.groups + 2))
        for k in np.flatnonzero(np.diff(edge)).tolist():
            mine = order[edge[k] : edge[k + 1]]
            out[mine] = v[at[mine]] @ p["q"][k] + p["b"][k] - norm[at[mine]]
            if k < self.groups:
                rows = slice(k * MEMBERS, (k + 1) * MEMBERS)
                bias = np.where(self.padding[rows], -1e9, p["d"][rows])
                for i in range(0, len(mine), 4096):
                    some = mine[i : i + 4096]
                    s = v[at[some]] @ p["w"][rows].T + bias
                    out[some] += s[np.arange(len(some)), rank[some] - k * MEMBERS] - _log_sum(s)
        return out / np.log(10)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _log_sum(s: np.ndarray) -> np.ndarray:
    top = s.max(1)
    return top + np.log(np.exp((s - top[:, None]).astype(np.float32)).sum(1, dtype=np.float64))


def _scatter(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, values[:, k], n) for k in range(values.shape[1])], 1).astype(np.float32)


def train(docs: DataFrame, model: Model) -> Model:
    """Every shard's texts once, from the same start; then the weighted mean."""

    def run(batches):
        local = shared.value
        start = local.p
        local.p = {k: v.copy() for k, v in start.items()}
        memory = {k: np.zeros_like(v) for k, v in start.items()}
        r, seen, held, size = np.random.default_rng(17), 0, [], 0
        for batch in batches:
            for part in slices(batch):
                h, _, first = _tokens(part)
                rank = local.ranks(h)
                held.append(np.stack([rank, *local.contexts(rank, first)]))
                size += len(rank)
                if size < BATCH * 16:
                    continue
                seen += _steps(local, np.concatenate(held, 1), r, memory)
                held, size = [], 0
        if held:
            seen += _steps(local, np.concatenate(held, 1), r, memory)
        if seen:
            flat = local.flat()
            flat = np.concatenate((flat, np.zeros(-len(flat) % _WIDE, np.float32))).reshape(-1, _WIDE)
            for i in range(0, len(flat), 512):
                some = flat[i : i + 512]
                yield pa.RecordBatch.from_pydict({"i": np.arange(i, i + len(some)), "v": pa.FixedSizeListArray.from_arrays(pa.array(some.ravel().astype(np.float64)), _WIDE).cast(pa.list_(pa.float64())), "n": np.full(len(some), float(seen))})
        local.p = start  # a worker may run several shards
        release()

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    small_batches(spark)
    place = F.xxhash64("doc_id", "text")
    shards = docs.select("text", place.alias("place")).repartition(max(1, -(-model.total // SHARD_TOKENS)), "place").sortWithinPartitions("place", "text")
    parts = shards.select("text").mapInArrow(run, "i long, v array<double>, n double")
    rows = parts.groupBy("i").agg(vector_to_array(Summarizer.mean(array_to_vector("v"), F.col("n"))).alias("v")).collect()
    if rows:
        model.load(np.concatenate([r["v"] for r in sorted(rows, key=lambda r: r["i"])])[: len(model.flat())])
    shared.unpersist()
    return model


def _steps(model: Model, x: np.ndarray, r: np.random.Generator, memory: dict) -> int:
    size = max(512, min(BATCH, -(-x.shape[1] // 16)))  # a small corpus takes some steps too
    for i in range(0, x.shape[1], size):
        model.step(*x[:, i : i + size], r, memory)
    return x.shape[1]


def learn(train_docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the counts of the tokens that it does not carry."""
    counts = cut(token_counts(train_docs))
    sizes = counts.groupBy("c").agg(F.count(F.lit(1)).alias("k")).toArrow().to_pydict()
    total, kinds, held, least = sum(c * k for c, k in zip(sizes["c"], sizes["k"])), sum(sizes["k"]), 0, 1 << 62
    for c, k in sorted(zip(sizes["c"], sizes["k"]), reverse=True):
        if held + k > HOT_WORDS:
            break
        held, least = held + k, c
    hot = counts.filter(F.col("c") >= least).toArrow()
    h, c = hot.column("h").to_numpy().view(np.uint64), hot.column("c").to_numpy()
    order = np.argsort(h)
    model = Model(h[order], c[order], total, kinds)
    return train(train_docs, model), counts.filter(F.col("c") < least)


def _score(batch: pa.RecordBatch, m: Model) -> pa.RecordBatch:
    """A row for each text, and one for each token of it that the model has no count of."""
    h, row, first = _tokens(batch)
    n = batch.num_rows
    rank = m.ranks(h)
    logp = m.log_probabilities(rank, *m.contexts(rank, first))
    if len(m.hot):
        at = np.minimum(np.searchsorted(m.hot, h), len(m.hot) - 1)
        known = m.hot[at] == h
        own = np.where(known, np.log10(m.count[at] + 1.0), 0.0)
    else:
        known, own = np.zeros(len(h), bool), np.zeros(len(h))
    size = np.diff(first)
    rest = rank == m.rest
    add = lambda x: np.bincount(row, x, n)
    base = add(own) - size * np.log10(m.total + m.kinds + 1)
    score = add(logp) + add(own * rest) - add(rest) * np.log10(m.rest_total + m.rest_kinds + 1)
    cold, times = np.unique(np.stack([row[~known].astype(np.uint64), h[~known]]), axis=1, return_counts=True)
    k, none = cold.shape[1], pa.nulls(cold.shape[1], pa.int64())
    take = pa.array(cold[0].astype(np.int64))
    both = lambda a, b: pa.concat_arrays([a, b])
    return pa.RecordBatch.from_arrays(
        [both(batch.column(c), batch.column(c).take(take)) for c in KEYS]
        + [both(long_array(size), none), both(long_array(add(known)), none), both(pa.array(base), none.cast(pa.float64())), both(pa.array(score), none.cast(pa.float64())), both(pa.nulls(n, pa.int64()), long_array(cold[1])), both(pa.nulls(n, pa.int64()), long_array(times[:k]))],
        names=[*KEYS, "n_tokens", "n_known", "base_score", "score", "h", "times"],
    )


def score_documents(docs: DataFrame, k: int = 7, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    text = F.col("text").cast("string").alias("text")
    model, cold_counts = learn(docs.filter(fold("doc_id", k) != held_out).select("doc_id", text))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = "k_id long, k_hash long, k_crc long, n_tokens long, n_known long, base_score double, score double, h long, times long"
    rows = cut(map_arrow(docs.select(*row_key(docs), text), lambda b: _score(b, shared.value), fields))
    found = rows.filter("h is not null").join(cold_counts, "h").groupBy(*KEYS).agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"))
    texts = rows.filter("h is null")
    copies = texts.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("copies"))  # repeated rows have added up
    joined = texts.join(found.join(copies, KEYS), KEYS, "left")
    more, more_known = F.coalesce(F.col("more") / F.col("copies"), F.lit(0.0)), F.coalesce(F.expr("more_known div copies"), F.lit(0))
    doc_id = F.when(F.col("k_id") != F.lit(-(1 << 63)), F.col("k_id")).alias("doc_id")
    return joined.select(doc_id, F.coalesce(fold(doc_id, k) == held_out, F.lit(False)).alias("held_out"), "n_tokens", (F.col("n_known") + more_known).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), F.round(F.col("base_score") + more, 6).alias("base_score"), F.round(F.col("score") + more, 4).alias("score"))
