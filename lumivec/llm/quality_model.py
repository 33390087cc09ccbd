"""Quality classifier: random Fourier features over document statistics.

Statistics of each whole text are computed once (map-only) and written to the
checkpoint folder; they are a few numbers a document. Cosines of random
projections approximate a Gaussian kernel over them. Ridge regression on these
features needs only the sums Z'Z and Z'y, which each partition adds up and Spark
merges row by row; what reaches the driver is FEATURES squared numbers. A fifth
of the training rows is left out of the fit and calibrates the scores by isotonic
regression over at most BINS score bins, again summed by Spark.

Defined results: null and empty texts have defined statistics and are scored;
labels that are null or whose document is absent are ignored; several labels of
one document all count; without any label every score is 0.5; equal statistics
(repeated rows, ties) get equal scores; columns of the caller's tables other than
doc_id, text and the label are not read. A text is held whole, at about 100 bytes
a word beside it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SPACE, cut, fold, gram_hash, id_text, map_arrow, mix, row_starts, small_batches, span_hash, utf8, words
from .quality_rules import SYMBOL, _sums, later_lines, repeated

FEATURES = 192
BINS = 2000
RIDGE = 1.0
WIDTH = 3.0  # of the kernel, in standard deviations of the statistics

_B = np.arange(256)
UPPER = (_B >= 65) & (_B <= 90)
LETTER = UPPER | ((_B >= 97) & (_B <= 122)) | (_B >= 128)
DIGIT = (_B >= 48) & (_B <= 57)
PIPE = _B == ord("|")
LOUD = np.isin(_B, [ord("!"), ord("?")])
STOP = np.isin(_B, [ord(c) for c in ".,;:"])
STATS = ["log_chars", "log_words", "word_chars", "word_spread", "upper", "digit", "symbol", "pipe", "loud", "stop", "not_ascii", "line_words", "dup_lines", "distinct", "repeats", "letters"]


def statistics(batch: pa.RecordBatch) -> np.ndarray:
    data, off = utf8(batch)
    starts, ends, first = words(data, off, SPACE)
    h = span_hash(data, starts, ends)
    lead = (data & 0xC0) != 0x80
    chars, n = _sums(lead, off), np.diff(first)
    c, w = np.maximum(chars, 1), np.maximum(n, 1)
    count = lambda table: _sums(table[data] & lead, off)
    letters = np.maximum(count(LETTER), 1)
    before = np.concatenate(([0], np.cumsum(lead)))
    size = before[ends] - before[starts]
    mean = _sums(size, first) / w
    spread = np.sqrt(np.maximum(_sums(size * size, first) / w - mean**2, 0))
    _, _, lf, later, _ = later_lines(data, off)
    lines = np.diff(lf)
    row = np.repeat(np.arange(len(n)), n)
    order = np.sort((h & np.uint64((1 << 40) - 1)) | (row.astype(np.uint64) << np.uint64(40)))
    fresh = np.concatenate(([True], order[1:] != order[:-1])) if len(order) else np.zeros(0, bool)
    distinct = np.bincount((order[fresh] >> np.uint64(40)).astype(np.int64), minlength=len(n))
    at, r = row_starts(first, 4)
    repeats = np.bincount(r, weights=repeated(gram_hash(h, 4)[at] ^ mix(r + 1)), minlength=len(n)) if len(at) else np.zeros(len(n))
    upper = _sums(UPPER[data], off)
    return np.stack([
        np.log1p(chars), np.log1p(n), mean, spread, upper / letters, count(DIGIT) / c, count(SYMBOL) / w, count(PIPE) / w,
        count(LOUD) / w, count(STOP) / w, count(_B >= 128) / c, n / np.maximum(lines, 1) / 20, _sums(later, lf) / np.maximum(lines, 1), distinct / w, repeats / w, letters / c,
    ], 1)


def statistics_table(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics, one row per row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "x": pa.array(list(statistics(batch)), pa.list_(pa.float64()))})

    return map_arrow(id_text(docs), run, "doc_id long, x array<double>")


class Features:
    """Standardised statistics -> random cosines, and a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES):
        rng = np.random.default_rng(7)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w = rng.normal(size=(len(mean), features)) / WIDTH
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.concatenate([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))], 1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def isotonic(x: np.ndarray, total: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over sorted bins; the pooled blocks' mean places and shares."""
    blocks: list[list[float]] = []
    for place, n, y in zip(x, total, positive):
        blocks.append([place * n, n, y])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 1], (b[:, 2] + 0.5 * (b[:, 2] / b[:, 1])) / (b[:, 1] + 0.5)


class Model:
    def __init__(self, features: Features | None, beta: np.ndarray | None):
        self.features, self.beta = features, beta
        self.x, self.y = np.zeros(0), np.zeros(0)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.beta is None or not len(self.x):
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        flat = 1 / (1 + np.exp(-4 * (raw - 0.5)))  # keeps the order inside an isotonic step
        return np.round(np.clip(0.98 * np.interp(raw, self.x, self.y) + 0.02 * flat, 0, 1), 6)


def fit(labelled: DataFrame) -> Model:
    """From rows (doc_id, x, y): sums over all of them, none collected."""
    labelled = labelled.withColumn("part", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(5)))
    if labelled.isEmpty():
        return Model(None, None)
    stats = labelled.select(Summarizer.metrics("mean", "std").summary(array_to_vector("x")).alias("s")).select("s.*").first()
    features = Features(stats["mean"].toArray(), stats["std"].toArray())

    def normal(batches):
        total = None
        for batch in batches:
            z, y = features(_matrix(batch)), batch.column("y").to_numpy()
            now = np.concatenate([z.T @ z, (z.T @ y)[:, None]], 1)
            total = now if total is None else total + now
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(total)), "v": pa.array(list(total), pa.list_(pa.float64()))})

    small_batches(labelled.sparkSession)
    sums = labelled.filter("part > 0").select("x", "y").mapInArrow(normal, "i long, v array<double>")
    rows = sums.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).collect()
    if not rows:
        return Model(None, None)
    a = np.array([r["v"] for r in sorted(rows, key=lambda r: r["i"])])
    model = Model(features, np.linalg.solve(a[:, :-1] + RIDGE * np.eye(len(a)), a[:, -1]))

    def binned(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"bin": np.rint(np.clip(model.raw(_matrix(batch)), -0.5, 1.5) * (BINS / 2)).astype(np.int64), "y": batch.column("y")})

    def score_bins(batches):
        yield from map(binned, batches)

    bins = labelled.filter("part = 0").select("x", "y").mapInArrow(score_bins, "bin long, y double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).collect()
    if not bins:
        model.x, model.y = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        return model
    b = np.array(sorted((r["bin"] / (BINS / 2), r["n"], r["y"]) for r in bins))
    model.x, model.y = isotonic(b[:, 0], b[:, 1], b[:, 2])
    return model


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    table = cut(statistics_table(docs))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).filter("y is not null").filter(fold("doc_id", 3) != 1)
    model = fit(table.filter("doc_id is not null").join(known, "doc_id"))

    def run(batches):
        for batch in batches:
            s = model.score(_matrix(batch))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": s, "predicted": pa.array((s >= 0.5).astype(np.int32))})

    small_batches(docs.sparkSession)
    source = table.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "x")
    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
