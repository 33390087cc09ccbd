"""Explainable embeddings: token vectors whose components are label scores.

Weights are long tables (label, token_id, w). Feature tables come from
vectorize: (doc_id, token_id, n, value). Scoring leaves the documents where they
are: sparse rows meet dense blocks of weights (see Blocks) in numpy, so nothing
of the size features x labels is ever shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut, scratch
from .vectorize import feature_rows, sparse_rows

BLOCK_CELLS = 1 << 22  # of a block of weights that goes to the tasks: 16 or 32 MB
PASS_CELLS = 1 << 20  # products that are held at once
ROWS = 512
MAX_LABELS = 1 << 18


def weights_from_models(models: DataFrame) -> DataFrame:
    """label, token_id, w of model rows; every name of a row stands for its column."""
    each = models.select(F.explode("label").alias("label"), "coef")
    return each.select("label", F.posexplode("coef").alias("token_id", "w"))


def encode(features: DataFrame, weights: DataFrame) -> DataFrame:
    """doc_id, token_id, label, value: one row for each distinct known token and label."""
    return features.join(weights, "token_id").select("doc_id", "token_id", "label", (F.col("w") * F.col("value")).alias("value"))


class Blocks:
    """A weight table as dense blocks: all tokens by a range of labels, one block at a time on its way to the tasks.

    names: the labels, ascending (a label's place is its component); norms: the
    length of each label's weights. A block has at most `cells` numbers (one
    label's tokens at least). Several blocks are written once to the shared
    scratch space, so each is read by itself and time grows in proportion to labels.
    """

    def __init__(self, weights: DataFrame, cells: int = BLOCK_CELLS):
        self.spark = weights.sparkSession
        known = weights.groupBy("label").agg(F.sqrt(F.sum(F.col("w").cast("double") * F.col("w"))).alias("norm"), F.max("token_id").alias("last")).limit(MAX_LABELS + 1).collect()
        if len(known) > MAX_LABELS:
            raise ValueError(f"a weight table has at most {MAX_LABELS} labels")
        known.sort(key=lambda r: r["label"])
        self.names = [r["label"] for r in known]
        self.norms = np.array([r["norm"] or 0.0 for r in known])
        self.tokens = 1 + max((r["last"] for r in known if r["last"] is not None), default=-1)
        self.width = max(1, cells // max(self.tokens, 1))
        places = self.spark.createDataFrame(pa.table({"label": pa.array(self.names, pa.string()), "_c": np.arange(len(self.names), dtype=np.int32)}))
        rows = weights.filter("token_id is not null").select("label", "token_id", F.col("w").cast("double").alias("w")).join(F.broadcast(places), "label")
        self.rows = rows.select("token_id", "w", F.col("_c").alias("c"), F.floor(F.col("_c") / self.width).cast("int").alias("block"))
        if len(self) > 1:
            path = scratch(self.spark)
            self.rows.repartition("block").write.partitionBy("block").parquet(path)
            self.rows = self.spark.read.parquet(path)

    def __len__(self) -> int:
        return -(-len(self.names) // self.width)

    def range(self, k: int) -> slice:
        return slice(k * self.width, min(len(self.names), (k + 1) * self.width))

    def load(self, k: int, precision: str) -> np.ndarray:
        """Block k: a row for each token and one of zeros for any other."""
        t = self.rows.filter(F.col("block") == k).select("token_id", "c", "w").toArrow()
        span = self.range(k)
        m = np.zeros((self.tokens + 1, span.stop - span.start), precision)
        m[t.column("token_id").to_numpy(), t.column("c").to_numpy() - span.start] = t.column("w").fill_null(0.0).to_numpy()
        return m


def _sums(ids: np.ndarray, values: np.ndarray, first: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Sparse rows (their offsets in ids and values) times a block; a row without ids is all ones."""
    ids = np.where((ids >= 0) & (ids < len(m) - 1), ids, len(m) - 1)
    out = np.ones((len(first) - 1, m.shape[1]), np.float64)
    step = max(1, PASS_CELLS // m.shape[1])
    at = 0
    while at < len(out):
        end = max(at + 1, int(np.searchsorted(first, first[at] + step, "right")) - 1)
        some = np.flatnonzero(np.diff(first[at : end + 1])) + at
        if len(some):
            part = slice(first[at], first[end])
            out[some] = np.add.reduceat(m[ids[part]] * values[part, None], first[some] - first[at], axis=0)
        at = end
    return out


def _scored(rows: DataFrame, keys: list[str], blocks: Blocks, k: int, precision: str, add: np.ndarray | None = None, divide: bool = False) -> DataFrame:
    """keys, v: rows (keys, ids, values) times block k; `add` goes onto every component, `divide` is by the labels' norms (null for 0)."""
    shared = blocks.spark.sparkContext.broadcast(blocks.load(k, precision))
    span = blocks.range(k)
    onto = None if add is None else add[span]
    norms = blocks.norms[span] if divide else None
    kind = pa.float32() if precision == "float32" else pa.float64()

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                lists = [pc.fill_null(part.column(c), []) if part.column(c).null_count else part.column(c) for c in ("ids", "values")]
                first = np.concatenate(([0], np.cumsum(pc.list_value_length(lists[0]).to_numpy())))
                v = _sums(lists[0].flatten().to_numpy(zero_copy_only=False), lists[1].flatten().to_numpy(zero_copy_only=False), first, shared.value)
                if onto is not None:
                    v += onto
                mask = None
                if norms is not None:
                    v /= np.where(norms == 0, 1, norms)
                    mask = np.tile(norms == 0, len(v))
                offsets = pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1])
                lists = pa.ListArray.from_arrays(offsets, pa.array(v.ravel().astype(precision), kind, mask=mask))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keys), lists], names=[*keys, "v"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)
    return rows.select(*keys, "ids", "values").mapInArrow(run, f"{kinds}, v array<{'float' if precision == 'float32' else 'double'}>")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _long(rows: DataFrame, keys: list[str], blocks: Blocks, precision: str, **options) -> DataFrame:
    """keys, label, value of rows (keys, ids, values) for all labels, block by block."""
    if len(blocks) > 1 and not rows.isStreaming:
        rows = cut(rows)
    parts = []
    for k in range(len(blocks)):
        v = _scored(rows, keys, blocks, k, precision, **options)
        each = v.select(*keys, F.explode(F.arrays_zip(F.lit(blocks.names[blocks.range(k)]).alias("label"), F.col("v").alias("value"))).alias("x"))
        parts.append(each.select(*keys, F.col("x.label").alias("label"), F.col("x.value").alias("value")))
    kind = "float" if precision == "float32" else "double"
    return _all(parts) if parts else rows.select(*keys, F.lit("").alias("label"), F.lit(0.0).cast(kind).alias("value")).limit(0)


def _wide(rows: DataFrame, keys: list[str], blocks: Blocks, precision: str, **options) -> DataFrame:
    """keys, v: all components of rows (keys, ids, values); those of several blocks are put together by their keys."""
    if len(blocks) == 1:
        return _scored(rows, keys, blocks, 0, precision, **options)
    if not len(blocks):
        return rows.select(*keys, F.array().cast("array<float>" if precision == "float32" else "array<double>").alias("v"))
    rows = cut(rows).withColumn("_row", F.monotonically_increasing_id())  # keys may repeat
    own = [*keys, "_row"]
    parts = _all([_scored(rows, own, blocks, k, precision, **options).withColumn("k", F.lit(k)) for k in range(len(blocks))])
    gathered = parts.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("x"))
    return gathered.select(*keys, F.flatten(F.col("x.v")).alias("v"))


def _document_rows(docs: DataFrame, features: DataFrame) -> DataFrame:
    """doc_id, ids, values of all documents."""
    return docs.select("doc_id").join(sparse_rows(features), "doc_id", "left")


def _onto(blocks: Blocks, intercepts: DataFrame | None) -> np.ndarray | None:
    if intercepts is None:
        return None
    given = {r["label"]: r["intercept"] for r in intercepts.select("label", "intercept").limit(MAX_LABELS).collect()}
    return np.array([float(given.get(c) or 0.0) for c in blocks.names])


def _occurrence_rows(occurrences: DataFrame, features: DataFrame, weights: DataFrame) -> DataFrame:
    """doc_id, pos, token_id of the occurrences of tokens with weights, ids and values: the token and its share of its value."""
    share = features.select("doc_id", "token_id", (F.col("value") / F.col("n")).alias("share"))
    found = occurrences.join(share, ["doc_id", "token_id"]).join(weights.select("token_id").distinct(), "token_id", "left_semi")
    return found.select("doc_id", "pos", "token_id", F.array("token_id").alias("ids"), F.array("share").alias("values"))


_PLACE = ["doc_id", "pos", "token_id"]


def encode_occurrences(occurrences: DataFrame, features: DataFrame, weights: DataFrame, precision: str = "float32", cells: int = BLOCK_CELLS) -> DataFrame:
    """As encode(), for every occurrence (doc_id, pos, token_id), the value shared by a token's occurrences."""
    return _long(_occurrence_rows(occurrences, features, weights), _PLACE, Blocks(weights, cells), precision)


def occurrence_vectors(occurrences: DataFrame, features: DataFrame, weights: DataFrame, precision: str = "float32", cells: int = BLOCK_CELLS) -> tuple[DataFrame, list[str]]:
    """doc_id, pos, token_id, v: one array of all labels for each occurrence; and the labels."""
    blocks = Blocks(weights, cells)
    return _wide(_occurrence_rows(occurrences, features, weights), _PLACE, blocks, precision), blocks.names


def vectors(docs: DataFrame, features: DataFrame, weights: DataFrame, intercepts: DataFrame | None = None, distance: bool = False, precision: str = "float32", cells: int = BLOCK_CELLS) -> tuple[DataFrame, list[str]]:
    """doc_id, v: one array of all labels for each document (see transform()); and the labels."""
    blocks = Blocks(weights, cells)
    return _wide(_document_rows(docs, features), ["doc_id"], blocks, precision, add=_onto(blocks, intercepts), divide=distance), blocks.names


def transform(docs: DataFrame, features: DataFrame, weights: DataFrame, intercepts: DataFrame | None = None, distance: bool = False, precision: str = "float32", cells: int = BLOCK_CELLS) -> DataFrame:
    """doc_id, label, value: the document vectors.

    A document without a known token is a vector of ones; a token without weights
    counts 0. The intercept (label, intercept) is added to all documents; a
    distance divides by the norm of the label's weights (null where that is 0).
    precision: float32 or float64, of weights and values (sums are made in float64).
    """
    blocks = Blocks(weights, cells)
    return _long(_document_rows(docs, features), ["doc_id"], blocks, precision, add=_onto(blocks, intercepts), divide=distance)


def score(docs: DataFrame, tokens: Column, vocabulary: DataFrame, weights: DataFrame, *keys: str, intercepts: DataFrame | None = None, distance: bool = False, precision: str = "float32", cells: int = BLOCK_CELLS) -> DataFrame:
    """keys, label, value: transform() of documents in one map, without a shuffle, over a table or a stream."""
    blocks = Blocks(weights, cells)
    return _long(feature_rows(docs, tokens, vocabulary, *keys), list(keys), blocks, precision, add=_onto(blocks, intercepts), divide=distance)


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two weight tables: labels of both are averaged token by token (a missing token counts 0), others are copied."""
    names = first.select("label").distinct().withColumn("_a", F.lit(1)).join(second.select("label").distinct().withColumn("_b", F.lit(1)), "label", "full_outer")
    both = first.withColumnRenamed("w", "w1").join(second.withColumnRenamed("w", "w2"), ["label", "token_id"], "full_outer").join(names, "label")
    w1, w2 = F.coalesce("w1", F.lit(0.0)), F.coalesce("w2", F.lit(0.0))
    shared = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return both.select("label", "token_id", F.when(shared, (w1 + w2) / 2).otherwise(w1 + w2).alias("w"))


def add(first: DataFrame, second: DataFrame) -> DataFrame:
    """Weights of two model tables (label array, intercept, coef) merged: refused with intercepts or a two-class model."""
    for models in (first, second):
        if not models.filter(F.col("intercept").isNotNull() | (F.size("label") != 1)).isEmpty():
            raise ValueError("models with intercepts or of two classes can't be added")
    return merge(weights_from_models(first), weights_from_models(second))


def unit_columns(weights: DataFrame) -> DataFrame:
    """Each label's weights at unit length; a zero column stays."""
    norm = F.sqrt(F.sum(F.col("w").cast("double") * F.col("w")).over(Window.partitionBy("label")))
    return weights.withColumn("_n", norm).withColumn("w", F.when(F.col("_n") == 0, F.col("w").cast("double")).otherwise(F.col("w") / F.col("_n"))).drop("_n")


def clip_negative(weights: DataFrame) -> DataFrame:
    return weights.withColumn("w", F.greatest(F.col("w").cast("double"), F.lit(0.0)))


def prune(weights: DataFrame, share: float = 0.95) -> DataFrame:
    """Keep each label's largest weights until their share of the sum passes `share`; the rest becomes 0.

    The threshold is the first weight at which the running share passes, given
    that the largest alone doesn't pass it; else it is 0. share = 1 clips negatives.
    """
    if share >= 1:
        return clip_negative(weights)
    by = Window.partitionBy("label")
    down = by.orderBy(F.desc("w"), "token_id")
    total = F.sum("w").over(by)
    t = weights.withColumn("w", F.col("w").cast("double")).withColumn("_t", F.when(total == 0, 1.0).otherwise(total))
    t = t.withColumn("_c", F.sum(F.col("w") / F.col("_t")).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_r", F.row_number().over(down))
    top = F.max(F.when(F.col("_r") == 1, F.col("_c"))).over(by)
    cut = F.min(F.when((F.col("_r") > 1) & (F.col("_c") > share), F.struct("_r", "w"))).over(by)["w"]
    t = t.withColumn("_x", F.when(top <= share, F.coalesce(cut, F.lit(0.0))).otherwise(0.0))
    return t.withColumn("w", F.when(F.col("w") < F.col("_x"), 0.0).otherwise(F.col("w"))).drop("_t", "_c", "_r", "_x")


def embed_tokens(occurrences: DataFrame, docs: DataFrame, weights: DataFrame, precision: str = "float32", cells: int = BLOCK_CELLS) -> DataFrame:
    """doc_id, label, value: plain sums of token vectors at unit length; ones without a known token."""
    counts = occurrences.groupBy("doc_id", "token_id").agg(F.count(F.lit(1)).cast("double").alias("value"))
    found, names = vectors(docs, counts, weights, precision=precision, cells=cells)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    kind = found.schema["v"].dataType.elementType
    unit = found.withColumn("n", norm).select("doc_id", F.transform("v", lambda x: (x / F.when(F.col("n") == 0, 1.0).otherwise(F.col("n"))).cast(kind)).alias("v"))
    pairs = unit.select("doc_id", F.explode(F.arrays_zip(F.lit(names).alias("label"), F.col("v").alias("value"))).alias("x"))
    return pairs.select("doc_id", F.col("x.label").alias("label"), F.col("x.value").alias("value"))


def unit_rows(vectors: DataFrame) -> DataFrame:
    """Each document's vector at unit length; a zero vector stays."""
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("doc_id")))
    return vectors.withColumn("_n", norm).withColumn("value", F.col("value") / F.when(F.col("_n") == 0, 1.0).otherwise(F.col("_n"))).drop("_n")
