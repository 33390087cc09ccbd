"""TF-IDF features as long tables (doc_id, token_id, value)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_TOKENS = 1 << 20
ROWS = 2000


def known_tokens(docs: DataFrame, tokens: Column, vocabulary: DataFrame) -> DataFrame:
    """doc_id, token_id, idf of every token occurrence in the vocabulary; the rest is dropped.

    A vocabulary has at most its k rows; Spark broadcasts it by its measured size.
    """
    return docs.select("doc_id", F.explode(tokens).alias("token")).join(vocabulary.select("token", "token_id", "idf"), "token").select("doc_id", "token_id", "idf")


def term_counts(known: DataFrame) -> DataFrame:
    return known.groupBy("doc_id", "token_id", "idf").agg(F.count(F.lit(1)).alias("n"))


def term_frequency(counts: DataFrame) -> DataFrame:
    """tf: count over all known tokens of the document."""
    return counts.withColumn("tf", F.col("n") / F.sum("n").over(Window.partitionBy("doc_id")))


def tf_idf(counts: DataFrame) -> DataFrame:
    """value: n * idf at unit length (the term frequency's denominator cancels); NaN where all weights are 0."""
    raw = F.col("n") * F.col("idf")
    norm = F.sqrt(F.sum(raw * raw).over(Window.partitionBy("doc_id")))
    return counts.withColumn("_norm", norm).withColumn("value", F.when(F.col("_norm") == 0, F.lit(float("nan"))).otherwise(raw / F.col("_norm"))).drop("_norm")


def features(docs: DataFrame, tokens: Column, vocabulary: DataFrame) -> DataFrame:
    """doc_id, token_id, n, value."""
    return tf_idf(term_counts(known_tokens(docs, tokens, vocabulary))).drop("idf")


def sparse_rows(table: DataFrame) -> DataFrame:
    """doc_id, ids, values: one sparse vector a document, ids ascending."""
    rows = F.array_sort(F.collect_list(F.struct("token_id", "value")))
    return table.groupBy("doc_id").agg(rows.alias("r")).select("doc_id", F.col("r.token_id").alias("ids"), F.col("r.value").alias("values"))


class _Lexicon:
    def __init__(self, token: pa.Array, ids: np.ndarray, idf: np.ndarray):
        order = np.argsort(ids)
        self.token, self.ids, self.idf = token.take(pa.array(order)), ids[order], idf[order]

    def rows(self, lists: pa.Array) -> tuple[pa.Array, pa.Array]:
        """ids and values of every list of tokens, as tf_idf() and sparse_rows() give them."""
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        at = pc.fill_null(pc.index_in(lists.flatten(), value_set=self.token), -1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(size)), size)[at >= 0]
        key, n = np.unique(row * len(self.ids) + at[at >= 0], return_counts=True)
        row, at = np.divmod(key, max(len(self.ids), 1))
        raw = n * self.idf[at]
        norm = np.sqrt(np.bincount(row, raw * raw, len(size)))[row]
        value = np.divide(raw, norm, out=np.full(len(raw), np.nan), where=norm > 0)
        first = pa.array(np.searchsorted(row, np.arange(len(size) + 1)).astype(np.int32))
        return pa.ListArray.from_arrays(first, pa.array(self.ids[at], pa.int32())), pa.ListArray.from_arrays(first, pa.array(value))


def feature_rows(docs: DataFrame, tokens: Column, vocabulary: DataFrame, *keys: str) -> DataFrame:
    """keys, ids, values: one sparse row a document, also without a known token, in one map over batches or a stream.

    The vocabulary (at most MAX_TOKENS entries, else an error) goes to every task.
    """
    known = vocabulary.select("token", F.col("token_id").cast("int").alias("token_id"), F.col("idf").cast("double").alias("idf")).limit(MAX_TOKENS + 1).toArrow().combine_chunks()
    if known.num_rows > MAX_TOKENS:
        raise ValueError(f"a vocabulary that goes to every task has at most {MAX_TOKENS} entries")
    token = known.column("token").cast(pa.string()).combine_chunks() if known.num_rows else pa.array([], pa.string())
    lexicon = docs.sparkSession.sparkContext.broadcast(_Lexicon(token, known.column("token_id").to_numpy(), known.column("idf").to_numpy()))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keys), *lexicon.value.rows(part.column("_tokens"))], names=[*keys, "ids", "values"])

    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in keys)
    return docs.select(*keys, tokens.alias("_tokens")).mapInArrow(run, kinds + "ids array<int>, values array<double>")
