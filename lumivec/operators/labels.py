"""Weak labels: which documents train which component."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .segment import segmenter, surfaces

MAX_LABELS = 1 << 20  # whose order goes to every task


def self_labels(tokens: Column) -> Column:
    """The sorted distinct tokens of a document under the keyword vocabulary."""
    return F.array_sort(F.array_distinct(tokens))


def given_labels(klass: Column) -> Column:
    """A class name; white space separates several."""
    return F.filter(F.split(F.trim(klass), r"\s+"), lambda x: x != "")


def label(docs: DataFrame, tokens: Column, klass: Column | None = None, self_supervised: bool = True) -> DataFrame:
    """Adds labels; a missing class falls back to the document's own tokens, and unlabelled documents go."""
    own = self_labels(tokens)
    chosen = own if self_supervised or klass is None else F.when(klass.isNull(), own).otherwise(given_labels(klass.cast("string")))
    return docs.withColumn("labels", chosen).filter(F.size("labels") > 0)


def from_segments(docs: DataFrame, norm: Column, keywords: DataFrame, klass: Column | None = None, self_supervised: bool = True) -> DataFrame:
    """Adds labels: the segments of the text under the keyword vocabulary, or the given class (see label())."""
    return label(docs, segmenter(surfaces(keywords))(norm), klass, self_supervised)


def label_frequency(labelled: DataFrame) -> DataFrame:
    return labelled.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("freq"))


def frequent_labels(frequency: DataFrame, min_pos: int) -> DataFrame:
    return frequency.filter(F.col("freq") >= min_pos)


def rarest_label(labelled: DataFrame, frequency: DataFrame) -> DataFrame:
    """doc_id, rarest: the document's least frequent label; of equals the first in label order.

    Up to MAX_LABELS labels go to every task in that order, and only the least
    place of a document is kept; more are joined, a row for each label of a document.
    """
    names = frequency.orderBy("freq", "label").select("label").limit(MAX_LABELS + 1).toArrow().column("label").cast(pa.string()).combine_chunks()
    if len(names) <= MAX_LABELS:
        shared = labelled.sparkSession.sparkContext.broadcast(names)

        def least(lists: pa.Array) -> pa.Array:
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            at = pc.fill_null(pc.index_in(lists.flatten().cast(pa.string()), value_set=shared.value), len(shared.value)).to_numpy(zero_copy_only=False)
            some, out = size > 0, np.full(len(size), len(shared.value), np.int32)
            if some.any():
                out[some] = np.minimum.reduceat(at, (np.cumsum(size) - size)[some])
            return pa.array(out, mask=out == len(shared.value))

        place = labelled.select("doc_id", F.arrow_udf(least, "int")("labels").alias("place")).groupBy("doc_id").agg(F.min("place").alias("place")).filter("place is not null")
        return place.select("doc_id", F.arrow_udf(lambda at: shared.value.take(at), "string")("place").alias("rarest"))
    each = labelled.select("doc_id", F.explode("labels").alias("label")).join(frequency, "label")
    return each.groupBy("doc_id").agg(F.min_by("label", F.struct("freq", "label")).alias("rarest"))


def rarest_frequency(rarest: DataFrame) -> DataFrame:
    return rarest.groupBy("rarest").agg(F.count(F.lit(1)).alias("freq"))
