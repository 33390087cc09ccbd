"""Downstream classifiers on tokens, segments and embeddings, and their score."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut


def split(docs: DataFrame, train_percent: int = 75, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """A stable random split by a digest of the id."""
    part = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "doc_id")), 1, 8), 16, 10).cast("long") % 100
    return docs.filter(part < train_percent), docs.filter(part >= train_percent)


def token_vectors(docs: DataFrame, tokens: Column, vocabulary: DataFrame) -> DataFrame:
    """doc_id, features: the sparse unit vectors of vectorize.features(), for every document, in Spark's own vectors.

    The vocabulary (one built with k, so of bounded size) becomes part of the model.
    """
    rows = vocabulary.orderBy("token_id").select("token", "idf").collect()
    counts = CountVectorizerModel.from_vocabulary([r["token"] for r in rows], inputCol="tokens", outputCol="counts")
    weighted = ElementwiseProduct(scalingVec=DenseVector([r["idf"] for r in rows]), inputCol="counts", outputCol="weighted")
    unit = Normalizer(inputCol="weighted", outputCol="features", p=2.0)
    table = docs.select("doc_id", tokens.alias("tokens"))
    return PipelineModel([counts, weighted, unit]).transform(table).select("doc_id", "features")


def dense_vectors(vectors: DataFrame) -> DataFrame:
    """doc_id, features (unit length) from (doc_id, v) of embed.vectors()."""
    return Normalizer(inputCol="raw", outputCol="features", p=2.0).transform(vectors.select("doc_id", array_to_vector("v").alias("raw"))).select("doc_id", "features")


def predict(features: DataFrame, truth: DataFrame, train_percent: int = 75, iterations: int = 20) -> DataFrame:
    """doc_id, y, predicted of the rows held out; truth: (doc_id, y) with y = 0, 1, ..."""
    rows = cut(features.join(truth, "doc_id").withColumn("label", F.col("y").cast("double")))
    train, rest = split(rows, train_percent)
    model = OneVsRest(classifier=LinearSVC(maxIter=iterations, regParam=1e-3)).fit(train)
    return model.transform(rest).select("doc_id", "y", F.col("prediction").cast("int").alias("predicted"))


def macro_recall(predictions: DataFrame) -> DataFrame:
    """model, macro_recall: the mean of each class's recall."""
    each = predictions.groupBy("model", "y").agg(F.avg((F.col("y") == F.col("predicted")).cast("double")).alias("recall"))
    return each.groupBy("model").agg(F.avg("recall").alias("macro_recall"))
