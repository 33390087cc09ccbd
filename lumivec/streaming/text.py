"""Text operators on streams.

Normalising, tokenising, labelling and scoring (embed.score) are maps and run on
a stream as they are.
without_repeats() keeps one signature a text in
state, bounded by the watermark, and catches texts that are equal once normalised;
near ones are in near.py.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as nz
from ..functions import tokens as tk
from ..sources.scratch import scratch  # noqa: F401  where a stream keeps its output and state


def read_documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long") -> DataFrame:
    """A stream of the Parquet files under a path or pattern."""
    return spark.readStream.schema(schema).parquet(path)


def normalized(stream: DataFrame, options: nz.TextOptions = nz.TextOptions()) -> DataFrame:
    return stream.withColumn("norm", nz.normalize(F.col("text"), options))


def tokenized(stream: DataFrame, tokens=tk.DEFAULT_TOKENS) -> DataFrame:
    return normalized(stream).withColumn("tokens", tk.tokenize(F.col("norm"), tokens))


def without_repeats(stream: DataFrame, time_col: str = "ts", window: str = "3 days") -> DataFrame:
    """Without texts whose normalised form came before within the window."""
    signed = normalized(stream).withColumn("signature", F.sha2("norm", 256))
    signed = signed.withColumn(time_col, F.col(time_col).cast("timestamp"))
    return signed.withWatermark(time_col, window).dropDuplicatesWithinWatermark(["signature"])


def run_once(stream: DataFrame, out: str, state: str, each_batch: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run over all that is there now, append to Parquet at `out`, and read it back.

    With each_batch every micro-batch goes through it first (grouped work); the batch
    number is part of the path, so a batch that is run again replaces itself.
    """
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if each_batch is None:
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda rows, k: each_batch(rows).write.mode("overwrite").parquet(f"{out}/batch={k}")).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(out)
