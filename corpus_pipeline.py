"""A training-corpus pipeline: five stages, each a Spark job over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. Rows with nulls, empty texts and repeated
rows pass through every stage with the results that its operator defines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumivec.llm import bpe, decontaminate, jaccard_join, langid, line_dedup
from lumivec.llm._common import cut, read_table
from lumivec.llm.queries import tokenizer_path


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without texts that have no letter or resemble no language of the corpus.

    Null and empty texts go; repeated rows are judged alike; ids and other
    columns may be null or have any name; without a labelled text to learn
    from, only texts without letters go; no rows give no rows.
    """
    return langid.keep_known(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows are cut out; what loses all its lines goes.

    n_chars, if there is such a column, is counted anew for what was cut. Null
    and empty texts stay; rows of one doc_id count as one document; a null
    doc_id comes first; no rows give no rows.
    """
    found = line_dedup.cut_lines(docs).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    if "n_chars" in docs.columns:
        old = F.col("row")["n_chars"]
        now = F.length(F.col("row")["text"]).cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("row", F.col("row").withField("n_chars", F.when(F.col("n_removed") > 0, now).otherwise(old)))
    return found.select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id.

    Rows without a word, null and empty texts included, all stay; of repeated
    rows one stays; a row without doc_id stays only if its whole group has none.
    """
    return jaccard_join.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a window of a benchmark item; null and empty texts hold none, and stay."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and digests of the ids and of the decoded text; null texts count as empty."""
    return bpe.encode_documents(docs, tokenizer_path(), with_text=False)


STAGES = [
    ("language_id", keep_languages),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("bpe", encode),
]

ORACLE_SQL = None  # language ID and BPE have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = cut(docs)
    return docs
