"""Vocabularies: document frequencies, top-k, ids, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .positions import numbered


def document_frequency(docs: DataFrame, tokens: Column) -> DataFrame:
    """token, df: in how many documents each token occurs; partial counts before the only shuffle."""
    return docs.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def document_count(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n_docs"))


def top_k(df_table: DataFrame, k: int) -> DataFrame:
    """The k most frequent tokens; ties in token order."""
    return df_table.orderBy(F.desc("df"), "token").limit(k)


def at_least(df_table: DataFrame, minimum: int) -> DataFrame:
    return df_table.filter(F.col("df") >= minimum)


def with_ids(kept: DataFrame, by: str = "token") -> DataFrame:
    """token_id: position in token order, or by falling frequency."""
    order = [F.col("token")] if by == "token" else [F.desc("df"), F.col("token")]
    return numbered(kept, order, "token_id").withColumn("token_id", F.col("token_id").cast("int"))


def with_idf(vocabulary: DataFrame, n_docs: DataFrame) -> DataFrame:
    """idf = log2(documents / df)."""
    return vocabulary.crossJoin(F.broadcast(n_docs)).withColumn("idf", F.log2(F.col("n_docs") / F.col("df"))).drop("n_docs")


def build_vocabulary(docs: DataFrame, tokens: Column, k: int | None = None, minimum: int = 1) -> DataFrame:
    """token, df, token_id, idf. Without k nothing is cut and ids follow falling frequency."""
    counts = at_least(document_frequency(docs, tokens), minimum)
    kept = top_k(counts, k) if k else counts
    return with_idf(with_ids(kept, "token" if k else "df"), document_count(docs))


def first_documents(docs: DataFrame, n: int | None, order: str = "doc_id") -> DataFrame:
    return docs if n is None else docs.orderBy(order).limit(n)


def keyword_vocabulary(word_list: DataFrame, lang: str) -> DataFrame:
    """token, df: the given words of a language; each counts once, as if there were one document."""
    return word_list.filter(F.col("lang") == lang).select("token").distinct().withColumn("df", F.lit(1).cast("long"))


def select_keywords(vocabulary: DataFrame, size: int, specials: bool = True) -> DataFrame:
    """Words, topped up to `size` with the longest q-grams that lie inside words."""
    is_q = F.col("token").startswith("q:")
    named = vocabulary.filter(~is_q) if specials else vocabulary.filter(~is_q & ~F.col("token").startswith("e:"))
    inner = vocabulary.filter(is_q & ~F.substring("token", 3, 1 << 20).contains("~"))
    room = F.broadcast(named.agg(F.greatest(F.lit(size) - F.count(F.lit(1)), F.lit(0)).alias("room")))
    best = inner.orderBy(F.desc(F.length("token")), "token").limit(size)
    ranked = best.withColumn("r", F.row_number().over(Window.orderBy(F.desc(F.length("token")), "token")))
    return named.select("token", "df").unionByName(ranked.crossJoin(room).filter("r <= room").select("token", "df"))


def drop_inner_joins(vocabulary: DataFrame) -> DataFrame:
    """Without word n-grams, that is entries with a `~` inside that are no q-grams."""
    return vocabulary.filter(F.col("token").startswith("q:") | ~F.expr("substring(token, 2, greatest(length(token) - 2, 0))").contains("~"))


def names_and_weights(vocabulary: DataFrame) -> DataFrame:
    """One row: arrays of tokens and weights in id order."""
    rows = F.array_sort(F.collect_list(F.struct("token_id", "token", "idf")))
    return vocabulary.agg(rows.alias("r")).select(F.col("r.token").alias("names"), F.col("r.idf").alias("weights"))
