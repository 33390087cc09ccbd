"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, tidy


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """v, root: the smallest vertex of the component of every vertex that has a link (columns a, b).

    Alternates two star operations: every vertex links its larger neighbours,
    then its smaller ones, to the smallest it knows. The number of rounds grows
    with the logarithm of the longest path; each round's links are written to
    the checkpoint folder, and nothing but their count and checksum is collected.
    """
    links = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        links = cut(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.withColumnRenamed("m", "b")).distinct())
        tidy(links.sparkSession)
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first())
        if now == state:
            return links.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
        state = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
