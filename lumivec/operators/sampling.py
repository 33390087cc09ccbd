"""A balanced training set for every label, all labels in one job."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut
from .positions import numbered

MAX_STRATA = 1 << 20  # 40 bytes each


def corpus_order(seed: int | None = None) -> list[Column | str]:
    """The order that `first` refers to: a fixed shuffle, or doc_id for reproducible reports."""
    return ["doc_id"] if seed is None else [F.xxhash64(F.col("doc_id"), F.lit(seed)), F.col("doc_id")]


def caps(frequency: DataFrame, max_pos: int, min_neg: int) -> DataFrame:
    """label, freq, n_pos, n_neg: how many documents of either side a label gets."""
    n_pos = F.least(F.lit(max_pos).cast("long"), F.col("freq"))
    return frequency.withColumn("n_pos", n_pos).withColumn("n_neg", F.greatest(n_pos, F.lit(min_neg).cast("long")))


def positives(labelled: DataFrame, limits: DataFrame, order: list[Column], max_pos: int | None = None) -> DataFrame:
    """The first n_pos documents of each label; with max_pos, which no n_pos passes, Spark cuts groups before the shuffle."""
    each = labelled.select("doc_id", F.explode("labels").alias("label"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(*order))
    ranked = each.withColumn("r", rank)
    ranked = ranked if max_pos is None else ranked.filter(F.col("r") <= max_pos)
    return ranked.join(limits.select("label", "n_pos"), "label").filter("r <= n_pos").select("label", "doc_id", F.lit(1).alias("y"))


BLOCK = 1024


def first_without(wanted: DataFrame, has: DataFrame, by: list[str]) -> DataFrame:
    """by, pos: for each row (by, q, size) the first q positions of 0 .. size - 1 that are not in has (by, pos).

    These lie within the first q + j positions, j of the taken ones having less
    than q free ones before them. j is counted by blocks of positions, so that
    only one block of each group is looked at row by row.
    """
    near = has.join(wanted, by).filter(F.col("pos") < F.col("size"))
    blocks = near.groupBy(*by, "q", F.expr(f"pos div {BLOCK}").alias("b")).agg(F.count(F.lit(1)).alias("k"))
    before = F.sum("k").over(Window.partitionBy(*by).orderBy("b")) - F.col("k")
    blocks = blocks.withColumn("before", before)
    ends = (F.col("b") + 1) * BLOCK - F.col("before") - F.col("k")
    whole = blocks.filter(ends < F.col("q")).groupBy(*by).agg(F.sum("k").alias("j"))
    split = blocks.filter((ends >= F.col("q")) & (F.col("b") * BLOCK - F.col("before") < F.col("q"))).select(*by, "b", "before")
    part = near.withColumn("b", F.expr(f"pos div {BLOCK}")).join(split, [*by, "b"])
    free = F.col("pos") - F.col("before") - F.row_number().over(Window.partitionBy(*by, "b").orderBy("pos")) + 1
    part = part.withColumn("free", free).filter("free < q").groupBy(*by).agg(F.count(F.lit(1)).alias("j"))
    # two joins: AQE may deal the sides of a union anew, and what groups it by its key takes it as dealt by that key
    taken = F.coalesce("j", F.lit(0)) + F.coalesce("j2", F.lit(0))
    upto = wanted.filter("q > 0 and size > 0").join(whole, by, "left").join(part.withColumnRenamed("j", "j2"), by, "left").withColumn("n", F.least(F.col("q") + taken, F.col("size")))
    runs = upto.select(*by, "n", F.explode(F.expr("sequence(0L, n - 1, 4096L)")).alias("s"))
    places = runs.select(*by, F.explode(F.expr("sequence(s, least(s + 4095, n - 1))")).alias("pos"))
    return places.join(has.select(*by, "pos"), [*by, "pos"], "left_anti")


def negatives(labelled: DataFrame, limits: DataFrame, order: list[Column]) -> DataFrame:
    """The first n_neg documents without each label."""
    placed = numbered(labelled.select("doc_id", "labels"), order)
    size = placed.agg(F.count(F.lit(1)).alias("size"))
    wanted = limits.select("label", F.col("n_neg").alias("q")).crossJoin(F.broadcast(size))  # one row
    has = placed.select("pos", F.explode("labels").alias("label"))
    free = first_without(wanted, has, ["label"])
    return free.join(placed.select("pos", "doc_id"), "pos").select("label", "doc_id", F.lit(-1).alias("y"))


def uniform_quotas(strata: DataFrame, total: Column | int, group: list[str] | None = None) -> DataFrame:
    """quota: total shared evenly over strata (stratum, available), none above what it has.

    Strata in rising order of availability a_i, p_i before them: those with
    a_i * (K - i) + p_i <= total give all, the others share what is left, the
    first ones one more.
    """
    group = group or []
    total = F.lit(total).cast("long") if isinstance(total, int) else total
    up = Window.partitionBy(*group).orderBy("available", "stratum")
    every = Window.partitionBy(*group)
    t = strata.withColumn("_t", total).withColumn("_i", F.row_number().over(up) - 1).withColumn("_k", F.count(F.lit(1)).over(every))
    t = t.withColumn("_p", F.sum("available").over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("available"))
    t = t.withColumn("_full", F.col("available") * (F.col("_k") - F.col("_i")) + F.col("_p") <= F.col("_t"))
    t = t.withColumn("_given", F.sum(F.when(F.col("_full"), F.col("available")).otherwise(0)).over(every)).withColumn("_n", F.sum(F.when(F.col("_full"), 0).otherwise(1)).over(every))
    t = t.withColumn("_left", F.col("_t") - F.col("_given")).withColumn("_j", F.col("_i") - (F.col("_k") - F.col("_n")))
    share = F.expr("_left div nullif(_n, 0)") + F.when(F.col("_j") < F.expr("_left % nullif(_n, 0)"), 1).otherwise(0)
    return t.withColumn("quota", F.when(F.col("_full"), F.col("available")).otherwise(share).cast("long")).drop(*(c for c in t.columns if c.startswith("_")))


class _Strata:
    """Strata in rising order of availability, with what a water level needs: prefix sums, once for all labels."""

    def __init__(self, names: list[str], available: list[int]):
        order = sorted(range(len(names)), key=lambda i: (available[i], names[i].encode()))
        self.names = pa.array([names[i] for i in order], pa.string())
        self.place = {names[i]: k for k, i in enumerate(order)}
        self.a = np.array([available[i] for i in order], np.int64)
        self.sums = np.concatenate(([0], np.cumsum(self.a)))
        rest = len(order) - np.arange(len(order))
        self.level = self.a * rest + self.sums[:-1]  # from this total on, a stratum gives all it has
        self.level_less = self.level - self.a  # with one of those behind it left out

    def quotas(self, label: str, total: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and quotas above 0 of all strata but the label's own, as uniform_quotas() shares `total`."""
        own, k = self.place.get(label), len(self.a)
        if own is None:
            full = int(np.searchsorted(self.level, total, "right"))
            order = np.arange(k)
            given = self.sums[full]
        else:
            full = int(np.searchsorted(self.level_less[:own], total, "right"))
            if full == own:
                full += int(np.searchsorted(self.level[own + 1 :], total + self.a[own], "right"))
            order = np.concatenate((np.arange(own), np.arange(own + 1, k)))
            given = self.sums[full] if full <= own else self.sums[full + 1] - self.a[own]
        share, more = divmod(int(total - given), len(order) - full) if full < len(order) else (0, 0)
        order = order if share else order[: full + more]
        quota = np.full(len(order), share)
        quota[:full] = self.a[order[:full]]
        quota[full : full + more] += 1
        return order[quota > 0], quota[quota > 0]


def stratum_quotas(limits: DataFrame, strata: DataFrame) -> DataFrame:
    """label, stratum, quota (above 0) for labels (label, n_neg) over strata (stratum, available), one row a label's at most MAX_STRATA.

    One binary search a label over the sorted strata; no label meets a stratum that gives it nothing.
    """
    rows = strata.select("stratum", "available").limit(MAX_STRATA + 1).collect()
    if len(rows) > MAX_STRATA:
        raise ValueError(f"at most {MAX_STRATA} strata")
    shared = strata.sparkSession.sparkContext.broadcast(_Strata([r["stratum"] for r in rows], [r["available"] for r in rows]))

    def run(batches):
        for batch in batches:
            for label, total in zip(batch.column("label").to_pylist(), batch.column("n_neg").to_pylist()):
                at, quota = shared.value.quotas(label, total)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.repeat(label, len(at)), shared.value.names.take(pa.array(at)), pa.array(quota, pa.int64())], names=["label", "stratum", "quota"])

    return limits.select("label", F.col("n_neg").cast("long").alias("n_neg")).mapInArrow(run, "label string, stratum string, quota long")


def stratified_negatives(labelled: DataFrame, rarest: DataFrame, rarest_freq: DataFrame, limits: DataFrame, order: list[Column]) -> DataFrame:
    """Negatives spread over the documents' rarest labels; a stratum that runs short is not refilled.

    Quotas come from frequencies; within a stratum the first documents without
    the label are taken.
    """
    quotas = stratum_quotas(limits, rarest_freq.select(F.col("rarest").alias("stratum"), F.col("freq").alias("available")))
    placed = numbered(labelled.select("doc_id", "labels").join(rarest.withColumnRenamed("rarest", "stratum"), "doc_id"), ["stratum", *order], "at")
    starts = placed.groupBy("stratum").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("size"))
    placed = placed.join(starts, "stratum").withColumn("pos", F.col("at") - F.col("start"))
    wanted = quotas.select("label", "stratum", F.col("quota").alias("q")).join(starts.drop("start"), "stratum")
    has = placed.select("stratum", "pos", F.explode("labels").alias("label"))
    free = first_without(wanted, has, ["label", "stratum"])
    return free.join(placed.select("stratum", "pos", "doc_id"), ["stratum", "pos"]).select("label", "doc_id", F.lit(-1).alias("y"))


def hide_label(tokens: Column, label: Column) -> Column:
    """A document's tokens without the label that it is a positive example of."""
    return F.array_remove(tokens, label)


def hide_target(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """As hide_label(), on training rows (label, y, ids, values): positives lose their label's feature.

    The others grow to unit length again; a row without any other feature stays
    empty. Negatives keep what they have.
    """
    target = vocabulary.select(F.col("token").alias("label"), F.col("token_id").alias("_t"))
    hide = (F.col("y") == 1) & F.coalesce(F.array_contains("ids", F.col("_t")), F.lit(False))
    rows = rows.join(target, "label", "left").withColumn("_h", hide).withColumn("_x", F.arrays_zip("ids", "values"))
    rows = rows.withColumn("_x", F.when(F.col("_h"), F.filter("_x", lambda x: x["ids"] != F.col("_t"))).otherwise(F.col("_x")))
    norm = F.sqrt(F.aggregate("_x", F.lit(0.0), lambda a, x: a + x["values"] * x["values"]))
    rows = rows.withColumn("_n", F.when(F.col("_h"), norm).otherwise(1.0)).withColumn("ids", F.col("_x.ids"))
    scaled = F.transform("_x", lambda x: x["values"] / F.col("_n"))
    return rows.withColumn("values", F.when(F.col("_n") > 0, scaled).otherwise(F.col("_x.values"))).drop("_t", "_h", "_x", "_n")


def training_set(pos: DataFrame, neg: DataFrame) -> DataFrame:
    """label, doc_id, y of the labels that have both sides.

    Both sides are written once: they are read twice, and a union of two tables
    dealt by label would count as dealt by label too, until AQE deals one anew.
    """
    both = cut(pos.unionByName(neg))
    whole = both.groupBy("label").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).filter("lo < hi").select("label")
    return both.join(whole, "label", "left_semi")


def shuffled(rows: DataFrame, seed: int = 0) -> DataFrame:
    """A fixed random order, which position counts from 0."""
    return numbered(rows, [F.md5(F.concat_ws(":", F.lit(str(seed)), "label", "doc_id")), "label", "doc_id"], "position")


def class_weights(training: DataFrame) -> DataFrame:
    """weight: rows of the label over twice the rows of its side."""
    n = F.count(F.lit(1)).over(Window.partitionBy("label"))
    side = F.count(F.lit(1)).over(Window.partitionBy("label", "y"))
    return training.withColumn("weight", n / (2 * side))
