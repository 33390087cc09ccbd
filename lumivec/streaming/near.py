"""Near duplicates on a stream, within a sliding window of days.

A text's shingle set gets BANDS signatures of ROWS least hashes each (MinHash).
Texts with an equal signature meet in keyed state: each keeps its set there for
as long as a later text can come within the window, and an exact Jaccard test
decides. Two texts of similarity 0.75 share none of 20 bands of 4 with
probability 0.0005; at 0.8, with less than 0.0001.

State for a signature: one entry for each different set, with the smallest
doc_id of every day, so copies cost one number a day; the watermark removes days
that no row can be compared with any more. A set is kept once for each of its
bands. A micro-batch's texts of one signature meet in one task, one after the
other; each looks for one earlier partner only.

Every band of every text is a key there, so micro-batches of more than some
thousand texts are slow. run_by_batch() is for these, and exact: sets lie once in
files by day, and a micro-batch is joined with those of the days around it.
"""

from __future__ import annotations

import datetime
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import spans as sp
from ..operators.curate import near_sets, shingles

BANDS, ROWS = 20, 4
DAY_MS = 86_400_000


def signatures(sets: Column, bands: int = BANDS, rows: int = ROWS) -> Column:
    """One 64-bit name for each band of an array of hashes; empty for an empty one."""
    factors = sp.mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)

    def one(values: np.ndarray) -> list[int]:
        if not len(values):
            return []
        least = np.array([sp.mix(values * f).min() for f in factors], np.uint64).reshape(bands, rows)
        name = np.arange(1, bands + 1, dtype=np.uint64)
        for k in range(rows):
            name = sp.mix(name * np.uint64(0x9E3779B97F4A7C15) + least[:, k])
        return name.view(np.int64).tolist()

    def run(column: pa.Array) -> pa.Array:
        return pa.array([one(np.asarray(v.values.to_numpy(zero_copy_only=False) if v.is_valid else [], np.int64).view(np.uint64)) for v in column], pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<bigint>")(sets)


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < max(len(a), len(b)) * percent:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * 100 >= (len(a) + len(b) - both) * percent


def _meet(entries: dict[bytes, dict[int, int]], doc_id: int, day: int, own: bytes, days: int, percent: int) -> set[int]:
    """Puts a text among the entries (set -> day -> smallest doc_id); the later ones, by doc_id, of all pairs that this makes."""
    found: set[int] = set()
    mine = np.frombuffer(own, np.int64)
    for other, by_day in entries.items():
        near = [i for d, i in by_day.items() if abs(d - day) <= days and i != doc_id]
        if doc_id in found:  # one earlier partner is enough
            near = [i for i in near if i > doc_id]
        if near and (other == own or _similar(mine, np.frombuffer(other, np.int64), percent)):
            found.update(max(i, doc_id) for i in near)
    by_day = entries.setdefault(own, {})
    by_day[day] = min(by_day.get(day, doc_id), doc_id)
    return found


def near_duplicates(stream: DataFrame, days: int = 3, percent: int = 75, n: int = 5, late: str = "0 days", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id (some more than once) of rows (doc_id, day, norm) of a stream with an earlier near duplicate at most `days` days away.

    Earlier is by doc_id, as in curate.near_duplicates(). Rows may come in any
    order up to `late` behind the newest day, the watermark. A text with fewer
    words than a shingle has no near duplicate.
    """
    keyed = stream.select("doc_id", F.col("day").cast("timestamp").alias("ts"), shingles(F.col("norm"), n).alias("s")).filter("doc_id is not null and ts is not null")
    keyed = keyed.withColumn("band", F.explode(signatures(F.col("s"), bands, rows))).withWatermark("ts", late)

    def run(key: tuple, parts, state: GroupState):
        entries: dict[bytes, dict[int, int]] = pickle.loads(state.get[0]) if state.exists else {}
        if state.hasTimedOut:
            parts = ()
        found: set[int] = set()
        for part in parts:
            for doc_id, ts, s in zip(part["doc_id"], part["ts"], part["s"]):
                found |= _meet(entries, int(doc_id), int(ts.value // 1_000_000 // DAY_MS), np.asarray(s, np.int64).tobytes(), days, percent)
        # a row that still may come is not older than the watermark
        oldest = state.getCurrentWatermarkMs() // DAY_MS - days
        entries = {s: kept for s, by_day in entries.items() if (kept := {d: i for d, i in by_day.items() if d >= oldest})}
        if entries:
            state.update((pickle.dumps(entries),))
            newest = min(max(by_day) for by_day in entries.values())
            state.setTimeoutTimestamp(max((newest + days + 1) * DAY_MS, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"doc_id": pd.Series(sorted(found), dtype="int64")})

    return keyed.groupBy("band").applyInPandasWithState(run, "doc_id long", "entries binary", "append", GroupStateTimeout.EventTimeTimeout)


def _days(spark: SparkSession, sets: str, before: int) -> dict[datetime.date, list]:
    """The folders of the days that micro-batches before one have left."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{sets}/batch=*/day=*")
    found: dict[datetime.date, list] = {}
    for status in where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where) or []:
        path = status.getPath()
        if int(path.getParent().getName().removeprefix("batch=")) < before:
            found.setdefault(datetime.date.fromisoformat(path.getName().removeprefix("day=")), []).append(path)
    return found


def run_by_batch(stream: DataFrame, out: str, state: str, days: int = 3, percent: int = 75, n: int = 5, late: int = 0) -> DataFrame:
    """doc_id (some more than once) as near_duplicates() of a stream run over all that is there now, found exactly, micro-batch by micro-batch.

    Sets of rows within `days` of a micro-batch's days are read again, and pairs
    with a new row are looked for. Days that no row can be compared with any more,
    being more than `late` + `days` behind the newest of earlier micro-batches, are
    removed. A micro-batch that is run again replaces what it has written.
    """
    spark, sets = stream.sparkSession, f"{state}/sets"

    def each(rows: DataFrame, k: int) -> None:
        spark = rows.sparkSession
        known = _days(spark, sets, k)
        if known:
            oldest = max(known) - datetime.timedelta(late + days)
            for path in [p for day, paths in known.items() if day < oldest for p in paths]:
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        new = rows.select("doc_id", F.col("day").cast("date").alias("day"), shingles(F.col("norm"), n).alias("s")).filter("doc_id is not null and day is not null")
        new.filter(F.size("s") > 0).write.mode("overwrite").partitionBy("day").parquet(f"{sets}/batch={k}")
        kept = spark.read.schema("doc_id long, s array<bigint>, batch int, day date").parquet(sets).filter(F.col("batch") <= k)
        first, last = kept.filter(F.col("batch") == k).agg(F.min("day"), F.max("day")).first()
        near = F.lit(False) if first is None else F.col("day").between(first - datetime.timedelta(days), last + datetime.timedelta(days))
        near = kept.filter(near).select("doc_id", "day", "s", (F.col("batch") == k).alias("new"))
        near_sets(near, days, percent, stored=True).write.mode("overwrite").parquet(f"{out}/batch={k}")

    stream.writeStream.option("checkpointLocation", f"{state}/stream").trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
    return spark.read.schema("doc_id long, batch int").parquet(f"{out}/batch=*").select("doc_id")
