"""Helpers that the operators of this subpackage share: text batches as numpy arrays, hashing, and Spark plumbing."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 19  # text bytes handled by one numpy pass
SPAN_BYTES = 1 << 17  # of them hashed at once
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20  # of an Arrow batch
_U = np.uint64


# ---------------------------------------------------------------- Spark

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator works on, so that extra columns never clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


KEYS = ["k_id", "k_hash", "k_crc"]
NO_ID = -(1 << 63)


def row_key(docs: DataFrame) -> list[Column]:
    """What tells rows apart, named KEYS: the id, and 64 and 32 bits of two checksums of the text."""
    text = F.col("text").cast("string")
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k_id"), F.xxhash64(text).alias("k_hash"), F.coalesce(F.crc32(text.cast("binary")), F.lit(-1)).cast("long").alias("k_crc")]


def fold(id_col: str | Column, k: int) -> Column:
    """crc32 of the id written as text, modulo k; null for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % k


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by rows and bytes, and so a Python worker's memory; Spark reads these settings from the session when a plan runs."""
    for name, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, so that a lost executor costs no recomputation.

    Spark removes what is no longer referred to if spark.cleaner.referenceTracking.cleanCheckpoints is true.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where:
            if sc.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            where = f"/tmp/checkpoints/{uuid.uuid4().hex}"  # one machine, as in tests
        sc.setCheckpointDir(where)
    return df.checkpoint()


def tidy(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffles of tables that cut() has written and nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release() -> None:
    """Gives free memory back at the end of a task: idle Python workers wait for later stages beside a full heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """fn(pa.RecordBatch) -> pa.RecordBatch | pa.Table | None, over slices of at most SLICE_BYTES of text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out = fn(part)
                if out is not None:
                    yield from out.to_batches() if isinstance(out, pa.Table) else [out]
        release()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch):
    """Cut a batch where the text in it passes SLICE_BYTES; a longer text is a slice by itself."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + SLICE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


# ---------------------------------------------------------------- texts as arrays

def texts(batch: pa.RecordBatch) -> list[str]:
    """Python strings; null counts as empty."""
    return [t or "" for t in batch.column("text").to_pylist()]


def utf8(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column and each row's offsets in them; null counts as empty."""
    col = pc.fill_null(batch.column(name).cast(pa.large_string()), "")
    n = len(col)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, off - off[0]


_B = np.arange(256)
SPACE = (_B == 32) | ((_B >= 9) & (_B <= 13))
NOT_ALNUM = ~(((_B >= 48) & (_B <= 57)) | ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122)) | (_B >= 128))
LOWER = np.where((_B >= 65) & (_B <= 90), _B + 32, _B).astype(np.uint8)


def words(data: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of non-separator bytes inside a row, and each row's offsets in these."""
    inside = ~separators[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    full = off[1:] > off[:-1]
    before = np.concatenate(([False], inside[:-1]))
    before[off[:-1][full]] = False
    after = np.concatenate((inside[1:], [False]))
    after[off[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64 (fixed constants of a public algorithm)."""
    h = h.astype(_U, copy=True)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def keys(n: int, seed: int = 1) -> np.ndarray:
    """n pseudo-random odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


_POSITION = keys(4096)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit multilinear hash of every span; spans are sorted and don't overlap."""
    out = np.zeros(len(starts), _U)
    size = np.cumsum(ends - starts)
    at = 0
    while at < len(starts):  # in blocks of about SPAN_BYTES, because each byte takes several words of memory
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SPAN_BYTES, "right")))
        out[at:end] = _span_hash(data, starts[at:end], ends[at:end])
        at = end
    return out


def _span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    length = ends - starts
    total = int(length.sum())
    first = np.cumsum(length) - length
    pos = np.arange(total) - np.repeat(first, length)
    byte = data[pos + np.repeat(starts, length)].astype(_U) + _U(1)
    longest = int(length.max())
    factor = _POSITION[pos] if longest <= len(_POSITION) else keys(longest)[pos]
    return mix(np.add.reduceat(byte * factor, first) + length.astype(_U))


def gram_hash(h: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """Hash of every n consecutive values of h, by first position; len(h) - n + 1 of them."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    out = np.zeros(m, _U)
    for i, k in enumerate(keys(n, seed)):
        out += h[i : i + m] * k
    return mix(out)


def row_starts(off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where n consecutive items of one row begin, and their rows; off: each row's offsets among the items."""
    count = np.maximum(np.diff(off) - n + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + off[row]
    return at, row


def covered(n: int, starts: np.ndarray, length) -> np.ndarray:
    """Which of n items lie in [start, start + length) for some start."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + length, n), -1)
    return np.cumsum(step[:-1]) > 0


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of True that lies in one row."""
    starts, ends, first = words(mask.astype(np.uint8), off, np.array([True, False]))
    return starts, ends, np.repeat(np.arange(len(off) - 1), np.diff(first))


def long_array(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64) if h.dtype == _U else h.astype(np.int64), pa.int64())
