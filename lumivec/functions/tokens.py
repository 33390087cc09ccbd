"""Tokens of normalised text: words, word n-grams, character q-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as sp

# Token lists by default, and the languages written without spaces.
DEFAULT_TOKENS = (-2, -1, 2, 3, 4)
UNSPACED_TOKENS = (1, 2, 3)
UNSPACED = ("ja", "zh")


def token_list(lang: str | None, given: Sequence[int] | None = None) -> list[int]:
    """Negative: word n-grams, positive: q-grams of characters."""
    return list(given) if given is not None else list(UNSPACED_TOKENS if lang in UNSPACED else DEFAULT_TOKENS)


def token_list_column(lang: Column) -> Column:
    return F.when(lang.isin(*UNSPACED), F.array(*map(F.lit, UNSPACED_TOKENS))).otherwise(F.array(*map(F.lit, DEFAULT_TOKENS)))


def words(norm: Column) -> Column:
    """What stands between the separators, specials included."""
    parts = F.split(norm, "~", -1)
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))


def word_ngrams(w: Column, n: int) -> Column:
    """Every n consecutive words of an array, joined by `~`."""
    none = F.array().cast("array<string>")
    grams = lambda v: F.when(F.size(v) >= n, F.transform(F.sequence(F.lit(1), F.size(v) - (n - 1)), lambda i: F.array_join(F.slice(v, i, n), "~"))).otherwise(none)
    return w if n == 1 else F.transform(F.array(w), grams)[0]  # w is worked out once, not once for each element


def _grams(data: np.ndarray, places: np.ndarray, start: np.ndarray, end: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of all substrings of q characters of spans, and which span each is of; places: where characters begin."""
    a, z = np.searchsorted(places, start), np.searchsorted(places, end)
    count = np.maximum(z - a - q + 1, 0)
    of = np.repeat(np.arange(len(a)), count)
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + a[of]
    return places[at], np.append(places, len(data))[at + q], of


def _token_spans(data: np.ndarray, off: np.ndarray, ngrams: Sequence[int], sizes: Sequence[int], inside: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Start, end, row and rank in the row of every token of normalised texts, kind after kind, and how many of them are words."""
    ws, we, wr = sp.words(data, off)
    starts, ends, rows, keys = [], [], [], []

    def add(start, end, row, key):
        starts.append(start)
        ends.append(end)
        rows.append(row)
        keys.append(np.full(len(start), key) if np.isscalar(key) else key)

    for k, n in enumerate(ngrams):
        m = max(len(ws) - n + 1, 0)
        one = wr[:m] == wr[n - 1 :]
        add(ws[:m][one], we[n - 1 :][one], wr[:m][one], k - len(ngrams))
    words = sum(len(x) for x in starts)
    if sizes:
        places = np.flatnonzero((data & 0xC0) != 0x80)
        at = np.minimum(ws + 1, max(len(data) - 1, 0))
        plain = ~((data[ws] == ord("e")) & (data[at] == ord(":")) & (we - ws > 1)) if len(ws) else np.zeros(0, bool)
        fs, fe, fr = ws[plain], we[plain], wr[plain]
        if not inside and len(fs):  # runs of words that no special item parts
            head = np.concatenate(([True], (fs[1:] != fe[:-1] + 1) | (fr[1:] != fr[:-1])))
            fs, fe, fr = fs[head], fe[np.append(np.flatnonzero(head)[1:], len(head)) - 1], fr[head]
        for k, q in enumerate(sizes):
            a, z, of = _grams(data, places, fs - 1, fe + 1, q)
            add(a, z, fr[of], k if inside else of * len(sizes) + k)
    return *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends, rows, keys)), words


def _token_arrays(column: pa.Array, ngrams: Sequence[int], sizes: Sequence[int], inside: bool) -> pa.Array:
    """Tokens of a slice of normalised texts: spans of the texts, q-grams marked, gathered at once."""
    data, off = sp.utf8(column)
    start, end, row, key, words = _token_spans(data, off, ngrams, sizes, inside)
    order = np.lexsort((key, row))
    values = sp.gather(data, start[order], end[order], (np.arange(len(start)) >= words)[order], b"q:")
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(len(off))), pa.int32()), values)


def _by_arrow(norm: Column, ngrams: Sequence[int], sizes: Sequence[int], inside: bool) -> Column:
    # a text's tokens take 20 times its bytes and more: they leave the worker slice by slice, never a batch's at once
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            for part in sp.slices(column):
                yield _token_arrays(part, ngrams, sizes, inside)

    return F.arrow_udf(run, "array<string>")(norm)


def q_grams_in_words(norm: Column, sizes: Sequence[int]) -> Column:
    """All substrings of `~word~` of each size, special items left out; sizes outer, words inner."""
    return _by_arrow(norm, [], sizes, True)


def q_grams_across(norm: Column, sizes: Sequence[int]) -> Column:
    """Substrings over whole runs of words between special items; runs outer, sizes inner."""
    return _by_arrow(norm, [], sizes, False)


def tokenize(norm: Column, tokens: Sequence[int] = DEFAULT_TOKENS, q_grams_words: bool = True) -> Column:
    """Word n-grams, then q-grams, duplicates kept; null is an empty text.

    Every token is a span of the normalised text, so numpy finds the spans of all
    kinds at once and gathers their bytes; words alone stay a built-in expression.
    """
    ngrams, sizes = [-n for n in tokens if n < 0], [q for q in tokens if q > 0]
    return words(F.coalesce(norm, F.lit("~"))) if ngrams == [1] and not sizes else _by_arrow(norm, ngrams, sizes, q_grams_words)


COUNTED = 1 << 18  # bytes of text that are counted at once
CELLS = 1 << 24


def _counted(column: pa.Array, ngrams: Sequence[int], sizes: Sequence[int], inside: bool) -> pa.RecordBatch:
    """The tokens of a slice of normalised texts, and in how many of these each occurs."""
    data, off = sp.utf8(column)
    start, end, row, _, words = _token_spans(data, off, ngrams, sizes, inside)
    found = sp.gather(data, start, end, np.arange(len(start)) >= words, b"q:").dictionary_encode()
    code, rows, n = found.indices.to_numpy(zero_copy_only=False), len(off) - 1, len(found.dictionary)
    if rows * n <= CELLS:
        has = np.zeros(rows * n, bool)
        has[row * n + code] = True
        df = has.reshape(rows, n).sum(0)
    else:
        df = np.bincount(np.unique(row * n + code) % n, minlength=n)
    return pa.RecordBatch.from_arrays([found.dictionary, pa.array(df, pa.int64())], names=["token", "n"])


def counts(docs: DataFrame, norm: Column, tokens: Sequence[int] = DEFAULT_TOKENS, q_grams_words: bool = True) -> DataFrame:
    """token, df: in how many documents each of tokenize()'s tokens occurs; slices of texts are counted where they are, only their sums leave the worker."""
    ngrams, sizes = [-n for n in tokens if n < 0], [q for q in tokens if q > 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sp.slices(batch.column(0), COUNTED):
                yield _counted(part, ngrams, sizes, q_grams_words)

    return docs.select(F.coalesce(norm, F.lit("~"))).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("df"))
