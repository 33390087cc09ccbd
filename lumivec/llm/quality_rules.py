"""Repetition rules: rolling hashes of several n-gram lengths.

For every text: how many of its word characters lie inside word n-grams that
occur more than once in it, for each length of NGRAM_LIMITS, and inside lines
that repeat an earlier line. Everything is computed over the whole text by numpy
passes on slices of documents; the job is map-only.

Defined results: null and empty texts have no words, so base_failed is true and
kept false; repeated rows are judged one by one; a share equal to its limit
passes; lines are compared byte by byte. A text is held whole, at about 60 bytes
a word beside it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import SPACE, covered, gram_hash, id_text, long_array, map_arrow, mix, row_starts, span_hash, utf8, words

# Largest share of word characters inside duplicated n-grams, by n, and inside repeated lines: twice (for lines one and a half times)
# the limits of a published rule set, whose own values also reject good short texts with one repeated line.
NGRAM_LIMITS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
LINE_LIMIT = 0.30
MIN_WORDS = 20
BASE_WINDOW = 8

_B = np.arange(256)
NEWLINE = _B == 10
SYMBOL = np.isin(_B, [ord(c) for c in "#*$%&|<>"])


def _sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
    return total[off[1:]] - total[off[:-1]]


def repeated(values: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    s = np.sort(values)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(values), bool)
    return twice[np.minimum(np.searchsorted(twice, values), len(twice) - 1)] == values


def repeated_words(h: np.ndarray, off: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-word window that its row has more than once."""
    at, row = row_starts(off, n)
    if not len(at):
        return np.zeros(len(h), bool)
    grams = gram_hash(h, n)[at] ^ mix(row + 1)
    return covered(len(h), at[repeated(grams)], n)


def later_lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines with a word: starts, ends, rows' offsets, and which equal an earlier line of their row."""
    starts, ends, _ = words(data, off, NEWLINE)
    solid = np.concatenate(([0], np.cumsum(~SPACE[data])))
    some = solid[ends] > solid[starts]
    starts, ends = starts[some], ends[some]
    first = np.searchsorted(starts, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    key = span_hash(data, starts, ends) ^ mix(row + 1)
    later = np.zeros(len(starts), bool)
    dup = np.flatnonzero(repeated(key))
    if len(dup):
        _, one = np.unique(key[dup], return_index=True)
        later[dup] = True
        later[dup[one]] = False
    return starts, ends, first, later, row


def measure(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    data, off = utf8(batch)
    starts, ends, first = words(data, off, SPACE)
    h = span_hash(data, starts, ends)
    lead = (data & 0xC0) != 0x80  # one for each code point
    chars = lead & ~SPACE[data]
    before = np.concatenate(([0], np.cumsum(chars)))
    word_len = before[ends] - before[starts]
    out = {"n_words": np.diff(first), "word_chars": _sums(chars, off), "n_symbols": _sums(SYMBOL[data], off)}
    ls, le, lf, later, _ = later_lines(data, off)
    out["n_dup_lines"] = _sums(later, lf)
    base = repeated_words(h, first, BASE_WINDOW)
    out["n_repeat_words"] = _sums(base, first)
    total = np.maximum(out["word_chars"], 1)
    out["line_share"] = _sums((before[le] - before[ls]) * later, lf) / total
    for n in NGRAM_LIMITS:
        mask = base if n == BASE_WINDOW else repeated_words(h, first, n)
        out[f"share_{n}"] = _sums(word_len * mask, first) / total
    return out


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and verdict, the shares measured, and kept."""
    shares = ["line_share", *(f"share_{n}" for n in NGRAM_LIMITS)]
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = measure(batch)
        failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
        kept = ~failed & (m["line_share"] <= LINE_LIMIT)
        for n, limit in NGRAM_LIMITS.items():
            kept &= m[f"share_{n}"] <= limit
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(long_array(m[c]) for c in counts), pa.array(failed), pa.array(kept), *(pa.array(np.round(m[c], 6)) for c in shares)],
            names=["doc_id", *counts, "base_failed", "kept", *shares],
        )

    schema = "doc_id long, " + "".join(f"{c} long, " for c in counts) + "base_failed boolean, kept boolean, " + ", ".join(f"{c} double" for c in shares)
    return map_arrow(id_text(docs), run, schema)
