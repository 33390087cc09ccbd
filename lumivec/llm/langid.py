"""Language identification with hyperdimensional profiles.

Every letter has a fixed pseudo-random vector of +1 and -1. A trigram's vector
binds (multiplies) its letters' vectors, permuted (rotated) by their place; a
document's vector bundles (adds) its trigrams; a language's prototype bundles
the unit vectors of its training documents. A text gets the language of the
nearest prototype by cosine, and that cosine as its score.

Training reads about `fit_rows` labelled rows (a documented bound for fitting
only), shared out by language: a rare language gives all its rows, the others
an even share of what is left, chosen by a hash of the id, and each the row
with the least hash at any rate. So every language that labels a text with a
letter has a prototype at every size. Every text is predicted whole. One pass
adds up prototypes inside each partition, and Spark sums them; only languages x
DIMS numbers reach the driver.

Defined results: `und` with score 0 for a text that is null or has no letter,
and for all texts when nothing can be learned; of equally near prototypes the
first in alphabetical order wins; each row is judged by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import _U, fold, map_arrow, mix, texts

DIMS = 1024
FIT_ROWS = 20_000
_SCALE = 1 << 20
CHUNK, GRAMS, SOME = 1 << 20, 1 << 13, 1 << 10  # characters, trigrams and vectors that one numpy pass holds
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def letter_vectors(codes: np.ndarray, dims: int) -> np.ndarray:
    """The vector of each code point: bits of a hash of the code and the dimension."""
    block = np.arange(dims // 64, dtype=_U)
    bits = mix((codes.astype(_U)[:, None] << _U(16)) + block + _U(0x5851F42D4C957F2D))
    return (np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * 2 - 1)[:, :dims]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams (as integers of three code points) of the letters of a text, and their counts."""
    low = text.lower()
    tail, found, counts = np.array([32]), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(low), CHUNK):
        code = np.frombuffer(low[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        code = np.concatenate((tail, np.where(_is_letter()[code], code, 32), [32] if at + CHUNK >= len(low) else []))
        code = code[np.concatenate(([True], (code[1:] != 32) | (code[:-1] != 32)))].astype(np.int64)
        tail = code[-2:]
        grams, n = np.unique(code[:-2] << 42 | code[1:-1] << 21 | code[2:], return_counts=True)
        found.append(grams)
        counts.append(n)
    if len(found) <= 2:
        return found[-1], counts[-1]
    grams, at = np.unique(np.concatenate(found), return_inverse=True)
    return grams, np.bincount(at, np.concatenate(counts), len(grams)).astype(np.int64)


def trigram_vectors(grams: np.ndarray, dims: int) -> np.ndarray:
    low = (1 << 21) - 1
    part = np.stack((grams >> 42, grams >> 21 & low, grams & low))
    codes, at = np.unique(part, return_inverse=True)
    v = letter_vectors(codes, dims)
    first, second, third = at.reshape(part.shape)
    out = np.roll(v, 2, 1)[first]
    out *= np.roll(v, 1, 1)[second]
    out *= v[third]
    return out


def document_vectors(batch_texts: list[str], dims: int = DIMS):
    """The unit vector of each text; zero where there is no letter. Memory: GRAMS vectors of one byte a dimension."""
    found = [trigrams(t) for t in batch_texts]
    grams = np.unique(np.concatenate([g for g, _ in found])) if found else np.zeros(0, np.int64)
    out = np.zeros((len(found), dims), np.float32)
    for at in range(0, len(grams), GRAMS):
        block = grams[at : at + GRAMS]
        vectors = trigram_vectors(block, dims)
        for i, (g, n) in enumerate(found):
            a, z = np.searchsorted(g, block[0]), np.searchsorted(g, block[-1], "right")
            for k in range(a, z, SOME):
                some = slice(k, min(k + SOME, z))
                out[i] += n[some].astype(np.float32) @ vectors[np.searchsorted(block, g[some])].astype(np.float32)
    norm = np.sqrt(np.einsum("ij,ij->i", out, out, dtype=np.float64))
    return out / np.maximum(norm, 1e-9).astype(np.float32)[:, None]


def shares(counts: dict[str, int], fit_rows: int) -> dict[str, int]:
    """Rows to read of each language: all of the rare ones, an even share of the rest for the others, one at least."""
    left, out = fit_rows, {}
    for k, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, max(1, left // (len(counts) - k)))
        left -= out[lang]
    return out


def fit_sample(train: DataFrame, fit_rows: int) -> DataFrame | None:
    """About fit_rows of the rows that have a language and a letter, of each language about its share; None without any."""
    train = train.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(17)), 1)
    counts = {r["lang"]: (r["n"], r["least"]) for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("least")).collect()}
    if not counts:
        return None
    if sum(n for n, _ in counts.values()) <= fit_rows:
        return train
    upto = [(k, max(counts[k][1], (s << 63) // counts[k][0] - 1)) for k, s in shares({k: n for k, (n, _) in counts.items()}, fit_rows).items()]
    limits = train.sparkSession.createDataFrame(upto, "lang string, upto long")
    return train.join(F.broadcast(limits), "lang").filter(order <= F.col("upto"))


def fit(train: DataFrame, dims: int = DIMS, fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes from (doc_id, text, lang); about fit_rows rows are read as text."""
    train = fit_sample(train, fit_rows)
    if train is None:
        return [], np.zeros((0, dims), np.float32)

    def sums(batch: pa.RecordBatch):
        v = document_vectors(texts(batch), dims)
        langs = batch.column("lang").to_pylist()
        names = sorted(set(langs))
        where = np.array([names.index(x) for x in langs])
        total = [np.rint(v[where == k].astype(np.float64) * _SCALE).astype(np.int64).sum(0) for k in range(len(names))]
        return pa.RecordBatch.from_pydict({"lang": names, "v": pa.array(total, pa.list_(pa.int64()))})

    parts = map_arrow(train.select("doc_id", "text", "lang"), sums, "lang string, v array<long>")
    rows = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).collect()
    rows = sorted((r["lang"], np.array([x["x"] for x in r["v"]], np.float64)) for r in rows)
    rows = [(k, v / np.sqrt(v @ v)) for k, v in rows if v.any()]
    return [k for k, _ in rows], np.array([v for _, v in rows], np.float32).reshape(len(rows), dims)


def predict_batch(batch: pa.RecordBatch, langs: list[str], prototypes: np.ndarray) -> tuple[list[str], np.ndarray]:
    v = document_vectors(texts(batch), prototypes.shape[1])
    if not langs:
        return ["und"] * len(v), np.zeros(len(v))
    cosine = v @ prototypes.T
    best = cosine.argmax(1)
    some = v.any(1)
    score = np.where(some, np.clip(cosine[np.arange(len(v)), best], 0, 1), 0).astype(np.float64)
    return [langs[k] if ok else "und" for k, ok in zip(best, some)], np.round(score, 6)


def learn(docs: DataFrame, held_out: int = 2, k: int = 4, fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    return fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter(fold("doc_id", k) != held_out), fit_rows=fit_rows)


def identify(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    langs, prototypes = learn(docs, fit_rows=fit_rows)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, score = predict_batch(batch, langs, prototypes)
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array(names, pa.string()), "score": score})

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text")
    return map_arrow(source, run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, min_score: float = 0.1, evidence: int = 50, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows, with all their columns, that may be in a learned language.

    Rejected are texts without a letter (`und`) and texts of at least `evidence`
    distinct trigrams whose best cosine is under min_score. Cosines with
    unrelated prototypes scatter around 0 by 1/sqrt(DIMS), about 0.03, and long
    texts of a learned language have 0.5 or more; a text of a few words shows
    too little to be rejected. Without anything to learn from, only texts
    without letters go.
    """
    langs, prototypes = learn(docs, fit_rows=fit_rows)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        all_texts = texts(batch)
        distinct = np.array([len(trigrams(t)[0]) for t in all_texts])
        if not langs:
            return batch.filter(pa.array(distinct > 0))
        names, score = predict_batch(batch, langs, prototypes)
        ok = (np.array(names) != "und") & ((score >= min_score) | (distinct < evidence))
        return batch.filter(pa.array(ok))

    return map_arrow(docs, run, docs.schema)
