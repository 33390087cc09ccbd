"""Byte-level BPE encoding and decoding with a given public vocabulary.

A short word is a contiguous array of parts with the ranks of adjacent pairs
beside it: scan for the lowest rank, delete the boundary it stands for, refresh
the two neighbouring ranks, and go on until no pair has a rank. Words of more
than LONG bytes take the same steps as numpy passes, all places of the lowest
pair at once. Both are map-only: no shuffle, and memory is bounded by the batch,
the longest text and CACHE_BYTES of remembered words.

Defined results: a null text is encoded as the empty text (no ids, and the
digests of the empty string); every row gives one row, repeated rows and null
ids included.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._common import id_text, map_arrow, texts

CACHE_BYTES = 40 << 20  # of remembered words and ids, in each of two generations
LONG = 200
_NONE = 1 << 62

# The byte-level pre-tokenisation pattern that vocabularies of this kind are made for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Codec:
    """Encoder and decoder of one tokenizer file (BPE with byte-level pieces, no normaliser)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("normalizer") or any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: only plain byte-level BPE is supported")
        for key, plain in (("ignore_merges", False), ("byte_fallback", False), ("dropout", None), ("fuse_unk", False), ("continuing_subword_prefix", None), ("end_of_word_suffix", None)):
            if (model.get(key) or plain) != plain:
                raise ValueError(f"{path}: {key} is not supported")
        before, after = spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space", True) or not before.get("use_regex", True) or after.get("type") != "ByteLevel":
            raise ValueError(f"{path}: only byte-level pieces by the usual pattern, without a space before the text, are supported")
        vocab, letters = model["vocab"], byte_letters()
        self.byte_ids = [vocab[c] for c in letters]
        byte_of = {c: b for b, c in enumerate(letters)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(key)
        self.keys = key[order]  # pairs of parts, ascending; their ranks and what they become beside them
        self.ranks = order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)[order]
        self.once = len(np.unique(self.made)) == len(merges) == len(np.unique(key))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = {str(i): bytes(byte_of[c] for c in t) for t, i in vocab.items() if all(c in byte_of for c in t)}
        self.pieces |= {str(i): t.encode() for t, i in self.added.items()}

    def ready(self) -> None:
        """What a worker builds once for itself: ranks by pair, one integer each."""
        self.words = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.pair = dict(zip(self.keys.tolist(), (self.ranks << 32 | self.made).tolist()))
        self.seen: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.room = CACHE_BYTES

    def short(self, parts: list[int]) -> list[int]:
        get = self.pair.get
        ranks = [get(a << 32 | b, _NONE) for a, b in zip(parts, parts[1:])]  # a pair's rank, and below it what it becomes
        while ranks:
            low = min(ranks)
            if low == _NONE:
                break
            i = ranks.index(low)
            parts[i] = made = low & 0xFFFFFFFF
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | made, _NONE)
            if i < len(ranks):
                ranks[i] = get(made << 32 | parts[i + 1], _NONE)
        return parts

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE), self.made[at]

    def long(self, ids: np.ndarray) -> np.ndarray:
        """As short(), for a long word: a rank's places go in one pass, of overlapping ones every second from the left."""
        ranks, _ = self._look(ids[:-1], ids[1:])
        while len(ranks) and (low := ranks.min()) < _NONE:
            at = np.flatnonzero(ranks == low)
            fresh = np.concatenate(([True], np.diff(at) != 1))
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            ids[at] = self._look(ids[at], ids[at + 1])[1]
            ids = np.delete(ids, at + 1)
            ranks = np.delete(ranks, at)
            now = at - np.arange(len(at))
            for i in (now - 1, now):
                i = i[(i >= 0) & (i < len(ranks))]
                ranks[i] = self._look(ids[i], ids[i + 1])[0]
        return ids

    def word(self, word: str) -> str:
        """A word's ids, decimal and joined by commas."""
        raw = word.encode("utf-8", "replace")
        parts = [self.byte_ids[b] for b in raw]
        if len(parts) > LONG and self.once and len(self.keys):
            return ",".join(map(str, self.long(np.array(parts, np.int64)).tolist()))
        return ",".join(map(str, self.short(parts)))

    def keep(self, word: str) -> str:
        ids = self.older.get(word) or self.word(word)
        self.room -= len(word) + len(ids) + 200
        if self.room < 0:  # the words of the generation before last are forgotten
            self.older, self.seen, self.room = self.seen, {}, CACHE_BYTES
        if len(word) <= LONG:
            self.seen[word] = ids
        return ids

    def encode(self, text: str) -> str:
        out: list[str] = []
        for piece in self.split.split(text) if self.split else [text]:
            if piece in self.added:
                out.append(str(self.added[piece]))
                continue
            found = self.words.findall(piece)
            ids = list(map(self.seen.get, found))
            if None in ids:
                ids = [i or self.seen.get(w) or self.keep(w) for w, i in zip(found, ids)]
            out += ids
        return ",".join(out)

    def decode(self, ids: str) -> str:
        return b"".join(map(self.pieces.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


def _sha(x: str) -> str:
    return hashlib.sha256(x.encode("utf-8", "replace")).hexdigest()


def encode_documents(docs: DataFrame, tokenizer_path: str, with_text: bool = True) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded text, ids (array<int>) and, if asked for, the decoded text."""
    return _encoded(docs, tokenizer_path, True, with_text)


def digest_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens and the digests only: what a comparison needs."""
    return _encoded(docs, tokenizer_path, False, False)


def _encoded(docs: DataFrame, path: str, with_ids: bool, with_text: bool) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Codec(path))  # its size is the vocabulary file's

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = shared.value
        if not hasattr(codec, "words"):
            codec.ready()
        rows = {"doc_id": batch.column("doc_id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        ids_col, text_col = [], []
        for text in texts(batch):
            ids = codec.encode(text)
            decoded = codec.decode(ids)
            rows["n_tokens"].append(ids.count(",") + 1 if ids else 0)
            rows["ids_sha256"].append(_sha(ids))
            rows["decoded_sha256"].append(_sha(decoded))
            if with_ids:
                ids_col.append(np.fromstring(ids, np.int32, sep=","))
            if with_text:
                text_col.append(decoded)
        out = {k: v if k == "doc_id" else pa.array(v, pa.int64() if k == "n_tokens" else pa.string()) for k, v in rows.items()}
        if with_ids:
            out["ids"] = pa.array(ids_col, pa.list_(pa.int32()))
        if with_text:
            out["decoded"] = pa.array(text_col, pa.string())
        return pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text
    return map_arrow(id_text(docs), run, schema)
