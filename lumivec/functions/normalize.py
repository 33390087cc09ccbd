"""Text normalisation as Column expressions.

The output has `~` as its only separator, before and after every word; special
items (symbols, emojis, placeholders) are `~e:...~`. Masks are built-in
expressions; decomposition and all that follows it go over the bytes of whole
Arrow columns at once (normalize), several times faster than one regular
expression a step (normalize_by_steps).
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import spans as sp

SLICE_BYTES = 1 << 20

# The symbols that count as punctuation, and the placeholders of grouped items.
SYMBOLS = ";:,.@\\-\"'/()[]¿?¡!{}<>|"
PLACEHOLDERS = ("_htag", "_ent", "_num", "_url", "_usr")

_CLASS = "[" + "".join("\\" + c for c in SYMBOLS if c not in "¿¡") + "¿¡]"
EMOJI = r"[\x{1F000}-\x{1F3FA}\x{1F400}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B05}-\x{2B55}\x{231A}-\x{23FF}\x{3030}\x{303D}\x{3297}\x{3299}]"
EMOJI_MARKS = r"[\x{1F3FB}-\x{1F3FF}\x{FE0F}\x{200D}]"


@dataclass(frozen=True)
class TextOptions:
    """How text is normalised; each option is none, `group` (a placeholder instead) or `delete`."""

    num: str | None = None
    usr: str | None = "group"
    url: str | None = "group"
    emo: str | None = None
    hashtag: str | None = None
    ent: str | None = None
    lc: bool = True
    del_dup: bool = False
    del_punc: bool = False
    del_diac: bool = True
    norm_emojis: bool = True
    norm_punc: bool = True

    def __post_init__(self):
        if not (self.norm_punc or self.del_punc):
            raise ValueError("either norm_punc or del_punc is needed")
        if self.norm_punc and not self.norm_emojis:
            raise ValueError("norm_punc needs norm_emojis")
        for name in ("num", "usr", "url", "emo", "hashtag", "ent"):
            if getattr(self, name) not in (None, "group", "delete"):
                raise ValueError(f"{name}: none, group or delete")


def masked(c: Column, pattern: str, option: str | None, placeholder: str) -> Column:
    if option is None:
        return c
    return F.regexp_replace(c, pattern, placeholder if option == "group" else "")


def lower(c: Column) -> Column:
    return F.lower(c)


def numbers(c: Column, option: str | None = "group") -> Column:
    return masked(c, r"\d+\.?\d+|\d+", option, "_num")


def users(c: Column, option: str | None = "group") -> Column:
    return masked(c, r"@\S+", option, "_usr")


def urls(c: Column, option: str | None = "group") -> Column:
    return masked(c, r"https?://\S+", option, "_url")


def hashtags(c: Column, option: str | None = "group") -> Column:
    return masked(c, r"#\S+", option, "_htag")


def entities(c: Column, option: str | None = "group") -> Column:
    """Capitalised words; has to come before lower()."""
    return masked(c, r"(?<![\p{L}\p{N}_])[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?![\p{L}\p{N}_])", option, "_ent")


def emoticons(c: Column, option: str | None = "delete") -> Column:
    """Delete emojis, or replace each by its class."""
    return masked(F.regexp_replace(c, EMOJI_MARKS, "") if option else c, EMOJI, option, "_emo")


_MARKS = re.compile("[\u0300-\u036f]+")


def _decomposed(column: pa.Array, drop_marks: bool) -> pa.Array:
    """NFD, if asked for without the marks; only texts beyond ASCII are touched."""
    column = column.cast(pa.string())
    other = pc.fill_null(pc.invert(pc.string_is_ascii(column)), False)
    at = pc.filter(pa.array(np.arange(len(column))), other)
    if not len(at):
        return column
    texts = [unicodedata.normalize("NFD", t) for t in column.take(at).to_pylist()]
    return pc.replace_with_mask(column, other, pa.array([_MARKS.sub("", t) for t in texts] if drop_marks else texts, pa.string()))


def strip_marks(c: Column) -> Column:
    """Decomposed (NFD) and without diacritics, by an Arrow function that passes over ASCII texts: Hangul gives its letters."""
    return F.arrow_udf(lambda column: _decomposed(column, True), "string")(c)


def decompose(c: Column) -> Column:
    """Unicode NFD, by an Arrow function: Spark has no such expression."""
    return F.arrow_udf(lambda column: _decomposed(column, False), "string")(c)


def collapse_repeats(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)(.)\1+", "$1")


def delete_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, _CLASS, "")


def mark_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, f"({_CLASS})", "~e:$1~")


def mark_emojis(c: Column) -> Column:
    """Each emoji as a special item, without skin tone and variation selectors."""
    return F.regexp_replace(F.regexp_replace(c, EMOJI_MARKS, ""), f"({EMOJI})", "~e:$1~")


def mark_placeholders(c: Column) -> Column:
    return F.regexp_replace(c, f"({'|'.join(PLACEHOLDERS)})", "~e:$1~")


def frame(c: Column) -> Column:
    """White space becomes `~`, and the text stands between two."""
    return F.concat(F.lit("~"), F.regexp_replace(c, "[ \t\r\n]", "~"), F.lit("~"))


def collapse_tildes(c: Column) -> Column:
    return F.regexp_replace(c, "~+", "~")


def _masked(c: Column, o: TextOptions) -> Column:
    c = F.coalesce(c, F.lit(""))
    c = entities(c, o.ent)
    c = lower(c) if o.lc else c
    c = numbers(hashtags(users(urls(c, o.url), o.usr), o.hashtag), o.num)
    return emoticons(c, o.emo)


def _steps(c: Column, o: TextOptions) -> Column:
    """All that follows decomposition."""
    c = collapse_repeats(c) if o.del_dup else c
    c = delete_punctuation(c) if o.del_punc else c
    c = mark_punctuation(c) if o.norm_punc and not o.del_punc else c
    c = mark_emojis(c) if o.norm_emojis else c
    return collapse_tildes(frame(mark_placeholders(c)))


def normalize_by_steps(c: Column, o: TextOptions = TextOptions()) -> Column:
    """All steps in order, each by itself; null and empty text give `~`."""
    c = _masked(c, o)
    return _steps(strip_marks(c) if o.del_diac else decompose(c), o)


def _passed(column: pa.Array, o: TextOptions) -> pa.Array:
    parts = [marked(*sp.utf8(_decomposed(part, o.del_diac)), o.norm_punc, o.norm_emojis) for part in sp.slices(column, SLICE_BYTES)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def normalize(c: Column, o: TextOptions = TextOptions()) -> Column:
    """What normalize_by_steps() gives: what needs regular expressions in Spark, the rest in one pass over the bytes."""
    if o.del_dup or o.del_punc:
        return normalize_by_steps(c, o)
    return F.arrow_udf(lambda column: _passed(column, o), "string")(_masked(c, o))


def _in_lists(column: pa.Array, fn) -> pa.Array:
    """fn over the strings of lists without nulls in them."""
    size = pc.list_value_length(column)
    first = np.concatenate(([0], np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False)))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(first), fn(column.flatten().cast(pa.string())))
    return pc.if_else(pc.is_null(size), pa.scalar(None, lists.type), lists)


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and code points of all characters of three and four bytes."""
    three, four = np.flatnonzero((data & 0xF0) == 0xE0), np.flatnonzero(data >= 0xF0)
    low = lambda at, k: (data[at + k] & 0x3F).astype(np.int32)
    of3 = (data[three] & 0x0F).astype(np.int32) << 12 | low(three, 1) << 6 | low(three, 2)
    of4 = (data[four] & 0x07).astype(np.int32) << 18 | low(four, 1) << 12 | low(four, 2) << 6 | low(four, 3)
    return np.concatenate((three, four)), np.concatenate((of3, of4))


def _within(code: np.ndarray, ranges: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(len(code), bool)
    for a, z in ranges:
        out |= (code >= a) & (code <= z)
    return out


def _ranges(pattern: str) -> list[tuple[int, int]]:
    """Of a character class written with code points."""
    return [(int(a, 16), int(z or a, 16)) for a, z in re.findall(r"\\x\{(\w+)\}(?:-\\x\{(\w+)\})?", pattern)]


_EMOJI_RANGES, _MARK_RANGES = _ranges(EMOJI), _ranges(EMOJI_MARKS)
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS if ord(c) < 128])
_SPACE = np.isin(np.arange(256), [ord(c) for c in " \t\r\n"])
_TILDE = ord("~")


def marked(data: np.ndarray, off: np.ndarray, punctuation: bool = True, emojis: bool = True) -> pa.Array:
    """Texts (their bytes and offsets) with symbols, emojis and placeholders as special items, framed, white space and runs of `~` as one `~`."""
    places, code = _code_points(data)
    if emojis and len(places):
        gone = _within(code, _MARK_RANGES)
        if gone.any():
            keep = np.ones(len(data), bool)
            for k in range(4):
                keep[places[gone & ((code >= 0x10000) | (k < 3))] + k] = False
            off = np.concatenate(([0], np.cumsum(keep)))[off]
            data = data[keep]
            places, code = _code_points(data)
    starts, sizes = [], []
    if punctuation:
        at = np.flatnonzero(_SYMBOL[data])
        starts.append(at), sizes.append(np.full(len(at), 1))
        at = np.flatnonzero(data[:-1] == 0xC2)
        at = at[(data[at + 1] == 0xBF) | (data[at + 1] == 0xA1)]
        starts.append(at), sizes.append(np.full(len(at), 2))
    if emojis and len(places):
        own = _within(code, _EMOJI_RANGES)
        starts.append(places[own]), sizes.append(np.where(code[own] < 0x10000, 3, 4))
    line = np.flatnonzero(data == ord("_"))
    if len(line):
        end = off[np.searchsorted(off, line, "right")]
        padded = np.append(data, np.zeros(8, np.uint8))
        for name in PLACEHOLDERS:
            same = line + len(name) <= end
            for k, c in enumerate(name.encode()):
                same &= padded[line + k] == c
            starts.append(line[same]), sizes.append(np.full(int(same.sum()), len(name)))
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    last = start + (np.concatenate(sizes) if sizes else start) - 1

    # every byte's place in the output, which is `~` where nothing is put
    grow = np.ones(len(data), np.int64)
    grow[start] += 3
    grow[last] += 1
    rows = len(off) - 1
    to = np.cumsum(grow) - grow + np.repeat(2 * np.arange(rows) + 1, np.diff(off))
    begin = np.concatenate(([0], np.cumsum(grow)))[off] + 2 * np.arange(rows + 1)
    out = np.full(int(begin[-1]), _TILDE, np.uint8)
    out[to[start] + 1], out[to[start] + 2] = ord("e"), ord(":")
    to[start] += 3
    out[to] = np.where(_SPACE[data], _TILDE, data)
    tilde = out == _TILDE
    keep = np.ones(len(out), bool)
    keep[1:] = ~(tilde[1:] & tilde[:-1])
    keep[begin[:-1]] = True
    first = np.concatenate(([0], np.cumsum(keep)))[begin]
    return pa.StringArray.from_buffers(rows, pa.py_buffer(first.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(out[keep])))


def normalize_texts(texts: Column, o: TextOptions = TextOptions()) -> Column:
    """A document of several texts: each is normalised, one space between them; null for a null list."""
    each = F.transform(texts, lambda t: _masked(t, o))
    lists = lambda fn: F.arrow_udf(lambda column: _in_lists(column, fn), "array<string>")(each)
    if o.del_dup or o.del_punc:
        return F.array_join(F.transform(lists(lambda v: _decomposed(v, o.del_diac)), lambda t: _steps(t, o)), " ")
    return F.array_join(lists(lambda v: _passed(v, o)), " ")
