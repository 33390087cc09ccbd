"""Normalisation, tokens and segmentation on literals."""

import random
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumivec.functions import normalize as nz
from lumivec.functions import tokens as tk
from lumivec.operators import segment as sg
from lumivec.operators import vocabulary as voc


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "text string").select(f(F.col("text")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("u v🙋🏽 🎉🎉lo", "~u~v~e:🙋~e:🎉~e:🎉~lo~"),
        ("un🙋🏽!🎉;🎉 ABc", "~un~e:🙋~e:!~e:🎉~e:;~e:🎉~abc~"),
        ("", "~"),
        (None, "~"),
        ("Ñandú @ana https://a.b/c", "~nandu~e:_usr~e:_url~"),
    ],
)
def test_normalize(spark, text, want):
    assert value(spark, text, nz.normalize) == want


def test_one_pass_equals_the_steps(spark):
    """Symbols, emojis with their marks, placeholders, letters of many scripts, runs of separators; and lists of texts."""
    r = random.Random(8)
    parts = [*"ab_~ .¿¡!-@#<é ñ\t\n\r\x0b", "_usr", "_url", "_nu", "_num", "🎉", "🙋🏽", "❤️", "☀", "〽", "漢", "한국어", "각", "ǆ", "ﬁ", "Å̧", "İ", "ß", "\u200d", "https://x.y/z", "@me", "\u0323\u0307", "\u05b0\u0591"]
    texts = ["".join(r.choices(parts, k=r.choice([0, 1, 3, 40, 400]))) for _ in range(300)] + [None, "", "~", "\u200d"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    for o in (nz.TextOptions(), nz.TextOptions(del_diac=False), nz.TextOptions(lc=False, usr=None, url="delete", num="group", ent="group", emo="group")):
        both = rows.select("t", nz.normalize(F.col("t"), o).alias("a"), nz.normalize_by_steps(F.col("t"), o).alias("b"))
        for x in both.collect():
            assert x["a"] == x["b"], (x["t"], x["a"], x["b"])
    lists = spark.createDataFrame([(1, ["Á b", None, ""]), (2, []), (3, None), (4, texts[:20])], "i int, t array<string>")
    want = {x["t"]: x["a"] for x in rows.select("t", nz.normalize(F.col("t")).alias("a")).collect()}
    got = {x["i"]: x["a"] for x in lists.select("i", nz.normalize_texts(F.col("t")).alias("a")).collect()}
    assert got == {1: "~a~b~ ~ ~", 2: "", 3: None, 4: " ".join(want[t] for t in texts[:20])}
    assert lists.select("i", nz.normalize_texts(F.col("t"), nz.TextOptions(del_dup=True)).alias("a")).filter("i = 1").first()["a"] == "~a~b~ ~ ~"


def test_korean_and_other_scripts_decompose(spark):
    texts = ["한국어 각", "Å ﬁ ǆ Ǆ ḹ", "क़ और ড়", "Ελλάδα", "đ ø ł"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for x in rows.select("t", nz.strip_marks(F.col("t")).alias("a"), nz.decompose(F.col("t")).alias("d")).collect():
        nfd = unicodedata.normalize("NFD", x["t"])
        assert x["d"] == nfd and x["a"] == "".join(c for c in nfd if not 0x300 <= ord(c) < 0x370)


def test_options(spark):
    assert value(spark, "aa 12.5 bb", lambda c: nz.normalize(c, nz.TextOptions(num="group", del_dup=True))) == "~a~e:_num~b~"
    assert value(spark, "a.b", lambda c: nz.normalize(c, nz.TextOptions(del_punc=True, norm_punc=False))) == "~ab~"
    assert value(spark, "é", lambda c: nz.normalize(c, nz.TextOptions(del_diac=False))) == "~é~"
    with pytest.raises(ValueError):
        nz.TextOptions(norm_punc=False)
    with pytest.raises(ValueError):
        nz.TextOptions(norm_emojis=False)


def test_tokens(spark):
    def tokens(text, sizes, inside=True):
        return value(spark, text, lambda c: tk.tokenize(nz.normalize(c), sizes, inside))

    assert tokens("casa🙋🏽 🎉mar", [-1, 1]) == "casa e:🙋 e:🎉 mar q:~ q:c q:a q:s q:a q:~ q:~ q:m q:a q:r q:~".split()
    want = "q:~verde q:verde~ q:~una~c q:una~ca q:na~cas q:a~casa q:~casa~".split()
    assert tokens("verde🙋🏽una casa _num _usr", [6], False) == want
    assert tokens("año ñu", [-2, 2]) == ["ano~nu", "q:~a", "q:an", "q:no", "q:o~", "q:~n", "q:nu", "q:u~"]
    assert tokens("ab cd", [-1, -3]) == ["ab", "cd"]
    assert tokens("", [-1, -2, 2]) == []
    long = "x" * 300
    assert tokens(long, [4]) == ["q:" + f"~{long}~"[i : i + 4] for i in range(299)]


def test_token_list():
    assert tk.token_list("ja") == [1, 2, 3] and tk.token_list(None) == [-2, -1, 2, 3, 4] and tk.token_list("ja", [2, 1]) == [2, 1]


def segments(spark, text, vocabulary):
    voc = spark.createDataFrame([(t, 1) for t in vocabulary], "token string, df long")
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return sg.segment(docs, nz.normalize(F.col("text")), voc).first()["tokens"]


def test_segments(spark):
    base = ["verde", "casa", "grande", "e:.", "e:?", "e:,", "e:🎉"]
    assert segments(spark, "verde casa?., , 🎉grande", base) == "verde casa e:? e:. e:, e:, e:🎉 grande".split()
    assert segments(spark, "verde casa ?.,", [*base, "verde~casa", "e:?~e:."]) == ["verde~casa", "e:?~e:.", "e:,"]
    assert segments(spark, None, base) == []
    words = spark.createDataFrame([(w, 1) for w in ["é", "日本", "b"]], "token string, df long")
    rows = spark.createDataFrame([(1, "~é~b~"), (2, None), (3, ""), (4, "~日本~x~é~"), (5, "zz")], "doc_id long, norm string")
    for form in (sg.segment, sg.segment_by_joins):
        assert {r["doc_id"]: r["tokens"] for r in form(rows, F.col("norm"), words).collect()} == {1: ["é", "b"], 2: [], 3: [], 4: ["日本", "é"], 5: []}


def found(texts, known):
    names = sorted(known)
    return sg._Known(names, names).segments(pa.array(texts, pa.string()), False).to_pylist()


def test_segment_rules():
    assert found(["~ab~cd"], {"~ab~", "~ab~cdef", "cd"}) == [["~ab~"]]  # a match at the end of a walk ends the text
    assert found(["abcb"], {"abcd", "b"}) == [["b"]]  # walked-over characters are skipped
    assert found(["", None, "x"], {"abcd", "b"}) == [[], [], []] and found(["ab"], set()) == [[]]


def slow_spans(text, known):
    """The rules of segmentation, one at a time, over all prefixes as strings."""
    prefixes = {k[:n] for k in known for n in range(1, len(k) + 1)}
    out, start = [], 0
    while start < len(text):
        longest = max((n for n in range(len(text) - start + 1) if n == 0 or all(text[start : start + m] in prefixes for m in range(1, n + 1))), default=0)
        match = max((n for n in range(1, longest + 1) if text[start : start + n] in known), default=0)
        if match:
            out.append((start, start + match))
        if start + longest == len(text):
            break
        step = match or longest
        if step == 0:
            start += 1
        elif step >= 2 and text[start + step - 1] == "~":
            start += step - 1
        else:
            start += step
    return out


def test_listed_words_equal_the_walk():
    known = ["~ab~", "~abc~", "~é~", "~añb~", "~x~", "~ab.c~"]
    texts = ["", "~", "~~", "~ab~", "~ab~abc~x~", "ab~ab", "~abc", "~~ab~~é~", "x~añb~ab.c~añ~", "~ab~abx~éé~é~"]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    assert sg.Listed.fits(known) and not any(sg.Listed.fits([*known, k]) for k in ("~a~b~", "ab", "~~", "~e:", "~ab"))
    got, want = sg.Listed(known).segments(data, off), sg.segments(data, off, sg.Trie(known))
    assert len(want[0]) and got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def test_tokens_and_segments_leave_slice_by_slice(spark, monkeypatch):
    """An Arrow batch of the result is a slice, not all tokens of the batch that came in."""
    norm = pa.array(["~ab~cd~"] * 5000)
    one = tk._token_arrays(norm.slice(0, 1), [1], [2, 3], True)
    kept = []
    monkeypatch.setattr(tk.F, "arrow_udf", lambda f, kind: kept.append(f) or (lambda c: c))
    tk.tokenize(F.lit("x"), [-1, 2, 3])
    out = list(kept[0](iter([norm, norm.slice(0, 0), norm])))
    assert max(x.nbytes for x in out) < 8 * 1024 * 1024 and sum(map(len, out)) == 10000 and all(x[0].as_py() == one[0].as_py() for x in out)
    parts = list(sg._Known(["~ab~", "q"], ["ab", "q:q"]).parts(pa.array(["~ab~" * 50_000] * 50), True))
    assert len(parts) > 1 and sum(map(len, parts)) == 50


def test_counts_equal_document_frequencies(spark, monkeypatch):
    texts = ["~ab~ab~abc~", "~", None, "~e:.~ab~é~", "~ñu~abc~e:.~e:.~x~ab~"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, norm string")
    for kinds, inside in (([-1, 2, 3], True), ([-2, 4], False)):
        want = {r["token"]: r["df"] for r in voc.document_frequency(docs, tk.tokenize(F.col("norm"), kinds, inside)).collect()}
        counted = tk.counts(docs, F.col("norm"), kinds, inside)
        assert "Generate" not in counted._jdf.queryExecution().executedPlan().toString()
        assert {r["token"]: r["df"] for r in counted.collect()} == want
    one = tk._counted(pa.array(texts), [1], [2], True)
    monkeypatch.setattr(tk, "CELLS", 0)
    assert tk._counted(pa.array(texts), [1], [2], True).equals(one)


def test_segments_equal_the_rules(spark):
    r = random.Random(5)
    for _ in range(400):
        letters = r.choice(["ab~", "aé~è", "a日本~"])
        known = {"".join(r.choices(letters, k=r.randint(1, 5))) for _ in range(r.randint(1, 8))}
        texts = ["".join(r.choices(letters + "x", k=r.choice([0, 5, 30, 700]))) for _ in range(4)]
        assert found(texts, known) == [[t[a:b] for a, b in slow_spans(t, known)] for t in texts]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("norm", nz.normalize(F.col("text"))).filter(F.length("norm") < 1500).select("doc_id", "norm")
    first = voc.top_k(voc.document_frequency(docs, tk.tokenize(F.col("norm"), [-1, 2, 3])), 300)
    table = {x["surface"]: x["token"] for x in sg.surfaces(first).collect()}
    rows, counts = docs.collect(), Counter()
    got = {x["doc_id"]: x["tokens"] for x in sg.segment(docs, F.col("norm"), first).collect()}
    for x in rows:
        want = [table[x["norm"][a:b]] for a, b in slow_spans(x["norm"], table)]
        assert got[x["doc_id"]] == want
        counts.update(set(want))
    short = docs.filter(F.length("norm") < 300).withColumn("s", F.lit("clash"))
    joined = {x["doc_id"]: x["tokens"] for x in sg.segment_by_joins(short, F.col("norm"), first).collect()}
    assert len(joined) > 10 and all(got[k] == v for k, v in joined.items())
    second = sg.second_vocabulary(docs, F.col("norm"), first, 50)
    assert [(x["token"], x["df"]) for x in second.orderBy("token_id").collect()] == sorted(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:50])


def test_vocabulary_for_segments_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(sg, "MAX_SURFACES", 2)
    with pytest.raises(ValueError, match="at most 2"):
        sg.segmenter(sg.surfaces(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "token string, df long")))


def test_surfaces(spark):
    rows = spark.createDataFrame([("q:~a~", 1), ("a", 1), ("q:~e:~", 1), ("q:xy", 1)], "token string, df long")
    assert {(r["surface"], r["token"]) for r in sg.surfaces(rows).collect()} == {("~a~", "a"), ("~e:~", "q:~e:~"), ("xy", "q:xy"), ("~e:", "q:~e:~")}
