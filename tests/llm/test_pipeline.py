"""The pipeline: stages follow each other, equal a brute-force version, and stand odd rows and columns."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from lumivec.llm import jaccard_join, langid
from lumivec.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t)


def lines_cut(texts):
    """doc_id: text, without later occurrences of three-line windows; without what loses all its lines."""
    first, gone = {}, {}
    for i in sorted(texts):
        lines = (texts[i] or "").split("\n")
        for k in range(len(lines) - 2):
            key = tuple(lines[k : k + 3])
            if WORD.search(" ".join(key)) and first.setdefault(key, (i, k)) != (i, k):
                gone.setdefault(i, set()).update((k, k + 1, k + 2))
    out = {}
    for i, x in texts.items():
        lines = (x or "").split("\n")
        if i not in gone:
            out[i] = x
        elif len(gone[i]) < len(lines):
            out[i] = "\n".join(v for k, v in enumerate(lines) if k not in gone[i])
    return out


def one_of_each_group(texts):
    sets = {}
    for i, x in texts.items():
        w = WORD.findall(low(x or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: x for i, x in texts.items() if find(i) == i}


def clean_of(texts, items):
    windows = set()
    for x in items:
        w = ALNUM.findall(low(x or ""))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9)) if w}
    sizes = {len(k) for k in windows}

    def hit(x):
        w = ALNUM.findall(low(x or ""))
        return any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    return {i: x for i, x in texts.items() if not hit(x)}


def test_stages_equal_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    names = {r["doc_id"] for r in langid.keep_known(docs).collect()}
    want = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in names}
    steps = [want, want := lines_cut(want), want := one_of_each_group(want), want := clean_of(want, items)]
    for k, (name, stage) in enumerate(p.STAGES):
        out = f"{tmp_path}/{k}"
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        if k < 4:
            assert docs.columns == columns
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == steps[k], name
            assert docs.filter(F.col("n_chars") != F.length("text")).count() == 0
    assert [len(x) for x in steps] == sorted((len(x) for x in steps), reverse=True) and len(steps[2]) < len(steps[1])
    got = {r["doc_id"]: r for r in docs.collect()}
    assert set(got) == set(want)
    for i, x in want.items():
        ids = tokenizer.encode(x, add_special_tokens=False).ids
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(x.encode()).hexdigest()


def test_run_gives_one_row_a_document(spark):
    got = p.run(spark, SF)
    assert got.count() == got.select("doc_id").distinct().count() > 0


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ids without a value, and columns with the operators' own names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 40")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    rows += [rows[3], rows[3], (None, rows[5][1], "en"), (None, None, None), (900, None, "en"), (901, "", None), (902, " \n \t", "de"), (903, rows[6][1] * 60, None), (904, rows[7][1], "en")]
    own = ["n_removed", "n_lines", "runs", "row", "places", "k_id", "cls", "hits", "ids", "score", "held_out", "token", "text_", "block"]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for k, name in enumerate(own):
        table = table.withColumn(name, F.lit(None).cast("long") if k % 2 else F.lit(7).cast("long"))
    return table.repartition(4)


@pytest.mark.parametrize("k", range(5))
def test_stages_stand_odd_rows_and_columns(spark, odd, k):
    stage = p.STAGES[k][1]
    plain = stage(spark, odd.select("doc_id", "text", "lang"), SF)
    got = stage(spark, odd, SF)
    if k < 4:
        assert got.columns == odd.columns
        assert got.filter("n_removed = 7 and n_lines is null").count() == got.count()
    show = lambda df: sorted(map(str, df.select(*[c for c in plain.columns if c != "ids"]).collect()))
    assert show(got) == show(plain) and len(show(got)) <= odd.count()
    assert k in (0, 2) or len(show(got)) >= 40
    assert stage(spark, odd.limit(0), SF).count() == 0


def test_near_duplicates_of_one_row_are_kept_once(spark, odd):
    kept = [r["doc_id"] for r in jaccard_join.keep_one(odd).collect()]
    assert kept.count(3) == 1 and {900, 901, 902} <= set(kept) and 904 not in kept
