"""License scans, Merkle manifests and collocations against brute-force versions, over odd rows, copies and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lumivec.llm import collocations, jaccard_join, license_scan, line_dedup, lm_score, merkle_manifest, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, g string, h string, block long, template long, word long, name string, path string, n long"
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def table(spark, rows):
    """rows: doc_id, text, lang; the other columns clash with the operators' own names."""
    return spark.createDataFrame([(i, t, k, None if i == 3 else f"s{i}", None if i == 4 else 7, 1, "x", "x", 2, 3, 4, "x", "x", 5) for i, t, k in rows], SCHEMA).repartition(3)


# ---------------------------------------------------------------- license scans

MIT, APACHE = license_scan.NOTICES[0][0], license_scan.NOTICES[1][0]


def license_rows():
    r = random.Random(1)
    prose = lambda n: " ".join(r.choices("the of and software license to in permission use copy x y z".split(), k=n))
    gap = MIT.split(" ")
    gap[20:20] = ["extra", "words"]
    del gap[40]
    return [
        (1, None, "en"), (2, "", None), (3, "MIT License, mit-license; Mit  License é", "en"), (4, "Licensed under the Apache License, Version 2.0.", "en"),
        (5, prose(50) + " " + " ".join(gap) + " " + prose(30), "en"), (6, APACHE.upper() * 2, "de"), (7, prose(4000), "en"), (7, prose(30), "en"), (7, prose(30) + " mit license", "en"),
        (8, MIT[:120], "en"), (9, "the gnu GENERAL PUBLIC LICENSE and mit license", "en"), (9, "the gnu GENERAL PUBLIC LICENSE and mit license", "en"), (None, "mit license", None),
        (10, "日本語 mit license", "ja"), (11, "mit " * 500 + "license", "en"), (12, "w" * 50000 + " mit license", "en"), (13, (MIT + "\n") * 30, "en"), *[(100 + k, "boilerplate " * (k % 3) + MIT, "en") for k in range(40)],
    ]


def test_license_base_is_every_place_of_a_phrase(spark):
    rows = license_rows()
    want = Counter()
    for i, t, _ in rows:
        w = ALNUM.findall(low(t or ""))
        places, labels = [], set()
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        want[(i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))] += 1
    got = license_scan.report(table(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == want
    for r in got:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def bands(text, template):
    """First word, found words and their share of every band: plain loops."""
    w, t, g, drift = ALNUM.findall(low(text or "")), ALNUM.findall(low(template)), license_scan.GRAM, license_scan.DRIFT
    where, first = defaultdict(list), {}
    for q in range(len(t) - g + 1):
        where[tuple(t[q : q + g])].append(q)
    votes = Counter()
    for p in range(len(w) - g + 1):
        for q in where.get(tuple(w[p : p + g]), ()):
            votes[p - q] += 1
            first.setdefault(p - q, p)
    near = {d: [x for x in range(d - drift, d + drift + 1) if x in votes] for d in votes}
    total = {d: sum(votes[x] for x in near[d]) for d in votes}
    for d in votes:
        if min(near[d], key=lambda x: (-total[x], x)) == d and total[d] >= max(1, -(-(len(t) - g + 1) // 4)):
            hits = sum(any(0 <= q + x < len(w) and w[q + x] == t[q] for x in near[d]) for q in range(len(t)))
            yield min(first[x] for x in near[d]), hits, hits / len(t)


def test_license_notices_equal_plain_loops(spark):
    rows = license_rows()
    want = []
    for i, t, _ in rows:
        joined = f" {' '.join(ALNUM.findall(low(t or '')))} "
        found = [(at, (hits, share), label) for notice, label in license_scan.NOTICES for at, hits, share in bands(t, notice) if share >= license_scan.MATCH]
        found = [(at, x[1], label) for at, x, label in found if x == max(y[1] for y in found if abs(at - y[0]) <= license_scan.SAME)]
        found += [(0, 1.0, label) for phrase, label in license_scan.PHRASES if f" {phrase} " in joined]
        want.append((i, ",".join(sorted({x[2] for x in found})), round(max([x[1] for x in found], default=0.0), 9)))
    got = license_scan.report(table(spark, rows)).select("doc_id", "labels", "score").collect()
    assert Counter((r["doc_id"], r["labels"], round(r["score"], 9)) for r in got) == Counter(want)
    by = {r["doc_id"]: r["labels"] for r in got}
    assert by[5] == "mit" and by[8] == "" and by[6] == "apache" and by[13] == "mit"


def test_every_notice_is_its_own_license(spark):
    rows = [(k, f"Copyright 2020\n{t}", "en") for k, (t, _) in enumerate(license_scan.NOTICES)]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.report(table(spark, rows)).collect()}
    for k, (_, label) in enumerate(license_scan.NOTICES):
        assert label in got[k][0].split(",") and got[k][1] == 1.0
        assert set(got[k][0].split(",")) - {label} <= set(filter(None, [r for p, r in license_scan.PHRASES if p in low(rows[k][1])]))


def test_license_sieve_changes_nothing_and_templates_are_the_callers(spark, monkeypatch):
    docs = table(spark, [(1, "a b c d e f g h", "en"), (2, "x a b c d q f g h", "en"), (3, "one two", None)])
    own = spark.createDataFrame([("A b c d e f g h", "abc", False), ("two", "two", True), ("two", "two", True), (None, "none", True), ("b c", "bc", None)], "text string, label string, phrase boolean")
    show = lambda df: sorted((r["doc_id"], tuple((s["label"], s["first"], s["last"], round(s["score"], 6)) for s in r["spans"])) for r in df.collect())
    first = show(license_scan.scan(docs, own))
    assert first[0] == (1, (("abc", 0, 7, 1.0),)) and first[2] == (3, (("two", 1, 1, 1.0),))
    monkeypatch.setattr(license_scan, "SIEVE_GRAMS", 0)
    assert show(license_scan.scan(docs, own)) == first
    assert license_scan.report(docs.limit(0)).count() == 0
    assert {r["labels"] for r in license_scan.scan(docs, own.limit(0)).select(F.size("spans").alias("labels")).collect()} == {0}


# ---------------------------------------------------------------- Merkle manifest

def written(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r, text):
    return sha("".join(written(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def tree(leaves):
    """Root, and the levels of siblings of every leaf: (before, after) lists."""
    paths, level, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(level) > 1:
        for k, p in enumerate(at):
            run = level[p // 8 * 8 : p // 8 * 8 + 8]
            paths[k].append((run[: p % 8], run[p % 8 + 1 :]))
        level = [sha("".join(level[k : k + 8])) for k in range(0, len(level), 8)]
        at = [p // 8 for p in at]
    return level[0], paths


def brute_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append(r)
    groups = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    found, tops = [], []
    for g in groups:
        each = sorted(by[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
        top, paths = tree([leaf_of(r, r["text"]) for r in each])
        tops.append(top)
        found.append((each, top, paths))
    root, upper = tree(tops)
    out = []
    for (each, top, paths), above in zip(found, upper):
        for r, path in zip(each, paths):
            h = own = leaf_of(r, r["text"])
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                h = leaf_of(r, low(r["text"]) if r["text"] is not None else None)
            proof = ""
            for before, after in path + above:
                proof += "".join(before + after)
                h = sha("".join(before) + h + "".join(after))
            out.append((r["doc_id"], own, top, root, sha(proof), h, h == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 8, 9, 700])
def test_merkle_manifest(spark, n):
    r = random.Random(n)
    rows = [(k, r.choice(["Text é " + str(k), "lower", "", None]), r.choice(["en", "en", "de", "z", None, "é", ""])) for k in range(n)]
    rows += [rows[0], (0, "other", rows[0][2]), (None, "x", "en"), (None, "y", "en"), (None, "x", "en")] * (n > 8)
    docs = table(spark, rows)
    got = merkle_manifest.report(docs).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute_manifest(docs.collect())


def test_merkle_many_groups_short_blocks_and_no_rows(spark):
    docs = table(spark, [(k, f"T{k}", f"l{k % 90}") for k in range(200)])
    want = brute_manifest(docs.collect())
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    proofs = merkle_manifest.verify(merkle_manifest.manifest(docs, tampered=F.when(third, merkle_manifest.lower_ascii(F.col("text"))), digits=1))
    got = proofs.select("doc_id", "leaf", "subroot", "root", merkle_manifest.proof_digest(F.col("path")).alias("p"), "folded_root", "verified").collect()
    assert sorted((tuple(x) for x in got), key=str) == want
    assert merkle_manifest.report(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- collocations

def brute_collocations(rows, top, least):
    f, n = defaultdict(Counter), Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(t or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, 5):
                for i in range(len(w) - size + 1):
                    f[lang][tuple(w[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in found.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inside[p[i : i + size]] = max(inside[p[i : i + size]], a)
        kept = []
        for p, a in found.items():
            if 100 * inside[p] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def collocation_rows():
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(25)] + ["é", "日本", "'s", "A-b"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    text = lambda n: "".join(w + r.choice([" "] * 8 + ["  ", "\t", ", ", ".\n", " ? ", "\x0b"]) for w in r.choices(vocabulary, weights, k=n))
    rows = [(k, text(r.randrange(1, 120)), r.choice(["en", "en", "de", None, "und"])) for k in range(150)]
    return rows + [(1, None, "en"), (2, "", None), (3, ".,;", "en"), (4, "one", "xx"), (5, text(6000), "en"), rows[0], rows[0], (None, "Same words again, same words again", "")] + [(9, "a b c d e f", "copy")] * 12


@pytest.mark.parametrize("least,budget,top", [(3, 500_000, 2000), (5, 40, 2000), (2, 3000, 7)])
def test_collocations(spark, least, budget, top):
    """Small budgets split prefixes and make many groups; a small top cuts through ties."""
    rows = collocation_rows()
    got = collocations.mine(table(spark, rows), top=top, least=least, budget=budget).collect()
    assert sorted(tuple(x) for x in got) == brute_collocations(rows, top, least)


def test_collocations_without_rows(spark):
    assert collocations.mine(table(spark, collocation_rows()).limit(0)).count() == 0
    assert collocations.mine(table(spark, [(1, "a b", "en"), (2, None, None)])).count() == 0


def test_collocation_scores_pass_64_bits(spark):
    found = spark.createDataFrame([(1, 9_000_000_000_000, [(1, 2, 3)], [])], "name long, f long, parts array<struct<k:int,first:long,rest:long>>, inner array<long>")
    counts = spark.createDataFrame([(2, 9_000_000_000_000), (3, 9_000_000_000_007)], "name long, f long")
    assert collocations.scored(found, counts).first()["score"] == 2_000_000 * 9_000_000_000_000 // 18_000_000_000_007


# ---------------------------------------------------------------- rows of one id

def equal_checksums(head, tail):
    """Two texts with equal crc32."""
    seen, r = {}, random.Random(1)
    for _ in range(600_000):
        t = f"{head}{r.getrandbits(64):016x}{tail}"
        c = zlib.crc32(t.encode())
        if c in seen:
            return seen[c], t
        seen[c] = t
    raise AssertionError("no pair found")


def test_rows_of_one_id_with_equal_checksums_keep_their_own_results(spark):
    lines = "alpha\nbeta\ngamma\n"
    a, b = equal_checksums("first\nsecond\n", "\nthird")
    docs = table(spark, [(1, lines + "x", "en"), (5, a + "\n" + lines, "en"), (5, b + "\n" + lines.replace("beta", "béta"), "en")])
    assert zlib.crc32(a.encode()) == zlib.crc32(b.encode())
    one, two = equal_checksums("q " * 120, " end")
    docs = table(spark, [(1, one, "en"), (5, one, "en"), (5, two + "", "en"), (None, one, "en"), (None, two, "en")])
    sizes = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in substring_dedup.report(docs).collect())
    alone = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in substring_dedup.report(table(spark, [(k, t, "en") for k, t in ((1, one), (5, one), (6, two), (7, one), (8, two))])).collect())
    assert [x[1:] for x in sizes] and sorted(x[1:] for x in sizes) == sorted(x[1:] for x in alone)

    c, d = equal_checksums("l1\nl2\nl3\nl4 ", "")
    cut = Counter((r["doc_id"], r["n_removed"]) for r in line_dedup.report(table(spark, [(1, c, "en"), (5, c, "en"), (5, d.replace("l1", "l1"), "en")])).collect())
    assert cut[(1, 0)] == 1 and sum(cut.values()) == 3

    words = " ".join(f"u{k}" for k in range(80))
    e, f = equal_checksums("n ", " " + " ".join(f"v{k}" for k in range(40)))
    near = f"{e} {words}", f"{f} " + " ".join(f"t{k}" for k in range(80))
    assert zlib.crc32(e.encode()) == zlib.crc32(f.encode())
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard_join.report(table(spark, [(5, e, "en"), (5, f, "en"), (7, e + " more", "en"), (8, near[1], "en")])).collect()}
    assert {v for (k, _), v in got.items() if k == 7} == {5} and {v for (k, _), v in got.items() if k == 8} == {8}

    scores = Counter((r["doc_id"], r["n_tokens"], r["n_known"]) for r in lm_score.score_documents(table(spark, [(5, e, "en"), (5, f, "en"), (7, e, "en"), (8, "n", "en"), (9, "v1 v2", "en")])).collect())
    assert sum(scores.values()) == 5


# ---------------------------------------------------------------- large groups

def test_light_members_of_a_large_group_stay_linear(spark, monkeypatch):
    """Texts of common words with up to 20 own ones: most link, and few pairs are made."""
    base, made = [f"w{k}" for k in range(84)], []
    kept = jaccard_join._filtered
    monkeypatch.setattr(jaccard_join, "_filtered", lambda pairs, sets: made.append(pairs.count()) or kept(pairs, sets))
    for n in (120, 240):
        r = random.Random(n)
        rows = [(k, " ".join(base + [f"x{r.randrange(10**9)}" for _ in range(k % 21)]), "en") for k in range(n)]
        assert {x["component_id"] for x in jaccard_join.report(table(spark, rows)).collect()} == {0}
    assert made[-1] <= 2.5 * made[0]


def test_copies_far_from_the_first_centre_make_few_pairs(spark, monkeypatch):
    """Near copies with many edits, most of them linked to the first text alone, over a third of them to nothing."""
    made, kept = [], jaccard_join._arrow

    def counted(df, fn, schema):
        if "head1_x" in df.columns:
            made.append(df.count())
        return kept(df, fn, schema)

    monkeypatch.setattr(jaccard_join, "_arrow", counted)
    r = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for k in range(240):
        w = list(base)
        for at in r.sample(range(150), r.choice([1, 2, 3, 4, 5, 6])):
            w[at] = f"x{k}y{at}"
        texts.append(" ".join(w))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split(" ") for t in texts)]
    links = [[j for j, t in enumerate(sets) if 100 * len(s & t) >= 75 * len(s | t)] for s in sets]
    label = list(range(len(sets)))
    while label != (new := [min(label[j] for j in of) for of in links]):
        label = new
    assert 10 < len(set(label)) and label.count(0) > 100
    assert {x["doc_id"]: x["component_id"] for x in jaccard_join.report(table(spark, [(k, t, "en") for k, t in enumerate(texts)])).collect()} == dict(enumerate(label))
    assert sum(made) <= 2 * len(texts)  # their differences to the median share little


def test_equal_parts_are_found_in_one_exchange(spark, monkeypatch):
    rows = [(k, 0, 0, k % 5, k % 3, 0, 300, 40) for k in range(60)]
    fields = "k_id long, k_hash long, k_crc long, core long, whole long, start long, stop long, anchor long"
    plan = substring_dedup._sorted_out(spark.createDataFrame(rows, fields))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    part = " ".join(f"w{k}" for k in range(90))
    docs = table(spark, [(k, f"{k} own {part[k:]} end {k}", "en") for k in range(6)])
    want = sorted(map(tuple, substring_dedup.report(docs).collect()))
    monkeypatch.setattr(substring_dedup, "BROADCAST_PLACES", 0)
    assert sorted(map(tuple, substring_dedup.report(docs).collect())) == want and all(r[2] > 100 for r in want)
