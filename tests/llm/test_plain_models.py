"""Models of the operators against plain single-process versions: the same sums as one loop or one matrix."""

import random
import zlib
from collections import Counter

import numpy as np

from lumivec.llm import langid, quality_model


def prose(r, parts, n):
    return " ".join("".join(r.choices(parts, k=r.randint(1, 3))) for _ in range(n))


def held(i, k):
    return None if i is None else zlib.crc32(str(i).encode()) % k


def plain_vector(text, dims):
    """Trigram counts in a dictionary, letters' vectors multiplied and added one by one."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    letters = f" {' '.join(letters.split())} " if letters.split() else ""
    total = np.zeros(dims)
    vector = lambda c: langid.letter_vectors(np.array([ord(c)]), dims)[0].astype(float)
    for gram, n in Counter(letters[i : i + 3] for i in range(len(letters) - 2)).items():
        total += n * np.roll(vector(gram[0]), 2) * np.roll(vector(gram[1]), 1) * vector(gram[2])
    return total / max(np.linalg.norm(total), 1e-9)


def test_language_profiles_equal_plain_loops(spark):
    r = random.Random(2)
    parts = {"en": "the of and ing tion er st".split(), "de": "der und sch ung ein ver tz".split(), "fr": "le de ent aux ique ér ç".split()}
    rows = [(k, prose(r, parts[lang], r.randint(1, 25)), lang if k % 9 else None) for k, lang in enumerate(r.choices(list(parts), k=90))]
    rows += [(200, "a", "en"), (201, "12 !", "de"), (202, None, "fr"), (203, "", None), (None, "der und", "de")]
    dims = langid.DIMS
    vectors = [plain_vector(t or "", dims) for _, t, _ in rows]
    names = sorted(parts)
    prototypes = []
    for lang in names:
        total = sum(v for v, (i, _, known) in zip(vectors, rows) if known == lang and held(i, 4) not in (2, None))
        prototypes.append(total / np.linalg.norm(total))
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    by = {x["doc_id"]: x for x in got}
    for (i, t, _), v in zip(rows, vectors):
        if not v.any():
            assert by[i]["lang_pred"] == "und" and by[i]["score"] == 0
            continue
        cosine = np.array([v @ p for p in prototypes])
        assert abs(by[i]["score"] - min(max(cosine.max(), 0), 1)) < 1e-4
        if np.sort(cosine)[-1] - np.sort(cosine)[-2] > 1e-4:
            assert by[i]["lang_pred"] == names[int(cosine.argmax())]
        assert by[i]["held_out"] == (held(i, 4) == 2)


def plain_isotonic(x, n, y):
    """Rising steps by merging neighbours that fall, over and over."""
    steps = [[a * b, b, c] for a, b, c in zip(x, n, y)]
    k = 0
    while k + 1 < len(steps):
        if steps[k][2] / steps[k][1] >= steps[k + 1][2] / steps[k + 1][1]:
            steps[k : k + 2] = [[a + b for a, b in zip(steps[k], steps[k + 1])]]
            k = max(0, k - 1)
        else:
            k += 1
    return [s[0] / s[1] for s in steps], [(s[2] + 0.5 * s[2] / s[1]) / (s[1] + 0.5) for s in steps]


def test_quality_scores_equal_one_matrix(spark):
    r = random.Random(3)
    good, bad = "the of and ing tion er st".split(), ["$$", "#", "xx", "!!"]
    rows = [(k, prose(r, good if k % 3 else bad, r.randint(1, 40))) for k in range(160)] + [(400, None), (401, "")]
    labels = [(k, int(k % 3 > 0) if r.random() < 0.9 else int(k % 3 == 0)) for k in range(0, 150)] + [(500, 1), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    given = spark.createDataFrame(labels, "doc_id long, quality int")
    x = {q["doc_id"]: np.array(q["x"]) for q in quality_model.statistics_table(docs).collect()}
    known = [(i, y) for i, y in labels if y is not None and i in x and held(i, 3) != 1]
    part = {q["doc_id"]: q["p"] for q in spark.createDataFrame([(i,) for i, _ in known], "doc_id long").selectExpr("doc_id", "pmod(xxhash64(doc_id, 5), 5) AS p").collect()}
    all_x = np.array([x[i] for i, _ in known])
    features = quality_model.Features(all_x.mean(0), all_x.std(0, ddof=1))
    fit = [(features(x[i][None])[0], y) for i, y in known if part[i] > 0]
    z, y = np.array([a for a, _ in fit]), np.array([b for _, b in fit], float)
    beta = np.linalg.solve(z.T @ z + quality_model.RIDGE * np.eye(z.shape[1]), z.T @ y)
    raw = {i: float(features(v[None])[0] @ beta) for i, v in x.items()}
    bins = Counter()
    hits = Counter()
    for i, label in known:
        if part[i] == 0:
            b = float(np.rint(np.clip(raw[i], -0.5, 1.5) * (quality_model.BINS / 2)))
            bins[b] += 1
            hits[b] += label
    places = sorted(bins)
    px, py = plain_isotonic([b / (quality_model.BINS / 2) for b in places], [bins[b] for b in places], [hits[b] for b in places])
    for q in quality_model.classify(docs, given).collect():
        v = raw[q["doc_id"]]
        want = min(max(0.98 * float(np.interp(v, px, py)) + 0.02 / (1 + np.exp(-4 * (v - 0.5))), 0), 1)
        assert abs(q["score"] - want) < 2e-3 and q["predicted"] == int(q["score"] >= 0.5) and q["held_out"] == (held(q["doc_id"], 3) == 1)
