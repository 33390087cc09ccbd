"""Vocabulary, sampling, training, embedding, curation and sources on small tables."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumivec.functions import tokens as tk
from lumivec.operators import classify, curate, embed, identity, labels, positions, sampling, tailored, train, vectorize, vocabulary
from lumivec.operators import vocabulary as vocabulary_
from lumivec.sources import corpus
from lumivec.streaming import near
from lumivec.streaming import text as st


def test_quotas(spark):
    def quotas(available, n):
        t = spark.createDataFrame([(str(k), a) for k, a in enumerate(available)], "stratum string, available long")
        return [r["quota"] for r in sampling.uniform_quotas(t, n).orderBy("stratum").collect()]

    assert quotas([700, 90, 30], 400) == [280, 90, 30]
    assert sum(quotas([25, 6, 3, 9], 12)) == 12
    assert quotas([3, 4], 100) == [3, 4]


def test_ids_are_dense_and_ordered(spark):
    words = [f"w{k:04d}" for k in range(500)]
    t = spark.createDataFrame([(w, k % 7) for k, w in enumerate(words)], "token string, df long").repartition(7)
    assert [r["token"] for r in vocabulary.with_ids(t).orderBy("token_id").collect()] == words
    rows = vocabulary.with_ids(t, "df").orderBy("token_id").collect()
    assert [r["token_id"] for r in rows] == list(range(500))
    assert [(-r["df"], r["token"]) for r in rows] == sorted((-r["df"], r["token"]) for r in rows)


def test_labels(spark):
    t = spark.createDataFrame([(1, ["b", "a", "b"], None), (2, ["c"], " x  y "), (3, [], None), (4, ["z"], "")], "doc_id long, w array<string>, klass string")
    got = {r["doc_id"]: r["labels"] for r in labels.label(t, F.col("w"), F.col("klass"), self_supervised=False).collect()}
    assert got == {1: ["a", "b"], 2: ["x", "y"]}


def test_rarest_label_needs_no_row_for_each_label(spark, monkeypatch):
    rows = [(1, ["a", "b"]), (2, ["b", "c", "a"]), (3, ["c", "x"]), (4, ["é"]), (5, []), (6, None), (7, ["x"]), (1, ["z"])]
    t = spark.createDataFrame(rows, "doc_id long, labels array<string>")
    frequency = labels.label_frequency(t).filter("label <> 'x'")
    quick = labels.rarest_label(t, frequency)
    assert "Generate" not in quick._jdf.queryExecution().executedPlan().toString()
    want = {1: "z", 2: "a", 3: "c", 4: "é"}
    assert {r["doc_id"]: r["rarest"] for r in quick.collect()} == want
    monkeypatch.setattr(labels, "MAX_LABELS", 2)
    assert {r["doc_id"]: r["rarest"] for r in labels.rarest_label(t, frequency).collect()} == want


def test_segments_are_found_once(spark):
    docs = spark.createDataFrame([(1, "~ab~cd~"), (2, "~xy~"), (3, None)], "doc_id long, norm string")
    keywords = spark.createDataFrame([("ab",), ("cd",)], "token string")
    rows = labels.from_segments(docs, F.col("norm"), keywords)
    assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r["doc_id"], r["labels"]) for r in rows.collect()] == [(1, ["ab", "cd"])]


def test_svm_meets_its_optimum():
    r = np.random.default_rng(0)
    x = r.normal(size=(80, 6))
    y = np.where(x[:, 0] + 0.3 * r.normal(size=80) > 0, 1.0, -1.0)
    weight = r.uniform(0.5, 2, 80)
    for intercept in (True, False):
        w = train.fit_svm([np.arange(6)] * 80, list(x), y, weight, 6, intercept)
        slack = np.maximum(0, 1 - y * (x @ w[:-1] + w[-1]))
        g = w - 2 * np.append(x.T @ (weight * y * slack), (weight * y * slack).sum())
        g = g if intercept else g[:-1]
        assert np.abs(g).max() < 1e-3 and (intercept or w[-1] == 0)


def test_prune(spark):
    def prune(column, share):
        t = spark.createDataFrame([("a", k, v) for k, v in enumerate(column)], "label string, token_id int, w double")
        return [r["w"] for r in embed.prune(t, share).orderBy("token_id").collect()]

    assert prune([0.45, 0.15, 0.4], 0.7) == [0.45, 0.0, 0.4]
    assert prune([0.0, 0.0], 0.7) == [0.0, 0.0]
    assert prune([0.25, 0.25, 0.25, 0.25], 0.7) == [0.25] * 4
    assert prune([0.05, 0.8, 0.15], 0.7) == [0.05, 0.8, 0.15]
    assert prune([2.0, -0.7, 0.3], 1) == [2.0, 0.0, 0.3]


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b", "c"]), (3, ["zz"]), (4, [])], "doc_id long, w array<string>")
    voc = vocabulary.build_vocabulary(docs, F.col("w"), 3)
    weights = spark.createDataFrame([(n, k, float(v)) for n, row in (("x", [1, 2, -1]), ("y", [0.5, -3, 4])) for k, v in enumerate(row)], "label string, token_id int, w double")
    return docs, voc, weights


def test_transform_is_features_times_weights(small):
    docs, voc, weights = small
    features = vectorize.features(docs, F.col("w"), voc)
    x = {(r["doc_id"], r["token_id"]): r["value"] for r in features.collect()}
    w = {(r["token_id"], r["label"]): r["w"] for r in weights.collect()}
    b = weights.select("label").distinct().withColumn("intercept", F.lit(0.25))
    got = {(r["doc_id"], r["label"]): r["value"] for r in embed.transform(docs, features, weights, b, precision="float64").collect()}
    for d in (1, 2, 3, 4):
        for name in ("x", "y"):
            known = [(k, v) for (i, k), v in x.items() if i == d]
            want = sum(v * w[k, name] for k, v in known) if known else 1.0
            assert abs(got[d, name] - want - 0.25) < 1e-9
    occurrences = docs.select("doc_id", F.posexplode("w").alias("pos", "token")).join(voc.select("token", "token_id"), "token")
    each = embed.encode_occurrences(occurrences.select("doc_id", "pos", "token_id"), features, weights, "float64")
    sums = {(r["doc_id"], r["label"]): r["v"] for r in each.groupBy("doc_id", "label").agg(F.sum("value").alias("v")).collect()}
    assert all(abs(v + 0.25 - got[k]) < 1e-9 for k, v in sums.items()) and len(sums) == 4


def test_blocks_of_labels_make_no_difference(spark):
    """Several blocks, labels and tokens without weights, two precisions, a zero label, repeated and missing ids."""
    r = random.Random(3)
    features = spark.createDataFrame([(d, t, 1 + t % 2, r.random()) for d in range(30) for t in r.sample(range(12), r.randint(1, 9))], "doc_id long, token_id int, n long, value double")
    docs = spark.createDataFrame([(d, "x", "y", 1) for d in [*range(32), 3]], "doc_id long, label string, ids string, block int")
    rows = [(f"l{k:02}", t, r.random() - 0.5) for k in range(23) for t in range(10) if r.random() < 0.7] + [("zero", 0, 0.0), ("none", 3, None)]
    weights = spark.createDataFrame(rows, "label string, token_id int, w double")
    b = spark.createDataFrame([("l03", 0.5), ("other", 9.0)], "label string, intercept double")
    x, w = {}, {(k, t): v or 0.0 for k, t, v in rows}
    for f in features.collect():
        x.setdefault(f["doc_id"], []).append((f["token_id"], f["value"]))
    names = sorted({k for k, _, _ in rows})
    for cells in (1 << 22, 60, 1):
        got = {(g["doc_id"], g["label"]): g["value"] for g in embed.transform(docs, features, weights, b, precision="float64", cells=cells).collect()}
        assert set(got) == {(d, k) for d in range(32) for k in names}
        for (d, k), v in got.items():
            want = sum(a * w.get((k, t), 0.0) for t, a in x[d]) if d in x else 1.0
            assert abs(v - want - 0.5 * (k == "l03")) < 1e-9
        single = embed.transform(docs, features, weights, b, cells=cells)
        assert dict(single.dtypes)["value"] == "float" and all(abs(g["value"] - got[g["doc_id"], g["label"]]) < 1e-5 for g in single.collect())
        far = {(g["doc_id"], g["label"]): g["value"] for g in embed.transform(docs, features, weights, distance=True, precision="float64", cells=cells).collect()}
        assert far[0, "zero"] is None and far[0, "none"] is None and far[31, "l00"] > 0
        whole, labels = embed.vectors(docs, features, weights, b, precision="float64", cells=cells)
        assert labels == names and whole.count() == 33 and all(abs(v - got[g["doc_id"], k]) < 1e-9 for g in whole.collect() for k, v in zip(names, g["v"]))
    assert embed.transform(docs, features, weights.limit(0)).count() == 0


def test_feature_rows_equal_features(small, spark):
    docs, voc, weights = small
    zero = voc.withColumn("idf", F.when(F.col("token") == "a", 0.0).otherwise(F.col("idf")))
    more = docs.unionByName(spark.createDataFrame([(5, None), (6, ["a"]), (1, ["b"])], "doc_id long, w array<string>")).withColumn("ids", F.lit("clash"))
    for vocabulary_table in (voc, zero):
        want = {r["doc_id"]: (r["ids"], r["values"]) for r in vectorize.sparse_rows(vectorize.features(docs.unionByName(spark.createDataFrame([(6, ["a"])], "doc_id long, w array<string>")), F.col("w"), vocabulary_table)).collect()}
        rows = vectorize.feature_rows(more.filter("not (doc_id = 1 and size(w) = 1)"), F.col("w"), vocabulary_table, "doc_id").collect()
        assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5, 6}
        for r in rows:
            ids, values = want.get(r["doc_id"], ([], []))
            assert r["ids"] == ids and np.allclose(r["values"], values, equal_nan=True)
    both = embed.transform(docs, vectorize.features(docs, F.col("w"), voc), weights, precision="float64")
    show = lambda df: sorted((r["doc_id"], r["label"], round(r["value"], 9)) for r in df.collect())
    for cells in (1 << 22, 1):
        assert show(embed.score(docs, F.col("w"), voc, weights, "doc_id", precision="float64", cells=cells)) == show(both)
    assert embed.score(docs, F.col("w"), voc.limit(0), weights, "doc_id").filter("value <> 1").count() == 0


def test_scoring_shuffles_no_label_times_feature(spark):
    """With 16,384 labels the plan's exchanges move documents' sparse rows only."""
    features = spark.createDataFrame([(d, t, 1, 0.5) for d in range(20) for t in range(4)], "doc_id long, token_id int, n long, value double")
    weights = spark.range(1 << 14).select(F.concat(F.lit("l"), "id").alias("label"), F.explode(F.array(F.lit(0), F.lit(3))).alias("token_id"), (F.col("id") % 7 - 3.0).alias("w"))
    found, names = embed.vectors(spark.range(21).withColumnRenamed("id", "doc_id"), features, weights)
    assert len(names) == 1 << 14
    rows = {r["doc_id"]: r["v"] for r in found.collect()}
    assert len(rows) == 21 and all(len(v) == 1 << 14 for v in rows.values())
    k = names.index("l5")
    assert rows[0][k] == 2.0 and rows[20][k] == 1.0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange")  # nothing is exchanged above the product


def test_merge(spark):
    a = spark.createDataFrame([("x", 0, 1.0), ("x", 1, 2.0), ("y", 0, 5.0)], "label string, token_id int, w double")
    b = spark.createDataFrame([("x", 1, 4.0), ("x", 2, 6.0), ("z", 0, 7.0)], "label string, token_id int, w double")
    got = {(r["label"], r["token_id"]): r["w"] for r in embed.merge(a, b).collect()}
    assert got == {("x", 0): 0.5, ("x", 1): 3.0, ("x", 2): 3.0, ("y", 0): 5.0, ("z", 0): 7.0}


def test_two_classes_need_one_model(spark):
    two = spark.createDataFrame([("ar", 5), ("mx", 6)], "label string, freq long")
    assert [r["label"] for r in train.labels_to_fit(two).collect()] == ["mx"]
    three = two.unionByName(spark.createDataFrame([("es", 1)], "label string, freq long"))
    assert train.labels_to_fit(three).count() == 3
    assert train.named(two.select("label"), ["mx", "ar"]).first()["label"] == ["ar", "mx"]


def test_negatives_skip_labels_in_every_document(spark):
    t = spark.createDataFrame([(k, ["all"] + (["odd"] if k % 2 else [])) for k in range(10)], "doc_id long, labels array<string>")
    limits = sampling.caps(labels.label_frequency(t), 3, 2)
    neg = sampling.negatives(t, limits, ["doc_id"])
    assert {(r["label"], r["doc_id"]) for r in neg.collect()} == {("odd", 0), ("odd", 2), ("odd", 4)}
    assert {r["label"] for r in sampling.training_set(sampling.positives(t, limits, ["doc_id"]), neg).collect()} == {"odd"}


@pytest.mark.parametrize("block", [1024, 4])
def test_first_documents_without_a_label(spark, monkeypatch, block):
    monkeypatch.setattr(sampling, "BLOCK", block)
    r = random.Random(block)
    share = {"rare": 0.02, "half": 0.5, "most": 0.95, "all": 1.0}
    rows = [(k, [x for x, p in share.items() if r.random() < p]) for k in range(300)]
    t = spark.createDataFrame(rows, "doc_id long, labels array<string>").repartition(5)
    limits = sampling.caps(labels.label_frequency(t), 20, 12)
    n_neg = {x["label"]: x["n_neg"] for x in limits.collect()}
    want = {(x, k) for x in share for k in [k for k, own in rows if x not in own][: n_neg[x]]}
    assert {(x["label"], x["doc_id"]) for x in sampling.negatives(t, limits, ["doc_id"]).collect()} == want
    rarest = labels.rarest_label(t, labels.label_frequency(t))
    of = {x["doc_id"]: x["rarest"] for x in rarest.collect()}
    strata = labels.rarest_frequency(rarest)
    quota = {}
    for x in share:
        table = strata.filter(F.col("rarest") != x).select(F.col("rarest").alias("stratum"), F.col("freq").alias("available"))
        quota |= {(x, q["stratum"]): q["quota"] for q in sampling.uniform_quotas(table, n_neg[x]).collect()}
    want = {(x, k) for (x, stratum), q in quota.items() for k in [k for k, own in rows if of.get(k) == stratum and x not in own][:q]}
    got = sampling.stratified_negatives(t, rarest, strata, limits, ["doc_id"])
    assert {(x["label"], x["doc_id"]) for x in got.collect()} == want


def test_training_sets_group_no_union(spark):
    """AQE may deal a side of a union anew, and a group or join behind that takes the union as dealt by its key then fails."""
    rows = spark.createDataFrame([(k, ["a"] + ["b"] * (k % 2) + ["c"] * (k % 3 == 0)) for k in range(60)], "doc_id long, labels array<string>")
    limits = sampling.caps(labels.label_frequency(rows), 20, 20)
    t = sampling.training_set(sampling.positives(rows, limits, ["doc_id"], 20), sampling.negatives(rows, limits, ["doc_id"]))
    assert "Union" not in t._jdf.queryExecution().executedPlan().toString()
    assert sampling.negatives(rows, limits, ["doc_id"])._jdf.queryExecution().executedPlan().toString().count("Union") == 0
    got = {(r["label"], r["y"]): r["n"] for r in t.groupBy("label", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {("b", 1): 20, ("b", -1): 20, ("c", 1): 20, ("c", -1): 20}


def test_positions(spark):
    t = spark.createDataFrame([(k * 7 % 100,) for k in range(100)], "doc_id long").repartition(9)
    assert {(x["doc_id"], x["pos"]) for x in positions.numbered(t, ["doc_id"]).collect()} == {(k, k) for k in range(100)}
    order = curate.shuffle(t).orderBy("position").collect()
    assert [x["position"] for x in order] == list(range(100)) and [x["doc_id"] for x in order] != list(range(100))


@pytest.mark.parametrize("small", [32, 1])
def test_near_duplicates(spark, monkeypatch, small):
    monkeypatch.setattr(curate, "SMALL", small)
    monkeypatch.setattr(curate, "FIRST", 2)
    r = random.Random(small)
    bases = [[f"w{r.randint(0, 10**6)}" for _ in range(60)] for _ in range(3)]
    rows = []
    for k in range(120):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            w[r.randrange(60)] = f"x{r.randint(0, 10**6)}"
        rows.append((k, "2022-09-0%d" % r.randint(1, 6), "~" + "~".join(w[: r.choice([60, 60, 52, 3])]) + "~"))
    rows += [(200, "2022-09-01", "~"), (201, None, rows[0][2])]
    t = spark.createDataFrame(rows, "doc_id long, day string, norm string").withColumn("day", F.col("day").cast("date")).repartition(6)
    sets = {k: {tuple(x.strip("~").split("~")[i : i + 5]) for i in range(len(x.strip("~").split("~")) - 4)} for k, _, x in rows}
    for days in (0, 2):
        near = lambda a, b: a[1] and b[1] and abs(int(a[1][-1]) - int(b[1][-1])) <= days
        want = {a[0] for a in rows for b in rows if b[0] < a[0] and near(a, b) and sets[a[0]] and 100 * len(sets[a[0]] & sets[b[0]]) >= 75 * len(sets[a[0]] | sets[b[0]])}
        assert {x["doc_id"] for x in curate.near_duplicates(t, days).collect()} == want and want


def test_hidden_target(spark):
    voc = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "token string, token_id int")
    rows = [("a", 1, [0, 1, 2], [0.6, 0.0, 0.8]), ("a", -1, [0, 2], [0.6, 0.8]), ("a", 1, [0], [1.0]), ("zz", 1, [0, 2], [0.6, 0.8]), ("b", 1, [0], [1.0])]
    t = spark.createDataFrame(rows, "label string, y int, ids array<int>, values array<double>")
    got = sorted((x["label"], x["y"], x["ids"], x["values"]) for x in sampling.hide_target(t, voc).collect())
    assert got == [("a", -1, [0, 2], [0.6, 0.8]), ("a", 1, [], []), ("a", 1, [1, 2], [0.0, 1.0]), ("b", 1, [0], [1.0]), ("zz", 1, [0, 2], [0.6, 0.8])]


def test_models_that_cannot_be_added(spark):
    schema = "label array<string>, n long, no_sv long, intercept double, coef array<float>"
    one = spark.createDataFrame([(["x"], 1, 1, None, [1.0, 2.0])], schema)
    assert {(x["label"], x["token_id"]): x["w"] for x in embed.add(one, one).collect()} == {("x", 0): 1.0, ("x", 1): 2.0}
    for bad in ([(["x"], 1, 1, 0.5, [1.0])], [(["x", "y"], 1, 1, None, [1.0])]):
        with pytest.raises(ValueError, match="can't be added"):
            embed.add(one, spark.createDataFrame(bad, schema))


@pytest.fixture(scope="module")
def tweets(spark):
    r = random.Random(2)
    topics = {"rain": "cloud wind storm wet".split(), "goal": "ball team match win".split(), "bread": "oven flour warm dough".split()}
    rows = []
    for k in range(240):
        topic = r.choice(list(topics))
        w = r.choices(topics[topic], k=5) + r.choices("the a of and".split(), k=3) + [topic] * r.choice([0, 1, 1])
        r.shuffle(w)
        rows.append((k, "~" + "~".join(w) + "~", "warm place" if k % 5 == 0 else None))
    docs = spark.createDataFrame(rows, "doc_id long, norm string, klass string")
    vocabulary = vocabulary_.build_vocabulary(docs, tk.words(F.col("norm")), 100)
    keywords = spark.createDataFrame([(x, 1) for x in topics], "token string, df long")
    return docs, vocabulary, keywords


def test_quotas_by_water_level_equal_giving_one_by_one():
    r = random.Random(6)
    for _ in range(400):
        names = [f"s{k}" for k in range(r.randint(0, 7))]
        available = [r.randint(1, 9) for _ in names]
        label, total = r.choice([*names, "other"]), r.randint(0, 40)
        rising = sorted((a, n) for a, n in zip(available, names) if n != label)
        want = {n: 0 for _, n in rising}
        left = total
        for k, (a, n) in enumerate(rising):  # strata that have less than an even share give all
            if a * (len(rising) - k) <= left:
                want[n] = a
                left -= a
            else:
                share, more = divmod(left, len(rising) - k)
                for i, (_, rest) in enumerate(rising[k:]):
                    want[rest] = share + (i < more)
                break
        strata = sampling._Strata(names, available)
        at, quota = strata.quotas(label, total)
        assert dict(zip(strata.names.take(at).to_pylist(), quota.tolist())) == {n: q for n, q in want.items() if q}


def test_stored_tables_are_named_by_their_parameters(spark, tweets, tmp_path):
    docs, vocabulary, keywords = tweets
    given = dict(keywords=keywords, min_pos=20, max_pos=40, min_neg=30, order=["doc_id"], path=f"{tmp_path}/m", labelled_path=f"{tmp_path}/l")
    one = tailored.models(docs, F.col("norm"), vocabulary, **given)
    two = tailored.models(docs, F.col("norm"), vocabulary, **{**given, "intercept": True})
    assert one.filter("intercept is not null").count() == 0 and two.filter("intercept is null").count() == 0
    ids = {x["model_id"] for x in one.unionByName(two).select("model_id").distinct().collect()}
    assert len(ids) == 2 and ids == set(os.listdir(f"{tmp_path}/m"))
    other = tailored.models(docs, F.col("norm"), vocabulary_.build_vocabulary(docs, tk.words(F.col("norm")), 12), **given)
    assert len(os.listdir(f"{tmp_path}/m")) == 3 and len(os.listdir(f"{tmp_path}/l")) == 2 and other.count() == 3
    corpus.write_vocabulary(vocabulary, vocabulary.agg(F.count("*").alias("n_docs")), {"k": 100, "lang": "es"}, f"{tmp_path}/v")
    assert corpus.read_vocabulary(spark, f"{tmp_path}/v")[1].first()["model_id"] == identity.name("Vocabulary", {"lang": "es", "k": 100})
    assert identity.checksum(vocabulary.repartition(5), "token") == identity.checksum(vocabulary, "token") != identity.checksum(vocabulary.limit(3), "token")


def sparse_training(n, size, seed=4):
    r = np.random.default_rng(seed)
    ids = [np.sort(r.choice(size, r.integers(1, 6), replace=False)) for _ in range(n)]
    values = [v / np.linalg.norm(v) for v in (r.random(len(i)) + 0.1 for i in ids)]
    y = np.where([i[0] < size // 3 for i in ids], 1, -1)
    y[r.random(n) < 0.1] *= -1
    return ids, values, y


@pytest.mark.parametrize("intercept", [True, False])
def test_one_label_of_any_size_ends_at_the_same_optimum(spark, intercept):
    ids, values, y = sparse_training(300, 40)
    weight = np.where(y == 1, 150 / (y == 1).sum(), 150 / (y == -1).sum())
    want = train.fit_svm(ids, values, y, weight, 40, intercept)
    rows = [(int(a), float(b), i.tolist(), v.tolist()) for a, b, i, v in zip(y, weight, ids, values)]
    docs = spark.createDataFrame(rows, "y int, weight double, ids array<int>, values array<double>").repartition(7)
    got = train.fit_large(docs, 40, intercept)
    assert np.abs(got - want).max() < 1e-4 and np.abs(want).max() > 0.5
    assert not train.fit_large(docs.limit(0), 40, intercept).any()


def test_blocks_of_labels_equal_single_fits(spark):
    """Labels that share documents, in blocks of 1, 2 and 8; positives go without their own label's feature."""
    ids, values, _ = sparse_training(120, 20)
    r = np.random.default_rng(1)
    training = [(f"l{k}", d, int(r.choice([1, -1])), float(r.random() + 0.5)) for k in range(5) for d in r.choice(120, 60, replace=False).tolist()]
    rows = spark.createDataFrame(training, "label string, doc_id long, y int, weight double")
    features = spark.createDataFrame([(d, i.tolist(), v.tolist()) for d, (i, v) in enumerate(zip(ids, values))], "doc_id long, ids array<int>, values array<double>")
    targets = spark.createDataFrame([("l0", 3), ("l2", 7), ("other", 1)], "label string, token_id int")
    for width in (1, 2, 8):
        got = {m["label"]: m for m in train.fit_blocks(rows, features, 20, True, targets, width=width).collect()}
        assert set(got) == {f"l{k}" for k in range(5)}
        for label, m in got.items():
            mine = [(d, y, c) for name, d, y, c in training if name == label]
            hidden = {"l0": 3, "l2": 7}.get(label, -1)
            i, v = [], []
            for d, y, _ in mine:
                keep = ids[d] != (hidden if y == 1 else -1)
                rest = values[d][keep]
                i.append(ids[d][keep])
                v.append(rest / np.linalg.norm(rest) if len(rest) else rest)
            want = train.fit_svm(i, v, np.array([y for _, y, _ in mine]), np.array([c for _, _, c in mine]), 20)
            assert m["n"] == 60 and np.abs(np.array(m["coef"]) - want[:-1]).max() < 2e-3 and abs(m["intercept"] - want[-1]) < 2e-3
    assert train.fit_blocks(rows.limit(0), features, 20).count() == 0


def test_tailored(spark, tweets, tmp_path):
    docs, vocabulary, keywords = tweets
    given = dict(keywords=keywords, min_pos=20, max_pos=40, min_neg=30, order=["doc_id"])
    ids = {x["token"]: x["token_id"] for x in vocabulary.collect()}
    corpus_ = tailored.labelled_corpus(docs, F.col("norm"), vocabulary, keywords)
    rows = tailored.training_rows(corpus_, ["doc_id"], 20, 40, 30, False, True)
    features = vectorize.sparse_rows(vectorize.features(corpus_, F.col("tokens"), vocabulary))
    rows = sampling.hide_target(rows.join(features, "doc_id"), vocabulary).collect()
    assert {x["label"] for x in rows} == {"rain", "goal", "bread"}
    assert not any(ids[x["label"]] in x["ids"] for x in rows if x["y"] == 1)  # a positive doesn't hold its own label
    assert sum(x["y"] == 1 for x in rows if x["label"] == "rain") == 40
    weights = {(x["label"], x["token_id"]): x["w"] for x in tailored.tailored(docs, F.col("norm"), vocabulary, **given).collect()}
    for label, friend in (("rain", "storm"), ("goal", "ball"), ("bread", "oven")):
        own = {k: w for (x, k), w in weights.items() if x == label}
        assert max(own, key=own.get) != ids[label] and own[ids[friend]] > 0
        w, data = np.array([own[k] for k in sorted(own)]), [x for x in rows if x["label"] == label]
        dense = np.zeros((len(data), len(own)))
        for i, x in enumerate(data):
            dense[i, x["ids"]] = x["values"]
        y, c = np.array([x["y"] for x in data]), np.array([x["weight"] for x in data])
        g = w - 2 * dense.T @ (c * y * np.maximum(0, 1 - y * (dense @ w)))
        assert np.abs(g).max() < 0.05  # as far as half precision goes
    path, kept = f"{tmp_path}/m", f"{tmp_path}/l"
    first = tailored.models(docs, F.col("norm"), vocabulary, path=path, labelled_path=kept, **{**given, "min_pos": 1000})
    assert first.count() == 0
    again = tailored.models(docs, F.col("norm"), vocabulary, path=path, labelled_path=kept, **given)
    assert sorted(x["label"] for x in again.collect()) == [["bread"], ["goal"], ["rain"]]
    assert tailored.models(docs.limit(0), F.col("norm"), vocabulary, path=path, labelled_path=kept, **given).count() == 3  # all is there
    both = tailored.tailored(docs, F.col("norm"), vocabulary, base=again.filter(F.array_contains("label", "rain")), **given)
    assert {x["label"] for x in both.select("label").distinct().collect()} == {"rain", "goal", "bread"}


def test_models_of_two_classes_and_of_strata(spark, tweets):
    docs, vocabulary, keywords = tweets
    two = tailored.models(docs.withColumn("klass", F.when(F.col("norm").contains("cloud"), "mx").otherwise("ar")), F.col("norm"), vocabulary, keywords=keywords, klass=F.col("klass"), self_supervised=False, min_pos=5, intercept=True)
    assert [x["label"] for x in two.collect()] == [["ar", "mx"]]
    kept = tailored.models(docs, F.col("norm"), vocabulary, keywords=keywords, min_pos=20, keep_unfreq=True, order=["doc_id"])
    assert kept.count() == 3 and kept.filter("n < 40").count() == 0


def test_unfinished_tables_are_made_again(spark, tmp_path):
    path = f"{tmp_path}/t"
    made = corpus.reuse(spark, path, lambda: spark.range(3))
    assert made.count() == 3 and corpus.reuse(spark, path, lambda: spark.range(9)).count() == 3
    os.remove(f"{path}/_SUCCESS")
    assert corpus.reuse(spark, path, lambda: spark.range(9)).count() == 9


def test_classifiers_learn(spark, tweets):
    docs, vocabulary, _ = tweets
    truth = docs.select("doc_id", F.when(F.col("norm").rlike("cloud|wind|storm|wet"), 1).otherwise(0).alias("y"))
    features = classify.token_vectors(docs, tk.words(F.col("norm")), vocabulary)
    sparse = {x["doc_id"]: x for x in vectorize.sparse_rows(vectorize.features(docs, tk.words(F.col("norm")), vocabulary)).collect()}
    for x in features.collect():
        assert np.allclose([x["features"][i] for i in sparse[x["doc_id"]]["ids"]], sparse[x["doc_id"]]["values"])
    found = classify.predict(features, truth).withColumn("model", F.lit("m"))
    assert found.count() > 30 and classify.macro_recall(found).first()["macro_recall"] > 0.95


def test_model_exchange(spark, tmp_path):
    m = spark.createDataFrame([(["a"], 3, 1, 0.1, [0.1, -2.0]), (["b", "c"], 2, 0, None, [1e-3, 7.0])], train.MODEL.replace("label string", "label array<string>"))
    corpus.write_model(m, f"{tmp_path}/m", exchange=True)
    got = {tuple(r["label"]): r for r in corpus.read_model(spark, f"{tmp_path}/m", exchange=True).collect()}
    assert got[("b", "c")]["intercept"] is None and got[("a",)]["intercept"] == pytest.approx(float(np.float16(0.1)))
    assert got[("a",)]["coef"] == [float(np.float16(0.1)), -2.0] and got[("b", "c")]["n"] == 2


def test_labelled_text_and_json(spark, tmp_path):
    t = spark.createDataFrame([(["a", "b"], "~x~y~"), (["c"], "~")], "labels array<string>, norm string")
    corpus.write_labelled(t, f"{tmp_path}/l", as_text=True)
    assert sorted((r["labels"], r["norm"]) for r in corpus.read_labelled(spark, f"{tmp_path}/l", as_text=True).collect()) == [(["a", "b"], "~x~y~"), (["c"], "~")]
    docs = spark.createDataFrame([(1, "t", None, "mx"), (2, "u", "k", None)], corpus.TEXT_SCHEMA)
    docs.write.option("compression", "gzip").json(f"{tmp_path}/j")
    assert corpus.load_labelled(corpus.read_corpus(spark, f"{tmp_path}/j"), "mx").count() == 1


def test_identifier(spark):
    got = spark.range(1).select(identity.identifier("M", {"lang": "es", "k": 1, "n": 3}, {"k": 1}, ("n",)).alias("v")).first()["v"]
    assert got == "M_c69aaba0f1b0783f273f85de6f599132"


def test_macro_recall(spark):
    t = spark.createDataFrame([("m", 0, 0), ("m", 0, 1), ("m", 1, 1)], "model string, y int, predicted int")
    assert classify.macro_recall(t).first()["macro_recall"] == 0.75


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Hola A", "es", "s", 6), (2, None, "es", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/d")
    out = st.run_once(st.tokenized(st.read_documents(spark, f"{tmp_path}/d")).select("doc_id", "norm", "tokens"), f"{tmp_path}/o", f"{tmp_path}/s")
    assert {r["doc_id"]: r["norm"] for r in out.collect()} == {1: "~hola~a~", 2: "~"}


def test_near_duplicates_on_a_stream_equal_the_batch(spark, tmp_path):
    """Near and equal copies in and out of a window of days, over several micro-batches, late rows and rows of one day included."""
    r = random.Random(12)
    word = lambda: f"w{r.randrange(400)}"
    bases = [[word() for _ in range(r.randint(20, 60))] for _ in range(12)]
    rows = []
    for k in range(150):
        w = list(r.choice(bases)) if r.random() < 0.7 else [word() for _ in range(30)]
        if r.random() < 0.5:
            w[r.randrange(len(w))] = word()
        rows.append((k, min(24, k // 7 + r.choice([0, 0, 1, 2])), "~" + "~".join(w) + "~"))
    rows += [(150, 24, "~a~b~"), (151, 24, "~a~b~"), (152, 24, None)]
    for at in range(0, len(rows), 40):
        part = spark.createDataFrame(rows[at : at + 40], "doc_id long, d int, norm string")
        part.select("doc_id", F.expr("date_add(DATE'2024-01-01', d)").alias("day"), "norm").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    batch = spark.read.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = st.run_once(near.near_duplicates(stream, 3, late="4 days"), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {x["doc_id"] for x in got.collect()}
    want = {x["doc_id"] for x in curate.near_duplicates(batch, 3).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) and 40 < len(want) < 140


def test_near_duplicates_by_micro_batch_equal_the_batch(spark, tmp_path):
    r = random.Random(5)
    bases = [[f"w{r.randrange(400)}" for _ in range(r.randint(20, 60))] for _ in range(6)]
    rows = []
    for k in range(120):
        w = list(r.choice(bases))
        if r.random() < 0.5:
            w[r.randrange(len(w))] = f"x{r.randrange(400)}"
        rows.append((k if k % 9 else 1000 - k, max(0, k // 8 - r.choice([0, 0, 1, 2])), "~" + "~".join(w) + "~"))
    rows += [(150, 15, "~a~b~"), (152, 15, None), (153, None, rows[0][2])]
    for at in range(0, len(rows), 41):
        part = spark.createDataFrame(rows[at : at + 41], "doc_id long, d int, norm string")
        part.select("doc_id", F.expr("date_add(DATE'2024-01-01', d)").alias("day"), "norm").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    batch = spark.read.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = near.run_by_batch(stream, f"{tmp_path}/out", f"{tmp_path}/state", 2, late=15)
    want = {x["doc_id"] for x in curate.near_duplicates(batch, 2).collect()}
    assert {x["doc_id"] for x in got.collect()} == want and len(want) > 40
    assert len(os.listdir(f"{tmp_path}/out")) == 3


def test_signatures_of_similar_sets_meet(spark):
    r = random.Random(1)
    pairs = []
    for k in range(300):
        both, own = r.randint(30, 60), 0
        own = both // 7  # similarity 7/9 = 0.78
        common = [r.getrandbits(62) for _ in range(both)]
        pairs.append((k, sorted(common + [r.getrandbits(62) for _ in range(own)]), sorted(common + [r.getrandbits(62) for _ in range(own)])))
    rows = spark.createDataFrame(pairs, "k int, a array<long>, b array<long>")
    shared = F.size(F.array_intersect(near.signatures(F.col("a")), near.signatures(F.col("b")))) > 0
    assert rows.filter(shared).count() >= 297
    assert spark.createDataFrame([([],), (None,)], "a array<long>").select(F.size(near.signatures(F.col("a"))).alias("n")).filter("n > 0").count() == 0
