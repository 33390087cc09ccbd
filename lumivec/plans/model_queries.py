"""Vocabularies, features, labels, sampling, training, embeddings, classifiers and curation over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..operators import classify as cl
from ..operators import curate as cu
from ..operators import embed as em
from ..operators import labels as lb
from ..operators import sampling as sp
from ..operators import segment as sg
from ..operators import tailored as tl
from ..operators import train as tr
from ..operators import vectorize as vec
from ..operators import vocabulary as voc
from ..sources import corpus as src
from ..sources.scratch import cut
from ..streaming import near as sn
from ..streaming import text as st
from .base import CAPS_SQL, DF_SQL, DOCS_SQL, FEAT_SQL, LAB_SQL, NEG_SQL, OCC_SQL, POS_SQL, RARE_SQL, TRAIN_SQL, VOC_SQL, W_SQL, MAX_POS, MIN_NEG, MIN_POS, K, fill_sql, keywords, labelled, normed, prepared, query, table, weights, word_column, word_features, word_vocabulary
from .text_queries import SEGMENT_SQL

ORDER = sp.corpus_order()


# ---------------------------------------------------------------- vocabulary

@query("v1_document_frequency", f"WITH {DF_SQL} SELECT token, df FROM v0")
def v1(spark, sf_dir):
    return voc.document_frequency(normed(spark, sf_dir), word_column())


@query("v2_document_count", "SELECT count(*) AS n_docs FROM documents")
def v2(spark, sf_dir):
    return voc.document_count(table(spark, sf_dir, "documents"))


@query("v3_top_k", f"WITH {DF_SQL} SELECT token, df FROM v0 ORDER BY df DESC, token LIMIT {K}")
def v3(spark, sf_dir):
    return voc.top_k(voc.document_frequency(normed(spark, sf_dir), word_column()), K)


@query("v4_token_ids", f"WITH {DF_SQL}, a AS (SELECT *, row_number() OVER (ORDER BY df DESC, token) - 1 AS i FROM v0) SELECT token, df, i::INTEGER AS token_id FROM a")
def v4(spark, sf_dir):
    """Without a limit: ids by falling frequency."""
    return voc.with_ids(voc.document_frequency(normed(spark, sf_dir), word_column()), "df").select("token", "df", "token_id")


@query("v5_first_documents", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def v5(spark, sf_dir):
    return voc.first_documents(table(spark, sf_dir, "documents"), 100).select("doc_id")


@query(
    "v6_second_vocabulary",
    f"""{SEGMENT_SQL}, sv AS (SELECT token, count(DISTINCT doc_id) AS df FROM sg GROUP BY token ORDER BY df DESC, token LIMIT {K})
SELECT token, df, (row_number() OVER (ORDER BY token) - 1)::INTEGER AS token_id, round(log2((SELECT count(*) FROM dn)::DOUBLE / df), 6) AS idf FROM sv""",
)
def v6(spark, sf_dir):
    docs = prepared(spark, sf_dir).select("doc_id", "norm")
    first = voc.top_k(tk.counts(docs, F.col("norm"), [-1, 2, 3]), K)
    return sg.second_vocabulary(docs, F.col("norm"), first, K).select("token", "df", "token_id", F.round("idf", 6).alias("idf"))


@query("v7_keyword_vocabulary", f"WITH {DOCS_SQL} SELECT DISTINCT token, 1::BIGINT AS df FROM (SELECT unnest(w) AS token FROM d WHERE lang = 'es')")
def v7(spark, sf_dir):
    words = normed(spark, sf_dir).select("lang", F.explode(word_column()).alias("token"))
    return voc.keyword_vocabulary(words, "es")


@query(
    "v8_select_keywords",
    f"""WITH {DF_SQL}, q AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(flatten(list_transform(list_transform(list_filter(w, lambda x : NOT starts_with(x, 'e:')), lambda x : '~' || x || '~'), lambda x : list_transform(range(1, length(x) - 1), lambda i : 'q:' || substring(x, i, 3))))) AS token FROM d) GROUP BY token),
a AS (SELECT token, df FROM (SELECT * FROM v0 UNION ALL SELECT * FROM q) ORDER BY df DESC, token LIMIT {K}),
n AS (SELECT * FROM a WHERE NOT starts_with(token, 'q:')),
i AS (SELECT *, row_number() OVER (ORDER BY length(token) DESC, token) AS r FROM a WHERE starts_with(token, 'q:') AND NOT contains(substring(token, 3), '~'))
SELECT token, df FROM n UNION ALL SELECT token, df FROM i WHERE r <= greatest({K} - (SELECT count(*) FROM n), 0)""",
)
def v8(spark, sf_dir):
    return voc.select_keywords(voc.top_k(voc.document_frequency(normed(spark, sf_dir), tk.tokenize(F.col("norm"), [-1, 3])), K), K)


@query(
    "v9_drop_word_pairs",
    f"""WITH {DF_SQL}, b AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i : array_to_string(w[i : i + 1], '~')))) AS token FROM d) GROUP BY token),
a AS (SELECT * FROM b ORDER BY df DESC, token LIMIT {K})
SELECT token, df FROM a WHERE starts_with(token, 'q:') OR NOT contains(substring(token, 2, greatest(length(token) - 2, 0)), '~')""",
)
def v9(spark, sf_dir):
    return voc.drop_inner_joins(voc.top_k(voc.document_frequency(normed(spark, sf_dir), tk.tokenize(F.col("norm"), [-1, -2])), K))


@query("v10_idf", f"WITH {VOC_SQL} SELECT token, token_id, round(idf, 6) AS idf FROM v")
def v10(spark, sf_dir):
    return word_vocabulary(normed(spark, sf_dir)).select("token", "token_id", F.round("idf", 6).alias("idf"))


@query("v11_names_and_weights", f"WITH {VOC_SQL} SELECT string_agg(token, ' ' ORDER BY token_id) AS names, round(sum(idf), 4) AS total FROM v")
def v11(spark, sf_dir):
    both = voc.names_and_weights(word_vocabulary(normed(spark, sf_dir)))
    return both.select(F.array_join("names", " ").alias("names"), F.round(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("v12_minimum_frequency", f"WITH {DF_SQL}, a AS (SELECT * FROM v0 WHERE df >= 5) SELECT token, df, (row_number() OVER (ORDER BY df DESC, token) - 1)::INTEGER AS token_id, round(log2((SELECT count(*) FROM documents)::DOUBLE / df), 6) AS idf FROM a")
def v12(spark, sf_dir):
    return voc.build_vocabulary(normed(spark, sf_dir), word_column(), None, 5).withColumn("idf", F.round("idf", 6))


# ---------------------------------------------------------------- features

@query("e1_known_tokens", f"WITH {OCC_SQL} SELECT doc_id, count(*) AS n FROM o GROUP BY doc_id")
def e1(spark, sf_dir):
    docs = prepared(spark, sf_dir)
    return vec.known_tokens(docs, word_column(), word_vocabulary(docs)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("e2_term_frequency", f"WITH {OCC_SQL} SELECT doc_id, token_id, n, round(n / sum(n) OVER (PARTITION BY doc_id), 6) AS tf FROM c")
def e2(spark, sf_dir):
    docs = prepared(spark, sf_dir)
    return vec.term_frequency(vec.term_counts(vec.known_tokens(docs, word_column(), word_vocabulary(docs)))).select("doc_id", "token_id", "n", F.round("tf", 6).alias("tf"))


@query("e3_tf_idf", f"WITH {FEAT_SQL} SELECT doc_id, token_id, n, round(value, 6) AS value FROM f")
def e3(spark, sf_dir):
    return word_features(prepared(spark, sf_dir)).select("doc_id", "token_id", "n", F.round("value", 6).alias("value"))


@query("e4_sparse_rows", f"WITH {FEAT_SQL} SELECT doc_id, string_agg(token_id::VARCHAR, ' ' ORDER BY token_id) AS ids, round(sum(value), 5) AS total FROM f GROUP BY doc_id")
def e4(spark, sf_dir):
    rows = vec.sparse_rows(word_features(prepared(spark, sf_dir)))
    return rows.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


# ---------------------------------------------------------------- labels

@query("l1_self_labels", f"WITH {LAB_SQL} SELECT doc_id, string_agg(label, ' ' ORDER BY label) AS labels FROM l GROUP BY doc_id")
def l1(spark, sf_dir):
    return labelled(prepared(spark, sf_dir)).select("doc_id", F.array_join("labels", " ").alias("labels"))


@query(
    "l2_given_labels",
    f"WITH {LAB_SQL}, o AS (SELECT doc_id, string_agg(label, ' ' ORDER BY label) AS labels FROM l GROUP BY doc_id) SELECT d.doc_id, CASE WHEN q.quality IS NULL THEN o.labels ELSE 'quality' || q.quality || ' toxic' || q.toxic END AS labels FROM d LEFT JOIN labels q USING (doc_id) LEFT JOIN o USING (doc_id) WHERE q.quality IS NOT NULL OR o.labels IS NOT NULL",
)
def l2(spark, sf_dir):
    docs = prepared(spark, sf_dir)
    klass = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("quality"), "quality", F.lit(" toxic"), "toxic").alias("klass"))
    rows = lb.from_segments(docs.join(klass, "doc_id", "left"), F.col("norm"), keywords(docs), F.col("klass"), self_supervised=False)
    return rows.select("doc_id", F.array_join("labels", " ").alias("labels"))


@query("l3_drop_unlabelled", f"WITH {LAB_SQL} SELECT DISTINCT doc_id FROM l")
def l3(spark, sf_dir):
    return labelled(prepared(spark, sf_dir)).select("doc_id")


@query("l4_label_frequency", f"WITH {LAB_SQL} SELECT label, freq FROM lf")
def l4(spark, sf_dir):
    return lb.label_frequency(labelled(prepared(spark, sf_dir)))


@query("l5_frequent_labels", f"WITH {LAB_SQL} SELECT label, freq FROM lf WHERE freq >= 100")
def l5(spark, sf_dir):
    return lb.frequent_labels(lb.label_frequency(labelled(prepared(spark, sf_dir))), 100)


def _rarest(rows):
    return lb.rarest_label(rows, lb.label_frequency(rows))


@query("l6_rarest_label", f"WITH {RARE_SQL} SELECT doc_id, rarest FROM r")
def l6(spark, sf_dir):
    return _rarest(labelled(prepared(spark, sf_dir)))


@query("l7_rarest_frequency", f"WITH {RARE_SQL} SELECT rarest, count(*) AS freq FROM r GROUP BY rarest")
def l7(spark, sf_dir):
    return lb.rarest_frequency(_rarest(labelled(prepared(spark, sf_dir))))


# ---------------------------------------------------------------- sampling

def _limits(rows):
    return sp.caps(lb.label_frequency(rows), MAX_POS, MIN_NEG)


@query("g1_positives", f"WITH {POS_SQL} SELECT label, doc_id, y FROM p")
def g1(spark, sf_dir):
    rows = labelled(prepared(spark, sf_dir))
    return sp.positives(rows, _limits(rows), ORDER, MAX_POS)


@query("g2_negatives", f"WITH {NEG_SQL} SELECT label, doc_id, y FROM ng")
def g2(spark, sf_dir):
    rows = labelled(prepared(spark, sf_dir))
    return sp.negatives(rows, _limits(rows), ORDER)


_STRATA = "(SELECT cap.label, n_neg, rf.rarest AS stratum, rf.freq AS available FROM cap, (SELECT rarest, count(*) AS freq FROM r GROUP BY rarest) rf WHERE cap.label <> rf.rarest)"


@query(
    "g3_stratified_negatives",
    f"""WITH {CAPS_SQL}, q AS {fill_sql(_STRATA, 'n_neg', 'label')}
SELECT label, doc_id, -1 AS y FROM (SELECT q.label, r.doc_id, quota, row_number() OVER (PARTITION BY q.label, stratum ORDER BY r.doc_id) AS k FROM q JOIN r ON r.rarest = q.stratum
WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.label = q.label AND l.doc_id = r.doc_id)) WHERE k <= quota""",
)
def g3(spark, sf_dir):
    rows = labelled(prepared(spark, sf_dir))
    rarest = _rarest(rows)
    return sp.stratified_negatives(rows, rarest, lb.rarest_frequency(rarest), _limits(rows), ORDER)


@query("g4_uniform_quotas", f"SELECT stratum, available, quota FROM {fill_sql('(SELECT source AS stratum, count(*) AS available FROM documents GROUP BY source)', '500')}")
def g4(spark, sf_dir):
    strata = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("stratum")).agg(F.count(F.lit(1)).alias("available"))
    return sp.uniform_quotas(strata, 500)


@query("g5_hide_label", f"WITH {POS_SQL} SELECT label, doc_id, len(list_filter(w, lambda x : x <> label))::BIGINT AS n FROM p JOIN d USING (doc_id)")
def g5(spark, sf_dir):
    docs = prepared(spark, sf_dir)
    rows = labelled(docs)
    tokens = docs.select("doc_id", word_column().alias("w"))
    return sp.positives(rows, _limits(rows), ORDER, MAX_POS).join(tokens, "doc_id").select("label", "doc_id", F.size(sp.hide_label(F.col("w"), F.col("label"))).cast("long").alias("n"))


def _training(rows):
    limits = cut(_limits(rows))
    return sp.training_set(sp.positives(rows, limits, ORDER, MAX_POS), sp.negatives(rows, limits, ORDER))


@query("g6_training_set", f"WITH {TRAIN_SQL} SELECT label, doc_id, y FROM t")
def g6(spark, sf_dir):
    return _training(labelled(prepared(spark, sf_dir)))


@query("g7_shuffled", f"WITH {TRAIN_SQL} SELECT label, doc_id, y, row_number() OVER (ORDER BY md5('0:' || label || ':' || doc_id), label, doc_id) - 1 AS position FROM t")
def g7(spark, sf_dir):
    return sp.shuffled(_training(labelled(prepared(spark, sf_dir))))


@query("h1_class_weights", f"WITH {TRAIN_SQL} SELECT label, doc_id, y, round(count(*) OVER (PARTITION BY label) / (2.0 * count(*) OVER (PARTITION BY label, y)), 6)::DOUBLE AS weight FROM t")
def h1(spark, sf_dir):
    return sp.class_weights(_training(labelled(prepared(spark, sf_dir)))).withColumn("weight", F.round("weight", 6))


# ---------------------------------------------------------------- models

def _models(spark, sf_dir, intercept=True):
    docs = prepared(spark, sf_dir)
    return tl.models(docs, F.col("norm"), cut(word_vocabulary(docs)), keywords=keywords(docs), min_pos=MIN_POS, max_pos=MAX_POS, min_neg=MIN_NEG, intercept=intercept, order=ORDER)


def _coef_digest(models):
    return models.select(F.element_at("label", -1).alias("label"), "n", "no_sv", F.round("intercept", 2).alias("intercept"), F.size("coef").alias("size"))


@query("h2_train")
def h2(spark, sf_dir):
    """One model for each of the keyword labels (g5: positives without their label; h5: half precision; h6: labels in parallel)."""
    return _coef_digest(_models(spark, sf_dir))


@query("h2_one_large_label", f"WITH {FEAT_SQL} SELECT '1' AS label, count(*) AS n, TRUE AS optimal FROM labels WHERE quality IS NOT NULL AND doc_id IN (SELECT doc_id FROM f)")
def h2_large(spark, sf_dir):
    """One label of any size, fitted by passes over its rows; optimal: the gradient, summed anew by a join, is (almost) 0 where the fit ended."""
    docs = prepared(spark, sf_dir)
    vocabulary = cut(word_vocabulary(docs))
    features = vec.features(docs, word_column(), vocabulary)
    given = table(spark, sf_dir, "labels").filter("quality is not null").select("doc_id", (F.col("quality") * 2 - 1).alias("y"), F.lit("1").alias("label"))
    rows = cut(sp.class_weights(given).join(vec.sparse_rows(features), "doc_id"))
    size = vocabulary.count()
    w = tr.fit_large(rows, size)
    weights = spark.createDataFrame([(k, float(v)) for k, v in enumerate(w[:-1])], "token_id int, w double")
    each = rows.select("doc_id", "y", "weight", F.explode(F.arrays_zip("ids", "values")).alias("x")).select("doc_id", "y", "weight", F.col("x.ids").alias("token_id"), F.col("x.values").alias("value"))
    slack = each.join(weights, "token_id").groupBy("doc_id").agg(F.sum(F.col("value") * F.col("w")).alias("h"))
    each = each.join(slack, "doc_id").withColumn("r", -2 * F.col("weight") * F.col("y") * F.greatest(F.lit(0.0), 1 - F.col("y") * (F.col("h") + float(w[-1]))))
    slope = each.groupBy("token_id").agg(F.sum(F.col("r") * F.col("value")).alias("g"), F.sum(-2 * F.col("weight") * F.col("y") * F.col("value")).alias("g0")).join(weights, "token_id")
    good = slope.agg((F.sqrt(F.sum((F.col("w") + F.col("g")) * (F.col("w") + F.col("g")))) <= 1e-4 * F.sqrt(F.sum(F.col("g0") * F.col("g0")))).alias("optimal"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(good))  # one row


@query(
    "h3_decision_values",
    f"WITH {FEAT_SQL}, lab AS (SELECT doc_id, 'd' || quality AS label, 2 * toxic - 1 AS y FROM labels), {W_SQL} SELECT lab.label, lab.doc_id, y::INTEGER AS y, round(sum(value * coalesce(w, 0)), 6) AS h FROM lab JOIN f USING (doc_id) LEFT JOIN w0 ON w0.label = lab.label AND w0.token_id = f.token_id GROUP BY ALL",
)
def h3(spark, sf_dir):
    return _decided(spark, sf_dir).withColumn("h", F.round("h", 6))


def _decided(spark, sf_dir):
    given = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("d"), "quality").alias("label"), (F.col("toxic") * 2 - 1).cast("int").alias("y"))
    return tr.decision_values(given.join(word_features(prepared(spark, sf_dir)).select("doc_id", "token_id", "value"), "doc_id"), weights(spark, sf_dir))


@query(
    "h4_outside_margin",
    f"WITH {FEAT_SQL}, lab AS (SELECT doc_id, 'd' || quality AS label, 2 * toxic - 1 AS y FROM labels), {W_SQL}, h AS (SELECT lab.label, lab.doc_id, y, 5 * sum(value * coalesce(w, 0)) AS h FROM lab JOIN f USING (doc_id) LEFT JOIN w0 ON w0.label = lab.label AND w0.token_id = f.token_id GROUP BY ALL) SELECT label, count_if(abs(h) >= 1 AND sign(h) = y)::BIGINT AS no_sv FROM h GROUP BY label",
)
def h4(spark, sf_dir):
    return tr.outside_margin(_decided(spark, sf_dir).withColumn("h", F.col("h") * 5))


@query("h5_half_precision")
def h5(spark, sf_dir):
    """Embedding values through half precision and its exchange form."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    coded = rows.select("vec_id", F.pandas_udf(src.half_to_hex, "string")("embedding").alias("code"))
    back = coded.select("vec_id", "code", F.pandas_udf(src.hex_to_half, "array<float>")(F.unhex("code")).alias("v"))
    return back.select("vec_id", F.md5("code").alias("digest"), F.round(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query("h7_two_classes", "SELECT max(q)::VARCHAR AS label FROM (SELECT DISTINCT quality AS q FROM labels) HAVING count(*) = 2")
def h7(spark, sf_dir):
    classes = lb.label_frequency(table(spark, sf_dir, "labels").select(F.array(F.col("quality").cast("string")).alias("labels")))
    return tr.labels_to_fit(classes).select("label")


@query("h8_resume", f"WITH {LAB_SQL} SELECT label, freq FROM lf WHERE freq < 100")
def h8(spark, sf_dir):
    frequency = lb.label_frequency(labelled(prepared(spark, sf_dir)))
    return tr.not_done(frequency, lb.frequent_labels(frequency, 100))


@query("s6_model_exchange")
def s6(spark, sf_dir):
    """Models written as gzipped JSON lines and read back (s7)."""
    path = st.scratch(spark)
    src.write_model(_models(spark, sf_dir), path, exchange=True)
    return _coef_digest(src.read_model(spark, path, exchange=True))


_FITTED_SQL = f"WITH {TRAIN_SQL}, known AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(w) AS token FROM d) WHERE token IN (SELECT token FROM v0 ORDER BY df DESC, token LIMIT {K})) SELECT label, count(*) AS n FROM t JOIN known USING (doc_id) WHERE label IN (SELECT label FROM lf WHERE freq >= {MIN_POS}) GROUP BY label"


@query("h6_labels_in_blocks", _FITTED_SQL)
def h6(spark, sf_dir):
    """All labels fitted in blocks that share their documents' features: which labels, and the rows that each was fitted on."""
    return _models(spark, sf_dir).select(F.element_at("label", -1).alias("label"), "n")


@query("s7_read_exchanged", _FITTED_SQL.replace("count(*) AS n FROM", "count(*) AS n, TRUE AS same FROM"))
def s7(spark, sf_dir):
    """Models read back from exchange files: as many coefficients as there were, all the same in half precision."""
    path, models = st.scratch(spark), _models(spark, sf_dir)
    src.write_model(models, path, exchange=True)
    back = src.read_model(spark, path, exchange=True).select("label", F.col("n").alias("n2"), F.col("coef").alias("coef2"), F.col("intercept").cast("double").alias("intercept2"))
    same = (F.col("coef") == F.col("coef2")) & (F.col("n") == F.col("n2")) & (F.col("intercept") == F.col("intercept2"))
    return models.join(back, "label").select(F.element_at("label", -1).alias("label"), "n", same.alias("same"))


@query("s4_labelled_set", f"WITH {LAB_SQL} SELECT doc_id, string_agg(label, ' ' ORDER BY label) AS labels FROM l GROUP BY doc_id")
def s4(spark, sf_dir):
    """A labelled set is written once (s9: and reused if it is there)."""
    path = st.scratch(spark)
    rows = labelled(prepared(spark, sf_dir))
    src.reuse(spark, path, lambda: rows)
    return src.reuse(spark, path, lambda: rows.limit(0)).select("doc_id", F.array_join("labels", " ").alias("labels"))


# ---------------------------------------------------------------- embeddings

_ENC = f"WITH {FEAT_SQL}, {W_SQL}, known AS (SELECT DISTINCT doc_id FROM f JOIN w0 USING (token_id)), names AS (SELECT label, sqrt(sum(w * w)) AS norm FROM w0 GROUP BY label), x AS (SELECT doc_id, label, sum(value * w) AS v FROM f JOIN w0 USING (token_id) GROUP BY ALL UNION ALL SELECT doc_id, label, 1.0 FROM documents, names WHERE doc_id NOT IN (SELECT doc_id FROM f))"


@query("i1_encode", f"WITH {FEAT_SQL}, {W_SQL} SELECT doc_id, count(*) AS n, round(sum(value * w), 5) AS total FROM f JOIN w0 USING (token_id) GROUP BY doc_id")
def i1(spark, sf_dir):
    return em.encode(word_features(prepared(spark, sf_dir)), weights(spark, sf_dir)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 5).alias("total"))


@query("i2_encode_occurrences", f"WITH {FEAT_SQL}, {W_SQL} SELECT o.doc_id, count(*) AS n, round(sum(w * value / n), 5) AS total FROM o JOIN f USING (doc_id, token_id) JOIN w0 USING (token_id) GROUP BY o.doc_id")
def i2(spark, sf_dir):
    docs = prepared(spark, sf_dir)
    vocabulary = cut(word_vocabulary(docs))
    occurrences = docs.select("doc_id", F.posexplode(word_column()).alias("pos", "token")).join(vocabulary.select("token", "token_id"), "token").select("doc_id", "pos", "token_id")
    rows, _ = em.occurrence_vectors(occurrences, vec.features(docs, word_column(), vocabulary), weights(spark, sf_dir), "float64")
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return rows.groupBy("doc_id").agg(F.sum(F.size("v")).alias("n"), F.round(F.sum(total), 5).alias("total"))


def _scores(spark, sf_dir, docs, **options):
    vocabulary = cut(word_vocabulary(prepared(spark, sf_dir)))
    return em.score(docs, word_column(), vocabulary, weights(spark, sf_dir), "doc_id", precision="float64", **options).withColumn("value", F.round("value", 5))


@query("i4_transform", f"{_ENC} SELECT doc_id, label, round(v, 5) AS value FROM x")
def i4(spark, sf_dir):
    """Documents without known tokens get ones (i3)."""
    return _scores(spark, sf_dir, normed(spark, sf_dir))


@query("i4_from_features", f"{_ENC} SELECT doc_id, label, round(v, 5) AS value FROM x")
def i4_features(spark, sf_dir):
    """The same from a feature table, block after block of labels."""
    docs = prepared(spark, sf_dir)
    return em.transform(docs, word_features(docs), weights(spark, sf_dir), precision="float64", cells=10 * K).withColumn("value", F.round("value", 5))


@query("i5_intercept", f"{_ENC} SELECT doc_id, label, round(v + 0.5, 5) AS value FROM x")
def i5(spark, sf_dir):
    half = weights(spark, sf_dir).select("label").distinct().withColumn("intercept", F.lit(0.5))
    return _scores(spark, sf_dir, normed(spark, sf_dir), intercepts=half)


@query("i6_distance", f"{_ENC} SELECT doc_id, label, round(v / norm, 5) AS value FROM x JOIN names USING (label)")
def i6(spark, sf_dir):
    return _scores(spark, sf_dir, normed(spark, sf_dir), distance=True)


@query("st4_scores_on_stream", f"{_ENC} SELECT doc_id, label, round(v, 5) AS value FROM x")
def st4(spark, sf_dir):
    """A stream of documents scored against a vocabulary and weights that are there."""
    where = st.scratch(spark)
    stream = st.normalized(st.read_documents(spark, f"{sf_dir}/document*.parquet"))
    return st.run_once(_scores(spark, sf_dir, stream), f"{where}/out", f"{where}/state")


@query("i7_weights_from_models", "SELECT label::VARCHAR AS label, count(*) * 64 AS n, round(sum(list_sum(embedding)::DOUBLE), 3) AS total FROM embeddings GROUP BY label")
def i7(spark, sf_dir):
    models = table(spark, sf_dir, "embeddings").select(F.array(F.col("label").cast("string")).alias("label"), F.col("embedding").alias("coef"))
    return em.weights_from_models(models).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("w").cast("double")), 3).alias("total"))


@query(
    "i8_merge",
    f"WITH {W_SQL}, a AS (SELECT * FROM w0 WHERE w > 0 AND label < 'd5'), b AS (SELECT * FROM w0 WHERE w < 0.1 AND label >= 'd3'), n AS (SELECT label, count(DISTINCT k) AS k FROM (SELECT label, 1 AS k FROM a UNION SELECT label, 2 FROM b) GROUP BY label) SELECT label, token_id, round(sum(w) / max(k), 6) AS w FROM (SELECT * FROM a UNION ALL SELECT * FROM b) JOIN n USING (label) GROUP BY label, token_id",
)
def i8(spark, sf_dir):
    w = weights(spark, sf_dir)
    return em.merge(w.filter("w > 0 and label < 'd5'"), w.filter("w < 0.1 and label >= 'd3'")).withColumn("w", F.round("w", 6))


@query("i9_tailored")
def i9(spark, sf_dir):
    """Label, sample, train and score in one go: the corpus's own embedding, on features of a segment vocabulary."""
    docs = prepared(spark, sf_dir)
    first = voc.top_k(tk.counts(docs, F.col("norm"), [-1, 2, 3]), K)
    vocabulary = cut(sg.second_vocabulary(docs, F.col("norm"), first, K))
    w = tl.tailored(docs, F.col("norm"), vocabulary, keywords=keywords(docs), min_pos=MIN_POS, max_pos=MAX_POS, min_neg=MIN_NEG, order=ORDER)
    features = vec.features(sg.segment(docs, F.col("norm"), vocabulary), F.col("tokens"), vocabulary)
    return em.transform(docs, features, w, precision="float64").withColumn("value", F.round("value", 2))


@query("i10_unit_columns", f"WITH {W_SQL} SELECT label, token_id, round(w / sqrt(sum(w * w) OVER (PARTITION BY label)), 6) AS w FROM w0")
def i10(spark, sf_dir):
    return em.unit_columns(weights(spark, sf_dir)).withColumn("w", F.round("w", 6))


@query(
    "i11_prune",
    f"""WITH {W_SQL}, a AS (SELECT label, token_id, greatest(w, 0) AS w FROM w0), s AS (SELECT *, CASE WHEN sum(w) OVER (PARTITION BY label) = 0 THEN 1 ELSE sum(w) OVER (PARTITION BY label) END AS t FROM a),
c AS (SELECT *, sum(w / t) OVER (PARTITION BY label ORDER BY w DESC, token_id ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (PARTITION BY label ORDER BY w DESC, token_id) AS r FROM s),
x AS (SELECT label, CASE WHEN max(CASE WHEN r = 1 THEN cum END) <= 0.65 THEN coalesce(arg_min(w, r) FILTER (WHERE r > 1 AND cum > 0.65), 0) ELSE 0 END AS thr FROM c GROUP BY label)
SELECT label, token_id, round(CASE WHEN w < thr THEN 0 ELSE w END, 6)::DOUBLE AS w FROM c JOIN x USING (label)""",
)
def i11(spark, sf_dir):
    return em.prune(em.clip_negative(weights(spark, sf_dir)), 0.65).withColumn("w", F.round("w", 6))


@query("i12_clip_negative", f"WITH {W_SQL} SELECT label, token_id, round(greatest(w, 0), 6)::DOUBLE AS w FROM w0")
def i12(spark, sf_dir):
    return em.prune(weights(spark, sf_dir), 1).withColumn("w", F.round("w", 6))


_TOK = f"WITH {OCC_SQL}, {W_SQL}, s AS (SELECT doc_id, label, sum(w) AS v FROM o JOIN w0 USING (token_id) GROUP BY ALL), x AS (SELECT * FROM s UNION ALL SELECT doc_id, label, 1.0 FROM documents, (SELECT DISTINCT label FROM w0) WHERE doc_id NOT IN (SELECT doc_id FROM s))"


@query("i13_embed_tokens", f"{_TOK} SELECT doc_id, label, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 5) AS value FROM x")
def i13(spark, sf_dir):
    docs = prepared(spark, sf_dir)
    return em.embed_tokens(vec.known_tokens(docs, word_column(), word_vocabulary(docs)), docs, weights(spark, sf_dir), "float64").withColumn("value", F.round("value", 5))


@query("i14_unit_rows", f"{_ENC} SELECT doc_id, label, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 5) AS value FROM x")
def i14(spark, sf_dir):
    docs = prepared(spark, sf_dir)
    return em.unit_rows(em.transform(docs, word_features(docs), weights(spark, sf_dir), precision="float64")).withColumn("value", F.round("value", 5))


# ---------------------------------------------------------------- classifiers

def _truth(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))


_PART = "('0x' || substring(md5('0:' || doc_id), 1, 8))::BIGINT % 100"


@query("c1_split", f"SELECT doc_id, CASE WHEN {_PART} < 75 THEN 'train' ELSE 'validation' END AS part FROM documents")
def c1(spark, sf_dir):
    train, rest = cl.split(table(spark, sf_dir, "documents"))
    return train.select("doc_id", F.lit("train").alias("part")).unionByName(rest.select("doc_id", F.lit("validation").alias("part")))


@query("c2_classify_tokens")
def c2(spark, sf_dir):
    docs = prepared(spark, sf_dir)
    return cl.predict(cl.token_vectors(docs, word_column(), word_vocabulary(docs)), _truth(spark, sf_dir))


@query("c3_classify_segments")
def c3(spark, sf_dir):
    docs = prepared(spark, sf_dir)
    first = voc.top_k(tk.counts(docs, F.col("norm"), [-1, 2, 3]), K)
    pieces = cut(sg.segment(docs, F.col("norm"), first))
    return cl.predict(cl.token_vectors(pieces, F.col("tokens"), voc.build_vocabulary(pieces, F.col("tokens"), K)), _truth(spark, sf_dir))


@query("c4_classify_embeddings")
def c4(spark, sf_dir):
    docs = prepared(spark, sf_dir)
    vectors, _ = em.vectors(docs, word_features(docs), weights(spark, sf_dir))
    return cl.predict(cl.dense_vectors(vectors), _truth(spark, sf_dir))


@query(
    "c5_macro_recall",
    "WITH p AS (SELECT 'loud' AS model, quality AS y, CASE WHEN contains(text, '!!') THEN 0 ELSE 1 END AS p FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'long', quality, CASE WHEN length(text) > 1000 THEN 1 ELSE 0 END FROM documents JOIN labels USING (doc_id)) SELECT model, round(avg(r), 6) AS macro_recall FROM (SELECT model, y, avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS r FROM p GROUP BY model, y) GROUP BY model",
)
def c5(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(_truth(spark, sf_dir), "doc_id")
    loud = rows.select(F.lit("loud").alias("model"), "y", F.when(F.col("text").contains("!!"), 0).otherwise(1).alias("predicted"))
    long = rows.select(F.lit("long").alias("model"), "y", F.when(F.length("text") > 1000, 1).otherwise(0).alias("predicted"))
    return cl.macro_recall(loud.unionByName(long)).withColumn("macro_recall", F.round("macro_recall", 6))


# ---------------------------------------------------------------- curation

def _dated(docs):
    return docs.withColumn("day", F.expr("date_add(DATE'2022-09-01', cast(doc_id % 60 AS int))"))


_DAY = "(DATE '2022-09-01' + (doc_id % 60)::INTEGER)"


@query("k1_drop_retweets", "SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'RT @someone ' || text ELSE text END AS text FROM documents) WHERE NOT regexp_matches(text, '^RT @')")
def k1(spark, sf_dir):
    """Every seventh document is made a retweet first: the table has none."""
    text = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("RT @someone "), "text")).otherwise(F.col("text"))
    return cu.drop_retweets(table(spark, sf_dir, "documents").withColumn("text", text)).select("doc_id")


@query("k2_mask", r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, 'https?://\S+', '_url', 'g'), '@\S+', '_usr', 'g')) AS digest FROM documents")
def k2(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(cu.mask(F.col("text"))).alias("digest"))


@query("k3_min_length", "SELECT doc_id FROM documents WHERE length(text) >= 50")
def k3(spark, sf_dir):
    return cu.min_length(table(spark, sf_dir, "documents")).select("doc_id")


@query("k4_split_by_date", f"SELECT doc_id, CASE WHEN {_DAY} < DATE '2022-10-01' THEN 'train' ELSE 'test' END AS \"set\" FROM documents WHERE {_DAY} < DATE '2022-10-01' OR {_DAY} >= DATE '2022-10-03'")
def k4(spark, sf_dir):
    return cu.split_by_date(_dated(table(spark, sf_dir, "documents")), F.col("day"), "2022-10-01", "2022-10-03").select("doc_id", "set")


@query("k5_cap", "SELECT doc_id, lang AS \"set\" FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= CASE lang WHEN 'es' THEN 50 WHEN 'en' THEN 200 ELSE 0 END")
def k5(spark, sf_dir):
    return cu.cap(table(spark, sf_dir, "documents").withColumn("set", F.col("lang")), {"es": 50, "en": 200}, ORDER).select("doc_id", "set")


@query("k6_by_country", "SELECT CASE WHEN source = 'src0' THEN 'ALL' ELSE source END AS country, count(*) AS n FROM documents GROUP BY 1")
def k6(spark, sf_dir):
    return cu.by_country(table(spark, sf_dir, "documents"), F.when(F.col("source") != "src0", F.col("source"))).groupBy("country").agg(F.count(F.lit(1)).alias("n"))


@query(
    "k7_uniform_over_days",
    f"WITH d AS (SELECT doc_id, {_DAY} AS day FROM documents), q AS {fill_sql('(SELECT day AS stratum, count(*) AS available FROM d GROUP BY day)', '500')} SELECT doc_id, day FROM (SELECT d.*, row_number() OVER (PARTITION BY day ORDER BY doc_id) AS r FROM d) JOIN q ON q.stratum = day WHERE r <= quota",
)
def k7(spark, sf_dir):
    return cu.uniform_over_days(_dated(table(spark, sf_dir, "documents")), 500, ORDER).select("doc_id", "day")


def _near_sql(days: int) -> str:
    return f"""WITH {DOCS_SQL}, s AS (SELECT DISTINCT doc_id, {_DAY} AS day, unnest(list_transform(range(1, len(w) - 3), lambda i : array_to_string(w[i : i + 4], '~'))) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND b.doc_id < a.doc_id AND abs(a.day - b.day) <= {days} GROUP BY 1, 2)
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT a FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c * 100 >= (x.n + y.n - c) * 75)"""


@query("k8_near_duplicates_day", _near_sql(0))
def k8(spark, sf_dir):
    return cu.drop_near_duplicates(_dated(normed(spark, sf_dir)).select("doc_id", "day", "norm"), 0).select("doc_id")


@query("k9_near_duplicates_window", _near_sql(2))
def k9(spark, sf_dir):
    return cu.drop_near_duplicates(_dated(normed(spark, sf_dir)).select("doc_id", "day", "norm"), 2).select("doc_id")


@query("st5_near_duplicates_stream", _near_sql(2))
def st5(spark, sf_dir):
    """As k9, from a stream of document files, days as event time."""
    where = st.scratch(spark)
    stream = _dated(st.normalized(st.read_documents(spark, f"{sf_dir}/document*.parquet")))
    repeated = sn.run_by_batch(stream, f"{where}/out", f"{where}/state", 2)
    return table(spark, sf_dir, "documents").select("doc_id").join(repeated.distinct(), "doc_id", "left_anti")


@query("k10_shuffle", "SELECT doc_id, row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) - 1 AS position FROM documents")
def k10(spark, sf_dir):
    return cu.shuffle(table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", "position")


@query("k11_size_table", "SELECT source AS country, nullif(count(*) FILTER (WHERE doc_id % 5 > 0), 0) AS train, nullif(count(*) FILTER (WHERE doc_id % 5 = 0), 0) AS test FROM documents WHERE lang = 'en' GROUP BY source")
def k11(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("lang", F.when(F.col("doc_id") % 5 > 0, "train").otherwise("test").alias("set"), F.col("source").alias("country")).agg(F.count(F.lit(1)).alias("n"))
    return cu.size_table(counts, "en", ["train", "test"])
