"""Sources, normalisation, tokens, segmentation and streaming over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as nz
from ..functions import tokens as tk
from ..operators import identity
from ..operators import segment as sg
from ..operators import vocabulary as voc
from ..sources import corpus as src
from ..streaming import text as st
from .base import DF_SQL, DOCS_SQL, SYMBOLS_SQL, VOC_SQL, K, norm_sql, normed, prepared, query, table, word_column, word_vocabulary


@query("s1_read_corpus", "SELECT doc_id, md5(text) AS digest FROM documents")
def s1(spark, sf_dir):
    return src.read_corpus(spark, f"{sf_dir}/documents.parquet", "parquet").select("doc_id", F.md5("text").alias("digest"))


@query("s2_corpus_function", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def s2(spark, sf_dir):
    return src.corpus(lambda: table(spark, sf_dir, "documents")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("s3_load_labelled", "SELECT doc_id, lang AS country, md5(text) AS digest FROM documents WHERE lang IN ('es', 'fr')")
def s3(spark, sf_dir):
    rows = src.load_labelled(table(spark, sf_dir, "documents"), ["es", "fr"], text_and_country=True, by="lang")
    return rows.select("doc_id", "country", F.md5("text").alias("digest"))


@query("s5_labelled_lines", f"WITH {DOCS_SQL} SELECT doc_id, 2::INTEGER AS n_labels, md5(norm) AS digest FROM d")
def s5(spark, sf_dir):
    lines = normed(spark, sf_dir).select("doc_id", src.labelled_lines(F.array("lang", "source"), F.col("norm")).alias("line"))
    labels, norm = src.parse_labelled(F.col("line"))
    return lines.select("doc_id", F.size(labels).alias("n_labels"), F.md5(norm).alias("digest"))


@query("s8_vocabulary_table", f"WITH {VOC_SQL} SELECT token, df, (SELECT count(*) FROM documents) AS n_docs FROM v")
def s8(spark, sf_dir):
    docs = normed(spark, sf_dir)
    path = st.scratch(spark)
    src.write_vocabulary(word_vocabulary(docs).select("token", "df"), voc.document_count(docs), {"k": K}, path)
    tokens, meta = src.read_vocabulary(spark, path)
    return tokens.crossJoin(F.broadcast(meta.select("n_docs")))


_esc = lambda pattern: pattern.replace("{", "{{").replace("}", "}}")
_SIGNS = " 🙋🏽🎉 x☀️y"  # the tables have none
_EMOJI_SQL, _MARKS_SQL = _esc(nz.EMOJI), _esc(nz.EMOJI_MARKS)
_STEPS = {
    "n1_lower": (nz.lower, "lower({0})"),
    "n2_numbers": (nz.numbers, r"regexp_replace({0}, '\d+\.?\d+|\d+', '_num', 'g')"),
    "n3_users": (nz.users, r"regexp_replace({0}, '@\S+', '_usr', 'g')"),
    "n5_hashtags": (nz.hashtags, r"regexp_replace({0}, '#\S+', '_htag', 'g')"),
    "n6_entities": (nz.entities, "array_to_string(list_transform(regexp_extract_all({0}, '[\\pL\\pN_]+|[^\\pL\\pN_]+'), lambda x : CASE WHEN regexp_full_match(x, '[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+') THEN '_ent' ELSE x END), '')"),
    "n7_emoticons": (lambda c: nz.emoticons(F.concat(c, F.lit(_SIGNS))), f"regexp_replace(regexp_replace({{0}} || '{_SIGNS}', '{_MARKS_SQL}', '', 'g'), '{_EMOJI_SQL}', '', 'g')"),
    "n8_strip_marks": (nz.strip_marks, "strip_accents({0})"),
    "n9_decompose": (nz.decompose, None),
    "n10_collapse_repeats": (nz.collapse_repeats, "array_to_string(list_filter(string_split({0}, ''), lambda x, i : i = 1 OR x <> string_split({0}, '')[i - 1]), '')"),
    "n11_delete_punctuation": (nz.delete_punctuation, f"regexp_replace({{0}}, '{SYMBOLS_SQL.replace('{', '{{').replace('}', '}}')}', '', 'g')"),
    "n12_mark_punctuation": (nz.mark_punctuation, rf"regexp_replace({{0}}, '({SYMBOLS_SQL.replace('{', '{{').replace('}', '}}')})', '~e:\1~', 'g')"),
    "n13_mark_emojis": (lambda c: nz.mark_emojis(F.concat(c, F.lit(_SIGNS))), f"regexp_replace(regexp_replace({{0}} || '{_SIGNS}', '{_MARKS_SQL}', '', 'g'), '({_EMOJI_SQL})', '~e:\\1~', 'g')"),
    "n14_mark_placeholders": (lambda c: nz.mark_placeholders(nz.users(c)), r"regexp_replace(regexp_replace({0}, '@\S+', '_usr', 'g'), '(_htag|_ent|_num|_url|_usr)', '~e:\1~', 'g')"),
    "n15_frame": (nz.frame, r"'~' || regexp_replace({0}, '[ \t\r\n]', '~', 'g') || '~'"),
    "n16_collapse_tildes": (lambda c: nz.collapse_tildes(nz.frame(c)), r"regexp_replace('~' || regexp_replace({0}, '[ \t\r\n]', '~', 'g') || '~', '~+', '~', 'g')"),
    "n17_normalize": (nz.normalize, norm_sql("{0}").replace("{}", "{{}}")),
}
for _name, (_step, _sql) in _STEPS.items():
    query(_name, f"SELECT doc_id, md5({_sql.format('text')}) AS digest FROM documents" if _sql else None)(
        lambda spark, sf_dir, step=_step: table(spark, sf_dir, "documents").select("doc_id", F.md5(step(F.col("text"))).alias("digest"))
    )


@query("n4_urls", r"SELECT page_id, regexp_replace(url, 'https?://\S+', '_url', 'g') AS url, md5(regexp_replace(html, 'https?://\S+', '_url', 'g')) AS digest FROM pages")
def n4(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", nz.urls(F.col("url")).alias("url"), F.md5(nz.urls(F.col("html"))).alias("digest"))


@query("n18_pick_text", "SELECT doc_id, md5(source) AS digest FROM documents")
def n18(spark, sf_dir):
    return src.pick_text(table(spark, sf_dir, "documents"), "source").select("doc_id", F.md5("text").alias("digest"))


@query("n19_several_texts", f"WITH c AS (SELECT conv_id, turn, {norm_sql('text')} AS norm FROM conversations) SELECT conv_id, md5(string_agg(norm, ' ' ORDER BY turn, norm)) AS digest FROM c GROUP BY conv_id")
def n19(spark, sf_dir):
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", nz.normalize(F.col("text")).alias("k"), F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    texts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("texts"))
    return texts.select("conv_id", F.md5(nz.normalize_texts(F.col("texts"))).alias("digest"))


def _array(name, make, sql):
    """Number and digest of an array of tokens for every document."""
    query(name, f"WITH {DOCS_SQL}, x AS (SELECT doc_id, {sql} AS a FROM d) SELECT doc_id, len(a)::BIGINT AS n, md5(array_to_string(a, ' ')) AS digest FROM x" if sql else None)(
        lambda spark, sf_dir: normed(spark, sf_dir).select("doc_id", make().alias("a")).select("doc_id", F.size("a").cast("long").alias("n"), F.md5(F.array_join("a", " ")).alias("digest"))
    )


def _ngram_sql(n: int) -> str:
    return f"list_transform(range(1, len(w) - {n - 2}), lambda i : array_to_string(w[i : i + {n - 1}], '~'))"


def _q_sql(q: int) -> str:
    framed = "list_transform(list_filter(w, lambda x : NOT starts_with(x, 'e:')), lambda x : '~' || x || '~')"
    return f"flatten(list_transform({framed}, lambda x : list_transform(range(1, length(x) - {q - 2}), lambda i : 'q:' || substring(x, i, {q}))))"


_RUNS_SQL = r"list_filter(list_transform(string_split(regexp_replace(norm, '~(?:e:[^~]*~)+', chr(1), 'g'), chr(1)), lambda x : trim(x, '~')), lambda x : x <> '')"
_array("t1_words", word_column, "w")
_array("t2_word_pairs", lambda: tk.word_ngrams(word_column(), 2), _ngram_sql(2))
_array("t3_q_grams_in_words", lambda: tk.q_grams_in_words(F.col("norm"), [2, 3]), f"list_concat({_q_sql(2)}, {_q_sql(3)})")
_array("t4_q_grams_across", lambda: tk.q_grams_across(F.col("norm"), [7]), f"flatten(list_transform(list_transform({_RUNS_SQL}, lambda x : '~' || x || '~'), lambda x : list_transform(range(1, length(x) - 5), lambda i : 'q:' || substring(x, i, 7))))")
_array("t5_tokenize", lambda: tk.tokenize(F.col("norm")), f"list_concat(list_concat({_ngram_sql(2)}, w), list_concat({_q_sql(2)}, list_concat({_q_sql(3)}, {_q_sql(4)})))")
_array("t7_q_gram_mode", lambda: tk.tokenize(F.col("norm"), [-1, 5], q_grams_words=False), f"list_concat(w, flatten(list_transform(list_transform({_RUNS_SQL}, lambda x : '~' || x || '~'), lambda x : list_transform(range(1, length(x) - 3), lambda i : 'q:' || substring(x, i, 5)))))")


@query("t6_default_tokens", "SELECT doc_id, CASE WHEN lang IN ('ja', 'zh') THEN '1,2,3' ELSE '-2,-1,2,3,4' END AS tokens FROM documents")
def t6(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tk.token_list_column(F.col("lang")).cast("array<string>"), ",").alias("tokens"))


def segment_sql(docs: str, first: str, levels: int = 17) -> str:
    """CTEs: sg (doc_id, s, token, surface), the segments of `docs` (doc_id, norm) under the tokens of `first`.

    Every start walks on while the text is a prefix of a surface; the chain of
    jumps from a text's beginning comes from doubling the jumps (2^levels of them).
    """
    jumps, seen = [], []
    for k in range(levels):
        seen.append(f"r{k + 1} AS MATERIALIZED (SELECT g FROM r{k} UNION SELECT j.nxt FROM r{k} JOIN j{k} j USING (g))")
        jumps.append(f"j{k + 1} AS MATERIALIZED (SELECT a.g, b.nxt FROM j{k} a JOIN j{k} b ON a.nxt = b.g)")
    double = ", ".join(x for pair in zip(seen, jumps) for x in pair)
    return f"""s0 AS (SELECT token, CASE WHEN starts_with(token, 'q:') THEN substring(token, 3) ELSE '~' || token || '~' END AS surface FROM {first}),
s1 AS (SELECT surface, token FROM (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY starts_with(token, 'q:'), token) AS r FROM s0) WHERE r = 1),
s2 AS (SELECT surface, token FROM s1 UNION ALL SELECT '~e:', token FROM s1 WHERE surface = '~e:~' AND NOT EXISTS (SELECT 1 FROM s1 WHERE surface = '~e:')),
pr AS MATERIALIZED (SELECT substring(surface, 1, n) AS part, max(CASE WHEN n = length(surface) THEN token END) AS token FROM (SELECT *, unnest(range(1, length(surface) + 1)) AS n FROM s2) GROUP BY part),
dn AS MATERIALIZED (SELECT doc_id, norm, length(norm) AS size, (sum(length(norm)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - length(norm))::BIGINT AS base FROM {docs}),
ds AS MATERIALIZED (SELECT doc_id, size, base, s, substring(norm, s, (SELECT max(length(surface)) FROM s2)) AS rest FROM (SELECT *, unnest(range(1, size + 1)) AS s FROM dn)),
wk AS (SELECT base + s AS g, rest, 1 AS n, pr.token FROM ds JOIN pr ON pr.part = substring(rest, 1, 1)
       UNION ALL SELECT g, rest, n + 1, pr.token FROM wk JOIN pr ON pr.part = substring(rest, 1, n + 1) WHERE n < length(rest)),
ms AS (SELECT g, max(n) AS far, max(n) FILTER (WHERE token IS NOT NULL) AS hit, arg_max(token, n) FILTER (WHERE token IS NOT NULL) AS token FROM wk GROUP BY g),
es AS MATERIALIZED (SELECT doc_id, s, base + s AS g, token, substring(rest, 1, hit) AS surface,
  CASE WHEN s + coalesce(far, 0) > size THEN NULL WHEN far IS NULL THEN base + s + 1
       WHEN coalesce(hit, far) >= 2 AND substring(rest, coalesce(hit, far), 1) = '~' THEN base + s + coalesce(hit, far) - 1 ELSE base + s + coalesce(hit, far) END AS nxt
  FROM ds LEFT JOIN ms ON ms.g = base + s),
r0 AS MATERIALIZED (SELECT g FROM es WHERE s = 1), j0 AS MATERIALIZED (SELECT g, nxt FROM es WHERE nxt IS NOT NULL), {double},
sg AS (SELECT doc_id, s, token, surface FROM es JOIN r{levels} USING (g) WHERE token IS NOT NULL)"""


FIRST_SQL = f"""q AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(list_concat({_q_sql(2)}, {_q_sql(3)})) AS token FROM d) GROUP BY token),
first AS (SELECT token FROM (SELECT * FROM v0 UNION ALL SELECT * FROM q) ORDER BY df DESC, token LIMIT {K})"""
SEGMENT_SQL = f"WITH RECURSIVE {DF_SQL}, {FIRST_SQL}, {segment_sql('d', 'first')}"
_DIGEST_SQL = "SELECT doc_id, count(s) AS n, md5(coalesce(string_agg({}, ' ' ORDER BY s), '')) AS digest FROM dn LEFT JOIN sg USING (doc_id) GROUP BY doc_id"


@query("t8_segment", f"{SEGMENT_SQL} {_DIGEST_SQL.format('surface')}")
def t8(spark, sf_dir):
    """Segments against the K most frequent tokens of the corpus itself."""
    docs = prepared(spark, sf_dir)
    vocabulary = voc.top_k(tk.counts(docs, F.col("norm"), [-1, 2, 3]), K)
    pieces = sg.segmenter(sg.surfaces(vocabulary), names=False)
    return docs.select("doc_id", pieces(F.col("norm")).alias("a")).select("doc_id", F.size("a").cast("long").alias("n"), F.md5(F.array_join("a", " ")).alias("digest"))


@query("t9_segment_tokens", f"{SEGMENT_SQL} {_DIGEST_SQL.format('token')}")
def t9(spark, sf_dir):
    docs = prepared(spark, sf_dir)
    vocabulary = voc.top_k(tk.counts(docs, F.col("norm"), [-1, 2, 3]), K)
    return sg.segment(docs, F.col("norm"), vocabulary).select("doc_id", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query(
    "t10_surfaces",
    f"""WITH {DF_SQL}, q AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_q_sql(3)}) AS token FROM d) GROUP BY token),
a AS (SELECT token FROM (SELECT * FROM v0 UNION ALL SELECT * FROM q) ORDER BY df DESC, token LIMIT {K}),
s AS (SELECT token, CASE WHEN starts_with(token, 'q:') THEN substring(token, 3) ELSE '~' || token || '~' END AS surface FROM a),
b AS (SELECT surface, token FROM (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY starts_with(token, 'q:'), token) AS r FROM s) WHERE r = 1)
SELECT surface, token FROM b UNION ALL SELECT '~e:', token FROM b WHERE surface = '~e:~' AND NOT EXISTS (SELECT 1 FROM b WHERE surface = '~e:')""",
)
def t10(spark, sf_dir):
    docs = prepared(spark, sf_dir)
    return sg.surfaces(voc.top_k(voc.document_frequency(docs, tk.tokenize(F.col("norm"), [-1, 3])), K))


@query("m1_identity", f"WITH {VOC_SQL} SELECT token, 'Segments_' || md5('k=500 lang=es') AS model_id FROM v")
def m1(spark, sf_dir):
    return identity.with_identifier(word_vocabulary(normed(spark, sf_dir)).select("token"), "Segments", {"lang": "es", "k": 500, "lc": True}, {"lc": True, "k": 100})


@query("st1_normalize_stream", f"WITH {DOCS_SQL} SELECT doc_id, md5(norm) AS digest FROM d")
def st1(spark, sf_dir):
    """The stream of document files, run over all that is there."""
    where = st.scratch(spark)
    stream = st.normalized(st.read_documents(spark, f"{sf_dir}/document*.parquet")).select("doc_id", F.md5("norm").alias("digest"))
    return st.run_once(stream, f"{where}/out", f"{where}/state")


@query("st2_count_per_batch", f"WITH {DOCS_SQL} SELECT lang, count(*) AS n, sum(len(w))::BIGINT AS n_words FROM d GROUP BY lang")
def st2(spark, sf_dir):
    """Grouped work on a stream runs on each micro-batch; the batches' sums are added up."""
    where = st.scratch(spark)
    stream = st.normalized(st.read_documents(spark, f"{sf_dir}/document*.parquet")).select("lang", F.size(word_column()).alias("k"))
    each = st.run_once(stream, f"{where}/out", f"{where}/state", lambda b: b.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k")))
    return each.groupBy("lang").agg(F.sum("n").alias("n"), F.sum("k").alias("n_words"))


@query("st3_repeats_in_window", "WITH e AS (SELECT DISTINCT user_id, event_type FROM events) SELECT event_type, count(*) AS n FROM e GROUP BY event_type")
def st3(spark, sf_dir):
    """Repeats within a watermark: a user's events of one type, all inside the window of 60 days."""
    where = st.scratch(spark)
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event*.parquet").select("ts", F.concat_ws(" ", "user_id", "event_type").alias("text"), "event_type")
    kept = st.without_repeats(stream, "ts", "60 days").select("event_type")
    return st.run_once(kept, f"{where}/out", f"{where}/state").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
