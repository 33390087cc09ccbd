"""What the registered queries share, in both languages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as nz
from ..functions import tokens as tk
from ..operators import labels as lb
from ..operators import vectorize as vec
from ..operators import vocabulary as voc
from ..sources.scratch import cut, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
K = 1 << 14  # entries of a vocabulary
N_KEYWORDS = 200
MAX_POS = MIN_NEG = 1 << 14
MIN_POS = 128


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL if it has one."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def normed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("norm", nz.normalize(F.col("text")))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, norm: normalised once, for what goes over the corpus several times."""
    return cut(normed(spark, sf_dir).select("doc_id", "lang", "source", "norm"))


def word_column():
    return tk.words(F.col("norm"))


def word_vocabulary(docs: DataFrame, k: int = K) -> DataFrame:
    return voc.build_vocabulary(docs, word_column(), k)


def word_features(docs: DataFrame, k: int = K) -> DataFrame:
    return vec.features(docs, word_column(), word_vocabulary(docs, k))


def keywords(docs: DataFrame, n: int = N_KEYWORDS) -> DataFrame:
    """Frequent words of four letters or more: what stands in for a given word list."""
    return cut(voc.top_k(voc.document_frequency(docs, word_column()).filter(F.length("token") >= 4), n))


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, labels: the segments of every document under the keyword vocabulary."""
    return cut(lb.from_segments(docs, F.col("norm"), keywords(docs)).select("doc_id", "labels"))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of every vocabulary entry out of the embeddings: entry i has vector i modulo their number, a dimension is a label."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    size = vectors.agg(F.count(F.lit(1)).alias("size"))
    entries = spark.range(K).crossJoin(F.broadcast(size)).select(F.col("id").cast("int").alias("token_id"), (F.col("id") % F.col("size")).alias("vec_id"))  # one row
    return entries.join(vectors, "vec_id").select("token_id", F.posexplode("embedding").alias("d", "w")).select(F.concat(F.lit("d"), "d").alias("label"), "token_id", F.col("w").cast("double").alias("w"))


# ---------------------------------------------------------------- SQL

SYMBOLS_SQL = r"""[;:,.@\\\-"''/()\[\]¿?¡!{}<>|]"""


def norm_sql(c: str) -> str:
    c = f"lower(coalesce({c}, ''))"
    c = rf"regexp_replace({c}, 'https?://\S+', '_url', 'g')"
    c = rf"regexp_replace({c}, '@\S+', '_usr', 'g')"
    c = f"strip_accents({c})"
    c = rf"regexp_replace({c}, '({SYMBOLS_SQL})', '~e:\1~', 'g')"
    c = rf"regexp_replace({c}, '(_htag|_ent|_num|_url|_usr)', '~e:\1~', 'g')"
    c = rf"'~' || regexp_replace({c}, '[ \t\r\n]', '~', 'g') || '~'"
    return f"regexp_replace({c}, '~+', '~', 'g')"


DOCS_SQL = f"d0 AS (SELECT *, {norm_sql('text')} AS norm FROM documents), d AS (SELECT *, string_split(norm, '~')[2:-2] AS w FROM d0)"
DF_SQL = f"{DOCS_SQL}, v0 AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(w) AS token FROM d) GROUP BY token)"
VOC_SQL = f"{DF_SQL}, v AS (SELECT token, df, (row_number() OVER (ORDER BY token) - 1)::INTEGER AS token_id, log2(n::DOUBLE / df) AS idf FROM (SELECT * FROM v0 ORDER BY df DESC, token LIMIT {K}), (SELECT count(*) AS n FROM documents))"
OCC_SQL = f"{VOC_SQL}, o AS (SELECT doc_id, pos, token_id, idf FROM (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM d) JOIN v USING (token)), c AS (SELECT doc_id, token_id, idf, count(*) AS n FROM o GROUP BY ALL)"
FEAT_SQL = f"{OCC_SQL}, f AS (SELECT doc_id, token_id, n, n * idf / sqrt(sum((n * idf) * (n * idf)) OVER (PARTITION BY doc_id)) AS value FROM c)"
LAB_SQL = f"{DF_SQL}, kw AS (SELECT token FROM v0 WHERE length(token) >= 4 ORDER BY df DESC, token LIMIT {N_KEYWORDS}), l AS (SELECT DISTINCT doc_id, token AS label FROM (SELECT doc_id, unnest(w) AS token FROM d) JOIN kw USING (token)), lf AS (SELECT label, count(*) AS freq FROM l GROUP BY label)"
RARE_SQL = f"{LAB_SQL}, r AS (SELECT doc_id, label AS rarest FROM (SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY freq, label) AS k FROM l JOIN lf USING (label)) WHERE k = 1)"
CAPS_SQL = f"{RARE_SQL}, cap AS (SELECT label, freq, least({MAX_POS}, freq) AS n_pos, greatest(least({MAX_POS}, freq), {MIN_NEG}) AS n_neg FROM lf), ld AS (SELECT DISTINCT doc_id FROM l)"
POS_SQL = f"{CAPS_SQL}, p AS (SELECT label, doc_id, 1 AS y FROM (SELECT l.label, doc_id, n_pos, row_number() OVER (PARTITION BY l.label ORDER BY doc_id) AS k FROM l JOIN cap USING (label)) WHERE k <= n_pos)"
NEG_SQL = f"{POS_SQL}, ng AS (SELECT label, doc_id, -1 AS y FROM (SELECT label, doc_id, n_neg, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS k FROM (SELECT label, doc_id, n_neg FROM cap, ld) ANTI JOIN l USING (label, doc_id)) WHERE k <= n_neg)"
TRAIN_SQL = f"{NEG_SQL}, t AS (SELECT * FROM (SELECT * FROM p UNION ALL SELECT * FROM ng) WHERE label IN (SELECT label FROM p INTERSECT SELECT label FROM ng))"
W_SQL = f"w0 AS (SELECT i::INTEGER AS token_id, unnest(embedding)::DOUBLE AS w, 'd' || (generate_subscripts(embedding, 1) - 1) AS label FROM range({K}) t(i) JOIN embeddings ON vec_id = i % (SELECT count(*) FROM embeddings))"


def fill_sql(source: str, total: str, group: str = "") -> str:
    """Even quotas over strata of `source` (stratum, available), as operators.sampling.uniform_quotas."""
    part = f"PARTITION BY {group}" if group else ""
    return f"""(SELECT *, CASE WHEN full_ THEN available ELSE (tot - given) // nullif(open_, 0) + CASE WHEN i - (kk - open_) < (tot - given) % nullif(open_, 0) THEN 1 ELSE 0 END END::BIGINT AS quota
FROM (SELECT *, sum(CASE WHEN full_ THEN available ELSE 0 END) OVER ({part})::BIGINT AS given, sum(CASE WHEN full_ THEN 0 ELSE 1 END) OVER ({part})::BIGINT AS open_
FROM (SELECT *, available * (kk - i) + before <= tot AS full_
FROM (SELECT *, {total} AS tot, row_number() OVER ({part} ORDER BY available, stratum) - 1 AS i, count(*) OVER ({part}) AS kk, (sum(available) OVER ({part} ORDER BY available, stratum ROWS UNBOUNDED PRECEDING) - available)::BIGINT AS before FROM {source}))))"""
