"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, decontaminate, jaccard_join, langid, license_scan, line_dedup, lm_score, merkle_manifest, quality_model, quality_rules, secrets, substring_dedup
from ._common import read_table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(read_table(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.report(read_table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + k - 1], ' ')) AS g
      FROM (SELECT doc_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS m FROM d UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.v WHERE r.m < e.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.m) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.v = d.doc_id GROUP BY ALL
"""


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents"))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(read_table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(read_table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bn AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win
       FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256
       FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP10_SQL = """
WITH l AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 2], chr(10)) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM l WHERE len(w) >= 3)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win WHERE regexp_matches(k, '[^\\x20\\x09-\\x0D]')),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS i FROM ranked WHERE r > 1),
one AS (SELECT doc_id, unnest(w) AS line, unnest(range(1, len(w) + 1)) AS i FROM l),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM one ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT l.doc_id, (CASE WHEN l.text = '' THEN 0 ELSE len(l.w) END)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM l LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

def op11_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(read_table(spark, sf_dir, "documents"))


_ALNUM = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_TEMPLATES = ", ".join(f"({k}, '{t.lower()}', '{label}', {phrase})" for k, (t, label, phrase) in enumerate([(*x, True) for x in license_scan.PHRASES] + [(*x, False) for x in license_scan.NOTICES]))
_NEAR = f"(PARTITION BY rid, template ORDER BY diagonal RANGE BETWEEN {license_scan.DRIFT} PRECEDING AND {license_scan.DRIFT} FOLLOWING)"

OP11_SQL = f"""
WITH t AS (SELECT *, CASE WHEN phrase THEN len(w) ELSE least({license_scan.GRAM}, len(w)) END AS k FROM (SELECT template, label, phrase, {_ALNUM.format('text')} AS w FROM (VALUES {_TEMPLATES}) v(template, text, label, phrase))),
tg AS (SELECT template, label, phrase, k, place, array_to_string(w[place + 1 : place + k], ' ') AS gram FROM (SELECT *, unnest(range(len(w) - k + 1)) AS place FROM t)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_ALNUM.format(_LOWER)} AS w FROM documents),
dg AS (SELECT rid, k, i AS at_, array_to_string(w[i + 1 : i + k], ' ') AS gram FROM (SELECT rid, w, k, unnest(range(len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM t) WHERE len(w) >= k)),
v AS (SELECT rid, template, label, phrase, at_ - place AS diagonal, count(*) AS votes, min(at_) AS first_at FROM dg JOIN tg USING (k, gram) GROUP BY ALL),
b AS (SELECT rid, template, label, diagonal, list(diagonal) OVER {_NEAR} AS band, sum(votes) OVER {_NEAR} AS total, min(first_at) OVER {_NEAR} AS first_at FROM v WHERE NOT phrase),
p AS (SELECT * FROM (SELECT *, max({{'total': total, 'd': -diagonal}}) OVER {_NEAR} AS best FROM b) WHERE best.d = -diagonal),
c AS (SELECT p.rid, p.template, p.label, p.diagonal, p.first_at, unnest(p.band) AS x, t.w AS tw FROM p JOIN t USING (template) WHERE p.total >= greatest(1, ceil((len(t.w) - t.k + 1) * {license_scan.LEAST_VOTES} - 1e-9))),
m AS (SELECT rid, template, label, diagonal, first_at, x, tw, unnest(range(len(tw))) AS q FROM c),
s1 AS (SELECT rid, template, label, diagonal, first_at, count(DISTINCT q) AS hits, count(DISTINCT q) / any_value(len(tw)) AS score FROM m JOIN d USING (rid) WHERE q + x >= 0 AND q + x < len(d.w) AND d.w[q + x + 1] = tw[q + 1] GROUP BY ALL HAVING score >= {license_scan.MATCH}),
s AS (SELECT * FROM s1 QUALIFY {{'h': hits, 's': score}} = max({{'h': hits, 's': score}}) OVER (PARTITION BY rid ORDER BY first_at RANGE BETWEEN {license_scan.SAME} PRECEDING AND {license_scan.SAME} FOLLOWING)),
base AS (SELECT rid, count(*) AS n_base, min(first_at) AS first_word, max(first_at) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM v WHERE phrase GROUP BY rid),
every AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM (SELECT rid, label, score FROM s UNION ALL SELECT rid, label, 1.0::DOUBLE FROM v WHERE phrase) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN every USING (rid)
"""


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.report(read_table(spark, sf_dir, "documents"))


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


def _levels(name: str, levels: int) -> str:
    """CTEs {name}0 (g, i, h) to {name}{levels}: each run of 8 becomes one node where its group has several; before and after: the siblings."""
    out = []
    for k in range(levels):
        out.append(f"{name}{k}s AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS n, list(h) OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS run FROM {name}{k})")
        out.append(f"{name}{k + 1} AS (SELECT g, i // 8 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(array_to_string(any_value(run), '')) END AS h FROM {name}{k}s GROUP BY g, i // 8)")
        out.append(f"{name}{k}p AS (SELECT g, i, CASE WHEN n = 1 THEN NULL ELSE array_to_string(run[1 : i % 8], '') END AS b, CASE WHEN n = 1 THEN NULL ELSE array_to_string(run[i % 8 + 2 :], '') END AS a FROM {name}{k}s)")
    return ",\n".join(out)


def _folds(name: str, levels: int) -> str:
    """CTEs {name}f0 (.., g, i, fold, proof) to {name}f{levels}: a node folded with its siblings, level by level."""
    return ",\n".join(
        f"{name}f{k + 1} AS (SELECT f.* REPLACE (f.i // 8 AS i, CASE WHEN b IS NULL THEN fold ELSE sha256(b || fold || a) END AS fold, proof || coalesce(b || a, '') AS proof) FROM {name}f{k} f JOIN {name}{k}p p ON p.g IS NOT DISTINCT FROM f.g AND p.i = f.i)"
        for k in range(levels)
    )


_CRC_TABLE = "(SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) FROM range(256) t(n))"


def _crc32(text: str) -> str:
    """Of ASCII text, with a table t in scope."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, t[xor(c & 255, x)::INT + 1])), 4294967295)"


OP12_SQL = f"""
WITH crc AS (SELECT {_CRC_TABLE} AS t),
d AS (SELECT doc_id, lang, sha256({' || '.join(_field(c) for c in merkle_manifest.FIELDS)}) AS leaf,
  CASE WHEN {_crc32('doc_id::VARCHAR')} % 3 = 0 THEN sha256({' || '.join(_field(c if c != 'text' else "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')") for c in merkle_manifest.FIELDS)}) END AS other FROM documents, crc),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM d),
a0 AS (SELECT lang AS g, rank AS i, leaf AS h FROM r),
{_levels('a', 9)},
b0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, g AS name, h FROM a9),
{_levels('b', 9)},
af0 AS (SELECT doc_id, leaf, lang, lang AS g, rank AS i, coalesce(other, leaf) AS fold, '' AS proof FROM r),
{_folds('a', 9)},
bf0 AS (SELECT f.* REPLACE (0 AS g, b0.i AS i), b0.h AS subroot FROM af9 f JOIN b0 ON f.lang IS NOT DISTINCT FROM b0.name),
{_folds('b', 9)}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified FROM bf9, b9
"""

def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read_table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
o AS (SELECT lang, size, w[i : i + size - 1] AS w FROM (SELECT lang, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM p, range(1, {collocations.DEPTH + 1}) t(size) WHERE len(w) >= size)),
f AS (SELECT lang, size, array_to_string(w, ' ') AS phrase, any_value(w) AS w, count(*) AS a FROM o GROUP BY lang, size, array_to_string(w, ' ') HAVING count(*) >= {collocations.LEAST}),
c AS (SELECT * FROM f WHERE size > 1),
k AS (SELECT c.lang, c.size, c.phrase, c.a, k, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a + r.a) AS score
      FROM (SELECT *, unnest(range(1, size)) AS k FROM c) c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : k], ' ') AND l.size = k
      JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1 :], ' ') AND r.size = c.size - k),
s AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(w[x : x + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, w, a, m, unnest(range(1, size - m + 2)) AS x FROM c, range(2, {collocations.DEPTH}) t(m) WHERE size > m) GROUP BY ALL),
kept AS (SELECT s.* FROM s LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {collocations.CONTAINED} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= {collocations.TOP}
"""

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_langid": op2_langid,
    "op3_secrets": op3_secrets,
    "op4_substrings": op4_substrings,
    "op5_jaccard": op5_jaccard,
    "op6_quality_rules": op6_quality_rules,
    "op7_quality_model": op7_quality_model,
    "op8_lm_score": op8_lm_score,
    "op9_decontaminate": op9_decontaminate,
    "op10_line_dedup": op10_line_dedup,
    "op11_license": op11_license,
    "op12_merkle": op12_merkle,
    "op13_collocations": op13_collocations,
}
ORACLE_SQL: dict[str, str] = {"op5_jaccard": OP5_SQL, "op9_decontaminate": OP9_SQL, "op10_line_dedup": OP10_SQL, "op11_license": OP11_SQL, "op12_merkle": OP12_SQL, "op13_collocations": OP13_SQL}
