"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"
CHEAP = ["n6_entities", "n7_emoticons", "n10_collapse_repeats", "n13_mark_emojis", "c1_split", "k1_drop_retweets", "k8_near_duplicates_day", "k10_shuffle", "h8_resume", "i2_encode_occurrences", "s3_load_labelled", "s5_labelled_lines", "n8_strip_marks", "n17_normalize", "n19_several_texts", "t9_segment_tokens", "i4_from_features", "st4_scores_on_stream", "t3_q_grams_in_words", "v3_top_k", "v4_token_ids", "e3_tf_idf", "l6_rarest_label", "g2_negatives", "g3_stratified_negatives", "g4_uniform_quotas", "h1_class_weights", "i4_transform", "i11_prune", "k7_uniform_over_days", "k9_near_duplicates_window", "k11_size_table", "m1_identity", "st1_normalize_stream"]


def plain(rows, names):
    show = lambda v: "-" if v is None or v != v else f"{float(v):.5f}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[names.index(c)]) for c in sorted(names)) for r in rows)


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.sql(e.oracle_sql()[name])
    got = e.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)


def test_entry(spark):
    assert e.entry(spark).count() == 1000
    assert set(e.oracle_sql()) <= set(e.queries())
