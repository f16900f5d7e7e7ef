"""Queries against their SQL in DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from winnowry.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
SOME = [
    "entry_top20", "p2_mid_rank", "p5_stratified_rank", "p13_sharpness", "p22_offline_score", "j6_replay_lookup", "j9_scene_match", "w8_capped_top",
    "w11_match_budget", "a1_threshold", "a6_auc", "a9_hypergeometric", "a17_mcnemar", "a18_permutation", "a33_latency", "q1_leader_groups",
    "q2_scene_groups", "q7_apply_verdicts", "a10_report", "p1_distinct_rank", "w1_champions_first", "a2_near_pairs", "a3_concentration", "q3_tournament", "q4_rejected_groups", "q5_spread_selection", "q6_marginal_contests", "q8_invariants", "s3_strided_sample",
    "u6_families", "st1_status", "st4_sequence_report", "j14_nearest", "w13_anchor_choice", "a41_wasted", "q9_plan_handshake", "q10_fold_directions", "p18_best_support", "p19_rule_classifier",
    "a13_median_reference", "a34_group_summary", "a31_valid_runs", "a32_run_scores", "a39_record_consistency", "a29_retest", "j12_complete_shards",
]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in cols) for r in df.collect()], key=str)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert got == sorted([tuple(plain(r[i]) for i in at) for r in want.fetchall()], key=str)
