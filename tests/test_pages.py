"""Queries that work on whole documents: what is made of words needs no sort, join or group of one document after them."""

import pytest

from tillroll.queries import QUERIES

SF = "/root/testdata/sf0.001"
NAMES = [
    "row_clustering",
    "nearest_same_row_exclusive",
    "span_prf_relaxed",
    "decode_items",
    "candidate_pairs",
    "threshold_sweep",
    "best_threshold",
    "evaluation_summary",
    "edge_verdicts",
    "span_match_metrics",
    "context_nodes",
    "field_verdicts",
    "box_clamp_normalize",
]


@pytest.mark.parametrize("name", NAMES)
def test_words_are_not_dealt_out_again(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode(CASE") == 1  # words are made once
    after = plan.partition("Generate explode(CASE")[0]
    assert not [w for w in ("Sort", "Join", "Window", "FlatMapGroupsInPandas", "hashpartitioning(doc_id") if w in after]


def test_pages_are_read_once(spark):
    plan = QUERIES["page_words"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode(CASE") == 1 and "Union" not in plan


def test_boxes_are_clamped_outside_filters(spark):
    plan = QUERIES["box_clamp_normalize"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "bround" not in plan
