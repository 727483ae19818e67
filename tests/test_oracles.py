"""Registered queries against their DuckDB oracles on the smallest driver tables."""

import pytest

import __spark_entry__ as E
from rankfold.plans import catalog
from rankfold.plans.check import compare, duck

FAST = [
    "cold_start_filter", "temporal_split", "recommend_popular", "evaluate_model", "recommend_random",
    "similar_items", "diversity", "rating_cdf", "activity_rank", "tag_tfidf", "bm25_weight",
    "request_rate", "sustained_alerts", "latency_histogram_quantiles", "drift_columns",
    "recommend_content", "auc_per_user", "recommend_all", "quarterly_rating",
]


@pytest.fixture(scope="module")
def con(small_dir):
    return duck(small_dir)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, small_dir, name):
    res = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], small_dir)
    assert res["ok"], res


ROWS_ONLY = {
    "recommend_als", "als_evaluation", "recommend_hybrid", "hybrid_evaluation", "als_grid",
    "als_best_test", "model_comparison",
}


def test_every_query_has_an_oracle_except_trained_or_timed_ones():
    assert set(E.oracle_sql()) <= set(E.queries())
    q, o = catalog.QUERIES, catalog.ORACLES
    assert set(o) <= set(q)
    assert set(q) - set(o) == ROWS_ONLY


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"user_idx", "rank", "movie_id", "title", "score", "genres"} <= set(df.columns)


PLAN_GUARD = ["recommend_popular", "evaluate_model", "metric_pivot", "latency_quantiles", "describe_features", "tag_tfidf", "recommend_all", "genre_ratings",
              "popular_items", "drift_columns", "sustained_alerts"]


@pytest.mark.parametrize("name", PLAN_GUARD)
def test_no_nested_loop_joins(spark, small_dir, name):
    from rankfold.plans.explain import summarise

    assert summarise(E.queries()[name](spark, small_dir))["nested_loop_joins"] == 0


def test_search_predicates_reach_the_scan(spark, small_dir):
    from rankfold.plans.explain import summarise

    scans = summarise(E.queries()["failed_requests"](spark, small_dir))["scans"]
    assert any("event_type" in s["pushed"] for s in scans)
    assert all(s["columns"] <= 4 for s in scans)
