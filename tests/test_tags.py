"""Tag texts, their counts and weights; metadata of lists."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rankfold.operators import features as FE
from rankfold.operators import serve as SV
from rankfold.sources import tables

TEXTS = [(1, "red blue red"), (1, "Blue, green!"), (2, "red"), (3, None), (3, "--"), (4, "b b c d"), (None, "red x")]


def by_force():
    tf = Counter((i, w) for i, t in TEXTS for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split())
    items, df = {i for i, _ in tf}, Counter(w for _, w in tf)
    n = len(items - {None}) + (None in items)
    w = {k: c * (math.log((1 + n) / (1 + df[k[1]])) + 1) for k, c in tf.items()}
    norm = Counter()
    for (i, _), x in w.items():
        norm[i] += x * x
    return {k: x / math.sqrt(norm[k[0]]) for k, x in w.items() if k[0] is not None}


@pytest.mark.parametrize("text_bytes, terms", [(1 << 20, 100), (8, 100), (1 << 20, 1), (1 << 20, 0), (8, 2)])
def test_text_weights_match_brute_force(spark, monkeypatch, text_bytes, terms):
    """Items cut into parts, terms broadcast or not: the same weights."""
    monkeypatch.setattr(FE, "TEXT_BYTES", text_bytes)
    monkeypatch.setattr(FE, "BROADCAST_TERMS", terms)
    texts = spark.createDataFrame(TEXTS, "movieId long, text string")
    got = {(r.movieId, r.tag): r.tfidf for r in FE.text_tfidf(texts, tables.words_of).collect()}
    assert got == pytest.approx(by_force())


def test_no_texts_no_weights(spark):
    texts = spark.createDataFrame([], "movieId long, text string")
    assert FE.text_tfidf(texts, tables.words_of).count() == 0


def test_words_are_cut_after_the_joins(spark, small_dir):
    from rankfold.plans import catalog

    plan = catalog.QUERIES["surviving_tags"](spark, small_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join LeftSemi")


@pytest.mark.parametrize("listed", [False, True])
def test_enrichment_joins_lists_once(spark, listed):
    recs = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (2, 0, 1), (2, 2, 2), (3, 30, 1), (4, None, 1), (5, 50, 1)], "user_idx int, movie_idx int, rank int")
    ids = spark.createDataFrame([(10, 0), (20, 1), (40, 2)], "original_id long, encoded_id int")
    movies = spark.createDataFrame([(10, "A", "x| y|"), (10, "A2", None), (20, None, "(no genres listed)"), (30, "C", "z"), (0, "D", "w")], "movieId long, title string, genres string")
    out = SV.enrich(recs, ids, movies, items=recs if listed else None)
    assert out.columns == ["user_idx", "rank", "movie_id", "title", "genres"]
    got = sorted((r.user_idx, r["rank"], r.movie_id, r.title, tuple(r.genres)) for r in out.where(F.col("user_idx") != 4).collect())
    first = [(u, 1, 10, t, g) for u in (1, 2) for t, g in (("A", ("x", "y")), ("A2", ()))]
    assert got == sorted([*first, (1, 2, 20, "Movie 20", ()), (2, 2, 40, "Movie 40", ()), (3, 1, 30, "C", ("z",)), (5, 1, 50, "Movie 50", ())])
    none = out.where("user_idx = 4").first()
    assert none.movie_id is None and none.title is None and none.genres == []
    if listed:
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan
