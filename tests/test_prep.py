"""Preparation invariants, after the reference's preprocessing tests."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankfold.operators import prep


@pytest.fixture(scope="module")
def sample_ratings(spark):
    # reference fixture shape: 500 seeded rows, users 1-30, movies 1-50, 0.5-step ratings
    rng = np.random.default_rng(42)
    n = 500
    pdf = pd.DataFrame({
        "userId": rng.integers(1, 31, n).astype("int64"),
        "movieId": rng.integers(1, 51, n).astype("int64"),
        "rating": rng.choice(np.arange(0.5, 5.01, 0.5), n),
        "timestamp": np.sort(rng.integers(946684800, 1704067200, n)).astype("int64"),
    })
    return spark.createDataFrame(pdf)


def test_kcore_minimum_counts(sample_ratings):
    res = prep.kcore(sample_ratings, 10, 5)
    pdf = res.ratings.toPandas()
    assert len(pdf) > 0
    assert pdf.groupby("userId").size().min() >= 10
    assert pdf.groupby("movieId").size().min() >= 5


def test_kcore_fixed_point_matches_pandas(sample_ratings):
    pdf = sample_ratings.toPandas()
    cur, prev = pdf, -1
    while len(cur) != prev:
        prev = len(cur)
        uc = cur["userId"].value_counts()
        cur = cur[cur["userId"].isin(uc[uc >= 16].index)]
        ic = cur["movieId"].value_counts()
        cur = cur[cur["movieId"].isin(ic[ic >= 4].index)]
    got = prep.kcore(sample_ratings, 16, 4).ratings.count()
    assert got == len(cur) and got > 0


def test_a_pass_looks_only_at_edges_of_removed_nodes(spark):
    """A chain that unravels from its end: every pass removes one node and one edge of a large table."""
    core = [(u, 1000 + i) for u in range(20) for i in range(20)]
    chain = [(100 + k // 2, 2000 + (k + 1) // 2) for k in range(12)]
    pdf = spark.createDataFrame([(u, i, 1) for u, i in core + chain], "userId long, movieId long, _rows long")
    res = prep.kcore_edges(pdf, 2, 2)
    assert sorted((r.userId, r.movieId) for r in res.edges.collect()) == sorted(core)
    assert sum(res.removed) <= 2 * len(chain) and res.passes == len(res.removed) > 5


def test_core_rows_are_scanned_where_few_nodes_go(spark, monkeypatch):
    """The core without a shuffle of its rows, and the same rows where the removed nodes are too many to broadcast."""
    from rankfold.plans.explain import summarise
    from rankfold.session import materialize

    rows = [(u, i, 1.0) for u in range(8) for i in range(8)] * 2 + [(50, 1, 2.0), (1, 60, 2.0), (None, 2, 3.0), (2, None, 3.0), (51, 60, 4.0)]
    ratings = materialize(spark.createDataFrame(rows, "userId long, movieId long, rating double"), "test-ratings")
    few = prep.kcore(ratings, 4, 4)
    assert summarise(few.ratings)["shuffles"] == 0 and summarise(few.ratings)["sort_merge_joins"] == 0
    monkeypatch.setattr(prep, "BROADCAST_NODES", 0)
    many = prep.kcore(ratings, 4, 4)
    assert sorted(map(tuple, few.ratings.collect())) == sorted(map(tuple, many.ratings.collect()))
    assert few.ratings.columns == many.ratings.columns and few.passes == many.passes and few.ratings.count() == 128


def test_implicit_pairs_are_written_once(spark, small_dir):
    from rankfold.plans import sql as S
    from rankfold.plans import stages as P

    pairs = P.implicit_train(spark, small_dir)
    best = P.part(spark, small_dir, "train").groupBy("user_idx", "movie_idx").agg(F.max("rating").alias("r")).where(F.col("r") >= S.IMPLICIT_THRESHOLD)
    assert sorted(map(tuple, pairs.collect())) == sorted((r.user_idx, r.movie_idx) for r in best.collect())
    assert P.implicit_train(spark, small_dir) is pairs


def test_the_random_split_joins_its_ratings_once(spark, small_dir):
    from rankfold.plans import catalog
    from rankfold.plans import stages as P

    out = catalog.QUERIES["random_split"](spark, small_dir)
    assert "lineitem" not in " ".join(out.inputFiles())
    assert sorted(map(tuple, out.drop("split").collect())) == sorted(map(tuple, P.ratings(spark, small_dir).collect()))


def test_cuts_match_sorting(spark):
    """Cut keys from bucket counts: ties at cuts, negative and very large keys, nulls, cuts at the ends."""
    rng = np.random.default_rng(4)
    for keys in (rng.integers(-(2**62), 2**62, 300), rng.integers(0, 4, 300), np.full(50, 7), rng.integers(0, 10**9, 200)):
        rows = [(int(k), i) for i, k in enumerate(keys)] + [(None, 900), (None, 901)]
        df = spark.createDataFrame(rows, "k long, i long")
        n = len(rows)
        cuts = [0, n // 3, n // 2, n - 1, n]
        out = prep.label_by_position(df, F.col("k"), ["i"], lambda _: cuts, list("abcdef")).collect()
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        expected = {r[1]: "abcdef"[sum(pos >= c for c in cuts)] for pos, r in enumerate(order)}
        assert {r.i: r.split for r in out} == expected


def test_kcore_collapses_to_empty(sample_ratings):
    assert prep.kcore(sample_ratings, 1000, 1).ratings.count() == 0


def test_encode_ids_contiguous_and_drops_originals(sample_ratings):
    enc = prep.encode_ids(sample_ratings)
    cols = enc.ratings.columns
    assert "userId" not in cols and "movieId" not in cols
    u = [r.encoded_id for r in enc.user_map.orderBy("encoded_id").collect()]
    assert u == list(range(len(u)))
    orig = [r.original_id for r in enc.user_map.orderBy("encoded_id").collect()]
    assert orig == sorted(orig)


def test_temporal_split_sizes_and_order(sample_ratings):
    enc = prep.encode_ids(sample_ratings).ratings
    sp = prep.temporal_split(enc, 0.7, 0.15).toPandas()
    sizes = sp["split"].value_counts()
    assert sizes["train"] == int(500 * 0.7)
    assert sizes["train"] + sizes["val"] == int(500 * 0.85)
    assert sp[sp.split == "train"]["timestamp"].max() <= sp[sp.split == "val"]["timestamp"].min()
    assert sp[sp.split == "val"]["timestamp"].max() <= sp[sp.split == "test"]["timestamp"].min()


@pytest.mark.parametrize("tf,vf", [(0.0, 0.1), (1.0, 0.1), (0.7, 0.3), (0.5, 0.0)])
def test_temporal_split_rejects_fractions(sample_ratings, tf, vf):
    with pytest.raises(prep.PreprocessingError):
        prep.temporal_split(sample_ratings, tf, vf)


def test_random_split_same_seed_same_split(sample_ratings):
    a = prep.random_split(sample_ratings, ("userId", "movieId", "timestamp"), 0.2, 42)
    b = prep.random_split(sample_ratings.repartition(3), ("userId", "movieId", "timestamp"), 0.2, 42)
    ta = sorted(map(tuple, a.where(F.col("split") == "test").toPandas().to_numpy().tolist()))
    tb = sorted(map(tuple, b.where(F.col("split") == "test").toPandas().to_numpy().tolist()))
    assert ta == tb and len(ta) == 100


def test_sparsity_edges(spark):
    from rankfold.operators.stats import sparsity

    empty = spark.createDataFrame([], "userId long, movieId long, rating double")
    assert sparsity(empty).first().sparsity == 1.0
    one = spark.createDataFrame([(1, 1, 1.0)], "userId long, movieId long, rating double")
    assert sparsity(one).first().sparsity == 0.0


def test_the_hash_of_the_bundles_split_is_written_once(spark, small_dir, monkeypatch):
    from rankfold.plans import stages as P

    monkeypatch.setattr(P, "_MEMO", {})
    seen = []
    real = prep.split_keyed
    monkeypatch.setattr(prep, "split_keyed", lambda keyed, *rest: (seen.append(keyed), real(keyed, *rest))[1])
    rows = P.bundle(spark, small_dir).split_rows
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and prep.SPLIT_KEY in plan
    expected = prep.random_split(P.ratings(spark, small_dir), ("userId", "movieId", "timestamp", "rating"), 0.2, 42)
    count = lambda df: {r.split: r["count"] for r in df.groupBy("split").count().collect()}
    assert count(rows) == count(expected)
