"""Recommenders on the reference's 4x6 interaction fixture."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfold.operators import recommend as R
from rankfold.operators.vectors import blocked_topk

# fixed values: u0:{0,2,3} u1:{1,3,4} u2:{0,1,5} u3:{2,4,5}
SEEN = {0: [0, 2, 3], 1: [1, 3, 4], 2: [0, 1, 5], 3: [2, 4, 5]}


@pytest.fixture(scope="module")
def inter(spark):
    return spark.createDataFrame([(u, i) for u, its in SEEN.items() for i in its], "user_idx int, movie_idx int")


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(u,) for u in range(5)], "user_idx int")  # user 4 has no history


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i,) for i in range(6)], "movie_idx int")


def test_popularity_excludes_seen_and_orders(inter, users, items):
    recs = R.recommend_popular(users, items, inter, 2, 6).toPandas()
    for u, its in SEEN.items():
        got = recs[recs.user_idx == u].sort_values("rank")
        assert len(got) == 2
        assert not set(got.movie_idx) & set(its)
        assert list(got.score) == sorted(got.score, reverse=True)
    assert len(recs[recs.user_idx == 4]) == 2


def test_popularity_short_list_when_catalogue_exhausted(inter, users, items):
    recs = R.recommend_popular(users, items, inter, 10, 6).toPandas()
    assert (recs.groupby("user_idx").size().loc[[0, 1, 2, 3]] == 3).all()
    assert len(recs[recs.user_idx == 4]) == 6


def test_random_length_unseen_deterministic(inter, users):
    a = R.recommend_random(users, inter, 3, 6, seed=42).toPandas()
    b = R.recommend_random(users.repartition(3), inter, 3, 6, seed=42).toPandas()
    assert a.sort_values(["user_idx", "rank"]).movie_idx.tolist() == b.sort_values(["user_idx", "rank"]).movie_idx.tolist()
    for u, its in SEEN.items():
        got = a[a.user_idx == u]
        assert len(got) == 3 and not set(got.movie_idx) & set(its)
        assert got.movie_idx.nunique() == 3
    assert all(s == pytest.approx(1 / 3) for s in a.score)


def test_similar_items_excludes_self(spark):
    vecs = spark.createDataFrame([(i, [float(i % 3 == 0), float(i % 3 == 1), 1.0]) for i in range(6)],
                                 "item_idx long, vec array<double>")
    out = blocked_topk(vecs, 2, block_vectors=1).toPandas()
    assert (out.item_idx != out.neighbor).all()
    assert (out.groupby("item_idx").size() == 2).all()
    # items 0 and 3 share a vector: each is the other's best neighbour
    best = out[out["rank"] == 1].set_index("item_idx").neighbor
    assert best[0] == 3 and best[3] == 0


def test_similar_items_zero_target_has_no_list(spark):
    vecs = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "item_idx long, vec array<double>")
    out = blocked_topk(vecs, 5).toPandas()
    assert 0 not in set(out.item_idx)
    assert set(out[out.item_idx == 1].neighbor) == {0, 2}


def test_blocks_do_not_change_lists_with_ties_at_the_cut(spark):
    import numpy as np

    from rankfold.operators.models import recommend_scored
    from rankfold.operators.vectors import top_scores

    rng = np.random.default_rng(3)
    # few different small vectors: many ties at every cut
    items = spark.createDataFrame([(i, rng.integers(-1, 2, 3).astype(float).tolist()) for i in range(90)], "movie_idx int, vec array<double>")
    users = spark.createDataFrame([(u, rng.integers(-1, 2, 3).astype(float).tolist(), int(u % 9)) for u in range(40)], "user_idx int, vec array<double>, k int")
    seen = spark.createDataFrame([(int(u), int(i)) for u, i in rng.integers(0, 40, (300, 2))], "user_idx int, movie_idx int")
    lists = [
        top_scores(users, items, "k", "user_idx", "movie_idx", cosine=c, seen=seen, block_vectors=b, out_key="movie_idx").orderBy("user_idx", "rank").select("user_idx", "movie_idx", "rank").collect()
        for c in (True, False) for b in (None, 2, 1)
    ]
    assert lists[0] == lists[1] == lists[2] and lists[3] == lists[4] == lists[5]
    taken = {(r.user_idx, r.movie_idx) for r in seen.collect()}
    assert not any((r.user_idx, r.movie_idx) in taken for r in lists[3])
    vec = {r.movie_idx: np.array(r.vec) for r in items.collect()}
    for u in users.collect():
        free = [i for i in vec if (u.user_idx, i) not in taken]
        expected = sorted(free, key=lambda i: (-round(float(vec[i] @ np.array(u.vec)), 9), i))[: u.k]
        assert [r.movie_idx for r in lists[3] if r.user_idx == u.user_idx] == expected
    assert recommend_scored(users, items, seen, 4, cosine=False).count() == 40 * 4


@pytest.mark.parametrize("cosine", [True, False])
def test_bounds_skip_blocks_and_lose_nothing(spark, cosine):
    import numpy as np

    from rankfold.operators.vectors import top_scores

    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 8)) * 5
    data = np.concatenate([c + rng.normal(size=(40, 8)) * 0.2 for c in centres]) * rng.uniform(0.5, 2, (1200, 1))
    data[::50] = data[3]  # repeated vectors
    data[7] = 0
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "item_idx long, vec array<double>")
    queries = data[::9] + rng.normal(size=(len(data[::9]), 8)) * 0.1
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "q long, vec array<double>")
    report = {}
    got = top_scores(left, items, 6, "q", "item_idx", cosine=cosine, block_vectors=20, report=report).orderBy("q", "rank").collect()
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    scores = unit(queries) @ unit(data).T if cosine else queries @ data.T
    for q in range(len(queries)):
        expected = sorted(range(len(data)), key=lambda i: (-round(float(scores[q, i]), 9), i))[:6]
        assert [r.neighbor for r in got if r.q == q] == expected
    assert report["blocks"] > 40 and report["pairs"] == len(queries) * report["blocks"] and report["scored"] < 0.6 * report["pairs"]


def test_no_candidates_no_lists(spark):
    vecs = spark.createDataFrame([], "item_idx long, vec array<double>")
    assert blocked_topk(vecs, 3).count() == 0


def test_item_feature_rows_sum_to_one(spark):
    from rankfold.operators.features import item_feature_matrix

    im = spark.createDataFrame([(10, 0), (11, 1), (12, 2)], "original_id long, encoded_id int")
    movies = spark.createDataFrame([(10, "a", "Action|Drama|Action"), (11, "b", None), (12, "c", "(no genres listed)")],
                                   "movieId long, title string, genres string")
    vocab = spark.createDataFrame([("Action", 0), ("Drama", 1)], "genre string, genre_id int")
    m = item_feature_matrix(im, movies, vocab)
    sums = {r.item_idx: r.s for r in m.groupBy("item_idx").agg(F.sum("weight").alias("s")).collect()}
    assert all(v == pytest.approx(1.0) for v in sums.values())
    assert m.where("item_idx = 0").count() == 3


def test_auc_user_scores_matches_brute_force(spark):
    import numpy as np

    from rankfold.operators.models import auc_user_scores

    rng = np.random.default_rng(11)
    n_users, n_items, d = 6, 15, 3
    U = rng.integers(-2, 3, (n_users, d)).astype(float)  # small integers: ties happen
    V = rng.integers(-2, 3, (n_items, d)).astype(float)
    train = [(u, int(i)) for u in range(n_users) for i in rng.choice(n_items, 4, replace=False)]
    test = [(u, int(i)) for u in range(n_users) for i in rng.choice(n_items, 4, replace=False)]
    uv = spark.createDataFrame([(u, U[u].tolist()) for u in range(n_users)], "user_idx int, vec array<double>")
    iv = spark.createDataFrame([(i, V[i].tolist()) for i in range(n_items)], "item_idx int, vec array<double>")
    tr = spark.createDataFrame(train, "user_idx int, item_idx int")
    te = spark.createDataFrame(test, "user_idx int, item_idx int")
    got = {r.user_idx: r.auc for r in auc_user_scores(uv, iv, tr, te).collect()}
    blocked = {r.user_idx: r.auc for r in auc_user_scores(uv, iv, tr, te, block_vectors=4).collect()}
    assert blocked == pytest.approx(got)
    for u in range(n_users):
        trs = {i for uu, i in train if uu == u}
        pos = {i for uu, i in test if uu == u} - trs
        neg = set(range(n_items)) - trs - pos
        s = V @ U[u]
        if not pos or not neg:
            assert u not in got
            continue
        wins = sum((s[p] > s[n]) + 0.5 * (s[p] == s[n]) for p in pos for n in neg)
        assert got[u] == pytest.approx(wins / (len(pos) * len(neg)))


def test_best_rows_match_sorting_with_ties():
    import numpy as np

    from rankfold.operators.vectors import best_rows

    rng = np.random.default_rng(5)
    scores = rng.integers(0, 4, (50, 30)).astype(float)  # many ties
    scores[3, :] = -np.inf
    scores[4, 5:] = -np.inf
    for k in (0, 1, 7, 30, 99):
        rows, columns, ranks = best_rows(scores, k)
        for i in range(50):
            free = [j for j in range(30) if np.isfinite(scores[i, j])]
            expected = sorted(free, key=lambda j: (-scores[i, j], j))[:k]
            assert columns[rows == i].tolist() == expected and ranks[rows == i].tolist() == list(range(1, len(expected) + 1))


def test_a_query_leaves_each_tile_with_one_list(spark, monkeypatch):
    """Blocks that cannot be skipped meet the chunks in tiles, not pair by pair."""
    import numpy as np

    from rankfold.operators import vectors as V

    rng = np.random.default_rng(5)
    data = rng.normal(size=(900, 6))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "item_idx long, vec array<double>")
    index = V.build_index(items, "item_idx", "vec", False, 10)
    rows = items.where("item_idx % 9 = 0").selectExpr("item_idx AS _l", "5 AS _k", "array(item_idx) AS _seen", "transform(vec, x -> x / 100) AS _rv")
    chunks = V.pack_chunks(rows, False)
    monkeypatch.setattr(V, "TILES_PER_CORE", 1)
    assert index.count() > 60
    per_query = {r["_l"]: r["count"] for r in V.search(chunks, index, False).groupBy("_l").count().collect()}
    assert len(per_query) == 100 and max(per_query.values()) <= 5 * (V.PROBES + 12)
    scores = data[::9] @ data.T / 100
    got = V.top_scores(rows.selectExpr("_l AS q", "_rv AS vec"), items, 5, "q", "item_idx", cosine=False, seen=rows.selectExpr("_l AS q", "_l AS item_idx"), block_vectors=10).collect()
    for q in range(100):
        expected = sorted((i for i in range(900) if i != 9 * q), key=lambda i: (-round(float(scores[q, i]), 9), i))[:5]
        assert [r.neighbor for r in sorted(got, key=lambda r: r["rank"]) if r.q == 9 * q] == expected


def test_tiles_hold_every_pair_and_send_a_block_once_for_many_chunks(spark):
    import pyarrow as pa

    from rankfold.operators.vectors import tiled

    chunks = spark.range(12, numPartitions=3).selectExpr("id AS chunk", "cast('k' AS binary) AS keys", "cast('12345678' AS binary) AS queries", "cast('s' AS binary) AS seen")
    index = spark.range(20, numPartitions=4).selectExpr("id AS block", "cast('k' AS binary) AS ids", "cast('s' AS binary) AS starts", "cast('12345678' AS binary) AS matrix")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        pairs = [(c, b) for c in left["chunk"].to_pylist() for b in right["block"].to_pylist()]
        return pa.table({"chunk": [c for c, _ in pairs], "block": [b for _, b in pairs], "blocks": [right.num_rows] * len(pairs), "chunks": [left.num_rows] * len(pairs)})

    got = tiled(chunks, None, index, work, "chunk long, block long, blocks long, chunks long", tile_bytes=40).collect()
    assert sorted((r.chunk, r.block) for r in got) == [(c, b) for c in range(12) for b in range(20)]
    assert {(r.chunks, r.blocks) for r in got} == {(4, 4)}
    routes = spark.createDataFrame([(0, 1), (1, 1), (11, 19)], "chunk long, block long")
    routed = tiled(chunks, chunks.selectExpr("chunk", "1 AS one"), index, work, "chunk long, block long, blocks long, chunks long", routes, 40).collect()
    assert sorted((r.chunk, r.block, r.chunks, r.blocks) for r in routed) == [(0, 1, 2, 1), (1, 1, 2, 1), (11, 19, 1, 1)]


@pytest.mark.parametrize("rank", [2, 9])
def test_als_rows_solve_their_normal_equations(rank):
    """Rows with fewer interactions than the rank and with more, weights of zero and below included."""
    import numpy as np

    from rankfold.operators import models as MD

    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((30, rank)).astype(np.float32)
    starts, at = np.array([0, 1, 5, 9]), rng.integers(0, 30, 24)
    weight = rng.uniform(0.1, 2, 24)
    weight[[2, 11]] = 0.0, -0.7
    gram = vectors.astype(float).T @ vectors.astype(float)
    values, basis = np.linalg.eigh(gram)
    got = MD.solve_rows(vectors, starts, at, weight, values, basis, 0.01, 40.0)
    for row, (first, last) in enumerate(zip(starts, [*starts[1:], 24], strict=True)):
        y, w = vectors[at[first:last]].astype(float), weight[first:last]
        left = gram + (y * (40.0 * np.abs(w))[:, None]).T @ y + 0.01 * (w > 0).sum() * np.eye(rank)
        want = np.linalg.solve(left, np.where(w > 0, 1 + 40.0 * w, 0.0) @ y)
        np.testing.assert_allclose(got[row], want, rtol=1e-5, atol=1e-6)


def test_als_equals_sparks(spark):
    """Same factors as Spark's ALS, whose solver worked one user at a time."""
    import numpy as np
    from pyspark.ml.recommendation import ALS

    from rankfold.operators import models as MD

    rng = np.random.default_rng(4)
    rows = [(u, int(i), float(rng.uniform(0.1, 3))) for u in range(40) for i in rng.choice(25, 1 + u % 9, replace=False)]
    df = spark.createDataFrame(rows, "user_idx int, movie_idx int, confidence double")
    users, items = MD.als_factors(df, rank=5, reg=0.01, iterations=2, alpha=40.0)
    model = ALS(
        rank=5, maxIter=2, regParam=0.01, implicitPrefs=True, alpha=40.0, userCol="user_idx", itemCol="movie_idx", ratingCol="confidence", seed=42, numUserBlocks=2, numItemBlocks=2
    ).fit(df)
    for mine, other, key in ((users, model.userFactors, "user_idx"), (items, model.itemFactors, "movie_idx")):
        got, want = {r[key]: r.vec for r in mine.collect()}, {r.id: r.features for r in other.collect()}
        assert set(got) == set(want)
        np.testing.assert_allclose([got[k] for k in sorted(got)], [want[k] for k in sorted(want)], atol=1e-5)


def _ranked_by_force(users, ranking, seen, n):
    return {(u, i, r) for u in users for r, i in enumerate([i for i in ranking if (u, i) not in seen][:n], 1)}


def test_ranked_lists_skip_only_what_lies_before_them(spark):
    """Lists equal brute force: heads seen whole, gaps, repeated pairs, unknown items and users, short catalogues."""
    ranking = [4, 0, 7, 2, 9, 1, 3, 8, 5, 6]
    pairs = [(0, i) for i in (4, 0, 7)] + [(1, i) for i in (0, 2, 1, 6)] + [(2, i) for i in ranking[:8]] + [(3, 99), (3, 6), (3, 6), (3, 4), (3, 4), (77, 4)]
    pairs += [(4, i) for i in ranking]
    seen = spark.createDataFrame(pairs, "user_idx int, movie_idx int")
    users = spark.createDataFrame([(u,) for u in range(6)], "user_idx int")
    ranked = spark.createDataFrame([(i, 1.0 / (p + 1), p) for p, i in enumerate(ranking)], "movie_idx int, score double, prank long")
    for n in (0, 1, 3, 12):
        got = R.recommend_from_ranking(users, ranked, seen, n, 10).collect()
        assert {(r.user_idx, r.movie_idx, r["rank"]) for r in got} == _ranked_by_force(range(6), ranking, set(pairs), n)
        assert all(r.score == 1.0 / (ranking.index(r.movie_idx) + 1) for r in got)
        free = R.recommend_from_ranking(users, ranked, seen, n, 10, exclude_seen=False).collect()
        assert {(r.user_idx, r.movie_idx, r["rank"]) for r in free} == _ranked_by_force(range(6), ranking, set(), n)


def test_ranked_lists_send_no_seen_pairs(spark):
    """Seen pairs meet the head of the ranking where they are: none of the shuffles before the lists takes all of them."""
    from rankfold.plans.explain import summarise
    from rankfold.session import materialize

    seen = materialize(spark.range(3000).selectExpr("cast(id % 300 as int) user_idx", "cast(id % 911 as int) movie_idx"), "test-seen")
    users = materialize(spark.range(300).selectExpr("cast(id as int) user_idx"), "test-users")
    ranked = materialize(spark.range(911).selectExpr("cast(id as int) movie_idx", "1D / (1 + id) score", "id prank"), "test-ranked")
    plan = R.recommend_from_ranking(users, ranked, seen, 10, 911)
    assert "LeftAnti" not in plan._jdf.queryExecution().executedPlan().toString()
    assert summarise(plan)["nested_loop_joins"] == 0


@pytest.mark.parametrize("n_items", [1, 2, 6, 24])
def test_walks_skip_seen_items_and_end_with_the_catalogue(spark, monkeypatch, n_items):
    import hashlib

    monkeypatch.setattr(R, "WALK_ELEMENTS", 32)
    pairs = [(0, i) for i in range(n_items - 1)] + [(1, 0), (1, 0), (1, n_items + 3), (2, n_items // 2), (9, 1)]
    seen = spark.createDataFrame([*pairs, (2, None)], "user_idx int, movie_idx int")
    users = spark.createDataFrame([(u,) for u in range(4)], "user_idx int")
    prime = R.next_prime(n_items)
    for n in (1, 4, 30):
        expected = set()
        for u in range(4):
            h = {t: int(hashlib.md5(f"42|{t}|{u}".encode()).hexdigest()[:8], 16) for t in "ab"}
            walk = [((1 + h["a"] % (prime - 1)) * t + h["b"] % prime) % prime for t in range(prime)]
            free = [i for i in walk if i < n_items and (u, i) not in pairs]
            expected |= {(u, i, r) for r, i in enumerate(free[:n], 1)}
        got = R.recommend_random(users, seen, n, n_items)
        assert {(r.user_idx, r.movie_idx, r["rank"]) for r in got.collect()} == expected


def _vector_case(scale: float, n_users: int = 70, n_items: int = 500, dim: int = 9, seed: int = 3):
    from rankfold.operators.vectors import Block, Chunk, pair_scores

    rng = np.random.default_rng(seed)
    items, users = rng.standard_normal((n_items, dim)) * scale, rng.standard_normal((n_users, dim))
    items[7], users[5] = 0.0, 0.0
    items[20:30] = items[20] * (1 + 1e-9 * np.arange(10)[:, None])  # nearer than single precision tells apart
    seen = [np.sort(rng.choice(n_items, 25, replace=False)) for _ in range(n_users)]
    chunk = Chunk(np.arange(n_users), np.full(n_users, 6, np.int32), users, np.arange(n_users + 1) * 25, np.concatenate(seen))
    blocks = [Block(np.arange(i, i + 100), np.arange(100), items[i : i + 100]) for i in range(0, n_items, 100)]
    scores = np.round(pair_scores(users, np.repeat(np.arange(n_users), n_items), items, np.tile(np.arange(n_items), n_users)).reshape(n_users, n_items), 9)
    return chunk, blocks, scores, seen


@pytest.mark.parametrize("scale", [1.0, 1e-7, 1e5, 1e25, 1e32])
def test_lists_filtered_in_single_precision_are_exact(scale):
    from rankfold.operators.vectors import _Lists, _score_into

    chunk, blocks, scores, seen = _vector_case(scale)
    lists = _Lists(chunk, np.full(len(chunk.keys), -np.inf))
    for block in blocks:
        _score_into(lists, np.arange(len(chunk.keys)), block)
    lists.settle()
    for u, own in enumerate(seen):
        left = scores[u].copy()
        left[own] = -np.inf
        expected = np.lexsort((np.arange(len(left)), -left))[:6]
        assert lists.ids[lists.rows == u].tolist() == expected.tolist()


@pytest.mark.parametrize("scale", [1.0, 1e-7, 1e25, 1e32])
def test_counts_below_own_scores_are_exact(scale):
    from rankfold.operators.models import _rank_in_block
    from rankfold.operators.vectors import Block

    chunk, blocks, scores, seen = _vector_case(scale)
    blocks[1] = Block(np.arange(100, 300), np.arange(0, 200, 2), blocks[1].matrix)  # two ids for each vector
    weight = np.ones(500, dtype=int)
    weight[100:200] = 2
    own = np.sort(np.stack([scores[u, seen[u][:5]] for u in range(len(seen))]), axis=1).T
    below, equal = np.zeros(own.shape, np.int64), np.zeros(own.shape, np.int64)
    for block in blocks:
        _rank_in_block(chunk.queries, np.ascontiguousarray(own), np.full(own.shape[1], 5), block, below, equal)
    for j, row in enumerate(own):
        assert below[j].tolist() == ((scores < row[:, None]) * weight).sum(axis=1).tolist()
        assert equal[j].tolist() == ((scores == row[:, None]) * weight).sum(axis=1).tolist()


def test_each_tile_has_a_task_of_its_own(spark):
    from pyspark import TaskContext

    from rankfold.operators.vectors import tiled

    chunks = spark.range(12).selectExpr("id AS chunk", "CAST('12345678' AS BINARY) AS keys", "CAST('' AS BINARY) AS queries", "CAST('' AS BINARY) AS seen")
    index = spark.range(9).selectExpr("id AS block", "CAST('12345678' AS BINARY) AS ids", "CAST('' AS BINARY) AS starts", "CAST('' AS BINARY) AS matrix")

    def work(left, right):
        import pyarrow as pa

        return pa.table({"task": pa.array([TaskContext.get().partitionId()], pa.int64()), "pairs": pa.array([left.num_rows * right.num_rows], pa.int64())})

    rows = tiled(chunks, None, index, work, "task long, pairs long", tile_bytes=24).collect()
    assert sum(r["pairs"] for r in rows) == 12 * 9
    assert len(rows) == 4 * 3
    assert len({r["task"] for r in rows}) == len(rows)


def test_als_in_one_task_equals_als_in_blocks(spark, monkeypatch):
    from rankfold.operators import models as MD

    rng = np.random.default_rng(8)
    rows = [(int(u), int(i), float(w)) for u, i, w in zip(rng.integers(0, 60, 900), rng.integers(0, 40, 900), 1 + rng.random(900), strict=True)]
    df = spark.createDataFrame([*{(u, i): (u, i, w) for u, i, w in rows}.values()], "user_idx int, movie_idx int, confidence double").cache()
    monkeypatch.setattr(MD, "LEAST_BLOCK_ROWS", 200)  # several blocks
    fits = [MD.AlsFit(6, 0.05, 4, 10.0, 42), MD.AlsFit(6, 0.05, 4, 30.0, 42), MD.AlsFit(45, 0.05, 3, 10.0, 42)]
    jobs = []
    monkeypatch.setattr(MD, "_fit_in_blocks", lambda data, fit, run=MD._fit_in_blocks: jobs.append(fit) or run(data, fit))
    in_tasks = MD.als_fits(df, fits)
    assert not jobs
    monkeypatch.setattr(MD, "MANY_ROWS", 0)
    in_blocks = MD.als_fits(df, fits[1:])
    assert jobs == fits[1:]
    for one, other in zip(in_tasks[1:], in_blocks, strict=True):
        for a, b, key in zip(one, other, ("user_idx", "movie_idx"), strict=True):
            a, b = ({r[key]: r["vec"] for r in x.collect()} for x in (a, b))
            assert a.keys() == b.keys()
            assert max(np.abs(np.subtract(a[k], b[k])).max() for k in a) < 1e-4
