"""Registered recommender, similarity and batch-serving queries with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfold.functions import sigmoid_score, valid_top_k
from rankfold.operators import metrics as M
from rankfold.operators import recommend as R
from rankfold.operators import serve as SV
from rankfold.plans import stages as P
from rankfold.plans import sql as S
from rankfold.plans.catalog import POP_CTES, popular_recs, r6, register
from rankfold.plans.catalog_eda import GL
from rankfold.session import materialize
from rankfold.sources import tables

SIMILAR_N = 10

# ------------------------------------------------------------------ random baseline

PRIME_SQL = (
    "prime AS (SELECT min(p) AS P FROM range((SELECT n FROM n_items), 2 * (SELECT n FROM n_items) + 3) t(p) "
    "WHERE p >= 2 AND NOT EXISTS (SELECT 1 FROM range(2, 5000) d(x) WHERE x * x <= p AND p % x = 0))"
)


def _h(tag: str, col: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '42', '{tag}', CAST({col} AS VARCHAR))), 1, 8) AS BIGINT)"


RANDOM_SQL = [
    PRIME_SQL,
    "seen_n AS (SELECT user_idx, count(*) AS s FROM implicit_train GROUP BY user_idx)",
    f"""walk AS (
  SELECT user_idx, t, CAST((a * t + b) % P AS INTEGER) AS movie_idx FROM (
    SELECT u.encoded_id AS user_idx, 1 + {_h('a', 'u.encoded_id')} % (pr.P - 1) AS a,
           {_h('b', 'u.encoded_id')} % pr.P AS b, pr.P,
           unnest(range(0, {S.TOP_K} + coalesce(s.s, 0) + (pr.P - (SELECT n FROM n_items)))) AS t
    FROM user_map u LEFT JOIN seen_n s ON s.user_idx = u.encoded_id, prime pr))""",
    f"""rand_recs AS (
  SELECT user_idx, movie_idx, rank FROM (
    SELECT w.user_idx, w.movie_idx, row_number() OVER (PARTITION BY w.user_idx ORDER BY w.t) AS rank
    FROM walk w WHERE w.movie_idx < (SELECT n FROM n_items)
      AND NOT EXISTS (SELECT 1 FROM implicit_train x WHERE x.user_idx = w.user_idx AND x.movie_idx = w.movie_idx))
  WHERE rank <= {S.TOP_K})""",
]


def random_recs(spark, sf):
    return R.recommend_random(P.user_universe(spark, sf), P.implicit_train(spark, sf), S.TOP_K,
                              P.n_items(spark, sf), seed=S.SEED)


@register(
    "recommend_random",
    S.with_ctes(
        f"SELECT user_idx, movie_idx, round(1.0 / {S.TOP_K}, 6) AS score, CAST(rank AS BIGINT) AS rank FROM rand_recs",
        *RANDOM_SQL,
        prepared=True,
    ),
)
def q_recommend_random(spark, sf):
    return random_recs(spark, sf).select(
        "user_idx", "movie_idx", r6("score").alias("score"), F.col("rank").cast("bigint").alias("rank")
    )


def _evaluate_random_sql() -> str:
    from rankfold.plans.catalog import EVAL_CTES, ORACLES  # noqa: PLC0415

    marker = "\nSELECT floor(CASE WHEN count(*) > 0"
    body = ORACLES["evaluate_model"].split(marker, 1)[1]
    body = marker.lstrip("\n") + body.replace("pop_recs", "rand_recs")
    return S.with_ctes(body, *RANDOM_SQL, *[c.replace("pop_recs", "rand_recs") for c in EVAL_CTES], prepared=True)


@register("evaluate_random", _evaluate_random_sql())
def q_evaluate_random(spark, sf):
    """Random baseline through the full evaluation (same job as evaluate_model)."""
    return M.evaluate(random_recs(spark, sf), P.part(spark, sf, "test"), S.TOP_K, S.EVAL_THRESHOLD,
                      P.n_items(spark, sf))


@register(
    "coverage",
    S.with_ctes(
        "SELECT round(count(DISTINCT movie_idx) / (SELECT n FROM n_items)::DOUBLE, 6) AS coverage FROM rand_recs",
        *RANDOM_SQL,
        prepared=True,
    ),
)
def q_coverage(spark, sf):
    return M.coverage(random_recs(spark, sf), P.n_items(spark, sf))


# ------------------------------------------------------------------ similar items, diversity

SIM_SQL = [
    "nv AS (SELECT CAST(vec_id AS BIGINT) AS item_idx, CAST(embedding AS DOUBLE[]) AS v, "
    "sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS norm FROM embeddings)",
    f"""sim AS (
  SELECT item_idx, neighbor, cosine, rank FROM (
    SELECT a.item_idx, b.item_idx AS neighbor,
           list_dot_product(a.v, b.v) / (a.norm * CASE WHEN b.norm = 0 THEN 1.0 ELSE b.norm END) AS cosine,
           row_number() OVER (PARTITION BY a.item_idx ORDER BY
             round(list_dot_product(a.v, b.v) / (a.norm * CASE WHEN b.norm = 0 THEN 1.0 ELSE b.norm END), 9) DESC,
             b.item_idx) AS rank
    FROM nv a JOIN nv b ON a.item_idx <> b.item_idx WHERE a.norm > 0)
  WHERE rank <= {SIMILAR_N})""",
]


def similar(spark, sf):
    return SV.similar_items(tables.item_vectors(spark, sf), SIMILAR_N)


@register(
    "similar_items",
    S.with_ctes(
        "SELECT item_idx, neighbor, round(cosine, 6) AS cosine, round(1.0 / (1.0 + exp(-cosine)), 4) AS score, "
        "CAST(rank AS INTEGER) AS rank FROM sim",
        *SIM_SQL,
    ),
)
def q_similar_items(spark, sf):
    return similar(spark, sf).select("item_idx", "neighbor", "cosine", "score", F.col("rank").cast("int").alias("rank"))


@register(
    "diversity",
    S.with_ctes(
        "SELECT l.item_idx AS list_id, round(CASE WHEN count(*) = 0 THEN 0.0 ELSE avg(1.0 - "
        "CASE WHEN a.norm = 0 OR b.norm = 0 THEN 0.0 ELSE list_dot_product(a.v, b.v) / (a.norm * b.norm) END) END, 6) "
        "AS diversity FROM sim l JOIN sim r ON l.item_idx = r.item_idx AND l.rank < r.rank "
        "JOIN nv a ON a.item_idx = l.neighbor JOIN nv b ON b.item_idx = r.neighbor GROUP BY l.item_idx",
        *SIM_SQL,
    ),
)
def q_diversity(spark, sf):
    """Intra-list diversity of every item's similar-item list (lists of >= 2 items)."""
    lists = similar(spark, sf).select(F.col("item_idx").alias("list_id"), F.col("neighbor").alias("item_idx"))
    d = M.intra_list_diversity(lists, tables.item_vectors(spark, sf), user_col="list_id")
    return d


@register(
    "item_vector_norms",
    S.with_ctes("SELECT item_idx, round(norm, 6) AS norm, label FROM nv JOIN item_vectors USING (item_idx)", *SIM_SQL),
)
def q_item_vector_norms(spark, sf):
    v = tables.item_vectors(spark, sf)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return v.select("item_idx", F.round(norm, 6).alias("norm"), "label")


# ------------------------------------------------------------------ serving paths

def _fallback_sql(size: str) -> list[str]:
    return [
        "fb_cnt AS (SELECT movie_idx, count(DISTINCT user_idx) AS c FROM implicit_train GROUP BY movie_idx)",
        f"""fallback AS (
  SELECT row_number() OVER (ORDER BY f.c DESC, f.movie_idx) AS fb_rank, f.movie_idx,
         coalesce(mm.original_id, f.movie_idx) AS movie_id,
         coalesce(m.title, 'Movie ' || CAST(coalesce(mm.original_id, f.movie_idx) AS VARCHAR)) AS title,
         round(f.c / (SELECT max(c) FROM fb_cnt)::DOUBLE, 6) AS score,
         array_to_string({GL.format(g='m.genres')}, '|') AS genres
  FROM (SELECT * FROM fb_cnt ORDER BY c DESC, movie_idx LIMIT {size}) f
  LEFT JOIN movie_map mm ON mm.encoded_id = f.movie_idx LEFT JOIN movies m ON m.movieId = mm.original_id)""",
    ]


FALLBACK_SQL = _fallback_sql(str(SV.FALLBACK_SIZE))


def fallback(spark, sf, size: int = SV.FALLBACK_SIZE):
    enc = P.encoded(spark, sf)
    return SV.popular_fallback(P.implicit_train(spark, sf), enc.movie_map, P.movies(spark, sf), size)


@register(
    "popular_items",
    S.with_ctes(
        "SELECT CAST(fb_rank AS INTEGER) AS fb_rank, movie_id, title, score, genres FROM fallback",
        *FALLBACK_SQL,
        prepared=True,
    ),
)
def q_popular_items(spark, sf):
    return fallback(spark, sf).select(
        F.col("fb_rank").cast("int").alias("fb_rank"), "movie_id", "title", "score",
        F.array_join("genres", "|").alias("genres"),
    )


@register(
    "get_popular",
    S.with_ctes(
        f"SELECT CAST(fb_rank AS INTEGER) AS fb_rank, movie_id, title, score FROM fallback WHERE fb_rank <= {S.TOP_K}",
        *FALLBACK_SQL,
        prepared=True,
    ),
)
def q_get_popular(spark, sf):
    return fallback(spark, sf).where(F.col("fb_rank") <= S.TOP_K).select(
        F.col("fb_rank").cast("int").alias("fb_rank"), "movie_id", "title", "score"
    )


ENRICH_SQL = (
    "SELECT r.user_idx, CAST(r.rank AS INTEGER) AS rank, coalesce(mm.original_id, r.movie_idx) AS movie_id, "
    "coalesce(m.title, 'Movie ' || CAST(coalesce(mm.original_id, r.movie_idx) AS VARCHAR)) AS title, "
    "round(1.0 / (1.0 + exp(-r.score)), 4) AS score, array_to_string("
    + GL.format(g="m.genres")
    + ", '|') AS genres FROM pop_recs r LEFT JOIN movie_map mm ON mm.encoded_id = r.movie_idx "
    "LEFT JOIN movies m ON m.movieId = mm.original_id"
)


@register("enrich_recs", S.with_ctes(ENRICH_SQL, *POP_CTES, prepared=True))
def q_enrich_recs(spark, sf):
    """Top-10 popular unseen items per user with original id, title, genres and the
    service's sigmoid score format."""
    # written once: read for the listed items and for the lists
    recs = materialize(popular_recs(spark, sf), "popular-lists")
    enc = P.encoded(spark, sf)
    out = SV.enrich(recs.withColumn("score", sigmoid_score("score")), enc.movie_map, P.movies(spark, sf), items=recs)
    return out.select("user_idx", F.col("rank").cast("int").alias("rank"), "movie_id", "title", "score",
                      F.array_join("genres", "|").alias("genres"))


def requests_of(spark, sf, endpoint: str):
    """Successful requests of one endpoint whose top_k passes validation (1..500; default 10)."""
    log = tables.request_log(spark, sf)
    k = F.coalesce("top_k", F.lit(S.TOP_K))
    return log.where((F.col("endpoint") == endpoint) & (F.col("status") == "success") & valid_top_k(k)).select(
        "request_id", "ts", "user_id", k.alias("top_k")
    )


def answer(spark, sf, requests, model=None):
    """Answer a request table with a model's lists (user_idx, movie_idx, score, rank), by default
    those of the popularity model, and the popular fallback; both as long as the requests ask."""
    enc = P.encoded(spark, sf)
    routed = SV.route_requests(requests, enc.user_map)
    warm_users = routed.where(~F.col("cold_start")).select("user_idx").distinct()
    # list length = the largest validated top_k among the requests (a scalar, <= 500)
    n = requests.agg(F.max("top_k")).first()[0] or S.TOP_K
    if model is None:
        model = R.recommend_popular(warm_users, P.item_universe(spark, sf), P.implicit_train(spark, sf),
                                    n, P.n_items(spark, sf))
    return SV.answer_requests(requests, enc.user_map, model, fallback(spark, sf, n), enc.movie_map, P.movies(spark, sf))


def _pop_recs_for(users_sql: str, n: int) -> str:
    return f"""req_recs AS (
  SELECT user_idx, movie_idx, score, rank FROM (
    SELECT u.user_idx, r.movie_idx, r.score,
           row_number() OVER (PARTITION BY u.user_idx ORDER BY r.prank) AS rank
    FROM ({users_sql}) u LEFT JOIN seen_n s ON s.user_idx = u.user_idx
    JOIN ranking r ON r.prank < ({n}) + coalesce(s.s, 0)
    WHERE NOT EXISTS (SELECT 1 FROM implicit_train t WHERE t.user_idx = u.user_idx AND t.movie_idx = r.movie_idx))
  WHERE rank <= ({n}))"""


def answer_sql(endpoint: str, lists: list[str] | None = None) -> list[str]:
    """CTEs warm and cold; ``lists`` define req_recs (user_idx, movie_idx, score, rank), by default
    those of the popularity model."""
    reqs = (
        f"reqs AS (SELECT request_id, ts, user_id, coalesce(top_k, {S.TOP_K}) AS top_k "
        f"FROM request_log WHERE endpoint = '{endpoint}' AND status = 'success' "
        f"AND coalesce(top_k, {S.TOP_K}) BETWEEN 1 AND 500)"
    )
    routed = "routed AS (SELECT q.*, um.encoded_id AS user_idx FROM reqs q LEFT JOIN user_map um ON um.original_id = q.user_id)"
    warm = (
        "warm AS (SELECT q.request_id, q.user_id, CAST(r.rank AS INTEGER) AS rank, "
        "coalesce(mm.original_id, r.movie_idx) AS movie_id, "
        "coalesce(m.title, 'Movie ' || CAST(coalesce(mm.original_id, r.movie_idx) AS VARCHAR)) AS title, "
        "round(1.0 / (1.0 + exp(-r.score)), 4) AS score, "
        f"array_to_string({GL.format(g='m.genres')}, '|') AS genres, false AS cold_start "
        "FROM routed q JOIN req_recs r ON r.user_idx = q.user_idx AND r.rank <= q.top_k "
        "LEFT JOIN movie_map mm ON mm.encoded_id = r.movie_idx LEFT JOIN movies m ON m.movieId = mm.original_id)"
    )
    cold = (
        "cold AS (SELECT q.request_id, q.user_id, CAST(f.fb_rank AS INTEGER) AS rank, f.movie_id, f.title, f.score, "
        "f.genres, true AS cold_start FROM routed q JOIN fallback f ON f.fb_rank <= q.top_k WHERE q.user_idx IS NULL)"
    )
    return [
        *POP_CTES[:3],
        reqs,
        *_fallback_sql("(SELECT coalesce(max(top_k), 0) FROM reqs)"),
        routed,
        *(lists or [_pop_recs_for("SELECT DISTINCT user_idx FROM routed WHERE user_idx IS NOT NULL", "SELECT max(top_k) FROM reqs")]),
        warm,
        cold,
    ]


@register(
    "recommend_all",
    S.with_ctes(
        "SELECT * FROM warm UNION ALL SELECT * FROM cold",
        *answer_sql("/recommend"),
        prepared=True,
    ),
)
def q_recommend_all(spark, sf):
    """Every successful /recommend request answered in one job: known users get the
    model list (sigmoid score), unknown users the popular fallback, cut to top_k."""
    out = answer(spark, sf, requests_of(spark, sf, "/recommend"))
    return out.select("request_id", "user_id", "rank", "movie_id", "title", "score",
                      F.array_join("genres", "|").alias("genres"), "cold_start")


@register(
    "cold_start_route",
    S.with_ctes(
        "SELECT request_id, user_id, user_idx IS NULL AS cold_start FROM routed",
        *answer_sql("/recommend"),
        prepared=True,
    ),
)
def q_cold_start_route(spark, sf):
    enc = P.encoded(spark, sf)
    return SV.route_requests(requests_of(spark, sf, "/recommend"), enc.user_map).select(
        "request_id", "user_id", "cold_start"
    )


@register(
    "batch_recommend",
    S.with_ctes(
        "SELECT b.batch_start, b.pos, a.user_id, a.rank, a.movie_id, a.score FROM "
        "(SELECT * FROM warm UNION ALL SELECT * FROM cold) a JOIN "
        "(SELECT request_id, time_bucket(INTERVAL 1 HOUR, ts) AS batch_start, "
        " CAST(row_number() OVER (PARTITION BY time_bucket(INTERVAL 1 HOUR, ts) ORDER BY ts, request_id) AS BIGINT) AS pos "
        " FROM reqs) b ON b.request_id = a.request_id",
        *answer_sql("/recommend/batch"),
        prepared=True,
    ),
)
def q_batch_recommend(spark, sf):
    """Batch endpoint: the batch requests of each hour form one ordered batch; every
    position is answered with its request's ``top_k`` (duplicates kept, seen items excluded)."""
    from rankfold.operators.ordering import running_totals  # noqa: PLC0415

    reqs = requests_of(spark, sf, "/recommend/batch")
    tagged = reqs.select("request_id", "ts", F.date_trunc("hour", "ts").alias("batch_start"), F.lit(1).alias("one"))
    # position inside the batch = running count in (ts, request_id) order; a hot hour is
    # spread over range partitions instead of one window partition
    pos = running_totals(tagged, ["ts", "request_id"], ["one"], group_cols=["batch_start"]).select(
        "request_id", "batch_start", F.col("one_cum").cast("bigint").alias("pos")
    )
    return answer(spark, sf, reqs).join(pos, "request_id").select("batch_start", "pos", "user_id", "rank", "movie_id", "score")


@register(
    "score_format",
    S.with_ctes(
        "SELECT user_idx, movie_idx, round(1.0 / (1.0 + exp(-score)), 4) AS score_fmt FROM pop_recs",
        *POP_CTES,
        prepared=True,
    ),
)
def q_score_format(spark, sf):
    return popular_recs(spark, sf).select("user_idx", "movie_idx", sigmoid_score("score").alias("score_fmt"))
