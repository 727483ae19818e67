"""Registered queries (Spark) and their DuckDB oracle SQL, keyed by operator name.

Every query reads the driver tables of ``sf_dir`` (or tables Spark derives from
them) in full.  Doubles are rounded to 6 places and counts are BIGINT on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.operators import metrics as M
from rankfold.operators import prep
from rankfold.operators import recommend as R
from rankfold.plans import stages as P
from rankfold.plans import sql as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---------------------------------------------------------------- preparation


@register(
    "cold_start_filter",
    S.with_ctes('SELECT userId, movieId, rating, "timestamp" FROM kc_core', prepared=True),
)
def q_cold_start_filter(spark, sf):
    return P.core(spark, sf).ratings.select("userId", "movieId", "rating", "timestamp")


@register(
    "cold_start_filter_deep",
    S.with_ctes(
        'SELECT userId, movieId, rating, "timestamp" FROM deep_core',
        *S.kcore_ctes("deep", "ratings", S.DEEP_MIN_USER, S.DEEP_MIN_ITEM),
    ),
)
def q_cold_start_filter_deep(spark, sf):
    return P.core(spark, sf, S.DEEP_MIN_USER, S.DEEP_MIN_ITEM).ratings.select(
        "userId", "movieId", "rating", "timestamp"
    )


@register(
    "id_map",
    S.with_ctes(
        "SELECT 'user' AS kind, original_id, encoded_id FROM user_map "
        "UNION ALL SELECT 'movie' AS kind, original_id, encoded_id FROM movie_map",
        prepared=True,
    ),
)
def q_id_map(spark, sf):
    enc = P.encoded(spark, sf)
    return enc.user_map.select(F.lit("user").alias("kind"), "original_id", "encoded_id").unionByName(
        enc.movie_map.select(F.lit("movie").alias("kind"), "original_id", "encoded_id")
    )


@register(
    "encode_ids",
    S.with_ctes('SELECT rating, "timestamp", user_idx, movie_idx FROM encoded', prepared=True),
)
def q_encode_ids(spark, sf):
    return P.encoded(spark, sf).ratings.select("rating", "timestamp", "user_idx", "movie_idx")


@register(
    "temporal_split",
    S.with_ctes('SELECT rating, "timestamp", user_idx, movie_idx, split FROM split', prepared=True),
)
def q_temporal_split(spark, sf):
    return P.split(spark, sf).select("rating", "timestamp", "user_idx", "movie_idx", "split")


@register(
    "split_stats",
    S.with_ctes(
        """SELECT CAST(sum(CASE WHEN split='train' THEN 1 ELSE 0 END) AS BIGINT) AS train_size,
                  CAST(sum(CASE WHEN split='val' THEN 1 ELSE 0 END) AS BIGINT) AS val_size,
                  CAST(sum(CASE WHEN split='test' THEN 1 ELSE 0 END) AS BIGINT) AS test_size,
                  CAST(count(DISTINCT user_idx) AS BIGINT) AS n_users,
                  CAST(count(DISTINCT movie_idx) AS BIGINT) AS n_items,
                  round(CASE WHEN count(DISTINCT user_idx) = 0 OR count(DISTINCT movie_idx) = 0 THEN 1.0
                        ELSE 1.0 - count(*) / (count(DISTINCT user_idx) * count(DISTINCT movie_idx))::DOUBLE END, 6)
                    AS sparsity
           FROM split""",
        prepared=True,
    ),
)
def q_split_stats(spark, sf):
    return prep.split_stats(P.split(spark, sf))


# ---------------------------------------------------------------- popularity model

POP_CTES = [
    """pop AS (
  SELECT m.encoded_id AS movie_idx, CAST(coalesce(c.pop, 0) AS BIGINT) AS pop
  FROM movie_map m LEFT JOIN (SELECT movie_idx, count(*) AS pop FROM implicit_train GROUP BY movie_idx) c
    ON c.movie_idx = m.encoded_id)""",
    """ranking AS MATERIALIZED (
  SELECT movie_idx, pop,
         pop / (CASE WHEN max(pop) OVER () > 0 THEN max(pop) OVER () ELSE 1 END)::DOUBLE AS score,
         row_number() OVER (ORDER BY pop DESC, movie_idx) - 1 AS prank
  FROM pop)""",
    "seen_n AS (SELECT user_idx, count(*) AS s FROM implicit_train GROUP BY user_idx)",
    f"""pop_recs AS MATERIALIZED (
  SELECT user_idx, movie_idx, score, rank FROM (
    SELECT u.encoded_id AS user_idx, r.movie_idx, r.score,
           row_number() OVER (PARTITION BY u.encoded_id ORDER BY r.prank) AS rank
    FROM user_map u LEFT JOIN seen_n s ON s.user_idx = u.encoded_id
    JOIN ranking r ON r.prank < {S.TOP_K} + coalesce(s.s, 0)
    WHERE NOT EXISTS (SELECT 1 FROM implicit_train t
                      WHERE t.user_idx = u.encoded_id AND t.movie_idx = r.movie_idx))
  WHERE rank <= {S.TOP_K})""",
]


def popular_recs(spark: SparkSession, sf: str, n: int = S.TOP_K) -> DataFrame:
    return R.recommend_popular(
        P.user_universe(spark, sf),
        P.item_universe(spark, sf),
        P.implicit_train(spark, sf),
        n,
        P.n_items(spark, sf),
    )


@register(
    "recommend_popular",
    S.with_ctes(
        "SELECT user_idx, movie_idx, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM pop_recs",
        *POP_CTES,
        prepared=True,
    ),
)
def q_recommend_popular(spark, sf):
    return popular_recs(spark, sf).select(
        "user_idx", "movie_idx", r6("score").alias("score"), F.col("rank").cast("bigint").alias("rank")
    )


EVAL_CTES = [
    f"relevant AS (SELECT DISTINCT user_idx, movie_idx FROM test WHERE rating >= {S.EVAL_THRESHOLD!r}e0)",
    "n_rel AS (SELECT user_idx, count(*) AS n_rel FROM relevant GROUP BY user_idx)",
    f"""per_hit AS (
  SELECT r.user_idx,
         sum(CASE WHEN r.rank <= {S.TOP_K} THEN 1 ELSE 0 END) AS h,
         sum(CASE WHEN r.rank <= {S.TOP_K} THEN 1.0 / log2(r.rank + 1.0) ELSE 0.0 END) AS dcg,
         min(r.rank) AS first_hit
  FROM pop_recs r JOIN relevant v ON r.user_idx = v.user_idx AND r.movie_idx = v.movie_idx
  GROUP BY r.user_idx)""",
    f"""ideal AS (
  SELECT i AS n_ideal, sum(1.0 / log2(i + 1.0)) OVER (ORDER BY i) AS idcg FROM range(1, {S.TOP_K} + 1) t(i))""",
    f"""per_user AS (
  SELECT n.user_idx,
         h, coalesce(h, 0) / {S.TOP_K}.0 AS precision,
         coalesce(h, 0) / n.n_rel::DOUBLE AS recall,
         CASE WHEN idcg > 0 THEN coalesce(dcg, 0.0) / idcg ELSE 0.0 END AS ndcg,
         CASE WHEN coalesce(h, 0) > 0 THEN 1.0 ELSE 0.0 END AS hit,
         CASE WHEN first_hit IS NOT NULL THEN 1.0 / first_hit ELSE 0.0 END AS rr
  FROM n_rel n LEFT JOIN per_hit p ON p.user_idx = n.user_idx
  LEFT JOIN ideal i ON i.n_ideal = least(n.n_rel, {S.TOP_K}))""",
]


@register(
    "ranking_metrics_per_user",
    S.with_ctes(
        "SELECT user_idx, round(precision, 6) AS precision, round(recall, 6) AS recall, "
        "round(ndcg, 6) AS ndcg, round(hit, 6) AS hit, round(rr, 6) AS rr FROM per_user",
        *POP_CTES,
        *EVAL_CTES,
        prepared=True,
    ),
)
def q_ranking_metrics_per_user(spark, sf):
    test = P.part(spark, sf, "test")
    pu = M.per_user_metrics(popular_recs(spark, sf), M.relevant_items(test, S.EVAL_THRESHOLD), S.TOP_K)
    return pu.select("user_idx", *[r6(c).alias(c) for c in ["precision", "recall", "ndcg", "hit", "rr"]])


@register(
    "evaluate_model",
    S.with_ctes(
        """SELECT floor(CASE WHEN count(*) > 0 THEN CAST(sum(coalesce(h, 0)) AS DOUBLE) / (10.0 * count(*)) ELSE 0.0 END
                        * 1000000.0 + 0.5) / 1000000.0 AS precision_at_k,
                  round(coalesce(avg(recall), 0.0), 6) AS recall_at_k,
                  round(coalesce(avg(ndcg), 0.0), 6) AS ndcg_at_k,
                  round(CASE WHEN coalesce(avg(precision), 0) + coalesce(avg(recall), 0) = 0 THEN 0.0
                        ELSE 2 * avg(precision) * avg(recall) / (avg(precision) + avg(recall)) END, 6) AS f1_score,
                  floor(CASE WHEN count(*) > 0 THEN sum(hit) / CAST(count(*) AS DOUBLE) ELSE 0.0 END
                        * 1000000.0 + 0.5) / 1000000.0 AS hit_rate_at_k,
                  round(coalesce(avg(rr), 0.0), 6) AS mrr,
                  round(CASE WHEN count(*) > 0 THEN
                     (SELECT count(DISTINCT movie_idx) FROM pop_recs WHERE user_idx IN (SELECT user_idx FROM n_rel))
                     / (SELECT n FROM n_items)::DOUBLE ELSE 0.0 END, 6) AS coverage,
                  CAST(count(*) AS DOUBLE) AS n_users_evaluated
           FROM per_user""",
        *POP_CTES,
        *EVAL_CTES,
        prepared=True,
    ),
)
def q_evaluate_model(spark, sf):
    return M.evaluate(
        popular_recs(spark, sf), P.part(spark, sf, "test"), S.TOP_K, S.EVAL_THRESHOLD, P.n_items(spark, sf)
    )


def entry_query(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: top-10 popular unseen movies per user, with titles and parsed genres."""
    from rankfold.operators.serve import enrich  # noqa: PLC0415

    recs = popular_recs(spark, sf)
    return enrich(recs, P.encoded(spark, sf).movie_map, P.movies(spark, sf))


# registration side effects of the other catalog modules
from rankfold.plans import catalog_eda  # noqa: E402,F401
from rankfold.plans import catalog_logs  # noqa: E402,F401
from rankfold.plans import catalog_models  # noqa: E402,F401
from rankfold.plans import catalog_drift  # noqa: E402,F401
from rankfold.plans import catalog_stream  # noqa: E402,F401
from rankfold.plans import catalog_fm  # noqa: E402,F401
from rankfold.plans import catalog_misc  # noqa: E402,F401
from rankfold.plans import catalog_hybrid  # noqa: E402,F401
from rankfold.plans import catalog_train  # noqa: E402,F401
