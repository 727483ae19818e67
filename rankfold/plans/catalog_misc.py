"""Registered request validation and the metric grid pivot."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfold.functions import BATCH_MAX, BATCH_MIN, TOP_K_MAX, TOP_K_MIN, valid_batch_size, valid_top_k
from rankfold.operators import metrics as M
from rankfold.operators import recommend as R
from rankfold.plans import stages as P
from rankfold.plans import sql as S
from rankfold.plans.catalog import POP_CTES, r6, register
from rankfold.sources import tables


@register(
    "request_validation",
    S.with_ctes(
        f"SELECT request_id, coalesce(top_k, {S.TOP_K}) AS top_k, "
        f"coalesce(top_k, {S.TOP_K}) BETWEEN {TOP_K_MIN} AND {TOP_K_MAX} AS valid, "
        f"CASE WHEN coalesce(top_k, {S.TOP_K}) BETWEEN {TOP_K_MIN} AND {TOP_K_MAX} THEN 'ok' "
        f"ELSE 'top_k out of range' END AS reason FROM request_log"
    ),
)
def q_request_validation(spark, sf):
    """Split the request table into valid and rejected rows (top_k in 1..500, default 10)."""
    log = tables.request_log(spark, sf)
    k = F.coalesce("top_k", F.lit(S.TOP_K))
    return log.select(
        "request_id", k.alias("top_k"), valid_top_k(k).alias("valid"),
        F.when(valid_top_k(k), F.lit("ok")).otherwise(F.lit("top_k out of range")).alias("reason"),
    )


GRID_K = [5, 10, 20]
GRID_THRESHOLDS = [3.0, 3.5, 4.0]


def _grid_sql() -> str:
    n = max(GRID_K)
    pop_n = POP_CTES[3].replace("pop_recs AS", "pop_grid AS").replace(f"{S.TOP_K} + coalesce", f"{n} + coalesce").replace(
        f"WHERE rank <= {S.TOP_K})", f"WHERE rank <= {n})"
    )
    cells = []
    for k in GRID_K:
        for t in GRID_THRESHOLDS:
            cells.append(
                f"SELECT {k} AS k, '{t}' AS thr, CASE WHEN count(*) = 0 THEN 0.0 ELSE sum(coalesce(h.h, 0)) / ({k} * count(*))::DOUBLE END AS precision "
                f"FROM (SELECT DISTINCT user_idx FROM test WHERE rating >= {t!r}e0) u LEFT JOIN "
                f"(SELECT r.user_idx, count(*) AS h FROM pop_grid r JOIN (SELECT DISTINCT user_idx, movie_idx FROM test "
                f"WHERE rating >= {t!r}e0) v ON v.user_idx = r.user_idx AND v.movie_idx = r.movie_idx "
                f"WHERE r.rank <= {k} GROUP BY r.user_idx) h ON h.user_idx = u.user_idx"
            )
    cols = ", ".join(
        f"floor(max(CASE WHEN thr = '{t}' THEN precision END) * 1000000.0 + 0.5) / 1000000.0 AS \"{t}\""
        for t in GRID_THRESHOLDS
    )
    return S.with_ctes(
        f"SELECT CAST(k AS INTEGER) AS k, {cols} FROM ({' UNION ALL '.join(cells)}) GROUP BY k",
        *POP_CTES[:3],
        pop_n,
        prepared=True,
    )


@register("metric_pivot", _grid_sql())
def q_metric_pivot(spark, sf):
    """Grid of popularity precision@k (rows k, columns relevance threshold), pivoted."""
    n = max(GRID_K)
    recs = R.recommend_popular(P.user_universe(spark, sf), P.item_universe(spark, sf), P.implicit_train(spark, sf),
                               n, P.n_items(spark, sf))
    pivot = M.precision_grid(recs, P.part(spark, sf, "test"), GRID_K, GRID_THRESHOLDS)
    # floor(x * 1e6 + 0.5) / 1e6: identical in any IEEE engine, also on rounding halves
    return pivot.select(
        F.col("k").cast("int").alias("k"),
        *[(F.floor(F.col(f"`{t}`") * 1e6 + 0.5) / 1e6).alias(str(t)) for t in GRID_THRESHOLDS],
    )


@register(
    "batch_validation",
    S.with_ctes(
        "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS batch_start, CAST(count(*) AS BIGINT) AS n_users, "
        f"count(*) BETWEEN {BATCH_MIN} AND {BATCH_MAX} AS valid FROM request_log "
        f"WHERE endpoint = '/recommend/batch' AND status = 'success' AND coalesce(top_k, {S.TOP_K}) BETWEEN 1 AND 500 "
        "GROUP BY 1"
    ),
)
def q_batch_validation(spark, sf):
    """Batch requests (one batch per hour of batch-endpoint requests): size and whether it
    passes the 1..100 user-list bound."""
    from rankfold.plans.catalog_models import requests_of  # noqa: PLC0415

    reqs = requests_of(spark, sf, "/recommend/batch")
    per = reqs.groupBy(F.date_trunc("hour", "ts").alias("batch_start")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_users")
    )
    return per.withColumn("valid", valid_batch_size("n_users"))
