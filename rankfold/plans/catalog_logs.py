"""Registered request-log queries (batch) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfold.operators import logs as L
from rankfold.plans import sql as S
from rankfold.plans.catalog import register
from rankfold.sources import tables

# sliding 5-minute windows every 30 s: each event lies in exactly 10 windows
WINDOWS_SQL = """wl AS (
  SELECT ws AS window_start, ws + INTERVAL 300 SECOND AS window_end,
         CAST(count(*) AS BIGINT) AS requests,
         CAST(sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors,
         CAST(sum(CASE WHEN cold_start THEN 1 ELSE 0 END) AS BIGINT) AS cold_starts
  FROM (SELECT status, cold_start, time_bucket(INTERVAL 30 SECOND, ts) - to_seconds(k * 30) AS ws
        FROM request_log, range(0, 10) r(k))
  GROUP BY ws)"""


def log(spark, sf):
    return tables.request_log(spark, sf)


@register(
    "requests_by_endpoint",
    S.with_ctes("SELECT status, endpoint, CAST(count(*) AS BIGINT) AS requests FROM request_log GROUP BY 1, 2"),
)
def q_requests_by_endpoint(spark, sf):
    return L.requests_by_endpoint(log(spark, sf))


@register(
    "request_rate",
    S.with_ctes("SELECT window_start, window_end, requests, round(requests / 300.0, 6) AS rate_per_s FROM wl", WINDOWS_SQL),
)
def q_request_rate(spark, sf):
    return L.request_rate(log(spark, sf))


@register(
    "error_rate",
    S.with_ctes(
        "SELECT window_start, window_end, requests, errors, "
        "round(CASE WHEN requests > 0 THEN errors / requests::DOUBLE END, 6) AS error_ratio, "
        "(CASE WHEN requests > 0 THEN errors / requests::DOUBLE END) > 0.01 AS above_1pct, "
        "(CASE WHEN requests > 0 THEN errors / requests::DOUBLE END) > 0.05 AS above_5pct FROM wl",
        WINDOWS_SQL,
    ),
)
def q_error_rate(spark, sf):
    return L.error_rate(log(spark, sf))


@register(
    "cold_start_spike",
    S.with_ctes("SELECT window_start, window_end, cold_starts, cold_starts > 10 AS spike FROM wl", WINDOWS_SQL),
)
def q_cold_start_spike(spark, sf):
    return L.cold_start_spike(log(spark, sf))


@register(
    "latency_quantiles",
    S.with_ctes(
        "SELECT endpoint, CAST(count(*) AS BIGINT) AS requests, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, "
        "round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms, round(quantile_cont(latency_ms, 0.99), 6) AS p99_ms "
        "FROM request_log GROUP BY endpoint"
    ),
)
def q_latency_quantiles(spark, sf):
    return L.latency_quantiles(log(spark, sf))


def _bucket_case() -> str:
    parts = " ".join(f"WHEN latency_ms / 1000.0 <= {b!r} THEN {b!r}" for b in L.LATENCY_BUCKETS)
    return f"CASE {parts} ELSE 'inf'::DOUBLE END"


def _lo_case() -> str:
    bs = L.LATENCY_BUCKETS
    parts = " ".join(f"WHEN le = {b!r} THEN {p!r}" for p, b in zip(bs, bs[1:], strict=False))
    return f"CASE WHEN le = 'inf'::DOUBLE THEN {bs[-1]!r} {parts} ELSE 0.0 END"


HIST_SQL = [
    f"hb0 AS (SELECT endpoint, {_bucket_case()} AS le, count(*) AS cnt FROM request_log GROUP BY 1, 2)",
    "hb1 AS (SELECT endpoint, le, cnt, sum(cnt) OVER (PARTITION BY endpoint ORDER BY le) AS cum, "
    "sum(cnt) OVER (PARTITION BY endpoint) AS total FROM hb0)",
    f"hb AS (SELECT *, {_lo_case()} AS lo, coalesce(lag(cum) OVER (PARTITION BY endpoint ORDER BY le), 0) AS cum_lo FROM hb1)",
]


def _hq(q: float) -> str:
    name = f"p{int(round(q * 100))}_ms"
    return (
        f"(SELECT endpoint, round(CASE WHEN le = 'inf'::DOUBLE THEN lo ELSE lo + (le - lo) * ({q!r} * total - cum_lo) / cnt END "
        f"* 1000.0, 6) AS {name} FROM hb WHERE (endpoint, le) IN "
        f"(SELECT (endpoint, min(le)) FROM hb WHERE cum >= {q!r} * total GROUP BY endpoint)) q{name}"
    )


@register(
    "latency_histogram_quantiles",
    S.with_ctes(
        "SELECT qp50_ms.endpoint, p50_ms, p95_ms, p99_ms FROM "
        + _hq(0.5) + " JOIN " + _hq(0.95) + " USING (endpoint) JOIN " + _hq(0.99) + " USING (endpoint)",
        *HIST_SQL,
    ),
)
def q_latency_histogram_quantiles(spark, sf):
    return L.latency_histogram_quantiles(log(spark, sf))


ALERT_SQL = [
    WINDOWS_SQL,
    "ticks AS (SELECT DISTINCT 'RecsysHighErrorRate' AS alert, CAST(epoch(window_end) / 30 AS BIGINT) AS tick FROM wl "
    "WHERE requests > 0 AND errors / requests::DOUBLE > 0.05 "
    "UNION SELECT DISTINCT 'RecsysModelColdStart' AS alert, CAST(epoch(window_end) / 30 AS BIGINT) AS tick FROM wl "
    "WHERE cold_starts > 10)",
    "isl AS (SELECT alert, min(tick) AS first_tick, max(tick) AS last_tick FROM "
    "(SELECT alert, tick, tick - row_number() OVER (PARTITION BY alert ORDER BY tick) AS g FROM ticks) GROUP BY alert, g)",
]


@register(
    "sustained_alerts",
    S.with_ctes(
        "SELECT alert, CAST(epoch_ms(first_tick * 30000) AS TIMESTAMP) AS pending_since, "
        "CAST(epoch_ms((first_tick + s) * 30000) AS TIMESTAMP) AS firing_since, "
        "CAST(epoch_ms(last_tick * 30000) AS TIMESTAMP) AS last_true "
        "FROM (SELECT *, CASE alert WHEN 'RecsysHighErrorRate' THEN 10 WHEN 'RecsysModelColdStart' THEN 4 END AS s FROM isl) "
        "WHERE last_tick - first_tick >= s",
        *ALERT_SQL,
    ),
)
def q_sustained_alerts(spark, sf):
    return L.sustained_alerts(L.alert_ticks(log(spark, sf)), L.ALERT_HOLD_SECONDS)


_SEARCH_SQL = {
    "slow_requests": ("endpoint = '/recommend' AND latency_ms > 500.0",
                      "request_id, ts, user_id, endpoint, latency_ms, cold_start, top_k"),
    "failed_requests": ("endpoint IN ('/recommend', '/recommend/batch', '/similar') AND status = 'error'",
                        "request_id, ts, user_id, endpoint, status"),
    "cold_start_requests": ("cold_start", "request_id, ts, user_id, endpoint, top_k, latency_ms"),
    "requests_by_user": ("user_id IS NOT NULL AND endpoint IN ('/recommend', '/recommend/batch')",
                         "request_id, ts, user_id, endpoint, latency_ms, cold_start"),
    "errors_and_warnings": ("(CASE WHEN status = 'error' THEN 'ERROR' ELSE 'INFO' END) IN ('ERROR', 'WARNING', 'CRITICAL')",
                            "request_id, ts, user_id, endpoint, latency_ms, status"),
}


def _search_query(name):
    def q(spark, sf):
        return L.saved_search(log(spark, sf), name)

    q.__name__ = f"q_{name}"
    return q


for _name, (_where, _cols) in _SEARCH_SQL.items():
    register(_name, S.with_ctes(f"SELECT {_cols} FROM request_log WHERE {_where}"))(_search_query(_name))


@register(
    "request_trace",
    S.with_ctes(
        "SELECT 'request_completed' AS event, request_id, ts, 'POST' AS method, endpoint AS path, "
        "CASE WHEN status = 'error' THEN 500 ELSE 200 END AS status_code, latency_ms FROM request_log"
    ),
)
def q_request_trace(spark, sf):
    return L.access_log(log(spark, sf))


@register(
    "request_records",
    S.with_ctes(
        "SELECT request_id, ts, 'POST' AS method, endpoint AS path, 200 AS status_code, latency_ms AS total_latency_ms, "
        "user_id, top_k, cold_start, coalesce(top_k, 0) AS result_count FROM request_log WHERE status = 'success'"
    ),
)
def q_request_records(spark, sf):
    return L.request_records(log(spark, sf))


@register(
    "log_decode",
    S.with_ctes(
        "SELECT request_id, CASE WHEN json_valid(props) THEN TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k, "
        "NOT coalesce(json_valid(props), false) AS corrupt FROM request_log"
    ),
)
def q_log_decode(spark, sf):
    return L.decode_props(log(spark, sf))


@register(
    "log_shaping",
    S.with_ctes(
        "SELECT container_name, event_type AS log_event, split_part(container_name, '-', 2) AS service_name, "
        "'client/' || CAST(user_id % 7 AS VARCHAR) AS http_user_agent, request_id, ts, user_id, endpoint, status, latency_ms, "
        "CAST(ts AS DATE) AS dt FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 'recsys-mlflow-1' WHEN 'view' THEN 'recsys-redis-1' "
        "ELSE 'recsys-api-1' END AS container_name FROM request_log) "
        "WHERE contains(container_name, 'api') OR contains(container_name, 'mlflow') OR contains(container_name, 'airflow') "
        "OR contains(container_name, 'evidently')"
    ),
)
def q_log_shaping(spark, sf):
    return L.shape_for_sink(tables.container_log(spark, sf))


@register(
    "cold_start_counts",
    S.with_ctes("SELECT CAST(count(*) AS BIGINT) AS cold_start_fallback_total FROM request_log WHERE cold_start"),
)
def q_cold_start_counts(spark, sf):
    return log(spark, sf).where(F.col("cold_start")).agg(F.count(F.lit(1)).cast("bigint").alias("cold_start_fallback_total"))
