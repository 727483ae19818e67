"""Registered drift queries: the train split against the test split and later months."""

from __future__ import annotations

from rankfold.operators import drift as D
from rankfold.plans import stages as P
from rankfold.plans import sql as S
from rankfold.plans.catalog import register
from rankfold.session import materialize

DRIFT_COLUMNS = ["rating", "timestamp", "user_idx", "movie_idx"]
# one test per column, whatever the size of the tables
DRIFT_TESTS = dict.fromkeys(DRIFT_COLUMNS, "wasserstein")


def reference_and_current(spark, sf):
    ref, cur = P.part(spark, sf, "train"), P.part(spark, sf, "test")
    return ref, cur, [c for c in D.common_columns(ref, cur) if c in DRIFT_COLUMNS]


def drift_table(spark, sf):
    ref, cur, cols = reference_and_current(spark, sf)
    return D.finalize_small_tests(D.drift_columns(ref, cur, cols, tests=DRIFT_TESTS))


_LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST(\"{c}\" AS DOUBLE) AS value, '{side}' AS side FROM {side}"
    for side in ("ref", "cur")
    for c in DRIFT_COLUMNS
)
DRIFT_SQL = [
    "ref AS (SELECT * FROM train)",
    "cur AS (SELECT * FROM test)",
    f"lv AS ({_LONG})",
    "h AS (SELECT feature, value, sum(CASE WHEN side = 'ref' THEN 1 ELSE 0 END) AS c_ref, "
    "sum(CASE WHEN side = 'cur' THEN 1 ELSE 0 END) AS c_cur FROM lv WHERE value IS NOT NULL GROUP BY feature, value)",
    "t AS (SELECT feature, sum(c_ref) AS n_ref, sum(c_cur) AS n_cur, sum(CASE WHEN c_ref > 0 THEN 1 ELSE 0 END) AS n_unique_ref, "
    "sum(c_ref * value) AS s1, sum(c_ref * value * value) AS s2 FROM h GROUP BY feature)",
    "r AS (SELECT h.*, t.n_ref, t.n_cur, sum(c_ref) OVER w AS cr, sum(c_cur) OVER w AS cc, lead(value) OVER w AS nv "
    "FROM h JOIN t USING (feature) WINDOW w AS (PARTITION BY feature ORDER BY value))",
    "st AS (SELECT feature, "
    "sum(abs(cr / n_ref - cc / n_cur) * coalesce(nv - value, 0.0)) AS wraw, max(abs(cr / n_ref - cc / n_cur)) AS ks, "
    "sqrt(greatest(sum(0.5 * CASE WHEN c_ref > 0 THEN (c_ref / n_ref) * ln((c_ref / n_ref) / ((c_ref / n_ref + c_cur / n_cur) / 2)) ELSE 0 END "
    "+ 0.5 * CASE WHEN c_cur > 0 THEN (c_cur / n_cur) * ln((c_cur / n_cur) / ((c_ref / n_ref + c_cur / n_cur) / 2)) ELSE 0 END), 0.0)) AS js, "
    "sum(CASE WHEN c_ref > 0 THEN 1 ELSE 0 END) - 1 AS dof FROM r GROUP BY feature)",
    "dc AS (SELECT st.feature, CAST(t.n_ref AS BIGINT) AS n_ref, CAST(t.n_cur AS BIGINT) AS n_cur, "
    "CAST(t.n_unique_ref AS BIGINT) AS n_unique_ref, "
    "st.wraw / greatest(sqrt(greatest(t.s2 / t.n_ref - (t.s1 / t.n_ref) ^ 2, 0.0)), 0.001) AS w, st.js, st.ks, "
    "CAST(st.dof AS BIGINT) AS dof FROM st JOIN t USING (feature))",
    "drift AS (SELECT feature, n_ref, n_cur, n_unique_ref, "
    "'wasserstein' AS stattest, round(w, 6) AS statistic, round(ks, 6) AS ks_statistic, dof, "
    "CAST(0.1 AS DOUBLE) AS threshold, w >= 0.1 AS drifted FROM dc)",
]


@register(
    "drift_columns",
    S.with_ctes(
        "SELECT feature, n_ref, n_cur, n_unique_ref, stattest, statistic, ks_statistic, dof, threshold, drifted FROM drift",
        *DRIFT_SQL,
        prepared=True,
    ),
)
def q_drift_columns(spark, sf):
    return drift_table(spark, sf)


@register(
    "drift_summary",
    S.with_ctes(
        "SELECT CAST(count(*) AS BIGINT) AS n_columns, CAST(sum(CAST(drifted AS INTEGER)) AS BIGINT) AS n_drifted, "
        "round(sum(CAST(drifted AS INTEGER)) / count(*)::DOUBLE, 6) AS drift_score, "
        "sum(CAST(drifted AS INTEGER)) / count(*)::DOUBLE >= 0.5 AS drift_detected, "
        "max(n_ref) AS reference_rows, max(n_cur) AS current_rows FROM drift",
        *DRIFT_SQL,
        prepared=True,
    ),
)
def q_drift_summary(spark, sf):
    return D.drift_summary(drift_table(spark, sf))


# ------------------------------------------------------------------ drift reports over time (L7)


def drift_reports(spark, sf):
    """One drift report per calendar month of the held-out (val + test) period against
    the train split: per-report column tests, then the dataset summary."""
    from pyspark.sql import functions as F  # noqa: PLC0415

    def build():
        ref, _, cols = reference_and_current(spark, sf)
        held = P.split(spark, sf).where(F.col("split").isin("val", "test"))
        # histograms are kept per day and merged to months
        daily = materialize(D.histogram(held.withColumn("day", F.to_date(F.timestamp_seconds("timestamp"))), cols, ["day"]), "daily-histograms")
        monthly = materialize(D.merge_histograms(daily.withColumn("report_month", F.date_format("day", "yyyy-MM-01")), ["report_month"]), "monthly-histograms")
        reference = materialize(D.histogram(ref, cols), "reference-histogram")
        stats = D.histogram_statistics(reference, monthly, "report_month")
        per_col = D.finalize_small_tests(D.tested(stats, [], group="report_month", tests=DRIFT_TESTS))
        return materialize(D.drift_summary(per_col, group="report_month"), "drift-reports")

    return P._memo(spark, sf, ("drift_reports",), build)


_LONG_CUR = " UNION ALL ".join(
    f"SELECT grp, '{c}' AS feature, CAST(\"{c}\" AS DOUBLE) AS value FROM cur" for c in DRIFT_COLUMNS
)
_LONG_REF = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(\"{c}\" AS DOUBLE) AS value FROM ref" for c in DRIFT_COLUMNS)
REPORT_SQL = [
    DRIFT_SQL[0],
    "cur AS (SELECT *, strftime(CAST(epoch_ms(\"timestamp\" * 1000) AS DATE), '%Y-%m-01') AS grp FROM split "
    "WHERE split IN ('val', 'test'))",
    "months AS (SELECT DISTINCT grp FROM cur)",
    f"href AS (SELECT feature, value, count(*) AS c FROM ({_LONG_REF}) WHERE value IS NOT NULL GROUP BY feature, value)",
    f"h AS (SELECT grp, feature, value, sum(c_ref) AS c_ref, sum(c_cur) AS c_cur FROM ("
    f"SELECT m.grp, r.feature, r.value, r.c AS c_ref, 0 AS c_cur FROM href r CROSS JOIN months m "
    f"UNION ALL SELECT grp, feature, value, 0 AS c_ref, 1 AS c_cur FROM ({_LONG_CUR}) WHERE value IS NOT NULL) "
    f"GROUP BY grp, feature, value)",
    "t AS (SELECT grp, feature, sum(c_ref) AS n_ref, sum(c_cur) AS n_cur, sum(CASE WHEN c_ref > 0 THEN 1 ELSE 0 END) "
    "AS n_unique_ref, sum(c_ref * value) AS s1, sum(c_ref * value * value) AS s2 FROM h GROUP BY grp, feature)",
    "r AS (SELECT h.*, t.n_ref, t.n_cur, sum(c_ref) OVER w AS cr, sum(c_cur) OVER w AS cc, lead(value) OVER w AS nv "
    "FROM h JOIN t USING (grp, feature) WINDOW w AS (PARTITION BY grp, feature ORDER BY value))",
    "st AS (SELECT grp, feature, sum(abs(cr / n_ref - cc / n_cur) * coalesce(nv - value, 0.0)) AS wraw, "
    "sqrt(greatest(sum(0.5 * CASE WHEN c_ref > 0 THEN (c_ref / n_ref) * ln((c_ref / n_ref) / ((c_ref / n_ref + c_cur / n_cur) / 2)) ELSE 0 END "
    "+ 0.5 * CASE WHEN c_cur > 0 THEN (c_cur / n_cur) * ln((c_cur / n_cur) / ((c_ref / n_ref + c_cur / n_cur) / 2)) ELSE 0 END), 0.0)) AS js "
    "FROM r GROUP BY grp, feature)",
    "dc AS (SELECT st.grp, st.feature, t.n_ref, t.n_cur, "
    "st.wraw / greatest(sqrt(greatest(t.s2 / t.n_ref - (t.s1 / t.n_ref) ^ 2, 0.0)), 0.001) AS w, st.js "
    "FROM st JOIN t USING (grp, feature))",
    "rep AS (SELECT grp, CAST(count(*) AS BIGINT) AS n_columns, "
    "CAST(sum(CAST(w >= 0.1 AS INTEGER)) AS BIGINT) AS n_drifted, "
    "max(n_ref) AS reference_rows, max(n_cur) AS current_rows FROM dc GROUP BY grp)",
]


@register(
    "drift_reports",
    S.with_ctes(
        "SELECT grp AS report_month, n_columns, n_drifted, round(n_drifted / n_columns::DOUBLE, 6) AS drift_score, "
        "n_drifted / n_columns::DOUBLE >= 0.5 AS drift_detected, reference_rows, current_rows FROM rep",
        *REPORT_SQL,
        prepared=True,
    ),
)
def q_drift_reports(spark, sf):
    """Time series of drift reports (one per month of the held-out period)."""
    return drift_reports(spark, sf)


@register(
    "drift_latest",
    S.with_ctes(
        "SELECT max(grp) AS report_month, CAST(count(*) AS BIGINT) AS n_reports, "
        "round(arg_max(n_drifted / n_columns::DOUBLE, grp), 6) AS drift_score, "
        "arg_max(n_drifted / n_columns::DOUBLE >= 0.5, grp) AS drift_detected, "
        "CAST(sum(CASE WHEN n_drifted / n_columns::DOUBLE >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_drift_reports FROM rep",
        *REPORT_SQL,
        prepared=True,
    ),
)
def q_drift_latest(spark, sf):
    """Latest drift status (score and flag of the newest report) and report counts."""
    from pyspark.sql import functions as F  # noqa: PLC0415

    r = drift_reports(spark, sf)
    return r.agg(
        F.max("report_month").alias("report_month"),
        F.count(F.lit(1)).cast("bigint").alias("n_reports"),
        F.max_by("drift_score", "report_month").alias("drift_score"),
        F.max_by("drift_detected", "report_month").alias("drift_detected"),
        F.sum(F.col("drift_detected").cast("int")).cast("bigint").alias("n_drift_reports"),
    )


@register(
    "drift_reports_per_hour",
    S.with_ctes(
        "SELECT hour, CAST(count(*) AS BIGINT) AS reports, CAST(sum(CAST(d AS INTEGER)) AS BIGINT) AS with_drift, "
        "round(max(score), 6) AS max_score FROM (SELECT CAST(grp AS TIMESTAMP) AS hour, n_drifted / n_columns::DOUBLE AS score, "
        "n_drifted / n_columns::DOUBLE >= 0.5 AS d FROM rep) GROUP BY hour",
        *REPORT_SQL,
        prepared=True,
    ),
)
def q_drift_reports_per_hour(spark, sf):
    """Drift reports generated per hour, those that flagged drift, and the highest score."""
    from pyspark.sql import functions as F  # noqa: PLC0415

    hour = F.date_trunc("hour", F.col("report_month").cast("timestamp_ntz")).cast("timestamp_ntz")
    return drift_reports(spark, sf).groupBy(hour.alias("hour")).agg(
        F.count(F.lit(1)).cast("bigint").alias("reports"), F.sum(F.col("drift_detected").cast("int")).cast("bigint").alias("with_drift"),
        F.round(F.max("drift_score"), 6).alias("max_score"),
    )


@register(
    "drift_events",
    S.with_ctes(
        "SELECT 'drift_report_generated' AS event, grp AS report_month, round(n_drifted / n_columns::DOUBLE, 6) AS drift_score, "
        "n_drifted / n_columns::DOUBLE >= 0.5 AS drift_detected, reference_rows, current_rows FROM rep",
        *REPORT_SQL,
        prepared=True,
    ),
)
def q_drift_events(spark, sf):
    """Saved search "drift reports": one event row per generated report."""
    from pyspark.sql import functions as F  # noqa: PLC0415

    return drift_reports(spark, sf).select(
        F.lit("drift_report_generated").alias("event"), "report_month", "drift_score", "drift_detected",
        "reference_rows", "current_rows",
    )


@register(
    "drift_alerts",
    S.with_ctes(
        "SELECT grp AS report_month, round(n_drifted / n_columns::DOUBLE, 6) AS drift_score, true AS drift_detected "
        "FROM rep WHERE n_drifted / n_columns::DOUBLE >= 0.5",
        *REPORT_SQL,
        prepared=True,
    ),
)
def q_drift_alerts(spark, sf):
    """Saved search "drift detected": reports that flagged dataset drift."""
    from pyspark.sql import functions as F  # noqa: PLC0415

    return drift_reports(spark, sf).where(F.col("drift_detected")).select("report_month", "drift_score", "drift_detected")


# ------------------------------------------------------------------ every test, on the request log (D1, D3)

# the log's columns with one test each: numbers, strings and a flag
LOG_TESTS = {"latency_ms": "ks", "user_id": "wasserstein", "event_type": "jensenshannon", "endpoint": "chisquare", "cold_start": "z"}
REFERENCE_SHARE = 0.7


def log_reference_and_current(spark, sf):
    """The request log before and after the time by which ``REFERENCE_SHARE`` of its span has passed."""
    from pyspark.sql import functions as F  # noqa: PLC0415

    from rankfold.sources import tables  # noqa: PLC0415

    log = tables.request_log(spark, sf).withColumn("at", tables.epoch_seconds("ts"))
    span = log.agg(F.min("at").alias("a"), F.max("at").alias("b")).first()
    cut = span["a"] + int((span["b"] - span["a"]) * REFERENCE_SHARE)
    columns = [*LOG_TESTS, "at"]
    return log.select(columns).where(F.col("at") < cut).drop("at"), log.select(columns).where(F.col("at") >= cut).drop("at")


_LOG_LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {'NULL::DOUBLE' if c in ('event_type', 'endpoint', 'cold_start') else f'CAST({c} AS DOUBLE)'} AS value, "
    f"{f'CAST({c} AS VARCHAR)' if c in ('event_type', 'endpoint', 'cold_start') else 'NULL::VARCHAR'} AS category, side FROM sided"
    for c in LOG_TESTS
)
_TEST_CASE = "CASE h.feature " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in LOG_TESTS.items()) + " END"
# fixed values: 95 % points of chi-square with 1, 2, ... degrees of freedom
_CHI2_95 = "[3.841459, 5.991465, 7.814728, 9.487729, 11.070498, 12.591587, 14.067140]"
LOG_DRIFT_SQL = [
    "timed AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM request_log)",
    f"cut AS (SELECT min(sec) + CAST(floor((max(sec) - min(sec)) * {REFERENCE_SHARE!r}e0) AS BIGINT) AS sec FROM timed)",
    "sided AS (SELECT timed.*, CASE WHEN timed.sec < cut.sec THEN 'ref' ELSE 'cur' END AS side FROM timed, cut)",
    f"h AS (SELECT feature, value, category, count(*) FILTER (side = 'ref') AS c_ref, count(*) FILTER (side = 'cur') AS c_cur "
    f"FROM ({_LOG_LONG}) WHERE value IS NOT NULL OR category IS NOT NULL GROUP BY feature, value, category)",
    "t AS (SELECT feature, sum(c_ref) AS n_ref, sum(c_cur) AS n_cur, count(*) FILTER (c_ref > 0) AS k, "
    "sum(c_ref * value) AS s1, sum(c_ref * value * value) AS s2 FROM h GROUP BY feature)",
    f"r AS (SELECT h.*, t.n_ref, t.n_cur, t.k, t.s1, t.s2, {_TEST_CASE} AS stattest, sum(c_ref) OVER w AS cr, sum(c_cur) OVER w AS cc, "
    "lead(value) OVER w AS nv, c_ref / n_ref AS p, c_cur / n_cur AS q, (c_ref + c_cur) / (n_ref + n_cur) AS pool "
    "FROM h JOIN t ON t.feature = h.feature WINDOW w AS (PARTITION BY h.feature ORDER BY value, category))",
    "st AS (SELECT feature, stattest, any_value(n_ref) AS n_ref, any_value(n_cur) AS n_cur, any_value(k) AS k, "
    "sum(abs(cr / n_ref - cc / n_cur) * coalesce(nv - value, 0.0)) / greatest(sqrt(greatest(any_value(s2 / n_ref - (s1 / n_ref) ^ 2), 0.0)), 0.001) AS w, "
    "max(abs(cr / n_ref - cc / n_cur)) AS ks, "
    "sqrt(greatest(sum(0.5 * CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + 0.5 * CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END), 0.0)) AS js, "
    "sum(CASE WHEN p > 0 THEN (c_cur - p * n_cur) ^ 2 / (p * n_cur) ELSE 0.0 END) AS chi2, "
    "max(CASE WHEN pool * (1 - pool) > 0 THEN abs(p - q) / sqrt(pool * (1 - pool) * (1 / n_ref + 1 / n_cur)) ELSE 0.0 END) AS z "
    "FROM r GROUP BY feature, stattest)",
    "sc AS (SELECT *, CASE stattest WHEN 'wasserstein' THEN w WHEN 'jensenshannon' THEN js WHEN 'ks' THEN ks WHEN 'chisquare' THEN chi2 ELSE z END AS x, "
    "sqrt(n_ref * n_cur / (n_ref + n_cur)) AS en FROM st)",
]


@register(
    "drift_columns_log",
    S.with_ctes(
        "SELECT feature, CAST(n_ref AS BIGINT) AS n_ref, CAST(n_cur AS BIGINT) AS n_cur, CAST(k AS BIGINT) AS n_unique_ref, stattest, "
        "round(x, 6) AS statistic, CAST(CASE WHEN stattest IN ('wasserstein', 'jensenshannon') THEN 0.1 ELSE 0.05 END AS DOUBLE) AS threshold, "
        "CASE WHEN stattest IN ('wasserstein', 'jensenshannon') THEN x >= 0.1 WHEN stattest = 'z' THEN x > 1.959964 "
        f"WHEN stattest = 'chisquare' THEN x > list_extract({_CHI2_95}, CAST(k - 1 AS INTEGER)) "
        "ELSE list_sum(list_transform(range(1, 101), lambda j: 2 * (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * "
        "exp(-2.0 * j * j * ((en + 0.12 + 0.11 / en) * x) ^ 2))) < 0.05 END AS drifted FROM sc",
        *LOG_DRIFT_SQL,
    ),
)
def q_drift_columns_log(spark, sf):
    """Each drift test on one column of the request log: the log's later part against its earlier."""
    ref, cur = log_reference_and_current(spark, sf)
    return D.finalize_small_tests(D.drift_columns(ref, cur, list(LOG_TESTS), tests=LOG_TESTS)).select(
        "feature", "n_ref", "n_cur", "n_unique_ref", "stattest", "statistic", "threshold", "drifted"
    )


# ------------------------------------------------------------------ the drift rule (L6)


@register(
    "drift_status_alerts",
    S.with_ctes(
        "SELECT 'EvidentlyDriftDetected' AS alert, min(ts) AS pending_since, min(ts) + INTERVAL 600 SECOND AS firing_since, max(until) AS last_true FROM ("
        "SELECT *, sum(CASE WHEN d AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (ORDER BY ts) AS island FROM ("
        "SELECT CAST(grp AS TIMESTAMP) AS ts, n_drifted / n_columns::DOUBLE >= 0.5 AS d, lag(n_drifted / n_columns::DOUBLE >= 0.5) OVER (ORDER BY grp) AS before, "
        "coalesce(lead(CAST(grp AS TIMESTAMP)) OVER (ORDER BY grp), CAST(grp AS TIMESTAMP)) AS until FROM rep)) "
        "WHERE d GROUP BY island HAVING max(until) - min(ts) >= INTERVAL 600 SECOND",
        *REPORT_SQL,
        prepared=True,
    ),
)
def q_drift_status_alerts(spark, sf):
    """The third rule: the reported drift status has been 1 for ten minutes."""
    from pyspark.sql import functions as F  # noqa: PLC0415

    from rankfold.operators import logs as L  # noqa: PLC0415

    reports = drift_reports(spark, sf).select(F.col("report_month").cast("timestamp_ntz").alias("ts"), "drift_detected")
    return L.status_alerts(reports, "ts", "drift_detected", L.DRIFT_ALERT, L.ALERT_HOLD_SECONDS[L.DRIFT_ALERT])
