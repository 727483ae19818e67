"""Request-log analytics: counters, sliding rates, latency quantiles, error ratios,
sustained-threshold alerts, saved searches and log decoding.

All functions take the shaped request log (``rankfold.sources.tables.request_log``)
and work identically on a batch DataFrame and — where noted — on a streaming one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfold.operators.ordering import quantiles, running_totals
from rankfold.sources.tables import COLD_START_EVENT, endpoint_in, status_is

# fixed values: rule windows and the client library's default histogram buckets (seconds)
RULE_WINDOW = "5 minutes"
RULE_WINDOW_SECONDS = 300
EVAL_INTERVAL = "30 seconds"
EVAL_INTERVAL_SECONDS = 30
LATENCY_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]
SLOW_REQUEST_MS = 500.0
ERROR_RATIO_LEVELS = (0.01, 0.05)
COLD_START_SPIKE = 10

LOG_JSON_SCHEMA = "k INT, _corrupt_record STRING"


def requests_by_endpoint(log: DataFrame) -> DataFrame:
    """Counter ``recommendation_requests_total`` by (status, endpoint)."""
    return log.groupBy("status", "endpoint").agg(F.count(F.lit(1)).cast("bigint").alias("requests"))


def _sliding(log: DataFrame, ts_col: str = "ts") -> Column:
    return F.window(F.col(ts_col), RULE_WINDOW, EVAL_INTERVAL)


def windowed_counts(log: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Per 5-minute window sliding every 30 s: requests, errors, cold starts.

    Partial aggregation happens before the shuffle; each event contributes to the 10
    windows that cover it (Spark expands it with an Expand node, no join).
    """
    return log.groupBy(_sliding(log, ts_col).alias("w")).agg(
        F.count(F.lit(1)).cast("bigint").alias("requests"),
        F.sum(F.when(F.col("status") == "error", 1).otherwise(0)).cast("bigint").alias("errors"),
        F.sum(F.when(F.col("cold_start"), 1).otherwise(0)).cast("bigint").alias("cold_starts"),
    ).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "requests", "errors", "cold_starts"
    )


def request_rate(log: DataFrame) -> DataFrame:
    """Requests per second over each sliding 5-minute window."""
    w = windowed_counts(log)
    return w.select(
        "window_start", "window_end", "requests",
        F.round(F.col("requests") / F.lit(float(RULE_WINDOW_SECONDS)), 6).alias("rate_per_s"),
    )


def error_rate(log: DataFrame) -> DataFrame:
    """Error ratio per sliding window with the 1 % and 5 % levels (null ratio without traffic)."""
    return error_ratios(windowed_counts(log))


def error_ratios(w: DataFrame) -> DataFrame:
    """:func:`error_rate` from window counts (batch or streaming)."""
    ratio = F.when(F.col("requests") > 0, F.col("errors") / F.col("requests"))
    return w.select(
        "window_start", "window_end", "requests", "errors",
        F.round(ratio, 6).alias("error_ratio"),
        (ratio > ERROR_RATIO_LEVELS[0]).alias("above_1pct"),
        (ratio > ERROR_RATIO_LEVELS[1]).alias("above_5pct"),
    )


def cold_start_spike(log: DataFrame, threshold: int = COLD_START_SPIKE) -> DataFrame:
    """Cold-start fallbacks per sliding window and the spike flag (> threshold)."""
    return spikes(windowed_counts(log), threshold)


def spikes(w: DataFrame, threshold: int = COLD_START_SPIKE) -> DataFrame:
    """:func:`cold_start_spike` from window counts (batch or streaming)."""
    return w.select("window_start", "window_end", "cold_starts", (F.col("cold_starts") > threshold).alias("spike"))


def latency_quantiles(log: DataFrame, qs: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact latency quantiles per endpoint (linear interpolation)."""
    found = quantiles(log, "latency_ms", qs, ["endpoint"])
    requests = log.groupBy("endpoint").agg(F.count(F.lit(1)).cast("bigint").alias("requests"))
    return requests.join(found, "endpoint", "left").select(
        "endpoint", "requests", *[F.round(f"q{i}", 6).alias(f"p{int(round(q * 100))}_ms") for i, q in enumerate(qs)]
    )


def bucket_counts(log: DataFrame) -> DataFrame:
    """(endpoint, le, n): requests in each latency bucket.  Counts of parts of a log add up to those of
    the whole, so a stream keeps them as its state."""
    seconds = F.col("latency_ms") / 1000.0
    bucket = F.lit(None).cast("double")
    for b in reversed(LATENCY_BUCKETS):
        bucket = F.when(seconds <= b, F.lit(b)).otherwise(bucket)
    return log.groupBy("endpoint", F.coalesce(bucket, F.lit(float("inf"))).alias("le")).agg(F.count(F.lit(1)).alias("n"))


def latency_histogram(log: DataFrame) -> DataFrame:
    """Cumulative histogram per endpoint: (endpoint, le, count) like ``*_bucket`` series."""
    return running_totals(bucket_counts(log), ["le"], ["n"], group_cols=["endpoint"])


def latency_histogram_quantiles(log: DataFrame, qs: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    return histogram_quantiles(bucket_counts(log), qs)


def histogram_quantiles(buckets: DataFrame, qs: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Quantiles estimated from bucket counts with linear interpolation inside the bucket
    (``histogram_quantile``): rank = q * total; the first bucket whose cumulative count
    reaches the rank; lower edge = previous bound (0 for the first); the +Inf bucket
    returns the largest finite bound.  Result in milliseconds."""
    h = running_totals(buckets, ["le"], ["n"], group_cols=["endpoint"]).select("endpoint", "le", F.col("n").alias("cnt"), F.col("n_cum").alias("cum"))
    tot = h.groupBy("endpoint").agg(F.max("cum").alias("total"))
    # lower edge = the preceding fixed bound (0 for the first bucket, the largest finite
    # bound for +Inf); cumulative count below it = the previous non-empty bucket's count
    lo = F.lit(0.0)
    for prev_b, b in zip(LATENCY_BUCKETS, LATENCY_BUCKETS[1:], strict=False):
        lo = F.when(F.col("le") == b, F.lit(prev_b)).otherwise(lo)
    lo = F.when(F.col("le") == float("inf"), F.lit(LATENCY_BUCKETS[-1])).otherwise(lo)
    # bucket rows are bounded by (#endpoints x #buckets)
    prev_cum = F.lag("cum").over(_window_by("endpoint", "le"))
    hb = h.join(tot, "endpoint").select("*", lo.alias("lo"), F.coalesce(prev_cum, F.lit(0.0)).alias("cum_lo"))
    outs = []
    for q in qs:
        rank = F.lit(q) * F.col("total")
        hit = hb.where(F.col("cum") >= rank).groupBy("endpoint").agg(
            F.min_by(F.struct("le", "lo", "cnt", "cum_lo", "total"), F.col("le")).alias("b")
        )
        est = F.when(
            F.col("b.le") == float("inf"), F.col("b.lo")
        ).otherwise(
            F.col("b.lo") + (F.col("b.le") - F.col("b.lo")) * (F.lit(q) * F.col("b.total") - F.col("b.cum_lo")) / F.col("b.cnt")
        )
        outs.append(hit.select("endpoint", F.round(est * 1000.0, 6).alias(f"p{int(round(q * 100))}_ms")))
    res = outs[0]
    for o in outs[1:]:
        res = res.join(o, "endpoint")
    return res


def _window_by(part: str, order: str):
    from pyspark.sql import Window  # noqa: PLC0415

    return Window.partitionBy(part).orderBy(order)


def condition_ticks(windows: DataFrame, condition: Column, alert: str) -> DataFrame:
    """(alert, tick) for every evaluation tick (window end, in 30 s units) where the rule holds.

    Window ends are unique per window, so no de-duplication is needed (and none is
    done, which keeps the function usable on streams)."""
    tick = (F.unix_timestamp(F.col("window_end").cast("timestamp")) / EVAL_INTERVAL_SECONDS).cast("bigint")
    return windows.where(condition).select(F.lit(alert).alias("alert"), tick.alias("tick"))


def sustained_alerts(ticks: DataFrame, hold_seconds: dict[str, int]) -> DataFrame:
    """Gaps-and-islands over true ticks: an alert fires once its condition has held at
    every evaluation for ``hold`` seconds (pending → firing), per alert series.

    Island starts are ticks whose predecessor is not true (anti-join on tick - 1); the
    island id is the running count of starts (distributed running sum, no per-series
    single-partition window); firing islands are those at least ``hold`` long.
    """
    prev = ticks.select("alert", (F.col("tick") + 1).alias("tick"))
    starts = ticks.join(prev, ["alert", "tick"], "left_anti").withColumn("is_start", F.lit(1))
    marked = ticks.join(starts, ["alert", "tick"], "left").select(
        "alert", "tick", F.coalesce(F.col("is_start"), F.lit(0)).alias("is_start")
    )
    ids = running_totals(marked, ["tick"], ["is_start"], group_cols=["alert"])
    islands = ids.groupBy("alert", F.col("is_start_cum").alias("island")).agg(
        F.min("tick").alias("first_tick"), F.max("tick").alias("last_tick")
    )
    hold = F.create_map(*[x for k, v in hold_seconds.items() for x in (F.lit(k), F.lit(v // EVAL_INTERVAL_SECONDS))])
    steps = F.element_at(hold, F.col("alert"))
    to_ts = lambda c: F.timestamp_seconds(c * EVAL_INTERVAL_SECONDS).cast("timestamp_ntz")
    return islands.where(F.col("last_tick") - F.col("first_tick") >= steps).select(
        "alert",
        to_ts(F.col("first_tick")).alias("pending_since"),
        to_ts(F.col("first_tick") + steps).alias("firing_since"),
        to_ts(F.col("last_tick")).alias("last_true"),
    )


def alert_ticks(log: DataFrame) -> DataFrame:
    """The two request rules of the reference as tick series."""
    return alert_ticks_from_windows(windowed_counts(log))


def alert_ticks_from_windows(w: DataFrame) -> DataFrame:
    """Rule ticks from window counts (batch or streaming)."""
    ratio = F.when(F.col("requests") > 0, F.col("errors") / F.col("requests"))
    return condition_ticks(w, ratio > ERROR_RATIO_LEVELS[1], "RecsysHighErrorRate").unionByName(
        condition_ticks(w, F.col("cold_starts") > COLD_START_SPIKE, "RecsysModelColdStart")
    )


DRIFT_ALERT = "EvidentlyDriftDetected"
# fixed values: how long each rule's condition must hold
ALERT_HOLD_SECONDS = {"RecsysHighErrorRate": 300, "RecsysModelColdStart": 120, DRIFT_ALERT: 600}


def status_alerts(reports: DataFrame, ts_col: str, flag_col: str, alert: str, hold_seconds: int) -> DataFrame:
    """Alerts on a status that keeps its value until the next report: stretches of true reports
    that last ``hold_seconds``, the last report lasting until its own time.

    ``reports`` has one row per report, so its rows are few; islands are found as in
    :func:`sustained_alerts`, on report times instead of evaluation ticks.
    """
    from pyspark.sql import Window  # noqa: PLC0415

    order = Window.partitionBy("alert").orderBy(ts_col)
    marked = (
        reports.withColumn("alert", F.lit(alert))
        .withColumn("_before", F.lag(flag_col).over(order))
        .withColumn("_until", F.coalesce(F.lead(ts_col).over(order), F.col(ts_col)))
        .withColumn("_new", (F.col(flag_col) & ~F.coalesce("_before", F.lit(False))).cast("int"))
        .withColumn("_island", F.sum("_new").over(order))
        .where(F.col(flag_col))
    )
    hold = F.make_dt_interval(secs=F.lit(hold_seconds))
    islands = marked.groupBy("alert", "_island").agg(F.min(ts_col).alias("pending_since"), F.max("_until").alias("last_true"))
    return islands.where(F.col("last_true") >= F.col("pending_since") + hold).select(
        "alert", "pending_since", (F.col("pending_since") + hold).alias("firing_since"), "last_true"
    )


# ------------------------------------------------------------------ searches, records


def access_log(log: DataFrame) -> DataFrame:
    """``request_completed`` records derived from the request log."""
    return log.select(
        F.lit("request_completed").alias("event"),
        "request_id",
        "ts",
        F.lit("POST").alias("method"),
        F.col("endpoint").alias("path"),
        F.when(F.col("status") == "error", F.lit(500)).otherwise(F.lit(200)).alias("status_code"),
        "latency_ms",
    )


def served_log(log: DataFrame) -> DataFrame:
    """``recommendation_served`` records (successful requests only)."""
    return log.where(F.col("status") == "success").select(
        F.lit("recommendation_served").alias("event"),
        "request_id",
        "user_id",
        "endpoint",
        "top_k",
        "cold_start",
        F.coalesce(F.col("top_k"), F.lit(0)).alias("result_count"),
        "latency_ms",
    )


def request_records(log: DataFrame) -> DataFrame:
    """Access record ⋈ served record on request_id (batch inner join)."""
    a = access_log(log).select("request_id", "ts", "method", "path", "status_code",
                               F.col("latency_ms").alias("total_latency_ms"))
    s = served_log(log).select("request_id", "user_id", "top_k", "cold_start", "result_count")
    return a.join(s, "request_id")


def log_level(log: DataFrame) -> Column:
    return F.when(F.col("status") == "error", F.lit("ERROR")).otherwise(F.lit("INFO"))


# (filter, columns, sort column of the stored search)
# predicates are written on the source columns (event_type, value, user_id) through the
# view's mapping, so Parquet receives them as pushed filters
SAVED_SEARCHES = {
    "slow_requests": (
        lambda log: endpoint_in("/recommend") & (F.col("latency_ms") > SLOW_REQUEST_MS),
        ["request_id", "ts", "user_id", "endpoint", "latency_ms", "cold_start", "top_k"],
        "latency_ms",
    ),
    "failed_requests": (
        lambda log: endpoint_in("/recommend", "/recommend/batch", "/similar") & status_is("error"),
        ["request_id", "ts", "user_id", "endpoint", "status"],
        "ts",
    ),
    "cold_start_requests": (
        lambda log: F.col("event_type") == COLD_START_EVENT,
        ["request_id", "ts", "user_id", "endpoint", "top_k", "latency_ms"],
        "ts",
    ),
    "requests_by_user": (
        lambda log: F.col("user_id").isNotNull() & endpoint_in("/recommend", "/recommend/batch"),
        ["request_id", "ts", "user_id", "endpoint", "latency_ms", "cold_start"],
        "ts",
    ),
    "errors_and_warnings": (
        # level ERROR is the error status; the view has no WARNING/CRITICAL rows
        lambda log: status_is("error"),
        ["request_id", "ts", "user_id", "endpoint", "latency_ms", "status"],
        "ts",
    ),
}


def saved_search(log: DataFrame, name: str) -> DataFrame:
    """A stored search: its filter, its columns and its sort (descending, ties by request_id)."""
    cond, cols, sort = SAVED_SEARCHES[name]
    return log.where(cond(log)).select(*cols).orderBy(F.col(sort).desc(), F.col("request_id"))


def decode_props(log: DataFrame) -> DataFrame:
    """Parse the JSON payload into top-level fields; unparsable text stays in ``_corrupt``."""
    return decoded(log).select("request_id", "k", "corrupt")


def decoded(log: DataFrame) -> DataFrame:
    """The log with the payload's top-level field ``k`` and ``corrupt``, true for unparsable text."""
    parsed = F.from_json(F.col("props"), LOG_JSON_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record"})
    return log.withColumn("_j", parsed).withColumns({"k": F.col("_j.k"), "corrupt": F.col("_j._corrupt_record").isNotNull()}).drop("_j")


# fixed value: the marker that the log shipper adds to lines it cannot decode
DECODE_ERROR = "parsing input as JSON"


# fixed values: the log shipper's services and renamed fields
SHIPPED_SERVICES = ("api", "mlflow", "airflow", "evidently")
RENAMED_FIELDS = {"event": "log_event", "service": "service_name", "user_agent": "http_user_agent"}


def shape_for_sink(log: DataFrame, ts_col: str = "ts", services_only: bool = True) -> DataFrame:
    """Rows of the shipped services (of all containers without ``services_only``), without the decoded ``timestamp``, with the fields renamed
    that the index reserves (absent fields are left out), and the daily partition column ``dt``."""
    shipped = F.lit(False)
    for service in SHIPPED_SERVICES:
        shipped |= F.col("container_name").contains(service)
    kept = log.where(shipped) if services_only else log
    return (
        kept.drop("timestamp").withColumnsRenamed(RENAMED_FIELDS).withColumn("dt", F.to_date(ts_col))
    )


def write_daily(log: DataFrame, path: str) -> None:
    """Daily-partitioned Parquet sink of the shaped log."""
    shape_for_sink(log).write.mode("overwrite").partitionBy("dt").parquet(path)

