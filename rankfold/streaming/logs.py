"""Structured Streaming versions of the request-log analytics.

The same functions as the batch path (``rankfold.operators.logs``) run on a
streaming DataFrame read from the events Parquet files.  Event time is cast to
TIMESTAMP (watermarks require it; the session time zone is UTC).  Results go to a
Parquet table via ``foreachBatch`` — no driver-side memory sink — one folder per
micro-batch, overwritten when a batch is replayed, with the query's own checkpoint
next to it.  With a ``folder`` of the caller a restarted query resumes where it
stopped and its table has no duplicates; without one it runs once in a new folder.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rankfold.operators import logs as L
from rankfold.session import ensure_checkpoint_dir
from rankfold.sources import tables


def event_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of ``events`` with the batch schema (no inference on streams)."""
    schema = tables.table(spark, sf_dir, "events").schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    ev = reader.parquet(f"{sf_dir}/events*.parquet")
    return tables.shape_request_log(ev).withColumn("ts", F.col("ts").cast("timestamp"))


def _scratch(spark: SparkSession, name: str) -> str:
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/stream-{name}-{uuid.uuid4().hex[:12]}"


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names below a path of any Hadoop filesystem; none if it does not exist."""
    jvm = spark.sparkContext._jvm  # noqa: SLF001 - Hadoop filesystem call
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
    return sorted(status.getPath().getName() for status in fs.listStatus(p)) if fs.exists(p) else []


def run_to_table(df: DataFrame, name: str, output_mode: str = "complete", folder: str | None = None) -> DataFrame:
    """Run a streaming query over everything available now and return its result table.

    Each micro-batch writes ``table/epoch=<id>`` and overwrites it when replayed.  ``complete``
    results are those of the last epoch, ``append`` results those of all.
    """
    spark = df.sparkSession
    base = (folder or _scratch(spark, name)).rstrip("/")
    out = f"{base}/table"

    def sink(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch_id}")

    q = (
        df.writeStream.outputMode(output_mode)
        .option("checkpointLocation", f"{base}/checkpoint")
        .foreachBatch(sink)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    epochs = sorted(int(f.partition("=")[2]) for f in _folders(spark, out) if f.startswith("epoch="))
    if not epochs:
        return spark.createDataFrame([], df.schema)
    chosen = epochs[-1:] if output_mode == "complete" else epochs
    return spark.read.schema(df.schema).parquet(*[f"{out}/epoch={e}" for e in chosen])


def windowed_counts_stream(log: DataFrame, watermark: str | None = None) -> DataFrame:
    """Sliding 5-minute request/error/cold-start counts on a stream.

    With a watermark the state of windows older than it is dropped (append/update
    modes); without one (complete mode) every window stays in state.
    """
    src = log.withWatermark("ts", watermark) if watermark else log
    return L.windowed_counts(src).select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        F.col("window_end").cast("timestamp_ntz").alias("window_end"),
        "requests",
        "errors",
        "cold_starts",
    )


def flushed_windows(finalized: DataFrame, spark: SparkSession, sf_dir: str, watermark: str) -> DataFrame:
    """``finalized`` (append-mode windows) and the windows that the watermark has not closed when
    the input ends, counted from the events of the last watermark and window only."""
    log = tables.request_log(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    last = log.agg((F.max("ts") - F.expr(f"INTERVAL {watermark}") - F.expr(f"INTERVAL {L.RULE_WINDOW}")).alias("t")).first()["t"]
    tail = windowed_counts_stream(log.where(F.col("ts") >= F.lit(last))) if last is not None else windowed_counts_stream(log)
    # a window that begins before the first event read is whole only in the finalised table
    whole = tail.where(F.col("window_start") >= F.lit(last).cast("timestamp_ntz")) if last is not None else tail
    return finalized.unionByName(whole.join(finalized.select("window_start"), "window_start", "left_anti").select(*finalized.columns))


def all_windows_stream(
    spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = None, watermark: str = "10 minutes", folder: str | None = None
) -> DataFrame:
    """Window counts in append mode: the watermark bounds the state; windows still open at the end are
    flushed."""
    closed = run_to_table(windowed_counts_stream(event_stream(spark, sf_dir, max_files_per_trigger), watermark), name, "append", folder)
    return flushed_windows(closed, spark, sf_dir, watermark)


def request_rate_stream(
    spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None, watermark: str = "10 minutes", folder: str | None = None
) -> DataFrame:
    counts = all_windows_stream(spark, sf_dir, "request-rate", max_files_per_trigger, watermark, folder)
    return counts.select(
        "window_start", "window_end", "requests",
        F.round(F.col("requests") / F.lit(float(L.RULE_WINDOW_SECONDS)), 6).alias("rate_per_s"),
    )


def error_rate_stream(
    spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None, watermark: str = "10 minutes", folder: str | None = None
) -> DataFrame:
    """Error ratio of every sliding window, from streamed counts."""
    return L.error_ratios(all_windows_stream(spark, sf_dir, "error-rate", max_files_per_trigger, watermark, folder))


def cold_start_spike_stream(
    spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None, watermark: str = "10 minutes", folder: str | None = None
) -> DataFrame:
    """Cold starts of every sliding window with the spike flag, from streamed counts."""
    return L.spikes(all_windows_stream(spark, sf_dir, "cold-starts", max_files_per_trigger, watermark, folder))


def latency_histogram_quantiles_stream(
    spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None, folder: str | None = None
) -> DataFrame:
    """Latency quantiles per endpoint.  The state is the bucket counts, a few rows per endpoint
    however long the log; the quantiles are read from the latest counts."""
    counts = run_to_table(L.bucket_counts(event_stream(spark, sf_dir, max_files_per_trigger)), "latency-buckets", "complete", folder)
    return L.histogram_quantiles(counts)


def requests_by_endpoint_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_to_table(L.requests_by_endpoint(event_stream(spark, sf_dir)), "requests-by-endpoint", "complete")


def finalized_windows_stream(spark: SparkSession, sf_dir: str, watermark: str = "10 minutes") -> DataFrame:
    """Append mode: each window is written once, after the watermark passes its end.
    Windows still open when the available input ends stay in state (not emitted)."""
    return run_to_table(windowed_counts_stream(event_stream(spark, sf_dir), watermark), "windows-append", "append")


# ---------------------------------------------------------------- sustained alerts


def _alert_state_fn(hold_steps: dict[str, int]):
    import pandas as pd  # noqa: PLC0415

    def emit(alert: str, first: int, last: int) -> pd.DataFrame:
        steps = hold_steps[alert]
        if last - first < steps:
            return pd.DataFrame({"alert": [], "first_tick": [], "last_tick": []})
        return pd.DataFrame({"alert": [alert], "first_tick": [first], "last_tick": [last]})

    def fn(key, pdfs, state):
        alert = key[0]
        if state.hasTimedOut:
            first, last = state.get
            state.remove()
            yield emit(alert, first, last)
            return
        first, last = state.get if state.exists else (None, None)
        ticks = sorted({int(t) for pdf in pdfs for t in pdf["tick"]})
        for t in ticks:
            if last is not None and t <= last:
                continue
            if last is not None and t == last + 1:
                last = t
                continue
            if last is not None:
                yield emit(alert, first, last)
            first = last = t
        if last is not None:
            state.update((first, last))
            # the island closes once event time passes the next evaluation tick
            state.setTimeoutTimestamp((last + 2) * L.EVAL_INTERVAL_SECONDS * 1000)

    return fn


# far beyond any event: a tick that ends every open island and begins one that is never long enough
_END_OF_INPUT = dt.datetime(2200, 1, 1)


def sustained_alerts_stream(spark: SparkSession, sf_dir: str, watermark: str = "10 minutes") -> DataFrame:
    """Two chained streaming queries.  1) sliding-window counts in append mode (each
    window final once the watermark passes it), with the windows still open at the end
    flushed; 2) that table read as a stream, rule ticks per alert, and
    ``applyInPandasWithState`` keyed by alert keeping the open island (first, last tick)
    with an event-time timeout.  Islands held at least the rule's ``for`` duration are
    emitted once closed; the end of the input closes those still open."""
    from pyspark.sql.streaming.state import GroupStateTimeout  # noqa: PLC0415

    base = _scratch(spark, "alerts")
    finalized = run_to_table(windowed_counts_stream(event_stream(spark, sf_dir), watermark), "alerts", "append", f"{base}/counts")
    windows = flushed_windows(finalized, spark, sf_dir, watermark)
    schema = "window_start timestamp_ntz, window_end timestamp_ntz, requests long, errors long, cold_starts long"
    end = spark.createDataFrame([(_END_OF_INPUT, _END_OF_INPUT, 1, 1, L.COLD_START_SPIKE + 1)], schema)
    windows.select("window_start", "window_end", "requests", "errors", "cold_starts").unionByName(end).write.parquet(f"{base}/windows")
    fin = spark.readStream.schema(schema).parquet(f"{base}/windows")
    ticks = L.alert_ticks_from_windows(fin).withColumn(
        "tick_ts", F.timestamp_seconds(F.col("tick") * L.EVAL_INTERVAL_SECONDS)
    ).withWatermark("tick_ts", "1 minute")
    steps = {k: v // L.EVAL_INTERVAL_SECONDS for k, v in L.ALERT_HOLD_SECONDS.items()}
    islands = ticks.groupBy("alert").applyInPandasWithState(
        _alert_state_fn(steps),
        outputStructType="alert string, first_tick long, last_tick long",
        stateStructType="first long, last long",
        outputMode="append",
        timeoutConf=GroupStateTimeout.EventTimeTimeout,
    )
    table = run_to_table(islands, "alert-islands", "append")
    hold = F.create_map(*[x for k, v in steps.items() for x in (F.lit(k), F.lit(v))])
    to_ts = lambda c: F.timestamp_seconds(c * L.EVAL_INTERVAL_SECONDS).cast("timestamp_ntz")
    return table.select(
        "alert",
        to_ts(F.col("first_tick")).alias("pending_since"),
        to_ts(F.col("first_tick") + F.element_at(hold, F.col("alert"))).alias("firing_since"),
        to_ts(F.col("last_tick")).alias("last_true"),
    )


# ---------------------------------------------------------------- access ⋈ served records


def request_records_stream(spark: SparkSession, sf_dir: str, watermark: str = "10 minutes") -> DataFrame:
    """Stream–stream inner join of ``request_completed`` and ``recommendation_served``
    records on request_id, both sides watermarked and the join bounded in event time,
    so join state is dropped once the watermark passes."""
    log = event_stream(spark, sf_dir)
    a = L.access_log(log).select(
        F.col("request_id").alias("a_request_id"), F.col("ts").alias("a_ts"), "method", "path", "status_code",
        F.col("latency_ms").alias("total_latency_ms"),
    ).withWatermark("a_ts", watermark)
    served = log.where(F.col("status") == "success").select(
        F.col("request_id").alias("s_request_id"), F.col("ts").alias("s_ts"), "user_id", "top_k", "cold_start",
        F.coalesce(F.col("top_k"), F.lit(0)).alias("result_count"),
    ).withWatermark("s_ts", watermark)
    joined = a.join(
        served,
        F.expr("a_request_id = s_request_id AND a_ts BETWEEN s_ts - INTERVAL 1 MINUTE AND s_ts + INTERVAL 1 MINUTE"),
    )
    out = joined.select(
        F.col("a_request_id").alias("request_id"), F.col("a_ts").cast("timestamp_ntz").alias("ts"), "method", "path",
        "status_code", "total_latency_ms", "user_id", "top_k", "cold_start", "result_count",
    )
    return run_to_table(out, "request-records", "append")


# ---------------------------------------------------------------- decoding and shipping of logs


def ship_logs_stream(
    spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None, folder: str | None = None, services_only: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(shipped, errors): container records, decoded and routed as they arrive.

    Records whose message decodes go to the daily sink, shaped as in ``logs.shape_for_sink``; those that
    do not go to a second sink with the text and the shipper's error marker.  A micro-batch writes
    one folder in each sink and overwrites both when it is replayed, so every record is in
    exactly one sink, once.  ``services_only`` drops other containers' records first."""
    base = (folder or _scratch(spark, "ship-logs")).rstrip("/")
    sinks = {name: f"{base}/{name}" for name in ("shipped", "errors")}
    records = tables.shape_container_log(L.decoded(event_stream(spark, sf_dir, max_files_per_trigger)))
    shaped = L.shape_for_sink(records, services_only=services_only)
    good = ~F.col("corrupt")

    def split(batch: DataFrame) -> dict[str, DataFrame]:
        return {
            "shipped": batch.where(good).drop("props", "corrupt"),
            "errors": batch.where(~good).drop("corrupt", "k").withColumnRenamed("props", "message").withColumn("error", F.lit(L.DECODE_ERROR)),
        }

    def sink(batch: DataFrame, epoch_id: int) -> None:
        for name, part in split(batch).items():
            part.write.mode("overwrite").partitionBy("dt").parquet(f"{sinks[name]}/epoch={epoch_id}")

    q = shaped.writeStream.option("checkpointLocation", f"{base}/checkpoint").foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    schemas = {name: part.schema for name, part in split(shaped).items()}

    def written(name: str) -> DataFrame:
        epochs = [f for f in _folders(spark, sinks[name]) if f.startswith("epoch=")]
        columns = schemas[name].names
        if not epochs:
            return spark.createDataFrame([], schemas[name])
        return spark.read.schema(schemas[name]).option("basePath", sinks[name]).parquet(*[f"{sinks[name]}/{e}" for e in epochs]).select(*columns)

    return written("shipped"), written("errors")


# ---------------------------------------------------------------- the drift rule


class HeldStatus(StatefulProcessor):
    """The alert of one status that keeps its value until the next report.

    State: when the status turned true and when it was last known to be.  A timer is set for the moment
    at which the status has held long enough, so the alert fires then even if no report comes.
    Rows (pending_since, last_true) are sent while the alert fires; the latest of them counts."""

    def __init__(self, hold_seconds: int):
        self.hold = hold_seconds * 1_000_000  # times are microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.since = handle.getValueState("since", "at long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802 - interface
        since = self.since.get()[0] if self.since.exists() else None
        for row in sorted(rows, key=lambda r: r["at"]):
            if since is not None and row["at"] >= since + self.hold:
                yield Row(alert=key[0], pending_since=since, last_true=row["at"])
            if not row["status"]:
                since = None
            elif since is None:
                since = row["at"]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if since is None:
            self.since.clear()
        else:
            self.since.update((since,))
            self.handle.registerTimer((since + self.hold) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802 - interface
        if self.since.exists():
            since = self.since.get()[0]
            yield Row(alert=key[0], pending_since=since, last_true=since + self.hold)

    def close(self) -> None:
        pass


def status_rows(reports: DataFrame, alert: str, hold_seconds: int, time_mode: str = "EventTime") -> DataFrame:
    """Streaming rows (alert, pending_since, last_true) of a stream of reports (ts, status) while the alert
    fires.  With ``time_mode`` "EventTime" the clock is that of the reports; with "ProcessingTime" an
    alert fires at its time on the wall clock without further input."""
    spark = reports.sparkSession
    # the state store that value state and timers need
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keyed = reports.select(F.lit(alert).alias("alert"), F.col("ts").cast("timestamp").alias("ts"), F.col("status").cast("boolean").alias("status"))
    keyed = keyed.withColumn("at", F.unix_micros("ts"))
    rows = keyed.withWatermark("ts", "0 seconds").groupBy("alert").transformWithState(
        statefulProcessor=HeldStatus(hold_seconds), outputStructType="alert string, pending_since long, last_true long", outputMode="Append",
        timeMode=time_mode,
    )
    return rows.select("alert", F.timestamp_micros("pending_since").alias("pending_since"), F.timestamp_micros("last_true").alias("last_true"))


def status_alerts_stream(reports: DataFrame, alert: str, hold_seconds: int, folder: str | None = None) -> DataFrame:
    """The alerts of all reports available now, as ``logs.status_alerts`` finds them."""
    sent = run_to_table(status_rows(reports, alert, hold_seconds), "status-alerts", "append", folder)
    hold = F.make_dt_interval(secs=F.lit(hold_seconds))
    return sent.groupBy("alert", "pending_since").agg(F.max("last_true").alias("last_true")).select(
        "alert", F.col("pending_since").cast("timestamp_ntz").alias("pending_since"), (F.col("pending_since") + hold).cast("timestamp_ntz").alias("firing_since"),
        F.col("last_true").cast("timestamp_ntz").alias("last_true"),
    )


def report_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The reports (ts, status) written below a folder, as a stream."""
    reader = spark.readStream.schema("ts timestamp_ntz, status boolean")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)
