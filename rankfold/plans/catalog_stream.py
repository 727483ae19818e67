"""Registered streaming queries: their result tables must equal the batch queries'."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rankfold.operators import logs as L
from rankfold.plans import catalog_drift as D
from rankfold.plans.catalog import ORACLES, register
from rankfold.session import ensure_checkpoint_dir
from rankfold.streaming import logs as SL


@register("request_rate_stream", ORACLES["request_rate"])
def q_request_rate_stream(spark, sf):
    """Sliding-window request rate computed by a Structured Streaming query (append mode, flushed)."""
    return SL.request_rate_stream(spark, sf)


@register("requests_by_endpoint_stream", ORACLES["requests_by_endpoint"])
def q_requests_by_endpoint_stream(spark, sf):
    return SL.requests_by_endpoint_stream(spark, sf)


@register("sustained_alerts_stream", ORACLES["sustained_alerts"])
def q_sustained_alerts_stream(spark, sf):
    """Sustained-threshold alerts from two chained streaming queries (append mode with
    watermarks, stateful islands per alert, open ones flushed at the end of the input)."""
    return SL.sustained_alerts_stream(spark, sf)


@register("request_records_stream", ORACLES["request_records"])
def q_request_records_stream(spark, sf):
    """Per-request access records by a watermarked stream-stream join (equals the batch join)."""
    return SL.request_records_stream(spark, sf)


@register("error_rate_stream", ORACLES["error_rate"])
def q_error_rate_stream(spark, sf):
    """Error ratio per sliding window from streamed window counts (append mode, flushed)."""
    return SL.error_rate_stream(spark, sf)


@register("cold_start_spike_stream", ORACLES["cold_start_spike"])
def q_cold_start_spike_stream(spark, sf):
    """Cold-start spikes from streamed window counts (append mode, flushed)."""
    return SL.cold_start_spike_stream(spark, sf)


@register("latency_histogram_quantiles_stream", ORACLES["latency_histogram_quantiles"])
def q_latency_histogram_quantiles_stream(spark, sf):
    """Latency quantiles read from a stream's state of bucket counts."""
    return SL.latency_histogram_quantiles_stream(spark, sf)


@register("log_decode_stream", ORACLES["log_decode"])
def q_log_decode_stream(spark, sf):
    """Decoded records of a log stream: the daily sink and the sink of lines that do not decode."""
    shipped, errors = SL.ship_logs_stream(spark, sf)
    return shipped.select("request_id", "k", F.lit(False).alias("corrupt")).unionByName(
        errors.select("request_id", F.lit(None).cast("int").alias("k"), F.lit(True).alias("corrupt"))
    )


@register("log_shaping_stream", ORACLES["log_shaping"])
def q_log_shaping_stream(spark, sf):
    """Records of the shipped services, shaped and routed as they arrive (both sinks)."""
    shipped, errors = SL.ship_logs_stream(spark, sf, services_only=True)
    rows = shipped.drop("k").unionByName(errors.drop("message", "error"))
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register("drift_status_alerts_stream", ORACLES["drift_status_alerts"])
def q_drift_status_alerts_stream(spark, sf):
    """The drift rule over the reports as a stream."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/reports-{uuid.uuid4().hex}"
    reports = D.drift_reports(spark, sf).select(F.col("report_month").cast("timestamp_ntz").alias("ts"), F.col("drift_detected").alias("status"))
    reports.repartitionByRange("ts").write.parquet(path)
    return SL.status_alerts_stream(SL.report_stream(spark, path), L.DRIFT_ALERT, L.ALERT_HOLD_SECONDS[L.DRIFT_ALERT])
