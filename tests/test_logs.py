"""Request-log analytics and streaming = batch."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from rankfold.operators import logs as L
from rankfold.sources import tables
from rankfold.streaming import logs as SL


def test_sustained_alert_needs_hold(spark):
    # ticks 10..20 true (11 ticks = 300 s span) and 30..32 true (too short)
    ticks = spark.createDataFrame([("A", t) for t in list(range(10, 21)) + [30, 31, 32]], "alert string, tick long")
    out = L.sustained_alerts(ticks, {"A": 300}).collect()
    assert len(out) == 1
    assert out[0].pending_since == dt.datetime(1970, 1, 1, 0, 5, 0)
    assert out[0].firing_since == dt.datetime(1970, 1, 1, 0, 10, 0)


def test_windows_cover_each_event_ten_times(spark, small_dir):
    log = tables.request_log(spark, small_dir)
    w = L.windowed_counts(log)
    assert w.agg(F.sum("requests")).first()[0] == 10 * log.count()


def test_stream_equals_batch(spark, small_dir):
    batch = L.request_rate(tables.request_log(spark, small_dir)).orderBy("window_start").collect()
    stream = SL.request_rate_stream(spark, small_dir).orderBy("window_start").collect()
    assert batch == stream


def test_decode_marks_corrupt(spark):
    log = spark.createDataFrame([(1, '{"k": 5}'), (2, "{bad")], "request_id long, props string")
    rows = {r.request_id: r for r in L.decode_props(log).collect()}
    assert rows[1].k == 5 and not rows[1].corrupt
    assert rows[2].k is None and rows[2].corrupt


def test_stream_alerts_are_batch_alerts(spark, small_dir):
    batch = {tuple(r) for r in L.sustained_alerts(L.alert_ticks(tables.request_log(spark, small_dir)),
                                                  L.ALERT_HOLD_SECONDS).collect()}
    stream = {tuple(r) for r in SL.sustained_alerts_stream(spark, small_dir).collect()}
    assert stream == batch


def test_daily_sink_partitions_by_date(spark, small_dir):
    import tempfile

    path = tempfile.mkdtemp(prefix="rankfold-logs-") + "/index"
    log = tables.container_log(spark, small_dir)
    L.write_daily(log, path)
    back = spark.read.parquet(path)
    shipped = log.where(~F.col("container_name").contains("redis"))
    assert 0 < back.count() == shipped.count() < log.count()
    assert not {"timestamp", "event", "service", "user_agent"} & set(back.columns)
    assert {"log_event", "service_name", "http_user_agent", "dt"} <= set(back.columns)
    assert back.select("dt").distinct().count() == shipped.select(F.to_date("ts")).distinct().count()


def test_saved_searches_keep_their_sort(spark, small_dir):
    rows = L.saved_search(tables.request_log(spark, small_dir), "failed_requests").collect()
    assert rows == sorted(rows, key=lambda r: (-r.ts.timestamp(), r.request_id)) and rows


def test_status_alert_needs_ten_minutes(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    reports = spark.createDataFrame(
        [(t(0), False), (t(5), True), (t(9), True), (t(20), False), (t(30), True), (t(35), False), (t(50), True)], "ts timestamp_ntz, d boolean"
    )
    out = L.status_alerts(reports, "ts", "d", "A", 600).collect()
    assert [(r.pending_since, r.firing_since, r.last_true) for r in out] == [(t(5), t(15), t(20))]


def test_restarted_stream_resumes_without_duplicates(spark, small_dir):
    import shutil
    import tempfile

    scratch = tempfile.mkdtemp(prefix="rankfold-restart-")
    spark.read.parquet(f"{small_dir}/events.parquet").orderBy("event_id").repartition(4, "event_id").write.parquet(f"{scratch}/all")
    parts = sorted(f for f in os.listdir(f"{scratch}/all") if f.endswith(".parquet"))
    run, folder = f"{scratch}/run", f"{scratch}/events.parquet"
    os.makedirs(folder)
    for step in (parts[:2], parts[2:], []):  # stop, new files, restart; then a restart without any
        for f in step:
            shutil.copy(f"{scratch}/all/{f}", f"{folder}/{f}")
        out = SL.run_to_table(SL.L.access_log(SL.event_stream(spark, scratch, 1)), "restart", "append", run)
    assert out.count() == out.select("request_id").distinct().count() == spark.read.parquet(f"{scratch}/all").count()
    # a replayed batch overwrites its own epoch
    spark.read.parquet(f"{run}/table/epoch=0").limit(0).write.mode("overwrite").parquet(f"{run}/replayed")
    assert SL.run_to_table(SL.L.access_log(SL.event_stream(spark, scratch, 1)), "restart", "append", run).count() == out.count()


def test_multi_batch_stream_equals_batch(spark, small_dir):
    """Events split over 4 files in time order, one file per micro-batch: window state carries over."""
    import tempfile

    scratch = tempfile.mkdtemp(prefix="rankfold-stream-")
    folder = f"{scratch}/events.parquet"
    spark.read.parquet(f"{small_dir}/events.parquet").repartitionByRange(4, "ts").write.parquet(folder)
    for i, name in enumerate(sorted(f for f in os.listdir(folder) if f.endswith(".parquet"))):
        os.utime(f"{folder}/{name}", (1_700_000_000 + i, 1_700_000_000 + i))  # files are read by age
    batch = L.request_rate(tables.request_log(spark, small_dir)).orderBy("window_start").collect()
    stream = SL.request_rate_stream(spark, scratch, max_files_per_trigger=1).orderBy("window_start").collect()
    assert batch == stream


def _split_events(spark, small_dir, n, mapped=None):
    """Events in time order over ``n`` files, which streams read by age."""
    import tempfile

    scratch = tempfile.mkdtemp(prefix="rankfold-stream-")
    events = spark.read.parquet(f"{small_dir}/events.parquet")
    events = mapped(events) if mapped else events
    events.repartitionByRange(n, "ts").write.parquet(f"{scratch}/all")
    names = sorted(f for f in os.listdir(f"{scratch}/all") if f.endswith(".parquet"))
    for i, name in enumerate(names):
        os.utime(f"{scratch}/all/{name}", (1_700_000_000 + i, 1_700_000_000 + i))
    os.makedirs(f"{scratch}/events.parquet")
    return scratch, names


def _arrive(scratch, names):
    import shutil

    for name in names:
        shutil.copy2(f"{scratch}/all/{name}", f"{scratch}/events.parquet/{name}")


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("kind", ["latency_histogram_quantiles", "error_rate", "cold_start_spike"])
def test_streams_equal_batch_file_by_file_and_after_a_restart(spark, small_dir, kind):
    scratch, names = _split_events(spark, small_dir, 4)
    stream = getattr(SL, f"{kind}_stream")
    batch = _rows(getattr(L, kind)(tables.request_log(spark, small_dir)))
    for step in (names[:2], names[2:], []):  # stopped and started again, at last without new files
        _arrive(scratch, step)
        got = stream(spark, scratch, max_files_per_trigger=1, folder=f"{scratch}/run")
        if step == names[:2]:
            part = getattr(L, kind)(tables.request_log(spark, scratch))
            assert kind != "latency_histogram_quantiles" or _rows(got) == _rows(part)
    assert _rows(got) == batch


def test_logs_are_routed_once_and_restart_without_duplicates(spark, small_dir):
    broken = lambda ev: ev.withColumn("props", F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("plain "), "props")).otherwise(F.col("props")))
    scratch, names = _split_events(spark, small_dir, 4, broken)
    for step in (names[:1], names[1:], []):
        _arrive(scratch, step)
        shipped, errors = SL.ship_logs_stream(spark, scratch, 1, f"{scratch}/run")
    batch = L.decode_props(tables.request_log(spark, scratch))
    assert errors.count() == batch.where("corrupt").count() > 0
    assert _rows(shipped.select("request_id", "k")) == _rows(batch.where("NOT corrupt").select("request_id", "k"))
    assert errors.where(~F.col("message").startswith("plain ") | (F.col("error") != L.DECODE_ERROR)).isEmpty()
    assert shipped.where("dt <> to_date(ts)").isEmpty() and "timestamp" not in shipped.columns
    # a replayed micro-batch overwrites its own folders
    again, _ = SL.ship_logs_stream(spark, scratch, 1, f"{scratch}/run")
    assert again.count() == shipped.count()


def _report_files(spark, reports):
    import tempfile

    folder = tempfile.mkdtemp(prefix="rankfold-reports-")
    os.makedirs(f"{folder}/in")
    for i, report in enumerate(reports):
        spark.createDataFrame(report, "ts timestamp_ntz, status boolean").coalesce(1).write.parquet(f"{folder}/w{i}")
    return folder


def test_status_alerts_stream_equals_batch_report_by_report(spark):
    import glob
    import shutil

    t = lambda m: dt.datetime(2024, 1, 1, m // 60, m % 60)
    flags = [(0, False), (5, True), (9, True), (20, False), (30, True), (35, False), (50, True), (61, True), (64, True)]
    folder = _report_files(spark, [[(t(m), d)] for m, d in flags])
    batch = L.status_alerts(spark.createDataFrame([(t(m), d) for m, d in flags], "ts timestamp_ntz, d boolean"), "ts", "d", "A", 600)
    for i in range(len(flags)):  # one report at a time, with a restart before each
        (part,) = glob.glob(f"{folder}/w{i}/part-*.parquet")
        shutil.copy(part, f"{folder}/in/{i:03d}.parquet")
        got = SL.status_alerts_stream(SL.report_stream(spark, f"{folder}/in", 1), "A", 600, f"{folder}/run")
    assert _rows(got) == _rows(batch) and got.count() == 2


def test_an_alert_fires_without_new_reports(spark):
    import glob
    import shutil
    import time

    now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
    folder = _report_files(spark, [[(now, True)]])
    shutil.copy(glob.glob(f"{folder}/w0/part-*.parquet")[0], f"{folder}/in/0.parquet")
    rows = SL.status_rows(SL.report_stream(spark, f"{folder}/in"), "A", 5, "ProcessingTime")
    seen = []
    query = rows.writeStream.option("checkpointLocation", f"{folder}/run").foreachBatch(lambda batch, _: seen.extend(batch.collect())).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60
        while not seen and time.time() < until:
            time.sleep(0.5)
    finally:
        query.stop()
    assert [r.alert for r in seen] == ["A"] and seen[0].last_true - seen[0].pending_since == dt.timedelta(seconds=5)
