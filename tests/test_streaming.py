from __future__ import annotations

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import event_frame
from logsieve.files import Folder
from logsieve.operators import metrics as mt
from logsieve.operators.baseline import BaselineDetector
from logsieve.operators.parse import parse_access_logs
from logsieve.options import JobOptions
from logsieve.plans.detect import detect
from logsieve.reports import event_stream, exported_plain
from logsieve.sinks.anomalies import append_anomalies, read_anomalies, recent_anomalies, recent_stored
from logsieve.sources.access_log import access_log_events
from logsieve.sources.lines import read_lines, stream_lines
from logsieve.streaming import rates
from logsieve.streaming.ingest import start_ingest
from logsieve.streaming.store import FANOUT, Closing, CountStore


def test_stream_equals_batch(spark, folder, tmp_path):
    inbox = str(tmp_path / "inbox")
    exported_plain(spark, folder).repartition(4).write.text(inbox)
    (tmp_path / "inbox" / "bad.txt").write_text("broken line\n\n")
    lines = read_lines(spark, inbox)
    events = parse_access_logs(lines, "plain")
    model = BaselineDetector.train(events)
    paths = [str(tmp_path / name) for name in ("anomalies", "batches", "checkpoint")]
    options = JobOptions(source_format="plain")

    def run() -> None:
        stream = stream_lines(spark, inbox, files_per_trigger=2)
        start_ingest(stream, model, 0.85, options, *paths).awaitTermination()

    run()
    batches = spark.read.parquet(paths[1])
    assert batches.count() == 3
    totals = batches.agg(F.sum("events"), F.sum("anomalies"), F.sum("skipped")).first()
    expected = detect(events, model, 0.85).filter("is_anomaly")
    assert tuple(totals) == (1000, expected.count(), 1)
    stored = spark.read.parquet(paths[0])
    columns = ["timestamp", "path", "anomaly_score"]
    batch_rows = expected.select(F.col("event_local"), "path", "anomaly_score").count()
    assert stored.select(columns).count() == batch_rows
    # Nothing new: a second run adds nothing.
    run()
    assert spark.read.parquet(paths[0]).count() == batch_rows


def test_bucket_counts_give_sliding_windows(spark, folder, tmp_path):
    status = mt.status_class(F.col("status")).alias("status_class")
    buckets = rates.bucket_counts(event_stream(spark, folder, files=4), "event_ts", status)
    store = rates.bucket_store(spark, str(tmp_path / "r"), "status_class", merge_every=2)
    rates.start_updates(buckets, store, str(tmp_path / "rc")).awaitTermination()
    window = F.window("event_ts", "300 seconds", "15 seconds")
    direct = access_log_events(spark, folder).groupBy(window, status).agg((F.count("*") / 300.0).alias("rate"))
    direct = direct.withColumn("window_start", F.unix_seconds(F.col("window.start").cast("timestamp")))
    derived = rates.stored_rates(store, "status_class")
    assert derived.join(direct, ["window_start", "status_class"]).filter("abs(cnt_rate - rate) < 1e-9").count() == direct.count() == derived.count()
    assert store.segments() and store.merged_upto() >= 2


def window_rows(batch: int) -> list[tuple[int, str, int]]:
    """Changed counts of a batch: its own minute, and the minute before counted on."""
    return [(60 * batch, "a", 1), (60 * batch, "b", batch), (60 * (batch - 1), "a", 100 + batch)]


def test_store_reads_the_same_few_folders_after_many_batches(spark, tmp_path):
    schema = "start long, label string, cnt long"
    store = CountStore(spark, str(tmp_path / "s"), ["start", "label"], Closing("start", 60, 120), merge_every=4)
    expected, files = {}, {}
    for batch in range(70):
        rows = window_rows(batch)
        expected.update({(start, label): cnt for start, label, cnt in rows})
        store.update(spark.createDataFrame(rows, schema), batch)
        if batch in (12, 69):
            found = store.counts()
            assert {(r["start"], r["label"]): r["cnt"] for r in found.collect()} == expected
            files[batch] = len(found.inputFiles())
            assert found.count() == len(expected)
    # 58 batches later, only the segments of the levels above have come on top.
    assert files[69] <= files[12] + FANOUT
    assert max(segment.level for segment in store.segments()) >= 1
    merged = store.merged_upto()
    # A repeated batch changes nothing, merged or not.
    for batch in (merged - 3, merged, 69):
        store.update(spark.createDataFrame(window_rows(batch), schema), batch)
    assert {(r["start"], r["label"]): r["cnt"] for r in store.counts().collect()} == expected
    assert len(Folder(spark, str(tmp_path / "s" / "updates")).names()) <= 8
    assert len(Folder(spark, str(tmp_path / "s" / "merged")).names()) <= 2


def test_store_survives_a_merge_that_died(spark, tmp_path):
    schema = "start long, label string, cnt long"
    store = CountStore(spark, str(tmp_path / "s"), ["start", "label"], Closing("start", 60, 0), merge_every=3)
    expected = {}
    for batch in range(8):
        rows = window_rows(batch)
        expected.update({(start, label): cnt for start, label, cnt in rows})
        if batch == 5:  # a sealed segment without its merged part
            spark.createDataFrame([(0, "a", -1)], schema).write.parquet(str(tmp_path / "s" / "sealed" / "0-3-5"))
            before = dict(expected)
            store.spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / "s" / "updates" / "5"))
            assert {(r["start"], r["label"]): r["cnt"] for r in store.counts().collect()} == before
        store.update(spark.createDataFrame(rows, schema), batch)
    assert {(r["start"], r["label"]): r["cnt"] for r in store.counts().collect()} == expected


def test_counters_without_windows(spark, tmp_path):
    store = CountStore(spark, str(tmp_path / "s"), ["label"], merge_every=2)
    with pytest.raises(FileNotFoundError):
        store.counts()
    empty = spark.createDataFrame([], "label string, cnt long")
    for batch in range(5):
        store.update(spark.createDataFrame([("x", batch), (None, 7)], "label string, cnt long") if batch != 3 else empty, batch)
    assert {(r["label"], r["cnt"]) for r in store.counts().collect()} == {("x", 4), (None, 7)}
    assert store.segments() == []


def test_recent_reads_by_utc_time(spark, tmp_path):
    """An event of a local day before may be the newer one."""
    path, at = str(tmp_path / "anomalies"), datetime(2026, 3, 9, 10, 30, tzinfo=UTC)
    rows = [
        {"path": "/a", "event_ts": at, "event_local": datetime(2026, 3, 10, 0, 30), "utc_offset": "+14:00"},
        {"path": "/b", "event_ts": at + timedelta(minutes=80), "event_local": datetime(2026, 3, 8, 23, 50), "utc_offset": "-12:00"},
    ]
    rows += [{"path": f"/old{i}", "event_ts": at - timedelta(hours=i + 1), "event_local": at.replace(tzinfo=None)} for i in range(40)]
    rows.append({"path": "/none", "event_ts": None})
    scored = event_frame(spark, *rows).withColumns({
        "is_anomaly": F.lit(True), "anomaly_score": F.lit(0.95), "model_version": F.lit("m"),
        "mitre_techniques": F.expr("array(named_struct('technique_id', 'T1', 'name', 'n', 'tactic', 't', 'confidence', 0.5D))"),
    })
    for run in ("one", "two", "two"):
        append_anomalies(scored, path, run_id=run)
    order = ["event_ts", "path", "run_id"]
    for retained in (1, 2, 3, 7, 500):
        found = recent_stored(spark, path, order, retained=retained, limit=100)
        plain = recent_anomalies(read_anomalies(spark, path), order, retained=retained, limit=100)
        assert [tuple(r) for r in found.select(order).collect()] == [tuple(r) for r in plain.select(order).collect()]
    assert recent_stored(spark, path, order, retained=1).first()["path"] == "/b"
    assert recent_stored(spark, path, order, retained=500, limit=500).count() == 2 * 43
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    append_anomalies(scored, path, run_id="dealt")  # a file for each share of the time
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(recent_stored(spark, path, order, retained=1).inputFiles()) < len(read_anomalies(spark, path).inputFiles())
    assert recent_stored(spark, path, order, retained=2).filter("path = '/b'").count() == 2
    append_anomalies(scored.filter("path = '/b'"), path, run_id="two")  # a smaller repeat replaces the whole run
    assert read_anomalies(spark, path).filter("run_id = 'two'").count() == 1
    with pytest.raises(ValueError):
        recent_stored(spark, path, ["path"])
