"""Batches of file lines, observed training, labelled files, duration quantiles and the options behind them."""

from __future__ import annotations

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logsieve.operators import labelled as lab
from logsieve.operators import metrics as mt
from logsieve.operators.iforest import tree_samples, training_features, with_row_ids
from logsieve.options import JobOptions
from logsieve.plans.detect import recent_ingested
from logsieve.plans.registry import ModelRegistry
from logsieve.plans.train import train_lines
from logsieve.plans.validate import labelled_events
from logsieve.sinks.anomalies import append_anomalies
from logsieve.sinks.export import write_labelled_set
from logsieve.sources.access_log import access_log_events
from logsieve.sources.lines import file_line_batches, read_lines
from helpers import event_frame


def test_lines_are_numbered_over_the_splits_of_a_file(spark, tmp_path):
    lines = {f"f{at}.txt": [f"{at}-{n}" + "x" * (n % 40) for n in range(700 * at)] for at in range(1, 4)}
    lines["blank.txt"] = ["", "  ", "\t"]
    for name, rows in lines.items():
        (tmp_path / name).write_text("\n\n".join(rows) + "\n")
    settings = {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "1"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        assert read_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 10
        found = file_line_batches(spark, str(tmp_path), 100).collect()
    finally:
        for name in settings:
            spark.conf.unset(name)
    got = {}
    for row in found:
        assert row["batch_id"] == row["line_no"] // 100
        got[row["file"].rsplit("/", 1)[-1], row["line_no"]] = row["value"]
    assert got == {(name, n): value for name, rows in lines.items() for n, value in enumerate(r for r in rows if r.strip())}
    with pytest.raises(ValueError):
        file_line_batches(spark, str(tmp_path), 0)


@pytest.mark.parametrize("model_type", ["baseline", "isolation_forest"])
def test_training_counts_the_lines_it_skips(spark, tmp_path, model_type):
    good = [json.dumps({"timestamp": f"2026-04-01T08:00:{n:02d}Z", "method": "GET", "path": f"/p{n % 4}", "status": 200}) for n in range(40)]
    registry = ModelRegistry(spark, str(tmp_path / "models"))
    lines = spark.createDataFrame([(line,) for line in [*good, "no json", "", "[1]", '{"status": "x"}']], "value string").repartition(3)
    training = {"trees": 3} if model_type == "isolation_forest" else {}
    row = train_lines(lines, JobOptions(model_type=model_type), registry, **training)
    assert (row["train_metrics"]["training_samples"], row["train_metrics"]["skipped_lines"]) == (40, 3)
    _, newest = registry.load_latest()
    assert newest["train_metrics"]["skipped_lines"] == 3


def test_labelled_set_is_written_whole_and_replaced(spark, folder, tmp_path):
    events = access_log_events(spark, folder).drop("label").filter("event_id < 300")
    templates = lab.sample_templates(events, "event_id")
    attacks = lab.inject_attacks(events, "event_id", templates)
    mix = lab.labelled_mix(events, attacks, "event_id")
    path = str(tmp_path / "set")
    for _ in range(2):
        write_labelled_set(events, attacks, mix, path, "event_id")
    assert {name: read_lines(spark, f"{path}/{name}").count() for name in ("clean", "attacks", "mixed")} == {"clean": 300, "attacks": 300, "mixed": 600}
    rows = [json.loads(r["value"]) for r in read_lines(spark, f"{path}/mixed").select("value").collect()]
    assert sum("_label" in row and row["_label"] is not None for row in rows) == 300
    read, skipped = labelled_events(read_lines(spark, f"{path}/mixed").select("value"))
    assert skipped.count() == 0
    expected = {(r["label"], r["path"]): r["n"] for r in mix.groupBy("label", "path").agg(F.count("*").alias("n")).collect()}
    assert {(r["label"], r["path"]): r["n"] for r in read.groupBy("label", "path").agg(F.count("*").alias("n")).collect()} == expected
    assert not any("_label" in json.loads(r["value"]) for r in read_lines(spark, f"{path}/clean").collect())


def test_labelled_set_takes_little_room(spark, folder, tmp_path):
    """The files of a set took several times the room of the tables it is made of."""
    events = access_log_events(spark, folder).drop("label").filter("event_id < 300")
    attacks = lab.inject_attacks(events, "event_id", lab.sample_templates(events, "event_id"))
    write_labelled_set(events, attacks, lab.labelled_mix(events, attacks, "event_id"), str(tmp_path / "set"), "event_id")
    for name, n in (("clean", 300), ("attacks", 300), ("mixed", 600)):
        lines = read_lines(spark, str(tmp_path / "set" / name)).agg(F.count("*").alias("n"), F.sum(F.length("value") + 1).alias("size")).first()
        files = list((tmp_path / "set" / name).glob("part-*"))
        assert lines["n"] == n and 3 * sum(file.stat().st_size for file in files) < lines["size"]


def test_duration_quantiles(spark):
    at = datetime(2026, 5, 1, tzinfo=UTC)
    rows = [(n, at + timedelta(seconds=60 * n), [0.02, 0.3, 0.3, 20.0][n % 4]) for n in range(8)]
    batches = spark.createDataFrame(rows, "batch_id long, ingest_ts timestamp, duration_seconds double")
    found = {(r["window_start"], r["quantile"]): r["value"] for r in mt.duration_quantiles(batches).collect()}
    start = int(at.timestamp())
    # One batch in the first window: half of the second bucket.
    assert found[start - 285, 0.5] == pytest.approx(0.01 + 0.04 * 0.5)
    # 0.02, 0.3, 0.3, 20 and 0.02: the median lies in the bucket up to 0.5, the last quantile beyond all bounds.
    assert found[start, 0.5] == pytest.approx(0.25 + 0.25 * (2.5 - 2) / 2)
    assert found[start, 0.99] == 10.0
    assert mt.duration_quantiles(batches.limit(0)).collect() == []


def test_retained_anomalies_come_from_the_options(spark, tmp_path):
    at = datetime(2026, 5, 1, tzinfo=UTC)
    scored = event_frame(spark, *[{"path": f"/{n}", "event_ts": at + timedelta(seconds=n)} for n in range(20)]).withColumns({
        "is_anomaly": F.lit(True), "anomaly_score": F.when(F.col("n") >= 18, 0.5).otherwise(0.95), "model_version": F.lit("m"),
        "mitre_techniques": F.expr("cast(array() AS array<struct<technique_id:string,name:string,tactic:string,confidence:double>>)"),
    })
    append_anomalies(scored, str(tmp_path / "a"))
    options = JobOptions(max_stored_anomalies=5)
    newest = recent_ingested(spark, options, str(tmp_path / "a"), ["event_ts"], min_score=0.9)
    assert [r["path"] for r in newest.collect()] == ["/17", "/16", "/15"]


def test_equal_rows_get_one_id_each(spark, folder):
    events = access_log_events(spark, folder).drop("event_id", "label")
    hot = events.limit(1).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(2048)))).drop("copy")
    both = events.limit(200).unionByName(hot)  # most rows are one
    found = []
    for parts in (2, 7):
        features = training_features(both.repartition(parts))
        ids = with_row_ids(features)
        found.append({r["_row"] for r in ids.select("_row").collect()})
        assert ids.count() == len(found[-1]) == 200 + 2048
        assert len({r["_file"] for r in features.select("_file").distinct().collect()}) > 1
    assert found[0] == found[1]
    assert tree_samples(training_features(both), 2248, 4, 64, 3).count() == 4 * 64
