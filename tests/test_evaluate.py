from __future__ import annotations

import json
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from logsieve.operators import evaluate as ev
from logsieve.operators import labelled as lab
from logsieve.operators import metrics as mt
from logsieve.operators.baseline import BaselineDetector
from logsieve.plans.validate import evaluate, labelled_events
from logsieve.sources.access_log import access_log_events
from logsieve.sources.lines import posted_lines


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(600):
        attack = rng.random() < 0.2
        score = round(float(np.clip(rng.normal(0.7 if attack else 0.4, 0.2), 0, 1)), 2)
        rows.append((score, "attack:" + "ab"[int(rng.integers(2))] if attack else "clean"))
    frame = spark.createDataFrame(rows, "anomaly_score double, label string")
    counts = frame.groupBy("anomaly_score", "label").agg(F.count("*").alias("n"))
    return rows, counts, ev.ordered_classes(ev.class_counts(counts)).cache()


def test_auc_matches_all_pairs(scored):
    rows, _, ordered = scored
    pos = [s for s, label in rows if label != "clean"]
    neg = [s for s, label in rows if label == "clean"]
    wins = sum((p > n) + 0.5 * (p == n) for p, n in product(pos, neg))
    assert ev.roc_auc(ordered).first()["auc"] == pytest.approx(wins / len(pos) / len(neg))


def test_distribution_matches_numpy(scored):
    rows, _, ordered = scored
    for row in ev.score_distribution(ordered).collect():
        own = np.array([s for s, label in rows if (label == "clean") == (row["class"] == "clean")])
        assert row["n"] == len(own)
        assert row["mean"] == pytest.approx(own.mean()) and row["std"] == pytest.approx(own.std())
        assert row["p95"] == pytest.approx(np.quantile(own, 0.95)) and row["max"] == own.max()


def test_sweep_and_best(scored):
    rows, counts, ordered = scored
    s = np.array([score for score, _ in rows])
    y = np.array([label != "clean" for _, label in rows])
    sweep = ev.threshold_sweep(ev.class_counts(counts)).orderBy("threshold").collect()
    assert len(sweep) == 101
    best, best_at = 0.0, None
    for row, threshold in zip(sweep, np.arange(0.0, 1.001, 0.01)):
        assert (row["tp"], row["fp"]) == (int((y & (s >= threshold)).sum()), int((~y & (s >= threshold)).sum()))
        if row["f1"] > best:
            best, best_at = row["f1"], row["threshold"]
    top = ev.best_f1(ev.threshold_sweep(ev.class_counts(counts)), 0.5).first()
    assert (top["threshold"], top["f1"]) == (best_at, best)
    none = ev.class_counts(counts.filter("label = 'clean'"))
    assert ev.best_f1(ev.threshold_sweep(none), 0.5).first()["threshold"] == 0.5
    cut = ev.youden_point(ev.roc_curve(ordered)).first()
    j = [((y & (s >= t)).sum() / y.sum() - (~y & (s >= t)).sum() / (~y).sum(), t) for t in np.unique(s)]
    assert cut["threshold"] == max(j)[1]


def test_histogram_quantiles(spark):
    buckets = spark.createDataFrame(
        [(0.1, 0), (0.5, 4), (1.0, 10), (float("inf"), 20)], "le double, cumulative bigint")
    got = {r["quantile"]: r["value"] for r in mt.histogram_quantiles(buckets, [0.1, 0.35, 0.9]).collect()}
    assert got[0.1] == pytest.approx(0.3) and got[0.35] == pytest.approx(0.75) and got[0.9] == 1.0
    empty = mt.histogram_quantiles(buckets.withColumn("cumulative", F.lit(0))).collect()
    assert {r["value"] for r in empty} == {None}


def test_severity(spark):
    frame = spark.createDataFrame([(0.0,), (0.05,), (0.2,)], "v double")
    assert [r[0] for r in frame.select(mt.severity("anomaly_rate", F.col("v"))).collect()] == ["green", "orange", "red"]


def test_full_report_and_labels(spark, folder):
    events = access_log_events(spark, folder)
    tables = evaluate(events, BaselineDetector.train(events), 0.85)
    assert tables["totals"].first()["n_total"] == 1000
    assert {name: table.count() > 0 for name, table in tables.items()} == dict.fromkeys(tables, True)
    lines = [
        json.dumps({"_label": "attack:xss", "timestamp": "2026-03-10T00:00:00Z", "path": "/<script"}),
        json.dumps({"_label": "attack:xss"}),
        json.dumps({"timestamp": "2026-03-10T00:00:00Z"}),
    ]
    parsed, skipped = labelled_events(posted_lines(spark, lines))
    assert sorted(r["label"] for r in parsed.collect()) == ["attack:xss", "clean"]
    assert [tuple(r) for r in skipped.collect()] == [("attack:xss", 1)]


def test_injected_attacks(spark, folder):
    events = access_log_events(spark, folder).drop("label", "attributes")
    templates = lab.sample_templates(events, "event_id", n=20, head=50)
    assert sorted(r["template_no"] for r in templates.collect()) == list(range(20))
    assert templates.agg(F.max("event_id")).first()[0] < 50
    attacks = lab.inject_attacks(events, "event_id", templates)
    again = lab.inject_attacks(events.repartition(5), "event_id", templates)
    key = ["event_id", "label", "path", "status", "user_agent"]
    first = sorted(map(str, attacks.select(key).collect()))
    assert first == sorted(map(str, again.select(key).collect())) and len(first) == 1000
    assert attacks.select("label").distinct().count() == 9
    assert {r[0] for r in attacks.filter("label = 'attack:bruteforce_401'").select("status").distinct().collect()} == {401}
    mix = lab.labelled_mix(events, attacks, "event_id", clean_limit=100)
    assert mix.filter("label = 'clean'").count() == 100 and mix.count() == 1100
