from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import event_frame
from logsieve.operators import lookup as lk
from logsieve.operators.baseline import BaselineDetector, unseen_templates
from logsieve.operators.iforest import ForestDetector, average_path, training_features, tree_samples
from logsieve.operators.parse import parse_access_logs
from logsieve.operators.ranking import grid_index, quantile, running_totals
from logsieve.operators.rules import classify_techniques
from logsieve.options import JobOptions
from logsieve.plans.detect import detect, ingest_files, ingest_posted, resolve_threshold
from logsieve.plans.registry import ModelRegistry, detector_class
from logsieve.plans.train import bootstrap_model, calibration, train_model
from logsieve.sinks.anomalies import append_anomalies, read_anomalies, recent_anomalies, recent_stored
from logsieve.sources.access_log import access_log_events
from logsieve.sources.lines import labelled_lines, posted_lines


def traffic(spark):
    rows = [{"method": "GET", "path": f"/item/{at}", "status": 200} for at in range(6)]
    rows += [{"method": "POST", "path": "/login", "status": 200}] * 3
    rows += [{"method": None, "path": None, "message": "job 7 done", "status": None}]
    return event_frame(spark, *rows)


def scores(df):
    return [row["anomaly_score"] for row in df.orderBy("n").collect()]


def test_baseline_scores(spark):
    model = BaselineDetector.train(traffic(spark))
    counts = {row["template"]: row["cnt"] for row in model.counts.collect()}
    assert counts == {"GET|2|/item/<NUM>": 6, "POST|2|/login": 3, "UNKNOWN|0|job <NUM> done": 1}
    seen = event_frame(spark, {"method": "get", "path": "/item/9", "status": 204}, {"path": "/new", "method": "GET"})
    assert scores(model.score(seen)) == [0.0, 1.0]
    empty = BaselineDetector.train(traffic(spark).limit(0))
    assert scores(empty.score(seen)) == [1.0, 1.0]
    assert unseen_templates(seen, model.counts).count() == 1


def test_every_lookup_way_gives_the_same(spark, monkeypatch):
    events = traffic(spark)
    expected = scores(BaselineDetector.train(events).score(events))
    for size in (10, lk.BROADCAST_BYTES + 1):
        trained = BaselineDetector.train(events)
        trained.model_bytes = size
        assert scores(trained.score(events)) == expected
        again = trained.score_counts(events, "level").agg(F.sum("n")).first()[0]
        assert again == 10
    plan = trained.score(events)._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan and "SortMergeJoin" in plan


def test_uniform_training_flags_everything(spark):
    events = event_frame(spark, *[{"method": "GET", "path": "/", "status": 200}] * 5)
    model = BaselineDetector.train(events)
    row = calibration(model.training_score_counts(), 0.95).first()
    assert row["threshold"] == 0.0
    assert model.predict(events, row["threshold"]).filter("is_anomaly").count() == 5


def test_running_totals_and_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.gamma(1.0, 0.3, 4000), 3)
    frame = spark.createDataFrame([(float(v),) for v in values], "v double")
    ordered = running_totals(frame.groupBy("v").agg(F.count("*").alias("n")), "v", ["n"]).cache()
    for row in ordered.orderBy("v").collect()[::97]:
        assert row["n_before"] == int((values < row["v"]).sum()) and row["n_total"] == 4000
    for q in (0.0, 0.5, 0.9, 0.95, 0.999, 1.0):
        got = ordered.agg(quantile("v", "n", q).alias("q")).first()["q"]
        assert got == pytest.approx(np.quantile(values, q), abs=1e-12)


def test_grid_index_matches_comparison(spark):
    values = [k * 0.01 for k in range(101)] + [0.285, 0.57, 0.58, 0.999, -0.1]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    got = [row[0] for row in frame.select(grid_index(F.col("v"), 0.01, 100)).collect()]
    assert got == [max([k for k in range(101) if v >= k * 0.01], default=-1) for v in values]


@pytest.fixture(scope="module")
def forest(spark, folder):
    events = access_log_events(spark, folder)
    return events, ForestDetector.train(events, id_column="event_id", trees=40)


def test_forest_trees(forest):
    _, model = forest
    nodes = model.nodes.toPandas()
    roots = nodes[nodes.node == 0]
    assert len(roots) == 40 and (roots["size"] == 256).all()
    leaves = nodes[nodes.feature < 0]
    assert (leaves.groupby("tree")["size"].sum() == 256).all()
    assert nodes.node.max() <= 2**9 - 2


def test_forest_scores(spark, forest, tmp_path):
    events, model = forest
    first = model.score(events).select("event_id", "anomaly_score").orderBy("event_id").toPandas()
    assert first.anomaly_score.between(0, 1).all()
    assert first.anomaly_score.max() == 1.0 and first.anomaly_score.min() == 0.0
    same = ForestDetector.train(events, id_column="event_id", trees=40)
    again = same.score(events).select("event_id", "anomaly_score").orderBy("event_id").toPandas()
    assert np.allclose(first.anomaly_score, again.anomaly_score, atol=1e-12)
    model.save(str(tmp_path / "forest"))
    loaded = ForestDetector.load(spark, str(tmp_path / "forest"))
    reread = loaded.score(events).select("event_id", "anomaly_score").orderBy("event_id").toPandas()
    assert np.allclose(first.anomaly_score, reread.anomaly_score, atol=1e-9)


def test_forest_matches_a_walk_through_the_nodes(forest):
    events, model = forest
    from logsieve import fixed_values as fv
    from logsieve.operators.features import extract_features

    nodes = {(r["tree"], r["node"]): r for r in model.nodes.collect()}
    rows = extract_features(events.filter("event_id < 20"), "event_id").orderBy("event_id").collect()
    raw = model.raw_score(events.filter("event_id < 20")).orderBy("event_id").collect()
    for row, scored in zip(rows, raw):
        lengths = []
        for tree in range(40):
            at = nodes[tree, 0]
            while at["feature"] >= 0:
                right = row[fv.FEATURE_NAMES[at["feature"]]] > at["threshold"]
                at = nodes[tree, 2 * at["node"] + 1 + int(right)]
            lengths.append(at["path_length"])
        assert scored["raw_score"] == pytest.approx(2 ** (-np.mean(lengths) / average_path(256)))


def test_forest_outliers_and_degenerate(spark):
    normal = [{"method": "GET", "path": "/a", "status": 200, "bytes_sent": 100 + at % 7} for at in range(120)]
    odd = [{"method": "POST", "path": "/x/y/z/" + "q" * 90, "status": 500, "bytes_sent": 10**8}]
    model = ForestDetector.train(event_frame(spark, *normal, *odd), id_column="n", trees=50)
    got = scores(model.score(event_frame(spark, *normal, *odd)))
    assert got[-1] > max(got[:-1])
    same = event_frame(spark, *[{"path": "/a", "status": 200}] * 30)
    flat = ForestDetector.train(same, trees=10)
    assert scores(flat.score(same)) == [0.0] * 30
    with pytest.raises(ValueError):
        ForestDetector.fit(training_features(same.limit(0)))


def test_registry_and_pipeline(spark, folder, tmp_path):
    registry = ModelRegistry(spark, str(tmp_path / "models"))
    with pytest.raises(FileNotFoundError):
        registry.load_latest()
    with pytest.raises(ValueError):
        detector_class("other")
    events = access_log_events(spark, folder)
    saved = train_model(events, "baseline", registry)
    assert saved["train_metrics"]["training_samples"] == 1000 and len(saved["feature_names"]) == 26
    detector, metadata = registry.load_latest()
    assert metadata["version"] == saved["version"] and detector.model_bytes > 0
    threshold = resolve_threshold(metadata, JobOptions())
    assert threshold == saved["train_metrics"]["threshold"]
    assert resolve_threshold(metadata, JobOptions(min_threshold=2.0)) == 2.0
    results = detect(events, detector, threshold)
    flagged = {r["event_id"] for r in results.filter("is_anomaly").collect()}
    assert 0 < len(flagged) < 200
    assert results.filter("NOT is_anomaly AND size(mitre_techniques) > 0").count() == 0
    append_anomalies(results, str(tmp_path / "anomalies"), "event_id")
    stored = read_anomalies(spark, str(tmp_path / "anomalies"))
    assert {r["event_id"] for r in stored.collect()} == flagged
    newest = recent_anomalies(stored, ["event_ts", "event_id"], limit=5, min_score=0.5, retained=20).collect()
    expected = sorted(flagged, reverse=True)[:20]
    assert [r["event_id"] for r in newest] == [i for i in expected if i in {r["event_id"] for r in newest}][:5]
    with pytest.raises(ValueError):
        recent_anomalies(stored, ["event_ts"], limit=501)


def test_file_ingest_and_bootstrap(spark, tmp_path):
    good = '{"timestamp":"2026-03-10T10:00:00Z","method":"GET","path":"/ok","status":200}'
    bad = '{"timestamp":"2026-03-10T10:00:00Z","method":"GET","path":"/../../etc/passwd","status":403,"user_agent":"sqlmap"}'
    (tmp_path / "boot.jsonl").write_text("\n".join([good] * 30) + "\n\nnot json\n")
    (tmp_path / "a.jsonl").write_text(good + "\n" + bad + "\n")
    (tmp_path / "b.jsonl").write_text(good + "\nbroken\n")
    registry = ModelRegistry(spark, str(tmp_path / "models"))
    options = JobOptions(
        model_type="baseline",
        bootstrap_path=str(tmp_path / "boot.jsonl"),
        input_paths=[str(tmp_path / n) for n in ("a.jsonl", "b.jsonl", "missing.jsonl")] + [str(tmp_path)],
        min_threshold=0.5,
    )
    assert bootstrap_model(JobOptions(bootstrap_path=str(tmp_path / "none")), registry) is None
    assert bootstrap_model(options, registry)["train_metrics"]["training_samples"] == 30
    summary = ingest_files(spark, options, registry, str(tmp_path / "anomalies"))
    got = {(r["file"] or "total").rsplit("/", 1)[-1]: tuple(r)[1:] for r in summary.collect()}
    assert got == {"a.jsonl": (2, 1, 0), "b.jsonl": (1, 0, 1), "total": (3, 1, 1)}
    row = read_anomalies(spark, str(tmp_path / "anomalies")).first()
    assert row["timestamp"] == "2026-03-10T10:00:00+00:00"
    assert {t["technique_id"] for t in row["mitre_techniques"]} >= {"T1190", "T1592", "T1110"}


def test_runs_replace_themselves_and_recent_reads_newest_dates(spark, folder, tmp_path):
    events = access_log_events(spark, folder)
    results = BaselineDetector.train(events).predict(events, 0.9)
    results = classify_techniques(results, F.col("is_anomaly"))
    path = str(tmp_path / "anomalies")
    for run in ("a", "a", "b"):
        append_anomalies(results, path, "event_id", run_id=run)
    stored = read_anomalies(spark, path)
    flagged = results.filter("is_anomaly").count()
    assert stored.groupBy("run_id").count().collect() and stored.count() == 2 * flagged
    order = ["event_ts", "event_id", "run_id"]
    newest = [tuple(r) for r in recent_stored(spark, path, order, retained=30, limit=10).select(order).collect()]
    assert newest == [tuple(r) for r in recent_anomalies(stored, order, limit=10, retained=30).select(order).collect()]


def test_posted_lines_are_stored_and_summed_up(spark, tmp_path):
    lines = ['{"timestamp":"2026-01-05T07:00:0%dZ","method":"GET","path":"/shelf","status":200}' % i for i in range(5)]
    odd = '{"timestamp":"2026-01-05T07:01:00Z","method":"GET","path":"/never/../seen","status":404}'
    registry = ModelRegistry(spark, str(tmp_path / "models"))
    train_model(parse_access_logs(posted_lines(spark, lines), "jsonl"), "baseline", registry)
    detector, metadata = registry.load_latest()
    options = JobOptions(model_type="baseline", min_threshold=0.5)
    for _ in range(2):
        row = ingest_posted(posted_lines(spark, [*lines, odd]), detector, metadata, options, str(tmp_path / "out"), "r1").first()
    assert (row["received"], row["anomalies"], row["model_version"]) == (6, 1, metadata["version"])
    assert read_anomalies(spark, str(tmp_path / "out")).count() == 1


def test_forest_samples_do_not_depend_on_partitions(spark, folder):
    events = access_log_events(spark, folder)
    events = events.unionByName(events.limit(40))
    drawn = [
        {tuple(r) for r in tree_samples(training_features(events.repartition(n)), 1040, 5, 64, 3).select("tree", "draw").collect()} for n in (2, 5)
    ]
    assert drawn[0] == drawn[1] and len(drawn[0]) == 5 * 64


def test_large_model_without_columns_to_spread_by(spark, folder, monkeypatch):
    events = access_log_events(spark, folder)
    model = BaselineDetector.train(events)
    small = {tuple(r) for r in model.score_counts(events).collect()}
    monkeypatch.setattr(lk, "BROADCAST_BYTES", -1)
    assert {tuple(r) for r in model.score_counts(events).collect()} == small
    assert model.score(events).count() == events.count()


def test_last_of_repeated_labels_counts(spark):
    frame = spark.createDataFrame([('{"_label":"one","_label":"two"}',), ('{"a":1}',)], "value string")
    assert [r["label"] for r in labelled_lines(frame).collect()] == ["two", "clean"]
