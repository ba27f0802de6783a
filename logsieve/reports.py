"""Ready-made reports over the provided tables, one per operator or job.

Each takes a session and the folder of the tables and returns flat columns.
Doubles are rounded so that engines can be compared.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed_values as fv
from .functions import text
from .operators import evaluate as ev
from .operators import labelled as lab
from .operators import metrics as mt
from .operators.baseline import BaselineDetector, template_counts, unseen_templates
from .operators.features import extract_features, feature_moments, scale_features
from .operators.iforest import ForestDetector, training_features
from .operators.parse import (
    parse_access_logs,
    request_parts,
    source_name,
    split_rejects,
)
from .operators.ranking import running_totals
from .operators.rules import classify_techniques, technique_hits, with_catalog
from .options import JobOptions
from .plans.detect import detect, file_summary, ingest_files, ingest_posted, recent_ingested, resolve_threshold
from .plans.registry import ModelRegistry
from .plans.train import calibration, fit_forest, train_lines, train_model
from .plans.validate import labelled_events, long_report
from .scratch import new_path, written
from .sinks.anomalies import anomaly_rows, read_anomalies, recent_anomalies
from .sinks.export import json_lines, plain_lines, write_labelled_set, write_lines
from .sources.access_log import access_log_events, access_log_view, as_events
from .sources.lines import count_lines, file_line_batches, line_batches, read_lines, stream_lines, strict_events
from .streaming import rates
from .streaming.ingest import start_ingest
from .streaming.store import CountStore

THRESHOLD = fv.BASELINE_THRESHOLD
REPORTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


# Generated methods beyond this size are never compiled by the JVM; split ones are.
METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000")


def report(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(build)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set(*METHOD_LIMIT)
        return build(spark, folder)

    REPORTS[build.__name__] = run
    return run


def rounded(column: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def round_all(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double column rounded."""
    doubles = [name for name, kind in df.dtypes if kind == "double"]
    return df.withColumns({name: F.round(name, digits) for name in doubles})


def small_pick(key: Column, salt: int, n: Column | int) -> Column:
    """Repeatable choice by plain arithmetic, the same in every engine."""
    mixed = ((key % 1000003) * (7919 + 97 * salt) + 40503 * salt) % 1000003
    return (mixed % n).cast("int")


def results(spark: SparkSession, folder: str) -> DataFrame:
    """The access log scored by the baseline trained on it, anomalies classified."""
    events = access_log_events(spark, folder)
    return detect(events, BaselineDetector.train(events), THRESHOLD)


def predicted(spark: SparkSession, folder: str) -> DataFrame:
    events = access_log_events(spark, folder)
    return BaselineDetector.train(events).predict(events, THRESHOLD)


def cube(spark: SparkSession, folder: str, *by: Column | str) -> DataFrame:
    return mt.metric_cube(results(spark, folder), *by)


def label_scores(spark: SparkSession, folder: str) -> DataFrame:
    events = access_log_events(spark, folder)
    return BaselineDetector.train(events).score_counts(events, "label")


def exported_plain(spark: SparkSession, folder: str, *kept: str) -> DataFrame:
    return plain_lines(access_log_events(spark, folder), *kept)


def broken_plain(spark: SparkSession, folder: str) -> DataFrame:
    """Plain lines with every 97th cut to ten characters; the host stands for the file."""
    lines = exported_plain(spark, folder, "event_id", F.col("host").alias("file"))
    cut = F.when(F.col("event_id") % 97 == 0, F.substring("value", 1, 10)).otherwise(F.col("value"))
    return lines.withColumn("value", cut)


def mixed_json(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines: even ids with plain key names, odd ids with camel-case ones."""
    events = access_log_events(spark, folder)
    camel = F.to_json(
        F.struct(
            F.concat(F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("time"),
            F.col("remote_addr").alias("remoteAddress"),
            "host",
            "method",
            F.col("path").alias("url"),
            "protocol",
            F.col("status").alias("statusCode"),
            F.col("user_agent").alias("userAgent"),
            F.lit("-").alias("referer"),
            F.col("bytes_sent").cast("string").alias("body_bytes_sent"),
            F.col("request_time").alias("responseTime"),
        )
    )
    snake = json_lines(events, "event_id", *events.columns[1:])
    odd = F.col("event_id") % 2 == 1
    return snake.select("event_id", F.when(odd, camel).otherwise(F.col("value")).alias("value"))


EVENT_TEXT = ["remote_addr", "remote_user", "method", "path", "protocol", "referrer", "user_agent",
              "message", "level", "service"]


def event_report(events: DataFrame) -> DataFrame:
    """Comparable columns of parsed events."""
    return events.select(
        "event_id",
        F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss").alias("at"),
        F.hour("event_local").alias("local_hour"),
        "utc_offset",
        "host",
        *EVENT_TEXT,
        "status",
        "bytes_sent",
        rounded("request_time").alias("request_time"),
    )


# --- Flagship ----------------------------------------------------------------


@report
def technique_counts_top20(spark: SparkSession, folder: str) -> DataFrame:
    return mt.top_techniques(cube(spark, folder))


@report
def lines_to_top_techniques(spark: SparkSession, folder: str) -> DataFrame:
    """Plain lines to parsed events, template model, scores, rules and the top techniques."""
    events = parse_access_logs(exported_plain(spark, folder), "plain")
    scored = detect(events, BaselineDetector.train(events), THRESHOLD)
    return mt.top_techniques(mt.metric_cube(scored))


# --- Parsing -----------------------------------------------------------------


@report
def parse_plain(spark: SparkSession, folder: str) -> DataFrame:
    return event_report(parse_access_logs(exported_plain(spark, folder, "event_id"), "plain"))


@report
def parse_plain_strict(spark: SparkSession, folder: str) -> DataFrame:
    lines = exported_plain(spark, folder, "event_id")
    events = parse_access_logs(lines, "plain", mode="failfast")
    return events.groupBy("level", "method").agg(F.count("*").alias("cnt"))


@report
def parse_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    return event_report(parse_access_logs(mixed_json(spark, folder), "jsonl"))


@report
def parse_jsonl_mapped(spark: SparkSession, folder: str) -> DataFrame:
    """Custom field mapping over JSON lines with other key names."""
    events = access_log_events(spark, folder)
    value = F.to_json(
        F.struct(
            F.concat(F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+03:00")).alias("ts"),
            F.col("remote_addr").alias("clientIp"),
            F.concat_ws(" ", "method", "path", "protocol").alias("request"),
            F.concat(F.col("status"), F.lit(".7")).alias("code"),
            F.col("bytes_sent").alias("size"),
        )
    )
    mapping = {
        "timestamp": ["ts"],
        "remote_addr": "clientIp",
        "status": ["status_code", "code"],
        "bytes_sent": ["size"],
    }
    lines = events.select("event_id", value.alias("value"))
    return event_report(parse_access_logs(lines, "jsonl", mapping=mapping))


@report
def parse_rejects_by_file(spark: SparkSession, folder: str) -> DataFrame:
    parsed = parse_access_logs(broken_plain(spark, folder), "plain", mode="keep")
    events, _ = split_rejects(parsed)
    scored = BaselineDetector.train(events).predict(parsed, THRESHOLD)
    return file_summary(scored).withColumn("file", F.coalesce("file", F.lit("total")))


@report
def reject_reasons(spark: SparkSession, folder: str) -> DataFrame:
    parsed = parse_access_logs(broken_plain(spark, folder), "plain", mode="keep")
    _, rejects = split_rejects(parsed)
    return rejects.select("event_id", "file", "value", "reject_reason")


@report
def line_counts(spark: SparkSession, folder: str) -> DataFrame:
    lines = broken_plain(spark, folder)
    return lines.groupBy("file").agg(F.count("*").alias("lines"))


def line_files(spark: SparkSession, lines: DataFrame) -> str:
    """A folder of text files with the given lines."""
    path = new_path(spark, "lines")
    write_lines(lines, path)
    return path


@report
def strict_file_scan(spark: SparkSession, folder: str) -> DataFrame:
    events = strict_events(spark, line_files(spark, exported_plain(spark, folder)), "plain")
    return events.groupBy("method", "status").agg(F.count("*").alias("cnt"))


@report
def file_line_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = line_files(spark, broken_plain(spark, folder))
    return spark.range(1).select(F.lit(count_lines(spark, path)).cast("long").alias("lines"))


@report
def multi_file_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """A tolerant ingest of real files with a registered model; a missing path and a folder are passed over."""
    registry = ModelRegistry(spark, new_path(spark, "registry"))
    path = line_files(spark, broken_plain(spark, folder))
    events, _ = split_rejects(parse_access_logs(read_lines(spark, path), "plain", mode="keep"))
    train_model(events, "baseline", registry)
    files = [row[0] for row in read_lines(spark, path).select("file").distinct().collect()]  # one name per file
    options = JobOptions(model_type="baseline", source_format="plain", input_paths=[*files, f"{path}/none", path])
    anomalies = new_path(spark, "anomalies")
    for _ in range(2):  # the same run twice stores its rows once
        summary = ingest_files(spark, options, registry, anomalies, run_id="one")
    stored = read_anomalies(spark, anomalies).agg(F.count("*").alias("stored"))
    return summary.filter("file is null").drop("file").join(F.broadcast(stored))


@report
def posted_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Posted lines scored by the registered model and stored; a repeated post of the same run changes nothing."""
    registry = ModelRegistry(spark, new_path(spark, "registry"))
    lines = exported_plain(spark, folder)
    train_model(parse_access_logs(lines, "plain"), "baseline", registry)
    detector, metadata = registry.load_latest()
    anomalies = new_path(spark, "anomalies")
    for _ in range(2):
        summary = ingest_posted(lines, detector, metadata, JobOptions(source_format="plain"), anomalies, run_id="one")
    stored = read_anomalies(spark, anomalies).agg(F.count("*").alias("stored"))
    named = F.col("model_version") == metadata["version"]
    return summary.withColumn("registered_version", named).drop("model_version").join(F.broadcast(stored))


@report
def line_batch_sizes(spark: SparkSession, folder: str) -> DataFrame:
    lines = exported_plain(spark, folder, "event_id")
    batches = line_batches(lines, "event_id", fv.INGEST_BATCH_SIZE)
    return batches.groupBy("batch_id").agg(F.count("*").alias("lines"))


@report
def file_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of lines numbered from real files, one file per host: their sizes, first and last lines."""
    path = new_path(spark, "host-files")
    lines = exported_plain(spark, folder, "event_id", "host")
    lines.repartition("host").sortWithinPartitions("host", "event_id").select("host", "value").write.partitionBy("host").text(path)
    batches = file_line_batches(spark, path, JobOptions().ingest_batch_size)
    host = F.regexp_extract("file", "host=([^/]+)", 1).alias("host")
    return batches.groupBy(host, "batch_id").agg(
        F.count("*").alias("lines"), F.min_by("value", "line_no").alias("first_line"), F.max_by("value", "line_no").alias("last_line"))


@report
def training_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Both models trained on lines with bad ones among them: rows learned from and lines skipped."""
    registry = ModelRegistry(spark, new_path(spark, "registry"))
    path = line_files(spark, broken_plain(spark, folder))
    for model_type, training in (("baseline", {}), ("isolation_forest", {"trees": 5})):
        options = JobOptions(model_type=model_type, source_format="plain")
        train_lines(read_lines(spark, path), options, registry, **training)
    return registry.versions().select("model_type", "train_metrics.training_samples", "train_metrics.skipped_lines")


@report
def request_line_split(spark: SparkSession, folder: str) -> DataFrame:
    events = access_log_events(spark, folder)
    split = events.select("event_id", request_parts(F.col("message")).alias("parts"))
    names = ("method", "path", "protocol")
    parts = [text.group(F.col("parts"), at + 1).alias(name) for at, name in enumerate(names)]
    return split.select("event_id", *parts)


@report
def level_counts(spark: SparkSession, folder: str) -> DataFrame:
    return access_log_events(spark, folder).groupBy("level").agg(F.count("*").alias("cnt"))


@report
def event_sources(spark: SparkSession, folder: str) -> DataFrame:
    events = access_log_events(spark, folder)
    source = source_name(F.col("host"), F.col("service")).alias("source")
    return events.groupBy(source).agg(F.count("*").alias("cnt"))


# --- Templates ---------------------------------------------------------------


@report
def path_templates(spark: SparkSession, folder: str) -> DataFrame:
    events = access_log_events(spark, folder)
    template = text.path_template(F.col("path")).alias("template")
    return events.groupBy(template).agg(F.count("*").alias("cnt"))


@report
def message_templates(spark: SparkSession, folder: str) -> DataFrame:
    events = access_log_events(spark, folder)
    number = F.lower(F.hex("event_id"))
    tail = F.lpad(number, 12, "0")
    message = F.concat(
        F.col("remote_addr"), F.lit(" "), F.col("path"), F.lit(" 0x"), number,
        F.lit(" id=550e8400-e29b-41d4-a716-"), tail, F.lit(" took "), F.col("bytes_sent").cast("string"),
    )
    template = text.message_template(message).alias("template")
    return events.groupBy(template).agg(F.count("*").alias("cnt"))


@report
def path_extension_counts(spark: SparkSession, folder: str) -> DataFrame:
    events = access_log_events(spark, folder)
    extension = text.path_extension(F.col("path")).alias("extension")
    return events.groupBy(extension).agg(F.count("*").alias("cnt"))


@report
def referrer_domains(spark: SparkSession, folder: str) -> DataFrame:
    events = access_log_events(spark, folder)
    domain = text.referrer_domain(F.col("referrer")).alias("domain")
    return events.groupBy(domain).agg(F.count("*").alias("cnt"))


@report
def hash_buckets(spark: SparkSession, folder: str) -> DataFrame:
    events = access_log_events(spark, folder)
    return events.select(
        "event_id",
        rounded(text.hash_bucket(F.col("remote_addr"))).alias("ip_bucket"),
        rounded(text.hash_bucket(F.col("user_agent"))).alias("agent_bucket"),
        rounded(text.hash_bucket(F.col("path"))).alias("path_bucket"),
    )


# --- Features ----------------------------------------------------------------


def features(spark: SparkSession, folder: str) -> DataFrame:
    return extract_features(access_log_events(spark, folder), "event_id")


@report
def features_request(spark: SparkSession, folder: str) -> DataFrame:
    names = ["status_code", "status_class", "method_code", "path_length", "path_depth",
             "path_tokens", "bytes_log1p", "request_time_log1p", "request_length_log1p"]
    return round_all(features(spark, folder).select("event_id", *names))


@report
def features_time(spark: SparkSession, folder: str) -> DataFrame:
    names = ["hour", "hour_sin", "hour_cos", "weekday", "is_weekend"]
    return round_all(features(spark, folder).select("event_id", *names))


@report
def features_text(spark: SparkSession, folder: str) -> DataFrame:
    names = ["referrer_hash", "user_agent_hash", "ip_hash", "path_template_hash", "user_length",
             "message_length"]
    return round_all(features(spark, folder).select("event_id", *names))


@report
def features_flags(spark: SparkSession, folder: str) -> DataFrame:
    names = ["has_query", "is_static", "has_user", "suspicious_path", "sql_keyword", "bot_ua"]
    return features(spark, folder).select("event_id", *names)


@report
def feature_scaler(spark: SparkSession, folder: str) -> DataFrame:
    moments = feature_moments(features(spark, folder))
    return round_all(moments.select("position", "feature", "mean", "std", "scale"), 5)


@report
def scaled_features(spark: SparkSession, folder: str) -> DataFrame:
    wide = features(spark, folder)
    names = ["status_code", "path_length", "bytes_log1p", "hour", "request_length_log1p"]
    scaled = scale_features(wide, feature_moments(wide)).select("event_id", *names)
    return round_all(scaled, 4)


# --- Baseline model ----------------------------------------------------------


@report
def baseline_model(spark: SparkSession, folder: str) -> DataFrame:
    return template_counts(access_log_events(spark, folder))


@report
def baseline_model_stats(spark: SparkSession, folder: str) -> DataFrame:
    stats = BaselineDetector.train(access_log_events(spark, folder)).stats
    return stats.select("total", "max_count", "templates")


@report
def baseline_scores(spark: SparkSession, folder: str) -> DataFrame:
    events = access_log_events(spark, folder)
    scored = BaselineDetector.train(events).score(events)
    return scored.select("event_id", rounded("anomaly_score").alias("anomaly_score"))


@report
def baseline_scores_on_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Trained on clean rows only, so that unseen templates score 1."""
    events = access_log_events(spark, folder)
    model = BaselineDetector.train(events.filter("label = 'clean'"))
    return model.score(events).select("event_id", rounded("anomaly_score").alias("anomaly_score"))


@report
def unseen_template_counts(spark: SparkSession, folder: str) -> DataFrame:
    events = access_log_events(spark, folder)
    known = template_counts(events.filter("label = 'clean'"))
    return unseen_templates(events, known)


@report
def score_stats(spark: SparkSession, folder: str) -> DataFrame:
    model = BaselineDetector.train(access_log_events(spark, folder))
    return round_all(calibration(model.training_score_counts(), fv.BASELINE_QUANTILE))


@report
def baseline_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    """Anomalies at the calibrated threshold."""
    events = access_log_events(spark, folder)
    model = BaselineDetector.train(events)
    row = calibration(model.training_score_counts(), fv.BASELINE_QUANTILE).first()
    found = model.predict(events, row["threshold"]).filter("is_anomaly")
    return found.select("event_id", rounded("anomaly_score").alias("anomaly_score"), "model_version")


# --- Rules -------------------------------------------------------------------


@report
def rule_hits(spark: SparkSession, folder: str) -> DataFrame:
    return technique_hits(access_log_events(spark, folder), "event_id")


@report
def technique_ranked(spark: SparkSession, folder: str) -> DataFrame:
    tagged = classify_techniques(access_log_events(spark, folder))
    rows = tagged.select("event_id", F.posexplode("mitre_techniques").alias("position", "item"))
    return rows.select("event_id", "position", "item.technique_id", "item.name", "item.tactic",
                       "item.confidence")


@report
def technique_catalog_join(spark: SparkSession, folder: str) -> DataFrame:
    hits = technique_hits(access_log_events(spark, folder), "event_id")
    named = with_catalog(hits)
    return named.groupBy("technique_id", "name", "tactic", "rule").agg(F.count("*").alias("cnt"))


# --- Detection, storage, metrics ---------------------------------------------


@report
def anomaly_table(spark: SparkSession, folder: str) -> DataFrame:
    """Stored anomaly rows, techniques as joined ids."""
    rows = anomaly_rows(results(spark, folder), "event_id")
    ids = F.array_join(F.transform("mitre_techniques", lambda item: item["technique_id"]), ",")
    return rows.select(
        "event_id", "timestamp", "level", "message", "host", "service", "remote_addr", "method",
        "path", "status", "bytes_sent", rounded("anomaly_score").alias("anomaly_score"),
        "model_version", ids.alias("technique_ids"),
    )


@report
def recent_anomaly_list(spark: SparkSession, folder: str) -> DataFrame:
    stored = anomaly_rows(results(spark, folder), "event_ts", "event_id")
    newest = recent_anomalies(stored, ["event_ts", "event_id"], limit=50, min_score=0.9)
    return newest.select("event_id", "timestamp", "path", rounded("anomaly_score").alias("anomaly_score"))


@report
def running_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = mt.running_summary(ingested_batches(spark, folder))
    last = F.date_format("last_ingest", "yyyy-MM-dd HH:mm:ss").alias("last_ingest")
    return summary.select("total_events", "anomalies", rounded("anomaly_rate").alias("anomaly_rate"), last)


@report
def ingest_summary(spark: SparkSession, folder: str) -> DataFrame:
    return mt.ingest_summary(predicted(spark, folder), "baseline")


@report
def last_ingest_time(spark: SparkSession, folder: str) -> DataFrame:
    return mt.last_ingest_time(ingested_batches(spark, folder))


@report
def event_counters(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(mt.event_counters(cube(spark, folder), "environment"))


def ingested_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The batch table of a replayed ingest: 500 events a batch, taken in when its last event had
    come, with a hundredth of its requests' seconds as the time it took."""
    return replayed_batches(predicted(spark, folder))


def replayed_batches(scored: DataFrame) -> DataFrame:
    events = scored.withColumn("batch_id", F.floor(F.col("event_id") / fv.INGEST_BATCH_SIZE))
    counted = events.groupBy("batch_id").agg(
        F.count("*").alias("events"), F.count_if("is_anomaly").alias("anomalies"),
        F.max("event_ts").alias("ingest_ts"), F.round(F.sum("request_time") / 100, 6).alias("duration_seconds"),
    )
    return counted.withColumn("anomaly_rate", F.col("anomalies") / F.col("events"))


def scored_once(spark: SparkSession, folder: str) -> DataFrame:
    """What the metrics need of the scored log, stored, as they read it more than once."""
    columns = ["event_id", "event_ts", "status", "request_time", "anomaly_score", "is_anomaly", "mitre_techniques"]
    return written(results(spark, folder).select(columns), "scored")


def batch_rates(spark: SparkSession, folder: str) -> DataFrame:
    batch = F.floor(F.col("event_id") / fv.INGEST_BATCH_SIZE).alias("batch_id")
    return mt.event_counters(mt.metric_cube(predicted(spark, folder), batch), "batch_id")


@report
def batch_anomaly_rates(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(batch_rates(spark, folder))


@report
def latest_batch_rate(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(mt.latest_batch_rate(batch_rates(spark, folder)))


@report
def status_classes(spark: SparkSession, folder: str) -> DataFrame:
    return mt.status_counts(mt.metric_cube(predicted(spark, folder)))


@report
def technique_total(spark: SparkSession, folder: str) -> DataFrame:
    return mt.technique_total(cube(spark, folder))


@report
def tactic_share(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(mt.tactic_share(cube(spark, folder)))


@report
def score_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return mt.score_histogram(mt.metric_cube(predicted(spark, folder)))


@report
def score_sum_count(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(mt.score_sum_count(mt.metric_cube(predicted(spark, folder))), 3)


@report
def histogram_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    buckets = mt.score_histogram(mt.metric_cube(predicted(spark, folder)))
    return round_all(mt.histogram_quantiles(buckets))


@report
def duration_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Buckets of the batch durations."""
    return mt.duration_histogram(ingested_batches(spark, folder))


@report
def duration_quantiles_5m(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(mt.duration_quantiles(ingested_batches(spark, folder)))


@report
def metric_severity(spark: SparkSession, folder: str) -> DataFrame:
    scored = scored_once(spark, folder)
    return round_all(mt.metric_severity(mt.metric_cube(scored), replayed_batches(scored)))


@report
def metric_series(spark: SparkSession, folder: str) -> DataFrame:
    scored = scored_once(spark, folder)
    table = mt.metric_table(mt.metric_cube(scored), replayed_batches(scored))
    labels = [F.col("labels")[name].alias(name) for name in ("status_class", "technique_id", "tactic")]
    return table.select("metric", *labels, "le", rounded("value", 3).alias("value"))


def rate_cube(spark: SparkSession, folder: str) -> DataFrame:
    return cube(spark, folder, mt.time_bucket(F.col("event_ts")).alias("bucket"))


@report
def event_rate_5m(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(mt.event_rates(rate_cube(spark, folder)))


@report
def status_rate_5m(spark: SparkSession, folder: str) -> DataFrame:
    counts = mt.status_counts(rate_cube(spark, folder), "bucket")
    return round_all(mt.sliding_rates(counts, ["cnt"], ["status_class"]))


@report
def technique_rate_5m(spark: SparkSession, folder: str) -> DataFrame:
    counts = mt.technique_counts(rate_cube(spark, folder), "bucket")
    return round_all(mt.sliding_rates(counts, ["cnt"], ["technique_id", "tactic"]))


@report
def score_quantiles_by_hour(spark: SparkSession, folder: str) -> DataFrame:
    """Dashboard quantiles of the score histogram per hour."""
    hour = mt.time_bucket(F.col("event_ts"), 3600).alias("hour_start")
    hourly = mt.metric_cube(predicted(spark, folder), hour)
    buckets = mt.score_histogram(hourly, "hour_start")
    return round_all(mt.histogram_quantiles(buckets, by=["hour_start"]))


# --- Evaluation --------------------------------------------------------------


def classes(spark: SparkSession, folder: str) -> DataFrame:
    return ev.class_counts(label_scores(spark, folder))


@report
def label_totals(spark: SparkSession, folder: str) -> DataFrame:
    return ev.label_totals(classes(spark, folder))


@report
def category_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ev.category_counts(label_scores(spark, folder))


@report
def confusion_at_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(ev.confusion_at(classes(spark, folder), THRESHOLD))


@report
def score_by_class(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(ev.score_distribution(ev.ordered_classes(classes(spark, folder))))


@report
def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(ev.roc_auc(ev.ordered_classes(classes(spark, folder))))


@report
def roc_curve(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(ev.roc_curve(ev.ordered_classes(classes(spark, folder))), 9)


@report
def youden_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(ev.youden_point(ev.roc_curve(ev.ordered_classes(classes(spark, folder)))))


@report
def f1_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(ev.threshold_sweep(classes(spark, folder)))


@report
def best_f1_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(ev.best_f1(ev.threshold_sweep(classes(spark, folder)), THRESHOLD))


@report
def sweep_report(spark: SparkSession, folder: str) -> DataFrame:
    shown = ev.sweep_report(ev.threshold_sweep(classes(spark, folder)), 0.97, THRESHOLD)
    return round_all(shown.select("threshold", "precision", "recall", "f1", "fpr", "marker"))


@report
def category_recall(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(ev.category_recall(label_scores(spark, folder), THRESHOLD, 0.97))


@report
def anomaly_share(spark: SparkSession, folder: str) -> DataFrame:
    return round_all(ev.anomaly_share(label_scores(spark, folder), THRESHOLD))


@report
def score_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with a smaller score, for each distinct training score."""
    model = BaselineDetector.train(access_log_events(spark, folder))
    ranked = running_totals(model.training_score_counts(), "anomaly_score", ["n"])
    return ranked.select(rounded("anomaly_score", 9).alias("anomaly_score"), "n", "n_before", "n_total")


@report
def validation_report(spark: SparkSession, folder: str) -> DataFrame:
    """A registered model judged on the labelled log, at its own calibrated threshold: the whole report as one table."""
    events = access_log_events(spark, folder)
    registry = ModelRegistry(spark, new_path(spark, "registry"))
    train_model(events, "baseline", registry)
    detector, metadata = registry.load_latest()
    return round_all(long_report(events, detector, resolve_threshold(metadata, JobOptions())))


# --- Labelled sets and exports -----------------------------------------------


@report
def template_sample(spark: SparkSession, folder: str) -> DataFrame:
    rows = access_log_events(spark, folder).select("event_id", "path")
    return lab.sample_templates(rows, "event_id", pick=small_pick)


@report
def labelled_mix(spark: SparkSession, folder: str) -> DataFrame:
    """One injected attack per clean event, mixed with the events."""
    events = access_log_events(spark, folder).drop("label", "attributes")
    templates = lab.sample_templates(events, "event_id", pick=small_pick)
    attacks = lab.inject_attacks(events, "event_id", templates, small_pick)
    mix = lab.labelled_mix(events, attacks, "event_id", None, small_pick)
    return mix.select("event_id", "label", "method", "path", "status", "user_agent", "mix_order")


@report
def labelled_set_files(spark: SparkSession, folder: str) -> DataFrame:
    """A labelled set written as files, twice, and read back: events by file, label and status."""
    # Made once, as the sorts of all six writes read them twice.
    events = written(access_log_events(spark, folder).drop("label"), "clean-events")
    templates = lab.sample_templates(events, "event_id", pick=small_pick)
    attacks = written(lab.inject_attacks(events, "event_id", templates, small_pick), "attack-events")
    mix = lab.labelled_mix(events, attacks, "event_id", None, small_pick)
    path = new_path(spark, "labelled-set")
    for _ in range(2):  # a rerun replaces the files
        write_labelled_set(events, attacks, mix, path, "event_id")
    parts = []
    for name in ("clean", "attacks", "mixed"):
        read, _ = labelled_events(read_lines(spark, f"{path}/{name}").select("value"))
        parts.append(read.groupBy(F.lit(name).alias("set_file"), "label", "status").agg(F.count("*").alias("cnt")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@report
def attack_categories(spark: SparkSession, folder: str) -> DataFrame:
    events = access_log_events(spark, folder).drop("label", "attributes")
    templates = lab.sample_templates(events, "event_id", pick=small_pick)
    attacks = lab.inject_attacks(events, "event_id", templates, small_pick)
    return attacks.groupBy("label", "status").agg(F.count("*").alias("cnt"))


@report
def labelled_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled JSON lines read back: events per label and level."""
    events = access_log_events(spark, folder)
    own = F.when(F.col("label") != "clean", F.col("label"))
    lines = json_lines(events, "event_id", extra={"_label": own})
    parsed, _ = labelled_events(lines)
    return parsed.groupBy("label", "level").agg(F.count("*").alias("cnt"))


@report
def plain_export(spark: SparkSession, folder: str) -> DataFrame:
    return exported_plain(spark, folder, "event_id")


@report
def jsonl_export(spark: SparkSession, folder: str) -> DataFrame:
    lines = json_lines(access_log_events(spark, folder), "event_id")

    def part(key: str) -> Column:
        return F.get_json_object("value", f"$.{key}").alias(key)

    keys = ["timestamp", "host", "remote_addr", "remote_user", "path", "status", "message", "level"]
    return lines.select(
        "event_id",
        *[part(key) for key in keys],
        rounded(part("request_time").cast("double")).alias("request_time"),
        F.size(F.json_object_keys("value")).alias("keys"),
    )


# --- Forest ------------------------------------------------------------------


@report
def iforest_scores(spark: SparkSession, folder: str) -> DataFrame:
    events = access_log_events(spark, folder)
    model = ForestDetector.train(events, id_column="event_id")
    return model.score(events).select("event_id", rounded("anomaly_score").alias("anomaly_score"))


@report
def iforest_training(spark: SparkSession, folder: str) -> DataFrame:
    """Calibration row of a forest trained on the whole access log."""
    model, scores = fit_forest(access_log_events(spark, folder), id_column="event_id")
    return round_all(calibration(scores, 1.0 - model.contamination))


@report
def iforest_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes of a small forest."""
    features = training_features(access_log_events(spark, folder), "event_id")
    nodes = ForestDetector.fit(features, trees=20).nodes
    split = F.col("feature") >= 0
    return nodes.select(
        "tree", "node", "feature", F.when(split, F.round("threshold", 6)).alias("threshold"), "size", rounded("path_length").alias("path_length"))


@report
def iforest_registered(spark: SparkSession, folder: str) -> DataFrame:
    """A forest trained, registered, read back as the newest model and used by its own threshold."""
    events = access_log_events(spark, folder)
    registry = ModelRegistry(spark, new_path(spark, "registry"))
    train_model(events, "isolation_forest", registry, id_column="event_id", trees=20)
    detector, metadata = registry.load_latest()
    threshold = resolve_threshold(metadata, JobOptions())
    found = detect(events, detector, threshold).agg(
        F.count("*").alias("received"), F.count_if("is_anomaly").alias("anomalies"), F.max("model_version").alias("model_version"))
    metrics = metadata["train_metrics"]
    return found.select(
        "received", "anomalies", "model_version", F.round(F.lit(threshold), 6).alias("threshold"),
        F.round(F.lit(metrics["score_mean"]), 6).alias("score_mean"), F.lit(metrics["training_samples"]).cast("long").alias("training_samples"))


@report
def iforest_sample_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows at the root of each tree."""
    model = ForestDetector.fit(training_features(access_log_events(spark, folder), "event_id"))
    return model.nodes.filter("node = 0").select("tree", "size")


@report
def iforest_auc(spark: SparkSession, folder: str) -> DataFrame:
    events = access_log_events(spark, folder)
    model = ForestDetector.train(events, id_column="event_id")
    counts = ev.class_counts(model.score_counts(events, "label"))
    return round_all(ev.roc_auc(ev.ordered_classes(counts)))


# --- Streaming ---------------------------------------------------------------


def event_stream(spark: SparkSession, folder: str, files: int = 2) -> DataFrame:
    """The access log as a stream: ``events`` cut by time into files, one file a batch."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    path = new_path(spark, "event-files")
    low, high = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    for at in range(files):  # one after another, as a stream takes files in the order of their writing
        start, stop = (low + (high - low) * (at + step) / files for step in (0, 1))
        upper = F.col("ts") <= stop if at == files - 1 else F.col("ts") < stop
        events.filter((F.col("ts") >= start) & upper).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return as_events(access_log_view(stream, spark.read.parquet(f"{folder}/pages.parquet")))


def ingested_stream(spark: SparkSession, folder: str, rejected: bool = False) -> tuple[str, str]:
    """The plain export streamed in, scored and stored, a few files a batch: the anomaly table and the batch table.

    ``rejected`` adds a last batch without a good line."""
    inbox, anomalies = new_path(spark, "inbox"), new_path(spark, "anomalies")
    batches, checkpoint = new_path(spark, "batches"), new_path(spark, "ingest-checkpoint")
    write_lines(exported_plain(spark, folder), inbox)
    model = BaselineDetector.train(parse_access_logs(read_lines(spark, inbox), "plain"))
    options = JobOptions(source_format="plain")

    def run() -> None:
        stream = stream_lines(spark, inbox, files_per_trigger=4)
        start_ingest(stream, model, THRESHOLD, options, anomalies, batches, checkpoint).awaitTermination()

    run()
    if rejected:
        write_lines(broken_plain(spark, folder).filter(F.col("event_id") % 97 == 0).coalesce(1), inbox, mode="append")
        run()
    return anomalies, batches


@report
def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of the batch table of a streamed ingest, and of the rows stored."""
    anomalies, batches = ingested_stream(spark, folder)
    stored = read_anomalies(spark, anomalies).agg(F.count("*").alias("stored"))
    totals = spark.read.parquet(batches).agg(
        F.sum("events").alias("received"),
        F.sum("anomalies").alias("anomalies"),
        F.sum("skipped").alias("skipped"),
    )
    return totals.join(F.broadcast(stored))


@report
def stream_recent(spark: SparkSession, folder: str) -> DataFrame:
    """The newest anomalies read back from the table a stream has written."""
    anomalies, _ = ingested_stream(spark, folder)
    newest = recent_ingested(spark, JobOptions(), anomalies, ["event_ts", "path", "anomaly_score"], min_score=0.9)
    return newest.select("timestamp", "path", rounded("anomaly_score").alias("anomaly_score"))


@report
def stream_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Running totals from the stream's own batch table; the last batch holds rejected lines only."""
    _, path = ingested_stream(spark, folder, rejected=True)
    batches = spark.read.parquet(path)
    ingests = batches.agg(F.max(F.when(F.col("events") > 0, F.col("batch_id"))).alias("batch_id"))
    newest = batches.join(F.broadcast(ingests), "batch_id").select(F.col("ingest_ts").alias("newest_ts"))
    summary = mt.running_summary(batches).join(F.broadcast(newest)).join(F.broadcast(mt.last_ingest_time(batches)))
    rejected = batches.agg(F.count_if(F.col("events") == 0).alias("empty_batches"), F.sum("skipped").alias("skipped"))
    same = (F.col("last_ingest") == F.col("newest_ts")) & (F.unix_seconds("last_ingest") == F.col("last_ingest_unix"))
    return summary.join(F.broadcast(rejected)).select(
        "total_events", "anomalies", rounded("anomaly_rate").alias("anomaly_rate"), "empty_batches", "skipped", same.alias("time_of_last_event_batch"))


def updated(counts: DataFrame, store: CountStore) -> CountStore:
    """The store after all counts of a stream."""
    rates.start_updates(counts, store, new_path(counts.sparkSession, "counts-checkpoint")).awaitTermination()
    return store


@report
def stream_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Sliding rates from a store that is merged every second batch."""
    counts = rates.bucket_counts(event_stream(spark, folder), "event_ts")
    store = rates.bucket_store(spark, new_path(spark, "rates"), merge_every=2)
    return round_all(rates.stored_rates(updated(counts, store)))


@report
def stream_status_counters(spark: SparkSession, folder: str) -> DataFrame:
    status = mt.status_class(F.col("status")).alias("status_class")
    counts = rates.cumulative_counters(event_stream(spark, folder), status)
    return updated(counts, CountStore(spark, new_path(spark, "counters"), ["status_class"], merge_every=2)).counts()


@report
def stream_score_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Score quantiles per 5-minute window of a scored stream."""
    model = BaselineDetector.train(access_log_events(spark, folder))
    counts = rates.windowed_score_buckets(model.score(event_stream(spark, folder)), "event_ts")
    latest = updated(counts, rates.score_store(spark, new_path(spark, "quantiles"), merge_every=2)).counts()
    buckets = mt.cumulative_buckets(latest, "score_le", "cnt", fv.SCORE_BOUNDS, ["window_start"])
    return round_all(mt.histogram_quantiles(buckets, by=["window_start"]))
