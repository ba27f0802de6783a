"""Parse, score, classify, store and summarize."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators.metrics import ingest_summary
from ..operators.parse import parse_access_logs
from ..operators.rules import classify_techniques
from ..options import JobOptions
from ..scratch import written
from ..sinks.anomalies import append_anomalies, recent_stored
from ..sources.lines import existing_files, parsed_files
from .registry import Detector, ModelRegistry


def resolve_threshold(metadata: Row, options: JobOptions) -> float:
    """Calibrated threshold, else the default of the model type.

    ``options.min_threshold`` is a floor for the degenerate case of uniform
    training data, where the calibrated threshold is 0 and flags every event.
    """
    metrics = metadata["train_metrics"]
    threshold = metrics["threshold"] if metrics is not None else None
    if threshold is None:
        baseline = metadata["model_type"].lower() == "baseline"
        threshold = options.baseline_threshold if baseline else options.anomaly_threshold
    if options.min_threshold is not None:
        threshold = max(threshold, options.min_threshold)
    return float(threshold)


def detect(events: DataFrame, detector: Detector, threshold: float) -> DataFrame:
    """Events with score, flag and model version; techniques on anomalies only."""
    predicted = detector.predict(events, threshold)
    return classify_techniques(predicted, F.col("is_anomaly"))


def parse_options(options: JobOptions) -> dict:
    return {"mapping": options.field_mapping, "patterns": options.plain_patterns}


def ingest_lines(
    lines: DataFrame, detector: Detector, threshold: float, options: JobOptions
) -> DataFrame:
    """Strict ingest of a posted batch: one bad line fails the job, nothing is stored."""
    events = parse_access_logs(
        lines, options.source_format, mode="failfast", **parse_options(options)
    )
    return detect(events, detector, threshold)


def file_summary(scored: DataFrame) -> DataFrame:
    """Received, anomalies and skipped per file; the row without a file is the total."""
    valid = F.col("reject_reason").isNull()
    by_file = scored.groupBy("file").agg(
        F.count_if(valid).alias("received"),
        F.count_if(valid & F.col("is_anomaly")).alias("anomalies"),
        F.count_if(~valid).alias("skipped_lines"),
    )
    # Only one row per file is rolled up.
    return by_file.rollup("file").agg(*[F.sum(name).alias(name) for name in ("received", "anomalies", "skipped_lines")])


def ingest_posted(
    lines: DataFrame, detector: Detector, metadata: Row, options: JobOptions, anomaly_path: str, run_id: str | None = None
) -> DataFrame:
    """Score a posted batch, store its anomalies and return received, anomalies and model version."""
    scored = written(ingest_lines(lines, detector, resolve_threshold(metadata, options), options), "posted")
    append_anomalies(scored, anomaly_path, run_id=run_id)
    return ingest_summary(scored, metadata["version"])


def ingest_files(
    spark: SparkSession, options: JobOptions, registry: ModelRegistry, anomaly_path: str | None = None,
    run_id: str | None = None,
) -> DataFrame | None:
    """Tolerant ingest of the configured paths; returns the summary per file and in total."""
    files = existing_files(spark, options.input_paths)
    if not files:
        return None
    detector, metadata = registry.load_latest()
    threshold = resolve_threshold(metadata, options)
    parsed = parsed_files(spark, files, options.source_format, **parse_options(options))
    # Stored once, so that every line is parsed and scored once for both uses.
    scored = written(detector.predict(parsed, threshold), "ingest")
    if anomaly_path is not None:
        events = scored.filter(F.col("reject_reason").isNull() & F.col("is_anomaly")).drop("reject_reason")
        append_anomalies(classify_techniques(events, F.col("is_anomaly")), anomaly_path, "file", run_id=run_id)
    return file_summary(scored)


def recent_ingested(
    spark: SparkSession, options: JobOptions, anomaly_path: str, newest_first: list[str], limit: int = fv.RECENT_LIMIT, min_score: float | None = None,
) -> DataFrame:
    """The newest stored anomalies, of as many as the options retain."""
    return recent_stored(spark, anomaly_path, newest_first, retained=options.max_stored_anomalies, limit=limit, min_score=min_score)
