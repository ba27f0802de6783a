"""Train a model, calibrate its threshold, register it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators.baseline import BaselineDetector
from ..operators.iforest import ForestDetector, training_features
from ..operators.parse import parse_access_logs
from ..operators.ranking import moments, quantile, running_totals
from ..options import JobOptions
from ..scratch import written
from ..sources.lines import existing_files, read_lines
from .registry import ModelRegistry, detector_class


def calibration(score_counts: DataFrame, threshold_quantile: float) -> DataFrame:
    """One row: mean, deviation, p90, p95, p99, threshold and row count of (anomaly_score, n)."""
    ordered = running_totals(score_counts, "anomaly_score", ["n"])
    mean, deviation = moments("anomaly_score", "n")
    values = {
        "score_mean": mean,
        "score_std": deviation,
        "score_p90": quantile("anomaly_score", "n", 0.90),
        "score_p95": quantile("anomaly_score", "n", 0.95),
        "score_p99": quantile("anomaly_score", "n", 0.99),
        "threshold": quantile("anomaly_score", "n", threshold_quantile),
    }
    return ordered.agg(
        *[F.coalesce(column, F.lit(0.0)).alias(name) for name, column in values.items()],
        F.lit(threshold_quantile).alias("threshold_quantile"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("training_samples"),
    )


def fit_baseline(events: DataFrame) -> tuple[BaselineDetector, DataFrame]:
    """Model with written counts and known size, and the scores of its training rows.

    The training scores come from the counts; events are read once.
    """
    model = BaselineDetector.train(events)
    return model, model.training_score_counts()


def fit_forest(
    events: DataFrame, id_column: str | None = None, **options: object
) -> tuple[ForestDetector, DataFrame]:
    """Calibrated model and the scores of its training rows, scored in one pass."""
    features = training_features(events, id_column)
    model = ForestDetector.fit(features, **options)
    raw = written(model.training_score_counts(features), "scores")
    model.calibrate(raw)
    scores = raw.groupBy(model.normalized(F.col("anomaly_score")).alias("anomaly_score")).agg(
        F.sum("n").alias("n")
    )
    return model, scores


def train_model(
    events: DataFrame, model_type: str, registry: ModelRegistry, seen: Observation | None = None, **options: object
) -> Row:
    """Train, calibrate and register; returns the registry row. ``seen`` observes ``skipped`` lines while the events are read."""
    kind = detector_class(model_type)
    if kind is BaselineDetector:
        model, scores = fit_baseline(events)
        level = fv.BASELINE_QUANTILE
    else:
        model, scores = fit_forest(events, **options)
        level = 1.0 - float(model.contamination)
    metrics = calibration(scores, level).first().asDict()
    if seen is not None:
        metrics["skipped_lines"] = seen.get["skipped"]
    return registry.save(model, model_type.lower(), metrics)


def train_lines(lines: DataFrame, options: JobOptions, registry: ModelRegistry, **training: object) -> Row:
    """Train on raw lines, whatever their number: bad lines are left out, and counted in the pass that reads them."""
    parsed = parse_access_logs(lines, options.source_format, options.field_mapping, options.plain_patterns, mode="keep")
    seen = Observation()
    watched = parsed.observe(seen, F.count_if(F.col("reject_reason").isNotNull()).alias("skipped"))
    events = watched.filter(F.col("reject_reason").isNull()).drop("reject_reason", *lines.columns)
    return train_model(events, options.model_type, registry, seen, **training)


def bootstrap_model(options: JobOptions, registry: ModelRegistry) -> Row | None:
    """Train from the bootstrap file; nothing happens if it is missing or holds no event."""
    if not options.bootstrap_path:
        return None
    files = existing_files(registry.spark, [options.bootstrap_path])
    if not files:
        return None
    events = parse_access_logs(
        read_lines(registry.spark, files),
        options.source_format,
        options.field_mapping,
        options.plain_patterns,
    )
    if events.isEmpty():
        return None
    return train_model(events, options.model_type, registry)
