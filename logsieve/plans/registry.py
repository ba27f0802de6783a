"""Model registry: one appended row per trained version, models as parquet tables."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import UTC, datetime
from typing import Protocol

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .. import fixed_values as fv
from ..operators.baseline import BaselineDetector
from ..operators.iforest import ForestDetector

METRIC_NAMES = [
    "score_mean", "score_std", "score_p90", "score_p95", "score_p99", "threshold",
    "threshold_quantile",
]
MODEL_SCHEMA = (
    "model_type string, version string, trained_at string, feature_names array<string>, "
    "train_metrics struct<"
    + ", ".join(f"{name}: double" for name in METRIC_NAMES)
    + ", training_samples: bigint, skipped_lines: bigint>, path string"
)


class Detector(Protocol):
    """What every model can do with DataFrames."""

    model_type: str
    model_version: str

    @classmethod
    def train(cls, events: DataFrame) -> Detector: ...

    def score(self, events: DataFrame) -> DataFrame: ...

    def predict(self, events: DataFrame, threshold: float) -> DataFrame: ...

    def score_counts(self, events: DataFrame, *by: str) -> DataFrame: ...

    def save(self, path: str) -> None: ...

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Detector: ...


def detector_class(model_type: str) -> type[BaselineDetector] | type[ForestDetector]:
    name = model_type.lower()
    if name == "baseline":
        return BaselineDetector
    if name in ("isolation_forest", "iforest"):
        return ForestDetector
    raise ValueError(f"Unsupported model type: {model_type}")


class ModelRegistry:
    """Versions under one folder of a shared file system."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.table = f"{self.folder}/models"

    def save(self, detector: Detector, model_type: str, metrics: Mapping[str, float]) -> Row:
        """Write the model, then its row; a failed write leaves no row behind."""
        now = datetime.now(UTC)
        version = now.strftime(fv.VERSION_FORMAT)
        path = f"{self.folder}/{model_type}_{version}"
        detector.save(path)
        values = tuple(metrics.get(name) for name in METRIC_NAMES)
        row = (
            model_type,
            version,
            now.isoformat(),
            fv.FEATURE_NAMES,
            (*values, metrics.get("training_samples"), metrics.get("skipped_lines")),
            path,
        )
        entry = self.spark.createDataFrame([row], MODEL_SCHEMA)
        entry.coalesce(1).write.mode("append").parquet(self.table)
        return entry.first()

    def versions(self) -> DataFrame:
        return self.spark.read.schema(MODEL_SCHEMA).parquet(self.table)

    def load_latest(self) -> tuple[Detector, Row]:
        try:
            newest = self.versions().orderBy(F.desc("version"), F.desc("trained_at")).first()
        except AnalysisException as error:
            raise FileNotFoundError("No model artifacts found. Train a model first.") from error
        if newest is None:
            raise FileNotFoundError("No model artifacts found. Train a model first.")
        if not newest["model_type"] or not newest["path"]:
            raise ValueError("Invalid model metadata")
        detector = detector_class(newest["model_type"]).load(self.spark, newest["path"])
        return detector, newest
