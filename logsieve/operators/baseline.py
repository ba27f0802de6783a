"""Template-frequency model: rare request templates score high."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import event_template
from ..scratch import written
from .lookup import ROW_OVERHEAD, lookup

MODEL_VERSION = "baseline"


def with_template(events: DataFrame) -> DataFrame:
    """Adds the template key of each event."""
    key = event_template(F.col("method"), F.col("status"), F.col("path"), F.col("message"))
    return events.withColumn("template", key)


def template_counts(events: DataFrame) -> DataFrame:
    return with_template(events).groupBy("template").agg(F.count("*").alias("cnt"))


def count_stats(counts: DataFrame) -> DataFrame:
    """One row: events, highest count, number of templates and their bytes."""
    return counts.agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"),
        F.coalesce(F.max("cnt"), F.lit(0)).alias("max_count"),
        F.count("*").alias("templates"),
        F.coalesce(F.sum(F.octet_length("template")), F.lit(0)).alias("template_bytes"),
    )


def unseen_templates(events: DataFrame, counts: DataFrame) -> DataFrame:
    """Templates of ``events`` that training never saw, with their number of events."""
    return template_counts(events).join(counts, "template", "left_anti")


class BaselineDetector:
    """Counts per template, and scores ``1 - count / highest count``."""

    model_type = "baseline"
    model_version = MODEL_VERSION

    def __init__(self, counts: DataFrame, stats: DataFrame, model_bytes: int | None = None) -> None:
        self.counts = counts
        self.stats = stats
        self.model_bytes = model_bytes

    @classmethod
    def train(cls, events: DataFrame) -> BaselineDetector:
        """Counts are stored once and their size is known, so that every use joins them the cheap way."""
        counts = written(template_counts(events), "counts")
        stats = count_stats(counts)
        row = stats.first()
        return cls(counts, stats, row["template_bytes"] + ROW_OVERHEAD * row["templates"])

    def template_scores(self) -> DataFrame:
        """(template, cnt, template_score); the highest count is a one-row side."""
        top = self.stats.select("max_count")
        frequency = F.col("cnt") / F.col("max_count")
        return self.counts.join(F.broadcast(top)).select(
            "template", "cnt", (1.0 - frequency).alias("template_score")
        )

    def score(self, events: DataFrame) -> DataFrame:
        """Adds ``anomaly_score``; an unseen template scores 1."""
        scored = lookup(
            with_template(events),
            self.template_scores().drop("cnt"),
            "template",
            self.model_bytes,
            [name for name in ("event_ts", "remote_addr", "path", "user_agent") if name in events.columns],
        )
        filled = F.coalesce(F.col("template_score"), F.lit(1.0))
        return scored.withColumn("anomaly_score", filled).drop("template", "template_score")

    def predict(self, events: DataFrame, threshold: float) -> DataFrame:
        return with_prediction(self.score(events), threshold, self.model_version)

    def score_counts(self, events: DataFrame, *by: str) -> DataFrame:
        """(anomaly_score, *by, n): grouped by template before the join, so the
        join sees one row per template and not one per event."""
        grouped = with_template(events).groupBy("template", *by).agg(F.count("*").alias("n"))
        scored = lookup(
            grouped, self.template_scores().drop("cnt"), "template", self.model_bytes, list(by)
        )
        score = F.coalesce(F.col("template_score"), F.lit(1.0))
        return scored.groupBy(score.alias("anomaly_score"), *by).agg(F.sum("n").alias("n"))

    def training_score_counts(self) -> DataFrame:
        """(anomaly_score, n) of the training events, from the counts alone."""
        scores = self.template_scores()
        return scores.groupBy(F.col("template_score").alias("anomaly_score")).agg(
            F.sum("cnt").alias("n")
        )

    def save(self, path: str) -> None:
        self.counts.write.mode("overwrite").parquet(f"{path}/counts")
        saved = self.counts.sparkSession.read.parquet(f"{path}/counts")
        stats = count_stats(saved).withColumn("model_version", F.lit(self.model_version))
        stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BaselineDetector:
        counts = spark.read.parquet(f"{path}/counts")
        stats = spark.read.parquet(f"{path}/stats")
        row = stats.first()
        size = row["template_bytes"] + ROW_OVERHEAD * row["templates"]
        model = cls(counts, stats, size)
        model.model_version = row["model_version"]
        return model


def with_prediction(scored: DataFrame, threshold: float, version: str) -> DataFrame:
    """Adds ``is_anomaly`` (score at or above the threshold) and the model version."""
    return scored.withColumns(
        {
            "is_anomaly": F.col("anomaly_score") >= F.lit(float(threshold)),
            "model_version": F.lit(version),
        }
    )
