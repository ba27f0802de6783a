"""Continuous ingest of line files with a fixed model."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.parse import parse_access_logs
from ..options import JobOptions
from ..plans.detect import detect, parse_options
from ..plans.registry import Detector
from ..sinks.anomalies import anomaly_rows, store_anomalies

BATCH_SCHEMA = (
    "batch_id bigint, events bigint, anomalies bigint, skipped bigint, anomaly_rate double, "
    "duration_seconds double, ingest_ts timestamp"
)


def _replace_batch(df: DataFrame, path: str) -> None:
    """Write one batch's folder, replacing it if the batch is repeated after a failure."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("batch_id").parquet(path)


def start_ingest(
    lines: DataFrame,
    detector: Detector,
    threshold: float,
    options: JobOptions,
    anomaly_path: str,
    batch_path: str,
    checkpoint: str,
    **trigger: object,
) -> StreamingQuery:
    """Score a stream of lines; anomalies and one summary row per batch are stored.

    Each batch is read once: the counts are observed while its anomalies are
    written. Writes are keyed by batch, so a repeated batch changes nothing.
    """
    parsed = parse_access_logs(lines, options.source_format, mode="keep", **parse_options(options))

    def store(batch: DataFrame, batch_id: int) -> None:
        spark, started = batch.sparkSession, time.monotonic()
        valid = F.col("reject_reason").isNull()
        scored = detect(batch, detector, threshold)
        seen = Observation()
        watched = scored.observe(
            seen,
            F.count_if(valid).alias("events"),
            F.count_if(valid & F.col("is_anomaly")).alias("anomalies"),
            F.count_if(~valid).alias("skipped"),
        )
        # Without a shuffle, which would take the observation with it where it turns out to be empty.
        rows = anomaly_rows(watched.filter(valid), "event_ts", "file")
        store_anomalies(rows, anomaly_path, f"batch-{batch_id:09d}", spread=False)
        counts = seen.get
        events, anomalies = counts["events"], counts["anomalies"]
        rate = anomalies / events if events else 0.0
        row = spark.createDataFrame(
            [(batch_id, events, anomalies, counts["skipped"], rate, time.monotonic() - started)],
            BATCH_SCHEMA.removesuffix(", ingest_ts timestamp"),
        ).withColumn("ingest_ts", F.current_timestamp())
        _replace_batch(row.coalesce(1), batch_path)

    writer = parsed.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
