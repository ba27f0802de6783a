"""Counters and rates over a stream of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import fixed_values as fv
from ..operators.metrics import first_bound, sliding_rates
from .store import Closing, CountStore

DELAY_SECONDS = 600


def bucket_counts(events: DataFrame, ts: str, *by: Column | str, delay: int = DELAY_SECONDS) -> DataFrame:
    """Counts per 15-second bucket (``bucket`` in epoch seconds)."""
    window = F.window(F.col(ts), f"{fv.RATE_STEP_SECONDS} seconds")
    counted = events.withWatermark(ts, f"{delay} seconds").groupBy(window, *by).agg(F.count("*").alias("cnt"))
    start = F.unix_seconds(F.col("window.start").cast("timestamp"))
    return counted.withColumn("bucket", start).drop("window")


def start_updates(counts: DataFrame, store: CountStore, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Keep the newest count of every key of a counted stream in ``store``."""
    writer = counts.writeStream.outputMode("update").foreachBatch(store.update)
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def bucket_store(spark: SparkSession, path: str, *by: str, delay: int = DELAY_SECONDS, **options: object) -> CountStore:
    """The store of ``bucket_counts``."""
    return CountStore(spark, path, ["bucket", *by], Closing("bucket", fv.RATE_STEP_SECONDS, delay), **options)


def score_store(spark: SparkSession, path: str, delay: int = DELAY_SECONDS, **options: object) -> CountStore:
    """The store of ``windowed_score_buckets``."""
    closing = Closing("window_start", fv.RATE_WINDOW_SECONDS, delay)
    return CountStore(spark, path, ["window_start", "score_le"], closing, **options)


def stored_rates(store: CountStore, *by: str) -> DataFrame:
    """Sliding 5-minute rates from the stored bucket counts."""
    return sliding_rates(store.counts(), ["cnt"], by)


def cumulative_counters(events: DataFrame, *by: Column | str) -> DataFrame:
    """Totals by label since the stream began, for ``update`` or ``complete`` output."""
    return events.groupBy(*by).agg(F.count("*").alias("cnt"))


def windowed_score_buckets(results: DataFrame, ts: str, delay: int = DELAY_SECONDS) -> DataFrame:
    """Counts per 5-minute window and score bucket; input of the windowed quantiles."""
    window = F.window(F.col(ts), f"{fv.RATE_WINDOW_SECONDS} seconds")
    le = first_bound(F.col("anomaly_score"), fv.SCORE_BOUNDS).alias("score_le")
    counted = results.withWatermark(ts, f"{delay} seconds").groupBy(window, le).agg(F.count("*").alias("cnt"))
    start = F.unix_seconds(F.col("window.start").cast("timestamp"))
    return counted.withColumn("window_start", start).drop("window")
