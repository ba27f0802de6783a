"""The stored-anomaly table and its reader."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.times import iso_text
from ..schema import ANOMALY_COLUMNS


def anomaly_rows(results: DataFrame, *kept: str) -> DataFrame:
    """Anomalies in the stored layout; an empty technique list is stored as null."""
    flat = results.filter("is_anomaly").withColumns(
        {
            "timestamp": iso_text(F.col("event_local"), F.col("utc_offset")),
            "mitre_techniques": F.when(F.size("mitre_techniques") > 0, F.col("mitre_techniques")),
        }
    )
    return flat.select(*kept, *ANOMALY_COLUMNS)


def store_anomalies(rows: DataFrame, path: str, run_id: str, spread: bool = True) -> None:
    """Store one run's ``anomaly_rows`` (with ``event_ts``) and what each of its files holds.

    The run's folder is replaced as a whole if the run is repeated. ``_index`` keeps one row per file with its
    number of timed rows and their first and last time (in UTC, whatever offset the events had); readers choose files by it.
    The rows are dealt over files by time; without ``spread`` they are written where they are, as suits a
    small batch of a stream.
    """
    spark = rows.sparkSession
    if spread:
        rows = rows.repartitionByRange("event_ts").sortWithinPartitions("event_ts")
    own = f"{path}/run_id={run_id}"
    rows.write.mode("overwrite").parquet(own)
    # The kinds are given, as a run without anomalies may leave no file to read them from.
    stored = spark.read.schema(rows.schema).parquet(own).select("event_ts", F.col("_metadata.file_name").alias("file_name"))
    files = stored.groupBy("file_name").agg(
        F.count("event_ts").alias("n"), F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts"))
    files.coalesce(1).write.mode("overwrite").parquet(f"{path}/_index/run_id={run_id}")


def append_anomalies(results: DataFrame, path: str, *order: str, run_id: str | None = None) -> None:
    """Store the anomalies of a run; ``order`` columns keep ingest order. See ``store_anomalies``."""
    store_anomalies(anomaly_rows(results, "event_ts", *order), path, run_id or uuid.uuid4().hex)


def read_anomalies(spark: SparkSession, path: str) -> DataFrame:
    """The stored anomalies of all runs."""
    return spark.read.parquet(path)


def recent_stored(spark: SparkSession, path: str, newest_first: list[str], retained: int = fv.MAX_STORED_ANOMALIES, **limits: object) -> DataFrame:
    """``recent_anomalies`` of a stored table, reading only files that can hold one of the newest rows.

    ``newest_first`` begins with ``event_ts``. The files are taken from the index by their first time, newest
    first, until they hold ``retained`` rows: no row before the last of these times can be among the newest, and
    neither can files that end before it.
    """
    if newest_first[:1] != ["event_ts"]:
        raise ValueError("the newest rows are found by event_ts")
    index = spark.read.parquet(f"{path}/_index").withColumn("run_id", F.col("run_id").cast("string"))
    upto, since = 0, None
    for row in index.filter("n > 0").orderBy(F.desc("first_ts")).toLocalIterator():
        upto, since = upto + row["n"], row["first_ts"]
        if upto >= retained:
            break
    if upto < retained:  # too few rows with a time: the others follow
        return recent_anomalies(read_anomalies(spark, path), newest_first, retained=retained, **limits)
    files = index.filter(F.col("last_ts") >= F.lit(since)).select(F.concat(F.lit(f"{path}/run_id="), "run_id", F.lit("/"), "file_name").alias("file"))
    names = [row["file"] for row in files.toLocalIterator()]
    newest = spark.read.option("basePath", path).parquet(*names).filter(F.col("event_ts") >= F.lit(since))
    return recent_anomalies(newest, newest_first, retained=retained, **limits)


def recent_anomalies(
    anomalies: DataFrame,
    newest_first: list[str],
    limit: int = fv.RECENT_LIMIT,
    min_score: float | None = None,
    retained: int = fv.MAX_STORED_ANOMALIES,
) -> DataFrame:
    """The newest retained anomalies, then those of at least ``min_score``, then ``limit``.

    Each limit is a top-N over sorted columns, so no task holds more than N rows.
    """
    if not 1 <= limit <= fv.RECENT_LIMIT_MAX:
        raise ValueError(f"limit must be between 1 and {fv.RECENT_LIMIT_MAX}")
    if min_score is not None and not 0.0 <= min_score <= 1.0:
        raise ValueError("min_score must be between 0 and 1")
    order = [F.desc(name) for name in newest_first]
    kept = anomalies.orderBy(*order).limit(retained)
    if min_score is not None:
        kept = kept.filter(F.col("anomaly_score") >= min_score)
    return kept.orderBy(*order).limit(limit)
