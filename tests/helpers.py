"""Small event tables for tests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsieve.schema import EVENT_FIELDS

AT = datetime(2026, 3, 10, 14, 30)


def event_frame(spark: SparkSession, *rows: dict) -> DataFrame:
    """Events with the given fields, the others null; ``n`` is the row's position."""
    names = [name for name, _ in EVENT_FIELDS if name != "attributes"]
    kinds = [kind.simpleString() for name, kind in EVENT_FIELDS if name != "attributes"]
    schema = "n int, " + ", ".join(f"{name} {kind}" for name, kind in zip(names, kinds))
    defaults = {"event_ts": AT, "event_local": AT, "utc_offset": "+00:00", "message": "", "level": "INFO"}
    values = [
        (at, *[{**defaults, **row}.get(name) for name in names]) for at, row in enumerate(rows)
    ]
    frame = spark.createDataFrame(values, schema)
    return frame.withColumn("attributes", F.parse_json(F.lit("{}")))


def line_frame(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lines)), "n int, value string")
