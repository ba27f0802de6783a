"""Column layouts shared by every job."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_FIELDS = [
    ("event_ts", T.TimestampType()),
    ("event_local", T.TimestampNTZType()),
    ("utc_offset", T.StringType()),
    ("host", T.StringType()),
    ("service", T.StringType()),
    ("remote_addr", T.StringType()),
    ("remote_user", T.StringType()),
    ("method", T.StringType()),
    ("path", T.StringType()),
    ("protocol", T.StringType()),
    ("status", T.IntegerType()),
    ("bytes_sent", T.LongType()),
    ("referrer", T.StringType()),
    ("user_agent", T.StringType()),
    ("request_time", T.DoubleType()),
    ("request_length", T.LongType()),
    ("x_forwarded_for", T.StringType()),
    ("message", T.StringType()),
    ("level", T.StringType()),
    ("attributes", T.VariantType()),
]
EVENT_COLUMNS = [name for name, _ in EVENT_FIELDS]
EVENT_SCHEMA = T.StructType([T.StructField(name, kind, True) for name, kind in EVENT_FIELDS])

TECHNIQUE = T.StructType(
    [
        T.StructField("technique_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("tactic", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)
TECHNIQUES = T.ArrayType(TECHNIQUE)

# Column order of a stored anomaly.
ANOMALY_COLUMNS = [
    "timestamp",
    "level",
    "message",
    "host",
    "service",
    "remote_addr",
    "remote_user",
    "method",
    "path",
    "protocol",
    "status",
    "bytes_sent",
    "referrer",
    "user_agent",
    "request_time",
    "request_length",
    "x_forwarded_for",
    "attributes",
    "anomaly_score",
    "model_version",
    "mitre_techniques",
]
