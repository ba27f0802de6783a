from __future__ import annotations

import hashlib
import math
from datetime import datetime
from urllib.parse import urlparse

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import event_frame
from logsieve import fixed_values as fv
from logsieve.functions import text
from logsieve.functions.values import three_decimals
from logsieve.operators.features import extract_features, feature_moments, scale_features


def evaluate(spark, values, build, kind="string"):
    rows = [(at, value) for at, value in enumerate(values)]
    frame = spark.createDataFrame(rows, f"n int, v {kind}").repartition(2)
    return [row["out"] for row in frame.select("n", build(F.col("v")).alias("out")).orderBy("n").collect()]


def test_path_templates(spark):
    paths = ["/items/123?x=1", "/o/a1b2c3d4e5f6", "/o/123456", "/v1/12", "", "/", "/٤٢/é 7"]
    assert evaluate(spark, paths, text.path_template) == [
        "/items/<NUM>", "/o/<HEX>", "/o/<HEX>", "/v1/<NUM>", "", "/", "/<NUM>/é <NUM>"]


def test_message_templates(spark):
    messages = [
        "from 192.168.1.1 port 22",
        "id=550e8400-e29b-41d4-a716-446655440000 0xdeadbeef took 9",
    ]
    assert evaluate(spark, messages, text.message_template) == [
        "from <IP> port <NUM>", "id=<UUID> <HEX> took <NUM>"]


def test_extensions_and_domains(spark):
    assert evaluate(spark, ["/a/app.JS?v=2.0", "/a.b/c", "/x", "/."], text.path_extension) == [
        ".js", ".b/c", "", "."]
    referrers = ["https://e.com:8080/p?q", "//cdn.x/y", "plain text", "-", "", None, "mailto:a@b", "http://a b|c/x"]
    expected = ["" if not r or r == "-" else (urlparse(r).netloc or r) for r in referrers]
    assert evaluate(spark, referrers, text.referrer_domain) == expected


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=30), min_size=1, max_size=40))
def test_hash_and_strip_match_python(spark, values):
    hashed = evaluate(spark, values, text.hash_bucket)
    expected = [
        int(hashlib.md5(v.encode()).hexdigest(), 16) % 1000 / 1000 if v else 0.0 for v in values
    ]
    assert hashed == expected
    assert evaluate(spark, values, text.strip) == [v.strip() for v in values]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 10**7).map(lambda n: n / 10**4), min_size=1, max_size=60))
def test_three_decimals_match_python(spark, values):
    assert evaluate(spark, values, three_decimals, "double") == [f"{v:.3f}" for v in values]


def test_feature_values(spark):
    saturday = datetime(2026, 3, 14, 6)
    events = event_frame(
        spark,
        {"method": "get", "path": "/static/app.JS?v=1", "status": 304, "bytes_sent": 1024, "request_time": 0.5,
         "request_length": 9, "remote_user": "bob", "message": "hello", "user_agent": "Googlebot",
         "event_local": saturday},
        {},
        {"method": "BREW", "path": "/../.env?q=UNION", "status": 99},
    )
    rows = extract_features(events, "n").orderBy("n").collect()
    first = rows[0]
    assert [first[name] for name in ("status_code", "status_class", "method_code", "path_length", "path_depth",
                                     "path_tokens", "has_query", "is_static")] == [304, 3, 0, 18, 2, 2, 1, 1]
    assert first["bytes_log1p"] == math.log1p(1024) and first["request_length_log1p"] == math.log1p(9)
    assert (first["hour"], first["weekday"], first["is_weekend"]) == (6, 5, 1)
    assert abs(first["hour_sin"] - 1.0) < 1e-12
    assert (first["has_user"], first["user_length"], first["message_length"], first["bot_ua"]) == (1, 3, 5, 1)
    assert all(rows[1][name] is not None for name in fv.FEATURE_NAMES)
    assert (rows[2]["method_code"], rows[2]["suspicious_path"], rows[2]["sql_keyword"], rows[2]["status_class"]) == (
        -1, 1, 1, 0)


def test_scaler(spark):
    events = event_frame(spark, *[{"status": s, "path": "/x" * s} for s in (1, 2, 3, 6)])
    features = extract_features(events)
    scaled = scale_features(features, feature_moments(features)).toPandas()
    assert np.allclose(scaled["path_length"].mean(), 0) and np.allclose(scaled["path_length"].std(ddof=0), 1)
    assert np.allclose(scaled["has_user"], 0)
