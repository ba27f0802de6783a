from __future__ import annotations

import pytest

from helpers import event_frame
from logsieve import fixed_values as fv
from logsieve.operators.rules import classify_techniques, technique_catalog, technique_hits
from pyspark.sql import functions as F

POSITIVE = [
    ({"path": "/%2E%2e/etc"}, "path_traversal"),
    ({"path": "/..\\x"}, "path_traversal"),
    ({"path": "/s?q=1 UNION  SELECT 2"}, "sql_injection"),
    ({"path": "/s?q=SELECT a FROM b"}, "sql_injection"),
    ({"path": "/p?x=%3CSCRIPT"}, "xss"),
    ({"user_agent": "<script>"}, "xss"),
    ({"path": "/p?c=; cat x"}, "command_injection"),
    ({"path": "/p?c=`id`"}, "command_injection"),
    ({"path": "/c99.php"}, "webshell"),
    ({"path": "/f?u=http://172.20.0.1"}, "ssrf"),
    ({"user_agent": "${jndi:ldap}"}, "log4shell"),
    ({"path": "/.git/HEAD"}, "sensitive_path"),
    ({"path": "/WP-ADMIN"}, "scanner_path"),
    ({"user_agent": "Nikto/2"}, "scanner_agent"),
    ({"user_agent": "my crawler"}, "bot_agent"),
    ({"method": "delete", "status": 405}, "write_method_error"),
    ({"status": 403}, "auth_failure"),
    ({"status": 503}, "server_error"),
]


def test_each_rule(spark):
    events = event_frame(spark, *[row for row, _ in POSITIVE])
    hits = {(row["n"], row["rule"]) for row in technique_hits(events, "n").collect()}
    assert all((at, rule) in hits for at, (_, rule) in enumerate(POSITIVE))


def test_clean_and_plus_signs(spark):
    events = event_frame(
        spark,
        {"path": "/api/v1/users/42", "status": 200, "method": "GET", "user_agent": "Mozilla/5.0"},
        {"path": "/q?x=or+1=1"},
        {"user_agent": "scrapy bot"},
    )
    rows = classify_techniques(events).orderBy("n").collect()
    assert rows[0]["mitre_techniques"] == [] and rows[1]["mitre_techniques"] == []
    assert [t["technique_id"] for t in rows[2]["mitre_techniques"]] == ["T1595.002"]


def test_dedup_rank_and_guard(spark):
    events = event_frame(
        spark,
        {"path": "/../x?q=%27;cat /c99", "status": 403, "user_agent": "sqlmap"},
        {"path": "/c99?u=localhost"},
        {"path": "/../x"},
    )
    rows = classify_techniques(events, F.col("n") < 2).orderBy("n").collect()
    first = [(t["technique_id"], t["confidence"]) for t in rows[0]["mitre_techniques"]]
    assert first == [("T1190", 0.95), ("T1059.004", 0.9), ("T1505.003", 0.85), ("T1595.002", 0.8), ("T1110", 0.4)]
    assert [t["technique_id"] for t in rows[1]["mitre_techniques"]] == ["T1505.003", "T1190"]
    assert rows[2]["mitre_techniques"] == []


def test_catalog(spark):
    rows = technique_catalog(spark).collect()
    assert len({row["technique_id"] for row in rows}) == 16 == len(fv.TECHNIQUE_CATALOG)
    assert all(row["name"] and row["tactic"] for row in rows)


@pytest.mark.parametrize("text", ["UNİON SELECT", "ſleep(1)"])
def test_case_folding_of_unicode(spark, text):
    import re

    rows = [
        row["rule"] for row in technique_hits(event_frame(spark, {"path": text}), "n").collect()]
    assert ("sql_injection" in rows) == bool(re.search(fv.SQL_INJECTION, text, re.IGNORECASE))
