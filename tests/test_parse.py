from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from helpers import line_frame
from logsieve.functions import times
from logsieve.operators.parse import java_pattern, parse_access_logs, split_rejects
from logsieve.options import JobOptions, merge_mapping, path_list

STAMP = "2026-03-10T12:00:00+00:00"


def parsed(spark, lines, fmt="jsonl", **options):
    texts = [line if isinstance(line, str) else json.dumps(line) for line in lines]
    rows = parse_access_logs(line_frame(spark, texts), fmt, mode="keep", **options)
    rows = rows.withColumn("attributes", F.to_json("attributes"))
    return {row["n"]: row for row in rows.collect()}


def test_json_rules(spark):
    cases = [
        {"url": "/basket/7?sort=up", "time": "2025-11-02T06:15:09Z", "responseTime": 1.75, "responseLength": 90210, "requestLength": 77,
         "xForwardedFor": "  -", "referer": "-", "userAgent": "probe/9", "statusCode": 304, "method": "HEAD", "host": "shop3",
         "remoteAddress": "2001:db8::17"},
        {"timestamp": "2026-03-10T08:00:00+03:00", "status": 404},
        {"timestamp": STAMP, "bytes_sent": 0, "request_time": 0.0},
        {"timestamp": STAMP, "bytes_sent": "0"},
        {"timestamp": STAMP, "responseLength": 0},
        {"timestamp": STAMP, "status": "12.7", "bytes_sent": "1e3"},
        {"timestamp": STAMP, "method": "-", "request": "POST /x HTTP/2.0"},
        {"timestamp": STAMP, "request": "POST /x HTTP/2.0"},
        {"timestamp": STAMP, "path": None, "uri": "/second"},
        {"timestamp": STAMP, "message": "", "level": "", "host": "", "service": ""},
        {"timestamp": STAMP, "attributes": {"k": [1, 2]}, "unknown": 5},
        {"timestamp": STAMP, "user": True, "status": True},
        {"timestamp": None, "time": "10/Mar/2026:08:00:00 -0130"},
        {"timestamp": "20260310T080000Z"},
        {"timestamp": "2026-03-10 08:00:00.123456789"},
        {"timestamp": 0},
        '{"timestamp":"%s","status":200,"status":500}' % STAMP,
        {"timestamp": STAMP, "client_ip": "1.2.3.4", "path": "/café　", "user_agent": " x "},
    ]
    rows = parsed(spark, cases)
    assert all(row["reject_reason"] is None for row in rows.values())
    first = rows[0]
    assert (first["remote_addr"], first["path"], first["status"], first["bytes_sent"]) == (
        "2001:db8::17", "/basket/7?sort=up", 304, 90210)
    assert (first["request_time"], first["request_length"]) == (1.75, 77)
    assert first["referrer"] is None and first["x_forwarded_for"] is None and first["service"] is None
    assert first["message"] == "HEAD /basket/7?sort=up" and first["level"] == "NOTICE"
    assert rows[1]["event_local"].hour == 8 and rows[1]["event_ts"].hour == 5
    assert rows[1]["utc_offset"] == "+03:00" and rows[1]["level"] == "WARNING"
    assert rows[1]["service"] == "nginx"
    assert rows[2]["bytes_sent"] is None and rows[2]["request_time"] is None
    assert rows[3]["bytes_sent"] == 0
    assert rows[4]["bytes_sent"] == 0
    assert (rows[5]["status"], rows[5]["bytes_sent"]) == (12, 1000)
    assert (rows[6]["method"], rows[6]["path"], rows[6]["protocol"]) == ("-", "/x", "HTTP/2.0")
    assert (rows[7]["method"], rows[7]["message"]) == ("POST", "POST /x HTTP/2.0")
    assert rows[8]["path"] == "/second"
    assert (rows[9]["service"], rows[9]["level"], rows[9]["message"]) == ("nginx", "INFO", "")
    assert json.loads(rows[10]["attributes"]) == {"k": [1, 2]}
    assert (rows[11]["remote_user"], rows[11]["status"]) == ("True", 1)
    assert (rows[12]["utc_offset"], str(rows[12]["event_ts"])) == ("-01:30", "2026-03-10 09:30:00")
    assert str(rows[13]["event_local"]) == "2026-03-10 08:00:00"
    assert rows[14]["event_local"].microsecond == 123456 and rows[14]["utc_offset"] is None
    assert str(rows[15]["event_ts"]) == "1970-01-01 00:00:00"
    assert rows[16]["status"] == 500
    assert (rows[17]["remote_addr"], rows[17]["path"], rows[17]["user_agent"]) == ("1.2.3.4", "/café", "x")


def test_json_rejects(spark):
    cases = {
        "not json": "not a JSON object",
        "[1]": "not a JSON object",
        '{"timestamp":"%s"} tail' % STAMP: "not a JSON object",
        '{"timestamp":"%s"},{"timestamp":"%s"}' % (STAMP, STAMP): "not a JSON object",
        '{"timestamp":"%s"}] }' % STAMP: "not a JSON object",
        "{'timestamp':'x'}": "not a JSON object",
        '{"method":"GET"}': "missing timestamp",
        '{"timestamp":"yesterday"}': "bad timestamp",
        '{"timestamp":"2026-02-30"}': "bad timestamp",
        '{"timestamp":"%s","status":"ok"}' % STAMP: "bad status",
        '{"timestamp":"%s","bytes_sent":"1d"}' % STAMP: "bad bytes_sent",
        '{"timestamp":"%s","request_time":"0x1"}' % STAMP: "bad request_time",
        '{"timestamp":"%s","request_length":[1]}' % STAMP: "bad request_length",
        '{"timestamp":"%s","method":5}' % STAMP: "method is not text",
        '{"timestamp":"%s","host":7}' % STAMP: "host is not text",
        '{"timestamp":"%s","message":7}' % STAMP: "message is not text",
        '{"timestamp":"%s","attributes":[]}' % STAMP: "attributes is not an object",
    }
    rows = parsed(spark, list(cases))
    assert [rows[at]["reject_reason"] for at in range(len(cases))] == list(cases.values())


def test_custom_mapping(spark):
    mapping = {"status": ["outcome", ""], "method": "verb", "timestamp": ["seen_at"]}
    rows = parsed(
        spark,
        [
            {"verb": "PATCH", "outcome": 409, "seen_at": STAMP, "path": "/stock/12"},
            {"verb": "PUT", "method": "GET", "status": 409, "outcome": 206, "seen_at": STAMP},
            {"verb": "PUT", "outcome": 206, "timestamp": STAMP},
        ],
        mapping=mapping,
    )
    assert (rows[0]["method"], rows[0]["path"], rows[0]["status"]) == ("PATCH", "/stock/12", 409)
    assert rows[1]["status"] == 206
    merged = merge_mapping(mapping)
    assert merged["method"] == ["verb"] and merged["status"] == ["outcome"]
    assert merged["user_agent"] == merge_mapping(None)["user_agent"] != []


GOOD = '203.0.113.9 - kim [07/Nov/2025:23:05:41 -0330] "POST /orders/88/pay HTTP/2.0" 202 4711 "https://till.example/cart" "pos/3.1" 2.25'


def test_plain_lines(spark):
    lines = [
        GOOD,
        '10.0.0.1 - - [10/Mar/2026:12:00:00 +0000] "GET /m HTTP/1.1" 404 - "-" "UA"',
        '10.0.0.1 - - [10/Mar/2026:12:00:00 +0000] "-" 500 0 "-" "-"',
        "  ",
        "nonsense",
        '10.0.0.1 - - [10/Mar/2026:12:00:00 +0000] "GET /m" 200 9 "-" "a\u0001b" 0.5',
        '10.0.0.1 - - [10/Mar/2026:12:00:00 +0000] "GET /m" 200 9 "-" "a" 1.2.3',
        "10.0.0.1 - é [32/Mar/2026:12:00:00 +0000] \"GET /m\" 200 9 \"-\" \"a\"",
    ]
    rows = parsed(spark, lines, "plain")
    assert 3 not in rows
    good = rows[0]
    assert (good["remote_user"], good["method"], good["protocol"], good["bytes_sent"], good["request_time"]) == (
        "kim", "POST", "HTTP/2.0", 4711, 2.25)
    assert (good["event_local"].hour, str(good["event_ts"]), good["service"]) == (23, "2025-11-08 02:35:41", "nginx")
    assert (rows[1]["level"], rows[1]["bytes_sent"], rows[1]["remote_user"]) == ("WARNING", None, None)
    assert (rows[2]["level"], rows[2]["method"], rows[2]["message"]) == ("ERROR", None, "")
    assert rows[4]["reject_reason"] == "no pattern matches"
    assert rows[5]["user_agent"] == "a\u0001b" and rows[5]["protocol"] is None
    assert rows[6]["reject_reason"] == "bad request_time"
    assert rows[7]["reject_reason"] == "bad timestamp"


def test_pattern_list(spark):
    patterns = [
        r"(?P<status>\d{3}) (?P<q>['|])(?P<request>[^'|]*)(?P=q) (?P<time_local>\S+)",
        r"(?P<time_local>\S+) (?P<remote_addr>\S+)",
    ]
    rows = parsed(spark, ["503 'GET /z' 2026-03-10T01:00:00Z", "2026-03-10T01:00:00Z 9.9.9.9 rest"], "plain", patterns=patterns)
    assert (rows[0]["status"], rows[0]["path"], rows[0]["remote_addr"]) == (503, "/z", None)
    assert (rows[1]["remote_addr"], rows[1]["status"]) == ("9.9.9.9", None)
    with pytest.raises(ValueError):
        java_pattern(r"(?P<status>\d+)")


def test_modes(spark):
    lines = line_frame(spark, [GOOD, "", "broken"])
    assert parse_access_logs(lines, "plain").count() == 1
    with pytest.raises(Exception, match="no pattern matches: broken"):
        parse_access_logs(lines, "plain", mode="failfast").collect()
    events, rejects = split_rejects(parse_access_logs(lines, "plain", mode="keep"))
    assert events.count() == 1
    assert [(row["value"], row["reject_reason"]) for row in rejects.collect()] == [("broken", "no pattern matches")]
    with pytest.raises(ValueError, match="Unsupported format"):
        parse_access_logs(lines, "xml")


def test_options():
    assert path_list('["a", " b "]') == ["a", "b"]
    assert path_list("a, b\nc,") == ["a", "b", "c"]
    assert path_list("") == path_list(None) == path_list(()) == []
    assert path_list(["x ", "", 7]) == ["x", "7"]
    for wrong in ('{"a": 1}', 5):
        with pytest.raises((TypeError, ValueError)):
            path_list(wrong if isinstance(wrong, int) else f"[{wrong}")
    with pytest.raises(ValueError):
        JobOptions(source_format="xml")
    with pytest.raises(ValueError):
        JobOptions(ingest_batch_size=0)


def test_filters_stop_at_the_parser(spark):
    events = parse_access_logs(line_frame(spark, [GOOD]), "plain").filter("status >= 200 AND method = 'POST'")
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate")]
    assert "status" in above and plan.count("Filter") == 1


def test_week_dates(spark):
    from datetime import datetime

    texts = [
        "2024-W03-2T10:11:12+00:00", "2024W032T101112", "2024-W03", "2024W03", "2020-W53-7T01:02:03+02:00", "2015-W01T10:00",
        "2025-W01-1T00:00", "2026-W01-4T23:59:59.123456-05:00", "2024-W01-1 00:00", "2021-W53-1", "2024-W00-1", "2024-W01-8",
        "2024-W01-0", "2024-W5-1", "2024-W03-2x",
    ]
    rows = parsed(spark, [{"timestamp": text} for text in texts])
    for at, text in enumerate(texts):
        try:
            expected = datetime.fromisoformat(text).replace(tzinfo=None)
        except ValueError:
            expected = None
        assert rows[at]["event_local"] == expected, text
        assert rows[at]["reject_reason"] == (None if expected else "bad timestamp"), text


def test_each_key_is_shown_once(spark):
    """The JSON text of a key is made in one place of the plan, however often it is read."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        parsed = parse_access_logs(spark.createDataFrame([('{"a": 1}',)], "value string"), "jsonl", mode="keep")
        plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    shown = set(re.findall(r"AS (_shown\d+)#", plan))
    assert shown and len(re.findall(r"to_json|StructsToJson", plan)) <= len(shown)


def test_times_in_the_usual_form_are_cut_out(spark):
    """The usual form gives the pieces of the pattern; others, one space more or a line end, still go through it."""
    usual = "27/Jan/2024:11:04:31 -0530"
    pieces = ["", "2024", "Jan", "27", "11", "04", "31", "0", "-0530"]
    texts = [usual, usual.replace(" ", "  "), usual.replace(" ", "\t"), usual + "\n", "7" + usual[2:], usual.replace("Jan", "J4n"), "2024-01-27T11:04:31-05:30", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", times.time_pieces(F.col("text")).alias("p"))
    rows = frame.select("i", "p", times.offset_text(F.col("p")).alias("offset")).orderBy("i").collect()
    assert [r["p"] for r in rows[:3]] == [pieces] * 3
    assert rows[3]["p"] == [*pieces[:-1], "-0530\n"] and rows[4]["p"] == [*pieces[:3], "7", *pieces[4:]]
    assert [r["offset"] for r in rows] == ["-05:30"] * 5 + [None, "-05:30", None]
    shown = times.offset_text(F.col("p"))
    assert "regexp" not in frame.select(shown)._jdf.queryExecution().analyzed().toString().split("Project")[1]
