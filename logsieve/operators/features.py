"""The 26 request features, one double column each."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.text import (
    hash_bucket,
    path_extension,
    path_template,
    referrer_domain,
    searches,
)


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def method_code(method: Column) -> Column:
    """Number of a known method in any case, else -1."""
    codes = F.create_map(*[F.lit(item) for pair in fv.METHOD_CODES.items() for item in pair])
    return F.coalesce(F.try_element_at(codes, F.upper(method)), F.lit(-1))


def feature_columns(path_template_of: Column | None = None) -> dict[str, Column]:
    """Feature name -> expression over the event columns, in vector order."""
    path = F.coalesce(F.col("path"), F.lit(""))
    agent = F.coalesce(F.col("user_agent"), F.lit(""))
    user = F.coalesce(F.col("remote_user"), F.lit(""))
    status = F.coalesce(F.col("status"), F.lit(0))
    hour = F.hour("event_local")
    weekday = F.weekday("event_local")
    radians = 2 * math.pi * hour / 24.0

    def log1p(name: str) -> Column:
        return F.log1p(F.coalesce(F.col(name), F.lit(0)))

    values = {
        "status_code": status,
        "status_class": F.floor(status / 100),
        "method_code": method_code(F.col("method")),
        "path_length": F.length(path),
        "path_depth": F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))),
        "path_tokens": F.size(F.array_remove(F.split(path, "/"), "")),
        "has_query": _flag(F.contains(path, F.lit("?"))),
        "is_static": _flag(path_extension(path).isin(fv.STATIC_EXTENSIONS)),
        "bytes_log1p": log1p("bytes_sent"),
        "request_time_log1p": log1p("request_time"),
        "referrer_hash": hash_bucket(referrer_domain(F.col("referrer"))),
        "user_agent_hash": hash_bucket(agent),
        "ip_hash": hash_bucket(F.col("remote_addr")),
        "hour": hour,
        "hour_sin": F.sin(radians),
        "hour_cos": F.cos(radians),
        "weekday": weekday,
        "is_weekend": _flag(weekday >= 5),
        "has_user": _flag(user != ""),
        "user_length": F.length(user),
        "message_length": F.length(F.coalesce(F.col("message"), F.lit(""))),
        "suspicious_path": _flag(searches(path, fv.SUSPICIOUS_PATH)),
        "sql_keyword": _flag(searches(path, fv.SQL_KEYWORD)),
        "bot_ua": _flag(searches(agent, fv.BOT_AGENT)),
        "path_template_hash": hash_bucket(
            path_template(path) if path_template_of is None else path_template_of
        ),
        "request_length_log1p": log1p("request_length"),
    }
    return {name: values[name].cast("double") for name in fv.FEATURE_NAMES}


def extract_features(events: DataFrame, *kept: str) -> DataFrame:
    """The feature columns, with the named event columns in front."""
    columns = feature_columns()
    return events.select(*kept, *[column.alias(name) for name, column in columns.items()])


def feature_moments(features: DataFrame) -> DataFrame:
    """One row per feature: mean, population deviation, scale to divide by, row count."""
    names = fv.FEATURE_NAMES
    wide = features.agg(
        F.count("*").alias("n"),
        *[F.avg(name).alias(f"mean_{name}") for name in names],
        *[F.stddev_pop(name).alias(f"std_{name}") for name in names],
    )
    rows = [
        F.struct(
            F.lit(index).alias("position"),
            F.lit(name).alias("feature"),
            F.col(f"mean_{name}").alias("mean"),
            F.col(f"std_{name}").alias("std"),
            F.col("n").alias("n"),
        )
        for index, name in enumerate(names)
    ]
    scale = F.when(F.col("std") > 0, F.col("std")).otherwise(1.0)
    return wide.select(F.inline(F.array(*rows))).withColumn("scale", scale)


def scale_features(features: DataFrame, moments: DataFrame) -> DataFrame:
    """Features minus mean over scale; the 26 moments are literals of the plan."""
    known = {row["feature"]: (row["mean"], row["scale"]) for row in moments.collect()}
    return features.withColumns(
        {name: (F.col(name) - mean) / scale for name, (mean, scale) in known.items()}
    )
