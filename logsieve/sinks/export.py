"""Events written back as log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import clf_text, iso_text
from ..functions.values import three_decimals

# Keys of an exported JSON line, in order.
JSON_KEYS = [
    "timestamp", "host", "service", "remote_addr", "remote_user", "method", "path", "protocol",
    "status", "bytes_sent", "referrer", "user_agent", "request_time", "request_length",
    "x_forwarded_for", "message", "level", "attributes",
]


def _or_dash(name: str) -> Column:
    return F.when(F.col(name) != "", F.col(name)).otherwise("-")


def plain_lines(events: DataFrame, *kept: str) -> DataFrame:
    """Combined-format ``value``: dash for null text, 0 for null numbers."""
    parts = [F.when(F.col(name) != "", F.col(name)) for name in ("method", "path", "protocol")]
    request = F.concat_ws(" ", *parts)
    value = F.format_string(
        '%s - %s [%s] "%s" %d %d "%s" "%s" %s',
        _or_dash("remote_addr"),
        _or_dash("remote_user"),
        clf_text(F.col("event_local"), F.col("utc_offset")),
        request,
        F.coalesce(F.col("status"), F.lit(0)),
        F.coalesce(F.col("bytes_sent"), F.lit(0)),
        _or_dash("referrer"),
        _or_dash("user_agent"),
        three_decimals(F.coalesce(F.col("request_time"), F.lit(0.0))),
    )
    return events.select(*kept, value.alias("value"))


def json_lines(events: DataFrame, *kept: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """One JSON object per event as ``value``, nulls kept, ISO timestamp."""
    stamp = iso_text(F.col("event_local"), F.col("utc_offset")).alias("timestamp")
    fields = [stamp, *JSON_KEYS[1:]]
    labels = [column.alias(name) for name, column in (extra or {}).items()]
    value = F.to_json(F.struct(*labels, *fields), {"ignoreNullFields": "false"})
    return events.select(*kept, value.alias("value"))


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists", compression: str | None = None) -> None:
    lines.select("value").write.mode(mode).text(path, compression=compression)


def write_labelled_set(clean: DataFrame, attacks: DataFrame, mixed: DataFrame, path: str, key: str) -> None:
    """The three files of a labelled set as JSON lines below ``path``: clean and attacks by key, and the shuffled mix.

    Every line of the last two carries its ``_label``. A rerun replaces the set; the mix, which readers
    take as a whole, is replaced last. The files are compressed by gzip, as a line repeats the keys of all others;
    line readers unpack them.
    """
    own = F.when(F.col("label") != "clean", F.col("label"))
    for name, rows, labels, order in (
        ("clean", clean, None, [key]), ("attacks", attacks, {"_label": F.col("label")}, [key]), ("mixed", mixed, {"_label": own}, ["mix_order", key]),
    ):
        lines = json_lines(rows.orderBy(*order), extra=labels)
        write_lines(lines, f"{path}/{name}", mode="overwrite", compression="gzip")
