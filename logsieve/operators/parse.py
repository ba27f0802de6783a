"""Raw lines to typed events, with the reason of every rejected line."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fv
from ..functions import times
from ..functions.text import clean_all, group, match_groups, strip
from ..functions.values import JsonValue, first_truthy, text_to_double, text_to_long
from ..options import check_format, merge_mapping
from ..schema import EVENT_COLUMNS, EVENT_FIELDS

MODES = ("keep", "drop", "failfast")
_BLANK = "blank line"
_END = "__logsieve_end__"
_PLAIN_GROUPS = [
    "remote_addr",
    "remote_user",
    "time_local",
    "request",
    "status",
    "bytes_sent",
    "referrer",
    "user_agent",
    "request_time",
]
_PLAIN_CLEANED = [name for name in _PLAIN_GROUPS if name not in ("time_local", "request")]
_DASHED = ["remote_addr", "remote_user", "user_agent", "referrer", "x_forwarded_for"]
_WHOLE = ["status", "bytes_sent", "request_length"]
_TEXT_ONLY = ["method", "protocol", "host", "service", "message", "level"]


def status_level(status: Column) -> Column:
    return (
        F.when(status >= 500, "ERROR")
        .when(status >= 400, "WARNING")
        .when(status >= 300, "NOTICE")
        .otherwise("INFO")
    )


def request_parts(request: Column) -> Column:
    """``match_groups`` array of method, path and protocol of a request line."""
    return match_groups(request, fv.REQUEST_LINE, [1, 2, 3])


def build_message(method: Column, path: Column, protocol: Column, request: Column) -> Column:
    """The request line, or else its non-empty parts."""
    parts = [F.when(part != "", part) for part in (method, path, protocol)]
    return F.when(~request.isin("", "-"), request).otherwise(F.concat_ws(" ", *parts))


def source_name(host: Column, service: Column) -> Column:
    """Host, else service, else ``unknown``."""
    return F.coalesce(F.nullif(host, F.lit("")), F.nullif(service, F.lit("")), F.lit("unknown"))


def nonblank_lines(lines: DataFrame) -> DataFrame:
    """Stripped lines; blank ones dropped."""
    return lines.withColumn("value", strip(F.col("value"))).filter(F.col("value") != "")


def java_pattern(pattern: str) -> tuple[str, dict[str, int]]:
    """Pattern without group names for the JVM, and the number of each group."""
    numbers = dict(re.compile(pattern).groupindex)
    if "time_local" not in numbers:
        raise ValueError("a plain pattern needs a group named time_local")

    def rewrite(found: re.Match[str]) -> str:
        if found.group("back"):
            return f"\\{numbers[found.group('back')]}"
        return "(" if found.group("name") else found.group(0)

    unnamed = re.sub(r"\\.|\(\?P<(?P<name>\w+)>|\(\?P=(?P<back>\w+)\)", rewrite, pattern, flags=re.S)
    return unnamed, numbers


def _reasons(checks: Sequence[tuple[str, Column]]) -> Column:
    """The first failed check by name, null when all pass."""
    name, failed = checks[0]
    chain = F.when(failed, name)
    for name, failed in checks[1:]:
        chain = chain.when(failed, name)
    return chain


def _to_events(df: DataFrame, kept: Sequence[str], columns: Mapping[str, Column]) -> DataFrame:
    """Event columns and ``reject_reason``, put out through a one-row generator.

    The generator is where later filters stop: pushed further down they would be
    rewritten in terms of the raw line and parse every line a second time.
    """
    typed = [
        columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in EVENT_FIELDS
    ]
    reason = F.when(F.col("value") == "", _BLANK).otherwise(columns["reject_reason"])
    row = F.struct(*typed, reason.alias("reject_reason"))
    return df.select(*kept, row.alias("_row")).select(*kept, F.inline_outer(F.array("_row")))


def _parse_plain(lines: DataFrame, patterns: Sequence[str]) -> DataFrame:
    kept = lines.columns
    compiled = [java_pattern(pattern) for pattern in patterns]
    matches = {}
    for index, (pattern, numbers) in enumerate(compiled):
        known = [numbers[name] for name in _PLAIN_GROUPS if name in numbers]
        matches[f"_m{index}"] = match_groups(F.col("value"), pattern, known)
    df = lines.withColumns(matches)

    def raw(name: str) -> Column:
        """The named group of the first pattern that matches."""
        chain = F
        for index, (_, numbers) in enumerate(compiled):
            matched = F.col(f"_m{index}")
            order = [known for known in _PLAIN_GROUPS if known in numbers]
            value = group(matched, order.index(name) + 1) if name in order else F.lit(None)
            chain = chain.when(F.size(matched) > 1, value)
        return chain.otherwise(None)

    any_match = F.greatest(*[F.size(name) for name in matches], F.lit(0)) > 1
    request = F.col("_request")
    df = df.select(
        *kept,
        clean_all([raw(name) for name in _PLAIN_CLEANED]).alias("_clean"),
        raw("request").alias("_request"),
        raw("time_local").alias("_time"),
        any_match.alias("_matched"),
    )

    def cleaned(name: str) -> Column:
        return F.get("_clean", F.lit(_PLAIN_CLEANED.index(name)))

    df = df.withColumns(
        {
            "_parts": request_parts(request),
            "_pieces": times.time_pieces(F.col("_time")),
            "_status_n": text_to_long(cleaned("status")).try_cast("int"),
            "_bytes_n": text_to_long(cleaned("bytes_sent")),
            "_time_n": text_to_double(cleaned("request_time")),
        }
    )
    df = df.withColumns(
        {
            "_local": times.local_time(F.col("_pieces")),
            "_offset": times.offset_text(F.col("_pieces")),
        }
    )
    method, path, protocol = (group(F.col("_parts"), index) for index in (1, 2, 3))
    status = F.col("_status_n")

    def bad(name: str, number: str) -> Column:
        return cleaned(name).isNotNull() & F.col(number).isNull()

    columns = {
        "event_ts": times.absolute_time(F.col("_local"), F.col("_offset")),
        "event_local": F.col("_local"),
        "utc_offset": F.col("_offset"),
        "service": F.lit(fv.DEFAULT_SERVICE),
        "method": method,
        "path": path,
        "protocol": protocol,
        "status": status,
        "bytes_sent": F.col("_bytes_n"),
        "request_time": F.col("_time_n"),
        "message": build_message(method, path, protocol, request),
        "level": status_level(status),
        "attributes": F.parse_json(F.lit("{}")),
        "reject_reason": _reasons(
            [
                ("no pattern matches", ~F.col("_matched")),
                ("bad timestamp", F.col("_local").isNull()),
                ("bad status", bad("status", "_status_n")),
                ("bad bytes_sent", bad("bytes_sent", "_bytes_n")),
                ("bad request_time", bad("request_time", "_time_n")),
            ]
        ),
    }
    for name in ("remote_addr", "remote_user", "referrer", "user_agent"):
        columns[name] = cleaned(name)
    return _to_events(df, kept, columns)


def _read_payload(lines: DataFrame, names: Sequence[str]) -> DataFrame:
    """Column ``_doc``: the wanted keys of the object as variants, null if malformed.

    One streaming pass reads only the wanted keys, keeps the last of duplicate
    keys and tells an absent key from a JSON null. The line is parsed inside an
    array with an end element behind it, so text after the object shows up as a
    missing or extra element.
    """
    fields = [T.StructField(name, T.VariantType()) for name in names]
    schema = T.ArrayType(T.StructType([*fields, T.StructField(_END, T.IntegerType())]))
    wrapped = F.concat(F.lit("["), F.col("value"), F.lit(f',{{"{_END}":1}}]'))
    parsed = lines.withColumn("_all", F.from_json(wrapped, schema, {"allowSingleQuotes": "false"}))
    whole = (
        (F.size("_all") == 2)
        & (F.get("_all", F.lit(1))[_END] == 1)
        & F.startswith(F.col("value"), F.lit("{"))
        & F.endswith(F.col("value"), F.lit("}"))
    )
    return parsed.withColumn("_doc", F.when(whole, F.get("_all", F.lit(0)))).drop("_all")


def _parse_jsonl(lines: DataFrame, mapping: Mapping[str, Sequence[str]]) -> DataFrame:
    """Variants are tagged once per key; aliases and chains choose among the tags.

    The later rules go through arrays, which keeps the generated code small.
    """
    kept = lines.columns
    chain_names = [name for chain in fv.TRUTHY_CHAINS.values() for name in chain]
    needed = list(dict.fromkeys([*fv.JSON_FIELD_MAPPING, *chain_names, "attributes"]))
    aliases = {name: list(dict.fromkeys([*mapping.get(name, []), name])) for name in needed}
    keys = list(dict.fromkeys(key for name in needed for key in aliases[name]))
    df = _read_payload(lines, keys)

    df = df.select(
        *kept,
        F.col("_doc").isNotNull().alias("_object"),
        F.coalesce(*[F.col("_doc").getField(key) for key in aliases["attributes"]]).alias("_attributes"),
        *[F.col("_doc").getField(key).alias(f"_value{at}") for at, key in enumerate(keys)],
        *[F.to_json(F.col("_doc").getField(key)).alias(f"_shown{at}") for at, key in enumerate(keys)],
    )
    tags = [JsonValue.tag(F.col(f"_value{at}"), F.col(f"_shown{at}")).alias(f"_tag{at}") for at in range(len(keys))]
    df = df.select(*kept, "_object", "_attributes", *tags)

    def own(name: str) -> Column:
        """The first alias that is present, be it null."""
        return F.coalesce(*[F.col(f"_tag{keys.index(key)}") for key in aliases[name]])

    # An absent path is filled from the request line before its chain is read.
    chains = {**fv.TRUTHY_CHAINS, "path": fv.TRUTHY_CHAINS["path"][1:]}
    order = list(chains)
    picks = [first_truthy([own(link) for link in chain]) for chain in chains.values()]
    singles = [*_TEXT_ONLY, "request", "attributes", "path", "timestamp"]
    df = df.select(
        *kept,
        "_object",
        "_attributes",
        *[column.alias(f"_pick_{name}") for name, column in zip(order, picks)],
        *[own(name).alias(f"_own_{name}") for name in singles],
    )

    def picked(name: str) -> Column:
        return F.col(f"_pick_{name}")

    def single(name: str) -> Column:
        return F.col(f"_own_{name}")

    texts = [*[picked(name) for name in _DASHED], single("request")]
    numbers = [picked(name) for name in (*_WHOLE, "request_time")]
    only = [single(name) for name in _TEXT_ONLY]
    df = df.select(
        *kept,
        "_object",
        "_attributes",
        single("attributes").alias("_attributes_tag"),
        single("path").alias("_path_tag"),
        single("timestamp").alias("_timestamp_tag"),
        picked("path").alias("_path_pick"),
        picked("timestamp").alias("_timestamp_pick"),
        F.transform(F.array(*texts), lambda tag: JsonValue(tag).as_text).alias("_texts"),
        F.transform(F.array(*numbers), lambda tag: JsonValue(tag).holds_something).alias("_given"),
        F.transform(F.array(*numbers[:-1]), lambda tag: JsonValue(tag).as_long).alias("_longs"),
        JsonValue(numbers[-1]).as_double.alias("_seconds"),
        F.transform(F.array(*only), lambda tag: JsonValue(tag).as_text).alias("_only"),
        F.transform(F.array(*only), lambda tag: JsonValue(tag).truthy).alias("_filled"),
        F.transform(
            F.array(*only), lambda tag: ~JsonValue(tag).missing & ~JsonValue(tag).is_text
        ).alias("_wrong"),
        F.transform(F.array(*only), lambda tag: tag.isNull()).alias("_absent"),
    )

    def at(array: str, names: Sequence[str], name: str) -> Column:
        return F.get(array, F.lit(list(names).index(name)))

    stamp = JsonValue(F.col("_timestamp_pick"))
    df = df.withColumns(
        {
            "_clean": clean_all([F.get("_texts", F.lit(index)) for index in range(len(texts))]),
            "_pieces": times.time_pieces(stamp.as_text),
            "_status_n": at("_longs", _WHOLE, "status").try_cast("int"),
        }
    )
    request = at("_clean", [*_DASHED, "request"], "request")
    # The number zero is taken as an epoch second when no other key holds a time.
    zero = stamp.missing & JsonValue(F.col("_timestamp_tag")).is_number
    epoch_local, epoch_offset = times.epoch_start()
    df = df.withColumns(
        {
            "_parts": request_parts(request),
            "_no_time": stamp.missing & ~zero,
            "_local": F.when(zero, epoch_local).otherwise(times.local_time(F.col("_pieces"))),
            "_offset": F.when(zero, epoch_offset).otherwise(times.offset_text(F.col("_pieces"))),
        }
    )
    own_path = JsonValue(F.col("_path_tag"))
    from_request = group(F.col("_parts"), 2)
    path_text = (
        F.when(own_path.truthy, own_path.as_text)
        .when(own_path.absent & from_request.isNotNull(), from_request)
        .otherwise(JsonValue(F.col("_path_pick")).as_text)
    )

    def filled_in(name: str, part: int) -> Column:
        return F.when(at("_absent", _TEXT_ONLY, name), group(F.col("_parts"), part)).otherwise(
            at("_only", _TEXT_ONLY, name)
        )

    df = df.withColumns({"_method": filled_in("method", 1), "_protocol": filled_in("protocol", 3)})
    shown = clean_all([path_text, F.col("_method"), F.col("_protocol")])
    df = df.withColumn("_shown", shown)
    path, method_shown, protocol_shown = (F.get("_shown", F.lit(index)) for index in range(3))
    status = F.col("_status_n")

    def only_text(name: str) -> Column:
        return at("_only", _TEXT_ONLY, name)

    def filled(name: str) -> Column:
        return at("_filled", _TEXT_ONLY, name)

    def wrong(name: str) -> Column:
        return at("_wrong", _TEXT_ONLY, name)

    def bad_number(name: str, number: Column) -> Column:
        return at("_given", [*_WHOLE, "request_time"], name) & number.isNull()

    no_source = ~filled("host") & ~filled("service")
    message = build_message(method_shown, path, protocol_shown, request)
    columns = {
        "event_ts": times.absolute_time(F.col("_local"), F.col("_offset")),
        "event_local": F.col("_local"),
        "utc_offset": F.col("_offset"),
        "host": only_text("host"),
        "service": F.when(no_source, fv.DEFAULT_SERVICE).otherwise(only_text("service")),
        "method": F.col("_method"),
        "path": path,
        "protocol": F.col("_protocol"),
        "status": status,
        "bytes_sent": at("_longs", _WHOLE, "bytes_sent"),
        "request_time": F.col("_seconds"),
        "request_length": at("_longs", _WHOLE, "request_length"),
        "message": F.when(filled("message"), only_text("message")).otherwise(message),
        "level": F.when(filled("level"), only_text("level")).otherwise(status_level(status)),
        "attributes": F.coalesce(F.col("_attributes"), F.parse_json(F.lit("{}"))),
        "reject_reason": _reasons(
            [
                ("not a JSON object", ~F.col("_object")),
                ("missing timestamp", F.col("_no_time")),
                ("bad timestamp", F.col("_local").isNull()),
                ("bad status", bad_number("status", status)),
                ("bad bytes_sent", bad_number("bytes_sent", at("_longs", _WHOLE, "bytes_sent"))),
                ("bad request_time", bad_number("request_time", F.col("_seconds"))),
                (
                    "bad request_length",
                    bad_number("request_length", at("_longs", _WHOLE, "request_length")),
                ),
                ("method is not text", wrong("method")),
                ("protocol is not text", wrong("protocol")),
                ("host is not text", wrong("host")),
                ("service is not text", wrong("service") & ~no_source),
                ("message is not text", filled("message") & wrong("message")),
                ("level is not text", filled("level") & wrong("level")),
                (
                    "attributes is not an object",
                    F.col("_attributes_tag").isNotNull()
                    & ~JsonValue(F.col("_attributes_tag")).is_object,
                ),
            ]
        ),
    }
    for name in _DASHED:
        columns[name] = at("_clean", [*_DASHED, "request"], name)
    return _to_events(df, kept, columns)


def parse_access_logs(
    lines: DataFrame,
    fmt: str = "jsonl",
    mapping: Mapping[str, Sequence[str] | str] | None = None,
    patterns: Sequence[str] | None = None,
    mode: str = "drop",
) -> DataFrame:
    """Parse the ``value`` column of ``lines``; the other columns are carried along.

    ``keep`` returns every non-blank line with ``reject_reason`` (null for an
    event), ``drop`` returns the events, ``failfast`` makes the job fail on the
    first rejected line so that nothing is written.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    clean = lines.withColumn("value", strip(F.col("value")))
    if check_format(fmt) == "plain":
        parsed = _parse_plain(clean, list(patterns) if patterns else fv.PLAIN_PATTERNS)
    else:
        parsed = _parse_jsonl(clean, merge_mapping(mapping))
    reason = F.col("reject_reason")
    if mode == "drop":
        return parsed.filter(reason.isNull()).drop("reject_reason", "value")
    # Blank lines leave here, above the generator, for the same reason as the
    # filters of later steps.
    parsed = parsed.filter(reason.isNull() | (reason != _BLANK))
    if mode == "keep":
        return parsed
    failure = F.raise_error(F.concat(reason, F.lit(": "), F.col("value")))
    passes = F.when(reason.isNotNull(), failure.cast("boolean")).otherwise(True)
    return parsed.filter(passes).drop("reject_reason", "value")


def split_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events and rejected lines of a ``keep`` parse."""
    rejected = F.col("reject_reason").isNotNull()
    kept = [name for name in parsed.columns if name not in EVENT_COLUMNS]
    return parsed.filter(~rejected).drop("reject_reason", "value"), parsed.filter(rejected).select(*kept)
