"""Timestamps that keep the wall clock of the log's own offset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARK = "\u0001"
_ZONE = r"(Z|[+-][0-9]{2}(?::?[0-9]{2}(?::?[0-9]{2}(?:\.[0-9]+)?)?)?)"
# Groups: day, month name, year, hour, minute, second, offset.
_CLF = (
    r"^([0-9]{1,2})/([A-Za-z]{3})/([0-9]{4}):([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2})\s+"
    r"(Z|[+-][0-9]{2}:?[0-9]{2}(?::?[0-9]{2})?)$"
)
# The usual form, of 26 characters at fixed places.
_USUAL = r"^[0-9]{2}/[A-Za-z]{3}/[0-9]{4}:[0-9]{2}:[0-9]{2}:[0-9]{2} [+-][0-9]{4}$"
# Groups: year, dash, month, day, hour, colon, minute, second, fraction, offset.
_ISO = (
    r"^([0-9]{4})(-?)([0-9]{2})\2([0-9]{2})"
    r"(?:(?s:.)([0-9]{2})(?:(:?)([0-9]{2})(?:\6([0-9]{2})(?:[.,]([0-9]{1,6})[0-9]*)?)?)?"
    + _ZONE + r"?)?$"
)
# Year, dash, week and day of a week date at the start of a text.
_WEEK = r"^([0-9]{4})(-?)W([0-9]{2})(?:\2([0-9])(?![0-9]))?"
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_EPOCH = "timestamp_ntz '1970-01-01 00:00:00'"


def calendar_text(text: Column) -> Column:
    """A leading ISO week date as the calendar date; other texts as they are, null for a week or day that does not exist.

    The first week of a year holds its 4th of January; a missing day is Monday.
    """
    year = F.regexp_extract(text, _WEEK, 1)
    week = F.regexp_extract(text, _WEEK, 3).try_cast("int")
    day = F.coalesce(F.regexp_extract(text, _WEEK, 4).try_cast("int"), F.lit(1))
    first = F.date_trunc("week", F.concat(year, F.lit("-01-04")).try_cast("timestamp_ntz")).cast("date")
    date = F.date_add(first, (week - 1) * 7 + day - 1)
    # The Thursday of a week lies in the week's year.
    real = F.year(F.date_add(first, week * 7 - 4)).cast("string") == F.ltrim(year, F.lit("0"))
    valid = (week >= 1) & day.between(1, 7) & real
    rest = F.substring(text, F.length(F.regexp_extract(text, _WEEK, 0)) + 1, F.length(text))
    return F.when(F.instr(text, "W").between(5, 6), F.when(valid, F.concat(date.cast("string"), rest))).otherwise(text)


def time_pieces(text: Column) -> Column:
    """Array of "", year, month, day, hour, minute, second, fraction, offset.

    One regex pass rearranges the text into marked pieces; a text in neither
    format gives an array of one element. Only the slash format has a slash
    after the one or two digits of its day. In its usual form the pieces are cut out.
    """
    places = [(8, 4), (4, 3), (1, 2), (13, 2), (16, 2), (19, 2)]
    cut = F.array(F.lit(""), *[F.substring(text, *place) for place in places], F.lit("0"), F.substring(text, 22, 5))
    usual = (F.length(text) == 26) & text.rlike(_USUAL)
    text = calendar_text(text)
    order = _MARK.join(["", "$3", "$2", "$1", "$4", "$5", "$6", "0", "$7"])
    clf = F.regexp_replace(text, _CLF, order)
    order = _MARK.join(["", "$1", "$3", "$4", "$5", "$7", "$8", "$9", "$10"])
    iso = F.regexp_replace(text, _ISO, order)
    chosen = F.when(F.instr(text, "/").between(2, 3), clf).otherwise(iso)
    return F.when(usual, cut).otherwise(F.split(F.when(~F.contains(text, F.lit(_MARK)), chosen), _MARK))


def local_time(pieces: Column) -> Column:
    """Wall-clock TIMESTAMP_NTZ of the pieces; null if they are no valid time."""

    def piece(index: int, default: str = "00") -> Column:
        value = F.get(pieces, F.lit(index))
        return F.when(value == "", default).otherwise(value)

    month = F.get(pieces, F.lit(2))
    at = F.instr(F.lit(_MONTHS), F.lower(month))
    named = F.when(at % 3 == 1, ((at + 2) / 3).cast("int").cast("string"))
    number = F.when(F.length(month) == 3, named).otherwise(month)
    day = F.concat(piece(1), F.lit("-"), number, F.lit("-"), piece(3))
    clock = F.concat(piece(4), F.lit(":"), piece(5), F.lit(":"), piece(6), F.lit("."), piece(7, "0"))
    return F.concat(day, F.lit(" "), clock).try_cast("timestamp_ntz")


def offset_text(pieces: Column) -> Column:
    """Offset as ``+HH:MM`` (or ``+HH:MM:SS``); null when the text has none."""
    zone = F.get(pieces, F.lit(8))
    # Besides digits a zone holds these, and perhaps a line end behind it.
    digits = F.translate(F.substring_index(zone, ".", 1), "Z+-:\r\n\u0085\u2028\u2029", "")
    hours = F.substring(digits, 1, 2)
    minutes = F.rpad(F.substring(digits, 3, 2), 2, "0")
    seconds = F.substring(digits, 5, 2)
    shown = F.concat(F.substring(zone, 1, 1), hours, F.lit(":"), minutes)
    with_seconds = F.concat(shown, F.lit(":"), seconds)
    return (
        F.when(zone == "Z", "+00:00")
        .when(zone == "", None)
        .when(seconds.isin("", "00"), shown)
        .otherwise(with_seconds)
    )


def offset_seconds(offset: Column) -> Column:
    def part(start: int) -> Column:
        return F.substring(offset, start, 2).cast("int")

    sign = F.when(offset.startswith("-"), -1).otherwise(1)
    minutes = part(2) * 60 + part(5)
    whole = F.when(F.length(offset) > 6, minutes * 60 + part(8)).otherwise(minutes * 60)
    # Most logs are in UTC; a missing offset counts as UTC too.
    return F.when(offset.isNull() | (offset == "+00:00"), 0).otherwise(sign * whole)


def local_micros(local: Column) -> Column:
    """Microseconds of a wall clock since 1970, whatever the session zone."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), local)


def absolute_time(local: Column, offset: Column) -> Column:
    return F.timestamp_micros(local_micros(local) - offset_seconds(offset).cast("bigint") * 1000000)


def iso_text(local: Column, offset: Column) -> Column:
    """ISO text with six fraction digits only if there are any, and the known offset."""
    text = local.cast("string")
    fraction = F.substring(text, 21, 6)
    shown = F.when(fraction == "", "").otherwise(F.concat(F.lit("."), F.rpad(fraction, 6, "0")))
    day, clock = F.substring(text, 1, 10), F.substring(text, 12, 8)
    return F.concat(day, F.lit("T"), clock, shown, F.coalesce(offset, F.lit("")))


def clf_text(local: Column, offset: Column) -> Column:
    """``dd/Mon/yyyy:HH:mm:ss +HHMM``."""
    text = local.cast("string")
    name = F.substring(F.lit(_MONTHS), F.month(local) * 3 - 2, F.lit(3))
    day = F.concat_ws("/", F.substring(text, 9, 2), F.initcap(name), F.substring(text, 1, 4))
    zone = F.replace(F.coalesce(offset, F.lit("")), F.lit(":"), F.lit(""))
    return F.concat(day, F.lit(":"), F.substring(text, 12, 8), F.lit(" "), zone)


def epoch_start() -> tuple[Column, Column]:
    """Wall clock and offset of second zero."""
    return F.expr(_EPOCH), F.lit("+00:00")
