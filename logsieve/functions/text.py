"""Text clean-up, templates and parts of URLs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv

# Characters removed from both ends by a text strip (Unicode white space).
WHITESPACE = "".join(
    chr(code)
    for code in [
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    ]
)
# Control characters and space, ignored before a URL.
URL_LEAD = "".join(chr(code) for code in range(0x21))

# Regex flags: only \n ends a line. Classes, boundaries and case know Unicode (U),
# which is several times slower and makes no difference to ASCII text.
UNICODE = "U"
PLAIN_FLAGS = "d"
SEARCH_FLAGS = "id"

# Separator between captured groups.
MARK = "\u0001"


def clean_all(texts: Sequence[Column]) -> Column:
    """``clean_dash`` of several texts as one array; the expression is generated once."""
    stripped = F.transform(F.array(*texts), strip)
    return F.transform(stripped, lambda text: F.when(~text.isin("", "-"), text))


def is_ascii(text: Column) -> Column:
    """As many bytes as characters."""
    return F.octet_length(text) == F.length(text)


def strip(text: Column) -> Column:
    """Trimmed of Unicode white space; only done where an end may be white space."""
    first, last = F.ascii(text), F.ascii(F.substring(text, -1, 1))
    plain = first.between(33, 126) & last.between(33, 126)
    return F.when(plain, text).otherwise(F.btrim(text, F.lit(WHITESPACE)))


def clean_dash(text: Column) -> Column:
    """Stripped text; empty text and a lone dash become null."""
    stripped = strip(text)
    return F.when(~stripped.isin("", "-"), stripped)


def match_groups(text: Column, pattern: str, groups: Sequence[int]) -> Column:
    """Groups of a match anchored at the start, as an array that begins with "".

    The text is rewritten once with the groups between marks and then split, so
    the pattern runs once however many groups are read. Without a match the
    array has one element, so element i >= 1 read with ``get`` is null. Text
    that holds the mark itself takes the group-by-group way.
    """
    marked = "".join(f"{MARK}${group}" for group in groups)

    def rewritten(flags: str) -> Column:
        return F.regexp_replace(text, f"(?{flags})^(?:{pattern})(?s:.*)$", marked)

    anchored = f"(?{PLAIN_FLAGS}{UNICODE})^(?:{pattern})"
    one_by_one = F.when(
        text.rlike(anchored),
        F.array(F.lit(""), *[F.regexp_extract(text, anchored, group) for group in groups]),
    )
    either = F.when(is_ascii(text), rewritten(PLAIN_FLAGS)).otherwise(
        rewritten(PLAIN_FLAGS + UNICODE)
    )
    return F.when(F.contains(text, F.lit(MARK)), one_by_one).otherwise(F.split(either, MARK))


def group(matched: Column, index: int) -> Column:
    """Element ``index`` (from 1) of ``match_groups``; null if empty or unmatched."""
    value = F.get(matched, F.lit(index))
    return F.when(value != "", value)


def searches(text: Column, pattern: str) -> Column:
    """Case-insensitive search anywhere in the text."""
    return F.when(is_ascii(text), text.rlike(f"(?{SEARCH_FLAGS}){pattern}")).otherwise(
        text.rlike(f"(?{SEARCH_FLAGS}{UNICODE}){pattern}")
    )


def replace_tokens(text: Column, masks: Sequence[tuple[str, str]]) -> Column:
    """Each token pattern replaced by its mask, in order."""

    def replaced(flags: str) -> Column:
        column = text
        for token, mask in masks:
            column = F.regexp_replace(column, f"(?{flags}){token}", mask)
        return column

    return F.when(is_ascii(text), replaced(PLAIN_FLAGS)).otherwise(replaced(PLAIN_FLAGS + UNICODE))


def without_query(path: Column) -> Column:
    return F.substring_index(path, "?", 1)


def path_template(path: Column) -> Column:
    """Path without query, long hex tokens and numbers masked."""
    return replace_tokens(
        without_query(path), [(fv.PATH_HEX_TOKEN, "<HEX>"), (fv.NUMBER_TOKEN, "<NUM>")]
    )


def message_template(message: Column) -> Column:
    """Message with addresses, UUIDs, 0x numbers and numbers masked, in that order."""
    return replace_tokens(
        message,
        [
            (fv.IP_TOKEN, "<IP>"),
            (fv.UUID_TOKEN, "<UUID>"),
            (fv.HEX_TOKEN, "<HEX>"),
            (fv.NUMBER_TOKEN, "<NUM>"),
        ],
    )


def path_extension(path: Column) -> Column:
    """Lower-case text after the last dot, with the dot; empty without a dot."""
    clean = without_query(path)
    tail = F.concat(F.lit("."), F.lower(F.substring_index(clean, ".", -1)))
    return F.when(F.contains(clean, F.lit(".")), tail).otherwise("")


def referrer_domain(referrer: Column) -> Column:
    """Network location of the referrer, or the whole text when it has none."""
    breaks = F.lit(False)
    for mark in ("\t", "\r", "\n"):
        breaks = breaks | F.contains(referrer, F.lit(mark))
    joined = F.when(breaks, F.translate(referrer, "\t\r\n", "")).otherwise(referrer)
    url = F.when(F.ascii(joined) > 32, joined).otherwise(F.ltrim(joined, F.lit(URL_LEAD)))
    netloc = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    found = F.when(netloc != "", netloc).otherwise(referrer)
    return F.when(referrer.isNull() | referrer.isin("", "-"), "").otherwise(found)


def hash_bucket(text: Column) -> Column:
    """MD5 as one big number, modulo 1000, over 1000; empty text gives 0.

    The 128-bit remainder is put together from the two 64-bit halves: the last
    three decimal digits of each half are its remainder, and 2**64 % 1000 = 616.
    """
    digest = F.md5(text.cast("binary"))

    def remainder(start: int) -> Column:
        digits = F.conv(F.substring(digest, start, 16), 16, 10)
        return F.right(digits, F.lit(3)).cast("int")

    bucket = (remainder(1) * 616 + remainder(17)) % fv.HASH_BUCKETS
    return F.when(text.isNull() | (text == ""), 0.0).otherwise(bucket / fv.HASH_BUCKETS)


def event_template(method: Column, status: Column, path: Column, message: Column) -> Column:
    """``METHOD|status class|path template``; the message template if the path is empty."""
    verb = F.upper(F.when(method != "", method).otherwise("UNKNOWN"))
    family = F.coalesce(F.floor(status / 100).cast("string"), F.lit("0"))
    from_path = path_template(path)
    base = F.when(from_path != "", from_path).otherwise(
        message_template(F.coalesce(message, F.lit("")))
    )
    return F.concat_ws("|", verb, family, base)
