"""Lenient number casts and the JSON value rules of the parser."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_dash

_DIGITS = r"[0-9](?:_?[0-9])*"
_NUMBER = (
    rf"^[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
    r"|(?i:inf(?:inity)?|nan))$"
)


def text_to_double(text: Column) -> Column:
    """Number written as text; null when it is not a plain decimal number."""
    return F.when(text.rlike(_NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


def text_to_long(text: Column) -> Column:
    """Number written as text, truncated toward zero."""
    return text_to_double(text).try_cast("bigint")


def three_decimals(value: Column) -> Column:
    """The number with three decimals, rounded from its exact binary value.

    The JVM's formatter rounds the shortest decimal text instead, which differs
    where that text ends in 5. The rounding error of ``value * 1000`` is computed
    exactly (Dekker's product) and decides such ties.
    """
    size = F.abs(value)
    scaled = size * 1000.0
    head = size * 134217729.0 - (size * 134217729.0 - size)
    error = (head * 1000.0 - scaled) + (size - head) * 1000.0
    low = F.floor(scaled)
    tie = F.when(error > 0, low + 1).when(error < 0, low).otherwise(low + low % 2)
    units = F.when(scaled - low == 0.5, tie).otherwise(F.rint(scaled).cast("bigint"))
    thousandths = F.lpad((units % 1000).cast("string"), 3, "0")
    sign = F.when(value < 0, "-").otherwise("")
    exact = F.concat(sign, F.floor(units / 1000).cast("string"), F.lit("."), thousandths)
    return F.when(size < 1e12, exact).otherwise(F.format_string("%.3f", value))


# A payload value is carried as one string: a quote and the text for a JSON string,
# else the JSON text itself. These are the falsy ones.
_FALSY = ["null", '"', "false", "0", "0.0", "-0.0", "[]", "{}"]
_NUMBER_START = [*"-0123456789"]


class JsonValue:
    """A payload value as tagged text; the column is null when the key is absent."""

    def __init__(self, tagged: Column) -> None:
        self.tagged = tagged

    @staticmethod
    def tag(value: Column, shown: Column) -> Column:
        """The column to put into a projection, from a variant column and its JSON text (a column too, as it is read often)."""
        quoted = shown.startswith('"')
        escaped = F.concat(F.lit('"'), F.try_variant_get(value, "$", "string"))
        bare = F.left(shown, F.length(shown) - 1)
        return F.when(quoted & F.contains(shown, F.lit("\\")), escaped).when(quoted, bare).otherwise(shown)

    @property
    def raw(self) -> Column:
        """The text without the quote."""
        return F.when(self.is_text, F.substring(self.tagged, 2, 2147483646)).otherwise(self.tagged)

    @property
    def absent(self) -> Column:
        return self.tagged.isNull()

    @property
    def missing(self) -> Column:
        """Absent or JSON null."""
        return F.coalesce(self.tagged, F.lit("null")) == "null"

    def _starts(self, *marks: str) -> Column:
        return F.coalesce(F.substring(self.tagged, 1, 1).isin(*marks), F.lit(False))

    @property
    def is_text(self) -> Column:
        return F.coalesce(self.tagged.startswith('"'), F.lit(False))

    @property
    def is_number(self) -> Column:
        return self._starts(*_NUMBER_START)

    @property
    def is_object(self) -> Column:
        return self._starts("{")

    @property
    def truthy(self) -> Column:
        return ~F.coalesce(self.tagged, F.lit("null")).isin(_FALSY)

    @property
    def as_text(self) -> Column:
        """The value as text; null when missing."""
        return F.when(self.tagged.isin("true", "false"), F.initcap(self.tagged)).when(
            ~self.missing, self.raw
        )

    @property
    def as_long(self) -> Column:
        whole = ~self.tagged.rlike("[.eE]")
        return (
            F.when(self.is_text, text_to_long(clean_dash(self.raw)))
            .when(self.is_number & whole, self.tagged.try_cast("bigint"))
            .when(self.is_number, self.tagged.try_cast("double").try_cast("bigint"))
            .when(self.tagged == "true", 1)
            .when(self.tagged == "false", 0)
        )

    @property
    def as_double(self) -> Column:
        return F.when(self.is_number, self.tagged.try_cast("double")).when(
            self.is_text, text_to_double(clean_dash(self.raw))
        )

    @property
    def holds_something(self) -> Column:
        """Neither missing nor blank or dash text: a number is expected here."""
        return ~self.missing & ~(self.is_text & clean_dash(self.raw).isNull())


def first_truthy(tagged: Sequence[Column]) -> Column:
    """The first truthy value, else the last one as it is (an ``or`` chain)."""
    *heads, last = tagged
    chain = F
    for head in heads:
        chain = chain.when(JsonValue(head).truthy, head)
    return chain.otherwise(last) if heads else last
