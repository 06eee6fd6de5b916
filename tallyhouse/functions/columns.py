"""Column expressions shared by the operators. All run inside codegen."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from tallyhouse.specs import CURRENCY_MARKS, TIMESTAMP_PATTERNS, WHITESPACE

MONEY = "decimal(18,4)"
MONEY_OUT = "decimal(18,2)"

# yyyy-M-d H:m:s with all its digits
USUAL = r"^[1-9]\d{3}-\d\d-\d\d \d\d:\d\d:\d\d\z"

# plain decimal or scientific notation; keeps Java-only forms such as `1d` out
NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*$"


def strip(c: Column) -> Column:
    """Trim every kind of white space; Spark's own trim removes spaces only."""
    return F.btrim(c, F.lit(WHITESPACE))


def file_name(path: Column) -> Column:
    """The name to show for a file; its whole path is what tells files apart."""
    return F.element_at(F.split(path, "/"), -1)


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def strip_currency(c: Column) -> Column:
    return F.translate(c, CURRENCY_MARKS + WHITESPACE, "")


def number_text(c: Column) -> Column:
    """The text where it is a number, else NULL. The column is used once, so chains
    of these expressions do not multiply when a filter is pushed through them."""
    return F.nullif(F.regexp_extract(c, NUMBER, 1), F.lit(""))


def to_number(c: Column) -> Column:
    """Text to DOUBLE, NULL where it is not a number."""
    return number_text(c).try_cast("double")


def _shape(pattern: str) -> str:
    """Regular expression of the texts a date pattern can match."""
    fields = {"yyyy": r"\d{4}", "MMM": "[A-Za-z]{3}", "'T'": "T"}
    digits = r"\d{1,2}"
    parts = re.split(r"(yyyy|MMM|'T'|[MdHms])", pattern)
    return "^" + "".join(fields.get(p, digits if p in tuple("MdHms") else re.escape(p)) for p in parts) + "$"


def to_timestamp(c: Column, pattern: str) -> Column:
    """The cheap test of the shape comes first: a failing parse costs an exception."""
    parsed = F.try_to_timestamp(c, F.lit(pattern)).cast("timestamp_ntz")
    return F.when(c.rlike(_shape(pattern)), parsed)


def to_timestamp_any(c: Column, patterns=TIMESTAMP_PATTERNS) -> Column:
    """First pattern that fits this one value. The usual form, which only the first pattern of
    ``TIMESTAMP_PATTERNS`` reads, is cast instead of parsed by a pattern."""
    known = F.coalesce(*[to_timestamp(c, p) for p in patterns])
    if TIMESTAMP_PATTERNS[0] not in patterns:
        return known
    return F.when(c.rlike(USUAL), c.try_cast("timestamp").cast("timestamp_ntz")).otherwise(known)


def is_true(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c.cast("string"))) == "true", F.lit(False))


def month_of(c: Column) -> Column:
    return F.date_trunc("month", c).cast("date")


def ratio(num: Column, den: Column) -> Column:
    """num / den as DOUBLE, NULL when den is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def money_text(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 2))


def percent_text(c: Column, signed: bool = False) -> Column:
    """0.1234 -> 12.3%"""
    pct = (c * 100).cast("decimal(18,1)")
    sign = F.when(pct >= 0, "+").otherwise("") if signed else F.lit("")
    return F.concat(sign, pct.cast("string"), F.lit("%"))
