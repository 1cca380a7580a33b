"""Column functions with explicit missing-value rules.

A missing value is always SQL NULL.  Nothing here can produce NaN, because
Spark orders NaN above every number and does not count it as NULL.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# Fixed value: feet per second to miles per hour.
FPS_TO_MPH = 0.681818

_MDY_PREFIX = r"^\s*(\d{1,2})/(\d{1,2})/(\d{2})"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def parse_mdy(text: Column | str) -> Column:
    """Date from month/day/two-digit-year text.

    Years 69-99 fall in the 1900s and 00-68 in the 2000s.  One-digit months and
    days are fine, text after the year's two digits is ignored, and anything
    that is not a calendar date gives NULL.
    """
    text = _col(text)
    month, day, yy = (F.regexp_extract(text, _MDY_PREFIX, i) for i in (1, 2, 3))
    century = F.when(yy >= "69", F.lit("19")).otherwise(F.lit("20"))
    return F.try_to_date(F.concat(century, yy, F.lit("-"), month, F.lit("-"), day), "yyyy-M-d")


def if_else(test: Column, yes: Column, no: Column) -> Column:
    """Two-way choice that is NULL where the test is NULL."""
    return F.when(test, yes).when(~test, no)


def is_in(value: Column | str, options: Iterable[str]) -> Column:
    """Membership that is false, not NULL, for a missing value."""
    return F.coalesce(_col(value).isin(*options), F.lit(False))


def null_or(value: Column | str, test: Column) -> Column:
    """True where the value is missing or the test holds."""
    return _col(value).isNull() | test


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient, NULL for a zero denominator."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def within(a: Column | str, b: Column | str, limit: float) -> Column:
    """True unless both values are present and differ by ``limit`` or more."""
    a, b = _col(a), _col(b)
    return a.isNull() | b.isNull() | (F.abs(a - b) < F.lit(limit))


def to_int(value: Column | str) -> Column:
    return _col(value).try_cast("int")


def paste(*parts: Column | str, sep: str = "_") -> Column:
    return F.concat_ws(sep, *(_col(p) for p in parts))


def label_part(label: Column | str, position: int, sep: str = ":") -> Column:
    """Integer at ``position`` (0-based) of a delimited label."""
    return F.get(F.split(_col(label), sep), F.lit(position)).try_cast("int")


def year_prefix(name: Column | str) -> Column:
    """Integer year from the first four characters of a name."""
    return F.substring(_col(name), 1, 4).try_cast("int")


def fps_to_mph(speed: Column | str) -> Column:
    return F.lit(FPS_TO_MPH) * _col(speed)


def display_round(value: Column | str, digits: int = 3) -> Column:
    return F.round(_col(value), digits)
