"""Conversions and missing-value rules. Missing is always NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def known(value: Column) -> Column:
    """The value as a double, NULL where it is NaN or infinite."""
    wide = value.cast("double")
    return F.when(~F.isnan(wide) & (F.abs(wide) < F.lit(float("inf"))), wide)


def to_number(text: Column) -> Column:
    """A double from dirty text; anything that is not a plain number is NULL."""
    raw = text.cast("string")
    return F.when(raw.rlike(_NUMBER), raw.try_cast("double"))


def to_timestamp(text: Column) -> Column:
    """ISO-8601 text to a timestamp, NULL where it does not parse."""
    return text.cast("string").try_cast("timestamp")


def holds(condition: Column) -> Column:
    """A condition that counts as false where it is unknown."""
    return F.coalesce(condition, F.lit(False))


def cap(value: Column, upper: float) -> Column:
    """Limit from above only, keeping NULL (least() alone would skip it)."""
    return F.when(value.isNotNull(), F.least(value, F.lit(upper)))
