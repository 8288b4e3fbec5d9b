"""Money, percentages and periods as column expressions."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

_PERIOD = re.compile(r"^\d{4}-(0[1-9]|1[0-2])$")


def parse_period(period: str) -> date:
    """First day of a ``YYYY-MM`` month; anything else is refused."""
    if not _PERIOD.match(period):
        raise ValueError(f"period must be YYYY-MM, not {period!r}")
    return date.fromisoformat(f"{period}-01")


def period_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def days_in_month(day: Column) -> Column:
    return F.dayofmonth(F.last_day(day))


def places(value: Column, digits: int) -> Column:
    """Half-up rounding of a number to a decimal, free of binary rounding noise."""
    return F.round(value.cast("decimal(38,6)"), digits)


def rounded(value: Column, digits: int = 2) -> Column:
    return places(value, digits).cast("double")


def fixed_text(value: Column, digits: int) -> Column:
    """Number as text with a fixed count of decimals and no grouping."""
    return places(value, digits).cast(f"decimal(38,{digits})").cast("string")


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` as a double, NULL when the whole is zero or NULL."""
    numerator = part.cast("double") * F.lit(100.0)
    return F.when(whole != 0, numerator / whole.cast("double"))


def percent_or_zero(part: Column, whole: Column) -> Column:
    """As :func:`percent`, but zero unless the whole is positive."""
    return F.when(whole > 0, percent(part, whole)).otherwise(F.lit(0.0))
