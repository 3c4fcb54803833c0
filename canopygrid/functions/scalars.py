"""Text-to-number and date helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Span accepted for a bare (decimal) year.
YEAR_RANGE = (1900, 2200)


def numeric_text(text: Column) -> Column:
    """Trimmed text; NULL where it ends in a type letter, which a cast would read as a number."""
    trimmed = F.trim(text)
    return F.when(~trimmed.rlike(r"(?i)[0-9.][df]$"), trimmed)


def to_number(text: Column, default: float | None = None) -> Column:
    """Trimmed text as DOUBLE; empty or unreadable text gives ``default``."""
    value = numeric_text(text).try_cast("double")
    fallback = F.lit(default).cast("double")
    return F.coalesce(F.when(F.isnan(value), F.lit(None)).otherwise(value), fallback)


def to_whole(text: Column, default: int | None = None) -> Column:
    """Trimmed text as BIGINT, decimals cut off; otherwise ``default``."""
    number = numeric_text(text).try_cast("double")
    exact = F.trim(text).try_cast("bigint")
    cut = F.when(~F.isnan(number), number).try_cast("bigint")
    return F.coalesce(exact, cut, F.lit(default).cast("bigint"))


def decimal_year(text: Column) -> Column:
    """Date text as a decimal year: year + (day of year - 1) / days in that year."""
    trimmed = F.trim(text)
    number = numeric_text(text).try_cast("double")
    bare = F.when(number.between(*YEAR_RANGE), number)
    # The year-first layouts need all their digits; a shorter text is no date.
    shaped = F.when(trimmed.rlike(r"^(\d{8}|\d{4}/\d{1,2}/\d{1,2}|\d{4}-\d{1,2}-\d{1,2})$"), trimmed)
    parts = F.coalesce(
        F.when(shaped.rlike(r"^\d{8}$"), F.concat_ws("-", shaped.substr(1, 4), shaped.substr(5, 2), shaped.substr(7, 2))),
        F.replace(shaped, F.lit("/"), F.lit("-")),
    )
    date = parts.try_cast("date")
    year_of = F.year(date)
    leap = ((year_of % 4 == 0) & (year_of % 100 != 0)) | (year_of % 400 == 0)
    days = F.when(leap, 366.0).otherwise(365.0)
    return F.coalesce(year_of + (F.dayofyear(date) - 1) / days, bare)


def period_years(start: Column, end: Column) -> Column:
    """Length in years between two date texts; NULL where unreadable or equal."""
    years = F.abs(decimal_year(end) - decimal_year(start))
    return F.when(years > 0, years)
