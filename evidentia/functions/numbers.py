"""Numbers: parsing from text, rounding, scales."""

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def half_up(x: Column) -> Column:
    """Nearest whole number, halves towards plus infinity."""
    return F.floor(x + F.lit(0.5))


def parse_number(text: Column) -> Column:
    """The number that a text starts with, without thousands commas and percent signs; null if there is none."""
    plain = F.regexp_replace(text, "[,%]", "")
    return F.nullif(F.regexp_extract(plain, NUMBER, 1), F.lit("")).try_cast("double")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def is_percent(header: Column, largest: Column) -> Column:
    """Whether a series is in percent: its largest value decides, and in (1, 1.5] or without values the header."""
    named = F.lower(header).contains("%") | F.lower(header).contains("percent")
    return F.when(largest > 1.5, F.lit(True)).when(largest <= 1.0, F.lit(False)).otherwise(named)


def iso_date(text: Column) -> Column:
    """A real calendar date yyyy-mm-dd, or null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def thousands(x: Column) -> Column:
    return half_up(x / 1000)
