"""Text and number clean-up expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text marks of the input files.
METRO_MODE = "地铁"
LINE_MARK = "号线"
HOUSEHOLD_UNIT = "户"
NO_DATA = "暂无数据"
HOLIDAYS = [4, 5, 6, 11, 12, 18, 19, 25, 26]


def station_name(location: Column) -> Column:
    """Text after the line mark; NULL where the mark is absent."""
    return F.trim(F.get(F.split(location, LINE_MARK), F.lit(1)))


def day_type(day: Column) -> Column:
    return F.when(day.isin(HOLIDAYS), F.lit("holidays")).otherwise(F.lit("workdays"))


def household_count(text: Column) -> Column:
    """Leading number before the unit; the no-data mark is 0, anything else unreadable is NULL."""
    number = F.trim(F.get(F.split(text, HOUSEHOLD_UNIT), F.lit(0)))
    return F.when(F.startswith(text, F.lit(NO_DATA)), F.lit(0)).otherwise(number.try_cast("int"))


def price_value(text: Column) -> Column:
    """Numeric price whose whole part is not zero, else NULL."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) >= 1), value)


def has_tag(tags: Column, tag: str) -> Column:
    return F.contains(tags, F.lit(tag))


def last_segment(tags: Column) -> Column:
    return F.element_at(F.split(tags, ";"), -1)


def is_tap_in(amount: Column) -> Column:
    """A fare of exactly 0.00 marks entering; everything else marks leaving."""
    return F.coalesce(amount == F.lit(0).cast("decimal(10,2)"), F.lit(False))


def ratio_cents(total: Column, count: Column) -> Column:
    """total / count in whole hundredths, ties away from zero, for non-negative integers."""
    return int_div(total * 200 + count, count * 2)


def int_div(top: Column, bottom: Column) -> Column:
    return F.call_function("div", top, bottom)


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970, without regard to the session time zone."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", origin, ts.cast("timestamp_ntz"))


def as_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
