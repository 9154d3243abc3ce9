"""Spans of time in words, and rules of the review screen, built from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _div(a: Column, by: int) -> Column:
    return F.floor(a / by).cast("long")


def relative_time(seconds: Column | str) -> Column:
    """A span of seconds (not negative) in words; each unit is a whole number of the one below."""
    s = _col(seconds).cast("long")
    minutes = _div(s, 60)
    hours = _div(minutes, 60)
    days = _div(hours, 24)
    months = _div(days, 30)
    many = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"))
    return (
        F.when(s <= 4, "a few seconds").when(s <= 44, many(s, "seconds")).when(s <= 89, "a minute")
        .when(minutes < 2, "a minute").when(minutes <= 44, many(minutes, "minutes")).when(minutes <= 89, "an hour")
        .when(hours < 2, "an hour").when(hours <= 21, many(hours, "hours")).when(hours <= 35, "a day")
        .when(days < 2, "a day").when(days <= 8, "a week").when(days <= 25, many(days, "days")).when(days <= 32, "a month")
        .when(months == 1, "a month").when(months <= 10, many(months, "months")).when(months <= 17, "a year")
        .otherwise(many(F.round(months / 12).cast("long"), "years"))
    )


def due_label(seconds: Column | str) -> Column:
    """Seconds until something is due: 'in ...', '... ago' or 'right now'."""
    s = _col(seconds).cast("long")
    words = relative_time(F.abs(s))
    return F.when(s < 0, F.concat(words, F.lit(" ago"))).when(s > 0, F.concat(F.lit("in "), words)).otherwise("right now")


def poll_interval(seconds: Column | str) -> Column:
    """Seconds until the label is worth another look; null if that is two days off or more."""
    s = _col(seconds).cast("long")
    return F.when(_div(F.abs(s), 86400) < 2, F.greatest(F.lit(10).cast("long"), _div(F.abs(s), 5)))


def refresh_interval(next_refresh: Column | str) -> Column:
    """Between 10 and 60 seconds; 60 if nothing is to come."""
    n = _col(next_refresh).cast("long")
    return F.when(n.isNull(), F.lit(60).cast("long")).otherwise(F.least(F.greatest(n, F.lit(10).cast("long")), F.lit(60).cast("long")))


def decoration_colour(is_due: Column | str, status: Column | str) -> Column:
    """The colour under a word: that of due items, or by status (null: no item, no colour). Fixed values."""
    due, st = _col(is_due), _col(status)
    return F.when(st.isNull(), None).when(due, "rgb(153 27 27)").when(st == "Learning", "#2563eb").when(st == "Relearning", "#d97706").when(st == "Reviewing", "transparent")


def reading_position(line: Column | str, lines: Column | str) -> Column:
    """Share of the lines, in per cent with one decimal."""
    return F.format_string("%.1f%%", F.lit(100.0) * _col(line) / _col(lines))


#: Words of the frequency list that percentiles refer to: a fixed value.
FREQUENCY_LIST = 160_836


def frequency_label(frequency: Column | str) -> Column:
    """A place in the frequency list as 'top x %'; 0 or null is unknown."""
    f = F.coalesce(_col(frequency), F.lit(0))
    return F.when(f == 0, "unknown").otherwise(F.format_string("top %.2f%%", F.lit(100.0) * f / FREQUENCY_LIST))
