"""ISO weeks as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def week_id(date: Column) -> Column:
    """`YYYY-Www` by the ISO year; null for a null date."""
    return F.when(date.isNotNull(), F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), date), F.weekofyear(date)))


def monday_of(week: Column) -> Column:
    """Monday of a week id: that of the week of 4 January, and so many weeks on."""
    first = F.date_trunc("week", F.to_date(F.concat(F.substring(week, 1, 4), F.lit("-01-04")))).cast("date")
    return F.date_add(first, 7 * (F.substring(week, 7, 2).cast("int") - 1))


def week_range(week: Column) -> Column:
    return F.struct(monday_of(week).alias("monday"), F.date_add(monday_of(week), 6).alias("sunday"))


def in_week(date: Column, week: Column) -> Column:
    """Whether a date lies in a week, both ends counted."""
    return date.between(monday_of(week), F.date_add(monday_of(week), 6))


def week_ordinals(weeks: DataFrame) -> DataFrame:
    """Distinct weeks with `week_idx` from 0. The table of weeks is small: one row per week."""
    return weeks.select("week").distinct().withColumn("week_idx", F.row_number().over(Window.orderBy("week")) - 1)
