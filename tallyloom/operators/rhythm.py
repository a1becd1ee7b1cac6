"""Time rhythm. One aggregate to (date, hour) cells; all else reads the cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tallyloom.functions.times import to_local
from tallyloom.operators.metrics import _timed


def activity_cells(sessions: DataFrame, zone: str = "UTC", by: Sequence[str] = ()) -> DataFrame:
    """Sessions per local (date, hour): at most 24 rows per calendar day."""
    local = to_local(F.coalesce("activity_at", "started_at"), zone)
    return (sessions.where(_timed()).withColumn("_local", local).where(F.col("_local").isNotNull())
            .groupBy(*by, F.to_date("_local").alias("date"), F.hour("_local").alias("hour"))
            .agg(F.count(F.lit(1)).alias("n")))


def daily(cells: DataFrame) -> DataFrame:
    return cells.groupBy("date").agg(F.sum("n").alias("count"))


def monthly(cells: DataFrame) -> DataFrame:
    return cells.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.sum("n").alias("count"))


def hours24(cells: DataFrame) -> DataFrame:
    """24 rows, zero filled."""
    return _dense(cells.groupBy("hour").agg(F.sum("n").alias("count")), "hour", 24)


def weekdays7(cells: DataFrame) -> DataFrame:
    """7 rows, Monday first, zero filled."""
    return _dense(cells.groupBy(F.weekday("date").alias("weekday")).agg(F.sum("n").alias("count")),
                  "weekday", 7)


def _dense(counts: DataFrame, column: str, size: int) -> DataFrame:
    slots = counts.sparkSession.range(size).select(F.col("id").cast("int").alias(column))
    return slots.join(counts, column, "left").select(
        column, F.coalesce(F.col("count"), F.lit(0)).alias("count"))


def favorite_hour(hours: DataFrame) -> DataFrame:
    """Busiest hour, the earliest among ties; 0 when there is no activity."""
    return hours.agg(F.max_by("hour", F.struct(F.col("count"), -F.col("hour"))).alias("favorite_hour"))


def late_night(hours: DataFrame) -> DataFrame:
    total = F.sum("count")
    late = F.sum(F.when(F.col("hour") < 5, F.col("count")).otherwise(0))
    return hours.agg(F.when(total > 0, F.round(100.0 * late / total, 1)).otherwise(0.0)
                     .alias("late_night_percent"))


def longest_streak(days: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Longest run of consecutive dates. ``days`` is distinct in (by, date)."""
    numbered = F.row_number().over(Window.partitionBy(*by).orderBy("date"))
    islands = (days.withColumn("_island", F.date_sub("date", numbered))
               .groupBy(*by, "_island").agg(F.count(F.lit(1)).alias("_days")))
    longest = F.coalesce(F.max("_days"), F.lit(0)).alias("longest_streak")
    return islands.groupBy(*by).agg(longest) if by else islands.agg(longest)


def busiest_day(days: DataFrame) -> DataFrame:
    return days.orderBy(F.desc("count"), "date").limit(1).select("date", "count")


def busiest_month(months: DataFrame) -> DataFrame:
    label = F.date_format(F.to_date(F.concat("month", F.lit("-01"))), "MMM yyyy")
    return months.orderBy(F.desc("count"), "month").limit(1).select(label.alias("label"), "count")
