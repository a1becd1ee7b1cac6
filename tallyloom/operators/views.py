"""Shapes of the report view: ranks, shares, calendars, buckets, levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.session import ensure_checkpoint_dir

# View limits.
PRIMARY_ROWS = 10
CALENDAR_DAYS = 1100
WEEKLY_SPAN_DAYS = 62
INCOMPLETE_STATUSES = ("known incomplete", "coverage assessment incomplete", "assessment unavailable")


def rank_in_group(df: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """Rank by value (largest first, unknown last), then name, restarting per group.

    Rows are range-partitioned by all three, so many equal values or names with a
    common head are spread like any others; one small row per partition and group
    carries the count on. The partitioning is kept, so that both passes see it.
    """
    from tallyloom.operators import ordered

    ensure_checkpoint_dir(df.sparkSession)
    keys = [*[F.col(g).asc_nulls_first() for g in group], F.col(value).desc_nulls_last(), F.col(name).asc_nulls_first()]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()).checkpoint()
    return ordered.rank(placed, group, ["_part"], keys[len(group):], "rank").drop("_part")


def share_of_max(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """value / largest value of its group (at least 1)."""
    from tallyloom.operators import ordered

    tops = df.groupBy(*group).agg(F.greatest(F.max(value), F.lit(1)).alias("_top"))
    joined = ordered._join_on(df, tops, list(group))
    return joined.withColumn("share", F.col(value) / F.col("_top")).drop("_top")


def top_and_rest(df: DataFrame, order: Sequence[Column], name: str, value: str,
                 limit: int = PRIMARY_ROWS) -> DataFrame:
    """The first rows plus one row that counts the remainder."""
    top = df.orderBy(*order).limit(limit).select(
        F.col(name).cast("string").alias("name"), F.col(value).alias("value"))
    rest = df.agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("value")).select(
        F.lit("(more)").alias("name"), "value")
    return top.unionByName(rest)


def normalize_activity(points: DataFrame) -> DataFrame:
    """Points with text dates: invalid dates dropped, equal dates summed."""
    text = F.regexp_extract(F.trim("date"), r"^(\d{4}-\d{2}-\d{2})", 1)
    day = F.to_date(F.try_to_timestamp(F.nullif(text, F.lit(""))))
    return (points.select(day.alias("date"), "count").where(F.col("date").isNotNull())
            .groupBy("date").agg(F.sum("count").alias("count")))


def dense_calendar(days: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Every day from first to last; ``fallback`` (start, end) when there is none."""
    span = days.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    if fallback is not None:
        spans = span.withColumn("_p", F.lit(0)).unionByName(fallback.select(
            F.least("start", "end").alias("first"), F.greatest("start", "end").alias("last"),
            F.lit(1).alias("_p")))
        span = spans.where(F.col("first").isNotNull()).agg(
            F.min_by("first", "_p").alias("first"), F.min_by("last", "_p").alias("last"))
    calendar = (span.where(F.col("first").isNotNull())
                .select(F.explode(F.sequence("first", "last")).alias("date")))
    return (calendar.join(days.select("date", "count"), "date", "left")
            .select("date", F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def _all_days():
    """A calendar holds one row per day, so a window over all of it stays small."""
    return Window.partitionBy(F.lit(0))


def clip_recent(calendar: DataFrame, limit: int = CALENDAR_DAYS) -> DataFrame:
    """The last ``limit`` days of a calendar."""
    last = F.max("date").over(_all_days())
    return (calendar.withColumn("_last", last)
            .where(F.col("date") > F.date_sub("_last", limit)).drop("_last"))


def bucketize(calendar: DataFrame) -> DataFrame:
    """Monday weeks when the span exceeds 62 days, else single days.

    The first week is labelled with the first day of the calendar.
    """
    spread = calendar.withColumns({"_first": F.min("date").over(_all_days()),
                                   "_span": F.count(F.lit(1)).over(_all_days())})
    weekly = F.col("_span") > WEEKLY_SPAN_DAYS
    monday = F.to_date(F.date_trunc("week", "date"))
    label = F.when(weekly, F.greatest(monday, F.col("_first"))).otherwise(F.col("date"))
    return spread.groupBy(label.alias("label")).agg(F.sum("count").alias("count"))


def weekly_active_days(days: DataFrame) -> DataFrame:
    """0..7 active days per Monday week, empty weeks included."""
    calendar = dense_calendar(days)
    return calendar.groupBy(F.to_date(F.date_trunc("week", "date")).alias("week")).agg(
        F.count_if(F.col("count") > 0).alias("active_days"))


def dominant_bucket(buckets: DataFrame) -> DataFrame:
    """The first largest bucket, if it holds at least half of everything."""
    best = buckets.agg(F.max("count").alias("count"), F.sum("count").alias("total"),
                       F.max_by("label", F.struct(F.col("count"), -F.datediff("label", F.lit("1970-01-01"))))
                       .alias("label"))
    return best.where((F.col("total") > 0) & (F.col("count") / F.col("total") >= 0.5)).select(
        "label", "count", "total")


def busiest_weekday(weekdays: DataFrame) -> DataFrame:
    best = weekdays.agg(F.max_by("weekday", F.struct("count", -F.col("weekday"))).alias("weekday"),
                        F.max("count").alias("count"))
    return best.where(F.col("count") > 0)


def heat_level(count: Column, maximum: Column) -> Column:
    """0 for none, else 1..8 on a log scale."""
    level = F.ceil(8 * F.log1p(count) / F.log1p(maximum))
    return (F.when((count <= 0) | (maximum <= 0), 0)
             .otherwise(F.greatest(F.lit(1), F.least(F.lit(8), level)))).cast("int")


def heat_levels(calendar: DataFrame) -> DataFrame:
    top = F.max("count").over(_all_days())
    return calendar.withColumn("_top", top).select(
        "date", "count", heat_level(F.col("count"), F.col("_top")).alias("level"))


def hour_levels(hours: DataFrame) -> DataFrame:
    """quiet, low, medium, high; late for any activity before five."""
    w = Window.partitionBy(F.lit(0))  # 24 rows
    ratio = F.log1p("count") / F.log1p(F.max("count").over(w))
    level = (F.when(F.col("count") <= 0, "quiet").when(F.col("hour") < 5, "late")
              .when(ratio < 0.38, "low").when(ratio < 0.72, "medium").otherwise("high"))
    return hours.select("hour", "count", level.alias("level"))


def leader(providers: DataFrame) -> DataFrame:
    """First provider with the most sessions, only when it has any."""
    return (providers.where(F.col("sessions") > 0)
            .orderBy(F.desc("sessions"), "harness").limit(1).select("harness", "sessions"))


def order_by_metric(df: DataFrame, metric: str, key: str) -> DataFrame:
    """``df`` with ``position``: largest metric first, unknown last, ties by key."""
    ranked = rank_in_group(df.withColumn("_all", F.lit(0)), ["_all"], metric, key)
    return ranked.withColumnRenamed("rank", "position").drop("_all")


def is_sparse(sessions: Column, active_days: Column) -> Column:
    return (sessions < 8) | (active_days < 3)


def incomplete_providers(providers: DataFrame) -> DataFrame:
    return providers.agg(F.count_if(F.lower("coverage_status").isin(*INCOMPLETE_STATUSES))
                         .alias("incomplete"))
