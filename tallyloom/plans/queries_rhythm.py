"""Rhythm and report views on the bound driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import times
from tallyloom.operators import metrics, rhythm, views
from tallyloom.plans.bindings import EV, ORD, ev_sessions, events, table
from tallyloom.plans.registry import query


def _cells(spark, sf_dir, zone="UTC"):
    return rhythm.activity_cells(ev_sessions(spark, sf_dir), zone)


def _order_days(spark, sf_dir):
    return table(spark, sf_dir, "orders", "o_orderdate").groupBy(
        F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("count"))


@query("daily_activity", EV + "SELECT CAST(date AS VARCHAR) AS date, n AS count FROM days")
def daily_activity(spark, sf_dir):
    return rhythm.daily(_cells(spark, sf_dir)).select(F.col("date").cast("string"), "count")


@query("local_day_shift", EV + """
SELECT CAST(CAST(started_at + INTERVAL 3 HOUR AS DATE) AS VARCHAR) AS date, count(*) AS count FROM timed GROUP BY 1""")
def local_day_shift(spark, sf_dir):
    return rhythm.daily(_cells(spark, sf_dir, "+03:00")).select(F.col("date").cast("string"), "count")


@query("monthly_activity", """
SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS count FROM orders GROUP BY 1""")
def monthly_activity(spark, sf_dir):
    return rhythm.monthly(_order_days(spark, sf_dir).withColumnRenamed("count", "n"))


@query("hours24", EV + "SELECT CAST(hour AS INTEGER) AS hour, n AS count FROM hours")
def hours24(spark, sf_dir):
    return rhythm.hours24(_cells(spark, sf_dir))


@query("weekdays7", EV + """
SELECT CAST(w.weekday AS INTEGER) AS weekday, count(t.started_at) AS count
FROM (SELECT unnest(range(7)) AS weekday) w LEFT JOIN timed t ON isodow(t.started_at) - 1 = w.weekday GROUP BY 1""")
def weekdays7(spark, sf_dir):
    return rhythm.weekdays7(_cells(spark, sf_dir))


@query("favorite_hour", EV + """
SELECT CAST(hour AS INTEGER) AS favorite_hour FROM hours ORDER BY n DESC, hour LIMIT 1""")
def favorite_hour(spark, sf_dir):
    return rhythm.favorite_hour(hours24(spark, sf_dir))


@query("late_night", EV + """
SELECT round(100.0 * sum(n) FILTER (hour < 5) / sum(n), 1) AS late_night_percent FROM hours""")
def late_night(spark, sf_dir):
    return rhythm.late_night(hours24(spark, sf_dir))


@query("active_days", EV + "SELECT count(*) AS active_days FROM days")
def active_days(spark, sf_dir):
    return rhythm.daily(_cells(spark, sf_dir)).agg(F.count(F.lit(1)).alias("active_days"))


@query("busiest_day", EV + """
SELECT CAST(date AS VARCHAR) AS date, n AS count FROM days ORDER BY n DESC, days.date LIMIT 1""")
def busiest_day(spark, sf_dir):
    return rhythm.busiest_day(rhythm.daily(_cells(spark, sf_dir))).select(F.col("date").cast("string"), "count")


@query("busiest_month", """
SELECT strftime(m, '%b %Y') AS label, count FROM (
  SELECT date_trunc('month', o_orderdate) AS m, count(*) AS count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)""")
def busiest_month(spark, sf_dir):
    return rhythm.busiest_month(monthly_activity(spark, sf_dir))


@query("longest_streak", EV + """
SELECT user_id, CAST(max(n) AS BIGINT) AS longest_streak FROM (
  SELECT user_id, grp, count(*) AS n FROM (
    SELECT user_id, date - CAST(row_number() OVER (PARTITION BY user_id ORDER BY date) AS INTEGER) AS grp
    FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS date FROM ev)) GROUP BY user_id, grp)
GROUP BY user_id""")
def longest_streak(spark, sf_dir):
    days = events(spark, sf_dir).select("user_id", F.to_date("ts").alias("date")).distinct()
    return rhythm.longest_streak(days, ["user_id"])


@query("longest_streak_orders", ORD + """
SELECT CAST(max(n) AS BIGINT) AS longest_streak FROM (SELECT grp, count(*) AS n FROM (
  SELECT date - CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS grp FROM days) GROUP BY grp)""")
def longest_streak_orders(spark, sf_dir):
    return rhythm.longest_streak(_order_days(spark, sf_dir).select("date"))


@query("coverage_label", """
WITH s AS (SELECT strftime(min(o_orderdate), '%b ') AS sm, day(min(o_orderdate)) AS sd, year(min(o_orderdate)) AS sy,
                  strftime(max(o_orderdate), '%b ') AS em, day(max(o_orderdate)) AS ed, year(max(o_orderdate)) AS ey,
                  min(o_orderdate) AS a, max(o_orderdate) AS b, o_orderpriority FROM orders
           GROUP BY o_orderpriority, year(o_orderdate))
SELECT o_orderpriority, sy AS year, CASE WHEN month(a) = 1 AND sd <= 7 AND month(b) = 12 AND ed >= 25 THEN CAST(sy AS VARCHAR)
         WHEN sy = ey THEN sm || sd || ' — ' || em || ed || ', ' || ey
         ELSE sm || sd || ', ' || sy || ' — ' || em || ed || ', ' || ey END AS label,
       month(a) = 1 AND sd <= 7 AND month(b) = 12 AND ed >= 25 AS framing
FROM s""")
def coverage_label(spark, sf_dir):
    spans = table(spark, sf_dir, "orders", "o_orderdate", "o_orderpriority").groupBy(
        "o_orderpriority", F.year("o_orderdate").cast("bigint").alias("year")).agg(
        F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    a, b = F.col("a"), F.col("b")
    return spans.select("o_orderpriority", "year", times.coverage_label(a, b).alias("label"),
                        times.is_calendar_year(a, b).alias("framing"))


@query("dense_calendar", ORD + "SELECT CAST(date AS VARCHAR) AS date, CAST(n AS BIGINT) AS count FROM calendar")
def dense_calendar(spark, sf_dir):
    return views.dense_calendar(_order_days(spark, sf_dir)).select(F.col("date").cast("string"), "count")


@query("calendar_clip", ORD + """
SELECT CAST(date AS VARCHAR) AS date, CAST(n AS BIGINT) AS count FROM calendar
WHERE date > (SELECT last FROM span) - 1100""")
def calendar_clip(spark, sf_dir):
    clipped = views.clip_recent(views.dense_calendar(_order_days(spark, sf_dir)))
    return clipped.select(F.col("date").cast("string"), "count")


_BUCKETS = ORD + """,
buckets AS (SELECT greatest(CAST(date_trunc('week', date) AS DATE), (SELECT first FROM span)) AS label,
                   CAST(sum(n) AS BIGINT) AS count FROM calendar GROUP BY 1)
"""


@query("week_buckets", _BUCKETS + "SELECT CAST(label AS VARCHAR) AS label, count FROM buckets")
def week_buckets(spark, sf_dir):
    buckets = views.bucketize(views.dense_calendar(_order_days(spark, sf_dir)))
    return buckets.select(F.col("label").cast("string"), "count")


@query("day_buckets", EV + """
SELECT CAST(d AS VARCHAR) AS label, coalesce(n, 0) AS count
FROM (SELECT CAST(unnest(generate_series((SELECT min(date) FROM days), (SELECT max(date) FROM days), INTERVAL 1 DAY)) AS DATE) AS d)
LEFT JOIN days ON days.date = d""")
def day_buckets(spark, sf_dir):
    buckets = views.bucketize(views.dense_calendar(rhythm.daily(_cells(spark, sf_dir))))
    return buckets.select(F.col("label").cast("string"), "count")


@query("weekly_active_days", ORD + """
SELECT CAST(date_trunc('week', date) AS DATE)::VARCHAR AS week, count(*) FILTER (n > 0) AS active_days
FROM calendar GROUP BY 1""")
def weekly_active_days(spark, sf_dir):
    weeks = views.weekly_active_days(_order_days(spark, sf_dir))
    return weeks.select(F.col("week").cast("string"), "active_days")


@query("dominant_bucket", """
WITH b AS (SELECT user_id % 40 AS g, CAST(ts AS DATE) AS label, count(*) AS count FROM events GROUP BY 1, 2),
t AS (SELECT CAST(label AS VARCHAR) AS label, count, CAST(sum(count) OVER () AS BIGINT) AS total
      FROM (SELECT label, sum(count)::BIGINT * CASE WHEN label = DATE '2024-01-15' THEN 100 ELSE 1 END AS count
            FROM b GROUP BY label))
SELECT label, count, total FROM t WHERE count * 2 >= total ORDER BY count DESC, label LIMIT 1""")
def dominant_bucket(spark, sf_dir):
    days = events(spark, sf_dir).groupBy(F.to_date("ts").alias("label")).agg(F.count(F.lit(1)).alias("count"))
    boosted = days.select("label", (F.col("count") * F.when(F.col("label") == F.lit("2024-01-15").cast("date"), 100)
                                    .otherwise(1)).alias("count"))
    return views.dominant_bucket(boosted).select(F.col("label").cast("string"), "count", "total")


@query("busiest_weekday", EV + """
SELECT CAST(isodow(started_at) - 1 AS INTEGER) AS weekday, count(*) AS count FROM timed
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""")
def busiest_weekday(spark, sf_dir):
    return views.busiest_weekday(weekdays7(spark, sf_dir))


@query("heat_levels", ORD + """
SELECT CAST(date AS VARCHAR) AS date, CASE WHEN n = 0 THEN 0 ELSE greatest(1, least(8,
         CAST(ceil(8 * ln(1 + n) / ln(1 + (SELECT max(n) FROM calendar))) AS INTEGER))) END AS level FROM calendar""")
def heat_levels(spark, sf_dir):
    levels = views.heat_levels(views.dense_calendar(_order_days(spark, sf_dir)))
    return levels.select(F.col("date").cast("string"), "level")


@query("hour_levels", EV + """
SELECT CAST(hour AS INTEGER) AS hour, CASE WHEN n = 0 THEN 'quiet' WHEN hour < 5 THEN 'late'
         WHEN ln(1 + n) / ln(1 + max(n) OVER ()) < 0.38 THEN 'low'
         WHEN ln(1 + n) / ln(1 + max(n) OVER ()) < 0.72 THEN 'medium' ELSE 'high' END AS level FROM hours""")
def hour_levels(spark, sf_dir):
    return views.hour_levels(hours24(spark, sf_dir)).select("hour", "level")


@query("normalize_activity", """
SELECT CAST(d AS VARCHAR) AS date, CAST(count(*) AS BIGINT) AS count FROM (
  SELECT CAST(o_orderdate AS DATE) AS d, o_orderkey FROM orders WHERE o_orderkey % 10 <> 3) GROUP BY d""")
def normalize_activity(spark, sf_dir):
    bad = F.col("o_orderkey") % 10 == 3
    points = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select(
        F.when(bad, F.concat(F.year("o_orderdate"), F.lit("-02-30")))
         .otherwise(F.concat(F.lit(" "), F.to_date("o_orderdate").cast("string"), F.lit("T00"))).alias("date"),
        F.lit(1).alias("count"))
    return views.normalize_activity(points).select(F.col("date").cast("string"), "count")
