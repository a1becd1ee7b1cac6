"""The database source and the scalar functions, over values that Spark derives from the driver tables."""

from __future__ import annotations

import sqlite3

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tallyloom.functions import jsonx, text, times
from tallyloom.plans.bindings import EV, events, ev_sessions, table
from tallyloom.plans.registry import query
from tallyloom.sources import sqlite

#: Events of one database, and the remainder of the databases that get a damaged page.
DATABASE_EVENTS, DAMAGED = 2000, 2


def _write(rows: pd.DataFrame) -> pd.DataFrame:
    """One database with the events of a group."""
    number = int(rows["number"].iloc[0])
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE events (id INTEGER, user INTEGER, kind TEXT, value REAL)")
    con.execute("CREATE TABLE notes (body TEXT)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?)", rows[["event_id", "user_id", "event_type", "value"]].values.tolist())
    con.commit()
    content = bytearray(con.serialize())
    con.close()
    if number % 3 == DAMAGED:
        content[4096:8192] = b"\xff" * 4096
    return pd.DataFrame({"path": [f"/lake/{number}/events.db"], "content": [bytes(content)]})


def _databases(spark, sf_dir) -> DataFrame:
    """A bounded number of events per database, so their number grows with the table."""
    ev = events(spark, sf_dir).withColumn("number", F.floor(F.col("event_id") / DATABASE_EVENTS))
    return ev.groupBy("number").applyInPandas(_write, "path string, content binary")


def _number(df: DataFrame) -> DataFrame:
    return df.withColumn("number", F.split("path", "/")[2].cast("bigint"))


@query("sqlite_scan", f"""
SELECT event_id // {DATABASE_EVENTS} AS number, event_id AS id, user_id AS user, value, NULL::VARCHAR AS absent
FROM events WHERE event_type <> 'error' AND event_id // {DATABASE_EVENTS} % 3 <> {DAMAGED}""")
def sqlite_scan(spark, sf_dir):
    """Filtered rows of the sound databases; a column that no database has is null."""
    got = sqlite.rows_of(_databases(spark, sf_dir), "events", "id bigint, user bigint, value double, absent string", "kind <> 'error'")
    return _number(got).select("number", "id", "user", "value", "absent")


@query("sqlite_columns", f"""
WITH d AS (SELECT DISTINCT event_id // {DATABASE_EVENTS} AS number FROM events),
c(table_name, column_name) AS (VALUES ('events', 'id'), ('events', 'user'), ('events', 'kind'), ('events', 'value'), ('notes', 'body'))
SELECT number, NULL AS table_name, NULL AS column_name, number % 3 <> {DAMAGED} AS readable FROM d
UNION ALL SELECT number, table_name, column_name, true FROM d CROSS JOIN c WHERE number % 3 <> {DAMAGED}""")
def sqlite_columns(spark, sf_dir):
    return _number(sqlite.columns_of(_databases(spark, sf_dir))).select("number", "table_name", "column_name", "readable")


@query("time_layouts", """
WITH e AS (SELECT event_id, epoch_us(ts) AS us FROM events)
SELECT event_id,
  CASE WHEN event_id % 4 < 2 THEN us END AS index_us,
  CASE event_id % 4 WHEN 0 THEN us WHEN 2 THEN us // 1000000 * 1000000 END AS text_us,
  CASE event_id % 4 WHEN 0 THEN us WHEN 3 THEN us // 1000 * 1000
    WHEN 2 THEN us // 1000000 * 1000 END AS json_us
FROM e""")
def time_layouts(spark, sf_dir):
    """RFC 3339, the same with a space, seconds and milliseconds as text, by each of the tolerant parsers."""
    ev = events(spark, sf_dir)
    kind = F.col("event_id") % 4
    written = (F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
                .when(kind == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS'+00:00'"))
                .when(kind == 2, F.unix_seconds("ts").cast("string")).otherwise(F.unix_millis("ts").cast("string")))
    t = F.col("t")
    # Milliseconds read as seconds lie outside every calendar; only the other layouts are asked.
    seconds = F.when(kind < 3, times.parse_or_seconds(t))
    return ev.select("event_id", written.alias("t")).select(
        "event_id", F.unix_micros(times.parse_index_time(t)).alias("index_us"), F.unix_micros(seconds).alias("text_us"),
        F.unix_micros(times.parse_json_time(t)).alias("json_us"))


@query("timezone_labels", EV + """
SELECT harness, 'Local time (UTC+05:30 at span start)' AS offset_label, 'Europe/Oslo' AS name_label
FROM sessions GROUP BY harness""")
def timezone_labels(spark, sf_dir):
    spans = ev_sessions(spark, sf_dir).groupBy("harness").agg(F.min("started_at").alias("start"))
    return spans.select("harness", times.timezone_label("+05:30", F.col("start")).alias("offset_label"),
                        times.timezone_label("Europe/Oslo", F.col("start")).alias("name_label"))


@query("json_presence", """
SELECT turn % 6 AS kind, count(*) AS n, count(*) FILTER (turn % 6 IN (3, 4, 5)) AS present FROM conversations GROUP BY 1""")
def json_presence(spark, sf_dir):
    """Absent, null and empty objects carry no value; text, an empty list and a filled object do."""
    kind = F.col("turn") % 6
    body = (F.when(kind == 1, "null").when(kind == 2, "{}").when(kind == 3, F.to_json(F.struct("text")))
             .when(kind == 4, "[]").when(kind == 5, '"x"'))
    rows = table(spark, sf_dir, "conversations").select(kind.alias("kind"), jsonx.present(F.try_parse_json(body)).alias("has"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("has").alias("present"))


@query("chat_folders", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'proj-' || p_size END AS project,
  CASE WHEN p_partkey % 5 IN (0, 1) THEN p_brand END AS label
FROM part""")
def chat_folders(spark, sf_dir):
    """Project from the folder above ``chats``, none from a hash; the one label of a list, none from two or no usable ones."""
    k = F.col("p_partkey")
    folder = F.when(k % 3 == 0, F.md5(k.cast("string"))).otherwise(F.concat(F.lit("proj-"), F.col("p_size")))
    path = F.concat(F.lit("/lake/s/gemini/tmp/"), folder, F.lit("/chats/"), F.when(k % 2 == 0, F.lit("sub/")).otherwise(F.lit("")),
                    F.lit("session-1.jsonl"))
    brand, none = F.col("p_brand"), F.lit(None).cast("string")
    ids = (F.when(k % 5 == 0, F.array(brand, F.lit(" "), brand)).when(k % 5 == 1, F.array(none, brand))
            .when(k % 5 == 2, F.array(brand, F.lit("other"))).when(k % 5 == 3, F.array(F.lit("/home/x"), F.lit(""))))
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.chat_folder_project(path).alias("project"), text.single_label(ids).alias("label"))
