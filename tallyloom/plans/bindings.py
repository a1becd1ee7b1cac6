"""Binding of the driver tables to the canonical tables, in Spark and in SQL.

The driver tables hold no agent histories. ``events`` becomes sessions, prompts,
calls and tools; the SQL text below says the same for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.functions.text import WORD_PATTERN
from tallyloom.schemas import conform, usage
from tallyloom.session import configure

#: Word count of a ``text`` column, for the oracle.
WORDS_SQL = f"len(regexp_extract_all(text, '{WORD_PATTERN}'))"
HARNESSES = ("claude", "codex", "hermes", "cursor")
MTIME = "file modification time (no physical-session record)"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    frame = configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    frame = frame.select(*columns) if columns else frame
    # The files hold wall-clock times without a zone; the session zone is UTC.
    zoneless = [f.name for f in frame.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return frame.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def micros(column: str) -> Column:
    return F.unix_micros(column)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    names = F.array(*[F.lit(h) for h in HARNESSES])
    return ev.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"), F.lit("s").alias("store_id"),
        F.element_at(names, (F.col("user_id") % 4 + 1).cast("int")).alias("harness"),
        F.concat_ws("-", "user_id", F.to_date("ts").cast("string")).alias("session_id"))


def event_ord(at: str = "ts", position: str = "event_id") -> Column:
    return F.struct(F.lit(0).cast("bigint").alias("src"), F.unix_micros(at).alias("block"),
                    F.col(position).cast("bigint").alias("n"))


def ev_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    first_k = F.min_by("k", F.struct("ts", "event_id"))
    rows = events(spark, sf_dir).groupBy("store_id", "harness", "session_id", "user_id").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), first_k.alias("fk"),
        F.count(F.lit(1)).alias("n"), F.sum("k").alias("ks"),
        F.count_if(F.col("event_type") == "purchase").alias("purchases"),
        F.count_if(F.col("event_type") == "error").alias("tool_calls"))
    named = F.when(F.col("fk") % 13 != 0, F.concat(F.lit("p"), (F.col("fk") % 12).cast("string")))
    basis = (F.when(user % 13 == 4, MTIME).when(user % 5 == 0, "prompt timestamps")
              .otherwise("session start"))
    full = rows.withColumns({
        "session_key": F.col("session_id"), "is_child": user % 7 == 3, "project": named,
        "activity_at": F.col("started_at"), "activity_basis": basis, "has_calls": F.col("purchases") > 0,
        "usage": usage("session columns", user % 2 == 0, input=F.col("n") * 10, output=F.col("ks")),
        "unanchored": user % 11 == 5, "history_only": user % 19 == 8, "time_unavailable": user % 17 == 6})
    return conform(full, "sessions")


def _session_of(events_df: DataFrame, sessions: DataFrame) -> DataFrame:
    heads = sessions.select("store_id", "harness", "session_id", "session_key", "is_child",
                            F.col("started_at").alias("session_at"), "has_calls")
    return events_df.join(heads, ["store_id", "harness", "session_id"])


def ev_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where(F.col("event_type").isin("view", "click"))
    joined = _session_of(rows, ev_sessions(spark, sf_dir))
    return conform(joined.withColumns({
        "ord": event_ord(), "at": F.col("ts"), "words": F.col("k").cast("long"),
        "characters": F.col("k").cast("long") * 5, "has_text": F.col("k") % 10 != 0,
        "event_id": F.when(F.col("event_id") % 50 != 0, (F.col("event_id") % 2000).cast("string"))}), "prompts")


def ev_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where(F.col("event_type") == "purchase")
    joined = _session_of(rows, ev_sessions(spark, sf_dir))
    return conform(joined.withColumns({
        "ord": event_ord(),
        "call_id": F.when(F.col("event_id") % 60 != 0, (F.col("event_id") % 1500).cast("string")),
        "model": F.when(F.col("k") % 5 != 4, F.concat(F.lit("m"), (F.col("k") % 5).cast("string"))),
        "usage": usage("message.usage", F.col("k") % 9 != 0, output=F.col("k"),
                       input=F.floor(F.col("value") * 100).cast("bigint"))}), "calls")


def ev_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where(F.col("event_type") == "purchase")
    joined = _session_of(rows, ev_sessions(spark, sf_dir))
    return conform(joined.withColumns({
        "ord": event_ord(),
        "tool_id": F.when(F.col("k") % 10 != 0, F.concat(F.lit("t"), (F.col("event_id") % 700).cast("string"))),
    }), "tools")


def ev_model_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where(F.col("event_type") == "signup")
    joined = _session_of(rows, ev_sessions(spark, sf_dir)).where(~F.col("has_calls"))
    named = joined.withColumn("model", F.concat(F.lit("s"), (F.col("k") % 3).cast("string")))
    return conform(named.groupBy("store_id", "harness", "session_key", "session_id", "is_child",
                                 "session_at", "model").agg(F.count(F.lit(1)).alias("turns")), "model_activity")


def ev_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors become warning codes by ``k``; a third of the codes are loss codes."""
    codes = F.array(*[F.lit(c) for c in ("malformed_record", "copied_prompts", "duplicate_tool_use")])
    rows = events(spark, sf_dir).where((F.col("event_type") == "error") & (F.col("user_id") % 4 != 2))
    return conform(rows.select("store_id", "harness", F.element_at(codes, (F.col("k") % 3 + 1).cast("int")).alias("code"))
                   .groupBy("store_id", "harness", "code").agg(F.count(F.lit(1)).alias("n")), "warnings")


EV = f"""
WITH ev AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         ['claude', 'codex', 'hermes', 'cursor'][CAST(1 + user_id % 4 AS INTEGER)] AS harness,
         user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id
  FROM events),
heads AS (
  SELECT harness, session_id, user_id, min(ts) AS started_at, max(ts) AS ended_at,
         first(k ORDER BY ts, event_id) AS fk, count(*) AS n, sum(k) AS ks,
         count(*) FILTER (event_type = 'purchase') AS purchases,
         count(*) FILTER (event_type = 'error') AS tool_calls
  FROM ev GROUP BY harness, session_id, user_id),
sessions AS (
  SELECT harness, session_id, user_id, started_at, ended_at, tool_calls, purchases > 0 AS has_calls,
         user_id % 7 = 3 AS is_child,
         CASE WHEN fk % 13 <> 0 THEN 'p' || (fk % 12) END AS project,
         CASE WHEN user_id % 13 = 4 THEN '{MTIME}'
              WHEN user_id % 5 = 0 THEN 'prompt timestamps' ELSE 'session start' END AS basis,
         user_id % 2 = 0 AS available, n * 10 AS u_input, ks AS u_output,
         user_id % 11 = 5 AS unanchored, user_id % 17 = 6 AS untimed, user_id % 19 = 8 AS history_only,
         NOT (user_id % 7 = 3) AND NOT (user_id % 11 = 5) AND NOT (user_id % 13 = 4) AS countable
  FROM heads),
timed AS (SELECT * FROM sessions WHERE countable AND NOT untimed),
prompts AS (
  SELECT e.harness, e.session_id, s.started_at AS session_at, e.ts, e.event_id AS pos, s.is_child,
         CASE WHEN e.event_id % 50 <> 0 THEN CAST(e.event_id % 2000 AS VARCHAR) END AS id,
         e.k AS words, e.k * 5 AS characters, e.k % 10 <> 0 AS has_text
  FROM ev e JOIN sessions s USING (harness, session_id) WHERE e.event_type IN ('view', 'click')),
first_prompts AS (
  SELECT * FROM prompts WHERE NOT is_child
  QUALIFY row_number() OVER (PARTITION BY harness, coalesce(id, 'row' || pos)
                             ORDER BY session_at, session_id, ts, pos) = 1),
calls AS (
  SELECT e.harness, e.session_id, s.started_at AS session_at, e.ts, e.event_id AS pos, s.is_child,
         CASE WHEN e.event_id % 60 <> 0 THEN CAST(e.event_id % 1500 AS VARCHAR) END AS id,
         CASE WHEN e.k % 5 <> 4 THEN 'm' || (e.k % 5) END AS model, e.k % 9 <> 0 AS available,
         CAST(floor(e.value * 100) AS BIGINT) AS u_input, e.k AS u_output,
         CASE WHEN e.k % 10 <> 0 THEN 't' || (e.event_id % 700) END AS tool_id
  FROM ev e JOIN sessions s USING (harness, session_id) WHERE e.event_type = 'purchase'),
first_calls AS (
  SELECT * FROM calls WHERE NOT is_child
  QUALIFY row_number() OVER (PARTITION BY harness, coalesce(id, 'row' || pos)
                             ORDER BY session_at, session_id, ts, pos) = 1),
turns AS (
  SELECT harness, model, CAST(count(*) AS BIGINT) AS turns FROM (
    SELECT harness, model FROM first_calls WHERE model IS NOT NULL
    UNION ALL
    SELECT e.harness, 's' || (e.k % 3) FROM ev e JOIN sessions s USING (harness, session_id)
    WHERE e.event_type = 'signup' AND NOT s.has_calls AND NOT s.is_child)
  GROUP BY harness, model),
projects AS (
  SELECT project AS name, count(*) AS sessions FROM sessions
  WHERE countable AND project IS NOT NULL GROUP BY project),
warns AS (
  SELECT harness, ['malformed_record', 'copied_prompts', 'duplicate_tool_use'][CAST(1 + k % 3 AS INTEGER)] AS code,
         count(*) AS n
  FROM ev WHERE event_type = 'error' AND user_id % 4 <> 2 GROUP BY ALL),
days AS (SELECT CAST(started_at AS DATE) AS date, count(*) AS n FROM timed GROUP BY ALL),
hours AS (
  SELECT h.hour, count(t.started_at) AS n
  FROM (SELECT unnest(range(24)) AS hour) h LEFT JOIN timed t ON hour(t.started_at) = h.hour GROUP BY h.hour)
"""
ORD = """
WITH days AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY ALL),
span AS (SELECT min(date) AS first, max(date) AS last FROM days),
calendar AS (
  SELECT CAST(g.d AS DATE) AS date, coalesce(days.n, 0) AS n
  FROM (SELECT unnest(generate_series(first, last, INTERVAL 1 DAY)) AS d FROM span) g
  LEFT JOIN days ON days.date = CAST(g.d AS DATE))
"""
