"""The ``copilot`` session store. Reply text is never selected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.functions import text, times
from tallyloom.schemas import Tables
from tallyloom.sources import sqlite
from tallyloom.sources.common import assemble, attach, complete_sessions, row_ord, store_of, with_prompts_only
from tallyloom.sources.lake import LAZY, Lake, Stage, existing, list_files, warning_rows

HARNESS = "copilot"


def normalize(spark: SparkSession, sessions: DataFrame, turns: DataFrame, source_files: DataFrame,
              problems: DataFrame | None = None, forced: DataFrame | None = None, stage: Stage = LAZY) -> Tables:
    """``sessions``: store_id, id, cwd, created_at, updated_at; ``turns``: store_id, session_id, ..."""
    body = F.coalesce("user_message", F.lit(""))
    prompts = turns.select(
        "store_id", "session_id", F.concat_ws("#", "session_id", F.col("turn_index").cast("string")).alias("event_id"),
        row_ord(F.col("turn_index")).alias("ord"), times.parse_rfc3339(F.col("timestamp")).alias("at"),
        text.words(body).alias("words"), text.characters(body).alias("characters"), text.has_text(body).alias("has_text"))
    started = times.parse_rfc3339(F.col("created_at"))
    base = sessions.where(F.coalesce("id", F.lit("")) != "").select(
        "store_id", F.col("id").alias("session_id"), started.alias("started_at"),
        F.coalesce(times.parse_rfc3339(F.col("updated_at")), started).alias("recorded_end"),
        text.project_name(F.col("cwd")).alias("project"), F.lit("session creation").alias("activity_basis"))
    last = prompts.groupBy("store_id", "session_id").agg(F.max("at").alias("last_at"))
    full = complete_sessions(base.join(last, ["store_id", "session_id"], "left").withColumn(
        "ended_at", F.greatest("recorded_end", "last_at")), HARNESS)
    owned = attach(prompts, full)
    return assemble(spark, HARNESS, with_prompts_only(full, owned), owned, source_files,
                    [problems] if problems is not None else [], None, forced, False, None, stage)


def read(spark: SparkSession, lake: Lake, stage: Stage | None = None) -> Tables:
    stage = stage or Stage.shared(spark)
    paths = existing(spark, lake.globs("copilot"))

    def rows(table: str, ddl: str) -> DataFrame:
        return sqlite.read_table(spark, paths, table, ddl).withColumn("store_id", store_of(lake, F.col("path")))

    columns = sqlite.table_columns(spark, paths).withColumn("store_id", store_of(lake, F.col("path")))
    need_s, need_t = ("id", "cwd", "created_at", "updated_at"), ("session_id", "turn_index", "user_message", "timestamp")
    facts = columns.groupBy("store_id").agg(
        F.bool_and("readable").alias("readable"),
        (F.count_if((F.col("table_name") == "sessions") & F.col("column_name").isin(*need_s)) < len(need_s)).alias("no_s"),
        (F.count_if((F.col("table_name") == "turns") & F.col("column_name").isin(*need_t)) < len(need_t)).alias("no_t"))
    known = F.col("readable") & ~F.col("no_s")
    problems = warning_rows(facts, {"sqlite_snapshot_failed": ~F.col("readable"), "unknown_schema": F.col("readable") & F.col("no_s"),
                                    "prompt_metrics_unavailable": known & F.col("no_t")}, HARNESS)
    forced = facts.select("store_id", F.when(~F.col("readable"), "unavailable").when(F.col("no_s"), "unsupported schema")
                          .alias("forced")).where(F.col("forced").isNotNull())
    files = list_files(spark, lake, "copilot").select("store_id")
    return normalize(spark, rows("sessions", "id string, cwd string, created_at string, updated_at string"),
                     rows("turns", "session_id string, turn_index bigint, user_message string, timestamp string"),
                     files, problems, forced, stage)
