"""The ``hermes`` state database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.functions import text, times
from tallyloom.operators.metrics import ledger
from tallyloom.schemas import Tables, usage
from tallyloom.sources import sqlite
from tallyloom.sources.common import assemble, attach, complete_sessions, row_ord, store_of
from tallyloom.sources.lake import LAZY, Lake, Stage, existing, list_files, warning_rows

HARNESS = "hermes"
# Columns every supported schema has, and usage sources.
TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens")
SESSION_COLUMNS = ("id", "parent_session_id", "started_at", "ended_at", "last_activity_at", "git_repo_root", "cwd",
                   "tool_call_count", "model", "api_call_count", *TOKENS)
MESSAGE_COLUMNS = ("id", "session_id", "role", "content", "timestamp", "_compressed_summary")
USAGE_COLUMNS = ("session_id", "model", "api_call_count", *TOKENS)
SOURCE_MODEL, SOURCE_SESSION = "session_model_usage", "sessions token columns"
_TOKEN_DDL = ", ".join(f"{t} bigint" for t in TOKENS)


def _usage(source: str):
    return usage(source, True, **{k: F.col(c) for k, c in zip(
        ("input", "output", "cache_read", "cache_write", "reasoning"), TOKENS)})


def prompts(messages: DataFrame) -> DataFrame:
    """One prompt per stored event.

    Compaction copies share session, time and content; a group with several live
    rows counts once per live row. Without the activity flag every row counts.
    """
    body = F.col("content")
    rows = messages.where((F.col("role") == "user") & (F.coalesce("_compressed_summary", F.lit(0)) == 0)
                          & (F.coalesce(body, F.lit("")) != "")).select(
        "store_id", "session_id", "id", F.col("timestamp").alias("ts"), F.sha2(body, 256).alias("digest"),
        F.array_contains("columns", "active").alias("flagged"), F.coalesce("active", F.lit(0)).alias("active"),
        text.words(body).alias("words"), text.characters(body).alias("characters"))
    shape = [F.min("id").alias("id"), F.min("words").alias("words"), F.min("characters").alias("characters")]
    groups = rows.where("flagged").groupBy("store_id", "session_id", "ts", "digest").agg(
        *shape, F.count_if(F.col("active") == 1).alias("live"))
    identity = F.concat_ws(":", F.col("ts").cast("string"), F.substring("digest", 1, 16), F.col("session_id"))
    many = F.greatest(F.col("live"), F.lit(1))
    copies = groups.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), many - 1))).select(
        "store_id", "session_id", "ts", "id", "words", "characters",
        F.when(many > 1, F.concat_ws("#", identity, "i")).otherwise(identity).alias("event_id"))
    plain = rows.where(~F.col("flagged")).select("store_id", "session_id", "ts", "id", "words", "characters",
                                                 F.col("id").cast("string").alias("event_id"))
    return copies.unionByName(plain).withColumns({
        "at": F.timestamp_seconds("ts"), "has_text": F.lit(True), "ord": row_ord(F.col("id"))})


def normalize(spark: SparkSession, sessions: DataFrame, messages: DataFrame, model_usage: DataFrame,
              source_files: DataFrame, problems: DataFrame | None = None, forced: DataFrame | None = None,
              stage: Stage = LAZY) -> Tables:
    """``sessions``, ``messages``, ``model_usage``: rows of the three tables with store_id."""
    s = sessions.select(
        "store_id", F.col("id").alias("session_id"), text.blank_to_null(F.col("parent_session_id")).alias("parent_id"),
        F.timestamp_seconds("started_at").alias("started_at"),
        F.timestamp_seconds(F.coalesce("ended_at", "last_activity_at", "started_at")).alias("ended_at"),
        F.coalesce(text.project_name(F.col("git_repo_root")), text.project_name(F.col("cwd"))).alias("project"),
        F.coalesce("tool_call_count", F.lit(0)).alias("tool_calls"), text.safe_label(F.col("model"), 100).alias("model"),
        F.coalesce("api_call_count", F.lit(0)).alias("api_calls"), _usage(SOURCE_SESSION).alias("own_usage"),
        F.lit("session start").alias("activity_basis"))
    s = s.withColumn("is_child", F.col("parent_id").isNotNull())
    rows = model_usage.select("store_id", "session_id", text.safe_label(F.col("model"), 100).alias("model"),
                              F.coalesce("api_call_count", F.lit(0)).alias("turns"), _usage(SOURCE_MODEL).alias("usage"))
    summed = ledger(rows, ("store_id", "session_id"), F.lit(0)).select(
        "store_id", "session_id", F.struct("available", "exact", "input", "output", "cache_read", "cache_write",
                                           "reasoning", "source").alias("listed"))
    full = stage(s.join(summed, ["store_id", "session_id"], "left").withColumn(
        "usage", F.coalesce("listed", "own_usage")), "hermes_base")
    done = complete_sessions(full, HARNESS)
    listed = attach(rows.where(F.col("model").isNotNull()), done)
    own = done.where(F.col("listed").isNull() & F.col("model").isNotNull()).select(
        "store_id", "harness", "session_key", "session_id", "is_child", F.col("started_at").alias("session_at"),
        "model", F.col("api_calls").alias("turns"))
    models = listed.drop("usage").unionByName(own)
    warned = [problems] if problems is not None else []
    return assemble(spark, HARNESS, done, attach(prompts(messages), done), source_files, warned, models,
                    forced, True, None, stage)


def schema_problems(lake: Lake, spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(warnings, forced statuses) per store from the columns each file has."""
    columns = sqlite.table_columns(spark, paths).withColumn("store_id", store_of(lake, F.col("path")))

    def lacks(table: str, wanted: tuple[str, ...]):
        have = F.count_if((F.col("table_name") == table) & F.col("column_name").isin(*wanted))
        return have < len(wanted)

    facts = columns.groupBy("store_id").agg(
        F.bool_and("readable").alias("readable"), lacks("sessions", SESSION_COLUMNS).alias("no_sessions"),
        lacks("messages", MESSAGE_COLUMNS).alias("no_messages"), lacks("messages", ("active",)).alias("no_active"),
        lacks("session_model_usage", USAGE_COLUMNS).alias("no_usage"))
    known = F.col("readable") & ~F.col("no_sessions")
    warned = warning_rows(facts, {
        "sqlite_snapshot_failed": ~F.col("readable"), "unknown_schema": F.col("readable") & F.col("no_sessions"),
        "prompt_metrics_unavailable": known & F.col("no_messages"),
        "prompt_identity_unavailable": known & ~F.col("no_messages") & F.col("no_active"),
        "model_usage_unavailable": known & F.col("no_usage")}, HARNESS)
    forced = facts.select("store_id", F.when(~F.col("readable"), "unavailable").when(F.col("no_sessions"), "unsupported schema")
                          .alias("forced")).where(F.col("forced").isNotNull())
    return warned, forced


def read(spark: SparkSession, lake: Lake, stage: Stage | None = None) -> Tables:
    stage = stage or Stage.shared(spark)
    paths = existing(spark, lake.globs("hermes"))
    warned, forced = schema_problems(lake, spark, paths)

    def rows(table: str, ddl: str, where: str | None = None) -> DataFrame:
        df = sqlite.read_table(spark, paths, table, ddl, where)
        return df.withColumn("store_id", store_of(lake, F.col("path")))

    sessions = rows("sessions", "id string, parent_session_id string, started_at double, ended_at double, "
                    "last_activity_at double, git_repo_root string, cwd string, tool_call_count bigint, model string, "
                    f"api_call_count bigint, {_TOKEN_DDL}")
    complete = F.size(F.array_intersect("columns", F.array(*[F.lit(c) for c in SESSION_COLUMNS]))) == len(SESSION_COLUMNS)
    messages = rows("messages", "id bigint, session_id string, role string, content string, timestamp double, "
                    "active bigint, _compressed_summary bigint", "role = 'user'")
    model_usage = rows("session_model_usage", f"session_id string, model string, api_call_count bigint, {_TOKEN_DDL}")
    files = list_files(spark, lake, "hermes").select("store_id")
    return normalize(spark, sessions.where(complete), messages, model_usage, files, warned, forced, stage)
