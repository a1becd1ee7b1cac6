"""Markdown chat logs of the ``aider`` harness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.functions import text, times
from tallyloom.operators import ordered
from tallyloom.schemas import Tables, published_ord
from tallyloom.sources.common import assemble, attach, complete_sessions, with_prompts_only
from tallyloom.sources.lake import LAZY, Lake, Stage, list_files, records, scan_lines, warning_rows

HARNESS = "aider"
#: Fixed values of the original tool, in force if the job asks for them (lake.byte_limit).
MAX_LINE_BYTES = 4 << 20
# Line grammar of the log.
START_PREFIX = "# aider chat started at "
USER_PREFIX = "#### "
USER_SUFFIX = "  "
BLANK_PROMPT = "<blank>"


def parse(raw: DataFrame, zone: str) -> DataFrame:
    """Content-free line events: headers, user lines (as sizes) and the rest."""
    rows = records(raw, MAX_LINE_BYTES)
    line = F.col("line")
    header = F.coalesce(line.startswith(START_PREFIX), F.lit(False))
    user = F.coalesce(~header & line.startswith(USER_PREFIX) & line.endswith(USER_SUFFIX), F.lit(False))
    start, shortest = len(USER_PREFIX) + 1, len(USER_PREFIX) + len(USER_SUFFIX)
    body = F.when(user, F.expr(f"substring(line, {start}, greatest(length(line) - {shortest}, 0))"))
    started = times.parse_local(text.trim_unicode(F.expr(f"substring(line, {len(START_PREFIX) + 1})")), zone)
    return rows.select(
        "store_id", "line_key", "oversize", header.alias("header"), user.alias("user"),
        F.when(header, started).alias("started_at"), text.words(body).alias("words"),
        text.characters(body).alias("characters"), text.has_text(body).alias("has_text"),
        F.coalesce(body == BLANK_PROMPT, F.lit(False)).alias("blank"),
        text.project_name(F.regexp_replace("path", "/[^/]*$", "")).alias("project"))


def normalize(raw: DataFrame, source_files: DataFrame, zone: str = "UTC", stage: Stage = LAZY) -> Tables:
    """Headers open sessions; adjacent user lines form one prompt.

    A prompt's size is the sum over its lines plus the joining newlines, so the
    text of a prompt is never put together.
    """
    events = stage(parse(raw, zone), "aider_events")
    lines = events.where(~F.col("oversize")).withColumns(
        {"_path": F.col("line_key.path"), "_block": F.col("line_key.block")})
    key = ["store_id", "_path"]
    placed = ordered.running_sum(lines, key, ["_block"], ["line_key"], F.col("header").cast("bigint"), "session_no")
    placed = ordered.running_sum(placed, key, ["_block"], ["line_key"], (~F.col("user")).cast("bigint"), "island")
    placed = stage(placed.where(F.col("session_no") > 0).withColumn(
        "session_id", F.concat_ws("-", F.sha2("_path", 256), F.col("session_no").cast("string"))),
        "aider_placed")
    islands = placed.where("user").groupBy("store_id", "_path", "session_id", "island").agg(
        F.min("line_key").alias("line_key"), F.sum("words").alias("words"),
        (F.sum("characters") + F.count(F.lit(1)) - 1).alias("characters"),
        (F.bool_or("has_text") & ~(F.bool_and("blank") & (F.count(F.lit(1)) == 1))).alias("has_text"))
    islands = islands.withColumn("_block", F.col("line_key.block"))
    numbered = ordered.rank(islands, ["store_id", "session_id"], ["_block"], ["line_key"], "_n")
    prompts = numbered.select(
        "store_id", "session_id", F.concat_ws("#", "session_id", (F.col("_n") - 1).cast("string")).alias("event_id"),
        published_ord(F.col("line_key")).alias("ord"), F.lit(None).cast("timestamp").alias("at"), "words", "characters", "has_text")
    heads = placed.where("header")
    sessions = complete_sessions(heads.select(
        "store_id", "session_id", "started_at", F.col("started_at").alias("ended_at"), "project",
        F.lit("chat session start time").alias("activity_basis"), F.col("started_at").isNull().alias("time_unavailable")), HARNESS)
    warned = [warning_rows(events, {"oversize_history_line": F.col("oversize"),
                                    "unreadable_session_start": F.col("header") & F.col("started_at").isNull()}, HARNESS)]
    owned = attach(prompts, sessions)
    return assemble(raw.sparkSession, HARNESS, with_prompts_only(sessions, owned), owned, source_files, warned, stage=stage)


def read(spark: SparkSession, lake: Lake, stage: Stage | None = None, zone: str = "UTC") -> Tables:
    """Logs in each root and in the direct children of each root."""
    stage = stage or Stage.shared(spark)
    shallow = F.size(F.split("rel", "/")) <= 2
    name = "*aider.chat.history.md"
    return normalize(scan_lines(spark, lake, "aider", name).where(shallow),
                     list_files(spark, lake, "aider", name).where(shallow), zone, stage)
