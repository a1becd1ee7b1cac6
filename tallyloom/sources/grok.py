"""Per-directory prompt-history logs of the ``grok`` harness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.functions import jsonx, text, times
from tallyloom.operators import ordered
from tallyloom.schemas import Tables, published_ord
from tallyloom.sources.common import assemble, attach, complete_sessions
from tallyloom.sources.lake import LAZY, Lake, Stage, list_files, records, scan_lines, warning_rows

HARNESS = "grok"
#: Fixed values of the original tool, in force if the job asks for them (lake.byte_limit).
MAX_LINE_BYTES = 1 << 20


def parse(raw: DataFrame) -> DataFrame:
    own = raw.where(F.col("rel").rlike(r"^[^/]+/prompt_history\.jsonl$"))
    rows = records(own, MAX_LINE_BYTES).withColumn("r", jsonx.parse_record(
        F.col("line"), "is_bash boolean, prompt string, session_id string, timestamp string"))
    r = F.col("r")
    malformed = ~F.col("oversize") & jsonx.is_malformed(F.col("line"), r)
    named = text.blank_to_null(r["session_id"])
    body = F.coalesce(r["prompt"], F.lit(""))
    folder = F.element_at(F.split("path", "/"), -2)
    return rows.select(
        "store_id", "line_key", "oversize", malformed.alias("malformed"),
        (~F.col("oversize") & ~malformed & named.isNull()).alias("unnamed"), named.alias("session_id"),
        times.parse_or_seconds(r["timestamp"]).alias("at"), text.words(body).alias("words"),
        text.characters(body).alias("characters"), text.has_text(body).alias("has_text"),
        text.project_name(text.decode_directory(folder)).alias("project"))


def normalize(raw: DataFrame, source_files: DataFrame, stage: Stage = LAZY) -> Tables:
    events = stage(parse(raw), "grok_events")
    good = events.where(F.col("session_id").isNotNull()).withColumns(
        {"_path": F.col("line_key.path"), "_block": F.col("line_key.block")})
    numbered = ordered.rank(good, ["store_id", "session_id"], ["_path", "_block"], [F.col("line_key.n")], "_n")
    prompts = numbered.withColumns({"event_id": F.concat_ws("#", "session_id", (F.col("_n") - 1).cast("string")),
                                    "ord": published_ord(F.col("line_key"))}).drop("_path", "_block", "_n")
    sessions = complete_sessions(good.groupBy("store_id", "session_id").agg(
        F.min("at").alias("started_at"), F.max("at").alias("ended_at"), F.max("at").alias("activity_at"),
        F.min_by("project", F.when(F.col("project").isNotNull(), F.col("line_key"))).alias("project"),
        F.lit("prompt timestamps").alias("activity_basis")), HARNESS)
    warned = [warning_rows(events, {"oversize_prompt_record": F.col("oversize"), "malformed_prompt_record": F.col("malformed"),
                                    "missing_session_id": F.col("unnamed")}, HARNESS)]
    return assemble(raw.sparkSession, HARNESS, sessions, attach(prompts.drop("project"), sessions), source_files, warned,
                    stage=stage)


def read(spark: SparkSession, lake: Lake, stage: Stage | None = None) -> Tables:
    stage = stage or Stage.shared(spark)
    files = list_files(spark, lake, "grok", "prompt_history.jsonl").where(F.size(F.split("rel", "/")) == 2)
    return normalize(scan_lines(spark, lake, "grok", "prompt_history.jsonl"), files, stage)
