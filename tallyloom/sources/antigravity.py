"""Conversation index and step transcripts of the ``antigravity`` harness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.functions import jsonx, text, times
from tallyloom.operators.metrics import ledger
from tallyloom.schemas import Tables, usage
from tallyloom.sources import sqlite
from tallyloom.sources.common import assemble, attach, complete_sessions, row_ord, store_of, with_prompts_only
from tallyloom.sources.lake import LAZY, Lake, Stage, byte_limit, existing, list_files, records, scan_lines, warning_rows

HARNESS = "antigravity"
# Limits, bases, labels.
#: Fixed values of the original tool, in force if the job asks for them (lake.byte_limit).
MAX_CHUNK_BYTES = 8 << 20
MAX_LINE_BYTES = 8 << 20
BASIS_INDEX = "conversation last-modified time"
BASIS_STEPS = "transcript step timestamps"
USAGE_SOURCE = "Antigravity step transcript token counts"
TRANSCRIPT_PATTERN = r"/brain/([^/]+)/\.system_generated/logs/transcript\.jsonl$"
STEP = ("step_index bigint, type string, created_at string, input_tokens bigint, output_tokens bigint, "
        "cache_read_tokens bigint, tool_calls array<variant>")


def slice_prompts(body: Column, marks: Column) -> Column:
    """Array of (step, words, characters, has_text) cut out of one UTF-8 body.

    ``marks`` is an array of (step, offset) in step order. Offsets that do not
    fit leave every prompt without sizes; so does a piece that is not UTF-8.
    """
    size = F.octet_length(body)
    following = F.slice(marks, F.lit(2), F.size(marks))
    ends = F.concat(F.transform(following, lambda m: m["offset"]), F.array(size.cast("bigint")))
    spans = F.arrays_zip(marks.alias("m"), ends.alias("e"))

    def cut(s: Column) -> Column:
        m = s["m"]
        start, end = m["offset"], s["e"]
        piece = F.substring(body, start.cast("int") + 1, (end - start).cast("int")).cast("string")
        good = (start >= 0) & (end >= start) & (end <= size) & F.is_valid_utf8(piece)
        return F.struct(m["step"].alias("step"), F.when(good, piece).alias("piece"))

    return F.transform(spans, cut)


def offsets_fit(marks: Column, size: Column) -> Column:
    """Offsets never fall and never pass the end."""
    edges = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(marks, lambda m: m["offset"]), F.array(size.cast("bigint")))
    steps = F.sequence(F.lit(1), F.size(edges) - 1)
    return F.forall(steps, lambda i: F.element_at(edges, i) <= F.element_at(edges, i + 1))


def prompt_chunks(chunks: DataFrame) -> DataFrame:
    """One row per prompt mark; ``state`` tells what could not be read."""
    raw = F.trim(F.coalesce("user_step_byte_offsets", F.lit("")))
    pairs = F.from_json(raw, "array<array<bigint>>")
    parsed = chunks.withColumns({
        "body": F.coalesce("user_body", F.lit("").cast("binary")), "blank": raw == "", "pairs": pairs})
    marks = F.array_sort(F.transform(F.col("pairs"), lambda p, i: F.struct(
        F.coalesce(F.try_element_at(p, F.lit(1)), F.lit(0)).alias("step"), i.alias("i"),
        F.coalesce(F.try_element_at(p, F.lit(2)), F.lit(0)).alias("offset"))))
    sized = parsed.withColumn("marks", F.when(F.col("blank"), F.array().cast(
        "array<struct<step:bigint,i:int,offset:bigint>>")).otherwise(marks))
    # Size is counted in characters, as the index stores it.
    oversize = F.length(F.col("body").cast("string")) > byte_limit(chunks.sparkSession, MAX_CHUNK_BYTES)
    fits = offsets_fit(F.col("marks"), F.octet_length("body"))
    state = (F.when(oversize, "oversize").when(F.col("marks").isNull(), "malformed")
              .when(~fits & (F.size("marks") > 0), "unfit").otherwise("ok"))
    return sized.withColumn("state", state)


def normalize(spark: SparkSession, summaries: DataFrame, chunks: DataFrame, transcripts: DataFrame,
              source_files: DataFrame, problems: DataFrame | None = None, forced: DataFrame | None = None,
              stage: Stage = LAZY) -> Tables:
    """``summaries``, ``chunks``: database rows with store_id; ``transcripts``: raw lines."""
    modified = times.parse_index_time(F.col("last_modified_time"))
    uris = F.from_json("workspace_uris", "array<string>")
    parent = text.blank_to_null(F.col("parent_conversation_id"))
    base = summaries.where(F.coalesce("conversation_id", F.lit("")) != "").select(
        "store_id", F.col("conversation_id").alias("session_id"), parent.alias("parent_id"),
        (parent.isNotNull() | (F.coalesce("nesting_depth", F.lit(0)) > 0)).alias("is_child"), modified.alias("modified"),
        text.project_from_file_uris(uris).alias("project"),
        F.when(F.col("last_user_input_step_index") >= 0, F.col("last_user_input_step_index")).alias("input_step"),
        times.parse_index_time(F.col("last_user_input_time")).alias("input_at"))

    rows = records(transcripts, MAX_LINE_BYTES).where(F.col("oversize") | jsonx.nonblank(F.col("line"))).withColumn(
        "r", jsonx.parse_record(F.col("line"), STEP))
    r = F.col("r")
    malformed = ~F.col("oversize") & jsonx.is_malformed(F.col("line"), r)
    planner = F.coalesce(r["type"] == "PLANNER_RESPONSE", F.lit(False))
    spent = F.coalesce(r["input_tokens"] > 0, F.lit(False)) | F.coalesce(r["output_tokens"] > 0, F.lit(False)) | \
        F.coalesce(r["cache_read_tokens"] > 0, F.lit(False))
    steps = stage(rows.select(
        "store_id", F.regexp_extract("path", TRANSCRIPT_PATTERN, 1).alias("session_id"), "line_key", "oversize",
        malformed.alias("malformed"), r["step_index"].alias("step"), times.parse_index_time(r["created_at"]).alias("at"),
        F.when(planner, F.coalesce(F.size(r["tool_calls"]), F.lit(0))).otherwise(0).cast("bigint").alias("tools"),
        usage(USAGE_SOURCE, planner & spent, input=r["input_tokens"], output=r["output_tokens"],
              cache_read=r["cache_read_tokens"]).alias("usage")).join(
        base.select("store_id", "session_id"), ["store_id", "session_id"], "left_semi"), "antigravity_steps")
    good = steps.where(~F.col("oversize") & ~F.col("malformed"))
    spans = good.groupBy("store_id", "session_id").agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.sum("tools").alias("tool_calls"))
    spent_rows = ledger(good, ("store_id", "session_id"), F.col("line_key"))
    spent_rows = spent_rows.select("store_id", "session_id", usage(
        F.coalesce("source", F.lit("")), F.col("available"), input=F.col("input"), output=F.col("output"),
        cache_read=F.col("cache_read")).alias("usage"))
    last_step = good.where(F.col("at").isNotNull() & F.col("step").isNotNull()).groupBy(
        "store_id", "session_id", "step").agg(F.max_by("at", "line_key").alias("step_at"))

    joined = base.join(spans, ["store_id", "session_id"], "left").join(spent_rows, ["store_id", "session_id"], "left")
    stepped = F.col("first_at").isNotNull()
    start = F.least("modified", "first_at")
    sessions = complete_sessions(joined.select(
        "store_id", "session_id", "parent_id", "is_child", "project", start.alias("started_at"),
        F.greatest("modified", "last_at").alias("ended_at"),
        F.when(stepped, BASIS_STEPS).otherwise(BASIS_INDEX).alias("activity_basis"),
        F.coalesce("tool_calls", F.lit(0)).alias("tool_calls"), F.coalesce("usage", usage("", False)).alias("usage"),
        start.isNull().alias("time_unavailable"), "input_step", "input_at"), HARNESS)

    placed = stage(prompt_chunks(chunks.withColumnRenamed("conversation_id", "session_id").join(
        base.select("store_id", "session_id"), ["store_id", "session_id"], "left_semi")).select(
        "store_id", "session_id", "state", "row_n",
        F.transform(F.when(F.col("state") == "ok", slice_prompts(F.col("body"), F.col("marks"))).when(
            F.col("state") == "unfit", F.transform("marks", lambda m: F.struct(
                m["step"].alias("step"), F.lit(None).cast("string").alias("piece")))),
            lambda p: F.struct(p["step"].alias("step"), F.coalesce(text.words(p["piece"]), F.lit(0)).alias("words"),
                               F.coalesce(text.characters(p["piece"]), F.lit(0)).alias("characters"),
                               text.has_text(p["piece"]).alias("has_text"))).alias("marks")), "antigravity_chunks")
    marks = placed.select("store_id", "session_id", "row_n", F.explode("marks").alias("m")).select(
        "store_id", "session_id", "row_n", "m.*").join(last_step, ["store_id", "session_id", "step"], "left").join(
        base.select("store_id", "session_id", "input_step", "input_at"), ["store_id", "session_id"])
    prompts = marks.select(
        "store_id", "session_id", F.concat_ws("#", "session_id", F.col("step").cast("string")).alias("event_id"),
        row_ord(F.col("row_n") * (1 << 20) + F.col("step")).alias("ord"),
        F.coalesce("step_at", F.when(F.col("step") == F.col("input_step"), F.col("input_at"))).alias("at"),
        "words", "characters", "has_text")
    warned = [
        warning_rows(placed, {"oversize_index_chunk": F.col("state") == "oversize",
                              "malformed_prompt_index": F.col("state") == "malformed",
                              "prompt_text_slices_invalid": F.col("state") == "unfit"}, HARNESS),
        warning_rows(steps, {"oversize_transcript_line": F.col("oversize"),
                             "malformed_transcript_line": F.col("malformed")}, HARNESS)]
    if problems is not None:
        warned.append(problems)
    owned = attach(prompts, sessions)
    return assemble(spark, HARNESS, with_prompts_only(sessions, owned), owned, source_files, warned, None, forced,
                    good.select("store_id"), None, stage)


def read(spark: SparkSession, lake: Lake, stage: Stage | None = None) -> Tables:
    stage = stage or Stage.shared(spark)
    paths = existing(spark, lake.globs("antigravity"))

    def rows(table: str, ddl: str, where: str | None = None) -> DataFrame:
        return sqlite.read_table(spark, paths, table, ddl, where).withColumn("store_id", store_of(lake, F.col("path")))

    summaries = rows("conversation_summaries", "conversation_id string, last_modified_time string, workspace_uris string, "
                     "parent_conversation_id string, nesting_depth bigint, last_user_input_time string, "
                     "last_user_input_step_index bigint")
    chunks = rows("conversations_fts", "conversation_id string, chunk_index string, user_step_byte_offsets string, "
                  "user_body binary", "CAST(chunk_index AS INTEGER) >= 0")
    columns = sqlite.table_columns(spark, paths).withColumn("store_id", store_of(lake, F.col("path")))
    need = ("conversation_id", "last_modified_time", "workspace_uris", "parent_conversation_id", "nesting_depth",
            "last_user_input_time", "last_user_input_step_index")
    fts = ("conversation_id", "chunk_index", "user_step_byte_offsets", "user_body")

    def lacks(table: str, names: tuple[str, ...]) -> Column:
        return F.count_if((F.col("table_name") == table) & F.col("column_name").isin(*names)) < len(names)

    facts = columns.groupBy("store_id").agg(F.bool_and("readable").alias("readable"),
                                            lacks("conversation_summaries", need).alias("unknown"),
                                            lacks("conversations_fts", fts).alias("no_fts"))
    known = F.col("readable") & ~F.col("unknown")
    problems = warning_rows(facts, {"sqlite_snapshot_failed": ~F.col("readable"),
                                    "unknown_schema": F.col("readable") & F.col("unknown"),
                                    "prompt_metrics_unavailable": known & F.col("no_fts")}, HARNESS)
    forced = facts.select("store_id", F.when(~F.col("readable"), "unavailable").when(F.col("unknown"), "unsupported schema")
                          .alias("forced")).where(F.col("forced").isNotNull())
    scripts = list_files(spark, lake, "antigravity_transcripts", "transcript.jsonl")
    files = list_files(spark, lake, "antigravity").select("store_id").unionByName(scripts.select("store_id"))
    return normalize(spark, summaries, chunks, scan_lines(spark, lake, "antigravity_transcripts", "transcript.jsonl"),
                     files, problems, forced, stage)
