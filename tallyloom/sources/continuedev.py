"""Chat documents and the session index of the ``continue`` harness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.functions import jsonx, text, times
from tallyloom.schemas import Tables, usage
from tallyloom.sources.common import assemble, attach, complete_sessions, row_ord, with_prompts_only
from tallyloom.sources.lake import LAZY, Lake, Stage, scan_documents, warning_rows

HARNESS = "continue"
INDEX_NAME = "sessions.json"
#: Fixed values of the original tool, in force if the job asks for them (lake.byte_limit).
MAX_SESSION_BYTES = 64 << 20
MAX_INDEX_BYTES = 16 << 20
BASIS = "session creation time"
USAGE_SOURCE = "Continue session usage block"
SESSION = ("sessionId string, workspaceDirectory string, chatModelTitle string, "
           "history array<struct<message:struct<role:string,content:variant>>>, usage struct<promptTokens:bigint,"
           "completionTokens:bigint,promptTokensDetails:struct<cachedTokens:bigint,cacheWriteTokens:bigint>,"
           "completionTokensDetails:struct<reasoningTokens:bigint>>")


def content_text(v):
    blocks = jsonx.as_blocks(v)
    joined = jsonx.joined_texts(blocks, lambda b: F.coalesce(b["type"] == "text", F.lit(False))
                                | (F.coalesce(b["text"], F.lit("")) != ""))
    return F.coalesce(F.when(jsonx.kind(v) == "string", jsonx.as_text(v)).otherwise(joined), F.lit(""))


def normalize(docs: DataFrame, index: DataFrame, stage: Stage = LAZY) -> Tables:
    """``docs``: one row per chat file; ``index``: one row per index file."""
    spark = docs.sparkSession
    opened = docs.withColumn("r", jsonx.parse_record(F.col("doc"), SESSION))
    r, u = F.col("r"), F.col("r.usage")
    bad = ~F.col("oversize") & jsonx.is_malformed(F.col("doc"), r)
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), r"\.json$", "")
    # Text leaves here: each turn keeps its role and sizes only.
    turns = F.transform(r["history"], lambda h, i: F.struct(
        i.alias("i"), h["message"]["role"].alias("role"),
        F.when(h["message"]["role"] == "user", content_text(h["message"]["content"])).alias("body")))
    sized = F.transform(turns, lambda t: F.struct(
        t["i"].alias("i"), t["role"].alias("role"), text.words(t["body"]).alias("words"),
        text.characters(t["body"]).alias("characters"), text.has_text(t["body"]).alias("has_text")))
    events = stage(opened.select(
        "store_id", "path", "oversize", bad.alias("bad"),
        F.coalesce(text.blank_to_null(r["sessionId"]), stem).alias("session_id"),
        text.project_name(r["workspaceDirectory"]).alias("project"), text.safe_label(r["chatModelTitle"], 80).alias("model"),
        usage(USAGE_SOURCE, ~bad & u.isNotNull(), input=u["promptTokens"], output=u["completionTokens"],
              cache_read=u["promptTokensDetails"]["cachedTokens"], cache_write=u["promptTokensDetails"]["cacheWriteTokens"],
              reasoning=u["completionTokensDetails"]["reasoningTokens"]).alias("usage"),
        F.when(~bad, sized).alias("turns")), "continue_events")
    entries = index.withColumn("r", F.from_json("doc", "array<struct<sessionId:string,dateCreated:string>>"))
    unreadable = F.col("oversize") | F.col("r").isNull()
    created = entries.select("store_id", F.posexplode("r").alias("i", "e")).select(
        "store_id", F.col("e.sessionId").alias("session_id"), "i",
        times.from_millis(F.col("e.dateCreated").try_cast("bigint")).alias("at")).where(F.col("at").isNotNull())
    created = created.groupBy("store_id", "session_id").agg(F.max_by("at", "i").alias("created"))
    rows = events.where(~F.col("oversize") & ~F.col("bad")).join(created, ["store_id", "session_id"], "left")
    key = F.concat_ws("\x1f", "session_id", F.sha2("path", 256))
    found = F.col("created").isNotNull()
    sessions = complete_sessions(rows.select(
        "store_id", "session_id", key.alias("session_key"), "project", "usage", "model",
        F.col("created").alias("started_at"), F.col("created").alias("ended_at"),
        F.when(found, BASIS).alias("activity_basis"), (~found).alias("time_unavailable"),
        F.size(F.filter("turns", lambda t: t["role"] == "assistant")).cast("bigint").alias("replies"), "turns"), HARNESS)
    prompts = sessions.select("store_id", "harness", "session_key", "session_id", "is_child",
                              F.col("started_at").alias("session_at"), F.explode("turns").alias("t")).where(
        F.col("t.role") == "user").select(
        "store_id", "harness", "session_key", "session_id", "is_child", "session_at",
        F.concat_ws("#", "session_id", F.col("t.i").cast("string")).alias("event_id"), row_ord(F.col("t.i")).alias("ord"),
        F.lit(None).cast("timestamp").alias("at"), "t.words", "t.characters", "t.has_text")
    counted = with_prompts_only(sessions.drop("turns"), prompts)
    models = counted.where(F.col("model").isNotNull()).select(
        "store_id", "harness", "session_key", "session_id", "is_child", F.col("started_at").alias("session_at"),
        "model", F.col("replies").alias("turns"))
    warned = [
        warning_rows(events, {"oversize_session": F.col("oversize"), "malformed_session": F.col("bad")}, HARNESS),
        warning_rows(entries, {"sessions_index_unreadable": unreadable}, HARNESS),
        warning_rows(counted, {"missing_creation_time": F.col("time_unavailable")}, HARNESS)]
    return assemble(spark, HARNESS, counted, prompts, docs.select("store_id"), warned, models, stage=stage)


def read(spark: SparkSession, lake: Lake, stage: Stage | None = None) -> Tables:
    stage = stage or Stage.shared(spark)
    top = ~F.col("rel").contains("/")
    files = scan_documents(spark, lake, "continue", MAX_SESSION_BYTES, "*.json").where(top & (F.col("rel") != INDEX_NAME))
    index = scan_documents(spark, lake, "continue", MAX_INDEX_BYTES, INDEX_NAME).where(top)
    return normalize(files, index, stage)
