"""The ``cursor`` composer database: modern and legacy headers, stored bubbles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.functions import jsonx, text, times
from tallyloom.operators.dedupe import precedence_union
from tallyloom.operators.reconcile import missing_rows
from tallyloom.schemas import Tables
from tallyloom.sources import sqlite
from tallyloom.sources.common import assemble, attach, complete_sessions, row_ord, store_of, with_prompts_only
from tallyloom.sources.lake import LAZY, Lake, Stage, existing, list_files, warning_rows

HARNESS = "cursor"
# Keys and JSON fields of the store.
LEGACY_KEYS = ("composer.composerHeaders", "composer.composerData")
HEADER = ("composerId:string,createdAt:bigint,lastUpdatedAt:bigint,isSubagent:boolean,isBestOfNSubcomposer:boolean,"
          "isDraft:boolean,isEphemeral:boolean,subagentInfo:struct<parentComposerId:string>")
BUBBLE_HEADER = "struct<bubbleId:string,type:int,createdAt:string,isDisplayOnly:boolean,isSimulated:boolean>"
COMPOSER = (f"composerId string, workspaceIdentifier struct<uri:string>, "
            f"fullConversationHeadersOnly array<{BUBBLE_HEADER}>")
BUBBLE = ("bubbleId string, type int, text string, createdAt string, isDisplayOnly boolean, isSimulated boolean, "
          "modelInfo struct<modelName:string>")


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _nonzero(c: Column) -> Column:
    return F.when(c != 0, c)


def keep_headers(headers: DataFrame) -> DataFrame:
    """Usable composer headers as session rows: no drafts, a time is required."""
    h = F.col("h")
    created = F.coalesce(F.when(h["createdAt"] > 0, h["createdAt"]), h["lastUpdatedAt"])
    updated = F.coalesce(F.when(h["lastUpdatedAt"] > 0, h["lastUpdatedAt"]), created)
    child = _yes(h["isSubagent"]) | _yes(h["isBestOfNSubcomposer"]) | h["subagentInfo"].isNotNull()
    return headers.where((F.coalesce(h["composerId"], F.lit("")) != "") & ~_yes(h["isDraft"]) & ~_yes(h["isEphemeral"])
                         & (created > 0)).select(
        "store_id", h["composerId"].alias("session_id"), "position",
        text.blank_to_null(h["subagentInfo"]["parentComposerId"]).alias("parent_id"), child.alias("is_child"),
        times.from_millis(created).alias("started_at"), times.from_millis(updated).alias("ended_at"))


def modern_headers(rows: DataFrame) -> DataFrame:
    """Rows of the header table; the stored JSON fills what the columns lack."""
    stored = F.from_json("value", ", ".join(f.replace(":", " ", 1) for f in _split(HEADER)))
    r = rows.withColumn("v", stored)
    v = F.col("v")
    h = F.struct(
        F.coalesce(text.blank_to_null(F.col("composerId")), v["composerId"]).alias("composerId"),
        F.coalesce(_nonzero(F.col("createdAt")), v["createdAt"]).alias("createdAt"),
        F.coalesce(_nonzero(F.col("lastUpdatedAt")), v["lastUpdatedAt"]).alias("lastUpdatedAt"),
        (_yes(F.col("isSubagent") != 0) | _yes(v["isSubagent"])).alias("isSubagent"),
        v["isBestOfNSubcomposer"].alias("isBestOfNSubcomposer"), v["isDraft"].alias("isDraft"),
        v["isEphemeral"].alias("isEphemeral"), v["subagentInfo"].alias("subagentInfo"))
    return r.select("store_id", h.alias("h"), F.col("row_n").alias("position"))


def _split(ddl: str) -> list[str]:
    """Top-level fields of a struct body."""
    out, depth, current = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(current)
            current = ""
        else:
            current += ch
    return [*out, current]


def legacy_headers(items: DataFrame) -> DataFrame:
    parsed = items.where(F.col("key").isin(*LEGACY_KEYS)).withColumn(
        "v", F.from_json("value", f"allComposers array<struct<{HEADER}>>"))
    rank = F.when(F.col("key") == LEGACY_KEYS[0], 0).otherwise(1)
    return parsed.select("store_id", rank.alias("_r"), F.posexplode("v.allComposers").alias("_p", "h")).select(
        "store_id", "h", (F.col("_r").cast("bigint") * (1 << 40) + F.col("_p")).alias("position"))


def normalize(spark: SparkSession, modern: DataFrame, items: DataFrame, kv: DataFrame, source_files: DataFrame,
              problems: DataFrame | None = None, forced: DataFrame | None = None, stage: Stage = LAZY) -> Tables:
    """``modern``: composerHeaders rows; ``items``: ItemTable rows; ``kv``: cursorDiskKV rows."""
    # Headers and composers are read by several tables each: their JSON is parsed once.
    merged = stage(precedence_union([keep_headers(modern_headers(modern)), keep_headers(legacy_headers(items))],
                                    ["store_id", "session_id"], ["position"]), "cursor_merged")

    data = kv.where(F.col("key").startswith("composerData:")).withColumn("r", jsonx.parse_record(F.col("value"), COMPOSER))
    cid = F.substring(F.col("key"), len("composerData:") + 1, 1 << 30)
    bad = jsonx.is_malformed(F.col("value"), F.col("r"))
    named = F.coalesce(F.col("r.composerId"), F.lit(""))
    mismatch = ~bad & ((cid == "") | ((named != "") & (named != cid)))
    uri = text.blank_to_null(F.col("r.workspaceIdentifier.uri"))
    checked = stage(data.select(
        "store_id", cid.alias("session_id"), bad.alias("bad"), mismatch.alias("mismatch"),
        F.when(uri.isNotNull(), text.project_from_uri(uri)).alias("project"),
        F.col("r.fullConversationHeadersOnly").alias("list")), "cursor_composers")
    composers = checked.where(~F.col("bad") & ~F.col("mismatch")).join(
        merged.select("store_id", "session_id"), ["store_id", "session_id"], "left_semi")
    meta = composers.select("store_id", "session_id", "project", F.col("list").isNotNull().alias("canonical"))
    spread = composers.select("store_id", "session_id", F.posexplode("list").alias("pos", "h"))
    heads = spread.where(F.coalesce("h.bubbleId", F.lit("")) != "").select(
        "store_id", "session_id", F.col("h.bubbleId").alias("bubble_id"), "pos",
        ((F.col("h.type") == 1) & ~_yes(F.col("h.isDisplayOnly")) & ~_yes(F.col("h.isSimulated"))).alias("eligible"),
        times.parse_json_time(F.col("h.createdAt")).alias("head_at"))
    heads = stage(heads.groupBy("store_id", "session_id", "bubble_id").agg(
        F.max_by(F.struct("eligible", "head_at"), F.col("pos")).alias("h")).select(
        "store_id", "session_id", "bubble_id", F.coalesce("h.eligible", F.lit(False)).alias("eligible"), "h.head_at"),
        "cursor_heads")

    parts = F.split("key", ":", 3)
    keyed = kv.where(F.col("key").startswith("bubbleId:")).select(
        "store_id", "value", "row_n", F.try_element_at(parts, F.lit(2)).alias("session_id"),
        F.try_element_at(parts, F.lit(3)).alias("bubble_id"))
    bad_key = (F.coalesce("session_id", F.lit("")) == "") | (F.coalesce("bubble_id", F.lit("")) == "")
    stored = keyed.where(~bad_key).join(
        merged.select("store_id", "session_id").join(meta.select("store_id", "session_id", "canonical"),
                                                     ["store_id", "session_id"], "left"), ["store_id", "session_id"])
    stored = stored.join(heads, ["store_id", "session_id", "bubble_id"], "left").where(
        ~_yes(F.col("canonical")) | _yes(F.col("eligible")))
    parsed = stored.withColumn("r", jsonx.parse_record(F.col("value"), BUBBLE))
    r = F.col("r")
    broken = jsonx.is_malformed(F.col("value"), r)
    human = ~broken & _yes(r["type"] == 1) & ~_yes(r["isDisplayOnly"]) & ~_yes(r["isSimulated"])
    wrong = human & (F.coalesce(r["bubbleId"], F.lit("")) != "") & (r["bubbleId"] != F.col("bubble_id"))
    body = F.coalesce(r["text"], F.lit(""))
    bubbles = stage(parsed.select(
        "store_id", "session_id", F.col("bubble_id").alias("event_id"), "row_n", broken.alias("broken"),
        _yes(wrong).alias("wrong"), (human & ~_yes(wrong)).alias("prompt"),
        F.coalesce(times.parse_json_time(r["createdAt"]), F.col("head_at")).alias("at"),
        text.words(body).alias("words"), text.characters(body).alias("characters"), text.has_text(body).alias("has_text"),
        text.safe_label(r["modelInfo"]["modelName"], 100).alias("model")), "cursor_bubbles")
    lost = missing_rows(heads.where("eligible").select("store_id", "session_id", F.col("bubble_id").alias("event_id")),
                        bubbles, ["store_id", "session_id", "event_id"])
    warned = [
        warning_rows(checked, {"malformed_composer": F.col("bad"), "mismatched_composer_id": F.col("mismatch")}, HARNESS),
        warning_rows(keyed, {"malformed_bubble_key": bad_key}, HARNESS),
        warning_rows(bubbles, {"malformed_bubble": F.col("broken"), "mismatched_bubble_id": F.col("wrong")}, HARNESS),
        warning_rows(lost, {"missing_bubble_body": F.lit(True)}, HARNESS)]
    if problems is not None:
        warned.append(problems)
    sessions = complete_sessions(merged.join(meta.select("store_id", "session_id", "project"),
                                             ["store_id", "session_id"], "left").withColumn(
        "activity_basis", F.lit("composer creation")), HARNESS)
    human_rows = bubbles.where("prompt").withColumn("ord", row_ord(F.col("row_n")))
    prompts = attach(human_rows, sessions)
    models = prompts.where(F.col("model").isNotNull()).groupBy(
        "store_id", "harness", "session_key", "session_id", "is_child", "session_at", "model").agg(
        F.count(F.lit(1)).alias("turns"))
    return assemble(spark, HARNESS, with_prompts_only(sessions, prompts), prompts, source_files, warned, models,
                    forced, False, None, stage)


def read(spark: SparkSession, lake: Lake, stage: Stage | None = None) -> Tables:
    stage = stage or Stage.shared(spark)
    paths = existing(spark, lake.globs("cursor"))

    def rows(table: str, ddl: str, where: str | None = None) -> DataFrame:
        df = sqlite.read_table(spark, paths, table, ddl, where)
        return df.withColumn("store_id", store_of(lake, F.col("path")))

    modern = rows("composerHeaders", "composerId string, createdAt bigint, lastUpdatedAt bigint, isSubagent bigint, value string")
    keys = ", ".join(f"'{k}'" for k in LEGACY_KEYS)
    items = rows("ItemTable", "key string, value string", f"key IN ({keys})")
    kv = rows("cursorDiskKV", "key string, value string",
              "key >= 'composerData:' AND key < 'composerData;' OR key >= 'bubbleId:' AND key < 'bubbleId;'")
    columns = sqlite.table_columns(spark, paths).withColumn("store_id", store_of(lake, F.col("path")))

    def has(table: str, *names: str) -> Column:
        return F.count_if((F.col("table_name") == table) & F.col("column_name").isin(*names)) == len(names)

    facts = columns.groupBy("store_id").agg(
        F.bool_and("readable").alias("readable"), has("composerHeaders", "composerId").alias("modern"),
        has("ItemTable", "key", "value").alias("legacy"), has("cursorDiskKV", "key", "value").alias("kv"))
    unknown = F.col("readable") & ~F.col("modern") & ~F.col("legacy")
    no_kv = F.col("readable") & ~unknown & ~F.col("kv")
    problems = warning_rows(facts, {"sqlite_snapshot_failed": ~F.col("readable"), "unknown_schema": unknown,
                                    "composer_metadata_unavailable": no_kv, "prompt_metrics_unavailable": no_kv}, HARNESS)
    forced = facts.select("store_id", F.when(~F.col("readable"), "unavailable").when(unknown, "unsupported schema")
                          .alias("forced")).where(F.col("forced").isNotNull())
    files = list_files(spark, lake, "cursor").select("store_id")
    return normalize(spark, modern, items, kv, files, problems, forced, stage)
