"""Transcripts, prompt history and id-only indexes of the ``claude`` harness."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.functions import jsonx, text, times
from tallyloom.operators import copies, coverage, dedupe, ordered, reconcile
from tallyloom.schemas import Tables, published_ord, tables, usage
from tallyloom.sources.lake import (LAZY, Lake, Stage, list_files, records, scan_documents, scan_lines,
                                    sum_warnings, warning_rows)

HARNESS = "claude"
SCOPE = ["store_id", "harness"]
# Limits, labels and the synthetic-turn marker of the source.
#: Fixed values of the original tool, in force if the job asks for them (lake.byte_limit).
MAX_RECORD_BYTES = 64 << 20
SYNTHETIC_MODEL = "<synthetic>"
BASIS_RECORD = "physical session record"
BASIS_UNTIMED = "physical record timestamp unavailable"
BASIS_MTIME = "file modification time (no physical-session record)"
BASIS_HISTORY = "prompt history timestamp"
USAGE_SOURCE = "message.usage"

RECORD = (
    "uuid string, type string, timestamp string, sessionId string, agentId string, cwd string, "
    "isSidechain boolean, isMeta boolean, isCompactSummary boolean, isVisibleInTranscriptOnly boolean, "
    "sourceToolAssistantUUID string, toolUseResult variant, "
    "message struct<id:string,role:string,model:string,content:variant,usage:struct<"
    "input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,"
    "cache_creation_input_tokens:bigint,output_tokens_details:struct<thinking_tokens:bigint>>>")


def exclusion_counts(rows: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """Each reason counted on its own (they overlap), their union, and the rest."""
    any_flag = F.greatest(*[F.coalesce(f, F.lit(False)) for f in flags.values()])
    return rows.agg(*[F.count_if(f).alias(n) for n, f in flags.items()],
                    F.count_if(any_flag).alias("excluded"), F.count_if(~any_flag).alias("kept"))


def place(raw: DataFrame) -> DataFrame:
    """Keep transcripts only: depth 2 is a root, below ``subagents`` a child."""
    parts = F.split("rel", "/")
    stem = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
    root = F.size(parts) == 2
    child = ((F.size(parts) >= 4) & (F.try_element_at(parts, F.lit(3)) == "subagents")
             & F.element_at(parts, -1).startswith("agent-"))
    return (raw.where(F.col("path").endswith(".jsonl")).withColumns({
        "child_path": child, "_root": root,
        "physical_id": F.when(child, F.regexp_replace(stem, "^agent-", "")).otherwise(stem),
        "path_parent": F.when(child, F.try_element_at(parts, F.lit(2)))})
        .where(F.col("child_path") | F.col("_root")).drop("_root"))


def parse(raw: DataFrame) -> DataFrame:
    """Content-free events, one per line: sizes, ids, times and flags."""
    rows = records(place(raw), MAX_RECORD_BYTES).withColumn("r", jsonx.parse_record(F.col("line"), RECORD))
    r = F.col("r")
    malformed = ~F.col("oversize") & jsonx.is_malformed(F.col("line"), r)
    ok = ~F.col("oversize") & ~malformed
    message = r["message"]
    is_user = ok & F.coalesce((r["type"] == "user") & (message["role"] == "user"), F.lit(False))
    is_reply = ok & F.coalesce((r["type"] == "assistant") & (message["role"] == "assistant"), F.lit(False))

    def yes(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    own = text.blank_to_null(r["sessionId"])
    belongs = ok & (yes(own == F.col("physical_id")) | (F.col("child_path") & (
        yes(r["agentId"] == F.col("physical_id")) | yes(F.coalesce(r["agentId"], F.lit("")) == ""))))
    base = rows.select(
        "store_id", "path", "line_key", "mtime", "child_path", "physical_id", "path_parent", "oversize",
        malformed.alias("malformed"), is_user.alias("is_user"), is_reply.alias("is_reply"),
        belongs.alias("belongs"), yes(r["isSidechain"]).alias("sidechain"), own.alias("record_session"),
        F.when(ok, times.parse_rfc3339(r["timestamp"])).alias("at"), r["cwd"].alias("cwd"),
        yes(r["isMeta"]).alias("x_meta"),
        (F.coalesce(r["sourceToolAssistantUUID"], F.lit("")) != "").alias("x_source_tool"),
        jsonx.present(r["toolUseResult"]).alias("x_tool_result"),
        yes(r["isCompactSummary"]).alias("x_compact"),
        yes(r["isVisibleInTranscriptOnly"]).alias("x_transcript_only"),
        text.blank_to_null(r["uuid"]).alias("uuid"), text.blank_to_null(message["id"]).alias("call_id"),
        message["model"].alias("model"), message["usage"].alias("u"), message["content"].alias("content"))
    excluded = F.col("is_user") & (F.col("x_meta") | F.col("x_source_tool") | F.col("x_tool_result")
                                   | F.col("x_compact") | F.col("x_transcript_only"))
    content = F.col("content")
    blocks = jsonx.as_blocks(content)
    kinds = base.withColumns({
        "excluded": excluded, "owner": F.col("is_user") & ~excluded,
        "kind": F.when(F.col("is_user") | F.col("is_reply"), F.coalesce(jsonx.kind(content), F.lit("absent"))),
        "blocks": F.when(F.col("is_user") | F.col("is_reply"), blocks)})
    joined = jsonx.joined_texts(F.col("blocks"), lambda b: (b["type"] == "text") & jsonx.nonblank(b["text"]))
    body = (F.when(F.col("kind") == "string", jsonx.as_text(content))
             .when(F.col("blocks").isNotNull(), joined).otherwise(F.lit("")))
    attached = F.coalesce(F.exists("blocks", lambda b: b["type"].isin("image", "document")), F.lit(False))
    # An explicit null decodes to empty text; anything else that is neither text
    # nor an array of parts is not readable.
    readable = F.col("kind").isin("string", "null") | F.col("blocks").isNotNull()
    sized = kinds.withColumn("body", F.when(F.col("owner"), body))
    textual = jsonx.nonblank(F.col("body"))
    counts_prompt = F.col("owner") & (textual | attached)
    label = text.safe_label(F.col("model"), 100)
    u = F.col("u")
    tools = F.transform(F.filter("blocks", lambda b: b["type"] == "tool_use"),
                        lambda b: F.coalesce(b["id"], F.lit("")))
    reply_usage = usage(USAGE_SOURCE, F.col("is_reply") & u.isNotNull(), input=u["input_tokens"],
                        output=u["output_tokens"], cache_read=u["cache_read_input_tokens"],
                        cache_write=u["cache_creation_input_tokens"],
                        reasoning=u["output_tokens_details"]["thinking_tokens"])
    return sized.select(
        "store_id", "path", "line_key", "mtime", "child_path", "physical_id", "path_parent", "oversize",
        "malformed", "is_user", "is_reply", "belongs", "sidechain", "record_session", "at", "excluded",
        "x_meta", "x_source_tool", "x_tool_result", "x_compact", "x_transcript_only", "uuid", "call_id",
        F.when(F.col("belongs"), text.project_name(F.col("cwd"))).alias("project"),
        counts_prompt.alias("is_prompt"), (F.col("owner") & ~readable).alias("unreadable_prompt"),
        F.when(textual, text.words(F.col("body"))).otherwise(0).alias("words"),
        F.when(textual, text.characters(F.col("body"))).otherwise(0).alias("characters"),
        textual.alias("has_text"),
        F.when(F.col("is_reply") & (label != SYNTHETIC_MODEL), label).alias("model"),
        (F.col("is_reply") & F.coalesce(label == SYNTHETIC_MODEL, F.lit(False))).alias("synthetic"),
        reply_usage.alias("usage"),
        F.when(F.col("is_reply"), F.coalesce(tools, F.array().cast("array<string>"))).alias("tool_ids"),
        (F.col("is_reply") & F.col("blocks").isNull() & jsonx.present(content)).alias("unreadable_content"))


def session_files(events: DataFrame, listing: DataFrame | None) -> DataFrame:
    """One row per transcript file; files without a line come from the listing."""
    columns = ["store_id", "path", "mtime", "child_path", "physical_id", "path_parent"]
    facts = ["belongs", "sidechain", "at", "project", "line_key"]
    rows = events.select(*columns, *facts)
    if listing is not None:
        rows = rows.unionByName(place(listing).select(*columns), allowMissingColumns=True)
    mine = F.coalesce(F.col("belongs"), F.lit(False))
    files = rows.groupBy("store_id", "path").agg(
        *[F.max(c).alias(c) for c in columns[2:]],
        F.min(F.when(mine, F.col("at"))).alias("first_at"), F.max(F.when(mine, F.col("at"))).alias("last_at"),
        F.min(F.when(~F.col("child_path"), F.col("at"))).alias("earliest_record"),
        F.bool_or(mine).alias("physical"), F.bool_or(mine & F.col("sidechain")).alias("side"),
        F.min_by("project", F.when(mine & F.col("project").isNotNull(), F.col("line_key"))).alias("project"))
    anchored = F.col("first_at").isNotNull()
    orphan = ~anchored & ~F.col("physical")
    child = F.col("child_path") | F.coalesce(F.col("side"), F.lit(False))
    return files.select(
        "store_id", F.lit(HARNESS).alias("harness"), "path", F.col("physical_id").alias("session_id"),
        F.when(child, F.col("path_parent")).alias("parent_id"), child.alias("is_child"),
        F.when(child, F.concat_ws("\x1f", F.coalesce("path_parent", F.lit("")), F.col("physical_id")))
         .otherwise(F.col("physical_id")).alias("session_key"),
        F.when(orphan, F.col("mtime")).otherwise(F.col("first_at")).alias("started_at"),
        F.when(orphan, F.col("mtime")).otherwise(F.col("last_at")).alias("ended_at"),
        F.when(anchored, BASIS_RECORD).when(orphan, BASIS_MTIME).otherwise(BASIS_UNTIMED).alias("activity_basis"),
        "project", orphan.alias("unanchored"), (~anchored & F.col("physical")).alias("time_unavailable"),
        F.lit(False).alias("history_only"), "earliest_record")


HISTORY = "display string, project string, sessionId string, timestamp bigint"


def parse_history(raw: DataFrame) -> DataFrame:
    """Content-free prompt-history events; ``bad`` marks what was skipped."""
    rows = records(raw, MAX_RECORD_BYTES).withColumn("r", jsonx.parse_record(F.col("line"), HISTORY))
    r = F.col("r")
    bad = ~F.col("oversize") & (jsonx.is_malformed(F.col("line"), r)
                                | (F.coalesce(r["sessionId"], F.lit("")) == "")
                                | (F.coalesce(r["timestamp"], F.lit(0)) <= 0))
    shown = F.coalesce(r["display"], F.lit(""))
    return rows.select(
        "store_id", F.lit(HARNESS).alias("harness"), "line_key", "oversize", bad.alias("bad"),
        r["sessionId"].alias("session_id"), F.timestamp_millis(r["timestamp"]).alias("at"),
        r["timestamp"].alias("ms"), text.project_name(r["project"]).alias("project"),
        F.sha2(shown, 256).alias("digest"), text.words(shown).alias("words"),
        text.characters(shown).alias("characters"), text.has_text(shown).alias("has_text"))


def history_prompts(events: DataFrame) -> DataFrame:
    """Prompts with ids that number equal (session, time, text) rows per file."""
    good = events.where(~F.col("bad") & ~F.col("oversize")).withColumns(
        {"_path": F.col("line_key.path"), "_block": F.col("line_key.block")})
    numbered = ordered.rank(good, ["store_id", "_path", "session_id", "ms", "digest"], ["_block"],
                            [F.col("line_key.n")], "_occurrence")
    stamp = F.concat_ws(":", F.lit("history"), "session_id", "ms", "digest", "_occurrence")
    return numbered.withColumn("event_id", stamp)


STATE = "projects map<string,struct<lastSessionId:string,lastSessionModified:bigint,lastStartTime:bigint>>"
CODE_INDEX = ("cliSessionId string, priorCliSessionIds array<string>, bridgeSessionIds array<string>, "
              "forkedFromSessionId string, createdAt bigint, lastActivityAt bigint")
PROJECT_INDEX = "version int, entries array<struct<sessionId:string,created:string,modified:string>>"
# Evidence sources in the order they are consulted.
RANKS = {"unanchored": 0, "code_index": 1, "global_state": 2, "project_index": 3, "stats": 4}


def _evidence(df: DataFrame, source: str, ref: Column, *instants: Column) -> DataFrame:
    return df.select("store_id", F.lit(HARNESS).alias("harness"), F.lit(source).alias("source"),
                     F.lit(RANKS[source]).alias("source_rank"), text.blank_to_null(ref).alias("ref_id"),
                     F.array_min(F.array(*instants)).alias("at"))


def evidence(stats: DataFrame, state: DataFrame, code: DataFrame, project: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Id-and-date evidence of the four whole-file indexes, and their warnings."""
    def opened(df: DataFrame, schema: str) -> DataFrame:
        parsed = df.withColumn("r", jsonx.parse_record(F.col("doc"), schema))
        return parsed.withColumn("bad", ~F.col("oversize") & jsonx.is_malformed(F.col("doc"), F.col("r")))

    st = opened(stats, "firstSessionDate string")
    when = times.parse_rfc3339(F.col("r.firstSessionDate"))
    bad_date = (F.coalesce(F.col("r.firstSessionDate"), F.lit("")) != "") & when.isNull()
    first = _evidence(st.where(~F.col("bad")), "stats", F.lit(""), when)

    gs = opened(state, STATE)
    entry = gs.where(~F.col("bad")).select("store_id", F.explode(F.map_values("r.projects")).alias("e"))
    states = _evidence(entry, "global_state", F.col("e.lastSessionId"),
                       times.from_millis(F.col("e.lastSessionModified")), times.from_millis(F.col("e.lastStartTime")))

    ci = opened(code, CODE_INDEX)
    ids = F.array_union(F.array("r.cliSessionId"), F.coalesce("r.priorCliSessionIds", F.array().cast("array<string>")))
    codes = _evidence(ci.where(~F.col("bad")).select("store_id", "r", F.explode(ids).alias("e")), "code_index",
                      F.col("e"), times.from_millis(F.col("r.createdAt")), times.from_millis(F.col("r.lastActivityAt")))
    opaque = ci.where(~F.col("bad")).select("store_id", F.explode(F.array_union(
        F.coalesce("r.bridgeSessionIds", F.array().cast("array<string>")),
        F.array("r.forkedFromSessionId"))).alias("e")).where(F.col("e") != "")

    pi = opened(project, PROJECT_INDEX).withColumn(
        "bad", ~F.col("oversize") & (F.col("bad") | ~F.coalesce(F.col("r.version") == 1, F.lit(False))
                                     | F.col("r.entries").isNull()))
    item = pi.where(~F.col("bad")).select("store_id", "path", F.explode("r.entries").alias("e"))
    named = F.trim(F.coalesce("e.sessionId", F.lit(""))) != ""
    created, modified = times.parse_rfc3339(F.col("e.created")), times.parse_rfc3339(F.col("e.modified"))

    def broken(raw: Column, parsed: Column) -> Column:
        return (F.coalesce(raw, F.lit("")) != "") & parsed.isNull()

    bad_entry = ~named | broken(F.col("e.created"), created) | broken(F.col("e.modified"), modified)
    projects = _evidence(item.where(named), "project_index", F.col("e.sessionId"), created, modified)
    bad_files = item.groupBy("store_id", "path").agg(F.bool_or(bad_entry).alias("bad")).where("bad")

    warned = warning_rows(st, {"oversize_stats_cache": F.col("oversize"),
                               "malformed_stats_cache": F.col("bad") | (~F.col("oversize") & bad_date)}, HARNESS)
    for df, tag in ((gs, "global_state"), (ci, "code_session_index"), (pi, "project_session_index")):
        warned = warned.unionByName(warning_rows(df, {f"malformed_{tag}": F.col("bad"),
                                                      f"oversize_{tag}": F.col("oversize")}, HARNESS))
    warned = warned.unionByName(warning_rows(
        bad_files, {"malformed_project_session_index": F.lit(True)}, HARNESS)).unionByName(
        warning_rows(opaque.distinct(), {"desktop_session_references_unmapped": F.lit(True)}, HARNESS))
    return first.unionByName(states).unionByName(codes).unionByName(projects), warned


def normalize(raw: DataFrame, history: DataFrame | None = None, listing: DataFrame | None = None,
              indexes: tuple[DataFrame, DataFrame] | None = None, excluded: DataFrame | None = None,
              audit_files: DataFrame | None = None, stage: Stage = LAZY, with_status: bool = True) -> Tables:
    """Tables of the harness from raw lines.

    Without ``with_status`` the warning and provider tables stay empty.

    ``history``: raw prompt-history lines; ``indexes``: result of :func:`evidence`;
    ``excluded``: desktop transcripts (store_id); ``audit_files``: supplemental
    files per store, for the source-file count.
    """
    spark = raw.sparkSession
    events = stage(parse(raw), "claude_events")
    files = stage(session_files(events, listing), "claude_files")
    merged = copies.coalesce_sessions(files)

    place_of = files.select("store_id", "harness", "path", "session_key").join(
        merged.select("store_id", "harness", "session_key", "session_id", "is_child",
                      F.col("started_at").alias("session_at")), ["store_id", "harness", "session_key"])
    first_paths = files.groupBy("store_id", "harness", "session_key").agg(F.min("path").alias("first_path"))
    owners = place_of.join(first_paths, ["store_id", "harness", "session_key"]).withColumn(
        "first_copy", F.col("path") == F.col("first_path")).drop("first_path")
    event_columns = ["store_id", "harness", "session_key", "session_id", "is_child", "session_at"]

    prompt_rows = events.where("is_prompt").select(
        "store_id", "path", "line_key", "at", "words", "characters", "has_text", "record_session",
        F.col("uuid").alias("event_id")).join(owners, ["store_id", "path"])
    prompts = _union_prompts(prompt_rows, event_columns)

    calls_per_file = _file_calls(events)
    call_rows = calls_per_file.join(owners, ["store_id", "path"]).select(
        *event_columns, "call_id", "line_key", "model", "usage")
    merged_calls, conflicts = copies.merge_calls(call_rows)
    call_sessions = merged.select("store_id", "harness", "session_key", "session_id", "is_child",
                                  F.col("started_at").alias("session_at"))
    calls = stage(merged_calls.join(call_sessions, ["store_id", "harness", "session_key"])
                  .withColumn("ord", published_ord(F.col("line_key"))), "claude_calls")

    tool_rows = events.where("is_reply").select(
        "store_id", "path", "line_key", F.explode("tool_ids").alias("tool_id")).withColumn(
        "tool_id", text.blank_to_null(F.col("tool_id")))
    tool_owned = tool_rows.join(owners, ["store_id", "path"])
    tools = (tool_owned.where(F.col("tool_id").isNotNull())
             .groupBy(*event_columns, "tool_id").agg(F.min("line_key").alias("line_key"))
             .unionByName(tool_owned.where(F.col("tool_id").isNull())
                          .select(*event_columns, "tool_id", "line_key"))
             .withColumn("ord", published_ord(F.col("line_key"))))

    has_calls = calls.select("store_id", "harness", "session_key").distinct().withColumn("has_calls", F.lit(True))
    sessions = merged.join(has_calls, ["store_id", "harness", "session_key"], "left").withColumn(
        "has_calls", F.coalesce("has_calls", F.lit(False))).withColumns(
        {"tool_calls": F.lit(0), "usage": usage("", False)})

    # Prompt history: suppressed by detail, then by copied events, else history only.
    warned = []
    if history is not None:
        hist = stage(parse_history(history), "claude_history")
        warned.append(warning_rows(hist, {"malformed_history_record": F.col("bad"),
                                          "oversize_history_record": F.col("oversize")}, HARNESS))
        rows = dedupe.keep_first(history_prompts(hist), SCOPE + ["session_id"], "event_id", ["line_key"],
                                 ["at", "ms", "words", "characters", "has_text", "project", "line_key"])
        per_file = hist.where(~F.col("bad") & ~F.col("oversize")).groupBy(*SCOPE, "session_id").agg(
            (F.count_distinct("line_key.path") - 1).alias("n"))
        warned.append(warning_rows(per_file, {"copied_session_files_coalesced": F.col("n")}, HARNESS))
        repeats = rows.where(F.col("copies") > 1)
        warned.append(warning_rows(repeats.select("store_id", (F.col("copies") - 1).alias("n")),
                                   {"copied_session_prompt_records": F.col("n")}, HARNESS))
        anchored = merged.where(~F.col("is_child") & ~F.col("unanchored")).select(*SCOPE, "session_id")
        alone, suppressed = reconcile.split_history(rows, anchored, SCOPE + ["session_id"])
        warned.append(warning_rows(suppressed, {"history_records_reconciled": F.lit(True)}, HARNESS))
        stamps = _owner_stamps(events, files)
        chunked = alone.withColumn("_block", F.col("line_key.block"))
        split = stage(reconcile.bag_split(chunked, stamps, SCOPE + ["session_id", "ms"],
                                          ["_block"], ["line_key"]), "claude_history_rest")
        warned.append(warning_rows(split.where("_consumed"),
                                   {"copied_history_prompt_records_reconciled": F.lit(True)}, HARNESS))
        extra = alone.groupBy(*SCOPE, "session_id").agg(
            F.min("at").alias("started_at"), F.max("at").alias("ended_at"), F.min("at").alias("activity_at"),
            F.min_by("project", F.when(F.col("project").isNotNull(), F.col("line_key"))).alias("project")
        ).withColumns({"session_key": F.concat_ws("\x1f", F.lit("history"), "session_id"),
                       "is_child": F.lit(False), "activity_basis": F.lit(BASIS_HISTORY),
                       "has_calls": F.lit(False), "unanchored": F.lit(False), "history_only": F.lit(True),
                       "time_unavailable": F.lit(False), "tool_calls": F.lit(0), "usage": usage("", False)})
        sessions = sessions.unionByName(extra, allowMissingColumns=True)
        kept = split.where(~F.col("_consumed")).join(
            extra.select(*SCOPE, "session_id", "session_key", F.col("started_at").alias("session_at")),
            SCOPE + ["session_id"]).withColumns({"is_child": F.lit(False), "retained": F.lit(1).cast("long"),
                                                 "copies": F.lit(1).cast("long"),
                                                 "ord": published_ord(F.col("line_key"))})
        prompts = prompts.unionByName(kept.select(*prompts.columns), allowMissingColumns=True)
        warned.append(warning_rows(extra, {"history_only_sessions": F.lit(True)}, HARNESS))
    sessions = stage(sessions, "claude_sessions")
    prompts = stage(prompts, "claude_prompts")

    if not with_status:
        return tables(spark, sessions=sessions, prompts=prompts, calls=calls, tools=tools)
    warned += _record_warnings(events, calls_per_file, tool_rows, files)
    warned += _copy_warnings(merged, prompts, merged_calls, conflicts, calls)
    if excluded is not None:
        warned.append(warning_rows(excluded, {"desktop_local_agent_sessions_excluded": F.lit(True)}, HARNESS))

    refs, ref_warned = indexes if indexes else (None, None)
    cover, cover_warned = _coverage_facts(sessions, files, refs)
    warned += cover_warned + ([ref_warned] if ref_warned is not None else [])
    warnings = stage(sum_warnings(warned), "claude_warnings")
    providers = _provider_rows(spark, sessions, files, cover, warnings, audit_files)
    return tables(spark, sessions=sessions, prompts=prompts, calls=calls, tools=tools,
                  warnings=warnings, providers=providers)


def _union_prompts(rows: DataFrame, event_columns: list[str]) -> DataFrame:
    """One row per event id and session.

    ``retained`` counts rows that survive the merging of copies: repeats inside
    the first copy stay, repeats in later copies go.
    """
    solo = F.when(F.col("event_id").isNull(), F.col("line_key"))
    first = F.min_by(F.struct("line_key", "at", "words", "characters", "has_text"), F.col("line_key"))
    merged = rows.groupBy(*event_columns, "event_id", solo.alias("_solo")).agg(
        first.alias("p"), F.count(F.lit(1)).alias("copies"),
        F.greatest(F.count_if("first_copy"), F.lit(1)).alias("retained"))
    return merged.select(*event_columns, "event_id", "p.at", "p.words", "p.characters", "p.has_text",
                         published_ord(F.col("p.line_key")).alias("ord"), "copies", "retained")


def _file_calls(events: DataFrame) -> DataFrame:
    """Responses per file after merging their streamed updates."""
    replies = events.where("is_reply")
    named = dedupe.merge_updates(replies.where(F.col("call_id").isNotNull()), ["store_id", "path", "call_id"],
                                 F.col("line_key"), F.col("usage"), F.col("usage.available"), F.col("model"))
    single = replies.where(F.col("call_id").isNull()).select(
        "store_id", "path", "call_id", "usage", "model", F.col("line_key").alias("first_position"),
        F.lit(1).cast("long").alias("records"))
    return named.unionByName(single).withColumn("usage", F.coalesce("usage", usage("", False))).withColumnRenamed(
        "first_position", "line_key")


def _owner_stamps(events: DataFrame, files: DataFrame) -> DataFrame:
    """(session, millisecond) of each distinct owner prompt of a root file."""
    roots = files.where(~F.col("is_child")).select("store_id", "path")
    rows = events.where(F.col("is_prompt") & F.col("record_session").isNotNull() & F.col("at").isNotNull()).select(
        "store_id", "path", F.lit(HARNESS).alias("harness"), F.col("uuid").alias("event_id"), "line_key",
        F.col("record_session").alias("session_id"), F.unix_millis("at").alias("ms")).join(
        roots, ["store_id", "path"], "left_semi")
    solo = F.when(F.col("event_id").isNull(), F.col("line_key"))
    return (rows.groupBy(*SCOPE, "event_id", solo.alias("_solo"))
            .agg(F.min(F.struct("session_id", "ms")).alias("s")).select(*SCOPE, "s.session_id", "s.ms"))


def _record_warnings(events: DataFrame, file_calls: DataFrame, tool_rows: DataFrame,
                     files: DataFrame) -> list[DataFrame]:
    user, reply = F.col("is_user"), F.col("is_reply")
    out = [warning_rows(events, {
        "oversize_record": F.col("oversize"), "malformed_record": F.col("malformed"),
        "invalid_record_timestamp": (user | reply) & F.col("at").isNull(),
        "meta_prompts_excluded": user & F.col("x_meta"),
        "source_tool_prompts_excluded": user & F.col("x_source_tool"),
        "tool_result_prompts_excluded": user & F.col("x_tool_result"),
        "compact_summary_prompts_excluded": user & F.col("x_compact"),
        "transcript_only_prompts_excluded": user & F.col("x_transcript_only"),
        "owner_prompt_records_excluded": F.col("excluded"),
        "unparseable_owner_prompt": F.col("unreadable_prompt"),
        "owner_prompt_missing_id": F.col("is_prompt") & F.col("uuid").isNull(),
        "synthetic_model_records_excluded": F.col("synthetic"),
        "assistant_response_missing_id": reply & F.col("call_id").isNull(),
        "unparseable_assistant_content": F.col("unreadable_content")}, HARNESS)]
    updates = events.where(reply & F.col("call_id").isNotNull()).select(
        "store_id", "path", "call_id", "line_key", "usage", "model", F.col("line_key.block").alias("_block"))
    repeated = file_calls.where((F.col("records") > 1) & F.col("call_id").isNotNull()).select(
        "store_id", "path", "call_id")
    classed = dedupe.classify_updates(updates.join(repeated, ["store_id", "path", "call_id"], "left_semi"),
                                      ["store_id", "path", "call_id"], ["_block"], ["line_key"])
    label = F.col("update_class")
    out.append(warning_rows(classed, {
        "assistant_updates_merged": label != "first", "assistant_usage_completed": label == "completed",
        "assistant_usage_advanced": label == "advanced", "assistant_update_usage_conflict": label == "conflict",
        "assistant_update_model_conflict": F.col("model_changed")}, HARNESS))
    per_file = tool_rows.groupBy("store_id", "path", "tool_id").agg(F.count(F.lit(1)).alias("n"))
    missing = F.col("tool_id").isNull()
    out.append(warning_rows(per_file, {
        "tool_use_missing_id": F.when(missing, F.col("n")).otherwise(0),
        "duplicate_tool_use": F.when(missing, 0).otherwise(F.col("n") - 1)}, HARNESS))
    out.append(warning_rows(files, {"physical_session_time_unavailable": F.col("time_unavailable"),
                                    "unanchored_session": F.col("unanchored")}, HARNESS))
    return out


def _copy_warnings(merged: DataFrame, prompts: DataFrame, merged_calls: DataFrame, conflicts: DataFrame,
                   calls: DataFrame) -> list[DataFrame]:
    out = [
        warning_rows(merged, {"copied_session_files_coalesced": F.col("copies") - 1}, HARNESS),
        warning_rows(prompts, {"copied_session_prompt_records":
                               F.coalesce(F.col("copies") - F.col("retained"), F.lit(0))}, HARNESS),
        warning_rows(merged_calls, {"copied_session_response_records": F.col("copies") - 1}, HARNESS),
        warning_rows(conflicts, {"copied_session_usage_conflict": F.col("usage_conflicts"),
                                 "copied_session_model_conflict": F.col("model_conflicts")}, HARNESS)]
    roots = calls.where(~F.col("is_child"))
    again = dedupe.annotate_copies(roots, SCOPE, "call_id", ["session_at", "session_id", "ord"], ["usage", "model"])
    out.append(warning_rows(again, {"copied_responses": F.col("repeats"),
                                    "conflicting_usage": F.col("usage_conflicts"),
                                    "conflicting_copied_models": F.col("model_conflicts")}, HARNESS))
    ids = prompts.where(~F.col("is_child") & F.col("event_id").isNotNull()).groupBy(*SCOPE, "event_id").agg(
        (F.sum("retained") - 1).alias("n"))
    out.append(warning_rows(ids, {"copied_prompts": F.col("n")}, HARNESS))
    return out


def _coverage_facts(sessions: DataFrame, files: DataFrame, refs: DataFrame | None) -> tuple[DataFrame, list[DataFrame]]:
    """Evidence minima, unmaterialised references and their warnings."""
    known = sessions.where(~F.col("is_child") & ~F.col("unanchored")).select(*SCOPE, "session_id")
    orphan = sessions.where(~F.col("is_child") & F.col("unanchored"))
    all_refs = orphan.select(*SCOPE, F.lit("unanchored").alias("source"), F.lit(0).alias("source_rank"),
                             F.col("session_id").alias("ref_id"), F.col("started_at").alias("at"))
    if refs is not None:
        all_refs = all_refs.unionByName(refs)
    named = all_refs.where(F.col("ref_id").isNotNull())
    lost = reconcile.unmaterialized(named, known, SCOPE)
    found = reconcile.reconciled(named, known, SCOPE)
    warned = [
        warning_rows(lost, {
            "code_session_index_unmaterialized": F.array_contains("sources", "code_index"),
            "global_state_only_sessions": F.col("first_source") == "global_state",
            "project_index_only_sessions": F.col("first_source") == "project_index"}, HARNESS),
        warning_rows(found.where(F.col("source") == "code_index"),
                     {"code_session_index_reconciled": F.col("reconciled")}, HARNESS)]
    detail = files.where(~F.col("is_child")).groupBy(*SCOPE).agg(F.min("earliest_record").alias("detailed"))
    stats = all_refs.groupBy(*SCOPE).agg(
        F.min("at").alias("evidence"), F.min(F.when(F.col("source") == "stats", F.col("at"))).alias("stats_at"))
    roots = sessions.where(~F.col("is_child")).groupBy(*SCOPE).agg(
        F.min("started_at").alias("root_start"), F.count_if("history_only").alias("history_only_sessions"))
    missing = lost.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("unmaterialized_sessions"))
    parts = roots.unionByName(detail, True).unionByName(stats, True).unionByName(missing, True)
    facts = parts.groupBy(*SCOPE).agg(
        F.min(F.least("evidence", "detailed", "root_start")).alias("earliest_local_evidence"),
        F.min("detailed").alias("earliest_detailed_record"), F.min("stats_at").alias("stats_at"),
        F.coalesce(F.max("history_only_sessions"), F.lit(0)).alias("history_only_sessions"),
        F.coalesce(F.max("unmaterialized_sessions"), F.lit(0)).alias("unmaterialized_sessions"))
    early = F.coalesce(F.col("stats_at") < F.col("earliest_detailed_record"), F.lit(False))
    warned.append(warning_rows(facts, {"aggregate_history_predates_detail": early}, HARNESS))
    return facts, warned


def _provider_rows(spark: SparkSession, sessions: DataFrame, files: DataFrame, facts: DataFrame,
                   warnings: DataFrame, audit_files: DataFrame | None) -> DataFrame:
    sources = files.select(*SCOPE)
    if audit_files is not None:
        sources = sources.unionByName(audit_files.select("store_id", F.lit(HARNESS).alias("harness")))
    counted = sources.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("source_files"))
    flags = warnings.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("codes"))
    detailed = files.groupBy(*SCOPE).agg(F.lit(True).alias("tool_calls_available"))
    joined = (counted.join(facts, SCOPE, "left").join(coverage.loss_flags(warnings), SCOPE, "left")
              .join(flags, SCOPE, "left").join(detailed, SCOPE, "left"))
    zero = ("history_only_sessions", "unmaterialized_sessions", "codes")
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})
    status = coverage.assessed_status(F.lit(True))
    return filled.select(
        *SCOPE, coverage.provider_status(F.col("source_files"), F.lit(1), F.col("codes")).alias("status"),
        F.coalesce("tool_calls_available", F.lit(False)).alias("tool_calls_available"), "source_files",
        status.alias("coverage_status"), coverage.confidence(status).alias("coverage_confidence"),
        "earliest_local_evidence", "earliest_detailed_record", "history_only_sessions", "unmaterialized_sessions")


def read(spark: SparkSession, lake: Lake, stage: Stage | None = None) -> Tables:
    """The harness's tables for every store of a lake."""
    stage = stage or Stage.shared(spark)

    def docs(name: str, glob: str = "*") -> DataFrame:
        return scan_documents(spark, lake, name, MAX_RECORD_BYTES, glob)

    stats, state = docs("claude_stats"), docs("claude_state")
    code, project = docs("claude_code_sessions", "local_*.json"), docs("claude_projects", "sessions-index.json")
    project = project.where(F.size(F.split("rel", "/")) == 2)
    desktop = list_files(spark, lake, "claude_desktop", "*.jsonl").where(
        F.col("rel").rlike(r"(^|/)\.?claude/projects/"))
    desktop = place(desktop.withColumn("rel", F.regexp_extract("rel", r"(?:^|/)\.?claude/projects/(.*)$", 1)))
    history_files = list_files(spark, lake, "claude_history")
    audit = history_files.select("store_id")
    for df in (stats, state, code, project, desktop):
        audit = audit.unionByName(df.select("store_id"))
    return normalize(scan_lines(spark, lake, "claude_projects", "*.jsonl"),
                     scan_lines(spark, lake, "claude_history"),
                     list_files(spark, lake, "claude_projects", "*.jsonl"),
                     evidence(stats, state, code, project), desktop.select("store_id"), audit, stage)
