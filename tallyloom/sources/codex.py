"""Rollouts, prompt history, indexes and databases of the ``codex`` harness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.functions import jsonx, text, times
from tallyloom.operators import chain, coverage, dedupe, ordered, preference, reconcile
from tallyloom.schemas import Tables, published_ord, tables, usage
from tallyloom.sources import sqlite
from tallyloom.sources.common import SCOPE, store_of
from tallyloom.sources.lake import (LAZY, Lake, Stage, existing, list_files, records, scan_documents,
                                    scan_lines, sum_warnings, warning_rows, with_offsets)

HARNESS = "codex"
#: Fixed values of the original tool, in force if the job asks for them (lake.byte_limit).
MAX_RECORD_BYTES = 64 << 20
# Prefixes of injected text, tool-call item types, part types, labels.
INJECTED_PREFIXES = ("<environment_context>", "<codex_internal_context ", "<permissions instructions>",
                     "<collaboration_mode>")
TOOL_CALL_TYPES = ("function_call", "custom_tool_call", "local_shell_call", "mcp_tool_call",
                   "web_search_call", "tool_search_call")
ATTACHMENT_TYPES = ("image", "input_image", "local_image", "audio", "input_audio", "local_audio")
TEXT_TYPES = ("text", "input_text")
USER_ITEM_TYPES = ("UserMessage", "user_message")
BASIS_START = "session start"
BASIS_HISTORY = "prompt history timestamp"
USAGE_SOURCE = "event_msg.payload.info.total_token_usage"
TOKEN_FIELDS = ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens",
                "reasoning_output_tokens", "total_tokens")

RECORD = (
    "ordinal bigint, timestamp string, type string, payload struct<type:string,id:string,session_id:string,"
    "parent_thread_id:string,history_mode:string,history_base:struct<thread_id:string,end_byte_offset:bigint,"
    "end_ordinal_exclusive:bigint>,cwd:string,model:string,turn_id:string,call_id:string,message:string,"
    "images:variant,local_images:variant,audio:variant,local_audio:variant,"
    "item:struct<type:string,id:string,content:variant>,"
    "info:struct<total_token_usage:struct<" + ",".join(f"{f}:bigint" for f in TOKEN_FIELDS) + ">>>")
BASE = "struct<thread_id:string,end_byte_offset:bigint,end_ordinal_exclusive:bigint>"


def is_injected(c: Column) -> Column:
    """Text the tool itself put in front of the model."""
    trimmed = text.trim_unicode(c)
    test = F.lit(False)
    for prefix in INJECTED_PREFIXES:
        test = test | trimmed.startswith(prefix)
    return F.coalesce(test, F.lit(False))


def place(raw: DataFrame) -> DataFrame:
    """Rollout files only; a plain file hides its compressed sibling."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return raw.where(name.rlike(r"^rollout-.*\.jsonl(\.zst)?$")).withColumn(
        "packed", F.col("path").endswith(".zst"))


def selected_files(listing: DataFrame) -> DataFrame:
    return dedupe.prefer_variant(place(listing), F.regexp_replace("path", r"\.zst$", ""), F.col("packed"))


def parse(raw: DataFrame) -> DataFrame:
    """Content-free events of every line; blank ones and the null line of an unreadable file hold nothing else.

    This is the only pass over the text: what later steps need of a line's bytes, its number of bytes and its digest, is
    kept here.
    """
    sized = place(raw).withColumns({
        "unreadable": F.col("line").isNull(), "bytes": F.coalesce(F.octet_length("line"), F.lit(0)).cast("bigint") + 1,
        "digest": F.sha2("line", 256)})
    rows = records(sized, MAX_RECORD_BYTES, blank=True)
    rows = rows.withColumn("blank", ~F.col("oversize") & (F.coalesce(F.length("line"), F.lit(0)) == 0)).withColumn(
        "r", jsonx.parse_record(F.col("line"), RECORD))
    r = F.col("r")
    malformed = ~F.col("oversize") & ~F.col("blank") & jsonx.is_malformed(F.col("line"), r)
    ok = ~F.col("oversize") & ~F.col("blank") & ~malformed
    p = r["payload"]
    msg = F.col("kind") == "event_msg"
    base = rows.select(
        "store_id", "path", "line_key", "packed", "bytes", "digest", "blank", "unreadable", "oversize",
        malformed.alias("malformed"), ok.alias("ok"), r["ordinal"].alias("ordinal"), F.when(ok, times.parse_rfc3339(r["timestamp"])).alias("at"),
        r["type"].alias("kind"), p.alias("p"), p["type"].alias("item"))
    p = F.col("p")
    is_legacy = F.coalesce(msg & (F.col("item") == "user_message"), F.lit(False))
    is_paged = F.coalesce(msg & (F.col("item") == "item_completed")
                          & p["item"]["type"].isin(*USER_ITEM_TYPES), F.lit(False))
    content = p["item"]["content"]
    blocks = jsonx.as_blocks(content)
    typed = base.withColumns({
        "legacy": is_legacy, "paged": is_paged, "blocks": F.when(is_paged, blocks),
        "whole": F.when(is_paged & (jsonx.kind(content) == "string"), jsonx.as_text(content))})
    parts = F.filter("blocks", lambda b: b["type"].isin(*TEXT_TYPES) & ~is_injected(b["text"]) & jsonx.nonblank(b["text"]))
    joined = F.array_join(F.transform(parts, lambda b: b["text"]), "\n")
    body = (F.when(F.col("legacy"), F.when(~is_injected(p["message"]), text.trim_unicode(p["message"])))
             .when(F.col("whole").isNotNull(), F.when(~is_injected(F.col("whole")), F.col("whole")))
             .otherwise(joined))
    attached = F.when(F.col("legacy"), F.greatest(*[
        jsonx.present(p[c], "[]", '""') for c in ("images", "local_images", "audio", "local_audio")])).otherwise(
        F.coalesce(F.exists("blocks", lambda b: b["type"].isin(*ATTACHMENT_TYPES)), F.lit(False)))
    sized = typed.withColumns({"body": F.coalesce(body, F.lit("")), "attached": attached})
    textual = jsonx.nonblank(F.col("body"))
    event_id = F.when(F.col("legacy"), F.coalesce(text.blank_to_null(p["id"]), text.blank_to_null(p["turn_id"]))
                      ).otherwise(text.blank_to_null(p["item"]["id"]))
    is_tool = F.coalesce((F.col("kind") == "response_item") & F.col("item").isin(*TOOL_CALL_TYPES), F.lit(False))
    is_tokens = F.coalesce(msg & (F.col("item") == "token_count") & p["info"].isNotNull(), F.lit(False))
    is_meta = F.coalesce(F.col("kind") == "session_meta", F.lit(False))
    is_turn = F.coalesce(F.col("kind") == "turn_context", F.lit(False))
    total = p["info"]["total_token_usage"]
    return sized.select(
        "store_id", "path", "line_key", "packed", "bytes", "digest", "blank", "unreadable", "oversize", "malformed", "ok",
        "ordinal", "at",
        (is_meta & F.col("ok")).alias("is_meta"), (is_turn & F.col("ok")).alias("is_turn"),
        F.when(is_meta, F.coalesce(text.blank_to_null(p["id"]), text.blank_to_null(p["session_id"]))).alias("thread_id"),
        F.when(is_meta, text.blank_to_null(p["id"])).alias("meta_id"),
        F.when(is_meta, text.blank_to_null(p["session_id"])).alias("meta_session"),
        F.when(is_meta, text.blank_to_null(p["parent_thread_id"])).alias("parent_id"),
        F.when(is_meta, F.lower(F.coalesce(p["history_mode"], F.lit("")))).alias("mode"),
        F.when(is_meta, p["history_base"]).alias("base"),
        F.when(is_meta | is_turn, text.project_name(p["cwd"])).alias("project"),
        F.when(is_turn, text.safe_label(p["model"], 100)).alias("model"),
        F.when(is_turn, text.blank_to_null(p["turn_id"])).alias("turn_id"), is_tool.alias("is_tool"),
        F.when(is_tool, F.coalesce(text.blank_to_null(p["call_id"]), text.blank_to_null(p["id"]))).alias("call_id"),
        F.when(is_tokens, F.struct(*[F.coalesce(total[f], F.lit(0)).alias(f) for f in TOKEN_FIELDS])).alias("tokens"),
        "legacy", "paged", ((F.col("legacy") | F.col("paged")) & (textual | F.col("attached"))).alias("is_prompt"),
        event_id.alias("event_id"), textual.alias("has_text"),
        F.when(textual, text.words(F.col("body"))).otherwise(0).alias("words"),
        F.when(textual, text.characters(F.col("body"))).otherwise(0).alias("characters"))


def inspect(events: DataFrame) -> DataFrame:
    """Segment header per file from its physical first line."""
    first = F.min_by(F.struct("ok", "is_meta", "thread_id", "ordinal", "base"), F.col("line_key"))
    head = events.where(~F.col("unreadable")).groupBy("store_id", "path").agg(first.alias("h"))
    meta = F.col("h.is_meta")
    return head.select(
        "store_id", "path", F.col("path").endswith(".zst").alias("packed"), (~F.col("h.ok")).alias("failed"),
        F.when(meta, F.col("h.thread_id")).alias("thread_id"), F.when(meta, F.col("h.ordinal")).alias("first_ordinal"),
        F.when(meta, F.col("h.base")).alias("base"))


def plan_segments(events: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(files with their plan, offsets of lines in cut files, warnings), from staged events alone."""
    heads = stage(inspect(events), "codex_heads")
    shared = heads.where(F.col("thread_id").isNotNull()).groupBy("store_id", "thread_id").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).drop("n")
    several = heads.join(shared, ["store_id", "thread_id"], "left_semi")
    candidates = events.where(~F.col("unreadable")).join(several.select("store_id", "path"), ["store_id", "path"], "left_semi")
    measured = stage(with_offsets(candidates.select("store_id", "path", "line_key", "ordinal", "bytes", F.col("digest").alias("line"))),
                     "codex_offsets")
    # A copy is another physical file, not another segment.
    digests = chain.fingerprint(measured)
    same = dedupe.byte_identical(several.join(digests, ["store_id", "path"]), ["store_id", "thread_id"],
                                 "digest", "path")
    unique = several.join(same.select("store_id", "thread_id", "path"), ["store_id", "thread_id", "path"], "left_semi")
    offsets = measured.drop("line", "bytes")
    plan = stage(chain.stitch(unique.select("store_id", "thread_id", "path", "first_ordinal", "packed", "base"),
                              offsets, stage), "codex_plan")
    suppressed = several.join(unique.select("store_id", "path"), ["store_id", "path"], "left_anti")
    files = (heads.join(suppressed.select("store_id", "path"), ["store_id", "path"], "left_anti")
             .join(plan.select("store_id", "path", "stitched", "cut_ordinal", "cut_offset"),
                   ["store_id", "path"], "left")
             .withColumn("stitched", F.coalesce("stitched", F.lit(False))))
    groups = plan.groupBy("store_id", "thread_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("stitched").alias("stitched"))
    alone = heads.join(shared, ["store_id", "thread_id"], "left_anti").where(F.col("thread_id").isNotNull()).select(
        "store_id", "base").unionByName(
        plan.where(F.col("group_size") == 1).select("store_id", "base"))
    warned = [
        warning_rows(heads, {"history_chain_inspection_failed": F.col("failed")}, HARNESS),
        warning_rows(same, {"identical_rollout_copy_suppressed": F.col("suppressed")}, HARNESS),
        warning_rows(groups, {
            "stitched_history_segments": F.when(F.col("stitched"), F.col("n") - 1).otherwise(0),
            "ambiguous_history_chain_suppressed": F.when(~F.col("stitched"), F.col("n") - 1).otherwise(0)}, HARNESS),
        warning_rows(alone, {"missing_history_base": F.col("base").isNotNull()}, HARNESS)]
    return files, offsets, warned


def file_sessions(events: DataFrame) -> DataFrame:
    """One row per rollout file: identity from its first metadata record."""
    key = F.col("line_key")
    meta_at = F.when(F.col("is_meta"), key)
    tokens = F.col("tokens")
    first = F.min_by(F.struct("thread_id", "meta_id", "meta_session", "parent_id", "mode", "project", "at"), meta_at)
    agg = events.groupBy("store_id", "path").agg(
        first.alias("m"), F.min_by("project", F.when(F.col("is_turn") & F.col("project").isNotNull(), key)).alias("turn_project"),
        F.max("at").alias("ended_at"),
        F.max_by("tokens", F.when(tokens.isNotNull(), F.struct(tokens["total_tokens"], key))).alias("tokens"))
    m, t = F.col("m"), F.col("tokens")
    best = F.when(t["total_tokens"] >= 0, t)
    ready = F.coalesce((best["total_tokens"] > 0) | (best["input_tokens"] > 0) | (best["output_tokens"] > 0), F.lit(False))
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), r"\.jsonl(\.zst)?$", "")
    child = m["parent_id"].isNotNull() | F.coalesce(m["meta_id"] != m["meta_session"], F.lit(False))
    mode = (F.when(m.isNull() | m["mode"].isin("", "legacy"), "legacy").when(m["mode"] == "paginated", "paginated")
             .otherwise("unknown"))
    valid = m["thread_id"].isNotNull() & m["at"].isNotNull()
    return agg.select(
        "store_id", "path", F.coalesce(m["thread_id"], stem).alias("session_id"), m["parent_id"].alias("parent_id"),
        F.coalesce(child, F.lit(False)).alias("is_child"), mode.alias("mode"),
        F.coalesce(valid, F.lit(False)).alias("valid"), F.when(valid, m["at"]).alias("started_at"), "ended_at",
        F.coalesce(m["project"], F.col("turn_project")).alias("project"),
        usage(USAGE_SOURCE, ready, input=best["input_tokens"], output=best["output_tokens"],
              cache_read=best["cached_input_tokens"], cache_write=best["cache_write_input_tokens"],
              reasoning=best["reasoning_output_tokens"]).alias("usage"))


def first_by_id(df: DataFrame, id_column: str, payload: Sequence[str]) -> DataFrame:
    return dedupe.keep_first(df, ["store_id", "path"], id_column, ["line_key"], payload)


def choose_files(files: DataFrame) -> DataFrame:
    """Winning file per id among unstitched ones, by the ordered preference.

    In path order a candidate replaces the current file when it ends later or has
    more prompts. That relation is not transitive, so every physically different
    file of an id takes part, as three scalars.
    """
    ends = F.unix_micros(F.coalesce(F.col("ended_at"), F.lit("0001-01-01").cast("timestamp")))
    rows = files.select("store_id", "session_id", "path", ends.alias("first"), F.col("n_prompts").cast("long").alias("second"))
    return preference.last_preferred(rows, ["store_id", "session_id"], "path", "first", "second")


HISTORY = "session_id string, text string, ts bigint"


def parse_history(raw: DataFrame) -> DataFrame:
    rows = records(raw, MAX_RECORD_BYTES).withColumn("r", jsonx.parse_record(F.col("line"), HISTORY))
    r = F.col("r")
    bad = ~F.col("oversize") & (jsonx.is_malformed(F.col("line"), r) | (F.coalesce(r["session_id"], F.lit("")) == "")
                                | (F.coalesce(r["ts"], F.lit(0)) <= 0))
    body = F.coalesce(text.trim_unicode(r["text"]), F.lit(""))
    numbered = rows.select(
        "store_id", F.lit(HARNESS).alias("harness"), "line_key", "oversize", bad.alias("bad"),
        r["session_id"].alias("session_id"), F.timestamp_seconds(r["ts"]).alias("at"),
        is_injected(body).alias("injected"), text.words(body).alias("words"),
        text.characters(body).alias("characters"), (body != "").alias("has_text"),
        F.col("line_key.path").alias("_path"), F.col("line_key.block").alias("_block"))
    return ordered.rank(numbered, ["store_id", "_path"], ["_block"], [F.col("line_key.n")], "line_no").drop("_path", "_block")


def evidence(index: DataFrame, imports: DataFrame, threads: DataFrame, catalog: DataFrame,
             hosts: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Reference ids and dates of the four indexes, and their warnings.

    ``threads``: store_id, id, created_ms; ``catalog``: store_id, path, thread_id,
    source_created_at, host_id; ``hosts``: store_id, path, host_id, host_kind.
    """
    def refs(df: DataFrame, source: str, rank: int, ref: Column, at: Column) -> DataFrame:
        return df.select("store_id", F.lit(HARNESS).alias("harness"), F.lit(source).alias("source"),
                         F.lit(rank).alias("source_rank"), text.blank_to_null(ref).alias("ref_id"), at.alias("at"))

    rows = records(index, MAX_RECORD_BYTES).withColumn(
        "r", jsonx.parse_record(F.col("line"), "id string, updated_at string"))
    updated = times.parse_rfc3339(F.col("r.updated_at"))
    bad = ~F.col("oversize") & (jsonx.is_malformed(F.col("line"), F.col("r"))
                                | (F.coalesce(F.col("r.id"), F.lit("")) == "") | updated.isNull())
    indexed = refs(rows.where(~bad & ~F.col("oversize")), "index", 0, F.col("r.id"), updated)
    docs = imports.withColumn("r", jsonx.parse_record(
        F.col("doc"), "records array<struct<source_path:string,imported_thread_id:string,imported_at:bigint>>"))
    broken = ~F.col("oversize") & jsonx.is_malformed(F.col("doc"), F.col("r"))
    items = docs.where(~broken).select("store_id", F.explode("r.records").alias("e"))
    imported = refs(items, "imports", 1, F.col("e.imported_thread_id"), times.from_seconds(F.col("e.imported_at")))
    stated = refs(threads, "state", 2, F.col("id"), times.from_millis(F.col("created_ms")))
    joined = catalog.join(hosts.select("path", "host_id", "host_kind"), ["path", "host_id"])
    local = refs(joined.where(F.col("host_kind") == "local"), "catalog", 3, F.col("thread_id"),
                 times.from_seconds(F.col("source_created_at")))
    remote = joined.where(F.col("host_kind") == "chatgpt")
    warned = [
        warning_rows(rows, {"malformed_session_index_record": bad, "oversize_session_index_record": F.col("oversize")}, HARNESS),
        warning_rows(docs, {"malformed_external_imports": broken, "oversize_external_imports": F.col("oversize")}, HARNESS),
        warning_rows(items, {"external_import_source_references": F.coalesce("e.source_path", F.lit("")) != ""}, HARNESS),
        warning_rows(remote, {"remote_catalog_sessions_excluded": F.lit(True)}, HARNESS),
        warning_rows(remote.select("store_id", "path", "host_id").distinct(), {"account_workspace_catalogs": F.lit(True)}, HARNESS)]
    return indexed.unionByName(imported).unionByName(stated).unionByName(local), warned


def state_paths(threads: DataFrame, listing: DataFrame, discovered: DataFrame, roots: Sequence[str]) -> list[DataFrame]:
    """Classify the rollout paths a state database names.

    ``threads``: store_id, store_root, database_dir, rollout_path. Paths outside the roots are
    never looked up; the others are matched with the file listing.
    """
    absolute = F.when(F.col("rollout_path").startswith("/"), F.col("rollout_path")).otherwise(
        F.concat_ws("/", "database_dir", "rollout_path"))
    named = threads.where(F.coalesce("rollout_path", F.lit("")) != "").select(
        "store_id", "store_root", absolute.alias("path"))
    inside = F.lit(False)
    for root in roots:
        inside = inside | F.col("path").startswith(F.concat("store_root", F.lit(f"/{root}/")))
    split = named.withColumn("inside", inside)
    within = split.where("inside")
    missing = reconcile.missing_rows(within, listing, ["path"])
    present = within.join(listing.select("path").distinct(), "path", "left_semi")
    unseen = reconcile.missing_rows(present, discovered, ["path"])
    return [warning_rows(split, {"state_rollouts_outside_configured_roots": ~F.col("inside")}, HARNESS),
            warning_rows(missing, {"missing_state_rollout_paths": F.lit(True)}, HARNESS),
            warning_rows(unseen, {"existing_state_rollouts_not_discovered": F.lit(True)}, HARNESS)]


def normalize(raw: DataFrame, history: DataFrame | None = None,
              indexes: tuple[DataFrame, list[DataFrame]] | None = None, extra_warnings: Sequence[DataFrame] = (),
              source_files: DataFrame | None = None, stage: Stage = LAZY, with_status: bool = True) -> Tables:
    """Tables of the harness from raw rollout lines (plain-over-packed applied).

    Without ``with_status`` the warning and provider tables stay empty.
    """
    spark = raw.sparkSession
    events = stage(parse(raw), "codex_events")
    files, offsets, warned = plan_segments(events, stage)
    files = stage(files, "codex_files")
    kept_events = events.where(~F.col("blank")).drop("bytes", "digest", "blank").join(files.select("store_id", "path", "stitched", "cut_ordinal", "cut_offset"), ["store_id", "path"])
    whole = kept_events.where(F.col("cut_offset").isNull())
    cut = (kept_events.where(F.col("cut_offset").isNotNull())
           .join(offsets.select("store_id", "path", "line_key", "start_offset"), ["store_id", "path", "line_key"])
           .where((F.col("ordinal").isNull() | (F.col("ordinal") < F.col("cut_ordinal")))
                  & (F.col("start_offset") < F.col("cut_offset"))).drop("start_offset"))
    used = stage(whole.unionByName(cut).drop("cut_ordinal", "cut_offset"), "codex_used")

    heads = file_sessions(used).join(files.select("store_id", "path", "stitched"), ["store_id", "path"])
    prompt_rows = used.where("is_prompt").drop("mode", "stitched").join(heads.select("store_id", "path", "mode"), ["store_id", "path"]).where(
        (F.col("legacy") & (F.col("mode") == "legacy")) | (F.col("paged") & (F.col("mode") == "paginated")))
    file_prompts = stage(first_by_id(prompt_rows, "event_id", ["line_key", "at", "words", "characters", "has_text"]),
                         "codex_file_prompts")
    turns = first_by_id(used.where(F.col("is_turn") & F.col("model").isNotNull()), "turn_id", ["model"])
    calls = first_by_id(used.where("is_tool"), "call_id", ["line_key"])
    sizes = (file_prompts.groupBy("store_id", "path").agg(F.count(F.lit(1)).alias("n_prompts"))
             .unionByName(calls.groupBy("store_id", "path").agg(F.count(F.lit(1)).alias("tool_calls")), True)
             .groupBy("store_id", "path").agg(F.coalesce(F.max("n_prompts"), F.lit(0)).alias("n_prompts"),
                                              F.coalesce(F.max("tool_calls"), F.lit(0)).alias("tool_calls")))
    full = stage(heads.join(sizes, ["store_id", "path"], "left").na.fill(0, ["n_prompts", "tool_calls"]), "codex_heads_full")

    # A stitched chain always wins over loose files of the same id.
    valid = full.where("valid")
    chains = valid.where("stitched")
    loose = valid.where(~F.col("stitched")).join(
        chains.select("store_id", "session_id").distinct(), ["store_id", "session_id"], "left_anti")
    chosen = choose_files(loose)
    # Four tables are made from the winners; the fold that finds them runs once.
    winners = stage(loose.join(chosen, ["store_id", "session_id", "path"], "left_semi").unionByName(chains), "codex_winners")
    dropped = valid.groupBy("store_id", "session_id").agg(F.count(F.lit(1)).alias("n")).join(
        winners.groupBy("store_id", "session_id").agg(F.count(F.lit(1)).alias("w")), ["store_id", "session_id"])
    at = F.struct("started_at", "path")
    sessions = winners.groupBy("store_id", "session_id").agg(
        F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"),
        F.bool_or("is_child").alias("is_child"), F.min_by("parent_id", F.when(F.col("parent_id").isNotNull(), F.col("path"))).alias("parent_id"),
        F.min_by("project", F.when(F.col("project").isNotNull(), F.col("path"))).alias("project"),
        F.sum("tool_calls").alias("tool_calls"), F.bool_or("usage.available").alias("_ready"),
        *[F.sum(f"usage.{k}").alias(f"_{k}") for k in ("input", "output", "cache_read", "cache_write", "reasoning")],
        F.min(at).alias("_at"))
    sessions = sessions.select(
        "store_id", F.lit(HARNESS).alias("harness"), F.col("session_id").alias("session_key"), "session_id", "parent_id",
        "is_child", "started_at", "ended_at", F.col("started_at").alias("activity_at"),
        F.lit(BASIS_START).alias("activity_basis"), "project", "tool_calls",
        usage(USAGE_SOURCE, F.col("_ready"), **{k: F.col(f"_{k}") for k in
                                                ("input", "output", "cache_read", "cache_write", "reasoning")}).alias("usage"),
        F.lit(False).alias("has_calls"), F.lit(False).alias("unanchored"), F.lit(False).alias("history_only"),
        F.lit(False).alias("time_unavailable"))
    owner = winners.select("store_id", "path", "session_id", "stitched").join(
        sessions.select("store_id", "harness", "session_key", "session_id", "is_child",
                        F.col("started_at").alias("session_at")), ["store_id", "session_id"])
    event = ["store_id", "harness", "session_key", "session_id", "is_child", "session_at"]
    owned = file_prompts.drop("copies").join(owner, ["store_id", "path"])
    merged = dedupe.keep_first(owned, event, "event_id", ["line_key"], ["line_key", "at", "words", "characters", "has_text"])
    prompts = merged.withColumn("ord", published_ord(F.col("line_key")))
    models = turns.join(owner, ["store_id", "path"]).groupBy(*event, "model").agg(F.count(F.lit(1)).alias("turns"))

    repeats = lambda df, code: warning_rows(
        df.select("store_id", (F.col("copies") - 1).alias("n")), {code: F.col("n")}, HARNESS)
    warned += [
        warning_rows(events, {"unreadable_file": F.col("unreadable")}, HARNESS),
        warning_rows(used, {"oversize_record": F.col("oversize"), "malformed_record": F.col("malformed"),
                            "invalid_timestamp": F.col("ok") & F.col("at").isNull()}, HARNESS),
        warning_rows(full, {"missing_or_invalid_session_meta": ~F.col("valid"),
                            "unknown_history_mode": F.col("mode") == "unknown"}, HARNESS),
        repeats(file_prompts.where(F.col("event_id").isNotNull()), "duplicate_prompt_event"),
        repeats(turns.where(F.col("turn_id").isNotNull()), "duplicate_turn_context"),
        repeats(calls.where(F.col("call_id").isNotNull()), "duplicate_tool_call"),
        repeats(merged.where(F.col("event_id").isNotNull()), "duplicate_stitched_prompt"),
        warning_rows(dropped, {"unvalidated_same_id_rollout_suppressed": F.col("n") - F.col("w")}, HARNESS)]

    if history is not None:
        hist = stage(parse_history(history), "codex_history")
        good = hist.where(~F.col("bad") & ~F.col("oversize"))
        alone, suppressed = reconcile.split_history(good, sessions.select(*SCOPE, "session_id"), SCOPE + ["session_id"])
        extra = alone.groupBy(*SCOPE, "session_id").agg(
            F.min("at").alias("started_at"), F.max("at").alias("ended_at"), F.min("at").alias("activity_at")).withColumns({
                "session_key": F.col("session_id"), "is_child": F.lit(False), "activity_basis": F.lit(BASIS_HISTORY),
                "has_calls": F.lit(False), "unanchored": F.lit(False), "history_only": F.lit(True),
                "time_unavailable": F.lit(False), "tool_calls": F.lit(0).cast("bigint"), "usage": usage("", False)})
        sessions = sessions.unionByName(extra, True)
        kept = alone.where(~F.col("injected")).join(
            extra.select(*SCOPE, "session_id", "session_key", F.col("started_at").alias("session_at")), SCOPE + ["session_id"]).select(
            *SCOPE, "session_key", "session_id", "session_at", F.lit(False).alias("is_child"),
            F.concat_ws(":", F.lit("history"), "session_id", "line_no").alias("event_id"),
            published_ord(F.col("line_key")).alias("ord"), "at", "words", "characters", "has_text")
        prompts = prompts.unionByName(kept, True)
        warned += [
            warning_rows(hist, {"malformed_history_record": F.col("bad"), "oversize_history_record": F.col("oversize")}, HARNESS),
            warning_rows(suppressed.where(~F.col("injected")), {"history_records_reconciled": F.lit(True)}, HARNESS),
            warning_rows(extra, {"history_only_sessions": F.lit(True)}, HARNESS)]
    sessions, prompts = stage(sessions, "codex_sessions"), stage(prompts, "codex_prompts")

    if not with_status:
        return tables(spark, sessions=sessions, prompts=prompts, model_activity=models)
    refs, ref_warned = indexes if indexes else (None, [])
    warned += [*ref_warned, *extra_warnings]
    facts = sessions.where(~F.col("is_child")).groupBy(*SCOPE).agg(
        F.min("started_at").alias("evidence"), F.min(F.when(~F.col("history_only"), F.col("started_at"))).alias("detailed"),
        F.count_if("history_only").alias("history_only_sessions"))
    if refs is not None:
        lost = reconcile.unmaterialized(refs.where(F.col("ref_id").isNotNull()), sessions, SCOPE)
        names = {"index": "index_only_sessions", "imports": "unmaterialized_import_sessions",
                 "state": "state_only_sessions", "catalog": "local_catalog_only_sessions"}
        warned.append(warning_rows(lost, {code: F.array_contains("sources", s) for s, code in names.items()}, HARNESS))
        facts = (facts.unionByName(refs.groupBy(*SCOPE).agg(F.min("at").alias("evidence")), True)
                 .unionByName(lost.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("missing")), True))
    else:
        facts = facts.withColumn("missing", F.lit(None).cast("bigint"))
    facts = facts.groupBy(*SCOPE).agg(
        F.min("evidence").alias("earliest_local_evidence"), F.min("detailed").alias("earliest_detailed_record"),
        F.coalesce(F.max("history_only_sessions"), F.lit(0)).alias("history_only_sessions"),
        F.coalesce(F.max("missing"), F.lit(0)).alias("unmaterialized_sessions"))
    warnings = stage(sum_warnings(warned), "codex_warnings")
    sources = (source_files if source_files is not None else files).select("store_id", F.lit(HARNESS).alias("harness"))
    counted = sources.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("source_files"))
    codes = warnings.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("codes"))
    detailed = valid.select("store_id", F.lit(HARNESS).alias("harness")).distinct().withColumn("tool_calls_available", F.lit(True))
    joined = (counted.join(facts, SCOPE, "left").join(coverage.loss_flags(warnings), SCOPE, "left")
              .join(codes, SCOPE, "left").join(detailed, SCOPE, "left")
              .na.fill(0, ["history_only_sessions", "unmaterialized_sessions", "codes"])
              .na.fill(False, ["tool_calls_available"]))
    status = coverage.assessed_status(F.lit(False))
    providers = joined.withColumns({
        "status": coverage.provider_status(F.col("source_files"), F.lit(1), F.col("codes")),
        "coverage_status": status, "coverage_confidence": coverage.confidence(status)})
    return tables(spark, sessions=sessions, prompts=prompts, model_activity=models, warnings=warnings,
                  providers=providers)


def read(spark: SparkSession, lake: Lake, stage: Stage | None = None) -> Tables:
    """The harness's tables for every store of a lake."""
    stage = stage or Stage.shared(spark)
    listing = list_files(spark, lake, "codex_rollouts")
    chosen = selected_files(listing)
    raw = place(scan_lines(spark, lake, "codex_rollouts", "rollout-*", verdicts=True)).join(
        chosen.select("store_id", "path"), ["store_id", "path"], "left_semi").drop("packed")
    threads = sqlite.read_table(spark, existing(spark, lake.globs("codex_state")), "threads",
                                "id string, rollout_path string, created_at bigint, created_at_ms bigint")
    threads = threads.select(
        store_of(lake, F.col("path")).alias("store_id"), "id", "rollout_path",
        F.concat(F.lit(lake.base.rstrip("/") + "/"), store_of(lake, F.col("path"))).alias("store_root"),
        F.regexp_replace("path", "/[^/]*$", "").alias("database_dir"),
        F.coalesce("created_at_ms", F.col("created_at") * 1000).alias("created_ms"))
    catalog_files = existing(spark, lake.globs("codex_catalog"))
    catalog = sqlite.read_table(spark, catalog_files, "local_thread_catalog",
                                "thread_id string, source_created_at double, host_id string")
    catalog = catalog.withColumn("store_id", store_of(lake, F.col("path")))
    hosts = sqlite.read_table(spark, catalog_files, "local_thread_catalog_hosts", "host_id string, host_kind string")
    index = scan_lines(spark, lake, "codex_index")
    imports = scan_documents(spark, lake, "codex_imports", MAX_RECORD_BYTES)
    unparsed = list_files(spark, lake, "codex_thread_history")
    extra = [warning_rows(unparsed, {"unparsed_thread_history_database": F.lit(True)}, HARNESS)]
    extra += state_paths(threads, listing, chosen, lake.layout["codex_rollouts"])
    for name, tables_needed, code in (
            ("codex_state", ("threads",), "state_index_unavailable"),
            ("codex_catalog", ("local_thread_catalog", "local_thread_catalog_hosts"), "catalog_index_unavailable")):
        present = sqlite.table_columns(spark, existing(spark, lake.globs(name))).groupBy("path").agg(
            F.size(F.collect_set(F.when(F.col("table_name").isin(*tables_needed), F.col("table_name")))).alias("n"))
        extra.append(warning_rows(present.withColumn("store_id", store_of(lake, F.col("path"))),
                                  {code: F.col("n") < len(tables_needed)}, HARNESS))
    sources = place(listing).select("store_id")
    for name in ("codex_history", "codex_index", "codex_imports", "codex_state", "codex_catalog", "codex_thread_history"):
        sources = sources.unionByName(list_files(spark, lake, name).select("store_id"))
    return normalize(raw, scan_lines(spark, lake, "codex_history"),
                     evidence(index, imports, threads, catalog, hosts), extra, sources, stage)
