"""Session recordings of the ``gemini`` harness: edit logs and whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.functions import jsonx, text, times
from tallyloom.operators import replay
from tallyloom.operators.dedupe import prefer_variant
from tallyloom.operators.metrics import ledger
from tallyloom.schemas import Tables, usage
from tallyloom.sources.common import assemble, attach, complete_sessions, with_prompts_only
from tallyloom.sources.lake import LAZY, Lake, Stage, list_files, records, scan_documents, scan_lines, warning_rows

HARNESS = "gemini"
#: Fixed values of the original tool, in force if the job asks for them (lake.byte_limit).
MAX_LINE_BYTES = 16 << 20
MAX_FILE_BYTES = 128 << 20
BASIS = "session message timestamps"
USAGE_SOURCE = "Gemini CLI message token summaries"
_MESSAGE = ("id:string,timestamp:string,type:string,content:variant,model:string,"
            "tokens:struct<input:bigint,output:bigint,cached:bigint,thoughts:bigint,tool:bigint>,"
            "toolCalls:array<variant>")
_META = "startTime:string,lastUpdated:string,kind:string"
_PATCH = "struct<id:string,content:variant,updates:array<struct<id:string,content:variant>>,removeIds:array<string>,orderIds:array<string>>"
RECORD = f"struct<{_MESSAGE},sessionId:string,{_META},`$set`:struct<{_META}>,`$patch`:{_PATCH},`$rewindTo`:string,_bad:string>"
DOCUMENT = f"struct<sessionId:string,{_META},messages:array<struct<{_MESSAGE}>>,_bad:string>"


def placed(df: DataFrame) -> DataFrame:
    """Recordings only: ``<project>/chats[/<sub>]/session-*``."""
    return df.where(F.col("rel").rlike(r"^[^/]+/chats/(?:[^/]+/)?session-[^/]*\.jsonl?$"))


def selected_files(listing: DataFrame) -> DataFrame:
    """A ``.jsonl`` recording hides the ``.json`` of the same stem."""
    return prefer_variant(placed(listing), F.regexp_replace("path", r"\.jsonl?$", ""), F.col("path").endswith(".json"))


def content_text(v: Column) -> Column:
    """Text of a string, a part, or an array of parts."""
    part = F.try_variant_get(v, "$.text", "string")
    parts = F.try_variant_get(v, "$", "array<struct<text:string>>")
    joined = F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: F.coalesce(t, F.lit("")) != ""), "\n")
    kind = jsonx.kind(v)
    return F.coalesce(F.when(kind == "string", jsonx.as_text(v)).when(kind == "object", part)
                       .when(kind == "array", joined), F.lit(""))


def _message(m: Column) -> Column:
    body = content_text(m["content"])
    t = m["tokens"]
    reply = F.coalesce(m["type"] == "gemini", F.lit(False))
    user = F.coalesce(m["type"] == "user", F.lit(False))
    return F.struct(
        m["type"].alias("type"), times.parse_rfc3339(m["timestamp"]).alias("at"),
        F.when(user, text.words(body)).alias("words"), F.when(user, text.characters(body)).alias("characters"),
        F.when(user, text.has_text(body)).alias("has_text"), F.when(reply, text.safe_label(m["model"], 80)).alias("model"),
        F.when(reply, F.coalesce(F.size(m["toolCalls"]), F.lit(0))).otherwise(0).cast("bigint").alias("tools"),
        usage(USAGE_SOURCE, reply & t.isNotNull(), input=t["input"], output=t["output"], cache_read=t["cached"],
              reasoning=t["thoughts"]).alias("usage"))


def _patched(content: Column) -> Column:
    """Sizes of replaced content, shaped like a message."""
    body = content_text(content)
    return F.struct(
        F.lit(None).cast("string").alias("type"), F.lit(None).cast("timestamp").alias("at"),
        text.words(body).alias("words"), text.characters(body).alias("characters"), text.has_text(body).alias("has_text"),
        F.lit(None).cast("string").alias("model"), F.lit(0).cast("bigint").alias("tools"), usage("", False).alias("usage"))


def _seq(sub: Column) -> Column:
    return F.struct(F.col("line_key.block").alias("block"), F.col("line_key.n").alias("n"), sub.cast("bigint").alias("sub"))


def parse_log(raw: DataFrame) -> DataFrame:
    """One row per line with its kind, header values and operations."""
    rows = records(placed(raw.where(F.col("path").endswith(".jsonl"))), MAX_LINE_BYTES).where(
        F.col("oversize") | jsonx.nonblank(F.col("line")))
    r = rows.withColumn("r", F.from_json("line", RECORD, {"columnNameOfCorruptRecord": "_bad"}))
    broken = F.col("r._bad").isNotNull() | F.col("r").isNull()
    # Wrong-typed fields are ignored silently; only broken JSON is malformed.
    malformed = ~F.col("oversize") & broken & F.coalesce(
        ~F.schema_of_variant(F.try_parse_json("line")).startswith("OBJECT"), F.lit(True))
    v = F.col("r")
    patch = v["$patch"]
    # A null target is a rewind to no message, which clears the log.
    rewound = v["$rewindTo"].isNotNull() | (F.contains(F.col("line"), F.lit("$rewindTo")) & F.coalesce(
        F.array_contains(F.json_object_keys("line"), "$rewindTo"), F.lit(False)))
    kind = (F.when(F.col("oversize"), "oversize").when(malformed, "malformed").when(broken, "ignored")
             .when(rewound, "rewind").when(patch.isNotNull(), "patch")
             .when(v["$set"].isNotNull(), "set").when(v["id"].isNotNull(), F.when(v["id"] != "", "put").otherwise("ignored"))
             .when(v["sessionId"].isNotNull(), "header").otherwise("ignored"))
    none = F.lit(None).cast("string")
    updates = F.concat(F.array(F.struct(patch["id"].alias("id"), patch["content"].alias("content"))),
                       F.coalesce(patch["updates"], F.array().cast("array<struct<id:string,content:variant>>")))
    no_ids = F.lit(None).cast("array<string>")

    def op(name: str, ident: Column, ids: Column, message: Column) -> Column:
        return F.struct(F.lit(name).alias("op"), ident.alias("id"), ids.alias("ids"), message.alias("message"))

    blank = F.lit(None).cast(replay.MESSAGE)
    kept = F.filter(updates, lambda u: (F.coalesce(u["id"], F.lit("")) != "") & u["content"].isNotNull())
    patches = F.transform(kept, lambda u: op("patch", u["id"], no_ids, _patched(u["content"]).cast(replay.MESSAGE)))
    removed = F.transform(F.coalesce(patch["removeIds"], F.array().cast("array<string>")), lambda i: op("remove", i, no_ids, blank))
    moved = F.when(F.size(F.coalesce(patch["orderIds"], F.array().cast("array<string>"))) > 0,
                   F.array(op("order", none, patch["orderIds"], blank))).otherwise(F.slice(F.array(op("order", none, no_ids, blank)), 1, 0))
    ops = (F.when(F.col("what") == "put", F.array(op("put", v["id"], no_ids, _message(v).cast(replay.MESSAGE))))
            .when(F.col("what") == "rewind", F.array(op("rewind", F.coalesce(v["$rewindTo"], F.lit("")), no_ids, blank)))
            .when(F.col("what") == "patch", F.concat(patches, removed, moved)))
    meta = F.when(F.col("what") == "header", F.struct(v["startTime"], v["lastUpdated"], v["kind"])).when(
        F.col("what") == "set", F.struct(v["$set"]["startTime"], v["$set"]["lastUpdated"], v["$set"]["kind"]))
    return r.withColumn("what", kind).select(
        "store_id", "path", "line_key", "what", ops.alias("ops"),
        F.when(F.col("what") == "header", text.blank_to_null(v["sessionId"])).alias("session_id"),
        text.blank_to_null(meta["startTime"]).alias("start"), text.blank_to_null(meta["lastUpdated"]).alias("updated"),
        text.blank_to_null(meta["kind"]).alias("kind"))


def parse_documents(docs: DataFrame) -> DataFrame:
    """Whole-document recordings in the shape of :func:`parse_log`."""
    v = docs.withColumn("r", F.from_json("doc", DOCUMENT, {"columnNameOfCorruptRecord": "_bad"}))
    bad = ~F.col("oversize") & (F.col("r._bad").isNotNull() | F.col("r").isNull())
    what = F.when(F.col("oversize"), "oversize_session").when(bad, "malformed_session").otherwise("header")
    r = F.col("r")
    good = F.filter(r["messages"], lambda m: F.coalesce(m["id"], F.lit("")) != "")
    ops = F.transform(good, lambda m: F.struct(
        F.lit("put").alias("op"), m["id"].alias("id"), F.lit(None).cast("array<string>").alias("ids"),
        _message(m).cast(replay.MESSAGE).alias("message")))
    key = F.struct(F.col("path"), F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("n"))
    return v.select(
        "store_id", "path", key.alias("line_key"), what.alias("what"), ops.alias("ops"),
        text.blank_to_null(r["sessionId"]).alias("session_id"), text.blank_to_null(r["startTime"]).alias("start"),
        text.blank_to_null(r["lastUpdated"]).alias("updated"), text.blank_to_null(r["kind"]).alias("kind"))


def normalize(raw: DataFrame, docs: DataFrame | None, source_files: DataFrame, stage: Stage = LAZY) -> Tables:
    events = parse_log(raw)
    if docs is not None:
        events = events.unionByName(parse_documents(docs))
    events = stage(events, "gemini_events")
    operations = events.select("store_id", "path", "line_key", F.posexplode("ops").alias("sub", "o")).select(
        "store_id", "path", _seq(F.col("sub")).alias("seq"), "o.*")
    left = stage(replay.survivors(operations, stage), "gemini_messages")

    def latest(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_key"))).alias(c)

    known = events.where(~F.col("what").isin("oversize_session", "malformed_session"))
    heads = known.groupBy("store_id", "path").agg(
        F.min_by("session_id", F.when(F.col("session_id").isNotNull(), F.col("line_key"))).alias("session_id"),
        latest("start"), latest("updated"), latest("kind"))
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), r"\.jsonl?$", "")
    folder = F.element_at(F.split("path", "/"), -2)
    child = F.coalesce(F.col("kind") == "subagent", F.lit(False))
    heads = heads.select(
        "store_id", "path", F.coalesce("session_id", stem).alias("session_id"), child.alias("is_child"),
        F.when(child & (folder != "chats"), folder).alias("parent_id"), text.chat_folder_project(F.col("path")).alias("project"),
        times.parse_rfc3339(F.col("start")).alias("head_start"), times.parse_rfc3339(F.col("updated")).alias("head_end"))
    m = F.col("message")
    facts = left.groupBy("store_id", "path").agg(F.min(m["at"]).alias("first_at"), F.max(m["at"]).alias("last_at"),
                                                 F.sum(m["tools"]).alias("tool_calls"))
    spent = ledger(left.select("store_id", "path", m["usage"].alias("usage")), ("store_id", "path"), F.lit(0))
    spent = spent.select("store_id", "path", usage(F.coalesce("source", F.lit("")), F.col("available"), **{
        k: F.col(k) for k in ("input", "output", "cache_read", "reasoning")}).alias("usage"))
    joined = heads.join(facts, ["store_id", "path"], "left").join(spent, ["store_id", "path"], "left")
    ended = F.greatest("head_end", "last_at")
    sessions = stage(complete_sessions(joined.select(
        "store_id", "path", "session_id", "is_child", "parent_id", "project",
        F.concat_ws("\x1f", "session_id", F.sha2("path", 256)).alias("session_key"),
        F.least("head_start", "first_at").alias("started_at"), ended.alias("ended_at"), ended.alias("activity_at"),
        F.lit(BASIS).alias("activity_basis"), F.coalesce("tool_calls", F.lit(0)).alias("tool_calls"),
        F.coalesce("usage", usage("", False)).alias("usage"), F.least("head_start", "first_at").isNull().alias("time_unavailable")),
        HARNESS), "gemini_base")
    owned = left.join(sessions.select("store_id", "path", "harness", "session_key", "session_id", "is_child",
                                      F.col("started_at").alias("session_at")), ["store_id", "path"])
    order = F.struct(F.xxhash64("path").alias("src"), F.lit(0).cast("bigint").alias("block"), F.xxhash64("id").alias("n"))
    prompts = owned.where(m["type"] == "user").select(
        "store_id", "harness", "session_key", "session_id", "is_child", "session_at",
        F.concat_ws("#", "session_id", "id").alias("event_id"), order.alias("ord"), m["at"].alias("at"),
        F.coalesce(m["words"], F.lit(0)).alias("words"), F.coalesce(m["characters"], F.lit(0)).alias("characters"),
        F.coalesce(m["has_text"], F.lit(False)).alias("has_text"))
    models = owned.where(m["model"].isNotNull()).groupBy(
        "store_id", "harness", "session_key", "session_id", "is_child", "session_at", m["model"].alias("model")).agg(
        F.count(F.lit(1)).alias("turns"))
    counted = with_prompts_only(sessions, prompts)
    models = models.join(counted.select("store_id", "session_key"), ["store_id", "session_key"], "left_semi")
    names = {"oversize": "oversize_record", "malformed": "malformed_record", "oversize_session": "oversize_session",
             "malformed_session": "malformed_session"}
    warned = [warning_rows(events, {code: F.col("what") == w for w, code in names.items()}, HARNESS)]
    return assemble(raw.sparkSession, HARNESS, counted, prompts, source_files, warned, models, None, True,
                    "unavailable", stage)


def read(spark: SparkSession, lake: Lake, stage: Stage | None = None) -> Tables:
    stage = stage or Stage.shared(spark)
    files = selected_files(list_files(spark, lake, "gemini", "session-*"))
    raw = scan_lines(spark, lake, "gemini", "session-*.jsonl")
    docs = placed(scan_documents(spark, lake, "gemini", MAX_FILE_BYTES, "session-*.json")).join(
        files.select("store_id", "path"), ["store_id", "path"], "left_semi")
    return normalize(raw, docs, files, stage)
