"""Per-task event arrays shared by the ``cline`` and ``roo`` harnesses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.functions import text, times
from tallyloom.operators.metrics import ledger
from tallyloom.schemas import Tables, usage
from tallyloom.sources.common import assemble, attach, complete_sessions, row_ord, with_prompts_only
from tallyloom.sources.lake import LAZY, Lake, Stage, scan_documents, warning_rows

MESSAGES, METADATA = "ui_messages.json", "task_metadata.json"
#: Fixed values of the original tool, in force if the job asks for them (lake.byte_limit).
MAX_MESSAGES_BYTES = 128 << 20
MAX_METADATA_BYTES = 8 << 20
BASIS = "task message timestamps"
USAGE_SOURCE = "task API request records"
PROMPT_SAYS = ("task", "user_feedback")
REQUEST_SAYS = ("api_req_started", "deleted_api_reqs")
EVENTS = "array<struct<ts:bigint,type:string,say:string,text:string,partial:boolean>>"
REQUEST = "tokensIn bigint, tokensOut bigint, cacheWrites bigint, cacheReads bigint, _bad string"


def first_root(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one document per task id, task ids with later copies).

    The earliest root wins before anything is decoded, even if its copy is broken.
    """
    named = docs.withColumn("task_id", F.element_at(F.split("path", "/"), -2))
    winners = named.groupBy("store_id", "task_id").agg(
        F.min_by("path", F.struct("root_rank", "path")).alias("path"), (F.count(F.lit(1)) - 1).alias("repeats"))
    return named.join(winners.select("store_id", "task_id", "path"), ["store_id", "task_id", "path"], "left_semi"), winners


def normalize(docs: DataFrame, metadata: DataFrame | None, harness: str, stage: Stage = LAZY) -> Tables:
    """``docs``: store_id, path, root_rank, doc, oversize of every event file."""
    spark = docs.sparkSession
    chosen, winners = first_root(docs)
    r = chosen.withColumn("e", F.from_json("doc", EVENTS, {"mode": "PERMISSIVE"}))
    bad = ~F.col("oversize") & F.col("e").isNull() & (F.trim("doc") != "null")
    marked = F.exists("e", lambda x: (x["type"] == "say") & (x["say"] == "task"))

    def small(x, i):
        say = F.coalesce((x["type"] == "say") & ~F.coalesce(x["partial"], F.lit(False)), F.lit(False))
        prompt = say & (x["say"].isin(*PROMPT_SAYS)
                        | ((x["say"] == "text") & (i == 0) & ~F.coalesce(marked, F.lit(False))))
        request = say & x["say"].isin(*REQUEST_SAYS)
        body = F.coalesce(x["text"], F.lit(""))
        q = F.from_json(body, REQUEST, {"columnNameOfCorruptRecord": "_bad"})
        broken = request & (q["_bad"].isNotNull() | q.isNull()) & (F.trim(body) != "null")
        spent = usage(USAGE_SOURCE, request & ~broken, input=q["tokensIn"], output=q["tokensOut"],
                      cache_read=q["cacheReads"], cache_write=q["cacheWrites"])
        return F.struct(
            i.alias("i"), times.from_millis(x["ts"]).alias("at"), F.coalesce(prompt, F.lit(False)).alias("prompt"),
            F.coalesce(broken, F.lit(False)).alias("broken"),
            F.coalesce(request & ~broken & (x["say"] == REQUEST_SAYS[0]), F.lit(False)).alias("counted"),
            spent.alias("usage"), F.when(prompt, text.words(body)).alias("words"),
            F.when(prompt, text.characters(body)).alias("characters"), F.when(prompt, text.has_text(body)).alias("has_text"))

    tasks = stage(r.select("store_id", "path", F.col("task_id").alias("session_id"), "oversize", bad.alias("bad"),
                           F.transform("e", small).alias("events")), f"{harness}_tasks")
    events = tasks.select("store_id", "path", "session_id", F.explode("events").alias("x")).select(
        "store_id", "path", "session_id", "x.*")
    facts = events.groupBy("store_id", "path", "session_id").agg(
        F.min("at").alias("started_at"), F.max("at").alias("ended_at"), F.count_if("counted").alias("requests"))
    spent = ledger(events, ("store_id", "session_id"), F.col("i")).select(
        "store_id", "session_id", usage(F.coalesce("source", F.lit("")), F.col("available"), **{
            k: F.col(k) for k in ("input", "output", "cache_read", "cache_write")}).alias("usage"))
    joined = facts.join(spent, ["store_id", "session_id"], "left")
    if metadata is not None:
        ids = F.from_json("doc", "model_usage array<struct<model_id:string>>")["model_usage"]
        single = text.single_label(F.transform(ids, lambda m: m["model_id"]), 80)
        models = metadata.where(~F.col("oversize")).select(
            "store_id", F.regexp_replace("path", "/[^/]*$", "").alias("dir"), single.alias("model"))
        joined = joined.withColumn("dir", F.regexp_replace("path", "/[^/]*$", "")).join(models, ["store_id", "dir"], "left")
    else:
        joined = joined.withColumn("model", F.lit(None).cast("string"))
    sessions = complete_sessions(joined.select(
        "store_id", "session_id", "started_at", "ended_at", F.col("ended_at").alias("activity_at"),
        F.lit(BASIS).alias("activity_basis"), "usage", F.col("started_at").isNull().alias("time_unavailable"),
        "model", "requests"), harness)
    prompts = attach(events.where("prompt").select(
        "store_id", "session_id", F.concat_ws("#", "session_id", F.col("i").cast("string")).alias("event_id"),
        row_ord(F.col("i")).alias("ord"), "at", "words", "characters", "has_text"), sessions)
    counted = with_prompts_only(sessions, prompts)
    model_rows = counted.where(F.col("model").isNotNull()).select(
        "store_id", "harness", "session_key", "session_id", "is_child", F.col("started_at").alias("session_at"),
        "model", F.col("requests").alias("turns"))
    warned = [
        warning_rows(winners, {"duplicate_task_id": F.col("repeats")}, harness),
        warning_rows(tasks, {"oversize_task": F.col("oversize"), "malformed_task": F.col("bad")}, harness),
        warning_rows(events, {"malformed_api_request_record": F.col("broken")}, harness)]
    return assemble(spark, harness, counted, prompts, docs.select("store_id"), warned, model_rows, stage=stage)


def _read(spark: SparkSession, lake: Lake, harness: str, with_models: bool, stage: Stage | None) -> Tables:
    stage = stage or Stage.shared(spark)
    docs = scan_documents(spark, lake, harness, MAX_MESSAGES_BYTES, MESSAGES).where(F.size(F.split("rel", "/")) == 2)
    rank = F.lit(len(lake.layout[harness]))
    for i, root in reversed(list(enumerate(lake.layout[harness]))):
        rank = F.when(F.col("path").contains(f"/{root}/"), i).otherwise(rank)
    metadata = scan_documents(spark, lake, harness, MAX_METADATA_BYTES, METADATA) if with_models else None
    return normalize(docs.withColumn("root_rank", rank), metadata, harness, stage)


def read_cline(spark: SparkSession, lake: Lake, stage: Stage | None = None) -> Tables:
    return _read(spark, lake, "cline", True, stage)


def read_roo(spark: SparkSession, lake: Lake, stage: Stage | None = None) -> Tables:
    return _read(spark, lake, "roo", False, stage)
