"""Steps shared by the readers: keys, event frames, spans, provider rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.operators import coverage
from tallyloom.schemas import Tables, tables, usage
from tallyloom.sources.lake import LAZY, Lake, Stage, sum_warnings

SCOPE = ["store_id", "harness"]
SESSION = [*SCOPE, "session_key"]


def store_of(lake: Lake, path: Column) -> Column:
    base = re.escape(re.sub("^file:/*", "/", lake.base.rstrip("/")))
    return F.regexp_extract(path, f"^{base}/([^/]+)/", 1)


def row_ord(n: Column) -> Column:
    return F.struct(F.lit(0).cast("bigint").alias("src"), F.lit(0).cast("bigint").alias("block"),
                    n.cast("bigint").alias("n"))


def complete_sessions(df: DataFrame, harness: str) -> DataFrame:
    """Fill the session columns a reader left out."""
    defaults = {
        "harness": F.lit(harness), "parent_id": F.lit(None).cast("string"), "is_child": F.lit(False),
        "session_key": F.col("session_id"), "activity_at": F.col("started_at"), "project": F.lit(None).cast("string"),
        "tool_calls": F.lit(0).cast("bigint"), "usage": usage("", False), "has_calls": F.lit(False),
        "unanchored": F.lit(False), "history_only": F.lit(False), "time_unavailable": F.lit(False)}
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def attach(events: DataFrame, sessions: DataFrame, on: Sequence[str] = ("store_id", "session_id")) -> DataFrame:
    """Events of known sessions, with the session columns the metrics need."""
    heads = sessions.select("store_id", "harness", "session_key", "session_id", "is_child",
                            F.col("started_at").alias("session_at"))
    return events.join(heads, list(on))


def with_prompts_only(sessions: DataFrame, prompts: DataFrame) -> DataFrame:
    return sessions.join(prompts.select("store_id", "session_key").distinct(),
                         ["store_id", "session_key"], "left_semi")


def assemble(spark, harness: str, sessions: DataFrame, prompts: DataFrame, source_files: DataFrame,
             warned: Sequence[DataFrame] = (), models: DataFrame | None = None,
             forced_status: DataFrame | None = None, tools_available: DataFrame | bool = False,
             empty_with_warnings: str | None = "unavailable", stage: Stage = LAZY) -> Tables:
    """Tables of a harness without supplemental evidence.

    ``source_files``: one row (store_id) per file; ``forced_status``: (store_id,
    forced) for stores whose source could not be read or recognised;
    ``tools_available``: (store_id) rows or one flag for all.
    """
    sessions = stage(sessions, f"{harness}_sessions")
    prompts = stage(prompts, f"{harness}_prompts")
    if models is not None:
        models = stage(models, f"{harness}_models")
    warnings = stage(sum_warnings(list(warned)), f"{harness}_warnings") if warned else None

    files = source_files.select("store_id").groupBy("store_id").agg(F.count(F.lit(1)).alias("source_files"))
    roots = sessions.groupBy("store_id").agg(
        F.count_if(~F.col("is_child")).alias("roots"), F.count_if("is_child").alias("children"))
    parts = files.unionByName(roots, True)
    if warnings is not None:
        parts = parts.unionByName(warnings.groupBy("store_id").agg(F.count(F.lit(1)).alias("codes")), True)
    else:
        parts = parts.withColumn("codes", F.lit(None).cast("bigint"))
    if forced_status is not None:
        parts = parts.unionByName(forced_status.select("store_id", "forced"), True)
    else:
        parts = parts.withColumn("forced", F.lit(None).cast("string"))
    if isinstance(tools_available, DataFrame):
        parts = parts.unionByName(tools_available.select("store_id").distinct().withColumn("tools", F.lit(True)), True)
    else:
        parts = parts.withColumn("tools", F.lit(tools_available))
    row = parts.groupBy("store_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("source_files", "roots", "children", "codes")],
        F.max("forced").alias("forced"), F.coalesce(F.bool_or("tools"), F.lit(False)).alias("tools"))
    status = F.coalesce("forced", coverage.provider_status(
        F.col("source_files"), F.col("roots") + F.col("children"), F.col("codes"), empty_with_warnings))
    judged = coverage.default_status(F.col("status"), F.col("roots"), F.col("children"))
    providers = (row.withColumns({"harness": F.lit(harness), "status": status})
                 .withColumn("coverage_status", judged)
                 .withColumn("coverage_confidence", coverage.confidence(F.col("coverage_status")))
                 .withColumns({"tool_calls_available": F.col("tools"), "history_only_sessions": F.lit(0),
                               "unmaterialized_sessions": F.lit(0)}))
    return tables(spark, sessions=sessions, prompts=prompts, model_activity=models,
                  warnings=warnings, providers=providers)
