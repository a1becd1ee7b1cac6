"""Canonical content-free tables.

Every key starts with ``(store_id, harness)``; ``session_key`` is unique inside
it. ``session_at`` and ``is_child`` are repeated on the event tables so that the
metrics need no join back to ``sessions``. Event order inside a session is the
comparable struct ``ord`` (hashed source, block, position). No table holds raw
text or a path.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ORD = "struct<src:bigint,block:bigint,n:bigint>"
USAGE = ("struct<available:boolean,exact:boolean,input:bigint,output:bigint,"
         "cache_read:bigint,cache_write:bigint,reasoning:bigint,source:string>")
USAGE_SUMS = ("input", "output", "cache_read", "cache_write", "reasoning")

SESSIONS = (
    "store_id string, harness string, session_key string, session_id string, parent_id string, "
    "is_child boolean, started_at timestamp, ended_at timestamp, activity_at timestamp, "
    f"activity_basis string, project string, tool_calls bigint, usage {USAGE}, "
    "has_calls boolean, unanchored boolean, history_only boolean, time_unavailable boolean")
_EVENT = ("store_id string, harness string, session_key string, session_id string, "
          "is_child boolean, session_at timestamp, ")
PROMPTS = _EVENT + f"event_id string, ord {ORD}, at timestamp, words bigint, characters bigint, has_text boolean"
CALLS = _EVENT + f"call_id string, ord {ORD}, model string, usage {USAGE}"
TOOLS = _EVENT + f"tool_id string, ord {ORD}"
MODEL_ACTIVITY = _EVENT + f"model string, turns bigint, usage {USAGE}"
WARNINGS = "store_id string, harness string, code string, n bigint"
PROVIDERS = (
    "store_id string, harness string, status string, tool_calls_available boolean, "
    "source_files bigint, coverage_status string, coverage_confidence string, "
    "earliest_local_evidence timestamp, earliest_detailed_record timestamp, "
    "history_only_sessions bigint, unmaterialized_sessions bigint")


@dataclass
class Tables:
    """One harness's, or all harnesses', normalised tables."""

    sessions: DataFrame
    prompts: DataFrame
    calls: DataFrame
    tools: DataFrame
    model_activity: DataFrame
    warnings: DataFrame
    providers: DataFrame

    def named(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


SCHEMAS = {"sessions": SESSIONS, "prompts": PROMPTS, "calls": CALLS, "tools": TOOLS,
           "model_activity": MODEL_ACTIVITY, "warnings": WARNINGS, "providers": PROVIDERS}

#: Column names that would carry content or a location into a published table.
FORBIDDEN_COLUMNS = frozenset({"text", "content", "line", "value", "body", "path", "cwd", "prompt",
                               "display", "message", "uri", "url"})


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """Content-free projection: exactly the published columns, in order and type."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([], SCHEMAS[name]).schema
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in wanted.fields])


def tables(spark: SparkSession, **frames: DataFrame) -> Tables:
    return Tables(**{name: conform(frames[name], name) if frames.get(name) is not None
                     else empty(spark, name) for name in SCHEMAS})


def usage(source: str | Column, available: Column | bool = True, **counts: Column) -> Column:
    """Usage struct with absent counts as zero; NULL-free so that structs compare."""
    ready = F.lit(available) if isinstance(available, bool) else F.coalesce(available, F.lit(False))
    sums = [F.when(ready, F.coalesce(counts.get(k, F.lit(0)).cast("bigint"), F.lit(0)))
             .otherwise(F.lit(0).cast("bigint")).alias(k) for k in USAGE_SUMS]
    label = F.lit(source) if isinstance(source, str) else source
    return F.struct(ready.alias("available"), ready.alias("exact"), *sums,
                    F.when(ready, label).otherwise(F.lit("")).alias("source"))


def published_ord(key: Column) -> Column:
    """Event order without the path it came from."""
    return F.struct(F.xxhash64(key["path"]).alias("src"), key["block"].alias("block"),
                    key["n"].alias("n"))


def no_usage() -> Column:
    return usage("", False)


def union_all(parts: list[Tables]) -> Tables:
    """Concatenate the outputs of several readers."""
    merged = {}
    for name in SCHEMAS:
        frame = getattr(parts[0], name)
        for part in parts[1:]:
            frame = frame.unionByName(getattr(part, name), allowMissingColumns=True)
        merged[name] = frame
    return Tables(**merged)
