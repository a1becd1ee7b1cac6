"""Provider-scoped metrics. Nothing here sums native units across harnesses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions.times import round1
from tallyloom.operators.dedupe import keep_first
from tallyloom.schemas import USAGE_SUMS

STORE = ("store_id", "harness")
FLEET = ("harness",)
_EVENT_ORDER = ("session_at", "session_id", "ord", "session_key")
# Fixed value: prefix of a basis that never counts as usage.
MTIME_BASIS = "file modification time"
MIXED_BASIS = "mixed recorded times"
# Labels by median word count.
TERSE, SPECIFICATION, PRECISION = "terse operator", "specification writer", "precision prompter"


def countable_root() -> Column:
    return (~F.col("is_child") & ~F.coalesce(F.col("unanchored"), F.lit(False))
            & ~F.coalesce(F.col("activity_basis").startswith(MTIME_BASIS), F.lit(False)))


def _timed() -> Column:
    return countable_root() & ~F.coalesce(F.col("time_unavailable"), F.lit(False))


def session_end() -> Column:
    return F.coalesce(F.col("ended_at"), F.col("started_at"))


def session_counts(sessions: DataFrame, scope: Sequence[str] = STORE) -> DataFrame:
    """Countable roots, children, projects, span and time basis in one pass."""
    basis = F.when(_timed(), F.col("activity_basis"))
    return sessions.groupBy(*scope).agg(
        F.count_if(countable_root()).alias("sessions"),
        F.count_if(F.col("is_child")).alias("child_sessions"),
        F.count_distinct(F.when(countable_root(), F.col("project"))).alias("projects"),
        F.min(F.when(_timed(), F.col("started_at"))).alias("span_start"),
        F.max(F.when(_timed(), session_end())).alias("span_end"),
        F.when(F.min(basis) != F.max(basis), MIXED_BASIS).otherwise(F.min(basis)).alias("time_basis"),
        F.min(F.when(_timed() & ~F.coalesce(F.col("history_only"), F.lit(False)),
                     F.col("started_at"))).alias("detailed_start"))


def distinct_prompts(prompts: DataFrame, scope: Sequence[str] = STORE) -> DataFrame:
    """First occurrence of every prompt of a non-child session."""
    return keep_first(prompts.where(~F.col("is_child")), scope, "event_id", _EVENT_ORDER,
                      ("at", "words", "characters", "has_text"))


def distinct_calls(calls: DataFrame, scope: Sequence[str] = STORE) -> DataFrame:
    """First record per response id keeps its usage and model."""
    return keep_first(calls.where(~F.col("is_child")), scope, "call_id", _EVENT_ORDER,
                      ("session_at", "session_id", "ord", "model", "usage"))


def distinct_tools(tools: DataFrame, scope: Sequence[str] = STORE) -> DataFrame:
    """Union of tool ids; uses without an id count one by one."""
    return tools.where(~F.col("is_child")).groupBy(*scope).agg(
        (F.count_distinct("tool_id") + F.count_if(F.col("tool_id").isNull())).alias("tools"))


def ledger(rows: DataFrame, scope: Sequence[str], order: Column) -> DataFrame:
    """Sum of available usage. ``exact`` holds only if every part is exact."""
    ready = F.col("usage.available")
    return rows.groupBy(*scope).agg(
        F.coalesce(F.bool_or(ready), F.lit(False)).alias("available"),
        F.coalesce(F.bool_and(F.when(ready, F.col("usage.exact"))), F.lit(False)).alias("exact"),
        *[F.coalesce(F.sum(F.when(ready, F.col(f"usage.{k}"))), F.lit(0)).alias(k) for k in USAGE_SUMS],
        F.min_by(F.col("usage.source"), F.when(ready & (F.col("usage.source") != ""), order)).alias("source"))


def token_ledger(sessions: DataFrame, first_calls: DataFrame, scope: Sequence[str] = STORE) -> DataFrame:
    """Usage of sessions without calls, then of the distinct calls."""
    whole = sessions.where(~F.col("is_child") & ~F.col("has_calls")).select(
        *scope, "usage", F.lit(0).alias("_part"), F.col("started_at").alias("_at"),
        F.col("session_id").alias("_id"))
    single = first_calls.select(*scope, "usage", F.lit(1).alias("_part"),
                                F.col("session_at").alias("_at"), F.col("session_id").alias("_id"))
    return ledger(whole.unionByName(single), scope, F.struct("_part", "_at", "_id"))


def model_turns(model_activity: DataFrame, first_calls: DataFrame,
                scope: Sequence[str] = STORE) -> DataFrame:
    """One turn per distinct call with a model, plus counters of call-less sessions.

    ``model_activity`` only holds rows of sessions without calls.
    """
    counters = model_activity.where(~F.col("is_child")).select(*scope, "model", "turns")
    single = first_calls.select(*scope, "model", F.lit(1).cast("long").alias("turns"))
    return (counters.unionByName(single).where(F.col("model").isNotNull())
            .groupBy(*scope, "model").agg(F.sum("turns").alias("turns")).where(F.col("turns") > 0))


def tool_calls(sessions: DataFrame, calls: DataFrame, tools: DataFrame,
               scope: Sequence[str] = STORE) -> DataFrame:
    """Distinct tool ids when the provider has calls, else the session counters."""
    counters = sessions.where(~F.col("is_child") & ~F.col("has_calls")).groupBy(*scope).agg(
        F.sum("tool_calls").alias("_counter"))
    has_calls = calls.where(~F.col("is_child")).groupBy(*scope).agg(F.lit(True).alias("_has_calls"))
    parts = (counters.unionByName(has_calls, allowMissingColumns=True)
             .unionByName(distinct_tools(tools, scope), allowMissingColumns=True))
    return parts.groupBy(*scope).agg(
        F.when(F.bool_or("_has_calls"), F.coalesce(F.max("tools"), F.lit(0)))
         .otherwise(F.coalesce(F.max("_counter"), F.lit(0))).alias("tool_calls"))


def project_ranking(sessions: DataFrame) -> DataFrame:
    """Countable roots per exact project name, untimed sessions included."""
    return (sessions.where(countable_root() & F.col("project").isNotNull())
            .groupBy(F.col("project").alias("name")).agg(F.count(F.lit(1)).alias("sessions")))


def order_projects(projects: DataFrame) -> DataFrame:
    """``projects`` with ``position``: most sessions first, then by name without case."""
    from tallyloom.operators.views import order_by_metric

    named = projects.withColumn("_name", F.concat_ws("\x00", F.lower("name"), F.col("name")))
    return order_by_metric(named, "sessions", "_name").drop("_name")


def longest_session(sessions: DataFrame) -> DataFrame:
    """Longest countable root; ties keep the first by harness, start, id."""
    seconds = (F.unix_micros("ended_at") - F.unix_micros("started_at")) / F.lit(1e6)
    return (sessions.where(_timed() & F.col("started_at").isNotNull())
            .withColumn("ended_at", session_end())
            .select("store_id", "harness", "started_at", "session_id", seconds.alias("seconds"))
            .where(F.col("seconds") >= 0)
            .orderBy(F.desc("seconds"), "harness", "started_at", "session_id", "store_id").limit(1)
            .select("harness", F.round(F.col("seconds") / 60).cast("long").alias("duration_minutes")))


def prompt_style(first_prompts: DataFrame) -> DataFrame:
    """Count, exact median, averages and label over distinct textual prompts."""
    row = first_prompts.where(F.col("has_text")).agg(
        F.count(F.lit(1)).alias("count"),
        F.percentile("words", F.lit(0.5)).alias("median_words"),
        round1(F.avg("words")).alias("average_words"),
        round1(F.avg("characters")).alias("average_characters"))
    median = F.col("median_words")
    label = (F.when(median.isNull(), F.lit("")).when(median <= 15, TERSE)
              .when(median > 60, SPECIFICATION).otherwise(PRECISION))
    return row.select((F.col("count") > 0).alias("available"), "count",
                      *[F.coalesce(F.col(c), F.lit(0.0)).alias(c)
                        for c in ("median_words", "average_words", "average_characters")],
                      label.alias("label"))


def warning_counts(warnings: DataFrame, scope: Sequence[str] = STORE) -> DataFrame:
    return (warnings.groupBy(*scope, "code").agg(F.sum("n").alias("count"))
            .where(F.col("count") > 0))


def global_span(sessions: DataFrame) -> DataFrame:
    return sessions.where(_timed()).agg(F.min("started_at").alias("start"),
                                        F.max(session_end()).alias("end"))
