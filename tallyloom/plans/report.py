"""The report: one nested row, schema version 3, from the normalised tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.functions import times
from tallyloom.operators import coverage, metrics, rhythm
from tallyloom.plans.texts import DISPLAY_NAMES, LIMITATIONS, METHODOLOGY, WARNING_MESSAGES
from tallyloom.schemas import Tables

SCHEMA_VERSION = 3
USAGE_FIELDS = ("available", "exact", "input", "output", "cache_read", "cache_write", "reasoning", "source")


@dataclass(frozen=True)
class Options:
    zone: str = "UTC"
    now: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    version: str = "dev"
    observation: str = "disabled"
    #: Ids are de-duplicated per store, or across the fleet as one logical home.
    dedupe_scope: Sequence[str] = metrics.STORE
    #: Whether the document lists all models and projects; else they are in their tables alone.
    inline_lists: bool = True


def _messages(spark: SparkSession) -> DataFrame:
    """Fixed lookup of a few hundred bytes per code."""
    return F.broadcast(spark.createDataFrame(sorted(WARNING_MESSAGES.items()), "code string, message string"))


def warnings_table(tables: Tables) -> DataFrame:
    counted = metrics.warning_counts(tables.warnings, ("harness",))
    joined = counted.join(_messages(counted.sparkSession), "code", "left")
    return joined.select("harness", "code", "count", F.coalesce("message", F.lit("")).alias("message"))


def _rolled_status() -> Column:
    """Status of a harness over its stores; one store keeps its own."""
    s = F.col("status")
    good = F.bool_or(s.startswith("supported"))
    plain = F.bool_and(s.isin("supported", "not found"))
    return F.when(F.min("status") == F.max("status"), F.min("status")).when(
        good & plain, "supported").when(good, "supported with warnings").otherwise(F.max("status"))


def provider_summary(tables: Tables, options: Options = Options()) -> DataFrame:
    """One row per harness; every known harness is listed, found or not."""
    h, scope = ["harness"], list(options.dedupe_scope)
    spark = tables.sessions.sparkSession
    first_calls = metrics.distinct_calls(tables.calls, scope)
    names = spark.createDataFrame(list(DISPLAY_NAMES.items()), "harness string, name string")
    worst = F.lit(len(coverage.CONFIDENCE))
    for i, status in reversed(list(enumerate(coverage.CONFIDENCE))):
        worst = F.when(F.col("coverage_status") == status, i).otherwise(worst)
    rolled = tables.providers.groupBy("harness").agg(
        _rolled_status().alias("status"), F.bool_or("tool_calls_available").alias("tool_calls_available"),
        F.sum("source_files").alias("source_file_count"), F.min_by("coverage_status", worst).alias("coverage_status"),
        F.min("earliest_local_evidence").alias("evidence"), F.min("earliest_detailed_record").alias("detailed"),
        F.sum("history_only_sessions").alias("history_only_sessions"),
        F.sum("unmaterialized_sessions").alias("unmaterialized_sessions"))
    counts = metrics.session_counts(tables.sessions, h)
    prompts = metrics.distinct_prompts(tables.prompts, scope).groupBy("harness").agg(F.count(F.lit(1)).alias("prompts"))
    tools = metrics.tool_calls(tables.sessions, tables.calls, tables.tools, scope).groupBy("harness").agg(
        F.sum("tool_calls").alias("tool_calls"))
    tokens = metrics.token_ledger(tables.sessions, first_calls, h).select(
        "harness", F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c == "source" else F.col(c)
                              for c in USAGE_FIELDS]).alias("token_usage"))
    warned = warnings_table(tables).groupBy("harness").agg(
        F.array_sort(F.collect_list(F.struct("code", "count", "message"))).alias("warnings"))
    joined = names
    for part in (rolled, counts, prompts, tools, tokens, warned):
        joined = joined.join(part, "harness", "left")
    status = F.coalesce("status", F.lit("not found"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("sessions", "child_sessions", "prompts", "projects", "tool_calls",
                                                  "source_file_count", "history_only_sessions", "unmaterialized_sessions")}
    filled = joined.withColumns(zero).withColumn("status", status)
    judged = F.coalesce("coverage_status", coverage.default_status(F.col("status"), F.col("sessions"), F.col("child_sessions")))
    limits = F.create_map(*[x for k, v in LIMITATIONS.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    none = F.struct(F.lit(False).alias("available"), F.lit(False).alias("exact"),
                    *[F.lit(0).cast("bigint").alias(c) for c in USAGE_FIELDS[2:7]], F.lit("").alias("source"))
    return filled.withColumn("coverage_status", judged).select(
        F.col("harness").alias("id"), "name", "status", F.lit("schema-verified with synthetic fixtures").alias("verification"),
        "sessions", "child_sessions", "prompts", "projects", "tool_calls",
        F.coalesce("tool_calls_available", F.lit(False)).alias("tool_calls_available"), "span_start", "span_end",
        F.coalesce("time_basis", F.lit("")).alias("time_basis"), F.coalesce("token_usage", none).alias("token_usage"),
        limits[F.col("harness")].alias("limitations"),
        F.coalesce("warnings", F.array().cast("array<struct<code:string,count:bigint,message:string>>")).alias("warnings"),
        "source_file_count", F.struct(
            F.col("coverage_status").alias("status"), coverage.confidence(F.col("coverage_status")).alias("confidence"),
            F.coalesce("evidence", "span_start").alias("earliest_local_evidence"),
            F.coalesce("detailed", "detailed_start").alias("earliest_detailed_record"),
            "history_only_sessions", "unmaterialized_sessions", coverage.note(F.col("coverage_status")).alias("note")).alias("coverage"))


def models_table(tables: Tables, options: Options = Options()) -> DataFrame:
    first_calls = metrics.distinct_calls(tables.calls, options.dedupe_scope)
    return metrics.model_turns(tables.model_activity, first_calls, ("harness",)).select(
        "harness", F.col("model").alias("name"), "turns")


def projects_table(tables: Tables) -> DataFrame:
    return metrics.project_ranking(tables.sessions)


def activity_table(tables: Tables, options: Options = Options()) -> DataFrame:
    """Sessions per local (date, hour); small, and the base of every rhythm figure."""
    return rhythm.activity_cells(tables.sessions, options.zone)


def _row(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.struct(*df.columns).alias(name))


def _rhythm(cells: DataFrame) -> DataFrame:
    days, hours = rhythm.daily(cells), rhythm.hours24(cells)
    parts = [
        days.agg(F.array_sort(F.collect_list(F.struct(F.col("date").cast("string").alias("date"), "count"))).alias("activity")),
        hours.agg(F.transform(F.array_sort(F.collect_list(F.struct("hour", "count"))), lambda x: x["count"]).alias("hours")),
        rhythm.weekdays7(cells).agg(F.transform(F.array_sort(F.collect_list(F.struct("weekday", "count"))),
                                                lambda x: x["count"]).alias("weekdays")),
        rhythm.favorite_hour(hours), rhythm.late_night(hours), rhythm.longest_streak(days.select("date")),
        rhythm.busiest_day(days).select(F.struct(F.col("date").cast("string").alias("date"), "count").alias("busiest_day")),
        rhythm.busiest_month(rhythm.monthly(cells)).select(F.struct("label", "count").alias("busiest_month")),
        days.agg(F.count(F.lit(1)).alias("active_days"))]
    return one_row(parts)


def one_row(parts: Sequence[DataFrame]) -> DataFrame:
    """Side by side: several one-row frames as one row."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged.agg(*[F.any_value(c, True).alias(c) for c in merged.columns])


def build(tables: Tables, options: Options = Options(), audit: DataFrame | None = None) -> DataFrame:
    """The report as one row.

    ``audit``: the row of :func:`tallyloom.operators.audit.compare`. The model and
    project lists are whole, whatever their length, or NULL if ``options`` leaves
    them to the tables of :func:`models_table` and :func:`projects_table`.
    """
    providers = provider_summary(tables, options)
    cells = activity_table(tables, options)
    first_prompts = metrics.distinct_prompts(tables.prompts, options.dedupe_scope)
    models, projects = models_table(tables, options), projects_table(tables)
    span = metrics.global_span(tables.sessions)
    local = [times.to_local(F.col(c), options.zone) for c in ("start", "end")]
    coverage_row = span.select(
        times.coverage_label(*local).alias("label"), "start", "end",
        times.timezone_label(options.zone, F.col("start")).alias("timezone"),
        times.is_calendar_year(*local).alias("calendar_framing"))
    sums = providers.agg(*[F.sum(c).alias(c) for c in ("sessions", "prompts", "child_sessions")],
                         F.sum("source_file_count").alias("source_files"))
    no_audit = tables.sessions.sparkSession.range(1).select(
        F.lit(False).alias("verified"), F.lit(0).cast("bigint").alias("files"), F.lit("").alias("manifest_before"),
        F.lit("").alias("manifest_after"), F.lit(0).cast("bigint").alias("changed_files"),
        F.lit(0).cast("bigint").alias("directory_changes"))
    audited = (audit if audit is not None else no_audit).select(*no_audit.columns)
    longest = metrics.longest_session(tables.sessions)
    parts = [
        _row(coverage_row, "coverage"), sums, _row(_rhythm(cells), "rhythm_all"),
        _row(metrics.prompt_style(first_prompts), "prompt_style"), _row(audited, "source_audit"),
        _row(longest, "longest"), projects.agg(F.count(F.lit(1)).alias("projects_n")),
        providers.agg(F.array_sort(F.collect_list(F.struct(*providers.columns))).alias("providers")),
        warnings_table(tables).agg(F.array_sort(F.collect_list(F.struct("harness", "code", "count", "message"))).alias("warnings")),
        _listed(models, ["harness", -F.col("turns"), "name"], options.inline_lists, "models"),
        _listed(projects, [-F.col("sessions"), F.lower("name"), "name"], options.inline_lists, "projects")]
    row = one_row(parts)
    r, a = F.col("rhythm_all"), F.col("source_audit")
    return row.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(options.now).alias("generated_at"),
        F.lit("tallyloom").alias("product_name"), F.lit(options.version).alias("generator_version"), "coverage",
        F.struct("sessions", "prompts", F.col("projects_n").alias("projects"), r["active_days"].alias("active_days"),
                 "child_sessions", "source_files", a["changed_files"].alias("source_files_changed")).alias("totals"),
        "providers", F.struct(*[r[c].alias(c) for c in (
            "activity", "hours", "weekdays", "favorite_hour", "late_night_percent", "longest_streak", "busiest_day",
            "busiest_month")]).alias("rhythm"), "prompt_style", "models", "projects",
        F.struct(F.col("longest").isNotNull().alias("available"), F.coalesce("longest.harness", F.lit("")).alias("harness"),
                 F.coalesce("longest.duration_minutes", F.lit(0)).alias("duration_minutes")).alias("longest_session"),
        F.struct(F.lit(False).alias("raw_content_persisted"), F.lit(False).alias("absolute_paths_persisted"),
                 F.lit("read-only").alias("source_access"), F.lit(options.observation).alias("source_observation"),
                 "source_audit").alias("privacy"),
        F.array(*[F.lit(m) for m in METHODOLOGY]).alias("methodology"), "warnings")


def _listed(df: DataFrame, order: Sequence, wanted: bool, name: str) -> DataFrame:
    """Ordered array of all rows, or NULL if it isn't wanted."""
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    entry = F.struct(*[k.alias(f"_{i}") for i, k in enumerate(keys)], F.struct(*df.columns).alias("row"))
    rows = df if wanted else df.limit(0)
    listed = rows.agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["row"]).alias(name))
    return listed if wanted else listed.select(F.when(F.lit(False), F.col(name)).alias(name))


def write(tables: Tables, path: str, options: Options = Options(), audit: DataFrame | None = None) -> None:
    """``document`` (one pretty JSON object) and one parquet folder per list."""
    document = build(tables, options, audit)
    text = F.to_json(F.struct(*document.columns), {"pretty": "true", "ignoreNullFields": "false"})
    document.select(text.alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/document")
    models_table(tables, options).write.mode("overwrite").partitionBy("harness").parquet(f"{path}/models")
    projects_table(tables).write.mode("overwrite").parquet(f"{path}/projects")
    activity_table(tables, options).write.mode("overwrite").parquet(f"{path}/activity")
    warnings_table(tables).write.mode("overwrite").parquet(f"{path}/warnings")
