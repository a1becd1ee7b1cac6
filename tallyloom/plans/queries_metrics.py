"""Provider metrics on the bound driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import coverage, metrics, views
from tallyloom.plans.bindings import (EV, WORDS_SQL, ev_calls, ev_model_activity, ev_prompts, ev_sessions, ev_tools,
                                      ev_warnings, micros, table)
from tallyloom.plans.registry import query

H = metrics.FLEET
_WORDS = WORDS_SQL


@query("sessions_by_harness", EV + "SELECT harness, count(*) AS sessions FROM sessions WHERE countable GROUP BY harness")
def sessions_by_harness(spark, sf_dir):
    return metrics.session_counts(ev_sessions(spark, sf_dir), H).select("harness", "sessions")


@query("child_sessions", EV + "SELECT harness, count(*) FILTER (is_child) AS child_sessions FROM sessions GROUP BY harness")
def child_sessions(spark, sf_dir):
    return metrics.session_counts(ev_sessions(spark, sf_dir), H).select("harness", "child_sessions")


@query("projects_by_harness", EV + """
SELECT harness, count(DISTINCT project) FILTER (countable) AS projects FROM sessions GROUP BY harness""")
def projects_by_harness(spark, sf_dir):
    return metrics.session_counts(ev_sessions(spark, sf_dir), H).select("harness", "projects")


@query("span_by_harness", EV + """
SELECT harness, epoch_us(min(started_at)) AS span_start, epoch_us(max(ended_at)) AS span_end
FROM timed GROUP BY harness""")
def span_by_harness(spark, sf_dir):
    counts = metrics.session_counts(ev_sessions(spark, sf_dir), H)
    return counts.select("harness", micros("span_start").alias("span_start"), micros("span_end").alias("span_end"))


@query("time_basis", EV + """
SELECT harness, CASE WHEN count(DISTINCT basis) > 1 THEN 'mixed recorded times' ELSE min(basis) END AS time_basis
FROM timed GROUP BY harness""")
def time_basis(spark, sf_dir):
    return metrics.session_counts(ev_sessions(spark, sf_dir), H).select("harness", "time_basis")


@query("coverage_minima", EV + """
SELECT harness, epoch_us(min(started_at)) AS earliest_local_evidence,
       epoch_us(min(started_at) FILTER (NOT history_only)) AS earliest_detailed_record
FROM timed GROUP BY harness""")
def coverage_minima(spark, sf_dir):
    counts = metrics.session_counts(ev_sessions(spark, sf_dir), H)
    return counts.select("harness", micros("span_start").alias("earliest_local_evidence"),
                         micros("detailed_start").alias("earliest_detailed_record"))


@query("distinct_prompts", EV + """
SELECT harness, count(*) AS prompts, CAST(sum(words) AS BIGINT) AS words,
       count(*) FILTER (has_text) AS textual FROM first_prompts GROUP BY harness""")
def distinct_prompts(spark, sf_dir):
    first = metrics.distinct_prompts(ev_prompts(spark, sf_dir), H)
    return first.groupBy("harness").agg(F.count(F.lit(1)).alias("prompts"), F.sum("words").alias("words"),
                                        F.count_if("has_text").alias("textual"))


@query("distinct_calls", EV + """
SELECT harness, count(*) AS calls, count(model) AS named FROM first_calls GROUP BY harness""")
def distinct_calls(spark, sf_dir):
    first = metrics.distinct_calls(ev_calls(spark, sf_dir), H)
    return first.groupBy("harness").agg(F.count(F.lit(1)).alias("calls"), F.count("model").alias("named"))


@query("distinct_tools", EV + """
SELECT harness, count(DISTINCT tool_id) + count(*) FILTER (tool_id IS NULL) AS tools
FROM calls WHERE NOT is_child GROUP BY harness""")
def distinct_tools(spark, sf_dir):
    return metrics.distinct_tools(ev_tools(spark, sf_dir), H)


@query("tool_calls_by_harness", EV + """
SELECT s.harness, CASE WHEN max(c.n) > 0 THEN max(c.tools) ELSE
         coalesce(CAST(sum(s.tool_calls) FILTER (NOT s.is_child AND NOT s.has_calls) AS BIGINT), 0) END AS tool_calls
FROM sessions s LEFT JOIN (
  SELECT harness, count(*) AS n, count(DISTINCT tool_id) + count(*) FILTER (tool_id IS NULL) AS tools
  FROM calls WHERE NOT is_child GROUP BY harness) c USING (harness) GROUP BY s.harness""")
def tool_calls_by_harness(spark, sf_dir):
    return metrics.tool_calls(ev_sessions(spark, sf_dir), ev_calls(spark, sf_dir), ev_tools(spark, sf_dir), H)


@query("token_ledger", EV + """
SELECT harness, bool_or(available) AS available, bool_or(available) AS exact,
       CAST(coalesce(sum(u_input) FILTER (available), 0) AS BIGINT) AS input,
       CAST(coalesce(sum(u_output) FILTER (available), 0) AS BIGINT) AS output,
       CAST(0 AS BIGINT) AS cache_read, CAST(0 AS BIGINT) AS cache_write, CAST(0 AS BIGINT) AS reasoning,
       max(source) FILTER (available) AS source FROM (
  SELECT harness, available, u_input, u_output, 'message.usage' AS source FROM first_calls
  UNION ALL
  SELECT harness, available, u_input, u_output, 'session columns' FROM sessions WHERE NOT is_child AND NOT has_calls)
GROUP BY harness
UNION ALL
SELECT 'none of ' || harness, false, false, 0, 0, 0, 0, 0, NULL FROM first_calls WHERE NOT available GROUP BY harness""")
def token_ledger(spark, sf_dir):
    first = metrics.distinct_calls(ev_calls(spark, sf_dir), H)
    sessions = ev_sessions(spark, sf_dir)
    # Calls without usage are harnesses of their own here, too: whose ledger is unavailable.
    bare = first.where("NOT usage.available").withColumn("harness", F.concat(F.lit("none of "), "harness"))
    total = metrics.token_ledger(sessions, first.unionByName(bare), H)
    return total.select("harness", "available", "exact", "input", "output", "cache_read", "cache_write", "reasoning", "source")


@query("model_turns", EV + "SELECT harness, model, turns FROM turns WHERE turns > 0")
def model_turns(spark, sf_dir):
    first = metrics.distinct_calls(ev_calls(spark, sf_dir), H)
    return metrics.model_turns(ev_model_activity(spark, sf_dir), first, H)


@query("models_ranked", EV + """
SELECT harness, model, turns, row_number() OVER (PARTITION BY harness ORDER BY turns DESC, model) AS rank FROM turns""")
def models_ranked(spark, sf_dir):
    return views.rank_in_group(model_turns(spark, sf_dir), ["harness"], "turns", "model")


@query("model_share", EV + """
SELECT harness, model, round(turns / greatest(max(turns) OVER (PARTITION BY harness), 1), 6) AS share FROM turns""")
def model_share(spark, sf_dir):
    shared = views.share_of_max(model_turns(spark, sf_dir), ["harness"], "turns")
    return shared.select("harness", "model", F.round("share", 6).alias("share"))


@query("project_ranking", EV + """
SELECT name, sessions, row_number() OVER (ORDER BY sessions DESC, lower(name), name) AS position FROM projects""")
def project_ranking(spark, sf_dir):
    return metrics.order_projects(metrics.project_ranking(ev_sessions(spark, sf_dir)))


@query("projects_top10_rest", EV + """
SELECT name, sessions AS value FROM (SELECT * FROM projects ORDER BY sessions DESC, lower(name), name LIMIT 10)
UNION ALL SELECT '(more)', greatest((SELECT count(*) FROM projects) - 10, 0)""")
def projects_top10_rest(spark, sf_dir):
    projects = metrics.project_ranking(ev_sessions(spark, sf_dir))
    return views.top_and_rest(projects, [F.desc("sessions"), F.lower("name"), F.col("name")], "name", "sessions")


@query("longest_session", EV + """
SELECT harness, CAST(round((epoch_us(ended_at) - epoch_us(started_at)) / 60e6) AS BIGINT) AS duration_minutes
FROM timed ORDER BY epoch_us(ended_at) - epoch_us(started_at) DESC, harness, started_at, session_id LIMIT 1""")
def longest_session(spark, sf_dir):
    return metrics.longest_session(ev_sessions(spark, sf_dir))


@query("report_totals", EV + """
SELECT (SELECT count(*) FROM sessions WHERE countable) AS sessions,
       (SELECT count(*) FROM sessions WHERE is_child) AS child_sessions,
       (SELECT count(*) FROM first_prompts) AS prompts,
       (SELECT count(*) FROM projects) AS projects, (SELECT count(*) FROM days) AS active_days""")
def report_totals(spark, sf_dir):
    from tallyloom.operators import rhythm

    sessions = ev_sessions(spark, sf_dir)
    parts = (sessions.agg(F.count_if(metrics.countable_root()).alias("sessions"),
                          F.count_if("is_child").alias("child_sessions"),
                          F.count_distinct(F.when(metrics.countable_root(), F.col("project"))).alias("projects"))
             .unionByName(metrics.distinct_prompts(ev_prompts(spark, sf_dir), H)
                          .agg(F.count(F.lit(1)).alias("prompts")), True)
             .unionByName(rhythm.activity_cells(sessions).agg(F.count_distinct("date").alias("active_days")), True))
    return parts.agg(*[F.any_value(c, True).alias(c)
                       for c in ("sessions", "child_sessions", "prompts", "projects", "active_days")])


@query("prompt_words", f"""
SELECT conv_id, turn, CAST({_WORDS} AS BIGINT) AS words, CAST(length(text) AS BIGINT) AS characters,
       {_WORDS} > 0 AS has_text FROM conversations WHERE role = 'user'""")
def prompt_words(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return rows.select("conv_id", "turn", text.words(F.col("text")).alias("words"),
                       text.characters(F.col("text")).alias("characters"),
                       text.has_text(F.col("text")).alias("has_text"))


@query("document_words", f"""
SELECT doc_id, CAST({_WORDS} AS BIGINT) AS words, CAST(length(text) AS BIGINT) AS characters FROM documents""")
def document_words(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", text.words(F.col("text")).alias("words"), text.characters(F.col("text")).alias("characters"))


@query("prompt_style", f"""
WITH p AS (SELECT {_WORDS} AS words, length(text) AS characters FROM conversations WHERE role = 'user' AND {_WORDS} > 0)
SELECT count(*) > 0 AS available, count(*) AS count, quantile_cont(words, 0.5) AS median_words,
       round(avg(words), 1) AS average_words, round(avg(characters), 1) AS average_characters,
       CASE WHEN quantile_cont(words, 0.5) <= 15 THEN 'terse operator'
            WHEN quantile_cont(words, 0.5) > 60 THEN 'specification writer' ELSE 'precision prompter' END AS label
FROM p""")
def prompt_style(spark, sf_dir):
    return metrics.prompt_style(prompt_words(spark, sf_dir))


@query("prompt_style_events", EV + """
SELECT count(*) AS count, quantile_cont(words, 0.5) AS median_words, round(avg(words), 1) AS average_words
FROM first_prompts WHERE has_text""")
def prompt_style_events(spark, sf_dir):
    first = metrics.distinct_prompts(ev_prompts(spark, sf_dir), H)
    return metrics.prompt_style(first).select("count", "median_words", "average_words")


@query("warning_counts", EV + "SELECT harness, code, CAST(n AS BIGINT) AS count FROM warns")
def warning_counts(spark, sf_dir):
    return metrics.warning_counts(ev_warnings(spark, sf_dir), H)


_COVERAGE_SQL = EV + """,
counted AS (
  SELECT harness, count(*) FILTER (history_only AND countable) AS history_only_sessions,
         min(started_at) FILTER (countable AND NOT untimed) AS evidence,
         min(started_at) FILTER (countable AND NOT untimed AND NOT history_only) AS detailed,
         count(*) FILTER (countable) AS sessions, count(*) FILTER (is_child) AS children
  FROM sessions GROUP BY harness),
loss AS (SELECT harness, bool_or(code = 'malformed_record' AND harness IN ('claude', 'codex')) AS has_loss,
                count(*) AS codes FROM warns GROUP BY harness)
"""


def _coverage_inputs(spark, sf_dir):
    sessions = ev_sessions(spark, sf_dir)
    counted = metrics.session_counts(sessions, ("store_id", "harness")).select(
        "store_id", "harness", "sessions", "child_sessions",
        F.col("span_start").alias("earliest_local_evidence"),
        F.col("detailed_start").alias("earliest_detailed_record"))
    only = sessions.groupBy("store_id", "harness").agg(
        F.count_if(F.col("history_only") & metrics.countable_root()).alias("history_only_sessions"),
        F.lit(0).alias("unmaterialized_sessions"))
    flags = coverage.loss_flags(ev_warnings(spark, sf_dir))
    return counted.join(only, ["store_id", "harness"]).join(flags, ["store_id", "harness"], "left")


@query("coverage_status", _COVERAGE_SQL + """
SELECT harness, CASE WHEN status = 'known incomplete' OR status = 'no local evidence' THEN 'high'
                     WHEN status = 'coverage assessment incomplete' THEN 'low' ELSE 'medium' END AS confidence, status
FROM (SELECT c.harness, CASE WHEN history_only_sessions > 0 OR (evidence IS NOT NULL AND detailed IS NULL)
                               OR evidence < detailed THEN 'known incomplete'
                             WHEN coalesce(has_loss, false) THEN 'coverage assessment incomplete'
                             WHEN evidence IS NULL THEN 'no local evidence' ELSE 'completeness unknown' END AS status
      FROM counted c LEFT JOIN loss USING (harness))""")
def coverage_status(spark, sf_dir):
    status = coverage.assessed_status(F.lit(True))
    return _coverage_inputs(spark, sf_dir).select("harness", status.alias("status")).withColumn(
        "confidence", coverage.confidence(F.col("status")))


@query("provider_status", _COVERAGE_SQL + """
SELECT harness, CASE WHEN sessions = 0 AND coalesce(codes, 0) > 0 THEN 'unavailable'
                     WHEN coalesce(codes, 0) > 0 THEN 'supported with warnings' ELSE 'supported' END AS status
FROM counted LEFT JOIN loss USING (harness)""")
def provider_status(spark, sf_dir):
    codes = ev_warnings(spark, sf_dir).groupBy("harness").agg(F.count(F.lit(1)).alias("codes"))
    counted = metrics.session_counts(ev_sessions(spark, sf_dir), H).join(codes, "harness", "left")
    return counted.select("harness", coverage.provider_status(
        F.lit(1), F.col("sessions"), F.coalesce("codes", F.lit(0))).alias("status"))


@query("incomplete_providers", _COVERAGE_SQL + """
SELECT count(*) FILTER (history_only_sessions > 0 OR (evidence IS NOT NULL AND detailed IS NULL)
                        OR evidence < detailed OR coalesce(has_loss, false)) AS incomplete
FROM counted LEFT JOIN loss USING (harness)""")
def incomplete_providers(spark, sf_dir):
    return views.incomplete_providers(
        coverage_status(spark, sf_dir).withColumnRenamed("status", "coverage_status"))


@query("leading_provider", EV + """
SELECT harness, count(*) AS sessions FROM sessions WHERE countable GROUP BY harness
ORDER BY sessions DESC, harness LIMIT 1""")
def leading_provider(spark, sf_dir):
    return views.leader(sessions_by_harness(spark, sf_dir))


@query("metric_order", EV + """
SELECT harness, prompts, row_number() OVER (ORDER BY prompts DESC NULLS LAST, harness) AS position FROM (
  SELECT harness, CASE WHEN harness = 'cursor' THEN NULL ELSE count(*) END AS prompts
  FROM first_prompts GROUP BY harness)""")
def metric_order(spark, sf_dir):
    prompts = distinct_prompts(spark, sf_dir).select(
        "harness", F.when(F.col("harness") != "cursor", F.col("prompts")).alias("prompts"))
    return views.order_by_metric(prompts, "prompts", "harness")


@query("sparse_record", EV + """
SELECT (SELECT count(*) FROM sessions WHERE countable) < 8 OR (SELECT count(*) FROM days) < 3 AS sparse""")
def sparse_record(spark, sf_dir):
    return report_totals(spark, sf_dir).select(
        views.is_sparse(F.col("sessions"), F.col("active_days")).alias("sparse"))


@query("owner_prompt_filter_counts", """
WITH r AS (SELECT turn % 5 = 1 AS meta, role = 'system' AS summary, conv_id % 6 = 2 AND turn % 3 = 0 AS tool_result,
                  role <> 'assistant' AS eligible FROM conversations)
SELECT CAST(sum(CAST(meta AS INT)) AS BIGINT) AS meta, CAST(sum(CAST(summary AS INT)) AS BIGINT) AS summary,
       CAST(sum(CAST(tool_result AS INT)) AS BIGINT) AS tool_result,
       CAST(sum(CAST(meta OR summary OR tool_result AS INT)) AS BIGINT) AS excluded,
       CAST(sum(CAST(NOT (meta OR summary OR tool_result) AS INT)) AS BIGINT) AS kept
FROM r WHERE eligible""")
def owner_prompt_filter_counts(spark, sf_dir):
    from tallyloom.sources.claude import exclusion_counts

    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role").where(F.col("role") != "assistant")
    flags = {"meta": F.col("turn") % 5 == 1, "summary": F.col("role") == "system",
             "tool_result": (F.col("conv_id") % 6 == 2) & (F.col("turn") % 3 == 0)}
    return exclusion_counts(rows, flags)
