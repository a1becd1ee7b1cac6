"""What is known to be missing: coverage rules and provider status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Warning codes that mean data may be lost, per harness.
LOSS_CODES = {
    "claude": (
        "unreadable_file", "malformed_record", "oversize_record", "invalid_record_timestamp",
        "physical_session_time_unavailable", "unparseable_owner_prompt",
        "unparseable_assistant_content", "owner_prompt_missing_id", "assistant_response_missing_id",
        "unanchored_session", "unreadable_history", "malformed_history_record",
        "oversize_history_record", "malformed_stats_cache", "oversize_stats_cache",
        "malformed_global_state", "oversize_global_state", "malformed_code_session_index",
        "oversize_code_session_index", "malformed_project_session_index",
        "oversize_project_session_index"),
    "codex": (
        "unreadable_file", "malformed_record", "oversize_record", "invalid_timestamp",
        "missing_or_invalid_session_meta", "unknown_history_mode", "history_chain_inspection_failed",
        "ambiguous_history_chain_suppressed", "unvalidated_same_id_rollout_suppressed",
        "missing_history_base", "rollout_copy_comparison_failed", "unreadable_history",
        "malformed_history_record", "oversize_history_record", "unreadable_session_index",
        "malformed_session_index_record", "oversize_session_index_record",
        "malformed_external_imports", "oversize_external_imports", "state_index_unavailable",
        "uninspectable_state_rollout_paths", "catalog_index_unavailable",
        "unparsed_thread_history_database", "existing_state_rollouts_not_discovered",
        "state_rollouts_outside_configured_roots"),
}

# Fixed values: (status, confidence) in the order the rules apply.
KNOWN_INCOMPLETE = ("known incomplete", "high")
ASSESSMENT_INCOMPLETE = ("coverage assessment incomplete", "low")
NO_EVIDENCE = ("no local evidence", "high")
UNKNOWN = ("completeness unknown", "medium")
UNAVAILABLE = ("assessment unavailable", "low")
CONFIDENCE = dict((KNOWN_INCOMPLETE, ASSESSMENT_INCOMPLETE, NO_EVIDENCE, UNKNOWN, UNAVAILABLE))

NOTES = {
    "known incomplete": "Evidence shows that detailed records are missing; counts describe what can be recovered.",
    "coverage assessment incomplete": "Some sources could not be read in full, so completeness cannot be judged.",
    "no local evidence": "No supported records were found.",
    "completeness unknown": "Surviving records were read; whether they are all there cannot be known.",
    "assessment unavailable": "The source could not be assessed; neither absence nor completeness follows.",
}


def loss_flags(warnings: DataFrame, scope=("store_id", "harness")) -> DataFrame:
    """Whether any loss warning, and the missing-base warning, was counted."""
    loss = None
    for harness, codes in LOSS_CODES.items():
        test = (F.col("harness") == harness) & F.col("code").isin(*codes)
        loss = test if loss is None else loss | test
    return warnings.where(F.col("n") > 0).groupBy(*scope).agg(
        F.bool_or(loss).alias("has_loss"),
        F.bool_or(F.col("code") == "missing_history_base").alias("missing_base"))


def assessed_status(evidence_without_detail: Column) -> Column:
    """Ordered rules for the harnesses with supplemental evidence.

    ``evidence_without_detail``: whether evidence alone proves a gap (one of the
    two harnesses also treats evidence with no detailed record at all as a gap).
    """
    earliest, detailed = F.col("earliest_local_evidence"), F.col("earliest_detailed_record")
    gap = ((F.col("history_only_sessions") > 0) | (F.col("unmaterialized_sessions") > 0)
           | F.coalesce(F.col("missing_base"), F.lit(False))
           | (F.coalesce(evidence_without_detail, F.lit(False)) & earliest.isNotNull() & detailed.isNull())
           | F.coalesce(earliest < detailed, F.lit(False)))
    return (F.when(gap, KNOWN_INCOMPLETE[0])
             .when(F.coalesce(F.col("has_loss"), F.lit(False)), ASSESSMENT_INCOMPLETE[0])
             .when(earliest.isNull(), NO_EVIDENCE[0]).otherwise(UNKNOWN[0]))


def default_status(status: Column, sessions: Column, children: Column) -> Column:
    """Rule for the harnesses without supplemental evidence."""
    return (F.when(status.isin("unavailable", "unsupported schema"), UNAVAILABLE[0])
             .when((sessions == 0) & (children == 0), NO_EVIDENCE[0]).otherwise(UNKNOWN[0]))


def confidence(status: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, level in CONFIDENCE.items():
        out = F.when(status == name, level).otherwise(out)
    return out


def note(status: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, text in NOTES.items():
        out = F.when(status == name, text).otherwise(out)
    return out


def provider_status(files: Column, sessions: Column, warnings: Column,
                    empty_with_warnings: str | None = "unavailable") -> Column:
    """not found / supported / supported with warnings / unavailable.

    ``empty_with_warnings`` names the status of a provider that produced warnings
    and no session; None keeps such a provider supported.
    """
    status = F.when(files == 0, "not found")
    if empty_with_warnings:
        status = status.when((sessions == 0) & (warnings > 0), empty_with_warnings)
    return status.when(warnings > 0, "supported with warnings").otherwise("supported")
