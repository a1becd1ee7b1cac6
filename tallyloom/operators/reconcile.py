"""Joins that reconcile partial sources: suppression, bags, missing references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyloom.operators import ordered


def split_history(history: DataFrame, detailed: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(history rows without detail, history rows suppressed by surviving detail)."""
    ids = detailed.select(*key).distinct()
    return history.join(ids, list(key), "left_anti"), history.join(ids, list(key), "left_semi")


def bag_minus(left: DataFrame, right: DataFrame, key: Sequence[str],
              chunk: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each right row consumes one left row of its key, earliest first.

    The right side is only counted; the left side is ranked in chunks, so neither
    a hot key nor a hot side ends in one task.
    """
    return bag_split(left, right, key, chunk, order).where(~F.col("_consumed")).drop("_consumed")


def bag_split(left: DataFrame, right: DataFrame, key: Sequence[str],
              chunk: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Left rows with the flag ``_consumed``."""
    taken = right.groupBy(*key).agg(F.count(F.lit(1)).alias("_taken"))
    # Ranked before the join, so that the counts per chunk come from the bare scan.
    ranked = ordered._join_on(ordered.rank(left, key, chunk, order, "_rn"), taken, list(key))
    return (ranked.withColumn("_consumed", F.col("_rn") <= F.coalesce(F.col("_taken"), F.lit(0)))
            .drop("_rn", "_taken"))


def unmaterialized(references: DataFrame, known: DataFrame, scope: Sequence[str],
                   ref_id: str = "ref_id") -> DataFrame:
    """References without a session, each with the first source that names it.

    ``references`` holds (scope, source, source_rank, ref_id).
    """
    per_ref = references.groupBy(*scope, ref_id).agg(
        F.min_by("source", "source_rank").alias("first_source"),
        F.collect_set("source").alias("sources"))
    return per_ref.join(known.select(*scope, F.col("session_id").alias(ref_id)).distinct(),
                        [*scope, ref_id], "left_anti")


def reconciled(references: DataFrame, known: DataFrame, scope: Sequence[str],
               ref_id: str = "ref_id") -> DataFrame:
    """Number of distinct references per source that do have a session."""
    matched = references.join(known.select(*scope, F.col("session_id").alias(ref_id)).distinct(),
                              [*scope, ref_id], "left_semi")
    return matched.groupBy(*scope, "source").agg(F.count_distinct(ref_id).alias("reconciled"))


def missing_rows(expected: DataFrame, found: DataFrame, key: Sequence[str]) -> DataFrame:
    """Expected keys that have no row."""
    return expected.join(found.select(*key).distinct(), list(key), "left_anti")
