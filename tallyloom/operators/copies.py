"""Several physical copies of one logical session become one session."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyloom.operators import ordered
from tallyloom.operators.dedupe import advances, keep_first
from tallyloom.schemas import no_usage

KEY = ("store_id", "harness", "session_key")


def coalesce_sessions(files: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """One row per session out of one row per file, in ``path`` order.

    A file with a trustworthy time beats one without; among equals the span is
    the widest. The project is the first named one from the first trusted file on.
    """
    valid = ~F.col("unanchored") & ~F.col("time_unavailable")
    anchors = files.groupBy(*key).agg(
        F.bool_or(valid).alias("_any_valid"), F.min(F.when(valid, F.col("path"))).alias("_first_valid"),
        F.min("path").alias("_first"))
    rows = ordered._join_on(files, anchors, list(key))
    counts = (F.col("_any_valid") & valid) | ~F.col("_any_valid")
    base = F.coalesce("_first_valid", "_first")
    from_base = (F.col("path") >= base) & F.col("project").isNotNull()
    at = F.col("path")
    merged = rows.groupBy(*key).agg(
        F.first("session_id").alias("session_id"),
        F.min_by("parent_id", at).alias("parent_id"),
        F.bool_or("is_child").alias("is_child"),
        F.min(F.when(counts, F.col("started_at"))).alias("started_at"),
        F.max(F.when(counts, F.col("ended_at"))).alias("ended_at"),
        F.max(F.when(at == base, F.col("activity_basis"))).alias("activity_basis"),
        F.min_by("project", F.when(from_base, at)).alias("project"),
        F.bool_and("unanchored").alias("unanchored"),
        (~F.bool_or("_any_valid") & F.bool_or("time_unavailable")).alias("time_unavailable"),
        F.bool_or("history_only").alias("history_only"),
        F.count(F.lit(1)).alias("copies"))
    return merged.withColumn("activity_at", F.col("started_at"))


def merge_calls(calls: DataFrame, key: Sequence[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """Calls of all copies, one per response id, and the conflict counts per key.

    The first named model wins. Usage starts at the first available record that
    does not contradict that model and only ever advances. A repeat of an already
    seen value can never change the outcome, so records collapse to distinct
    values before they meet.
    """
    named = calls.where(F.col("call_id").isNotNull())
    blank = calls.where(F.col("call_id").isNull())
    ident = [*key, "call_id"]
    heads = named.groupBy(*ident).agg(
        F.min_by("model", F.when(F.col("model").isNotNull(), F.col("line_key"))).alias("_model"),
        F.min("line_key").alias("line_key"), F.count(F.lit(1)).alias("copies"),
        F.count_distinct(F.when(F.col("usage.available"), F.col("usage"))).alias("_values"),
        F.max_by("usage", F.when(F.col("usage.available"), F.lit(1))).alias("_only"))
    # One usage value needs no fold; that is nearly every response.
    single = heads.where(F.col("_values") <= 1)
    several = heads.where(F.col("_values") > 1).select(*ident, "_model")
    rows = named.join(several, ident, "inner")
    fits = F.col("usage.available") & (F.col("model").isNull() | (F.col("model") == F.col("_model")))
    eligible = rows.where(fits)
    values = eligible.groupBy(*ident, "usage").agg(F.min("line_key").alias("at"))
    chain = F.aggregate(
        F.array_sort(F.collect_list(F.struct("at", "usage"))),
        F.expr("cast(array() as array<struct<at:struct<path:string,block:bigint,n:bigint>,usage:"
               "struct<available:boolean,exact:boolean,input:bigint,output:bigint,cache_read:bigint,"
               "cache_write:bigint,reasoning:bigint,source:string>>>)"),
        lambda acc, x: F.when((F.size(acc) == 0)
                              | advances(F.try_element_at(acc, F.lit(-1))["usage"], x["usage"]),
                              F.concat(acc, F.array(x))).otherwise(acc))
    chains = values.groupBy(*ident).agg(chain.alias("_chain"))
    multi = (heads.where(F.col("_values") > 1)
             .join(chains, ident, "left")
             .withColumn("usage", F.coalesce(F.try_element_at("_chain", F.lit(-1))["usage"], no_usage())))
    head_columns = [*ident, "line_key", F.col("_model").alias("model"), "usage", "copies"]
    merged = (single.withColumn("usage", F.coalesce(F.when(F.col("_only.available"), F.col("_only")), no_usage()))
              .select(*head_columns).unionByName(multi.select(*head_columns))
              .unionByName(blank.select(*ident, "line_key", "model", "usage",
                                        F.lit(1).cast("long").alias("copies"))))

    current = F.try_element_at(F.filter("_chain", lambda c: c["at"] < F.col("line_key")), F.lit(-1))["usage"]
    usage_conflicts = eligible.join(chains, ident, "inner").where(
        current.isNotNull() & (current != F.col("usage")) & ~advances(current, F.col("usage"))
        & ~advances(F.col("usage"), current))
    model_rows = named.where(F.col("model").isNotNull()).groupBy(*ident, "model").agg(
        F.count(F.lit(1)).alias("n"), F.min("line_key").alias("at"))
    model_conflicts = model_rows.groupBy(*ident).agg(
        (F.sum("n") - F.min_by("n", "at")).alias("n")).where(F.col("n") > 0)
    conflicts = (usage_conflicts.groupBy(*key).agg(F.count(F.lit(1)).alias("usage_conflicts"))
                 .unionByName(model_conflicts.groupBy(*key).agg(F.sum("n").alias("model_conflicts")),
                              allowMissingColumns=True)
                 .groupBy(*key).agg(F.coalesce(F.sum("usage_conflicts"), F.lit(0)).alias("usage_conflicts"),
                                    F.coalesce(F.sum("model_conflicts"), F.lit(0)).alias("model_conflicts")))
    return merged, conflicts
