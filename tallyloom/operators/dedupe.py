"""Identity: first record per id, precedence, digests, updates of one response."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.operators import ordered


def keep_first(df: DataFrame, scope: Sequence[str], id_column: str,
               order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """First record per id inside ``scope``; rows without an id are never merged.

    An aggregate, not a window: copies collapse before the shuffle, so an id that
    holds a third of all rows costs one row per map task.
    """
    blank = F.col(id_column).isNull()
    solo = F.when(blank, F.struct(*order))
    first = F.min_by(F.struct(*payload), F.struct(*order)).alias("_first")
    return (df.groupBy(*scope, id_column, solo.alias("_solo"))
            .agg(first, F.count(F.lit(1)).alias("copies"))
            .select(*scope, id_column, "_first.*", "copies"))


def precedence_union(sources: Sequence[DataFrame], key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of earlier sources win; later ones only fill missing keys."""
    ranked = [s.withColumn("_rank", F.lit(i)) for i, s in enumerate(sources)]
    merged = ranked[0]
    for other in ranked[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    payload = [c for c in merged.columns if c not in key and c != "_rank"]
    picked = merged.groupBy(*key).agg(
        F.min_by(F.struct(*payload), F.struct("_rank", *order)).alias("_row"))
    return picked.select(*key, "_row.*")


def prefer_variant(files: DataFrame, group: Column, preference: Column) -> DataFrame:
    """One file per ``group``: the smallest ``preference`` (plain before packed)."""
    columns = files.columns
    return (files.groupBy(group.alias("_group"))
            .agg(F.min_by(F.struct(*columns), F.struct(preference, F.col("path"))).alias("_row"))
            .select("_row.*"))


def byte_identical(files: DataFrame, id_columns: Sequence[str], digest: str, path: str) -> DataFrame:
    """Lowest path per (id, digest), with the number of suppressed copies."""
    return (files.groupBy(*id_columns, digest)
            .agg(F.min(path).alias(path), (F.count(F.lit(1)) - 1).alias("suppressed")))


def merge_updates(df: DataFrame, key: Sequence[str], position: Column, usage: Column,
                  usage_available: Column, model: Column) -> DataFrame:
    """Repeated updates of one response: last available usage, last named model."""
    return df.groupBy(*key).agg(
        F.max_by(usage, F.when(usage_available, position)).alias("usage"),
        F.max_by(model, F.when(model.isNotNull(), position)).alias("model"),
        F.min(position).alias("first_position"),
        F.count(F.lit(1)).alias("records"))


def advances(previous: Column, current: Column) -> Column:
    """Only output and reasoning grew; every other field stayed."""
    same = [previous[f] == current[f] for f in ("exact", "source", "input", "cache_read", "cache_write")]
    test = previous["available"] & current["available"]
    for s in same:
        test = test & s
    return test & (current["output"] >= previous["output"]) & (current["reasoning"] >= previous["reasoning"])


def same_usage(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def classify_updates(df: DataFrame, key: Sequence[str], chunk: Sequence[str], order: Sequence[str],
                     usage: str = "usage", model: str = "model") -> DataFrame:
    """Every row against the state stored so far for its response.

    Adds ``update_class`` (first, same, completed, advanced, conflict) and
    ``model_changed``. The stored usage is the last available one before the row.
    """
    current = F.col(usage)
    with_state = ordered.last_before(df, key, chunk, order, {
        "_stored": F.when(current["available"], current),
        "_model": F.col(model), "_seen": F.lit(True)})
    stored, named = F.col("_stored"), F.col("_model")
    repeat = F.coalesce(F.col("_seen"), F.lit(False))
    label = (F.when(~repeat, "first")
              .when(stored.isNull() & ~current["available"], "same")
              .when(stored.isNull(), "completed")
              .when(same_usage(stored, current), "same")
              .when(advances(stored, current), "advanced")
              .otherwise("conflict"))
    changed = F.coalesce(repeat & named.isNotNull() & F.col(model).isNotNull()
                         & (named != F.col(model)), F.lit(False))
    return (with_state.withColumn("update_class", label).withColumn("model_changed", changed)
            .drop("_stored", "_model", "_seen"))


def final_cumulative(df: DataFrame, key: Sequence[str], info: Column, total: Column,
                     position: Column) -> DataFrame:
    """Largest cumulative record per key; the later one wins a tie."""
    return df.groupBy(*key).agg(F.max_by(info, F.struct(total, position)).alias("final"))


def annotate_copies(df: DataFrame, scope: Sequence[str], id_column: str, order: Sequence[str],
                    compare: Sequence[str]) -> DataFrame:
    """Repeats of an id and how many disagree with its first record.

    Equal variants are counted before the shuffle, so only distinct variants of
    an id ever meet.
    """
    variants = (df.where(F.col(id_column).isNotNull())
                .groupBy(*scope, id_column, *compare)
                .agg(F.min(F.struct(*order)).alias("_at"), F.count(F.lit(1)).alias("_n")))
    firsts = (variants.groupBy(*scope, id_column)
              .agg(F.sum("_n").alias("_total"),
                   *[F.min_by(F.col(c), F.col("_at")).alias(f"_first_{c}") for c in compare]))
    rows = ordered._join_on(variants, firsts, [*scope, id_column])
    changed = [F.sum(F.when(~F.col(c).eqNullSafe(F.col(f"_first_{c}")), F.col("_n")).otherwise(0))
               .alias(f"{c}_conflicts") for c in compare]
    repeats = F.sum("_n") - F.count_distinct(F.struct(*scope, id_column))
    return rows.groupBy(*scope).agg(repeats.alias("repeats"), *changed)
