"""Ordered per-key state that survives a hot key.

A window over ``key`` alone sends the whole key to one task. Here the key is cut
into order-preserving chunks (a file block, a day): windows run per chunk, one
small row per chunk carries the state across, and a join brings it back. The
result equals the plain window; the largest task holds one chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def _join_on(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in columns else F.col(c)
                             for c in right.columns])
    on = None
    for c in columns:
        test = left[c].eqNullSafe(renamed[f"_r_{c}"])
        on = test if on is None else on & test
    return left.join(renamed, on, "left").drop(*[f"_r_{c}" for c in columns])


def _before(keys: Sequence[str], chunk: Sequence[str]):
    return (Window.partitionBy(*keys).orderBy(*chunk)
            .rowsBetween(Window.unboundedPreceding, -1))


def rank(df: DataFrame, keys: Sequence[str], chunk: Sequence[str],
         order: Sequence[str | Column], name: str = "rn") -> DataFrame:
    """1-based position of every row inside ``keys``, by ``chunk`` then ``order``."""
    sizes = df.groupBy(*keys, *chunk).agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(*keys, *chunk, F.coalesce(
        F.sum("_size").over(_before(keys, chunk)), F.lit(0)).alias("_offset"))
    local = Window.partitionBy(*keys, *chunk).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(local).cast("long"))
    return (_join_on(ranked, offsets, [*keys, *chunk])
            .withColumn(name, F.col(name) + F.col("_offset")).drop("_offset"))


def running_sum(df: DataFrame, keys: Sequence[str], chunk: Sequence[str],
                order: Sequence[str | Column], value: Column, name: str,
                inclusive: bool = True) -> DataFrame:
    """Running total of ``value``, including or up to the current row."""
    sizes = df.groupBy(*keys, *chunk).agg(F.sum(value).alias("_size"))
    offsets = sizes.select(*keys, *chunk, F.coalesce(
        F.sum("_size").over(_before(keys, chunk)), F.lit(0)).alias("_offset"))
    local = (Window.partitionBy(*keys, *chunk).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    summed = df.withColumn(name, F.coalesce(F.sum(value).over(local), F.lit(0)))
    return (_join_on(summed, offsets, [*keys, *chunk])
            .withColumn(name, F.col(name) + F.col("_offset")).drop("_offset"))


def last_before(df: DataFrame, keys: Sequence[str], chunk: Sequence[str],
                order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """For each row the latest non-NULL ``values`` among the earlier rows."""
    position = F.struct(*order)
    lasts = df.groupBy(*keys, *chunk).agg(*[
        F.max_by(v, F.when(v.isNotNull(), position)).alias(f"_last_{n}") for n, v in values.items()])
    carried = lasts.select(*keys, *chunk, *[
        F.last(f"_last_{n}", ignorenulls=True).over(_before(keys, chunk)).alias(f"_carry_{n}")
        for n in values])
    local = (Window.partitionBy(*keys, *chunk).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumns({n: F.last(v, ignorenulls=True).over(local) for n, v in values.items()})
    joined = _join_on(marked, carried, [*keys, *chunk])
    return (joined.withColumns({n: F.coalesce(F.col(n), F.col(f"_carry_{n}")) for n in values})
            .drop(*[f"_carry_{n}" for n in values]))
