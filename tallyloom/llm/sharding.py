"""Sharding: contiguous shards of nearly equal bytes from global prefix sums.

The rows are put in one global order (doc_id, checksum, size) by a range partitioning of narrow rows; texts never
move. Each partition gives one total, the running sum of those totals places every partition on the line of all bytes,
and a running sum inside each partition places every row. A row belongs to the shard in whose equal share of the line
its middle lies, so shards are contiguous, differ from the target by less than the largest row, and a group of equal
texts, however large, is cut wherever the target says.

Edge cases: a null text counts as empty (size 16, checksum 0); null ids come first; equal rows are interchangeable;
an empty table gives no rows; fewer rows than shards leave shards empty; long texts only count by their size; columns
of other names are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import cut

OVERHEAD = 16


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus ``OVERHEAD``), text_crc32 (unsigned)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))


def shard(rows: DataFrame, shards: int, order: tuple[str, ...], size: str = "size") -> DataFrame:
    """``rows`` with shard (0 to ``shards`` - 1) and slot (0, 1, ... in it). ``order``: columns that order all rows.

    ``rows`` should be narrow: they are shuffled twice, and kept in between so that both passes see one partitioning.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The scan's row number parts equal rows, of which a table may hold any number.
    order = (*order, "_row")
    placed = cut(rows.withColumn("_row", F.monotonically_increasing_id())
                 .repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in order])
                 .withColumn("_part", F.spark_partition_id()))
    # One row per partition.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(F.sum(size).alias("_bytes"), F.count("*").alias("_rows"))
    starts = totals.select(
        "_part", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_from"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row_from"),
        F.sum("_bytes").over(Window.partitionBy()).alias("_all"))
    inside = Window.partitionBy("_part").orderBy(*[F.col(c).asc_nulls_first() for c in order]) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = placed.withColumn("_to", F.sum(size).over(inside)).withColumn("_nth", F.count("*").over(inside)) \
        .join(F.broadcast(starts), "_part")  # bounded: one row per shuffle partition
    # Twice the middle, so that it stays whole; decimals, as the product may pass 64 bits.
    middle = (2 * (F.col("_from") + F.col("_to")) - F.col(size)).cast("decimal(28,0)")
    line = line.withColumn("shard", F.least(
        F.floor(middle * shards / (2 * F.col("_all"))), F.lit(shards - 1)).cast("int")) \
        .withColumn("_at", F.col("_row_from") + F.col("_nth") - 1)
    first = line.groupBy("shard").agg(F.min("_at").alias("_first"))  # one row per shard
    return line.join(F.broadcast(first), "shard").select(
        *rows.columns, "shard", (F.col("_at") - F.col("_first")).alias("slot"))


def report(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null under this law)."""
    return shard(sized(docs), shards, ("doc_id", "text_crc32", "size")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
