"""Segments of one long record: copies, boundaries, stitching."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tallyloom.operators import ordered

SCOPE = ["store_id", "thread_id"]


def fingerprint(lines: DataFrame) -> DataFrame:
    """Content identity per file: size, line count and combined SHA-256 pieces.

    Every line is hashed together with its offset and the hashes are combined by
    XOR, so one huge file is hashed by all its blocks at once.
    """
    digest = F.sha2(F.concat_ws(":", F.col("start_offset").cast("string"), F.col("line")), 256)
    pieces = [F.bit_xor(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("bigint")) for i in range(4)]
    return lines.groupBy("store_id", "path").agg(
        F.struct(F.max("end_offset"), F.count(F.lit(1)), *pieces).cast("string").alias("digest"))


def boundary_claims(segments: DataFrame) -> DataFrame:
    """Each segment with the path of the segment before it.

    ``segments``: store_id, thread_id, path, first_ordinal, packed, base struct
    (thread_id, end_byte_offset, end_ordinal_exclusive).
    """
    chunked = segments.withColumn("_chunk", F.floor(F.coalesce("first_ordinal", F.lit(-1)) / 65536))
    return ordered.last_before(chunked, SCOPE, ["_chunk"], ["first_ordinal", "path"], {
        "previous": F.struct("path", "packed")}).drop("_chunk")


def check_boundaries(claims: DataFrame, lines: DataFrame) -> DataFrame:
    """Claims with ``ok``: the base ends exactly where the claim says.

    The line that ends at the offset has the ordinal before the boundary, and the
    line that starts there (if any) has the boundary ordinal. ``lines``: path,
    start_offset, end_offset, ordinal, of plain files.
    """
    asked = claims.where(F.col("previous").isNotNull()).select(
        "store_id", F.col("previous.path").alias("path"),
        F.col("base.end_byte_offset").alias("offset")).where(F.col("offset").isNotNull()).distinct()
    # A file is asked for one offset or a few, so its lines meet them by the file and only those at an offset are left.
    wanted = asked.withColumnsRenamed({"path": "_path", "store_id": "_store"})
    is_end, is_start = F.col("end_offset") == F.col("offset"), F.col("start_offset") == F.col("offset")
    meets = (F.col("store_id") == F.col("_store")) & (F.col("path") == F.col("_path")) & (is_end | is_start)
    seen = (lines.select("store_id", "path", "start_offset", "end_offset", "ordinal").join(wanted, meets)
            .groupBy("store_id", "path", "offset")
            .agg(F.max(F.when(is_end, F.col("ordinal"))).alias("ends"), F.max(F.when(is_start, F.col("ordinal"))).alias("starts"),
                 F.bool_or(is_end).alias("is_end"), F.bool_or(is_start).alias("is_start")))
    sided = claims.withColumns({"_path": F.col("previous.path"),
                                "_offset": F.col("base.end_byte_offset")})
    joined = sided.join(seen.withColumnsRenamed({"path": "_path", "offset": "_offset"}),
                        ["store_id", "_path", "_offset"], "left")
    ordinal = F.col("base.end_ordinal_exclusive")
    before = F.when(F.col("_offset") == 0, ordinal == 0).otherwise(
        F.col("is_end") & (F.col("ends") == ordinal - 1))
    after = ~F.coalesce(F.col("is_start"), F.lit(False)) | (F.col("starts") == ordinal)
    is_first = F.col("previous").isNull()
    linked = (F.col("first_ordinal").isNotNull() & F.col("base").isNotNull()
              & (F.col("base.thread_id") == F.col("thread_id")) & (ordinal == F.col("first_ordinal"))
              & ~F.col("previous.packed") & (F.col("_offset") >= 0) & before & after)
    opens = F.col("base").isNull() & F.col("first_ordinal").isNotNull()
    return joined.withColumn("ok", F.coalesce(F.when(is_first, opens).otherwise(linked), F.lit(False))).drop(
        "_path", "_offset", "ends", "starts", "is_end", "is_start")


def stitch(segments: DataFrame, lines: DataFrame,
           stage: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """Segments with ``stitched``, ``group_size`` and, when stitched, the cut.

    ``cut_ordinal`` and ``cut_offset`` end a segment where its successor begins.
    A broken chain cuts nothing. The checked segments are read three times, so a
    ``stage`` that writes them saves two passes over the lines.
    """
    claims = stage(boundary_claims(segments), "chain_claims")
    checked = stage(check_boundaries(claims, lines), "chain_checked")
    groups = checked.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("group_size"),
                                         F.bool_and("ok").alias("_all_ok"))
    cuts = checked.where(F.col("previous").isNotNull()).select(
        "store_id", "thread_id", F.col("previous.path").alias("path"),
        F.col("base.end_ordinal_exclusive").alias("cut_ordinal"),
        F.col("base.end_byte_offset").alias("cut_offset"))
    joined = (checked.select("store_id", "thread_id", "path", "first_ordinal", "base", "packed")
              .join(groups, SCOPE).join(cuts, ["store_id", "thread_id", "path"], "left"))
    stitched = F.col("_all_ok") & (F.col("group_size") > 1)
    return (joined.withColumn("stitched", stitched)
            .withColumn("cut_ordinal", F.when(stitched, F.col("cut_ordinal")))
            .withColumn("cut_offset", F.when(stitched, F.col("cut_offset"))).drop("_all_ok"))
