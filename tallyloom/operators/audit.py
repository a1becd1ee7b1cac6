"""Dataset manifests: what was there, and did it change."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Files above this size are hashed as a stream instead of as one row's value.
STREAM_HASH_BYTES = 64 << 20
_SIDECARS = ("-wal", "-shm", "-journal")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, mtime) of every file below a root; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
            .select("path", "length", F.col("modificationTime").alias("mtime")))


def _stream_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        digests = []
        for path in batch["path"]:
            system, name = fs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///"))
            state = hashlib.sha256()
            with system.open_input_stream(name) as stream:
                while chunk := stream.read(1 << 20):
                    state.update(chunk)
            digests.append(state.hexdigest())
        yield pd.DataFrame({"path": batch["path"], "sha256": digests, "size": batch["size"]})


def hash_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256, size). Small files inside the JVM, large ones streamed."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root))
    small = files.where(F.col("length") <= STREAM_HASH_BYTES).select(
        "path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))
    large = (files.where(F.col("length") > STREAM_HASH_BYTES).select("path", F.col("length").alias("size"))
             .repartition("path").mapInPandas(_stream_digests, "path string, sha256 string, size long"))
    return small.unionByName(large)


def with_sidecars(files: DataFrame) -> DataFrame:
    """Expected paths plus the optional companions of database files."""
    database = F.lower("path").rlike(r"\.(db|sqlite|vscdb)$")
    extra = files.where(database).select(F.explode(F.array(
        *[F.concat("path", F.lit(s)) for s in _SIDECARS])).alias("path"), F.lit(False).alias("required"))
    return files.unionByName(extra)


def file_manifest(expected: DataFrame, hashed: DataFrame) -> DataFrame:
    """(path, exists, sha256, size, complete): expected files, present or not.

    ``expected``: path, required. Only a missing required file is incomplete.
    """
    wanted = expected.groupBy("path").agg(F.bool_or("required").alias("required"))
    joined = wanted.join(hashed, "path", "left")
    exists = F.col("sha256").isNotNull()
    return joined.select("path", exists.alias("exists"), F.coalesce("sha256", F.lit("")).alias("sha256"),
                         F.coalesce("size", F.lit(0)).cast("long").alias("size"),
                         (exists | ~F.col("required")).alias("complete"))


def directory_inventory(listing: DataFrame) -> DataFrame:
    """(path, entries, digest) per directory, from every file path below a root.

    The digest combines one hash per ``kind:name`` entry, so a directory that
    holds a third of all files is still summed in parallel.
    """
    parts = F.split(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "/")
    depth = F.size(parts)
    levels = listing.select(parts.alias("p"), depth.alias("d")).select(
        "p", "d", F.explode(F.sequence(F.lit(2), F.col("d"))).alias("i"))
    entries = levels.select(
        F.concat(F.lit("/"), F.array_join(F.slice("p", F.lit(2), F.col("i") - 2), "/")).alias("path"),
        F.concat(F.when(F.col("i") == F.col("d"), "f:").otherwise("d:"),
                 F.element_at("p", F.col("i"))).alias("entry")).distinct()
    return entries.groupBy("path").agg(F.count(F.lit(1)).alias("entries"), _set_digest(F.col("entry")).alias("digest"))


def _set_digest(item: Column) -> Column:
    digest = F.sha2(item, 256)
    pieces = [F.bit_xor(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("bigint")) for i in range(4)]
    return F.sha2(F.concat_ws(":", F.count(F.lit(1)), *[p.cast("string") for p in pieces]), 256)


def manifest_digest(lines: DataFrame, column: str = "line") -> DataFrame:
    """One digest over a set of distinct manifest lines, independent of their order."""
    return lines.select(column).distinct().agg(_set_digest(F.col(column)).alias("manifest"))


def manifest_lines(manifest: DataFrame, directories: DataFrame | None = None) -> DataFrame:
    rows = manifest.select(F.concat_ws("\x00", F.lit("file"), "path", F.col("exists").cast("string"),
                                       "sha256", F.col("size").cast("string")).alias("line"))
    if directories is not None:
        rows = rows.unionByName(directories.select(
            F.concat_ws("\x00", F.lit("dir"), "path", "digest").alias("line")))
    return rows


def diff(before: DataFrame, after: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """Rows of either side with ``changed``: added, removed or different."""
    left = before.select(F.col(key), F.struct(*compare).alias("_before"))
    right = after.select(F.col(key), F.struct(*compare).alias("_after"))
    return left.join(right, key, "full_outer").select(
        key, (~F.col("_before").eqNullSafe(F.col("_after"))).alias("changed"),
        F.when(F.col("_before").isNull(), "added").when(F.col("_after").isNull(), "removed")
         .when(~F.col("_before").eqNullSafe(F.col("_after")), "modified").otherwise("same").alias("state"))


def compare(before: DataFrame, after: DataFrame, dirs_before: DataFrame, dirs_after: DataFrame) -> DataFrame:
    """One row: files, changed files, directory changes, both digests, verified."""
    labelled = (
        diff(before, after, "path", ["exists", "sha256", "size"]).agg(
            F.count_if("changed").alias("changed_files"))
        .unionByName(diff(dirs_before, dirs_after, "path", ["digest"]).agg(
            F.count_if("changed").alias("directory_changes")), True)
        .unionByName(before.agg(F.count_if("exists").alias("files"),
                                F.bool_and("complete").alias("complete_before")), True)
        .unionByName(after.agg(F.bool_and("complete").alias("complete_after")), True)
        .unionByName(manifest_digest(manifest_lines(before, dirs_before))
                     .withColumnRenamed("manifest", "manifest_before"), True)
        .unionByName(manifest_digest(manifest_lines(after, dirs_after))
                     .withColumnRenamed("manifest", "manifest_after"), True))
    row = labelled.agg(*[F.any_value(c, True).alias(c) for c in labelled.columns])
    return row.withColumn("verified", is_verified())


def is_verified() -> Column:
    return F.coalesce(F.col("complete_before") & F.col("complete_after") & (F.col("files") > 0)
                      & (F.col("changed_files") == 0) & (F.col("directory_changes") == 0)
                      & (F.col("manifest_before") == F.col("manifest_after")), F.lit(False))


def observation(enabled: bool, failed: bool, complete: bool) -> str:
    """observed, disabled or unavailable."""
    if not enabled:
        return "disabled"
    return "observed" if complete and not failed else "unavailable"


def same_listing(left: DataFrame, right: DataFrame) -> bool:
    """Whether two listings hold the same paths (one small action)."""
    a, b = left.select("path"), right.select("path")
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def stable_listing(spark: SparkSession, root: str, attempts: int = 3) -> tuple[DataFrame, bool]:
    """List until two listings in a row agree, at most ``attempts`` times."""
    listing = list_files(spark, root)
    for _ in range(attempts):
        again = list_files(spark, root)
        if same_listing(listing, again):
            return again, True
        listing = again
    return listing, False
