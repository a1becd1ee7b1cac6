"""Directory trees with a digest for every node, built from the leaves up and compared from the roots down.

A leaf is a file, a link or an empty directory; a directory's digest combines the names, kinds and digests of what it
holds, whatever their order, so a directory of any size is summed by many tasks. Two trees differ below a node exactly
if its digests do: a comparison reads the children of changed directories only, level by level.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tallyloom.operators.audit import _set_digest

Stage = Callable[[DataFrame, str], DataFrame]
NODE = ["path", "parent", "depth", "kind", "digest"]
KINDS = ("file", "link", "dir")


def leaves(entries: DataFrame) -> DataFrame:
    """``NODE`` rows of ``entries``: path (absolute, '/' between names), kind (``KINDS``; ``dir`` for an empty one) and
    content (digest of a file, target of a link, nothing for a directory). Of a path named twice the least row counts."""
    path = F.regexp_replace(F.regexp_replace("path", "/+", "/"), "(?<=.)/$", "")
    rows = entries.select(path.alias("path"), "kind", F.coalesce("content", F.lit("")).alias("content"))
    rows = rows.groupBy("path").agg(F.min(F.struct("kind", "content")).alias("e")).select("path", "e.*")
    return rows.select(
        "path", F.regexp_replace("path", "/[^/]*$", "").alias("parent"), _depth().alias("depth"), "kind",
        F.sha2(F.concat_ws("\x00", "kind", "content"), 256).alias("digest"))


def _depth():
    return (F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).cast("int")


def build(entries: DataFrame, stage: Stage = lambda df, name: df) -> DataFrame:
    """All nodes of the tree of ``entries`` (see :func:`leaves`); the root is the empty path at depth 0.

    An empty directory that holds something after all is its contents' parent, not a leaf.
    """
    level = stage(leaves(entries), "leaves")
    deepest = level.agg(F.max("depth")).first()[0] or 0
    nodes = level.where(F.col("depth") == deepest)
    found = [nodes]
    for depth in range(deepest - 1, -1, -1):  # one shuffle a level, and there are as many as names in the longest path
        item = F.concat_ws("\x00", F.element_at(F.split("path", "/"), -1), "kind", "digest")
        above = nodes.groupBy(F.col("parent").alias("path")).agg(_set_digest(item).alias("digest")).select(
            "path", F.regexp_replace("path", "/[^/]*$", "").alias("parent"), F.lit(depth).alias("depth"),
            F.lit("dir").alias("kind"), "digest")
        own = level.where(F.col("depth") == depth).join(above.select("path"), "path", "left_anti")
        nodes = stage(above.unionByName(own), f"level-{depth}")
        found.append(nodes)
    out = found[0]
    for nodes in found[1:]:
        out = out.unionByName(nodes)
    return out


def changes(before: DataFrame, after: DataFrame, stage: Stage = lambda df, name: df) -> DataFrame:
    """path, kind, state (added, removed, modified) of the nodes that differ, directories among them.

    Below a directory that is on one side only, all nodes are named.
    """
    deepest = max(df.agg(F.max("depth")).first()[0] or 0 for df in (before, after))
    parts, open_ = [], None
    for depth in range(deepest + 1):
        sides = []
        for name, df in (("b", before), ("a", after)):
            rows = df.where(F.col("depth") == depth)
            if open_ is not None:
                rows = rows.join(open_.withColumnRenamed("path", "parent"), "parent", "left_semi")
            sides.append(rows.select("path", F.struct("kind", "digest").alias(name)))
        state = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("modified")
        differ = sides[0].join(sides[1], "path", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
        differ = stage(differ.select("path", F.coalesce("a.kind", "b.kind").alias("kind"), state.alias("state")), f"changes-{depth}")
        parts.append(differ)
        open_ = differ.select("path")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def verified(before: DataFrame, after: DataFrame, roots: list[str]) -> DataFrame:
    """root, exists (in both), verified (the same in both) of each of the configured roots; two rows are read for each."""
    names = before.sparkSession.createDataFrame([(r.rstrip("/"),) for r in roots], "root string")
    for name, df in (("b", before), ("a", after)):
        names = names.join(df.select(F.col("path").alias("root"), F.concat("kind", "digest").alias(name)), "root", "left")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return names.select("root", both.alias("exists"), (both & F.coalesce(F.col("a") == F.col("b"), F.lit(False))).alias("verified"))
