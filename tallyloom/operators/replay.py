"""Surviving messages of an edit log.

Operations, content-free: ``put`` (insert or replace, keeps its place), ``patch``
(new sizes for a live message), ``remove``, ``order`` (listed ids move to the
tail) and ``rewind`` (drop a message and all after it, everything if unknown).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: A put's content-free payload.
MESSAGE = ("struct<type:string,at:timestamp,words:bigint,characters:bigint,has_text:boolean,model:string,"
           "tools:bigint,usage:struct<available:boolean,exact:boolean,input:bigint,output:bigint,"
           "cache_read:bigint,cache_write:bigint,reasoning:bigint,source:string>>")
SIZES = ("words", "characters", "has_text")
KEY = ["store_id", "path"]
#: Rows of a batch.
BATCH = 4_096


def survivors(operations: DataFrame,
              stage: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """(store_id, path, id, message) of the messages left at the end.

    ``operations``: store_id, path, seq (comparable), op, id, ids, message. Three
    cases, by what a log contains:

    * no rewind, removal or reorder: the last put and the last later patch of each
      id decide, which is one aggregate;
    * rewinds or removals: the same aggregate over the ids that :func:`_uncovered`
      finds alive; messages of one log are spread over its blocks;
    * reorders: positions no longer follow time, so ids and sizes are replayed.

    What is replayed streams through a task in order: it holds the live ids of a log, and each operation costs time in
    proportion to the ids it names or drops.
    """
    operations = stage(operations, "replay_operations")
    kinds = stage(operations.groupBy(*KEY).agg(
        F.bool_or(F.col("op").isin("rewind", "remove")).alias("_cut"), F.bool_or(F.col("op") == "order").alias("_moved")),
        "replay_kinds")

    def logs(test: Column) -> DataFrame:
        return operations.join(kinds.where(test).select(*KEY), KEY, "left_semi")

    moved, cut = F.col("_moved"), F.col("_cut")
    edited = stage(logs(cut & ~moved), "replay_edited")
    return (_by_aggregate(logs(~cut & ~moved))
            .unionByName(_by_aggregate(edited).join(_uncovered(edited), [*KEY, "id"], "left_semi"))
            .unionByName(_by_replay(logs(moved))))


def _uncovered(operations: DataFrame) -> DataFrame:
    """(store_id, path, id) alive at the end of logs without reorders.

    A rewind at ``t`` to a message born at ``b`` kills every birth in [b, t). A
    message is alive at the end exactly if one of its puts lies in no such
    interval and after its last removal: were it covered by a later cut, so would
    that put be. Whether a put is covered is a running minimum, from the end, of
    the births that later rewinds go back to.
    """
    puts = operations.where(F.col("op") == "put").select(*KEY, "id", "seq")
    rewinds = operations.where(F.col("op") == "rewind")
    targets = rewinds.select(*KEY, "id").distinct()
    # Births of the targets alone decide where a rewind goes back to.
    skeleton = operations.where(F.col("op").isin("put", "remove")).join(targets, [*KEY, "id"], "left_semi").unionByName(rewinds)
    cuts = _streamed(skeleton.select(*KEY, "op", "id", "seq.*"), _births,
                     "store_id string, path string, block long, n long, sub long, to_block long, to_n long, to_sub long")
    none = F.lit(None).cast("struct<block:bigint,n:bigint,sub:bigint>")
    stream = puts.withColumn("floor", none).unionByName(cuts.select(
        *KEY, F.lit(None).cast("string").alias("id"), F.struct("block", "n", "sub").alias("seq"),
        F.struct(F.col("to_block").alias("block"), F.col("to_n").alias("n"), F.col("to_sub").alias("sub")).alias("floor")))
    stream = stream.withColumn("_block", F.col("seq.block"))
    per_block = stream.groupBy(*KEY, "_block").agg(F.min("floor").alias("_floor"))
    later = Window.partitionBy(*KEY).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select(*KEY, "_block", F.min("_floor").over(later).alias("_later"))
    inside = Window.partitionBy(*KEY, "_block").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    reached = stream.withColumn("_here", F.min("floor").over(inside)).join(carried, [*KEY, "_block"])
    covered = F.coalesce(F.least("_here", "_later") <= F.col("seq"), F.lit(False))
    removed = operations.where(F.col("op") == "remove").groupBy(*KEY, "id").agg(F.max("seq").alias("_removed"))
    return (reached.where(F.col("id").isNotNull() & ~covered).join(removed, [*KEY, "id"], "left")
            .where(F.col("_removed").isNull() | (F.col("seq") > F.col("_removed")))
            .select(*KEY, "id").distinct())


def _streamed(rows: DataFrame, of_log: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """``of_log`` of every log's rows in their order; rows hold ``KEY`` and the parts of seq."""
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    shape = pa.schema([(part.split()[0], kinds[part.split()[1]]) for part in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for row in _logs((row for batch in batches for row in batch.to_pylist()), of_log):
            held.append(row)
            if len(held) == BATCH:
                yield pa.RecordBatch.from_pylist(held, schema=shape)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=shape)

    dealt = rows.repartition(*KEY).sortWithinPartitions(*KEY, "block", "n", "sub")
    return dealt.mapInArrow(run, schema).select(*names)


def _logs(rows: Iterator[dict], of_log: Callable[[Iterator[dict]], Iterator[dict]]) -> Iterator[dict]:
    for key, log in groupby(rows, key=lambda r: tuple(r[k] for k in KEY)):
        for out in of_log(log):
            yield {**dict(zip(KEY, key, strict=True)), **out}


def _births(log: Iterator[dict]) -> Iterator[dict]:
    """Per rewind: the birth of its target, or before everything when unknown."""
    born: dict[str, tuple] = {}  # in the order of birth, so a rewind drops the last ones
    for r in log:
        at = (r["block"], r["n"], r["sub"])
        if r["op"] == "put":
            born.setdefault(r["id"], at)
        elif r["op"] == "remove":
            born.pop(r["id"], None)
        else:
            floor = born.get(r["id"], (-1, 0, 0))
            while born and next(reversed(born.values())) >= floor:
                born.popitem()
            yield dict(zip(("block", "n", "sub", "to_block", "to_n", "to_sub"), (*at, *floor), strict=True))


def _by_aggregate(operations: DataFrame) -> DataFrame:
    put, patch = F.col("op") == "put", F.col("op") == "patch"
    rows = operations.where((put | patch) & F.col("id").isNotNull()).groupBy(*KEY, "id").agg(
        F.max(F.when(put, F.col("seq"))).alias("_put"), F.max_by("message", F.when(put, F.col("seq"))).alias("_m"),
        F.max(F.when(patch, F.col("seq"))).alias("_patch"), F.max_by("message", F.when(patch, F.col("seq"))).alias("_p"))
    sized = F.col("_m")
    for name in SIZES:
        sized = sized.withField(name, F.col(f"_p.{name}"))
    message = F.when(F.col("_patch") > F.col("_put"), sized).otherwise(F.col("_m"))
    return rows.where(F.col("_put").isNotNull()).select(*KEY, "id", message.alias("message"))


def _by_replay(operations: DataFrame) -> DataFrame:
    flat = operations.select(*KEY, "seq.block", "seq.n", "seq.sub", "op", "id", "ids",
                             "message.words", "message.characters", "message.has_text")
    kept = _streamed(flat, _replay, "store_id string, path string, id string, block long, n long, sub long, "
                     "words long, characters long, has_text boolean")
    puts = operations.where(F.col("op") == "put").select(
        *KEY, "id", "message", "seq.block", "seq.n", "seq.sub")
    joined = kept.withColumnsRenamed({c: f"_{c}" for c in SIZES}).join(puts, [*KEY, "id", "block", "n", "sub"])
    message = F.col("message")
    for name in SIZES:
        message = message.withField(name, F.col(f"_{name}"))
    return joined.select(*KEY, "id", message.alias("message"))


def _replay(log: Iterator[dict]) -> Iterator[dict]:
    """Keys only: which put of each id survives, and its current sizes."""
    live: dict[str, dict] = {}  # insertion order is message order
    for r in log:
        op, ident = r["op"], r["id"]
        if op == "put":
            live[ident] = {k: r[k] for k in ("id", "block", "n", "sub", *SIZES)}
        elif op == "patch" and ident in live:
            live[ident].update({k: r[k] for k in SIZES})
        elif op == "remove":
            live.pop(ident, None)
        elif op == "order":
            for listed in dict.fromkeys(r["ids"]):
                if listed in live:
                    live[listed] = live.pop(listed)
        elif op == "rewind":
            if ident not in live:
                live.clear()
            while ident in live:
                live.popitem()
    yield from live.values()
