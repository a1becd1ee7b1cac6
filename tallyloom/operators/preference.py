"""A fold over rows in order, whose preference is not transitive, without a list per key.

In order, a row replaces the one held so far if it is greater in the first value or in the second. What a run of rows
does to any incoming row is a small function: the first row that replaces it decides everything after. That row is the
earlier of the first one beyond the incoming first value and the first one beyond the incoming second value, both read
off the run's rising records. So runs are summarised side by side and only their summaries follow one another.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import islice
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows of a batch that a task hands on: a key's row is a few bytes, far less than what a batch costs.
BATCH = 2_000

RUN = "part int, firsts array<long>, first_at array<int>, seconds array<long>, second_at array<int>, ends array<int>, " \
      "held_names array<string>, held_firsts array<long>, held_seconds array<long>"


def records(values: Sequence[int]) -> tuple[list[int], list[int]]:
    """The rising records and their places."""
    found, at = [], []
    for i, value in enumerate(values):
        if not found or value > found[-1]:
            found.append(value)
            at.append(i)
    return found, at


def finals(firsts: Sequence[int], seconds: Sequence[int]) -> list[int]:
    """For each place the place that is held at the end if the fold starts there.

    From the back: the next place that replaces i is the first one beyond either value, found on two stacks that keep
    the places which are still the first beyond something.
    """
    n = len(firsts)
    out = list(range(n))
    stacks = ([], [])
    for i in range(n - 1, -1, -1):
        following = n
        for stack, values in zip(stacks, (firsts, seconds), strict=True):
            while stack and values[stack[-1]] <= values[i]:
                stack.pop()
            if stack:
                following = min(following, stack[-1])
            stack.append(i)
        if following < n:
            out[i] = out[following]
    return out


def summary(names: Sequence[str], firsts: Sequence[int], seconds: Sequence[int]) -> dict:
    """What the run does to any incoming row: records with the number of the row held in the end.

    Neighbouring records that end alike are one, as long as no record of the other value lies between them.
    """
    end = finals(firsts, seconds)
    (a, a_at), (b, b_at) = records(firsts), records(seconds)
    places = sorted({*a_at, *b_at})
    # Records of one end in a row are interchangeable: only the run of places matters.
    block, number = {}, 0
    for before, place in zip([None, *places], places, strict=False):
        number += before is not None and end[before] != end[place]
        block[place] = number

    def merged(values: list[int], at: list[int]) -> tuple[list[int], list[int]]:
        kept: dict[int, int] = {}
        for value, place in zip(values, at, strict=True):
            kept[block[place]] = value  # the greatest of its block
        return list(kept.values()), list(kept)

    a, a_at = merged(a, a_at)
    b, b_at = merged(b, b_at)
    ends = {block[p]: end[p] for p in places}
    held = sorted(set(ends.values()))
    number = {p: i for i, p in enumerate(held)}
    return {"firsts": a, "first_at": a_at, "seconds": b, "second_at": b_at, "ends": [number[ends[i]] for i in range(len(ends))],
            "held_names": [names[p] for p in held], "held_firsts": [firsts[p] for p in held],
            "held_seconds": [seconds[p] for p in held]}


def applied(state: tuple[str, int, int] | None, run: dict) -> tuple[str, int, int]:
    """The row held after a run."""
    if state is None:
        block = 0
    else:
        i, j = bisect_right(run["firsts"], state[1]), bisect_right(run["seconds"], state[2])
        found = [run["first_at"][i]] if i < len(run["firsts"]) else []
        found += [run["second_at"][j]] if j < len(run["seconds"]) else []
        if not found:
            return state
        block = min(found)
    end = run["ends"][block]
    return run["held_names"][end], run["held_firsts"][end], run["held_seconds"][end]


def _grouped(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of each key, which stand together."""
    last, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if held and key != last:
                yield last, held
                held = []
            last = key
            held.append(row)
    if held:
        yield last, held


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``rows`` in batches of ``BATCH``."""
    while some := list(islice(rows, BATCH)):
        yield pa.RecordBatch.from_pylist(some, schema=schema)


def last_preferred(rows: DataFrame, keys: Sequence[str], name: str, first: str, second: str) -> DataFrame:
    """``keys`` and the ``name`` that is held in the end. ``first`` and ``second`` are longs without nulls.

    Rows are ordered by a range partitioning, which cuts a key of any size where a partition ends; a task holds the rows
    of one key in its partition, and a key has a summary for each partition that it touches. Keys of one row hold it and
    take no part in the fold.
    """
    keys = list(keys)
    kinds = dict(rows.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)
    fields = [part.split()[0] for part in RUN.split(", ")]

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        yield from _batched(({**dict(zip(keys, key, strict=True)), "part": part,
                              **summary([r[name] for r in held], [r[first] for r in held], [r[second] for r in held])}
                             for key, held in _grouped(batches, keys)), shape)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def held() -> Iterator[dict]:
            for key, runs in _grouped(batches, keys):
                state = None
                for run in runs:
                    state = applied(state, run)
                yield {**dict(zip(keys, key, strict=True)), name: state[0]}

        yield from _batched(held(), result)

    longs, ints, strings = pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string())
    shape = pa.schema([*((k, pa.string()) for k in keys), ("part", pa.int32()), ("firsts", longs), ("first_at", ints),
                       ("seconds", longs), ("second_at", ints), ("ends", ints), ("held_names", strings),
                       ("held_firsts", longs), ("held_seconds", longs)])
    result = pa.schema([*((k, pa.string()) for k in keys), (name, pa.string())])
    narrow = rows.select(*keys, name, first, second)
    counted = narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(name).alias(name))
    several = counted.where("_n > 1").select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    several = narrow.join(several, reduce(and_, same), "left_semi")
    runs = several.repartitionByRange(*keys, name).sortWithinPartitions(*keys, name).mapInArrow(summarise, f"{head}, {RUN}")
    folded = runs.select(*keys, *fields).repartition(*keys).sortWithinPartitions(*keys, "part") \
        .mapInArrow(fold, f"{head}, {name} string")
    return counted.where("_n = 1").select(*keys, name).unionByName(folded)
