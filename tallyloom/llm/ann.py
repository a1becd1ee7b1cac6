"""Nearest neighbours by a block matrix join over int8 tiles with error bounds.

Candidates are packed where they are scanned into blocks of up to ``CANDIDATES`` vectors, queries into blocks of up to
``QUERIES``; both are read whole. A Spark join on (part, query group, dimension) makes the tiles: a row holds
one candidate and one query block. In a tile all vectors are scaled to unit length and rounded to int8 with a scale
each; one matrix product gives all approximate cosines, and the norms of the rounding errors bound how far each can be
off. With e the error vector and q the rounded vector, cos differs by at most |e1| + |q1| * |e2|. Only pairs whose upper
bound reaches the k-th best lower bound (or the k-th best cosine so far) survive; their cosines are computed in double
precision from the original vectors, and heaps keep the k best per query over the tiles of one join key. A window over
those few rows merges the keys. No true neighbour can be lost, so recall is 1.

Of equal vectors in a block only k rows of an id, and of these the 2 k with the smallest ids, can ever be among a query's
nearest, since at most k of them have the query's own id; the others are left out before the product, which keeps large
groups of copies cheap and changes nothing.

Queries are split into groups of about ``GROUP``, candidates into parts of about ``CANDIDATES`` (by their scan task and,
where tasks hold more, by their id). Each candidate block is sent to every group, each query block to every part, so a
task's work is bounded by its two sides. With few queries there is one group, and candidates move once. Both sides are
shuffled whatever their size: a query block is repeated for each part, which Spark's estimates of it do not know, and
broadcast it would pass through the driver. Vectors of floats move as floats.

Edge cases: vectors that are null, empty, zero or hold a null or non-finite component, and rows with a null id, take no
part. Vectors of another dimension than the query's are no candidates. Rows with the query's own id are never its
neighbours; a repeated query id is one query (its smallest vector), a repeated candidate row counts by itself. Ties go
to the smaller id. Fewer than k candidates: all are listed. An empty table gives no rows. Other columns are not used.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
QUERY_STEP = 50
CANDIDATES = 16_384
QUERIES = 4_096
GROUP = 32_768
BLOCK_BYTES = 8 << 20
#: Parts that one scan task's candidates are dealt to at most; a block of each is open meanwhile.
PARTS_OF_A_TASK = 16
#: Rows and columns of a product held at once.
PANEL = (512, 4_096)
#: Dimensions whose int8 products add up exactly in single precision.
EXACT = 1_024

BLOCK = "part int, dim int, ids binary, data binary"


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _pack(most: int, kind: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of vectors of one part and dimension; ids as int64, data as ``kind``, both little-endian."""
        held = {}

        def block(part: int, dim: int) -> pa.RecordBatch:
            ids, data = held.pop((part, dim))
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "dim": pa.array([dim], pa.int32()),
                "ids": pa.array([np.concatenate(ids).astype("<i8").tobytes()], pa.binary()),
                "data": pa.array([np.concatenate(data).astype(kind).tobytes()], pa.binary())})

        for batch in batches:
            ids = np.asarray(batch.column("vec_id"))
            lists = batch.column("vector")
            sizes = np.asarray(pc.list_value_length(lists))
            flat, starts = np.asarray(lists.flatten()), np.cumsum(sizes) - sizes
            parts = np.asarray(batch.column("part"))
            for part, dim in sorted(set(zip(parts.tolist(), sizes.tolist(), strict=True))):
                rows = np.flatnonzero((sizes == dim) & (parts == part))
                step = max(1, min(most, BLOCK_BYTES // (8 * dim)))
                for at in range(0, len(rows), step):
                    some = rows[at:at + step]
                    vectors = flat[starts[some][:, None] + np.arange(dim)]
                    if (part, dim) in held and sum(map(len, held[part, dim][0])) + len(some) > step:
                        yield block(part, dim)
                    kept = held.setdefault((part, dim), ([], []))
                    kept[0].append(ids[some])
                    kept[1].append(vectors.ravel())
        for key in list(held):
            yield block(*key)

    return pack


class Side:
    """The vectors of a block: original, scaled by a power of two, and as int8 with bounds."""

    def __init__(self, ids: bytes, data: bytes, dim: int, kind: str, copies: int | None = None):
        self.ids = np.frombuffer(ids, dtype="<i8")
        raw = np.frombuffer(data, dtype=kind).reshape(-1, dim).astype("<f8")
        if copies:
            keep = self._few_copies(raw, copies)
            self.ids, raw = self.ids[keep], raw[keep]
        # A power of two changes no digit and keeps squares in range.
        self.raw = np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1))[1][:, None])
        self.square = np.zeros(len(raw))
        for d in range(dim):
            self.square += self.raw[:, d] * self.raw[:, d]
        unit = self.raw / np.sqrt(self.square)[:, None]
        self.scale = np.abs(unit).max(axis=1) / 127
        rounded = np.rint(unit / self.scale[:, None])
        self.int8 = rounded.astype(np.int8)
        self.error = np.linalg.norm(unit - rounded * self.scale[:, None], axis=1) + 1e-12
        self.length = np.linalg.norm(rounded, axis=1) * self.scale

    def _few_copies(self, raw: np.ndarray, copies: int) -> np.ndarray:
        """Rows left if of equal vectors ``copies`` rows of an id stay, and of these twice as many with the smallest ids."""
        rows = np.ascontiguousarray(raw).view(np.dtype((np.void, raw.shape[1] * 8))).ravel()
        _, group = np.unique(rows, return_inverse=True)
        order = np.lexsort((self.ids, group))
        # Runs of one vector and id.
        new = np.diff(group[order], prepend=-1) != 0
        new[1:] |= np.diff(self.ids[order]) != 0
        at = np.arange(len(order))
        order = order[at - np.maximum.accumulate(np.where(new, at, 0)) < copies]
        sorted_group = group[order]
        first = np.searchsorted(sorted_group, sorted_group, side="left")
        return np.sort(order[np.arange(len(order)) - first < 2 * copies])


def cosines(a: Side, i: np.ndarray, b: Side, j: np.ndarray) -> np.ndarray:
    """Cosines of the pairs, added up component by component."""
    dot = np.zeros(len(i))
    for d in range(a.raw.shape[1]):
        dot += a.raw[i, d] * b.raw[j, d]
    return np.clip(dot / np.sqrt(a.square[i] * b.square[j]), -1.0, 1.0)


def tile(queries: Side, candidates: Side, k: int, best: list[list[tuple]]) -> None:
    """Puts the tile's pairs into ``best``: per query up to k of (-cosine, id), smallest first."""
    dim = queries.raw.shape[1]
    for top in range(0, len(queries.ids), PANEL[0]):
        q = slice(top, min(top + PANEL[0], len(queries.ids)))
        for left in range(0, len(candidates.ids), PANEL[1]):
            c = slice(left, min(left + PANEL[1], len(candidates.ids)))
            product = np.zeros((q.stop - q.start, c.stop - c.start))
            for d in range(0, dim, EXACT):
                product += queries.int8[q, d:d + EXACT].astype(np.float32) @ \
                    candidates.int8[c, d:d + EXACT].astype(np.float32).T
            product *= queries.scale[q, None] * candidates.scale[None, c]
            bound = queries.error[q, None] + queries.length[q, None] * candidates.error[None, c]
            own = queries.ids[q, None] == candidates.ids[None, c]
            product[own] = -np.inf
            low = product - bound
            floor = np.array([-b[-1][0] if len(b) == k else -np.inf for b in best[q]])
            if low.shape[1] >= k:
                floor = np.maximum(floor, np.partition(low, low.shape[1] - k, axis=1)[:, -k])
            # The slack covers the rounding of the bounds themselves.
            i, j = np.nonzero((product + bound >= floor[:, None] - 1e-9) & ~own)
            if not len(i):
                continue
            exact = cosines(queries, i + q.start, candidates, j + c.start)
            ids = candidates.ids[j + c.start]
            order = np.lexsort((ids, -exact, i))
            i, exact, ids = i[order], exact[order], ids[order]
            leading = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
            found: dict[int, list[tuple]] = {}
            for at, score, vec in zip(i[leading].tolist(), exact[leading].tolist(), ids[leading].tolist(), strict=True):
                found.setdefault(at + q.start, []).append((-score, vec))
            for at, pairs in found.items():
                best[at] = heapq.nsmallest(k, heapq.merge(best[at], pairs))


def _tiles(k: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tiles in the order of their keys; the k best of a query so far are kept while the key lasts."""
        key, state, candidate, side = None, {}, None, None

        def flush() -> Iterator[pa.RecordBatch]:
            for queries, best in state.values():
                rows = [(q, vec, -score) for q, pairs in zip(queries.ids.tolist(), best, strict=True)
                        for score, vec in pairs]
                columns = list(zip(*rows, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                     pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                part, group, dim = (batch.column(c)[row].as_py() for c in ("part", "grp", "dim"))
                if (part, group, dim) != key:
                    yield from flush()
                    key, state, candidate = (part, group, dim), {}, None
                q_ids, c_ids = batch.column("q_ids")[row].as_py(), batch.column("ids")[row].as_py()
                if q_ids not in state:
                    queries = Side(q_ids, batch.column("q_data")[row].as_py(), dim, kind)
                    state[q_ids] = (queries, [[] for _ in queries.ids])
                if c_ids != candidate:
                    candidate, side = c_ids, Side(c_ids, batch.column("data")[row].as_py(), dim, kind, k)
                queries, best = state[q_ids]
                tile(queries, side, k, best)
        yield from flush()

    return run


def search(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of ``candidates`` of each of the ``queries`` (both vec_id, vector)."""
    floats = all(dict(df.dtypes)["vector"] == "array<float>" for df in (candidates, queries))
    kind, stored = ("<f4", "array<float>") if floats else ("<f8", "array<double>")
    candidates, queries = (df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast(stored).alias("vector"))
                           .where(usable(F.col("vector")) & F.col("vec_id").isNotNull()) for df in (candidates, queries))
    queries = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    groups = max(1, math.ceil(queries.count() / GROUP))
    n, last = candidates.select(F.spark_partition_id().alias("task")).agg(F.count("*"), F.max("task")).first()
    parts = max(1, math.ceil(n / CANDIDATES))
    of_task = min(PARTS_OF_A_TASK, math.ceil(parts / ((last or 0) + 1)))
    # Blocks of one group: its rows are packed by the task that holds them.
    packed = queries.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")) \
        .repartition(groups, "part").sortWithinPartitions("part", "vec_id") \
        .mapInArrow(_pack(QUERIES, kind), BLOCK).withColumnsRenamed({"ids": "q_ids", "data": "q_data", "part": "grp"})
    packed = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    part = F.spark_partition_id() * of_task + F.pmod(F.xxhash64("vec_id"), F.lit(of_task))
    blocks = candidates.withColumn("part", F.pmod(part, F.lit(parts)).cast("int")) \
        .mapInArrow(_pack(CANDIDATES, kind), BLOCK) \
        .withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    tiles = blocks.join(packed.hint("merge"), ["part", "grp", "dim"])
    found = tiles.mapInArrow(_tiles(k, kind), "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def report(embeddings: DataFrame) -> DataFrame:
    """The nearest vectors of every row whose vec_id is divisible by ``QUERY_STEP``."""
    vectors = embeddings.select("vec_id", F.col("embedding").alias("vector"))
    return search(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0))


#: The same over all pairs, for DuckDB.
SQL = f"""
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.x, c.x) AS score
  FROM v q JOIN v c ON q.vec_id % {QUERY_STEP} = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
