"""Whitening by the leading eigenvectors of the covariance, found by Jacobi-Davidson.

Entries become whole numbers first, floor(1024 * c) + 100000, so sums are exact and every vector is centred exactly: the
centred entry is (n * x - S) / n. The vectors are packed where they are scanned into blocks that are checkpointed once;
no task holds more than a block. The covariance is never formed. All that is asked of the data are products of it with
a few vectors: each task centres its blocks, multiplies them with the vectors and back, and Spark sums the results,
which are a few numbers for each dimension.

**Jacobi-Davidson.** The driver keeps a subspace of at most ``WIDEST`` vectors for each component asked for, and its
products. Rayleigh-Ritz gives approximate pairs; those whose residual has reached the rounding of the product are locked
and leave the subspace. For the others the correction equations (I - QQ') (V - e I) (I - QQ') t = -r, with all locked
and wanted vectors in Q, are solved roughly by MINRES; the equations go in step, so each step is one product for all. The
corrections extend the subspace; a full one restarts from its best vectors. A residual that neither shrinks further nor
exceeds a wider bound is taken to be at the rounding of its product.

**Whitened** values are the projections of the centred vectors over the root of their eigenvalue; a last pass sums their
means and products, whose largest departure from the identity is ``identity_error``.

Edge cases: vectors that are null, or hold a null, NaN or infinite entry, are left out. Vectors of another length have
a fit of their own, so an empty vector has no components. Directions without variance are no components (one vector, or
equal ones: no rows). Null ids are kept; repeated rows count each; an empty table gives no rows; equal eigenvalues may
come with any basis of their space. Entries whose whole number exceeds a long are an error, as in SQL, and so is a
deviation that does. Columns other than id and vector are not used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import cut

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
BLOCK_BYTES = 4 << 20
#: Vectors of the subspace for each component, and after a restart; steps of MINRES.
WIDEST, KEPT = 6, 3
STEPS = 5
MAX_ROUNDS = 200
#: Residual over the largest eigenvalue: taken at once, and taken if it has stopped to shrink.
ROUNDING, WIDER = 2.0 ** -46, 1e-12
#: Eigenvalues below this share of the largest are no variance.
NOTHING = 1e-12

BLOCK = "ids array<long>, dim int, data binary"
RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Model:
    """A fit: number of vectors, sums of their entries, components (columns), eigenvalues and the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return vector.isNotNull() & finite


def packed(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Blocks of whole-number vectors of one length: ids, dim and data (int64, little-endian), checkpointed."""
    whole = F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(c * SCALE) + SHIFT)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, data, _ = zip(*held.pop(dim), strict=True)
            offsets = pa.array([0, sum(map(len, ids))], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(offsets, pa.concat_arrays(ids)), pa.array([dim], pa.int32()),
                 pa.array([b"".join(data)], pa.binary())], ["ids", "dim", "data"])

        for batch in batches:
            ids, lists = batch.column("id").cast(pa.int64()), batch.column("x")
            sizes = np.asarray(pc.list_value_length(lists))
            flat, starts = np.asarray(lists.flatten()), np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                step = max(1, BLOCK_BYTES // (8 * max(1, dim)))
                for at in range(0, len(rows), step):
                    some = rows[at:at + step]
                    if sum(n for *_, n in held.get(dim, [])) + len(some) > step:
                        yield block(dim)
                    data = flat[starts[some][:, None] + np.arange(dim)].astype("<i8").tobytes()
                    held.setdefault(dim, []).append((ids.take(pa.array(some)), data, len(some)))
        for dim in list(held):
            yield block(dim)

    usable_rows = rows.where(usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), whole.alias("x"))
    return cut(usable_rows.mapInArrow(pack, BLOCK))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and vectors of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, dim = batch.column("ids")[i].values, batch.column("dim")[i].as_py()
            data = np.frombuffer(batch.column("data")[i].as_buffer(), dtype="<i8")
            yield ids, data.reshape(len(ids), dim)


def moments(blocks: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and exact sums of their entries, by length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[int]] = {}
        for ids, x in _blocks(batches):
            # Halves of 32 bits, so that no sum of a block overflows.
            high = [int(v) for v in (x >> 32).sum(axis=0)]
            low = [int(v) for v in (x & 0xFFFFFFFF).sum(axis=0)]
            values = [len(ids), *((h << 32) + v for h, v in zip(high, low, strict=True))]
            known = found.setdefault(x.shape[1], [0] * len(values))
            found[x.shape[1]] = [a + b for a, b in zip(known, values, strict=True)]
        for dim, values in found.items():
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim] * len(values), pa.int32()),
                                              "i": pa.array(range(len(values)), pa.int32()),
                                              "v": pa.array([str(v) for v in values], pa.string())})

    rows = blocks.select("ids", "dim", "data").mapInArrow(run, "dim int, i int, v string") \
        .groupBy("dim", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # a number a dimension
    out: dict[int, dict[int, int]] = {}
    for row in rows:
        out.setdefault(row.dim, {})[row.i] = int(row.v)
    return {dim: (v[0], [v[i] for i in range(1, dim + 1)]) for dim, v in sorted(out.items())}


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly."""
    most = max(map(abs, sums), default=0) + n * int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))))
    kind = np.int64 if most < 2 ** 63 else object
    return x.astype(kind) * n - np.array(sums, dtype=kind)


def _summed(blocks: DataFrame, of: Callable[[np.ndarray], np.ndarray], n: int, sums: list[int], shape: tuple) -> np.ndarray:
    """The sum over all blocks of an array made of the block's centred vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches):
            part = of(_deviations(x, n, sums).astype(np.float64) / n).ravel()
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "v": pa.array(total)})

    out = np.zeros(int(np.prod(shape)))
    for row in blocks.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[row.i] = row.v  # dimensions times a few vectors
    return out.reshape(shape)


def _orthogonal(new: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """Orthonormal columns of what ``new`` adds to the columns of the others."""
    kept = [np.zeros((len(new), 0))]
    for column in new.T:
        size = np.linalg.norm(column)
        for _ in range(3):
            for basis in (*others, *kept):
                column = column - basis @ (basis.T @ column)
        left = np.linalg.norm(column)
        if size and left > 1e-8 * size:
            kept.append((column / left)[:, None])
    return np.column_stack(kept)


def minres(product: Callable[[np.ndarray], np.ndarray], values: np.ndarray, right: np.ndarray, outside: np.ndarray,
           steps: int, goal: float) -> np.ndarray:
    """Rough solutions of (V - value) t = right for every column, orthogonal to ``outside``; a product a step."""
    def project(columns: np.ndarray) -> np.ndarray:
        return columns - outside @ (outside.T @ columns)

    v = project(right)
    beta = np.linalg.norm(v, axis=0)
    start, solution = beta.copy(), np.zeros_like(right)
    v = v / np.where(beta, beta, 1)
    before, w, w_before = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    beta, rest, cosine, sine = np.zeros_like(start), start.copy(), -np.ones_like(start), np.zeros_like(start)
    diagonal, above = np.zeros_like(start), np.zeros_like(start)
    running = start > 0
    for _ in range(steps):
        if not running.any():
            break
        p = project(product(v) - v * values) - before * beta
        alpha = (v * p).sum(axis=0)
        p -= v * alpha
        following = np.linalg.norm(p, axis=0)
        older, delta = above, cosine * diagonal + sine * alpha
        bar = sine * diagonal - cosine * alpha
        above, diagonal = sine * following, -cosine * following
        gamma = np.maximum(np.hypot(bar, following), 1e-300)
        cosine, sine = bar / gamma, following / gamma
        w, w_before = (v - w_before * older - w * delta) / gamma, w
        solution += np.where(running, cosine * rest, 0) * w
        rest = sine * rest
        running &= (np.abs(rest) > goal * start) & (following > 1e-14 * np.abs(values).max())
        before, v, beta = v, p / np.where(following > 0, following, 1), following
    return project(solution)


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, seed: int = 0
                    ) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric positive operator, falling, and their unit eigenvectors as columns.

    ``product`` gives the operator's product with all columns of an array. Fewer pairs come back if the rest is nothing.
    """
    wanted = min(wanted, size)
    space = _orthogonal(np.random.default_rng(seed).standard_normal((size, min(size, KEPT * wanted))))
    images = product(space)
    locked, values, largest, least, stuck = np.zeros((size, 0)), [], 0.0, np.inf, 0
    for round_ in range(MAX_ROUNDS):
        inner = space.T @ images
        theta, turn = np.linalg.eigh((inner + inner.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, images = space @ turn, images @ turn
        largest = max([largest, *theta[:1]])
        if largest <= 0:
            break
        open_ = min(wanted - len(values), space.shape[1])
        residuals = images[:, :open_] - space[:, :open_] * theta[:open_]
        residuals -= locked @ (locked.T @ residuals)
        norms = np.linalg.norm(residuals, axis=0) / largest
        # A first pair that does not improve any more has reached the rounding of its product.
        stuck = stuck + 1 if norms[0] > 0.5 * least else 0
        least = min(least, norms[0])
        done = 0
        while done < open_ and (norms[done] <= ROUNDING or norms[done] <= WIDER and (done == 0 and stuck > 1)):
            done += 1
        if done:
            locked = np.column_stack([locked, space[:, :done]])
            values += theta[:done].tolist()
            space, images, least, stuck = space[:, done:], images[:, done:], np.inf, 0
            if len(values) == wanted or values[-1] <= NOTHING * largest:
                break
            theta, residuals, open_ = theta[done:], residuals[:, done:], open_ - done
        if space.shape[1] > WIDEST * wanted:
            space, images, theta = (part[..., :KEPT * wanted] for part in (space, images, theta))
        targets = np.column_stack([locked, space[:, :open_]])
        if open_ and targets.shape[1] < size:
            steps = minres(product, theta[:open_], -residuals, targets, STEPS, 0.5 ** (round_ + 2))
            new = _orthogonal(steps, locked, space)
        else:
            new = np.zeros((size, 0))
        if not new.shape[1] and locked.shape[1] + space.shape[1] < size:
            new = _orthogonal(np.random.default_rng(seed + 1 + round_).standard_normal((size, 1)), locked, space)
        if new.shape[1]:
            space, images = np.column_stack([space, new]), np.column_stack([images, product(new)])
        elif space.shape[1]:
            images = product(space)  # the subspace is everything: only the products' rounding is left
        else:
            break
    else:
        raise RuntimeError(f"eigenpairs have not settled in {MAX_ROUNDS} rounds")
    values, locked = np.array(values), locked / np.maximum(np.linalg.norm(locked, axis=0), 1e-300)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > NOTHING * largest]
    return values[order], locked[:, order]


def fit(blocks: DataFrame, dim: int, n: int, sums: list[int], components: int = COMPONENTS, seed: int = 0) -> Model:
    """The leading components of the blocks of one length."""
    def product(columns: np.ndarray) -> np.ndarray:
        return _summed(blocks, lambda c: c.T @ (c @ columns), n, sums, columns.shape) / n

    trace = float(_summed(blocks, lambda c: np.array([(c * c).sum()]), n, sums, (1,))[0]) / n
    values, vectors = jacobi_davidson(product, dim, components, seed) if trace > 0 else (np.zeros(0), np.zeros((dim, 0)))
    return Model(n, sums, vectors, values, trace)


def identity_error(blocks: DataFrame, model: Model) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    k = len(model.values)
    scaled = model.vectors / np.sqrt(model.values)
    means = _summed(blocks, lambda c: (c @ scaled).sum(axis=0), model.n, model.sums, (k,)) / model.n

    def spread(c: np.ndarray) -> np.ndarray:
        w = c @ scaled - means
        return w.T @ w

    covariance = _summed(blocks, spread, model.n, model.sums, (k, k)) / model.n
    return float(np.abs(covariance - np.eye(k)).max(initial=0))


def transform(blocks: DataFrame, model: Model, error: float, key: str = "vec_id") -> DataFrame:
    """A row for each vector and component: ``key`` and ``RESULT``."""
    n, k, scaled = model.n, len(model.values), model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches):
            for at in range(0, len(x), 4_096):
                some = _deviations(x[at:at + 4_096], n, model.sums)
                m = len(some)
                most = int(abs(some).max(initial=0))
                exact = some if most * most * some.shape[1] < 2 ** 63 else some.astype(object)
                deviation = (exact * exact).sum(axis=1)
                rows = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, m).take(rows), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, dtype=np.int64)), pa.array(deviation.tolist(), pa.int64()).take(rows),
                    pa.array(((some.astype(np.float64) / n) @ scaled).ravel()),
                    pa.array(np.tile(model.values / model.trace, m)), pa.array(np.full(m * k, error))],
                    [key, *(part.split()[0] for part in RESULT.split(", "))])

    return blocks.mapInArrow(run, f"`{key}` long, {RESULT}")


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``key``, component, n, deviation, whitened, explained, identity_error for each usable vector and component."""
    blocks = packed(rows, key, vector)
    out = rows.sparkSession.createDataFrame([], f"`{key}` long, {RESULT}")
    for dim, (n, sums) in moments(blocks).items():
        own = blocks.where(F.col("dim") == dim)
        model = fit(own, dim, n, sums, components)
        if len(model.values):
            out = out.union(transform(own, model, identity_error(own, model), key))
    return out


def report(rows: DataFrame) -> DataFrame:
    """The whitened vectors of the ``embeddings`` table."""
    return whiten(rows.select("vec_id", "embedding"))
