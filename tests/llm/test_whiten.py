from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tallyloom.llm import whiten

SCHEMA = "vec_id long, embedding array<float>, component string, whitened int"


def vectors(n, d, seed=0):
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
    return (rng.standard_normal((n, d)) * np.linspace(2, 0.3, d) @ turn).astype(np.float32)


def frame(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [None if c is None else float(c) for c in v], "c", 1)
                                  for i, v in rows], SCHEMA).repartition(3)


def brute(usable, k=whiten.COMPONENTS):
    """By exact sums and a dense solver: deviation by id, eigenvalues, eigenvectors, centred vectors and trace."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in usable]
    n, sums = len(x), [sum(column) for column in zip(*x, strict=True)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(row, sums, strict=True)] for row in x])
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return deviation, values[::-1][:k], turn[:, ::-1][:, :k], centred, values.sum()


def check(got, usable):
    deviation, values, turn, centred, trace = brute(usable)
    assert len(got) == len(usable) * len(values)
    by = {(r.vec_id, r.component): r for r in got}
    at = {i: j for j, (i, _) in enumerate(usable)}
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1
    for c in range(1, len(values) + 1):
        expected = centred @ turn[:, c - 1] / np.sqrt(values[c - 1])
        mine = np.array([by[i, c].whitened for i, _ in usable])
        sign = np.sign(expected @ mine)
        assert np.abs(sign * mine - expected).max() < 1e-9
        for i, _ in usable:
            row = by[i, c]
            assert row.deviation == deviation[at[i]] and row.n == len(usable)
            assert abs(row.explained - values[c - 1] / trace) < 1e-12


def test_against_a_dense_solver(spark):
    rows = list(enumerate(vectors(300, 24)))
    bad = [(1000, None), (1001, [None] * 24), (1002, [float("nan")] * 24), (1003, [float("inf")] + [0.0] * 23)]
    got = whiten.whiten(frame(spark, rows + bad))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(got.collect(), rows)


def test_small_table_is_right(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check(whiten.report(df).collect(), [(r.vec_id, r.embedding) for r in df.collect()])


def test_many_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(whiten, "BLOCK_BYTES", 8 * 12 * 7)
    rows = list(enumerate(vectors(200, 12, 3)))
    check(whiten.whiten(frame(spark, rows)).collect(), rows)


def test_lengths_have_their_own_fits(spark):
    three, one = list(enumerate(vectors(40, 3, 1))), [(100 + i, v) for i, v in enumerate(vectors(9, 1, 2))]
    got = whiten.whiten(frame(spark, [*three, *one, (500, [])])).collect()
    check([r for r in got if r.vec_id < 100], three)
    check([r for r in got if 100 <= r.vec_id < 500], one)
    assert not [r for r in got if r.vec_id == 500]


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(i, [0.5, 0.5]) for i in range(6)]])
def test_nothing_to_whiten(spark, rows):
    assert whiten.whiten(frame(spark, rows)).count() == 0


def test_repeated_rows_null_ids_and_ties(spark):
    base = vectors(20, 2, 5)
    square = [(None, v) for w in base for v in ([w[0], w[1]], [-w[0], -w[1]], [-w[1], w[0]], [w[1], -w[0]])]
    got = whiten.whiten(frame(spark, square + square)).collect()
    assert {(r.vec_id, r.component, r.n) for r in got} == {(None, 1, 160), (None, 2, 160)} and len(got) == 320
    assert max(r.identity_error for r in got) < 1e-9


@pytest.mark.parametrize("shape", [(40, 30), (500, 60), (7, 50)])
def test_solver(shape):
    rng = np.random.default_rng(1)
    c = rng.standard_normal(shape) * np.linspace(3, 0.01, shape[1])
    v = c.T @ c
    values, turn = whiten.jacobi_davidson(lambda u: v @ u, shape[1], 8)
    dense = np.linalg.eigvalsh(v)[::-1]
    expected = dense[:8][dense[:8] > 1e-12 * dense[0]]
    assert np.abs(values - expected).max() <= 1e-12 * dense[0]
    assert np.abs(turn.T @ turn - np.eye(len(values))).max() < 1e-12
    assert np.linalg.norm(v @ turn - turn * values, axis=0).max() <= 1e-12 * dense[0]


def test_large_numbers_stay_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-3e4, 3e4) for _ in range(3)]) for i in range(30)]
    usable = [(i, np.array(v, dtype=np.float32)) for i, v in rows]
    check(whiten.whiten(frame(spark, rows)).collect(), usable)
