from __future__ import annotations

import math
import random

import duckdb
import pytest

from tallyloom.llm import ann


def brute(rows, k=5):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    queries = {}
    for i, v in good:
        if i % 50 == 0:
            queries[i] = min(queries.get(i, v), v)

    def cosine(a, b):
        dot = na = nb = 0.0
        for x, y in zip(a, b, strict=True):
            dot, na, nb = dot + x * y, na + x * x, nb + y * y
        return max(-1.0, min(1.0, dot / math.sqrt(na * nb)))

    for q, v in queries.items():
        scored = sorted((-cosine(v, w), i) for i, w in good if i != q and len(w) == len(v))
        yield from ((q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1))


def compare(spark, rows, kind="array<double>"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}").selectExpr("*", "1 AS part", "'x' AS ids")
    got = sorted(tuple(r) for r in ann.report(df.repartition(3)).collect())
    want = sorted(brute(rows))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=1e-15)


def vectors(n, dim, seed=1):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 1) for _ in range(dim)]) for i in range(n)]


def test_random_vectors_in_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(ann, "PANEL", (3, 40))
    monkeypatch.setattr(ann, "CANDIDATES", 64)
    monkeypatch.setattr(ann, "QUERIES", 4)
    compare(spark, vectors(500, 16))


def test_several_query_groups(spark, monkeypatch):
    monkeypatch.setattr(ann, "GROUP", 3)
    compare(spark, vectors(500, 8, 2))


def test_no_side_is_broadcast(spark):
    df = spark.createDataFrame(vectors(300, 8, 4), "vec_id long, embedding array<float>")
    found = ann.report(df)
    assert found.count() == 30
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_one_task_deals_its_rows_to_parts(spark, monkeypatch):
    monkeypatch.setattr(ann, "CANDIDATES", 16)
    rows = [(i, [float(round(16 * x)) for x in v]) for i, v in vectors(500, 8, 5)]
    for kind in ("array<float>", "array<double>"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}").coalesce(1)
        got = sorted(tuple(r) for r in ann.report(df).collect())
        want = sorted(brute(rows))
        assert [r[:3] for r in got] == [r[:3] for r in want]
        assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=1e-15)


def test_floats_against_doubles(spark):
    rows = vectors(200, 4, 6)
    doubles = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    floats = doubles.withColumn("vector", doubles.vector.cast("array<float>"))
    got = ann.search(doubles, floats.where("vec_id % 50 = 0")).collect()
    want = ann.search(doubles, floats.where("vec_id % 50 = 0").withColumn("vector", floats.vector.cast("array<double>")))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))


def test_edges(spark):
    rows = vectors(120, 4, 3)
    rows += [(200, None), (250, []), (300, [0.0] * 4), (350, [1.0, None, 2.0, 3.0]), (400, [float("nan")] * 4),
             (450, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0, 2.0, 3.0, 4.0]), (500, [1e-200, 2e-200, 0.0, 1e-201]),
             (550, [1.0, 2.0, 3.0]), (551, [3.0, 2.0, 1.0]), (600, [1.0])]
    rows = [r for r in rows if r[0] != 500]
    compare(spark, rows)


def test_copies_and_ties(spark):
    same = [1.0, 2.0, 3.0, 4.0]
    rows = [(i, same) for i in range(300)] + [(i, [2.0, 4.0, 6.0, 8.0]) for i in range(300, 310)] + vectors(40, 4)[1:]
    compare(spark, [(i, v) for i, v in rows])


@pytest.mark.parametrize("repeats", [5, 6, 40])
def test_query_id_repeated_among_copies(spark, repeats):
    same = [1.0, 2.0, 3.0, 4.0]
    rows = [(0, same)] * repeats + [(1, same)] * 2 + [(50, same)] * repeats + [(i, same) for i in range(51, 60)]
    compare(spark, rows + vectors(40, 4)[2:])
    compare(spark, [(0, same)] * repeats + [(1, same)] + vectors(40, 4)[2:])


def test_scaled_vectors_do_not_overflow(spark):
    df = spark.createDataFrame([(0, [1e200, 1e200]), (1, [2e200, 2e200]), (2, [1e-200, -1e-200])],
                               "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.report(df).orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 0.0)]


def test_few_and_none(spark):
    compare(spark, vectors(3, 4))
    assert ann.report(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert ann.report(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    got = ann.report(spark.read.parquet(f"{folder}/embeddings.parquet")).collect()
    assert sorted(tuple(r) for r in got) == sorted(con.execute(ann.SQL).fetchall())
