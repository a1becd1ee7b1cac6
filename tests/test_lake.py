"""Scans over files: places of lines, archives, the ordered preference and published versions."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tallyloom.operators import preference
from tallyloom.plans import ingest
from tallyloom.schemas import tables
from tallyloom.sources import codex
from tallyloom.sources.lake import scan_lines, unreadable_files, with_offsets

LAYOUT = "codex_rollouts"


@pytest.fixture
def splits(spark):
    """Sets the bytes of a split for a test."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def set_to(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")

    yield set_to
    for n, v in before.items():
        spark.conf.set(n, v)


def test_places_do_not_depend_on_splits(spark, store, lake, splits):
    """Blank lines, carriage returns, long lines and lines of several bytes a character, in one file and in many splits."""
    rng = random.Random(1)
    expected = {}
    for name in ("one", "two", "three"):
        data, at = b"", []
        for _ in range(rng.randrange(50, 300)):
            line = rng.choice(["", "\r", "x" * rng.randrange(900), "größe 日本 " * rng.randrange(1, 9), "a\r"]).encode()
            at.append((len(data), len(data) + len(line) + 1, line.decode()))
            data += line + b"\n"
        with open(store.path(f"codex/sessions/{name}.jsonl"), "wb") as out:
            out.write(data)
        expected[name] = at
    for size in (700, 4_000, 1 << 20):
        splits(size)
        raw = scan_lines(spark, lake, LAYOUT).withColumn("bytes", F.octet_length("line").cast("long") + 1)
        assert raw.select("line_key.block").distinct().count() > 3
        got = {}
        for r in with_offsets(raw).collect():
            got.setdefault(r.path.rsplit("/", 1)[1].removesuffix(".jsonl"), []).append((r.start_offset, r.end_offset, r.line))
        assert {k: sorted(v) for k, v in got.items()} == expected


def test_archives_are_places_of_their_text(spark, store, lake):
    import zstandard

    lines = [b"", *(b"y" * (i % 700) for i in range(9_000))]
    with open(store.path("codex/sessions/rollout-a.jsonl.zst"), "wb") as out:
        out.write(zstandard.compress(b"\n".join(lines) + b"\n"))
    raw = scan_lines(spark, lake, LAYOUT).withColumn("bytes", F.octet_length("line").cast("long") + 1)
    got = sorted((r.start_offset, r.end_offset) for r in with_offsets(raw).collect())
    assert got[0] == (0, 1) and len(got) == len(lines) and got[-1][1] == sum(map(len, lines)) + len(lines)
    assert all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))


def test_an_archive_longer_than_a_value_fails_nothing(spark, store, lake):
    import os

    import zstandard

    store.lines("codex/sessions/rollout-plain.jsonl", "{}", "{}")
    with open(store.path("codex/sessions/rollout-long.jsonl.zst"), "wb") as out:
        out.write(zstandard.compress(os.urandom(5_000)))
    name = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(name, "1000")
    try:
        assert scan_lines(spark, lake, LAYOUT).count() == 2
        assert [r.path.rsplit("/", 1)[1] for r in unreadable_files(spark, lake, LAYOUT).collect()] == ["rollout-long.jsonl.zst"]
        assert codex.read(spark, lake).warnings.where("code = 'unreadable_file'").collect()[0].n == 1
    finally:
        spark.conf.unset(name)


def sequential(rows):
    held = None
    for row in rows:
        if held is None or row[1] > held[1] or row[2] > held[2]:
            held = row
    return held


@pytest.mark.parametrize("seed", range(6))
def test_runs_fold_like_rows(seed):
    rng = random.Random(seed)
    for _ in range(1_500):
        n = rng.randrange(1, 30)
        most = rng.choice([2, 5, 40])
        rows = [(str(i), rng.randrange(most), rng.randrange(most)) for i in range(n)]
        cuts = sorted({rng.randrange(n + 1) for _ in range(rng.randrange(4))} | {0, n})
        state = None
        for a, b in zip(cuts, cuts[1:], strict=False):
            state = preference.applied(state, preference.summary(*zip(*rows[a:b], strict=True)))
        assert state == sequential(rows)


def test_many_files_of_one_id(spark):
    """One id holds nearly all files; its fold runs over many partitions."""
    rng = random.Random(9)
    rows = [("s", "hot", f"p{i:06d}", rng.randrange(10 ** 6), rng.randrange(10 ** 6)) for i in range(100_000)]
    rows += [("s", f"id{i}", f"p{j}", rng.randrange(5), rng.randrange(5)) for i in range(200) for j in range(rng.randrange(1, 6))]
    df = spark.createDataFrame(rows, "store_id string, session_id string, path string, e long, n long").repartition(8)
    got = {r.session_id: r.path for r in preference.last_preferred(df, ["store_id", "session_id"], "path", "e", "n").collect()}
    by = {}
    for row in sorted(rows):
        by.setdefault(row[1], []).append(row[2:])
    assert got == {k: sequential(v)[0] for k, v in by.items()}


def test_versions(spark, tmp_path):
    """A version shows all tables of its runs; what an unfinished run wrote is not read; old versions stay for a while."""
    out = str(tmp_path / "tables")

    def run(harness, n):
        rows = spark.createDataFrame([("s", harness, f"{harness}{i}") for i in range(n)], "store_id string, harness string, code string")
        return tables(spark, warnings=rows.withColumn("n", F.lit(1).cast("long")))

    with pytest.raises(FileNotFoundError):
        ingest.load_tables(spark, out)
    ingest.write_tables(run("codex", 3), out, ["codex"])
    first = ingest.load_tables(spark, out)
    ingest.write_tables(run("grok", 2), out, ["grok"])
    # A run that is killed before its version: its files lie there, and count for nothing.
    run("grok", 9).warnings.write.partitionBy("harness").parquet(f"{out}/runs/killed/warnings")
    ingest.write_tables(run("codex", 1), out, ["codex"])
    assert sorted(r.code for r in ingest.load_tables(spark, out).warnings.collect()) == ["codex0", "grok0", "grok1"]
    assert first.warnings.count() == 3 and ingest.load_tables(spark, out, 2).warnings.count() == 5
    for n in (5, 6, 7):
        ingest.write_tables(run("codex", n), out, ["codex", "grok"])
    assert ingest.Versions(spark, out).numbers() == [4, 5, 6]
    assert ingest.load_tables(spark, out).warnings.count() == 7
    assert (tmp_path / "tables/runs/killed").exists()


def test_runs_that_publish_at_once(spark, tmp_path, monkeypatch):
    """A number that another run has taken meanwhile is not overwritten."""
    versions = ingest.Versions(spark, str(tmp_path))
    versions.publish("one", ["codex"])
    numbers, calls = ingest.Versions.numbers, []

    def late(self):
        found = numbers(self)
        if not calls:
            calls.append(1)
            ingest.Versions(spark, str(tmp_path)).publish("two", ["grok"])
        return found

    monkeypatch.setattr(ingest.Versions, "numbers", late)
    assert versions.publish("three", ["codex"]) == 3
    assert versions.runs(3) == {"codex": "three", "grok": "two"} and versions.runs(2) == {"codex": "one", "grok": "two"}


def test_batches_of_many_keys(spark):
    """A task hands on its keys in batches, not one batch a key; keys of one row don't reach it at all."""
    rows = [("s", f"id{i}", f"p{j}", i % 7, j) for i in range(3_000) for j in range(1 + i % 2)]
    df = spark.createDataFrame(rows, "store_id string, session_id string, path string, e long, n long").repartition(4)
    got = preference.last_preferred(df, ["store_id", "session_id"], "path", "e", "n")
    assert sorted((r.session_id, r.path) for r in got.collect()) == sorted((f"id{i}", f"p{i % 2}") for i in range(3_000))
    shape = pa.schema([("k", pa.string()), ("n", pa.int32())])
    sizes = [b.num_rows for b in preference._batched(iter([{"k": "a", "n": i} for i in range(4_500)]), shape)]
    assert sizes == [2_000, 2_000, 500]
