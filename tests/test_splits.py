"""Splits of the logs that the file queries write."""

from __future__ import annotations

from tallyloom.plans.queries_files import SPLIT_BYTES, SPLITS, small_splits, split_bytes


def test_splits_grow_with_the_logs():
    """Small logs have splits of the least size; larger ones have no more than ``SPLITS``, up to the session's own size."""
    most = 128 << 20
    assert split_bytes(1 << 20, most) == SPLIT_BYTES
    for total in (1 << 30, 6 << 30):
        assert total / split_bytes(total, most) <= SPLITS
    assert split_bytes(1 << 40, most) == most


def test_splits_of_a_lake(spark, store, lake):
    store.lines("codex/sessions/rollout-a.jsonl", *["x" * 1_000] * 20_000)
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    with small_splits(spark, lake):
        held = int(spark.conf.get(name))
        assert 20_000 * 1_001 / SPLITS <= held < 20_000 * 1_001 / SPLITS + 1
        files = spark.read.option("recursiveFileLookup", "true").text(f"{lake.base}")
        assert SPLITS <= files.rdd.getNumPartitions() <= SPLITS + 8
    assert spark.conf.get(name) == before


def test_segments_come_from_counts(spark, monkeypatch):
    """Heads of segments are made from the counts of their lines; lines are neither written nor ranked over their record."""
    from tallyloom.plans import catalog
    from tallyloom.sources.lake import Stage

    names, write = [], Stage.__call__
    monkeypatch.setattr(Stage, "__call__", lambda self, df, name: names.append(name) or write(self, df, name))
    got = catalog.queries()["segment_stitch"](spark, "/root/testdata/sf0.001")
    assert names == ["heads", "chain_claims", "chain_checked"]
    assert got.count() > 0


def test_cursor_parses_composers_once(spark, monkeypatch):
    """Headers and composers are staged: what is read after them parses no composer again."""
    from tallyloom.plans import catalog
    from tallyloom.sources.lake import Stage

    plans, write = {}, Stage.__call__
    monkeypatch.setattr(Stage, "__call__", lambda self, df, name: plans.update(
        {name: df._jdf.queryExecution().optimizedPlan().toString()}) or write(self, df, name))
    catalog.queries()["cursor_ingest"](spark, "/root/testdata/sf0.001")
    assert {"composers", "cursor_merged", "cursor_composers"} <= set(plans)
    assert "from_json" in plans["cursor_composers"] and "from_json" not in plans["cursor_heads"]
