"""Operators against small Python models, and against changed partitioning."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F
from tallyloom.functions import jsonx, text, times
from tallyloom.operators import chain, dedupe, ordered, reconcile, replay, rhythm, views
from tallyloom.sources import antigravity, sqlite

PARTITIONS = (1, 7, 200)


def test_ordered_state_equals_one_pass(spark):
    rnd = random.Random(1)
    data = [(rnd.choice("aab"), i // 5, i, rnd.choice([None, 1, 2, 3])) for i in range(120)]
    expected, counts, sums, last = {}, {}, {}, {}
    for key, block, n, value in data:
        counts[key] = counts.get(key, 0) + 1
        before = last.get(key)
        sums[key] = sums.get(key, 0) + (value or 0)
        if value is not None:
            last[key] = value
        expected[n] = (counts[key], sums[key], before)
    shuffled = data[:]
    rnd.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "key string, block long, n long, v long")
    for parts in PARTITIONS:
        out = ordered.rank(df.repartition(parts), ["key"], ["block"], ["n"])
        out = ordered.running_sum(out, ["key"], ["block"], ["n"], F.coalesce("v", F.lit(0)), "total")
        out = ordered.last_before(out, ["key"], ["block"], ["n"], {"before": F.col("v")})
        assert {r.n: (r.rn, r.total, r.before) for r in out.collect()} == expected


def test_bag_minus_consumes_earliest(spark):
    rnd = random.Random(2)
    left = [(rnd.choice("ab"), i % 3, i) for i in range(40)]
    right = [(rnd.choice("ab"),) for _ in range(17)]
    taken = {k: sum(r[0] == k for r in right) for k in "ab"}
    kept, seen = set(), {}
    for key, block, n in sorted(left, key=lambda r: (r[1], r[2])):
        seen[key] = seen.get(key, 0) + 1
        if seen[key] > taken[key]:
            kept.add(n)
    l_df = spark.createDataFrame(left, "key string, block int, n int")
    r_df = spark.createDataFrame(right, "key string")
    for parts in PARTITIONS:
        out = reconcile.bag_minus(l_df.repartition(parts), r_df, ["key"], ["block"], ["n"])
        assert {r.n for r in out.collect()} == kept


def test_keep_first_never_merges_blanks(spark):
    df = spark.createDataFrame([("h", "x", 2, 20), ("h", "x", 1, 10), ("h", None, 3, 30), ("h", None, 4, 40)],
                               "harness string, id string, at int, v int")
    for parts in PARTITIONS:
        out = dedupe.keep_first(df.repartition(parts), ["harness"], "id", ["at"], ["v"])
        assert sorted(rows(out, "v", "copies")) == [(10, 2), (30, 1), (40, 1)]


def test_longest_streak(spark):
    rnd = random.Random(3)
    days = sorted({date(2024, 1, 1) + timedelta(days=rnd.randint(0, 60)) for _ in range(45)})
    best = run = 0
    for i, day in enumerate(days):
        run = run + 1 if i and day - days[i - 1] == timedelta(days=1) else 1
        best = max(best, run)
    df = spark.createDataFrame([(d,) for d in days], "date date")
    assert rows(rhythm.longest_streak(df)) == [(best,)]
    assert rows(rhythm.longest_streak(df.limit(0))) == [(0,)]


def _model_replay(ops):
    order, sizes = [], {}
    for op, ident, ids, words in ops:
        if op == "put":
            if ident not in sizes:
                order.append(ident)
            sizes[ident] = words
        elif op == "patch" and ident in sizes:
            sizes[ident] = words
        elif op == "remove" and ident in sizes:
            order.remove(ident)
            del sizes[ident]
        elif op == "order":
            tail = [i for i in dict.fromkeys(ids) if i in sizes]
            order = [i for i in order if i not in tail] + tail
        elif op == "rewind":
            cut = order.index(ident) if ident in sizes else 0
            for i in order[cut:]:
                del sizes[i]
            order = order[:cut]
    return sizes


def test_replay_equals_model(spark):
    rnd = random.Random(4)
    data, expected = [], {}
    for log in range(60):
        kinds = ["put", "put", "put", "patch"] + [[], ["remove", "rewind"], ["rewind"], ["remove", "order", "rewind"]][log % 4]
        ops = []
        for _ in range(rnd.randint(1, 25)):
            op = rnd.choice(kinds)
            ops.append((op, rnd.choice("abcdef") if op != "order" else None,
                        rnd.sample("abcdefg", 3) if op == "order" else None, rnd.randint(1, 99)))
        for i, words in _model_replay(ops).items():
            expected[f"log{log}", i] = words
        for n, (op, ident, ids, words) in enumerate(ops):
            message = ("user", None, words, words, True, None, 0, (False, False, 0, 0, 0, 0, 0, "")) if op in ("put", "patch") else None
            data.append(("s", f"log{log}", (n // 6, n, 0), op, ident, ids, message))
    df = spark.createDataFrame(data, "store_id string, path string, seq struct<block:long,n:long,sub:long>, op string, "
                               f"id string, ids array<string>, message {replay.MESSAGE}")
    out = replay.survivors(df.repartition(7))
    assert {(r.path, r.id): r.message.words for r in out.collect()} == expected


@pytest.mark.parametrize("offset,ordinal,valid", [(20, 2, True), (20, 5, False), (15, 2, False), (40, 4, True), (40, 9, False)])
def test_boundaries(spark, offset, ordinal, valid):
    lines = spark.createDataFrame([("s", "a", i, i * 10, i * 10 + 10) for i in range(4)],
                                  "store_id string, path string, ordinal long, start_offset long, end_offset long")
    segments = spark.createDataFrame(
        [("s", "t", "a", 0, False, None), ("s", "t", "b", ordinal, False, ("t", offset, ordinal))],
        "store_id string, thread_id string, path string, first_ordinal long, packed boolean, "
        "base struct<thread_id:string,end_byte_offset:long,end_ordinal_exclusive:long>")
    plan = {r.path: r for r in chain.stitch(segments, lines).collect()}
    assert plan["a"].stitched is valid and plan["a"].cut_offset == (offset if valid else None)


def test_scalars(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).collect()[0].x

    names = {"/a/b": "b", "C:\\Users\\x\\app\\": "app", "C:\\": None, "/": None, ".": None, "a/../..": "..", "/..": None,
             "/a/./b/..": "a", "": None, "/x/file:y": None, "/p/a\tb": "ab", "/p/" + "z" * 90: "z" * 80}
    df = spark.createDataFrame(list(names), "string")
    assert {r.value: r.n for r in df.select("value", text.project_name(F.col("value")).alias("n")).collect()} == names
    spaces = "\u3000a\u00a0b\x85c\u2003"
    assert one(text.words(F.lit(spaces))) == 3 and one(text.has_text(F.lit("\u2003\n"))) is False
    assert one(text.safe_label(F.lit(" \\\\host"), 9)) is None
    assert one(text.clean_text(F.lit(" a\x01 /home/me/x, C:\\t\\y "), "-", 50)) == "a [local path], [local path]"
    assert one(text.project_from_uri(F.lit("file:///w/my%20app"))) == "my app"
    assert one(text.project_from_file_uris(F.array(F.lit("http://a/b"), F.lit("file:///"), F.lit("file:///w/z")))) == "z"
    assert one(text.decode_directory(F.lit("a+b%2Fc"))) == "a+b/c" and one(text.decode_directory(F.lit("a%zz"))) == "a%zz"
    assert one(text.single_label(F.array(F.lit("m"), F.lit(" m "), F.lit("")))) == "m"
    assert one(times.parse_rfc3339(F.lit("2026-01-02"))) is None
    assert one(times.parse_rfc3339(F.lit("2026-01-02T03:04:05.123456789+02:00"))).isoformat() == "2026-01-02T01:04:05.123456"
    assert one(times.parse_json_time(F.lit("1000"))).timestamp() == 1 and one(times.from_millis(F.lit(0))) is None
    assert one(times.parse_local(F.lit("2026-01-02 03:04:05"), "+03:00")).hour == 0
    assert one(times.timezone_label("+03:00", F.lit(None))) == "Local time (UTC+03:00 at span start)"
    assert one(times.round1(F.lit(2.25))) == 2.3
    v = F.parse_json(F.lit('{"a": [1]}'))
    assert one(jsonx.present(v)) is True and one(jsonx.present(F.parse_json(F.lit("{}")))) is False
    assert one(jsonx.present(F.parse_json(F.lit("[]")), "[]")) is False
    assert one(views.heat_level(F.lit(1), F.lit(1))) == 8 and one(views.heat_level(F.lit(0), F.lit(5))) == 0
    marks = F.expr("array(named_struct('step', 1L, 'offset', 0L), named_struct('step', 2L, 'offset', 9L))")
    assert one(antigravity.offsets_fit(marks, F.lit(8))) is False and one(antigravity.offsets_fit(marks, F.lit(9))) is True


def test_views_edges(spark):
    none = spark.createDataFrame([], "date date, count long")
    span = spark.createDataFrame([(date(2024, 1, 3), date(2024, 1, 1))], "start date, end date")
    assert views.dense_calendar(none, span).count() == 3 and views.dense_calendar(none).count() == 0
    days = spark.createDataFrame([(date(2024, 1, 3), 4), (date(2024, 3, 20), 1)], "date date, count long")
    weeks = views.bucketize(views.dense_calendar(days)).orderBy("label").collect()
    assert weeks[0].label == date(2024, 1, 3) and weeks[1].label == date(2024, 1, 8) and len(weeks) == 12
    assert views.dominant_bucket(views.bucketize(views.dense_calendar(days))).collect()[0].label == date(2024, 1, 3)


def make_database(path, n=3000):
    import sqlite3

    con = sqlite3.connect(path)
    con.execute("PRAGMA journal_mode=WAL")
    con.execute("CREATE TABLE t (a INTEGER, b TEXT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(i, "x" * 200) for i in range(n)])
    con.commit()
    con.close()
    return str(path)


def test_sqlite_reads_whole_tables(spark, tmp_path):
    path = make_database(tmp_path / "50% off?#1.db")
    df = sqlite.read_table(spark, [str(tmp_path)], "t", "a bigint, missing string")
    assert df.agg(F.count("a"), F.sum("a"), F.count("missing")).collect()[0][:] == (3000, 4498500, 0)
    assert rows(df.select("path", "columns").distinct(), "path", "columns") == [(path, ["a", "b"])]
    filtered = sqlite.read_table(spark, [str(tmp_path)], "t", "a bigint", "a < 10")
    assert filtered.count() == 10 and sqlite.read_table(spark, [str(tmp_path)], "nope", "a bigint").count() == 0
    assert sqlite.read_table(spark, [str(tmp_path)], "t", "a bigint", "older = 1").count() == 0
    assert sqlite.read_table(spark, [], "t", "a bigint").count() == 0


def test_sqlite_gives_all_of_a_database_or_nothing(spark, tmp_path):
    sound, damaged = make_database(tmp_path / "sound.db"), make_database(tmp_path / "damaged.db")
    (tmp_path / "text.db").write_text("not a database")
    (tmp_path / "empty.db").write_bytes(b"")
    with open(damaged, "r+b") as handle:
        handle.seek(4096 * 40)
        handle.write(b"\xff" * 4096 * 3)
    assert rows(sqlite.read_table(spark, [str(tmp_path)], "t", "a bigint").groupBy("path").count()) == [(sound, 3000)]
    told = sqlite.table_columns(spark, [str(tmp_path)]).where("table_name IS NULL")
    assert {r.path.rsplit("/", 1)[1]: r.readable for r in told.collect()} == {
        "sound.db": True, "damaged.db": False, "text.db": False}  # Spark lists no empty files
    capped = sqlite.table_columns(spark, [sound], max_bytes=1000)
    assert rows(capped, "readable") == [(False,)]


def test_sqlite_through_another_file_system(spark, tmp_path):
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.lake.link./in", f"file://{tmp_path}")
    make_database(tmp_path / "a.db", 10)
    assert sqlite.read_table(spark, ["viewfs://lake/in/*.db"], "t", "a bigint").count() == 10


def test_copilot_store_with_a_damaged_page_is_unavailable(spark, store, lake):
    from tallyloom.sources import copilot

    for name in ("alice", "bob"):
        store.store = name
        store.database(
            "copilot/session-store.db", "CREATE TABLE sessions (id, cwd, created_at, updated_at)",
            "CREATE TABLE turns (session_id, turn_index, user_message, timestamp)",
            "INSERT INTO sessions VALUES ('s', '/w/app', '2026-04-01T08:00:00Z', '2026-04-01T08:30:00Z')",
            "WITH RECURSIVE n(i) AS (SELECT 0 UNION ALL SELECT i + 1 FROM n WHERE i < 2999) INSERT INTO turns "
            "SELECT 's', i, hex(zeroblob(60)), '2026-04-01T08:10:00Z' FROM n")
    with open(store.path("copilot/session-store.db"), "r+b") as handle:
        handle.seek(4096 * 30)
        handle.write(b"\xff" * 4096)
    tables = copilot.read(spark, lake)
    status = {r.store_id: r.status for r in tables.providers.collect()}
    assert status == {"alice": "supported", "bob": "unavailable"}
    assert rows(tables.prompts.groupBy("store_id").count()) == [("alice", 3000)]
    assert [(r.store_id, r.code) for r in tables.warnings.collect()] == [("bob", "sqlite_snapshot_failed")]
