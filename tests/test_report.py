from __future__ import annotations

import json
import os
from datetime import datetime, timezone

import pytest
from conftest import Store, rows
from tallyloom.operators import audit
from tallyloom.plans import ingest, report
from tallyloom.schemas import FORBIDDEN_COLUMNS, SCHEMAS, conform, tables
from tallyloom.sources.lake import Lake

NO = (False, False, 0, 0, 0, 0, 0, "")


def at(text):
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def session(sid, start, end=None, harness="claude", project=None, basis="recorded", **more):
    return {"store_id": "s", "harness": harness, "session_key": sid, "session_id": sid, "is_child": False,
            "started_at": start and at(start), "ended_at": end and at(end), "activity_at": start and at(start),
            "activity_basis": basis, "project": project, "tool_calls": 0, "usage": NO, "has_calls": False,
            "unanchored": False, "history_only": False, "time_unavailable": False, **more}


def event(sid, start, ident, harness="claude", n=0, **more):
    return {"store_id": "s", "harness": harness, "session_key": sid, "session_id": sid, "is_child": False,
            "session_at": start and at(start), "ord": (0, 0, n), **more}


def make(spark, **data):
    from pyspark.sql import types as T

    def frame(name):
        schema = spark.createDataFrame([], SCHEMAS[name]).schema
        def fill(row, s):
            return tuple(row.get(f.name) for f in s.fields)
        return spark.createDataFrame([fill(r, schema) for r in data.get(name, [])], T.StructType(schema.fields))
    return tables(spark, **{name: frame(name) for name in SCHEMAS})


def prompt(sid, start, ident, words, **more):
    return event(sid, start, ident, event_id=ident, words=words, characters=words * 5, has_text=True, **more)


def test_dedupe_zone_and_style(spark):
    """Duplicate prompt and call ids; +03:00 shifts the day; median of an even count."""
    one, two = "2025-12-31T22:30:00", "2026-01-01T10:00:00"
    used = (True, True, 100, 10, 0, 0, 0, "message.usage")
    t = make(spark,
             sessions=[session("a", one, "2025-12-31T23:30:00", project="project", has_calls=True),
                       session("b", two, "2026-01-01T10:20:00", project="Project", has_calls=True),
                       session("kid", two, is_child=True),
                       session("mtime", "2020-01-01T00:00:00", basis="file modification time (x)", unanchored=True),
                       session("untimed", None, project="late", time_unavailable=True)],
             prompts=[prompt("a", one, "p1", 2), prompt("b", two, "p1", 9), prompt("b", two, "p2", 3, n=1),
                      prompt("kid", two, "p9", 50, is_child=True)],
             calls=[event("a", one, "c", call_id="c1", model="m", usage=used), event("b", two, "c", call_id="c1", model="m2", usage=used)],
             tools=[event("a", one, "t", tool_id="t1"), event("b", two, "t", tool_id="t1"), event("b", two, "t", tool_id=None)],
             providers=[{"store_id": "s", "harness": "claude", "status": "supported", "tool_calls_available": True, "source_files": 3}])
    doc = report.build(t, report.Options(zone="+03:00", now=at("2026-02-01T00:00:00"))).collect()[0].asDict(recursive=True)
    claude = next(p for p in doc["providers"] if p["id"] == "claude")
    assert (claude["sessions"], claude["child_sessions"], claude["prompts"], claude["tool_calls"]) == (3, 1, 2, 2)
    assert claude["token_usage"]["input"] == 100 and claude["projects"] == 3
    assert doc["models"] == [{"harness": "claude", "name": "m", "turns": 1}]
    assert doc["projects"] == [{"name": "late", "sessions": 1}, {"name": "Project", "sessions": 1}, {"name": "project", "sessions": 1}]
    assert [d["date"] for d in doc["rhythm"]["activity"]] == ["2026-01-01"]
    assert doc["rhythm"]["hours"][1] == 1 and doc["rhythm"]["hours"][13] == 1 and doc["rhythm"]["favorite_hour"] == 1
    assert doc["prompt_style"]["median_words"] == 2.5 and doc["prompt_style"]["label"] == "terse operator"
    assert doc["longest_session"] == {"available": True, "harness": "claude", "duration_minutes": 60}
    assert doc["totals"]["sessions"] == 3 and doc["totals"]["active_days"] == 1 and doc["totals"]["source_files"] == 3
    assert len(doc["providers"]) == 12 and doc["providers"][0]["id"] == "aider"
    assert next(p for p in doc["providers"] if p["id"] == "grok")["status"] == "not found"
    assert doc["coverage"]["label"] == "Jan 1 — Jan 1, 2026"
    # lists are whole, or left out by choice
    bare = report.build(t, report.Options(inline_lists=False)).collect()[0]
    assert bare.projects is None and bare.models is None


def test_unanchored_donates_only_events(spark):
    one = "2026-01-01T00:00:00"
    t = make(spark, sessions=[session("u", one, unanchored=True, has_calls=True, project="x")],
             prompts=[prompt("u", one, "p", 4)],
             calls=[event("u", one, "c", call_id="c", model="m", usage=(True, True, 7, 3, 0, 0, 0, "u"))])
    doc = report.build(t).collect()[0]
    claude = next(p for p in doc.providers if p.id == "claude")
    assert (claude.sessions, claude.prompts, claude.projects, claude.token_usage.input) == (0, 1, 0, 7)
    assert doc.totals.active_days == 0 and doc.coverage.label == "No local history found"
    assert not doc.longest_session.available


def test_full_year_label(spark):
    t = make(spark, sessions=[session("a", "2025-01-03T00:00:00", "2025-01-03T01:00:00"),
                              session("b", "2025-12-28T00:00:00", "2025-12-28T01:00:00")])
    doc = report.build(t).collect()[0]
    assert doc.coverage.label == "2025" and doc.coverage.calendar_framing
    assert doc.rhythm.longest_streak == 1 and doc.rhythm.busiest_month.label == "Jan 2025"


@pytest.fixture(scope="module")
def lake(tmp_path_factory):
    base = str(tmp_path_factory.mktemp("lake"))
    s = Store(base)
    s.lines("grok/sessions/app/prompt_history.jsonl",
            {"prompt": "a secret prompt", "session_id": "one", "timestamp": "2026-09-20T10:00:00Z"})
    s.doc("aider/repo/aider.chat.history.md", "# aider chat started at 2026-10-20 10:00:00\n\n#### another secret  \n")
    return Lake(base)


def test_end_to_end(spark, lake, tmp_path):
    t = ingest.run(spark, lake, str(tmp_path / "tables"), ["grok", "aider"])
    root = str(tmp_path / "report")
    report.write(t, root, report.Options(observation="disabled"))
    name = next(n for n in os.listdir(f"{root}/document") if n.startswith("part-"))
    text = open(f"{root}/document/{name}").read()
    doc = json.loads(text)
    assert doc["schema_version"] == 3 and doc["totals"]["sessions"] == 2 and doc["totals"]["prompts"] == 2
    assert "secret" not in text and lake.base not in text and '"one"' not in text
    # a rerun of one harness replaces only its partition
    ingest.run(spark, lake, str(tmp_path / "tables"), ["aider"])
    assert ingest.load_tables(spark, str(tmp_path / "tables")).sessions.count() == 2


def test_a_harness_that_disappears_leaves_no_rows(spark, lake, tmp_path):
    out = str(tmp_path / "tables")
    ingest.run(spark, lake, out, ["grok", "aider"])
    gone = ingest.run(spark, Lake(str(tmp_path / "nothing")), out, ["aider"])
    for name, df in gone.named().items():
        assert not df.where("harness = 'aider'").take(1), name
    assert gone.sessions.where("harness = 'grok'").count() > 0
    assert not [n for n in os.listdir(out) if n.startswith("_new")]


def test_byte_limits_are_a_choice(spark, store):
    from tallyloom.sources import grok
    from tallyloom.sources.lake import byte_limit

    store.lines("grok/sessions/a/prompt_history.jsonl", {"session_id": "long", "prompt": "y" * (1 << 20)}, {"session_id": "short", "prompt": "y"})

    def read():
        t = grok.read(spark, Lake(store.base))
        return t.prompts.count(), {r.code: r.n for r in t.warnings.collect()}

    assert read() == (2, {})
    spark.conf.set("tallyloom.byteLimits", "reference")
    try:
        assert read() == (1, {"oversize_prompt_record": 1})
        spark.conf.set("tallyloom.byteLimits", "77")
        assert byte_limit(spark, 5) == 77
    finally:
        spark.conf.unset("tallyloom.byteLimits")


def test_overlapping_roots_are_read_once(spark, store):
    from tallyloom.sources.lake import list_files, scan_lines

    store.lines("claude/projects/a/one.jsonl", "{}", "{}")
    twice = Lake(store.base, {"claude_projects": ("claude/projects", "claude/projects/a", "claude/projects", "claude/other")})
    assert scan_lines(spark, twice, "claude_projects").count() == 2
    assert [r.rel for r in list_files(spark, twice, "claude_projects").collect()] == ["a/one.jsonl"]


def test_an_error_outside_the_files_fails_the_job(spark, lake, monkeypatch):
    def boom(*_):
        raise OSError("unreachable")
    monkeypatch.setitem(ingest.READERS, "grok", boom)
    with pytest.raises(OSError):
        ingest.read_all(spark, lake, ["grok", "aider"])


def test_published_tables_carry_no_text(spark):
    for name in SCHEMAS:
        df = spark.createDataFrame([], SCHEMAS[name])
        assert not FORBIDDEN_COLUMNS & set(df.columns)
        assert conform(df, name).schema == df.schema


def test_manifest(spark, tmp_path):
    root = tmp_path / "src"
    (root / "sub").mkdir(parents=True)
    (root / "a.db").write_text("one")
    (root / "sub" / "b.jsonl").write_text("two")
    expected = spark.createDataFrame([(f"file:{root}/a.db", True), (f"file:{root}/sub/b.jsonl", True),
                                      (f"file:{root}/later.json", False)], "path string, required boolean")

    def snapshot():
        hashed = audit.hash_files(spark, str(root))
        return (spark.createDataFrame(audit.file_manifest(audit.with_sidecars(expected), hashed).collect(),
                                      "path string, exists boolean, sha256 string, size long, complete boolean"),
                spark.createDataFrame(audit.directory_inventory(audit.list_files(spark, str(root))).collect(),
                                      "path string, entries long, digest string"))

    before, dirs = snapshot()
    same, same_dirs = snapshot()
    row = audit.compare(before, same, dirs, same_dirs).collect()[0]
    assert row.verified and row.files == 2 and row.changed_files == 0
    assert {r.path: r.exists for r in before.collect()}[f"file:{root}/a.db-wal"] is False
    (root / "later.json").write_text("{}")
    (root / "a.db").write_text("changed")
    after, dirs_after = snapshot()
    row = audit.compare(before, after, dirs, dirs_after).collect()[0]
    assert not row.verified and row.changed_files == 2 and row.directory_changes == 1
    lost = audit.file_manifest(expected.withColumn("required", expected.required | True), audit.hash_files(spark, str(root / "sub")))
    assert sorted(r.complete for r in lost.collect()) == [False, False, True]
    import hashlib

    digests = list(audit._stream_digests(iter([__import__("pandas").DataFrame({"path": [f"file:{root}/a.db"], "size": [7]})])))
    assert digests[0].sha256[0] == hashlib.sha256(b"changed").hexdigest()
    assert audit.stable_listing(spark, str(root))[1]
    assert [audit.observation(*x) for x in ((False, False, True), (True, False, True), (True, True, True))] == \
        ["disabled", "observed", "unavailable"]
