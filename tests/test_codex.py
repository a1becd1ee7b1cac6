from __future__ import annotations

import json

import pytest
from conftest import Store, of_store, rows, warned
from tallyloom.sources import codex
from tallyloom.sources.lake import Lake


def meta(ident, at, **payload):
    ordinal = payload.pop("ordinal", None)
    out = {"timestamp": at, "type": "session_meta", "payload": {"id": ident, "session_id": ident, **payload}}
    return {"ordinal": ordinal, **out} if ordinal is not None else out


def item(ident, at, body, ordinal=None):
    out = {"timestamp": at, "type": "event_msg", "payload": {"type": "item_completed", "item": {
        "type": "UserMessage", "id": ident, "content": [{"type": "input_text", "text": body}]}}}
    return {"ordinal": ordinal, **out} if ordinal is not None else out


def tokens(at, ordinal=None, **counts):
    out = {"timestamp": at, "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": counts}}}
    return {"ordinal": ordinal, **out} if ordinal is not None else out


def event(at, kind, **payload):
    return {"timestamp": at, "type": kind, "payload": payload}


def build_modes(store):
    """A legacy thread with replies, commands and injected text, its helper, and a paginated thread with a repeat."""
    at = "2025-06-14T09:{}Z".format
    day = "codex/archived_sessions/2025/06/14"
    store.lines(f"{day}/rollout-a.jsonl",
                meta("orchard", at("00:00"), cwd="/home/mira/orchard survey", history_mode="legacy"),
                event(at("00:05"), "turn_context", turn_id="t1", model="pomme"),
                event(at("00:06"), "event_msg", type="user_message", message="<environment_context>\n<cwd>/</cwd>"),
                event(at("00:07"), "event_msg", type="user_message", message="count trees\nper row, please", images=["a.png"]),
                event(at("00:20"), "response_item", type="function_call", call_id="shell-1"),
                event(at("00:21"), "response_item", type="function_call_output", call_id="shell-1"),
                event(at("00:30"), "response_item", type="custom_tool_call", call_id="edit-1"),
                tokens(at("00:40"), input_tokens=310, cached_input_tokens=40, output_tokens=22, total_tokens=332),
                event(at("01:00"), "turn_context", turn_id="t2", model="poire"),
                event(at("01:01"), "event_msg", type="user_message", message="and the pears?"),
                tokens(at("01:30"), input_tokens=575, cached_input_tokens=90, output_tokens=61, total_tokens=636))
    store.lines(f"{day}/rollout-b.jsonl",
                event(at("00:22"), "session_meta", id="helper", session_id="orchard", parent_thread_id="orchard"),
                event(at("00:29"), "turn_context", turn_id="h1", model="pomme"))
    store.lines("codex/recovery/rollout-c.jsonl",
                meta("hedge", at("30:00"), history_mode="paginated"),
                item("ask", at("30:04"), "trim it to one metre"), item("ask", at("30:04"), "trim it to one metre"),
                item("more", at("30:50"), ""), event(at("31:00"), "event_msg", type="user_message", message="other mode"))


def build_chain(store):
    """Three segments that continue each other, each cut inside the one before; archives and copies beside them."""
    def opens(at, ordinal, offset=None):
        base = {} if offset is None else {"history_base": {
            "thread_id": "canal", "end_byte_offset": offset, "end_ordinal_exclusive": ordinal}}
        return meta("canal", at, history_mode="paginated", ordinal=ordinal, **base)

    def size(items):
        return sum(len(json.dumps(x)) + 1 for x in items)

    kept1 = [opens("2025-07-01T06:00:00Z", 0), item("lock one", "2025-07-01T06:01:00Z", "open the lower gate now", 1),
             tokens("2025-07-01T06:02:00Z", 2, input_tokens=30, output_tokens=3, total_tokens=33)]
    cut1 = [item("dropped", "2025-07-01T06:03:00Z", "wait", 3), tokens("2025-07-01T06:04:00Z", 4, input_tokens=99, total_tokens=99)]
    kept2 = [opens("2025-07-02T06:00:00Z", 3, size(kept1)), item("lock two", "2025-07-02T06:01:00Z", "fill the chamber", 4)]
    cut2 = [item("dropped too", "2025-07-02T06:05:00Z", "stop", 5)]
    last = [opens("2025-07-03T06:00:00Z", 5, size(kept2)), item("lock three", "2025-07-03T06:01:00Z", "moor", 6),
            tokens("2025-07-03T06:02:00Z", 7, input_tokens=11, output_tokens=2, total_tokens=13)]
    files = {"sessions/rollout-1": kept1 + cut1, "sessions/rollout-2": kept2 + cut2, "sessions/rollout-3": last,
             "recovery/rollout-2-again": kept2 + cut2}
    for rel, data in files.items():
        store.lines(f"codex/{rel}.jsonl", *data)


def build_lone(store):
    """Segments whose base is missing, or ends in the middle of a line."""
    store.lines("codex/sessions/rollout-adrift.jsonl",
                meta("adrift", "2025-07-05T10:00:00Z", history_mode="paginated", ordinal=40, history_base={
                    "thread_id": "adrift", "end_byte_offset": 900, "end_ordinal_exclusive": 40}))
    store.lines("codex/sessions/rollout-e1.jsonl", meta("eddy", "2025-07-06T10:00:00Z", history_mode="paginated", ordinal=0),
                item("first", "2025-07-06T10:00:30Z", "left bank", 1))
    store.lines("codex/sessions/rollout-e2.jsonl",
                meta("eddy", "2025-07-06T11:00:00Z", history_mode="paginated", ordinal=2, history_base={
                    "thread_id": "eddy", "end_byte_offset": 33, "end_ordinal_exclusive": 2}),
                item("second", "2025-07-06T11:00:30Z", "right bank", 3), item("third", "2025-07-06T11:00:40Z", "midstream", 4))


def build_history(store):
    """Prompt history, indexes and databases that know more sessions than there are rollouts."""
    at = 1750000000
    store.lines("codex/sessions/rollout-known.jsonl", meta("known", "2025-06-15T15:06:00Z"),
                event("2025-06-15T15:06:40Z", "event_msg", type="user_message", message="hello there"))
    store.lines("codex/history.jsonl", {"session_id": "known", "text": "hello there", "ts": at},
                {"session_id": "old", "text": "before all that", "ts": at - 900_000},
                {"session_id": "old", "text": "", "ts": at - 800_000}, {"session_id": None, "text": "x", "ts": at}, {"text": "y"})
    store.lines("codex/session_index.jsonl", {"id": "known", "updated_at": "2025-06-15T15:10:00Z"},
                {"id": "paper", "updated_at": "2025-05-20T08:00:00+02:00"}, {"id": "", "updated_at": "2025-05-20T08:00:00Z"},
                {"id": "scrap", "updated_at": "May"})
    store.doc("codex/external_imports.json", {"records": [
        {"source_path": "", "imported_thread_id": "moved", "imported_at": at - 5_000}, {"source_path": "/old/a"}, {"source_path": "/old/b"}]})
    here = f"{store.base}/{store.store}/codex/sessions"
    store.database("codex/state.sqlite",
                   "CREATE TABLE threads (id TEXT, rollout_path TEXT, created_at INTEGER, created_at_ms INTEGER)",
                   *[("INSERT INTO threads VALUES (?, ?, ?, ?)", row) for row in (
                       ("known", f"{here}/rollout-known.jsonl", at, None), ("lost", f"{here}/2024/rollout-lost.jsonl", at - 70, None),
                       ("lost too", f"{here}/rollout-lost-too.jsonl", None, (at - 80) * 1000), ("abroad", "/mnt/backup/rollout-z.jsonl", at, None))])
    store.database("codex/catalog.sqlite",
                   "CREATE TABLE local_thread_catalog (thread_id TEXT, source_created_at REAL, host_id TEXT)",
                   "CREATE TABLE local_thread_catalog_hosts (host_id TEXT, host_kind TEXT)",
                   f"INSERT INTO local_thread_catalog VALUES ('here', {at - 3_000_000}.25, 'desk'), ('there', 9, 'web'), ('elsewhere', 9, 'web 2'), ('odd', 9, 'none')",
                   "INSERT INTO local_thread_catalog_hosts VALUES ('desk', 'local'), ('web', 'chatgpt'), ('web 2', 'chatgpt'), ('ssh', 'ssh')")


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("codex"))
    for name, build in globals().items():
        if name.startswith("build_"):
            build(Store(base, name.removeprefix("build_")))
    return codex.read(spark, Lake(base))


def test_modes(read):
    t = of_store(read, "modes")
    got = {r.session_id: r for r in t.sessions.collect()}
    assert set(got) == {"orchard", "helper", "hedge"}
    orchard, helper = got["orchard"], got["helper"]
    assert orchard.project == "orchard survey" and not orchard.is_child and orchard.tool_calls == 2
    assert (orchard.usage.output, orchard.usage.cache_read) == (61, 90) and orchard.usage.available
    assert helper.is_child and helper.parent_id == "orchard"
    assert (helper.started_at.isoformat(), helper.ended_at.isoformat()) == ("2025-06-14T09:00:22", "2025-06-14T09:00:29")
    sizes = rows(t.prompts.where("has_text"), "session_id", "words")
    assert sorted(sizes) == [("hedge", 5), ("orchard", 3), ("orchard", 5)]
    assert warned(t)["duplicate_prompt_event"] == 1
    assert sorted(rows(t.model_activity.where("not is_child"), "model", "turns")) == [("poire", 1), ("pomme", 1)]


def test_chain(read):
    t = of_store(read, "chain")
    assert rows(t.sessions, "session_id", "usage.input", "usage.output") == [("canal", 41, 5)]
    assert sorted(r[0] for r in rows(t.prompts, "event_id")) == ["lock one", "lock three", "lock two"]
    w = warned(t)
    assert w["stitched_history_segments"] == 2 and w["identical_rollout_copy_suppressed"] == 1
    assert "ambiguous_history_chain_suppressed" not in w and "unvalidated_same_id_rollout_suppressed" not in w
    assert t.providers.collect()[0].source_files == 4


def test_lone(read):
    t = of_store(read, "lone")
    w = warned(t)
    assert w["missing_history_base"] == 1 and w["ambiguous_history_chain_suppressed"] == 1
    assert w["unvalidated_same_id_rollout_suppressed"] == 1
    assert t.providers.collect()[0].coverage_status == "known incomplete"
    assert sorted(r[0] for r in rows(t.prompts.where("session_id = 'eddy'"), "event_id")) == ["second", "third"]


def test_history(read):
    t = of_store(read, "history")
    p, w = t.providers.collect()[0], warned(t)
    assert t.sessions.count() == 2 and p.history_only_sessions == 1
    assert p.unmaterialized_sessions == 6  # paper, moved, lost, lost too, abroad, here
    assert w["history_records_reconciled"] == 1 and w["malformed_history_record"] == 2
    assert w["index_only_sessions"] == 1 and w["malformed_session_index_record"] == 2
    assert w["external_import_source_references"] == 2 and w["unmaterialized_import_sessions"] == 1
    assert w["state_only_sessions"] == 3 and w["missing_state_rollout_paths"] == 2
    assert w["state_rollouts_outside_configured_roots"] == 1 and "existing_state_rollouts_not_discovered" not in w
    assert w["remote_catalog_sessions_excluded"] == 2 and w["account_workspace_catalogs"] == 2
    assert w["local_catalog_only_sessions"] == 1
    assert p.earliest_local_evidence.timestamp() == 1747000000.25
    assert all(r[0].startswith("history:old:") for r in rows(t.prompts, "event_id") if r[0])


def test_one_damaged_archive_among_good_ones(spark, store, lake):
    """A cut file and a file with a changed byte have no lines and are counted; the other one is read whole."""
    import zstandard

    from tallyloom.sources.lake import scan_lines, unreadable_files

    lines = "".join(f'{{"type":"note","number":{i},"filler":"{"ab" * (i % 50)}"}}\n' for i in range(5000)).encode()
    good = zstandard.ZstdCompressor(write_checksum=True).compress(lines)
    bad = bytearray(good)
    bad[len(bad) // 2] ^= 255
    for name, data in (("rollout-good", good), ("rollout-cut", good[:-40]), ("rollout-bad", bytes(bad)), ("rollout-two", good + good)):
        with open(store.path(f"codex/sessions/{name}.jsonl.zst"), "wb") as handle:
            handle.write(data)
    store.lines("codex/sessions/rollout-plain.jsonl", "{}")
    got = scan_lines(spark, lake, "codex_rollouts", "rollout-*").groupBy("rel").count().collect()
    assert {r.rel: r["count"] for r in got} == {
        "rollout-good.jsonl.zst": 5000, "rollout-two.jsonl.zst": 10000, "rollout-plain.jsonl": 1}
    bad = unreadable_files(spark, lake, "codex_rollouts", "rollout-*").collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in bad) == ["rollout-bad.jsonl.zst", "rollout-cut.jsonl.zst"]
    assert codex.read(spark, lake).warnings.where("code = 'unreadable_file'").collect()[0].n == 2


def test_fold_runs_once(spark, store, lake, tmp_path):
    """The fold over the files of an id is staged: no table that is made from its winners runs it again."""
    from tallyloom.sources.lake import Stage

    build_modes(store)
    t = codex.read(spark, lake, Stage(str(tmp_path / "stage")))
    assert "MapInArrow" not in t.model_activity._jdf.queryExecution().toString()
