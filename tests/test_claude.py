from __future__ import annotations

import pytest
from conftest import Store, of_store, rows, warned
from tallyloom.operators import metrics
from tallyloom.sources import claude
from tallyloom.sources.lake import DEFAULT_LAYOUT, LAZY, Lake


def user(uuid, session, at, content, **more):
    return {"type": "user", "uuid": uuid, "sessionId": session, "timestamp": at,
            "message": {"role": "user", "content": content}, **more}


def reply(call, session, at, model="claude-test", content=(), usage=None, **more):
    message = {"id": call, "role": "assistant", "model": model, "content": list(content)}
    if usage:
        message["usage"] = usage
    return {"type": "assistant", "sessionId": session, "timestamp": at, "message": message, **more}


def tool(name):
    return {"type": "tool_use", "id": name}


def provider(tables):
    return tables.providers.collect()[0]


def build_root_and_child(store):
    """Owner prompts among records that only look like them; a helper and a workflow below the same session."""
    at = "2025-09-12T17:{}Z".format
    home = "claude/projects/-home-mira-quilt"
    spent = {"input_tokens": 57, "output_tokens": 9, "cache_read_input_tokens": 12}
    store.lines(
        f"{home}/quilt.jsonl",
        user("ask", "quilt", at("00:00"), [{"type": "text", "text": "cut forty"}, {"type": "text", "text": "blue squares"}], cwd="/home/mira/quilt"),
        reply("r-1", "quilt", at("00:09"), content=[tool("measure"), tool("cut")], usage=spent),
        user("back", "quilt", at("00:10"), [{"type": "tool_result"}], sourceToolAssistantUUID="e", toolUseResult="fine"),
        reply("r-1", "quilt", at("00:11"), content=[tool("cut")], usage=spent),
        user("note", "quilt", at("00:12"), "reminder", isMeta=True), user("sum", "quilt", at("00:13"), "so far", isCompactSummary=True),
        user("seen", "quilt", at("00:14"), "shown only", isVisibleInTranscriptOnly=True),
        reply("r-2", "quilt", at("00:30"), content=[tool("press")], usage={"input_tokens": 3, "output_tokens": 1}),
        user("look", "quilt", at("41:00"), [{"type": "image", "source": {}}]))
    for name in ("agent-pins", "workflows/borders/agent-thread"):
        store.lines(f"{home}/quilt/subagents/{name}.jsonl",
                    user("do", "quilt", at("00:20"), "delegated work", agentId=name.rsplit("-", 1)[1], isSidechain=True))


def build_updates(store):
    """A reply that grows, one whose usage comes late under another model, and two with a synthetic record each."""
    kiln, at = "claude/projects/-srv-kiln", "2025-06-30T18:4{}:20Z".format

    def spent(out, thought=0):
        return {"input_tokens": 431, "output_tokens": out, "output_tokens_details": {"thinking_tokens": thought}}

    store.lines(f"{kiln}/glaze.jsonl", reply("stir", "glaze", at(1), content=[tool("sieve")], usage=spent(17, 6)),
                reply("stir", "glaze", at(2), content=[tool("pour")], usage=spent(40, 15)))
    store.lines(f"{kiln}/fire.jsonl", reply("heat", "fire", at(0), model="ember"),
                reply("heat", "fire", at(3), model="flame", usage=spent(12)))
    store.lines(f"{kiln}/cool.jsonl", reply("open", "cool", at(4), model="frost", usage=spent(7)),
                reply("open", "cool", at(5), model="<synthetic>", usage=spent(30)),
                reply("look", "cool", at(6), model="<synthetic>"), reply("look", "cool", at(7), model="frost"))


def build_history_and_state(store):
    """Two prompts only the history has, one it shares with a transcript, and a state file that knows one more session."""
    store.lines("claude/projects/-srv-well/well.jsonl", user("dig", "well", "2025-10-01T12:00:00Z", "dig deeper"))
    at = 1759320000000  # the same moment
    store.lines("claude/history.jsonl", *[
        {"display": text, "project": project, "sessionId": session, "timestamp": at + ms} for text, project, session, ms in (
            ("dig deeper", "/srv/well", "well", 0), ("draw a map", "/srv/spring", "spring", -86_400_000), ("and a key", "/srv/spring", "spring", -86_300_000))])
    store.doc("claude.json", {"projects": {name: {"lastSessionId": session} for name, session in (
        ("/srv/well", "well"), ("/srv/spring", "spring"), ("/srv/pond", "pond"))}})


def build_copied_prompt_consumes_history(store):
    """A transcript that holds another session's records only: its prompts answer for that session's history."""
    at = "2025-11-08T10:00:{}Z".format
    store.lines("claude/projects/-srv-mill/after.jsonl",
                user("grind", "before", at("00"), "grind the rye"), reply("flour", "before", at("05"), content=[tool("stone")],
                                                                       usage={"input_tokens": 21, "output_tokens": 4}),
                user("sift", "before", at("30"), "sift it twice"))
    store.lines("claude/history.jsonl", *[
        {"display": "x", "project": "/srv/mill", "sessionId": session, "timestamp": 1762596000000 + ms}
        for session, ms in (("before", 0), ("before", 30_000), ("after", 7_200_000))])


def build_indexes_are_evidence_only(store):
    """Every index names sessions; none of them becomes one."""
    store.lines("claude/projects/-srv-tower/bell.jsonl", user("ring", "bell", "2025-04-04T04:04:04Z", "ring it"))
    store.doc("claude/projects/-srv-tower/sessions-index.json", {"version": 1, "entries": [
        {"sessionId": "bell", "created": "2025-04-04T04:04:00Z"}, {"sessionId": "clapper", "created": "2025-02-03T10:20:30Z"}, {"created": "?"}]})
    store.doc("claude-code-sessions/org/user/local_1.json", {
        "cliSessionId": "bell", "priorCliSessionIds": ["rope", "wheel"], "createdAt": 1743739440000, "lastActivityAt": 1743739500000,
        "bridgeSessionIds": ["session_tower"]})
    store.doc("claude/stats-cache.json", {"firstSessionDate": "2025-01-15T08:00:00Z"})
    store.lines("claude-desktop/a/b/claude/projects/-srv/clock.jsonl", user("t", "clock", "2025-03-01T00:00:00Z", "what time is it"))


def build_loss_warnings(store):
    """Records that lost their time, their text or their id, lines that are no records, and a file without any time."""
    lamp = "claude/projects/-srv-lamp"
    store.lines(
        f"{lamp}/keeper.jsonl",
        reply("oil", "keeper", "2025-08-19T03:20:00Z", content=[{"type": "tool_use"}, tool("can")]),
        "[1, 2", user(None, "keeper", "2025-08-19T03:15:00Z", "trim the wick"),
        reply("soot", "keeper", "2025-08-19T03:31:00Z", content=[tool("can")]),
        {"type": "assistant", "sessionId": "keeper", "timestamp": "later", "message": {"role": "assistant", "model": "beam", "content": "?"}},
        '{"type": "user", "isMeta": "perhaps"}', user(None, "keeper", "yesterday", {"shape": 7}))
    store.lines(f"{lamp}/fog.jsonl", user("horn", "fog", "soon", "sound the horn"))
    store.lines(f"{lamp}/boat.jsonl", user("row", "boat", "2025-08-20T04:00:00Z", "row out", isSidechain=True))


def build_copies_across_homes(store):
    """A session copied to another home and continued there, its helper in both, and a history kept twice."""
    quay = "projects/-srv-quay"
    ask = user("load", "ferry", "2025-05-09T07:10:00Z", "load the crates")
    store.lines(f"claude/{quay}/ferry.jsonl", ask, reply("deck", "ferry", "2025-05-09T07:11:00Z", content=[tool("crane")],
                                                       usage={"input_tokens": 140, "output_tokens": 31}))
    store.lines(f"extra/{quay}/ferry.jsonl", ask, reply("deck", "ferry", "2025-05-09T07:12:30Z", content=[tool("ramp")],
                                                      usage={"input_tokens": 140, "output_tokens": 52}),
                user("sail", "ferry", "2025-05-11T06:00:00Z", "sail at high tide"),
                reply("cast", "ferry", "2025-05-11T06:02:00Z", usage={"input_tokens": 66, "output_tokens": 9}))
    seen, other = ({"sessionId": "pier", "timestamp": 1746000000000, "display": text} for text in ("again", "once"))
    for home, kept in (("claude", [seen, seen]), ("extra", [other, seen, seen])):
        store.lines(f"{home}/history.jsonl", *kept)
        store.lines(f"{home}/{quay}/ferry/subagents/workflows/moor/agent-rope.jsonl",
                    user("tie", "ferry", "2025-05-09T07:15:00Z", "tie her up", agentId="rope", isSidechain=True))


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("claude"))
    for name, build in globals().items():
        if name.startswith("build_"):
            build(Store(base, name.removeprefix("build_")))
    layout = {**DEFAULT_LAYOUT, "claude_projects": ("claude/projects", "extra/projects"),
              "claude_history": ("claude/history.jsonl", "extra/history.jsonl")}
    return claude.read(spark, Lake(base, layout))


def test_root_and_child(read):
    t = of_store(read, "root_and_child")
    got = {r.session_id: r for r in t.sessions.collect()}
    assert set(got) == {"quilt", "pins", "thread"} and got["quilt"].project == "quilt"
    assert all(got[x].is_child and got[x].parent_id == "quilt" for x in ("pins", "thread"))
    prompts = rows(t.prompts.where("not is_child"), "event_id", "words", "has_text")
    assert sorted(prompts) == [("ask", 4, True), ("look", 0, False)]
    calls = rows(t.calls.where("not is_child"), "call_id", "usage.input", "usage.cache_read")
    assert sorted(calls) == [("r-1", 57, 12), ("r-2", 3, 0)]
    assert rows(metrics.distinct_tools(t.tools), "tools") == [(3,)]
    w = warned(t)
    assert w["meta_prompts_excluded"] == 1 and w["tool_result_prompts_excluded"] == 1
    assert w["transcript_only_prompts_excluded"] == 1 and w["assistant_updates_merged"] == 1
    assert w["duplicate_tool_use"] == 1 and "assistant_usage_advanced" not in w
    p = provider(t)
    assert p.source_files == 3 and p.status == "supported with warnings"


def test_updates(read):
    t = of_store(read, "updates")
    got = {r.call_id: r for r in t.calls.collect()}
    assert (got["stir"].usage.output, got["stir"].usage.reasoning) == (40, 15)
    assert got["heat"].model == "flame" and got["heat"].usage.input == 431
    assert got["open"].model == "frost" and got["open"].usage.output == 30
    assert got["look"].model == "frost" and not got["look"].usage.available
    w = warned(t)
    assert w["assistant_usage_advanced"] == 2 and w["assistant_usage_completed"] == 1
    assert w["assistant_update_model_conflict"] == 1 and w["synthetic_model_records_excluded"] == 2
    assert rows(metrics.distinct_tools(t.tools), "tools") == [(2,)]


def test_history_and_state(read):
    t = of_store(read, "history_and_state")
    p, w = provider(t), warned(t)
    assert sorted(rows(t.prompts, "session_id", "words")) == [("spring", 3), ("spring", 3), ("well", 2)]
    assert (p.history_only_sessions, p.unmaterialized_sessions, p.coverage_status) == (1, 1, "known incomplete")
    assert w["history_records_reconciled"] == 1 and w["global_state_only_sessions"] == 1


def test_copied_prompt_consumes_history(read):
    t = of_store(read, "copied_prompt_consumes_history")
    w, p = warned(t), provider(t)
    assert w["copied_history_prompt_records_reconciled"] == 2 and w["unanchored_session"] == 1
    assert p.history_only_sessions == 2 and p.unmaterialized_sessions == 0
    counts = metrics.session_counts(t.sessions).collect()[0]
    assert counts.sessions == 2 and counts.projects == 1
    assert metrics.distinct_prompts(t.prompts).count() == t.prompts.count() == 3


def test_indexes_are_evidence_only(read):
    t = of_store(read, "indexes_are_evidence_only")
    w, p = warned(t), provider(t)
    assert [r.session_id for r in t.sessions.collect()] == ["bell"] and p.unmaterialized_sessions == 3
    assert w["code_session_index_reconciled"] == 1 and w["code_session_index_unmaterialized"] == 2
    assert w["desktop_session_references_unmapped"] == 1 and w["project_index_only_sessions"] == 1
    assert w["malformed_project_session_index"] == 1 and w["desktop_local_agent_sessions_excluded"] == 1
    assert w["aggregate_history_predates_detail"] == 1
    assert p.earliest_local_evidence.isoformat() == "2025-01-15T08:00:00"


def test_loss_warnings(read):
    t = of_store(read, "loss_warnings")
    w = warned(t)
    for code, n in {"invalid_record_timestamp": 3, "unparseable_owner_prompt": 1, "unparseable_assistant_content": 1,
                    "owner_prompt_missing_id": 1, "assistant_response_missing_id": 1, "tool_use_missing_id": 1,
                    "duplicate_tool_use": 1, "malformed_record": 2, "physical_session_time_unavailable": 1}.items():
        assert w[code] == n, (code, w)
    counts = metrics.session_counts(t.sessions).collect()[0]
    assert counts.sessions == 2 and counts.child_sessions == 1


def test_copies_across_homes(read):
    t = of_store(read, "copies_across_homes")
    w = warned(t)
    assert w["copied_session_files_coalesced"] == 3
    # one prompt of the root copy, one of the child copy, two of the history copy
    assert w["copied_session_prompt_records"] == 4
    assert w["copied_session_response_records"] == 1
    counts = metrics.session_counts(t.sessions).collect()[0]
    assert counts.sessions == 2 and counts.child_sessions == 1
    calls = metrics.distinct_calls(t.calls)
    assert metrics.token_ledger(t.sessions, calls).collect()[0].output == 61
    assert rows(metrics.distinct_tools(t.tools), "tools") == [(2,)]
    assert metrics.distinct_prompts(t.prompts).count() == 5


def test_merge_calls_matches_a_fold(spark):
    """Random copies against the ordered fold, one record at a time."""
    import random

    from tallyloom.operators import copies
    from tallyloom.schemas import USAGE
    from tallyloom.sources.lake import LINE_KEY

    rnd = random.Random(5)
    data, expected, conflict = [], {}, [0, 0]
    for call in range(60):
        state = None
        for n in range(rnd.randint(1, 6)):
            model = rnd.choice([None, "a", "a", "b"])
            ready = rnd.random() < 0.8
            u = (True, True, rnd.choice([1, 1, 1, 2]), rnd.randint(0, 4), 0, 0, rnd.randint(0, 2), "s") if ready \
                else (False, False, 0, 0, 0, 0, 0, "")
            data.append(("s", "claude", "k", f"c{call}", ("p", 0, n), model, u))

            def grows(x, y):
                return x[0] and y[0] and x[2] == y[2] and y[3] >= x[3] and y[6] >= x[6]

            if state is None:
                state = [model, u]
                continue
            clash = state[0] and model and state[0] != model
            if ready and not clash:
                if not state[1][0] or grows(state[1], u):
                    state[1] = u
                elif state[1] != u and not grows(u, state[1]):
                    conflict[0] += 1
            if not state[0]:
                state[0] = model
            elif model and state[0] != model:
                conflict[1] += 1
        expected[f"c{call}"] = tuple(state)
    schema = ("store_id string, harness string, session_key string, call_id string, "
              f"line_key {LINE_KEY}, model string, usage {USAGE}")
    merged, conflicts = copies.merge_calls(spark.createDataFrame(data, schema).repartition(7))
    got = {r.call_id: (r.model, tuple(r.usage)) for r in merged.collect()}
    assert got == expected
    row = conflicts.collect()[0]
    assert [row.usage_conflicts, row.model_conflicts] == conflict
    assert LAZY.folder is None
