from __future__ import annotations

import json

import pytest
from conftest import Store, of_store, rows, warned
from tallyloom.sources import aider, antigravity, continuedev, copilot, cursor, gemini, grok, hermes, tasks
from tallyloom.sources.lake import Lake


@pytest.fixture
def base(tmp_path):
    return str(tmp_path)


def provider(t):
    return t.providers.collect()[0]


def test_grok(spark, base):
    """Two folders; the first prompt of a session is not its earliest; seconds as text."""
    s = Store(base)
    s.lines("grok/sessions/%2Fsrv%2Fwork%2Fkiln%20log/prompt_history.jsonl",
            {"session_id": "firing", "prompt": "raise the ramp rate", "timestamp": "2025-03-09T06:15:00+02:00"},
            {"session_id": "firing", "prompt": "make flash", "is_bash": True, "timestamp": "2025-03-09T03:58:30Z"}, "",
            {"session_id": "firing", "prompt": "log cone temperatures hourly please", "timestamp": "2025-03-09T05:00:00Z"},
            {"prompt": "nobody's"}, "not json")
    s.lines("grok/sessions/%2Fsrv%2Fwork%2Fglaze/prompt_history.jsonl",
            {"session_id": "celadon", "prompt": "", "timestamp": "1741500000"}, "[1,2")
    s.lines("grok/sessions/too/deep/prompt_history.jsonl", {"session_id": "deep", "prompt": "x"})
    t = grok.read(spark, Lake(base))
    got = {r.session_id: r for r in t.sessions.collect()}
    assert got["firing"].project == "kiln log" and got["celadon"].project == "glaze"
    assert got["firing"].started_at.isoformat() == "2025-03-09T03:58:30"
    assert got["firing"].activity_at.isoformat() == "2025-03-09T05:00:00" == got["firing"].ended_at.isoformat()
    assert got["celadon"].started_at.timestamp() == 1741500000
    sizes = {r.event_id: (r.words, r.has_text) for r in t.prompts.collect()}
    assert {k: v for k, v in sizes.items() if k < "d"} == {"celadon#0": (0, False)}
    assert [sizes[f"firing#{i}"] for i in range(3)] == [(4, True), (2, True), (5, True)]
    assert warned(t) == {"missing_session_id": 1, "malformed_prompt_record": 2}
    assert provider(t).status == "supported with warnings" and not provider(t).tool_calls_available


def test_aider(spark, base):
    """Adjacent prompt lines are one prompt; quoted headings are not; times are local."""
    asked = ["sort the shelf labels", "print two copies\nof each label\non A5 paper", "<blank>", "undo"]

    def prompt(text):
        return "".join(f"#### {line}  \n" for line in text.split("\n"))

    log = ("no chat yet\n" + prompt("before any chat") + "# aider chat started at 2024-11-30 23:50:00\n> Tokens: 2k sent\n"
           + prompt(asked[0]) + "\nSorted by size.\n#### Shelf B\n" + prompt(asked[1]) + "\n"
           + "# aider chat started at 2024-12-03 07:05:09\n" + prompt(asked[2]) + "\nok\n" + prompt(asked[3])
           + "# aider chat started at soon\n" + "# aider chat started at 2024-12-04 10:00:00\n> nothing asked\n")
    s = Store(base)
    s.doc("aider/labels/aider.chat.history.md", log)
    t = aider.read(spark, Lake(base), zone="-05:00")
    got = sorted(t.sessions.collect(), key=lambda r: r.started_at)
    assert [r.started_at.isoformat() for r in got] == ["2024-12-01T04:50:00", "2024-12-03T12:05:09"]
    assert {r.project for r in got} == {"labels"}
    prompts = sorted(rows(t.prompts, "session_at", "event_id", "words", "characters", "has_text"))
    assert [p[2:] for p in prompts] == [(len(x.split()), len(x), x != "<blank>") for x in asked]
    assert warned(t) == {"unreadable_session_start": 1}


def message(ident, kind, content=None, **more):
    return {"id": ident, "type": kind, **({} if content is None else {"content": content}), **more}


def test_gemini(spark, base):
    """A log with totals, a document beside it, a nested document, and a log that is edited as it grows."""
    s = Store(base, "plain")
    s.lines("gemini/tmp/tide-tables/chats/session-0a.jsonl",
            {"sessionId": "tides", "startTime": "2025-05-02T18:30:00Z"},
            message("q", "user", [{"text": "when is"}, {"text": "high water"}], timestamp="2025-05-02T18:30:07Z"),
            message("a", "gemini", "at nine", model="flash", toolCalls=[{"id": "lookup"}], timestamp="2025-05-02T18:30:20Z",
                    tokens={"input": 64, "output": 8, "cached": 16, "thoughts": 4}),
            message("b", "gemini", "or ten", model="pro", toolCalls=[{"id": "x"}, {"id": "y"}, {"id": "z"}],
                    timestamp="2025-05-02T19:02:00Z", tokens={"input": 31, "output": 5, "thoughts": 9, "tool": 2}),
            {"$set": {"lastUpdated": "2025-05-02T19:15:30Z"}})
    s.doc("gemini/tmp/tide-tables/chats/session-0a.json", {"sessionId": "shadowed", "messages": [message("n", "user", "no")]})
    s.doc(f"gemini/tmp/{'5f' * 20}/chats/night/session-1b.json", {
        "sessionId": "moon", "kind": "subagent", "messages": [message("m", "user", {"text": "phase of the moon"})]})
    e = Store(base, "edited")
    e.lines("gemini/tmp/boat/chats/session-2c.jsonl",
            {"sessionId": "knots", "startTime": "2025-05-03T08:00:00Z"},
            message("one", "user", "tie a bowline"), message("two", "user", "tie it again"),
            message("three", "gemini", "tied"), message("four", "user", "and a sheet bend"),
            {"$rewindTo": "three"}, message("five", "user", "clove hitch"),
            {"$patch": {"removeIds": ["two", "unknown"], "updates": [{"id": "five", "content": "a clove hitch on the rail"}]}},
            message("six", "user", tokens=7), "{cut")
    c = Store(base, "cleared")
    c.lines("gemini/tmp/boat/chats/session-3d.jsonl", {"sessionId": "sails", "startTime": "2025-05-03T09:00:00Z"},
            message("one", "user", "reef the main"), {"$rewindTo": None}, message("two", "user", "hoist the jib now"))
    t = gemini.read(spark, Lake(base))
    p = of_store(t, "plain")
    got = {r.session_id: r for r in p.sessions.collect()}
    assert set(got) == {"tides", "moon"}
    tides = got["tides"]
    assert tides.project == "tide-tables" and tides.tool_calls == 4
    assert tides.ended_at.isoformat() == "2025-05-02T19:15:30"
    u = tides.usage
    assert (u.input, u.output, u.cache_read, u.reasoning) == (95, 13, 16, 13)
    moon = got["moon"]
    assert moon.is_child and moon.parent_id == "night" and moon.project is None and moon.time_unavailable
    assert sorted(rows(p.prompts, "event_id", "words")) == [("moon#m", 4), ("tides#q", 4)]
    assert sorted(rows(p.model_activity, "model", "turns")) == [("flash", 1), ("pro", 1)]
    edited = of_store(t, "edited")
    assert sorted(rows(edited.prompts, "event_id", "words")) == [("knots#five", 6), ("knots#one", 3)]
    assert warned(edited)["malformed_record"] == 1
    assert rows(of_store(t, "cleared").prompts, "event_id", "words") == [("sails#two", 4)]


def test_continue(spark, base):
    s = Store(base)
    s.doc("continue/sessions/sessions.json", [{"sessionId": "bread", "dateCreated": "1715000000250"}, {"sessionId": "unknown"}])
    s.doc("continue/sessions/bread.json", {
        "sessionId": "bread", "workspaceDirectory": "/home/mira/sourdough", "chatModelTitle": "Baker 2",
        "history": [{"message": {"role": "system", "content": "be brief"}},
                    {"message": {"role": "user", "content": [{"type": "text", "text": "Scale the recipe"},
                                                             {"type": "text", "text": "to nine loaves"}]}},
                    {"message": {"role": "assistant", "content": "Scaled."}},
                    {"message": {"role": "user", "content": [{"type": "imageUrl"}]}}],
        "usage": {"promptTokens": 77, "completionTokens": 21, "completionTokensDetails": {"reasoningTokens": 6},
                  "promptTokensDetails": {"cachedTokens": 33, "cacheWriteTokens": 11}}})
    s.doc("continue/sessions/silent.json", {"sessionId": "silent", "history": [{"message": {"role": "assistant", "content": "hello"}}]})
    s.doc("continue/sessions/undated.json", {"history": [{"message": {"role": "user", "content": "fold the dough"}}]})
    s.doc("continue/sessions/torn.json", '{"sessionId": "to')
    t = continuedev.read(spark, Lake(base))
    got = {r.session_id: r for r in t.sessions.collect()}
    assert set(got) == {"bread", "undated"} and got["bread"].project == "sourdough" and got["undated"].time_unavailable
    u = got["bread"].usage
    assert (u.input, u.output, u.cache_read, u.cache_write, u.reasoning) == (77, 21, 33, 11, 6)
    assert got["bread"].started_at.timestamp() == 1715000000.25
    sizes = {r.event_id: (r.words, r.has_text) for r in t.prompts.collect()}
    assert sizes == {"bread#1": (6, True), "bread#3": (0, False), "undated#0": (3, True)}
    assert rows(t.model_activity, "model", "turns") == [("Baker 2", 1)]
    assert warned(t) == {"malformed_session": 1, "missing_creation_time": 1}


def said(at, what, text):
    return {"ts": at, "type": "say", "say": what, "text": text if isinstance(text, str) else json.dumps(text)}


def test_tasks(spark, base):
    """One task under two roots, requests with and without readable numbers, a task whose prompt is plain text."""
    at = 1733000000000
    events = [said(at, "task", "Draw the floor plan"), said(at + 250, "api_req_started", {"tokensIn": 41, "tokensOut": 7, "cacheReads": 5}),
              said(at + 9_000, "user_feedback", "wider doors"), said(at + 9_500, "api_req_started", "{"),
              said(at + 9_900, "api_req_started", {"tokensIn": 13, "tokensOut": 2, "cacheWrites": 3}),
              said(at + 30_000, "user_feedback", "and a skylight over the stairs"),
              said(at + 31_000, "deleted_api_reqs", {"tokensIn": 6, "tokensOut": 1})]
    s = Store(base)
    for root in ("cline/tasks", "cline-data/tasks"):
        s.doc(f"{root}/plan/ui_messages.json", events)
    s.doc("cline/tasks/plan/task_metadata.json", {"model_usage": [{"model_id": "draft-9"}, {"model_id": "draft-9"}, {"model_id": "draft-9"}]})
    s.doc("cline-data/tasks/walls/ui_messages.json", [said(at + 60_000, "text", "Paint them"), said(at + 61_000, "text", "Painted.")])
    s.doc("cline/tasks/torn/ui_messages.json", '[{"ts":')
    t = tasks.read_cline(spark, Lake(base))
    got = {r.session_id: r for r in t.sessions.collect()}
    assert set(got) == {"plan", "walls"}
    assert (got["plan"].started_at.timestamp(), got["plan"].ended_at.timestamp()) == (1733000000, 1733000031)
    u = got["plan"].usage
    assert (u.input, u.output, u.cache_read, u.cache_write) == (60, 10, 5, 3)
    assert sorted(rows(t.prompts, "event_id", "words")) == [("plan#0", 4), ("plan#2", 2), ("plan#5", 6), ("walls#0", 2)]
    assert rows(t.model_activity, "model", "turns") == [("draft-9", 2)]
    assert warned(t) == {"duplicate_task_id": 1, "malformed_task": 1, "malformed_api_request_record": 1}


def test_copilot(spark, base):
    make = ("CREATE TABLE sessions (id TEXT, cwd TEXT, created_at TEXT, updated_at TEXT)",
            "CREATE TABLE turns (session_id TEXT, turn_index INTEGER, user_message TEXT, assistant_response TEXT, timestamp TEXT)")
    Store(base).database(
        "copilot/session-store.db", *make,
        "INSERT INTO sessions VALUES ('garden', '/home/mira/beds', '2025-04-11T07:00:00Z', '2025-04-11T09:30:00Z'),"
        " ('', '/x', '2025-04-11T07:00:00Z', NULL), ('seeds', NULL, 'spring', NULL), ('unused', '/y', '2025-04-12T07:00:00Z', NULL)",
        "INSERT INTO turns VALUES ('garden', 3, 'When do I plant beans?', 'private', '2025-04-11T07:20:00+01:00'),"
        " ('garden', 4, NULL, 'private', NULL), ('seeds', 0, 'order them', 'private', '2025-04-13T10:00:00Z'),"
        " ('nowhere', 0, 'lost', 'private', NULL)")
    Store(base, "bare").database("copilot/session-store.db", make[0], "INSERT INTO sessions VALUES ('a', 'b', 'c', 'd')")
    Store(base, "odd").database("copilot/session-store.db", "CREATE TABLE beds (rows)")
    with open(Store(base, "torn").path("copilot/session-store.db"), "wb") as handle:
        handle.write(b"SQLite format 3\x00" + b"\x07" * 500)
    t = copilot.read(spark, Lake(base))
    mine = of_store(t, "alice")
    got = {r.session_id: r for r in mine.sessions.collect()}
    assert set(got) == {"garden", "seeds"} and got["garden"].project == "beds" and got["seeds"].started_at is None
    assert got["garden"].ended_at.isoformat() == "2025-04-11T09:30:00"
    assert sorted(rows(mine.prompts, "event_id", "words", "has_text")) == [
        ("garden#3", 5, True), ("garden#4", 0, False), ("seeds#0", 2, True)]
    status = {r.store_id: (r.status, r.coverage_status) for r in t.providers.collect()}
    assert status["alice"] == ("supported", "completeness unknown")
    assert status["odd"] == ("unsupported schema", "assessment unavailable")
    assert status["torn"] == ("unavailable", "assessment unavailable")
    codes = {(r.store_id, r.code) for r in t.warnings.collect()}
    assert codes == {("odd", "unknown_schema"), ("torn", "sqlite_snapshot_failed"), ("bare", "prompt_metrics_unavailable")}


def test_hermes(spark, base):
    """Compaction copies, live twins, usage listed by model or kept with the session; an older schema without flags."""
    tokens = ", ".join(f"{t} INTEGER" for t in hermes.TOKENS)
    sessions = ("CREATE TABLE sessions (id TEXT, parent_session_id TEXT, started_at REAL, ended_at REAL, last_activity_at REAL, "
                f"git_repo_root TEXT, cwd TEXT, tool_call_count INTEGER, model TEXT, api_call_count INTEGER, {tokens})")
    messages = "CREATE TABLE messages (id INTEGER PRIMARY KEY, session_id TEXT, role TEXT, content TEXT, timestamp REAL, {} _compressed_summary INTEGER)"
    usage = f"CREATE TABLE session_model_usage (session_id TEXT, model TEXT, api_call_count INTEGER, {tokens})"
    at = 1728000000
    Store(base, "new").database(
        "hermes/state.db", sessions, messages.format("active INTEGER,"), usage,
        f"INSERT INTO sessions VALUES ('loom', '', {at}, {at + 40}, {at + 99}, NULL, '/home/mira/weaving', 4, 'warp', 8, 1, 1, 1, 1, 1),"
        f" ('shuttle', 'loom', {at + 5}, NULL, {at + 7.25}, '/git/looms', '/elsewhere', 0, NULL, 0, 0, 0, 0, 0, 0),"
        f" ('solo', NULL, {at + 9}, NULL, NULL, '', '', 2, 'weft', 6, 70, 30, 20, 10, 5)",
        "INSERT INTO session_model_usage VALUES ('loom', 'warp', 5, 40, 4, 3, 2, 1), ('loom', 'weft', 1, 2, 1, 0, 0, 0),"
        " ('loom', 'warp', 2, 8, 1, 0, 0, 0)",
        f"INSERT INTO messages VALUES (10, 'loom', 'user', 'thread the heddles', {at + 1.5}, 0, 0),"
        f" (11, 'loom', 'user', 'thread the heddles', {at + 1.5}, 0, 0), (12, 'loom', 'user', 'thread the heddles', {at + 1.5}, 1, 0),"
        f" (13, 'loom', 'user', 'beat', {at + 2}, 1, 0), (14, 'loom', 'user', 'beat', {at + 2}, 1, 0), (15, 'loom', 'user', 'beat', {at + 2}, 1, 0),"
        f" (16, 'loom', 'user', 'thread the heddles', {at + 3}, 0, 0), (17, 'loom', 'user', 'all so far', {at + 4}, 1, 1),"
        f" (18, 'loom', 'assistant', 'done', {at + 4}, 1, 0), (19, 'solo', 'user', NULL, {at + 9}, 1, 0)")
    Store(base, "old").database(
        "hermes/state.db", sessions, messages.format(""), usage,
        f"INSERT INTO sessions (id, started_at) VALUES ('felt', {at})",
        *[f"INSERT INTO messages VALUES ({i}, 'felt', 'user', 'press it', {at + 1}, 0)" for i in (1, 2, 3)])
    t = hermes.read(spark, Lake(base))
    new = of_store(t, "new")
    got = {r.session_id: r for r in new.sessions.collect()}
    assert (got["loom"].usage.input, got["loom"].usage.output, got["loom"].usage.reasoning) == (50, 6, 1)
    assert got["solo"].usage.source == "sessions token columns" and got["solo"].usage.cache_write == 10
    assert [got[x].is_child for x in ("loom", "shuttle", "solo")] == [False, True, False]
    assert (got["loom"].project, got["shuttle"].project, got["solo"].project) == ("weaving", "looms", None)
    assert got["shuttle"].ended_at.timestamp() == at + 7.25 and got["solo"].ended_at == got["solo"].started_at
    # one for the copies, three live twins, one at another time
    assert new.prompts.count() == 5 and warned(new) == {}
    turns = new.model_activity.groupBy("session_id", "model").agg({"turns": "sum"}).collect()
    assert sorted(tuple(r) for r in turns) == [("loom", "warp", 7), ("loom", "weft", 1), ("solo", "weft", 6)]
    old = of_store(t, "old")
    assert old.prompts.count() == 3 and warned(old) == {"prompt_identity_unavailable": 1}


def test_cursor(spark, base):
    """Headers win over the older list; bodies are matched by key; children, drafts and odd keys."""
    at = 1740000000000

    def kv(key, value):
        return ("INSERT INTO cursorDiskKV VALUES (?, ?)", (key, value if isinstance(value, str) else json.dumps(value)))

    def heads(*bubbles, **more):
        return {"fullConversationHeadersOnly": list(bubbles), **more}

    Store(base).database(
        "cursor/state.vscdb",
        "CREATE TABLE composerHeaders (composerId TEXT PRIMARY KEY, createdAt INTEGER, lastUpdatedAt INTEGER, isSubagent INTEGER, value TEXT)",
        "CREATE TABLE cursorDiskKV (key TEXT UNIQUE ON CONFLICT REPLACE, value BLOB)", "CREATE TABLE ItemTable (key TEXT, value BLOB)",
        f"INSERT INTO composerHeaders VALUES ('bees', {at}, {at + 60_000}, 0, NULL), ('swarm', {at + 1}, {at + 2}, 1,"
        f" '{{\"subagentInfo\":{{\"parentComposerId\":\"bees\"}}}}'), ('sketch', {at}, {at}, 0, '{{\"isDraft\":true}}'),"
        f" ('idle', {at}, {at}, 0, '{{}}')",
        ("INSERT INTO ItemTable VALUES ('composer.composerData', ?)", (json.dumps({"allComposers": [
            {"composerId": "bees", "createdAt": 7}, {"composerId": "wax", "createdAt": at - 500}]}),)),
        kv("composerData:bees", heads({"bubbleId": "b1", "type": 1, "createdAt": "2025-02-19T21:20:05Z"}, {"bubbleId": "gone", "type": 1},
                                      {"bubbleId": "gone too", "type": 1}, {"bubbleId": "shown", "type": 1, "isDisplayOnly": True},
                                      {"bubbleId": "reply", "type": 2}, composerId="bees",
                                      workspaceIdentifier={"uri": "file:///home/mira/apiary%20notes"})),
        kv("composerData:swarm", heads({"bubbleId": "s1", "type": 1, "createdAt": at + 2})), kv("composerData:torn", "{\"a\":"),
        kv("composerData:mixed", {"composerId": "somebody else"}),
        kv("bubbleId:bees:b1", {"bubbleId": "b1", "type": 1, "text": "count the frames in every hive", "modelInfo": {"modelName": "drone"}}),
        kv("bubbleId:bees:shown", {"type": 1, "text": "no"}), kv("bubbleId:bees:reply", {"type": 2, "text": "no"}),
        kv("bubbleId:swarm:s1", {"type": 1, "text": "look closer"}), kv("bubbleId:sketch:x", {"type": 1, "text": "no"}),
        kv("bubbleId:wax:w1", {"type": 1, "text": "melt it", "createdAt": at - 400}), kv("bubbleId:wax:w2", "not json"),
        kv("bubbleId:wax:w3", {"bubbleId": "w4", "type": 1, "text": "no"}), kv("bubbleId:alone", {"type": 1}), kv("bubbleIdea:x", "{}"))
    t = cursor.read(spark, Lake(base))
    got = {r.session_id: r for r in t.sessions.collect()}
    assert set(got) == {"bees", "swarm", "wax"}
    assert got["bees"].project == "apiary notes" and not got["bees"].usage.available
    assert got["bees"].started_at.timestamp() * 1000 == at and got["wax"].started_at.timestamp() * 1000 == at - 500
    assert got["swarm"].is_child and got["swarm"].parent_id == "bees"
    prompts = {r.event_id: r for r in t.prompts.collect()}
    assert {k: r.words for k, r in prompts.items()} == {"b1": 6, "s1": 2, "w1": 2}
    assert prompts["b1"].at.isoformat() == "2025-02-19T21:20:05"
    assert rows(t.model_activity, "model", "turns") == [("drone", 1)]
    assert warned(t) == {"missing_bubble_body": 2, "malformed_composer": 1, "mismatched_composer_id": 1,
                         "malformed_bubble_key": 1, "malformed_bubble": 1, "mismatched_bubble_id": 1}
    assert not provider(t).tool_calls_available


def test_antigravity(spark, base):
    """Prompts are byte ranges of one body; times come from transcript steps, or from the last input."""
    pieces = ["Grüß the ferry", "board now", "wave from the upper deck", "ahoy"]
    body, starts = "\n".join(pieces), []
    for i in range(len(pieces)):
        starts.append(len("\n".join(pieces[:i]).encode()) + (i > 0))
    marks = [[step, start] for step, start in zip((1, 4, 6, 9), starts, strict=True)]
    s = Store(base)
    s.database(
        "antigravity/conversation_summaries.db",
        "CREATE TABLE conversation_summaries (conversation_id text, last_modified_time text, workspace_uris text, parent_conversation_id text,"
        " nesting_depth integer, last_user_input_time text, last_user_input_step_index integer)",
        "CREATE VIRTUAL TABLE conversations_fts USING fts5(conversation_id UNINDEXED, chunk_index UNINDEXED, user_step_byte_offsets UNINDEXED, user_body)",
        "INSERT INTO conversation_summaries VALUES ('ferry', '2025-08-05 12:45:10.5+00:00', '[\"file:///home/mira/crossings\"]', '', 0, '2025-08-05 12:40:00+00:00', 9),"
        " ('gull', '2025-08-06 09:00:00+00:00', NULL, 'ferry', 2, '', -1), ('fog', 'unknown', '{', '', 0, '', -1)",
        ("INSERT INTO conversations_fts VALUES (?, ?, ?, ?)", ("ferry", 0, json.dumps(marks), body)),
        ("INSERT INTO conversations_fts VALUES (?, ?, ?, ?)", ("ferry", -1, "[]", "summary")),
        ("INSERT INTO conversations_fts VALUES (?, ?, ?, ?)", ("gull", 0, "[[0,40]]", "beyond the end")),
        ("INSERT INTO conversations_fts VALUES (?, ?, ?, ?)", ("gull", 1, "nonsense", "x")),
        ("INSERT INTO conversations_fts VALUES (?, ?, ?, ?)", ("fog", 0, "[[2,0],[3,3]]", "Grüß")))  # 3 lies inside ü

    def step(index, at, **more):
        return {"step_index": index, "type": "PLANNER_RESPONSE", "created_at": at, **more}

    s.lines("antigravity/brain/ferry/.system_generated/logs/transcript.jsonl",
            step(1, "2025-08-05T11:58:00Z"), step(2, "2025-08-05T11:58:30Z", input_tokens=90, output_tokens=12, tool_calls=[{"id": "a"}]),
            step(6, "2025-08-05T12:10:00Z", input_tokens=10, output_tokens=3, cache_read_tokens=55, tool_calls=[{"id": "b"}, {"id": "c"}, {"id": "d"}]),
            "}{", "")
    t = antigravity.read(spark, Lake(base))
    got = {r.session_id: r for r in t.sessions.collect()}
    ferry = got["ferry"]
    assert ferry.project == "crossings" and ferry.tool_calls == 4 and ferry.activity_basis == "transcript step timestamps"
    assert (ferry.usage.input, ferry.usage.output, ferry.usage.cache_read) == (100, 15, 55)
    assert (ferry.started_at.isoformat(), ferry.ended_at.isoformat()) == ("2025-08-05T11:58:00", "2025-08-05T12:45:10.500000")
    assert got["gull"].is_child and got["fog"].time_unavailable
    prompts = {r.event_id: r for r in t.prompts.collect()}
    assert [prompts[f"ferry#{i}"].words for i in (1, 4, 6, 9)] == [len(p.split()) for p in pieces]
    times = [prompts[f"ferry#{i}"].at for i in (1, 4, 6, 9)]
    assert [x and x.isoformat() for x in times] == ["2025-08-05T11:58:00", None, "2025-08-05T12:10:00", "2025-08-05T12:40:00"]
    assert prompts["gull#0"].words == 0 and not prompts["gull#0"].has_text
    assert prompts["fog#2"].words == 0 and prompts["fog#3"].words == 0
    assert warned(t) == {"prompt_text_slices_invalid": 1, "malformed_prompt_index": 1, "malformed_transcript_line": 1}
    assert provider(t).tool_calls_available
