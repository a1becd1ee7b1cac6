"""The readers, run over histories that Spark derives from the driver tables.

``events`` and ``conversations`` are written out as the lines, documents and
database rows a harness would store; the reader's whole normalisation then runs
on them, and the oracle states the expected figures from the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.operators import metrics
from tallyloom.plans.bindings import EV, events, table
from tallyloom.plans.registry import query
from tallyloom.sources import aider, antigravity, claude, codex, continuedev, copilot, cursor, gemini, grok, hermes, tasks
from tallyloom.sources.lake import LINE_KEY, Stage
from tallyloom.plans.bindings import WORDS_SQL

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
_MTIME_SECONDS = 1_600_000_000


def _iso(c: str) -> Column:
    return F.date_format(c, _ISO)


def _line(path: Column, n: Column, record: Column, rel: Column | None = None, block: Column | None = None) -> list[Column]:
    """Columns of one raw line; ``block``: start of the split that holds it."""
    return [F.lit("s").alias("store_id"), path.alias("path"), (rel if rel is not None else path).alias("rel"),
            F.struct(path.alias("path"), (F.lit(0) if block is None else block).cast("bigint").alias("block"), n.cast("bigint").alias("n"))
            .cast(LINE_KEY).alias("line_key"), record.alias("line"), F.timestamp_seconds(F.lit(_MTIME_SECONDS)).alias("mtime")]


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def _files(raw: DataFrame) -> DataFrame:
    return raw.select("store_id", "path").distinct()


def _by_session(tables, sessions: bool = True) -> DataFrame:
    """Sessions with their prompt count and words."""
    prompts = tables.prompts.groupBy("session_key").agg(
        F.count(F.lit(1)).alias("prompts"), F.sum("words").alias("words"), F.sum("characters").alias("characters"))
    return tables.sessions.join(prompts, "session_key", "left")


# --- line logs -----------------------------------------------------------------

def _claude_raw(spark, sf_dir) -> DataFrame:
    """One transcript per user; views and clicks are prompts, purchases replies."""
    ev = events(spark, sf_dir)
    kind, k = F.col("event_type"), F.col("k")
    own = F.when(F.col("user_id") % 11 == 5, F.lit("elsewhere")).otherwise(F.concat(F.lit("u"), F.col("user_id")))
    human = kind.isin("view", "click", "error", "signup")
    text = F.concat_ws(" ", F.array_repeat(F.lit("w"), k % 7))
    block = F.when(k % 10 == 0, F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("id"))).otherwise(
        F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("t"), F.col("event_id") % 700).alias("id")))
    record = F.when(human, _json(
        type=F.lit("user"), uuid=F.concat(F.lit("p"), F.col("event_id") % 2000), sessionId=own, timestamp=_iso("ts"),
        cwd=F.concat(F.lit("/w/p"), F.col("user_id") % 12), isMeta=kind == "error",
        isCompactSummary=(kind == "signup") & (k % 2 == 0), isSidechain=F.col("user_id") % 7 == 3,
        message=F.struct(F.lit("user").alias("role"), text.alias("content")))).otherwise(_json(
            type=F.lit("assistant"), sessionId=own, timestamp=_iso("ts"), isSidechain=F.col("user_id") % 7 == 3,
            message=F.struct(
                F.lit("assistant").alias("role"), F.concat(F.lit("r"), F.col("event_id") % 1500).alias("id"),
                F.when(k % 5 != 4, F.concat(F.lit("m"), k % 5)).otherwise(F.lit("<synthetic>")).alias("model"),
                F.array(block).alias("content"),
                F.when(k % 9 != 0, F.struct(F.floor(F.col("value") * 100).alias("input_tokens"), k.alias("output_tokens"))).alias("usage"))))
    rel = F.concat(F.lit("project/u"), F.col("user_id"), F.lit(".jsonl"))
    return ev.select(*_line(F.concat(F.lit("/lake/s/claude/projects/"), rel), F.col("event_id"), record, rel))


_CLAUDE = """
WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
files AS (SELECT user_id, CASE WHEN user_id % 11 = 5 THEN TIMESTAMP '2020-09-13 12:26:40' ELSE min(ts) END AS st,
                 user_id % 11 = 5 AS unanchored,
                 user_id % 7 = 3 AND user_id % 11 <> 5 AS is_child FROM e GROUP BY user_id),
own AS (SELECT e.*, f.st, 'u' || e.user_id AS sid FROM e JOIN files f USING (user_id) WHERE NOT f.is_child),
prompts AS (SELECT event_id % 2000 AS id, k % 7 AS words FROM own
            WHERE (event_type IN ('view', 'click') OR (event_type = 'signup' AND k % 2 <> 0)) AND k % 7 > 0
            QUALIFY row_number() OVER (PARTITION BY event_id % 2000 ORDER BY st, sid, event_id) = 1),
merged AS (SELECT user_id, st, sid, event_id % 1500 AS id, last(floor(value * 100)::BIGINT ORDER BY event_id) FILTER (k % 9 <> 0) AS i,
                  last(k ORDER BY event_id) FILTER (k % 9 <> 0) AS o,
                  last('m' || (k % 5) ORDER BY event_id) FILTER (k % 5 <> 4) AS model
           FROM own WHERE event_type = 'purchase' GROUP BY ALL),
calls AS (SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY id ORDER BY st, sid) = 1),
tools AS (SELECT event_id % 700 AS id, k % 10 = 0 AS blank FROM own WHERE event_type = 'purchase')
"""


@query("claude_ingest", _CLAUDE + """
SELECT (SELECT count(*) FROM files WHERE NOT is_child AND NOT unanchored) AS sessions,
       (SELECT count(*) FROM files WHERE is_child) AS child_sessions, (SELECT count(*) FROM prompts) AS prompts,
       (SELECT sum(words)::BIGINT FROM prompts) AS words, (SELECT count(*) FROM calls) AS calls,
       (SELECT sum(i)::BIGINT FROM calls) AS input, (SELECT sum(o)::BIGINT FROM calls) AS output,
       (SELECT count(DISTINCT id) FILTER (NOT blank) + count(*) FILTER (blank) FROM tools) AS tools,
       (SELECT count(*) FROM calls WHERE model = 'm2') AS m2_turns""")
def claude_ingest(spark, sf_dir):
    t = claude.normalize(_claude_raw(spark, sf_dir), stage=Stage.shared(spark))
    h = metrics.FLEET
    calls = metrics.distinct_calls(t.calls, h)
    prompts = metrics.distinct_prompts(t.prompts, h)
    turns = metrics.model_turns(t.model_activity, calls, h).where("model = 'm2'").agg(F.max("turns").alias("m2_turns"))
    parts = (metrics.session_counts(t.sessions, h).select("sessions", "child_sessions")
             .unionByName(prompts.agg(F.count(F.lit(1)).alias("prompts"), F.sum("words").alias("words")), True)
             .unionByName(calls.agg(F.count(F.lit(1)).alias("calls"), F.sum("usage.input").alias("input"),
                                    F.sum("usage.output").alias("output")), True)
             .unionByName(metrics.distinct_tools(t.tools, h).select("tools"), True).unionByName(turns, True))
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


@query("claude_owner_prompts", """
WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type <> 'purchase')
SELECT count(*) FILTER (event_type = 'error') AS meta, count(*) FILTER (event_type = 'signup' AND k % 2 = 0) AS compact,
       count(*) FILTER (event_type = 'error' OR (event_type = 'signup' AND k % 2 = 0)) AS excluded,
       count(*) FILTER (NOT (event_type = 'error' OR (event_type = 'signup' AND k % 2 = 0)) AND k % 7 > 0) AS prompts FROM e""")
def claude_owner_prompts(spark, sf_dir):
    parsed = claude.parse(_claude_raw(spark, sf_dir)).where("is_user")
    return parsed.agg(F.count_if("x_meta").alias("meta"), F.count_if("x_compact").alias("compact"),
                      F.count_if("excluded").alias("excluded"), F.count_if("is_prompt").alias("prompts"))


@query("claude_history", """
WITH e AS (SELECT user_id, ts, event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type FROM events)
SELECT 'u' || user_id AS session_id, count(*) FILTER (event_type = 'view') AS prompts, epoch_us(min(ts)) // 1000 AS started
FROM e WHERE user_id % 3 = 1 AND event_type = 'view' GROUP BY user_id""")
def claude_history(spark, sf_dir):
    """Views are history rows; two thirds of the users also left a transcript."""
    ev = events(spark, sf_dir)
    transcript = _claude_raw(spark, sf_dir).where(F.regexp_extract("path", r"u(\d+)\.jsonl", 1).cast("int") % 3 != 1)
    # Every transcript is given records of its own, so that it anchors its session.
    anchored = transcript.withColumn("line", F.regexp_replace("line", '"sessionId":"elsewhere"', F.concat(
        F.lit('"sessionId":"u'), F.regexp_extract("path", r"u(\d+)\.jsonl", 1), F.lit('"'))))
    anchored = anchored.withColumn("line", F.replace("line", F.lit('"isSidechain":true'), F.lit('"isSidechain":false')))
    record = _json(display=F.concat_ws(" ", F.lit("shown"), "k"), project=F.lit("/w/x"),
                   sessionId=F.concat(F.lit("u"), F.col("user_id")), timestamp=F.unix_millis("ts"))
    history = ev.where(F.col("event_type") == "view").select(*_line(F.lit("/lake/s/claude/history.jsonl"), F.col("event_id"), record))
    t = claude.normalize(anchored, history, stage=Stage.shared(spark))
    only = _by_session(t).where("history_only")
    return only.select("session_id", "prompts", F.unix_millis("started_at").alias("started"))


def _codex_raw(spark, sf_dir) -> DataFrame:
    """One rollout per session: a metadata line, then an event per row."""
    ev = events(spark, sf_dir)
    k, kind = F.col("k"), F.col("event_type")
    name = F.concat(F.lit("/lake/s/codex/sessions/rollout-"), F.col("session_id"), F.lit(".jsonl"))
    text = F.concat_ws(" ", F.array_repeat(F.lit("w"), k % 7))
    payload = {
        "view": _json(timestamp=_iso("ts"), type=F.lit("event_msg"), payload=F.struct(
            F.lit("user_message").alias("type"), F.concat(F.lit("p"), F.col("event_id") % 50).alias("id"), text.alias("message"))),
        "signup": _json(timestamp=_iso("ts"), type=F.lit("turn_context"), payload=F.struct(
            F.concat(F.lit("t"), F.col("event_id") % 5).alias("turn_id"), F.concat(F.lit("m"), k % 3).alias("model"))),
        "error": _json(timestamp=_iso("ts"), type=F.lit("response_item"), payload=F.struct(
            F.lit("function_call").alias("type"), F.concat(F.lit("c"), F.col("event_id") % 4).alias("call_id"))),
        "purchase": _json(timestamp=_iso("ts"), type=F.lit("event_msg"), payload=F.struct(
            F.lit("token_count").alias("type"), F.struct(F.struct(
                k.alias("input_tokens"), F.col("event_id").alias("output_tokens"), k.alias("total_tokens")).alias("total_token_usage")).alias("info")))}
    record = F.when(kind.isin("view", "click"), payload["view"])
    for name_, value in list(payload.items())[1:]:
        record = record.when(kind == name_, value)
    rows = ev.select(*_line(name, F.col("event_id"), record))
    heads = ev.groupBy("session_id", "user_id").agg(F.min("ts").alias("ts")).select(*_line(name, F.lit(-1), _json(
        timestamp=_iso("ts"), type=F.lit("session_meta"), payload=F.struct(
            F.col("session_id").alias("id"), F.when(F.col("user_id") % 7 == 3, F.lit("up")).alias("parent_thread_id"),
            F.concat(F.lit("/w/p"), F.col("user_id") % 12).alias("cwd")))))
    return rows.unionByName(heads)


_EVK = """
WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
                  user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS sid FROM events)
"""


@query("codex_ingest", _EVK + """
SELECT sid AS session_id, user_id % 7 = 3 AS is_child, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended,
       count(DISTINCT event_id % 50) FILTER (event_type IN ('view', 'click') AND k % 7 > 0) AS prompts,
       count(DISTINCT event_id % 4) FILTER (event_type = 'error') AS tool_calls,
       coalesce(arg_max(k, CAST(k AS BIGINT) * 1000000000 + event_id) FILTER (event_type = 'purchase'), 0) AS input,
       coalesce(arg_max(event_id, CAST(k AS BIGINT) * 1000000000 + event_id) FILTER (event_type = 'purchase'), 0) AS output
FROM e GROUP BY sid, user_id""")
def codex_ingest(spark, sf_dir):
    t = codex.normalize(_codex_raw(spark, sf_dir), stage=Stage.shared(spark))
    return _by_session(t).select("session_id", "is_child", F.unix_micros("started_at").alias("started"),
                                 F.unix_micros("ended_at").alias("ended"), F.coalesce("prompts", F.lit(0)).alias("prompts"),
                                 "tool_calls", F.col("usage.input").alias("input"), F.col("usage.output").alias("output"))


@query("codex_turns", _EVK + """
SELECT model, count(*) AS turns FROM (
  SELECT sid, event_id % 5, 'm' || first(k % 3 ORDER BY event_id) AS model FROM e WHERE event_type = 'signup' AND user_id % 7 <> 3 GROUP BY 1, 2)
GROUP BY model""")
def codex_turns(spark, sf_dir):
    t = codex.normalize(_codex_raw(spark, sf_dir), stage=Stage.shared(spark))
    return t.model_activity.where("not is_child").groupBy("model").agg(F.sum("turns").alias("turns"))


@query("grok_ingest", _EVK + """
SELECT sid AS session_id, count(*) AS prompts, CAST(sum(k % 7) AS BIGINT) AS words, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended,
       'my app ' || (user_id % 5) AS project FROM e WHERE event_type IN ('view', 'click') GROUP BY sid, user_id""")
def grok_ingest(spark, sf_dir):
    ev = events(spark, sf_dir).where(F.col("event_type").isin("view", "click"))
    folder = F.concat(F.lit("%2Fhome%2Fmy%20app%20"), F.col("user_id") % 5)
    record = _json(is_bash=F.col("event_type") == "click", prompt=F.concat_ws(" ", F.array_repeat(F.lit("w"), F.col("k") % 7)),
                   session_id=F.col("session_id"), timestamp=_iso("ts"))
    rel = F.concat(folder, F.lit("/prompt_history.jsonl"))
    raw = ev.select(*_line(F.concat(F.lit("/lake/s/grok/sessions/"), rel), F.col("event_id"), record, rel))
    t = grok.normalize(raw, _files(raw), stage=Stage.shared(spark))
    return _by_session(t).select("session_id", "prompts", "words", F.unix_micros("started_at").alias("started"),
                                 F.unix_micros("ended_at").alias("ended"), "project")


@query("aider_ingest", f"""
WITH c AS (SELECT conv_id, turn, role, text, {WORDS_SQL} AS words,
                  sum(CASE WHEN role <> 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM conversations)
SELECT conv_id, count(*) AS prompts, CAST(sum(w) AS BIGINT) AS words, CAST(sum(ch) AS BIGINT) AS characters FROM (
  SELECT conv_id, island, sum(words) AS w, sum(length(text)) + count(*) - 1 AS ch FROM c WHERE role = 'user' GROUP BY ALL)
GROUP BY conv_id""")
def aider_ingest(spark, sf_dir):
    """Ten logs; a conversation is a chat and a split of its log, its user turns are marked lines."""
    turns = table(spark, sf_dir, "conversations")
    conv = F.col("conv_id")
    path = F.concat(F.lit("/lake/s/aider/repo"), conv % 10, F.lit("/aider.chat.history.md"))
    lines = turns.select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n", -1)).alias("i", "l"))
    body = F.when(F.col("role") == "user", F.concat(F.lit("#### "), "l", F.lit("  "))).otherwise(F.concat(F.lit("> "), "l"))
    position = F.shiftleft(F.col("turn") + 1, 32) + F.col("i")
    start = F.timestamp_seconds(F.lit(1767225600) + conv)
    convs = turns.select("conv_id").distinct()
    raw = lines.select(*_line(path, position, body, block=conv)).unionByName(convs.select(*_line(
        path, F.lit(0), F.concat(F.lit("# aider chat started at "), F.date_format(start, "yyyy-MM-dd HH:mm:ss")), block=conv)))
    raw = raw.withColumn("rel", F.regexp_extract("path", "aider/(.*)$", 1))
    placed = aider.normalize(raw, _files(raw), stage=Stage.shared(spark))
    # Sessions carry no conversation id, but every chat starts at a second of its own.
    starts = convs.select("conv_id", start.alias("started_at"))
    return _by_session(placed).join(starts, "started_at").select("conv_id", "prompts", "words", "characters")


def _gemini_raw(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    rel = F.concat(F.lit("app/chats/session-"), F.col("conv_id"), F.lit(".jsonl"))
    path = F.concat(F.lit("/lake/s/gemini/tmp/"), rel)
    user = F.col("role") == "user"
    message = _json(id=F.concat(F.lit("m"), F.col("turn")), timestamp=_iso("at"),
                    type=F.when(user, "user").otherwise(F.lit("gemini")), content=F.array(F.struct(F.col("text").alias("text"))),
                    model=F.when(~user, F.lit("g")), tokens=F.when(~user, F.struct(F.col("turn").alias("input"))))
    body = turns.withColumn("at", F.timestamp_seconds(F.lit(1767225600) + F.col("turn"))).select(
        *_line(path, F.col("turn"), message, rel))
    convs = turns.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    header = convs.select(*_line(path, F.lit(-1), _json(sessionId=F.concat(F.lit("c"), F.col("conv_id")), startTime=F.lit("")), rel))
    rewind = convs.where(F.col("conv_id") % 3 == 0).select(*_line(path, F.lit(1 << 30), F.to_json(
        F.struct(F.concat(F.lit("m"), F.col("turn")).alias("$rewindTo"))), rel))
    patch = convs.where(F.col("conv_id") % 3 == 1).select(*_line(path, F.lit(1 << 30), F.to_json(F.struct(F.struct(
        F.lit("m0").alias("id"), F.lit("patched to four words").alias("content")).alias("$patch"))), rel))
    return body.unionByName(header).unionByName(rewind).unionByName(patch)


@query("gemini_replay", f"""
WITH c AS (SELECT *, {WORDS_SQL} AS w, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
kept AS (SELECT conv_id, role, turn, CASE WHEN conv_id % 3 = 1 AND turn = 0 THEN 4 ELSE w END AS w FROM c
         WHERE NOT (conv_id % 3 = 0 AND turn >= last))
SELECT 'c' || conv_id AS session_id, count(*) FILTER (role = 'user') AS prompts, CAST(sum(w) FILTER (role = 'user') AS BIGINT) AS words,
       coalesce(CAST(sum(turn) FILTER (role <> 'user') AS BIGINT), 0) AS input FROM kept GROUP BY conv_id
HAVING count(*) FILTER (role = 'user') > 0""")
def gemini_replay(spark, sf_dir):
    raw = _gemini_raw(spark, sf_dir)
    t = gemini.normalize(raw, None, _files(raw), Stage.shared(spark))
    return _by_session(t).select("session_id", "prompts", "words", F.col("usage.input").alias("input"))


# --- whole documents -----------------------------------------------------------

def _docs(df: DataFrame, path: Column, doc: Column, *extra: Column) -> DataFrame:
    return df.select(F.lit("s").alias("store_id"), path.alias("path"), path.alias("rel"), doc.alias("doc"),
                     F.lit(False).alias("oversize"), *extra)


@query("continue_ingest", f"""
WITH c AS (SELECT *, {WORDS_SQL} AS w FROM conversations)
SELECT 'c' || conv_id AS session_id, count(*) FILTER (role = 'user') AS prompts, CAST(sum(w) FILTER (role = 'user') AS BIGINT) AS words,
       count(*) FILTER (role = 'assistant') AS turns, conv_id % 4 = 0 AS untimed FROM c GROUP BY conv_id
HAVING count(*) FILTER (role = 'user') > 0""")
def continue_ingest(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    content = F.struct(F.col("role").alias("role"), F.col("text").alias("content")).alias("message")
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", content))).alias("all"))
    sid = F.concat(F.lit("c"), F.col("conv_id"))
    history = F.transform("all", lambda x: F.struct(x["message"].alias("message")))
    docs = _docs(chats, F.concat(F.lit("/lake/s/continue/sessions/"), sid, F.lit(".json")), _json(
        sessionId=sid, workspaceDirectory=F.lit("/w/app"), chatModelTitle=F.lit("M"), history=history))
    # One index part per conversation: the index is read as several files.
    index = _docs(chats.where(F.col("conv_id") % 4 != 0), F.lit("/lake/s/continue/sessions/sessions.json"), F.to_json(F.array(F.struct(
        sid.alias("sessionId"), F.lit("1789000000000").alias("dateCreated")))))
    t = continuedev.normalize(docs, index, Stage.shared(spark))
    replies = t.model_activity.groupBy("session_key").agg(F.sum("turns").alias("turns"))
    return _by_session(t).join(replies, "session_key", "left").select(
        "session_id", "prompts", "words", F.coalesce("turns", F.lit(0)).alias("turns"), F.col("time_unavailable").alias("untimed"))


@query("tasks_ingest", _EVK + """,
t AS (SELECT sid, count(*) FILTER (event_type IN ('view', 'click'))
               + CASE WHEN arg_min(event_type, event_id) = 'signup' AND count(*) FILTER (event_type = 'view') = 0 THEN 1 ELSE 0 END AS prompts,
             epoch_us(min(ts)) // 1000 AS started, epoch_us(max(ts)) // 1000 AS ended,
             coalesce(CAST(sum(k) FILTER (event_type IN ('purchase', 'error')) AS BIGINT), 0) AS input FROM e GROUP BY sid)
SELECT sid AS session_id, prompts, started, ended, input FROM t WHERE prompts > 0""")
def tasks_ingest(spark, sf_dir):
    """A task per session, stored under two roots; the later root is ignored."""
    ev = events(spark, sf_dir)
    kind = F.col("event_type")
    say = (F.when(kind == "view", "task").when(kind == "click", "user_feedback").when(kind == "purchase", "api_req_started")
            .when(kind == "error", "deleted_api_reqs").otherwise("text"))
    body = F.when(kind.isin("purchase", "error"), _json(tokensIn=F.col("k"))).otherwise(F.lit("some words"))
    item = F.struct(F.unix_millis("ts").alias("ts"), F.lit("say").alias("type"), say.alias("say"), body.alias("text"))
    grouped = ev.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("event_id", item.alias("e")))).alias("all"))
    doc = F.to_json(F.transform("all", lambda x: x["e"]))
    docs = None
    for rank, root in enumerate(("cline", "cline-data")):
        part = _docs(grouped, F.concat(F.lit(f"/lake/s/{root}/tasks/"), "session_id", F.lit("/ui_messages.json")),
                     doc if rank == 0 else F.lit("[]"), F.lit(rank).alias("root_rank"))
        docs = part if docs is None else docs.unionByName(part)
    t = tasks.normalize(docs, None, "cline", Stage.shared(spark))
    return _by_session(t).select("session_id", "prompts", F.unix_millis("started_at").alias("started"),
                                 F.unix_millis("ended_at").alias("ended"), F.col("usage.input").alias("input"))


# --- databases -----------------------------------------------------------------

@query("hermes_ingest", _EVK + """,
p AS (SELECT sid, greatest(1, count(*) FILTER (event_id % 2 = 0)) AS n FROM e WHERE event_type IN ('view', 'click') GROUP BY sid, hour(ts), k % 3),
u AS (SELECT sid, sum(k) AS i FROM e WHERE event_type = 'purchase' GROUP BY sid)
SELECT s.sid AS session_id, coalesce(CAST((SELECT sum(n) FROM p WHERE p.sid = s.sid) AS BIGINT), 0) AS prompts,
       CAST(coalesce(u.i, s.ks) AS BIGINT) AS input FROM (SELECT sid, sum(k) AS ks FROM e GROUP BY sid) s LEFT JOIN u USING (sid)""")
def hermes_ingest(spark, sf_dir):
    ev = events(spark, sf_dir)
    none = F.lit(None).cast("string")
    zero = {c: F.lit(0).cast("bigint") for c in hermes.TOKENS}
    sessions = ev.groupBy("session_id").agg(F.min(F.unix_seconds("ts")).cast("double").alias("started_at"), F.sum("k").alias("input_tokens")).select(
        F.lit("s").alias("store_id"), F.col("session_id").alias("id"), none.alias("parent_session_id"), "started_at",
        F.lit(None).cast("double").alias("ended_at"), F.lit(None).cast("double").alias("last_activity_at"), none.alias("git_repo_root"),
        F.lit("/w/app").alias("cwd"), F.lit(0).alias("tool_call_count"), F.lit("own").alias("model"), F.lit(1).alias("api_call_count"),
        "input_tokens", *[zero[c].alias(c) for c in hermes.TOKENS[1:]])
    messages = ev.where(F.col("event_type").isin("view", "click")).select(
        F.lit("s").alias("store_id"), F.array(F.lit("active")).alias("columns"), F.col("event_id").alias("id"), "session_id",
        F.lit("user").alias("role"), F.concat(F.lit("text "), F.col("k") % 3).alias("content"),
        F.hour("ts").cast("double").alias("timestamp"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(0).alias("active"),
        F.lit(0).alias("_compressed_summary"))
    model_usage = ev.where(F.col("event_type") == "purchase").select(
        F.lit("s").alias("store_id"), "session_id", F.concat(F.lit("m"), F.col("k") % 5).alias("model"),
        F.lit(1).alias("api_call_count"), F.col("k").alias("input_tokens"), *[zero[c].alias(c) for c in hermes.TOKENS[1:]])
    t = hermes.normalize(spark, sessions, messages, model_usage, sessions.select("store_id").distinct(),
        stage=Stage.shared(spark))
    return _by_session(t).select("session_id", F.coalesce("prompts", F.lit(0)).alias("prompts"), F.col("usage.input").alias("input"))


@query("cursor_ingest", _EVK + """
SELECT sid AS session_id, user_id % 6 <> 5 AND user_id % 9 <> 2 AND user_id % 7 = 3 AS is_child, count(*) AS prompts, CAST(sum(k % 7) AS BIGINT) AS words FROM e
WHERE event_type = 'view' AND k % 8 <> 0 AND (user_id % 9 <> 2 OR user_id % 6 = 5 OR user_id % 2 = 0) GROUP BY sid, user_id""")
def cursor_ingest(spark, sf_dir):
    """Every eighth view is display-only in the canonical header list; some composers are drafts. The older
    list has some that the table lacks, and fills in for drafts."""
    ev = events(spark, sf_dir).where(F.col("event_type").isin("view", "click"))
    at = F.unix_millis("ts")
    stage = Stage.shared(spark)
    heads = stage(ev.groupBy("session_id", "user_id").agg(
        F.min(at).alias("at"), F.collect_list(F.struct(
            F.concat(F.lit("b"), "event_id").alias("bubbleId"), F.when(F.col("event_type") == "view", 1).otherwise(2).alias("type"),
            (F.col("k") % 8 == 0).alias("isDisplayOnly"))).alias("list")), "composers")
    modern = heads.where(F.col("user_id") % 6 != 5).select(
        F.lit("s").alias("store_id"), F.col("session_id").alias("composerId"), F.col("at").alias("createdAt"),
        F.lit(0).cast("bigint").alias("lastUpdatedAt"), F.when(F.col("user_id") % 7 == 3, 1).otherwise(0).cast("bigint").alias("isSubagent"),
        _json(isDraft=F.col("user_id") % 9 == 2).alias("value"), F.lit(0).cast("bigint").alias("row_n"))
    listed = (F.col("user_id") % 6 == 5) | (F.col("user_id") % 2 == 0)
    items = heads.where(listed).groupBy("user_id").agg(F.collect_list(F.struct(
        F.col("session_id").alias("composerId"), F.col("at").alias("createdAt"))).alias("all")).select(
        F.lit("s").alias("store_id"), F.lit(cursor.LEGACY_KEYS[0]).alias("key"), _json(allComposers=F.col("all")).alias("value"))
    data = heads.select(F.lit("s").alias("store_id"), F.concat(F.lit("composerData:"), "session_id").alias("key"),
                        _json(fullConversationHeadersOnly=F.col("list")).alias("value"), F.lit(0).cast("bigint").alias("row_n"))
    bubbles = ev.select(F.lit("s").alias("store_id"), F.concat_ws(":", F.lit("bubbleId"), "session_id", F.concat(F.lit("b"), "event_id")).alias("key"),
                        _json(type=F.when(F.col("event_type") == "view", 1).otherwise(2), createdAt=at,
                              text=F.concat_ws(" ", F.array_repeat(F.lit("w"), F.col("k") % 7))).alias("value"),
                        F.col("event_id").alias("row_n"))
    t = cursor.normalize(spark, modern, items, data.unionByName(bubbles), modern.select("store_id").distinct(),
        stage=stage)
    return _by_session(t).select("session_id", "is_child", "prompts", "words")


@query("copilot_ingest", _EVK + """
SELECT sid AS session_id, count(*) AS prompts, CAST(sum(k % 7) AS BIGINT) AS words, epoch_us(max(ts)) AS ended
FROM e WHERE event_type IN ('view', 'click') GROUP BY sid""")
def copilot_ingest(spark, sf_dir):
    ev = events(spark, sf_dir)
    sessions = ev.groupBy("session_id").agg(F.min("ts").alias("ts")).select(
        F.lit("s").alias("store_id"), F.col("session_id").alias("id"), F.lit("/w/app").alias("cwd"),
        _iso("ts").alias("created_at"), F.lit("").alias("updated_at"))
    turns = ev.where(F.col("event_type").isin("view", "click")).select(
        F.lit("s").alias("store_id"), "session_id", F.col("event_id").alias("turn_index"), F.concat_ws(" ", F.array_repeat(F.lit("w"), F.col("k") % 7)).alias("user_message"),
        _iso("ts").alias("timestamp"))
    t = copilot.normalize(spark, sessions, turns, sessions.select("store_id").distinct(),
        stage=Stage.shared(spark))
    return _by_session(t).select("session_id", "prompts", "words", F.unix_micros("ended_at").alias("ended"))


@query("antigravity_ingest", f"""
SELECT 'c' || conv_id AS session_id, turn, CAST({WORDS_SQL} AS BIGINT) AS words, CAST(length(text) AS BIGINT) AS characters
FROM conversations WHERE role = 'user'""")
def antigravity_ingest(spark, sf_dir):
    """User turns of a conversation joined into one indexed body, cut back by byte offsets."""
    turns = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("start", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)).cast("bigint"))
    # A body is one value, as long as one conversation.
    packed = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "start"))).alias("all"))
    marks = F.transform("all", lambda x: F.array(x["turn"].cast("bigint"), x["start"]))
    sid = F.concat(F.lit("c"), F.col("conv_id"))
    chunks = packed.select(
        F.lit("s").alias("store_id"), sid.alias("conversation_id"), F.to_json(marks).alias("user_step_byte_offsets"),
        F.array_join(F.transform("all", lambda x: x["text"]), "").cast("binary").alias("user_body"), F.lit(0).cast("bigint").alias("row_n"))
    summaries = packed.select(
        F.lit("s").alias("store_id"), sid.alias("conversation_id"), F.lit("2026-10-20 02:36:18+00:00").alias("last_modified_time"),
        F.lit('["file:///w/app"]').alias("workspace_uris"), F.lit("").alias("parent_conversation_id"), F.lit(0).alias("nesting_depth"),
        F.lit("").alias("last_user_input_time"), F.lit(-1).alias("last_user_input_step_index"))
    none = spark.createDataFrame([], f"store_id string, path string, rel string, line_key {LINE_KEY}, line string, mtime timestamp")
    t = antigravity.normalize(spark, summaries, chunks, none, summaries.select("store_id").distinct(),
        stage=Stage.shared(spark))
    return t.prompts.select("session_id", F.split("event_id", "#")[1].cast("bigint").alias("turn"), "words", "characters")
