"""The readers over files: logs are written below a lake, listed, split, read and normalised with all warnings."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyloom.operators import metrics
from tallyloom.plans.bindings import events
from tallyloom.plans.registry import query
from tallyloom.schemas import Tables
from tallyloom.sources import codex
from tallyloom.sources.lake import Lake, Stage, list_files

#: Threads of the logs, and least bytes of a split: logs of the larger tables have several.
THREADS = 40
SPLIT_BYTES = 32 << 10
#: Splits of all logs together, beyond which splits grow with the logs: each task reports to the driver.
SPLITS = 256


def write_logs(lines: DataFrame, folder: str, stem: str) -> None:
    """A file for each ``file`` below the folder, named ``<stem>-....jsonl``, with its ``line`` rows in the order of ``n``."""
    (lines.repartition("file").sortWithinPartitions("file", "n").select("line", "file")
     .write.option("mapreduce.output.basename", stem).partitionBy("file").mode("append").text(folder))
    # The writer's own ending is fixed; there are as many names as threads or segments.
    spark = lines.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.listFiles(path(folder), True)
    while found.hasNext():
        name = found.next().getPath().toString()
        if name.endswith(".txt"):
            system.rename(path(name), path(name.removesuffix(".txt") + ".jsonl"))


def split_bytes(total: int, most: int) -> int:
    """Bytes of a split of logs of ``total`` bytes: ``SPLITS`` in all, as long as they lie between ``SPLIT_BYTES`` and ``most``."""
    return min(max(SPLIT_BYTES, -(-total // SPLITS)), max(SPLIT_BYTES, most))


@contextmanager
def small_splits(spark: SparkSession, lake: Lake):
    """Splits of :func:`split_bytes` while the readers scan, so that all logs have several and tasks don't grow with them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(lake.base)
    total = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    # The session's own value may carry a unit.
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    names = {"spark.sql.files.maxPartitionBytes": str(split_bytes(total, most)), "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def _iso(at: str) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _event(kind: str, at: str = "ts", **payload: Column) -> Column:
    return _json(timestamp=_iso(at), type=F.lit(kind), payload=F.struct(*[c.alias(n) for n, c in payload.items()]))


def facts(tables: Tables, extra: Sequence[DataFrame] = ()) -> DataFrame:
    """store, kind, name, value: warnings, provider figures and totals of each store."""
    def long(df: DataFrame, kind: str, names: Sequence[str]) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("bigint").alias("value")) for n in names])
        return df.select(F.col("store_id").alias("store"), F.lit(kind).alias("kind"), F.inline(cells))

    providers = tables.providers.withColumns({
        "evidence": F.unix_micros("earliest_local_evidence"), "detailed": F.unix_micros("earliest_detailed_record"),
        "known_incomplete": (F.col("coverage_status") == "known incomplete").cast("bigint"),
        "assessment_incomplete": (F.col("coverage_status") == "coverage assessment incomplete").cast("bigint")})
    sessions = tables.sessions.groupBy("store_id").agg(
        F.count_if(~F.col("is_child")).alias("sessions"), F.count_if("is_child").alias("child_sessions"),
        F.sum("tool_calls").alias("tool_calls"), F.sum("usage.input").alias("input"), F.sum("usage.output").alias("output"))
    prompts = metrics.distinct_prompts(tables.prompts, ["store_id"]).groupBy("store_id").agg(
        F.count(F.lit(1)).alias("prompts"), F.sum("words").alias("words"))
    warned = tables.warnings.select(F.col("store_id").alias("store"), F.lit("warning").alias("kind"),
                                    F.col("code").alias("name"), F.col("n").alias("value"))
    parts = [warned, long(providers, "provider", ["history_only_sessions", "unmaterialized_sessions", "evidence", "detailed",
                                                  "known_incomplete", "assessment_incomplete"]),
             long(sessions, "total", ["sessions", "child_sessions", "tool_calls", "input", "output"]),
             long(prompts, "total", ["prompts", "words"]), *extra]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _stores(df: DataFrame, lake: Lake, write: Callable[[DataFrame, str], None]) -> None:
    """Even threads are of store ``a``, odd ones of ``b``."""
    for store, rest in (("a", 0), ("b", 1)):
        write(df.where(F.col("g") % 2 == rest), f"{lake.base}/{store}")


# --- rollouts, prompt history, session index -----------------------------------------------

_CODEX = f"""
WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, user_id % {THREADS} AS g FROM events),
r AS (SELECT *, CASE WHEN g % 2 = 0 THEN 'a' ELSE 'b' END AS store,
             event_type = 'click' AND k % 17 = 0 AS broken, event_type = 'click' AND k % 17 = 1 AS blank FROM e),
asked AS (SELECT * FROM r WHERE event_type IN ('view', 'click') AND NOT broken AND NOT blank AND k % 7 > 0
            AND NOT (event_type = 'view' AND k % 11 = 0)),
kept AS (SELECT * FROM asked QUALIFY row_number() OVER (PARTITION BY g, event_id % 50 ORDER BY event_id) = 1),
used AS (SELECT g, arg_max(k, CAST(k AS BIGINT) * 1000000000 + event_id) AS i, arg_max(event_id, CAST(k AS BIGINT) * 1000000000 + event_id) AS o
         FROM r WHERE event_type = 'purchase' GROUP BY g),
s AS (SELECT store, g, min(ts) AS st, count(DISTINCT event_id % 4) FILTER (event_type = 'error') AS calls FROM r GROUP BY ALL),
old AS (SELECT * FROM r WHERE event_type = 'view' AND user_id % 5 = 1),
solo AS (SELECT store, user_id, min(date_trunc('second', ts)) AS st FROM old WHERE user_id % 10 = 6 GROUP BY ALL),
idx AS (SELECT DISTINCT store, user_id FROM r WHERE user_id % 4 = 2),
lost AS (SELECT store, count(*) AS n FROM idx WHERE user_id % 16 <> 6 AND user_id % 8 = 2 GROUP BY store),
gaps AS (SELECT store, count(*) FILTER (event_type = 'view' AND user_id % 10 = 6) + count(*) FILTER (user_id % 4 = 2 AND user_id % 16 <> 6) > 0 AS gap,
           count(*) FILTER (broken OR (event_type = 'error' AND k % 13 = 0) OR user_id % 16 = 6) > 0 AS loss FROM r GROUP BY store),
shown AS (SELECT store, 1 AS own, words FROM (SELECT store, k % 7 AS words FROM kept WHERE g % 7 <> 3)
          UNION ALL SELECT store, 1, 2 FROM old WHERE user_id % 10 = 6),
f AS (
  SELECT store, 'warning' AS kind, 'malformed_record' AS name, count(*) AS value FROM r WHERE broken GROUP BY store
  UNION ALL SELECT store, 'warning', 'duplicate_prompt_event', (SELECT count(*) FROM asked a WHERE a.store = r.store) - (SELECT count(*) FROM kept a WHERE a.store = r.store)
    FROM r GROUP BY store
  UNION ALL SELECT store, 'warning', 'duplicate_turn_context', count(*) - count(DISTINCT g * 5 + event_id % 5) FROM r WHERE event_type = 'signup' GROUP BY store
  UNION ALL SELECT store, 'warning', 'duplicate_tool_call', count(*) - count(DISTINCT g * 4 + event_id % 4) FROM r WHERE event_type = 'error' GROUP BY store
  UNION ALL SELECT store, 'warning', 'malformed_history_record', count(*) FROM r WHERE event_type = 'error' AND k % 13 = 0 GROUP BY store
  UNION ALL SELECT store, 'warning', 'history_records_reconciled', count(*) FROM old WHERE user_id % 10 = 1 GROUP BY store
  UNION ALL SELECT store, 'warning', 'history_only_sessions', count(*) FROM solo GROUP BY store
  UNION ALL SELECT store, 'warning', 'malformed_session_index_record', count(*) FROM idx WHERE user_id % 16 = 6 GROUP BY store
  UNION ALL SELECT store, 'warning', 'index_only_sessions', n FROM lost
  UNION ALL SELECT store, 'provider', 'history_only_sessions', (SELECT count(*) FROM solo o WHERE o.store = s.store) FROM s GROUP BY store
  UNION ALL SELECT store, 'provider', 'unmaterialized_sessions', coalesce((SELECT n FROM lost o WHERE o.store = s.store), 0) FROM s GROUP BY store
  UNION ALL SELECT store, 'provider', 'evidence', epoch_us(least(min(st), coalesce((SELECT min(st) FROM solo o WHERE o.store = s.store), min(st)),
      coalesce((SELECT min(TIMESTAMP '2023-12-01' + to_days(CAST(user_id % 20 AS INTEGER))) FROM idx o WHERE o.store = s.store AND user_id % 16 <> 6), min(st))))
    FROM (SELECT store, g, CASE WHEN g % 7 <> 3 THEN st END AS st FROM s) s GROUP BY store
  UNION ALL SELECT store, 'provider', 'detailed', epoch_us(min(st) FILTER (g % 7 <> 3)) FROM s GROUP BY store
  UNION ALL SELECT store, 'provider', 'known_incomplete', CAST(gap AS INTEGER) FROM gaps
  UNION ALL SELECT store, 'provider', 'assessment_incomplete', CAST(NOT gap AND loss AS INTEGER) FROM gaps
  UNION ALL SELECT store, 'total', 'sessions', count(*) FILTER (g % 7 <> 3) + (SELECT count(*) FROM solo o WHERE o.store = s.store) FROM s GROUP BY store
  UNION ALL SELECT store, 'total', 'child_sessions', count(*) FILTER (g % 7 = 3) FROM s GROUP BY store
  UNION ALL SELECT store, 'total', 'tool_calls', sum(calls) FROM s GROUP BY store
  UNION ALL SELECT store, 'total', 'input', coalesce(sum(i), 0) FROM s LEFT JOIN used USING (g) GROUP BY store
  UNION ALL SELECT store, 'total', 'output', coalesce(sum(o), 0) FROM s LEFT JOIN used USING (g) GROUP BY store
  UNION ALL SELECT store, 'total', 'prompts', sum(own) FROM shown GROUP BY store
  UNION ALL SELECT store, 'total', 'words', sum(words) FROM shown GROUP BY store
  UNION ALL SELECT store, 'listing', 'rollouts', count(*) FROM s GROUP BY store)
SELECT store, kind, name, CAST(value AS BIGINT) AS value FROM f WHERE kind <> 'warning' OR value > 0
"""


@query("codex_read", _CODEX)
def codex_read(spark, sf_dir):
    """Rollouts under two roots of two stores, with broken and blank lines and injected text, prompt history and index."""
    ev = events(spark, sf_dir).withColumn("g", F.col("user_id") % THREADS)
    k, kind, ident = F.col("k"), F.col("event_type"), F.col("event_id")
    words = F.concat_ws(" ", F.array_repeat(F.lit("w"), k % 7))
    message = F.when((kind == "view") & (k % 11 == 0), F.concat(F.lit("<environment_context> "), words)).otherwise(words)
    line = (F.when((kind == "click") & (k % 17 == 0), '{"type": ').when((kind == "click") & (k % 17 == 1), "")
            .when(kind.isin("view", "click"), _event("event_msg", type=F.lit("user_message"), id=F.concat_ws("-", F.lit("p"), "g", ident % 50), message=message))
            .when(kind == "signup", _event("turn_context", turn_id=F.concat(F.lit("t"), ident % 5), model=F.concat(F.lit("m"), k % 3)))
            .when(kind == "error", _event("response_item", type=F.lit("function_call"), call_id=F.concat(F.lit("c"), ident % 4)))
            .otherwise(_event("event_msg", type=F.lit("token_count"), info=F.struct(F.struct(
                k.alias("input_tokens"), ident.alias("output_tokens"), k.alias("total_tokens")).alias("total_token_usage")))))
    name = F.concat(F.lit("u"), F.col("g"))
    heads = ev.groupBy("g").agg(F.min("ts").alias("ts")).select("g", F.lit(-1).cast("bigint").alias("n"), _event(
        "session_meta", id=name, parent_thread_id=F.when(F.col("g") % 7 == 3, F.lit("up")), cwd=F.lit("/w/p")).alias("line"))
    rollouts = ev.select("g", ident.alias("n"), line.alias("line")).unionByName(heads).withColumn("file", name)

    user = F.col("user_id")
    shown = _json(session_id=F.concat(F.when(user % 10 == 1, F.concat(F.lit("u"), F.col("g"))).otherwise(F.concat(F.lit("h"), user))),
                  text=F.lit("w w"), ts=F.unix_seconds("ts"))
    history = ev.where((kind == "view") & (user % 5 == 1)).select("g", ident.alias("n"), shown.alias("line")).unionByName(
        ev.where((kind == "error") & (k % 13 == 0)).select("g", ident.alias("n"), F.lit('{"text": "y"}').alias("line")))
    named = F.when(user % 16 == 6, "").when(user % 8 == 2, F.concat(F.lit("x"), user)).otherwise(F.concat(F.lit("u"), F.col("g")))
    updated = F.lit("2023-12-01").cast("timestamp") + F.make_dt_interval((user % 20).cast("int"))
    index = ev.where(user % 4 == 2).select("g", user.alias("n")).distinct().withColumn("user_id", F.col("n")) \
        .withColumn("updated", updated).select("g", "n", _json(id=named, updated_at=_iso("updated")).alias("line"))

    stage = Stage.shared(spark)
    lake = Lake(f"{stage.folder}/lake")
    first = F.col("g") % 3 > 0
    _stores(rollouts.where(first), lake, lambda df, to: write_logs(df, f"{to}/codex/sessions", "rollout"))
    _stores(rollouts.where(~first), lake, lambda df, to: write_logs(df, f"{to}/codex/archived_sessions", "rollout"))
    # One file for each store, as in a home: line numbers of a history are parts of its prompts' ids.
    _stores(history.withColumn("file", F.lit("all")), lake, lambda df, to: write_logs(df, f"{to}/codex/history.jsonl", "part"))
    _stores(index.withColumn("file", F.concat(F.lit("m"), F.col("n") % 3)), lake, lambda df, to: write_logs(df, f"{to}/codex/session_index.jsonl", "part"))
    with small_splits(spark, lake):
        listed = list_files(spark, lake, "codex_rollouts").groupBy(F.col("store_id").alias("store")).agg(
            F.lit("listing").alias("kind"), F.lit("rollouts").alias("name"), F.count(F.lit(1)).alias("value"))
        return facts(codex.read(spark, lake, stage), [listed])


# --- segments of one record -----------------------------------------------------------------

#: Bytes of the first line of a segment, padded so that its length doesn't depend on the offset it states.
HEAD_BYTES = 400

_CHAINS = f"""
WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, user_id % {THREADS} AS g, day(ts) // 8 AS seg FROM events),
c AS (SELECT g, count(DISTINCT seg) AS n, max(seg) AS last FROM e GROUP BY g),
w AS (SELECT e.*, n, last, n > 1 AND g % 5 <> 0 AS stitched FROM e JOIN c USING (g)),
used AS (SELECT * FROM w WHERE stitched OR n = 1 OR seg = last),
p AS (SELECT g, count(*) AS prompts, sum(k % 7) AS words FROM used WHERE event_type <> 'purchase' AND k % 7 > 0 GROUP BY g),
t AS (SELECT g, sum(k) AS i FROM (SELECT g, seg, max(k) AS k FROM used WHERE event_type = 'purchase' GROUP BY ALL) GROUP BY g)
SELECT 'u' || g AS name, prompts, CAST(words AS BIGINT) AS words, CAST(coalesce(i, 0) AS BIGINT) AS input FROM c JOIN p USING (g) LEFT JOIN t USING (g)
UNION ALL SELECT 'stitched_history_segments', sum(n - 1), NULL, NULL FROM c WHERE g % 5 <> 0 AND n > 1
UNION ALL SELECT 'ambiguous_history_chain_suppressed', sum(n - 1), NULL, NULL FROM c WHERE g % 5 = 0 AND n > 1
UNION ALL SELECT 'unvalidated_same_id_rollout_suppressed', sum(n - 1), NULL, NULL FROM c WHERE g % 5 = 0 AND n > 1
UNION ALL SELECT 'identical_rollout_copy_suppressed', count(DISTINCT g), NULL, NULL FROM c WHERE g % 4 = 1
"""


@query("codex_chains", _CHAINS)
def codex_chains(spark, sf_dir):
    """Threads in up to four files: each continues the one before inside of it; some offsets are wrong, some files copied."""
    ev = events(spark, sf_dir).withColumns({"g": F.col("user_id") % THREADS, "seg": F.floor(F.dayofmonth("ts") / 8)})
    stage = Stage.shared(spark)
    spans = ev.groupBy("g", "seg").agg(F.count(F.lit(1)).alias("lines"), F.min("ts").alias("ts"), F.max("ts").alias("until"))
    # At most four segments of a thread, and a line more for the head of each.
    order = Window.partitionBy("g").orderBy("seg")
    spans = spans.withColumn("first", F.coalesce(F.sum(F.col("lines") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    spans = spans.withColumn("more", F.lead("seg").over(order).isNotNull())
    name, k = F.concat(F.lit("u"), F.col("g")), F.col("k")
    chunked = ev.join(spans.select("g", "seg", "first"), ["g", "seg"])
    inside = Window.partitionBy("g", "seg", F.dayofmonth("ts")).orderBy("event_id")
    days = chunked.groupBy("g", "seg", F.dayofmonth("ts").alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    starts = days.select("g", "seg", "_day", F.coalesce(F.sum("_n").over(
        Window.partitionBy("g", "seg").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_from"))
    numbered = chunked.withColumns({"_nth": F.row_number().over(inside), "_day": F.dayofmonth("ts")}).join(starts, ["g", "seg", "_day"])
    numbered = numbered.withColumn("ordinal", F.col("first") + F.col("_from") + F.col("_nth"))
    body = F.struct(F.lit("UserMessage").alias("type"), F.concat(F.lit("p"), F.col("event_id")).alias("id"), F.array(F.struct(
        F.lit("input_text").alias("type"), F.concat_ws(" ", F.array_repeat(F.lit("w"), k % 7)).alias("text"))).alias("content"))
    record = F.when(F.col("event_type") == "purchase", _json(
        ordinal=F.col("ordinal"), timestamp=_iso("ts"), type=F.lit("event_msg"), payload=F.struct(F.lit("token_count").alias("type"), F.struct(
            F.struct(k.alias("input_tokens"), k.alias("total_tokens")).alias("total_token_usage")).alias("info")))).otherwise(_json(
                ordinal=F.col("ordinal"), timestamp=_iso("ts"), type=F.lit("event_msg"),
                payload=F.struct(F.lit("item_completed").alias("type"), body.alias("item"))))
    lines = stage(numbered.select("g", "seg", F.col("ordinal").alias("n"), record.alias("line")), "lines")
    sizes = lines.groupBy("g", "seg").agg(F.sum(F.octet_length("line") + 1).alias("_bytes"))
    heads = spans.join(sizes, ["g", "seg"]).withColumn("offset", F.lag(F.col("_bytes") + HEAD_BYTES + 1).over(order))
    heads = heads.withColumn("offset", F.col("offset") - F.when((F.col("g") % 5 == 0) & ~F.col("more"), 7).otherwise(0))
    base = F.struct(name.alias("thread_id"), F.col("offset").alias("end_byte_offset"), F.col("first").alias("end_ordinal_exclusive"))
    meta = _json(ordinal=F.col("first"), timestamp=_iso("ts"), type=F.lit("session_meta"), payload=F.struct(
        name.alias("id"), name.alias("session_id"), F.lit("paginated").alias("history_mode"),
        F.when(F.col("offset").isNotNull(), base).alias("history_base")))
    tail = _json(ordinal=F.col("first") + F.col("lines") + 1, timestamp=_iso("until"), type=F.lit("event_msg"), payload=F.struct(
        F.lit("item_completed").alias("type"), F.struct(F.lit("UserMessage").alias("type"), F.lit("dropped").alias("id"), F.array(F.struct(
            F.lit("input_text").alias("type"), F.lit("not kept").alias("text"))).alias("content")).alias("item")))
    heads = stage(heads, "heads")
    whole = lines.unionByName(heads.select("g", "seg", F.col("first").alias("n"), F.rpad(meta, HEAD_BYTES, " ").alias("line"))).unionByName(
        heads.where("more").select("g", "seg", (F.col("first") + F.col("lines") + 1).alias("n"), tail.alias("line")))
    whole = whole.withColumn("file", F.concat_ws("-", name, "seg"))
    lake = Lake(f"{stage.folder}/lake")
    write_logs(whole, f"{lake.base}/a/codex/sessions", "rollout")
    firsts = spans.groupBy("g").agg(F.min("seg").alias("seg")).where("g % 4 = 1")
    write_logs(whole.join(firsts, ["g", "seg"], "left_semi"), f"{lake.base}/a/codex/recovery", "rollout")
    with small_splits(spark, lake):
        t = codex.read(spark, lake, stage)
    prompts = t.prompts.groupBy("session_id").agg(F.count(F.lit(1)).alias("prompts"), F.sum("words").alias("words"))
    none = F.lit(None).cast("bigint")
    return t.sessions.join(prompts, "session_id").select(F.col("session_id").alias("name"), "prompts", "words", F.col("usage.input").alias("input")) \
        .unionByName(t.warnings.select(F.col("code").alias("name"), F.col("n").alias("prompts"), none.alias("words"), none.alias("input")))
