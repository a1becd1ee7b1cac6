"""Reconciliation, copies, updates, chains, manifests and scalars on the driver tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tallyloom.functions import text
from tallyloom.operators import audit, chain, copies, dedupe, ordered, reconcile, replay, tree
from tallyloom.plans.bindings import EV, ev_calls, ev_sessions, events, table
from tallyloom.plans.registry import query
from tallyloom.schemas import usage
from tallyloom.sources.lake import Stage

SCOPE = ["store_id", "harness"]


@query("history_antijoin", EV + """
SELECT p.harness, count(*) FILTER (NOT d) AS kept, count(*) FILTER (d) AS suppressed
FROM (SELECT e.harness, EXISTS (SELECT 1 FROM sessions s WHERE s.harness = e.harness AND s.session_id = e.session_id
                                AND s.countable AND s.has_calls) AS d
      FROM ev e WHERE e.event_type = 'view') p GROUP BY p.harness""")
def history_antijoin(spark, sf_dir):
    from tallyloom.operators.metrics import countable_root

    history = events(spark, sf_dir).where(F.col("event_type") == "view").select(*SCOPE, "session_id")
    detailed = ev_sessions(spark, sf_dir).where(countable_root() & F.col("has_calls"))
    alone, suppressed = reconcile.split_history(history, detailed, SCOPE + ["session_id"])
    both = alone.groupBy("harness").agg(F.count(F.lit(1)).alias("kept")).unionByName(
        suppressed.groupBy("harness").agg(F.count(F.lit(1)).alias("suppressed")), True)
    return both.groupBy("harness").agg(F.coalesce(F.max("kept"), F.lit(0)).alias("kept"),
                                       F.coalesce(F.max("suppressed"), F.lit(0)).alias("suppressed"))


@query("history_bag_minus", """
WITH l AS (SELECT event_id, user_id, CAST(ts AS DATE) AS d, row_number() OVER (
             PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'view'),
r AS (SELECT user_id, CAST(ts AS DATE) AS d, row_number() OVER (
             PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'click')
SELECT event_id FROM l ANTI JOIN r USING (user_id, d, rn)""")
def history_bag_minus(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "event_type", "user_id", "ts", F.to_date("ts").alias("d"),
                                        F.hour("ts").alias("_hour"))
    left, right = (rows.where(F.col("event_type") == t) for t in ("view", "click"))
    return reconcile.bag_minus(left, right, ["user_id", "d"], ["_hour"], ["ts", "event_id"]).select("event_id")


def _references(spark, sf_dir):
    kinds = F.create_map(*[F.lit(x) for x in ("signup", "index", "error", "state", "purchase", "catalog")])
    ranks = F.create_map(*[F.lit(x) for x in ("signup", 0, "error", 1, "purchase", 2)])
    kind = F.col("event_type")
    return events(spark, sf_dir).where(kind.isin("signup", "error", "purchase")).select(
        *SCOPE, kinds[kind].alias("source"), ranks[kind].alias("source_rank"), F.col("session_id").alias("ref_id"))


_REFS = EV + """,
refs AS (SELECT harness, session_id, CASE event_type WHEN 'signup' THEN 'index' WHEN 'error' THEN 'state' ELSE 'catalog' END AS source,
                CASE event_type WHEN 'signup' THEN 0 WHEN 'error' THEN 1 ELSE 2 END AS r
         FROM ev WHERE event_type IN ('signup', 'error', 'purchase')),
known AS (SELECT harness, session_id FROM sessions WHERE countable)
"""


@query("unmaterialized_refs", _REFS + """
SELECT harness, first_source, count(*) AS refs FROM (
  SELECT harness, session_id, arg_min(source, r) AS first_source FROM refs ANTI JOIN known USING (harness, session_id)
  GROUP BY harness, session_id) GROUP BY harness, first_source""")
def unmaterialized_refs(spark, sf_dir):
    from tallyloom.operators.metrics import countable_root

    known = ev_sessions(spark, sf_dir).where(countable_root())
    lost = reconcile.unmaterialized(_references(spark, sf_dir), known, SCOPE)
    return lost.groupBy("harness", "first_source").agg(F.count(F.lit(1)).alias("refs"))


@query("reconciled_refs", _REFS + """
SELECT harness, source, count(DISTINCT session_id) AS reconciled FROM refs SEMI JOIN known USING (harness, session_id)
GROUP BY harness, source""")
def reconciled_refs(spark, sf_dir):
    from tallyloom.operators.metrics import countable_root

    known = ev_sessions(spark, sf_dir).where(countable_root())
    return reconcile.reconciled(_references(spark, sf_dir), known, SCOPE).select("harness", "source", "reconciled")


@query("missing_bodies", EV + """
SELECT harness, count(*) AS missing FROM (SELECT DISTINCT harness, event_id % 3000 AS b FROM ev WHERE event_type = 'view')
ANTI JOIN (SELECT DISTINCT harness, event_id % 3000 AS b FROM ev WHERE event_type = 'click') USING (harness, b)
GROUP BY harness""")
def missing_bodies(spark, sf_dir):
    rows = events(spark, sf_dir).select("harness", "event_type", (F.col("event_id") % 3000).alias("bubble_id"))
    heads, bodies = (rows.where(F.col("event_type") == t) for t in ("view", "click"))
    lost = reconcile.missing_rows(heads.select("harness", "bubble_id").distinct(), bodies, ["harness", "bubble_id"])
    return lost.groupBy("harness").agg(F.count(F.lit(1)).alias("missing"))


@query("undiscovered_paths", """
SELECT o_orderpriority, count(*) AS undiscovered FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey
GROUP BY o_orderpriority""")
def undiscovered_paths(spark, sf_dir):
    def path(c):
        return F.concat(F.lit("/lake/s/codex/sessions/rollout-"), F.col(c), F.lit(".jsonl")).alias("path")

    named = table(spark, sf_dir, "orders").select("o_orderpriority", path("o_orderkey"))
    found = table(spark, sf_dir, "lineitem", "l_orderkey").select(path("l_orderkey"))
    lost = reconcile.missing_rows(named, found, ["path"])
    return lost.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("undiscovered"))


@query("catalog_hosts", """
WITH j AS (SELECT c_custkey, n_nationkey, n_regionkey % 3 AS kind FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT count(*) FILTER (kind = 1) AS remote_sessions, count(DISTINCT n_nationkey) FILTER (kind = 1) AS remote_hosts,
       count(DISTINCT c_custkey) FILTER (kind = 0) AS local_ids FROM j""")
def catalog_hosts(spark, sf_dir):
    catalog = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").withColumnRenamed("c_nationkey", "host_id")
    hosts = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").select(
        F.col("n_nationkey").alias("host_id"), (F.col("n_regionkey") % 3).alias("kind"))
    joined = catalog.join(hosts, "host_id")
    remote = F.col("kind") == 1
    return joined.agg(F.count_if(remote).alias("remote_sessions"),
                      F.count_distinct(F.when(remote, F.col("host_id"))).alias("remote_hosts"),
                      F.count_distinct(F.when(F.col("kind") == 0, F.col("c_custkey"))).alias("local_ids"))


@query("copy_coalesce", EV + """,
files AS (SELECT harness, session_id, user_id, event_id % 3 AS path, min(ts) AS s, max(ts) AS e,
                 user_id % 11 = 5 AND event_id % 3 = 0 AS un, user_id % 7 = 6 AND event_id % 3 = 1 AS ut,
                 CASE WHEN min(event_id) % 4 <> 0 THEN 'p' || (min(event_id) % 4) END AS project
          FROM ev GROUP BY ALL),
base AS (SELECT harness, session_id, bool_or(NOT un AND NOT ut) AS anyv, min(path) FILTER (NOT un AND NOT ut) AS fv,
                min(path) AS f FROM files GROUP BY ALL)
SELECT harness, session_id, epoch_us(min(s) FILTER (NOT anyv OR (NOT un AND NOT ut))) AS started,
       epoch_us(max(e) FILTER (NOT anyv OR (NOT un AND NOT ut))) AS ended, bool_and(un) AS unanchored,
       NOT bool_or(anyv) AND bool_or(ut) AS untimed, count(*) AS copies,
       arg_min(project, path) FILTER (project IS NOT NULL AND path >= coalesce(fv, f)) AS project
FROM files JOIN base USING (harness, session_id) GROUP BY harness, session_id""")
def copy_coalesce(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("path", (F.col("event_id") % 3).cast("string"))
    first = F.min("event_id")
    files = ev.groupBy(*SCOPE, "session_id", "user_id", "path").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"),
        F.when(first % 4 != 0, F.concat(F.lit("p"), (first % 4).cast("string"))).alias("project"))
    user = F.col("user_id")
    files = files.withColumns({
        "session_key": F.col("session_id"), "parent_id": F.lit(None).cast("string"), "is_child": F.lit(False),
        "activity_basis": F.lit("recorded"), "history_only": F.lit(False),
        "unanchored": (user % 11 == 5) & (F.col("path") == "0"),
        "time_unavailable": (user % 7 == 6) & (F.col("path") == "1")})
    merged = copies.coalesce_sessions(files)
    return merged.select("harness", "session_id", F.unix_micros("started_at").alias("started"),
                         F.unix_micros("ended_at").alias("ended"), "unanchored",
                         F.col("time_unavailable").alias("untimed"), "copies", "project")


@query("copied_calls", EV + """
SELECT user_id, id AS call_id, first(model ORDER BY ts, pos) FILTER (model IS NOT NULL) AS model, count(*) AS copies
FROM (SELECT user_id, CAST(event_id % 300 AS VARCHAR) AS id, CASE WHEN k % 5 <> 4 THEN 'm' || (k % 5) END AS model,
             ts, event_id AS pos FROM ev WHERE event_type = 'purchase') GROUP BY user_id, id""")
def copied_calls(spark, sf_dir):
    rows = events(spark, sf_dir).where(F.col("event_type") == "purchase").select(
        *SCOPE, F.col("user_id").alias("session_key"), (F.col("event_id") % 300).cast("string").alias("call_id"),
        F.struct(F.lit("p").alias("path"), F.unix_micros("ts").alias("block"), F.col("event_id").alias("n")).alias("line_key"),
        F.when(F.col("k") % 5 != 4, F.concat(F.lit("m"), (F.col("k") % 5).cast("string"))).alias("model"),
        usage("u", F.col("k") % 9 != 0, input=F.col("k") % 2, output=F.col("k")).alias("usage"))
    merged, _ = copies.merge_calls(rows)
    return merged.select(F.col("session_key").alias("user_id"), "call_id", "model", "copies")


@query("copied_history_annotation", EV + """,
v AS (SELECT harness, id, model, available, CASE WHEN available THEN u_input ELSE 0 END AS i,
             CASE WHEN available THEN u_output ELSE 0 END AS o, session_at, session_id, ts, pos
      FROM calls WHERE NOT is_child AND id IS NOT NULL),
f AS (SELECT *, first_value(model) OVER w AS fm, first_value(available) OVER w AS fa, first_value(i) OVER w AS fi,
             first_value(o) OVER w AS fo FROM v WINDOW w AS (PARTITION BY harness, id ORDER BY session_at, session_id, ts, pos))
SELECT harness, count(*) - count(DISTINCT id) AS repeats,
       count(*) FILTER (available <> fa OR i <> fi OR o <> fo) AS usage_conflicts,
       count(*) FILTER (model IS DISTINCT FROM fm) AS model_conflicts FROM f GROUP BY harness""")
def copied_history_annotation(spark, sf_dir):
    roots = ev_calls(spark, sf_dir).where(~F.col("is_child"))
    return dedupe.annotate_copies(roots, ["harness"], "call_id", ["session_at", "session_id", "ord"], ["usage", "model"])


@query("digest_dedupe", """
SELECT sha256(text) AS digest, CAST(min(doc_id) AS BIGINT) AS doc_id, count(*) - 1 AS suppressed FROM documents GROUP BY 1""")
def digest_dedupe(spark, sf_dir):
    files = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("digest"))
    return dedupe.byte_identical(files, [], "digest", "doc_id")


@query("precedence_union", """
SELECT o_orderpriority, source, count(*) AS orders FROM (
  SELECT o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN 'modern' ELSE 'legacy' END AS source FROM orders) GROUP BY ALL""")
def precedence_union(spark, sf_dir):
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority")
    modern = rows.where(F.col("o_orderkey") % 3 == 0).withColumn("source", F.lit("modern"))
    merged = dedupe.precedence_union([modern, rows.withColumn("source", F.lit("legacy"))], ["o_orderkey"], ["o_orderpriority"])
    return merged.groupBy("o_orderpriority", "source").agg(F.count(F.lit(1)).alias("orders"))


@query("prefer_plain", """
SELECT l_linenumber, count(*) FILTER (packed) AS packed, count(*) FILTER (NOT packed) AS plain FROM (
  SELECT l_orderkey, l_linenumber, bool_and(l_returnflag = 'R') AS packed FROM lineitem GROUP BY ALL) GROUP BY 1""")
def prefer_plain(spark, sf_dir):
    stem = F.concat_ws("/", "l_orderkey", "l_linenumber")
    files = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").select(
        "l_linenumber", (F.col("l_returnflag") == "R").alias("packed"),
        F.concat(stem, F.when(F.col("l_returnflag") == "R", ".jsonl.zst").otherwise(".jsonl")).alias("path"))
    kept = dedupe.prefer_variant(files, F.regexp_replace("path", r"\.zst$", ""), F.col("packed"))
    return kept.groupBy("l_linenumber").agg(F.count_if("packed").alias("packed"), F.count_if(~F.col("packed")).alias("plain"))


_LI_ORDER = "l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity"
_LI_KEY = ["l_orderkey", "l_linenumber"]


def _line_updates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem", *_LI_KEY, "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice",
                 "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    ready = F.col("l_returnflag") != "R"
    return rows.withColumns({
        "usage": usage("u", ready, input=F.round(F.col("l_discount") * 100).cast("bigint") % 2, output=F.col("l_quantity")),
        "model": F.when(F.col("l_returnflag") != "N", F.col("l_linestatus")), "_month": F.date_trunc("month", "l_shipdate")})


_UPDATES_SQL = f"""
WITH u AS (SELECT l_orderkey, l_linenumber, {_LI_ORDER.replace(', ', ', ')}, l_returnflag <> 'R' AS ready,
             CASE WHEN l_returnflag <> 'N' THEN l_linestatus END AS model,
             CAST(round(l_discount * 100) AS BIGINT) % 2 AS i, CAST(l_quantity AS BIGINT) AS o FROM lineitem)
"""


@query("update_merge", _UPDATES_SQL + f"""
SELECT l_orderkey, l_linenumber, last(o ORDER BY {_LI_ORDER}) FILTER (ready) AS output,
       last(model ORDER BY {_LI_ORDER}) FILTER (model IS NOT NULL) AS model, count(*) AS records
FROM u GROUP BY l_orderkey, l_linenumber""")
def update_merge(spark, sf_dir):
    position = F.struct(*_LI_ORDER.split(", "))
    merged = dedupe.merge_updates(_line_updates(spark, sf_dir), _LI_KEY, position, F.col("usage"),
                                  F.col("usage.available"), F.col("model"))
    return merged.select(*_LI_KEY, F.col("usage.output").alias("output"), "model", "records")


@query("update_transitions", _UPDATES_SQL + f""",
s AS (SELECT *, last_value(CASE WHEN ready THEN i END IGNORE NULLS) OVER w AS si,
             last_value(CASE WHEN ready THEN o END IGNORE NULLS) OVER w AS so,
             last_value(model IGNORE NULLS) OVER w AS sm, row_number() OVER v AS rn
      FROM u WINDOW v AS (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LI_ORDER}),
                    w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LI_ORDER}
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT CASE WHEN rn = 1 THEN 'first' WHEN si IS NULL AND NOT ready THEN 'same' WHEN si IS NULL THEN 'completed'
            WHEN ready AND si = i AND so = o THEN 'same' WHEN ready AND si = i AND o >= so THEN 'advanced'
            ELSE 'conflict' END AS update_class, count(*) AS records,
       count(*) FILTER (rn > 1 AND sm IS NOT NULL AND model IS NOT NULL AND sm <> model) AS model_changes
FROM s GROUP BY 1""")
def update_transitions(spark, sf_dir):
    classed = dedupe.classify_updates(_line_updates(spark, sf_dir), _LI_KEY, ["_month"], _LI_ORDER.split(", "))
    return classed.groupBy("update_class").agg(F.count(F.lit(1)).alias("records"),
                                               F.count_if("model_changed").alias("model_changes"))


@query("tool_first_owner", """
SELECT l_orderkey, tool_id, CAST(min(l_linenumber) AS INTEGER) AS owner, count(*) - 1 AS duplicates
FROM (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 5 AS VARCHAR) AS tool_id FROM lineitem) GROUP BY ALL""")
def tool_first_owner(spark, sf_dir):
    uses = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate").withColumn(
        "tool_id", (F.col("l_partkey") % 5).cast("string"))
    first = dedupe.keep_first(uses, ["l_orderkey"], "tool_id", ["l_linenumber", "l_shipdate"], ["l_linenumber"])
    return first.select("l_orderkey", "tool_id", F.col("l_linenumber").alias("owner"), (F.col("copies") - 1).alias("duplicates"))


@query("cumulative_final", f"""
WITH r AS (SELECT l_orderkey, l_partkey, sum(l_quantity) OVER w AS total, row_number() OVER w AS rn FROM lineitem
           WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, {_LI_ORDER} ROWS UNBOUNDED PRECEDING))
SELECT l_orderkey, max(total) AS total, arg_max(l_partkey, rn) AS l_partkey FROM r GROUP BY l_orderkey""")
def cumulative_final(spark, sf_dir):
    rows = _line_updates(spark, sf_dir)
    order = ["l_linenumber", *_LI_ORDER.split(", ")]
    totals = ordered.running_sum(rows, ["l_orderkey"], ["l_linenumber", "_month"], _LI_ORDER.split(", "),
                                 F.col("l_quantity"), "total")
    final = dedupe.final_cumulative(totals, ["l_orderkey"], F.struct("total", "l_partkey"), F.col("total"), F.struct(*order))
    return final.select("l_orderkey", "final.total", "final.l_partkey")


@query("segment_stitch", """
WITH seg AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT l_orderkey, count(*) AS segments, count(*) > 1 AND l_orderkey % 5 <> 0 AS stitched FROM seg GROUP BY l_orderkey""")
def segment_stitch(spark, sf_dir):
    """Files are lines of one order; every fifth order claims a wrong boundary."""
    rows = table(spark, sf_dir, "lineitem", *_LI_KEY, "l_shipdate", "l_partkey")
    path = F.concat_ws("/", F.lit("s"), F.col("l_orderkey"), F.col("l_linenumber"))
    stage = Stage.shared(spark)
    # A file's number of lines gives all that its head says; only the lines themselves are ordered.
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber")  # at most seven segments
    counts = rows.groupBy(*_LI_KEY).agg(F.count(F.lit(1)).alias("_n"))
    heads = stage(counts.select(*_LI_KEY, F.coalesce(F.sum("_n").over(
        order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first_ordinal"),
        (F.lag(F.col("_n") * 100).over(order) + F.when(F.col("l_orderkey") % 5 == 0, 50).otherwise(0)).alias("before")), "heads")
    local = Window.partitionBy(*_LI_KEY).orderBy("l_shipdate", "l_partkey")
    inside = F.col("_inside")
    lines = rows.withColumn("_inside", (F.row_number().over(local) - 1).cast("long")).join(heads, _LI_KEY).select(
        F.lit("s").alias("store_id"), path.alias("path"), (F.col("first_ordinal") + inside).alias("ordinal"),
        (inside * 100).alias("start_offset"), ((inside + 1) * 100).alias("end_offset"))
    thread = F.col("l_orderkey").cast("string")
    base = F.struct(thread.alias("thread_id"), F.col("before").alias("end_byte_offset"),
                    F.col("first_ordinal").alias("end_ordinal_exclusive"))
    segments = heads.select(F.lit("s").alias("store_id"), thread.alias("thread_id"), path.alias("path"), "first_ordinal",
                            F.lit(False).alias("packed"), F.when(F.col("before").isNotNull(), base).alias("base"))
    plan = chain.stitch(segments, lines, stage)
    return plan.groupBy(F.col("thread_id").cast("bigint").alias("l_orderkey")).agg(
        F.count(F.lit(1)).alias("segments"), F.bool_or("stitched").alias("stitched"))


def _document_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    lines = docs.select(F.lit("s").alias("store_id"), F.col("doc_id").cast("string").alias("path"),
                        F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    sized = lines.withColumns({"_block": F.floor(F.col("n") / 64), "_bytes": F.octet_length("line") + 1})
    return ordered.running_sum(sized, ["store_id", "path"], ["_block"], ["n"], F.col("_bytes"), "end_offset").withColumn(
        "start_offset", F.col("end_offset") - F.col("_bytes"))


@query("byte_offsets", """
SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS bytes, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines FROM documents""")
def byte_offsets(spark, sf_dir):
    return _document_lines(spark, sf_dir).groupBy(F.col("path").cast("bigint").alias("doc_id")).agg(
        F.max("end_offset").alias("bytes"), F.count(F.lit(1)).alias("lines"))


@query("content_fingerprint", """
SELECT CAST(min(doc_id) AS BIGINT) AS doc_id, count(*) AS copies FROM documents GROUP BY text""")
def content_fingerprint(spark, sf_dir):
    prints = chain.fingerprint(_document_lines(spark, sf_dir))
    return prints.groupBy("digest").agg(F.min(F.col("path").cast("bigint")).alias("doc_id"),
                                        F.count(F.lit(1)).alias("copies")).drop("digest")


@query("ordinal_ids", EV + """
SELECT event_id, session_id || '#' || (row_number() OVER (PARTITION BY harness, session_id ORDER BY ts, event_id) - 1) AS ordinal_id
FROM ev WHERE event_type IN ('view', 'click')""")
def ordinal_ids(spark, sf_dir):
    rows = events(spark, sf_dir).where(F.col("event_type").isin("view", "click")).withColumn("_hour", F.hour("ts"))
    ranked = ordered.rank(rows, ["harness", "session_id"], ["_hour"], ["ts", "event_id"], "_n")
    return ranked.select("event_id", F.concat_ws("#", "session_id", (F.col("_n") - 1).cast("string")).alias("ordinal_id"))


@query("first_project", EV + """
SELECT harness, user_id, first('p' || (k % 12) ORDER BY ts, event_id) FILTER (k % 13 <> 0) AS project FROM ev GROUP BY ALL""")
def first_project(spark, sf_dir):
    k = F.col("k")
    named = F.when(k % 13 != 0, F.struct("ts", "event_id"))
    return events(spark, sf_dir).groupBy("harness", "user_id").agg(
        F.min_by(F.concat(F.lit("p"), (k % 12).cast("string")), named).alias("project"))


def _snapshots(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    path = F.concat_ws("/", F.lit(""), "source", "doc_id")
    files = docs.select("doc_id", path.alias("path"), F.lit(True).alias("exists"), F.sha2("text", 256).alias("sha256"),
                        F.octet_length("text").cast("bigint").alias("size"), F.lit(True).alias("complete"))
    changed = F.sha2(F.concat("sha256", F.lit("x")), 256)
    after = files.where(F.col("doc_id") % 50 != 7).withColumn(
        "sha256", F.when(F.col("doc_id") % 40 == 3, changed).otherwise(F.col("sha256")))
    return files, after


@query("manifest_diff", """
SELECT CASE WHEN doc_id % 50 = 7 THEN 'removed' WHEN doc_id % 40 = 3 THEN 'modified' ELSE 'same' END AS state, count(*) AS files
FROM documents GROUP BY 1""")
def manifest_diff(spark, sf_dir):
    before, after = _snapshots(spark, sf_dir)
    states = audit.diff(before, after, "path", ["exists", "sha256", "size"])
    return states.groupBy("state").agg(F.count(F.lit(1)).alias("files"))


_PIECES = ", ".join(f"bit_xor(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT))" for i in range(4))


@query("manifest_digest", f"""
WITH l AS (SELECT DISTINCT sha256('file' || chr(0) || '/' || source || '/' || doc_id || chr(0) || 'true' || chr(0) ||
                                  sha256(text) || chr(0) || strlen(text)) AS h FROM documents)
SELECT sha256(concat_ws(':', count(*), {_PIECES})) AS manifest FROM l""")
def manifest_digest(spark, sf_dir):
    return audit.manifest_digest(audit.manifest_lines(_snapshots(spark, sf_dir)[0]))


@query("manifest_compare", """
SELECT count(*) AS files, count(*) FILTER (doc_id % 50 = 7 OR doc_id % 40 = 3) AS changed_files,
       count(DISTINCT source) FILTER (doc_id % 50 = 7) AS directory_changes, false AS verified FROM documents""")
def manifest_compare(spark, sf_dir):
    before, after = _snapshots(spark, sf_dir)
    dirs = [audit.directory_inventory(f.select("path")).where(F.col("path") != "/") for f in (before, after)]
    row = audit.compare(before, after, *dirs)
    return row.select("files", "changed_files", "directory_changes", "verified")


def _trees(spark, sf_dir):
    """Texts as files, two levels deep; some change, some go, one directory becomes a link, an empty one is only there later."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source").withColumn("source", F.coalesce("source", F.lit("-")))
    k = F.col("doc_id")
    path = F.concat_ws("/", F.lit("/r"), "source", k % 7, k)
    files = docs.select("doc_id", path.alias("path"), F.lit("file").alias("kind"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content"))
    after = files.where((k % 50 != 7) & (k % 7 != 3)).withColumn(
        "content", F.when((k % 40 == 3) & (k % 7 == 1), F.sha2(F.concat("content", F.lit("x")), 256)).otherwise(F.col("content")))
    odd = docs.select("source").distinct().select(
        F.inline(F.array(F.struct(F.concat(F.lit("/r/"), "source", F.lit("/3")).alias("path"), F.lit("link").alias("kind"), F.lit("/x").alias("content")),
                         F.struct(F.concat(F.lit("/r/"), "source", F.lit("/empty")).alias("path"), F.lit("dir").alias("kind"), F.lit("").alias("content")))))
    stage = Stage.shared(spark)
    return (tree.build(files.drop("doc_id"), lambda df, name: stage(df, f"before-{name}")),
            tree.build(after.drop("doc_id").unionByName(odd), lambda df, name: stage(df, f"after-{name}")), stage)


_TREE = """
WITH d AS (SELECT doc_id, coalesce(source, '-') AS source, doc_id % 7 AS part, '/r/' || coalesce(source, '-') || '/' || doc_id % 7 AS dir
  FROM documents),
f AS (SELECT *, CASE WHEN part = 3 OR doc_id % 50 = 7 THEN 'removed' WHEN doc_id % 40 = 3 AND part = 1 THEN 'modified' END AS state FROM d),
dirs AS (SELECT dir, source, part, count(*) AS n, count(*) FILTER (state = 'removed') AS gone, count(state) AS changed FROM f GROUP BY ALL)
"""


@query("tree_changes", _TREE + """
SELECT dir || '/' || doc_id AS path, 'file' AS kind, state FROM f WHERE state IS NOT NULL
UNION ALL SELECT dir, CASE WHEN part = 3 THEN 'link' ELSE 'dir' END, CASE WHEN part <> 3 AND gone = n THEN 'removed' ELSE 'modified' END
  FROM dirs WHERE changed > 0
UNION ALL SELECT '/r/' || source || '/3', 'link', 'added' FROM dirs GROUP BY source HAVING count(*) FILTER (part = 3) = 0
UNION ALL SELECT DISTINCT '/r/' || source || '/empty', 'dir', 'added' FROM d
UNION ALL SELECT DISTINCT '/r/' || source, 'dir', 'modified' FROM d
UNION ALL VALUES ('/r', 'dir', 'modified'), ('', 'dir', 'modified')""")
def tree_changes(spark, sf_dir):
    """What differs between two trees, found from the root down."""
    before, after, stage = _trees(spark, sf_dir)
    return tree.changes(before, after, stage)


@query("tree_verified", _TREE + """
SELECT dir AS root, part <> 3 AND gone < n OR part = 3 AS exists, changed = 0 AS verified FROM dirs
UNION ALL SELECT '/r/nowhere', false, false""")
def tree_verified(spark, sf_dir):
    """Directories as configured roots: the same, changed, gone, and one that never was."""
    before, after, _ = _trees(spark, sf_dir)
    roots = before.where("depth = 3").select("path").collect()  # a row for each seventh of a source
    return tree.verified(before, after, [*(r.path for r in roots), "/r/nowhere"])


@query("directory_inventory", """
SELECT '/' || source AS path, count(*) AS entries FROM documents GROUP BY 1
UNION ALL SELECT '/', count(DISTINCT source) FROM documents""")
def directory_inventory(spark, sf_dir):
    return audit.directory_inventory(_snapshots(spark, sf_dir)[0].select("path")).select("path", "entries")


@query("path_redaction", r"""
SELECT page_id, CASE WHEN length(t) > 60 THEN rtrim(substr(t, 1, 59)) || '…' ELSE t END AS label FROM (
  SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace('at /home/u' || page_id || '/x,' || chr(9) || url || '  C:\t\' || page_id,
    '/(?:Users|home)/[^\s,;]+', '[local path]', 'g'), '[A-Za-z]:\\[^\s,;]+', '[local path]', 'g'), '\s+', ' ', 'g')) AS t FROM pages)""")
def path_redaction(spark, sf_dir):
    raw = F.concat(F.lit("at /home/u"), F.col("page_id"), F.lit("/x,\t"), F.col("url"), F.lit("  C:\\t\\"), F.col("page_id"))
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", text.clean_text(raw, "none", 60).alias("label"))


@query("project_name", r"""
SELECT page_id, last_part AS name FROM (
  SELECT page_id, list_filter(string_split(regexp_replace(url, '^https?:/', ''), '/'), lambda x: x <> '' AND x <> '.')[-1] AS last_part FROM pages)""")
def project_name(spark, sf_dir):
    raw = F.concat(F.lit("C:\\x\\..\\"), F.replace(F.regexp_replace("url", "^https?:/", ""), F.lit("/"), F.lit("\\")), F.lit("/./a/.."))
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", text.project_name(raw).alias("name"))


@query("project_from_uri", r"""
SELECT page_id, list_filter(string_split(coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), url), '/'), lambda x: x <> '')[-1] AS name
FROM pages""")
def project_from_uri(spark, sf_dir):
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", text.project_from_uri(F.col("url")).alias("name"))


@query("decoded_directory", "SELECT page_id, url AS name FROM pages")
def decoded_directory(spark, sf_dir):
    return table(spark, sf_dir, "pages", "page_id", "url").select(
        "page_id", text.decode_directory(F.replace(F.url_encode("url"), F.lit("+"), F.lit("%20"))).alias("name"))


@query("safe_label", """
SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN nullif(trim(substr(replace(trim(text), chr(10), ''), 1, 40)), '') END AS label FROM documents""")
def safe_label(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("/"), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.safe_label(raw, 40).alias("label"))


#: Logs of edits, and ids in a log; an event of a kind may name ids that never existed.
EDIT_LOGS, EDIT_IDS = 20, 37


@query("edit_replay", f"""
WITH RECURSIVE e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, user_id % {EDIT_LOGS} AS log FROM events),
o AS (
  SELECT log, event_id, k, event_id % {EDIT_IDS} AS id, row_number() OVER (PARTITION BY log ORDER BY event_id) AS step,
    CASE WHEN event_type IN ('view', 'click') THEN 'put' WHEN event_type = 'signup' THEN 'patch'
      WHEN log % 3 = 1 THEN 'put' WHEN event_type = 'purchase' AND k % 4 = 0 AND log % 3 = 2 THEN 'order'
      WHEN event_type = 'purchase' THEN 'remove' WHEN k % 10 = 0 THEN 'rewind' ELSE 'put' END AS op,
    event_id % ({EDIT_IDS} + 4) AS target, [k % {EDIT_IDS}, (k + 5) % {EDIT_IDS}, (k + 11) % {EDIT_IDS}] AS listed FROM e),
s AS (
  SELECT log, CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS live FROM o GROUP BY log
  UNION ALL
  SELECT s.log, s.step + 1, CASE op
    WHEN 'put' THEN CASE WHEN list_contains(live, id) THEN live ELSE list_append(live, id) END
    WHEN 'remove' THEN list_filter(live, lambda x: x <> id)
    WHEN 'order' THEN list_concat(list_filter(live, lambda x: NOT list_contains(listed, x)), list_filter(listed, lambda x: list_contains(live, x)))
    WHEN 'rewind' THEN CASE WHEN list_contains(live, target) THEN live[1:list_position(live, target) - 1] ELSE CAST([] AS BIGINT[]) END
    ELSE live END
  FROM s JOIN o ON o.log = s.log AND o.step = s.step + 1),
last AS (SELECT log, unnest(live) AS id FROM s QUALIFY row_number() OVER (PARTITION BY log ORDER BY step DESC) = 1),
sizes AS (SELECT log, id, arg_max(k, event_id) AS words FROM o WHERE op IN ('put', 'patch') GROUP BY ALL)
SELECT log, id, words FROM last JOIN sizes USING (log, id)""")
def edit_replay(spark, sf_dir):
    """Logs without edits, with removals and rewinds (to unknown ids, too), and with reorders, each over many blocks."""
    ev = events(spark, sf_dir).withColumn("log", F.col("user_id") % EDIT_LOGS)
    k, kind, ident, third = F.col("k"), F.col("event_type"), F.col("event_id"), F.col("log") % 3
    op = (F.when(kind.isin("view", "click"), "put").when(kind == "signup", "patch").when(third == 1, "put")
           .when((kind == "purchase") & (k % 4 == 0) & (third == 2), "order").when(kind == "purchase", "remove")
           .when(k % 10 == 0, "rewind").otherwise("put"))
    named = F.when(F.col("op") == "rewind", ident % (EDIT_IDS + 4)).otherwise(ident % EDIT_IDS)
    seq = F.struct(F.floor(ident / 50).alias("block"), ident.alias("n"), F.lit(0).cast("bigint").alias("sub"))
    message = F.from_json(F.to_json(F.struct(k.alias("words"), k.alias("characters"), F.lit(True).alias("has_text"))), replay.MESSAGE)
    rows = ev.withColumn("op", op).select(
        F.lit("s").alias("store_id"), F.col("log").cast("string").alias("path"), seq.alias("seq"), "op", named.cast("string").alias("id"),
        F.array(*[((k + d) % EDIT_IDS).cast("string") for d in (0, 5, 11)]).alias("ids"), message.alias("message"))
    left = replay.survivors(rows, Stage.shared(spark))
    return left.select(F.col("path").cast("bigint").alias("log"), F.col("id").cast("bigint").alias("id"), F.col("message.words").alias("words"))
