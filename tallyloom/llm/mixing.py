"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

**Targets.** Sources, ordered by code point with null last, weigh 5, 2, 1, repeating, and share ``BUDGET`` times all
words; a source's target stops at ``MOST`` times its own words and the excess is reshared by weight. The fixed point
has one level t with target = min(MOST * words, weight * t); a running sum over the sources finds it.

**Rates.** Per source, the rates r of the documents minimise sum r (ln r - 1) + 1 under 0 <= r <= MOST and the token
constraint sum r * size = target. The solution is an exponential tilt, r = min(MOST, exp(lambda * size)), whose
multiplier solves a convex dual. All multipliers are found together by Newton steps, safeguarded by bisection, each
one aggregate over the cells (source, size, number of documents): a rate depends on nothing else.

**Copies.** Rates become whole copies on the same cells: running sums over a source's sizes round the copies of each
size so that errors cancel, and a greedy pass then moves single copies until less is left over than a document could
change. Inside a cell the documents with the smallest hash get the extra copy. They are ranked in blocks of about
``BLOCK`` documents whose counts are summed first, so many tasks rank a cell of any length.

Rates are summed as whole numbers (units of 1e-9), so the order of summation doesn't matter and reruns agree. There is
one cell at most for each distinct size of a source; only cells are read repeatedly or collected into arrays.

Edge cases: a null text has size 0; documents of size 0 take no words (rate 1); a source without words has target 0;
an empty table gives no rows; repeated rows are ranked as documents of their own; null ids are allowed; texts of any
length are counted whole; columns of other names don't matter, carried ones may have any name but those with a leading
underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import WORD, cut, fits

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MOST = 2
UNIT = 1_000_000_000
MAX_STEPS = 80
BLOCK = 500
#: Rows up to which a lookup of three numbers a row is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 500_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lookup(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if fits(df, BROADCAST_ROWS) else df


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target and the running number _s; ``sizes``: source, words. One row per source."""
    everything = Window.partitionBy()
    rows = sizes.withColumn("_s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_s") % len(WEIGHTS) + 1).cast("int"))
    rows = rows.withColumn("_w", weight)
    before = Window.orderBy(F.col("words") / F.col("_w"), "_s").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*", F.sum("words").over(everything).alias("_all"),
        F.coalesce(F.sum("words").over(before), F.lit(0)).alias("_limited"),
        (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))).alias("_open"))
    level = (BUDGET * F.col("_all") - MOST * F.col("_limited")) / F.col("_open")
    # With sources in the order in which they fill, the level rises while they do and falls afterwards.
    limit, level = MOST * F.col("words"), F.max(level).over(everything)
    return rows.select("source", F.col("words").alias("source_size"),
                       F.least(limit.cast("double"), F.col("_w") * level).alias("target"), "_s")


def _rate(multiplier: Column) -> Column:
    """min(MOST, exp(multiplier * x)) in units of 1e-9."""
    return F.round(F.least(F.lit(float(MOST)), F.exp(F.least(multiplier * F.col("_x"), F.lit(1.0)))) * UNIT).cast("long")


def _whole(column: Column) -> Column:
    return column.cast("decimal(19,0)")


def tilt(cells: DataFrame, aims: DataFrame) -> DataFrame:
    """_s, target and the rate of each of the ``cells`` (_s, size, n); ``aims``: _s, source_size, target."""
    mean = cells.groupBy("_s").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("_mean"))
    cells = cells.where("size > 0").join(mean, "_s").withColumn("_x", F.col("size") / F.col("_mean")).drop("_mean")
    cells = cut(cells)
    full = F.col("target") >= MOST * F.col("source_size")
    now = cut(aims.select("_s", "target", full.alias("_full"), F.lit(0.0).alias("_at"), F.lit(-1e6).alias("_low"),
                          F.lit(1e6).alias("_high"), full.alias("_done")))
    for _ in range(MAX_STEPS):
        rate, words = _rate(F.col("_at")), F.col("n") * F.col("size")
        # Derivative of a rate by the multiplier; zero where the limit holds.
        slope = F.when(rate < MOST * UNIT, F.round(rate * F.least(F.col("_x"), F.lit(1e6))))
        sums = cells.join(now.where(~F.col("_done")), "_s").groupBy("_s").agg(
            F.sum(_whole(words) * _whole(rate)).alias("_got"), F.sum(_whole(words) * _whole(slope)).alias("_slope"))
        miss = F.col("_got").cast("double") / UNIT - F.col("target")
        high = F.when(miss > 0, F.least("_high", "_at")).otherwise(F.col("_high"))
        low = F.when(miss < 0, F.greatest("_low", "_at")).otherwise(F.col("_low"))
        newton = F.col("_at") - miss * UNIT / F.nullif(F.col("_slope").cast("double"), F.lit(0.0))
        near = miss.isNull() | (F.abs(miss) <= F.greatest(F.lit(0.25), 1e-7 * F.col("target"))) | (high - low < 1e-12)
        now = cut(now.join(sums, "_s", "left").select(
            "_s", "target", "_full",
            F.when(F.col("_done") | near, F.col("_at")).when((newton > low) & (newton < high), newton)
            .otherwise((low + high) / 2).alias("_at"),
            low.alias("_low"), high.alias("_high"), (F.col("_done") | near).alias("_done")))
        if not now.where(~F.col("_done")).take(1):
            break
    else:
        raise RuntimeError(f"rates have not settled in {MAX_STEPS} steps")
    rate = F.when(F.col("_full"), F.lit(MOST * UNIT).cast("long")).otherwise(_rate(F.col("_at")))
    return cells.join(now, "_s").select("_s", "size", "n", "target", rate.alias("rate"))


def copies(rated: DataFrame) -> DataFrame:
    """_s, size, base, extra: every document of the cell gets ``base`` copies, ``extra`` of them one more."""
    running = Window.partitionBy("_s").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    due = F.sum(_whole(F.col("n")) * _whole(F.col("rate"))).over(running)
    to = F.floor((due + UNIT // 2) / UNIT).cast("long")
    rounded = rated.withColumn("_to", to).withColumn("k", F.col("_to") - F.coalesce(
        F.lag("_to").over(Window.partitionBy("_s").orderBy("size")), F.lit(0)))
    rounded = cut(rounded.select("_s", "size", "n", "target", "k"))
    left = rounded.groupBy("_s").agg((F.first("target") - F.sum(F.col("k") * F.col("size"))).alias("_left"))
    # Greedy over the sizes, largest first: at most one entry for each distinct size.
    entries = rounded.join(left, "_s").where(F.col("size") <= F.abs("_left")).groupBy("_s", "_left").agg(
        F.sort_array(F.collect_list(F.struct("size", (MOST * F.col("n") - F.col("k")).alias("more"), F.col("k").alias("less"))),
                     asc=False).alias("_sizes"))

    def step(state: Column, e: Column) -> Column:
        rest = state["rest"]
        by = F.when(rest > 0, F.least(e["more"], F.floor(rest / e["size"]))) \
            .otherwise(-F.least(e["less"], F.floor(-rest / e["size"]))).cast("long")
        moved = F.struct(e["size"].alias("size"), by.alias("by"))
        return F.struct((rest - by * e["size"]).alias("rest"), F.when(
            by != 0, F.concat(state["moves"], F.array(moved))).otherwise(state["moves"]).alias("moves"))

    start = F.struct(F.col("_left").alias("rest"), F.array().cast("array<struct<size:bigint,by:bigint>>").alias("moves"))
    moves = entries.select("_s", F.inline(F.aggregate("_sizes", start, step, lambda state: state["moves"])))
    k = F.col("k") + F.coalesce(F.col("by"), F.lit(0))
    return rounded.join(moves, ["_s", "size"], "left").select(
        "_s", "size", F.floor(k / F.col("n")).cast("long").alias("base"), (k % F.col("n")).alias("extra"),
        F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"))


def _blocked(rows: DataFrame, aims: DataFrame, cells: DataFrame) -> DataFrame:
    aims = lookup(aims.select(F.col("source").alias("_source"), "_s", "source_size", "target"))
    rows = rows.join(aims, rows["source"].eqNullSafe(aims["_source"])).drop("_source")
    rows = rows.join(lookup(cells).withColumnRenamed("size", "_size"), ["_s", "_size"], "left")
    rows = rows.fillna({"base": 1, "extra": 0, "blocks": 1})  # documents without words
    return rows.withColumn("_hash", F.xxhash64("doc_id", "_size")) \
        .withColumn("_block", F.pmod(F.col("_hash"), F.col("blocks")))


def mix(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, the columns ``carry``, and _size, source_size, target, _copies, for every row of ``docs``.

    ``docs`` is read twice, the first time for sizes alone; what is carried crosses one shuffle.
    """
    rows = docs.select("doc_id", "source", *carry, word_count(F.col("text")).alias("_size"))
    narrow = cut(rows.select("doc_id", "source", "_size"))
    if not carry:
        # Equal rows are one row with a number until the end, however many there are.
        rows = narrow.groupBy("doc_id", "source", "_size").agg(F.count("*").alias("_times"))
    else:
        rows = rows.withColumn("_times", F.lit(1).cast("long"))
    aims = cut(targets(narrow.groupBy("source").agg(F.sum("_size").alias("words"))))
    small = lookup(aims.select(F.col("source").alias("_source"), "_s"))
    cells = narrow.join(small, narrow["source"].eqNullSafe(small["_source"])) \
        .groupBy("_s", F.col("_size").alias("size")).agg(F.count("*").alias("n"))
    cells = cut(copies(tilt(cells, aims)))
    counts = _blocked(narrow, aims, cells).groupBy("_s", "_size", "_block").agg(F.count("*").alias("_docs"))
    before = Window.partitionBy("_s", "_size").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_s", "_size", "_block", F.coalesce(F.sum("_docs").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("_s", "_size", "_block").orderBy("_hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ranked = _blocked(rows, aims, cells).withColumn("_prior", F.coalesce(F.sum("_times").over(inside), F.lit(0)))
    ranked = ranked.join(lookup(cut(offsets.where("_from > 0"))), ["_s", "_size", "_block"], "left")
    # So many of the row's equals get one copy more.
    more = F.col("extra") - F.coalesce(F.col("_from"), F.lit(0)) - F.col("_prior")
    ranked = ranked.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    more = F.col("_nth") <= more
    return ranked.select("doc_id", "source", *carry, "_size", "source_size", "target",
                         (F.col("base") + F.when(more, 1).otherwise(0)).alias("_copies"))


def repeat(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` of the documents the mix takes, a row for every copy; documents it leaves out are gone."""
    rest = tuple(c for c in columns if c not in ("doc_id", "source"))
    taken = mix(docs, rest).where("_copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*columns)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target (its source's), taken (words), then copies."""
    return mix(docs).select("doc_id", F.col("_size").alias("size"), "source_size", "target",
                            (F.col("_copies") * F.col("_size")).alias("taken"), F.col("_copies").alias("copies"))
