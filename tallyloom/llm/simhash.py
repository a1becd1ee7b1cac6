"""SimHash near-duplicates by anchor-point covering.

A document's fingerprint has a bit wherever more than half of its shingles' XXH64 values have it. Two fingerprints
link if they differ in two bits at most. Fingerprints are collapsed to distinct values first, so a group of copies of
any size is one row from there on.

**Anchors.** Of two linked fingerprints, either the low halves (32 bits) differ in one bit at most, or the high halves
are equal. On a half, the anchors are the words whose first 31 bits are a codeword of the perfect [31, 26] Hamming
code: every half has exactly one anchor within the covering radius 1 that agrees in its last bit, its home. A
fingerprint is replicated to each anchor within covering radius plus threshold: 2 for the low half (17 anchors at
most), 1 for the high half, whose threshold is 0 (the home alone). Linked fingerprints therefore meet at the home of
the smaller one. Per anchor, homes are compared with all that came there; the equi-join on the anchor evaluates the
exact distance, so only links leave it, each of them once.

**Components.** Links become stars by alternating large-star and small-star rounds, each a minimum per node and a join;
no neighbour list is collected. Every round is checkpointed.

Edge cases: a null text has no words; no words give fingerprint zero, which links like any other; fewer words than a
shingle are one shingle; null ids take part and lose every minimum; repeated rows share their component; an empty
table gives no rows. Long texts are hashed in segments, with the last words carried over. Columns of other names are
left out, but for those that ``keep_one`` is asked to return.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import cut, fits

SHINGLE = 3
DISTANCE = 2
SEED = 42
SEGMENT = 4 << 20
MAX_ROUNDS = 100
#: Rows of 16 bytes up to which the documents that stay are broadcast.
BROADCAST_ROWS = 200_000

_LOW = (1 << 32) - 1
_CODE = (1 << 31) - 1
_TOP = 1 << 31
#: Bits whose number (from 1) has bit j set: the parity checks of the Hamming code.
_CHECKS = [sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5)]


def _segments(data: bytes, size: int) -> Iterator[bytes]:
    start, space = 0, re.compile(rb"[\x20\x09-\x0d]")
    while start < len(data):
        found = space.search(data, start + size)
        end = found.start() if found else len(data)
        yield data[start:end]
        start = end


def shingles(text: str | None, shingle: int, segment: int = SEGMENT) -> Iterator[list[int]]:
    """XXH64 values of a whole text's shingles, in their order, a list for each segment."""
    data = (text or "").encode().lower()  # of bytes: A-Z only
    digest, seed = xxhash.xxh64_intdigest, SEED
    none, last = True, []
    for part in _segments(data, segment):
        words = last + part.split()
        if len(words) >= shingle:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = [0, *ends[:-shingle].tolist()]
            none = False
            yield [digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist(), strict=True)]
        last = words[-(shingle - 1):] if shingle > 1 else []
    if none and last:
        yield [digest(b" ".join(last), seed)]


def fingerprint(text: str | None, shingle: int = SHINGLE, segment: int = SEGMENT) -> int:
    """SimHash of a whole text, unsigned."""
    bits, n = np.zeros(64, dtype=np.int64), 0
    for hashes in shingles(text, shingle, segment):
        values = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        for at in range(0, len(values), 1 << 16):
            bits = bits + np.unpackbits(values[at:at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return sum(1 << int(i) for i in np.flatnonzero(2 * bits > n))


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed long."""
    shingle = SHINGLE

    @F.arrow_udf("long")
    def signed(texts: pa.Array) -> pa.Array:
        prints = np.array([fingerprint(t, shingle) for t in texts.to_pylist()], dtype=np.uint64)
        return pa.array(prints.view(np.int64))

    return docs.withColumn(name, signed.asNondeterministic()(F.col(text)))


def _bit(p: Column) -> Column:
    """1 << (p - 1), of a column of shifts."""
    return F.expr("shiftleft(1L, 0)") if p is None else F.call_function("shiftleft", F.lit(1).cast("long"), p - 1)


def _syndrome(half: Column) -> Column:
    total = F.lit(0)
    for j, check in enumerate(_CHECKS):
        total = total + (F.bit_count(half.bitwiseAND(F.lit(check))) % 2) * (1 << j)
    return total.cast("int")


def _home(half: Column, s: Column) -> Column:
    return F.when(s == 0, half).otherwise(half.bitwiseXOR(_bit(s)))


def _around(half: Column, s: Column) -> Column:
    """All anchors within distance 2 of a half."""
    home = _home(half, s)
    pairs = F.filter(F.sequence(F.lit(1), F.lit(31)), lambda p: p < p.bitwiseXOR(s))
    further = F.transform(pairs, lambda p: half.bitwiseXOR(_bit(p)).bitwiseXOR(_bit(p.bitwiseXOR(s))))
    return F.concat(F.array(home, home.bitwiseXOR(F.lit(_TOP))), further)


def links(prints: DataFrame) -> DataFrame:
    """a > b: the pairs of distinct fingerprints ``fp`` that differ in at most ``DISTANCE`` bits, each once."""
    low, high = F.col("fp").bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned("fp", 32)
    halves = prints.select("fp", low.alias("low"), high.alias("high"))
    halves = halves.select("*", _syndrome(F.col("low")).alias("s"), _syndrome(F.col("high")).alias("t"))
    above = F.lit(1 << 32)  # anchors of the high half
    upper = _home(F.col("high"), F.col("t")).bitwiseOR(above)
    homes = halves.select("fp", F.explode(F.array(_home(F.col("low"), F.col("s")), upper)).alias("anchor"))
    others = halves.select(F.col("fp").alias("other"), F.explode(
        F.concat(_around(F.col("low"), F.col("s")), F.array(upper))).alias("anchor"))
    differ = F.col("fp").bitwiseXOR(F.col("other"))
    low_bits = F.bit_count(differ.bitwiseAND(F.lit(_LOW)))
    # The low anchors answer for pairs with at most one differing low bit, the high ones for the rest.
    answers = (F.col("anchor") < above) == (low_bits <= 1)
    near = (F.col("fp") < F.col("other")) & (F.bit_count(differ) <= DISTANCE)
    homes, others = homes.withColumnRenamed("anchor", "at"), others
    found = homes.join(others, (F.col("at") == F.col("anchor")) & near & answers)
    return found.select(F.col("other").alias("a"), F.col("fp").alias("b"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Checkpointed, so that both sides of the join come straight from a shuffle: Spark then splits a star's centre.
    least = cut(both.groupBy("a").agg(F.min("b").alias("m")))
    moved = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    return moved.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    rest = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(least.select("a", F.col("m").alias("b"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether all are stars: every a has one b only, which is no a. A round would leave them as they are."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(
        edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")) \
        .where("leaf > 1 or leaf = 1 and centre = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """a, b: every node but the least of its component, with that least node. ``edges``: a > b."""
    now = cut(edges)
    for _ in range(MAX_ROUNDS):
        if _settled(now):
            return now
        now = cut(_small_star(_large_star(now)))
    raise RuntimeError(f"components have not settled in {MAX_ROUNDS} rounds")


def classes(prints: DataFrame, link: Callable[[DataFrame], DataFrame] = links) -> DataFrame:
    """fp, first (struct of the least id and its fp) and root of every distinct fingerprint of ``prints`` (doc_id, fp)."""
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    stars = components(link(distinct.select("fp")))
    rooted = distinct.join(stars.withColumnRenamed("a", "fp"), "fp", "left") \
        .select("fp", "least", F.coalesce("b", "fp").alias("root"))
    # Nulls sort last here, so a null id stands for its class only if there is no other.
    firsts = rooted.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp"))
                                        .alias("first"))
    return rooted.select("fp", "root").join(firsts, "root").select("fp", "root", "first")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least id of the component)."""
    prints = cut(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "fp"))
    found = classes(prints).select("fp", F.col("first.least").alias("component_id"))
    return prints.join(found, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, columns: tuple[str, ...], mark: Callable[..., DataFrame] = with_fingerprint,
             link: Callable[[DataFrame], DataFrame] = links) -> DataFrame:
    """``columns`` of one document of each component: the one with the least id.

    ``mark`` adds the fingerprint, ``link`` gives the links of the distinct fingerprints.
    """
    rest = [c for c in columns if c != "doc_id"]
    prints = cut(mark(docs.select("doc_id", "text")).select("doc_id", "fp"))
    stay = cut(classes(prints, link).select("first").distinct()
               .select(F.col("first.least").alias("_id"), F.col("first.fp").alias("_fp")))
    if fits(stay, BROADCAST_ROWS):
        stay = F.broadcast(stay)
    whole = mark(docs.select("doc_id", *rest), name="_print")
    kept = whole.join(stay, whole["doc_id"].eqNullSafe(stay["_id"]) & (F.col("_print") == F.col("_fp")), "left_semi")
    # Rows that share id and fingerprint are copies too.
    one = kept.groupBy("doc_id", "_print").agg(F.min(F.struct(*rest)).alias("_row"))
    return one.select("doc_id", "_row.*").select(*columns)
