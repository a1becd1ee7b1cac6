from __future__ import annotations

import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import mixing


def brute_targets(words, weights=(5, 2, 1), budget=1.5, most=2):
    """Reshare the excess until no source is above its limit."""
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    limit, total, full = {s: most * n for s, n in words.items()}, budget * sum(words.values()), set()
    while True:
        free = total - sum(limit[s] for s in full)
        share = {s: free * weight[s] / sum(weight[x] for x in words if x not in full) for s in words if s not in full}
        over = {s for s, n in share.items() if n > limit[s]}
        if not over:
            return share | {s: limit[s] for s in full}
        full |= over


def reachable(sizes, target):
    """How near whole copies, two of a document at most, can come to the target."""
    sums = {0}
    for n in sizes:
        sums |= {s + n for s in sums} | {s + 2 * n for s in sums}
    return min(abs(s - target) for s in sums)


def check(df, triples, nearest=2.0):
    size = {}
    words = defaultdict(int)
    for doc_id, text, source in triples:
        size[doc_id] = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        words[source] += size[doc_id]
    targets = brute_targets(words) if sum(words.values()) else {s: 0 for s in words}
    taken, got = defaultdict(int), mixing.report(df).collect()
    assert len(got) == len(triples)
    source_of = {i: s for i, _, s in triples}
    for r in got:
        source = source_of[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == words[source]
        assert r.target == pytest.approx(targets[source], rel=1e-9)
        assert r.taken == r.copies * r["size"] and 0 <= r.taken <= 2 * r["size"]
        taken[source] += r.taken
    for source, target in targets.items():
        best = reachable([size[i] for i, _, s in triples if s == source], target) if len(triples) < 200 else 0
        assert abs(taken[source] - target) <= best + nearest, source
    return got


def corpus(n=600, sources=("s1", "s2", "s3", "s4", "s5", "s6", None)):
    rng = random.Random(3)
    return [(i, " ".join("w" for _ in range(min(3000, int(math.exp(rng.gauss(4, 1)))))),
             rng.choice([*sources, *["s1"] * 4])) for i in range(n)]


def test_mix_meets_targets(spark):
    triples = corpus()
    check(spark.createDataFrame(triples, "doc_id long, text string, source string").repartition(3), triples)


def test_reruns_agree(spark):
    df = spark.createDataFrame(corpus(200), "doc_id long, text string, source string")
    first = sorted(map(repr, mixing.report(df).collect()))
    assert first == sorted(map(repr, mixing.report(df.repartition(5)).collect()))


def test_edges(docs, rows):
    triples = [(i, text, source) for i, (_, text, _, source) in enumerate(rows)]
    spark = docs.sparkSession
    df = spark.createDataFrame([(*t, "x", 1) for t in triples], "doc_id long, text string, source string, _s string, size long")
    check(df, triples, nearest=20)
    got = mixing.report(docs)  # null and repeated ids
    assert got.count() == len(rows) and got.where("taken > 2 * size").count() == 0


def test_one_size_everywhere(spark):
    """A cell with all documents is ranked by blocks; the copies add up."""
    triples = [(i, "five words are in here", "ab"[i % 7 == 0]) for i in range(5000)]
    check(spark.createDataFrame(triples, "doc_id long, text string, source string"), triples, nearest=5)


def test_repeat_is_the_mix(spark):
    df = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in corpus(150)],
                               "doc_id long, text string, lang string, source string, n_chars long")
    copies = {r.doc_id: r.copies for r in mixing.report(df).collect()}
    got = {r.doc_id: r["count"] for r in mixing.repeat(df, tuple(df.columns)).groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in copies.items() if n}


def test_native_and_empty(spark, empty):
    report = mixing.report(spark.createDataFrame(corpus(30), "doc_id long, text string, source string"))
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Cartesian" not in plan
    assert mixing.report(empty).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert sorted(r.taken for r in mixing.report(none).collect()) == [0, 0]
    assert mixing.report(none).agg(F.sum("target")).first()[0] == 0
