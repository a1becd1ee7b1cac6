from __future__ import annotations

import random
import re

import pytest
import xxhash

from tallyloom.llm import simhash
from tallyloom.llm.common import cut, fits

from .conftest import same


def brute_print(text):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(lower)) if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    """(id, print) rows to the least id reachable over prints that differ in two bits at most."""
    prints = sorted({p for _, p in pairs})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, p in pairs:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return [(i, f"{p:016x}", least.get(find(p))) for i, p in pairs]


def test_documents(docs, rows):
    same(simhash.report(docs), brute_components([(i, brute_print(t)) for i, t, *_ in rows]),
         "doc_id", "fingerprint", "component_id")


def test_segments_change_nothing(rows):
    for _, text, *_ in rows:
        assert simhash.fingerprint(text, segment=50) == simhash.fingerprint(text) == brute_print(text)


def dense_prints(seed):
    """Clusters and chains of fingerprints a few bits apart, over all bit places."""
    rng = random.Random(seed)
    found = [rng.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    for _ in range(700):
        p = rng.choice(found)
        for _ in range(rng.randrange(1, 4)):
            p ^= 1 << rng.randrange(64)
        found.append(p)
    return sorted(set(found))


def test_every_link_is_found_once(spark):
    prints = dense_prints(5)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3)).collect()
    got = sorted((r.a, r.b) for r in links)
    expected = sorted((max(a, b), min(a, b)) for i, a in enumerate(signed) for b in signed[:i]
                      if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert got == expected and len(got) > 200


def test_components_of_long_chains(spark):
    rng = random.Random(2)
    nodes = list(range(1, 200))
    rng.shuffle(nodes)
    edges = [(max(a, b), min(a, b)) for a, b in zip(nodes[:120], nodes[1:121], strict=True)]
    edges += [(max(a, b), min(a, b)) for a, b in zip(nodes[130:160], nodes[131:161], strict=True)]
    got = {r.a: r.b for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for part in (nodes[:121], nodes[130:161]):
        assert {n: got.get(n, n) for n in part} == {n: min(part) for n in part}


def test_keep_one_of_each(docs, rows):
    columns = ("doc_id", "text", "lang", "source", "n_chars")
    kept = simhash.keep_one(docs, columns)
    assert tuple(kept.columns) == columns
    classes = brute_components([(i, brute_print(t)) for i, t, *_ in rows])
    prints = {f: c for _, f, c in classes}
    got = kept.collect()
    assert sorted(prints[f"{brute_print(r.text):016x}"] for r in got) == sorted(set(prints.values()))
    assert all(r.doc_id == prints[f"{brute_print(r.text):016x}"] for r in got)


def test_empty(empty):
    assert simhash.report(empty).count() == 0
    assert simhash.keep_one(empty, ("doc_id", "text")).count() == 0


def test_stars_take_no_round(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_large_star", None)  # a round would fail
    stars = [(7, 1), (8, 1), (9, 2), (4, 2)]
    got = simhash.components(spark.createDataFrame(stars, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted(stars)
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("edges", [[(3, 2), (2, 1)], [(3, 1), (3, 2)], [(5, 1), (5, 1)]])
def test_no_stars_yet(spark, edges):
    assert not simhash._settled(spark.createDataFrame(edges, "a long, b long"))
    got = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    nodes = {n for e in edges for n in e}
    assert {r.a: r.b for r in got} == {n: min(nodes) for n in nodes if n != min(nodes)}


def test_rows_are_counted_where_they_are(spark, monkeypatch):
    df = cut(spark.range(1000))
    for name in ("take", "collect", "head", "toPandas", "toArrow"):  # rows would come to the driver
        monkeypatch.setattr(type(df), name, None)
    assert fits(df, 1000) and not fits(df, 999)
