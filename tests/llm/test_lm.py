from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from tallyloom.llm import lm


def brute(rows):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [[w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(lower)) if w] for _, t, *_ in rows]
    pairs = [list(zip([None, *d], d, strict=False)) for d in docs]
    words, bigrams = Counter(w for d in docs for w in d), Counter(p for d in pairs for p in d)
    words[None], n = sum(map(bool, docs)), sum(map(len, docs))
    for (doc_id, *_), d, p in zip(rows, docs, pairs, strict=True):
        own, own_pairs, total, seen = Counter(d), Counter(p), 0.0, 0
        for before, w in p:
            b, u = bigrams[before, w] - own_pairs[before, w], words[w] - own[w]
            seen += b > 0
            total += math.log(b / words[before] if b else 0.4 * u / n if u else 0.16 / n)
        yield doc_id, len(d), seen, total / len(d) if d else None


def compare(df, rows):
    got = sorted(((r.doc_id, r.n_words, r.n_seen, r.score) for r in lm.report(df).collect()), key=lambda r: repr(r[:3]))
    want = sorted(brute(rows), key=lambda r: repr(r[:3]))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    for a, b in zip(sorted(r[3] for r in got if r[3] is not None), sorted(r[3] for r in want if r[3] is not None),
                    strict=True):
        assert a == pytest.approx(b, abs=1e-8)
    for a, b in zip(got, want, strict=True):
        assert (a[3] is None) == (b[3] is None)


def test_matches_brute_force(docs, rows):
    compare(docs, rows)


def test_many_buckets_and_chunks(docs, rows, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET", 300)
    monkeypatch.setattr(lm, "CHUNK_BYTES", 2_000)
    compare(docs, rows)


def test_frequent_words_spread(spark, monkeypatch):
    """Half of all tokens are one word, and no word is frequent by default."""
    monkeypatch.setattr(lm, "BUCKET", 50)
    rows = [(i, " ".join(f"the w{(i * j) % 17}" for j in range(10))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    compare(df, rows)
    monkeypatch.setattr(lm, "FREQUENT", 2)
    compare(df, rows)


def test_empty(empty):
    assert lm.report(empty).count() == 0
