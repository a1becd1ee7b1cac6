from __future__ import annotations

import zlib

import numpy as np
import pytest

from tallyloom.llm import langid


def test_bundles_match_brute_force():
    """Vectors from the definition, n-gram by n-gram."""
    grams = langid.Grams()

    def letter(c):
        bits = langid.letter_bits(np.array([c]), langid.DIM // 64).view(np.uint8)
        return 1 - 2 * np.unpackbits(bits).astype(int)

    def brute(text):
        total = np.zeros(langid.DIM)
        word = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        for w in word:
            codes = [0, *map(ord, w), 0]
            for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
                total += np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
        return total

    texts = ["Straße, über  den Fluß", "a", "x1y2z", "日本語テキスト!", "12 34"]
    model = langid.Model(["q", "r"], np.stack([brute("the river"), brute("der fluß")]))
    cosines, lettered = model.cosines(texts, grams)
    for i, text in enumerate(texts):
        bundle = brute(text)
        size = np.linalg.norm(bundle)
        assert lettered[i] == (size > 0)
        assert cosines[i] == pytest.approx(model.prototypes @ bundle / (size or 1))


def test_segments_change_nothing(monkeypatch):
    text = "one two three, fünf sechs sieben. " * 40
    model = langid.Model(["q"], np.ones((1, langid.DIM)))
    whole, _ = model.cosines([text, text[:99]], langid.Grams())
    monkeypatch.setattr(langid, "SEGMENT", 50)
    monkeypatch.setattr(langid, "CHUNK", 120)
    parts, _ = model.cosines([text, text[:99]], langid.Grams())
    assert parts == pytest.approx(whole)


def test_edges(docs, rows):
    got = langid.report(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert got.count() == len(rows)
    texts = {i: t for i, t, *_ in rows if i is not None}
    for r in got.where("doc_id IS NOT NULL").collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        lettered = any(c.isalpha() for c in texts[r.doc_id] or "")
        assert (r.lang_pred == "und") == (not lettered) and 0 <= r.score <= 1
        assert r.lang_pred in ("und", "en", "de")


def test_learns_from_other_folds_only(spark):
    """A language known from held-out documents alone is never learned."""
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0]
    rows = [(i, "quelque chose en français", "fr") if i in held else (i, "something in english here", "en") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.train(df).langs == ["en"]
    assert {r.lang_pred for r in langid.report(df).collect()} == {"en"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


def test_keep(spark):
    english, german = "the house by the river is old and small ", "das alte haus am fluss ist sehr klein und schön "
    rows = [(i, english * 3, "en", "s", 1) for i in range(40)] + [(i, german * 3, "de", "s", 1) for i in range(40, 80)]
    rows += [(100, german * 2, "en", "s", 1), (101, "1234 5678", "en", "s", 1), (102, None, "en", "s", 1),
             (103, english, None, "s", 1), (104, english, "xx", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in langid.keep(df, tuple(df.columns)).collect()}
    assert kept == {*range(80), 103, 104}


def test_empty(empty):
    assert langid.report(empty).count() == 0
    assert langid.keep(empty, ("doc_id", "text", "lang")).count() == 0
