from __future__ import annotations

import re

from tallyloom.llm import licenses

from .conftest import same

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def words_of(text):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))


def brute(doc_id, text):
    words, at, labels = words_of(text), [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return (doc_id, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))


BASE = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def test_base_matches_brute_force(docs, rows):
    same(licenses.report(docs), [brute(i, t) for i, t, *_ in rows], *BASE)


def test_small_slices_change_nothing(docs, rows, monkeypatch):
    monkeypatch.setattr(licenses, "BYTES", 500)
    same(licenses.report(docs), [brute(i, t) for i, t, *_ in rows], *BASE)


def test_notices(spark):
    bsd = next(t.text for t in licenses.TEMPLATES if t.label == "bsd")
    words = bsd.split()
    texts = {
        1: "Intro. Licensed under the Apache License, Version 2.0. Bye",
        2: f"x {bsd.upper()} y",
        3: " ".join(words[:9] + ["also"] + words[9:]),  # a word put in moves the diagonal
        4: " ".join(words[:5]),  # too little of it
        5: "general public or license", 6: "all rights are reserved"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.base_labels, r.score) for r in licenses.report(df).collect()}
    assert got[1][:2] == ("apache-2.0", "") and got[1][2] == 1
    assert got[2][:2] == ("bsd", "") and got[2][2] == 1
    assert got[3][0] == "bsd" and 0.9 < got[3][2] < 1
    assert got[4] == got[5] == got[6] == ("", "", 0.0)


def test_spans_lie_where_the_words_are(spark):
    text = "a b all rights reserved c cc by"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {(r.label, r.first_word, r.last_word) for r in licenses.spans(df).where("base").collect()}
    assert got == {("reserved", 2, 4), ("cc-by", 6, 7)}


def test_empty(empty):
    assert licenses.report(empty).count() == 0
