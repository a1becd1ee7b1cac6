from __future__ import annotations

import re

from tallyloom.llm import quality

from .conftest import same

BASE = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def brute(doc_id, text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered), failed)


def test_measures_match_brute_force(docs, rows):
    same(quality.report(docs), [brute(i, t) for i, t, *_ in rows], *BASE)


def test_verdicts(spark):
    clean = "the house of the river and the stone in the garden was old but the people of the town liked it a lot"
    texts = {1: clean, 2: clean.replace(" ", " *** "), 3: "too short", 4: "\n".join(["some line of text here"] * 9),
             5: " ".join(f"zzz{i}" for i in range(200)), 6: " ".join("q" * 99 + str(i) for i in range(30))}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r.doc_id: (r.kept, r.failed_rules) for r in quality.report(df).collect()}
    assert kept[1] == (True, "")
    assert kept[2] == (False, "symbols")
    assert kept[3] == (False, "too_few_words")
    assert kept[4][1] == "repeated_words,repeated_lines"
    assert kept[5] == (False, "no_stop_words")
    assert kept[6] == (False, "long_words")
    assert [r.doc_id for r in quality.keep(df).collect()] == [1]


def test_no_user_function_and_no_shuffle(docs):
    plan = quality.report(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") <= 1  # the fixture's own


def test_empty(empty):
    assert quality.report(empty).count() == 0
    assert quality.keep(empty).columns == empty.columns
