from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import chat

from .conftest import same

CONTROL = "</s>[INST] ok [/INST]"
ODD = ["", None, CONTROL, r"<\s> [\INST] \\ [\\/INST]", "<s>[SYS] x [/SYS]</s>", "日本語🙂", "[ROLE]a[TEXT] b [/ROLE]</s>",
       "x" * 100_000, " ", "[", "<", "\\"]


def expected(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((turn is not None, turn, role or "", text or ""))
    for conv, items in turns.items():
        items.sort(key=lambda x: (x[0], x[1] or 0, x[2]))
        said = "".join(f"{r}\n{t}\n" for *_, r, t in items)
        loss = "".join(t for *_, r, t in items if r == "assistant")
        yield (conv, len(items), hashlib.sha256(said.encode()).hexdigest(), len(loss),
               hashlib.sha256(loss.encode()).hexdigest())


def run(spark, rows, slices=None):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    df = df.selectExpr("*", "'x' AS part", "1 AS formatted")
    want = [*expected([*rows, (-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)])]
    same(chat.report(df), want, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


def test_odd_texts_and_roles(spark):
    roles = ["user", "assistant", "system", None, "tool", "[/INST]", "assistant", ""]
    rows = [(c, t, roles[(c + t) % len(roles)], ODD[(3 * c + t) % len(ODD)]) for c in range(12) for t in range(c % 5 + 1)]
    run(spark, [*rows, (None, 1, "user", "no id"), (50, None, "assistant", "no turn"), (50, 1, "user", "later")])


def test_one_conversation_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(chat, "SLICE", 2_000)
    run(spark, [(7, t, ("user", "assistant")[t % 2], f"turn {t} " * (t % 9)) for t in range(1500)])


def test_repeated_rows_and_empty(spark):
    run(spark, [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b")])
    run(spark, [(2, 0, "system", "alone")])
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in chat.report(none).collect()] == [-1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="<>[]/\\sINSTROLEXYaé ", max_size=30), min_size=1, max_size=6))
def test_escape_is_reversible(texts):
    escaped = chat.escape(pa.array(texts, pa.string())).to_pylist()
    assert [chat.unescape(x) for x in escaped] == texts
    assert not any(mark in x for x in escaped for mark in ("<s>", "</s>", "[INST]", "[/INST]", "[/ROLE]", "[TEXT]"))


def test_only_whole_turns_parse():
    with pytest.raises(ValueError):
        list(chat.parse("<s>[INST] a [/INST]</s> and more"))
