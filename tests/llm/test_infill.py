from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import infill

from .conftest import same


def brute(i, text):
    text = text or ""
    tokens = regex.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


ODD = ["a<P>b", "<", "<<S", "S><M", "x<S>", "ab\ncd<M", "日本<P", "é🙃e", "A1b2", "P>"]


def test_documents(docs, rows):
    same(infill.report(docs), [(i, *(b := brute(i, t))[:4], sha(b[4]), sha(t)) for i, t, *_ in rows],
         "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def test_outputs_and_restored_texts(spark):
    rows = [(i, ODD[i % len(ODD)] * (1 + i % 3), "old", "kept") for i in range(200)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, Form string, more string")
    done = infill.transform(df)
    assert done.columns == ["doc_id", "more", "n", "form", "prefix_chars", "middle_chars", "fim_text"]
    same(done, [(i, *brute(i, t)) for i, t, *_ in rows],
         "doc_id", "n", "form", "prefix_chars", "middle_chars", "fim_text")
    back = infill.restore(done)
    same(back, [(i, t or "", m) for i, t, _, m in rows], "doc_id", "restored", "more")


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 1 << 40), st.one_of(st.none(), st.text(), st.text("aB<>PSM \né🙃"))), max_size=8))
def test_any_texts(rows):
    texts = pa.array([t for _, t in rows], pa.string())
    # A slice must not be taken for its whole array.
    for cut in (0, len(rows) // 2):
        found = infill.scatter(*infill.flat(texts.slice(cut)), [i for i, _ in rows[cut:]])
        outputs = infill.strings(found["data"], found["at"]).to_pylist()
        expected = [brute(i, t) for i, t in rows[cut:]]
        assert outputs == [e[4] for e in expected]
        assert [infill.FORMS[f] for f in found["form"]] == [e[1] for e in expected]
        restored = infill.strings(*infill.gather(found["data"], found["at"], found["form"])).to_pylist()
        assert restored == [t or "" for _, t in rows[cut:]]


def test_outputs_without_their_marks_are_refused():
    data, at = infill.flat(pa.array(["no marks"]))
    with pytest.raises(ValueError):
        infill.gather(data, at, np.array([1]))
    data, at = infill.flat(pa.array(["<P>a<S>b<M>c", "d<S>"]))
    back, ends = infill.gather(data, at, np.array([1, 0]))
    assert infill.strings(back, ends).to_pylist() == ["acb", "d<S>"]


def test_empty(empty):
    assert infill.report(empty).count() == 0 and infill.restore(infill.transform(empty)).count() == 0
