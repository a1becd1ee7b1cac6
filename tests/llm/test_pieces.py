from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import pieces

from .conftest import same

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
with open(MODEL, "rb") as _file:
    TABLES = pieces.Tables(pieces.Vocabulary(_file.read()))
DECODER = pieces.Decoder(TABLES.vocabulary)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digests(text):
    ids = LIBRARY.encode(text or "", add_eos=True)
    return len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids))


def encode(texts):
    return [x.tolist() for x in pieces.Encoder(TABLES).encode(texts)[0]]


def test_documents(docs, rows):
    same(pieces.report(docs, MODEL), [(i, *digests(t)) for i, t, *_ in rows],
         "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def test_ids_are_returned_and_names_replaced(spark):
    df = spark.createDataFrame([(1, "</s> <0x41> straße", "x"), (2, None, "y")], "doc_id long, text string, IDS string")
    got = pieces.encode(df, MODEL)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert {r.doc_id: r.ids for r in got.collect()} == {
        1: LIBRARY.encode("</s> <0x41> straße", add_eos=True), 2: [LIBRARY.eos_id()]}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text("ab c▁\n\tDéß語🙃")), min_size=1, max_size=5))
def test_any_text(texts):
    expected = [LIBRARY.encode(t, add_eos=True) for t in texts]
    assert encode(texts) == expected
    for ids in expected:
        assert DECODER.decode(np.array(ids)).decode() == LIBRARY.decode(ids)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(3, 258), st.just(28705)), max_size=8))
def test_any_ids(ids):
    assert DECODER.decode(np.array(ids, dtype=np.int64)).decode() == LIBRARY.decode(ids)


def test_long_words_and_forgetting(monkeypatch):
    rng = random.Random(3)
    texts = ["x" * 5000, " " * 3000, "ab" * 2000, "-=" * 900, "\n" * 400, "".join(rng.choice("theing") for _ in range(6000))]
    expected = [LIBRARY.encode(t, add_eos=True) for t in texts]
    monkeypatch.setattr(pieces, "KEEP", 1)
    monkeypatch.setattr(pieces, "STRIDE", 50)
    encoder = pieces.Encoder(TABLES)
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)[0]] == expected


class Made:
    """A vocabulary of few letters with ranks in any order."""

    def __init__(self, rng):
        longer = sorted({"".join(rng.choice("ab▁") for _ in range(rng.randrange(2, 6))) for _ in range(14)})
        self.pieces = [*"ab▁"[rng.randrange(2):], *longer]
        self.normal = np.ones(len(self.pieces), dtype=bool)
        # Several pieces may share a rank.
        self.rank = {p: rng.randrange(12) for p in self.pieces}
        self.byte_id, self.end = list(range(100, 356)), 2

    history = pieces.Vocabulary.history


@pytest.mark.parametrize("seed", range(25))
def test_made_vocabularies(seed):
    """Whatever the ranks, the pieces are those of merging the whole text symbol by symbol."""
    rng = random.Random(seed)
    made = Made(rng)
    number = {p: i for i, p in enumerate(made.pieces)}
    encoder = pieces.Encoder(pieces.Tables(made))
    texts = ["".join(rng.choice("aab b?") for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    for text, ids in zip(texts, encoder.encode(texts)[0], strict=True):
        symbols, _ = made.history("▁" + text.replace(" ", "▁"))
        expected = [i for s in symbols for i in ([number[s]] if s in number else [100 + b for b in s.encode()])]
        assert ids.tolist() == [*expected, 2]


def test_empty(empty):
    assert pieces.report(empty, MODEL).count() == 0
