from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import bpe

from .conftest import same

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENS = bpe.read_ranks(RANKS)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                              mergeable_ranks={t: i for i, t in enumerate(TOKENS)})
ENCODER = bpe.Encoder(TOKENS, public_tokenizers.PATTERN)


def digests(text):
    ids = REFERENCE.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest())


def test_documents_round_trip(docs, rows):
    same(bpe.report(docs, RANKS, public_tokenizers.PATTERN), [(i, *digests(t)) for i, t, *_ in rows],
         "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def test_ids_are_returned(spark):
    df = spark.createDataFrame([(1, "<|endoftext|> straße"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in bpe.encode(df, RANKS, public_tokenizers.PATTERN).collect()}
    assert got == {1: REFERENCE.encode_ordinary("<|endoftext|> straße"), 2: []}
    assert bpe.decode(np.array(got[1]), TOKENS).decode() == "<|endoftext|> straße"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(), min_size=1, max_size=5))
def test_any_text(texts):
    assert [x.tolist() for x in ENCODER.encode(texts)] == [REFERENCE.encode_ordinary(t) for t in texts]


def test_long_pieces_and_forgetting(monkeypatch):
    rng = random.Random(1)
    texts = ["a" * 3000, "ab" * 2000, "".join(rng.choice("abc") for _ in range(4000)), "  " * 500]
    monkeypatch.setattr(bpe, "KEEP", 1)
    encoder = bpe.Encoder(TOKENS, public_tokenizers.PATTERN)
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)] == [REFERENCE.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("seed", range(12))
def test_lists_whose_merges_are_out_of_order(seed):
    """A list whose longer tokens come first still merges lowest rank first, leftmost first."""
    rng = random.Random(seed)
    longer = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randrange(2, 6))) for _ in range(12)})
    rng.shuffle(longer)
    tokens = [bytes([b]) for b in range(256)] + longer
    ranks = {t: i for i, t in enumerate(tokens)}

    def plain(piece):
        parts = [bytes([b]) for b in piece]
        while True:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
            if not found:
                return [ranks[p] for p in parts]
            _, i = min(found)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    merges = bpe.Merges(tokens)
    pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    ids, counts = merges.replay(pieces)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [plain(p) for p in pieces]
    assert [merges.one(p) for p in pieces] == [plain(p) for p in pieces]


def test_empty(empty):
    assert bpe.report(empty, RANKS, public_tokenizers.PATTERN).count() == 0
