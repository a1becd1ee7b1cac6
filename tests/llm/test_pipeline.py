from __future__ import annotations

import hashlib
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402

from check_oracles import connect  # noqa: E402

from tallyloom.llm import mixing  # noqa: E402
from tallyloom.llm.oracles import QUALITY  # noqa: E402

from .test_bpe import REFERENCE
from .test_quality import brute
from .test_similar import brute_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage over the smallest table."""
    folder, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(folder / name))
        done = spark.read.parquet(str(folder / name))
        out[name] = docs, done
        docs = done
    return out


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_names_and_columns(stages):
    assert list(stages) == ["quality_rules", "language_id", "simhash_dedup", "source_mix", "byte_bpe"]
    assert all(done.columns == COLUMNS for name, (_, done) in stages.items() if name != "byte_bpe")


def test_quality_rules(stages):
    """Kept are exactly the documents that the SQL of the rules keeps, and no rule of the base is broken."""
    docs, done = stages["quality_rules"]
    kept = set(ids(done))
    judged = connect("/root/testdata/sf0.001").execute(f"SELECT doc_id FROM ({QUALITY}) WHERE kept").fetchall()
    assert kept == {doc_id for doc_id, in judged} and 0 < len(kept) < docs.count()
    for r in docs.collect():
        _, n_words, _, n_symbols, *_, base_failed = brute(r.doc_id, r.text)
        assert not (r.doc_id in kept and (base_failed or n_symbols > 0.2 * n_words))


def test_language_id_keeps_what_reads_as_claimed(stages):
    docs, done = stages["language_id"]
    assert docs.count() - done.count() <= 0.02 * docs.count()


def test_dedup_keeps_one_of_each(stages):
    docs, done = stages["simhash_dedup"]
    groups, linked = brute_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert ids(done) == sorted(set(groups.values())) and linked > 0


def test_mix_is_the_operator(stages):
    docs, done = stages["source_mix"]
    assert ids(done) == sorted(r.doc_id for r in mixing.report(docs).collect() for _ in range(r.copies))


def test_encoding(stages):
    docs, done = stages["byte_bpe"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert ids(done) == ids(docs)
    for r in done.collect():
        assert r.ids == REFERENCE.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, dtype="<u4").tobytes()).hexdigest()


def test_run_and_odd_rows(spark, docs, empty, tmp_path, stages):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert ids(got) == ids(stages["byte_bpe"][1])
    for df in (docs, empty):
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, str(tmp_path))
        assert "doc_id" in df.columns and df.count() >= 0
