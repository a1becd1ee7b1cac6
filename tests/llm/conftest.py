from __future__ import annotations

import random

import pytest

COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, size long, fp long, row string, "
           "_s string, words string, label string")


def sentence(rng, n, stock):
    return " ".join(rng.choice(stock) for _ in range(n))


def edge_texts():
    """Texts with copies, near copies, odd characters, repeats, licenses and extremes."""
    rng = random.Random(7)
    english = "the of and to in that river stone garden window paper morning light people house water".split()
    german = "der die und das nicht über straße zeit haus wasser garten fenster stein morgen licht größe".split()
    texts = [None, "", " ", "\n\t \n", "a", "\x00 b\x00c", "42 17", "...", "the", "x" * 5000]
    texts += [sentence(rng, rng.randrange(1, 120), english) for _ in range(30)]
    texts += [sentence(rng, rng.randrange(1, 120), german) for _ in range(20)]
    long = sentence(rng, 4000, english)
    texts += [long, long, long + " once more", "Ünïcode 日本語 テキスト 漢字 🙂🙃 é", "a b c \x85 d"]
    texts += ["\n".join([sentence(rng, 8, english)] * 5), sentence(rng, 9, english) + " # * $ % & | < >" * 9]
    texts += ["This is CC-BY, all rights reserved. GNU General Public License; general public, license",
              "cc by cc by", "Licensed under the Apache License, Version 2.0.", "all rights all rights reserved reserved"]
    texts += [texts[20]] * 4
    return texts


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source): null and repeated ids among them."""
    texts = edge_texts()
    sources = ["b", "a", None, "c", "a", "ä", "z"]
    langs = ["en", "de", None, "en"]
    out = [(i, t, langs[i % 4], sources[i % 7]) for i, t in enumerate(texts)]
    return out + [out[25], out[25], out[12], (None, texts[30], "en", "a"), (None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    extra = [(i, t, lang, source, len(t or ""), -1, 5, "r", "s", "w", "l") for i, t, lang, source in rows]
    return spark.createDataFrame(extra, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def same(df, expected, *columns):
    """The rows of ``df`` and the expected tuples as sorted multisets."""
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
