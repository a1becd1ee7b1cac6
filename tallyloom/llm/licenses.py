"""License scans by diagonal voting.

The words of every document give rolling k-gram hashes, one row for each place. A Spark join meets them with the
k-grams of the license templates, a fixed table, so nothing of the corpus is broadcast or shuffled before it has a
match. A match of document place p and template place t votes for the diagonal p - t; votes are aggregated by
(document, template, diagonal), keeping which template places voted. Neighbouring diagonals of a template, up to
``SLACK`` apart, are merged, so that a few words put in or left out do not break a passage, and a merged span is
verified by the share of template places it covers and by its length. For the base phrases slack is 0 and the whole
template must be there: such a diagonal is a place where the phrase stands.

Words are compared by two independent 64-bit hashes; k-grams join on both.

Edge cases: a null or empty text has no words and no labels; repeated rows and equal ids are separate documents
(a row number of the scan keeps them apart); an empty table gives no rows. Texts are hashed whole; a batch holds
whole documents and at least one, so the longest text bounds the memory. Columns of other names are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 2
SLACK = 2
COVERED = 0.8
STRETCH = 1.5
BYTES = 1 << 20
GRAMS = "row long, doc_id long, n_words long, at int, h1 long, h2 long"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False


# Phrases of the contract, then notices as the licenses word them. At most 64 words each.
TEMPLATES = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                    "associated documentation files the software to deal in the software without restriction"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
                    "provided that the following conditions are met"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)

_SEEDS = ((np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)),
          (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)))


def _lower() -> np.ndarray:
    """Lower-cased word bytes; 0 for bytes between words."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A"):ord("Z") + 1] += 32
    for start, end in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
        table[start:end + 1] = 0
    return table


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, ends: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Document and two hashes of every word.

    ``ends``: byte ends of the documents in ``data``; ``table``: what each byte counts as, 0 between words.
    """
    letters = table[data]
    is_word = letters != 0
    edge = np.zeros(len(letters) + 1, dtype=bool)
    edge[ends] = True
    edge[0] = True
    start = is_word & (edge[:-1] | np.append(True, ~is_word[:-1]) if len(letters) else is_word)
    starts = np.flatnonzero(start)
    doc = np.searchsorted(ends, starts, side="right")
    inside = np.flatnonzero(is_word)
    if not len(starts):
        return doc, [np.zeros(0, dtype=np.uint64)] * 2
    first = np.flatnonzero(start[inside])  # places of the starts among the word bytes
    lengths = np.diff(np.append(first, len(inside)))
    offset = np.arange(len(inside)) - np.repeat(first, lengths)
    value, hashes = letters[inside].astype(np.uint64) + np.uint64(1), []
    with np.errstate(over="ignore"):
        for base, salt in _SEEDS:
            powers = np.cumprod(np.append(np.uint64(1), np.full(int(lengths.max()), base, dtype=np.uint64)))
            total = np.add.reduceat(value * powers[offset], first)
            hashes.append(_mix(total + lengths.astype(np.uint64) * salt))
    return doc, hashes


def gram_hashes(doc: np.ndarray, hashes: list[np.ndarray], k: int = K) -> tuple[np.ndarray, list[np.ndarray]]:
    """Number of the first word of every k-gram inside a document, and its two hashes."""
    n = max(0, len(doc) - k + 1)
    whole = np.flatnonzero(doc[:n] == doc[k - 1:k - 1 + n])
    grams = []
    with np.errstate(over="ignore"):
        for h, (base, salt) in zip(hashes, _SEEDS, strict=True):
            total = np.full(len(whole), salt, dtype=np.uint64)
            for j in range(k):
                total = _mix(total * base + h[whole + j])
            grams.append(total.view(np.int64))
    return whole, grams


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every document a row with its id and number of words (at = -1), for every k-gram a row with its hashes."""
    row = TaskContext.get().partitionId() << 40
    for whole in batches:
        for batch in _slices(whole):
            n = batch.num_rows
            if not n:
                continue
            texts = pc.fill_null(batch.column("text").cast(pa.string()), "")
            offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + n + 1]
            data = texts.buffers()[2]
            data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
            doc, hashes = word_hashes(data[offsets[0]:offsets[-1]], (offsets[1:] - offsets[0]).astype(np.int64),
                                      _lower())
            words = np.bincount(doc, minlength=n)
            first, grams = gram_hashes(doc, hashes)
            of = doc[first]
            at = first - (np.cumsum(words) - words)[of]
            g = len(first)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([row + np.arange(n), row + of])),
                pa.concat_arrays([batch.column("doc_id").cast(pa.int64()), pa.nulls(g, pa.int64())]),
                pa.concat_arrays([pa.array(words.astype(np.int64)), pa.nulls(g, pa.int64())]),
                pa.array(np.concatenate([np.full(n, -1), at]).astype(np.int32)),
                *[pa.array(np.concatenate([np.zeros(n, dtype=np.int64), h])) for h in grams]],
                ["row", "doc_id", "n_words", "at", "h1", "h2"])
            row += n


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    if n < 2 or batch.nbytes <= BYTES:
        yield batch
    else:
        yield from _slices(batch.slice(0, n // 2))
        yield from _slices(batch.slice(n // 2))


def template_grams(templates: tuple[Template, ...] = TEMPLATES) -> list[tuple]:
    """template, place, h1, h2 of every k-gram of every template."""
    rows = []
    for i, template in enumerate(templates):
        data = np.frombuffer(template.text.encode(), dtype=np.uint8)
        doc, hashes = word_hashes(data, np.array([len(data)]), _lower())
        first, grams = gram_hashes(doc, hashes)
        if len(doc) > 64 or len(doc) < K:
            raise ValueError(f"a template has {K} to 64 words: {template.text[:40]}")
        rows += [(i, int(t), int(a), int(b)) for t, a, b in zip(first, *grams, strict=True)]
    return rows


def spans(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Verified spans: row, label, base, first_word, last_word, coverage; and a row with doc_id and n_words per document."""
    spark = docs.sparkSession
    grams = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_emit, GRAMS)
    places = spark.createDataFrame(template_grams(templates), "template int, place int, t1 long, t2 long")
    # Bounded: the templates are constants.
    met = grams.join(F.broadcast(places), (F.col("h1") == F.col("t1")) & (F.col("h2") == F.col("t2")), "left") \
        .where("at < 0 OR template IS NOT NULL")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.coalesce("place", F.lit(0)))
    votes = met.groupBy("row", F.coalesce("template", F.lit(-1)).alias("template"),
                        F.coalesce(F.col("at") - F.col("place"), F.lit(-1)).alias("diagonal")).agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.bit_or(one).alias("covered"),
        F.min("at").alias("a"), F.max("at").alias("b"))
    facts = spark.createDataFrame(
        [(i, t.label, t.base, len(t.text.split())) for i, t in enumerate(templates)],
        "template int, label string, base boolean, words int")
    votes = votes.join(F.broadcast(facts), "template", "left")  # as bounded
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > F.when(F.col("base"), 0).otherwise(SLACK)
    islands = votes.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")) \
        .withColumn("island", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("row", "template", "island").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.first("label").alias("label"),
        F.first("base").alias("base"), F.first("words").alias("words"), F.bit_or("covered").alias("covered"),
        F.min("a").alias("first_word"), (F.max("b") + K - 1).alias("last_word"))
    merged = merged.withColumn("coverage", F.bit_count("covered") / (F.col("words") - (K - 1)))
    verified = F.when(F.col("base"), F.col("coverage") == 1).otherwise(
        (F.col("coverage") >= COVERED) &
        (F.col("last_word") - F.col("first_word") + 1 <= STRETCH * F.col("words")))
    return merged.where((F.col("template") < 0) | verified).select(
        "row", "doc_id", "n_words", "label", "base", "first_word", "last_word", "coverage")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (best coverage, 0 without a span)."""
    base = F.col("base")

    def joined(labels: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(labels)), ",")  # bounded: the labels of the templates

    return spans(docs).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"),
        F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score")).drop("row")
