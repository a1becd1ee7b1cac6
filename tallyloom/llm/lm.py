"""Language-model scoring: stupid backoff over bigram and unigram count tables.

A token is scored against the rest of the corpus: the counts of its own document are taken off. With b the number of
times its bigram stands in other documents and u that of the word,

    S = b / c(previous word)   if b > 0,   else 0.4 * u / N   if u > 0,   else 0.16 / N,

where c and N count the whole corpus and a document's first word follows a start mark. A document's score is the mean
of ln S. Words are runs of anything but white space, lower-cased A-Z, told apart by 48 bits of their hash.

**Count tables partitioned by hash.** Each task explodes its documents' bigrams, adds up repeats inside a document and
deals them by the hash of the predicted word into buckets of about ``BUCKET`` tokens, whatever the size of the corpus:
one compact row for each chunk of documents and bucket. Words that make up a thousandth of all tokens or more (at most
a thousand words, found by a first pass) are dealt by the previous word instead, so they spread over all buckets. A
bucket therefore holds every occurrence of its bigrams and counts them.

**Join.** A bucket lists the words whose totals it needs, the previous words of its bigrams that other documents share
and its parts of frequent words; the listing also carries its own word counts, so one aggregate by word gives the
unigram table and sends each total to the buckets that asked. Buckets and totals meet in a cogroup on the bucket, and
the sums per document come back by chunk.

Nothing of the corpus is broadcast but the list of frequent words. Edge cases: a null text or one without words has no
score (null); with no other document all words are unknown; repeated rows are documents of their own; ids may be null;
an empty table gives no rows; long texts are counted whole; columns of other names are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.licenses import word_hashes

BACKOFF = 0.4
BUCKET = 1_000_000
#: A word with this share of all tokens is dealt by its neighbours.
FREQUENT = 1_000
#: Text bytes and documents of a chunk; document numbers fit 16 bits.
CHUNK_BYTES = 4 << 20
CHUNK_DOCS = 60_000
START = 0

PACKET = ("bucket int, chunk long, word binary, entries binary, before binary, doc binary, times binary, own binary, "
          "ids array<long>, lengths array<int>")
ASKED = "word long, n long, bucket int"
SUMS = "chunk long, bucket int, doc binary, total binary, seen binary, ids array<long>, lengths array<int>"
SCORES = "doc_id long, n_words long, n_seen long, score double"


def _letters() -> np.ndarray:
    """Lower-cased word bytes; 0 for white space. The byte 0, a word's byte here, takes the free place of the space."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A"):ord("Z") + 1] += 32
    table[0] = 0x20
    table[[0x20, *range(0x09, 0x0E)]] = 0
    return table


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of whole documents, cut to the size of a chunk."""
    for batch in batches:
        stack = [batch]
        while stack:
            one = stack.pop()
            n = one.num_rows
            if n > 1 and (one.nbytes > CHUNK_BYTES or n > CHUNK_DOCS):
                stack += [one.slice(n // 2), one.slice(0, n // 2)]
            elif n:
                yield one


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Document number and 48-bit hash (never ``START``) of every word of a batch."""
    texts = pc.fill_null(batch.column("text").cast(pa.string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    doc, (hashes, _) = word_hashes(data[offsets[0]:offsets[-1]], (offsets[1:] - offsets[0]).astype(np.int64), _letters())
    return doc, np.maximum((hashes >> np.uint64(16)).astype(np.int64), 1)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of a chunk (as word ``START``), and the words that are frequent in it."""
    for batch in _chunks(batches):
        _, words = _words(batch)
        names, n = np.unique(words, return_counts=True)
        often = n * FREQUENT >= len(words)
        yield pa.RecordBatch.from_pydict({"word": pa.array(np.append(START, names[often])),
                                          "n": pa.array(np.append(len(words), n[often]))})


def _bucket(word: np.ndarray, before: np.ndarray, frequent: np.ndarray, buckets: int) -> np.ndarray:
    hot = np.isin(word, frequent)
    with np.errstate(over="ignore"):
        x = np.where(hot, before ^ (word << 8), word).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys."""
    n = len(keys[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _deal(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    chunk = TaskContext.get().partitionId() << 32
    for batch in _chunks(batches):
        doc, word = _words(batch)
        lengths = np.bincount(doc, minlength=batch.num_rows)
        before = np.append(START, word)[:-1]
        before[_runs(doc)] = START
        # How often a word stands in its document.
        order = np.lexsort((doc, word))
        first = _runs(word[order], doc[order])
        own = np.zeros(len(word), dtype=np.uint32)
        sizes = np.diff(np.append(first, len(word)))
        own[order] = np.repeat(sizes, sizes)
        bucket = _bucket(word, before, frequent, buckets)
        order = np.lexsort((doc, before, word, bucket))
        bucket, word, before, doc, own = (x[order] for x in (bucket, word, before, doc, own))
        first = _runs(bucket, word, before, doc)
        times = np.diff(np.append(first, len(word))).astype("<u4")
        bucket, word, before, doc, own = (x[first] for x in (bucket, word, before, doc, own))
        cuts = np.append(_runs(bucket), len(bucket))
        home, ids, told = chunk % buckets, batch.column("doc_id"), False
        rows = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            heads = a + _runs(word[a:b])
            here = int(bucket[a]) == home
            told |= here
            six = before[a:b].astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6]
            rows.append((int(bucket[a]), chunk, word[heads].astype("<i8").tobytes(),
                         np.diff(np.append(heads, b)).astype("<u4").tobytes(), six.tobytes(),
                         doc[a:b].astype("<u2").tobytes(), times[a:b].tobytes(), own[a:b].astype("<u4").tobytes(),
                         ids.to_pylist() if here else None, lengths.tolist() if here else None))
        if not told:
            rows.append((home, chunk, *[b""] * 6, ids.to_pylist(), lengths.tolist()))
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6, pa.list_(pa.int64()), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                         [x.split()[0] for x in PACKET.split(", ")])
        chunk += 1


class Bucket:
    """All packets of a bucket as arrays, one entry for each bigram of a document, in a fixed order."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("chunk")
        self.chunks = table.column("chunk").to_pylist()
        self.ids, self.lengths = table.column("ids").to_pylist(), table.column("lengths").to_pylist()
        self.bucket = table.column("bucket")[0].as_py()

        def joined(name: str, kind: str) -> np.ndarray:
            return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=kind)

        self.word = np.repeat(joined("word", "<i8"), joined("entries", "<u4"))
        six = joined("before", "u1").reshape(-1, 6)
        wide = np.zeros((len(six), 8), dtype=np.uint8)
        wide[:, :6] = six
        self.before = wide.view("<i8").ravel()
        self.doc, self.times, self.own = joined("doc", "<u2"), joined("times", "<u4"), joined("own", "<u4")
        sizes = [len(x) // 2 for x in table.column("doc").to_pylist()]
        self.packet = np.repeat(np.arange(len(sizes)), sizes)
        # Bigrams of the bucket: number of each entry's bigram, and its count over all documents.
        order = np.lexsort((self.before, self.word))
        first = _runs(self.word[order], self.before[order])
        number = np.zeros(len(order), dtype=np.int64)
        number[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        self.count = np.bincount(number, weights=self.times, minlength=len(first))[number]
        self.elsewhere = self.count - self.times


def _survey(table: pa.Table, frequent: np.ndarray) -> pa.Table:
    b = Bucket(table)
    words, number = np.unique(b.word, return_inverse=True)
    counts = np.bincount(number, weights=b.times, minlength=len(words)).astype(np.int64)
    partial = np.isin(words, frequent)
    asked = np.unique(b.before[b.elsewhere > 0])
    starts = int(b.times[b.before == START].sum())
    word = np.concatenate([words, [START], asked])
    n = np.concatenate([counts, [starts], np.zeros(len(asked), dtype=np.int64)])
    to = np.concatenate([partial, [False], np.ones(len(asked), dtype=bool)])
    return pa.table({"word": pa.array(word, pa.int64()), "n": pa.array(n, pa.int64()),
                     "bucket": pa.array(np.full(len(word), b.bucket), pa.int32(), mask=~to)})


def _score(table: pa.Table, totals: pa.Table, frequent: np.ndarray, tokens: int) -> pa.Table:
    names = [x.split()[0] for x in SUMS.split(", ")]
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 3, pa.list_(pa.int64()), pa.list_(pa.int32())]
    if not table.num_rows:
        return pa.table([pa.array([], k) for k in kinds], names)
    b = Bucket(table)
    known = np.asarray(totals.column("word")).astype(np.int64)
    order = np.argsort(known)
    known, total = known[order], np.asarray(totals.column("n")).astype(np.float64)[order]

    def looked_up(words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
        return np.where(known[at] == words, total[at], np.nan) if len(known) else np.full(len(words), np.nan)

    words, number = np.unique(b.word, return_inverse=True)
    count = np.bincount(number, weights=b.times, minlength=len(words))
    partial = np.isin(words, frequent)
    count[partial] = looked_up(words[partial])
    alone = count[number] - b.own
    seen = b.elsewhere > 0
    value = np.where(alone > 0, BACKOFF * alone, BACKOFF * BACKOFF) / tokens
    value[seen] = b.elsewhere[seen] / looked_up(b.before[seen])
    logs = np.log(value) * b.times
    rows, ends = [], np.searchsorted(b.packet, np.arange(len(b.chunks) + 1))
    for i, (chunk, a, z) in enumerate(zip(b.chunks, ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        docs, at = np.unique(b.doc[a:z], return_inverse=True)
        rows.append((chunk, b.bucket, docs.tobytes(),
                     np.bincount(at, weights=logs[a:z], minlength=len(docs)).astype("<f8").tobytes(),
                     np.bincount(at, weights=b.times[a:z] * seen[a:z], minlength=len(docs)).astype("<u4").tobytes(),
                     b.ids[i], b.lengths[i]))
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _totals(table: pa.Table) -> pa.Table:
    """Scores of a chunk's documents from the sums of all buckets, added in their order."""
    table = table.sort_by("bucket")
    lengths = next(x for x in table.column("lengths").to_pylist() if x is not None)
    ids = next(x for x in table.column("ids").to_pylist() if x is not None)
    total, seen = np.zeros(len(lengths)), np.zeros(len(lengths), dtype=np.int64)
    for doc, part, n in zip(*(table.column(c).to_pylist() for c in ("doc", "total", "seen")), strict=True):
        at = np.frombuffer(doc, dtype="<u2")
        total[at] += np.frombuffer(part, dtype="<f8")
        seen[at] += np.frombuffer(n, dtype="<u4")
    size = np.array(lengths, dtype=np.int64)
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(size), "n_seen": pa.array(seen),
                     "score": pa.array(total / np.maximum(size, 1), pa.float64(), mask=size == 0)})


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_seen (tokens whose bigram other documents have), score (mean ln S, null without words)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    often = rows.select("text").mapInArrow(_tally, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    tokens = often.where(F.col("word") == START).agg(F.sum("n")).first()[0] or 0
    # At most FREQUENT words can have that share.
    frequent = np.array(sorted(r.word for r in often.where(
        (F.col("word") != START) & (F.col("n") * FREQUENT >= tokens)).select("word").collect()), dtype=np.int64)
    buckets = max(1, math.ceil(tokens / BUCKET))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _deal(batches, frequent, buckets)

    def survey(table: pa.Table) -> pa.Table:
        return _survey(table, frequent)

    def scored(key: tuple, table: pa.Table, totals: pa.Table) -> pa.Table:
        return _score(table, totals, frequent, tokens)

    packets = rows.mapInArrow(deal, PACKET)
    asked = packets.groupBy("bucket").applyInArrow(survey, ASKED)
    unigrams = asked.groupBy("word").agg(F.sum("n").alias("n"), F.collect_set("bucket").alias("buckets"))
    totals = unigrams.select(F.explode("buckets").alias("bucket"), "word", "n")
    sums = packets.groupBy("bucket").cogroup(totals.groupBy("bucket")).applyInArrow(scored, SUMS)
    return sums.groupBy("chunk").applyInArrow(_totals, SCORES)


def report(docs: DataFrame) -> DataFrame:
    """``score`` with the score rounded to nine decimals, and the perplexity."""
    return score(docs).select("doc_id", "n_words", "n_seen", F.round("score", 9).alias("score"),
                              F.round(F.exp(-F.col("score")), 3).alias("perplexity"))
