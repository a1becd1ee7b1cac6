"""Byte-level BPE by corpus-level merge replay.

A task gathers whole documents up to ``CHUNK`` bytes of text, splits them by the public pattern and keeps each document
as numbers of distinct pieces. The new distinct pieces of the chunk form one array of symbols, a byte each, linked to
their neighbours inside the piece. An inverted index from a pair's merge rank to the positions where that pair stands
then replays the merge list in rank order: all positions of the lowest rank present merge at once, and only the pairs
of their neighbours are looked up anew and indexed. Encoded pieces are kept for later chunks of the task (up to
``KEEP`` pieces, then forgotten, which costs time, not results), documents are put together from them, and ids are
decoded back through the byte strings of the ranks. No shuffle takes place and no state leaves a task.

The encoding is that of the merge ranks alone: within a piece the lowest rank merges first, leftmost first. A list
whose merge makes a pair of still lower rank would need the step-by-step order inside that piece; such pieces are
noticed and replayed one merge at a time.

Edge cases: a null text counts as empty and has no ids; the digests of nothing are those of the empty string; special
tokens do not exist, their strings are ordinary text; repeated rows and empty tables need no care.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallyloom.llm.common import others

CHUNK = 8 << 20
KEEP = 400_000
NONE = np.int32(np.iinfo(np.int32).max)

SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> list[bytes]:
    """Byte strings by rank; the file is small and bounded by its vocabulary."""
    with open(path, "rb") as lines:
        found = {int(rank): base64.b64decode(text) for text, rank in (line.split() for line in lines if line.strip())}
    return [found[rank] for rank in range(len(found))]


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each of the given runs, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class Merges:
    """The merge list: rank of every pair of tokens whose bytes together are a token."""

    def __init__(self, tokens: list[bytes]):
        rank = {token: i for i, token in enumerate(tokens)}
        self.byte = np.array([rank[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {}
        for i, token in enumerate(tokens):
            for cut in range(1, len(token)):
                left, right = rank.get(token[:cut]), rank.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = i
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[key] for key in self.keys.tolist()], dtype=np.int32)
        self.pairs = pairs
        lengths = np.array([len(token) for token in tokens], dtype=np.int64)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` if it doesn't merge."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[_ragged(self.starts[ids], self.lengths[ids])]

    def one(self, piece: bytes) -> list[int]:
        """A piece by single merges: the pair of lowest rank, leftmost first, from a heap of pairs."""
        token = self.byte[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(token)
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n

        def rank(i: int) -> int | None:
            return self.pairs.get(token[i] << 32 | token[after[i]]) if after[i] < n else None

        heap = [(r, i) for i in range(n) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if gone[i] or rank(i) != r:
                continue
            token[i], right = r, after[i]
            gone[right], after[i] = True, after[right]
            if after[i] < n:
                before[after[i]] = i
            for j in (i, before[i]):
                if j >= 0 and (new := rank(j)) is not None:
                    heapq.heappush(heap, (new, j))
        return [t for t, dead in zip(token, gone, strict=True) if not dead]

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and the number of each piece's ids."""
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        n = int(sizes.sum())
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        token = self.byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        # Position n stands for "no neighbour"; it never holds a pair.
        token = np.append(token, np.int32(0))
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        ends = np.cumsum(sizes)[sizes > 0]
        after[ends - 1] = n
        before[ends[:-1]] = n
        before[:1] = n
        here = np.flatnonzero(after[:n] < n)
        pair = np.full(n + 1, NONE, dtype=np.int32)
        pair[here] = self.rank(token[here], token[here + 1])
        alive = np.ones(n + 1, dtype=bool)
        early = np.zeros(len(pieces), dtype=bool)

        index: dict[int, list[np.ndarray]] = defaultdict(list)
        ranks: list[int] = []

        def add(positions: np.ndarray) -> None:
            positions = positions[pair[positions] != NONE]
            if not len(positions):
                return
            of = pair[positions]
            order = np.argsort(of, kind="stable")
            positions, of = positions[order], of[order]
            cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
            starts = [0, *cuts.tolist(), len(of)]
            for r, a, b in zip(of[starts[:-1]].tolist(), starts, starts[1:], strict=False):
                if r not in index:
                    heapq.heappush(ranks, r)
                index[r].append(positions[a:b])

        add(here)
        while ranks:
            r = heapq.heappop(ranks)
            held = index.pop(r)
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            at = at[pair[at] == r]
            if len(at) > 1:
                # Of pairs that overlap in a row, every second one merges.
                chained = after[at[:-1]] == at[1:]
                if chained.any():
                    where = np.arange(len(at))
                    first = np.maximum.accumulate(np.where(np.append(False, chained), 0, where))
                    at = at[(where - first) % 2 == 0]
            if not len(at):
                continue
            right = after[at]
            beyond = after[right]
            # Where the next merge of this rank follows at once, the pair that stands there in between.
            beside = np.flatnonzero(beyond[:-1] == at[1:])
            if len(beside):
                between = self.rank(np.full(len(beside), r), token[at[beside + 1]])
                early[owner[at[beside[between < r]]]] = True
            token[at], alive[right], pair[right] = r, False, NONE
            after[at] = beyond
            before[beyond] = at
            touched = before[at]
            touched = np.unique(np.concatenate([at, touched[touched < n]]))
            to = after[touched]
            new = np.where(to < n, self.rank(token[touched], token[to]), NONE)
            pair[touched] = new
            if (new < r).any():
                early[owner[touched[new < r]]] = True
            add(touched)
        ids, of = token[:n][alive[:n]], owner[alive[:n]]
        counts = np.bincount(of, minlength=len(pieces))
        if early.any():
            split = np.split(ids, np.cumsum(counts)[:-1])
            for i in np.flatnonzero(early).tolist():
                split[i] = np.array(self.one(pieces[i]), dtype=np.int32)
            ids, counts = np.concatenate(split), np.array([len(x) for x in split])
        return ids.astype(np.int32), counts.astype(np.int64)


class Encoder:
    """Encodes chunks of texts; keeps the ids of pieces it has met."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.merges, self.split = Merges(tokens), regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.numbers: defaultdict[str, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.ids, self.counts = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.numbers) > KEEP:
            self._forget()
        known, number, split = len(self.numbers), self.numbers.__getitem__, self.split
        docs = [np.fromiter(map(number, split(text)), dtype=np.int32) for text in texts]
        if len(self.numbers) > known:
            new = [piece.encode() for piece, _ in zip(reversed(self.numbers), range(len(self.numbers) - known),
                                                      strict=False)]
            ids, counts = self.merges.replay(new[::-1])
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        starts = np.cumsum(self.counts) - self.counts
        return [self.ids[_ragged(starts[doc], self.counts[doc])] for doc in docs]


def encode_batches(batches: Iterator[pa.RecordBatch], tokens: list[bytes], pattern: str, column: str,
                   with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Batches without ``column`` and with the columns of ``SCHEMA`` (and ids)."""
    encoder = Encoder(tokens, pattern)

    def finish(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [text or "" for batch in held for text in batch.column(column).to_pylist()]
        encoded = encoder.encode(texts)
        merges, at = encoder.merges, 0
        for batch in held:
            ids = encoded[at:at + batch.num_rows]
            at += batch.num_rows
            arrays = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != column]
            names = [name for name in batch.schema.names if name != column]
            arrays += [pa.array([len(x) for x in ids], pa.int64()),
                       pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                       pa.array([hashlib.sha256(merges.decode(x).tobytes()).hexdigest() for x in ids], pa.string())]
            if with_ids:
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, [*names, "n_tokens", "ids_sha256", "decoded_sha256",
                                                      *["ids"] * with_ids])

    held, size = [], 0
    for batch in batches:
        for part in _bounded(batch, column):
            held.append(part)
            size += part.column(column).nbytes
            if size >= CHUNK:
                yield from finish(held)
                held, size = [], 0
    if held:
        yield from finish(held)


def _bounded(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of at most about ``CHUNK`` bytes of text, of whole rows."""
    n = batch.num_rows
    if batch.column(column).nbytes <= CHUNK or n < 2:
        yield batch
    else:
        yield from _bounded(batch.slice(0, n // 2), column)
        yield from _bounded(batch.slice(n // 2), column)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """``docs`` without ``text`` and with n_tokens, ids_sha256, decoded_sha256 and, if asked, ids (array<int>).

    ids_sha256: digest of the ids as little-endian unsigned 32-bit integers; decoded_sha256: of the decoded bytes.
    ``ranks_path`` is read by the driver. Input columns that carry the name of an added one are replaced.
    """
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))  # bounded: the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return encode_batches(batches, tokens.value, pattern, text, with_ids)

    added = SCHEMA + ", ids array<int>" * with_ids
    kept = others(docs, added, text)
    schema = ", ".join([*(f"`{name}` {kind}" for name, kind in docs.dtypes if name in kept), added])
    return docs.select(*(f"`{c}`" for c in kept), text).mapInArrow(run, schema)


def decode(ids: np.ndarray, tokens: list[bytes]) -> bytes:
    """The bytes of a sequence of ids."""
    return b"".join(tokens[i] for i in ids.tolist())


def report(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    return encode(docs.select("doc_id", "text"), ranks_path, pattern, with_ids=False)
