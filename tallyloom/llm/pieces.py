"""SentencePiece encoding and decoding of merge models by backtracking.

A merge model joins the two neighbouring symbols of best score again and again, leftmost first among equals, starting
from single characters. A row of pieces is the result of that exactly if each two neighbours are compatible: merging
their joined characters anew gives the same two pieces. (The first merge across a seam of the whole text would also be
the first one in the two pieces alone.) So pieces can be found from left to right:

1. One Aho-Corasick pass gives the longest piece that starts at each place; shorter ones are its prefixes.
2. At each place the longest piece that is compatible with the one before is taken, or else the next shorter one. Two
   pieces are merged anew by following the merges inside each in their common order, with the pair at the seam.
3. If none fits, the place can't be a seam of this text; its bit in a bitfield is set, and the piece before is taken
   back for a shorter one. Each place fails at most once, so the work stays linear in the text.

Compatible pairs are remembered. Characters in no piece become byte pieces. Between two characters that stand beside
each other in no piece a text falls apart into words; the words of a slice are encoded once each and remembered by
the worker (up to ``KEEP`` words, then forgotten, which costs time, not results). Tasks take slices of whole texts; no shuffle
takes place. Decoding looks ids up in a table of byte strings.

Edge cases: a null text counts as empty, and has the end id only; the strings of control pieces are ordinary text; a
long text is a slice of its own, a long word one of its words; repeated rows and empty tables need no care. Input
columns that carry the name of an added column are replaced. Models with a character map, with unused pieces or
without byte pieces are refused.
"""

from __future__ import annotations

import codecs
import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tallyloom.llm.bpe import SCHEMA, _ragged
from tallyloom.llm.common import others, sliced

SPACE = "▁"
#: Bytes of text encoded at once.
CHUNK = 4 << 20
#: Words and pairs of pieces kept, and characters of the words.
KEEP = 400_000
KEEP_CHARS = 16 << 20
#: Characters of new words searched at once.
STRIDE = 1 << 18
NEVER = 1 << 40


class Vocabulary:
    """Pieces, their ranks and the bytes they stand for. ``model``: the content of a model file; bounded by its vocabulary."""

    def __init__(self, model: bytes):
        given = sentencepiece.SentencePieceProcessor(model_proto=model)
        every = range(given.get_piece_size())
        if any(given.is_unused(i) for i in every):
            raise ValueError("a vocabulary with unused pieces is not a plain merge model")
        self.pieces = [given.id_to_piece(i) for i in every]
        self.bytes = [b""] * len(self.pieces)
        self.byte_id = [-1] * 256
        self.normal = np.zeros(len(self.pieces), dtype=bool)
        for i, piece in enumerate(self.pieces):
            if given.is_byte(i):
                self.bytes[i] = bytes([int(piece[3:5], 16)])
                self.byte_id[int(piece[3:5], 16)] = i
            elif given.is_unknown(i):
                self.bytes[i] = " ⁇ ".encode()
            elif not given.is_control(i):
                self.bytes[i], self.normal[i] = piece.replace(SPACE, " ").encode(), True
        if -1 in self.byte_id:
            raise ValueError("a vocabulary without byte pieces can't hold every text")
        # What a plain model makes of odd texts: a leading space mark, nothing dropped, nothing mapped.
        for text in (" a  b ", "ﬁＡ\t\n é"):
            if given.normalize(text) != SPACE + text.replace(" ", SPACE):
                raise ValueError("a model that maps characters or drops spaces is not supported")
        scores = sorted({given.get_score(i) for i in np.flatnonzero(self.normal).tolist()}, reverse=True)
        rank = {score: r for r, score in enumerate(scores)}
        self.rank = {self.pieces[i]: rank[given.get_score(i)] for i in np.flatnonzero(self.normal).tolist()}
        self.end = given.eos_id()

    def history(self, text: str) -> tuple[list[str], list[tuple[int, str, str]]]:
        """The symbols left of a text, and its merges in order: rank, first symbol and last symbol afterwards."""
        symbols, steps, rank = [*text], [], self.rank
        while len(symbols) > 1:
            best, at = min((rank.get(a + b, NEVER), i) for i, (a, b) in enumerate(pairwise(symbols)))
            if best == NEVER:
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
            steps.append((best, symbols[0], symbols[-1]))
        return symbols, steps


class Decoder:
    """Ids to text, as the library's decode(ids)."""

    def __init__(self, vocabulary: Vocabulary):
        self.lengths = np.array([len(b) for b in vocabulary.bytes], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(vocabulary.bytes), dtype=np.uint8)
        self.spaced = vocabulary.normal & np.array([p.startswith(SPACE) for p in vocabulary.pieces])
        self.silent = self.lengths == 0
        self.byte = np.zeros(len(self.lengths), dtype=bool)
        self.byte[vocabulary.byte_id] = True
        codecs.register_error("tallyloom-bytes", lambda error: ("�", error.start + 1))

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text: one space of the first piece goes, bytes that are no character become U+FFFD each."""
        found = self.data[_ragged(self.starts[ids], self.lengths[ids])]
        first = ids[~self.silent[ids]][:1]
        if len(first) and self.spaced[first[0]]:
            found = found[1:]
        text = found.tobytes()
        return text.decode(errors="tallyloom-bytes").encode() if self.byte[ids].any() else text


class Tables:
    """What encoding needs of a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        pieces = [p if n else None for p, n in zip(vocabulary.pieces, vocabulary.normal.tolist(), strict=True)]
        known = set(filter(None, pieces))
        # Characters that only stand inside pieces get numbers beyond the pieces; the last number is any other character.
        self.texts = [*pieces, *sorted({c for p in known for c in p} - known), ""]
        self.other = len(self.texts) - 1
        self.length = [len(t or "") for t in self.texts]
        self.length[self.other] = 1
        number = {t: i for i, t in enumerate(self.texts) if t}
        self.shorter = [next((number[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in number), -1) if t else -1
                        for t in self.texts]
        self.search = ahocorasick.Automaton()
        for text, i in number.items():
            self.search.add_word(text, i)
        self.search.make_automaton()
        self.apart = next(chr(c) for c in range(0x10FFFF, 0, -1) if chr(c) not in number)
        # A bit for the hash of each two characters that stand together in a piece.
        self.together = np.zeros(1 << 22, dtype=bool)
        pairs = np.array([[ord(a), ord(b)] for p in known for a, b in pairwise(p)], dtype=np.uint32).reshape(-1, 2)
        self.together[self.pair(pairs[:, 0], pairs[:, 1])] = True
        self.decimal = [str(i) for i in range(max(len(pieces) - 1, vocabulary.end, *vocabulary.byte_id) + 1)]
        self.histories: dict[int, list | None] = {-1: [], self.other: []}

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return ((left * np.uint32(0x9E3779B1) + right) * np.uint32(0x85EBCA6B)) >> np.uint32(10)

    def history(self, piece: int) -> list[tuple[int, str, str]] | None:
        """The merges that make a piece; None if merging its characters gives something else."""
        if piece not in self.histories:
            left, steps = self.vocabulary.history(self.texts[piece])
            self.histories[piece] = [*steps, (NEVER, "", "")] if len(left) == 1 else None
        return self.histories[piece]

    def compatible(self, last: int, piece: int) -> bool:
        """Whether merging the characters of both anew gives these two pieces.

        The merges inside each are known, so only their order and the two symbols at the seam are followed: the seam
        holds if its pair is never the best one, where the pair further left wins among equals.
        """
        ours, theirs = self.history(last), self.history(piece)
        if not ours or not theirs:  # nothing before, any other character, or no result of merges
            return theirs is not None
        left, right, i, j = self.texts[last][-1], self.texts[piece][0], 0, 0
        rank = self.vocabulary.rank
        while True:
            here, before, behind = rank.get(left + right, NEVER), ours[i][0], theirs[j][0]
            if here < before and here <= behind and here != NEVER:
                return False
            if before <= behind:
                if before == NEVER:
                    return True
                left, i = ours[i][2], i + 1
            else:
                right, j = theirs[j][1], j + 1


class Encoder:
    """Encodes chunks of texts; keeps the ids of words it has met."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self._forget()

    def _forget(self) -> None:
        self.numbers: defaultdict[str, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.ids, self.counts = np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        self.known: dict[int, bool] = {}
        self.chars = 0

    def walk(self, text: str) -> list[int]:
        """The pieces of a text from left to right."""
        tables, known = self.tables, self.known
        length, shorter, compatible, base = tables.length, tables.shorter, tables.compatible, len(tables.texts)
        found = np.fromiter(tables.search.iter(text), dtype=[("end", np.int32), ("piece", np.int32)])
        longest = np.full(len(text) + 1, tables.other, dtype=np.int32)
        # In the order of their ends, so the longest one of a start comes last.
        longest[found["end"] + 1 - np.array(length, dtype=np.int32)[found["piece"]]] = found["piece"]
        longest, n = longest.tolist(), len(text)
        failed = bytearray((n >> 3) + 1)
        row, at, last, piece = [], 0, -1, longest[0]
        while at < n:
            while piece >= 0:
                end = at + length[piece]
                if not failed[end >> 3] >> (end & 7) & 1:
                    key = (last + 1) * base + piece
                    fits = known.get(key)
                    if fits is None:
                        fits = known[key] = compatible(last, piece)
                    if fits:
                        break
                piece = shorter[piece]
            if piece >= 0:
                row.append(piece)
                at, last = end, piece
                piece = longest[at]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = row.pop()
                at -= length[piece]
                piece, last = shorter[piece], row[-1] if row else -1
        return row

    def words(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of all words, one after the other, and the number of each word's ids, for some words at a time.

        Some words are one text, held apart by a character of no piece.
        """
        tables, pieces = self.tables, len(self.tables.vocabulary.pieces)
        length = np.array(tables.length, dtype=np.int64)
        start = 0
        while start < len(words):
            end, size = start, 0
            while end < len(words) and size < STRIDE:
                size += len(words[end]) + 1
                end += 1
            some, start = words[start:end], end
            text = tables.apart.join(some)
            row = np.array(self.walk(text), dtype=np.int64)
            places = np.cumsum(length[row]) - length[row]
            apart = np.searchsorted(places, np.cumsum([len(w) + 1 for w in some])[:-1] - 1)
            counts = np.ones(len(row), dtype=np.int64)
            counts[apart] = 0
            odd = np.flatnonzero((row >= pieces) & (counts > 0))
            held = [[tables.vocabulary.byte_id[b] for b in text[i].encode()] for i in places[odd].tolist()]
            counts[odd] = [len(h) for h in held]
            ids = np.repeat(row, counts)
            if len(odd):
                ids[_ragged((np.cumsum(counts) - counts)[odd], counts[odd])] = np.concatenate(held)
            yield ids.astype(np.int32), np.add.reduceat(counts, np.append(0, apart))

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
        """Ids of each text, the end id last, and the ids as decimal numbers joined by a space."""
        if max(len(self.numbers), len(self.known)) > KEEP or self.chars > KEEP_CHARS:
            self._forget()
        shown = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        ends = np.cumsum([len(t) for t in shown])
        whole = "".join(shown)
        codes = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        apart = np.ones(len(codes) + 1, dtype=bool)
        apart[1:-1] = ~self.tables.together[self.tables.pair(codes[:-1], codes[1:])]
        apart[ends] = True
        cuts = np.flatnonzero(apart)
        known, places = len(self.numbers), cuts.tolist()
        words = np.fromiter((self.numbers[whole[a:b]] for a, b in pairwise(places)), dtype=np.int64)
        new = [w for w, _ in zip(reversed(self.numbers), range(len(self.numbers) - known), strict=False)][::-1]
        found = list(self.words(new))
        self.chars += sum(map(len, new))
        self.ids = np.concatenate([self.ids, *(ids for ids, _ in found)])
        self.counts = np.concatenate([self.counts, *(counts for _, counts in found)])
        starts, end = np.cumsum(self.counts) - self.counts, self.tables.vocabulary.end
        ids, decimal, at = [], [], 0
        for to in np.searchsorted(cuts, ends).tolist():
            doc, at = words[at:to], to
            ids.append(np.append(self.ids[_ragged(starts[doc], self.counts[doc])], np.int32(end)))
            decimal.append(" ".join(map(self.tables.decimal.__getitem__, ids[-1].tolist())))
        return ids, decimal


def encode(docs: DataFrame, model_path: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """``docs`` without ``text`` and with n_tokens, ids_sha256, decoded_sha256 and, if asked, ids (array<int>).

    ids_sha256: digest of the decimal ids joined by a space; decoded_sha256: of the text that the ids decode to.
    ``model_path`` is read by the driver.
    """
    with open(model_path, "rb") as file:
        # Bounded: the vocabulary. A worker adds tables and known words to its copy, for the next tasks of the job.
        shared = docs.sparkSession.sparkContext.broadcast({"model": file.read()})
    added = SCHEMA + ", ids array<int>" * with_ids
    kept = others(docs, added, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "encoder" not in shared.value:
            shared.value["encoder"] = Encoder(Tables(Vocabulary(shared.value["model"])))
        encoder = shared.value["encoder"]
        decoder = Decoder(encoder.tables.vocabulary)
        for batch in sliced(batches, text, CHUNK):
            ids, shown = encoder.encode([t or "" for t in batch.column(text).to_pylist()])
            arrays = [*(batch.column(c) for c in kept), pa.array([len(x) for x in ids], pa.int64()),
                      pa.array([hashlib.sha256(x.encode()).hexdigest() for x in shown], pa.string()),
                      pa.array([hashlib.sha256(decoder.decode(x)).hexdigest() for x in ids], pa.string())]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(
                arrays, [*kept, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {kind}" for c, kind in docs.dtypes if c in kept), added]))


def report(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    return encode(docs.select("doc_id", "text"), model_path, with_ids=False)
