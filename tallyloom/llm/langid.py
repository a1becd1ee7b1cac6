"""Language identification with hyperdimensional profiles.

Every letter has a random vector of ``DIM`` signs, a fixed function of its code point. A letter n-gram's vector binds
its letters' vectors, each permuted (rotated) by its place: v(abc) = rot2(a) * rot1(b) * c. A text is the bundle (sum)
of its n-grams' vectors, a language's prototype the bundle of all its training texts. A text is compared with every
prototype by cosine; the largest wins, ties to the smaller language code.

N-grams run over lower-cased letters inside words, a word's two ends counting as a letter of their own. Training and
prediction take whole texts, long ones in segments cut between words. Training is one pass without a shuffle of
documents: each task bundles its texts per language in whole numbers and returns one vector per language, so the sums
are exact and don't depend on partitioning. Prototypes are 8 KB for each distinct language and are sent to all tasks;
``MAX_LANGUAGES`` bounds them (beyond it, ``fit`` raises).

Edge cases: a text that is null or has no letter is ``und`` with score 0, as is every text if nothing was learned or
no n-gram is near any prototype (cosine 0 or less keeps the best language with score 0); rows with a null language
teach nothing; a null doc_id counts as the empty string in the fold; empty tables and repeated rows need no care; long
texts are read whole, in blocks; columns of other names are not used, but for those that ``keep`` is asked to return.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 1024
GRAM = 3
FOLDS = 5
MAX_LANGUAGES = 10_000
UNKNOWN = "und"
#: Characters handled at once, and characters of a segment of a long text.
CHUNK = 800_000
SEGMENT = 400_000
BLOCK = 64
#: A document goes if it is nearer to another language than to its own by this much, or near to none.
MARGIN = 0.25
LEAST_SCORE = 0.05


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def letter_bits(codes: np.ndarray, words: int) -> np.ndarray:
    """``words`` times 64 pseudo-random bits for each code point (a splitmix64 sequence seeded by it)."""
    with np.errstate(over="ignore"):
        x = codes.astype(np.uint64)[:, None] * np.uint64(1 << 16) + np.arange(1, words + 1, dtype=np.uint64)
        x = x * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Grams:
    """Turns texts into n-gram counts and the n-grams into their vectors."""

    def __init__(self, dim: int = DIM, gram: int = GRAM):
        self.dim, self.gram = dim, gram
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)

    def segments(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > SEGMENT:
            end = start + SEGMENT
            while end < len(text) and text[end].isalpha():
                end += 1
            yield text[start:end]
            start = end
        yield text[start:]

    def count(self, texts: list[str], owners: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The letters of each distinct n-gram (rows of code points), and for each n-gram occurrence its row and owner."""
        coded = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
        owner = np.repeat(np.array(owners, dtype=np.int32), [len(c) for c in coded])
        codes = np.concatenate(coded) if coded else np.zeros(0, dtype=np.uint32)
        codes = np.where(self.letter[codes], codes, np.uint32(0))
        seen = np.zeros(0x110000, dtype=bool)
        seen[codes] = True
        seen[0] = True
        alphabet = np.flatnonzero(seen)
        small = np.zeros(0x110000, dtype=np.int32)
        small[alphabet] = np.arange(len(alphabet))
        letters, n, size = small[codes], self.gram, len(alphabet)
        count = max(0, len(letters) - n + 1)
        wide = np.int32 if size ** n < 1 << 31 else np.int64
        key, inside = np.zeros(count, dtype=wide), np.ones(count, dtype=bool)
        for k in range(n):
            here = letters[k:k + count]
            key = key * size + here
            # Ends of words stand only at the ends of an n-gram, which then holds a letter.
            inside &= here != 0 if 0 < k < n - 1 else True
        key, owner = key[inside], owner[:count][inside]
        if size ** n <= 1 << 24:
            present = np.zeros(size ** n, dtype=bool)
            present[key] = True
            distinct = np.flatnonzero(present)
            rank = np.zeros(size ** n, dtype=np.int32)
            rank[distinct] = np.arange(len(distinct))
            row = rank[key]
        else:
            distinct, row = np.unique(key, return_inverse=True)
        places = [alphabet[distinct // size ** (n - 1 - k) % size] for k in range(n)]
        return np.stack(places, axis=1) if n else distinct[:, None], row, owner

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """A row of ``dim`` signs for each n-gram."""
        bound = np.zeros((len(grams), self.dim), dtype=np.uint8)
        for k in range(self.gram):
            codes, row = np.unique(grams[:, k], return_inverse=True)
            bits = np.unpackbits(letter_bits(codes, self.dim // 64).view(np.uint8), axis=1)
            bound ^= np.roll(bits, self.gram - 1 - k, axis=1)[row]
        return 1 - 2 * bound.astype(np.float32)


def _chunks(texts: Iterator[tuple[int, str]], grams: Grams) -> Iterator[tuple[list[int], list[str]]]:
    owners, parts, size = [], [], 0
    for owner, text in texts:
        for part in grams.segments(text):
            owners.append(owner)
            parts.append(part)
            size += len(part)
            if size >= CHUNK:
                yield owners, parts
                owners, parts, size = [], [], 0
    if parts:
        yield owners, parts


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language, the bundle of all texts of a task."""
    grams, sums = Grams(), {}
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text")
        names = sorted(set(langs))
        number = {name: i for i, name in enumerate(names)}
        rows = ((number[lang], text.as_py()) for lang, text in zip(langs, texts, strict=True))
        for owners, parts in _chunks(rows, grams):
            letters, row, owner = grams.count(parts, owners)
            g = len(letters)
            if not g:
                continue
            counts = np.bincount(owner * np.int64(g) + row, minlength=len(names) * g).reshape(len(names), g)
            total = counts.astype(np.float64) @ grams.vectors(letters).astype(np.float64)
            for i in np.flatnonzero(counts.sum(axis=1)).tolist():
                sums[names[i]] = sums.get(names[i], 0) + np.rint(total[i]).astype(np.int64)
    yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "sums": pa.array(
        [v.tolist() for v in sums.values()], pa.list_(pa.int64()))})


class Model:
    """Prototypes: languages in order, and a row of unit length for each."""

    def __init__(self, langs: list[str], prototypes: np.ndarray):
        self.langs, self.prototypes = langs, prototypes

    def cosines(self, texts: list[str], grams: Grams) -> tuple[np.ndarray, np.ndarray]:
        """Cosine of every text with every prototype, and whether the text has a letter."""
        bundles = np.zeros((len(texts), grams.dim), dtype=np.float64)
        lettered = np.zeros(len(texts), dtype=bool)
        for owners, parts in _chunks(enumerate(texts), grams):
            letters, row, owner = grams.count(parts, owners)
            if not len(letters):
                continue
            vectors = grams.vectors(letters)
            first, last = owners[0], owners[-1] + 1
            cuts = np.searchsorted(owner, np.arange(first, last + BLOCK, BLOCK))
            for block, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                if a == b:
                    continue
                at = first + block * BLOCK
                rows, col = np.unique(row[a:b], return_inverse=True) if b - a < len(letters) else (
                    np.arange(len(letters)), row[a:b])
                n = min(BLOCK, last - at)
                counts = np.bincount((owner[a:b] - at) * len(rows) + col, minlength=n * len(rows))
                counts = counts.reshape(n, len(rows)).astype(np.float32)
                bundles[at:at + n] += counts @ vectors[rows]
                lettered[at:at + n] |= counts.any(axis=1)
        norms = np.linalg.norm(bundles, axis=1, keepdims=True)
        return bundles @ self.prototypes.T / np.where(norms == 0, 1, norms), lettered


def fit(docs: DataFrame) -> Model:
    """Prototypes from ``text`` and ``lang`` of all rows of ``docs`` where both are there.

    The ``MAX_LANGUAGES`` values of ``lang`` with most documents are learned, each from all of its documents.
    """
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    parts = rows.mapInArrow(_bundle, "lang string, sums array<long>")
    # The names with most documents, in a column however dirty; ties go by name.
    names = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).select("lang")
    sums = parts.select("lang", F.posexplode("sums").alias("dim", "value")).groupBy("lang", "dim") \
        .agg(F.sum("value").alias("value")).groupBy("lang").agg(F.collect_list(F.struct("dim", "value")).alias("v"))
    found = {r.lang: r.v for r in sums.join(names, "lang", "left_semi").collect()}
    langs = sorted(found)
    prototypes = np.zeros((len(langs), DIM))
    for i, lang in enumerate(langs):
        for entry in found[lang]:
            prototypes[i, entry.dim] = entry.value
    norms = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return Model(langs, prototypes / np.where(norms == 0, 1, norms))


def predictor(model: Model):
    """Column function of a text: struct of lang_pred, score and cosines (by language)."""
    langs, prototypes = model.langs, model.prototypes
    kind = "lang_pred string, score double, cosines array<double>"

    @F.arrow_udf(kind)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams, known = Grams(), Model(langs, prototypes)
        for batch in batches:
            cosines, lettered = known.cosines([t or "" for t in batch.to_pylist()], grams)
            n = len(batch)
            if langs:
                best = cosines.argmax(axis=1)
                names = [langs[b] if is_text else UNKNOWN for b, is_text in zip(best, lettered, strict=True)]
                scores = np.where(lettered, np.clip(cosines[np.arange(n), best], 0, 1), 0.0)
            else:
                names, scores = [UNKNOWN] * n, np.zeros(n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(langs)),
                                             pa.array(cosines.ravel(), pa.float64()))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), lists],
                                             ["lang_pred", "score", "cosines"])

    return predict.asNondeterministic()


def train(docs: DataFrame) -> Model:
    return fit(docs.where(~held_out(F.col("doc_id"))))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    predict = predictor(train(docs))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text")).alias("_p"))
    return out.select("doc_id", "held_out", "_p.lang_pred", "_p.score")


def keep(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` of the documents that read as the language they claim.

    A document goes if it is ``und``, if it is near no prototype (``LEAST_SCORE``), or if its own language was learned
    and another is nearer by more than ``MARGIN``. Documents of unlearned or null languages are judged by score alone.
    """
    model = train(docs)
    out = docs.select(*columns, predictor(model)(F.col("text")).alias("_p"))
    own = F.get(F.col("_p.cosines"), F.array_position(F.array(*map(F.lit, model.langs)).cast("array<string>"),
                                                      F.col("lang")).cast("int") - 1)
    wrong = F.coalesce(F.col("_p.score") - own > MARGIN, F.lit(False))
    return out.where((F.col("_p.lang_pred") != UNKNOWN) & (F.col("_p.score") >= LEAST_SCORE) & ~wrong).select(*columns)
