"""Fill-in-middle by displacement scatter.

A text is cut into units (a run of ASCII letters, or any other single code point), two cuts among them give a prefix, a
middle and a suffix, and these are written anew in the order of the document's form, each after its mark. A hash of
``seed`` and doc_id decides cuts and form, so any rerun and any partitioning gives the same.

**Scan.** A slice of an Arrow batch is one array of bytes. A byte starts a unit unless it continues a code point or
follows a letter as a letter; the places of the starts turn unit numbers into byte places.
**Scatter.** Every part of a text moves by one displacement. The differences between neighbouring parts go into an array
at the parts' first bytes, whose cumulative sum is the displacement of every byte of the slice; one numpy assignment
puts all bytes into the output, another one the marks.
**Gather.** Reading back finds the three marks of each output, takes the same differences over the restored bytes and
gathers them. A text that holds a mark stays plain, and no mark can arise at a seam, so output and form are enough.

Edge cases: a null text counts as empty; an empty text is plain; a null doc_id hashes as nothing; repeated rows have
equal outputs; a long text is one slice of its own; an empty table gives no rows. Input columns that carry the name of
an added column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import others, sliced

MARKS = (b"<P>", b"<S>", b"<M>")
MARK = 3
SEED = 1
#: Shares in percent: texts left as they are, and texts of the rest whose suffix comes first.
PLAIN, SUFFIX_FIRST = 10, 20
FORMS = ("plain", "psm", "spm")
#: Bytes of text worked on at once.
CHUNK = 1 << 20

COLUMNS = "n long, form string, prefix_chars long, middle_chars long, fim_text string"
DIGESTS = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and the places where they start and the last one ends."""
    whole = texts.fill_null("").cast(pa.large_string())
    _, at, data = whole.buffers()
    at = np.frombuffer(at, dtype=np.int64)[whole.offset:whole.offset + len(whole) + 1] if at else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """The texts that lie between these places."""
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(np.ascontiguousarray(at)),
                                            pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def units(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places where units start."""
    begins = (data & 0xC0) != 0x80
    small = data | 0x20
    letter = (small >= 97) & (small <= 122)
    begins[1:] &= ~(letter[1:] & letter[:-1])
    begins[at[:-1][at[:-1] < len(data)]] = True
    return np.flatnonzero(begins)


def marked(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of marks that lie inside one text, and the numbers of these texts."""
    if len(data) < MARK:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = np.array([m[1] for m in MARKS], dtype=np.uint8)
    places = np.flatnonzero((data[:-2] == MARKS[0][0]) & (data[2:] == MARKS[0][2]))
    places = places[np.isin(data[places + 1], inner)]
    owner = np.searchsorted(at, places, side="right") - 1
    inside = places + MARK <= at[owner + 1]
    return places[inside], owner[inside]


def draws(ids: list, seed: int) -> np.ndarray:
    """Four unsigned 32-bit numbers for each id."""
    shown = ("" if i is None else i for i in ids)
    digest = b"".join(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:16] for i in shown)
    return np.frombuffer(digest, dtype=">u4").astype(np.int64).reshape(-1, 4)


def displacements(starts: np.ndarray, moves: np.ndarray, size: int) -> np.ndarray:
    """The move of each of ``size`` bytes, if all bytes from a start up to the next one move alike."""
    steps = np.zeros(size + 1, dtype=np.int64)
    np.add.at(steps, starts, np.diff(moves, prepend=0))
    return np.cumsum(steps[:-1])


def scatter(data: np.ndarray, at: np.ndarray, ids: list, seed: int = SEED) -> dict[str, np.ndarray]:
    """n, form (place in ``FORMS``), characters of prefix and middle, and the outputs as bytes and places."""
    begins = units(data, at)
    first = np.searchsorted(begins, at)
    n = np.diff(first)
    h = draws(ids, seed)
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    # The unit after a text's last one is the next text's first, or the end.
    edge = np.append(begins, len(data))[first[:-1, None] + cuts]
    held = np.zeros(len(n), dtype=bool)
    held[marked(data, at)[1]] = True
    plain = (n == 0) | held | (h[:, 2] % 100 >= 100 - PLAIN)
    suffix_first = ~plain & (h[:, 3] % 100 < SUFFIX_FIRST)
    form = np.where(plain, 0, np.where(suffix_first, 2, 1))

    starts = np.column_stack([at[:-1], edge])
    prefix, middle, suffix = np.diff(np.column_stack([starts, at[1:]]), axis=1).T
    out_at = np.cumsum(np.append(0, np.diff(at) + np.where(plain, 0, 3 * MARK)))
    here = out_at[:-1]
    last = here + 3 * MARK + prefix + suffix
    to = np.where(suffix_first[:, None],
                  np.column_stack([here + 2 * MARK + suffix, last, here + MARK]),
                  np.column_stack([here + MARK, last, here + 2 * MARK + prefix]))
    to = np.where(plain[:, None], starts - at[:-1, None] + here[:, None], to)
    moves = displacements(starts.ravel(), (to - starts).ravel(), len(data))
    out = np.empty(out_at[-1], dtype=np.uint8)
    out[np.arange(len(data)) + moves] = data
    for part, mark in zip((0, 2, 1), MARKS, strict=True):
        places = to[~plain, part] - MARK
        for j, byte in enumerate(mark):
            out[places + j] = byte

    chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    return {"n": n, "form": form, "prefix_chars": chars[edge[:, 0]] - chars[at[:-1]],
            "middle_chars": chars[edge[:, 1]] - chars[edge[:, 0]], "data": out, "at": out_at}


def gather(data: np.ndarray, at: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts that gave these outputs, as bytes and places."""
    changed = form > 0
    places, owner = marked(data, at)
    marks = places[changed[owner]]
    if len(marks) != 3 * changed.sum():
        raise ValueError("an output that is not plain must hold three marks")
    marks = marks.reshape(-1, 3)
    suffix_first = form[changed] == 2
    ends = at[1:][changed]
    second = np.where(suffix_first, 0, 1)
    rows = np.arange(len(marks))
    bounds = np.column_stack([marks, ends])
    prefix, suffix = marks[rows, 1 - second] + MARK, marks[rows, second] + MARK
    prefix_size, suffix_size = bounds[rows, 2 - second] - prefix, bounds[rows, second + 1] - suffix
    middle = marks[:, 2] + MARK

    lost = np.where(changed, 3 * MARK, 0)
    back_at = np.cumsum(np.append(0, np.diff(at) - lost))
    starts, sources = np.repeat(back_at[:-1, None], 3, axis=1), np.repeat(at[:-1, None], 3, axis=1)
    here = back_at[:-1][changed]
    starts[changed] = np.column_stack([here, here + prefix_size, here + prefix_size + ends - middle])
    sources[changed] = np.column_stack([prefix, middle, suffix])
    if not np.array_equal(starts[changed][:, 2] + suffix_size, back_at[1:][changed]):
        raise ValueError("marks are not in the order of the form")
    moves = displacements(starts.ravel(), (sources - starts).ravel(), int(back_at[-1]))
    return data[np.arange(len(moves)) + moves], back_at


def _hexes(data: np.ndarray, at: np.ndarray) -> pa.Array:
    view = memoryview(np.ascontiguousarray(data))
    return pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())


def _counts(found: dict[str, np.ndarray]) -> list[pa.Array]:
    none = found["form"] == 0
    return [pa.array(found["n"], pa.int64()), pa.array([FORMS[f] for f in found["form"]], pa.string()),
            pa.array(found["prefix_chars"], pa.int64(), mask=none), pa.array(found["middle_chars"], pa.int64(), mask=none)]


def transform(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """``docs`` without ``text`` and with n (units), form, prefix_chars, middle_chars (null if plain) and fim_text."""
    kept = others(docs, COLUMNS, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text, CHUNK):
            found = scatter(*flat(batch.column(text)), batch.column(key).to_pylist(), seed)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *_counts(found), strings(found["data"], found["at"])],
                [*kept, "n", "form", "prefix_chars", "middle_chars", "fim_text"])

    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {kind}" for c, kind in docs.dtypes if c in kept), COLUMNS]))


def restore(df: DataFrame, text: str = "fim_text", form: str = "form") -> DataFrame:
    """``df`` without ``text`` and with the texts it came from, as restored. A null output or form counts as plain."""
    added = "restored string"
    kept = others(df, added, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text, CHUNK):
            forms = np.array([FORMS.index(f or FORMS[0]) for f in batch.column(form).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept),
                                              strings(*gather(*flat(batch.column(text)), forms))], [*kept, "restored"])

    return df.mapInArrow(run, ", ".join([*(f"`{c}` {kind}" for c, kind in df.dtypes if c in kept), added]))


def report(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and digests of the output and of what is restored from it."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", CHUNK):
            found = scatter(*flat(batch.column("text")), batch.column("doc_id").to_pylist(), seed)
            data, at = found["data"], found["at"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *_counts(found), _hexes(data, at), _hexes(*gather(data, at, found["form"]))],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    return docs.select("doc_id", F.col("text")).mapInArrow(run, f"doc_id {kind}, {DIGESTS}")
