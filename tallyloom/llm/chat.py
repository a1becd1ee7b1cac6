"""Chat formatting by columnar byte assembly.

Every turn becomes header, content and end mark. For a slice of turns the lengths of all segments are arrays, their
running sum gives each segment's place in the output, and index arrays scatter header and content bytes into one
preallocated Arrow buffer, from which the strings are cut without another copy. No turn is handled by itself.

Template: ``<s>[INST] text [/INST]</s>`` for users, ``[SYS]`` for system, ``[ANS]`` for assistant turns, and
``<s>[ROLE]role[TEXT] text [/ROLE]</s>`` for any other role. A control string inside a text or role gets a backslash
after its first character, one more if it has some already; reading takes one away. So no text can hold a control
string, and every text comes back as it was. The loss mask, in code points, covers assistant texts alone.

Rows are put in order (conv_id, turn, role, text) over all partitions, so the turns of a long conversation are
formatted by many tasks. The output has one row for each part of a conversation: the turns that one slice held, in the
order of ``part``; an ordinary conversation has one or two parts. Slices are bounded in bytes.

Edge cases: null text or role is empty; turns with equal numbers stand in the order of role, then of the text's hash;
a null conv_id is a conversation of its own; null turns come first; an empty table gives no rows; long texts are whole
in one slice; columns of other names are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text assembled at once, and the length from which a segment is copied as a whole.
SLICE = 4 << 20
LONG = 1 << 16

# The roles with marks of their own.
MARKS = {"system": "SYS", "user": "INST", "assistant": "ANS"}
CONTROL = r"/?s>|/?(?:SYS|INST|ANS|ROLE)\]|TEXT\]"
HEADS = [f"<s>[{m}] ".encode() for m in MARKS.values()] + [b"<s>[ROLE]"]
MIDDLES = [b""] * len(MARKS) + [b"[TEXT] "]
TAILS = [f" [/{m}]</s>".encode() for m in (*MARKS.values(), "ROLE")]

FORMATTED = "conv_id long, part long, n_turns int, formatted string, loss_start array<int>, loss_end array<int>"
REPORT = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
          "formatted_chars long")


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, rf"([<\[])(\\*)({CONTROL})", r"\1\\\2\3")


def unescape(text: str) -> str:
    return re.sub(rf"([<\[])\\(\\*)({CONTROL})", r"\1\2\3", text)


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data, starts and lengths of a string column without nulls."""
    offsets = np.frombuffer(strings.buffers()[1], dtype=np.int32)[strings.offset:strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    starts = offsets[:-1].astype(np.int64)
    return data, starts, np.diff(offsets).astype(np.int64)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns; byte ends of the turns; their code points; loss start in the turn, and loss length."""
    known = pc.index_in(roles, value_set=pa.array(list(MARKS)))
    kind = np.asarray(pc.fill_null(known, len(MARKS)))
    other = kind == len(MARKS)
    role_data, role_start, role_length = _bytes(escape(roles))
    role_chars = np.asarray(pc.utf8_length(escape(roles))).astype(np.int64)
    content = escape(texts)
    text_data, text_start, text_length = _bytes(content)
    text_chars = np.asarray(pc.utf8_length(content)).astype(np.int64)
    role_length, role_chars = np.where(other, role_length, 0), np.where(other, role_chars, 0)

    def constant(table: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(x) for x in table], dtype=np.int64)
        return np.frombuffer(b"".join(table), dtype=np.uint8), (np.cumsum(lengths) - lengths)[kind], lengths[kind]

    segments = [constant(HEADS), (role_data, role_start, role_length), constant(MIDDLES),
                (text_data, text_start, text_length), constant(TAILS)]
    lengths = np.stack([s[2] for s in segments], axis=1)
    places = (np.cumsum(lengths.ravel()) - lengths.ravel()).reshape(lengths.shape)
    total = int(lengths.sum())
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, dtype=np.uint8)
    for k, (data, starts, sizes) in enumerate(segments):
        long = sizes >= LONG
        short = ~long
        out[_ragged(places[short, k], sizes[short])] = data[_ragged(starts[short], sizes[short])]
        for to, at, n in zip(places[long, k].tolist(), starts[long].tolist(), sizes[long].tolist(), strict=True):
            out[to:to + n] = data[at:at + n]
    before = lengths[:, 0] + role_chars + lengths[:, 2]
    return (buffer, np.cumsum(lengths.sum(axis=1)), before + text_chars + lengths[:, 4], before,
            np.where(kind == list(MARKS).index("assistant"), text_chars, 0))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    if n < 2 or batch.nbytes <= SLICE:
        yield batch
    else:
        yield from _slices(batch.slice(0, n // 2))
        yield from _slices(batch.slice(n // 2))


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId() << 40
    for whole in batches:
        for batch in _slices(whole):
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column("conv_id")
            roles, texts = (pc.fill_null(batch.column(c).cast(pa.string()), "") for c in ("role", "text"))
            buffer, ends, chars, before, loss = assemble(roles, texts)
            ids = np.asarray(pc.fill_null(conv, 0))
            none = np.asarray(conv.is_null())
            first = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (none[1:] != none[:-1])))
            last = np.append(first[1:], n) - 1
            offsets = np.append(0, ends[last]).astype(np.int32)
            strings = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), buffer)
            # Places in code points, from the start of the part.
            to = np.cumsum(chars)
            start = to - chars - np.repeat((to - chars)[first], last - first + 1) + before
            has = np.asarray(pc.equal(roles, "assistant"))
            spans = np.append(0, np.cumsum(has)[last]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(spans), pa.array(x[has].astype(np.int32)))
                     for x in (start, start + loss)]
            yield pa.RecordBatch.from_arrays(
                [conv.take(pa.array(first)), pa.array(part + np.arange(len(first))),
                 pa.array((last - first + 1).astype(np.int32)), strings, *lists],
                ["conv_id", "part", "n_turns", "formatted", "loss_start", "loss_end"])
            part += len(first)


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, formatted, loss_start, loss_end of all turns (conv_id, turn, role, text)."""
    rows = conversations.select("conv_id", "turn", "role", "text", F.xxhash64("text").alias("_hash"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "_hash")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ordered.select("conv_id", "role", "text").mapInArrow(_format, FORMATTED)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of every turn of a formatted string."""
    roles = {mark: role for role, mark in MARKS.items()}
    turn = re.compile(r"<s>\[(?:(SYS|INST|ANS)\]|ROLE\](.*?)\[TEXT\]) (.*?) \[/(?:SYS|INST|ANS|ROLE)\]</s>", re.DOTALL)
    at = 0
    for found in turn.finditer(formatted):
        if found.start() != at:
            break
        at = found.end()
        yield roles[found[1]] if found[1] else unescape(found[2]), unescape(found[3])
    if at != len(formatted):
        raise ValueError("not a formatted conversation")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its parts in order; holds one part and two digests at a time."""
    names, current, begun = [x.split()[0] for x in REPORT.split(", ")], None, False
    turns, loss, counts = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def row() -> tuple:
        return current, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        done = []
        columns = [batch.column(c) for c in ("conv_id", "formatted", "loss_start", "loss_end")]
        for i in range(batch.num_rows):
            conv, formatted, starts, ends = (c[i].as_py() for c in columns)
            if begun and conv != current:
                done.append(row())
            if not begun or conv != current:
                turns, loss, counts, current, begun = hashlib.sha256(), hashlib.sha256(), [0, 0, 0], conv, True
            for role, text in parse(formatted):
                turns.update(f"{role}\n{text}\n".encode())
                counts[0] += 1
            for start, end in zip(starts, ends, strict=True):
                text = unescape(formatted[start:end])
                loss.update(text.encode())
                counts[1] += len(text)
            counts[2] += len(formatted)
        yield batch_of(done)
    if begun:
        yield batch_of([row()])


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of every conversation, from its formatted parts alone.

    A SHA-256 is computed in order, so the parts of one conversation pass one task, as a sorted stream of which it
    holds one part at a time.
    """
    order = [F.col("conv_id").asc_nulls_first(), "part"]
    rows = formatted.select("conv_id", "part", "formatted", "loss_start", "loss_end") \
        .repartition("conv_id").sortWithinPartitions(*order)
    return rows.drop("part").mapInArrow(_read_back, REPORT)


def report(conversations: DataFrame) -> DataFrame:
    """The formatted output of all conversations and of conversation -1, read back."""
    control = "</s>[INST] ok [/INST]"
    rows = conversations.select(*(F.col(c).cast(k) for c, k in (
        ("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))))
    extra = rows.sparkSession.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)],
                                              "conv_id long, turn long, role string, text string")
    return read_back(format_turns(rows.union(extra)))
