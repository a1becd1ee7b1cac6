"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import configure, ensure_checkpoint_dir

#: Columns of the ``documents`` table.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: White space between words: space and the controls 9 to 13.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; lambdas would compute a plain expression anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint: every executor can read it and its lineage ends here."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fits(df: DataFrame, most_rows: int) -> bool:
    """Whether ``df``, a checkpoint, has at most that many rows; they are counted where they are."""
    return df.count() <= most_rows


def others(df: DataFrame, added: str, *gone: str) -> list[str]:
    """Columns of ``df`` but those gone and those that have the name of an added one (of a schema string)."""
    names = {part.split()[0].lower() for part in added.split(", ")}
    return [c for c in df.columns if c not in gone and c.lower() not in names]


def sliced(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of whole rows with about ``size`` bytes in ``column``; a longer value is alone."""
    for batch in batches:
        yield from _halved(batch, column, size)


def _halved(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    if batch.column(column).nbytes <= size or n < 2:
        yield batch
    else:
        yield from _halved(batch.slice(0, n // 2), column, size)
        yield from _halved(batch.slice(n // 2), column, size)
