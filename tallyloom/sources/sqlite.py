"""Tables of many landed SQLite snapshots as one DataFrame.

Spark lists the files and reads them as bytes, so they may lie in any file system
Spark can read, many small databases share a task, and no path passes the driver.
A database is opened in memory and checked first: a damaged one gives no rows at
all and is reported as unreadable, so a table holds all of a database or nothing.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

BATCH_ROWS = 8192
#: A database is one value of the binary file source; this is the limit of that source.
MAX_BYTES = (1 << 31) - 1
COLUMNS_SCHEMA = "path string, table_name string, column_name string, readable boolean"


def open_snapshot(content: bytes) -> sqlite3.Connection | None:
    """A checked in-memory copy, or None for what is not a sound database."""
    con = sqlite3.connect(":memory:")
    con.text_factory = lambda raw: raw.decode("utf-8", "replace")
    if content[18:20] == b"\x02\x02":
        # A snapshot has no log beside it: read it as a database without one.
        content = content[:18] + b"\x01\x01" + content[20:]
    try:
        con.deserialize(content)
        sound = con.execute("PRAGMA quick_check(1)").fetchone() == ("ok",)
    except sqlite3.Error:
        sound = False
    if sound and content:
        return con
    con.close()
    return None


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _snapshots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, sqlite3.Connection | None]]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            # Files beyond the limit come without content.
            con = open_snapshot(content.as_py()) if content.is_valid else None
            yield path.as_py(), con
            if con is not None:
                con.close()


def _table_rows(table: str, where: str | None, schema: pa.Schema):
    wanted = [f.name for f in schema if f.name not in ("path", "columns", "row_n")]

    def batch_of(path: str, have: list[str], rows: list[tuple], at: int) -> pa.RecordBatch:
        columns = []
        for field in schema:
            if field.name == "path":
                values = [path] * len(rows)
            elif field.name == "columns":
                values = [have] * len(rows)
            elif field.name == "row_n":
                values = list(range(at, at + len(rows)))
            else:
                index = wanted.index(field.name)
                values = [_coerce(r[index], field.type) for r in rows]
            columns.append(pa.array(values, type=field.type))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, con in _snapshots(batches):
            if con is None:
                continue  # table_columns reports it
            have = [r[1] for r in con.execute(f"PRAGMA table_info({_quoted(table)})")]
            if not have:
                continue
            picks = ", ".join(_quoted(c) if c in have else "NULL" for c in wanted)
            clause = f" WHERE {where}" if where else ""
            try:
                cursor = con.execute(f"SELECT {picks} FROM {_quoted(table)}{clause}")
            except sqlite3.OperationalError:
                continue  # an older schema without the column that is filtered by
            at = 0
            # An error from here on is not an unreadable snapshot; it fails the job.
            while rows := cursor.fetchmany(BATCH_ROWS):
                yield batch_of(path, have, rows, at)
                at += len(rows)

    return read


def _coerce(value, kind: pa.DataType):
    if value is None:
        return None
    if pa.types.is_string(kind):
        return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
    if pa.types.is_binary(kind):
        return value.encode() if isinstance(value, str) else bytes(value) if isinstance(value, bytes) else str(value).encode()
    try:
        return int(value) if pa.types.is_integer(kind) else float(value)
    except (TypeError, ValueError, OverflowError):
        return None


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for path, con in _snapshots(batches):
        rows = [(path, None, None, con is not None)]
        if con is not None:
            names = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view')")]
            rows += [(path, name, info[1], True) for name in names
                     for info in con.execute(f"PRAGMA table_info({_quoted(name)})")]
        paths, tables, columns, readable = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(tables, pa.string()), pa.array(columns, pa.string()),
             pa.array(readable, pa.bool_())], ["path", "table_name", "column_name", "readable"])


def _contents(spark: SparkSession, roots: Sequence[str], max_bytes: int) -> DataFrame:
    if not roots:
        return spark.createDataFrame([], "path string, content binary")
    files = spark.read.format("binaryFile").load(list(roots))
    fits = files.where(F.col("length") <= max_bytes).select("path", "content")
    large = files.where(F.col("length") > max_bytes).select("path", F.lit(None).cast("binary").alias("content"))
    return fits.unionByName(large).withColumn("path", F.regexp_replace("path", "^file:/*", "/"))


def rows_of(contents: DataFrame, table: str, columns: str, where: str | None = None) -> DataFrame:
    """Rows of one table of every sound database: path, present ``columns``, row_n, and the asked columns.

    ``contents``: path, content. A column missing from a file's schema reads as NULL.
    """
    ddl = f"path string, columns array<string>, row_n bigint, {columns}"
    schema = to_arrow_schema(contents.sparkSession.createDataFrame([], ddl).schema)
    return contents.select("path", "content").mapInArrow(_table_rows(table, where, schema), ddl)


def columns_of(contents: DataFrame) -> DataFrame:
    """(path, table_name, column_name, readable) of every file; the names are null in one row for each file."""
    return contents.select("path", "content").mapInArrow(_columns, COLUMNS_SCHEMA)


def read_table(spark: SparkSession, roots: Sequence[str], table: str, columns: str,
               where: str | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """:func:`rows_of` the files behind ``roots`` (files or globs that match something)."""
    return rows_of(_contents(spark, roots, max_bytes), table, columns, where)


def table_columns(spark: SparkSession, roots: Sequence[str], max_bytes: int = MAX_BYTES) -> DataFrame:
    """:func:`columns_of` the files behind ``roots``."""
    return columns_of(_contents(spark, roots, max_bytes))
