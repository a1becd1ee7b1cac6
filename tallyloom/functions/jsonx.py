"""JSON of unknown shape, carried as VARIANT from one typed ``from_json`` pass."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyloom.functions.text import trim_unicode

BAD = "_bad"
BLOCKS = "array<struct<type:string,text:string,id:string>>"


def parse_record(line: Column, schema: str) -> Column:
    """Typed record; ``_bad`` is set for broken JSON and for wrong-typed fields."""
    return F.from_json(line, f"{schema}, {BAD} string", {"columnNameOfCorruptRecord": BAD})


def is_malformed(line: Column, record: Column) -> Column:
    """Not a JSON object of the expected types (a bare ``null`` is harmless)."""
    return (record[BAD].isNotNull() | record.isNull()) & (F.trim(line) != "null")


def kind(v: Column) -> Column:
    """``string``, ``array``, ``object``, ``null`` or ``other``; NULL when absent."""
    text = F.schema_of_variant(v)
    return (F.when(v.isNull(), F.lit(None).cast("string"))
             .when(text == "STRING", "string").when(text.startswith("ARRAY"), "array")
             .when(text.startswith("OBJECT"), "object").when(text == "VOID", "null")
             .otherwise("other"))


def as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def as_blocks(v: Column) -> Column:
    """Array of typed parts; NULL when the value is not an array of objects."""
    return F.try_variant_get(v, "$", BLOCKS)


def present(v: Column, *also_empty: str) -> Column:
    """Carries a value: absent, ``null`` and ``{}`` do not, nor do ``also_empty``."""
    return F.coalesce(v.isNotNull() & ~F.is_variant_null(v)
                      & ~as_json(v).isin("{}", *also_empty), F.lit(False))


def as_json(v: Column) -> Column:
    return F.to_json(v)


def joined_texts(blocks: Column, keep) -> Column:
    """Texts of the kept parts joined by newline ('' when none is kept)."""
    return F.array_join(F.transform(F.filter(blocks, keep), lambda b: F.coalesce(b["text"], F.lit(""))), "\n")


def nonblank(text: Column) -> Column:
    return F.coalesce(trim_unicode(text) != "", F.lit(False))
