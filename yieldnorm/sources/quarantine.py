"""Malformed records put aside instead of stopping the job: a reader's other mode beside FAILFAST.

A reader given a ``quarantine`` folder appends its bad records there as Parquet (file, raw, reason) and returns the good
rows; without one it is as strict as before. Nothing is lost: each record is in one of the two. Records that a reader
skips in either mode (blank lines, features that are no polygons) are in neither.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..plans.sizing import scratch_path

#: The reader's column for a record that doesn't fit the schema, and what a bad record gets.
RAW = "__raw"
BAD_SCHEMA = "file string, raw string, reason string"


def permissive(schema: StructType) -> StructType:
    """``schema`` with room for the raw record; read with ``options()``."""
    return StructType([*schema.fields, StructField(RAW, StringType(), True)])


def options() -> dict[str, str]:
    return {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": RAW}


def put_aside(marked: DataFrame, raw: Column, reason: Column, columns: Sequence[str], folder: str) -> DataFrame:
    """Good rows (``reason`` null) with ``columns``; the others go to ``folder``. What was read is written once, since both
    sides read it (for reference lists, not for the daily table), in a folder each: a filter between them could be
    moved behind later expressions that raise on bad rows."""
    rows = marked.withColumns({"__file": F.input_file_name(), "__text": raw, "__reason": reason})
    rows = rows.select(*columns, "__file", "__text", "__reason", F.col("__reason").isNotNull().alias("__bad"))
    path = scratch_path(marked.sparkSession, "checked")
    rows.write.partitionBy("__bad").parquet(path)
    written = marked.sparkSession.read.schema(rows.schema).parquet(path)
    _append(written.filter(F.col("__bad")).select(
        F.col("__file").alias("file"), F.col("__text").alias("raw"), F.col("__reason").alias("reason")), folder)
    return written.filter(~F.col("__bad")).select(*columns)


def cast_text(df: DataFrame, types: Mapping[str, str], folder: str, file: Column | None = None) -> DataFrame:
    """Text columns cast to ``types``; a row with text that is no such value goes to ``folder``, as JSON, with the names of
    the columns. Blank text is missing. Columns that aren't text are left alone; without text columns nothing is read.
    Reads ``df`` once more for the bad rows instead of writing it. ``file`` says where rows come from (default: null)."""
    text = [c for c in types if isinstance(df.schema[c].dataType, StringType)]
    if not text:
        return df

    def bad(c):
        return (F.trim(F.col(f"`{c}`")) != "") & F.col(f"`{c}`").try_cast(types[c]).isNull()

    wrong = F.lit(False)
    for c in text:
        wrong = wrong | F.coalesce(bad(c), F.lit(False))
    names = F.concat_ws(", ", *[F.when(bad(c), F.lit(f"{c} is no {types[c]}")) for c in text])
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    where = F.lit(None).cast("string") if file is None else file
    _append(df.filter(wrong).select(where.alias("file"), whole.alias("raw"), names.alias("reason")), folder)
    return df.filter(~wrong).withColumns({c: F.col(f"`{c}`").try_cast(types[c]) for c in text})


def _append(bad: DataFrame, folder: str) -> None:
    bad.write.mode("append").parquet(folder)
