"""Scans: delimited text, JSON arrays and wrapped JSON, JSON lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.text import strip
from .ranges import document_records, text_records
from .row_index import with_row_index
from .scratch import scratch_path

BOM = "﻿"


class EmptySource(ValueError):
    """The source holds no records."""


def _first_line(spark: SparkSession, path: str) -> str:
    line = spark.read.text(path).filter(strip(F.col("value")) != "").limit(1).collect()
    return line[0]["value"].lstrip(BOM) if line else ""


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """Tab wins; else ``;`` or ``|`` when more frequent than the comma in the first line; else comma."""
    line = _first_line(spark, path)
    if "\t" in line:
        return "\t"
    for sep in (";", "|"):
        if line.count(sep) > line.count(","):
            return sep
    return ","


def drop_blank_rows(df: DataFrame) -> DataFrame:
    """Drop rows whose values are all null or blank."""
    kept = [F.coalesce(strip(F.col(f"`{c}`").cast("string")), F.lit("")) != "" for c in df.columns]
    return df.filter(reduce(lambda a, b: a | b, kept))


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise EmptySource("the source holds no records")
    return df


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    drop_blank: bool = True,
    index: str | None = None,
    split_lines: bool | None = None,
    rest: str | None = "extra_fields",
) -> DataFrame:
    """CSV, TSV, semicolon or pipe text with a header; every value a string, empty values kept as ``""``.

    A file is divided between tasks, which find out where quoted values hold line breaks (see ``ranges``); the file is
    read twice for that. ``split_lines=True`` declares that none does, and saves one reading. ``split_lines=False`` reads a
    file in one task; it alone takes a carriage return as the end of a record.

    A record with more fields than the header keeps its whole text in the column ``rest``, null elsewhere (a
    short record with separators inside quotes may be kept there as well). ``rest=None`` declares that there
    are none and leaves the column out.
    """
    if sep is None:
        sep = detect_delimiter(spark, path)
    asked = {"sep": sep, "quote": '"', "escape": '"'}
    reader = spark.read.options(header=True, multiLine=not split_lines, inferSchema=False, **asked)
    names = reader.csv(path).columns
    clean = [n.lstrip(BOM) for n in names]
    columns = [T.StructField(n, T.StringType()) for n in names]
    if rest is not None:
        if rest in clean:
            raise ValueError(f"the header has a column {rest!r} already: name another one for longer records")
        columns.append(T.StructField(rest, T.StringType()))
        asked["columnNameOfCorruptRecord"] = rest
    if split_lines is None:
        ddl = ", ".join(f"`{c.name.replace('`', '``')}` string" for c in columns)
        records = text_records(spark, path, sep).select(
            F.col("position").alias("__position"), F.from_csv(F.rtrim("record", F.lit("\r")), ddl, {"multiLine": "true", **asked}).alias("__record")
        )
        df = records.select("__position", "__record.*")
        if index is not None:
            df = df.withColumnRenamed("__position", index)
    else:
        df = reader.options(**asked).schema(T.StructType(columns)).csv(path)
        if index is not None:
            df = with_row_index(df, index, file_order=True)
    kept = [F.col(index)] if index is not None else []
    kept += [F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(c) for n, c in zip(names, clean)]
    if rest is not None:
        text = F.col(f"`{rest}`")
        separators = F.length(text) - F.length(F.replace(text, F.lit(sep), F.lit("")))
        kept.append(F.when(separators >= len(names), text).alias(rest))
    df = df.select(*kept)
    if drop_blank:
        kept = [strip(F.col(f"`{c}`")) != "" for c in clean]
        df = df.filter(reduce(lambda a, b: a | b, kept))
    return df


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of objects, or one object that wraps such an array, or a single object, per file.

    Only an object at the top is unwrapped: records of an array keep their lists. Elements that are not objects
    are left out. A document is divided between tasks, which find out where its records begin (see ``ranges``); they are
    staged as JSON lines. Text that ends inside of a value fails the read, as does a record that is not JSON; what stands
    between records is not looked at. An object without such a list is one record, one value of one task.
    """
    records, bare = document_records(spark, path, tuple(fixed.JSON_WRAPPERS))
    lines = records.select("text")
    if bare:
        lines = lines.unionByName(spark.read.text(bare, wholetext=True).select(F.replace("value", F.lit(BOM), F.lit("")).alias("text")))
    staged = scratch_path(spark, "records")
    # outside of strings a line break is white space, and inside them JSON has it escaped
    lines.select(F.translate("text", "\r\n", "  ").alias("value")).write.text(staged)
    return read_json_lines(spark, staged)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line; a bad line fails the read."""
    return spark.read.option("mode", "FAILFAST").json(path)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Pick the reader from the first lines, as an upload without a declared format."""
    lines = [
        r["value"].lstrip(BOM).strip()
        for r in spark.read.text(path).filter(strip(F.col("value")) != "").limit(10).collect()
    ]
    if not lines:
        raise EmptySource("the source holds no records")
    if lines[0].startswith("{") and all(x.startswith("{") and x.endswith("}") for x in lines) and len(lines) > 1:
        return require_rows(read_json_lines(spark, path))
    if lines[0][0] in "{[":
        return require_rows(read_json(spark, path))
    return require_rows(read_delimited(spark, path))


def read_ragged(frames: list[DataFrame]) -> DataFrame:
    """Stack tables with different columns; a missing column reads as null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def head_sample(df: DataFrame, n: int = 5, index: str = "source_row_index") -> DataFrame:
    """First ``n`` rows in source order (a top-k, not a sort of the table)."""
    return df.orderBy(index).limit(n)


def find_amount_column(columns: list[str]) -> str | None:
    """The source column that holds money: a well-known name, else one that mentions balance or amount."""
    for name in fixed.WELL_KNOWN_AMOUNTS:
        if name in columns:
            return name
    return next((c for c in columns if "balance" in c.lower() or "amount" in c.lower()), None)

