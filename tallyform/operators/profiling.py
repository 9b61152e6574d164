"""Schema inference, column profiles and rule trials over whole tables.

Counts, distinct values, frequencies, samples and pattern flags all come from tables of (column, value,
count): the source is read once, equal values are merged before the only big shuffle, and a value that fills
a third of the table is one row per task by then.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.text import strip
from .conform import ROW_INDEX, apply_rule, column_ref


def _blank(value):
    return value.isNull() | (strip(value) == "")


#: Types whose values have a text that is never blank.
_NEVER_BLANK = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _filled(name: str, of: T.DataType):
    """The text of a column, null where it is blank."""
    text = F.col(name).cast("string")
    return text if isinstance(of, _NEVER_BLANK) else F.when(~_blank(text), text)


def value_counts(df: DataFrame, columns: Sequence[str] | None = None, index: str | None = None) -> DataFrame:
    """(column_name, position, value, count): every distinct value of every column, nulls included.

    With ``index`` also ``first_seen``, the position of the value's first row.
    """
    names = list(columns) if columns is not None else [c for c in df.columns if c != index]
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("column_name"), F.lit(i).alias("position"), column_ref(n).cast("string").alias("value"))
            for i, n in enumerate(names)
        ]
    )
    seen = [F.col(index).alias("seen")] if index else []
    long = df.select(*seen, F.explode(cells).alias("c")).select(*["seen"] * bool(index), "c.*")
    aggs = [F.count(F.lit(1)).alias("count")]
    if index:
        aggs.append(F.min("seen").alias("first_seen"))
    return long.groupBy("column_name", "position", "value").agg(*aggs)


#: Bytes of a SHA-256.
DIGEST_BYTES = 32


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, index: str | None = None) -> DataFrame:
    """Counts, null share, exact distinct count and pattern flags per column; a table without rows has zeros.

    A value of ``DIGEST_BYTES`` bytes or more travels as its SHA-256, which is that long, with what it contributes; a shorter
    one travels as it is, and what it contributes is read off once for all rows that have it.
    """
    names = list(columns) if columns is not None else [c for c in df.columns if c != index]
    v = F.col("value")
    marks = {
        "filled": ~_blank(v),
        "comma": v.contains(","),
        "date": v.contains("/") | v.contains("-"),
        "money": v.startswith("$") | v.contains("("),
        "digits": v.rlike(r"[0-9]{3}"),
    }
    cells = F.array(*[F.struct(F.lit(i).alias("position"), column_ref(n).cast("string").alias("value")) for i, n in enumerate(names)])
    long = df.select(F.explode(cells).alias("c")).select("c.*")
    long_value = F.octet_length(v) >= DIGEST_BYTES
    key = F.when(long_value, F.unhex(F.sha2(v, 256))).otherwise(v.cast("binary")).alias("key")
    read = F.when(long_value, F.struct(*[F.coalesce(m, F.lit(False)).alias(k) for k, m in marks.items()])).alias("read")
    distinct = long.select("position", key, read).groupBy("position", "key", "read").agg(F.count(F.lit(1)).alias("count"))
    distinct = distinct.withColumn("value", F.when(F.col("read").isNull(), F.col("key").cast("string")))
    distinct = distinct.select("position", "count", *[F.when(F.col("read").isNull(), m).otherwise(F.col("read")[k]).alias(k) for k, m in marks.items()])
    n, filled = F.col("count"), F.col("filled")
    per = distinct.groupBy("position").agg(
        F.sum(n).alias("total_records"),
        F.sum(F.when(filled, n)).alias("non_null_count"),
        F.sum(F.when(~filled, n)).alias("null_count"),
        F.count_if(filled).alias("distinct_count"),
        *[F.bool_or(filled & F.col(k)).alias(k) for k in fixed.PATTERN_FLAGS],
    )
    # a column that no row has come from still has its line
    every = df.sparkSession.createDataFrame(list(enumerate(names)), "position int, column_name string")
    counts = {c: F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("total_records", "non_null_count", "null_count", "distinct_count")}
    per = F.broadcast(every).join(per, "position", "left").select("position", "column_name", *counts.values(), *fixed.PATTERN_FLAGS)
    share = F.round(F.col("null_count") * 100 / F.greatest("total_records", F.lit(1)), 2).cast("double")
    flags = F.array_compact(
        F.array(*[F.when(F.col(k), F.lit(text)) for k, text in fixed.PATTERN_FLAGS.items()])
    )
    return per.select(
        "column_name", "position", "total_records", "non_null_count", "null_count", share.alias("null_percentage"),
        "distinct_count", flags.alias("patterns_detected"),
    )


#: Registers of a sketch as a power of two, and three standard errors of what it estimates after merging.
SKETCH_BITS = 12


def sketch_error(bits: int = SKETCH_BITS) -> float:
    """The share by which an estimate is off at most, but in 3 of 1,000 cases."""
    return 3 * 1.04 / 2 ** (bits / 2)


def distinct_sketches(df: DataFrame, columns: Sequence[str] | None = None, bits: int = SKETCH_BITS) -> DataFrame:
    """column_name, position, total_records, sketch: what a profile keeps of a column's non-blank values to count distinct
    ones later, together with those of other runs. At most 2 ** bits bytes leave a task for each column; no value does."""
    names = list(columns) if columns is not None else df.columns
    # sketches take their input an expression at a time, so it is made before, in compiled code
    texts = df.select(*[column_ref(n).alias(f"t{i}") for i, n in enumerate(names)])
    texts = texts.select(*[_filled(f.name, f.dataType).alias(f.name) for f in texts.schema])
    one = texts.agg(F.count(F.lit(1)).alias("n"), *[F.hll_sketch_agg(F.col(f"t{i}"), bits).alias(f"s{i}") for i in range(len(names))])
    rows = [
        F.struct(F.lit(n).alias("column_name"), F.lit(i).alias("position"), F.col("n").alias("total_records"), F.col(f"s{i}").alias("sketch"))
        for i, n in enumerate(names)
    ]
    return one.select(F.inline(F.array(*rows)))


def merge_sketches(kept: DataFrame) -> DataFrame:
    """The sketches of several runs or parts as those of all their rows."""
    return kept.groupBy("column_name", "position").agg(F.sum("total_records").alias("total_records"), F.hll_union_agg("sketch").alias("sketch"))


def estimated_distinct(kept: DataFrame) -> DataFrame:
    """column_name, position, total_records, distinct_estimate."""
    return kept.select("column_name", "position", "total_records", F.hll_sketch_estimate("sketch").alias("distinct_estimate"))


def top_values(
    df: DataFrame, k: int = 10, columns: Sequence[str] | None = None, index: str | None = None
) -> DataFrame:
    """The ``k`` most frequent values per column; ties by first appearance when ``index`` is given, else by value.

    The rank limit is applied inside each partition before the rows of a column meet.
    """
    counted = value_counts(df, columns, index).filter(~_blank(F.col("value")))
    tie = F.col("first_seen") if index else F.col("value")
    order = Window.partitionBy("column_name").orderBy(F.desc("count"), tie)
    ranked = counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("column_name", "rank", "value", "count")


def sample_values(df: DataFrame, k: int = 8, columns: Sequence[str] | None = None) -> DataFrame:
    """The ``k`` smallest distinct values per column."""
    counted = value_counts(df, columns).filter(~_blank(F.col("value")))
    order = Window.partitionBy("column_name").orderBy("value")
    ranked = counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("column_name", "rank", "value")


def infer_schema(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """int, float or string per column, judged on every non-blank value; nullable when any value is blank.

    One pass, partial aggregates only: no value leaves its task.
    """
    names = list(columns) if columns is not None else df.columns
    text = {n: column_ref(n).cast("string") for n in names}
    aggs = []
    for i, n in enumerate(names):
        filled = ~_blank(text[n])
        aggs += [
            F.bool_and(F.when(filled, text[n].rlike("^-?[0-9]+$"))).alias(f"i{i}"),
            F.bool_and(F.when(filled, text[n].rlike(r"^-?[0-9]+(\.[0-9]+)?$"))).alias(f"f{i}"),
            F.bool_or(~filled).alias(f"n{i}"),
        ]
    one = df.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(n).alias("name"),
                F.when(F.col(f"i{i}"), "int").when(F.col(f"f{i}"), "float").otherwise("string").alias("data_type"),
                F.coalesce(F.col(f"n{i}"), F.lit(False)).alias("nullable"),
            )
            for i, n in enumerate(names)
        ]
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def rule_trial(
    df: DataFrame, column: str, rule: str, params: dict[str, Any] | None = None, sample_limit: int | None = None,
    index: str = ROW_INDEX,
) -> DataFrame:
    """Success and error counts of one rule on a column of the whole table, or of its first rows."""
    rows = df if sample_limit is None else df.orderBy(index).limit(sample_limit)
    tried = apply_rule(rows, rule, column, params)
    tested, good = F.count(F.lit(1)), F.count_if(F.col("error").isNull())
    return tried.agg(
        F.lit(column).alias("column_name"),
        F.lit(rule).alias("rule_id"),
        tested.alias("tested_sample_size"),
        good.alias("success_count"),
        F.count_if(F.col("error").isNotNull()).alias("error_count"),
        F.when(tested > 0, F.round(good * 100 / F.greatest(tested, F.lit(1)), 2)).otherwise(0.0).cast("double")
        .alias("success_rate_percent"),
    )


def rule_errors(
    df: DataFrame, column: str, rule: str, params: dict[str, Any] | None = None, k: int = 5, index: str = ROW_INDEX
) -> DataFrame:
    """The first ``k`` rows a rule refuses."""
    bad = apply_rule(df, rule, column, params).filter(F.col("error").isNotNull())
    return bad.orderBy(index).limit(k).select(
        F.col(index).alias("row_index"), column_ref(column).alias("raw_value"), F.col("error").alias("error_message")
    )
