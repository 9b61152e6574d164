"""Code lists too large for a plan's parameters: a table of codes, joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import strip
from .conform import column_ref


def _normal(column: Column, case_sensitive: bool) -> Column:
    text = strip(column.cast("string"))
    return text if case_sensitive else F.lower(text)


def code_table(codes: DataFrame, code: str, value: str, case_sensitive: bool = False) -> DataFrame:
    """code, value, variants: one row per code as it is compared (trimmed, in lower case unless ``case_sensitive``).

    A code with several values has the least of them here and ``variants`` above 1. Blank codes and null values are left out.
    """
    rows = codes.select(_normal(column_ref(code), case_sensitive).alias("code"), column_ref(value).cast("string").alias("value"))
    rows = rows.filter((F.col("code") != "") & F.col("value").isNotNull())
    # the values of a code are merged twice, so that a code repeated in many rows is one row per task when they meet
    return rows.distinct().groupBy("code").agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("variants"))


def repeated_codes(codes: DataFrame, code: str, value: str, case_sensitive: bool = False) -> DataFrame:
    """Codes that stand for more than one value."""
    return code_table(codes, code, value, case_sensitive).filter("variants > 1").select("code", "variants")


def lookup_codes(
    df: DataFrame, column: str, codes: DataFrame, code: str, value: str, fallback: str | None = None, required: bool = False,
    case_sensitive: bool = False, out: str = "value", error: str = "error",
) -> DataFrame:
    """The columns of ``df``, ``out`` and ``error``: ENUM_LOOKUP with its mapping in a table.

    Unknown codes and codes that stand for several values are refused, or take ``fallback``. The table has one row per code
    when it is joined, and Spark broadcasts it if it is small; otherwise a frequent code is split by its skew join.
    """
    table = code_table(codes, code, value, case_sensitive).select(
        F.col("code").alias("__code"), F.col("value").alias("__found"), (F.col("variants") > 1).alias("__several")
    )
    key = _normal(column_ref(column), case_sensitive)
    # blank and null values have no code: without a key they take no part in the join
    rows = df.withColumn("__key", F.when(key != "", key)).join(table, F.col("__key") == F.col("__code"), "left")
    blank, several = F.col("__key").isNull(), F.coalesce(F.col("__several"), F.lit(False))
    good = ~several & F.col("__found").isNotNull()
    shown = column_ref(column).cast("string")
    if fallback is not None:
        problem = F.lit(None).cast("string")
    else:
        problem = (
            F.when(blank, F.lit(fixed.MSG_ENUM_MISSING if required else None).cast("string"))
            .when(several, F.concat(F.lit("the code '"), shown, F.lit("' stands for more than one value")))
            .when(~good, F.concat(F.lit("there is no code '"), shown, F.lit("'")))
        )
    return rows.select(
        *[column_ref(c) for c in df.columns], F.coalesce(F.when(good, F.col("__found")), F.lit(fallback).cast("string")).alias(out), problem.alias(error)
    )
