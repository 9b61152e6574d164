"""Row positions without sorting or shuffling the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stage

_MID = "__mid"
_ROWS_BITS = 33  # monotonically_increasing_id keeps the position inside a partition in the low 33 bits


def with_row_index(df: DataFrame, name: str = "source_row_index", file_order: bool = False) -> DataFrame:
    """Add a dense 0-based position.

    Positions follow partition order, or with ``file_order`` (file sources only) file name and offset.
    The rows are written once together with their place in the scan, so that both reads below see the same
    places even when a lost executor makes Spark run a task again. Only one small row per partition (or per
    file split) is ever brought together to turn counts into offsets; that table is bounded by the number
    of input splits, not by the data.
    """
    columns = df.columns
    place = {_MID: F.monotonically_increasing_id()}
    if file_order:
        place["__file"] = F.col("_metadata.file_path")
        place["__block"] = F.col("_metadata.file_block_start")
    else:
        place["__file"] = F.lit("")
        place["__block"] = F.shiftright(F.monotonically_increasing_id(), _ROWS_BITS)
    placed = stage(df.withColumns(place), "row-index")
    splits = placed.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("__rows"), F.min(_MID).alias("__first"))
    before = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("__offset", F.coalesce(F.sum("__rows").over(before), F.lit(0))).drop("__rows")
    joined = placed.join(offsets, ["__file", "__block"])
    position = F.col("__offset") + F.col(_MID) - F.col("__first")
    return joined.select(position.cast("bigint").alias(name), *["`" + c.replace("`", "``") + "`" for c in columns])
