"""Values that two rows of the target may not share, checked before the write.

The first row of a batch with a value claims it, unless a row of the target with another business key holds it. Rows of
other keys with that value are refused; rows of the same key may repeat it. A claim stands even if its own row is refused
for another value, so the outcome does not depend on the order in which columns are looked at, and whatever is let through
leaves every value with one key.

All columns are checked in one aggregate over (column, value): equal values of a column are merged before the shuffle, so a
value that fills a third of the batch is one row per task by then.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .conform import ROW_INDEX
from .upsert import key_columns

RULE_TAKEN = "UNIQUE"


def _key(keys: Sequence[str]) -> Column:
    """The business key as one comparable value: trimmed texts, null equal to null."""
    return F.struct(*[c.alias(n) for n, c in key_columns(keys).items()])


def taken_values(
    batch: DataFrame, keys: Sequence[str], columns: Sequence[str], holders: Callable[[str, DataFrame], DataFrame],
    index: str = ROW_INDEX,
) -> DataFrame:
    """Cells that would repeat a value of another key: ``index``, column_name, value, taken_by (``batch`` or ``target``).

    ``holders`` gives the target's rows that hold one of some values in a column; null never repeats.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    long = batch.select(F.col(index), _key(keys).alias("key"), F.inline(cells)).filter(F.col("value").isNotNull())
    claims = long.groupBy("column_name", "value").agg(
        F.min_by("key", index).alias("first_key"), F.min("key").alias("low"), F.max("key").alias("high")
    )
    held = None
    for c in columns:
        rows = holders(c, batch.select(F.col(c)).filter(F.col(c).isNotNull()))
        rows = rows.select(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"), _key(keys).alias("held_by"))
        held = rows if held is None else held.unionByName(rows)
    if held is None:
        return long.select(index, "column_name", "value", F.lit("").alias("taken_by")).limit(0)
    # a target from elsewhere may hold a value twice already
    held = held.groupBy("column_name", "value").agg(F.min("held_by").alias("held_by"))
    owners = claims.join(held, ["column_name", "value"], "left")
    owner = F.coalesce("held_by", "first_key")
    disputed = owners.filter((F.col("low") != owner) | (F.col("high") != owner)).select(
        "column_name", "value", owner.alias("owner"), F.when(F.col("held_by").isNotNull(), "target").otherwise("batch").alias("taken_by")
    )
    # disputed values are few as a rule; a hot one meets its rows in a join that Spark splits when it is skewed
    return long.join(disputed, ["column_name", "value"]).filter(F.col("key") != F.col("owner")).select(index, "column_name", "value", "taken_by")
