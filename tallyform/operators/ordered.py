"""The row before, per key, when one key may hold any share of the table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stage

BLOCK_BITS = 20
#: Up to so many hashes of repeated keys are sent to every task (8 bytes each).
FEW_REPEATS = 1 << 17


@dataclass(frozen=True)
class Repeats:
    """64-bit hashes of the keys that several rows have. Other keys may share a hash: what is not in here is not repeated."""

    hashes: DataFrame
    count: int

    def split(self, df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame | None, DataFrame | None]:
        """Rows whose key no other row has, and those that have to meet others; None where there are none. With more than
        ``FEW_REPEATS`` hashes all rows are among the latter."""
        if not self.count:
            return df, None
        if self.count > FEW_REPEATS:
            return None, df
        hashes = F.broadcast(self.hashes)
        same = F.xxhash64(*keys) == F.col("__hash")
        return df.join(hashes, same, "left_anti"), df.join(hashes, same, "left_semi")


def repeats(df: DataFrame, keys: Sequence[str]) -> Repeats:
    """Which keys are repeated in ``df``: one aggregate over 8 bytes a row. Runs at once."""
    counted = df.select(F.xxhash64(*keys).alias("__hash")).groupBy("__hash").agg(F.count(F.lit(1)).alias("n"))
    found = stage(counted.filter("n > 1").select("__hash"), "repeats")
    return Repeats(found, found.count())


def previous_in_key(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str = "previous", bits: int = BLOCK_BITS,
    known: Repeats | None = None,
) -> DataFrame:
    """Add ``{out}`` (``value`` of the previous row of the same key by ``order``) and ``{out}_found``.

    Rows whose key is not repeated (see ``repeats``; ``known`` may be of more rows than ``df``) have none before them and stay
    where they are.
    """
    alone, many = (known or repeats(df, keys)).split(df, keys)
    found = None if many is None else _previous_in_block(many, keys, order, value, out, bits)
    if alone is None:
        return found
    kind = df.select(value.alias("v")).schema["v"].dataType
    first = alone.select(*[f"`{c}`" for c in df.columns], F.lit(None).cast(kind).alias(out), F.lit(False).alias(f"{out}_found"))
    return first if found is None else first.unionByName(found)


def _previous_in_block(df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, bits: int) -> DataFrame:
    """``previous_in_key`` of rows that may all be of one key.

    ``order`` is a unique integer position. A window over the key alone would put all rows of a hot key into
    one task, so rows are grouped by key and block of ``2**bits`` positions: no group holds more rows than a
    block has positions. What crosses a block border is the last value of each (key, block), one row each.
    """
    blocked = df.withColumns({"__block": F.shiftright(F.col(order), bits), "__value": value})
    held = F.struct(F.col("__value").alias("v"))
    inside = Window.partitionBy(*keys, "__block").orderBy(order)
    marked = blocked.withColumn("__lag", F.lag(held).over(inside))
    # what crosses a border comes from a partial aggregate, not from the sorted rows again
    heads = blocked.groupBy(*keys, "__block").agg(F.max_by(held, order).alias("__last"))
    across = Window.partitionBy(*keys).orderBy("__block")
    carried = heads.withColumn("__carry", F.lag("__last").over(across)).filter(F.col("__carry").isNotNull())
    joined = marked.join(carried.select(*keys, "__block", "__carry"), [*keys, "__block"], "left")
    before = F.coalesce(F.col("__lag"), F.col("__carry"))
    return joined.select(
        *[f"`{c}`" for c in df.columns], before["v"].alias(out), before.isNotNull().alias(f"{out}_found")
    )
