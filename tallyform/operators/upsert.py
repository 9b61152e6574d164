"""Upsert of a batch into a target by business key, with the outcome of every row.

The batch may hold a key many times (the last row wins) and one key may hold any share of it. Rows of a key
are therefore merged by partial aggregates before they meet, and the row-by-row outcome is worked out in
bounded blocks (see ``ordered``). Rows whose key the batch has once need neither and are not moved. Keys are compared as trimmed text and null equals null, so a row without a key
has outcomes like any other; ``pipeline.execute`` sends such rows to the ledger before they get here.
"""

from __future__ import annotations

import copy
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.rules import uuid5_column
from ..functions.text import strip
from ..plans.spec import TargetSpec, spark_type
from .conform import ROW_INDEX
from .ordered import Repeats, previous_in_key, repeats

RUN_COLUMN, TIME_COLUMN = "migration_run_id", "migrated_at"
LINEAGE = (RUN_COLUMN, TIME_COLUMN)


class ConstraintError(ValueError):
    """A batch that must not be written."""


def key_columns(keys: Sequence[str]) -> dict[str, Column]:
    """Join keys: the trimmed text of each key, and whether it is null (a join drops null keys otherwise)."""
    text = {f"__k{i}": strip(F.col(k).cast("string")) for i, k in enumerate(keys)}
    found = {name: F.coalesce(value, F.lit("")) for name, value in text.items()}
    found.update({f"__n{i}": value.isNull() for i, value in enumerate(text.values())})
    return found


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """Number of the bucket of a key, from the trimmed text of its parts."""
    texts = [F.coalesce(strip(F.col(k).cast("string")), F.lit("")) for k in keys]
    digest = F.md5(F.concat_ws("\x1f", *texts))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def _comparable(name: str, dtype: T.DataType, have: T.DataType) -> Column:
    """A missing amount counts as zero when rows are compared; other values are compared as ``dtype``."""
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)).alias(name)
    return F.col(name) if have == dtype else F.col(name).cast(dtype).alias(name)


class Upsert:
    def __init__(
        self,
        target: DataFrame,
        batch: DataFrame,
        keys: Sequence[str],
        run_id: str,
        migrated_at: str,
        surrogate: str | None = None,
        detect_changes: bool = True,
        index: str = ROW_INDEX,
        block_bits: int = 20,
    ):
        """``detect_changes`` leaves unchanged rows alone and counts them as skipped; without it every row of a
        known key is an update. ``run_id`` and ``migrated_at`` are stamped on written rows."""
        self.target, self.batch = target, batch
        self.keys, self.surrogate, self.index = list(keys), surrogate, index
        self.run_id, self.migrated_at = run_id, migrated_at
        self.detect_changes, self.block_bits = detect_changes, block_bits
        self.columns = [c for c in batch.columns if c != index]
        fixed_columns = {*self.keys, surrogate, *LINEAGE}
        self.data_columns = [c for c in self.columns if c not in fixed_columns]
        self._k = list(key_columns(self.keys))
        self._repeats: Repeats | None = None

    def against(self, target: DataFrame) -> Upsert:
        """The same batch into another target, or another part of it."""
        other = copy.copy(self)
        other.target = target
        return other

    def _rows(self) -> DataFrame:
        """Batch rows under their trimmed key."""
        return self.batch.withColumns(key_columns(self.keys))

    def _repeated(self) -> Repeats:
        """Keys that the batch has more than once; looked for once."""
        if self._repeats is None:
            self._repeats = repeats(self._rows(), self._k)
        return self._repeats

    def _compared(self, df: DataFrame) -> Column:
        """The values a change is judged by, as the target's types.

        Columns the target does not have yet count as null there. Text that is no value of the target's type
        fails the job; ``guard_types`` refuses such a batch beforehand.
        """
        types = dict(self._all_columns())
        have = {f.name: f.dataType for f in df.schema.fields}
        parts = [
            _comparable(c, types[c], have[c]) if c in have else F.lit(None).cast(types[c]).alias(c)
            for c in self.data_columns
        ]
        return F.struct(*parts) if parts else F.struct(F.lit(1).alias("same"))

    def _known(self) -> DataFrame:
        """Target rows under their trimmed key."""
        return self.target.withColumns(key_columns(self.keys))

    # -- row outcomes -----------------------------------------------------------------------------

    def actions(self) -> DataFrame:
        """One row per batch row: key columns, position and ``insert``, ``update`` or ``skip``."""
        rows = self._rows().select(
            F.col(self.index), *self.keys, *self._k, self._compared(self.batch).alias("__now")
        )
        seen = previous_in_key(rows, self._k, self.index, F.col("__now"), "__before", self.block_bits, self._repeated())
        # a target from elsewhere may hold a key twice; one of its rows is enough to tell an outcome
        known = self._known().select(*self._k, self._compared(self.target).alias("__old"))
        known = known.groupBy(*self._k).agg(F.min("__old").alias("__old"), F.lit(True).alias("__in"))
        # only the first row of a key looks into the target: at most one per key, so no key is hot here
        first = seen.filter(~F.col("__before_found")).join(known, self._k, "left")
        later = seen.filter(F.col("__before_found"))
        if not self.data_columns:
            change, again = F.lit("skip"), F.lit("skip")
        elif self.detect_changes:
            change = F.when(F.col("__now").eqNullSafe(F.col("__old")), "skip").otherwise("update")
            again = F.when(F.col("__now").eqNullSafe(F.col("__before")), "skip").otherwise("update")
        else:
            change, again = F.lit("update"), F.lit("update")
        out = [F.col(self.index), *[F.col(k) for k in self.keys]]
        return first.select(
            *out, F.when(F.col("__in"), change).otherwise("insert").alias("action")
        ).unionByName(later.select(*out, again.alias("action")))

    def counts(self) -> DataFrame:
        """inserted, updated and skipped: every batch row is exactly one of them."""
        a = F.col("action")
        return self.actions().agg(
            F.count_if(a == "insert").alias("inserted_count"),
            F.count_if(a == "update").alias("updated_count"),
            F.count_if(a == "skip").alias("skipped_count"),
        )

    # -- merged table -----------------------------------------------------------------------------

    def winners(self) -> DataFrame:
        """One row per key: the last row's data, the first row's surrogate key, and whether rows differed."""
        alone, many = self._repeated().split(self._rows(), self._k)
        single = None if alone is None else alone.select(
            *self._k, F.col(self.index).alias("__first"), F.lit(False).alias("__mixed"), *self.columns
        )
        if many is None:
            return single
        merged = self._merged_keys(many)
        return merged if single is None else single.unionByName(merged)

    def _merged_keys(self, rows: DataFrame) -> DataFrame:
        """``winners`` of rows that may all be of one key."""
        hashed = F.xxhash64(self._compared(rows))
        aggs = [
            F.max_by(F.struct(*self.columns), F.col(self.index)).alias("__row"),
            F.min(hashed).alias("__hmin"),
            F.max(hashed).alias("__hmax"),
            F.min(self.index).alias("__first"),
        ]
        if self.surrogate:
            aggs.append(F.min_by(self.surrogate, self.index).alias("__pk"))
        merged = rows.groupBy(*self._k).agg(*aggs)
        values = {c: F.col("__row")[c] for c in self.columns}
        if self.surrogate:
            values[self.surrogate] = F.col("__pk")
        return merged.select(
            *self._k, "__first", (F.col("__hmin") != F.col("__hmax")).alias("__mixed"),
            *[v.alias(c) for c, v in values.items()],
        )

    def _all_columns(self) -> list[tuple[str, T.DataType]]:
        """Target columns, then columns the batch adds, then lineage."""
        types = {f.name: f.dataType for f in self.target.schema.fields if f.name not in LINEAGE}
        for f in self.batch.schema.fields:
            if f.name != self.index and f.name not in LINEAGE:
                types.setdefault(f.name, f.dataType)
        return list(types.items())

    def merged(self, winners: DataFrame | None = None) -> DataFrame:
        """The target after the batch.

        Target rows look their key up in the batch, and the keys found tell which batch rows are new. Pass the
        staged ``winners``: Spark knows their size then, and leaves the target where it is when they are small.
        """
        t = self._known().select(
            *self._k,
            F.struct(*[F.col(c) for c in self.target.columns]).alias("t"),
            self._compared(self.target).alias("t_cmp"),
        )
        w = self.winners() if winners is None else winners
        w = w.select(
            *self._k, F.struct(*self.columns).alias("w"), "__mixed", self._compared(w).alias("w_cmp")
        )
        found = self._known().select(*self._k).join(w.select(*self._k), self._k, "left_semi")
        new = w.join(found, self._k, "left_anti")
        both = t.join(w, self._k, "left").unionByName(new, allowMissingColumns=True)
        have_t, have_w = F.col("t").isNotNull(), F.col("w").isNotNull()
        if not self.data_columns:
            written = have_w & ~have_t
        elif self.detect_changes:
            changed = F.col("__mixed") | ~F.col("t_cmp").eqNullSafe(F.col("w_cmp"))
            written = have_w & (~have_t | changed)
        else:
            written = have_w
        out = []
        batch_has, target_has = set(self.columns), set(self.target.columns)
        for name, dtype in self._all_columns():
            old = F.col("t")[name].cast(dtype) if name in target_has else F.lit(None).cast(dtype)
            new = F.col("w")[name].cast(dtype) if name in batch_has else old
            if name in self.keys:
                # the stored key is the trimmed text, as it was compared
                i = self.keys.index(name)
                new = F.when(~F.col(f"__n{i}"), F.col(f"__k{i}")).cast(dtype)
            if name in self.keys or name == self.surrogate:
                out.append(F.when(have_t, old).otherwise(new).alias(name))
            else:
                out.append(F.when(written, new).otherwise(old).alias(name))
        for name, stamp in ((RUN_COLUMN, self.run_id), (TIME_COLUMN, self.migrated_at)):
            old = F.col("t")[name] if name in target_has else F.lit(None).cast("string")
            out.append(F.when(written, F.lit(stamp)).otherwise(old).alias(name))
        return both.select(*out)


def empty_target(spark, spec: TargetSpec) -> DataFrame:
    fields = [T.StructField(f.name, spark_type(f.data_type)) for f in spec.fields]
    fields += [T.StructField(c, T.StringType()) for c in LINEAGE]
    return no_rows(spark, T.StructType(fields))


def no_rows(spark, schema: T.StructType) -> DataFrame:
    """An empty table that Spark knows to be empty: what is joined with it is not moved."""
    return spark.createDataFrame([], schema).limit(0)


# -- write-time guards --------------------------------------------------------------------------------


def violations(df: DataFrame, spec: TargetSpec) -> DataFrame:
    """(column_name, constraint, violations) for NOT NULL, enum and UNIQUE, zero counts left out."""
    rows = []
    for f in spec.fields:
        if f.name not in df.columns:
            continue
        if not f.nullable:
            rows.append((f.name, "NOT NULL", F.col(f.name).isNull()))
        if f.allowed:
            outside = F.col(f.name).isNotNull() & ~F.col(f.name).cast("string").isin([str(a) for a in f.allowed])
            rows.append((f.name, "ENUM", outside))
    found = None
    if rows:
        one = df.agg(*[F.count_if(cond).alias(f"c{i}") for i, (_, _, cond) in enumerate(rows)])
        found = one.select(
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(n).alias("column_name"), F.lit(c).alias("constraint"), F.col(f"c{i}").alias("violations"))
                        for i, (n, c, _) in enumerate(rows)
                    ]
                )
            ).alias("r")
        ).select("r.*")
    # a primary key of several columns is unique as a whole
    unique = [(f.name,) for f in spec.fields if f.unique or spec.primary_key == (f.name,)]
    if len(spec.primary_key) > 1:
        unique.append(tuple(spec.primary_key))
    for names in unique:
        if not set(names) <= set(df.columns):
            continue
        filled = reduce(and_, [F.col(n).isNotNull() for n in names])
        dup = duplicate_keys(df.filter(filled), names).agg(
            F.lit(", ".join(names)).alias("column_name"), F.lit("UNIQUE").alias("constraint"),
            F.count(F.lit(1)).alias("violations"),
        )
        found = dup if found is None else found.unionByName(dup)
    if found is None:
        return df.sparkSession.createDataFrame([], "column_name string, constraint string, violations bigint")
    return found.filter(F.col("violations") > 0)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") > 1)


def _per_column(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """column_name, violations: rows of ``df`` that meet each column's test, in one pass."""
    if not tests:
        return df.sparkSession.createDataFrame([], "column_name string, violations bigint")
    names = list(tests)
    one = df.agg(*[F.count_if(tests[c]).alias(f"c{i}") for i, c in enumerate(names)])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("violations")) for i, c in enumerate(names)]
    return one.select(F.inline(F.array(*rows)))


def _required(spec: TargetSpec) -> list[str]:
    """Columns that must be filled; only generated keys may be empty."""
    return [f.name for f in spec.fields if not f.nullable and f.name not in spec.primary_key and not f.name.endswith("_uuid")]


def missing_values(df: DataFrame, spec: TargetSpec) -> DataFrame:
    """column_name, violations: rows without a value, of each required column; all rows where the column is missing."""
    return _per_column(df, {c: F.col(c).isNull() if c in df.columns else F.lit(True) for c in _required(spec)})


def _numbers(df: DataFrame, spec: TargetSpec) -> dict[str, Column]:
    """How text columns of number types are read."""
    casts = {}
    for f in spec.fields:
        if f.name not in df.columns or not isinstance(df.schema[f.name].dataType, T.StringType):
            continue
        text = strip(F.col(f.name))
        name = f.data_type.lower().strip()
        if name in fixed.FLOAT_TYPES or name in fixed.MONEY_STORAGE_TYPES:
            casts[f.name] = F.translate(text, "$,", "").try_cast("double")
        elif name in fixed.INTEGER_TYPES:
            casts[f.name] = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))
    return casts


def unreadable_numbers(df: DataFrame, spec: TargetSpec) -> DataFrame:
    """column_name, violations: rows whose text is no number, of each text column that should hold numbers."""
    return _per_column(df, {c: (strip(F.col(c)) != "") & cast.isNull() for c, cast in _numbers(df, spec).items()})


def guard_not_null(df: DataFrame, spec: TargetSpec) -> None:
    """Refuse the whole batch when a required value is missing; only generated keys may be."""
    absent = [c for c in _required(spec) if c not in df.columns]
    if absent:
        raise ConstraintError(f"NOT NULL constraint failed on {spec.table_name}.{absent[0]}: column is missing")
    bad = [r for r in missing_values(df, spec).collect() if r["violations"]]
    if bad:
        raise ConstraintError(f"NOT NULL constraint failed on {spec.table_name}.{bad[0]['column_name']}: {bad[0]['violations']} rows")


def guard_types(df: DataFrame, spec: TargetSpec) -> DataFrame:
    """Numbers in text columns are parsed; a value that is not a number refuses the whole batch."""
    casts = _numbers(df, spec)
    if not casts:
        return df
    bad = [r for r in unreadable_numbers(df, spec).collect() if r["violations"]]
    if bad:
        raise ConstraintError(f"Data type constraint violation on {bad[0]['column_name']}: {bad[0]['violations']} rows are not numbers")
    return df.withColumns(casts)


def rekey_collisions(
    inserts: DataFrame, target: DataFrame, primary: str, keys: Sequence[str], order: str, block_bits: int = 20,
    known: Repeats | None = None,
) -> DataFrame:
    """Give rows a new primary key when theirs is taken, in the batch by an earlier row or in the target.

    The new key is derived from the old one and the business key, so a repeated run gives the same.
    ``rekeyed`` tells which rows changed. ``known`` are the repeated primary keys, if somebody looked already. A primary key shared by many rows is handled in blocks.
    """
    seen = previous_in_key(inserts, [primary], order, F.lit(True), "__earlier", block_bits, known)
    taken = target.select(F.col(primary)).filter(F.col(primary).isNotNull()).distinct().withColumn("__taken", F.lit(True))
    # one row per primary key looks into the target
    first = seen.filter(~F.col("__earlier_found")).join(taken, [primary], "left")
    later = seen.filter(F.col("__earlier_found")).withColumn("__taken", F.lit(True))
    rows = first.unionByName(later)
    clash = F.col(primary).isNotNull() & F.coalesce(F.col("__taken"), F.lit(False))
    derived = uuid5_column("rekey", F.concat_ws("|", F.col(primary).cast("string"), *[F.col(k).cast("string") for k in keys]))
    names = [c for c in inserts.columns if c != primary]
    return rows.select(
        F.when(clash, derived).otherwise(F.col(primary).cast("string")).alias(primary), *names, clash.alias("rekeyed")
    )


def version_diff(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys removed, added or changed between two versions of a table, lineage ignored."""
    data = [c for c in before.columns if c not in keys and c not in LINEAGE and c in after.columns]
    b = before.select(*keys, F.struct(*data).alias("b"))
    a = after.select(*keys, F.struct(*data).alias("a"))
    both = b.join(a, list(keys), "full_outer")
    change = (
        F.when(F.col("a").isNull(), "removed").when(F.col("b").isNull(), "added")
        .when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    )
    return both.select(*keys, change.alias("change")).filter(F.col("change").isNotNull())


def add_columns(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Both tables stacked over the union of their columns: a table evolves by adding columns only."""
    return target.unionByName(batch, allowMissingColumns=True)


