"""Apply a plan to a whole table: map, check, split into accepted rows and quarantine.

Everything here is one narrow projection over the source: no shuffle, no Python in the tasks. Work is laid
out in stages (see ``_Layout``) so that each regex and each parsed part is evaluated once per row.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.checks import coerce
from ..functions.rules import Source, Stage, compile_rule, mix
from ..functions.text import blank_column, fill, java_regex, strip, strip_column
from ..plans.spec import FieldMapping, Plan, SpecError, TargetField, TargetSpec, spark_type

ROW_INDEX = "source_row_index"

ERROR_TYPE = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("rule", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("raw_value", T.StringType()),
        T.StructField("suggestion", T.StringType()),
    ]
)
ERRORS_TYPE = T.ArrayType(ERROR_TYPE)


def column_ref(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _loose(name: str) -> str:
    return name.lower().replace("-", "_").strip()


def resolve_column(name: str, columns: Sequence[str]) -> str | None:
    """A source column by exact name, else ignoring case and taking ``-`` for ``_``."""
    if name in columns:
        return name
    wanted = _loose(name)
    return next((c for c in columns if _loose(c) == wanted), None)


def _kind(data_type: T.DataType) -> str:
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.IntegralType):
        return "long"
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "double"
    if isinstance(data_type, T.ArrayType):
        return "array"
    return "other"


def _as_text(c: Column, kind: str, data_type: T.DataType | None) -> Column:
    if isinstance(data_type, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    return c if kind == "string" else c.cast("string")


# Spark fuses a chain of projections into one generated method, and the JVM leaves methods above 8000 bytes
# of bytecode uncompiled: a wide plan fused whole runs several times slower. Text length of the expressions
# stands in for bytecode size; the budget keeps generated methods below that limit.
_METHOD_BUDGET = 2000
# More partitions than a table can have.
_KEEP_PARTITIONS = 2**31 - 1


class _Layout:
    """Stages in order, with None where the fused method is to end."""

    def __init__(self) -> None:
        self.steps: list[Stage | None] = []
        self.weight = 0

    def add(self, stages: list[Stage]) -> _Layout:
        for stage, weight in ((s, _weight(s)) for s in stages if s):
            if self.weight and self.weight + weight > _METHOD_BUDGET:
                self.steps.append(None)
                self.weight = 0
            self.steps.append(stage)
            self.weight += weight
        return self

    def add_side_by_side(self, many: list[list[Stage]]) -> _Layout:
        """Stages of independent fields: as many fields as fit one piece are added level by level together."""
        group: list[list[Stage]] = []
        size = self.weight
        for stages in many:
            weight = sum(map(_weight, stages))
            if group and size + weight > _METHOD_BUDGET:
                self.add(_merge_stages(group))
                group, size = [], self.weight
            group.append(stages)
            size += weight
        return self.add(_merge_stages(group))

    def apply(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            # the coalesce never merges partitions: it only ends the fused method, without moving rows
            df = df.coalesce(_KEEP_PARTITIONS) if step is None else df.withColumns(step)
        return df


def _weight(stage: Stage) -> int:
    return sum(len(str(c)) for c in stage.values())


def _merge_stages(many: list[list[Stage]]) -> list[Stage]:
    depth = max((len(s) for s in many), default=0)
    return [{k: c for stages in many if i < len(stages) for k, c in stages[i].items()} for i in range(depth)]


def _names_in(c: Column) -> set[str]:
    return set(re.findall(r"\w+", str(c)))


class SourceTable:
    """Source columns by loose name, each stripped once."""

    def __init__(self, df: DataFrame, prefix: str, columns: Sequence[str] | None = None):
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.columns = list(columns) if columns is not None else df.columns
        self.prefix = prefix
        self.stage: Stage = {}

    def stripped(self, name: str) -> Column:
        key = f"{self.prefix}src_{self.columns.index(name)}"
        if key not in self.stage:
            text = _kind(self.types[name]) == "string"
            self.stage[key] = strip_column(name) if text else strip(self.text(name))
        return F.col(key)

    def text(self, name: str) -> Column:
        dt = self.types[name]
        return _as_text(column_ref(name), _kind(dt), dt)

    def source(self, names: Sequence[str], rule: str) -> Source:
        label = ", ".join(names) if names else "input"
        if len(names) > 1:
            if rule != "CONCAT_WS":
                raise SpecError(f"{rule} takes one source field, got {list(names)}")
            found = [resolve_column(n, self.columns) for n in names]
            parts = tuple(F.lit(None).cast("string") if c is None else self.text(c) for c in found)
            shown = F.concat(
                F.lit("["), F.concat_ws(", ", *[F.coalesce(p, F.lit("None")) for p in parts]), F.lit("]")
            )
            return Source(label, shown, "list", shown, shown, parts)
        column = resolve_column(names[0], self.columns) if names else None
        if column is None:
            none = F.lit(None).cast("string")
            return Source(label, none, "string", none, none)
        kind = _kind(self.types[column])
        value = column_ref(column)
        if isinstance(self.types[column], T.IntegralType):
            value = value.cast("bigint")
        elif kind == "double":
            value = value.cast("double")
        return Source(label, value, kind, self.text(column), self.stripped(column))


@dataclass(frozen=True)
class _Field:
    """Names of the columns a compiled mapping leaves in the evaluated frame."""

    mapping: FieldMapping
    target: TargetField
    value: str  # final value, typed
    rule: str  # first rule or check that refused the row, null when none
    message: Column
    hint: Column
    raw: Column
    inputs: tuple[str, ...]  # columns the texts are made of


def _business_key(spec: TargetSpec, plan: Plan, table: SourceTable, index: Column) -> Column:
    names = spec.by_name()
    declared = spec.document.get("natural_key") or spec.document.get("primary_key") or spec.natural_key
    if "natural_key" in names:
        target = "natural_key"
    elif isinstance(declared, str):
        target = declared
    elif isinstance(declared, (list, tuple)) and len(declared) == 1:
        target = declared[0]
    else:
        target = "id"
    mapping = plan.mapping_for(target)
    parts: list[str | None] = []
    if mapping is not None and mapping.source_fields:
        parts = [resolve_column(s, table.columns) for s in mapping.source_fields]
    elif declared:
        wanted = [declared] if isinstance(declared, str) else declared
        parts = [resolve_column(s, table.columns) for s in wanted]
    candidates = []
    present = [table.stripped(p) for p in parts if p is not None]
    if present:
        candidates.append(F.nullif(F.concat_ws("_", *present), F.lit("")))
    for name in fixed.WELL_KNOWN_KEYS:
        column = resolve_column(name, table.columns)
        if column is not None:
            candidates.append(F.nullif(table.stripped(column), F.lit("")))
    return F.coalesce(*candidates, F.concat(F.lit("rec_"), index.cast("string")))


def _literal_error(field: str, rule: str, message: str, hint: str) -> Column:
    return F.struct(
        F.lit(field).alias("field"),
        F.lit(rule).alias("rule"),
        F.lit(fixed.SEVERITY).alias("severity"),
        F.lit(message).alias("error_message"),
        F.lit(None).cast("string").alias("raw_value"),
        F.lit(hint).alias("suggestion"),
    ).cast(ERROR_TYPE)


class Conformed:
    """A source table with every mapping evaluated. All members are lazy DataFrames."""

    def __init__(self, frame, fields, unmapped, spec, source_columns, key, index, prefix):
        self.frame: DataFrame = frame
        self._fields: list[_Field] = fields
        self._unmapped: list[str] = unmapped
        self.spec: TargetSpec = spec
        self.source_columns: list[str] = source_columns
        self._key: str = key
        self._index: str = index
        self._prefix = prefix
        #: What each mapping computes, and the columns that hold it.
        self.forms: dict[str, _Field] = {}

    # -- predicates -------------------------------------------------------------------------------

    def refused(self) -> Column:
        """True for rows with at least one error. Reads no message text."""
        if self._unmapped:
            return F.lit(True)
        cond = F.lit(False)
        for f in self._fields:
            cond = cond | F.col(f.rule).isNotNull()
        return cond

    def errors(self) -> Column:
        """Evidence array: unmapped required fields first, then mapping order."""
        empty = F.array().cast(ERRORS_TYPE)
        parts = []
        for name in self._unmapped:
            parts.append(
                F.array(
                    _literal_error(
                        name,
                        fixed.RULE_UNMAPPED,
                        fixed.MSG_UNMAPPED.replace("{field}", name),
                        fixed.HINT_UNMAPPED.replace("{field}", name),
                    )
                )
            )
        for f in self._fields:
            entry = F.struct(
                F.lit(f.mapping.target_field).alias("field"),
                F.col(f.rule).alias("rule"),
                F.lit(fixed.SEVERITY).alias("severity"),
                f.message.alias("error_message"),
                f.raw.alias("raw_value"),
                f.hint.alias("suggestion"),
            ).cast(ERROR_TYPE)
            parts.append(F.when(F.col(f.rule).isNotNull(), F.array(entry)).otherwise(empty))
        return F.concat(*parts) if parts else empty

    def failures(self) -> Column:
        """(field, rule) pairs only: what counting needs, without building any text."""
        pair = T.ArrayType(
            T.StructType([T.StructField("field", T.StringType()), T.StructField("rule", T.StringType())])
        )
        parts = [
            F.array(F.struct(F.lit(n).alias("field"), F.lit(fixed.RULE_UNMAPPED).alias("rule"))).cast(pair)
            for n in self._unmapped
        ]
        for f in self._fields:
            one = F.array(F.struct(F.lit(f.mapping.target_field).alias("field"), F.col(f.rule).alias("rule")))
            parts.append(F.when(F.col(f.rule).isNotNull(), one.cast(pair)).otherwise(F.array().cast(pair)))
        return F.concat(*parts) if parts else F.array().cast(pair)

    # -- results ----------------------------------------------------------------------------------

    def target_columns(self) -> list[Column]:
        """Target columns in declared order (typed null where optional and unmapped), extras last."""
        mapped = {f.mapping.target_field: f for f in self._fields}
        out = []
        for t in self.spec.fields:
            dt = spark_type(t.data_type)
            value = F.col(mapped[t.name].value) if t.name in mapped else F.lit(None).cast(dt)
            out.append(value.alias(t.name))
        declared = self.spec.by_name()
        out += [F.col(f.value).alias(n) for n, f in mapped.items() if n not in declared]
        return out

    def accepted(self, with_index: bool = False) -> DataFrame:
        index = [F.col(self._index).alias(ROW_INDEX)] if with_index else []
        return self.frame.filter(~self.refused()).select(*index, *self.target_columns())

    def payload(self) -> Column:
        """The source row as JSON text, nulls kept."""
        return F.to_json(
            F.struct(*[column_ref(c) for c in self.source_columns]), {"ignoreNullFields": "false"}
        )

    def quarantine_columns(self, run_id: str, created_at: str) -> list[Column]:
        index = F.col(self._index)
        digits = index.cast("string")
        padded = F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits)
        return [
            F.concat(F.lit(f"q_{run_id}_"), padded).alias("quarantine_id"),
            F.lit(self.spec.table_name).alias("table_name"),
            F.lit(run_id).alias("run_id"),
            index.cast("bigint").alias(ROW_INDEX),
            F.col(self._key).alias("source_natural_key"),
            self.payload().alias("source_payload"),
            self.errors().alias("errors"),
            F.lit(created_at).alias("created_at"),
        ]

    def quarantine(self, run_id: str, created_at: str) -> DataFrame:
        """Ledger rows of the refused part; ``suggestion`` is the first error's hint."""
        rows = self.frame.filter(self.refused()).select(*self.quarantine_columns(run_id, created_at))
        return rows.withColumn("suggestion", F.col("errors")[0]["suggestion"])

    def status(self, *extra: Column) -> DataFrame:
        """One row per source row: index, key, accepted or not, number of errors."""
        wrong = sum((F.col(f.rule).isNotNull().cast("int") for f in self._fields), F.lit(len(self._unmapped)))
        return self.frame.select(
            F.col(self._index).alias(ROW_INDEX),
            F.col(self._key).alias("natural_key"),
            (~self.refused()).alias("accepted"),
            wrong.alias("error_count"),
            *extra,
        )

    def evidence(self) -> DataFrame:
        """One row per field error."""
        rows = self.frame.filter(self.refused()).select(
            F.col(self._index).alias(ROW_INDEX),
            F.col(self._key).alias("natural_key"),
            F.explode(self.errors()).alias("e"),
        )
        return rows.select(ROW_INDEX, "natural_key", "e.*")

    def summary(self) -> DataFrame:
        """Total, accepted and rejected rows, in one pass with a partial aggregate."""
        bad = self.refused()
        return self.frame.agg(
            F.count(F.lit(1)).alias("total_source_records"),
            F.count_if(~bad).alias("accepted_count"),
            F.count_if(bad).alias("rejected_count"),
        )

    def errors_by(self, *by: str) -> DataFrame:
        """Number of error entries by ``field``, ``rule`` or both."""
        pairs = self.frame.filter(self.refused()).select(F.explode(self.failures()).alias("e")).select("e.*")
        return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("error_count"))

    def preview(self, run_id: str, created_at: str, limit: int = 200) -> DataFrame:
        """First quarantined rows in source order."""
        return self.quarantine(run_id, created_at).orderBy(ROW_INDEX).limit(limit)

    def field_value(self, target_field: str) -> Column:
        return F.col(next(f for f in self._fields if f.mapping.target_field == target_field).value)

    def field_rule(self, target_field: str) -> Column:
        return F.col(next(f for f in self._fields if f.mapping.target_field == target_field).rule)


def _usable(value: Any) -> bool:
    return bool(value) and str(value).strip() != ""


def _compile_checks(mapping: FieldMapping, target: TargetField, value: str, error: str | None, kind: str, src, tmp):
    """Names of the final value, the refusing rule, its message and hint, and the stages that compute them.

    A stage is only added where a check really changes or tests the value.
    """
    params = mapping.parameters
    refused_by_rule = F.col(error).isNotNull() if error else None
    current = F.col(value)
    tests: list[tuple[Column, str]] = []  # later checks, in order
    stages: list[Stage] = []

    def keep(name: str, column: Column) -> Column:
        stages.append({tmp + name: column})
        return F.col(tmp + name)

    # not null
    null_test = None
    if not target.nullable:
        blank = blank_column(value) if kind == "string" else current.isNull()
        substitute = params.get("default") or params.get("fallback")
        if _usable(substitute):
            mixed, literal, kind = mix(current, kind, substitute)
            current = keep("nn", F.when(blank, literal).otherwise(mixed))
        else:
            null_test = blank
    shown = current

    # enum
    enum_test, allowed = None, target.allowed
    if allowed:
        outside = current.isNotNull() & ~current.cast("string").isin([str(a) for a in allowed])
        substitute = params.get("fallback") or params.get("fallback_enum")
        if substitute and substitute in allowed:
            mixed, literal, kind = mix(current, kind, substitute)
            current = keep("en", F.when(outside, literal).otherwise(mixed))
        else:
            enum_test = outside

    # regex
    regex_test, pattern = None, target.pattern
    if pattern:
        translated = java_regex(pattern)
        miss = ~current.cast("string").rlike(translated) if translated else F.lit(True)
        miss = current.isNotNull() & miss
        if target.nullable and (params.get("on_invalid") == "null" or params.get("null_on_invalid")):
            current = keep("re", F.when(~miss, current))
        else:
            regex_test = miss

    checked = current
    coerced = coerce(checked, kind, target.data_type)
    final_name = next(reversed(stages[-1])) if stages else value
    if coerced.value is not checked or coerced.message is not None:
        final_name = tmp + "val"
        stages.append({final_name: coerced.value})

    if refused_by_rule is not None:
        tests.append((refused_by_rule, mapping.transformation))
    if null_test is not None:
        tests.append((null_test, fixed.RULE_NOT_NULL))
    if enum_test is not None:
        tests.append((enum_test, fixed.RULE_ENUM))
    if regex_test is not None:
        tests.append((regex_test, fixed.RULE_REGEX))
    if coerced.message is not None:
        tests.append((checked.isNotNull() & F.col(final_name).isNull(), fixed.RULE_TYPE))
    code: Column = F.lit(None).cast("string")
    if tests:
        code = F.when(*_pair(tests[0]))
        for t in tests[1:]:
            code = code.when(*_pair(t))
    stages.append({tmp + "rule": code})

    name = mapping.target_field
    texts: list[tuple[str, Column, Column]] = []
    if refused_by_rule is not None:
        hint = fixed.HINT_RULE.replace("{rule}", mapping.transformation).replace("{sources}", src.label)
        texts.append((mapping.transformation, F.col(error), F.lit(hint)))
    if null_test is not None:
        texts.append(
            (
                fixed.RULE_NOT_NULL,
                F.lit(fixed.MSG_NOT_NULL.replace("{field}", name)),
                F.lit(fixed.HINT_NOT_NULL.replace("{field}", name)),
            )
        )
    if enum_test is not None:
        texts.append(
            (
                fixed.RULE_ENUM,
                fill(fixed.MSG_ENUM_CHECK, v=shown, allowed=str(allowed)),
                fill(fixed.HINT_ENUM, v=shown, first=str(allowed[0])),
            )
        )
    if regex_test is not None:
        texts.append(
            (
                fixed.RULE_REGEX,
                fill(fixed.MSG_REGEX_CHECK, v=checked, pattern=pattern),
                fill(fixed.HINT_REGEX, v=checked, pattern=pattern),
            )
        )
    if coerced.message is not None:
        texts.append(
            (fixed.RULE_TYPE, coerced.message, F.lit(fixed.HINT_TYPE.replace("{type}", target.data_type)))
        )
    message = hint = F.lit(None).cast("string")
    if texts:
        which = F.col(tmp + "rule")
        message, hint = F.when(which == texts[0][0], texts[0][1]), F.when(which == texts[0][0], texts[0][2])
        for rule, text, advice in texts[1:]:
            message, hint = message.when(which == rule, text), hint.when(which == rule, advice)
    return final_name, stages, message, hint


def _pair(test: tuple[Column, str]) -> tuple[Column, Column]:
    return test[0], F.lit(test[1])


@dataclass(frozen=True)
class _Compiled:
    layout: _Layout
    fields: list[_Field]
    key_column: str
    forms: dict[str, _Field]


_COMPILED: dict[tuple, _Compiled] = {}
_COMPILED_MAX = 64


def _form(mapping: FieldMapping, target: TargetField, key: str) -> str:
    """What a mapping computes, whatever plan it stands in: target, rule, inputs, parameters, and the business key if it
    stands in for a blank input."""
    stands_in = key if mapping.transformation == "UUID_V5_FROM_KEY" else ""
    return json.dumps([mapping.canonical(), repr(target), stands_in], sort_keys=True, default=str)


def _compile(
    df: DataFrame, plan: Plan, spec: TargetSpec, index: str, prefix: str, columns: list[str], known: dict[str, _Field]
) -> _Compiled:
    """Columns of a whole plan. They depend on names and types only, and are kept for the next batch. Mappings whose form
    is ``known`` are there already and add nothing."""
    key = (
        df.sparkSession.sparkContext.applicationId,
        json.dumps([m.canonical() for m in plan.mappings], sort_keys=True, default=str),
        repr(spec), json.dumps(spec.document, sort_keys=True, default=str),
        df.schema.json(), index, prefix, tuple(columns), tuple(sorted(known)),
    )
    if key in _COMPILED:
        return _COMPILED[key]
    table = SourceTable(df, prefix, columns)
    key_column = prefix + "key"
    business_key = _business_key(spec, plan, table, F.col(index))
    declared = spec.by_name()

    fields: list[_Field] = []
    per_field: list[list[Stage]] = []
    forms: dict[str, _Field] = {}
    for i, mapping in enumerate(plan.mappings):
        tmp = f"{prefix}{i}_"
        target = declared.get(mapping.target_field, TargetField(mapping.target_field))
        form = _form(mapping, target, str(business_key).replace(prefix, ""))
        if form in known:
            forms[form] = known[form]
            fields.append(known[form])
            continue
        src = table.source(mapping.source_fields, mapping.transformation)
        raw = src.text
        if mapping.transformation == "UUID_V5_FROM_KEY":
            filled = F.when(src.blank, F.col(key_column)).otherwise(src.stripped)
            src = Source(src.label, filled, "string", filled, filled)
            raw = filled
        outcome = compile_rule(mapping.transformation, src, mapping.parameters, tmp)
        result, error = {tmp + "r": outcome.value}, None
        if outcome.error is not None:
            error = tmp + "e"
            result[error] = outcome.error
        final, checks, message, hint = _compile_checks(mapping, target, tmp + "r", error, outcome.kind, src, tmp)
        per_field.append([*outcome.stages, result, *checks])
        made = {c for stage in per_field[-1] for c in stage} | set(table.stage) | {key_column}
        inputs = tuple(sorted(made & (_names_in(message) | _names_in(hint) | _names_in(raw))))
        fields.append(_Field(mapping, target, final, tmp + "rule", message, hint, raw, inputs))
        forms[form] = fields[-1]

    layout = _Layout().add([table.stage, {key_column: business_key}]).add_side_by_side(per_field)
    if len(_COMPILED) >= _COMPILED_MAX:
        _COMPILED.pop(next(iter(_COMPILED)))
    _COMPILED[key] = _Compiled(layout, fields, key_column, forms)
    return _COMPILED[key]


def conform(
    df: DataFrame,
    plan: Plan,
    spec: TargetSpec,
    index: str = ROW_INDEX,
    prefix: str = "__c_",
    source_columns: Sequence[str] | None = None,
    shared: Conformed | None = None,
) -> Conformed:
    """Evaluate every mapping of ``plan`` on every row of ``df``.

    ``index`` names the column that holds each row's position (see ``sources.row_index``). It is evidence,
    not data, and is left out of the payload. ``prefix`` keeps two evaluations of one table apart. ``shared`` is an
    evaluation whose frame ``df`` is: mappings that both plans have alike are taken from it, not computed again.
    """
    columns = list(source_columns) if source_columns is not None else [c for c in df.columns if c != index]
    compiled = _compile(df, plan, spec, index, prefix, columns, shared.forms if shared is not None else {})
    keep = [*df.columns, compiled.key_column]
    for f in compiled.fields:
        keep += [f.value, f.rule, *f.inputs]
    frame = compiled.layout.apply(df).select(*[column_ref(c) for c in dict.fromkeys(keep)])
    mapped = {m.target_field for m in plan.mappings}
    unmapped = [f.name for f in spec.fields if not f.nullable and f.name not in mapped and f.default is None]
    done = Conformed(frame, compiled.fields, unmapped, spec, columns, compiled.key_column, index, prefix)
    done.forms = compiled.forms
    # Row counts of whatever job runs over the frame. The observation also keeps Catalyst from pushing a filter
    # on the outcome below the mapping, where every rule would be evaluated a second time inside the filter.
    done.frame = frame.observe(
        f"conform_{uuid.uuid4().hex}",
        F.count(F.lit(1)).alias("total_source_records"),
        F.count_if(done.refused()).alias("rejected_count"),
    )
    return done


def apply_rule(
    df: DataFrame,
    rule: str,
    source_fields: Sequence[str] | str,
    params: dict[str, Any] | None = None,
    value: str = "value",
    error: str = "error",
) -> DataFrame:
    """Add one rule's value and error text to a table.

    A generated key whose source is blank comes from the row's position, or from the whole row where the table has none."""
    names = [source_fields] if isinstance(source_fields, str) else list(source_fields)
    tmp = "__r_"
    table = SourceTable(df, tmp)
    src = table.source(names, rule)
    if rule == "UUID_V5_FROM_KEY" and not (params or {}).get("required", False):
        place = F.col(ROW_INDEX).cast("string") if ROW_INDEX in df.columns else F.to_json(F.struct(*map(column_ref, df.columns)))
        filled = F.when(src.blank, place).otherwise(src.stripped)
        src = Source(src.label, filled, "string", filled, filled)
    outcome = compile_rule(rule, src, params, tmp)
    out = _Layout().add([table.stage, *outcome.stages]).apply(df)
    message = outcome.error if outcome.error is not None else F.lit(None).cast("string")
    return out.select(*[column_ref(c) for c in df.columns], outcome.value.alias(value), message.alias(error))
