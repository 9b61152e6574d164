"""Changes of policy on a plan, and what they do to the rejected rows.

A change is a set of overrides: parameters per target field. Overrides come from a person (``override``,
``with_policy``), from the target's constraints (``fix_all_for``), or from the errors that were found
(``fixes_from_errors``); one table says which parameters answer which failing rule.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import fill
from ..plans.spec import Plan, TargetSpec
from .conform import ROW_INDEX, conform

Overrides = Mapping[str, Mapping[str, Any]]
#: As the value of a parameter: remove it.
DROP = object()


@dataclass(frozen=True)
class Remedy:
    """``filled`` parameters take the substitute; ``also`` are set as they stand."""

    filled: tuple[str, ...] = ("fallback",)
    also: Mapping[str, Any] = field(default_factory=dict)


_NULL = Remedy((), {"on_invalid": "null", "null_on_invalid": True})
_OPTIONAL = Remedy(("fallback", "default"), {"required": False})

#: Failing rule or constraint -> parameter change. A rule that is not listed gets a fallback.
REMEDIES = {
    "DATE_TO_ISO8601": Remedy(("fallback", "default")),
    "EMAIL_NORMALIZE": Remedy(),
    "ENUM_LOOKUP": Remedy(),
    "ENUM_CONSTRAINT": Remedy(),
    "PHONE_TO_E164": _NULL,
    "REGEX_CONSTRAINT": _NULL,
    "SPLIT_NAME": _OPTIONAL,
    "NOT_NULL_CONSTRAINT": _OPTIONAL,
}
#: What is written instead, by the rule that fills the field.
SUBSTITUTES = {
    "DATE_TO_ISO8601": fixed.FIX_DATE,
    "EMAIL_NORMALIZE": fixed.FIX_EMAIL,
    "ENUM_LOOKUP": fixed.FIX_STATUS,
    "SPLIT_NAME": fixed.FIX_NAME,
}
#: Substitutes for status, phone, date and e-mail of the customer plan. Names stay required.
CUSTOMER_FIXES: Overrides = {
    "status": {"fallback": fixed.FIX_STATUS, "mapping": {"X": fixed.FIX_STATUS}},
    "phone_e164": _NULL.also,
    "joined_at": {"fallback": fixed.FIX_DATE, "default": fixed.FIX_DATE},
    "email": {"fallback": fixed.FIX_EMAIL},
}
#: What to do with values that cannot be used.
POLICIES = {
    "null": lambda value: dict(_NULL.also),
    "substitute": lambda value: {"fallback": value, "default": value, "required": False},
    "quarantine": lambda value: {
        "required": True, **dict.fromkeys(("default", "fallback", "on_invalid", "null_on_invalid"), DROP)
    },
}


def override(plan: Plan, overrides: Overrides) -> Plan:
    """The plan with changed parameters, as a draft that needs a new approval.

    A ``mapping`` is added to the one the plan has, ``DROP`` removes a parameter, and fields that the plan
    does not fill are left out.
    """
    for name, changes in overrides.items():
        now = plan.mapping_for(name)
        if now is None:
            continue
        kept = {k: v for k, v in changes.items() if v is not DROP}
        if "mapping" in kept:
            kept["mapping"] = {**(now.parameters.get("mapping") or {}), **kept["mapping"]}
        plan = plan.with_parameters(name, kept, drop=tuple(k for k, v in changes.items() if v is DROP))
    return plan.back_to_draft()


def with_policy(plan: Plan, name: str, policy: str, value: Any = None) -> Plan:
    """One field under ``null``, ``substitute`` (by ``value``) or ``quarantine``."""
    if policy not in POLICIES:
        raise ValueError(f"policy {policy!r} is none of {sorted(POLICIES)}")
    return override(plan, {name: POLICIES[policy](value)})


def remedy(
    plan: Plan, name: str, rule: str, raw: Any = None, substitute: Any = None, spec: TargetSpec | None = None
) -> dict[str, Any]:
    """Parameters that answer one failing rule of a field; a rejected code ``raw`` is mapped as well."""
    mapped = plan.mapping_for(name)
    filler = mapped.transformation if mapped else rule
    declared = spec.by_name().get(name) if spec else None
    code = rule if rule in REMEDIES else filler
    change = REMEDIES.get(code, Remedy())
    if substitute is None:
        allowed = declared.allowed if declared else []
        substitute = allowed[0] if allowed else SUBSTITUTES.get(filler, fixed.FIX_OTHER)
    found = {**dict.fromkeys(change.filled, substitute), **change.also}
    if raw is not None and code.startswith("ENUM"):
        found["mapping"] = {str(raw): substitute}
    return found


def fix_field(
    plan: Plan, name: str, rule: str, raw: Any = None, substitute: Any = None, spec: TargetSpec | None = None
) -> Plan:
    """The fix for one field, chosen by its failing rule; ``spec`` names the allowed codes."""
    return override(plan, {name: remedy(plan, name, rule, raw, substitute, spec)})


def fix_all(plan: Plan) -> Plan:
    """The published fixes of the customer plan."""
    return override(plan, CUSTOMER_FIXES)


def fix_all_for(plan: Plan, spec: TargetSpec) -> Plan:
    """Substitutes for every field of any plan, chosen from the target's constraints."""
    fixes: dict[str, dict[str, Any]] = {}
    for f in spec.fields:
        # an allowed code also fills a required field
        holds = {
            "ENUM_CONSTRAINT": bool(f.allowed),
            "NOT_NULL_CONSTRAINT": not f.nullable and not f.allowed,
            "REGEX_CONSTRAINT": bool(f.constraints.get("regex")),
        }
        for code in (c for c, applies in holds.items() if applies):
            fixes.setdefault(f.name, {}).update(remedy(plan, f.name, code, spec=spec))
    return override(plan, fixes)


def fixes_from_errors(errors: DataFrame, plan: Plan, spec: TargetSpec, least: int = 1) -> Plan:
    """Fix what was found: one remedy per (field, rule) with at least ``least`` errors.

    ``errors`` is the error table (columns ``field``, ``rule``); what reaches the driver is one row per field
    and rule of the plan. Rules are applied in order of their names, so the result is repeatable.
    """
    pairs = errors.groupBy("field", "rule").count().filter(F.col("count") >= least).orderBy("field", "rule").collect()
    fixes: dict[str, dict[str, Any]] = {}
    for row in pairs:
        fixes.setdefault(row["field"], {}).update(remedy(plan, row["field"], row["rule"], spec=spec))
    return override(plan, fixes)


def outcomes(df: DataFrame, before: Plan, after: Plan, spec: TargetSpec, index: str = ROW_INDEX) -> DataFrame:
    """Per row: accepted under the old plan, accepted under the new one.

    Both plans are evaluated on the same scan, so nothing is joined; mappings that did not change are evaluated once.
    """
    columns = [c for c in df.columns if c != index]
    old = conform(df, before, spec, index, "__old_")
    new = conform(old.frame, after, spec, index, "__new_", columns, shared=old)
    return new.frame.select(
        F.col(index).alias(ROW_INDEX), (~old.refused()).alias("before"), (~new.refused()).alias("after")
    )


def impact(df: DataFrame, before: Plan, after: Plan, spec: TargetSpec, index: str = ROW_INDEX) -> DataFrame:
    """How many rows a change of plan fixed, broke, left rejected or left accepted."""
    b, a = F.col("before"), F.col("after")
    what = (
        F.when(~b & a, "fixed").when(~b & ~a, "still_rejected").when(b & ~a, "newly_rejected").otherwise("unchanged")
    )
    return outcomes(df, before, after, spec, index).groupBy(what.alias("outcome")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def diagnosis(field: Column, rule: Column, message: Column, raw: Column) -> Column:
    """The fixed explanation of one error."""
    return fill(fixed.DIAGNOSIS, field=field, rule=rule, message=message, raw=raw)
