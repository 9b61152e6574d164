"""The closed catalogue of cleaning rules.

A rule turns one source value into a pair of Columns: the value and, for rows the rule refuses, an error
text. Rules are registered as builders of Columns, so a whole plan runs inside Catalyst without Python.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .calendar import date_stages
from .text import blanks, fill, is_blank, one_blank, strip

Params = dict[str, Any]
Stage = dict[str, Column]


@dataclass(frozen=True)
class Source:
    """The input of one mapping, already resolved against the source table."""

    label: str
    value: Column  # as read
    kind: str  # string, long, double, boolean, array, other, list (several source columns)
    text: Column  # as text
    stripped: Column  # as text, stripped
    parts: tuple[Column, ...] = ()  # several source columns, as text

    @property
    def blank(self) -> Column:
        return self.stripped.isNull() | (self.stripped == F.lit(""))


@dataclass(frozen=True)
class Outcome:
    value: Column
    error: Column | None = None
    kind: str = "string"
    stages: list[Stage] = field(default_factory=list)


Rule = Callable[[Source, Params, str], Outcome]
RULES: dict[str, Rule] = {}


def rule(name: str) -> Callable[[Rule], Rule]:
    def register(fn: Rule) -> Rule:
        RULES[name] = fn
        return fn

    return register


def _null() -> Column:
    return F.lit(None).cast("string")


def _text(value: Any) -> Column:
    return F.lit(None if value is None else str(value)).cast("string")


def _first_set(params: Params, *names: str) -> Any:
    """First parameter that is neither missing nor empty."""
    return next((params[n] for n in names if params.get(n)), None)


def _null_on_invalid(params: Params) -> bool:
    return bool(
        params.get("on_invalid") == "null" or params.get("allow_null_on_invalid") or params.get("null_on_invalid")
    )


def _refused(params: Params, fallback: Any, message: Column, required_only: bool = False, null_first: bool = True):
    """(value, error) for a refused value: null, fallback or error in the rule's own order of preference."""
    if null_first and _null_on_invalid(params):
        return _null(), _null()
    if fallback:
        return _text(fallback), _null()
    if not null_first and _null_on_invalid(params):
        return _null(), _null()
    if required_only and not params.get("required", False):
        return _null(), _null()
    return _null(), message


def _cases(branches: list[tuple[Column, Column, Column]], value: Column) -> tuple[Column, Column]:
    """Fold (condition, value, error) branches, first match wins, over the clean value."""
    v, e = None, None
    for cond, bv, be in branches:
        v = F.when(cond, bv) if v is None else v.when(cond, bv)
        e = F.when(cond, be) if e is None else e.when(cond, be)
    return v.otherwise(value), e


def literal_of(value: Any, kind: str) -> tuple[Column, str]:
    """A literal in the column's own kind when that is possible, else as text."""
    if value is None:
        return F.lit(None), kind
    if kind == "long" and isinstance(value, int) and not isinstance(value, bool):
        return F.lit(value).cast("bigint"), kind
    if kind == "double" and isinstance(value, (int, float)) and not isinstance(value, bool):
        return F.lit(float(value)), kind
    if kind == "boolean" and isinstance(value, bool):
        return F.lit(value), kind
    return _text(value), "string"


def mix(value: Column, kind: str, literal: Any) -> tuple[Column, Column, str]:
    """Bring a column and a literal to one kind."""
    lit, lit_kind = literal_of(literal, kind)
    if lit_kind != kind:
        return value.cast("string"), lit, "string"
    return value, lit, kind


@rule("DIRECT_COPY")
def direct_copy(src: Source, params: Params, tmp: str) -> Outcome:
    value, default, kind = mix(src.value, src.kind, params.get("default"))
    missing = src.value.isNull() | (src.value == F.lit("")) if src.kind == "string" else src.value.isNull()
    if params.get("default") is not None:
        return Outcome(F.when(missing, default).otherwise(value), None, kind)
    error = F.when(missing, F.lit(fixed.MSG_COPY_MISSING)) if params.get("required", False) else None
    return Outcome(F.when(~missing, value), error, kind)


@rule("TRIM_CLEAN")
def trim_clean(src: Source, params: Params, tmp: str) -> Outcome:
    spaced = tmp + "spaced"
    stages = [{spaced: blanks(src.stripped)}]
    value = F.when(F.col(spaced) != "", one_blank(F.col(spaced)))
    if not params.get("required", False):
        return Outcome(value, stages=stages)
    error = F.when(src.text.isNull(), F.lit(fixed.MSG_TRIM_MISSING)).when(
        src.stripped == "", F.lit(fixed.MSG_TRIM_EMPTY)
    )
    return Outcome(value, error, stages=stages)


@rule("CONCAT_WS")
def concat_ws(src: Source, params: Params, tmp: str) -> Outcome:
    sep = params.get("separator", " ")
    if src.kind == "array":
        cleaned = F.transform(src.value, lambda x: F.nullif(strip(x.cast("string")), F.lit("")))
        joined = F.concat_ws(sep, cleaned)
    else:
        joined = F.concat_ws(sep, *[F.nullif(strip(p), F.lit("")) for p in src.parts or (src.text,)])
    out = tmp + "joined"
    value = F.nullif(F.col(out), F.lit(""))
    error = F.when(F.col(out) == "", F.lit(fixed.MSG_CONCAT_EMPTY)) if params.get("required", False) else None
    return Outcome(value, error, stages=[{out: joined}])


@rule("SPLIT_NAME")
def split_name(src: Source, params: Params, tmp: str) -> Outcome:
    fallback = _first_set(params, "default", "fallback")
    part = str(params.get("part", "first")).lower()
    required = params.get("required", False)
    on_blank = _refused({"required": required}, fallback, F.lit(fixed.MSG_NAME_MISSING), required_only=True)
    if part not in ("first", "last"):
        message = F.lit(fixed.MSG_NAME_PART.replace("{part}", part))
        value, error = _cases([(src.blank, *on_blank)], _null())
        return Outcome(value, error.otherwise(message))

    s, comma, flat, got = src.stripped, tmp + "comma", tmp + "flat", tmp + "got"
    first_stage = {
        comma: F.instr(s, ","),
        flat: one_blank(blanks(s)),
    }
    if part == "first":
        after_comma = strip(F.substr(s, F.col(comma) + 1))
        plain = F.substring_index(F.col(flat), " ", 1)
    else:
        after_comma = strip(F.substr(s, F.lit(1), F.col(comma) - 1))
        plain = F.when(F.instr(F.col(flat), " ") > 0, F.substr(F.col(flat), F.instr(F.col(flat), " ") + 1))
    second_stage = {got: F.coalesce(F.when(F.col(comma) > 0, after_comma).otherwise(plain), F.lit(""))}
    template = fixed.MSG_NAME_FIRST if part == "first" else fixed.MSG_NAME_LAST
    on_missing = _refused({"required": required}, fallback, fill(template, v=src.text), required_only=True)
    value, error = _cases([(src.blank, *on_blank), (F.col(got) == "", *on_missing)], F.col(got))
    return Outcome(value, error, stages=[first_stage, second_stage])


@rule("DATE_TO_ISO8601")
def date_to_iso8601(src: Source, params: Params, tmp: str) -> Outcome:
    fallback = _first_set(params, "fallback", "default")
    iso, num = F.col(tmp + "iso"), F.col(tmp + "num")
    on_blank = _refused(
        {"required": params.get("required", False)}, fallback, F.lit(fixed.MSG_DATE_MISSING), required_only=True
    )
    message = F.when(num, fill(fixed.MSG_DATE_EPOCH, s=src.stripped)).otherwise(
        fill(fixed.MSG_DATE_BAD, s=src.stripped)
    )
    on_bad = _refused({}, fallback, message)
    value, error = _cases([(src.blank, *on_blank), (iso.isNull(), *on_bad)], iso)
    return Outcome(value, error, stages=date_stages(src.stripped, tmp))


@rule("PHONE_TO_E164")
def phone_to_e164(src: Source, params: Params, tmp: str) -> Outcome:
    fallback = _first_set(params, "fallback", "default")
    code = str(params.get("default_country_code", fixed.DEFAULT_DIALLING_CODE))
    digits, count, phone = F.col(tmp + "digits"), F.col(tmp + "count"), F.col(tmp + "phone")
    s = src.stripped
    prefix = F.when(~s.startswith("+") & (count == 10), F.lit("+" + code)).otherwise(F.lit("+"))
    stages = [
        {tmp + "digits": F.regexp_replace(s, r"[^\p{Nd}]", "")},
        {tmp + "count": F.length(digits)},
        {tmp + "phone": F.concat(prefix, digits)},
    ]

    def refused(message: Column, required_only: bool = False):
        return _refused(params, fallback, message, required_only)

    number = count.cast("string")
    value, error = _cases(
        [
            (src.blank, *refused(F.lit(fixed.MSG_PHONE_MISSING), True)),
            (count == 0, *refused(fill(fixed.MSG_PHONE_NO_DIGITS, s=s), True)),
            (count < fixed.PHONE_MIN_DIGITS, *refused(fill(fixed.MSG_PHONE_SHORT, s=s, n=number))),
            (count > fixed.PHONE_MAX_DIGITS, *refused(fill(fixed.MSG_PHONE_LONG, s=s, n=number))),
            (~phone.rlike("(?U)" + fixed.E164_PATTERN), *refused(fill(fixed.MSG_PHONE_BAD, p=phone))),
        ],
        phone,
    )
    return Outcome(value, error, stages=stages)


@rule("EMAIL_NORMALIZE")
def email_normalize(src: Source, params: Params, tmp: str) -> Outcome:
    fallback = _first_set(params, "fallback", "default")
    mail = F.col(tmp + "mail")
    on_blank = _refused(params, fallback, F.lit(fixed.MSG_EMAIL_MISSING), required_only=True, null_first=False)
    on_bad = _refused(params, fallback, fill(fixed.MSG_EMAIL_BAD, v=src.text), null_first=False)
    value, error = _cases([(src.blank, *on_blank), (~mail.rlike(fixed.EMAIL_PATTERN), *on_bad)], mail)
    return Outcome(value, error, stages=[{tmp + "mail": F.lower(src.stripped)}])


def _negative(s: Column) -> Column:
    return (s.startswith("(") & s.endswith(")")) | s.startswith("-")


def money_stages(stripped: Column, tmp: str) -> list[Stage]:
    """``{tmp}digits`` and ``{tmp}money``: the amount as decimal(38,2), null when it does not parse."""
    digits = F.col(tmp + "digits")
    amount = digits.try_cast("decimal(38,2)")
    return [
        {tmp + "digits": F.regexp_replace(stripped, "[^0-9.]", "")},
        {tmp + "money": F.when(_negative(stripped), -amount).otherwise(amount)},
    ]


@rule("CLEAN_CURRENCY_TO_FLOAT")
def clean_currency_to_float(src: Source, params: Params, tmp: str) -> Outcome:
    default = params.get("default")
    on_blank_default = params.get("default", 0.0)
    money, digits = F.col(tmp + "money"), F.col(tmp + "digits")
    try:
        amount = None if default is None else float(default)
        unusable = None
    except (TypeError, ValueError) as exc:
        amount, unusable = None, f"Execution failure in transform 'CLEAN_CURRENCY_TO_FLOAT': {exc!s}"

    no_digits = digits == ""
    # beyond 36 integer digits the amount no longer fits a decimal; a double still holds it
    wide = digits.try_cast("double")
    wide = F.when(_negative(src.stripped), -wide).otherwise(wide)
    parsed = F.coalesce(money.cast("double"), wide)
    value, blank_value, kind = mix(parsed, "double", on_blank_default)
    empty_value = F.lit(amount).cast("double") if amount is not None else F.lit(None).cast("double")
    if kind == "string":
        empty_value = empty_value.cast("string")
    result = F.when(src.blank, blank_value).when(no_digits, empty_value).otherwise(value)

    errors: list[tuple[Column, Column]] = []
    if params.get("required", False) and on_blank_default is None:
        errors.append((src.blank, F.lit(fixed.MSG_MONEY_MISSING)))
    else:
        errors.append((src.blank, _null()))
    if unusable:
        errors.append((no_digits, F.lit(unusable)))
    elif amount is None:
        errors.append((no_digits, fill(fixed.MSG_MONEY_EMPTY, v=src.text)))
    else:
        errors.append((no_digits, _null()))
    errors.append((parsed.isNull(), fill(fixed.MSG_MONEY_BAD, v=src.text)))
    error = F.when(*errors[0])
    for cond, message in errors[1:]:
        error = error.when(cond, message)
    return Outcome(result, error, kind, money_stages(src.stripped, tmp))


def lookup(table: dict[str, Any], key: Column) -> Column:
    """Value of ``key`` in a small literal table, null when absent."""
    if not table:
        return _null()
    keys = F.lit([str(k) for k in table])
    return F.try_element_at(F.map_from_arrays(keys, F.lit([str(v) for v in table.values()])), key)


@rule("ENUM_LOOKUP")
def enum_lookup(src: Source, params: Params, tmp: str) -> Outcome:
    mapping = params.get("mapping") or {}
    fallback = params.get("fallback")
    if params.get("case_sensitive", False):
        table, key = {str(k): v for k, v in mapping.items()}, src.stripped
    else:
        table, key = {str(k).lower(): v for k, v in mapping.items()}, F.lower(src.stripped)
    hit = F.col(tmp + "hit")
    stages = [{tmp + "hit": lookup({k: v for k, v in table.items() if v is not None}, key)}]
    if fallback is not None:
        return Outcome(F.coalesce(F.when(~src.blank, hit), _text(fallback)), None, stages=stages)
    on_blank = F.lit(fixed.MSG_ENUM_MISSING) if params.get("required", False) else _null()
    message = fill(fixed.MSG_ENUM_BAD, v=src.text, keys=str(list(mapping.keys())))
    value, error = _cases([(src.blank, _null(), on_blank), (hit.isNull(), _null(), message)], hit)
    return Outcome(value, error, stages=stages)


@rule("COUNTRY_TO_ISO2")
def country_to_iso2(src: Source, params: Params, tmp: str) -> Outcome:
    default = params.get("default", fixed.DEFAULT_COUNTRY)
    fallback = params.get("fallback") or None
    raw, bare, hit = F.col(tmp + "raw"), F.col(tmp + "bare"), F.col(tmp + "hit")
    stages = [
        {tmp + "raw": F.upper(src.stripped)},
        {tmp + "bare": strip(F.replace(raw, F.lit("."), F.lit("")))},
        {
            tmp + "hit": F.coalesce(
                lookup(fixed.COUNTRIES, raw), lookup(fixed.COUNTRIES, bare), F.when(bare.rlike(r"^\p{L}{2}$"), bare)
            )
        },
    ]
    missing = F.lit(fixed.MSG_COUNTRY_MISSING) if params.get("required", False) and not default else _null()
    on_bad = _refused({}, fallback, fill(fixed.MSG_COUNTRY_BAD, v=src.text))
    value, error = _cases([(src.blank, _text(default), missing), (hit.isNull(), *on_bad)], hit)
    return Outcome(value, error, stages=stages)


@rule("COALESCE_VAL")
def coalesce_val(src: Source, params: Params, tmp: str) -> Outcome:
    value, default, kind = mix(src.value, src.kind, params.get("default"))
    missing = src.stripped.isNull() | src.stripped.isin(list(fixed.COALESCE_BLANKS))
    return Outcome(F.when(missing, default).otherwise(value), None, kind)


def uuid5_digest(namespace: str, key: Column) -> Column:
    space = uuid.uuid5(uuid.NAMESPACE_DNS, namespace)
    return F.sha1(F.concat(F.unhex(F.lit(space.hex)), F.encode(key, "UTF-8")))


def uuid5_text(digest: Column) -> Column:
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3),
        F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def uuid5_column(namespace: str, key: Column) -> Column:
    """RFC 4122 version-5 UUID of ``key`` inside the namespace, from SHA-1 alone."""
    return uuid5_text(uuid5_digest(namespace, key))


@rule("UUID_V5_FROM_KEY")
def uuid_v5_from_key(src: Source, params: Params, tmp: str) -> Outcome:
    namespace = params.get("namespace", fixed.DEFAULT_UUID_NAMESPACE)
    stages = [
        {tmp + "sha": uuid5_digest(namespace, src.stripped)},
        {tmp + "uuid": uuid5_text(F.col(tmp + "sha"))},
    ]
    made = F.col(tmp + "uuid")
    if params.get("required", False):
        return Outcome(F.when(~src.blank, made), F.when(src.blank, F.lit(fixed.MSG_UUID_MISSING)), stages=stages)
    # callers put the business key, the row's position or its content in place of a blank source
    return Outcome(F.when(~src.blank, made), None, stages=stages)


def compile_rule(name: str, src: Source, params: Params | None, tmp: str) -> Outcome:
    """Columns for one rule; an unknown rule refuses every row."""
    builder = RULES.get(name)
    if builder is None:
        return Outcome(_null(), F.lit(fixed.MSG_UNKNOWN_RULE.replace("{rule}", name)))
    return builder(src, dict(params or {}), tmp)


__all__ = ["RULES", "Outcome", "Source", "compile_rule", "is_blank", "lookup", "mix", "money_stages", "uuid5_column"]
