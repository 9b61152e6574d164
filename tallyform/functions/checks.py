"""Target checks on a mapped value: type coercion and the texts that explain a failure."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .calendar import days_in_month, valid_day
from .text import fill, strip

# digits, single underscores allowed between them
_D = r"[0-9](?:_?[0-9])*"
_FLOAT = rf"^[+-]?(?:{_D}(?:\.(?:{_D})?)?|\.{_D})(?:[eE][+-]?{_D})?$"
_NOT_FINITE = ("nan", "inf", "infinity")
_DAY_SHAPE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_MOMENT_SHAPE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}"


@dataclass(frozen=True)
class Coercion:
    value: Column  # null when the value cannot be coerced
    message: Column | None  # None when coercion cannot fail


def _integer(v: Column, kind: str) -> Coercion:
    if kind in ("long", "boolean"):
        return Coercion(v.cast("bigint"), None)
    if kind == "double":
        whole = (v == F.floor(v)) & (F.abs(v) < 9.2e18)
        return Coercion(F.when(whole, v.try_cast("bigint")), fill(fixed.MSG_INT_FRACTION, v=v))
    text = strip(v.cast("string"))
    return Coercion(F.when(text.rlike("^-?[0-9]+$"), text.try_cast("bigint")), fill(fixed.MSG_INT_BAD, v=v))


def _float(v: Column, kind: str) -> Coercion:
    if kind in ("long", "double"):
        return Coercion(v.cast("double"), None)
    if kind == "boolean":
        return Coercion(v.cast("int").cast("double"), None)
    text = strip(F.translate(v.cast("string"), fixed.CURRENCY_SIGNS, ""))
    number = F.when(text.rlike(_FLOAT), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
    finite = F.when(F.abs(number) < float("inf"), number)
    bare = F.lower(F.ltrim(text, F.lit("+-")))
    message = F.when(
        bare.isin(list(_NOT_FINITE)) | text.rlike(_FLOAT), fill(fixed.MSG_FLOAT_NAN, v=v)
    ).otherwise(fill(fixed.MSG_FLOAT_BAD, v=v))
    return Coercion(finite, message)


def _boolean(v: Column, kind: str) -> Coercion:
    if kind == "boolean":
        return Coercion(v, None)
    text = strip(F.lower(v.cast("string")))
    word = F.when(text.isin(list(fixed.TRUE_WORDS)), True).when(text.isin(list(fixed.FALSE_WORDS)), False)
    return Coercion(word, fill(fixed.MSG_BOOL_BAD, v=v))


def _day(v: Column, kind: str) -> Coercion:
    head = F.substring(strip(v.cast("string")), 1, 10)
    shaped = head.rlike(_DAY_SHAPE)
    y = F.substring(head, 1, 4).try_cast("int")
    m = F.substring(head, 6, 2).try_cast("int")
    d = F.substring(head, 9, 2).try_cast("int")
    why = (
        F.when(
            ~m.between(1, 12) | (d < 1),
            F.concat(F.lit("time data '"), head, F.lit("' does not match format '%Y-%m-%d'")),
        )
        .when(d > 31, F.concat(F.lit("unconverted data remains: "), F.substring(head, 10, 1)))
        .when(d > days_in_month(y, m), F.lit("day is out of range for month"))
        .otherwise(F.lit("year 0 is out of range"))
    )
    message = F.when(shaped, fill(fixed.MSG_DATE_CALENDAR, d=head, why=why)).otherwise(
        fill(fixed.MSG_DATE_SHAPE, v=v)
    )
    return Coercion(F.when(shaped & valid_day(y, m, d), head), message)


def _moment(v: Column, kind: str) -> Coercion:
    text = strip(v.cast("string"))
    return Coercion(F.when(text.rlike(_MOMENT_SHAPE), text), fill(fixed.MSG_DATETIME_SHAPE, v=v))


def coerce(v: Column, kind: str, data_type: str) -> Coercion:
    """Check and convert ``v`` (of the given kind) to the declared type."""
    name = data_type.lower().strip()
    if name in fixed.INTEGER_TYPES:
        return _integer(v, kind)
    if name in fixed.FLOAT_TYPES:
        return _float(v, kind)
    if name in fixed.BOOLEAN_TYPES:
        return _boolean(v, kind)
    if name in fixed.DATE_TYPES:
        return _day(v, kind)
    if name in fixed.DATETIME_TYPES:
        return _moment(v, kind)
    if kind in ("string", "array", "other"):
        return Coercion(v, None)
    return Coercion(v.cast("string"), None)
