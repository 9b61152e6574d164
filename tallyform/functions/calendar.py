"""Date arithmetic on integer columns.

Dirty dates are the rule here, not the exception. Integer arithmetic rejects a bad day without the
exception that a failing timestamp parser raises for every row and every format tried, and it does not
depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .fixed import WHITESPACE_CLASS as WS

_MARK = "\x01"
_NAMED = "\x02"

# day-sized part: two digits, or a space and one digit
_NUMERIC = (
    r"^(\d{1,4})([-/])( [1-9]|\d{1,2})\2( [1-9]|\d{1,4})"
    rf"(?:[Tt](\d{{1,2}}):(\d{{1,2}}):(\d{{1,2}})[Zz]?|{WS}+(\d{{1,2}}):(\d{{1,2}}):(\d{{1,2}}))?$"
)
_NUMERIC_OUT = _MARK + _MARK.join(["$2", "$1", "$3", "$4", "$5$8", "$6$9", "$7$10"])
_NAMED_DATE = rf"^([A-Za-z]+){WS}+(\d{{1,2}}),{WS}+(\d{{4}})$"
_NAMED_OUT = _NAMED + _NAMED.join(["$1", "$2", "$3"])


def days_in_month(y: Column, m: Column) -> Column:
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(30 + (m + (m > 7).cast("int")) % 2)


def valid_day(y: Column, m: Column, d: Column) -> Column:
    return (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= days_in_month(y, m))


def _pad(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _day(y: Column, m: Column, d: Column) -> Column:
    """Date of three digit texts, null when there is no such day.

    The range tests come first because the cast itself answers an impossible month or day by catching an
    exception; what is left for it to refuse are the 29th to 31st of short months.
    """
    text = F.concat(y, F.lit("-"), m, F.lit("-"), F.ltrim(d))
    possible = m.try_cast("int").between(1, 12) & F.ltrim(d).try_cast("int").between(1, 31)
    return F.when(possible, text.try_cast("date"))


def _century(yy: Column) -> Column:
    return F.concat(F.when(yy >= str(fixed.TWO_DIGIT_YEAR_PIVOT), F.lit("19")).otherwise(F.lit("20")), yy)


def date_stages(s: Column, tmp: str) -> list[dict[str, Column]]:
    """Columns to add, stage by stage, to parse the stripped text ``s``.

    The last stage leaves ``{tmp}iso`` (null when nothing parsed) and ``{tmp}num`` (the text was an epoch).
    Stages keep each regex and each part evaluated once; later stages refer to earlier columns by name.

    The formats are tried in a fixed order, yet hardly ever is more than one attempt needed. With the year
    last and slashes, month first wins whenever the first number can be a month: if that month lacks the day,
    the day is above 28 and cannot be a month in its turn. With dashes and a two-digit year the same holds for
    day first. Only ``yy-m-d`` may fail and still leave a chance to ``d-m-yy``.
    """

    def t(name: str) -> Column:
        return F.col(tmp + name)

    rewritten = F.regexp_replace(F.regexp_replace(s, _NUMERIC, _NUMERIC_OUT), _NAMED_DATE, _NAMED_OUT)
    first = {
        tmp + "num": s.rlike("^-?[0-9]+$"),
        tmp + "txt": F.when(~s.contains(_MARK) & ~s.contains(_NAMED), rewritten),
    }
    second = {
        tmp + "parts": F.when(t("txt").startswith(_MARK), F.split(t("txt"), _MARK, -1)),
        tmp + "named": F.when(t("txt").startswith(_NAMED), F.split(t("txt"), _NAMED, -1)),
        tmp + "epoch": F.when(t("num"), s.try_cast("bigint")),
    }

    def part(i: int) -> Column:
        return F.get(t("parts"), F.lit(i))

    pairs = ", ".join(
        f"'{w}', '{i}'" for i, name in enumerate(fixed.MONTH_NAMES, start=1) for w in dict.fromkeys((name, name[:3]))
    )
    words = F.expr(f"map({pairs})")
    third = {
        tmp + "dash": part(1) == "-",
        tmp + "a": part(2),
        tmp + "b": part(3),
        tmp + "c": part(4),
        tmp + "clock": part(5) != "",
        tmp + "nm": F.when(
            t("named").isNotNull(), F.try_element_at(words, F.lower(F.get(t("named"), F.lit(1))))
        ),
        tmp + "sec": F.when(
            F.abs(t("epoch")) <= fixed.EPOCH_MILLIS_ABOVE, F.when(t("epoch") >= -62135596800, t("epoch"))
        ).when(t("epoch").between(-62135596800000, 253402300799999), F.floor(t("epoch") / 1000)),
    }
    a, b, c, dash = t("a"), t("b"), t("c"), t("dash")
    long_first, long_last = F.length(a) == 4, F.length(c) == 4
    short_last = F.length(c) <= 2
    # a day-sized part may be a space and a digit; a month or a year may not
    b_number, c_number = ~b.startswith(" "), ~c.startswith(" ")
    may_be_month = F.lpad(F.col(tmp + "mfirst"), 2, "0").between("01", "12")
    fourth = {
        # year first: yyyy-m-d, yyyy/m/d, yy-m-d
        tmp + "yfirst": F.when(
            short_last & b_number & (~t("clock") | dash),
            F.when(long_first, a).when(dash & ~t("clock") & (F.length(a) == 2), _century(a)),
        ),
        # year last, of four or two digits
        tmp + "ylast": F.when(
            ~t("clock") & (F.length(a) <= 2),
            F.when(long_last, c).when((F.length(c) == 2) & c_number, _century(c)),
        ),
        # the part that is the month if it can be one, else the other part is
        tmp + "mfirst": F.when(dash & short_last, F.when(b_number, b).otherwise("")).otherwise(a),
    }
    swap = F.when(dash & short_last, ~may_be_month).otherwise(may_be_month)  # True: month is a, day is b
    fifth = {
        tmp + "d1": F.when(t("yfirst").isNotNull(), _day(t("yfirst"), b, c)),
        tmp + "swap": swap,
    }
    sixth = {
        tmp + "date": F.when(t("d1").isNotNull(), t("d1"))
        .when(
            t("ylast").isNotNull(),
            _day(
                t("ylast"),
                F.when(t("swap"), a).when(b_number, b),
                F.when(t("swap"), b).otherwise(a),
            ),
        )
        .when(t("nm").isNotNull(), _day(F.get(t("named"), F.lit(3)), t("nm"), F.get(t("named"), F.lit(2))))
        .when(
            t("sec").isNotNull(),
            F.date_add(F.lit("1970-01-01").cast("date"), F.floor(t("sec") / 86400).cast("int")),
        ),
        tmp + "time": F.when(
            t("clock"),
            F.when(
                (F.lpad(part(5), 2, "0") <= "23") & (F.lpad(part(6), 2, "0") <= "59") & (F.lpad(part(7), 2, "0") <= "59"),
                F.concat_ws(":", F.lpad(part(5), 2, "0"), F.lpad(part(6), 2, "0"), F.lpad(part(7), 2, "0")),
            ),
        )
        .when(
            t("sec").isNotNull(),
            F.concat_ws(
                ":",
                _pad(F.floor(F.pmod(t("sec"), F.lit(86400)) / 3600), 2),
                _pad(F.floor(F.pmod(t("sec"), F.lit(3600)) / 60), 2),
                _pad(F.pmod(t("sec"), F.lit(60)), 2),
            ),
        )
        .otherwise(F.lit("00:00:00")),
    }
    seventh = {
        tmp + "iso": F.when(
            t("date") >= F.lit("0001-01-01").cast("date"),
            F.concat(t("date").cast("string"), F.lit("T"), t("time"), F.lit("Z")),
        )
    }
    return [first, second, third, fourth, fifth, sixth, seventh]
