"""Literal tables per rule, and dates against Python's own parser."""

import random
import uuid
from datetime import datetime, timezone

import pytest

from tallyform import apply_rule

CASES = {
    ("DIRECT_COPY", ()): [("x", "x", None), (" ", " ", None), ("", None, None), (None, None, None)],
    ("DIRECT_COPY", (("default", "d"),)): [("", "d", None), (None, "d", None), ("x", "x", None)],
    ("DIRECT_COPY", (("required", True),)): [("", None, "Required field is missing or empty")],
    ("TRIM_CLEAN", (("required", True),)): [
        ("  Alice   Smith ", "Alice Smith", None), (" a\t b\n", "a b", None),
        (None, None, "Required field is missing"), (" \t ", None, "Field is empty after trimming"),
    ],
    ("SPLIT_NAME", (("part", "first"), ("required", True))): [
        ("Doe, John", "John", None), ("John Doe", "John", None), ("  Mary   Ann  Lee ", "Mary", None), ("Cher", "Cher", None),
        ("Doe,", None, "First name could not be extracted from 'Doe,'"), (" ", None, "Name is missing or empty"),
    ],
    ("SPLIT_NAME", (("part", "last"),)): [
        ("Doe, John, Jr", "Doe", None), ("Mary  Ann Lee", "Ann Lee", None), ("Cher", None, None), (", John", None, None), (None, None, None),
    ],
    ("SPLIT_NAME", (("part", "last"), ("fallback", "F"))): [("Cher", "F", None), ("", "F", None)],
    ("SPLIT_NAME", (("part", "middle"),)): [("A B", None, "Invalid split_name part param 'middle'"), ("", None, None)],
    ("PHONE_TO_E164", ()): [
        ("(555) 234-5678", "+15552345678", None), ("000-000-0000", "+10000000000", None), ("TBD", None, None),
        ("337-470-2891 x770", "+3374702891770", None), ("+44 20 7946 0958", "+442079460958", None),
        ("911", None, "Phone number '911' is too short (3 digits; min 10 required)"),
        ("1234567890123456", None, "Phone number '1234567890123456' is too long (16 digits; max 15 allowed)"),
        ("+0123456789", None, "Generated phone '+0123456789' does not meet E.164 format"),
    ],
    ("PHONE_TO_E164", (("fallback", "+1"), ("on_invalid", "null"))): [("911", None, None)],
    ("PHONE_TO_E164", (("fallback", "+19999999999"),)): [("911", "+19999999999", None), ("", "+19999999999", None)],
    ("PHONE_TO_E164", (("required", True), ("default_country_code", "91"))): [
        ("5552345678", "+915552345678", None), ("", None, "Phone number is required"), ("n/a", None, "Phone number 'n/a' contains no digits"),
    ],
    ("EMAIL_NORMALIZE", (("required", True),)): [
        (" John.Doe@GMAIL.com\t", "john.doe@gmail.com", None), ("a@b", None, "Invalid email format: 'a@b'"),
        (None, None, "Email address is required"), ("a b@c.d", None, "Invalid email format: 'a b@c.d'"),
    ],
    ("EMAIL_NORMALIZE", (("fallback", "f@x.y"), ("null_on_invalid", True))): [("bad", "f@x.y", None)],
    ("CLEAN_CURRENCY_TO_FLOAT", ()): [
        ("$1,450.75", 1450.75, None), ("(25.50)", -25.5, None), ("-12571.26", -12571.26, None), ("$-5.00", 5.0, None), ("", 0.0, None),
        ("USD 8,482.57", 8482.57, None), ("5.", 5.0, None), (".5", 0.5, None),
        ("N/A", None, "Unable to parse numeric amount from 'N/A'"), ("1.2.3", None, "Invalid numeric currency string '1.2.3'"),
    ],
    ("CLEAN_CURRENCY_TO_FLOAT", (("default", None), ("required", True))): [("", None, "Currency field is required")],
    ("CLEAN_CURRENCY_TO_FLOAT", (("default", 0.0),)): [("N/A", 0.0, None)],
    ("COUNTRY_TO_ISO2", ()): [
        ("United States", "US", None), ("u.s.a.", "US", None), ("Untied States", "US", None), ("zz", "ZZ", None), ("", "US", None),
        ("Narnia", None, "Unrecognized country 'Narnia'. Must be valid 2-letter ISO or recognized name."),
    ],
    ("COUNTRY_TO_ISO2", (("fallback", "CA"), ("default", ""))): [("Narnia", "CA", None)],
    ("COALESCE_VAL", (("default", "D"),)): [(" NULL ", "D", None), ("none", "D", None), ("None", "None", None), (None, "D", None), (" x", " x", None)],
    ("UUID_V5_FROM_KEY", (("required", True),)): [(" ", None, "Natural key is missing for UUID generation")],
    ("CURRENCY_TO_FLOAT", ()): [("1", None, "Unsupported transformation rule 'CURRENCY_TO_FLOAT'")],
}


@pytest.mark.parametrize("rule,params", list(CASES), ids=lambda p: str(p)[:60])
def test_rule(spark, rule, params):
    rows = CASES[rule, params]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, v string")
    got = apply_rule(df, rule, "v", dict(params)).orderBy("i").collect()
    assert [(r["value"], r["error"]) for r in got] == [r[1:] for r in rows]


def test_enum(spark):
    df = spark.createDataFrame([(0, " high "), (1, "X"), (2, ""), (3, None)], "i int, v string")
    codes = {"HIGH": "CRITICAL", "n": "STANDARD"}
    got = apply_rule(df, "ENUM_LOOKUP", "v", {"mapping": codes}).orderBy("i").collect()
    assert [r["value"] for r in got] == ["CRITICAL", None, None, None]
    assert got[1]["error"] == "Unrecognized enum code 'X'. Allowed source keys: ['HIGH', 'n']" and got[2]["error"] is None
    got = apply_rule(df, "ENUM_LOOKUP", "v", {"mapping": codes, "fallback": "F", "case_sensitive": True}).orderBy("i").collect()
    assert [r["value"] for r in got] == ["F", "F", "F", "F"]


def test_concat(spark):
    df = spark.createDataFrame([(0, " a ", "b"), (1, None, " "), (2, "", "z")], "i int, x string, y string")
    got = apply_rule(df, "CONCAT_WS", ["x", "y"], {"separator": "-", "required": True}).orderBy("i").collect()
    assert [r["value"] for r in got] == ["a-b", None, "z"]
    assert got[1]["error"] == "No non-empty components found to concatenate"


def test_uuid_equals_python(spark):
    keys = ["LEGACY-CUST-1", " padded ", "ключ", "x" * 300]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, v string")
    got = apply_rule(df, "UUID_V5_FROM_KEY", "v", {"namespace": "a.b"}).orderBy("i").collect()
    space = uuid.uuid5(uuid.NAMESPACE_DNS, "a.b")
    assert [r["value"] for r in got] == [str(uuid.uuid5(space, k.strip())) for k in keys]


FORMATS = [
    "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%m-%d-%Y", "%d-%m-%Y",
    "%y-%m-%d", "%d-%m-%y", "%m-%d-%y", "%m/%d/%y", "%d/%m/%y", "%B %d, %Y", "%b %d, %Y", "%Y/%m/%d",
]


def expected_date(text):
    """The first of the formats that parses, as the parser of the standard library sees it."""
    s = text.strip()
    if not s:
        return None
    if s.lstrip("-").isdigit() and s.count("-") <= 1 and s.isascii():
        n = int(s)
        try:
            d = datetime.fromtimestamp(n / 1000.0 if abs(n) > 1e11 else n, tz=timezone.utc)
            return f"{d.year:04d}-{d:%m-%dT%H:%M:%SZ}"
        except (ValueError, OverflowError, OSError):
            return None
    for fmt in FORMATS:
        try:
            d = datetime.strptime(s, fmt)
        except ValueError:
            continue
        return f"{d.year:04d}-{d:%m-%dT%H:%M:%SZ}"
    return None


def date_texts():
    rng = random.Random(7)
    out = ["", "20240115", "-86401", "1700000000000", "99999999999999999", "253402300799999", "-62135596800", "TBD", "2024-02-30", "0000-01-01"]
    out += ["May 5, 2020", "oct  8, 2007", "Sept 1, 2007", "2024-01- 5", "12/ 5/2024", " 5/12/2024", "2024-01-05T24:00:00Z", "2024-01-05 1:2:3", "2024/1/2 10:00:00"]
    for _ in range(6000):
        sep = rng.choice("-/")
        def num():
            return rng.choice([str(rng.randint(0, 33)), f"{rng.randint(0, 99):02d}", str(rng.randint(1, 2100)), f"{rng.randint(0, 9999):04d}", f" {rng.randint(0, 9)}"])
        text = sep.join(num() for _ in range(3))
        if rng.random() < 0.2:
            text += rng.choice(["T", " ", "t"]) + f"{rng.randint(0, 25)}:{rng.randint(0, 61):02d}:{rng.randint(0, 62)}" + rng.choice(["", "Z", "z"])
        out.append(text)
    for _ in range(300):
        month = rng.choice(["January", "feb", "MARCH", "apr", "Juni", "december", "Sep"])
        out.append(f"{month} {rng.randint(0, 33)}, {rng.randint(0, 9999):04d}")
    return out


def test_dates_equal_python(spark):
    texts = date_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    got = {r["i"]: r["value"] for r in apply_rule(df, "DATE_TO_ISO8601", "v", {}).collect()}
    wrong = [(t, expected_date(t), got[i]) for i, t in enumerate(texts) if expected_date(t) != got[i]]
    assert not wrong, wrong[:10]
