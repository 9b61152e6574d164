"""Messy source tables to work on: a generator of any size, and SQL that dirties clean tables.

The SQL texts are plain enough to run unchanged in other engines, which is how results are checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalogue import SPECS
from ..plans.spec import TargetSpec
from .readers import read_delimited, require_rows

_FIRST = ["Ada", "Bram", "Chiara", "Dmitri", "Elif", "Farah", "Goran", "Hana", "Ivo", "Jolanda", "Kwame"]
_LAST = ["Okafor", "Lindqvist", "Moreau", "Tanaka", "Varga", "Silva", "Novak", "Brandt", "Iyer", "Castellanos"]
_DOMAINS = ["example.com", "example.org", "mail.example.net", "shop-example.io"]
_COUNTRIES = ["USA", "United States", "US", "Canada", "CA", "United Kingdom", "UK", "GB", "Australia", "DE"]


def legacy_customers(spark: SparkSession, n: int = 1000) -> DataFrame:
    """``n`` messy CRM rows. Which rows are bad follows from the row number alone, at any ``n``.

    Every 25th row has a bad date, else every 33rd a bad phone, else every 40th a bad e-mail, else every
    50th an unknown status, else every 70th no name.
    """
    i = F.col("i")

    def pick(values: list[str], salt: int):
        return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(values))).cast("int"))

    def number(salt: int, low: int, high: int):
        return F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(high - low + 1)) + F.lit(low)

    def pad(c, width: int):
        return F.lpad(c.cast("string"), width, "0")

    def every(k: int):
        return i % k == 0

    rows = spark.range(1, n + 1).withColumnRenamed("id", "i").withColumns(
        {"fn": pick(_FIRST, 1), "ln": pick(_LAST, 2), "dom": pick(_DOMAINS, 3)}
    )
    rows = rows.withColumn(
        "bad",
        F.when(every(25), "date").when(every(33), "phone").when(every(40), "email").when(every(50), "status")
        .when(every(70), "name").otherwise("none"),
    )
    fn, ln, dom, bad = F.col("fn"), F.col("ln"), F.col("dom"), F.col("bad")
    year, month, day = number(4, 2020, 2024), pad(number(5, 1, 12), 2), pad(number(6, 1, 28), 2)
    cents = pad(number(7, 0, 99), 2)
    name = (
        F.when(bad == "name", "")
        .when(every(3), F.concat_ws(", ", ln, fn))
        .when(every(5), F.concat(F.lit("  "), fn, F.lit("   "), ln, F.lit("  ")))
        .otherwise(F.concat_ws(" ", fn, ln))
    )
    mail = (
        F.when(bad == "email", F.concat(F.lower(fn), F.lit("."), F.lower(ln), F.lit("-no-at-sign")))
        .when(every(4), F.concat(F.lit(" "), F.upper(fn), F.lit("."), ln, F.lit("@"), dom, F.lit(" ")))
        .otherwise(F.concat(F.lower(fn), F.lit("."), F.lower(ln), F.lit("@"), dom))
    )
    a, b, c = number(8, 200, 999), number(9, 100, 999), number(10, 1000, 9999)
    phone = (
        F.when(bad == "phone", "911")
        .when(every(4), F.format_string("(%d) %d-%d", a, b, c))
        .when(every(6), F.concat_ws(".", a, b, c))
        .otherwise(F.concat(F.lit("+1"), a.cast("string"), b.cast("string"), c.cast("string")))
    )
    date = (
        F.when(bad == "date", "INVALID_TIMESTAMP")
        .when(every(3), F.concat_ws("/", month, day, year))
        .when(every(5), F.concat_ws("-", year, month, day))
        .otherwise(F.concat(F.concat_ws("-", year, month, day), F.lit("T10:30:00Z")))
    )
    balance = (
        F.when(every(15), F.concat(F.lit("($"), number(11, 10, 500).cast("string"), F.lit("."), cents, F.lit(")")))
        .when(every(8), F.concat(F.lit("$"), number(11, 50, 5000).cast("string"), F.lit("."), cents))
        .otherwise(F.concat(number(11, 0, 3000).cast("string"), F.lit("."), cents))
    )
    return rows.select(
        (i - 1).alias("source_row_index"),
        F.concat(F.lit("LEGACY-CUST-"), F.when(i < 100000, pad(i, 5)).otherwise(i.cast("string"))).alias("legacy_account_id"),
        name.alias("full_name_raw"),
        mail.alias("email_address"),
        phone.alias("phone_raw"),
        date.alias("signup_date_str"),
        F.when(bad == "status", "X").when(every(7), "9").when(every(11), "0").otherwise("1").alias("account_status_code"),
        balance.alias("balance_due_str"),
        F.when(every(10), "HIGH").when(every(6), "Y").when(every(4), "LOW").otherwise("N").alias("risk_flag"),
        pick(_COUNTRIES, 12).alias("country_code_raw"),
    )


# {customer} and {nation} are table references of the engine that runs the text.
LEGACY_CRM = """
SELECT k - 1 AS source_row_index,
       concat('LEGACY-CUST-', lpad(cast(k AS varchar(20)), 9, '0')) AS legacy_account_id,
       CASE WHEN bad = 'name' THEN ''
            WHEN k % 61 = 0 THEN concat('Mono', seg)
            WHEN k % 3 = 0 THEN concat(ln, ', ', fn)
            WHEN k % 5 = 0 THEN concat('  ', fn, '   ', ln, '  ')
            WHEN k % 71 = 0 THEN concat(fn, ' van der ', ln)
            ELSE concat(fn, ' ', ln) END AS full_name_raw,
       CASE WHEN bad = 'email' THEN concat(lower(fn), '.', lower(ln), '-no-at-sign')
            WHEN k % 97 = 0 THEN 'N/A'
            WHEN k % 4 = 0 THEN concat(' ', upper(fn), '.', ln, '@', lower(seg), '.example.com ')
            ELSE concat(lower(fn), '.', lower(ln), '@', lower(seg), '.example.com') END AS email_address,
       CASE WHEN bad = 'phone' THEN '911'
            WHEN k % 59 = 0 THEN 'TBD'
            WHEN k % 83 = 0 THEN '000-000-0000'
            WHEN k % 89 = 0 THEN concat('337-470-', lpad(cast(k % 10000 AS varchar(20)), 4, '0'), ' x770')
            WHEN k % 4 = 0 THEN concat('(', cast(200 + k % 800 AS varchar(20)), ') ', cast(100 + k % 900 AS varchar(20)), '-', cast(1000 + k % 9000 AS varchar(20)))
            WHEN k % 6 = 0 THEN concat(cast(200 + k % 800 AS varchar(20)), '.', cast(100 + k % 900 AS varchar(20)), '.', cast(1000 + k % 9000 AS varchar(20)))
            ELSE concat('+1', cast(2000000000 + k % 1000000 AS varchar(20))) END AS phone_raw,
       CASE WHEN bad = 'date' THEN CASE WHEN k % 2 = 0 THEN 'INVALID_TIMESTAMP' ELSE '2024-02-31' END
            WHEN k % 43 = 0 THEN cast(1100000000 + k * 86 AS varchar(20))
            WHEN k % 47 = 0 THEN concat('October ', cast(1 + k % 31 AS varchar(20)), ', 2007')
            WHEN k % 53 = 0 THEN concat(lpad(cast(k % 100 AS varchar(20)), 2, '0'), '-', lpad(cast(1 + k % 12 AS varchar(20)), 2, '0'), '-', lpad(cast(1 + k % 28 AS varchar(20)), 2, '0'))
            WHEN k % 7 = 0 THEN concat(cast(1 + k % 28 AS varchar(20)), '/', cast(1 + k % 12 AS varchar(20)), '/20', lpad(cast(k % 25 AS varchar(20)), 2, '0'))
            WHEN k % 3 = 0 THEN concat(lpad(cast(1 + k % 12 AS varchar(20)), 2, '0'), '/', lpad(cast(1 + k % 28 AS varchar(20)), 2, '0'), '/20', lpad(cast(k % 25 AS varchar(20)), 2, '0'))
            WHEN k % 5 = 0 THEN concat('20', lpad(cast(k % 25 AS varchar(20)), 2, '0'), '-', lpad(cast(1 + k % 12 AS varchar(20)), 2, '0'), '-', lpad(cast(1 + k % 28 AS varchar(20)), 2, '0'))
            ELSE concat('20', lpad(cast(k % 25 AS varchar(20)), 2, '0'), '-', lpad(cast(1 + k % 12 AS varchar(20)), 2, '0'), '-', lpad(cast(1 + k % 28 AS varchar(20)), 2, '0'), 'T10:30:00Z') END AS signup_date_str,
       CASE WHEN k % 27 = 0 THEN 'X' WHEN k % 7 = 0 THEN '9' WHEN k % 11 = 0 THEN ' 0' WHEN k % 13 = 0 THEN '' ELSE '1' END AS account_status_code,
       CASE WHEN k % 101 = 0 THEN 'N/A'
            WHEN k % 103 = 0 THEN '1.2.3'
            WHEN k % 15 = 0 THEN concat('($', cast(abs(bal) AS varchar(30)), ')')
            WHEN k % 8 = 0 THEN concat('$', cast(abs(bal) AS varchar(30)))
            WHEN k % 17 = 0 THEN concat('USD ', cast(abs(bal) AS varchar(30)))
            ELSE cast(bal AS varchar(30)) END AS balance_due_str,
       CASE WHEN k % 10 = 0 THEN 'HIGH' WHEN k % 6 = 0 THEN 'y' WHEN k % 4 = 0 THEN 'LOW' WHEN k % 9 = 0 THEN 'MED' ELSE 'N' END AS risk_flag,
       CASE WHEN nat % 9 = 0 THEN 'USA' WHEN nat % 9 = 1 THEN 'u.s.a.' WHEN nat % 9 = 2 THEN 'Canada'
            WHEN nat % 9 = 3 THEN ' uk ' WHEN nat % 9 = 4 THEN 'Untied States' WHEN nat % 9 = 5 THEN 'de'
            WHEN nat % 9 = 6 THEN nation_name WHEN nat % 9 = 7 THEN '' ELSE 'Japan' END AS country_code_raw
FROM (SELECT c.c_custkey + 1 AS k, c.c_nationkey AS nat, n.n_name AS nation_name, c.c_mktsegment AS seg,
             cast(c.c_acctbal AS decimal(18,2)) AS bal,
             concat('Fn', cast(c.c_custkey % 211 AS varchar(20))) AS fn,
             concat('Ln', cast(c.c_custkey % 1009 AS varchar(20))) AS ln,
             CASE WHEN (c.c_custkey + 1) % 25 = 0 THEN 'date' WHEN (c.c_custkey + 1) % 33 = 0 THEN 'phone'
                  WHEN (c.c_custkey + 1) % 40 = 0 THEN 'email' WHEN (c.c_custkey + 1) % 70 = 0 THEN 'name'
                  ELSE 'none' END AS bad
      FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey) base
"""

LEGACY_ORDERS = """
SELECT o_orderkey AS source_row_index,
       concat('ORD-', cast(o_orderkey AS varchar(20))) AS order_id,
       CASE WHEN o_orderkey % 401 = 0 THEN '' ELSE concat(' ON-', lpad(cast(o_orderkey AS varchar(20)), 9, '0')) END AS order_num,
       CASE WHEN o_orderkey % 37 = 0 THEN concat('cust', cast(o_custkey AS varchar(20)), 'example.com')
            WHEN o_orderkey % 5 = 0 THEN concat('CUST', cast(o_custkey AS varchar(20)), '@Example.COM ')
            ELSE concat('cust', cast(o_custkey AS varchar(20)), '@example.com') END AS cust_email_raw,
       CASE WHEN o_orderkey % 41 = 0 THEN 'UNKNOWN'
            WHEN o_orderkey % 3 = 0 THEN concat(lpad(cast(month(o_orderdate) AS varchar(20)), 2, '0'), '/', lpad(cast(day(o_orderdate) AS varchar(20)), 2, '0'), '/', cast(year(o_orderdate) AS varchar(20)))
            WHEN o_orderkey % 4 = 0 THEN concat(cast(year(o_orderdate) AS varchar(20)), '/', cast(month(o_orderdate) AS varchar(20)), '/', cast(day(o_orderdate) AS varchar(20)))
            ELSE concat(cast(year(o_orderdate) AS varchar(20)), '-', lpad(cast(month(o_orderdate) AS varchar(20)), 2, '0'), '-', lpad(cast(day(o_orderdate) AS varchar(20)), 2, '0')) END AS date_placed,
       CASE WHEN o_orderkey % 53 = 0 THEN '' WHEN o_orderkey % 59 = 0 THEN 'twelve'
            WHEN o_orderkey % 2 = 0 THEN concat('$', cast(cast(o_totalprice AS decimal(18,2)) AS varchar(30)))
            WHEN o_orderkey % 7 = 0 THEN concat('(', cast(cast(o_totalprice AS decimal(18,2)) AS varchar(30)), ')')
            ELSE cast(cast(o_totalprice AS decimal(18,2)) AS varchar(30)) END AS order_total_str,
       CASE WHEN o_orderkey % 61 = 0 THEN '?' ELSE o_orderstatus END AS status_cd,
       o_orderpriority AS priority
FROM {orders}
"""


#: Values that exports really hold, by column; a row takes one of each by its number. Lists of unlike lengths make many pairs.
HARD_VALUES = {
    "full_name_raw": ["Dupont,  Amélie", "N/A", "  ", "Prince", "van der Berg, Jan Willem", "O'Neil,Shaun", "Li\tWei", ", Solo", "Mr. Bob  Dole ", "García Márquez, Gabriel", "TBD"],
    "email_address": ["JOHN@Example.COM", " pat@mail.example.org\t", "no-at-sign", "a@b", "x@@example.com", "", "first.last+tag@sub.example.co", "N/A", "trailing@example.com.", "sp ace@example.com"],
    "phone_raw": ["+44 20 7946 0958", "555-0100", "(555) 010-0199", "000-000-0000", "555.010.0199 x42", "none", "1-800-555-0199", "+1 (555) 010 0199", "911", "  5550100199  ", "+123456789012345678", "", "5550100199 ext 7"],
    "signup_date_str": ["2021-02-30", "00/00/0000", "1463788800", "October 18, 2007", "13-07-22", "2020-02-29", "3/4/2019", "2019/7/5", "31/12/2018", "TBD", " 2022-01-05 ", "2021-03-04T05:06:07Z", "20210304", "Sept 5, 2020", "12/31/99", "2021-06-07 08:09:10"],
    "account_status_code": ["1", " 1", "01", "0", "9", "X", "", "active", "1.0"],
    "balance_due_str": ["USD 8,482.57", "(124.07)", "$-5.00", "1,234", "--", "", "N/A", "0", "12.345", "-7.5", "$ 1 000.10", "1.2.3", "$1,000,000.00", "(0.00)"],
    "risk_flag": ["HIGH", " low ", "Y", "n", "medium", "", "??"],
    "country_code_raw": ["u.s.a.", "United  States", "Untied States", "uk", "Great Britain", "XX", "canada", "", "D E", "Australia ", "U.K.", "123"],
}


def _one_of(values: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v.replace(chr(39), chr(39) * 2)}'" for i, v in enumerate(values))
    return f"CASE c_custkey % {len(values)} {cases} END"


#: Every customer with hard values in all columns but its key.
HARD_CRM = (
    "SELECT c_custkey AS source_row_index, concat('HARD-', cast(c_custkey AS varchar(20))) AS legacy_account_id, "
    + ", ".join(f"{_one_of(values)} AS {column}" for column, values in HARD_VALUES.items()) + " FROM {customer}"
)


def hard_customers(spark: SparkSession, n: int = 100) -> DataFrame:
    """``n`` rows of hard values, of which any 100 hold every one."""
    rows = spark.range(n).withColumnRenamed("id", "c_custkey")
    return spark.sql(HARD_CRM.replace("{customer}", "{rows}"), rows=rows)


def parquet_ref(sf_dir: str, table: str) -> str:
    return f"parquet.`{sf_dir}/{table}.parquet`"


def legacy_crm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LEGACY_CRM.format(customer=parquet_ref(sf_dir, "customer"), nation=parquet_ref(sf_dir, "nation")))


def legacy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LEGACY_ORDERS.format(orders=parquet_ref(sf_dir, "orders")))


def named_dataset(spark: SparkSession, name: str, path: str) -> tuple[DataFrame, TargetSpec]:
    """A delimited file together with the shipped target specification of that name."""
    if name not in SPECS:
        raise KeyError(f"no data set {name!r}; known: {sorted(SPECS)}")
    return require_rows(read_delimited(spark, path, index="source_row_index")), SPECS[name]
