"""Derived source tables shared by the queries and their SQL counterparts. ``{x}`` are table references."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.benchmark import HARD_CRM, LEGACY_CRM, LEGACY_ORDERS, parquet_ref

# Event values as the text a careless export would hold.
TYPED_EVENTS = """
SELECT event_id AS source_row_index,
       cast(event_id AS varchar(20)) AS src_id,
       CASE WHEN event_id % 11 = 0 THEN 'forty-two' WHEN event_id % 13 = 0 THEN concat(' ', cast(user_id AS varchar(20)), ' ')
            WHEN event_id % 17 = 0 THEN '1.5' WHEN event_id % 19 = 0 THEN '' ELSE cast(user_id AS varchar(20)) END AS count_str,
       CASE WHEN event_id % 7 = 0 THEN concat('$', cast(cast(value AS decimal(18,2)) AS varchar(30)))
            WHEN event_id % 23 = 0 THEN 'nan' WHEN event_id % 29 = 0 THEN 'twelve' WHEN event_id % 31 = 0 THEN '1e3'
            ELSE cast(cast(value AS decimal(18,2)) AS varchar(30)) END AS price_str,
       CASE WHEN event_id % 5 = 0 THEN 'Yes' WHEN event_id % 5 = 1 THEN '0' WHEN event_id % 37 = 0 THEN 'maybe' ELSE ' T ' END AS active_str,
       CASE WHEN event_id % 41 = 0 THEN '2024-02-31' WHEN event_id % 43 = 0 THEN '2024/01/05' WHEN event_id % 47 = 0 THEN '2024-13-01'
            ELSE concat('2024-01-', lpad(cast(1 + event_id % 31 AS varchar(20)), 2, '0'), 'T00:00:00') END AS date_str,
       CASE WHEN event_id % 53 = 0 THEN 'noon' ELSE concat('2024-01-', lpad(cast(1 + event_id % 31 AS varchar(20)), 2, '0'), ' 10:30') END AS moment_str
FROM {events}
"""

# An activity feed that names the same account many times (one of them in a third of all rows), and the
# accounts already in the target.
ACCOUNT_BATCH = """
SELECT event_id AS source_row_index, concat('E', cast(event_id AS varchar(20))) AS account_id,
       CASE WHEN event_id % 3 = 0 THEN 'U7' ELSE concat(' U', cast(user_id AS varchar(20)), ' ') END AS account_code, event_type AS status,
       cast(event_id % 3 AS double) AS score
FROM {events}
"""
ACCOUNT_TARGET = """
SELECT concat('C', cast(c_custkey AS varchar(20))) AS account_id, concat('U', cast(c_custkey AS varchar(20))) AS account_code,
       CASE WHEN c_custkey % 2 = 0 THEN 'click' ELSE 'view' END AS status, cast(c_custkey % 3 AS double) AS score,
       'run_0' AS migration_run_id, '2024-01-01T00:00:00Z' AS migrated_at
FROM {customer} WHERE c_mktsegment <> 'HOUSEHOLD'
"""

# One run per order month: shipped orders were inserted, fulfilled ones updated, pending ones quarantined.
RUN_METRICS = """
SELECT run_id, count(*) AS total_source_records, sum(CASE WHEN s = 'O' THEN 1 ELSE 0 END) AS inserted_count,
       sum(CASE WHEN s = 'F' AND pr <> '5-LOW' THEN 1 ELSE 0 END) AS updated_count,
       sum(CASE WHEN s = 'F' AND pr = '5-LOW' THEN 1 ELSE 0 END) AS skipped_count
FROM (SELECT concat('run_', cast(year(o_orderdate) AS varchar(8)), lpad(cast(month(o_orderdate) AS varchar(8)), 2, '0')) AS run_id,
             o_orderstatus AS s, o_orderpriority AS pr FROM {orders}) o
GROUP BY run_id
"""
# The ledger lost the low-priority rows of every May, and every November has no quarantine at all.
RUN_LEDGER = """
SELECT concat('run_', cast(year(o_orderdate) AS varchar(8)), lpad(cast(month(o_orderdate) AS varchar(8)), 2, '0')) AS run_id, o_orderkey
FROM {orders}
WHERE o_orderstatus = 'P' AND NOT (month(o_orderdate) = 5 AND o_orderpriority = '5-LOW')
"""
RUN_EVENTS = """
SELECT run_id, concat('evt_', run_id) AS event_id, 'MIGRATION_EXECUTED' AS event_type, max(o_orderkey) AS seq FROM (
  SELECT concat('run_', cast(year(o_orderdate) AS varchar(8)), lpad(cast(month(o_orderdate) AS varchar(8)), 2, '0')) AS run_id, o_orderkey FROM {orders}) x
GROUP BY run_id
UNION ALL
SELECT run_id, concat('rb_', run_id) AS event_id, 'MIGRATION_ROLLED_BACK' AS event_type, max(o_orderkey) + 1 AS seq FROM (
  SELECT concat('run_', cast(year(o_orderdate) AS varchar(8)), lpad(cast(month(o_orderdate) AS varchar(8)), 2, '0')) AS run_id, o_orderkey FROM {orders}
  WHERE month(o_orderdate) = 8) y
GROUP BY run_id
"""

# Every run was simulated first; those of February stayed at that, those of an even year's August were executed again.
RUN_HISTORY = f"""
SELECT run_id, event_type, seq * 10 AS seq FROM ({RUN_EVENTS}) a WHERE run_id NOT LIKE '%02'
UNION ALL SELECT DISTINCT run_id, 'DRY_RUN_EXECUTED' AS event_type, cast(0 AS bigint) AS seq FROM ({RUN_EVENTS}) b
UNION ALL SELECT run_id, 'MIGRATION_RETRIED' AS event_type, seq * 10 + 1 AS seq FROM ({RUN_EVENTS}) c
WHERE event_type = 'MIGRATION_ROLLED_BACK' AND cast(substr(run_id, 5, 4) AS int) % 2 = 0
UNION ALL SELECT DISTINCT run_id, 'PLAN_UPDATED' AS event_type, cast(9000000000 AS bigint) AS seq FROM ({RUN_EVENTS}) d
"""
RUN_RECORDED = f"SELECT * FROM ({RUN_METRICS}) m WHERE run_id NOT LIKE '%02'"

# Codes of parts; those of parts that are multiples of 25 are there once more, for another brand.
PART_CODES = """
SELECT concat('p-', cast(p_partkey AS varchar(20))) AS code, p_brand AS brand FROM {part}
UNION ALL SELECT concat(' P-', cast(p_partkey AS varchar(20))), p_brand FROM {part} WHERE p_partkey % 2 = 0
UNION ALL SELECT concat('P-', cast(p_partkey AS varchar(20)), ' '), concat(p_brand, '-old') FROM {part} WHERE p_partkey % 25 = 0
"""

# Agents of few territories.
CUSTOMER_TERRITORIES = """
SELECT c_custkey AS source_row_index, concat('C', cast(c_custkey AS varchar(20))) AS code,
       concat(cast(c_nationkey AS varchar(20)), '-', c_mktsegment) AS territory
FROM {customer} WHERE c_mktsegment <> 'MACHINERY'
"""
SUPPLIER_TERRITORIES = """
SELECT s_suppkey AS source_row_index, concat('S', cast(s_suppkey AS varchar(20))) AS code,
       concat(cast(s_nationkey AS varchar(20)), CASE WHEN s_suppkey % 2 = 0 THEN '-MACHINERY' ELSE '-BUILDING' END) AS territory
FROM {supplier}
"""

TEXTS = {
    "crm": LEGACY_CRM, "hard": HARD_CRM, "orders_src": LEGACY_ORDERS, "typed": TYPED_EVENTS, "batch": ACCOUNT_BATCH,
    "target": ACCOUNT_TARGET, "run_metrics": RUN_METRICS, "run_ledger": RUN_LEDGER, "run_events": RUN_EVENTS,
    "run_history": RUN_HISTORY, "run_recorded": RUN_RECORDED, "part_codes": PART_CODES,
    "customer_territories": CUSTOMER_TERRITORIES, "supplier_territories": SUPPLIER_TERRITORIES,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or one of the given ones."""
    if name not in TEXTS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needed = set(re.findall(r"\{(\w+)\}", TEXTS[name]))
    return spark.sql(TEXTS[name].format(**{t: parquet_ref(sf_dir, t) for t in needed}))


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table whose rows are about to be mapped."""
    return table(spark, sf_dir, name)


def plain(name: str) -> str:
    """The same text for an engine in which the given tables are views."""
    return re.sub(r"\{(\w+)\}", r"\1", TEXTS[name])
