"""Every registered query against its SQL counterpart."""

import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
# The training-data operators have tests of their own.
OWN = re.compile(r"op\d+_|pipeline$")
QUERIES = {k: v for k, v in entry_module.queries().items() if not OWN.match(k)}
ORACLE = {k: v for k, v in entry_module.oracle_sql().items() if not OWN.match(k)}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple("NaN" if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order)) for r in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(df.collect(), df.columns) == plain(cursor.fetchall(), names)
