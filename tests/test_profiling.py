"""Profiles against counts made one by one, and what travels for them."""

import datetime
import random

from pyspark.sql import functions as F

from tallyform.operators import profiling


def rows(rnd, n):
    texts = [None, "", " ", "\t ", "a", "a,b", "1/2", "$5", "(1)", "123", "x" * 31, "x" * 32, "é" * 16, "y" * 40 + "-", " " * 50, "日" * 11, "z" * 33 + "123"]
    return [(rnd.choice(texts), rnd.choice([None, 7, 1234567890123456789]), rnd.choice([None, 1.5, float("nan")]), rnd.choice([None, datetime.date(2024, 1, 2)])) for _ in range(n)]


def test_profiles_of_short_and_long_values(spark):
    found = rows(random.Random(5), 400)
    got = {r.column_name: r for r in profiling.profile_columns(spark.createDataFrame(found, "t string, n bigint, d double, at date")).collect()}
    for k, name in enumerate(["t", "n", "d", "at"]):
        texts = [None if r[k] is None else {"nan": "NaN"}.get(str(r[k]), str(r[k])) for r in found]
        filled = [t for t in texts if t is not None and t.strip()]
        assert (got[name].total_records, got[name].non_null_count, got[name].distinct_count) == (400, len(filled), len(set(filled)))
        flags = [any(c(t) for t in filled) for c in (
            lambda t: "," in t, lambda t: "/" in t or "-" in t, lambda t: t.startswith("$") or "(" in t, lambda t: any(t[i : i + 3].isdigit() for i in range(len(t) - 2)))]
        assert len(got[name].patterns_detected) == sum(flags), name


def test_long_values_alone_have_their_patterns(spark):
    one = spark.createDataFrame([("y" * 40 + ",",), ("y" * 40 + ",",), ("  " * 20,)], "t string")
    r = profiling.profile_columns(one).first()
    assert (r.non_null_count, r.null_count, r.distinct_count, len(r.patterns_detected)) == (2, 1, 1, 1)


def test_short_values_are_not_digested_one_by_one(spark):
    """Marks and digests of each cell were what a profile spent its time on."""
    df = spark.range(3).select(F.col("id").cast("string").alias("t"))
    below = profiling.profile_columns(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "octet_length" in below and "AS digest" not in below


def test_sketches_take_texts_made_before(spark):
    df = spark.createDataFrame(rows(random.Random(6), 100), "t string, n bigint, d double, at date")
    kept = profiling.distinct_sketches(df)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "hll_sketch_agg(t0" in plan and "hll_sketch_agg(cast" not in plan and "hll_sketch_agg(CASE" not in plan
    exact = [len({x for x in df.select(F.col(c).cast("string")).toPandas().iloc[:, 0] if x is not None and x.strip()}) for c in df.columns]
    got = {r.position: r.distinct_estimate for r in profiling.estimated_distinct(kept).collect()}
    assert [got[i] for i in range(4)] == exact
