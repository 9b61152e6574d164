"""Upserts against a row-by-row loop over a small fixture."""

import random

import pytest

from tallyform import TargetSpec, Upsert
from tallyform.operators import ordered
from tallyform.operators.ordered import previous_in_key
from tallyform.operators.upsert import (
    ConstraintError, empty_target, guard_not_null, guard_types, rekey_collisions, version_diff, violations,
)
from pyspark.sql import functions as F


def by_hand(target, batch, detect):
    """One row after the other; the target maps key -> (pk, a, b, run)."""
    state, actions = dict(target), []
    for _, pk, key, a, b in batch:
        key = key.strip()
        old = state.get(key)
        if old is None:
            state[key] = (pk, a, b, "new")
            actions.append("insert")
        elif not detect or (old[1], old[2] or 0.0) != (a, b or 0.0):
            state[key] = (old[0], a, b, "new")
            actions.append("update")
        else:
            actions.append("skip")
    return state, actions


@pytest.mark.parametrize("detect", [True, False])
@pytest.mark.parametrize("bits", [2, 20])
def test_matches_the_loop(spark, detect, bits):
    rng = random.Random(bits)
    target = {f"K{i}": (f"p{i}", rng.choice("xy"), rng.choice([None, 0.0, 1.0]), "old") for i in range(20)}
    batch = []
    for i in range(600):
        key = "K3" if rng.random() < 0.4 else f" K{rng.randint(0, 40)} "  # one key holds over a third
        batch.append((i, f"q{i}", key, rng.choice("xy"), rng.choice([None, 0.0, 1.0])))
    t = spark.createDataFrame([(v[0], k, v[1], v[2], v[3], "t0") for k, v in target.items()], "pk string, key string, a string, b double, migration_run_id string, migrated_at string")
    b = spark.createDataFrame(batch, "source_row_index long, pk string, key string, a string, b double").repartition(5)
    up = Upsert(t, b, ["key"], "new", "t1", "pk", detect, block_bits=bits)
    state, actions = by_hand(target, batch, detect)
    got = {r["source_row_index"]: r["action"] for r in up.actions().collect()}
    assert [got[i] for i in range(600)] == actions
    c = up.counts().first()
    assert sum(c) == 600 and c["inserted_count"] == actions.count("insert")
    assert up.merged().count() == len(state)
    merged = {r["key"]: r for r in up.merged().collect()}
    assert set(merged) == set(state)
    for k, (pk, a, b_, run) in state.items():
        assert (merged[k]["pk"], merged[k]["a"], merged[k]["migration_run_id"]) == (pk, a, run), k
        assert (merged[k]["b"] or 0.0) == (b_ or 0.0)


def test_twice_is_once(spark):
    b = spark.createDataFrame([(0, "1", "A", 1.0), (1, "2", "B", 2.0)], "source_row_index long, pk string, key string, v double")
    empty = spark.createDataFrame([], "pk string, key string, v double, migration_run_id string, migrated_at string")
    once = Upsert(empty, b, ["key"], "r1", "t1", "pk").merged()
    again = Upsert(once, b, ["key"], "r2", "t2", "pk")
    assert tuple(again.counts().first()) == (0, 0, 2)
    assert again.merged().exceptAll(once).count() == 0 and once.exceptAll(again.merged()).count() == 0


def test_new_columns_and_composite_keys(spark):
    t = spark.createDataFrame([("A", 1, "x", "r0", "t0")], "k1 string, k2 int, v string, migration_run_id string, migrated_at string")
    b = spark.createDataFrame([(0, "A", 1, "x", "new"), (1, "A", 2, "y", "n2")], "source_row_index long, k1 string, k2 int, v string, extra string")
    up = Upsert(t, b, ["k1", "k2"], "r1", "t1")
    assert tuple(up.counts().first()) == (1, 1, 0)
    assert sorted(tuple(r) for r in up.merged().collect()) == [("A", 1, "x", "new", "r1", "t1"), ("A", 2, "y", "n2", "r1", "t1")]


def test_previous_in_key_over_blocks(spark):
    rows = [(i, "hot" if i % 3 else f"k{i % 7}", i * 10) for i in range(500)]
    df = spark.createDataFrame(rows, "pos long, key string, v long").repartition(7)
    got = {r["pos"]: r["previous"] for r in previous_in_key(df, ["key"], "pos", F.col("v"), bits=3).collect()}
    last, want = {}, {}
    for pos, key, v in rows:
        want[pos] = last.get(key)
        last[key] = v
    assert got == want


@pytest.mark.parametrize("few", [0, 3, 1 << 17])
def test_previous_in_key_however_many_keys_repeat(spark, monkeypatch, few):
    monkeypatch.setattr(ordered, "FEW_REPEATS", few)
    rows = [(i, None if i % 9 == 0 else "hot" if i % 4 == 0 else "twice" if i in (5, 150) else f"k{i}", i * 10) for i in range(200)]
    df = spark.createDataFrame(rows, "pos long, key string, v long").repartition(7)
    found = previous_in_key(df, ["key"], "pos", F.col("v")).collect()
    got = {r["pos"]: (r["previous"], r["previous_found"]) for r in found}
    last, want = {}, {}
    for pos, key, v in rows:
        want[pos] = (last.get(key), key in last)
        last[key] = v
    assert got == want and len(found) == 200


def test_rows_of_a_first_load_are_not_moved(spark):
    spec = TargetSpec.from_dict({"table_name": "t", "natural_key": "key", "fields": [{"name": "pk"}, {"name": "key"}, {"name": "v", "data_type": "float"}]})
    b = spark.createDataFrame([(i, f"p{i}", f"K{i}", float(i)) for i in range(50)], "source_row_index long, pk string, key string, v double")
    up = Upsert(empty_target(spark, spec), b, ["key"], "r1", "t1", "pk")
    for rows in (up.actions(), up.winners(), up.merged()):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert not any(step in plan for step in ("Join", "Window", "Aggregate")), plan
    assert tuple(up.counts().first()) == (50, 0, 0)
    assert sorted(r["key"] for r in up.merged().collect()) == sorted(f"K{i}" for i in range(50))


SPEC = TargetSpec.from_dict(
    {"table_name": "s", "primary_key": "id", "natural_key": "code", "fields": [
        {"name": "id", "nullable": False}, {"name": "code", "nullable": False, "constraints": {"unique": True}},
        {"name": "amount", "data_type": "float", "nullable": False, "constraints": {"enum": [1.0, 2.0]}}]}
)


def test_write_guards(spark):
    with pytest.raises(ConstraintError, match="NOT NULL constraint failed"):
        guard_not_null(spark.createDataFrame([("1", "C", None)], "id string, code string, amount double"), SPEC)
    with pytest.raises(ConstraintError, match="NOT NULL constraint failed"):
        guard_not_null(spark.createDataFrame([("1", "C")], "id string, code string"), SPEC)
    guard_not_null(spark.createDataFrame([(None, "C", 1.0)], "id string, code string, amount double"), SPEC)
    with pytest.raises(ConstraintError, match="Data type constraint violation"):
        guard_types(spark.createDataFrame([("1", "C", "not-a-number")], "id string, code string, amount string"), SPEC)
    assert guard_types(spark.createDataFrame([("1", "C", "$1,200.5")], "id string, code string, amount string"), SPEC).first()["amount"] == 1200.5


def test_constraints(spark):
    df = spark.createDataFrame([("1", "C", 1.0), ("1", "D", 3.0), ("2", "D", None)], "id string, code string, amount double")
    got = {(r["column_name"], r["constraint"]): r["violations"] for r in violations(df, SPEC).collect()}
    assert got == {("amount", "NOT NULL"): 1, ("amount", "ENUM"): 1, ("id", "UNIQUE"): 1, ("code", "UNIQUE"): 1}


def test_rekey(spark):
    rows = spark.createDataFrame([(0, "p", "a"), (1, "p", "b"), (2, "q", "c"), (3, None, "d"), (4, "p", "e")], "pos long, pk string, key string")
    target = spark.createDataFrame([("q",)], "pk string")
    got = {r["key"]: r for r in rekey_collisions(rows, target, "pk", ["key"], "pos", 1).collect()}
    assert {k: r["rekeyed"] for k, r in got.items()} == {"a": False, "b": True, "c": True, "d": False, "e": True}
    assert len({r["pk"] for r in got.values()}) == 5


def test_version_diff(spark):
    before = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    after = spark.createDataFrame([("a", 1), ("b", 5), ("d", 4)], "k string, v int")
    assert {tuple(r) for r in version_diff(before, after, ["k"]).collect()} == {("b", "changed"), ("c", "removed"), ("d", "added")}


def test_taken_primary_keys_are_replaced_in_the_store(spark, tmp_path):
    from tallyform.pipeline import apply_batch
    from tallyform.sources.store import Store

    spec = TargetSpec.from_dict(
        {"table_name": "s", "primary_key": "id", "natural_key": "code", "fields": [{"name": "id"}, {"name": "code"}, {"name": "v"}]}
    )
    store = Store(spark, str(tmp_path / "s"), spec)
    ddl = "source_row_index long, id string, code string, v string"
    assert apply_batch(store, spark.createDataFrame([(0, "p", "A", "1"), (1, "p", "B", "1")], ddl), "r1", "t1")["inserted_count"] == 2
    got = apply_batch(store, spark.createDataFrame([(0, "p", "C", "1"), (1, "zz", "A", "2")], ddl), "r2", "t2")
    assert got == {"inserted_count": 1, "updated_count": 1, "skipped_count": 0}
    rows = {r["code"]: r for r in store.target().collect()}
    assert rows["A"]["id"] == "p" and rows["A"]["v"] == "2" and len({r["id"] for r in rows.values()}) == 3


def test_null_keys_types_and_repeated_target_keys(spark):
    batch = spark.createDataFrame([(0, None, "5"), (1, None, "6"), (2, "k1", "7")], "source_row_index int, key string, n string")
    target = spark.createDataFrame([("k1", 7), (" k1 ", 7)], "key string, n bigint")
    up = Upsert(target, batch, ["key"], "r1", "t1")
    assert {r.source_row_index: r.action for r in up.actions().collect()} == {0: "insert", 1: "update", 2: "skip"}
    once = up.merged()
    assert sorted((r.key or "", r.n) for r in once.collect()) == [("", 6), (" k1 ", 7), ("k1", 7)]
    again = Upsert(once, batch, ["key"], "r2", "t2")
    assert again.merged().count() == 3


def test_primary_key_of_two_columns(spark):
    spec = TargetSpec.from_dict({"table_name": "t", "primary_key": ["a", "b"], "fields": [{"name": "a"}, {"name": "b"}]})
    rows = spark.createDataFrame([(1, "x"), (1, "y")], "a int, b string")
    assert violations(rows, spec).count() == 0
    assert [tuple(r) for r in violations(rows.union(rows.limit(1)), spec).collect()] == [("a, b", "UNIQUE", 1)]
