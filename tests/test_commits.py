"""Commits of several writers, versions that share buckets, and values that must be unique."""

import random

import pytest
from pyspark.sql import functions as F

from tallyform.operators.upsert import ConstraintError
from tallyform.pipeline import apply_batch, execute, prepare_batch
from tallyform.plans.spec import Plan, TargetSpec
from tallyform.sources import files
from tallyform.sources.store import CommitConflict, Store

PLAIN = TargetSpec.from_dict({"table_name": "t", "natural_key": "k", "fields": [{"name": "k"}, {"name": "v"}]})
UNIQUE = TargetSpec.from_dict(
    {"table_name": "t", "natural_key": "k", "primary_key": "id", "fields": [
        {"name": "id"}, {"name": "k"}, {"name": "a", "constraints": {"unique": True}}, {"name": "b", "type": "int", "constraints": {"unique": True}}]}
)
BATCH = "source_row_index long, k string, v string"


def batch(spark, *pairs):
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(pairs)], BATCH)


def rows(store):
    return {r.k: r.v for r in store.target().collect()}


def bucket_of_key(store, k):
    from tallyform.operators.upsert import bucket_of

    return store.spark.createDataFrame([(k,)], "k string").select(bucket_of(["k"], store.view().buckets)).first()[0]


def test_a_file_is_put_once(spark, tmp_path):
    path = f"{tmp_path}/x/one"
    assert files.put_if_absent(spark, path, "first") and not files.put_if_absent(spark, path, "second")
    assert files.read_text(spark, path) == "first" and files.names(spark, f"{tmp_path}/x") == ["one"]


def test_two_writers_of_different_buckets_are_both_kept(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), PLAIN, buckets=32)
    apply_batch(store, batch(spark, *((f"k{i}", "old") for i in range(40))), "r0", "t0")
    apart = next(k for k in (f"k{i}" for i in range(1, 40)) if bucket_of_key(store, k) != bucket_of_key(store, "k0"))
    view = store.view()
    one = prepare_batch(store, batch(spark, ("k0", "one")), "r1", "t1", view=view)[1]
    two = prepare_batch(store, batch(spark, (apart, "two")), "r2", "t2", view=view)[1]
    assert (store.commit(one, "r1", "t1"), store.commit(two, "r2", "t2")) == (1, 2)
    after = rows(store)
    assert (after["k0"], after[apart], len(after)) == ("one", "two", 40)
    assert {r.k: r.v for r in store.version(1).collect()}[apart] == "old"
    log = store.commits().orderBy("seq").collect()
    assert [(r.seq, r.version, r.run_id, r.parent) for r in log] == [(0, 0, "r0", None), (1, 1, "r1", 0), (2, 2, "r2", 1)]


def test_two_writers_of_one_bucket(spark, tmp_path):
    """The second is refused; done again on what the first left, neither's rows are lost."""
    store = Store(spark, str(tmp_path / "t"), PLAIN, buckets=1)
    apply_batch(store, batch(spark, ("a", "0"), ("b", "0")), "r0", "t0")
    view = store.view()
    one = prepare_batch(store, batch(spark, ("a", "1")), "r1", "t1", view=view)[1]
    two = prepare_batch(store, batch(spark, ("b", "2")), "r2", "t2", view=view)[1]
    store.commit(one, "r1", "t1")
    with pytest.raises(CommitConflict):
        store.commit(two, "r2", "t2")
    assert rows(store) == {"a": "1", "b": "0"} and store.view().seq == 1
    gone = store.vacuum()
    assert gone == [f"data/__write={two.write}"] and rows(store) == {"a": "1", "b": "0"}


def test_a_run_goes_on_when_another_commits_first(spark, tmp_path, monkeypatch):
    store, other = (Store(spark, str(tmp_path / "t"), PLAIN, buckets=1) for _ in range(2))
    apply_batch(store, batch(spark, ("a", "0"), ("b", "0")), "r0", "t0")
    plan = Plan.of(("k", ["k"], "DIRECT_COPY"), ("v", ["v"], "DIRECT_COPY")).approve("x", PLAIN)
    claim, met = store._claim, []

    def claim_late(seq, row):
        if not met:
            met.append(apply_batch(other, batch(spark, ("b", "9"), ("c", "9")), "r1", "t1"))
        return claim(seq, row)

    monkeypatch.setattr(store, "_claim", claim_late)
    done = execute(store, batch(spark, ("a", "2"), ("c", "2")), plan, "r2", "t2")
    assert rows(store) == {"a": "2", "b": "9", "c": "2"}
    assert (done.inserted_count, done.updated_count) == (0, 2) and done.snapshot_id == 1
    assert [r.version for r in store.commits().orderBy("seq").collect()] == [0, 1, 2]


def test_a_rollback_meanwhile_refuses_the_write(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), PLAIN, buckets=8)
    apply_batch(store, batch(spark, ("a", "0")), "r0", "t0")
    apply_batch(store, batch(spark, ("b", "1")), "r1", "t1")
    late = prepare_batch(store, batch(spark, ("c", "2")), "r2", "t2")[1]
    assert store.rollback(0, "r1", "me", "t3").records_removed == 1
    with pytest.raises(CommitConflict):
        store.commit(late, "r2", "t2")
    assert rows(store) == {"a": "0"}


def test_versions_share_buckets_and_columns_may_come(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), PLAIN, buckets=16)
    apply_batch(store, batch(spark, *((f"k{i}", "old") for i in range(64))), "r0", "t0")
    counts = apply_batch(store, batch(spark, ("k1", "new"), ("k2", "old")), "r1", "t1")
    assert counts == {"inserted_count": 0, "updated_count": 1, "skipped_count": 1}
    written = store.rewritten(1)
    only = {bucket_of_key(store, r.k) for r in written.filter("rewritten").collect()}
    assert only == {bucket_of_key(store, "k1")} and written.count() == 64
    wider = spark.createDataFrame([(0, "k5", "old", 7)], BATCH + ", extra int")
    apply_batch(store, wider, "r2", "t2")
    assert {r.k: r.extra for r in store.target().collect() if r.extra is not None} == {"k5": 7}
    assert "extra" not in store.version(1).columns and store.target().columns[-2:] == ["migration_run_id", "migrated_at"]
    nothing = apply_batch(store, batch(spark, ("k1", "new")), "r3", "t3")
    assert nothing["skipped_count"] == 1 and store.rewritten(3).filter("rewritten").count() == 0 and store.target().count() == 64


def brute_unique(target, incoming):
    """Row by row, with all claims made before: which rows are refused."""
    claims = {}
    for c in ("a", "b"):
        for key, row in target.items():
            if row[c] is not None:
                claims.setdefault((c, str(row[c])), key)
    for row in incoming:
        for c in ("a", "b"):
            if row[c] is not None:
                claims.setdefault((c, str(row[c])), row["k"].strip())
    return {row["source_row_index"] for row in incoming if any(row[c] is not None and claims[(c, str(row[c]))] != row["k"].strip() for c in ("a", "b"))}


def test_unique_values_against_brute_force(spark, tmp_path):
    rnd = random.Random(4)
    store = Store(spark, str(tmp_path / "t"), UNIQUE, buckets=4)
    fields = ("id", "k", "a", "b")
    plan = Plan.of(*((f, [f], "DIRECT_COPY") for f in fields)).approve("x", UNIQUE)
    known = {}
    for run in range(3):
        incoming = [
            {"source_row_index": i, "id": f"id{rnd.randint(0, 60)}", "k": f"{' ' * rnd.randint(0, 1)}k{rnd.randint(0, 25)}",
             "a": rnd.choice([None, "hot", *(f"a{n}" for n in range(30))]), "b": rnd.choice([None, *range(40)])} for i in range(40)
        ]
        df = spark.createDataFrame([tuple(r.values()) for r in incoming], "source_row_index long, id string, k string, a string, b long")
        want = brute_unique(known, incoming)
        done = execute(store, df, plan, f"r{run}", f"t{run}")
        ledger = store.quarantine(f"r{run}").collect()
        assert {r.source_row_index for r in ledger} == want and want
        assert {e.rule for r in ledger for e in r.errors} == {"UNIQUE"} and done.quarantined_count == len(want)
        for r in incoming:
            if r["source_row_index"] not in want:
                known[r["k"].strip()] = {"a": r["a"], "b": r["b"]}
        got = store.target().collect()
        assert {r.k: {"a": r.a, "b": r.b} for r in got} == known
        assert len({r.id for r in got}) == len(got)
        held = [r.a for r in got if r.a is not None]
        assert len(set(held)) == len(held)


def test_a_batch_without_ledger_is_refused_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), UNIQUE, buckets=4)
    df = spark.createDataFrame([(0, "i1", "k1", "x", 1), (1, "i2", "k2", "x", 2)], "source_row_index long, id string, k string, a string, b long")
    with pytest.raises(ConstraintError, match=r"t\.a: 1 values"):
        apply_batch(store, df, "r0", "t0")
    assert store.target().count() == 0
    assert apply_batch(store, df.withColumn("a", F.col("k")), "r0", "t0")["inserted_count"] == 2
