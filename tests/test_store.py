import json

import pytest
from pyspark.sql import functions as F

from tallyform.operators.reconcile import balance_sheet, reconcile_run, reconcile_runs
from tallyform.pipeline import RULE_NO_KEY, apply_batch, dry_run, execute
from tallyform.plans.catalogue import CUSTOMERS, CUSTOMERS_PLAN
from tallyform.plans.spec import ApprovalError, Plan, TargetSpec
from tallyform.sources.benchmark import legacy_customers
from tallyform.sources.readers import read_delimited
from tallyform.sources.store import Store, UnknownSnapshot
from tallyform.streaming.micro_batch import accepted_stream, batch_writer, start

PLAN = CUSTOMERS_PLAN.approve("tester", CUSTOMERS)


def at(n):
    return f"2024-06-01T00:00:0{n}Z"


def test_whole_run(spark, tmp_path):
    store, src = Store(spark, str(tmp_path / "t"), CUSTOMERS), legacy_customers(spark)
    with pytest.raises(ApprovalError):
        execute(store, src, CUSTOMERS_PLAN, "r0", at(0))
    assert store.target().count() == 0
    s = dry_run(store, src, PLAN, "dry", at(1))
    assert (s["accepted_count"], s["rejected_count"]) == (902, 98) and store.target().count() == 0
    pending = reconcile_run("latest", store.metrics(), store.quarantine(), store.events(), store.target(), src)
    assert (pending["run_id"], pending["verdict"], pending["quarantined_records"]) == ("dry", "PENDING_EXECUTION", 98)

    first = execute(store, src, PLAN, "r1", at(2))
    assert (first.inserted_count, first.updated_count, first.skipped_count, first.quarantined_count) == (902, 0, 0, 98)
    second = execute(store, src, PLAN, "r2", at(3))
    assert (second.inserted_count, second.updated_count, second.skipped_count) == (0, 0, 902)
    assert {r["migration_run_id"] for r in store.target().select("migration_run_id").distinct().collect()} == {"r1"}

    report = reconcile_run("latest_run", store.metrics(), store.quarantine(), store.events(), store.target(), src)
    assert report["run_id"] == "r2" and report["verdict"] == "PASSED_WITH_QUARANTINE" and len(report["details"]) == 9
    assert report["delta"] == abs(report["source_sum"] - report["target_sum"]) > 0
    unknown = reconcile_run("nope", store.metrics(), store.quarantine(), store.events(), store.target(), src)
    assert unknown["verdict"] == "PENDING_EXECUTION" and unknown["target_accepted_records"] == 0

    # a ledger that lost three rows shows
    kept = store.quarantine("r2").filter("source_row_index not in (24, 32, 39)")
    tampered = store.quarantine().filter("run_id <> 'r2'").unionByName(kept)
    bad = {r["run_id"]: r for r in reconcile_runs(store.metrics(), tampered, store.events(), store.target()).collect()}
    assert bad["r2"]["verdict"] == "DISCREPANCY_DETECTED" and bad["r2"]["unaccounted_records"] == 3
    assert bad["r1"]["verdict"] == "PASSED_WITH_QUARANTINE"

    store.export_target(str(tmp_path / "csv"))
    assert read_delimited(spark, str(tmp_path / "csv")).count() == 902
    store.export_quarantine(str(tmp_path / "bad"), "r2")
    report = read_delimited(spark, str(tmp_path / "bad"))
    first = report.orderBy(F.col("source_row_index").cast("int")).first()
    assert first["source_row_index"] == "25" and first["errors_detected"].startswith("[joined_at]: Cannot parse 'INVALID_TIMESTAMP'")
    assert json.loads(first["raw_payload"])["legacy_account_id"] == "LEGACY-CUST-00025"
    assert [r["source_row_index"] for r in store.quarantine_page("r2", 2, 1).collect()] == [32, 39]
    assert [r["natural_key"] for r in store.page(2, 1).collect()] == ["LEGACY-CUST-00002", "LEGACY-CUST-00003"]

    with pytest.raises(UnknownSnapshot):
        store.rollback(77, "r1", "tester", at(4))
    back = store.rollback(0, "r1", "tester", at(5))
    assert (back.records_removed, back.target_records_remaining) == (902, 0) and store.target().count() == 0
    verdicts = {r["run_id"]: r["verdict"] for r in reconcile_runs(store.metrics(), store.quarantine(), store.events(), store.target()).collect()}
    assert verdicts == {"r1": "ROLLED_BACK", "r2": "PASSED_WITH_QUARANTINE"}
    assert [r["event_type"] for r in store.audit_trail().collect()] == ["MIGRATION_ROLLED_BACK", "MIGRATION_RETRIED", "MIGRATION_EXECUTED", "DRY_RUN_EXECUTED"]
    store.rollback(1, "r9", "tester", at(6))
    assert store.target().count() == 902


@pytest.mark.parametrize("step", ["prepare", "write_quarantine", "record_run", "log", "commit"])
def test_a_run_lost_at_any_step_is_repeated_without_loss(spark, tmp_path, monkeypatch, step):
    store, src = Store(spark, str(tmp_path / "t"), CUSTOMERS), legacy_customers(spark, 100)

    def lost(*args, **kwargs):
        raise RuntimeError("executor lost")

    feed = batch_writer(store, PLAN, "feed", lambda: at(1))
    with monkeypatch.context() as m:
        m.setattr(store, step, lost)
        with pytest.raises(RuntimeError):
            feed(src, 0)
    assert store.target().count() == 0 and store.metrics().count() == 0
    feed(src, 0)
    feed(src, 0)
    kept, refused = store.target().count(), store.quarantine("feed_00000000").count()
    assert kept + refused == 100 and refused > 0
    run = reconcile_runs(store.metrics(), store.quarantine(), store.events(), store.target())
    assert [(r.total_source_records, r.verdict) for r in run.collect()] == [(100, "PASSED_WITH_QUARANTINE")]
    assert [r.event_type for r in store.audit_trail().collect()] == ["MIGRATION_EXECUTED"]
    sheet = {r.measure: (r.value, r.broken) for r in balance_sheet(run).collect()}
    assert sheet["read"] == (100, False) and sheet["kept"] == (kept, False) and sheet["missing"] == (0, False)


def test_latest_snapshot_never_restores_an_undone_run(spark, tmp_path):
    spec = TargetSpec.from_dict({"table_name": "t", "primary_key": "k", "fields": [{"name": "k"}, {"name": "v"}]})
    store = Store(spark, str(tmp_path / "t"), spec)
    assert store.latest_snapshot() is None
    store.snapshot("r1", at(0))
    assert store.latest_snapshot() is None
    for n in (1, 2):
        apply_batch(store, spark.createDataFrame([(0, f"k{n}", "x")], "source_row_index int, k string, v string"), f"r{n}", at(n))
    assert store.latest_snapshot() == 1 and store.target().count() == 2
    for n in (3, 4):
        store.rollback(store.latest_snapshot(), "r2", "tester", at(n))
        assert store.latest_snapshot() == 1 and store.target().count() == 1
    store.rollback(0, "r1", "tester", at(5))
    assert store.latest_snapshot() == 0


def test_rows_without_a_key_go_to_the_ledger(spark, tmp_path):
    spec = TargetSpec.from_dict({"table_name": "t", "primary_key": "k", "fields": [{"name": "k", "nullable": True}, {"name": "v"}]})
    plan = Plan.of(("k", ["k"], "DIRECT_COPY"), ("v", ["v"], "DIRECT_COPY")).approve("x", spec)
    store = Store(spark, str(tmp_path / "t"), spec)
    src = spark.createDataFrame([(0, "a", "1"), (1, None, "2"), (2, None, "3")], "source_row_index int, k string, v string")
    for n in (1, 2):
        got = execute(store, src, plan, f"r{n}", at(n))
        assert (got.inserted_count + got.skipped_count, got.quarantined_count, store.target().count()) == (1, 2, 1)
    assert {e["rule"] for r in store.quarantine("r2").collect() for e in r.errors} == {RULE_NO_KEY}


def test_stream_applies_each_batch_once(spark, tmp_path):
    src = legacy_customers(spark, 200)
    src.filter("source_row_index < 100").coalesce(1).write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "t"), CUSTOMERS)

    def run():
        stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
        start(stream, store, PLAN, "feed", str(tmp_path / "cp"), lambda: at(1)).awaitTermination()
        return store.target().count()

    first = run()
    assert first + store.quarantine().count() == 100 and run() == first
    src.filter("source_row_index >= 100").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() + store.quarantine().count() == 200
    assert store.metrics().agg(F.sum("total_source_records")).first()[0] == 200
    assert accepted_stream(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), PLAN, CUSTOMERS, "source_row_index").isStreaming


def test_money_totals_survive_amounts_that_do_not_fit(spark):
    from tallyform.operators.reconcile import money_total, target_total

    text = spark.createDataFrame([("12.50",), ("9" * 30,), (None,)], "amount string")
    assert float(money_total(text, "amount").first().total) == 12.5
    numbers = spark.createDataFrame([(1e17,), (2.5,), (1e40,)], "balance_due double")
    assert float(target_total(numbers).first().total) == 1e17 + 2.5
