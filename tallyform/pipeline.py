"""The whole job: conform, quarantine, upsert, record, reconcile."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import fixed
from .operators.conform import ERRORS_TYPE, ROW_INDEX, Conformed, conform
from .operators.constraints import RULE_TAKEN, taken_values
from .operators.ordered import repeats
from .operators.upsert import ConstraintError, Upsert, bucket_of, guard_not_null, guard_types, rekey_collisions
from .plans.spec import Plan
from .sources.scratch import stage
from .sources.store import CommitConflict, Prepared, Store, View


@dataclass(frozen=True)
class RunResult:
    run_id: str
    plan_id: str
    plan_version: int
    snapshot_id: int
    total_source_records: int
    inserted_count: int
    updated_count: int
    skipped_count: int
    quarantined_count: int
    timestamp: str


# Rule name of rows that satisfy every constraint but have no value in a key column.
RULE_NO_KEY = "UPSERT_KEY_IS_NULL"


# Counts of a run and the outcomes they count.
OUTCOMES = {"inserted": "insert", "updated": "update", "skipped": "skip"}


def _evaluate_once(done: Conformed, run_id: str, at: str) -> tuple[DataFrame, DataFrame]:
    """Accepted and quarantined rows of one single evaluation, written side by side.

    Both parts come from the same pass, so no row can be in neither or in both. A row without an upsert key
    cannot be found again by a later run; it is refused like a row that breaks a constraint.
    """
    row, keys = F.struct(*done.target_columns()), done.spec.keys()
    bad = done.refused() | reduce(or_, [row[k].isNull() for k in keys])
    target = F.when(~bad, row).alias("row")
    ledger = F.when(bad, F.struct(*done.quarantine_columns(run_id, at))).alias("ledger")
    both = done.frame.select(F.col(done._index).alias(ROW_INDEX), target, ledger, bad.alias("refused"))
    written = stage(both, "evaluated", ["refused"])
    accepted = written.filter(~F.col("refused")).select(ROW_INDEX, "row.*")
    refused = written.filter(F.col("refused")).select("ledger.*")
    missing = {
        "field": ", ".join(keys), "rule": RULE_NO_KEY, "severity": fixed.SEVERITY,
        "error_message": "no value to find the row by", "suggestion": "map a source column that is always filled",
    }
    entry = F.struct(
        *[F.lit(missing.get(f.name)).cast(f.dataType).alias(f.name) for f in ERRORS_TYPE.elementType.fields]
    )
    errors = F.when(F.size("errors") == 0, F.array(entry)).otherwise(F.col("errors"))
    refused = refused.withColumn("errors", errors)
    return accepted, refused.withColumn("suggestion", F.col("errors")[0]["suggestion"])


def _plan_event(store: Store, event: str, plan: Plan, by: str, at: str, **more: object) -> Plan:
    details = {"plan_id": plan.plan_id, "version": plan.version, "status": plan.status, "fingerprint": plan.fingerprint(store.spec), **more}
    store.log(event, by, "", at, details)
    return plan


def propose(store: Store, plan: Plan, by: str, at: str) -> Plan:
    """Record a new plan in the audit log."""
    return _plan_event(store, fixed.PLAN_CREATED, plan, by, at, fields=len(plan.mappings))


def revise(store: Store, before: Plan, after: Plan, by: str, at: str) -> Plan:
    """Record a changed plan: a version of its own, not approved, with the names of the fields that differ."""
    old = {m.target_field: m.canonical() for m in before.mappings}
    new = {m.target_field: m.canonical() for m in after.mappings}
    changed = sorted(f for f in old.keys() | new.keys() if old.get(f) != new.get(f))
    after = replace(after, version=before.version + 1, status="DRAFT", approval_fingerprint=None, approved_by=None)
    return _plan_event(store, fixed.PLAN_UPDATED, after, by, at, changed=",".join(changed))


def approve(store: Store, plan: Plan, by: str, at: str) -> Plan:
    """Approve a plan for the store's table, and record who did."""
    return _plan_event(store, fixed.PLAN_APPROVED, plan.approve(by, store.spec), by, at)


def dry_run(store: Store, source: DataFrame, plan: Plan, run_id: str, at: str, actor: str = "Simulator") -> dict:
    """Evaluate without writing the target; the quarantine and an audit event are kept."""
    done = conform(source, plan, store.spec)
    accepted, refused = _evaluate_once(done, run_id, at)
    store.write_quarantine(refused, run_id)
    good, bad = accepted.count(), refused.count()
    summary = {
        "run_id": run_id, "total_source_records": good + bad, "accepted_count": good, "rejected_count": bad
    }
    store.log(fixed.DRY_RUN_EXECUTED, actor, run_id, at, summary)
    return summary


def execute(
    store: Store,
    source: DataFrame,
    plan: Plan,
    run_id: str,
    at: str,
    actor: str = "Data Engineer",
    detect_changes: bool = True,
    require_approval: bool = True,
    attempts: int = 5,
) -> RunResult:
    """Run an approved plan into the store.

    ``run_id`` and ``at`` are given, so that a run can be repeated. The commit is the last step: until then the
    old version is current, and a repeated run replaces all that the lost one had written. If another run changes the
    same rows meanwhile, the upsert is done again on what that run left.
    """
    spec = store.spec
    if require_approval:
        plan.require_approved(spec)
    done = conform(source, plan, spec)
    accepted, refused = _evaluate_once(done, run_id, at)
    guard_not_null(accepted, spec)
    accepted = guard_types(accepted, spec)
    for attempt in range(attempts):
        snapshot, view = store.snapshot(run_id, at), store.view()
        good, taken = _without_taken(store, accepted, view)
        counts, prepared = prepare_batch(store, good, run_id, at, detect_changes, view)
        ledger = refused if taken is None else refused.unionByName(_taken_ledger(done, taken, run_id, at))
        store.write_quarantine(ledger, run_id)
        bad = store.quarantine(run_id).count()
        total = sum(counts.values()) + bad
        result = RunResult(
            run_id, plan.plan_id, plan.version, snapshot, total, counts["inserted_count"], counts["updated_count"],
            counts["skipped_count"], bad, at,
        )
        store.record_run(asdict(result))
        event = fixed.MIGRATION_RETRIED if result.skipped_count else fixed.MIGRATION_EXECUTED
        store.log(event, actor, run_id, at, asdict(result), once=f"run-{run_id}")
        try:
            store.commit(prepared, run_id, at)
            return result
        except CommitConflict:
            if attempt + 1 == attempts:
                raise
    raise AssertionError("unreachable")


def _without_taken(store: Store, batch: DataFrame, view: View) -> tuple[DataFrame, DataFrame | None]:
    """The batch without rows whose unique values belong to other keys, and those rows' disputed cells (None: there are none).

    The primary key is not checked here: a row whose primary key is taken gets another one."""
    surrogate = store.spec.surrogate()
    columns = [c for c in store.claimed_columns() if c != surrogate and c in batch.columns]
    if not columns:
        return batch, None
    cells = taken_values(batch, store.spec.keys(), columns, lambda c, values: store.holders(c, values, view))
    cells = stage(cells, "taken")
    if cells.isEmpty():
        return batch, None
    return batch.join(cells.select(ROW_INDEX).distinct(), ROW_INDEX, "left_anti"), cells


def _taken_ledger(done: Conformed, cells: DataFrame, run_id: str, at: str) -> DataFrame:
    """Ledger rows of accepted rows that were refused for a unique value."""
    entry = F.struct(
        F.col("column_name").alias("field"), F.lit(RULE_TAKEN).alias("rule"), F.lit(fixed.SEVERITY).alias("severity"),
        F.concat(F.lit("the value belongs to another row of the "), "taken_by").alias("error_message"),
        F.col("value").alias("raw_value"), F.lit("correct the value, or the key of one of the rows").alias("suggestion"),
    )
    errors = cells.groupBy(ROW_INDEX).agg(F.sort_array(F.collect_list(entry)).cast(ERRORS_TYPE).alias("errors"))
    rows = done.frame.select(*done.quarantine_columns(run_id, at)).drop("errors").join(errors, ROW_INDEX)
    return rows.withColumn("suggestion", F.col("errors")[0]["suggestion"])


def apply_batch(
    store: Store, batch: DataFrame, run_id: str, at: str, detect_changes: bool = True, attempts: int = 5
) -> dict[str, int]:
    """Upsert accepted rows into the store as a new version; counts of inserted, updated and skipped rows.

    There is no ledger here: a batch with a value that belongs to another key is refused as a whole."""
    batch = stage(batch, "batch")
    for attempt in range(attempts):
        view = store.view()
        _, taken = _without_taken(store, batch, view)
        if taken is not None:
            first = taken.orderBy(ROW_INDEX, "column_name").first()
            raise ConstraintError(f"UNIQUE constraint failed on {store.spec.table_name}.{first['column_name']}: {taken.count()} values")
        counts, prepared = prepare_batch(store, batch, run_id, at, detect_changes, view)
        try:
            store.commit(prepared, run_id, at)
            return counts
        except CommitConflict:
            if attempt + 1 == attempts:
                raise
    raise AssertionError("unreachable")


def prepare_batch(
    store: Store, batch: DataFrame, run_id: str, at: str, detect_changes: bool = True, view: View | None = None
) -> tuple[dict[str, int], Prepared]:
    """The outcome counts of a batch, and the buckets it changes, written but not current yet.

    Only buckets that hold a key of the batch are read, and only those in which a row is inserted or updated are written.
    """
    spec, view = store.spec, view or store.view()
    bucket = bucket_of(spec.keys(), view.buckets)
    near = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()]

    up = Upsert(store.target(near, view), batch, spec.keys(), run_id, at, spec.surrogate(), detect_changes)
    outcomes = up.actions().groupBy(bucket.alias("b"), "action").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {f"{name}_count": sum(r["n"] for r in outcomes if r["action"] == action) for name, action in OUTCOMES.items()}
    given = batch.count()
    if sum(counts.values()) != given:
        raise ConstraintError(f"{given} rows have {sum(counts.values())} outcomes in {spec.table_name}")
    changed = sorted({r["b"] for r in outcomes if r["action"] != "skip"})
    up = up.against(store.target(changed, view))
    winners = stage(up.winners().filter(bucket.isin(changed)), "winners")
    primary = spec.surrogate()
    if primary is not None:
        winners = _rekeyed(store, view, up, winners, primary)
    return counts, store.prepare(up.merged(winners), run_id, changed, view)


def _rekeyed(store: Store, view: View, up: Upsert, winners: DataFrame, primary: str) -> DataFrame:
    """Winners with the primary keys of new rows replaced where they are taken, in any bucket."""
    known = up._known().select(*up._k).join(winners.select(*up._k), up._k, "left_semi")
    new = winners.join(known, up._k, "left_anti")
    taken = store.holders(primary, new.select(primary), view)
    texts = [k for k in up._k if k.startswith("__k")]
    replaced = rekey_collisions(new, taken, primary, texts, "__first", known=repeats(winners, [primary])).filter("rekeyed")
    fresh = stage(replaced.select(*up._k, F.col(primary).alias("__new_pk")), "rekeyed")
    if fresh.isEmpty():
        return winners
    changed = winners.join(fresh, up._k, "left").withColumn(primary, F.coalesce("__new_pk", primary))
    return stage(changed.drop("__new_pk"), "winners")
