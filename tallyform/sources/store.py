"""A versioned target table, its ledgers, snapshots and exports, on plain Parquet.

Rows lie in buckets by a hash of their key. A version is a manifest: for each bucket the write that made it, and that
write's folder holds the bucket's rows. A new version rewrites the buckets that changed and takes the others over, so it
costs what changed, and versions share what they have in common. Folders are never written again.

Which version is current follows from the commit log, one small file per commit, numbered without gaps. A write first
completes its folders and its manifest and only then claims the next number, by a file that must not exist: of two writers
one gets it. The other one reads what was committed meanwhile; if that changed other buckets it puts its own into the newer
manifest and claims the next number, else it is told to begin anew (``CommitConflict``). A failed job leaves the old version
current. A snapshot is the number of a version; rolling back commits its manifest again, without copying rows.

Beside the rows of a bucket lie 64-bit fingerprints of the values of its unique columns (``claims``). Whether a value may be
taken is looked up there; only buckets that hold such a fingerprint are then read.

Ledger, metrics and the audit event of a run are folders named by the run and come before its commit: a run that was lost
half way is simply repeated, and metrics count only once committed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..operators.conform import ERRORS_TYPE, ROW_INDEX
from ..operators.upsert import LINEAGE, bucket_of, empty_target, no_rows
from ..plans.spec import TargetSpec
from . import files

COMMITS = "seq bigint, version bigint, manifest string, action string, run_id string, created_at string, parent bigint, buckets bigint"
EVENTS = "seq bigint, event_id string, event_type string, actor string, table_name string, run_id string, details map<string,string>, timestamp string"
METRICS = (
    "run_id string, plan_id string, plan_version bigint, snapshot_id bigint, total_source_records bigint, "
    "inserted_count bigint, updated_count bigint, skipped_count bigint, quarantined_count bigint, timestamp string"
)
LEDGER = T.StructType(
    [
        T.StructField("quarantine_id", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField(ROW_INDEX, T.LongType()),
        T.StructField("source_natural_key", T.StringType()),
        T.StructField("source_payload", T.StringType()),
        T.StructField("errors", ERRORS_TYPE),
        T.StructField("created_at", T.StringType()),
        T.StructField("suggestion", T.StringType()),
        T.StructField("run_id", T.StringType()),
    ]
)


# Commits that made the rows of a run current.
_WRITTEN = "action = 'write' AND manifest <> ''"

BUCKET, WRITE = "__bucket", "__write"
CLAIMS = "constraint_id int, fingerprint bigint"

#: Buckets of a new store. With rows of 100 bytes, 1,024 hold 10 billion rows at 1 GB each.
BUCKETS = 16


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


class UnknownSnapshot(ValueError):
    pass


class CommitConflict(RuntimeError):
    """Another writer changed the same buckets since this write was prepared: prepare it again."""


@dataclass(frozen=True)
class View:
    """The table as one commit left it: what a run reads, whoever commits meanwhile."""

    seq: int
    version: int | None
    manifest: str
    buckets: int


@dataclass(frozen=True)
class Prepared:
    """Buckets written and not current yet."""

    write: str
    base: View
    touched: tuple[int, ...]
    present: tuple[int, ...]
    columns: dict[str, Any]


@dataclass(frozen=True)
class RolledBack:
    run_id: str
    snapshot_id: int
    records_removed: int
    target_records_remaining: int


class Store:
    """One target table under ``path``: data versions, commit log, quarantine and audit ledgers, run metrics."""

    def __init__(self, spark: SparkSession, path: str, spec: TargetSpec, buckets: int = BUCKETS):
        """``buckets`` counts for a new store only; an old one keeps the number it has."""
        self.spark, self.path, self.spec = spark, path.rstrip("/"), spec
        self._buckets = buckets

    # -- small tables -----------------------------------------------------------------------------

    def _read(self, name: str, schema: Any) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            return self.spark.createDataFrame([], schema)

    def _replace(self, folder: str, schema: str, row: tuple, *in_path: str) -> None:
        rows = self.spark.createDataFrame([row], schema).drop(*in_path).coalesce(1)
        rows.write.mode("overwrite").parquet(f"{self.path}/{folder}")

    def commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(COMMITS).json(f"{self.path}/commits")
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            return self.spark.createDataFrame([], COMMITS)

    def _commit(self, seq: int) -> dict[str, Any]:
        return json.loads(files.read_text(self.spark, f"{self.path}/commits/{seq:012d}.json"))

    def events(self) -> DataFrame:
        """The audit log. Of events written under one name, as by a repeated run, the last one counts."""
        names = _names(EVENTS)
        try:
            found = self.spark.read.schema(f"{EVENTS}, once string").json(f"{self.path}/audit")
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            return self.spark.createDataFrame([], EVENTS)
        last = found.groupBy(F.coalesce("once", F.col("event_id")).alias("name")).agg(F.max_by(F.struct(*names), "seq").alias("e"))
        return last.select("e.*")

    def metrics(self) -> DataFrame:
        """One row per committed run; what a lost run left behind is not shown."""
        done = self.commits().filter(_WRITTEN).select("run_id").distinct()
        return self._read("metrics", METRICS).join(done, "run_id", "left_semi").select(*_names(METRICS))

    def current(self) -> dict[str, Any] | None:
        """The newest commit, or None."""
        found = [n for n in files.names(self.spark, f"{self.path}/commits") if n.endswith(".json")]
        return self._commit(int(found[-1].removesuffix(".json"))) if found else None

    def view(self) -> View:
        """The table as it is now."""
        row = self.current()
        if row is None:
            return View(-1, None, "", self._buckets)
        return View(row["seq"], row["version"], row["manifest"], row["buckets"])

    # -- target -----------------------------------------------------------------------------------

    def _manifest(self, name: str) -> dict[str, Any]:
        """{"columns": schema, "writes": {bucket: write}}: as many entries as there are buckets."""
        return json.loads(files.read_text(self.spark, f"{self.path}/{name}"))

    def _rows(self, manifest: str, only: Iterable[int] | None = None) -> DataFrame:
        """Rows of a manifest, or of some of its buckets."""
        if not manifest:
            return empty_target(self.spark, self.spec)
        held = self._manifest(manifest)
        schema = T.StructType.fromJson(held["columns"])
        return self._read_buckets("data", held["writes"], schema, only)

    def _read_buckets(self, kind: str, writes: dict[str, str], schema: T.StructType, only: Iterable[int] | None) -> DataFrame:
        wanted = None if only is None else {str(b) for b in only}
        folders = [f"{self.path}/{kind}/{WRITE}={w}/{BUCKET}={b}" for b, w in writes.items() if wanted is None or b in wanted]
        if not folders:
            return no_rows(self.spark, schema)
        # a bucket that was not rewritten since a column came has nulls there
        return self.spark.read.schema(schema).parquet(*folders)

    def _written(self, number: int) -> dict[str, Any]:
        """The commit that wrote a version: its number is the version's."""
        newest = self.view().seq
        row = self._commit(number) if 0 <= number <= newest else None
        if row is None or row["action"] != "write":
            raise UnknownSnapshot(f"there is no version {number} to go back to")
        return row

    def version(self, number: int) -> DataFrame:
        return self._rows(self._written(number)["manifest"])

    def rewritten(self, number: int) -> DataFrame:
        """Rows of a version, and whether it wrote them itself (``rewritten``) or took their bucket over from one before."""
        held = self._manifest(self._written(number)["manifest"])
        schema = T.StructType.fromJson(held["columns"])
        parts = T.StructType([*schema.fields, T.StructField(WRITE, T.StringType())])
        folders = [f"{self.path}/data/{WRITE}={w}/{BUCKET}={b}" for b, w in held["writes"].items()]
        rows = self.spark.read.option("basePath", f"{self.path}/data").schema(parts).parquet(*folders)
        return rows.select(*schema.names, (F.col(WRITE) == held["write"]).alias("rewritten"))

    def target(self, only: Iterable[int] | None = None, view: View | None = None) -> DataFrame:
        """The current rows (or those of a view), or some buckets of them."""
        return self._rows((view or self.view()).manifest, only)

    def snapshot(self, run_id: str, created_at: str) -> int:
        """Number of the version a rollback would return to; the empty table is a version as well."""
        if self.view().version is None:
            self._claim(0, {"version": 0, "manifest": "", "action": "write", "run_id": run_id, "created_at": created_at, "parent": None, "buckets": self._buckets})
        return self.view().version

    def committed(self, run_id: str) -> bool:
        return not self.commits().filter(_WRITTEN).filter(F.col("run_id") == run_id).isEmpty()

    def claimed_columns(self) -> list[str]:
        """Columns no two rows may have the same value in, besides the business key: the primary key, then unique ones."""
        keys, surrogate = self.spec.keys(), self.spec.surrogate()
        unique = [f.name for f in self.spec.fields if f.unique and (f.name,) != tuple(keys) and f.name != surrogate]
        return ([surrogate] if surrogate else []) + unique

    def prepare(
        self, df: DataFrame, run_id: str, touched: Iterable[int] | None = None, view: View | None = None
    ) -> Prepared:
        """Write the rows of the buckets ``touched`` (all, by default), made from what ``view`` holds. ``commit`` makes them
        current."""
        view = view or self.view()
        write, bucket = f"{run_id}-{uuid.uuid4().hex[:12]}", bucket_of(self.spec.keys(), view.buckets)
        data, claims = (f"{self.path}/{kind}/{WRITE}={write}" for kind in ("data", "claims"))
        df.withColumn(BUCKET, bucket).repartition(F.col(BUCKET)).write.partitionBy(BUCKET).parquet(data)
        present = tuple(sorted(int(n.split("=")[1]) for n in files.names(self.spark, data) if n.startswith(f"{BUCKET}=")))
        places = [(i, c) for i, c in enumerate(self.claimed_columns()) if c in df.columns]
        if places and present:
            kept = self._read_buckets("data", {str(b): write for b in present}, df.schema, None)
            marks = F.array(*[F.struct(F.lit(i).alias("constraint_id"), fingerprint(c).alias("fingerprint")) for i, c in places])
            marked = kept.select(bucket.alias(BUCKET), F.inline(marks)).filter(F.col("fingerprint").isNotNull())
            # read by bucket, written by bucket: nothing has to move
            marked.write.partitionBy(BUCKET).parquet(claims)
        given = tuple(range(view.buckets)) if touched is None else tuple(sorted(touched))
        if not set(present) <= set(given):
            raise ValueError(f"rows outside of the buckets to be written: {sorted(set(present) - set(given))}")
        return Prepared(write, view, given, present, json.loads(df.schema.json()))

    def _claim(self, seq: int, row: dict[str, Any]) -> bool:
        """Take a place in the commit log, which somebody else may have by now."""
        return files.put_if_absent(self.spark, f"{self.path}/commits/{seq:012d}.json", json.dumps({"seq": seq, **row}))

    def commit(self, done: Prepared, run_id: str, created_at: str, attempts: int = 20) -> int:
        """Make prepared buckets current; the number of the version. The version it replaces is kept as its parent."""
        for _ in range(attempts):
            now = self.view()
            self._require_apart(done, now)
            held = self._manifest(now.manifest) if now.manifest else {"columns": {"type": "struct", "fields": []}, "writes": {}}
            writes = {b: w for b, w in held["writes"].items() if int(b) not in done.touched}
            writes.update({str(b): done.write for b in done.present})
            manifest = f"manifests/{done.write}-{now.seq + 1}.json"
            entry = {"columns": _all_fields(done.columns, held["columns"]), "writes": writes, "write": done.write, "touched": list(done.touched)}
            files.write_text(self.spark, f"{self.path}/{manifest}", json.dumps(entry))
            row = {
                "version": now.seq + 1, "manifest": manifest, "action": "write", "run_id": run_id, "created_at": created_at,
                "parent": now.version, "buckets": done.base.buckets,
            }
            if self._claim(now.seq + 1, row):
                return now.seq + 1
        raise CommitConflict(f"no place in the commit log of {self.spec.table_name} after {attempts} attempts")

    def _require_apart(self, done: Prepared, now: View) -> None:
        """Refuse if a commit since the view that ``done`` was made from is a rollback, or changed a bucket that ``done``
        changes. Where columns are unique any other write counts: it may have taken a value."""
        for seq in range(done.base.seq + 1, now.seq + 1):
            row = self._commit(seq)
            if row["action"] == "write" and not row["manifest"]:
                continue
            apart = row["action"] == "write" and not self.claimed_columns()
            if not apart or set(self._manifest(row["manifest"])["touched"]) & set(done.touched):
                raise CommitConflict(f"run {row['run_id']} changed {self.spec.table_name} meanwhile (commit {seq})")

    def write(self, df: DataFrame, run_id: str, created_at: str) -> int:
        """Replace all rows by a new version."""
        return self.commit(self.prepare(df, run_id), run_id, created_at)

    def holders(self, column: str, values: DataFrame, view: View | None = None) -> DataFrame:
        """Rows of the target that hold one of the ``values`` (one column) in a unique column.

        The fingerprints tell which buckets may hold one; only those are read, and values are compared in full.
        """
        view = view or self.view()
        if not view.manifest:
            return empty_target(self.spark, self.spec)
        held = self._manifest(view.manifest)
        folders = [f"{self.path}/claims/{WRITE}={w}/{BUCKET}={b}" for b, w in held["writes"].items()]
        claims = self.spark.read.option("basePath", f"{self.path}/claims").schema(f"{CLAIMS}, {BUCKET} int").parquet(*folders)
        name = values.columns[0]
        asked = values.select(fingerprint(name).alias("fingerprint")).distinct()
        mine = claims.filter(F.col("constraint_id") == self.claimed_columns().index(column))
        only = [r[0] for r in mine.join(asked, "fingerprint", "left_semi").select(BUCKET).distinct().collect()]
        wanted = values.select(F.col(name).cast("string").alias("__value")).distinct()
        return self._rows(view.manifest, only).join(wanted, F.col(column).cast("string") == F.col("__value"), "left_semi")

    def vacuum(self) -> list[str]:
        """Delete folders and manifests that no commit names: what lost runs and refused writers left. Nobody may be writing."""
        live = {r["manifest"] for r in self.commits().filter("manifest <> ''").select("manifest").collect()}
        writes = {f"{WRITE}={w}" for m in live for w in self._manifest(m)["writes"].values()}
        gone = [f"{kind}/{n}" for kind in ("data", "claims") for n in files.names(self.spark, f"{self.path}/{kind}") if n not in writes]
        gone += [f"manifests/{n}" for n in files.names(self.spark, f"{self.path}/manifests") if f"manifests/{n}" not in live]
        for name in gone:
            files.delete(self.spark, f"{self.path}/{name}")
        return gone

    def rollback(self, snapshot_id: int, run_id: str, actor: str, at: str, attempts: int = 20) -> RolledBack:
        row = self._written(snapshot_id)
        for _ in range(attempts):
            view = self.view()
            entry = {"version": snapshot_id, "manifest": row["manifest"], "action": "rollback", "run_id": run_id, "created_at": at, "parent": None, "buckets": row["buckets"]}
            if self._claim(view.seq + 1, entry):
                break
        else:
            raise CommitConflict(f"no place in the commit log of {self.spec.table_name} after {attempts} attempts")
        before, after = self.target(view=view).count(), self._rows(row["manifest"]).count()
        removed = max(0, before - after)
        self.log(
            fixed.MIGRATION_ROLLED_BACK, actor, run_id, at,
            {"snapshot_id": snapshot_id, "records_before_rollback": before, "records_after_rollback": after,
             "records_removed": removed},
        )
        return RolledBack(run_id, snapshot_id, removed, after)

    def latest_snapshot(self) -> int | None:
        """The version that the newest write replaced, or the current one if a rollback went further back.

        Rolling back to it never brings an undone run back. None before the first write onto a version.
        """
        newest = self.commits().filter(_WRITTEN).orderBy(F.desc("seq")).limit(1).first()
        if newest is None or newest["parent"] is None:
            return None
        return min(int(newest["parent"]), self.view().version)

    def page(self, limit: int = 50, offset: int = 0) -> DataFrame:
        return page(self.target(), self.spec.keys(), limit, offset)

    # -- ledgers ----------------------------------------------------------------------------------

    def log(
        self, event_type: str, actor: str, run_id: str, at: str, details: dict[str, Any], once: str | None = None
    ) -> int:
        """Add an event; its number. With ``once`` it replaces the event written under that name, as by a repeated run.

        Numbers are claimed like those of commits: of two writers each gets its own."""
        text = {k: str(v) for k, v in details.items()}
        while True:
            found = [n for n in files.names(self.spark, f"{self.path}/audit") if n.endswith(".json")]
            seq = int(found[-1].removesuffix(".json")) + 1 if found else 0
            row = {
                "seq": seq, "event_id": f"evt_{seq:08d}", "event_type": event_type, "actor": actor, "table_name": self.spec.table_name,
                "run_id": run_id, "details": text, "timestamp": at, "once": once,
            }
            if files.put_if_absent(self.spark, f"{self.path}/audit/{seq:012d}.json", json.dumps(row)):
                return seq

    def audit_trail(self, limit: int = 50) -> DataFrame:
        return newest_events(self.events(), limit)

    def record_run(self, row: dict[str, Any]) -> None:
        names, run_id = _names(METRICS), row["run_id"]
        self._replace(f"metrics/run_id={run_id}", METRICS, tuple(row[n] for n in names), "run_id")

    def write_quarantine(self, rows: DataFrame, run_id: str) -> None:
        """One folder per run: writing a run again replaces its rows and touches no other run."""
        rows.drop("run_id").write.mode("overwrite").parquet(f"{self.path}/quarantine/run_id={run_id}")

    def quarantine(self, run_id: str | None = None) -> DataFrame:
        """Ledger rows; a run's rows are read from its own folder only."""
        rows = self._read("quarantine", LEDGER)
        return rows if run_id is None else rows.filter(F.col("run_id") == run_id)

    def quarantine_page(self, run_id: str, limit: int = 50, offset: int = 0) -> DataFrame:
        return page(self.quarantine(run_id), [ROW_INDEX], limit, offset)

    # -- exports ----------------------------------------------------------------------------------

    def export_target(self, path: str, fmt: str = "csv") -> None:
        rows = self.target()
        if rows.isEmpty():
            raise ValueError("nothing to export: the target is empty")
        export(rows.orderBy(*self.spec.keys()), path, fmt)

    def export_quarantine(self, path: str, run_id: str) -> None:
        rows = quarantine_report(self.quarantine(run_id))
        if rows.isEmpty():
            raise ValueError("nothing to export: no refused rows of this run")
        export(rows.orderBy("source_row_index"), path, "csv")


def page(rows: DataFrame, keys: Iterable[str], limit: int = 50, offset: int = 0) -> DataFrame:
    """Some rows in order of their keys: a top-k, not a sort of the table."""
    return rows.orderBy(*keys).offset(offset).limit(limit)


def newest_events(events: DataFrame, limit: int = 50) -> DataFrame:
    """The last events, by their time and then their number."""
    time = [F.desc("timestamp")] if "timestamp" in events.columns else []
    return events.orderBy(*time, F.desc("seq")).limit(limit)


def fingerprint(column: str):
    """Of a value as text; none of null."""
    return F.when(F.col(column).isNotNull(), F.xxhash64(F.col(column).cast("string")))


def _all_fields(new: dict[str, Any], old: dict[str, Any]) -> dict[str, Any]:
    """Columns of both, lineage last: another writer may have added some since."""
    fields = {f["name"]: f for f in [*new["fields"], *old["fields"]]}
    last = [fields.pop(c) for c in LINEAGE if c in fields]
    return {"type": "struct", "fields": [*fields.values(), *last]}


def export(df: DataFrame, path: str, fmt: str = "csv", sep: str = ",") -> None:
    if fmt == "json":
        df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    else:
        # by default the writer strips the ends of every value
        keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        df.write.mode("overwrite").option("header", True).option("escape", '"').options(sep=sep, **keep).csv(path)


def quarantine_report(ledger: DataFrame) -> DataFrame:
    """The ledger flattened for people: 1-based row number and all errors in one text."""
    each = F.transform("errors", lambda e: F.concat(F.lit("["), e["field"], F.lit("]: "), e["error_message"]))
    return ledger.select(
        (F.col(ROW_INDEX) + 1).alias("source_row_index"),
        F.col("source_natural_key").alias("natural_key"),
        "run_id",
        F.concat_ws("; ", each).alias("errors_detected"),
        F.col("source_payload").alias("raw_payload"),
        "created_at",
    )
