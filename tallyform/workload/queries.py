"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codes, profiling, reconcile, remediate, suggest
from ..operators.conform import apply_rule, conform
from ..operators.upsert import (
    Upsert, add_columns, duplicate_keys, missing_values, rekey_collisions, unreadable_numbers, version_diff, violations,
)
from ..pipeline import apply_batch, approve, dry_run, execute, propose, revise
from ..plans.catalogue import CUSTOMERS, CUSTOMERS_PLAN, ORDERS, ORDERS_PLAN
from ..plans.spec import Plan, TargetSpec
from ..sources import readers
from ..sources.row_index import with_row_index
from ..sources.scratch import scratch_path
from ..sources.store import Store, export, newest_events, page, quarantine_report
from .sources_sql import source, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
RUN, AT = "run_1", "2024-06-01T00:00:00Z"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# -- rules ------------------------------------------------------------------------------------------------

RULE_CASES: dict[str, tuple[str, str, list[str], dict[str, Any]]] = {
    "rule_direct_copy": ("crm", "DIRECT_COPY", ["account_status_code"], {"required": True}),
    "rule_trim_clean": ("crm", "TRIM_CLEAN", ["full_name_raw"], {"required": True}),
    "rule_concat_ws": ("crm", "CONCAT_WS", ["full_name_raw", "country_code_raw"], {"separator": " | ", "required": True}),
    "rule_split_first": ("crm", "SPLIT_NAME", ["full_name_raw"], {"part": "first", "required": True}),
    "rule_split_last": ("crm", "SPLIT_NAME", ["full_name_raw"], {"part": "last", "required": True}),
    "rule_date_iso": ("crm", "DATE_TO_ISO8601", ["signup_date_str"], {"required": True}),
    "rule_date_iso_orders": ("orders_src", "DATE_TO_ISO8601", ["date_placed"], {}),
    "rule_phone_e164": ("crm", "PHONE_TO_E164", ["phone_raw"], {"required": True}),
    "rule_phone_null_on_invalid": ("crm", "PHONE_TO_E164", ["phone_raw"], {"on_invalid": "null"}),
    "rule_email": ("crm", "EMAIL_NORMALIZE", ["email_address"], {"required": True}),
    "rule_currency": ("crm", "CLEAN_CURRENCY_TO_FLOAT", ["balance_due_str"], {}),
    "rule_currency_orders": ("orders_src", "CLEAN_CURRENCY_TO_FLOAT", ["order_total_str"], {"default": 0.0}),
    "rule_enum": ("crm", "ENUM_LOOKUP", ["risk_flag"], {"mapping": {"HIGH": "CRITICAL", "Y": "ELEVATED", "N": "STANDARD", "LOW": "STANDARD"}, "fallback": "STANDARD"}),
    "rule_enum_strict": ("crm", "ENUM_LOOKUP", ["account_status_code"], {"mapping": {"1": "ACTIVE", "0": "INACTIVE", "9": "TERMINATED"}, "required": True}),
    "rule_country": ("crm", "COUNTRY_TO_ISO2", ["country_code_raw"], {}),
    "rule_coalesce": ("crm", "COALESCE_VAL", ["account_status_code"], {"default": "MISSING"}),
    "rule_uuid_v5": ("crm", "UUID_V5_FROM_KEY", ["legacy_account_id"], {"namespace": "modern-customer-store.prod", "required": True}),
    "rule_unknown": ("crm", "LITERAL_VALUE", ["risk_flag"], {}),
}


def _rule_query(name: str) -> Query:
    origin, rule, fields, params = RULE_CASES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return apply_rule(source(spark, sf_dir, origin), rule, fields, params).select("source_row_index", "value", "error")

    return run


for _name in RULE_CASES:
    QUERIES[_name] = _rule_query(_name)


@query
def rule_trim_clean_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return apply_rule(docs, "TRIM_CLEAN", "text").select("doc_id", "value")


# -- conform ----------------------------------------------------------------------------------------------


def _crm(spark, sf_dir):
    return conform(source(spark, sf_dir, "crm"), CUSTOMERS_PLAN, CUSTOMERS)


def _orders(spark, sf_dir):
    return conform(source(spark, sf_dir, "orders_src"), ORDERS_PLAN, ORDERS)


@query
def conform_accepted(spark, sf_dir):
    return _crm(spark, sf_dir).accepted()


@query
def conform_quarantine(spark, sf_dir):
    rows = _crm(spark, sf_dir).quarantine(RUN, AT)
    return rows.select(
        "quarantine_id", "table_name", "run_id", "source_row_index", "source_natural_key", "source_payload",
        F.size("errors").alias("error_count"), F.col("errors")[0]["field"].alias("first_field"), "suggestion", "created_at",
    )


@query
def conform_evidence(spark, sf_dir):
    return _crm(spark, sf_dir).evidence()


@query
def conform_summary(spark, sf_dir):
    return _crm(spark, sf_dir).summary()


@query
def errors_by_field(spark, sf_dir):
    return _crm(spark, sf_dir).errors_by("field")


@query
def errors_by_field_rule(spark, sf_dir):
    return _crm(spark, sf_dir).errors_by("field", "rule")


@query
def quarantine_preview(spark, sf_dir):
    return _crm(spark, sf_dir).preview(RUN, AT, 200).select("quarantine_id", "source_row_index", "source_natural_key")


@query
def quarantine_export(spark, sf_dir):
    return quarantine_report(_crm(spark, sf_dir).quarantine(RUN, AT)).drop("raw_payload")


@query
def diagnosis_text(spark, sf_dir):
    e = _crm(spark, sf_dir).evidence()
    text = remediate.diagnosis(F.col("field"), F.col("rule"), F.col("error_message"), F.col("raw_value"))
    return e.select("source_row_index", "field", text.alias("diagnosis"))


@query
def orders_accepted(spark, sf_dir):
    return _orders(spark, sf_dir).accepted()


@query
def orders_summary(spark, sf_dir):
    return _orders(spark, sf_dir).summary()


@query
def orders_errors_by_field_rule(spark, sf_dir):
    return _orders(spark, sf_dir).errors_by("field", "rule")


@query
def natural_key_derivation(spark, sf_dir):
    """Composite key from two mapped columns; where both are blank the next well-known column, then the position."""
    spec = TargetSpec.from_dict({"table_name": "keyed", "natural_key": "natural_key", "fields": [{"name": "natural_key"}]})
    plan = Plan.of(("natural_key", ["order_num", "status_cd"], "CONCAT_WS", {"separator": "_"}))
    return conform(table(spark, sf_dir, "orders_src"), plan, spec).status().select("source_row_index", "natural_key")


@query
def loose_columns(spark, sf_dir):
    """Source columns named in another case and with dashes still resolve."""
    src = table(spark, sf_dir, "orders_src").withColumnsRenamed({"order_num": "ORDER-NUM", "date_placed": "Date-Placed"})
    spec = TargetSpec.from_dict({"table_name": "loose", "natural_key": "order_num", "fields": [{"name": "order_num"}, {"name": "placed"}]})
    plan = Plan.of(("order_num", ["order_num"], "TRIM_CLEAN"), ("placed", ["date_placed"], "DIRECT_COPY"))
    return conform(src, plan, spec).accepted()


TYPED_SPEC = TargetSpec.from_dict(
    {
        "table_name": "typed_events", "natural_key": "src_id",
        "fields": [
            {"name": "src_id", "data_type": "string", "nullable": False},
            {"name": "item_count", "type": "int"}, {"name": "unit_price", "data_type": "float"},
            {"name": "is_active", "data_type": "bool"}, {"name": "created_date", "data_type": "date"},
            {"name": "created_at", "data_type": "timestamp"},
        ],
    }
)
TYPED_PLAN = Plan.of(
    ("src_id", ["src_id"], "DIRECT_COPY"), ("item_count", ["count_str"], "TRIM_CLEAN"),
    ("unit_price", ["price_str"], "DIRECT_COPY"), ("is_active", ["active_str"], "DIRECT_COPY"),
    ("created_date", ["date_str"], "DIRECT_COPY"), ("created_at", ["moment_str"], "DIRECT_COPY"),
)


@query
def type_coercion_accepted(spark, sf_dir):
    return conform(source(spark, sf_dir, "typed"), TYPED_PLAN, TYPED_SPEC).accepted()


@query
def type_coercion_report(spark, sf_dir):
    e = conform(source(spark, sf_dir, "typed"), TYPED_PLAN, TYPED_SPEC).evidence()
    return e.select("source_row_index", "field", "rule", "error_message")


@query
def required_unmapped(spark, sf_dir):
    spec = TargetSpec.from_dict(
        {"table_name": "orders", "natural_key": "order_num",
         "fields": [{"name": "order_num", "nullable": False}, {"name": "warehouse", "nullable": False}, {"name": "note"}]}
    )
    plan = Plan.of(("order_num", ["order_id"], "TRIM_CLEAN"))
    return conform(table(spark, sf_dir, "orders_src"), plan, spec).evidence().select("source_row_index", "natural_key", "field", "rule", "error_message")


@query
def constraint_checks(spark, sf_dir):
    """NOT NULL with and without substitute, enum with and without substitute, regex refused and nulled."""
    def f(name, nullable=True, **c):
        return {"name": name, "nullable": nullable, "constraints": c}

    spec = TargetSpec.from_dict(
        {"table_name": "checks", "natural_key": "legacy_account_id", "fields": [
            f("status_required", False), f("status_filled", False), f("risk", enum=["HIGH", "LOW", "N"]),
            f("risk_filled", enum=["HIGH", "LOW", "N"]), f("phone", regex=r"^\+1\d+$"), f("phone_or_null", regex=r"^\+1\d+$"),
        ]}
    )
    plan = Plan.of(
        ("status_required", ["account_status_code"], "TRIM_CLEAN"),
        ("status_filled", ["account_status_code"], "TRIM_CLEAN", {"fallback": "1"}),
        ("risk", ["risk_flag"], "DIRECT_COPY"), ("risk_filled", ["risk_flag"], "DIRECT_COPY", {"fallback_enum": "N"}),
        ("phone", ["phone_raw"], "DIRECT_COPY"), ("phone_or_null", ["phone_raw"], "DIRECT_COPY", {"null_on_invalid": True}),
    )
    done = conform(table(spark, sf_dir, "crm"), plan, spec)
    picked = [done.field_value(n).alias(n) for n in ("status_filled", "risk_filled", "phone_or_null")]
    rules = [done.field_rule(n).alias(n + "_rule") for n in ("status_required", "risk", "phone")]
    return done.frame.select("source_row_index", *picked, *rules)


# -- profiling --------------------------------------------------------------------------------------------

CRM_COLUMNS = [
    "legacy_account_id", "full_name_raw", "email_address", "phone_raw", "signup_date_str", "account_status_code",
    "balance_due_str", "risk_flag", "country_code_raw",
]


def _flat_profile(df: DataFrame) -> DataFrame:
    return df.withColumn("patterns_detected", F.concat_ws("; ", "patterns_detected"))


@query
def profile_crm(spark, sf_dir):
    return _flat_profile(profiling.profile_columns(table(spark, sf_dir, "crm"), CRM_COLUMNS))


@query
def profile_documents(spark, sf_dir):
    return _flat_profile(profiling.profile_columns(table(spark, sf_dir, "documents"), ["text", "lang", "source", "n_chars"]))


@query
def profile_orders(spark, sf_dir):
    return _flat_profile(profiling.profile_columns(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]))


@query
def profile_top_values(spark, sf_dir):
    return profiling.top_values(table(spark, sf_dir, "crm"), 10, CRM_COLUMNS)


@query
def profile_top_values_first_seen(spark, sf_dir):
    return profiling.top_values(table(spark, sf_dir, "crm"), 10, CRM_COLUMNS, "source_row_index")


@query
def profile_sample_values(spark, sf_dir):
    return profiling.sample_values(table(spark, sf_dir, "crm"), 8, CRM_COLUMNS)


@query
def infer_schema_crm(spark, sf_dir):
    return profiling.infer_schema(table(spark, sf_dir, "crm"), CRM_COLUMNS)


@query
def infer_schema_lineitem(spark, sf_dir):
    src = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("decimal(18,2)").alias("l_quantity"), "l_returnflag")
    return profiling.infer_schema(src)


@query
def rule_trial(spark, sf_dir):
    src = table(spark, sf_dir, "crm")
    trials = [
        profiling.rule_trial(src, c, r, p)
        for c, r, p in (("signup_date_str", "DATE_TO_ISO8601", {}), ("phone_raw", "PHONE_TO_E164", {}), ("email_address", "EMAIL_NORMALIZE", {}))
    ]
    return trials[0].unionByName(trials[1]).unionByName(trials[2])


@query
def rule_trial_errors(spark, sf_dir):
    return profiling.rule_errors(table(spark, sf_dir, "crm"), "email_address", "EMAIL_NORMALIZE", {})


@query
def head_sample(spark, sf_dir):
    return readers.head_sample(table(spark, sf_dir, "orders_src"), 100)


# -- upsert -----------------------------------------------------------------------------------------------


def _accounts(spark, sf_dir, detect_changes=True, block_bits=20) -> Upsert:
    return Upsert(
        table(spark, sf_dir, "target"), table(spark, sf_dir, "batch"), ["account_code"], "run_1", AT, "account_id",
        detect_changes, block_bits=block_bits,
    )


@query
def upsert_actions(spark, sf_dir):
    return _accounts(spark, sf_dir).actions().select("source_row_index", "action")


@query
def upsert_actions_small_blocks(spark, sf_dir):
    """The same with blocks of 256 positions: nearly every key spans several blocks."""
    return _accounts(spark, sf_dir, block_bits=8).actions().select("source_row_index", "action")


@query
def upsert_counts(spark, sf_dir):
    return _accounts(spark, sf_dir).counts()


@query
def upsert_all_counts(spark, sf_dir):
    return _accounts(spark, sf_dir, detect_changes=False).counts()


@query
def upsert_merged(spark, sf_dir):
    return _accounts(spark, sf_dir).merged()


@query
def upsert_all_merged(spark, sf_dir):
    return _accounts(spark, sf_dir, detect_changes=False).merged()


@query
def upsert_rollback_diff(spark, sf_dir):
    """What undoing the upsert removes and changes."""
    after = _accounts(spark, sf_dir).merged()
    return version_diff(after, table(spark, sf_dir, "target"), ["account_code"])


@query
def key_duplicates(spark, sf_dir):
    return duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def constraint_violations(spark, sf_dir):
    spec = TargetSpec.from_dict(
        {"table_name": "feed", "primary_key": "account_id", "natural_key": "account_code", "fields": [
            {"name": "account_id", "nullable": False}, {"name": "account_code", "nullable": False, "constraints": {"unique": True}},
            {"name": "status", "constraints": {"enum": ["click", "view", "signup"]}}]}
    )
    return violations(table(spark, sf_dir, "batch"), spec)


@query
def primary_key_collisions(spark, sf_dir):
    """Orders keyed by customer: all but a customer's first order get a new key, as do keys the target holds."""
    o = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("account_id"),
        F.col("o_orderkey").cast("string").alias("order_code"), F.col("o_orderkey").alias("position"),
    )
    target = table(spark, sf_dir, "target").filter(F.col("status") == "click")
    return rekey_collisions(o, target, "account_id", ["order_code"], "position", 10).select("account_id", "order_code", "rekeyed")


@query
def schema_evolution_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), "c_mktsegment")
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_suppkey").cast("string").alias("code"))
    return add_columns(c, s)


# -- reconciliation ---------------------------------------------------------------------------------------


@query
def reconcile_all_runs(spark, sf_dir):
    return reconcile.reconcile_runs(
        table(spark, sf_dir, "run_metrics"), table(spark, sf_dir, "run_ledger"), table(spark, sf_dir, "run_events"),
        table(spark, sf_dir, "orders"), ["o_orderkey"],
    )


@query
def reconcile_with_duplicates(spark, sf_dir):
    return reconcile.reconcile_runs(
        table(spark, sf_dir, "run_metrics"), table(spark, sf_dir, "run_ledger"), None,
        table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"],
    ).select("run_id", "duplicate_count", "verdict")


@query
def latest_run(spark, sf_dir):
    return reconcile.latest_run(table(spark, sf_dir, "run_events"))


@query
def rolled_back_runs(spark, sf_dir):
    return reconcile.rolled_back_runs(table(spark, sf_dir, "run_events"))


@query
def money_reconciliation(spark, sf_dir):
    """Source, accepted and quarantined money, and the two checksums, in one pass."""
    return reconcile.money_report(_orders(spark, sf_dir), "order_total_str", "total_amount")


@query
def quarantine_per_run(spark, sf_dir):
    return reconcile.ledger_per_run(table(spark, sf_dir, "run_ledger")).withColumnRenamed("quarantined_records", "quarantined")


# -- remediation and suggestion ---------------------------------------------------------------------------


@query
def remediation_impact(spark, sf_dir):
    return remediate.impact(source(spark, sf_dir, "crm"), CUSTOMERS_PLAN, remediate.fix_all(CUSTOMERS_PLAN), CUSTOMERS)


@query
def remediation_one_field(spark, sf_dir):
    fixed_plan = remediate.fix_field(CUSTOMERS_PLAN, "joined_at", "DATE_TO_ISO8601", "INVALID_TIMESTAMP")
    return remediate.outcomes(source(spark, sf_dir, "crm"), CUSTOMERS_PLAN, fixed_plan, CUSTOMERS)


@query
def remediation_orders(spark, sf_dir):
    return remediate.impact(source(spark, sf_dir, "orders_src"), ORDERS_PLAN, remediate.fix_all_for(ORDERS_PLAN, ORDERS), ORDERS)


@query
def suggested_mapping(spark, sf_dir):
    return suggest.mapping_table(table(spark, sf_dir, "crm"), CUSTOMERS, CRM_COLUMNS)


# -- paging -----------------------------------------------------------------------------------------------


@query
def target_page(spark, sf_dir):
    return page(table(spark, sf_dir, "target"), ["account_code"], 50, 20)


@query
def audit_latest(spark, sf_dir):
    return newest_events(table(spark, sf_dir, "run_events"), 50)


# -- files ------------------------------------------------------------------------------------------------


@query
def source_delimited(spark, sf_dir):
    """Written as semicolon text, read back with the delimiter found from its first line."""
    path = scratch_path(spark, "csv")
    src = table(spark, sf_dir, "orders_src").select("order_id", "order_num", "cust_email_raw", "order_total_str")
    export(src, path, sep=";")
    return readers.read_delimited(spark, path, rest=None)


@query
def source_json_lines(spark, sf_dir):
    path = scratch_path(spark, "ndjson")
    table(spark, sf_dir, "orders_src").select("order_id", "order_total_str").write.json(path)
    return readers.read_json_lines(spark, path).select("order_id", "order_total_str")


@query
def source_row_index(spark, sf_dir):
    """Positions are dense: as many as rows, from zero, each once."""
    rows = with_row_index(table(spark, sf_dir, "lineitem").select("l_orderkey"), "pos")
    return rows.agg(
        F.count(F.lit(1)).alias("row_count"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"),
        F.count_distinct("pos").alias("distinct_pos"),
    )


@query
def target_export(spark, sf_dir):
    path = scratch_path(spark, "export")
    export(_orders(spark, sf_dir).accepted().select("order_num", "customer_email", "order_status").orderBy("order_num"), path)
    return readers.read_delimited(spark, path, sep=",", split_lines=True, rest=None)


@query
def ledger_read_back(spark, sf_dir):
    """Two runs in the ledger; one is read back, from its own folder."""
    store = Store(spark, scratch_path(spark, "ledger"), ORDERS)
    done = _orders(spark, sf_dir)
    store.write_quarantine(done.quarantine("run_a", AT), "run_a")
    store.write_quarantine(done.quarantine("run_b", AT), "run_b")
    rows = store.quarantine("run_a")
    return rows.select("quarantine_id", "source_row_index", "run_id", F.size("errors").alias("error_count"))


@query
def store_upsert_rollback(spark, sf_dir):
    """Accounts upserted twice into a store, then rolled back to the first version."""
    spec = TargetSpec.from_dict(
        {"table_name": "accounts", "primary_key": "account_id", "natural_key": "account_code", "fields": [
            {"name": "account_id"}, {"name": "account_code"}, {"name": "status"}, {"name": "score", "data_type": "float"}]}
    )
    store = Store(spark, scratch_path(spark, "store"), spec)
    customers = table(spark, sf_dir, "target").drop("migration_run_id", "migrated_at")
    first = customers.withColumn("source_row_index", F.expr("cast(substr(account_id, 2) as bigint)"))
    apply_batch(store, first, "run_1", AT)
    apply_batch(store, table(spark, sf_dir, "batch"), "run_2", AT)
    store.rollback(0, "run_2", "tester", AT)
    return store.target().drop("migration_run_id", "migrated_at")


ACCOUNTS = TargetSpec.from_dict(
    {"table_name": "accounts", "primary_key": "account_id", "natural_key": "account_code", "fields": [
        {"name": "account_id"}, {"name": "account_code"}, {"name": "status"}, {"name": "score", "data_type": "float"}]}
)


@query
def store_bucketed_upsert(spark, sf_dir):
    """Accounts, then a correction of a few of them: both versions, with the rows that each wrote. The second takes the
    buckets without a changed account over from the first."""
    store = Store(spark, scratch_path(spark, "store"), ACCOUNTS, buckets=64)
    customers = table(spark, sf_dir, "target").drop("migration_run_id", "migrated_at")
    apply_batch(store, customers.withColumn("source_row_index", F.expr("cast(substr(account_id, 2) as bigint)")), "run_1", AT)
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("source_row_index"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("account_id"),
        F.concat(F.lit("U"), F.col("n_nationkey").cast("string")).alias("account_code"), F.col("n_name").alias("status"), F.lit(1.0).alias("score"),
    )
    apply_batch(store, nations, "run_2", AT)
    both = [store.rewritten(n).withColumn("version", F.lit(n)) for n in (0, 1)]
    return both[0].unionByName(both[1]).drop("migrated_at")


@query
def store_unique_values(spark, sf_dir):
    """Customers, then suppliers, claim one territory each: rows whose territory another key has go to the ledger."""
    spec = TargetSpec.from_dict(
        {"table_name": "agents", "natural_key": "code", "fields": [{"name": "code"}, {"name": "territory", "constraints": {"unique": True}}]}
    )
    plan = Plan.of(("code", ["code"], "DIRECT_COPY"), ("territory", ["territory"], "DIRECT_COPY")).approve("tester", spec)
    store = Store(spark, scratch_path(spark, "agents"), spec)
    execute(store, source(spark, sf_dir, "customer_territories"), plan, "run_1", AT)
    execute(store, source(spark, sf_dir, "supplier_territories"), plan, "run_2", AT)
    kept = store.target().select(F.col("migration_run_id").alias("run_id"), "code", "territory", F.lit(None).cast("string").alias("refused"))
    e = F.col("errors")[0]
    lost = store.quarantine().select("run_id", F.col("source_natural_key").alias("code"), e["raw_value"].alias("territory"), e["error_message"].alias("refused"))
    return kept.unionByName(lost)


def _as_files(rows: DataFrame, path: str, head: str, tail: str | None = None, between: str = "") -> None:
    """Rows of text (``value``) as files, one by each task that has them; ``head`` and ``tail`` are lines of every file."""

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"value": [head]})
        lead = ""
        for batch in batches:
            lines = batch["value"].to_pylist()
            yield pa.RecordBatch.from_pydict({"value": pa.array([(between if k else lead) + line for k, line in enumerate(lines)], pa.string())})
            lead = between if lines else lead
        if tail is not None:
            yield pa.RecordBatch.from_pydict({"value": [tail]})

    rows.select("value").mapInArrow(framed, "value string").write.text(path)


QUOTED = "concat('\"', replace(text, ', ', '\", \"'), '\"')"


@query
def source_delimited_quoted(spark, sf_dir):
    """Whole documents as delimited files, one by each task that reads some: line ends, separators and quotes inside of quoted values, read by ranges."""
    path = scratch_path(spark, "quoted")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(QUOTED).alias("text"), "lang", "source", "n_chars")
    export(docs, path)
    return readers.read_delimited(spark, path, sep=",", rest=None)


@query
def source_delimited_ragged(spark, sf_dir):
    """Pipe text with longer, shorter and blank records."""
    path = scratch_path(spark, "ragged")
    at = F.col("source_row_index")
    blank = F.when(at % 5 == 0, F.when(at % 2 == 0, "").otherwise(" | | "))
    rows = table(spark, sf_dir, "orders_src").select(F.explode(F.array_compact(F.array(F.expr(RAGGED_LINE), blank))).alias("value"))
    _as_files(rows, path, "row|order_num|order_total")
    return readers.read_delimited(spark, path)


RAGGED_LINE = """
CASE WHEN source_row_index % 7 = 0 THEN concat_ws('|', cast(source_row_index AS string), order_num, order_total_str, 'late', 'x')
     WHEN source_row_index % 11 = 0 THEN concat_ws('|', cast(source_row_index AS string), order_num)
     ELSE concat_ws('|', cast(source_row_index AS string), order_num, order_total_str) END"""


@query
def source_delimited_tabs(spark, sf_dir):
    """Tab text, its separator found from the first line, with positions."""
    path = scratch_path(spark, "tabs")
    export(table(spark, sf_dir, "customer").orderBy("c_custkey"), path, sep="\t")
    return readers.read_delimited(spark, path, index="pos", rest=None)


@query
def source_json_array(spark, sf_dir):
    """Orders with their lines as JSON arrays, one per file; strings hold brackets, braces and quotes."""
    path = scratch_path(spark, "array")
    lines = table(spark, sf_dir, "lineitem").withColumn("remark", F.expr("concat('}]{\"', l_returnflag, '\\\\\", [')"))
    item = F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("l_quantity"), "remark")
    orders = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))
    _as_files(orders.select(F.to_json(F.struct("l_orderkey", "items")).alias("value")), path, "[", "]", ", ")
    return readers.read_json(spark, path).select("l_orderkey", F.inline("items"))


@query
def source_json_wrapped(spark, sf_dir):
    """Customers in one list of an object that holds other lists and objects, an object per file."""
    path = scratch_path(spark, "wrapped")
    c = table(spark, sf_dir, "customer")
    body = c.select(F.concat(F.to_json(F.struct(*c.columns)), F.lit(",")).alias("value"))
    head = '{"status": "ok", "meta": {"page": {"n": 1}}, "errors": [{"code": 1}], "records": ['
    _as_files(body, path, head, 'null], "more": [[{"c_custkey": -5}], {"c_custkey": -6}]}')
    return readers.read_json(spark, path).select(*c.columns)


@query
def upsert_null_keys(spark, sf_dir):
    """A feed in which every fourth row has no key: accounts kept, and rows that went to the ledger."""
    spec = TargetSpec.from_dict({"table_name": "feed", "natural_key": "code", "fields": [{"name": "code"}, {"name": "status"}]})
    plan = Plan.of(("code", ["code"], "DIRECT_COPY"), ("status", ["status"], "DIRECT_COPY")).approve("tester", spec)
    store = Store(spark, scratch_path(spark, "feed"), spec)
    feed = table(spark, sf_dir, "batch").select("source_row_index", F.expr("CASE WHEN source_row_index % 4 <> 0 THEN account_code END").alias("code"), "status")
    execute(store, feed, plan, "run_1", AT)
    kept = store.target().select(F.lit(None).cast("bigint").alias("source_row_index"), "code", "status", F.lit(None).cast("string").alias("rule"))
    lost = store.quarantine("run_1").select("source_row_index", F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("status"), F.col("errors")[0]["rule"].alias("rule"))
    return kept.unionByName(lost)


@query
def suggested_mapping_tried(spark, sf_dir):
    """Every candidate rule of every field, tried on the whole column; choice 1 is what the plan takes."""
    return suggest.rule_trials(table(spark, sf_dir, "crm"), CUSTOMERS, CRM_COLUMNS).drop("precedence")


@query
def reconcile_run_states(spark, sf_dir):
    """Runs that were simulated only, executed, rolled back, or rolled back and executed again."""
    return reconcile.run_states(table(spark, sf_dir, "run_history"), table(spark, sf_dir, "run_recorded"), table(spark, sf_dir, "run_ledger"))


@query
def rule_enum_table(spark, sf_dir):
    """Part codes of all order lines looked up in a table of codes, some of which stand for two brands."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(PART_CODE).alias("code"))
    done = codes.lookup_codes(lines, "code", table(spark, sf_dir, "part_codes"), "code", "brand", required=True)
    return done.select("l_orderkey", "l_linenumber", "value", "error")


PART_CODE = "CASE WHEN l_partkey % 9 = 0 THEN concat('p-', cast(l_partkey + 1 AS string)) WHEN l_partkey % 10 = 1 THEN ' ' ELSE concat(' P-', cast(l_partkey AS string), ' ') END"


@query
def code_table_repeated(spark, sf_dir):
    return codes.repeated_codes(table(spark, sf_dir, "part_codes"), "code", "brand")


@query
def profile_distinct_sketches(spark, sf_dir):
    """Sketches of two halves of the order lines, merged, against one of the whole and the exact counts."""
    lines = table(spark, sf_dir, "lineitem")
    halves = [profiling.distinct_sketches(lines.filter(half)) for half in ("l_linestatus = 'O'", "l_linestatus <> 'O' OR l_linestatus IS NULL")]
    merged = profiling.estimated_distinct(profiling.merge_sketches(halves[0].unionByName(halves[1])))
    # an unmerged sketch estimates from the order of its updates, too: merged with itself, from its registers alone
    whole = profiling.distinct_sketches(lines)
    again = profiling.estimated_distinct(profiling.merge_sketches(whole.unionByName(whole))).select("position", F.col("distinct_estimate").alias("whole"))
    exact = profiling.profile_columns(lines).select("position", "distinct_count")
    off = F.abs(F.col("distinct_estimate") - F.col("distinct_count")) / F.col("distinct_count")
    return merged.join(again, "position").join(exact, "position").select(
        "column_name", "total_records", "distinct_count", (off <= profiling.sketch_error()).alias("within_bound"),
        (F.col("distinct_estimate") == F.col("whole")).alias("halves_equal_whole"),
    )


@query
def profile_empty_table(spark, sf_dir):
    """A profile of no rows has a line of zeros for every column."""
    return _flat_profile(profiling.profile_columns(table(spark, sf_dir, "events").filter("event_id < 0")))


@query
def audit_of_a_run(spark, sf_dir):
    """A plan proposed, revised and approved, simulated, executed and rolled back: what the audit log says of it."""
    store = Store(spark, scratch_path(spark, "audited"), ORDERS)
    first = propose(store, ORDERS_PLAN, "planner", "2024-06-01T00:00:01Z")
    changed = first.with_parameters(first.mappings[0].target_field, {"reviewed": "yes"})
    plan = approve(store, revise(store, first, changed, "planner", "2024-06-01T00:00:02Z"), "owner", "2024-06-01T00:00:03Z")
    rows = source(spark, sf_dir, "orders_src")
    dry_run(store, rows, plan, "run_0", "2024-06-01T00:00:04Z")
    execute(store, rows, plan, "run_1", "2024-06-01T00:00:05Z")
    store.rollback(0, "run_1", "owner", "2024-06-01T00:00:06Z")
    d = F.col("details")
    return store.audit_trail().select(
        "seq", "event_type", "actor", "run_id", F.coalesce(d["version"], d["plan_version"]).alias("plan_version"), F.coalesce(d["inserted_count"], d["accepted_count"], d["records_removed"]).alias("rows"),
        F.coalesce(d["quarantined_count"], d["rejected_count"]).alias("refused"),
    )


@query
def store_commit_log(spark, sf_dir):
    """Snapshot, two upserts, a rollback: the log, and the rows of each version."""
    store = Store(spark, scratch_path(spark, "log"), ACCOUNTS, buckets=4)
    store.snapshot("run_0", AT)
    customers = table(spark, sf_dir, "target").drop("migration_run_id", "migrated_at")
    apply_batch(store, customers.withColumn("source_row_index", F.expr("cast(substr(account_id, 2) as bigint)")), "run_1", AT)
    apply_batch(store, table(spark, sf_dir, "batch"), "run_2", AT)
    back = store.latest_snapshot()
    store.rollback(back, "run_2", "tester", AT)
    rows = [store.version(n).agg(F.lit(n).cast("bigint").alias("version"), F.count(F.lit(1)).alias("version_rows")) for n in (0, 1, 2)]
    held = rows[0].unionByName(rows[1]).unionByName(rows[2])
    log = store.commits().select("seq", "version", "action", "run_id", "parent").join(held, "version")
    return log.crossJoin(store.target().agg(F.count(F.lit(1)).alias("current_rows")))


@query
def ledger_page(spark, sf_dir):
    """Refused orders 6 to 25 of one run's ledger."""
    store = Store(spark, scratch_path(spark, "ledger"), ORDERS)
    store.write_quarantine(_orders(spark, sf_dir).quarantine("run_a", AT), "run_a")
    return store.quarantine_page("run_a", 20, 5).select("quarantine_id", "source_row_index", F.size("errors").alias("error_count"), "created_at")


@query
def reconcile_balance_sheet(spark, sf_dir):
    """The measures behind every run's verdict, a row each."""
    runs = reconcile.reconcile_runs(
        table(spark, sf_dir, "run_metrics"), table(spark, sf_dir, "run_ledger"), table(spark, sf_dir, "run_events"),
        table(spark, sf_dir, "orders"), ["o_orderkey"],
    )
    return reconcile.balance_sheet(runs)


@query
def target_totals(spark, sf_dir):
    """Rows and money of the orders that were accepted."""
    return reconcile.target_summary(_orders(spark, sf_dir).accepted(), "total_amount").withColumn("target_sum", F.col("target_sum").cast("double"))


@query
def write_guards(spark, sf_dir):
    """What would refuse a batch of events as a whole: required values that are missing, text that is no number."""
    spec = TargetSpec.from_dict(
        {"table_name": "events", "natural_key": "src_id", "fields": [
            {"name": "src_id", "nullable": False}, {"name": "count_str", "type": "int", "nullable": False}, {"name": "price_str", "type": "float"},
            {"name": "active_str", "nullable": False}, {"name": "region", "nullable": False}]}
    )
    rows = table(spark, sf_dir, "typed").withColumn("active_str", F.expr("nullif(active_str, 'maybe')"))
    missing = missing_values(rows, spec).withColumn("guard", F.lit("NOT NULL"))
    return missing.unionByName(unreadable_numbers(rows, spec).withColumn("guard", F.lit("NUMBER")))


@query
def hard_values_evidence(spark, sf_dir):
    """Every error of customers with hard values in all columns."""
    return conform(source(spark, sf_dir, "hard"), CUSTOMERS_PLAN, CUSTOMERS).evidence()


@query
def hard_values_accepted(spark, sf_dir):
    return conform(source(spark, sf_dir, "hard"), CUSTOMERS_PLAN, CUSTOMERS).accepted()
