import json

import pytest
from pyspark.sql import functions as F

from tallyform import Plan, TargetSpec, conform
from tallyform.operators import remediate
from tallyform.operators.conform import apply_rule
from tallyform.operators.remediate import (
    fix_all, fix_all_for, fix_field, fixes_from_errors, impact, override, with_policy,
)
from tallyform.plans.catalogue import CUSTOMERS, CUSTOMERS_PLAN
from tallyform.plans.spec import ApprovalError, SpecError
from tallyform.sources.benchmark import legacy_customers


def spec_of(*fields, key="id"):
    return TargetSpec.from_dict({"table_name": "t", "natural_key": key, "fields": list(fields)})


def test_golden_counts(spark):
    done = conform(legacy_customers(spark), CUSTOMERS_PLAN, CUSTOMERS)
    assert done.summary().first().asDict() == {"total_source_records": 1000, "accepted_count": 902, "rejected_count": 98}
    by = {r["field"]: r["error_count"] for r in done.errors_by("field").collect()}
    assert by == {"joined_at": 40, "phone_e164": 29, "email": 20, "first_name": 9}


def test_fix_all_leaves_the_nameless(spark):
    got = impact(legacy_customers(spark), CUSTOMERS_PLAN, fix_all(CUSTOMERS_PLAN), CUSTOMERS).collect()
    assert {r["outcome"]: r["rows"] for r in got} == {"unchanged": 902, "fixed": 89, "still_rejected": 9}


def test_fix_one_field_and_answers(spark):
    plan = fix_field(CUSTOMERS_PLAN, "joined_at", "DATE_TO_ISO8601", "INVALID_TIMESTAMP")
    assert conform(legacy_customers(spark), plan, CUSTOMERS).summary().first()["rejected_count"] == 58
    plan = with_policy(CUSTOMERS_PLAN.approve("x"), "phone_e164", "null")
    assert plan.status == "DRAFT" and plan.approval_fingerprint is None
    assert conform(legacy_customers(spark), plan, CUSTOMERS).summary().first()["rejected_count"] == 69
    back = with_policy(plan, "phone_e164", "quarantine")
    assert conform(legacy_customers(spark), back, CUSTOMERS).summary().first()["rejected_count"] == 98
    assert override(CUSTOMERS_PLAN, {"nothing": {"default": 1}}) == CUSTOMERS_PLAN
    coded = override(CUSTOMERS_PLAN, {"status": {"mapping": {"X": "SUSPENDED"}}}).mapping_for("status").parameters["mapping"]
    assert coded == {**CUSTOMERS_PLAN.mapping_for("status").parameters["mapping"], "X": "SUSPENDED"}


def test_fixes_follow_from_the_errors_found(spark):
    src = legacy_customers(spark)
    errors = conform(src, CUSTOMERS_PLAN, CUSTOMERS).evidence()
    fixed_plan = fixes_from_errors(errors, CUSTOMERS_PLAN, CUSTOMERS)
    assert conform(src, fixed_plan, CUSTOMERS).summary().first()["rejected_count"] == 0
    # only the 40 unreadable dates are frequent enough
    some = fixes_from_errors(errors, CUSTOMERS_PLAN, CUSTOMERS, least=40)
    assert conform(src, some, CUSTOMERS).summary().first()["rejected_count"] == 58
    assert fixes_from_errors(errors.limit(0), CUSTOMERS_PLAN, CUSTOMERS) == CUSTOMERS_PLAN


def test_type_coercion(spark):
    spec = spec_of(
        {"name": "id"}, {"name": "n", "data_type": "int"}, {"name": "p", "data_type": "float"}, {"name": "a", "type": "boolean"}, {"name": "d", "data_type": "date"}
    )
    plan = Plan.of(*[(c, [c], "DIRECT_COPY") for c in ("id", "n", "p", "a", "d")])
    rows = [
        (0, "a", "42", "$1,000.50", "YES", "2024-01-15T10:00"), (1, "b", "forty-two", "1_0e1", "f", "2024-01-15"),
        (2, "c", "7", "inf", "1", "2024-02-31"), (3, "d", "99999999999999999999", "x", "maybe", "2024/01/01"), (4, "e", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "source_row_index int, id string, n string, p string, a string, d string")
    done = conform(df, plan, spec)
    ok = {r["id"]: r for r in done.accepted().collect()}
    assert set(ok) == {"a", "e"}
    assert tuple(ok["a"]) == ("a", 42, 1000.5, True, "2024-01-15")
    errors = {(r["source_row_index"], r["field"]): r["error_message"] for r in done.evidence().collect()}
    assert errors == {
        (1, "n"): "Cannot coerce value 'forty-two' to INTEGER",
        (2, "p"): "Invalid numeric float value: 'inf'", (2, "d"): "Invalid calendar date '2024-02-31': day is out of range for month",
        (3, "n"): "Cannot coerce value '99999999999999999999' to INTEGER", (3, "p"): "Cannot coerce value 'x' to REAL/FLOAT",
        (3, "a"): "Cannot coerce value 'maybe' to BOOLEAN", (3, "d"): "Expected ISO-8601 date (YYYY-MM-DD), but got: '2024/01/01'",
    }


def test_typed_sources_keep_their_type(spark):
    spec = spec_of({"name": "id"}, {"name": "n", "data_type": "int"}, {"name": "tags", "data_type": "string"})
    df = spark.createDataFrame([(0, 5, 2.0, ["x"]), (1, 6, 2.5, None)], "source_row_index int, id long, n double, tags array<string>")
    done = conform(df, Plan.of(("id", ["id"], "DIRECT_COPY"), ("n", ["n"], "DIRECT_COPY"), ("tags", ["tags"], "DIRECT_COPY")), spec)
    assert [tuple(r) for r in done.accepted().collect()] == [("5", 2, ["x"])]
    assert done.evidence().first()["error_message"] == "Expected integer but got float with fraction: 2.5"


def test_evidence_order_and_payload(spark):
    spec = spec_of({"name": "id", "nullable": False}, {"name": "must", "nullable": False}, {"name": "mail", "nullable": False})
    df = spark.createDataFrame([(3, "", None)], "source_row_index int, id string, mail string")
    done = conform(df, Plan.of(("id", ["id"], "TRIM_CLEAN"), ("mail", ["mail"], "EMAIL_NORMALIZE", {"required": True})), spec)
    row = done.quarantine("r", "now").first()
    assert [e["field"] for e in row["errors"]] == ["must", "id", "mail"]
    assert [e["rule"] for e in row["errors"]] == ["REQUIRED_FIELD_UNMAPPED", "NOT_NULL_CONSTRAINT", "EMAIL_NORMALIZE"]
    assert row["quarantine_id"] == "q_r_0003" and row["source_natural_key"] == "rec_3"
    assert json.loads(row["source_payload"]) == {"id": "", "mail": None}


def test_generic_fix_all(spark):
    spec = spec_of({"name": "id", "nullable": False}, {"name": "status", "nullable": False, "constraints": {"enum": ["PAID", "PENDING"]}})
    plan = Plan.of(("id", ["id"], "COALESCE_VAL"), ("status", ["code"], "DIRECT_COPY"))
    df = spark.createDataFrame([(0, "I-1", "PAID"), (1, "", "??")], "source_row_index int, id string, code string")
    assert conform(df, plan, spec).summary().first()["rejected_count"] == 1
    done = conform(df, fix_all_for(plan, spec), spec)
    assert sorted(tuple(r) for r in done.accepted().collect()) == [("I-1", "PAID"), ("UNKNOWN", "PAID")]


def test_bad_pattern_refuses_and_several_sources_need_concat(spark):
    df = spark.createDataFrame([(0, "a", "b")], "source_row_index int, id string, x string")
    bad = spec_of({"name": "id", "constraints": {"regex": "("}})
    assert conform(df, Plan.of(("id", ["id"], "DIRECT_COPY")), bad).evidence().first()["rule"] == "REGEX_CONSTRAINT"
    with pytest.raises(SpecError):
        conform(df, Plan.of(("id", ["id", "x"], "TRIM_CLEAN")), spec_of({"name": "id"}))


def test_approval():
    plan = CUSTOMERS_PLAN.approve("me", CUSTOMERS)
    plan.require_approved(CUSTOMERS)
    for changed in (CUSTOMERS_PLAN, plan.with_parameters("status", {"fallback": "INACTIVE"})):
        with pytest.raises(ApprovalError):
            changed.require_approved(CUSTOMERS)
    from dataclasses import replace
    forged = replace(plan.with_parameters("status", {}), status="APPROVED", approval_fingerprint=plan.approval_fingerprint, version=2)
    with pytest.raises(ApprovalError):
        forged.require_approved(CUSTOMERS)


def test_no_shuffle_and_filter_stays_above_the_mapping(spark):
    text = conform(legacy_customers(spark), CUSTOMERS_PLAN, CUSTOMERS).accepted()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    assert text.count("sha1(") == 1


def test_rows_are_conserved(spark):
    done = conform(legacy_customers(spark, 3000), CUSTOMERS_PLAN, CUSTOMERS)
    s = done.summary().first()
    assert s["accepted_count"] + s["rejected_count"] == 3000
    assert done.accepted(True).join(done.quarantine("r", "t"), "source_row_index").count() == 0
    assert done.status().filter(F.col("accepted") == (F.col("error_count") > 0)).count() == 0


def test_mappings_that_two_plans_share_are_evaluated_once(spark):

    src = legacy_customers(spark, 200)
    after = remediate.fix_all(CUSTOMERS_PLAN)
    old = conform(src, CUSTOMERS_PLAN, CUSTOMERS, prefix="__old_")
    new = conform(old.frame, after, CUSTOMERS, prefix="__new_", source_columns=old.source_columns, shared=old)
    alike = {m.target_field for m in CUSTOMERS_PLAN.mappings if m.canonical() == after.mapping_for(m.target_field).canonical()}
    assert len(alike) >= 5
    taken = {f.mapping.target_field for f in new._fields if f.value.startswith("__old_")}
    assert taken == alike
    alone = conform(src, after, CUSTOMERS)
    assert sorted(map(tuple, new.accepted().collect())) == sorted(map(tuple, alone.accepted().collect()))
    assert sorted(map(repr, new.evidence().collect())) == sorted(map(repr, alone.evidence().collect()))


def test_generated_keys_are_the_same_in_every_run(spark):
    df = spark.createDataFrame([(0, None), (1, " "), (2, "x")], "source_row_index long, k string")
    for rows in (df, df.drop("source_row_index").withColumn("n", F.lit(1))):
        first, second = ([r.value for r in apply_rule(rows, "UUID_V5_FROM_KEY", "k").collect()] for _ in range(2))
        assert first == second and len(set(first)) == 3 and None not in first
