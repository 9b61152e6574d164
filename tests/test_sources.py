import json

import pytest

from tallyform.sources.readers import EmptySource, detect_delimiter, drop_blank_rows, read_any, read_delimited, read_json, read_ragged, find_amount_column
from tallyform.sources.row_index import with_row_index
from tallyform.operators.profiling import infer_schema, profile_columns, sample_values, top_values
from tallyform.operators.suggest import match_column, suggest_plan
from tallyform.plans.catalogue import CUSTOMERS, ORDERS


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


FORMATS = {
    "array.json": (json.dumps([{"inv_id": "I-1", "amount": 100.0}, {"inv_id": "I-2", "amount": 2.0}], indent=1), 2, "inv_id"),
    "records.json": (json.dumps({"status": "ok", "records": [{"no": "1"}, {"no": "2"}]}), 2, "no"),
    "invoices.json": (json.dumps({"invoices": [{"code": "A", "due": 5}, {"code": "B", "due": 7}]}, indent=2), 2, "code"),
    "one.json": ('{\n "id": "x",\n "v": 1}', 1, "id"),
    "lines.ndjson": ('{"id": 1}\n{"id": 2}\n\n{"id": 3}', 3, "id"),
    "semi.csv": ("id;product;price\nP-1;Lap,top;1200\nP-2;Mouse;25\n", 2, "product"),
    "pipe.csv": ("id|product\nP-1|a\nP-2|b\n", 2, "product"),
    "tab.tsv": ("code\tcity\nNYC\tNew York, NY\nLON\tLondon\n", 2, "city"),
    "bom.csv": ("﻿account_id,balance\nA,1\nB,2\n", 2, "account_id"),
}


@pytest.mark.parametrize("name", list(FORMATS))
def test_formats(spark, tmp_path, name):
    text, rows, column = FORMATS[name]
    df = read_any(spark, write(tmp_path, name, text))
    assert df.count() == rows and column in df.columns


def test_quotes_line_breaks_blank_rows_and_empty_values(spark, tmp_path):
    path = write(tmp_path, "q.csv", 'id,note,n\n1,"a ""b""\nnext",\n,  ,\n2," x ",5\n')
    df = read_delimited(spark, path, rest=None)
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", 'a "b"\nnext', ""), ("2", " x ", "5")]
    assert read_delimited(spark, path, drop_blank=False).count() == 3
    assert detect_delimiter(spark, path) == ","
    with pytest.raises(EmptySource):
        read_any(spark, write(tmp_path, "e.csv", "\n \n"))


def test_wrapped_list_is_the_first_in_order(spark, tmp_path):
    path = write(tmp_path, "w.json", json.dumps({"orders": [{"a": 1}], "data": [{"b": 1}, {"b": 2}]}))
    assert read_json(spark, path).columns == ["b"]


def test_array_records_keep_their_lists(spark, tmp_path):
    records = [{"id": 1, "amount": 5, "items": [{"sku": "x"}, {"sku": "y\n"}]}, 5, None, {"id": 2, "amount": 6, "items": []}]
    df = read_json(spark, write(tmp_path, "a.json", json.dumps(records, indent=2)))
    assert [(r.id, r.amount, [i.sku for i in r["items"]]) for r in df.orderBy("id").collect()] == [(1, 5, ["x", "y\n"]), (2, 6, [])]
    wrapped = read_json(spark, write(tmp_path, "o.json", json.dumps({"data": [{"id": 1, "data": [1, 2]}, "x"]})))
    assert [(r.id, r.data) for r in wrapped.collect()] == [(1, [1, 2])]
    with pytest.raises(Exception):
        read_json(spark, write(tmp_path, "bad.json", '[{"id": 1}, {"id"')).count()


def test_longer_records_are_kept(spark, tmp_path):
    path = write(tmp_path, "r.csv", 'id,note\n1,a,b\n2,"x,y"\n3\n4,5" pipe\n')
    for split in (False, True):
        rows = {r.id: (r.note, r.extra_fields) for r in read_delimited(spark, path, split_lines=split).collect()}
        assert rows["1"][0] == "a" and rows["1"][1].strip() == "1,a,b"
        assert {k: v for k, v in rows.items() if k != "1"} == {"2": ("x,y", None), "3": ("", None), "4": ('5" pipe', None)}


def test_row_index_follows_the_files(spark, tmp_path):
    spark.range(5000).repartitionByRange(9, "id").write.csv(str(tmp_path / "many"), header=True)
    df = read_delimited(spark, str(tmp_path / "many"), index="pos")
    assert df.filter("cast(id as bigint) <> pos").count() == 0 and df.count() == 5000
    got = with_row_index(spark.range(100, 1100, 1, 7), "pos")
    assert got.filter("id <> pos + 100").count() == 0


def test_ragged_and_profile(spark):
    a = spark.createDataFrame([(0, "1", "x,y"), (1, "22", " ")], "pos long, n string, t string")
    b = spark.createDataFrame([(2, "-3", "2024-01-01"), (3, None, "2024-01-01")], "pos long, n string, extra string")
    df = read_ragged([a, b])
    got = {r["column_name"]: r for r in profile_columns(df, ["n", "t", "extra"]).collect()}
    assert (got["n"]["non_null_count"], got["n"]["null_count"], got["n"]["null_percentage"]) == (3, 1, 25.0)
    assert got["t"]["null_percentage"] == 75.0 and got["extra"]["distinct_count"] == 1
    assert got["extra"]["patterns_detected"] == ["DATE_SEPARATORS_DETECTED", "DIGIT_CLUSTERS_DETECTED"]
    kinds = {r["name"]: (r["data_type"], r["nullable"]) for r in infer_schema(df, ["n", "t"]).collect()}
    assert kinds == {"n": ("int", True), "t": ("string", True)}
    ties = spark.createDataFrame([(0, "z"), (1, "a"), (2, "z"), (3, "a"), (4, "m")], "pos long, v string")
    assert [r["value"] for r in top_values(ties, 2, ["v"], "pos").orderBy("rank").collect()] == ["z", "a"]
    assert [r["value"] for r in top_values(ties, 2, ["v"]).orderBy("rank").collect()] == ["a", "z"]
    assert [r["value"] for r in sample_values(ties, 2, ["v"]).orderBy("rank").collect()] == ["a", "m"]
    assert drop_blank_rows(spark.createDataFrame([("", None), (" ", "x")], "a string, b string")).count() == 1


def test_suggestion():
    columns = ["legacy_account_id", "full_name_raw", "email_address", "created", "amount_due"]
    assert match_column("email", columns) == "email_address" and match_column("joined_at", columns) == "created"
    assert find_amount_column(columns) == "amount_due" and find_amount_column(["x"]) is None
    plan = suggest_plan(columns, CUSTOMERS)
    rules = {m.target_field: m.transformation for m in plan.mappings}
    assert rules["customer_uuid"] == "UUID_V5_FROM_KEY" and rules["phone_e164"] == "COALESCE_VAL" and rules["status"] == "COALESCE_VAL"
    assert plan.mapping_for("status").parameters == {"default": "ACTIVE"} and plan.mapping_for("country_iso2").parameters == {"default": "US"}
    assert {q.question_id for q in plan.questions} == {"clarify_status", "clarify_risk_tier", "clarify_country_iso2"}
    assert suggest_plan(["order_num"], ORDERS).mapping_for("order_num").transformation == "DIRECT_COPY"


def test_named_dataset_end_to_end(spark, tmp_path):
    from tallyform import conform
    from tallyform.sources.benchmark import named_dataset

    text = "sku_raw,product_title,qty_on_hand,unit_cost_raw,category_code\n" + "".join(
        f"{sku},{title},{qty},{cost},{cat}\n"
        for sku, title, qty, cost, cat in [
            (" S-1 ", "Bolt", "10", '"$1,204.50"', "HW"), ("S-2", "Nut", "ten", "2", "HW"), ("S-3", "", "5", "3", "HW"), ("S-4", "Cam", "-3", "($4.25)", "EL"),
        ]
    )
    df, spec = named_dataset(spark, "inventory", write(tmp_path, "inv.csv", text))
    from tallyform import Plan

    plan = Plan.of(
        ("item_uuid", ["sku_raw"], "UUID_V5_FROM_KEY"), ("sku_code", ["sku_raw"], "TRIM_CLEAN"), ("item_name", ["product_title"], "TRIM_CLEAN"),
        ("stock_quantity", ["qty_on_hand"], "DIRECT_COPY"), ("unit_price", ["unit_cost_raw"], "CLEAN_CURRENCY_TO_FLOAT"),
        ("category", ["category_code"], "ENUM_LOOKUP", {"mapping": {"hw": "Hardware", "el": "Electronics"}}),
    )
    done = conform(df, plan, spec)
    rows = [tuple(r)[1:] for r in done.accepted().orderBy("sku_code").collect()]
    assert rows == [("S-1", "Bolt", 10, 1204.5, "Hardware"), ("S-4", "Cam", -3, -4.25, "Electronics")]
    bad = {r["source_row_index"]: (r["field"], r["rule"], r["natural_key"]) for r in done.evidence().collect()}
    assert bad == {1: ("stock_quantity", "TYPE_INCOMPATIBILITY", "S-2"), 2: ("item_name", "NOT_NULL_CONSTRAINT", "S-3")}


def test_signed_gap(spark):
    from tallyform.operators.reconcile import reconcile_runs

    metrics = spark.createDataFrame(
        [("even", 100, 70, 10, 5), ("over", 100, 70, 10, 5), ("under", 100, 60, 10, 5), ("clean", 85, 70, 10, 5)],
        "run_id string, total_source_records long, inserted_count long, updated_count long, skipped_count long",
    )
    held = {"even": 15, "over": 30, "under": 15}
    ledger = spark.createDataFrame([(r, i) for r, n in held.items() for i in range(n)], "run_id string, i int")
    got = {r["run_id"]: (r["unaccounted_records"], r["verdict"]) for r in reconcile_runs(metrics, ledger).collect()}
    assert got == {
        "even": (0, "PASSED_WITH_QUARANTINE"), "over": (-15, "DISCREPANCY_DETECTED"), "under": (10, "DISCREPANCY_DETECTED"), "clean": (0, "PASSED_EXACT")
    }


def test_hard_values(spark):
    from tallyform import conform
    from tallyform.operators.conform import apply_rule
    from tallyform.plans.catalogue import CUSTOMERS_PLAN
    from tallyform.sources.benchmark import HARD_VALUES, hard_customers

    rows = hard_customers(spark)
    found = rows.collect()
    assert len(found) == 100 and all({r[c] for r in found} == set(v) for c, v in HARD_VALUES.items())
    done = conform(rows, CUSTOMERS_PLAN, CUSTOMERS)
    got = done.summary().first()
    assert got.total_source_records == 100 == got.accepted_count + got.rejected_count and got.rejected_count > 50
    phones = {r.phone_raw: r.error for r in apply_rule(rows, "PHONE_TO_E164", "phone_raw").collect()}
    assert phones["000-000-0000"] is None and phones["911"] and phones["555.010.0199 x42"] is None
