"""Shipped target specifications and plans.

Field names, types, codes and parameters are fixed values of the data sets they describe.
"""

from __future__ import annotations

from .spec import Plan, TargetSpec


def _field(name, data_type="string", nullable=False, **constraints):
    return {"name": name, "data_type": data_type, "nullable": nullable, "constraints": constraints}


CUSTOMERS = TargetSpec.from_dict(
    {
        "schema_id": "modern_customers_v2",
        "table_name": "customers",
        "primary_key": "customer_uuid",
        "natural_key": "natural_key",
        "fields": [
            _field("customer_uuid", unique=True, format="uuid"),
            _field("natural_key", unique=True),
            _field("first_name", min_length=1),
            _field("last_name", nullable=True),
            _field("email", format="email"),
            _field("phone_e164", nullable=True, regex=r"^\+[1-9]\d{1,14}$"),
            _field("joined_at", format="date-time"),
            _field("status", enum=["ACTIVE", "INACTIVE", "SUSPENDED", "TERMINATED"]),
            _field("balance_due", "float", default=0.0),
            _field("risk_tier", enum=["STANDARD", "ELEVATED", "CRITICAL"]),
            _field("country_iso2", regex="^[A-Z]{2}$"),
        ],
    }
)

CUSTOMERS_PLAN = Plan.of(
    ("customer_uuid", ["legacy_account_id"], "UUID_V5_FROM_KEY", {"namespace": "modern-customer-store.prod"}),
    ("natural_key", ["legacy_account_id"], "TRIM_CLEAN", {"required": True}),
    ("first_name", ["full_name_raw"], "SPLIT_NAME", {"part": "first", "required": True}),
    ("last_name", ["full_name_raw"], "SPLIT_NAME", {"part": "last", "required": False}),
    ("email", ["email_address"], "EMAIL_NORMALIZE", {"required": True}),
    ("phone_e164", ["phone_raw"], "PHONE_TO_E164", {"default_country_code": "1", "required": False}),
    ("joined_at", ["signup_date_str"], "DATE_TO_ISO8601", {"required": True}),
    (
        "status",
        ["account_status_code"],
        "ENUM_LOOKUP",
        {"mapping": {"1": "ACTIVE", "0": "INACTIVE", "9": "TERMINATED"}, "fallback": "SUSPENDED", "required": True},
    ),
    ("balance_due", ["balance_due_str"], "CLEAN_CURRENCY_TO_FLOAT", {"default": 0.0, "required": True}),
    (
        "risk_tier",
        ["risk_flag"],
        "ENUM_LOOKUP",
        {
            "mapping": {"HIGH": "CRITICAL", "Y": "ELEVATED", "N": "STANDARD", "LOW": "STANDARD"},
            "fallback": "STANDARD",
            "required": True,
        },
    ),
    ("country_iso2", ["country_code_raw"], "COUNTRY_TO_ISO2", {"default": "US", "required": True}),
)

ORDERS = TargetSpec.from_dict(
    {
        "schema_id": "ecommerce_orders_v1",
        "table_name": "orders",
        "primary_key": "order_uuid",
        "natural_key": "order_num",
        "fields": [
            _field("order_uuid", unique=True),
            _field("order_num", unique=True),
            _field("customer_email"),
            _field("order_date"),
            _field("total_amount", "float"),
            _field("order_status"),
        ],
    }
)

ORDERS_PLAN = Plan.of(
    ("order_uuid", ["order_num"], "UUID_V5_FROM_KEY", {"namespace": "custom.data.migration"}),
    ("order_num", ["order_num"], "TRIM_CLEAN", {"required": True}),
    ("customer_email", ["cust_email_raw"], "EMAIL_NORMALIZE", {"required": True}),
    ("order_date", ["date_placed"], "DATE_TO_ISO8601", {"required": True}),
    ("total_amount", ["order_total_str"], "CLEAN_CURRENCY_TO_FLOAT", {"default": None}),
    (
        "order_status",
        ["status_cd"],
        "ENUM_LOOKUP",
        {"mapping": {"O": "OPEN", "F": "FULFILLED", "P": "PENDING"}, "required": True},
    ),
)

INVOICES = TargetSpec.from_dict(
    {
        "schema_id": "saas_invoices_v1",
        "table_name": "invoices",
        "primary_key": "invoice_uuid",
        "natural_key": "invoice_number",
        "fields": [
            _field("invoice_uuid", unique=True),
            _field("invoice_number", unique=True),
            _field("client_name"),
            _field("invoice_date"),
            _field("due_date"),
            _field("balance_due", "float"),
            _field("payment_status"),
        ],
    }
)

INVENTORY = TargetSpec.from_dict(
    {
        "schema_id": "warehouse_inventory_v1",
        "table_name": "inventory",
        "primary_key": "item_uuid",
        "natural_key": "sku_code",
        "fields": [
            _field("item_uuid", unique=True),
            _field("sku_code", unique=True),
            _field("item_name"),
            _field("stock_quantity", "int"),
            _field("unit_price", "float"),
            _field("category"),
        ],
    }
)

ENCOUNTERS = TargetSpec.from_dict(
    {
        "schema_id": "clinical_encounters_v1",
        "table_name": "encounters",
        "primary_key": "encounter_uuid",
        "natural_key": "encounter_id",
        "fields": [
            _field("encounter_uuid", unique=True),
            _field("encounter_id", unique=True),
            _field("patient_mrn"),
            _field("patient_first_name"),
            _field("patient_last_name"),
            _field("service_date"),
            _field("department_name"),
            _field("billed_amount", "float"),
        ],
    }
)

SPECS = {
    "customers": CUSTOMERS,
    "orders": ORDERS,
    "invoices": INVOICES,
    "inventory": INVENTORY,
    "healthcare": ENCOUNTERS,
    "encounters": ENCOUNTERS,
}
