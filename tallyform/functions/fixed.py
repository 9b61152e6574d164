"""Fixed values.

Everything in this file has to equal the published rule catalogue character by
character for results to agree, so it is written down as plain literals.
"""

from __future__ import annotations

# Characters removed by a Unicode-aware strip and matched by a Unicode-aware \s.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

EMAIL_PATTERN = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"
E164_PATTERN = r"^\+[1-9]\d{1,14}$"

PHONE_MIN_DIGITS = 10
PHONE_MAX_DIGITS = 15
DEFAULT_DIALLING_CODE = "1"

# Integers beyond this magnitude are epoch milliseconds, below it epoch seconds.
EPOCH_MILLIS_ABOVE = 100_000_000_000
# Two-digit years from this value on belong to the 1900s.
TWO_DIGIT_YEAR_PIVOT = 69
MONTH_NAMES = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)

COALESCE_BLANKS = ("", "NULL", "none", "nan")
TRUE_WORDS = ("true", "1", "yes", "y", "t")
FALSE_WORDS = ("false", "0", "no", "n", "f")
CURRENCY_SIGNS = "$€£,"

DEFAULT_COUNTRY = "US"
COUNTRIES = {
    "US": "US",
    "USA": "US",
    "UNITED STATES": "US",
    "UNITED STATES OF AMERICA": "US",
    "UNTIED STATES": "US",
    "U.S.A.": "US",
    "U.S.": "US",
    "CA": "CA",
    "CAN": "CA",
    "CANADA": "CA",
    "GB": "GB",
    "GBR": "GB",
    "UK": "GB",
    "UNITED KINGDOM": "GB",
    "GREAT BRITAIN": "GB",
    "IN": "IN",
    "IND": "IN",
    "INDIA": "IN",
    "DE": "DE",
    "DEU": "DE",
    "GERMANY": "DE",
    "FR": "FR",
    "FRA": "FR",
    "FRANCE": "FR",
    "AU": "AU",
    "AUS": "AU",
    "AUSTRALIA": "AU",
    "JP": "JP",
    "JPN": "JP",
    "JAPAN": "JP",
}

DEFAULT_UUID_NAMESPACE = "data-migration.internal"

# Type names of target fields.
INTEGER_TYPES = ("int", "integer", "bigint", "smallint")
FLOAT_TYPES = ("float", "real", "double", "numeric", "decimal", "currency")
BOOLEAN_TYPES = ("bool", "boolean")
DATE_TYPES = ("date",)
DATETIME_TYPES = ("datetime", "timestamp")
# These are stored as numbers or bytes but carry no check of their own.
MONEY_STORAGE_TYPES = ("money",)
BINARY_TYPES = ("blob", "binary", "bytes")

# Source columns tried, in this order, for a row's business key.
WELL_KNOWN_KEYS = (
    "legacy_account_id", "id", "account_id", "inv_num", "order_num", "encounter_id", "sku_code", "user_id",
)
# Source columns tried, in this order, for the money total.
WELL_KNOWN_AMOUNTS = ("balance_due_str", "balance_due", "balance", "amount", "balance_raw")

# Members of a JSON object tried, in this order, as the wrapped table.
JSON_WRAPPERS = (
    "records", "data", "items", "results", "rows", "invoices", "orders", "customers", "entries", "payload",
)

PATTERN_FLAGS = {
    "comma": "CONTAINS_COMMAS (e.g. 'Last, First' or amounts)",
    "date": "DATE_SEPARATORS_DETECTED",
    "money": "CURRENCY_SYMBOLS_OR_ACCOUNTING_PARENS",
    "digits": "DIGIT_CLUSTERS_DETECTED",
}

IDENTIFIER_PATTERN = r"^[a-zA-Z_][a-zA-Z0-9_]{0,63}$"

# Other names a target field's source column may go by.
COLUMN_ALIASES = {
    "joined_at": ("created", "created_at", "signup_date", "registered_at", "date_joined", "signup_date_str"),
    "natural_key": ("id", "legacy_id", "legacy_account_id", "user_id", "customer_id"),
    "customer_uuid": ("id", "legacy_id", "legacy_account_id", "user_id", "customer_id"),
    "first_name": ("name", "full_name", "full_name_raw", "fname"),
    "last_name": ("name", "full_name", "full_name_raw", "lname"),
    "email": ("mail", "email_address", "contact_email"),
    "phone_e164": ("phone", "cell", "mobile", "telephone", "phone_number", "phone_raw"),
    "balance_due": ("amount", "balance", "due", "total_due", "balance_due_str"),
    "status": ("status_code", "account_status", "status_raw", "active_flag", "account_status_code"),
    "risk_tier": ("risk", "risk_flag", "risk_level", "risk_tier_code"),
    "country_iso2": ("country", "country_code", "country_code_raw", "nation", "country_iso"),
}
# Extra codes a status / risk enum understands.
STATUS_CODES = {
    "1": "ACTIVE", "0": "INACTIVE", "true": "ACTIVE", "false": "INACTIVE",
    "active": "ACTIVE", "inactive": "INACTIVE", "9": "TERMINATED",
}
RISK_CODES = {
    "LOW": "STANDARD", "low": "STANDARD", "N": "STANDARD", "n": "STANDARD",
    "MED": "ELEVATED", "med": "ELEVATED", "MEDIUM": "ELEVATED",
    "HIGH": "CRITICAL", "high": "CRITICAL", "Y": "CRITICAL", "y": "CRITICAL",
}
ISO2_PATTERN = r"^[A-Z]{2}$"
SUGGESTED_UUID_NAMESPACE = "custom.data.migration"

# Substitutes used by the remediation actions.
FIX_DATE = "2024-01-01T00:00:00Z"
FIX_EMAIL = "remediated@customer.internal"
FIX_NAME = "VALUED_CUSTOMER"
FIX_STATUS = "SUSPENDED"
FIX_OTHER = "UNKNOWN"

# Event types of the audit ledger.
PLAN_CREATED = "PLAN_CREATED"
PLAN_UPDATED = "PLAN_UPDATED"
PLAN_APPROVED = "PLAN_APPROVED"
DRY_RUN_EXECUTED = "DRY_RUN_EXECUTED"
MIGRATION_EXECUTED = "MIGRATION_EXECUTED"
MIGRATION_RETRIED = "MIGRATION_RETRIED"
MIGRATION_ROLLED_BACK = "MIGRATION_ROLLED_BACK"
EXECUTION_EVENTS = (MIGRATION_EXECUTED, MIGRATION_RETRIED)

# Evidence texts. {v} = raw source value, {s} = stripped text, {n} = digit count,
# {p} = the assembled phone number; everything else is filled in when a plan is compiled.
MSG_COPY_MISSING = "Required field is missing or empty"
MSG_TRIM_MISSING = "Required field is missing"
MSG_TRIM_EMPTY = "Field is empty after trimming"
MSG_CONCAT_EMPTY = "No non-empty components found to concatenate"
MSG_NAME_MISSING = "Name is missing or empty"
MSG_NAME_FIRST = "First name could not be extracted from '{v}'"
MSG_NAME_LAST = "Last name could not be extracted from '{v}'"
MSG_NAME_PART = "Invalid split_name part param '{part}'"
MSG_DATE_MISSING = "Required date field is missing"
MSG_DATE_EPOCH = "Invalid epoch timestamp '{s}': out of range"
MSG_DATE_BAD = "Cannot parse '{s}' as a valid date. Expected format like YYYY-MM-DD or MM/DD/YYYY"
MSG_PHONE_MISSING = "Phone number is required"
MSG_PHONE_NO_DIGITS = "Phone number '{s}' contains no digits"
MSG_PHONE_SHORT = "Phone number '{s}' is too short ({n} digits; min 10 required)"
MSG_PHONE_LONG = "Phone number '{s}' is too long ({n} digits; max 15 allowed)"
MSG_PHONE_BAD = "Generated phone '{p}' does not meet E.164 format"
MSG_EMAIL_MISSING = "Email address is required"
MSG_EMAIL_BAD = "Invalid email format: '{v}'"
MSG_MONEY_MISSING = "Currency field is required"
MSG_MONEY_EMPTY = "Unable to parse numeric amount from '{v}'"
MSG_MONEY_BAD = "Invalid numeric currency string '{v}'"
MSG_ENUM_MISSING = "Value is required for enum mapping"
MSG_ENUM_BAD = "Unrecognized enum code '{v}'. Allowed source keys: {keys}"
MSG_COUNTRY_MISSING = "Country code is required"
MSG_COUNTRY_BAD = "Unrecognized country '{v}'. Must be valid 2-letter ISO or recognized name."
MSG_UUID_MISSING = "Natural key is missing for UUID generation"
MSG_UNKNOWN_RULE = "Unsupported transformation rule '{rule}'"

RULE_UNMAPPED = "REQUIRED_FIELD_UNMAPPED"
RULE_NOT_NULL = "NOT_NULL_CONSTRAINT"
RULE_ENUM = "ENUM_CONSTRAINT"
RULE_REGEX = "REGEX_CONSTRAINT"
RULE_TYPE = "TYPE_INCOMPATIBILITY"
SEVERITY = "CRITICAL"

MSG_UNMAPPED = "Required target field '{field}' (NOT NULL) has no mapping in MigrationPlan."
MSG_NOT_NULL = "Target field '{field}' is NOT NULL, but evaluated to null/empty"
MSG_ENUM_CHECK = "Value '{v}' is not in allowed target enum list: {allowed}"
MSG_REGEX_CHECK = "Value '{v}' violates target regex pattern: '{pattern}'"
MSG_INT_FRACTION = "Expected integer but got float with fraction: {v}"
MSG_INT_BAD = "Cannot coerce value '{v}' to INTEGER"
MSG_FLOAT_NAN = "Invalid numeric float value: '{v}'"
MSG_FLOAT_BAD = "Cannot coerce value '{v}' to REAL/FLOAT"
MSG_BOOL_BAD = "Cannot coerce value '{v}' to BOOLEAN"
MSG_DATE_CALENDAR = "Invalid calendar date '{d}': {why}"
MSG_DATE_SHAPE = "Expected ISO-8601 date (YYYY-MM-DD), but got: '{v}'"
MSG_DATETIME_SHAPE = "Expected ISO-8601 timestamp, but got: '{v}'"

HINT_UNMAPPED = "Add a mapping in MigrationPlan for required target field '{field}'."
HINT_RULE = "Configure '{rule}' with fallback parameter or cleanse source field '{sources}'."
HINT_NOT_NULL = (
    "Target field '{field}' is NOT NULL. Configure fallback substitution "
    "(e.g. 'UNKNOWN' or 'VALUED_CUSTOMER') or substitute default value."
)
HINT_ENUM = (
    "Value '{v}' is not in target enum list. Update ENUM_LOOKUP mapping dictionary or set fallback='{first}'."
)
HINT_REGEX = (
    "Value '{v}' fails regex '{pattern}'. Apply pre-formatting transform "
    "(e.g. phone E.164 normalization) or null-substitution if optional."
)
HINT_TYPE = "Configure a transformation rule to convert source value to '{type}'."

DIAGNOSIS = (
    "Root Cause: Column '{field}' failed {rule} with error '{message}'. Actionable Fix: Update the "
    "transformation rule in Mapping Studio to handle '{raw}' (e.g. configure fallback value, enum mapping, "
    "or regex pre-cleaning) or cleanse source input."
)
