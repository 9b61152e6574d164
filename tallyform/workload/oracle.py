"""The queries once more in plain SQL, written independently of the Spark expressions."""

from __future__ import annotations

from ..functions import fixed
from .queries import AT, CRM_COLUMNS, RUN
from .sources_sql import plain

ORACLE: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WS = q(fixed.WHITESPACE)
_WS_CLASS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(x: str) -> str:
    return f"trim({x}, {_WS})"


def squeeze(x: str) -> str:
    return f"regexp_replace({strip(x)}, {q(_WS_CLASS + '+')}, ' ', 'g')"


def blank(x: str) -> str:
    return f"({x} IS NULL OR {strip(x)} = '')"


def first_name(x: str) -> str:
    return (
        f"(CASE WHEN strpos({strip(x)}, ',') > 0 THEN {strip('substr(' + strip(x) + ', strpos(' + strip(x) + chr(44) + q(',') + ') + 1)')} "
        f"ELSE split_part({squeeze(x)}, ' ', 1) END)"
    )


def last_name(x: str) -> str:
    return (
        f"(CASE WHEN strpos({strip(x)}, ',') > 0 THEN {strip('split_part(' + strip(x) + chr(44) + q(',') + ', 1)')} "
        f"WHEN strpos({squeeze(x)}, ' ') > 0 THEN substr({squeeze(x)}, strpos({squeeze(x)}, ' ') + 1) ELSE '' END)"
    )


_DATE_FORMATS = [
    (r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}Z", "%Y-%m-%dT%H:%M:%SZ"),
    (r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}", "%Y-%m-%dT%H:%M:%S"),
    (r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}", "%Y-%m-%d %H:%M:%S"),
    (r"\d{4}-\d{1,2}-\d{1,2}", "%Y-%m-%d"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "%m/%d/%Y"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "%d/%m/%Y"),
    (r"\d{1,2}-\d{1,2}-\d{4}", "%m-%d-%Y"),
    (r"\d{1,2}-\d{1,2}-\d{4}", "%d-%m-%Y"),
    (r"\d{2}-\d{1,2}-\d{1,2}", "%y-%m-%d"),
    (r"\d{1,2}-\d{1,2}-\d{2}", "%d-%m-%y"),
    (r"\d{1,2}-\d{1,2}-\d{2}", "%m-%d-%y"),
    (r"\d{1,2}/\d{1,2}/\d{2}", "%m/%d/%y"),
    (r"\d{1,2}/\d{1,2}/\d{2}", "%d/%m/%y"),
    (r"[A-Za-z]+ \d{1,2}, \d{4}", "%B %d, %Y"),
    (r"[A-Za-z]+ \d{1,2}, \d{4}", "%b %d, %Y"),
    (r"\d{4}/\d{1,2}/\d{1,2}", "%Y/%m/%d"),
]


def date_iso(x: str) -> str:
    s = strip(x)
    tries = ", ".join(
        f"CASE WHEN regexp_full_match({s}, {q(shape)}) THEN try_strptime({s}, {q(fmt)}) END" for shape, fmt in _DATE_FORMATS
    )
    epoch = f"make_timestamp(try_cast({s} AS BIGINT) * 1000000)"
    return (
        f"strftime(CASE WHEN regexp_full_match({s}, '-?[0-9]+') THEN {epoch} ELSE coalesce({tries}) END, '%Y-%m-%dT%H:%M:%SZ')"
    )


def date_error(x: str) -> str:
    return (
        f"'Cannot parse ''' || {strip(x)} || ''' as a valid date. Expected format like YYYY-MM-DD or MM/DD/YYYY'"
    )


def digits(x: str) -> str:
    return f"regexp_replace({strip(x)}, '[^0-9]', '', 'g')"


def phone(x: str) -> str:
    d = digits(x)
    return f"(CASE WHEN NOT starts_with({strip(x)}, '+') AND length({d}) = 10 THEN '+1' ELSE '+' END || {d})"


def phone_error(x: str, required: bool) -> str:
    d = digits(x)
    none = f"'Phone number ''' || {strip(x)} || ''' contains no digits'" if required else "NULL"
    return (
        f"CASE WHEN {blank(x)} THEN {q(fixed.MSG_PHONE_MISSING) if required else 'NULL'} WHEN {d} = '' THEN {none} "
        f"WHEN length({d}) < 10 THEN 'Phone number ''' || {strip(x)} || ''' is too short (' || length({d}) || ' digits; min 10 required)' "
        f"WHEN length({d}) > 15 THEN 'Phone number ''' || {strip(x)} || ''' is too long (' || length({d}) || ' digits; max 15 allowed)' "
        f"WHEN NOT regexp_matches({phone(x)}, {q(fixed.E164_PATTERN)}) THEN 'Generated phone ''' || {phone(x)} || ''' does not meet E.164 format' END"
    )


def phone_value(x: str) -> str:
    d = digits(x)
    return (
        f"CASE WHEN {blank(x)} OR length({d}) NOT BETWEEN 10 AND 15 OR NOT regexp_matches({phone(x)}, {q(fixed.E164_PATTERN)}) "
        f"THEN NULL ELSE {phone(x)} END"
    )


def email_ok(x: str) -> str:
    return f"regexp_matches(lower({strip(x)}), {q(fixed.EMAIL_PATTERN)})"


def email_value(x: str) -> str:
    return f"CASE WHEN NOT {blank(x)} AND {email_ok(x)} THEN lower({strip(x)}) END"


def email_error(x: str) -> str:
    return f"CASE WHEN {blank(x)} THEN {q(fixed.MSG_EMAIL_MISSING)} WHEN NOT {email_ok(x)} THEN 'Invalid email format: ''' || {x} || '''' END"


def money_digits(x: str) -> str:
    return f"regexp_replace({strip(x)}, '[^0-9.]', '', 'g')"


def money(x: str) -> str:
    n = f"try_cast({money_digits(x)} AS DECIMAL(38,2))"
    s = strip(x)
    return f"(CASE WHEN (starts_with({s}, '(') AND ends_with({s}, ')')) OR starts_with({s}, '-') THEN -{n} ELSE {n} END)"


def money_value(x: str, blank_default: str, empty_default: str) -> str:
    return (
        f"CASE WHEN {blank(x)} THEN {blank_default} WHEN {money_digits(x)} = '' THEN {empty_default} "
        f"ELSE cast({money(x)} AS DOUBLE) END"
    )


def money_error(x: str, has_default: bool) -> str:
    none = "NULL" if has_default else f"'Unable to parse numeric amount from ''' || {x} || ''''"
    return (
        f"CASE WHEN {blank(x)} THEN NULL WHEN {money_digits(x)} = '' THEN {none} "
        f"WHEN {money(x)} IS NULL THEN 'Invalid numeric currency string ''' || {x} || '''' END"
    )


def enum_hit(x: str, codes: dict[str, str]) -> str:
    return f"CASE lower({strip(x)}) " + " ".join(f"WHEN {q(k.lower())} THEN {q(v)}" for k, v in codes.items()) + " END"


def country_hit(x: str) -> str:
    up = f"upper({strip(x)})"
    bare = strip(f"replace({up}, '.', '')")
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fixed.COUNTRIES.items())
    return (
        f"coalesce(CASE {up} {cases} END, CASE {bare} {cases} END, CASE WHEN regexp_full_match({bare}, '[A-Z]{{2}}') THEN {bare} END)"
    )


def country_value(x: str) -> str:
    return f"CASE WHEN {blank(x)} THEN 'US' ELSE {country_hit(x)} END"


def country_error(x: str) -> str:
    return (
        f"CASE WHEN NOT {blank(x)} AND {country_hit(x)} IS NULL THEN 'Unrecognized country ''' || {x} || "
        f"'''. Must be valid 2-letter ISO or recognized name.' END"
    )


def uuid5(namespace: str, x: str) -> str:
    import uuid

    space = uuid.uuid5(uuid.NAMESPACE_DNS, namespace).hex
    h = f"sha1(unhex('{space}') || encode({x}))"
    return (
        f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || "
        f"translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"
    )


def _rule(name: str, source: str, value: str, error: str = "cast(NULL AS VARCHAR)") -> None:
    ORACLE[name] = f"SELECT source_row_index, {value} AS value, {error} AS error FROM ({plain(source)}) src"


_STATUS = {"1": "ACTIVE", "0": "INACTIVE", "9": "TERMINATED"}
_RISK = {"HIGH": "CRITICAL", "Y": "ELEVATED", "N": "STANDARD", "LOW": "STANDARD"}
_RULE_MISSING = "CASE WHEN {b} THEN {m} END"

_rule(
    "rule_direct_copy", "crm", "nullif(account_status_code, '')",
    f"CASE WHEN account_status_code IS NULL OR account_status_code = '' THEN {q(fixed.MSG_COPY_MISSING)} END",
)
_rule(
    "rule_trim_clean", "crm", f"nullif({squeeze('full_name_raw')}, '')",
    f"CASE WHEN {strip('full_name_raw')} = '' THEN {q(fixed.MSG_TRIM_EMPTY)} END",
)
_both = f"concat_ws(' | ', nullif({strip('full_name_raw')}, ''), nullif({strip('country_code_raw')}, ''))"
_rule("rule_concat_ws", "crm", f"nullif({_both}, '')", f"CASE WHEN {_both} = '' THEN {q(fixed.MSG_CONCAT_EMPTY)} END")
_rule(
    "rule_split_first", "crm", f"nullif({first_name('full_name_raw')}, '')",
    f"CASE WHEN {blank('full_name_raw')} THEN {q(fixed.MSG_NAME_MISSING)} WHEN {first_name('full_name_raw')} = '' "
    f"THEN 'First name could not be extracted from ''' || full_name_raw || '''' END",
)
_rule(
    "rule_split_last", "crm", f"nullif({last_name('full_name_raw')}, '')",
    f"CASE WHEN {blank('full_name_raw')} THEN {q(fixed.MSG_NAME_MISSING)} WHEN {last_name('full_name_raw')} = '' "
    f"THEN 'Last name could not be extracted from ''' || full_name_raw || '''' END",
)
_rule(
    "rule_date_iso", "crm", date_iso("signup_date_str"),
    f"CASE WHEN {date_iso('signup_date_str')} IS NULL THEN {date_error('signup_date_str')} END",
)
_rule(
    "rule_date_iso_orders", "orders_src", date_iso("date_placed"),
    f"CASE WHEN {date_iso('date_placed')} IS NULL THEN {date_error('date_placed')} END",
)
_rule("rule_phone_e164", "crm", phone_value("phone_raw"), phone_error("phone_raw", True))
_rule("rule_phone_null_on_invalid", "crm", phone_value("phone_raw"))
_rule("rule_email", "crm", email_value("email_address"), email_error("email_address"))
_rule("rule_currency", "crm", money_value("balance_due_str", "0.0::DOUBLE", "NULL"), money_error("balance_due_str", False))
_rule(
    "rule_currency_orders", "orders_src", money_value("order_total_str", "0.0::DOUBLE", "0.0::DOUBLE"),
    money_error("order_total_str", True),
)
_rule("rule_enum", "crm", f"coalesce({enum_hit('risk_flag', _RISK)}, 'STANDARD')")
_rule(
    "rule_enum_strict", "crm", enum_hit("account_status_code", _STATUS),
    f"CASE WHEN {blank('account_status_code')} THEN {q(fixed.MSG_ENUM_MISSING)} WHEN {enum_hit('account_status_code', _STATUS)} IS NULL "
    f"THEN 'Unrecognized enum code ''' || account_status_code || '''. Allowed source keys: ' || {q(str(list(_STATUS)))} END",
)
_rule("rule_country", "crm", country_value("country_code_raw"), country_error("country_code_raw"))
_rule(
    "rule_coalesce", "crm",
    f"CASE WHEN account_status_code IS NULL OR {strip('account_status_code')} IN ('', 'NULL', 'none', 'nan') THEN 'MISSING' ELSE account_status_code END",
)
_rule("rule_uuid_v5", "crm", uuid5("modern-customer-store.prod", strip("legacy_account_id")))
_rule("rule_unknown", "crm", "cast(NULL AS VARCHAR)", "'Unsupported transformation rule ''LITERAL_VALUE'''")
ORACLE["rule_trim_clean_documents"] = f"SELECT doc_id, nullif({squeeze('text')}, '') AS value FROM documents"

# -- conform: customers ---------------------------------------------------------------------------------------

_PAYLOAD = "cast(json_object(" + ", ".join(f"{q(c)}, {c}" for c in CRM_COLUMNS) + ") AS VARCHAR)"
# one row per source row: every field's value and error; error order is the order of the plan
_CRM = f"""
WITH src AS ({plain('crm')}),
f AS (SELECT *,
  {uuid5('modern-customer-store.prod', strip('legacy_account_id'))} AS v_uuid, {strip('legacy_account_id')} AS v_key,
  nullif({first_name('full_name_raw')}, '') AS v_first, nullif({last_name('full_name_raw')}, '') AS v_last,
  {email_value('email_address')} AS v_email, {phone_value('phone_raw')} AS v_phone, {date_iso('signup_date_str')} AS v_joined,
  coalesce({enum_hit('account_status_code', _STATUS)}, 'SUSPENDED') AS v_status,
  {money_value('balance_due_str', '0.0::DOUBLE', '0.0::DOUBLE')} AS v_balance,
  coalesce({enum_hit('risk_flag', _RISK)}, 'STANDARD') AS v_risk, {country_value('country_code_raw')} AS v_country,
  CASE WHEN {blank('full_name_raw')} THEN {q(fixed.MSG_NAME_MISSING)} END AS e_first,
  {email_error('email_address')} AS e_email, {phone_error('phone_raw', False)} AS e_phone,
  CASE WHEN {date_iso('signup_date_str')} IS NULL THEN {date_error('signup_date_str')} END AS e_joined,
  {money_error('balance_due_str', True)} AS e_balance, {country_error('country_code_raw')} AS e_country
  FROM src),
ev AS (
  SELECT source_row_index, v_key AS natural_key, 3 AS pos, 'first_name' AS field, 'SPLIT_NAME' AS rule, e_first AS error_message, full_name_raw AS raw_value, 'full_name_raw' AS src_col FROM f WHERE e_first IS NOT NULL
  UNION ALL SELECT source_row_index, v_key, 5, 'email', 'EMAIL_NORMALIZE', e_email, email_address, 'email_address' FROM f WHERE e_email IS NOT NULL
  UNION ALL SELECT source_row_index, v_key, 6, 'phone_e164', 'PHONE_TO_E164', e_phone, phone_raw, 'phone_raw' FROM f WHERE e_phone IS NOT NULL
  UNION ALL SELECT source_row_index, v_key, 7, 'joined_at', 'DATE_TO_ISO8601', e_joined, signup_date_str, 'signup_date_str' FROM f WHERE e_joined IS NOT NULL
  UNION ALL SELECT source_row_index, v_key, 9, 'balance_due', 'CLEAN_CURRENCY_TO_FLOAT', e_balance, balance_due_str, 'balance_due_str' FROM f WHERE e_balance IS NOT NULL
  UNION ALL SELECT source_row_index, v_key, 11, 'country_iso2', 'COUNTRY_TO_ISO2', e_country, country_code_raw, 'country_code_raw' FROM f WHERE e_country IS NOT NULL),
bad AS (SELECT source_row_index, natural_key, count(*) AS n, arg_min(field, pos) AS first_field, arg_min(rule, pos) AS first_rule, arg_min(src_col, pos) AS first_col,
  string_agg('[' || field || ']: ' || error_message, '; ' ORDER BY pos) AS summary FROM ev GROUP BY source_row_index, natural_key)
"""
_HINT = "'Configure ''' || {r} || ''' with fallback parameter or cleanse source field ''' || {c} || '''.'"
_QID = (
    f"'q_{RUN}_' || CASE WHEN source_row_index < 10000 THEN lpad(cast(source_row_index AS VARCHAR), 4, '0') "
    "ELSE cast(source_row_index AS VARCHAR) END"
)

ORACLE["conform_accepted"] = _CRM + """
SELECT v_uuid AS customer_uuid, v_key AS natural_key, v_first AS first_name, v_last AS last_name, v_email AS email, v_phone AS phone_e164,
  v_joined AS joined_at, v_status AS status, v_balance AS balance_due, v_risk AS risk_tier, v_country AS country_iso2
FROM f WHERE source_row_index NOT IN (SELECT source_row_index FROM bad)"""
ORACLE["conform_quarantine"] = _CRM + f"""
SELECT {_QID.replace('source_row_index', 'bad.source_row_index')} AS quarantine_id, 'customers' AS table_name, '{RUN}' AS run_id, bad.source_row_index,
  natural_key AS source_natural_key, {_PAYLOAD} AS source_payload, n::INTEGER AS error_count, first_field,
  {_HINT.format(r='first_rule', c='first_col')} AS suggestion, '{AT}' AS created_at
FROM bad JOIN f ON bad.source_row_index = f.source_row_index"""
ORACLE["conform_evidence"] = _CRM + f"""
SELECT source_row_index, natural_key, field, rule, 'CRITICAL' AS severity, error_message, raw_value, {_HINT.format(r='rule', c='src_col')} AS suggestion FROM ev"""
ORACLE["conform_summary"] = _CRM + """
SELECT (SELECT count(*) FROM f) AS total_source_records, (SELECT count(*) FROM f) - (SELECT count(*) FROM bad) AS accepted_count, (SELECT count(*) FROM bad) AS rejected_count"""
ORACLE["errors_by_field"] = _CRM + "SELECT field, count(*) AS error_count FROM ev GROUP BY field"
ORACLE["errors_by_field_rule"] = _CRM + "SELECT field, rule, count(*) AS error_count FROM ev GROUP BY field, rule"
ORACLE["quarantine_preview"] = _CRM + f"""
SELECT {_QID} AS quarantine_id, source_row_index, natural_key AS source_natural_key FROM bad ORDER BY source_row_index LIMIT 200"""
ORACLE["quarantine_export"] = _CRM + f"""
SELECT source_row_index + 1 AS source_row_index, natural_key, '{RUN}' AS run_id, summary AS errors_detected, '{AT}' AS created_at FROM bad"""
ORACLE["diagnosis_text"] = _CRM + """
SELECT source_row_index, field, 'Root Cause: Column ''' || field || ''' failed ' || rule || ' with error ''' || error_message ||
  '''. Actionable Fix: Update the transformation rule in Mapping Studio to handle ''' || raw_value ||
  ''' (e.g. configure fallback value, enum mapping, or regex pre-cleaning) or cleanse source input.' AS diagnosis FROM ev"""

# -- conform: orders ------------------------------------------------------------------------------------------

_ORDER_STATUS = {"O": "OPEN", "F": "FULFILLED", "P": "PENDING"}
_ORDERS = f"""
WITH src AS ({plain('orders_src')}),
f AS (SELECT *, nullif({squeeze('order_num')}, '') AS v_num, {email_value('cust_email_raw')} AS v_email, {date_iso('date_placed')} AS v_date,
  {money_value('order_total_str', 'NULL', 'NULL')} AS v_total, {enum_hit('status_cd', _ORDER_STATUS)} AS v_status,
  {money_error('order_total_str', False)} AS e_total, {money('order_total_str')} AS cash FROM src),
ev AS (
  SELECT source_row_index, 'order_num' AS field, 'TRIM_CLEAN' AS rule FROM f WHERE v_num IS NULL
  UNION ALL SELECT source_row_index, 'customer_email', 'EMAIL_NORMALIZE' FROM f WHERE v_email IS NULL
  UNION ALL SELECT source_row_index, 'order_date', 'DATE_TO_ISO8601' FROM f WHERE v_date IS NULL
  UNION ALL SELECT source_row_index, 'total_amount', CASE WHEN e_total IS NULL THEN 'NOT_NULL_CONSTRAINT' ELSE 'CLEAN_CURRENCY_TO_FLOAT' END FROM f WHERE v_total IS NULL
  UNION ALL SELECT source_row_index, 'order_status', 'ENUM_LOOKUP' FROM f WHERE v_status IS NULL),
good AS (SELECT * FROM f WHERE source_row_index NOT IN (SELECT source_row_index FROM ev))
"""
ORACLE["orders_accepted"] = _ORDERS + f"""
SELECT {uuid5('custom.data.migration', 'v_num')} AS order_uuid, v_num AS order_num, v_email AS customer_email, v_date AS order_date, v_total AS total_amount, v_status AS order_status FROM good"""
ORACLE["orders_summary"] = _ORDERS + """
SELECT (SELECT count(*) FROM f) AS total_source_records, (SELECT count(*) FROM good) AS accepted_count, (SELECT count(*) FROM f) - (SELECT count(*) FROM good) AS rejected_count"""
ORACLE["orders_errors_by_field_rule"] = _ORDERS + "SELECT field, rule, count(*) AS error_count FROM ev GROUP BY field, rule"
ORACLE["natural_key_derivation"] = f"""
SELECT source_row_index, coalesce(nullif({strip('order_num')} || '_' || {strip('status_cd')}, ''), order_num) AS natural_key FROM ({plain('orders_src')}) s"""
ORACLE["loose_columns"] = f"SELECT nullif({squeeze('order_num')}, '') AS order_num, nullif(date_placed, '') AS placed FROM ({plain('orders_src')}) s"

_TYPED = f"""
WITH src AS ({plain('typed')}),
f AS (SELECT *,
  CASE WHEN regexp_full_match({strip('count_str')}, '-?[0-9]+') THEN cast({strip('count_str')} AS BIGINT) END AS v_count,
  CASE WHEN price_str = 'nan' THEN NULL ELSE try_cast(replace(replace(price_str, '$', ''), ',', '') AS DOUBLE) END AS v_price,
  CASE WHEN lower({strip('active_str')}) IN ('true', '1', 'yes', 'y', 't') THEN true WHEN lower({strip('active_str')}) IN ('false', '0', 'no', 'n', 'f') THEN false END AS v_active,
  CASE WHEN regexp_full_match(substr(date_str, 1, 10), '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND try_cast(substr(date_str, 1, 10) AS DATE) IS NOT NULL THEN substr(date_str, 1, 10) END AS v_date,
  CASE WHEN regexp_matches(moment_str, '^\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}') THEN moment_str END AS v_moment
  FROM src),
ev AS (
  SELECT source_row_index, 'item_count' AS field, 'Cannot coerce value ''' || {strip('count_str')} || ''' to INTEGER' AS error_message FROM f WHERE v_count IS NULL AND count_str <> ''
  UNION ALL SELECT source_row_index, 'unit_price', CASE WHEN price_str = 'nan' THEN 'Invalid numeric float value: ''nan''' ELSE 'Cannot coerce value ''' || price_str || ''' to REAL/FLOAT' END FROM f WHERE v_price IS NULL
  UNION ALL SELECT source_row_index, 'is_active', 'Cannot coerce value ''' || active_str || ''' to BOOLEAN' FROM f WHERE v_active IS NULL
  UNION ALL SELECT source_row_index, 'created_date', CASE WHEN date_str = '2024-02-31' THEN 'Invalid calendar date ''2024-02-31'': day is out of range for month'
     WHEN date_str = '2024-13-01' THEN 'Invalid calendar date ''2024-13-01'': time data ''2024-13-01'' does not match format ''%Y-%m-%d'''
     ELSE 'Expected ISO-8601 date (YYYY-MM-DD), but got: ''' || date_str || '''' END FROM f WHERE v_date IS NULL
  UNION ALL SELECT source_row_index, 'created_at', 'Expected ISO-8601 timestamp, but got: ''' || moment_str || '''' FROM f WHERE v_moment IS NULL)
"""
ORACLE["type_coercion_accepted"] = _TYPED + """
SELECT src_id, v_count AS item_count, v_price AS unit_price, v_active AS is_active, v_date AS created_date, v_moment AS created_at
FROM f WHERE source_row_index NOT IN (SELECT source_row_index FROM ev)"""
ORACLE["type_coercion_report"] = _TYPED + "SELECT source_row_index, field, 'TYPE_INCOMPATIBILITY' AS rule, error_message FROM ev"
ORACLE["required_unmapped"] = f"""
SELECT source_row_index, order_id AS natural_key, 'warehouse' AS field, 'REQUIRED_FIELD_UNMAPPED' AS rule,
  'Required target field ''warehouse'' (NOT NULL) has no mapping in MigrationPlan.' AS error_message FROM ({plain('orders_src')}) s"""
ORACLE["constraint_checks"] = f"""
SELECT source_row_index, coalesce(nullif({squeeze('account_status_code')}, ''), '1') AS status_filled,
  CASE WHEN risk_flag IN ('HIGH', 'LOW', 'N') THEN risk_flag ELSE 'N' END AS risk_filled,
  CASE WHEN regexp_matches(phone_raw, '^\\+1\\d+$') THEN phone_raw END AS phone_or_null,
  CASE WHEN {strip('account_status_code')} = '' THEN 'NOT_NULL_CONSTRAINT' END AS status_required_rule,
  CASE WHEN risk_flag NOT IN ('HIGH', 'LOW', 'N') THEN 'ENUM_CONSTRAINT' END AS risk_rule,
  CASE WHEN NOT regexp_matches(phone_raw, '^\\+1\\d+$') THEN 'REGEX_CONSTRAINT' END AS phone_rule
FROM ({plain('crm')}) s"""

# -- profiling ------------------------------------------------------------------------------------------------


def _cells(source: str, columns: list[str], index: str = "0") -> str:
    return " UNION ALL ".join(
        f"SELECT {q(c)} AS column_name, {i} AS position, cast({c} AS VARCHAR) AS value, {index} AS seen FROM {source}" for i, c in enumerate(columns)
    )


def _profile(prefix: str, source: str, columns: list[str]) -> str:
    ok = f"NOT {blank('value')}"
    flags = ", ".join(
        f"CASE WHEN bool_or({ok} AND {test}) THEN {q(text)} END"
        for test, text in zip(
            ["contains(value, ',')", "(contains(value, '/') OR contains(value, '-'))", "(starts_with(value, '$') OR contains(value, '('))", "regexp_matches(value, '[0-9]{3}')"],
            fixed.PATTERN_FLAGS.values(),
        )
    )
    return f"""{prefix} SELECT column_name, position, count(*) AS total_records, count(*) FILTER ({ok}) AS non_null_count, count(*) FILTER (NOT ({ok})) AS null_count,
  round(100.0 * count(*) FILTER (NOT ({ok})) / count(*), 2)::DOUBLE AS null_percentage, count(DISTINCT value) FILTER ({ok}) AS distinct_count,
  concat_ws('; ', {flags}) AS patterns_detected FROM ({_cells(source, columns)}) c GROUP BY column_name, position"""


_WITH_CRM = f"WITH src AS ({plain('crm')})"
ORACLE["profile_crm"] = _profile(_WITH_CRM, "src", CRM_COLUMNS)
ORACLE["profile_documents"] = _profile("", "documents", ["text", "lang", "source", "n_chars"])
ORACLE["profile_orders"] = _profile("", "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


def _ranked(order: str, k: int, columns: str) -> str:
    return f"""{_WITH_CRM}, vc AS (SELECT column_name, value, count(*) AS count, min(seen) AS seen FROM ({_cells('src', CRM_COLUMNS, 'source_row_index')}) c
  WHERE NOT {blank('value')} GROUP BY column_name, value)
SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY {order}) AS rank FROM vc) r WHERE rank <= {k}"""


ORACLE["profile_top_values"] = _ranked("count DESC, value", 10, "column_name, rank, value, count")
ORACLE["profile_top_values_first_seen"] = _ranked("count DESC, seen", 10, "column_name, rank, value, count")
ORACLE["profile_sample_values"] = _ranked("value", 8, "column_name, rank, value")


def _infer(prefix: str, source: str, columns: list[str]) -> str:
    return f"""{prefix} SELECT position, column_name AS name,
  CASE WHEN bool_and(regexp_full_match(value, '-?[0-9]+')) FILTER (NOT {blank('value')}) THEN 'int'
       WHEN bool_and(regexp_full_match(value, '-?[0-9]+(\\.[0-9]+)?')) FILTER (NOT {blank('value')}) THEN 'float' ELSE 'string' END AS data_type,
  bool_or({blank('value')}) AS nullable FROM ({_cells(source, columns)}) c GROUP BY position, column_name"""


ORACLE["infer_schema_crm"] = _infer(_WITH_CRM, "src", CRM_COLUMNS)
ORACLE["infer_schema_lineitem"] = _infer(
    "WITH src AS (SELECT l_orderkey, l_linenumber, cast(l_quantity AS DECIMAL(18,2)) AS l_quantity, l_returnflag FROM lineitem)",
    "src", ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"],
)


def _trial(column: str, rule: str, error: str) -> str:
    return f"""SELECT {q(column)} AS column_name, {q(rule)} AS rule_id, count(*) AS tested_sample_size, count(*) FILTER (({error}) IS NULL) AS success_count,
  count(*) FILTER (({error}) IS NOT NULL) AS error_count, round(100.0 * count(*) FILTER (({error}) IS NULL) / count(*), 2)::DOUBLE AS success_rate_percent FROM src"""


ORACLE["rule_trial"] = _WITH_CRM + " UNION ALL ".join(
    [
        _trial("signup_date_str", "DATE_TO_ISO8601", f"CASE WHEN {date_iso('signup_date_str')} IS NULL THEN 'x' END"),
        _trial("phone_raw", "PHONE_TO_E164", phone_error("phone_raw", False)),
        _trial("email_address", "EMAIL_NORMALIZE", f"CASE WHEN NOT {blank('email_address')} AND NOT {email_ok('email_address')} THEN 'x' END"),
    ]
)
ORACLE["rule_trial_errors"] = f"""{_WITH_CRM} SELECT source_row_index AS row_index, email_address AS raw_value, 'Invalid email format: ''' || email_address || '''' AS error_message
FROM src WHERE NOT {blank('email_address')} AND NOT {email_ok('email_address')} ORDER BY source_row_index LIMIT 5"""
ORACLE["head_sample"] = f"SELECT * FROM ({plain('orders_src')}) s ORDER BY source_row_index LIMIT 100"

# -- upsert ---------------------------------------------------------------------------------------------------

_ACCOUNTS = f"""
WITH t AS ({plain('target')}), b AS (SELECT *, trim(account_code) AS code FROM ({plain('batch')}) x),
o AS (SELECT *, row_number() OVER w AS n, lag(status) OVER w AS p_status, lag(score) OVER w AS p_score FROM b WINDOW w AS (PARTITION BY code ORDER BY source_row_index)),
a AS (SELECT o.source_row_index, o.code, CASE WHEN n > 1 THEN CASE WHEN o.status = p_status AND o.score = p_score THEN 'skip' ELSE 'update' END
        WHEN t.account_code IS NULL THEN 'insert' WHEN o.status = t.status AND o.score = t.score THEN 'skip' ELSE 'update' END AS action
      FROM o LEFT JOIN t ON o.code = t.account_code),
a2 AS (SELECT o.source_row_index, CASE WHEN n = 1 AND t.account_code IS NULL THEN 'insert' ELSE 'update' END AS action FROM o LEFT JOIN t ON o.code = t.account_code),
w AS (SELECT o.code, arg_max(status, o.source_row_index) AS status, arg_max(score, o.source_row_index) AS score, arg_min(account_id, o.source_row_index) AS account_id,
        bool_or(action <> 'skip') AS changed FROM o JOIN a ON o.source_row_index = a.source_row_index GROUP BY o.code)
"""
ORACLE["upsert_actions"] = ORACLE["upsert_actions_small_blocks"] = _ACCOUNTS + "SELECT source_row_index, action FROM a"
_COUNTS = """SELECT count(*) FILTER (action = 'insert') AS inserted_count, count(*) FILTER (action = 'update') AS updated_count, count(*) FILTER (action = 'skip') AS skipped_count FROM """
ORACLE["upsert_counts"] = _ACCOUNTS + _COUNTS + "a"
ORACLE["upsert_all_counts"] = _ACCOUNTS + _COUNTS + "a2"


def _merged(changed: str) -> str:
    return f"""SELECT coalesce(t.account_id, w.account_id) AS account_id, coalesce(t.account_code, w.code) AS account_code,
  CASE WHEN w.code IS NULL THEN t.status ELSE w.status END AS status, CASE WHEN w.code IS NULL THEN t.score ELSE w.score END AS score,
  CASE WHEN {changed} THEN 'run_1' ELSE t.migration_run_id END AS migration_run_id, CASE WHEN {changed} THEN '{AT}' ELSE t.migrated_at END AS migrated_at
FROM t FULL OUTER JOIN w ON t.account_code = w.code"""


ORACLE["upsert_merged"] = _ACCOUNTS + _merged("w.code IS NOT NULL AND w.changed")
ORACLE["upsert_all_merged"] = _ACCOUNTS + _merged("w.code IS NOT NULL")
ORACLE["upsert_rollback_diff"] = _ACCOUNTS + f""", m AS ({_merged('w.code IS NOT NULL AND w.changed')})
SELECT m.account_code, CASE WHEN t.account_code IS NULL THEN 'removed' ELSE 'changed' END AS change FROM m LEFT JOIN t ON m.account_code = t.account_code
WHERE t.account_code IS NULL OR m.status <> t.status OR m.score <> t.score OR m.account_id <> t.account_id"""
ORACLE["key_duplicates"] = "SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"
ORACLE["constraint_violations"] = f"""
WITH b AS ({plain('batch')})
SELECT 'status' AS column_name, 'ENUM' AS "constraint", count(*) AS violations FROM b WHERE status NOT IN ('click', 'view', 'signup')
UNION ALL SELECT 'account_code', 'UNIQUE', count(*) FROM (SELECT account_code FROM b GROUP BY account_code HAVING count(*) > 1) d"""
_OLD_PK = "('C' || cast(o_custkey AS VARCHAR))"
ORACLE["primary_key_collisions"] = f"""
WITH o AS (SELECT {_OLD_PK} AS pk, cast(o_orderkey AS VARCHAR) AS order_code, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
t AS (SELECT account_id FROM ({plain('target')}) x WHERE status = 'click')
SELECT CASE WHEN n > 1 OR account_id IS NOT NULL THEN {uuid5('rekey', "pk || '|' || order_code")} ELSE pk END AS account_id, order_code,
  (n > 1 OR account_id IS NOT NULL) AS rekeyed FROM o LEFT JOIN t ON o.pk = t.account_id"""
ORACLE["schema_evolution_union"] = """
SELECT c_name AS name, c_nationkey AS nation, c_mktsegment, cast(NULL AS VARCHAR) AS code FROM customer
UNION ALL SELECT s_name, s_nationkey, NULL, cast(s_suppkey AS VARCHAR) FROM supplier"""

# -- reconciliation -------------------------------------------------------------------------------------------


def _reconcile(duplicates: str, events: str) -> str:
    return f"""
WITH m AS ({plain('run_metrics')}), l AS (SELECT run_id, count(*) AS n FROM ({plain('run_ledger')}) x GROUP BY run_id),
rb AS ({events}), d AS (SELECT count(*) AS dup FROM ({duplicates}) x),
r AS (SELECT m.run_id, m.total_source_records::BIGINT AS total_source_records, (rb.run_id IS NOT NULL) AS rolled_back, coalesce(l.n, 0) AS quarantined_records,
  CASE WHEN rb.run_id IS NOT NULL THEN 0 ELSE (inserted_count + updated_count + skipped_count)::BIGINT END AS target_accepted_records, dup AS duplicate_count
  FROM m LEFT JOIN l ON m.run_id = l.run_id LEFT JOIN rb ON m.run_id = rb.run_id, d),
g AS (SELECT *, CASE WHEN rolled_back THEN 0 ELSE total_source_records - target_accepted_records - quarantined_records END AS unaccounted_records FROM r),
v AS (SELECT *, CASE WHEN rolled_back THEN 'ROLLED_BACK' WHEN unaccounted_records <> 0 OR duplicate_count > 0 THEN 'DISCREPANCY_DETECTED'
  WHEN quarantined_records = 0 THEN 'PASSED_EXACT' ELSE 'PASSED_WITH_QUARANTINE' END AS verdict FROM g)
"""


_UNDONE = f"SELECT DISTINCT run_id FROM ({plain('run_events')}) e WHERE event_type = 'MIGRATION_ROLLED_BACK'"
ORACLE["reconcile_all_runs"] = _reconcile("SELECT o_orderkey FROM orders GROUP BY o_orderkey HAVING count(*) > 1", _UNDONE) + """
SELECT run_id, total_source_records, target_accepted_records, quarantined_records, rolled_back, duplicate_count, unaccounted_records, verdict,
  (verdict <> 'DISCREPANCY_DETECTED') AS invariants_passed FROM v"""
ORACLE["reconcile_with_duplicates"] = _reconcile(ORACLE["key_duplicates"], "SELECT '' AS run_id") + "SELECT run_id, duplicate_count, verdict FROM v"
ORACLE["latest_run"] = f"SELECT arg_max(run_id, seq) AS run_id FROM ({plain('run_events')}) e WHERE event_type = 'MIGRATION_EXECUTED'"
ORACLE["rolled_back_runs"] = _UNDONE
ORACLE["quarantine_per_run"] = f"SELECT run_id, count(*) AS quarantined FROM ({plain('run_ledger')}) l GROUP BY run_id"
_CASH = "cast(coalesce(sum(coalesce(cash, 0)), 0) AS DECIMAL(38,2))"
ORACLE["money_reconciliation"] = _ORDERS + f""",
s AS (SELECT count(*) AS source_rows, {_CASH} AS s FROM f),
h AS (SELECT {_CASH} AS q FROM f WHERE source_row_index IN (SELECT source_row_index FROM ev)),
k AS (SELECT count(*) AS target_rows, cast(coalesce(sum(cast(v_total AS DECIMAL(18,2))), 0) AS DECIMAL(38,2)) AS t FROM good)
SELECT source_rows, target_rows, s::DOUBLE AS source_sum, q::DOUBLE AS quarantined_sum, t::DOUBLE AS target_sum, abs(s - t)::DOUBLE AS delta,
  substr(sha256('SRC_' || source_rows || '_' || s), 1, 16) AS source_checksum, substr(sha256('TGT_' || target_rows || '_' || t), 1, 16) AS target_checksum
FROM s, h, k"""

# -- remediation, suggestion, paging, files -------------------------------------------------------------------

_STILL = "(e_first IS NOT NULL OR e_balance IS NOT NULL OR e_country IS NOT NULL)"
_BEFORE = "(e_first IS NOT NULL OR e_email IS NOT NULL OR e_phone IS NOT NULL OR e_joined IS NOT NULL OR e_balance IS NOT NULL OR e_country IS NOT NULL)"
ORACLE["remediation_impact"] = _CRM + f"""
SELECT CASE WHEN {_STILL} THEN 'still_rejected' WHEN {_BEFORE} THEN 'fixed' ELSE 'unchanged' END AS outcome, count(*) AS rows FROM f GROUP BY 1"""
ORACLE["remediation_one_field"] = _CRM + f"""
SELECT source_row_index, NOT {_BEFORE} AS before, NOT {_BEFORE.replace(' OR e_joined IS NOT NULL', '')} AS after FROM f"""
ORACLE["remediation_orders"] = _ORDERS + """
SELECT CASE WHEN order_total_str IN ('', 'twelve') THEN 'still_rejected' WHEN source_row_index IN (SELECT source_row_index FROM ev) THEN 'fixed' ELSE 'unchanged' END AS outcome,
  count(*) AS rows FROM f GROUP BY 1"""
_NULLS = " UNION ALL ".join(
    f"SELECT {q(c)} AS source_field, round(100.0 * count(*) FILTER ({blank(c)}) / count(*), 2)::DOUBLE AS null_percentage FROM src" for c in CRM_COLUMNS
)
ORACLE["suggested_mapping"] = f"""{_WITH_CRM}, p AS ({_NULLS}),
m(position, target_field, source_field, transformation, base, nullable) AS (VALUES
 (0, 'customer_uuid', 'legacy_account_id', 'UUID_V5_FROM_KEY', 'LOW', false), (1, 'natural_key', 'legacy_account_id', 'DIRECT_COPY', 'LOW', false),
 (2, 'first_name', 'full_name_raw', 'SPLIT_NAME', 'LOW', false), (3, 'last_name', 'full_name_raw', 'SPLIT_NAME', 'LOW', true),
 (4, 'email', 'email_address', 'EMAIL_NORMALIZE', 'MEDIUM', false), (5, 'phone_e164', 'phone_raw', 'PHONE_TO_E164', 'MEDIUM', true),
 (6, 'joined_at', 'signup_date_str', 'DATE_TO_ISO8601', 'MEDIUM', false), (7, 'status', 'account_status_code', 'ENUM_LOOKUP', 'HIGH', false),
 (8, 'balance_due', 'balance_due_str', 'CLEAN_CURRENCY_TO_FLOAT', 'LOW', false), (9, 'risk_tier', 'risk_flag', 'ENUM_LOOKUP', 'HIGH', false),
 (10, 'country_iso2', 'country_code_raw', 'COUNTRY_TO_ISO2', 'LOW', false))
SELECT position, target_field, m.source_field, transformation, null_percentage, CASE WHEN NOT nullable AND null_percentage > 0 THEN 'HIGH' ELSE base END AS risk_level
FROM m JOIN p ON m.source_field = p.source_field"""
ORACLE["target_page"] = f"SELECT * FROM ({plain('target')}) t ORDER BY account_code LIMIT 50 OFFSET 20"
ORACLE["audit_latest"] = f"SELECT * FROM ({plain('run_events')}) e ORDER BY seq DESC LIMIT 50"
ORACLE["source_delimited"] = f"SELECT order_id, order_num, cust_email_raw, order_total_str FROM ({plain('orders_src')}) s"
ORACLE["source_json_lines"] = f"SELECT order_id, order_total_str FROM ({plain('orders_src')}) s"
ORACLE["source_row_index"] = "SELECT count(*) AS row_count, 0::BIGINT AS first_pos, count(*) - 1 AS last_pos, count(*) AS distinct_pos FROM lineitem"
ORACLE["target_export"] = _ORDERS + "SELECT v_num AS order_num, v_email AS customer_email, v_status AS order_status FROM good"
ORACLE["ledger_read_back"] = _ORDERS + f"""
SELECT {_QID.replace(RUN, 'run_a')} AS quarantine_id, source_row_index, 'run_a' AS run_id, count(*)::INTEGER AS error_count FROM ev GROUP BY source_row_index"""
ORACLE["store_upsert_rollback"] = f"SELECT account_id, account_code, status, score FROM ({plain('target')}) t"

_BUCKET = "(('0x' || substr(md5(account_code), 1, 8))::BIGINT % 64)"
ORACLE["store_bucketed_upsert"] = f"""
WITH t AS (SELECT account_id, account_code, status, score FROM ({plain('target')}) x),
n AS (SELECT 'N' || n_nationkey::VARCHAR AS account_id, 'U' || n_nationkey::VARCHAR AS account_code, n_name AS status, 1.0::DOUBLE AS score FROM nation),
m AS (SELECT coalesce(t.account_id, n.account_id) AS account_id, account_code, coalesce(n.status, t.status) AS status, coalesce(n.score, t.score) AS score,
  CASE WHEN n.account_code IS NULL THEN 'run_1' ELSE 'run_2' END AS migration_run_id FROM t FULL OUTER JOIN n USING (account_code)),
b AS (SELECT DISTINCT {_BUCKET} AS bucket FROM n)
SELECT 0 AS version, account_id, account_code, status, score, 'run_1' AS migration_run_id, true AS rewritten FROM t
UNION ALL SELECT 1, account_id, account_code, status, score, migration_run_id, {_BUCKET} IN (SELECT bucket FROM b) FROM m"""
ORACLE["store_unique_values"] = f"""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY territory ORDER BY source_row_index) AS place FROM ({plain('customer_territories')}) x),
s AS (SELECT s.*, c.code AS holder, row_number() OVER (PARTITION BY s.territory ORDER BY s.source_row_index) AS place
  FROM ({plain('supplier_territories')}) s LEFT JOIN (SELECT * FROM c WHERE place = 1) c ON s.territory = c.territory)
SELECT 'run_1' AS run_id, code, territory, CASE WHEN place > 1 THEN 'the value belongs to another row of the batch' END AS refused FROM c
UNION ALL SELECT 'run_2', code, territory, CASE WHEN holder IS NOT NULL THEN 'the value belongs to another row of the target'
  WHEN place > 1 THEN 'the value belongs to another row of the batch' END FROM s"""

ORACLE["source_delimited_quoted"] = """
SELECT doc_id::VARCHAR AS doc_id, coalesce('"' || replace(text, ', ', '", "') || '"', '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  coalesce(n_chars::VARCHAR, '') AS n_chars FROM documents"""
ORACLE["source_delimited_ragged"] = f"""
SELECT source_row_index::VARCHAR AS row, coalesce(order_num, '') AS order_num, CASE WHEN source_row_index % 7 <> 0 AND source_row_index % 11 = 0 THEN '' ELSE coalesce(order_total_str, '') END AS order_total,
  CASE WHEN source_row_index % 7 = 0 THEN concat_ws('|', source_row_index::VARCHAR, order_num, order_total_str, 'late', 'x') END AS extra_fields FROM ({plain('orders_src')}) t"""
ORACLE["source_delimited_tabs"] = """
SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, c_acctbal::VARCHAR AS c_acctbal, c_mktsegment
FROM customer"""
ORACLE["source_json_array"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::INTEGER::BIGINT AS l_quantity, '}]{"' || l_returnflag || chr(92) || '", [' AS remark FROM lineitem"""
ORACLE["source_json_wrapped"] = "SELECT * FROM customer"
ORACLE["upsert_null_keys"] = f"""
WITH f AS (SELECT source_row_index, CASE WHEN source_row_index % 4 <> 0 THEN trim(account_code) END AS code, status FROM ({plain('batch')}) b)
SELECT NULL::BIGINT AS source_row_index, code, arg_max(status, source_row_index) AS status, NULL::VARCHAR AS rule FROM f WHERE code IS NOT NULL GROUP BY code
UNION ALL SELECT source_row_index, NULL, NULL, 'UPSERT_KEY_IS_NULL' FROM f WHERE code IS NULL"""


def _trial(position: int, field: str, column: str, rule: str, good: str) -> str:
    return (
        f"SELECT {position} AS position, {q(field)} AS target_field, {q(column)} AS source_field, {q(rule)} AS transformation, "
        f"count(*) FILTER (NOT {blank(column)}) AS filled, count(*) FILTER (NOT {blank(column)} AND coalesce({good}, false)) AS accepted FROM src"
    )


def _upper_name(x: str, part: str) -> str:
    return f"({first_name(x) if part == 'first' else last_name(x)}) <> ''"


_ACCOUNT, _NAME, _MAIL, _PHONE, _DAY = "legacy_account_id", "full_name_raw", "email_address", "phone_raw", "signup_date_str"
_STATUS, _MONEY, _RISK, _COUNTRY = "account_status_code", "balance_due_str", "risk_flag", "country_code_raw"
_NUMBER = f"try_cast({_MONEY} AS DOUBLE) IS NOT NULL"
_TRIALS = [
    (0, "customer_uuid", _ACCOUNT, "UUID_V5_FROM_KEY", "true"), (0, "customer_uuid", _ACCOUNT, "DIRECT_COPY", "true"), (1, "natural_key", _ACCOUNT, "DIRECT_COPY", "true"),
    (2, "first_name", _NAME, "SPLIT_NAME", _upper_name(_NAME, "first")), (2, "first_name", _NAME, "DIRECT_COPY", "true"),
    (3, "last_name", _NAME, "SPLIT_NAME", _upper_name(_NAME, "last")), (3, "last_name", _NAME, "DIRECT_COPY", "true"),
    (4, "email", _MAIL, "EMAIL_NORMALIZE", email_ok(_MAIL)), (4, "email", _MAIL, "DIRECT_COPY", "true"),
    (5, "phone_e164", _PHONE, "PHONE_TO_E164", f"{phone_value(_PHONE)} IS NOT NULL"),
    (5, "phone_e164", _PHONE, "DIRECT_COPY", f"regexp_matches({_PHONE}, '^\\+[1-9][0-9]{{1,14}}$')"),
    (6, "joined_at", _DAY, "DATE_TO_ISO8601", f"{date_iso(_DAY)} IS NOT NULL"), (6, "joined_at", _DAY, "DIRECT_COPY", "true"),
    (7, "status", _STATUS, "ENUM_LOOKUP", f"lower({strip(_STATUS)}) IN ('1', '0', '9', 'true', 'false', 'active', 'inactive', 'suspended', 'terminated')"),
    (7, "status", _STATUS, "DIRECT_COPY", f"{_STATUS} IN ('ACTIVE', 'INACTIVE', 'SUSPENDED', 'TERMINATED')"),
    (8, "balance_due", _MONEY, "CLEAN_CURRENCY_TO_FLOAT", f"{money(_MONEY)} IS NOT NULL"), (8, "balance_due", _MONEY, "DIRECT_COPY", _NUMBER),
    (9, "risk_tier", _RISK, "ENUM_LOOKUP", f"lower({strip(_RISK)}) IN ('low', 'n', 'med', 'medium', 'high', 'y', 'standard', 'elevated', 'critical')"),
    (9, "risk_tier", _RISK, "DIRECT_COPY", f"{_RISK} IN ('STANDARD', 'ELEVATED', 'CRITICAL')"),
    (10, "country_iso2", _COUNTRY, "COUNTRY_TO_ISO2", "v_country_known"), (10, "country_iso2", _COUNTRY, "DIRECT_COPY", f"regexp_matches({_COUNTRY}, '^[A-Z]{{2}}$')"),
]
_KNOWN = "(source_row_index IN (SELECT source_row_index FROM ({}) k WHERE value IS NOT NULL))".format(ORACLE["rule_country"])
ORACLE["suggested_mapping_tried"] = f"""{_WITH_CRM}, t AS ({' UNION ALL '.join(_trial(*t).replace('v_country_known', _KNOWN) for t in _TRIALS)}),
u AS (SELECT *, round(100.0 * accepted / filled, 2)::DOUBLE AS accepted_percentage FROM t)
SELECT *, row_number() OVER (PARTITION BY position ORDER BY accepted_percentage < 50, transformation = 'DIRECT_COPY', accepted_percentage DESC) AS choice FROM u"""

ORACLE["reconcile_run_states"] = f"""
WITH h AS ({plain('run_history')}), m AS ({plain('run_recorded')}),
e AS (SELECT run_id, count(*) FILTER (event_type = 'DRY_RUN_EXECUTED') AS simulations, count(*) FILTER (event_type IN ('MIGRATION_EXECUTED', 'MIGRATION_RETRIED')) AS executions,
  count(*) FILTER (event_type = 'MIGRATION_ROLLED_BACK') AS rollbacks, max(seq) FILTER (event_type = 'MIGRATION_ROLLED_BACK') AS undone,
  max(seq) FILTER (event_type IN ('MIGRATION_EXECUTED', 'MIGRATION_RETRIED')) AS done FROM h GROUP BY run_id),
l AS (SELECT run_id, count(*) AS n FROM ({plain('run_ledger')}) x GROUP BY run_id),
r AS (SELECT run_id, CASE WHEN m.total_source_records IS NULL THEN 'simulated' WHEN undone > done THEN 'rolled_back' ELSE 'executed' END AS state,
  coalesce(simulations, 0) AS simulations, coalesce(executions, 0) AS executions, coalesce(rollbacks, 0) AS rollbacks,
  coalesce(total_source_records, 0)::BIGINT AS total_source_records, coalesce(inserted_count + updated_count + skipped_count, 0)::BIGINT AS accepted, coalesce(n, 0) AS quarantined_records
  FROM e FULL OUTER JOIN m USING (run_id) FULL OUTER JOIN l USING (run_id)),
s AS (SELECT * EXCLUDE (accepted), CASE WHEN state = 'executed' THEN accepted ELSE 0 END AS target_accepted_records,
  CASE WHEN state = 'executed' THEN total_source_records - accepted - quarantined_records ELSE 0 END AS unaccounted_records FROM r)
SELECT *, CASE state WHEN 'simulated' THEN 'PENDING_EXECUTION' WHEN 'rolled_back' THEN 'ROLLED_BACK' ELSE
  CASE WHEN unaccounted_records <> 0 THEN 'DISCREPANCY_DETECTED' WHEN quarantined_records = 0 THEN 'PASSED_EXACT' ELSE 'PASSED_WITH_QUARANTINE' END END AS verdict FROM s"""

_CODES = f"SELECT lower(trim(code)) AS code, min(brand) AS brand, count(DISTINCT brand) AS variants FROM ({plain('part_codes')}) c GROUP BY 1"
ORACLE["rule_enum_table"] = f"""
WITH c AS ({_CODES}), x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 9 = 0 THEN 'p-' || (l_partkey + 1)::VARCHAR WHEN l_partkey % 10 = 1 THEN ' ' ELSE ' P-' || l_partkey::VARCHAR || ' ' END AS raw FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN variants = 1 THEN brand END AS value,
  CASE WHEN trim(raw) = '' THEN {q(fixed.MSG_ENUM_MISSING)} WHEN variants > 1 THEN 'the code ' || chr(39) || raw || chr(39) || ' stands for more than one value' WHEN variants IS NULL THEN 'there is no code ' || chr(39) || raw || chr(39) END AS error
FROM x LEFT JOIN c ON lower(trim(raw)) = c.code"""
ORACLE["code_table_repeated"] = f"SELECT code, variants FROM ({_CODES}) c WHERE variants > 1"
ORACLE["profile_distinct_sketches"] = " UNION ALL ".join(
    f"SELECT {q(c)} AS column_name, count(*) AS total_records, count(DISTINCT {c}) AS distinct_count, true AS within_bound, true AS halves_equal_whole FROM lineitem"
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
)
ORACLE["profile_empty_table"] = " UNION ALL ".join(
    f"SELECT {q(c)} AS column_name, {i} AS position, 0::BIGINT AS total_records, 0::BIGINT AS non_null_count, 0::BIGINT AS null_count, 0.0::DOUBLE AS null_percentage, 0::BIGINT AS distinct_count, '' AS patterns_detected"
    for i, c in enumerate(("event_id", "ts", "user_id", "event_type", "value", "props"))
)

_RUN_COUNTS = "(SELECT count(*) FROM good)::VARCHAR AS good, ((SELECT count(*) FROM f) - (SELECT count(*) FROM good))::VARCHAR AS bad"
ORACLE["audit_of_a_run"] = _ORDERS + f""", c AS (SELECT {_RUN_COUNTS})
SELECT seq, event_type, actor, run_id, CASE WHEN seq = 0 THEN '1' WHEN seq IN (1, 2, 4) THEN '2' END AS plan_version, CASE WHEN seq >= 3 THEN good END AS rows, CASE WHEN seq IN (3, 4) THEN bad END AS refused
FROM c, (VALUES (0, 'PLAN_CREATED', 'planner', ''), (1, 'PLAN_UPDATED', 'planner', ''), (2, 'PLAN_APPROVED', 'owner', ''), (3, 'DRY_RUN_EXECUTED', 'Simulator', 'run_0'),
  (4, 'MIGRATION_EXECUTED', 'Data Engineer', 'run_1'), (5, 'MIGRATION_ROLLED_BACK', 'owner', 'run_1')) e(seq, event_type, actor, run_id)"""
ORACLE["store_commit_log"] = f"""
WITH t AS (SELECT count(*) AS n FROM ({plain('target')}) x),
m AS (SELECT count(*) AS n FROM (SELECT account_code FROM ({plain('target')}) x UNION SELECT trim(account_code) FROM ({plain('batch')}) y) z)
SELECT seq, version, action, run_id, parent, CASE version WHEN 0 THEN 0 WHEN 1 THEN t.n ELSE m.n END AS version_rows, t.n AS current_rows
FROM t, m, (VALUES (0, 0, 'write', 'run_0', NULL), (1, 1, 'write', 'run_1', 0), (2, 2, 'write', 'run_2', 1), (3, 1, 'rollback', 'run_2', NULL)) l(seq, version, action, run_id, parent)"""
ORACLE["reconcile_balance_sheet"] = _reconcile("SELECT o_orderkey FROM orders GROUP BY o_orderkey HAVING count(*) > 1", _UNDONE) + """
SELECT run_id, position, measure, CASE position WHEN 0 THEN total_source_records WHEN 1 THEN target_accepted_records WHEN 2 THEN quarantined_records WHEN 3 THEN unaccounted_records ELSE duplicate_count END AS value,
  verdict = 'DISCREPANCY_DETECTED' AND ((position = 3 AND unaccounted_records <> 0) OR (position = 4 AND duplicate_count <> 0)) AS broken
FROM v, (VALUES (0, 'read'), (1, 'kept'), (2, 'quarantined'), (3, 'missing'), (4, 'repeated keys')) m(position, measure)"""
ORACLE["target_totals"] = _ORDERS + "SELECT count(*) AS target_rows, coalesce(sum(cast(v_total AS DECIMAL(18,2))), 0)::DOUBLE AS target_sum FROM good"
ORACLE["write_guards"] = f"""
WITH t AS ({plain('typed')})
SELECT 'NOT NULL' AS guard, 'count_str' AS column_name, count(*) FILTER (count_str IS NULL) AS violations FROM t
UNION ALL SELECT 'NOT NULL', 'active_str', count(*) FILTER (active_str = 'maybe') FROM t
UNION ALL SELECT 'NOT NULL', 'region', count(*) FROM t
UNION ALL SELECT 'NUMBER', 'count_str', count(*) FILTER (trim(count_str) <> '' AND NOT regexp_full_match(trim(count_str), '[+-]?[0-9]+')) FROM t
UNION ALL SELECT 'NUMBER', 'price_str', count(*) FILTER (trim(price_str) <> '' AND try_cast(replace(replace(trim(price_str), '$', ''), ',', '') AS DOUBLE) IS NULL) FROM t"""
ORACLE["ledger_page"] = _ORDERS + f"""
SELECT {_QID.replace(RUN, 'run_a')} AS quarantine_id, source_row_index, count(*)::INTEGER AS error_count, '{AT}' AS created_at FROM ev
GROUP BY source_row_index ORDER BY source_row_index LIMIT 20 OFFSET 5"""

for _name, _of in (("hard_values_evidence", "conform_evidence"), ("hard_values_accepted", "conform_accepted")):
    ORACLE[_name] = ORACLE[_of].replace(plain("crm"), plain("hard"))
