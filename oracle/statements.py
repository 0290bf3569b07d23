"""SQL for DuckDB that computes what the registered queries compute.

Column names and types, the texts of the rule catalog and the derivation of the source tables are
data and come from the package; everything else, the predicates of rules, issues and rejects
among it, is spelled out here on its own.
"""

from __future__ import annotations

import re

from oresmith.plans.contracts import CUSTOMER, DATE, ITEM, SALES, STORE, Contract
from oresmith.rules.catalog import BRONZE_KEYS, OWNERS, RULES, VALIDATION_MODES
from oresmith.sources import retail

DUCK = retail.Dialect(
    day_name="dayname({})",
    weekday="dayofweek({})",
    days_since="datediff('day', DATE '1900-01-01', {})",
    moment="TIMESTAMP '{}'",
)

LATEST = "row_number() OVER (PARTITION BY {keys} ORDER BY {order}) = 1"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# --- common table expressions --------------------------------------------------------------


def _typed(contract: Contract, *more: str) -> str:
    columns = []
    for field in contract.fields:
        if field.type != "string":
            columns.append(f"TRY_CAST({field.name} AS {field.type}) AS {field.name}")
        elif field.clean == "blank":
            columns.append(f"nullif(trim({field.name}), '') AS {field.name}")
        elif field.clean == "trim":
            columns.append(f"trim({field.name}) AS {field.name}")
        else:
            columns.append(field.name)
    return ", ".join([*columns, *more])


def _lost(contract: Contract) -> str:
    """What a row loses to the contract's types, as text."""
    parts = [
        f"CASE WHEN {f.name} IS NOT NULL AND TRY_CAST({f.name} AS {f.type}) IS NULL "
        f"THEN '{f.name}=' || CAST({f.name} AS VARCHAR) END"
        for f in contract.fields
        if f.type != "string"
    ]
    return f"nullif(concat_ws('; ', {', '.join(parts)}), '') AS cast_failed"


def _latest(source: str, contract: Contract, name: str, *more: str) -> str:
    typed = _typed(contract, *more, _lost(contract), "loaded_at AS ingestion_timestamp", f"{text(name)} AS source_table")
    window = LATEST.format(keys=", ".join(contract.key), order="ingestion_timestamp DESC NULLS LAST")
    return f"SELECT * FROM (SELECT {typed} FROM {source}) t QUALIFY {window}"


DATE_DERIVED = (
    "CAST(d_year AS VARCHAR) || '-' || lpad(CAST(d_moy AS VARCHAR), 2, '0') AS year_month",
    "coalesce(d_weekend = 'Y', false) AS is_weekend",
)

DATE_RULES = """d_date_sk IS NOT NULL AND d_date_sk > 0 AND d_date IS NOT NULL AND d_year BETWEEN 1900 AND 2100
    AND d_moy BETWEEN 1 AND 12 AND d_dom BETWEEN 1 AND 31 AND d_dow BETWEEN 0 AND 6 AND d_qoy BETWEEN 1 AND 4"""
ITEM_RULES = """i_item_sk > 0 AND i_item_id IS NOT NULL AND i_current_price >= 0
    AND (i_wholesale_cost >= 0 OR i_wholesale_cost IS NULL)"""
STORE_RULES = """s_store_sk > 0 AND s_store_id IS NOT NULL AND s_store_name IS NOT NULL
    AND coalesce(s_number_employees, 0) >= 0 AND coalesce(s_floor_space, 0) >= 0"""
CUSTOMER_RULES = """c_customer_sk > 0 AND c_customer_id IS NOT NULL AND coalesce(c_birth_year, 2000) BETWEEN 1900 AND 2100
    AND coalesce(c_birth_month, 1) BETWEEN 1 AND 12 AND coalesce(c_birth_day, 1) BETWEEN 1 AND 31"""
SALES_RULES = """ss_ticket_number IS NOT NULL AND ss_item_sk > 0 AND ss_quantity > 0
    AND coalesce(ss_sales_price, 0) >= 0 AND coalesce(ss_list_price, 0) >= 0
    AND coalesce(ss_wholesale_cost, 0) >= 0 AND coalesce(ss_net_paid, 0) >= 0
    AND (ss_sales_price IS NULL OR ss_list_price IS NULL OR ss_sales_price <= 1.5 * ss_list_price)"""


def _resolved(p: str) -> str:
    """Reference filter against dimensions with prefix ``p``."""
    return f"""ss_item_sk IN (SELECT i_item_sk FROM {p}item)
        AND (ss_sold_date_sk IS NULL OR ss_sold_date_sk IN (SELECT d_date_sk FROM {p}date))
        AND (ss_store_sk IS NULL OR ss_store_sk IN (SELECT s_store_sk FROM {p}store))
        AND (ss_customer_sk IS NULL OR ss_customer_sk IN (SELECT c_customer_sk FROM {p}customer))"""


def _exists(column: str, table: str, key: str) -> str:
    return f"({column} IS NOT NULL AND {column} IN (SELECT {key} FROM {table}))"


def _ratio(part: str, whole: str, scale: int = 10) -> str:
    return f"CAST(CAST({part} AS DOUBLE) / CAST(nullif({whole}, 0) AS DOUBLE) AS DECIMAL(30,{scale}))"


def _pct(part: str, whole: str) -> str:
    """Percentage of two counts or sums, rounded half up like a decimal."""
    return (
        f"CAST(round(CAST(100.0 * CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0)"
        " AS DECIMAL(30,10)), 2) AS DOUBLE)"
    )


def _percent(part: str, whole: str) -> str:
    return f"CAST(round({_ratio(part, whole)} * 100, 2) AS DOUBLE)"


CTES: dict[str, str] = {
    "raw_sales": retail.sales_sql("lineitem", "orders", "part"),
    "raw_date": retail.date_sql("orders", DUCK),
    "raw_item": retail.item_sql("part", DUCK),
    "raw_store": retail.store_sql("supplier", "nation", "region", DUCK),
    "raw_customer": retail.customer_sql("customer", DUCK),
    # u_: latest rows before enforcement; s_: silver; t_: typed fact with duplicates.
    "u_date": _latest("raw_date", DATE, "date_dim", *DATE_DERIVED),
    "u_item": _latest("raw_item", ITEM, "item"),
    "u_store": _latest("raw_store", STORE, "store"),
    "u_customer": _latest("raw_customer", CUSTOMER, "customer"),
    "s_date": f"SELECT * FROM u_date WHERE cast_failed IS NULL AND {DATE_RULES}",
    "s_item": f"SELECT * FROM u_item WHERE cast_failed IS NULL AND {ITEM_RULES}",
    "s_store": f"SELECT * FROM u_store WHERE cast_failed IS NULL AND {STORE_RULES}",
    "s_customer": f"SELECT * FROM u_customer WHERE cast_failed IS NULL AND {CUSTOMER_RULES}",
    "t_sales": "SELECT "
    + _typed(SALES, _lost(SALES), "loaded_at AS ingestion_timestamp", "'store_sales' AS source_table", "ss_row_seq")
    + " FROM raw_sales",
    "l_sales": "SELECT * EXCLUDE (ss_row_seq) FROM t_sales QUALIFY "
    + LATEST.format(
        keys="ss_ticket_number, ss_item_sk", order="ingestion_timestamp DESC NULLS LAST, ss_row_seq DESC NULLS LAST"
    ),
    "u_sales": f"SELECT * FROM l_sales WHERE {_resolved('u_')}",
    "s_sales": f"SELECT * FROM l_sales WHERE cast_failed IS NULL AND {SALES_RULES} AND {_resolved('s_')}",
    "annotated": f"""SELECT *,
        CASE WHEN ss_sold_date_sk IS NULL OR {_exists('ss_sold_date_sk', 's_date', 'd_date_sk')} THEN 1 ELSE 0 END
            AS has_valid_date_fk,
        CASE WHEN {_exists('ss_item_sk', 's_item', 'i_item_sk')} THEN 1 ELSE 0 END AS has_valid_item_fk,
        CASE WHEN ss_store_sk IS NULL OR {_exists('ss_store_sk', 's_store', 's_store_sk')} THEN 1 ELSE 0 END
            AS has_valid_store_fk,
        CASE WHEN ss_customer_sk IS NULL OR {_exists('ss_customer_sk', 's_customer', 'c_customer_sk')}
             THEN 1 ELSE 0 END AS has_valid_customer_fk
        FROM {{facts}}""",
}


def _gold(p: str) -> dict[str, str]:
    """Gold tables over silver tables with prefix ``p``; decimals as doubles, dates as text."""
    g = "g" + p
    return {
        f"{g}date": f"""SELECT d_date_sk AS date_key, d_date_id AS date_id, CAST(d_date AS VARCHAR) AS calendar_date,
            d_year AS year, d_qoy AS quarter, d_moy AS month, d_dom AS day_of_month, d_dow AS day_of_week,
            d_day_name AS day_name, d_quarter_name AS quarter_name, d_fy_year AS fiscal_year,
            d_fy_quarter_seq AS fiscal_quarter_seq, d_fy_week_seq AS fiscal_week_seq, d_month_seq AS month_seq,
            d_week_seq AS week_seq, d_quarter_seq AS quarter_seq, year_month,
            'Q' || CAST(d_qoy AS VARCHAR) || ' ' || CAST(d_year AS VARCHAR) AS quarter_year,
            coalesce(d_holiday = 'Y', false) AS is_holiday, is_weekend,
            coalesce(d_following_holiday = 'Y', false) AS is_following_holiday,
            coalesce(d_current_day = 'Y', false) AS is_current_day,
            coalesce(d_current_week = 'Y', false) AS is_current_week,
            coalesce(d_current_month = 'Y', false) AS is_current_month,
            coalesce(d_current_quarter = 'Y', false) AS is_current_quarter,
            coalesce(d_current_year = 'Y', false) AS is_current_year,
            d_same_day_ly AS same_day_last_year_key, d_same_day_lq AS same_day_last_quarter_key,
            CAST(ingestion_timestamp AS VARCHAR) AS source_timestamp FROM {p}date""",
        f"{g}item": f"""SELECT i_item_sk AS item_key, i_item_id AS item_id, i_item_desc AS item_description,
            i_product_name AS product_name, CAST(i_current_price AS DOUBLE) AS current_price,
            CAST(i_wholesale_cost AS DOUBLE) AS wholesale_cost,
            CASE WHEN i_current_price < 10 THEN 'Low (< 10)' WHEN i_current_price < 50 THEN 'Medium (10-50)'
                 WHEN i_current_price < 100 THEN 'High (50-100)' ELSE 'Premium (>= 100)' END AS price_category,
            {_percent('(i_current_price - i_wholesale_cost)', 'i_current_price')} AS margin_pct,
            i_brand_id AS brand_id, i_brand AS brand_name, i_manufact_id AS manufacturer_id,
            i_manufact AS manufacturer_name, i_category_id AS category_id, i_category AS category_name,
            i_class_id AS class_id, i_class AS class_name, i_size AS size, i_color AS color,
            i_units AS unit_of_measure, i_container AS container_type, i_formulation AS formulation,
            i_manager_id AS manager_id, CAST(i_rec_start_date AS VARCHAR) AS valid_from,
            CAST(i_rec_end_date AS VARCHAR) AS valid_to, i_rec_end_date IS NULL AS is_current,
            CAST(ingestion_timestamp AS VARCHAR) AS source_timestamp FROM {p}item""",
        f"{g}store": f"""SELECT s_store_sk AS store_key, s_store_id AS store_id, s_store_name AS store_name,
            s_number_employees AS number_of_employees, s_floor_space AS floor_space_sqft,
            s_hours AS operating_hours, s_manager AS store_manager,
            CASE WHEN s_number_employees < 100 THEN 'Small (< 100)' WHEN s_number_employees < 200
                 THEN 'Medium (100-200)' WHEN s_number_employees < 300 THEN 'Large (200-300)'
                 ELSE 'Very Large (>= 300)' END AS store_size_category,
            s_market_id AS market_id, s_market_desc AS market_description, s_market_manager AS market_manager,
            s_geography_class AS geography_class, s_company_id AS company_id, s_company_name AS company_name,
            s_division_id AS division_id, s_division_name AS division_name,
            concat_ws(' ', s_street_number, s_street_name, s_street_type) AS street_address,
            s_suite_number AS suite_number, s_city AS city, s_county AS county, s_state AS state,
            s_zip AS zip_code, s_country AS country,
            concat_ws(', ', concat_ws(' ', s_street_number, s_street_name, s_street_type, s_suite_number),
                      s_city, s_state, s_zip, s_country) AS full_address,
            CAST(s_gmt_offset AS DOUBLE) AS gmt_offset, CAST(s_tax_precentage AS DOUBLE) AS tax_percentage,
            CAST(s_rec_start_date AS VARCHAR) AS valid_from, CAST(s_rec_end_date AS VARCHAR) AS valid_to,
            s_closed_date_sk AS closed_date_key,
            (s_rec_end_date IS NULL AND s_closed_date_sk IS NULL) AS is_currently_open,
            CAST(ingestion_timestamp AS VARCHAR) AS source_timestamp FROM {p}store""",
        f"{g}customer": f"""SELECT c_customer_sk AS customer_key, c_customer_id AS customer_id,
            concat_ws(' ', c_salutation, c_first_name, c_last_name) AS full_name, c_salutation AS salutation,
            c_first_name AS first_name, c_last_name AS last_name, c_email_address AS email_address,
            c_login AS login, c_birth_day AS birth_day, c_birth_month AS birth_month,
            c_birth_year AS birth_year, c_birth_country AS birth_country,
            CASE WHEN c_birth_year IS NULL THEN 'Unknown' WHEN 2024 - c_birth_year < 25 THEN 'Gen Z (< 25)'
                 WHEN 2024 - c_birth_year < 40 THEN 'Millennials (25-39)'
                 WHEN 2024 - c_birth_year < 55 THEN 'Gen X (40-54)'
                 WHEN 2024 - c_birth_year < 75 THEN 'Baby Boomers (55-74)'
                 ELSE 'Silent Generation (75+)' END AS age_group,
            2024 - c_birth_year AS current_age,
            coalesce(c_preferred_cust_flag = 'Y', false) AS is_preferred_customer,
            c_current_cdemo_sk AS current_demographics_key,
            c_current_hdemo_sk AS current_household_demographics_key,
            c_current_addr_sk AS current_address_key, c_first_shipto_date_sk AS first_shipment_date_key,
            c_first_sales_date_sk AS first_sales_date_key, c_last_review_date_sk AS last_review_date_key,
            c_last_review_date AS last_review_date,
            CAST(ingestion_timestamp AS VARCHAR) AS source_timestamp FROM {p}customer""",
        f"{g}sales": _gold_sales(p, zero=True),
        f"{g}top": f"""SELECT * FROM (
            SELECT *, CAST(row_number() OVER (PARTITION BY year, month ORDER BY total_revenue DESC NULLS LAST,
                total_quantity_sold DESC NULLS LAST, item_key ASC) AS INT) AS revenue_rank
            FROM (SELECT d.d_year AS year, d.d_moy AS month, d.year_month, i.i_item_sk AS item_key,
                         i.i_item_id AS item_id, i.i_product_name AS product_name, i.i_category AS category_name,
                         CAST(sum(f.ss_ext_sales_price) AS DOUBLE) AS total_revenue,
                         CAST(sum(f.ss_quantity) AS BIGINT) AS total_quantity_sold,
                         CAST(sum(f.ss_net_profit) AS DOUBLE) AS total_profit
                  FROM {p}sales f JOIN {p}date d ON f.ss_sold_date_sk = d.d_date_sk
                       JOIN {p}item i ON f.ss_item_sk = i.i_item_sk
                  GROUP BY ALL) monthly) ranked WHERE revenue_rank <= 10""",
    }


def _gold_sales(p: str, zero: bool) -> str:
    def settled(value: str) -> str:
        return f"coalesce({value}, 0)" if zero else value

    ratio = _ratio("(ss_list_price - ss_sales_price)", "ss_list_price")
    per_unit = f"CAST(round({_ratio('ss_ext_sales_price', 'ss_quantity', 13)}, 2) AS DOUBLE)"
    money = ", ".join(
        f"CAST(ss_{old} AS DOUBLE) AS {new}"
        for new, old in (
            ("unit_wholesale_cost", "wholesale_cost"),
            ("unit_list_price", "list_price"),
            ("unit_sales_price", "sales_price"),
            ("total_wholesale_cost", "ext_wholesale_cost"),
            ("total_list_price", "ext_list_price"),
            ("total_sales_price", "ext_sales_price"),
            ("total_discount_amount", "ext_discount_amt"),
            ("total_tax_amount", "ext_tax"),
            ("coupon_amount", "coupon_amt"),
            ("net_paid", "net_paid"),
            ("net_paid_including_tax", "net_paid_inc_tax"),
            ("net_profit", "net_profit"),
        )
    )
    return f"""SELECT ss_sold_date_sk AS sold_date_key, ss_sold_time_sk AS sold_time_key, ss_item_sk AS item_key,
        ss_customer_sk AS customer_key, ss_store_sk AS store_key, ss_promo_sk AS promotion_key,
        ss_cdemo_sk AS customer_demographics_key, ss_hdemo_sk AS household_demographics_key,
        ss_addr_sk AS address_key, ss_ticket_number AS ticket_number, ss_quantity AS quantity_sold, {money},
        {settled(_percent('(ss_list_price - ss_sales_price)', 'ss_list_price'))} AS discount_percentage,
        {settled(_percent('ss_net_profit', 'ss_ext_sales_price'))} AS profit_margin_percentage,
        {settled(per_unit)} AS revenue_per_unit,
        CASE WHEN ss_list_price IS NULL OR ss_list_price = 0 THEN 'No List Price'
             WHEN {ratio} = 0 THEN 'No Discount' WHEN {ratio} <= 0.10 THEN 'Small (0-10%)'
             WHEN {ratio} <= 0.25 THEN 'Medium (10-25%)' WHEN {ratio} <= 0.50 THEN 'Large (25-50%)'
             ELSE 'Very Large (> 50%)' END AS discount_category,
        CAST(ingestion_timestamp AS VARCHAR) AS source_timestamp FROM {p}sales"""


CTES["annotated_latest"] = CTES["annotated"].format(facts="l_sales")
CTES["annotated_typed"] = CTES.pop("annotated").format(facts="t_sales")
CTES.update(_gold("s_"))
CTES.update(_gold("u_"))


def _needs(sql: str, seen: list[str]) -> None:
    for name, body in CTES.items():
        if name not in seen and _mentions(sql, name):
            _needs(body, seen)
            if name not in seen:
                seen.append(name)


def _mentions(sql: str, name: str) -> bool:
    return re.search(rf"(?<![A-Za-z0-9_.']){name}(?![A-Za-z0-9_'])", sql) is not None


def query(sql: str) -> str:
    """Put the common table expressions a statement uses in front of it."""
    names: list[str] = []
    _needs(sql, names)
    if not names:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in names) + "\n" + sql


# --- pieces of statements ------------------------------------------------------------------


def _plain(contract: Contract, source: str, *more: str) -> str:
    columns = []
    for field in contract.fields:
        if field.type.startswith("decimal"):
            columns.append(f"CAST({field.name} AS DOUBLE) AS {field.name}")
        elif field.type == "date":
            columns.append(f"CAST({field.name} AS VARCHAR) AS {field.name}")
        else:
            columns.append(field.name)
    lineage = ("CAST(ingestion_timestamp AS VARCHAR) AS ingestion_timestamp", "source_table")
    return f"SELECT {', '.join([*columns, *more, *lineage])} FROM {source}"


SILVER_TABLES = {
    "silver_date_dim": "date",
    "silver_item": "item",
    "silver_store": "store",
    "silver_customer": "customer",
    "silver_store_sales": "sales",
}
GOLD_TABLES = {
    "gold_dim_date": "date",
    "gold_dim_item": "item",
    "gold_dim_store": "store",
    "gold_dim_customer": "customer",
    "gold_fact_store_sales": "sales",
    "gold_top_items_month": "top",
}
BRONZE_TABLES = {
    "bronze_store_sales": "raw_sales",
    "bronze_date_dim": "raw_date",
    "bronze_item": "raw_item",
    "bronze_store": "raw_store",
    "bronze_customer": "raw_customer",
}


Issue = tuple[str, str, str, tuple[str, ...], tuple[tuple[str, str], ...]]
_SALES_KEYS = ("ss_ticket_number", "ss_item_sk", "ss_store_sk", "ss_customer_sk")
_FACT_KEYS = ("ticket_number", "item_key", "store_key", "customer_key")
_NO_KEY = (("NULL_TICKET_NUMBER", "ss_ticket_number IS NULL"), ("NULL_ITEM_SK", "ss_item_sk IS NULL"))
_QUANTITY = (("NULL_QUANTITY", "ss_quantity IS NULL"), ("INVALID_QUANTITY", "ss_quantity < 1"))
_MONEY = (
    ("NEGATIVE_SALES_PRICE", "ss_sales_price < 0"),
    ("NEGATIVE_LIST_PRICE", "ss_list_price < 0"),
    ("NEGATIVE_WHOLESALE_COST", "ss_wholesale_cost < 0"),
    ("NEGATIVE_NET_PAID", "ss_net_paid < 0"),
)
# Table, rule, group, keys, and reasons in the order in which they are looked for.
SILVER_ISSUES: tuple[Issue, ...] = (
    ("silver_date_dim", "DP_SILVER_001", "KEY_VALIDITY", ("d_date_sk", "d_date_id"),
     (("NULL_DATE_SK", "d_date_sk IS NULL"), ("NULL_DATE", "d_date IS NULL"),
      ("NULL_YEAR", "d_year IS NULL"), ("NULL_MONTH", "d_moy IS NULL"))),
    ("silver_item", "DP_SILVER_006", "BUSINESS_VALUE", ("i_item_sk", "i_item_id"),
     (("NULL_CURRENT_PRICE", "i_current_price IS NULL"), ("NEGATIVE_CURRENT_PRICE", "i_current_price < 0"),
      ("NEGATIVE_WHOLESALE_COST", "i_wholesale_cost < 0"))),
    ("silver_store", "DP_SILVER_008", "KEY_VALIDITY", ("s_store_sk", "s_store_id", "s_store_name"),
     (("NULL_STORE_SK", "s_store_sk IS NULL"), ("NULL_STORE_ID", "s_store_id IS NULL"),
      ("NULL_STORE_NAME", "s_store_name IS NULL"))),
    ("silver_customer", "DP_SILVER_009", "KEY_VALIDITY", ("c_customer_sk", "c_customer_id"),
     (("NULL_CUSTOMER_SK", "c_customer_sk IS NULL"), ("NULL_CUSTOMER_ID", "c_customer_id IS NULL"))),
    ("silver_store_sales", "DP_SILVER_010", "KEY_VALIDITY", _SALES_KEYS, (*_NO_KEY, *_QUANTITY)),
    ("silver_store_sales", "DP_SILVER_012", "BUSINESS_VALUE", _SALES_KEYS, _MONEY),
)
GOLD_ISSUES: tuple[Issue, ...] = (
    ("gold_dim_item", "DP_GOLD_001", "BUSINESS_VALUE", ("item_key", "item_id"),
     (("NEGATIVE_CURRENT_PRICE", "current_price < 0"), ("NEGATIVE_WHOLESALE_COST", "wholesale_cost < 0"))),
    ("gold_dim_store", "DP_GOLD_002", "BUSINESS_KEY", ("store_key", "store_id", "store_name"),
     (("NULL_STORE_ID", "store_id IS NULL"), ("NULL_STORE_NAME", "store_name IS NULL"))),
    ("gold_dim_customer", "DP_GOLD_003", "BUSINESS_KEY", ("customer_key", "customer_id", "email_address"),
     (("NULL_CUSTOMER_ID", "customer_id IS NULL"), ("NULL_EMAIL_ADDRESS", "email_address IS NULL"))),
    ("gold_fact_store_sales", "DP_GOLD_004", "MEASURE_VALIDITY", _FACT_KEYS, (("NEGATIVE_NET_PROFIT", "net_profit < 0"),)),
    ("gold_fact_store_sales", "DP_GOLD_005", "BUSINESS_KEY", _FACT_KEYS,
     (("NULL_SOLD_DATE_KEY", "sold_date_key IS NULL"), ("NULL_ITEM_KEY", "item_key IS NULL"),
      ("NULL_STORE_KEY", "store_key IS NULL"), ("NULL_CUSTOMER_KEY", "customer_key IS NULL"))),
    ("gold_top_items_month", "DP_GOLD_006", "BUSINESS_KEY", ("year", "month", "item_key", "item_id"),
     (("NULL_YEAR", "year IS NULL"), ("NULL_MONTH", "month IS NULL"), ("NULL_ITEM_KEY", "item_key IS NULL"))),
)
QUARANTINE: tuple[Issue, ...] = (
    ("silver_store_sales", "cast_contract", "TYPE_VALIDITY", _SALES_KEYS, (("CAST_FAILED", "cast_failed <> ''"),)),
    ("silver_store_sales", "DP_SILVER_010", "KEY_VALIDITY", _SALES_KEYS, _NO_KEY),
    ("silver_store_sales", "fk_item_sk_positive", "KEY_VALIDITY", _SALES_KEYS, (("NON_POSITIVE_ITEM_SK", "ss_item_sk < 1"),)),
    ("silver_store_sales", "DP_SILVER_011", "BUSINESS_VALUE", _SALES_KEYS, _QUANTITY),
    ("silver_store_sales", "DP_SILVER_012", "BUSINESS_VALUE", _SALES_KEYS, _MONEY),
    ("silver_store_sales", "sales_price_reasonable", "BUSINESS_VALUE", _SALES_KEYS,
     (("UNREASONABLE_SALES_PRICE", "2 * ss_sales_price > 3 * ss_list_price"),)),
    ("silver_store_sales", "DP_SILVER_013", "REFERENTIAL_VALIDITY", _SALES_KEYS,
     (("INVALID_DATE_FK", "has_valid_date_fk = 0"), ("INVALID_ITEM_FK", "has_valid_item_fk = 0"),
      ("INVALID_STORE_FK", "has_valid_store_fk = 0"), ("INVALID_CUSTOMER_FK", "has_valid_customer_fk = 0"))),
)


def _issue_sql(issue: Issue, source: str, context: str = "") -> str:
    table, rule_id, group, keys, reasons = issue
    slots = [f"CAST({k} AS VARCHAR)" for k in keys] + ["CAST(NULL AS VARCHAR)"] * (4 - len(keys))
    listed = ", ".join(f"{k} AS key_{n}" for n, k in enumerate(slots, start=1))
    codes = " ".join(f"WHEN {p} THEN {text(code)}" for code, p in reasons)
    broken = " OR ".join(f"({p})" for _, p in reasons)
    return f"""SELECT 'declarative' AS paradigm, {text(table)} AS object_name,
        {text(rule_id)} AS rule_id, {text(group)} AS rule_group, {listed},
        CASE {codes} ELSE 'UNKNOWN' END AS issue_reason{context} FROM {source} WHERE {broken}"""


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _catalog_values() -> str:
    rows = [
        ", ".join(
            text(v)
            for v in (
                r.rule_id,
                r.layer,
                r.object_name,
                r.group,
                r.expression,
                r.action,
                VALIDATION_MODES[r.layer, r.action],
                r.severity,
                OWNERS[r.layer],
            )
        )
        for r in RULES
    ]
    names = (
        "rule_id, layer, object_name, rule_group, rule_expression, rule_type, validation_mode, severity, owner"
    )
    return f"SELECT * FROM (VALUES {', '.join(f'({r})' for r in rows)}) catalog({names})"


def _bronze_metrics() -> str:
    parts = []
    for table, source in BRONZE_TABLES.items():
        keys = BRONZE_KEYS[table]
        counts = [f"CAST(count(*) FILTER (WHERE {k} IS NULL) AS BIGINT)" for k in keys]
        pcts = [_pct(f"count(*) FILTER (WHERE {k} IS NULL)", "count(*)") for k in keys]
        counts += ["CAST(NULL AS BIGINT)"] * (4 - len(keys))
        pcts += ["CAST(NULL AS DOUBLE)"] * (4 - len(keys))
        slots = ", ".join(
            [f"{c} AS null_key_{n}_count" for n, c in enumerate(counts, start=1)]
            + [f"{c} AS pct_null_key_{n}" for n, c in enumerate(pcts, start=1)]
        )
        groups = f"(SELECT count(*) FROM (SELECT 1 FROM {source} GROUP BY {', '.join(keys)}) g)"
        parts.append(
            f"SELECT 'declarative' AS paradigm, {text(table)} AS object_name, 'RAW_MODEL' AS object_type, "
            f"count(*) AS row_count, {slots}, count(*) - {groups} AS duplicate_row_count FROM {source}"
        )
    return _union(parts)


def _gold_metrics(p: str) -> str:
    checks = {
        "gold_dim_date": ("false", "date_key IS NULL OR calendar_date IS NULL"),
        "gold_dim_item": ("current_price < 0 OR wholesale_cost < 0", "false"),
        "gold_dim_store": ("false", "store_id IS NULL OR store_name IS NULL"),
        "gold_dim_customer": ("false", "customer_id IS NULL OR email_address IS NULL"),
        "gold_fact_store_sales": (
            "net_profit < 0",
            "sold_date_key IS NULL OR item_key IS NULL OR store_key IS NULL OR customer_key IS NULL",
        ),
        "gold_top_items_month": ("false", "year IS NULL OR month IS NULL OR item_key IS NULL"),
    }
    return _union(
        [
            f"""SELECT 'declarative' AS paradigm, {text(table)} AS object_name,
            'MATERIALIZED_VIEW' AS object_type, count(*) AS row_count,
            count(*) FILTER (WHERE ({negative}) OR ({missing})) AS issue_count,
            count(*) FILTER (WHERE {negative}) AS negative_value_count,
            count(*) FILTER (WHERE {missing}) AS null_business_key_count,
            'mv_from_silver' AS source_layer FROM {p}{GOLD_TABLES[table]}"""
            for table, (negative, missing) in checks.items()
        ]
    )


# Names and predicates of the rules that keep a dimension row, spelled out for the rejects.
DIMENSION_CHECKS = {
    "date": (
        ("d_date_sk", "d_date_id"),
        ("DP_SILVER_001", "d_date_sk IS NOT NULL"),
        ("DP_SILVER_002", "d_date IS NOT NULL"),
        ("DP_SILVER_003", "d_year >= 1900 AND d_year <= 2100"),
        ("DP_SILVER_004", "d_moy >= 1 AND d_moy <= 12"),
        ("pk_date_sk_positive", "d_date_sk >= 1"),
        ("valid_day_of_month", "d_dom >= 1 AND d_dom <= 31"),
        ("valid_day_of_week", "d_dow >= 0 AND d_dow <= 6"),
        ("valid_quarter", "d_qoy >= 1 AND d_qoy <= 4"),
    ),
    "item": (
        ("i_item_sk", "i_item_id"),
        ("DP_SILVER_005", "i_item_sk IS NOT NULL AND i_item_id IS NOT NULL"),
        ("DP_SILVER_006", "i_current_price >= 0"),
        ("DP_SILVER_007", "coalesce(i_wholesale_cost, 0) >= 0"),
        ("pk_item_sk_positive", "i_item_sk >= 1"),
    ),
    "store": (
        ("s_store_sk", "s_store_id"),
        ("DP_SILVER_008", "s_store_sk IS NOT NULL AND s_store_id IS NOT NULL AND s_store_name IS NOT NULL"),
        ("pk_store_sk_positive", "s_store_sk >= 1"),
        ("valid_employees", "coalesce(s_number_employees, 0) >= 0"),
        ("valid_floor_space", "coalesce(s_floor_space, 0) >= 0"),
    ),
    "customer": (
        ("c_customer_sk", "c_customer_id"),
        ("DP_SILVER_009", "c_customer_sk IS NOT NULL AND c_customer_id IS NOT NULL"),
        ("pk_customer_sk_positive", "c_customer_sk >= 1"),
        ("valid_birth_year", "coalesce(c_birth_year, 2000) BETWEEN 1900 AND 2100"),
        ("valid_birth_month", "coalesce(c_birth_month, 1) BETWEEN 1 AND 12"),
        ("valid_birth_day", "coalesce(c_birth_day, 1) BETWEEN 1 AND 31"),
    ),
}


SALES_CHECKS = (
    ("DP_SILVER_010", "ss_ticket_number IS NOT NULL AND ss_item_sk IS NOT NULL"),
    ("DP_SILVER_011", "ss_quantity >= 1"),
    ("DP_SILVER_012", "least(coalesce(ss_sales_price, 0), coalesce(ss_list_price, 0), coalesce(ss_wholesale_cost, 0), "
     "coalesce(ss_net_paid, 0)) >= 0"),
    ("fk_item_sk_positive", "ss_item_sk >= 1"),
    ("sales_price_reasonable", "ss_sales_price IS NULL OR ss_list_price IS NULL OR 2 * ss_sales_price <= 3 * ss_list_price"),
)
MONITORS = {
    "date": (("valid_holiday_flag", "d_holiday = 'Y' OR d_holiday = 'N'"), ("valid_weekend_flag", "d_weekend = 'Y' OR d_weekend = 'N'")),
    "item": (("valid_date_range", "i_rec_end_date IS NULL OR i_rec_start_date <= i_rec_end_date"),),
    "store": (
        ("valid_tax_pct", "coalesce(s_tax_precentage, 0) BETWEEN 0 AND 1"),
        ("valid_gmt_offset", "coalesce(s_gmt_offset, 0) BETWEEN -12 AND 14"),
        ("valid_date_range", "s_rec_end_date IS NULL OR s_rec_start_date <= s_rec_end_date"),
    ),
}


def _expectations(p: str, action: str | None) -> str:
    parts = []
    for table, source in SILVER_TABLES.items():
        dropping = SALES_CHECKS if source == "sales" else DIMENSION_CHECKS[source][1:]
        listed = [(n, c, "drop") for n, c in dropping if action != "monitor"]
        listed += [(n, c, "monitor") for n, c in MONITORS.get(source, ())]
        for name, check, kind in listed:
            parts.append(
                f"""SELECT {text(table)} AS object_name, {text(name)} AS expectation, {text(kind)} AS action,
                count(*) FILTER (WHERE {check}) AS passed_rows,
                count(*) - count(*) FILTER (WHERE {check}) AS failed_rows FROM {p}{source}"""
            )
    return _union(parts)


def _rule_status(p: str) -> str:
    parts = []
    checks = dict(c for listed in DIMENSION_CHECKS.values() for c in listed[1:]) | dict(SALES_CHECKS)
    for r in RULES:
        if r.layer != "silver" or r.action != "EXPECT":
            continue
        met = f"count(*) FILTER (WHERE {checks[r.rule_id]})"
        parts.append(
            f"""SELECT 'declarative' AS paradigm, 'silver' AS layer, {text(r.object_name)} AS object_name,
            {text(r.rule_id)} AS rule_id, {text(r.group)} AS rule_group,
            CASE WHEN {met} = count(*) THEN 'PASS' ELSE 'FAIL' END AS rule_status,
            count(*) - {met} AS violating_rows, {met} AS matching_rows FROM {p}{SILVER_TABLES[r.object_name]}"""
        )
    return _union(parts)


# What must hold by each gold rule, and the columns that the rules name, spelled out.
GOLD_RULES = {
    "DP_GOLD_000": "date_key IS NOT NULL AND calendar_date IS NOT NULL",
    "DP_GOLD_001": "current_price >= 0 AND coalesce(wholesale_cost, 0) >= 0",
    "DP_GOLD_002": "store_id IS NOT NULL AND store_name IS NOT NULL",
    "DP_GOLD_003": "customer_id IS NOT NULL AND email_address IS NOT NULL",
    "DP_GOLD_004": "net_profit >= 0",
    "DP_GOLD_005": "sold_date_key IS NOT NULL AND item_key IS NOT NULL AND store_key IS NOT NULL AND customer_key IS NOT NULL",
    "DP_GOLD_006": "year IS NOT NULL AND month IS NOT NULL AND item_key IS NOT NULL",
}
RULE_COLUMNS = {
    "silver_date_dim": {"d_date_sk": 1, "d_date": 1, "d_year": 1, "d_moy": 1},
    "silver_item": {"i_item_sk": 1, "i_item_id": 1, "i_current_price": 1, "i_wholesale_cost": 1},
    "silver_store": {"s_store_sk": 1, "s_store_id": 1, "s_store_name": 1},
    "silver_customer": {"c_customer_sk": 1, "c_customer_id": 1},
    "silver_store_sales": {
        "ss_ticket_number": 1, "ss_item_sk": 2, "ss_quantity": 1, "ss_sales_price": 1, "ss_list_price": 1,
        "ss_wholesale_cost": 1, "ss_net_paid": 1, "ss_sold_date_sk": 1, "ss_store_sk": 1, "ss_customer_sk": 1,
    },
    "gold_dim_date": {"date_key": 1, "calendar_date": 1},
    "gold_dim_item": {"current_price": 1, "wholesale_cost": 1},
    "gold_dim_store": {"store_id": 1, "store_name": 1},
    "gold_dim_customer": {"customer_id": 1, "email_address": 1},
    "gold_fact_store_sales": {"net_profit": 1, "sold_date_key": 1, "item_key": 1, "store_key": 1, "customer_key": 1},
    "gold_top_items_month": {"year": 1, "month": 1, "item_key": 1},
}


def _rule_scores() -> str:
    checks = dict(c for listed in DIMENSION_CHECKS.values() for c in listed[1:]) | dict(SALES_CHECKS) | GOLD_RULES
    parts = []
    for r in RULES:
        if r.layer == "bronze":
            source, keys = BRONZE_TABLES[r.object_name], BRONZE_KEYS[r.object_name]
            checks[r.rule_id] = f"{keys[int(r.rule_id[-2:]) - 1]} IS NOT NULL"
        elif r.layer == "silver":
            source = "l_sales" if r.object_name == "silver_store_sales" else "u_" + SILVER_TABLES[r.object_name]
        else:
            source = "gu_" + GOLD_TABLES[r.object_name]
        if r.kind == "duplicate":
            broken = f"count(*) - (SELECT count(*) FROM (SELECT 1 FROM {source} GROUP BY {', '.join(keys)}) g)"
        else:
            check = _resolved("u_") if r.kind == "foreign_key" else checks[r.rule_id]
            broken = f"count(*) FILTER (WHERE NOT coalesce({check}, false))"
        parts.append(
            f"""SELECT 'declarative' AS paradigm, {text(r.layer)} AS layer, {text(r.object_name)} AS object_name,
            {text(r.rule_id)} AS rule_id, {text(r.group)} AS rule_group, {text(r.kind)} AS rule_kind,
            CASE WHEN {broken} = 0 THEN 'PASS' ELSE 'FAIL' END AS rule_status,
            {broken} AS violating_rows, count(*) - ({broken}) AS matching_rows FROM {source}"""
        )
    return _union(parts)


_DIMS = ("date_dim", "item", "store", "customer")
_SILVER = [f"silver_{d}" for d in _DIMS]
_GOLD_DIMS = {"gold_dim_date": "date_dim", "gold_dim_item": "item", "gold_dim_store": "store", "gold_dim_customer": "customer"}
_GOLD_ALL = [*_GOLD_DIMS, "gold_fact_store_sales", "gold_top_items_month"]
_BRONZE_ALL = ["bronze_store_sales", *[f"bronze_{d}" for d in _DIMS]]
_STAGING = [f"staging_{d}" for d in _DIMS]
_ANNOTATED = "staging_store_sales_annotated"
# Which tables each table of a whole run is made from.
READS = {
    **{f"staging_{d}": [f"bronze_{d}"] for d in _DIMS},
    **{f"silver_{d}": [f"staging_{d}"] for d in _DIMS},
    "dq_dimension_rejects": _STAGING,
    _ANNOTATED: ["bronze_store_sales", *_SILVER],
    "silver_store_sales": [_ANNOTATED],
    "dq_store_sales_quarantine": [_ANNOTATED],
    **{g: [f"silver_{d}"] for g, d in _GOLD_DIMS.items()},
    "gold_fact_store_sales": ["silver_store_sales"],
    "gold_top_items_month": ["gold_fact_store_sales", "gold_dim_date", "gold_dim_item"],
    "dq_bronze_metrics": _BRONZE_ALL,
    "dq_bronze_observability": ["dq_bronze_metrics", "dq_rule_catalog"],
    "dq_cast_failures": _BRONZE_ALL,
    "dq_silver_dropped": [*_STAGING, _ANNOTATED],
    **{f"dq_silver_{q}": [*_SILVER, "silver_store_sales"] for q in ("monitors", "issues", "rule_status")},
    "dq_gold_issues": _GOLD_ALL,
    "dq_gold_metrics": _GOLD_ALL,
    "dq_gold_observability": ["dq_gold_metrics", "dq_rule_catalog"],
}


def _reach() -> str:
    edges = ", ".join(f"({text(t)}, {text(r)})" for t, reads in READS.items() for r in reads)
    return f"""(WITH RECURSIVE edges (object_name, reads) AS (VALUES {edges}),
        reach (changed, reached, distance) AS (
          SELECT name, name, 0 FROM (SELECT object_name AS name FROM edges UNION SELECT reads FROM edges) names
          UNION ALL SELECT changed, object_name, distance + 1 FROM reach JOIN edges ON reached = reads)
        SELECT changed, reached, min(distance) AS distance FROM reach GROUP BY changed, reached)"""


def _counted_tables() -> str:
    return _row_counts(
        {
            **BRONZE_TABLES,
            **{t: "s_" + s for t, s in SILVER_TABLES.items()},
            **{t: "gs_" + s for t, s in GOLD_TABLES.items()},
        }
    )


def _rules_per_table() -> str:
    counts: dict[str, int] = {}
    for r in RULES:
        counts[r.object_name] = counts.get(r.object_name, 0) + 1
    return "(VALUES " + ", ".join(f"({text(t)}, {n})" for t, n in counts.items()) + ") k (object_name, rules)"


def _column_impact() -> str:
    named = {t: {k: 2 for k in keys} for t, keys in BRONZE_KEYS.items()} | RULE_COLUMNS
    rows = ", ".join(f"({text(t)}, {text(c)}, {n})" for t, columns in named.items() for c, n in columns.items())
    return f"""SELECT c.object_name, c.column_name, CAST(c.n AS BIGINT) AS rules_on_column,
        (SELECT count(*) FROM {_reach()} r WHERE r.changed = c.object_name AND distance > 0) AS tables_behind,
        CAST(coalesce((SELECT sum(rules) FROM {_reach()} r JOIN {_rules_per_table()} ON k.object_name = r.reached
                       WHERE r.changed = c.object_name AND distance > 0), 0) AS BIGINT) AS rules_behind, n.row_count
        FROM (VALUES {rows}) c (object_name, column_name, n) JOIN ({_counted_tables()}) n ON n.object_name = c.object_name"""


def _dimension_rejects() -> str:
    names = {"date": "silver_date_dim", "item": "silver_item", "store": "silver_store", "customer": "silver_customer"}
    parts = []
    for source, ((first, second), *checks) in DIMENSION_CHECKS.items():
        broken = ", ".join(
            ["CASE WHEN cast_failed IS NOT NULL THEN 'cast_contract' END"]
            + [f"CASE WHEN NOT coalesce({p}, false) THEN '{n}' END" for n, p in checks]
        )
        parts.append(
            f"""SELECT * FROM (SELECT '{names[source]}' AS object_name, CAST({first} AS VARCHAR) AS key_1,
            CAST({second} AS VARCHAR) AS key_2, concat_ws(', ', {broken}) AS broken_rules, cast_failed
            FROM u_{source}) r WHERE broken_rules <> ''"""
        )
    return _union(parts)


def _row_counts(tables: dict[str, str]) -> str:
    return _union([f"SELECT {text(n)} AS object_name, count(*) AS row_count FROM {s}" for n, s in tables.items()])


FK = "ss_ticket_number, ss_item_sk, ss_sold_time_sk, ss_customer_sk, ss_store_sk"


def _share(by: str, source: str) -> str:
    return f"""SELECT {by}, CAST(sum(price) AS DOUBLE) AS total_value,
        CAST(coalesce(sum(price) FILTER (WHERE o_orderstatus = 'F'), 0) AS DOUBLE) AS subset_value,
        count(DISTINCT o_custkey) AS num_members,
        count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'F') AS num_subset_members,
        coalesce({_pct("sum(price) FILTER (WHERE o_orderstatus = 'F')", 'sum(price)')}, 0.0) AS subset_percentage
        FROM {source} GROUP BY {by}"""


PRICED = "(SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS price, CAST(year(o_orderdate) AS INT) AS year FROM orders) p"

MEANS = """round(CAST(CAST(sum(quantity) AS DOUBLE) / count(*) AS DECIMAL(28,6)), 2)::DOUBLE AS avg_quantity,
    round(CAST(CAST(sum(price) AS DOUBLE) / count(*) AS DECIMAL(28,6)), 2)::DOUBLE AS avg_price,
    round(CAST(CAST(sum(discount) AS DOUBLE) / count(*) AS DECIMAL(28,6)), 2)::DOUBLE AS avg_discount,
    round(CAST(CAST(sum(tax) AS DOUBLE) / count(*) AS DECIMAL(28,6)), 2)::DOUBLE AS avg_tax,
    round(CAST(sum(l_linenumber) AS DOUBLE) / count(*), 2) AS avg_linenumber"""
MEAN_LINES = """(SELECT *, CAST(l_quantity AS DECIMAL(12,2)) AS quantity, CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
    CAST(l_discount AS DECIMAL(12,2)) AS discount, CAST(l_tax AS DECIMAL(12,2)) AS tax FROM lineitem) m"""


def _change(name: str, before: str, after: str) -> str:
    return f"round((CAST({after} AS DOUBLE) / nullif(CAST({before} AS DOUBLE), 0) - 1) * 100, 2) AS {name}_change_pct"


LINE_SPLIT = r"regexp_split_to_array(text, '\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]')"
CODE_LINE = r"NOT regexp_matches(l, '^\s*(#|$)')"
LINE_HIT = "regexp_matches(l, '[0-9]{3}-[0-9]{4}|[A-Z]{4,}|token')"


def _normalized(column: str) -> str:
    return (
        rf"""trim(regexp_replace(regexp_replace(regexp_replace({column}, '"[^"\n]*"|''[^''\n]*''', 'STR', 'g'), """
        r"""'\b[0-9]+\b', 'NUM', 'g'), '\s+', ' ', 'g'))"""
    )


IDS = r"""(SELECT doc_id, source, unnest(list_concat(list_concat(regexp_extract_all(text, '([0-9]{3}-[0-9]{4})', 1),
    regexp_extract_all(text, '"([0-9a-f]{40})"', 1)), regexp_extract_all(text, '([A-Z]{4,})', 1))) AS identifier
    FROM documents) ids"""

DOC_LINES = rf"""(SELECT doc_id, source, CAST(len(list_filter({LINE_SPLIT}, lambda l: {CODE_LINE})) AS INT) AS code_lines,
    CAST(len(list_filter({LINE_SPLIT}, lambda l: {CODE_LINE} AND {LINE_HIT})) AS INT) AS pattern_lines FROM documents) lines"""


CLONES = f"""SELECT source, CAST(sum(n) AS BIGINT) AS total_blocks,
    count(*) FILTER (WHERE everywhere > 1) AS duplicated_blocks,
    CAST(sum(n * (n - 1) // 2) AS DOUBLE) AS equal_pairs
    FROM (SELECT source, block, count(*) AS n, sum(count(*)) OVER (PARTITION BY block) AS everywhere
          FROM (SELECT source, {_normalized('line')} AS block
                FROM (SELECT source, unnest({LINE_SPLIT}) AS line FROM documents) l) b
          WHERE block <> '' GROUP BY source, block) counted GROUP BY source"""


def statements() -> dict[str, str]:
    sql = {
        "bronze_ingest": """SELECT * EXCLUDE (l_shipdate), CAST(l_shipdate AS VARCHAR) AS l_shipdate,
            'lineitem' AS source_table FROM lineitem""",
        "cast_contract": """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS quantity,
            CAST(TRY_CAST(l_extendedprice AS DECIMAL(7,2)) AS DOUBLE) AS extended_price,
            (l_extendedprice IS NOT NULL AND TRY_CAST(l_extendedprice AS DECIMAL(7,2)) IS NULL) AS cast_failed,
            CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS ship_date FROM lineitem""",
        "cast_failures": """SELECT count(*) FILTER (WHERE ss_net_paid IS NOT NULL
            AND TRY_CAST(ss_net_paid * 10 AS DECIMAL(7,2)) IS NULL) AS ss_net_paid,
            count(*) FILTER (WHERE ss_ext_list_price IS NOT NULL
            AND TRY_CAST(ss_ext_list_price AS DECIMAL(7,2)) IS NULL) AS ss_ext_list_price,
            count(*) FILTER (WHERE ss_quantity IS NOT NULL AND TRY_CAST(ss_quantity AS INT) IS NULL) AS ss_quantity
            FROM raw_sales""",
        "cast_quarantine": f"""SELECT CAST(ss_ticket_number AS VARCHAR) AS key_1, CAST(ss_item_sk AS VARCHAR) AS key_2,
            'cast_contract' AS rule_id, 'CAST_FAILED' AS issue_reason, cast_failed FROM (
            SELECT {_typed(SALES, _lost(SALES), 'loaded_at AS ingestion_timestamp', 'ss_row_seq')} FROM (
                SELECT * REPLACE (ss_net_paid * 10 AS ss_net_paid, CASE WHEN ss_ticket_number % 50 = 0
                    THEN 3000000000 + ss_customer_sk ELSE ss_customer_sk END AS ss_customer_sk) FROM raw_sales) r) t
            QUALIFY cast_failed IS NOT NULL AND {LATEST.format(
                keys='ss_ticket_number, ss_item_sk',
                order='ingestion_timestamp DESC NULLS LAST, ss_row_seq DESC NULLS LAST')}""",
        "cast_failure_counts": _union(
            [
                f"""SELECT {text(c.name)} AS object_name, {text(f.name)} AS column_name, count(*) FILTER (WHERE
                {f.name} IS NOT NULL AND TRY_CAST({f.name} AS {f.type}) IS NULL) AS failed_rows FROM {source}"""
                for c, source in zip((SALES, DATE, ITEM, STORE, CUSTOMER), BRONZE_TABLES.values())
                for f in c.fields
                if f.type != "string"
            ]
        ),
        "dimension_rejects": _dimension_rejects(),
        "trim_to_null": """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE trim(c_name) END AS clean_name,
            CASE WHEN c_custkey % 7 = 0 THEN '' ELSE trim(c_name) END AS trimmed_name FROM customer""",
        "latest_by_key": """SELECT * EXCLUDE (l_shipdate), CAST(l_shipdate AS VARCHAR) AS l_shipdate FROM lineitem
            QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY lineitem.l_shipdate DESC,
                l_linenumber DESC, l_suppkey DESC) = 1""",
        "replicate": """SELECT l_orderkey, l_linenumber, l_partkey, 1 AS scale_factor_copy FROM lineitem
            UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 2 FROM lineitem""",
        "replicate_offset": """SELECT o_orderkey + (c - 1) * 10000000000 AS o_orderkey, o_custkey,
            CAST(c AS INT) AS scale_factor_copy FROM orders, (SELECT unnest([1, 2, 3]) AS c) copies""",
        "silver_date": _plain(DATE, "s_date", "year_month", "is_weekend"),
        "silver_item": _plain(ITEM, "s_item"),
        "silver_item_validate_first": _plain(
            ITEM,
            "(SELECT * FROM (SELECT "
            + _typed(ITEM, _lost(ITEM), "loaded_at AS ingestion_timestamp", "'item' AS source_table")
            + f" FROM raw_item) t WHERE cast_failed IS NULL AND {ITEM_RULES} QUALIFY "
            + LATEST.format(keys="i_item_sk", order="ingestion_timestamp DESC NULLS LAST")
            + ") v",
        ),
        "silver_store": _plain(STORE, "s_store"),
        "silver_customer": _plain(CUSTOMER, "s_customer"),
        "silver_sales": _plain(SALES, "s_sales"),
        "silver_sales_split": _plain(SALES, "s_sales"),
        "fk_semi": f"SELECT {FK} FROM t_sales WHERE ss_item_sk IN (SELECT i_item_sk FROM s_item)",
        "fk_optional": f"""SELECT {FK} FROM t_sales WHERE ss_customer_sk IS NULL
            OR ss_customer_sk IN (SELECT c_customer_sk FROM s_customer)""",
        "fk_orphans": f"""SELECT {FK} FROM t_sales WHERE ss_store_sk IS NOT NULL
            AND ss_store_sk NOT IN (SELECT s_store_sk FROM s_store)""",
        "fk_flags": f"""SELECT {FK}, has_valid_date_fk, has_valid_item_fk, has_valid_store_fk, has_valid_customer_fk
            FROM annotated_typed""",
        "gold_date": "SELECT * FROM gs_date",
        "gold_item": "SELECT * FROM gs_item",
        "gold_store": "SELECT * FROM gs_store",
        "gold_customer": "SELECT * FROM gs_customer",
        "gold_sales": "SELECT * FROM gs_sales",
        "gold_sales_null_ratio": _gold_sales("u_", zero=False),
        "top_items_month": "SELECT * FROM gs_top",
        "monitor_counts": _expectations("s_", "monitor"),
        "expectation_counts": _expectations("u_", None),
        "dup_rows": """SELECT count(*) - (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_partkey) g)
            AS duplicate_row_count FROM lineitem""",
        "null_pct": "SELECT count(*) AS row_count, "
        + ", ".join(
            f"count(*) FILTER (WHERE {c} IS NULL) AS {c}_nulls, "
            f"{_pct(f'count(*) FILTER (WHERE {c} IS NULL)', 'count(*)')} AS {c}_pct"
            for c in ("ss_item_sk", "ss_store_sk", "ss_customer_sk", "ss_promo_sk", "ss_quantity")
        )
        + " FROM raw_sales",
        "bronze_metrics": _bronze_metrics(),
        "bronze_observability": f"""SELECT m.*, c.* EXCLUDE (object_name) FROM ({_bronze_metrics()}) m
            JOIN ({_catalog_values()}) c ON m.object_name = c.object_name WHERE c.layer = 'bronze'""",
        "rule_catalog": "SELECT c.*, n.row_count FROM ("
        + _catalog_values()
        + ") c LEFT JOIN ("
        + _row_counts(
            {
                **BRONZE_TABLES,
                **{t: "s_" + s for t, s in SILVER_TABLES.items()},
                **{t: "gs_" + s for t, s in GOLD_TABLES.items()},
            }
        )
        + ") n ON c.object_name = n.object_name",
        "silver_issues": _union([_issue_sql(i, "u_" + SILVER_TABLES[i[0]]) for i in SILVER_ISSUES]),
        "gold_issues": _union([_issue_sql(i, "gu_" + GOLD_TABLES[i[0]]) for i in GOLD_ISSUES]),
        "sales_quarantine": _union(
            [
                _issue_sql(
                    i,
                    "annotated_latest",
                    """, ss_sold_date_sk, ss_sold_time_sk, ss_quantity, CAST(ss_sales_price AS DOUBLE) AS ss_sales_price,
                    CAST(ss_list_price AS DOUBLE) AS ss_list_price,
                    CAST(ss_wholesale_cost AS DOUBLE) AS ss_wholesale_cost, CAST(ss_net_paid AS DOUBLE) AS ss_net_paid,
                    CAST(ss_net_profit AS DOUBLE) AS ss_net_profit,
                    CAST(ingestion_timestamp AS VARCHAR) AS ingestion_timestamp, source_table, cast_failed""",
                )
                for i in QUARANTINE
            ]
        ),
        "rule_status": _rule_status("u_"),
        "gold_metrics": _gold_metrics("gu_"),
        "gold_observability": f"""SELECT m.*, c.* EXCLUDE (object_name, layer) FROM ({_gold_metrics('gu_')}) m
            JOIN ({_catalog_values()}) c ON m.object_name = c.object_name WHERE c.layer = 'gold'""",
        "rule_scores": _rule_scores(),
        "change_impact": f"""SELECT changed, count(*) FILTER (WHERE distance > 0) AS tables_reached,
            CAST(max(distance) AS INT) AS levels, CAST(coalesce(sum(rules), 0) AS BIGINT) AS rules_reached,
            count(row_count) AS tables_counted, CAST(coalesce(sum(row_count), 0) AS BIGINT) AS rows_reached
            FROM {_reach()} r LEFT JOIN {_rules_per_table()} ON k.object_name = r.reached
            LEFT JOIN ({_counted_tables()}) n ON n.object_name = r.reached GROUP BY changed""",
        "column_impact": _column_impact(),
        "failed_load_keeps_rows": _union(
            [
                f"""SELECT '{step}' AS step, o_orderpriority, count(*) AS orders,
                CAST(sum({times} * CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS price
                FROM orders WHERE {rows} GROUP BY o_orderpriority"""
                for step, times, rows in (
                    ("loaded", 1, "o_orderpriority <> '5-LOW'"),
                    ("load broke", 1, "o_orderpriority <> '5-LOW'"),
                    ("load too small", 1, "o_orderpriority <> '5-LOW'"),
                    ("loaded again", 2, "true"),
                )
            ]
        ),
        "bucketed_keys": """SELECT (SELECT count(*) FROM l_sales) AS latest_rows,
            (SELECT CAST(sum(ss_quantity) AS BIGINT) FROM l_sales) AS latest_quantity,
            count(*) - (SELECT count(*) FROM l_sales) AS repeated_keys, count(*) AS row_count,
            count(*) FILTER (WHERE ss_sold_date_sk IS NULL) AS null_key_3_count,
            count(*) FILTER (WHERE ss_store_sk IS NULL) AS null_key_4_count,
            count(*) - (SELECT count(*) FROM (SELECT 1 FROM raw_sales
              GROUP BY ss_item_sk, ss_ticket_number, ss_sold_date_sk, ss_store_sk) g) AS duplicate_row_count FROM raw_sales""",
        "top_items_of_months": "SELECT * FROM gs_top WHERE year = 1997 AND month IN (3, 4, 5)",
        "near_edits": f"""SELECT DISTINCT y.page_id FROM
            (SELECT page_id, {_normalized('lower(url)')} AS t FROM pages) x
            JOIN (SELECT page_id, {_normalized('lower(url)')} AS t FROM pages) y
            ON x.page_id < y.page_id AND 10 * least(length(x.t), length(y.t)) >= 8 * greatest(length(x.t), length(y.t))
            WHERE 10 * levenshtein(x.t, y.t) <= 2 * greatest(length(x.t), length(y.t))""",
        "growth_by_scale": """WITH loaded AS (
              SELECT years, count(*) AS orders, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS price,
                     count(DISTINCT o_custkey) AS customers
              FROM orders, (SELECT DISTINCT year(o_orderdate) - (SELECT min(year(o_orderdate)) FROM orders) + 1 AS years
                            FROM orders) s
              WHERE year(o_orderdate) - (SELECT min(year(o_orderdate)) FROM orders) + 1 <= years GROUP BY years),
            long AS (SELECT years::DOUBLE AS scale, unnest(['orders', 'price', 'customers']) AS measure,
                     unnest([orders::DOUBLE, price::DOUBLE, customers::DOUBLE]) AS value FROM loaded),
            slopes AS (SELECT measure, regr_slope(ln(value), ln(scale)) AS growth_exponent FROM long GROUP BY measure)
            SELECT l.*, round(growth_exponent, 9) AS growth_exponent,
                   lag(scale) OVER w AS previous_scale, lag(value) OVER w AS previous_value,
                   round((value / lag(value) OVER w - 1) * 100, 2) AS change_pct
            FROM long l JOIN slopes s ON s.measure = l.measure WINDOW w AS (PARTITION BY l.measure ORDER BY scale)""",
        "distinct_keys_of_loads": """SELECT o.o_orderpriority, count(DISTINCT o_custkey) AS distinct_keys, y.year
            FROM orders o JOIN (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year FROM orders) y
            ON year(o.o_orderdate) <= y.year GROUP BY o.o_orderpriority, y.year""",
        "ordered_export": """SELECT count(*) AS row_count, min(o_custkey) AS first_customer,
            max(o_custkey) AS last_customer, 0 AS out_of_order FROM orders""",
        "corpus_blocks": f"""SELECT c.source, c.code_lines, c.pattern_lines, coalesce(i.identifiers, 0) AS identifiers
            FROM (SELECT source, CAST(sum(code_lines) AS BIGINT) AS code_lines,
                         CAST(sum(pattern_lines) AS BIGINT) AS pattern_lines FROM {DOC_LINES} GROUP BY source) c
            LEFT JOIN (SELECT source, count(*) AS identifiers FROM {IDS} GROUP BY source) i ON i.source = c.source""",
        "write_verify": _row_counts({"gold_dim_item": "s_item", "gold_dim_customer": "s_customer"}),
        "schema_reset": "SELECT 'keep_orders' AS object_name, count(*) AS row_count FROM orders",
        "csv_summary": """SELECT o_orderpriority, count(DISTINCT o_custkey) AS num_members,
            count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'F') AS num_subset_members
            FROM orders GROUP BY o_orderpriority""",
        "group_means": _union(
            [
                f"SELECT l_returnflag, '{scope}' AS scope, {MEANS} FROM {MEAN_LINES} WHERE {rows} GROUP BY l_returnflag"
                for scope, rows in (
                    ("all", "true"),
                    ("main", "l_linestatus <> 'O'"),
                    ("quality", "l_linestatus = 'O'"),
                )
            ]
        ),
        "share_of_total": _share("o_orderpriority", PRICED),
        "share_of_total_by_layer": _share("o_orderpriority, year", PRICED),
        "reuse_kpi": """SELECT l_returnflag, count(DISTINCT l_partkey) AS unique_items, count(*) AS total_uses,
            count(*) - count(DISTINCT l_partkey) AS duplicate_instances,
            CAST(count(*) AS DOUBLE) / count(DISTINCT l_partkey) AS reuse_ratio,
            CAST(count(*) - count(DISTINCT l_partkey) AS DOUBLE) / count(DISTINCT l_partkey)
                AS duplicate_instance_ratio FROM lineitem GROUP BY l_returnflag""",
        "left_fill": """SELECT c_custkey AS custkey, c_name, CAST(count(o_orderkey) AS INT) AS urgent_orders
            FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'
            GROUP BY c_custkey, c_name""",
        "pivot_share": f"""SELECT o_orderpriority,
            CAST(sum(price) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS "F",
            CAST(sum(price) FILTER (WHERE o_orderstatus = 'O') AS DOUBLE) AS "O",
            CAST(sum(price) FILTER (WHERE o_orderstatus = 'P') AS DOUBLE) AS "P",
            CAST(substr(o_orderpriority, 1, 1) AS INT) AS position FROM {PRICED} GROUP BY o_orderpriority""",
        "change_per_doubling": f"""SELECT *, {_change('rows', 'rows_before', 'rows_after')},
            {_change('price', 'price_before', 'price_after')}, {_change('keys', 'keys_before', 'keys_after')}
            FROM (SELECT l_returnflag, count(*) AS rows_before, 2 * count(*) AS rows_after,
                         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price_before,
                         CAST(2 * sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price_after,
                         count(DISTINCT (l_orderkey, l_partkey)) AS keys_before,
                         count(DISTINCT (l_orderkey, l_partkey)) AS keys_after
                  FROM lineitem GROUP BY l_returnflag) scales""",
        "change_between_years": f"""SELECT *, {_change('orders', 'orders_before', 'orders_after')},
            {_change('price', 'price_before', 'price_after')}
            FROM (SELECT o_orderpriority, count(*) FILTER (WHERE year = 1998) AS orders_before,
                         count(*) FILTER (WHERE year = 1999) AS orders_after,
                         CAST(sum(price) FILTER (WHERE year = 1998) AS DOUBLE) AS price_before,
                         CAST(sum(price) FILTER (WHERE year = 1999) AS DOUBLE) AS price_after
                  FROM {PRICED} GROUP BY o_orderpriority) years""",
        "rule_impact": f"""SELECT change_scenario, count(*) AS objects_touched,
            CAST(sum(touch_points) AS BIGINT) AS touch_points, CAST(sum(row_count) AS BIGINT) AS rows_governed,
            CAST(count(*) * sum(touch_points) AS BIGINT) AS complexity_score
            FROM (SELECT change_scenario, object_name, count(*) AS touch_points FROM (
                    SELECT 'every_customer_table' AS change_scenario, object_name
                    FROM ({_catalog_values()}) a WHERE object_name LIKE '%customer%'
                    UNION ALL SELECT 'all_key_completeness_rules', object_name
                    FROM ({_catalog_values()}) b WHERE rule_group = 'KEY_COMPLETENESS'
                    UNION ALL SELECT 'first_silver_rule', object_name
                    FROM ({_catalog_values()}) c WHERE rule_id = 'DP_SILVER_001') touched
                  GROUP BY ALL) t
            JOIN ({_row_counts({**BRONZE_TABLES, 'silver_date_dim': 's_date', 'silver_customer': 's_customer', 'gold_dim_customer': 's_customer'})}) n
            ON t.object_name = n.object_name GROUP BY change_scenario""",
        "corpus_scan": f"""SELECT source, 'unknown' AS layer, false AS is_data_quality,
            CAST(sum(length(text) + 1) AS BIGINT) AS characters,
            CAST(sum(len(list_filter({LINE_SPLIT}, lambda l: {CODE_LINE}))) AS BIGINT) AS code_lines
            FROM documents GROUP BY source""",
        "overwrite_keeps_schema": """SELECT o_orderpriority, count(*) AS orders,
            CAST(sum(CAST(trunc(o_totalprice) AS BIGINT)) AS DOUBLE) AS price FROM orders GROUP BY o_orderpriority""",
        "view_dataset": """SELECT o_orderstatus, count(*) AS orders, count(DISTINCT o_custkey) AS customers
            FROM orders GROUP BY o_orderstatus""",
        "publish_view": """SELECT c_nationkey, count(*) AS customers,
            (SELECT count(DISTINCT c_nationkey) FROM customer) AS published_rows FROM customer GROUP BY c_nationkey""",
        "layer_run": _row_counts(
            {
                **BRONZE_TABLES,
                **{t: "s_" + n for t, n in SILVER_TABLES.items()},
                **{t: "gs_" + n for t, n in GOLD_TABLES.items()},
            }
        ),
        "key_config": _union(
            [
                f"""SELECT {text(t)} AS object_name, {text(', '.join(BRONZE_KEYS[t]))} AS key_cols,
                (SELECT count(*) FROM {n}) AS row_count,
                (SELECT count(*) FROM (SELECT 1 FROM {n} GROUP BY {', '.join(BRONZE_KEYS[t])}) g) AS distinct_keys"""
                for t, n in BRONZE_TABLES.items()
            ]
        ),
        "path_and_unit_labels": """SELECT event_id,
            CASE event_id % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'bronze' WHEN 2 THEN 'silver' ELSE 'gold' END AS layer,
            '0' || CAST(event_id % 4 AS VARCHAR) || '_' || event_type AS job,
            event_id % 3 = 0 AS is_data_quality,
            CASE WHEN event_type LIKE 'dec%' OR event_id % 5 = 0 THEN 'declarative' ELSE 'imperative' END AS variant,
            value / 60 AS minutes FROM events""",
        "pattern_lines": f"SELECT doc_id, source, code_lines, pattern_lines FROM {DOC_LINES}",
        "extract_ids": f"""SELECT identifier, count(*) AS occurrences, count(DISTINCT doc_id) AS documents
            FROM {IDS} GROUP BY identifier""",
        "normalize_text": f"SELECT doc_id, {_normalized('text')} AS normalized FROM documents",
        "clone_blocks": CLONES,
        "near_duplicates": f"""SELECT DISTINCT doc_id FROM (
            WITH words AS (SELECT doc_id, regexp_split_to_array({_normalized('lower(text)')}, ' ') AS w FROM documents),
            runs AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS run
                     FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words) s),
            sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
            pairs AS (SELECT a.doc_id AS earlier, b.doc_id, count(*) AS common FROM runs a
                      JOIN runs b ON a.run = b.run AND a.doc_id < b.doc_id GROUP BY ALL)
            SELECT p.doc_id FROM pairs p JOIN sizes x ON x.doc_id = p.earlier JOIN sizes y ON y.doc_id = p.doc_id
            WHERE 10 * common >= 8 * (x.n + y.n - common)) found""",
        "kpi_summary": f"""SELECT s.*, coalesce(r.unique_items, 0) AS unique_items,
            coalesce(r.total_uses, 0) AS total_uses, coalesce(r.duplicate_instances, 0) AS duplicate_instances,
            coalesce(r.reuse_ratio, 0) AS reuse_ratio,
            coalesce(r.duplicate_instance_ratio, 0) AS duplicate_instance_ratio,
            a.avg_pattern_lines, coalesce(c.duplicated_blocks, 0) AS duplicated_blocks,
            coalesce(CAST(c.duplicated_blocks AS DOUBLE) / r.unique_items, 0) AS duplicate_block_ratio FROM (
                SELECT source, CAST(sum(code_lines) AS BIGINT) AS total_value,
                       CAST(coalesce(sum(code_lines) FILTER (WHERE pattern_lines > 0), 0) AS BIGINT) AS subset_value,
                       count(*) AS num_members, count(*) FILTER (WHERE pattern_lines > 0) AS num_subset_members,
                       coalesce({_pct('sum(code_lines) FILTER (WHERE pattern_lines > 0)', 'sum(code_lines)')}, 0.0)
                           AS subset_percentage
                FROM {DOC_LINES} GROUP BY source) s
            LEFT JOIN (SELECT source, count(DISTINCT identifier) AS unique_items, count(*) AS total_uses,
                         count(*) - count(DISTINCT identifier) AS duplicate_instances,
                         CAST(count(*) AS DOUBLE) / count(DISTINCT identifier) AS reuse_ratio,
                         CAST(count(*) - count(DISTINCT identifier) AS DOUBLE) / count(DISTINCT identifier)
                             AS duplicate_instance_ratio
                  FROM {IDS} GROUP BY source) r ON r.source = s.source
            LEFT JOIN (SELECT source, avg(pattern_lines) FILTER (WHERE pattern_lines > 0) AS avg_pattern_lines
                  FROM {DOC_LINES} GROUP BY source) a ON a.source = s.source
            LEFT JOIN ({CLONES}) c ON c.source = s.source""",
    }
    return {name: query(statement) for name, statement in sql.items()}
