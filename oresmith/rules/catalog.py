"""The rule catalog and the rule sets around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from oresmith.rules.model import Expectation, IssueSpec, Reason, Rule

# Key columns of every bronze table and the id prefix of its rules.
BRONZE_KEYS = {
    "bronze_store_sales": ("ss_item_sk", "ss_ticket_number", "ss_sold_date_sk", "ss_store_sk"),
    "bronze_date_dim": ("d_date_sk", "d_date_id"),
    "bronze_item": ("i_item_sk", "i_item_id"),
    "bronze_store": ("s_store_sk", "s_store_id"),
    "bronze_customer": ("c_customer_sk", "c_customer_id"),
}
BRONZE_PREFIXES = {
    "bronze_store_sales": "BRZ_SS",
    "bronze_date_dim": "BRZ_DATE",
    "bronze_item": "BRZ_ITEM",
    "bronze_store": "BRZ_STORE",
    "bronze_customer": "BRZ_CUST",
}

# Owner and validation mode by (layer, action).
OWNERS = {"bronze": "data-engineering", "silver": "model-owner", "gold": "business-owner"}
VALIDATION_MODES = {
    ("bronze", "MONITOR"): "passive observability on raw model",
    ("silver", "EXPECT"): "EXPECT constraint on materialized model",
    ("silver", "OBSERVE"): "observed model state after EXPECT enforcement",
    ("gold", "EXPECT"): "EXPECT constraint on materialized view",
}

MONEY_COLUMNS = ("ss_sales_price", "ss_list_price", "ss_wholesale_cost", "ss_net_paid")
SALES_REFERENCES = ("ss_sold_date_sk", "ss_item_sk", "ss_store_sk", "ss_customer_sk")


def _present(*columns: str) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in columns)


def _non_negative(column: str) -> str:
    return f"{column} >= 0 OR {column} IS NULL"


def _bronze_rules() -> list[Rule]:
    rules = []
    for table, keys in BRONZE_KEYS.items():
        prefix = BRONZE_PREFIXES[table]
        for n, key in enumerate(keys, start=1):
            rules.append(
                Rule(f"{prefix}_KEY_{n:02d}", table, "KEY_COMPLETENESS", _present(key), "MONITOR", "LOW")
            )
        rules.append(
            Rule(
                f"{prefix}_DUP_01",
                table,
                "DUPLICATE_MONITORING",
                f"duplicate({', '.join(keys)})",
                "MONITOR",
                "MEDIUM",
                kind="duplicate",
                columns=keys,
            )
        )
    return rules


# Id, object, group, predicate, severity of the enforced silver and gold rules.
_ENFORCED = (
    ("DP_SILVER_001", "silver_date_dim", "KEY_VALIDITY", _present("d_date_sk"), "HIGH"),
    ("DP_SILVER_002", "silver_date_dim", "KEY_VALIDITY", _present("d_date"), "HIGH"),
    ("DP_SILVER_003", "silver_date_dim", "DOMAIN_VALIDITY", "d_year BETWEEN 1900 AND 2100", "MEDIUM"),
    ("DP_SILVER_004", "silver_date_dim", "DOMAIN_VALIDITY", "d_moy BETWEEN 1 AND 12", "MEDIUM"),
    ("DP_SILVER_005", "silver_item", "KEY_VALIDITY", _present("i_item_sk", "i_item_id"), "HIGH"),
    ("DP_SILVER_006", "silver_item", "BUSINESS_VALUE",
     "i_current_price IS NOT NULL AND i_current_price >= 0", "HIGH"),
    ("DP_SILVER_007", "silver_item", "BUSINESS_VALUE", _non_negative("i_wholesale_cost"), "MEDIUM"),
    ("DP_SILVER_008", "silver_store", "KEY_VALIDITY",
     _present("s_store_sk", "s_store_id", "s_store_name"), "HIGH"),
    ("DP_SILVER_009", "silver_customer", "KEY_VALIDITY", _present("c_customer_sk", "c_customer_id"), "HIGH"),
    ("DP_SILVER_010", "silver_store_sales", "KEY_VALIDITY", _present("ss_ticket_number", "ss_item_sk"), "HIGH"),
    ("DP_SILVER_011", "silver_store_sales", "BUSINESS_VALUE", "ss_quantity > 0", "HIGH"),
    ("DP_SILVER_012", "silver_store_sales", "BUSINESS_VALUE",
     " AND ".join(f"({_non_negative(c)})" for c in MONEY_COLUMNS), "HIGH"),
    ("DP_GOLD_000", "gold_dim_date", "BUSINESS_KEY", _present("date_key", "calendar_date"), "HIGH"),
    ("DP_GOLD_001", "gold_dim_item", "BUSINESS_VALUE",
     f"current_price >= 0 AND ({_non_negative('wholesale_cost')})", "HIGH"),
    ("DP_GOLD_002", "gold_dim_store", "BUSINESS_KEY", _present("store_id", "store_name"), "HIGH"),
    ("DP_GOLD_003", "gold_dim_customer", "BUSINESS_KEY", _present("customer_id", "email_address"), "HIGH"),
    ("DP_GOLD_004", "gold_fact_store_sales", "MEASURE_VALIDITY", "net_profit >= 0", "HIGH"),
    ("DP_GOLD_005", "gold_fact_store_sales", "BUSINESS_KEY",
     _present("sold_date_key", "item_key", "store_key", "customer_key"), "HIGH"),
    ("DP_GOLD_006", "gold_top_items_month", "BUSINESS_KEY", _present("year", "month", "item_key"), "HIGH"),
)

_REFERENTIAL = Rule(
    "DP_SILVER_013",
    "silver_store_sales",
    "REFERENTIAL_VALIDITY",
    f"foreign_key({', '.join(SALES_REFERENCES)})",
    "OBSERVE",
    "MEDIUM",
    kind="foreign_key",
    columns=SALES_REFERENCES,
)


def _catalog() -> tuple[Rule, ...]:
    enforced = [
        Rule(rule_id, table, group, predicate, "EXPECT", severity)
        for rule_id, table, group, predicate, severity in _ENFORCED
    ]
    silver = [r for r in enforced if r.layer == "silver"]
    gold = [r for r in enforced if r.layer == "gold"]
    return (*_bronze_rules(), *silver, _REFERENTIAL, *gold)


RULES = _catalog()

# Names and predicates of what holds on silver tables beside the catalog.
EXTRA_EXPECTATIONS = (
    Expectation("pk_date_sk_positive", "silver_date_dim", "d_date_sk > 0"),
    Expectation("valid_day_of_month", "silver_date_dim", "d_dom BETWEEN 1 AND 31"),
    Expectation("valid_day_of_week", "silver_date_dim", "d_dow BETWEEN 0 AND 6"),
    Expectation("valid_quarter", "silver_date_dim", "d_qoy BETWEEN 1 AND 4"),
    Expectation("valid_holiday_flag", "silver_date_dim", "d_holiday IN ('Y', 'N')", "monitor"),
    Expectation("valid_weekend_flag", "silver_date_dim", "d_weekend IN ('Y', 'N')", "monitor"),
    Expectation("pk_item_sk_positive", "silver_item", "i_item_sk > 0"),
    Expectation("valid_date_range", "silver_item",
                "i_rec_end_date IS NULL OR i_rec_end_date >= i_rec_start_date", "monitor"),
    Expectation("pk_store_sk_positive", "silver_store", "s_store_sk > 0"),
    Expectation("valid_employees", "silver_store", _non_negative("s_number_employees")),
    Expectation("valid_floor_space", "silver_store", _non_negative("s_floor_space")),
    Expectation("valid_tax_pct", "silver_store",
                "s_tax_precentage BETWEEN 0 AND 1 OR s_tax_precentage IS NULL", "monitor"),
    Expectation("valid_gmt_offset", "silver_store",
                "s_gmt_offset BETWEEN -12 AND 14 OR s_gmt_offset IS NULL", "monitor"),
    Expectation("valid_date_range", "silver_store",
                "s_rec_end_date IS NULL OR s_rec_end_date >= s_rec_start_date", "monitor"),
    Expectation("pk_customer_sk_positive", "silver_customer", "c_customer_sk > 0"),
    Expectation("valid_birth_year", "silver_customer",
                "c_birth_year BETWEEN 1900 AND 2100 OR c_birth_year IS NULL"),
    Expectation("valid_birth_month", "silver_customer",
                "c_birth_month BETWEEN 1 AND 12 OR c_birth_month IS NULL"),
    Expectation("valid_birth_day", "silver_customer",
                "c_birth_day BETWEEN 1 AND 31 OR c_birth_day IS NULL"),
    Expectation("fk_item_sk_positive", "silver_store_sales", "ss_item_sk > 0"),
    Expectation("sales_price_reasonable", "silver_store_sales",
                "ss_sales_price <= ss_list_price * 1.5 OR ss_sales_price IS NULL OR ss_list_price IS NULL"),
)


def rule(rule_id: str) -> Rule:
    """One catalog rule by id."""
    for candidate in RULES:
        if candidate.rule_id == rule_id:
            return candidate
    raise KeyError(rule_id)


def rules_for(layer: str | None = None, action: str | None = None, object_name: str | None = None) -> list[Rule]:
    return [
        r
        for r in RULES
        if (layer is None or r.layer == layer)
        and (action is None or r.action == action)
        and (object_name is None or r.object_name == object_name)
    ]


def expectations(object_name: str, action: str | None = None) -> list[Expectation]:
    """Enforced catalog predicates of a silver table followed by its other expectations."""
    from_catalog = [
        Expectation(r.rule_id, r.object_name, r.expression)
        for r in rules_for(action="EXPECT", object_name=object_name)
        if r.kind == "predicate"
    ]
    own = [e for e in EXTRA_EXPECTATIONS if e.object_name == object_name]
    return [e for e in (*from_catalog, *own) if action is None or e.action == action]


CATALOG_SCHEMA = T.StructType(
    [
        T.StructField(name, T.StringType(), False)
        for name in (
            "rule_id",
            "layer",
            "object_name",
            "rule_group",
            "rule_expression",
            "rule_type",
            "validation_mode",
            "severity",
            "owner",
        )
    ]
)

KEY_CONFIG_SCHEMA = T.StructType(
    [
        T.StructField("object_name", T.StringType(), False),
        T.StructField("key_cols", T.ArrayType(T.StringType()), False),
    ]
)


def catalog_frame(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The catalog as a table, one row per rule; of a size that the planner knows."""
    rows = [
        (
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
        for r in rules
    ]
    listed = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {listed} AS catalog({', '.join(CATALOG_SCHEMA.names)})")


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def key_config_frame(spark: SparkSession) -> DataFrame:
    """Key columns per bronze table."""
    return spark.createDataFrame([(t, list(keys)) for t, keys in BRONZE_KEYS.items()], KEY_CONFIG_SCHEMA)


def _spec(rule_id: str, keys: tuple[str, ...], *reasons: tuple[str, str]) -> IssueSpec:
    owner = rule(rule_id)
    return IssueSpec(
        owner.object_name, rule_id, owner.group, keys, tuple(Reason(*r) for r in reasons)
    )


SALES_KEYS = ("ss_ticket_number", "ss_item_sk", "ss_store_sk", "ss_customer_sk")
FACT_KEYS = ("ticket_number", "item_key", "store_key", "customer_key")

# Reason codes and the order in which they are tried, here and in the specs below.
MONEY_REASONS = (
    ("NEGATIVE_SALES_PRICE", "ss_sales_price < 0"),
    ("NEGATIVE_LIST_PRICE", "ss_list_price < 0"),
    ("NEGATIVE_WHOLESALE_COST", "ss_wholesale_cost < 0"),
    ("NEGATIVE_NET_PAID", "ss_net_paid < 0"),
)
QUANTITY_REASONS = (
    ("NULL_QUANTITY", "ss_quantity IS NULL"),
    ("INVALID_QUANTITY", "ss_quantity <= 0"),
)
SALES_KEY_REASONS = (
    ("NULL_TICKET_NUMBER", "ss_ticket_number IS NULL"),
    ("NULL_ITEM_SK", "ss_item_sk IS NULL"),
)

SILVER_ISSUES = (
    _spec(
        "DP_SILVER_001",
        ("d_date_sk", "d_date_id"),
        ("NULL_DATE_SK", "d_date_sk IS NULL"),
        ("NULL_DATE", "d_date IS NULL"),
        ("NULL_YEAR", "d_year IS NULL"),
        ("NULL_MONTH", "d_moy IS NULL"),
    ),
    _spec(
        "DP_SILVER_006",
        ("i_item_sk", "i_item_id"),
        ("NULL_CURRENT_PRICE", "i_current_price IS NULL"),
        ("NEGATIVE_CURRENT_PRICE", "i_current_price < 0"),
        ("NEGATIVE_WHOLESALE_COST", "i_wholesale_cost < 0"),
    ),
    _spec(
        "DP_SILVER_008",
        ("s_store_sk", "s_store_id", "s_store_name"),
        ("NULL_STORE_SK", "s_store_sk IS NULL"),
        ("NULL_STORE_ID", "s_store_id IS NULL"),
        ("NULL_STORE_NAME", "s_store_name IS NULL"),
    ),
    _spec(
        "DP_SILVER_009",
        ("c_customer_sk", "c_customer_id"),
        ("NULL_CUSTOMER_SK", "c_customer_sk IS NULL"),
        ("NULL_CUSTOMER_ID", "c_customer_id IS NULL"),
    ),
    _spec("DP_SILVER_010", SALES_KEYS, *SALES_KEY_REASONS, *QUANTITY_REASONS),
    _spec("DP_SILVER_012", SALES_KEYS, *MONEY_REASONS),
)

GOLD_ISSUES = (
    _spec(
        "DP_GOLD_001",
        ("item_key", "item_id"),
        ("NEGATIVE_CURRENT_PRICE", "current_price < 0"),
        ("NEGATIVE_WHOLESALE_COST", "wholesale_cost < 0"),
    ),
    _spec(
        "DP_GOLD_002",
        ("store_key", "store_id", "store_name"),
        ("NULL_STORE_ID", "store_id IS NULL"),
        ("NULL_STORE_NAME", "store_name IS NULL"),
    ),
    _spec(
        "DP_GOLD_003",
        ("customer_key", "customer_id", "email_address"),
        ("NULL_CUSTOMER_ID", "customer_id IS NULL"),
        ("NULL_EMAIL_ADDRESS", "email_address IS NULL"),
    ),
    _spec("DP_GOLD_004", FACT_KEYS, ("NEGATIVE_NET_PROFIT", "net_profit < 0")),
    _spec(
        "DP_GOLD_005",
        FACT_KEYS,
        ("NULL_SOLD_DATE_KEY", "sold_date_key IS NULL"),
        ("NULL_ITEM_KEY", "item_key IS NULL"),
        ("NULL_STORE_KEY", "store_key IS NULL"),
        ("NULL_CUSTOMER_KEY", "customer_key IS NULL"),
    ),
    _spec(
        "DP_GOLD_006",
        ("year", "month", "item_key", "item_id"),
        ("NULL_YEAR", "year IS NULL"),
        ("NULL_MONTH", "month IS NULL"),
        ("NULL_ITEM_KEY", "item_key IS NULL"),
    ),
)


def _fact_spec(rule_id: str, group: str, *reasons: tuple[str, str]) -> IssueSpec:
    return IssueSpec(
        "silver_store_sales", rule_id, group, SALES_KEYS, tuple(Reason(*r) for r in reasons)
    )


# Why a fact row is kept out of silver. A row no entry fires on is kept, so the kept and the
# quarantined rows together are the deduplicated input. ``has_valid_*_fk`` are the reference flags.
CAST_RULE = "cast_contract"
QUARANTINE_RULES = (
    _fact_spec(CAST_RULE, "TYPE_VALIDITY", ("CAST_FAILED", "cast_failed IS NOT NULL")),
    _spec("DP_SILVER_010", SALES_KEYS, *SALES_KEY_REASONS),
    _fact_spec("fk_item_sk_positive", "KEY_VALIDITY", ("NON_POSITIVE_ITEM_SK", "ss_item_sk <= 0")),
    _spec("DP_SILVER_011", SALES_KEYS, *QUANTITY_REASONS),
    _spec("DP_SILVER_012", SALES_KEYS, *MONEY_REASONS),
    _fact_spec(
        "sales_price_reasonable",
        "BUSINESS_VALUE",
        ("UNREASONABLE_SALES_PRICE", "ss_sales_price > ss_list_price * 1.5"),
    ),
    _spec(
        "DP_SILVER_013",
        SALES_KEYS,
        ("INVALID_DATE_FK", "has_valid_date_fk = 0"),
        ("INVALID_ITEM_FK", "has_valid_item_fk = 0"),
        ("INVALID_STORE_FK", "has_valid_store_fk = 0"),
        ("INVALID_CUSTOMER_FK", "has_valid_customer_fk = 0"),
    ),
)
