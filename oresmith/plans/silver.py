"""Silver: typed, cleaned, one row per key, validated, with resolved references.

Every builder takes ``tie_break`` columns that decide between rows of equal load time, and
``validate_first``: the default validates the latest version of a key, so a bad latest row
removes the key; with ``validate_first`` an older good version takes its place. ``enforced=False``
skips the row rules, which shows the issue reports what they are meant to find.

A row that lost a value to the types of its contract breaks a rule like any other: it is rejected
with its raw values kept, so a key that does not fit is never taken for a missing one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oresmith.functions.text import year_month, yes_flag
from oresmith.operators.keys import latest_by_key, latest_of_complete_keys
from oresmith.operators.references import Reference, keep_resolved, reference_flags
from oresmith.plans.contracts import CAST_FAILED, CONTRACTS, CUSTOMER, DATE, ITEM, LINEAGE, SALES, STORE, Contract
from oresmith.quality.enforce import enforce_table, failed_expectations
from oresmith.quality.issues import issue_frame
from oresmith.rules.catalog import BRONZE_KEYS, CAST_RULE, QUARANTINE_RULES
from oresmith.rules.model import DECLARATIVE, IssueSpec, any_reason

QUARANTINE_CONTEXT = (
    "ss_sold_date_sk",
    "ss_sold_time_sk",
    "ss_quantity",
    "ss_sales_price",
    "ss_list_price",
    "ss_wholesale_cost",
    "ss_net_paid",
    "ss_net_profit",
    *LINEAGE,
    CAST_FAILED,
)


def _latest(enforced: bool):
    """Enforced tables drop rows without a key anyway; reports must see each of them."""
    return latest_by_key if enforced else latest_of_complete_keys


def _dimension(
    bronze: DataFrame,
    contract: Contract,
    derived: Mapping[str, Column],
    tie_break: Sequence[str] | None,
    validate_first: bool,
    enforced: bool,
) -> DataFrame:
    rows, extra = _versions(bronze, contract, derived, tie_break)
    if enforced and validate_first:
        rows = _fitting(rows, contract.name)
    rows = _latest(enforced)(rows, contract.key, tie_break=tie_break).drop(*extra)
    if enforced and not validate_first:
        rows = _fitting(rows, contract.name)
    return rows.drop(CAST_FAILED)


def _versions(
    bronze: DataFrame, contract: Contract, derived: Mapping[str, Column], tie_break: Sequence[str] | None
) -> tuple[DataFrame, list[str]]:
    """All rows in the contract's types with what they lost, and the tie columns beside them."""
    extra = [c for c in tie_break or () if c not in (*contract.columns, *LINEAGE)]
    rows = contract.checked(bronze, *LINEAGE, *extra)
    if derived:
        rows = rows.select(
            *contract.columns, *[c.alias(n) for n, c in derived.items()], *LINEAGE, *extra, CAST_FAILED
        )
    return rows, extra


def _fitting(rows: DataFrame, name: str) -> DataFrame:
    """Rows that lost no value and satisfy the row rules."""
    return enforce_table(rows.where(F.col(CAST_FAILED).isNull()), name)


def latest_dimension(name: str, bronze: DataFrame, tie_break: Sequence[str] | None = None) -> DataFrame:
    """Latest rows of a dimension before its rules, with what they lost: all the split needs."""
    rows, extra = _versions(bronze, CONTRACTS[name], _derived(name), tie_break)
    return latest_of_complete_keys(rows, CONTRACTS[name].key, tie_break=tie_break).drop(*extra)


def kept_dimension(name: str, latest: DataFrame) -> DataFrame:
    """Latest rows that satisfy the rules, in silver shape."""
    return _fitting(latest, name).drop(CAST_FAILED)


def dimension_rejects(name: str, latest: DataFrame) -> DataFrame:
    """One row per latest row that the rules drop: its keys, the rules it breaks, what it lost."""
    first, second = BRONZE_KEYS[name.replace("silver_", "bronze_", 1)]
    lost = F.when(F.col(CAST_FAILED).isNotNull(), F.lit(CAST_RULE))
    broken = F.concat_ws(", ", lost, *failed_expectations(name, "drop"))
    return latest.select(
        F.lit(name).alias("object_name"),
        F.col(first).cast("string").alias("key_1"),
        F.col(second).cast("string").alias("key_2"),
        broken.alias("broken_rules"),
        CAST_FAILED,
    ).where("broken_rules <> ''")


def _derived(name: str) -> dict[str, Column]:
    if name == DATE.name:
        return {"year_month": year_month("d_year", "d_moy"), "is_weekend": yes_flag("d_weekend")}
    return {}


def silver_date(
    bronze: DataFrame,
    tie_break: Sequence[str] | None = None,
    validate_first: bool = False,
    enforced: bool = True,
) -> DataFrame:
    return _dimension(bronze, DATE, _derived(DATE.name), tie_break, validate_first, enforced)


def silver_item(
    bronze: DataFrame,
    tie_break: Sequence[str] | None = None,
    validate_first: bool = False,
    enforced: bool = True,
) -> DataFrame:
    return _dimension(bronze, ITEM, {}, tie_break, validate_first, enforced)


def silver_store(
    bronze: DataFrame,
    tie_break: Sequence[str] | None = None,
    validate_first: bool = False,
    enforced: bool = True,
) -> DataFrame:
    return _dimension(bronze, STORE, {}, tie_break, validate_first, enforced)


def silver_customer(
    bronze: DataFrame,
    tie_break: Sequence[str] | None = None,
    validate_first: bool = False,
    enforced: bool = True,
) -> DataFrame:
    return _dimension(bronze, CUSTOMER, {}, tie_break, validate_first, enforced)


def sales_references(
    date: DataFrame, item: DataFrame, store: DataFrame, customer: DataFrame
) -> list[Reference]:
    """The fact's foreign keys: the item must resolve, the others may be missing."""
    return [
        Reference("ss_sold_date_sk", date, "d_date_sk", "has_valid_date_fk"),
        Reference("ss_item_sk", item, "i_item_sk", "has_valid_item_fk", required=True),
        Reference("ss_store_sk", store, "s_store_sk", "has_valid_store_fk"),
        Reference("ss_customer_sk", customer, "c_customer_sk", "has_valid_customer_fk"),
    ]


def latest_sales(
    bronze: DataFrame, tie_break: Sequence[str] | None = None, validate_first: bool = False
) -> DataFrame:
    """Typed fact rows with what they lost, one per (ticket, item); rows without a complete key
    all stay."""
    rows, extra = _versions(bronze, SALES, {}, tie_break)
    if validate_first:
        rows = _fitting(rows, SALES.name)
    return latest_of_complete_keys(rows, SALES.key, tie_break=tie_break).drop(*extra)


def silver_sales(
    bronze: DataFrame,
    references: Sequence[Reference],
    tie_break: Sequence[str] | None = None,
    validate_first: bool = False,
    enforced: bool = True,
) -> DataFrame:
    """The fact: latest rows that satisfy the row rules and whose references resolve.

    The row rules run before the reference joins, so fewer rows are joined; both are row
    filters, so their order does not change the result.
    """
    rows, _ = _versions(bronze, SALES, {}, tie_break)
    if validate_first and enforced:
        rows = _fitting(rows, SALES.name)
    rows = _latest(enforced)(rows, SALES.key, tie_break=tie_break)
    if enforced:
        rows = _fitting(rows, SALES.name)
    return keep_resolved(rows.select(*SALES.columns, *LINEAGE), references)


def annotated_sales(
    bronze: DataFrame, references: Sequence[Reference], tie_break: Sequence[str] | None = None
) -> DataFrame:
    """Latest fact rows with one 0/1 flag per reference: all that the split below needs."""
    return reference_flags(latest_sales(bronze, tie_break), references)


def resolved_sales(annotated: DataFrame, references: Sequence[Reference]) -> DataFrame:
    """Annotated rows whose references resolve, in silver shape; the row rules are not applied."""
    resolve = [F.col(r.flag) == 1 for r in references]
    return annotated.where(reduce(lambda a, b: a & b, resolve)).select(*SALES.columns, *LINEAGE)


def _rejected(rules: Sequence[IssueSpec]) -> Column:
    rejected = F.lit(False)
    for spec in rules:
        rejected = rejected | any_reason(spec.reasons)
    return rejected


def kept_sales(annotated: DataFrame, rules: Sequence[IssueSpec] = QUARANTINE_RULES) -> DataFrame:
    """Annotated rows no quarantine rule fires on, in silver shape."""
    return annotated.where(~_rejected(rules)).select(*SALES.columns, *LINEAGE)


def sales_quarantine(
    annotated: DataFrame,
    rules: Sequence[IssueSpec] = QUARANTINE_RULES,
    variant: str = DECLARATIVE,
    observed_at: Column | None = None,
) -> DataFrame:
    """One row per (rejected fact row, broken rule) with context columns."""
    return issue_frame(annotated, rules, variant, QUARANTINE_CONTEXT, observed_at)


BUILDERS = {
    DATE.name: silver_date,
    ITEM.name: silver_item,
    STORE.name: silver_store,
    CUSTOMER.name: silver_customer,
}
