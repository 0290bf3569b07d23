"""Column contracts of the silver tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oresmith.functions.aggregates import count_if

LINEAGE = ("ingestion_timestamp", "source_table")
# Holds what a row lost to its contract's types, as ``column=raw value; ...``; NULL if nothing.
CAST_FAILED = "cast_failed"


@dataclass(frozen=True)
class Field:
    """``clean``: '' keeps the text, 'trim' trims it, 'blank' also turns empty text into NULL."""

    name: str
    type: str
    clean: str = ""

    def misfit(self) -> str:
        """SQL that is true where a value is present but does not fit.

        ``greatest(x, x)`` is x. Written with x alone, the cast would equal the typed column, and
        the optimizer would derive every way of putting one for the other: 2 to the power of the
        columns.
        """
        return f"({self.name} IS NOT NULL AND try_cast(greatest({self.name}, {self.name}) AS {self.type}) IS NULL)"

    def lost(self) -> str:
        """SQL for ``column=raw value`` where a value is present but does not fit, else NULL."""
        return f"CASE WHEN {self.misfit()} THEN concat('{self.name}=', CAST({self.name} AS string)) END"

    def typed(self) -> str:
        """SQL for the source column in the contract's type; a value that does not fit is NULL."""
        if self.type != "string":
            value = f"try_cast({self.name} AS {self.type})"
        elif self.clean == "blank":
            value = f"nullif(trim(CAST({self.name} AS string)), '')"
        elif self.clean == "trim":
            value = f"trim(CAST({self.name} AS string))"
        else:
            value = f"CAST({self.name} AS string)"
        return f"{value} AS {self.name}"


@dataclass(frozen=True)
class Contract:
    name: str
    key: tuple[str, ...]
    fields: tuple[Field, ...]

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]

    def project(self, source: DataFrame, *carry: str) -> DataFrame:
        """Exactly the contract's columns, typed and cleaned, plus the ``carry`` columns."""
        return source.selectExpr(*[f.typed() for f in self.fields], *carry)

    def checked(self, source: DataFrame, *carry: str) -> DataFrame:
        """``project`` with ``CAST_FAILED`` as its last column. A column that has its type already
        cannot lose a value and is not looked at.

        The texts are put together only for rows that lost something, and as an array without its
        NULLs: a filter over an array stays out of the function that Spark generates for the whole
        stage, which with the texts of 16 columns in it is too long for the JVM to compile.
        """
        types = dict(source.dtypes)
        checked = [f for f in self.fields if f.type != "string" and types.get(f.name) != f.type]
        if not checked:
            return self.project(source, *carry, f"CAST(NULL AS string) AS {CAST_FAILED}")
        texts = f"array_compact(array({', '.join(f.lost() for f in checked)}))"
        any_lost = " OR ".join(f.misfit() for f in checked)
        text = f"CASE WHEN {any_lost} THEN array_join({texts}, '; ') END"
        return self.project(source, *carry, f"{text} AS {CAST_FAILED}")

    def cast_failures(self, source: DataFrame) -> DataFrame:
        """One row: per non-text column, the rows whose value is present but does not fit."""
        return source.agg(
            *[
                count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.type).isNull()).alias(f.name)
                for f in self.fields
                if f.type != "string"
            ]
        )

    def with_types(self, types: Mapping[str, str]) -> Contract:
        """The same contract with other types for some columns."""
        return Contract(
            self.name,
            self.key,
            tuple(Field(f.name, types.get(f.name, f.type), f.clean) for f in self.fields),
        )


# Names, order and types of the silver columns.
SALES = Contract(
    "silver_store_sales",
    ("ss_ticket_number", "ss_item_sk"),
    (
        Field("ss_sold_date_sk", "int"),
        Field("ss_sold_time_sk", "int"),
        Field("ss_item_sk", "int"),
        Field("ss_customer_sk", "int"),
        Field("ss_cdemo_sk", "int"),
        Field("ss_hdemo_sk", "int"),
        Field("ss_addr_sk", "int"),
        Field("ss_store_sk", "int"),
        Field("ss_promo_sk", "int"),
        Field("ss_ticket_number", "bigint"),
        Field("ss_quantity", "int"),
        Field("ss_wholesale_cost", "decimal(7,2)"),
        Field("ss_list_price", "decimal(7,2)"),
        Field("ss_sales_price", "decimal(7,2)"),
        Field("ss_ext_discount_amt", "decimal(7,2)"),
        Field("ss_ext_sales_price", "decimal(7,2)"),
        Field("ss_ext_wholesale_cost", "decimal(7,2)"),
        Field("ss_ext_list_price", "decimal(7,2)"),
        Field("ss_ext_tax", "decimal(7,2)"),
        Field("ss_coupon_amt", "decimal(7,2)"),
        Field("ss_net_paid", "decimal(7,2)"),
        Field("ss_net_paid_inc_tax", "decimal(7,2)"),
        Field("ss_net_profit", "decimal(7,2)"),
    ),
)

DATE = Contract(
    "silver_date_dim",
    ("d_date_sk",),
    (
        Field("d_date_sk", "int"),
        Field("d_date_id", "string"),
        Field("d_date", "date"),
        Field("d_month_seq", "int"),
        Field("d_week_seq", "int"),
        Field("d_quarter_seq", "int"),
        Field("d_year", "int"),
        Field("d_dow", "int"),
        Field("d_moy", "int"),
        Field("d_dom", "int"),
        Field("d_qoy", "int"),
        Field("d_fy_year", "int"),
        Field("d_fy_quarter_seq", "int"),
        Field("d_fy_week_seq", "int"),
        Field("d_day_name", "string", "trim"),
        Field("d_quarter_name", "string", "trim"),
        Field("d_holiday", "string"),
        Field("d_weekend", "string"),
        Field("d_following_holiday", "string"),
        Field("d_first_dom", "int"),
        Field("d_last_dom", "int"),
        Field("d_same_day_ly", "int"),
        Field("d_same_day_lq", "int"),
        Field("d_current_day", "string"),
        Field("d_current_week", "string"),
        Field("d_current_month", "string"),
        Field("d_current_quarter", "string"),
        Field("d_current_year", "string"),
    ),
)

ITEM = Contract(
    "silver_item",
    ("i_item_sk",),
    (
        Field("i_item_sk", "int"),
        Field("i_item_id", "string", "blank"),
        Field("i_rec_start_date", "date"),
        Field("i_rec_end_date", "date"),
        Field("i_item_desc", "string", "blank"),
        Field("i_current_price", "decimal(7,2)"),
        Field("i_wholesale_cost", "decimal(7,2)"),
        Field("i_brand_id", "int"),
        Field("i_brand", "string", "blank"),
        Field("i_class_id", "int"),
        Field("i_class", "string", "blank"),
        Field("i_category_id", "int"),
        Field("i_category", "string", "blank"),
        Field("i_manufact_id", "int"),
        Field("i_manufact", "string", "blank"),
        Field("i_size", "string", "blank"),
        Field("i_formulation", "string", "blank"),
        Field("i_color", "string", "blank"),
        Field("i_units", "string", "blank"),
        Field("i_container", "string", "blank"),
        Field("i_manager_id", "int"),
        Field("i_product_name", "string", "blank"),
    ),
)

STORE = Contract(
    "silver_store",
    ("s_store_sk",),
    (
        Field("s_store_sk", "int"),
        Field("s_store_id", "string", "blank"),
        Field("s_rec_start_date", "date"),
        Field("s_rec_end_date", "date"),
        Field("s_closed_date_sk", "int"),
        Field("s_store_name", "string", "blank"),
        Field("s_number_employees", "int"),
        Field("s_floor_space", "int"),
        Field("s_hours", "string", "blank"),
        Field("s_manager", "string", "blank"),
        Field("s_market_id", "int"),
        Field("s_geography_class", "string", "blank"),
        Field("s_market_desc", "string", "blank"),
        Field("s_market_manager", "string", "blank"),
        Field("s_division_id", "int"),
        Field("s_division_name", "string", "blank"),
        Field("s_company_id", "int"),
        Field("s_company_name", "string", "blank"),
        Field("s_street_number", "string", "blank"),
        Field("s_street_name", "string", "blank"),
        Field("s_street_type", "string", "blank"),
        Field("s_suite_number", "string", "blank"),
        Field("s_city", "string", "blank"),
        Field("s_county", "string", "blank"),
        Field("s_state", "string", "blank"),
        Field("s_zip", "string", "blank"),
        Field("s_country", "string", "blank"),
        Field("s_gmt_offset", "decimal(5,2)"),
        Field("s_tax_precentage", "decimal(5,2)"),
    ),
)

CUSTOMER = Contract(
    "silver_customer",
    ("c_customer_sk",),
    (
        Field("c_customer_sk", "int"),
        Field("c_customer_id", "string", "blank"),
        Field("c_current_cdemo_sk", "int"),
        Field("c_current_hdemo_sk", "int"),
        Field("c_current_addr_sk", "int"),
        Field("c_first_shipto_date_sk", "int"),
        Field("c_first_sales_date_sk", "int"),
        Field("c_salutation", "string", "blank"),
        Field("c_first_name", "string", "blank"),
        Field("c_last_name", "string", "blank"),
        Field("c_preferred_cust_flag", "string"),
        Field("c_birth_day", "int"),
        Field("c_birth_month", "int"),
        Field("c_birth_year", "int"),
        Field("c_birth_country", "string", "blank"),
        Field("c_login", "string", "blank"),
        Field("c_email_address", "string", "blank"),
        Field("c_last_review_date_sk", "int"),
        Field("c_last_review_date", "int"),
    ),
)

CONTRACTS = {c.name: c for c in (SALES, DATE, ITEM, STORE, CUSTOMER)}

CONTRACTS = {c.name: c for c in (DATE, ITEM, STORE, CUSTOMER, SALES)}


def cast_failure_report(bronze: Mapping[str, DataFrame]) -> DataFrame:
    """(object_name, column_name, failed_rows) for every typed column of the given bronze tables.

    One scan per table; the object is the silver table that the contract describes.
    """
    frames = []
    for name, source in bronze.items():
        contract = CONTRACTS[name.replace("bronze_", "silver_", 1)]
        counts = contract.cast_failures(source)
        rows = [
            F.struct(
                F.lit(contract.name).alias("object_name"), F.lit(c).alias("column_name"), F.col(c).alias("failed_rows")
            )
            for c in counts.columns
        ]
        frames.append(counts.select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, frames)
