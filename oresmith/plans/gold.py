"""Gold: business names, derived measures, and the monthly leaders."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oresmith.functions import measures as m
from oresmith.functions import text as t
from oresmith.operators.keys import top_n
from oresmith.operators.references import Reference, keep_required


def _renamed(columns: Mapping[str, str]) -> list[Column]:
    """Columns under new names, given as ``new: old``."""
    return [F.col(old).alias(new) for new, old in columns.items()]


# The mappings of new to old names below are fixed values, as are their order and the flags.


def gold_date(silver: DataFrame) -> DataFrame:
    flags = (
        "holiday",
        "following_holiday",
        "current_day",
        "current_week",
        "current_month",
        "current_quarter",
        "current_year",
    )
    is_flag = {f: t.yes_flag(f"d_{f}").alias(f"is_{f}") for f in flags}
    return silver.select(
        *_renamed(
            {
                "date_key": "d_date_sk",
                "date_id": "d_date_id",
                "calendar_date": "d_date",
                "year": "d_year",
                "quarter": "d_qoy",
                "month": "d_moy",
                "day_of_month": "d_dom",
                "day_of_week": "d_dow",
                "day_name": "d_day_name",
                "quarter_name": "d_quarter_name",
                "fiscal_year": "d_fy_year",
                "fiscal_quarter_seq": "d_fy_quarter_seq",
                "fiscal_week_seq": "d_fy_week_seq",
                "month_seq": "d_month_seq",
                "week_seq": "d_week_seq",
                "quarter_seq": "d_quarter_seq",
                "year_month": "year_month",
            }
        ),
        t.quarter_year("d_qoy", "d_year").alias("quarter_year"),
        is_flag["holiday"],
        F.col("is_weekend"),
        is_flag["following_holiday"],
        is_flag["current_day"],
        is_flag["current_week"],
        is_flag["current_month"],
        is_flag["current_quarter"],
        is_flag["current_year"],
        *_renamed(
            {
                "same_day_last_year_key": "d_same_day_ly",
                "same_day_last_quarter_key": "d_same_day_lq",
                "source_timestamp": "ingestion_timestamp",
            }
        ),
    )


def gold_item(silver: DataFrame, unknown_band: str | None = None) -> DataFrame:
    price, cost = F.col("i_current_price"), F.col("i_wholesale_cost")
    return silver.select(
        *_renamed(
            {
                "item_key": "i_item_sk",
                "item_id": "i_item_id",
                "item_description": "i_item_desc",
                "product_name": "i_product_name",
                "current_price": "i_current_price",
                "wholesale_cost": "i_wholesale_cost",
            }
        ),
        m.price_band(price, unknown_band).alias("price_category"),
        m.margin_percent(price, cost).alias("margin_pct"),
        *_renamed(
            {
                "brand_id": "i_brand_id",
                "brand_name": "i_brand",
                "manufacturer_id": "i_manufact_id",
                "manufacturer_name": "i_manufact",
                "category_id": "i_category_id",
                "category_name": "i_category",
                "class_id": "i_class_id",
                "class_name": "i_class",
                "size": "i_size",
                "color": "i_color",
                "unit_of_measure": "i_units",
                "container_type": "i_container",
                "formulation": "i_formulation",
                "manager_id": "i_manager_id",
                "valid_from": "i_rec_start_date",
                "valid_to": "i_rec_end_date",
            }
        ),
        t.open_ended("i_rec_end_date").alias("is_current"),
        *_renamed(
            {
                "source_timestamp": "ingestion_timestamp",
            }
        ),
    )


def gold_store(silver: DataFrame, unknown_band: str | None = None) -> DataFrame:
    street = ("s_street_number", "s_street_name", "s_street_type")
    return silver.select(
        *_renamed(
            {
                "store_key": "s_store_sk",
                "store_id": "s_store_id",
                "store_name": "s_store_name",
                "number_of_employees": "s_number_employees",
                "floor_space_sqft": "s_floor_space",
                "operating_hours": "s_hours",
                "store_manager": "s_manager",
            }
        ),
        m.store_size_band(F.col("s_number_employees"), unknown_band).alias("store_size_category"),
        *_renamed(
            {
                "market_id": "s_market_id",
                "market_description": "s_market_desc",
                "market_manager": "s_market_manager",
                "geography_class": "s_geography_class",
                "company_id": "s_company_id",
                "company_name": "s_company_name",
                "division_id": "s_division_id",
                "division_name": "s_division_name",
            }
        ),
        t.spaced(*street).alias("street_address"),
        *_renamed(
            {
                "suite_number": "s_suite_number",
                "city": "s_city",
                "county": "s_county",
                "state": "s_state",
                "zip_code": "s_zip",
                "country": "s_country",
            }
        ),
        t.postal_line((*street, "s_suite_number"), "s_city", "s_state", "s_zip", "s_country").alias(
            "full_address"
        ),
        *_renamed(
            {
                "gmt_offset": "s_gmt_offset",
                "tax_percentage": "s_tax_precentage",
                "valid_from": "s_rec_start_date",
                "valid_to": "s_rec_end_date",
                "closed_date_key": "s_closed_date_sk",
            }
        ),
        t.open_ended("s_rec_end_date", "s_closed_date_sk").alias("is_currently_open"),
        *_renamed(
            {
                "source_timestamp": "ingestion_timestamp",
            }
        ),
    )


def gold_customer(silver: DataFrame, as_of: date | None = None) -> DataFrame:
    """``as_of`` is the day ages are taken at; today if not given."""
    day = F.current_date() if as_of is None else F.lit(as_of)
    age = m.age_at(day, F.col("c_birth_year"))
    return silver.select(
        *_renamed(
            {
                "customer_key": "c_customer_sk",
                "customer_id": "c_customer_id",
            }
        ),
        t.spaced("c_salutation", "c_first_name", "c_last_name").alias("full_name"),
        *_renamed(
            {
                "salutation": "c_salutation",
                "first_name": "c_first_name",
                "last_name": "c_last_name",
                "email_address": "c_email_address",
                "login": "c_login",
                "birth_day": "c_birth_day",
                "birth_month": "c_birth_month",
                "birth_year": "c_birth_year",
                "birth_country": "c_birth_country",
            }
        ),
        m.age_band(age).alias("age_group"),
        age.alias("current_age"),
        t.yes_flag("c_preferred_cust_flag").alias("is_preferred_customer"),
        *_renamed(
            {
                "current_demographics_key": "c_current_cdemo_sk",
                "current_household_demographics_key": "c_current_hdemo_sk",
                "current_address_key": "c_current_addr_sk",
                "first_shipment_date_key": "c_first_shipto_date_sk",
                "first_sales_date_key": "c_first_sales_date_sk",
                "last_review_date_key": "c_last_review_date_sk",
                "last_review_date": "c_last_review_date",
                "source_timestamp": "ingestion_timestamp",
            }
        ),
    )


def gold_sales(silver: DataFrame, null_ratio: str = "zero") -> DataFrame:
    """The sales fact. ``null_ratio``: undefined ratios become 0 ('zero') or stay NULL ('null')."""
    if null_ratio not in ("zero", "null"):
        raise ValueError(f"null_ratio must be 'zero' or 'null', not {null_ratio!r}")
    settle = m.or_zero if null_ratio == "zero" else (lambda c: c)
    list_price, sales_price = F.col("ss_list_price"), F.col("ss_sales_price")
    revenue = F.col("ss_ext_sales_price")
    return silver.select(
        *_renamed(
            {
                "sold_date_key": "ss_sold_date_sk",
                "sold_time_key": "ss_sold_time_sk",
                "item_key": "ss_item_sk",
                "customer_key": "ss_customer_sk",
                "store_key": "ss_store_sk",
                "promotion_key": "ss_promo_sk",
                "customer_demographics_key": "ss_cdemo_sk",
                "household_demographics_key": "ss_hdemo_sk",
                "address_key": "ss_addr_sk",
                "ticket_number": "ss_ticket_number",
                "quantity_sold": "ss_quantity",
                "unit_wholesale_cost": "ss_wholesale_cost",
                "unit_list_price": "ss_list_price",
                "unit_sales_price": "ss_sales_price",
                "total_wholesale_cost": "ss_ext_wholesale_cost",
                "total_list_price": "ss_ext_list_price",
                "total_sales_price": "ss_ext_sales_price",
                "total_discount_amount": "ss_ext_discount_amt",
                "total_tax_amount": "ss_ext_tax",
                "coupon_amount": "ss_coupon_amt",
                "net_paid": "ss_net_paid",
                "net_paid_including_tax": "ss_net_paid_inc_tax",
                "net_profit": "ss_net_profit",
            }
        ),
        settle(m.discount_percent(list_price, sales_price)).alias("discount_percentage"),
        settle(m.percent(F.col("ss_net_profit"), revenue)).alias("profit_margin_percentage"),
        settle(m.per_unit(revenue, F.col("ss_quantity"))).alias("revenue_per_unit"),
        m.discount_band(list_price, sales_price).alias("discount_category"),
        *_renamed(
            {
                "source_timestamp": "ingestion_timestamp",
            }
        ),
    )


SOLD_PERIOD = ("sold_year", "sold_month")


def with_sold_period(fact: DataFrame) -> DataFrame:
    """The fact with the year and month of its date key (yyyymmdd), to be partitioned by."""
    day = F.col("sold_date_key")
    return fact.withColumns({"sold_year": F.expr("sold_date_key div 10000").cast("int"), "sold_month": F.floor(day / 100).cast("int") % 100})


def top_items_of_months(
    fact: DataFrame,
    date_dim: DataFrame,
    item_dim: DataFrame,
    months: Column,
    n: int = 10,
) -> DataFrame:
    """``top_items_month`` of the months for which a condition on ``date_dim`` holds.

    ``fact`` is stored with ``SOLD_PERIOD`` as its partition columns, and ``date_dim`` is stored as
    well. Year and month of the chosen days are part of the join, so Spark reads the partitions of
    those months only, whatever the condition is on; the days themselves settle the rest.
    """
    days = date_dim.where(months)
    period = F.expr("date_key div 10000").cast("int").alias("sold_year"), (F.expr("date_key div 100") % 100).cast("int").alias("sold_month")
    chosen = days.select(*period).distinct()
    # One row per month of a calendar, so it is small whatever the fact's size; pruning waits for it.
    return top_items_month(fact.join(F.broadcast(chosen), list(SOLD_PERIOD), "left_semi"), days, item_dim, n)


def item_reference(item_dim: DataFrame) -> Reference:
    """The keys of an ``item_dim``; made of a silver table, it has them once."""
    return Reference("item_key", item_dim, "item_key", "has_item", required=True)


def top_items_month(
    fact: DataFrame,
    date_dim: DataFrame,
    item_dim: DataFrame,
    n: int = 10,
    stamp: Column | None = None,
    items: Reference | None = None,
) -> DataFrame:
    """The ``n`` items of greatest revenue per month; ties go to quantity, then the smaller key.

    The fact is summed per month and item before the item attributes are joined, so the only
    shuffle of fact-sized input carries partial sums and a best-selling item is one row by then.
    ``items``, a reference to an ``item_dim`` of many keys that do not repeat, lets the attributes
    wait until the leaders are known. ``stamp`` adds an ``aggregation_timestamp``.
    """
    calendar = date_dim.select("date_key", "year", "month", "year_month")
    monthly = (
        fact.select("sold_date_key", "item_key", "quantity_sold", "total_sales_price", "net_profit")
        .join(calendar, F.col("sold_date_key") == F.col("date_key"))
        .groupBy("year", "month", "year_month", "item_key")
        .agg(
            F.sum("total_sales_price").alias("total_revenue"),
            F.sum("quantity_sold").alias("total_quantity_sold"),
            F.sum("net_profit").alias("total_profit"),
        )
    )
    attributes = item_dim.select("item_key", "item_id", "product_name", "category_name")
    leaders = top_n(
        monthly.join(attributes, "item_key") if items is None else keep_required(monthly, items),
        n,
        ("year", "month"),
        (
            F.col("total_revenue").desc_nulls_last(),
            F.col("total_quantity_sold").desc_nulls_last(),
            F.col("item_key").asc(),
        ),
        "revenue_rank",
    )
    if items is not None:
        # n rows per month of a calendar, whatever the fact's and the items' size.
        leaders = attributes.join(F.broadcast(leaders), "item_key")
    leaders = leaders.select(
        "year",
        "month",
        "year_month",
        "item_key",
        "item_id",
        "product_name",
        "category_name",
        "total_revenue",
        "total_quantity_sold",
        "total_profit",
        "revenue_rank",
    )
    return leaders if stamp is None else leaders.withColumn("aggregation_timestamp", stamp)
