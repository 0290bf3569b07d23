"""The retail source tables, derived from the order tables the repository is tested on.

Clean input cannot exercise data quality, so arithmetic on the keys puts missing and orphan
keys, bad quantities, prices and flags, padded and blank text and older item versions into it.
The statements are plain SQL; only the functions in ``Dialect`` differ between SQL engines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oresmith.plans.bronze import SOURCES, bronze_ingest


@dataclass(frozen=True)
class Dialect:
    """SQL fragments that are spelled differently; ``{}`` takes the argument."""

    day_name: str
    weekday: str
    days_since: str
    moment: str


SPARK = Dialect(
    day_name="date_format({}, 'EEEE')",
    weekday="(dayofweek({}) - 1)",
    days_since="datediff({}, DATE '1900-01-01')",
    moment="TIMESTAMP_NTZ '{}'",
)


def _day_key(day: str) -> str:
    return f"CAST(year({day}) * 10000 + month({day}) * 100 + day({day}) AS INT)"


def sales_sql(lineitem: str, orders: str, part: str) -> str:
    retail = "p_retail"
    return f"""
    SELECT l_orderkey AS ss_ticket_number,
           CASE WHEN l_orderkey % 89 = 0 THEN 2147483647 - l_partkey % 1000000 ELSE l_partkey END AS ss_item_sk,
           CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE l_suppkey END AS ss_store_sk,
           CASE WHEN l_orderkey % 83 = 0 THEN NULL ELSE o_custkey END AS ss_customer_sk,
           sold AS ss_sold_date_sk,
           l_linenumber * 3600 AS ss_sold_time_sk,
           o_custkey % 1000 AS ss_cdemo_sk,
           o_custkey % 100 AS ss_hdemo_sk,
           o_custkey AS ss_addr_sk,
           CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_partkey % 300 END AS ss_promo_sk,
           CAST(quantity AS INT) AS ss_quantity,
           cost AS ss_wholesale_cost,
           list_price AS ss_list_price,
           sales_price AS ss_sales_price,
           CAST((list_price - sales_price) * quantity AS DECIMAL(12,2)) AS ss_ext_discount_amt,
           CAST(sales_price * quantity AS DECIMAL(12,2)) AS ss_ext_sales_price,
           CAST(cost * quantity AS DECIMAL(12,2)) AS ss_ext_wholesale_cost,
           CAST(list_price * quantity AS DECIMAL(12,2)) AS ss_ext_list_price,
           CAST(CAST(sales_price * quantity AS DECIMAL(9,2)) * tax_rate AS DECIMAL(12,2)) AS ss_ext_tax,
           CAST(CASE WHEN l_orderkey % 11 = 0 THEN 5 ELSE 0 END AS DECIMAL(12,2)) AS ss_coupon_amt,
           CAST(sales_price * quantity AS DECIMAL(12,2)) AS ss_net_paid,
           CAST(CAST(sales_price * quantity AS DECIMAL(9,2)) * (1 + tax_rate) AS DECIMAL(12,2)) AS ss_net_paid_inc_tax,
           CAST((sales_price - cost) * quantity AS DECIMAL(12,2)) AS ss_net_profit,
           l_linenumber * CAST(1000000000 AS BIGINT) + l_suppkey AS ss_row_seq,
           l_shipdate AS loaded_at
    FROM (
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, o_custkey,
               {_day_key('o_orderdate')} AS sold,
               CASE WHEN (l_orderkey + l_partkey) % 101 = 0 THEN NULL
                    WHEN (l_orderkey + l_partkey) % 103 = 0 THEN CAST(0 AS DECIMAL(3,0))
                    ELSE CAST(CAST(l_quantity AS INT) AS DECIMAL(3,0)) END AS quantity,
               CAST(l_tax AS DECIMAL(4,2)) AS tax_rate,
               CASE WHEN l_partkey % 53 = 0 THEN CAST(0 AS DECIMAL(7,2)) ELSE {retail} END AS list_price,
               CAST({retail} * CASE WHEN l_orderkey % 107 = 0 THEN CAST(1.6 AS DECIMAL(6,2))
                                    WHEN l_orderkey % 109 = 0 THEN CAST(1.2 AS DECIMAL(6,2))
                                    ELSE CAST(1 - 6 * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(6,2))
                               END AS DECIMAL(7,2)) AS sales_price,
               CASE WHEN l_orderkey % 113 = 0 THEN CAST(-1 AS DECIMAL(7,2))
                    ELSE CAST({retail} * CAST(0.7 AS DECIMAL(2,1)) AS DECIMAL(7,2)) END AS cost
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
             JOIN (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(7,2)) AS p_retail FROM {part}) retail
             ON l_partkey = p_partkey
    ) priced
    """


def date_sql(orders: str, dialect: Dialect = SPARK) -> str:
    day_name = dialect.day_name.format("d")
    weekday = dialect.weekday.format("d")
    days = dialect.days_since.format("d")
    return f"""
    SELECT sk AS d_date_sk,
           'D' || CAST(sk AS STRING) AS d_date_id,
           d AS d_date,
           (y - 1900) * 12 + m - 1 AS d_month_seq,
           CAST(floor({days} / 7.0) AS INT) AS d_week_seq,
           (y - 1900) * 4 + q - 1 AS d_quarter_seq,
           y AS d_year, {weekday} AS d_dow, m AS d_moy, dom AS d_dom, q AS d_qoy,
           y AS d_fy_year, (y - 1900) * 4 + q - 1 AS d_fy_quarter_seq,
           CAST(floor({days} / 7.0) AS INT) AS d_fy_week_seq,
           '  ' || {day_name} || ' ' AS d_day_name,
           ' ' || CAST(y AS STRING) || 'Q' || CAST(q AS STRING) AS d_quarter_name,
           CASE WHEN dom = 1 THEN 'Y' WHEN dom = 2 THEN NULL ELSE 'N' END AS d_holiday,
           CASE WHEN {weekday} IN (0, 6) THEN 'Y' ELSE 'N' END AS d_weekend,
           CASE WHEN dom = 2 THEN 'Y' ELSE 'N' END AS d_following_holiday,
           y * 10000 + m * 100 + 1 AS d_first_dom,
           y * 10000 + m * 100 + day(last_day(d)) AS d_last_dom,
           sk - 10000 AS d_same_day_ly,
           CASE WHEN m > 3 THEN sk - 300 ELSE sk - 10000 + 900 END AS d_same_day_lq,
           CASE WHEN sk = 20010615 THEN 'Y' ELSE 'N' END AS d_current_day,
           CASE WHEN sk BETWEEN 20010611 AND 20010617 THEN 'Y' ELSE 'N' END AS d_current_week,
           CASE WHEN y = 2001 AND m = 6 THEN 'Y' ELSE 'N' END AS d_current_month,
           CASE WHEN y = 2001 AND q = 2 THEN 'Y' WHEN y = 2001 THEN NULL ELSE 'N' END AS d_current_quarter,
           CASE WHEN y = 2001 THEN 'Y' ELSE 'N' END AS d_current_year,
           {dialect.moment.format('2024-01-01 00:00:00')} AS loaded_at
    FROM (
        SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, {_day_key('o_orderdate')} AS sk,
               year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dom,
               quarter(o_orderdate) AS q
        FROM {orders} WHERE day(o_orderdate) <> 31
    ) days
    """


def item_sql(part: str, dialect: Dialect = SPARK) -> str:
    """Current items plus, for every tenth, a version of an earlier load at a good price."""
    bad_price = """CASE WHEN p_partkey % 61 = 0 THEN NULL
                WHEN p_partkey % 67 = 0 THEN CAST(-1 AS DECIMAL(12,2))
                ELSE price END"""
    columns = """
           p_partkey AS i_item_sk,
           'I' || CAST(p_partkey AS STRING) AS i_item_id,
           ' ' || p_name || '  ' AS i_item_desc,
           CASE WHEN p_partkey % 71 = 0 THEN CAST(-0.5 AS DECIMAL(12,2))
                ELSE CAST(price * CAST(0.7 AS DECIMAL(2,1)) AS DECIMAL(12,2)) END AS i_wholesale_cost,
           p_partkey % 25 AS i_brand_id, p_brand AS i_brand,
           p_partkey % 7 AS i_class_id, p_type AS i_class,
           p_size % 10 AS i_category_id, 'Category ' || CAST(p_size % 10 AS STRING) AS i_category,
           p_partkey % 40 AS i_manufact_id, 'Maker ' || CAST(p_partkey % 40 AS STRING) AS i_manufact,
           CAST(p_size AS STRING) AS i_size,
           CASE WHEN p_partkey % 2 = 1 THEN '   ' ELSE 'F' || CAST(p_partkey % 9 AS STRING) END AS i_formulation,
           CASE WHEN p_partkey % 3 = 0 THEN 'red' WHEN p_partkey % 3 = 1 THEN ' blue ' ELSE NULL END AS i_color,
           'Each' AS i_units, 'Box' AS i_container,
           p_partkey % 100 AS i_manager_id,
           CASE WHEN p_partkey % 41 = 0 THEN '  ' ELSE '  ' || p_name || ' ' END AS i_product_name"""
    factor = """CASE p_partkey % 4 WHEN 0 THEN CAST(0.005 AS DECIMAL(4,3)) WHEN 1 THEN CAST(0.03 AS DECIMAL(4,3))
                                   WHEN 2 THEN CAST(0.08 AS DECIMAL(4,3)) ELSE CAST(1 AS DECIMAL(4,3)) END"""
    priced = f"SELECT *, CAST(CAST(p_retailprice AS DECIMAL(7,2)) * {factor} AS DECIMAL(12,2)) AS price FROM {part}"
    return f"""
    SELECT {columns},
           {bad_price} AS i_current_price,
           DATE '2000-01-01' AS i_rec_start_date,
           CASE WHEN p_partkey % 29 = 0 THEN DATE '1999-01-01'
                WHEN p_partkey % 3 = 0 THEN DATE '2003-12-31' ELSE NULL END AS i_rec_end_date,
           {dialect.moment.format('2024-01-01 00:00:00')} AS loaded_at
    FROM ({priced}) current_items
    UNION ALL
    SELECT {columns},
           CAST(price + 1 AS DECIMAL(12,2)) AS i_current_price,
           DATE '1998-01-01' AS i_rec_start_date,
           DATE '1999-12-31' AS i_rec_end_date,
           {dialect.moment.format('2023-01-01 00:00:00')} AS loaded_at
    FROM ({priced}) older_items WHERE p_partkey % 10 = 0
    """


def store_sql(supplier: str, nation: str, region: str, dialect: Dialect = SPARK) -> str:
    return f"""
    SELECT s_suppkey AS s_store_sk,
           'S' || CAST(s_suppkey AS STRING) AS s_store_id,
           DATE '1997-03-13' AS s_rec_start_date,
           CASE WHEN s_suppkey % 7 = 3 THEN DATE '1996-03-13' WHEN s_suppkey % 7 = 5 THEN DATE '2001-03-12'
                ELSE NULL END AS s_rec_end_date,
           CASE WHEN s_suppkey % 13 = 4 THEN 19990101 ELSE NULL END AS s_closed_date_sk,
           CASE WHEN s_suppkey % 37 = 6 THEN '  ' ELSE ' ' || s_name || ' ' END AS s_store_name,
           CASE WHEN s_suppkey % 17 = 5 THEN NULL ELSE s_suppkey % 10 * 40 END AS s_number_employees,
           CASE WHEN s_suppkey % 31 = 8 THEN -1 ELSE 1000 + s_suppkey % 500 END AS s_floor_space,
           '8AM-8PM' AS s_hours,
           'Manager ' || CAST(s_suppkey % 20 AS STRING) AS s_manager,
           s_suppkey % 6 AS s_market_id,
           CASE WHEN s_suppkey % 2 = 0 THEN 'Unknown' ELSE '   ' END AS s_geography_class,
           'Market of ' || r_name AS s_market_desc,
           'Lead ' || CAST(s_suppkey % 6 AS STRING) AS s_market_manager,
           1 AS s_division_id, 'Unknown' AS s_division_name,
           1 AS s_company_id, 'Unknown' AS s_company_name,
           CAST(100 + s_suppkey % 900 AS STRING) AS s_street_number,
           CASE WHEN s_suppkey % 5 = 2 THEN NULL ELSE n_name END AS s_street_name,
           CASE WHEN s_suppkey % 3 = 0 THEN 'Ave' WHEN s_suppkey % 3 = 1 THEN ' ' ELSE 'Street' END AS s_street_type,
           CASE WHEN s_suppkey % 4 = 0 THEN 'Suite ' || CAST(s_suppkey % 80 AS STRING) ELSE NULL END
               AS s_suite_number,
           n_name AS s_city, n_name || ' County' AS s_county,
           CASE WHEN s_suppkey % 11 = 9 THEN NULL ELSE 'TN' END AS s_state,
           CAST(30000 + s_suppkey % 9999 AS STRING) AS s_zip,
           r_name AS s_country,
           CAST(0 - n_nationkey % 16 AS DECIMAL(12,2)) AS s_gmt_offset,
           CAST(s_suppkey % 12 AS DECIMAL(12,2)) * CAST(0.1 AS DECIMAL(2,1)) AS s_tax_precentage,
           {dialect.moment.format('2024-01-01 00:00:00')} AS loaded_at
    FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
    """


def customer_sql(customer: str, dialect: Dialect = SPARK) -> str:
    return f"""
    SELECT c_custkey AS c_customer_sk,
           'C' || CAST(c_custkey AS STRING) AS c_customer_id,
           c_custkey % 1000 AS c_current_cdemo_sk,
           c_custkey % 100 AS c_current_hdemo_sk,
           c_custkey AS c_current_addr_sk,
           19980101 + c_custkey % 28 AS c_first_shipto_date_sk,
           19980101 + c_custkey % 25 AS c_first_sales_date_sk,
           CASE WHEN c_custkey % 2 = 0 THEN 'Dr.' ELSE '  ' END AS c_salutation,
           ' ' || c_name AS c_first_name,
           'of ' || c_mktsegment AS c_last_name,
           CASE WHEN c_custkey % 3 = 0 THEN 'Y' WHEN c_custkey % 3 = 1 THEN 'N' ELSE NULL END
               AS c_preferred_cust_flag,
           1 + c_custkey % 28 AS c_birth_day,
           CASE WHEN c_custkey % 43 = 1 THEN 13 ELSE 1 + c_custkey % 12 END AS c_birth_month,
           CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE 1930 + c_custkey % 80 END AS c_birth_year,
           'Country ' || CAST(c_nationkey AS STRING) AS c_birth_country,
           '' AS c_login,
           CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE c_name || '@x.test' END AS c_email_address,
           20000101 + c_custkey % 28 AS c_last_review_date_sk,
           2400000 + c_custkey % 28 AS c_last_review_date,
           {dialect.moment.format('2024-01-01 00:00:00')} AS loaded_at
    FROM {customer}
    """


# Columns of the order tables the sources are derived from.
TABLE_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
}


def order_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the order tables; its schema is declared, so no file is opened to find it."""
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


_STATEMENTS = {
    "store_sales": (sales_sql, "lineitem orders part"),
    "date_dim": (date_sql, "orders"),
    "item": (item_sql, "part"),
    "store": (store_sql, "supplier nation region"),
    "customer": (customer_sql, "customer"),
}


def retail_source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A source table with a ``loaded_at`` column."""
    statement, inputs = _STATEMENTS[name]
    tables = {t: order_table(spark, folder, t) for t in inputs.split()}
    return spark.sql(statement(*["{" + t + "}" for t in tables]), **tables)


def retail_sources(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The five source tables by name."""
    return {name: retail_source(spark, folder, name) for name in _STATEMENTS}


def retail_bronze(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A bronze table over its source; ``loaded_at`` becomes the ingestion time."""
    source = SOURCES[name]
    rows = retail_source(spark, folder, source)
    return bronze_ingest(rows, source, F.col("loaded_at")).drop("loaded_at")
