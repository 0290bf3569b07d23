"""The registered queries over the test tables.

Builders return typed tables; ``_plain`` only renders decimals as doubles and dates as text, so
that other engines' results can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace
from datetime import date
from functools import cached_property, partial, reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oresmith.functions.aggregates import count_if, pct_null, row_count
from oresmith.functions.measures import seconds_to_minutes
from oresmith.functions.text import normalize_for_clones, trim_to_null, variant_label
from oresmith.operators import corpus, kpi
from oresmith.operators.distinct_counts import distinct_keys, key_bitmaps, merged
from oresmith.operators.keys import duplicate_row_count, latest_by_key
from oresmith.operators.near_duplicates import near_duplicates
from oresmith.operators.near_edits import near_edits
from oresmith.operators.references import counted, keep_optional, keep_required, orphans, reference_flags
from oresmith.plans import gold, silver
from oresmith.plans.bronze import SOURCES, bronze_ingest
from oresmith.plans.contracts import SALES, cast_failure_report
from oresmith.plans.layers import GOLD_TABLES, SILVER_TABLES, run_all
from oresmith.quality.enforce import expectation_report
from oresmith.quality.issues import issues
from oresmith.quality.metrics import (
    bronze_metrics,
    bronze_observability,
    gold_metrics,
    gold_observability,
    rule_scores,
    rule_status,
    table_profile,
)
from oresmith.rules.catalog import BRONZE_KEYS, GOLD_ISSUES, SILVER_ISSUES, catalog_frame, key_config_frame
from oresmith.rules.lineage import change_impact, column_impact
from oresmith.session import shared_folder, stored
from oresmith.sources.retail import retail_bronze, retail_sources
from oresmith.sources.tables import Buckets, TableSpace, TooFewRows, write_csv, write_sorted

AS_OF = date(2024, 1, 1)
SALES_TIES = ("ss_row_seq",)

# Patterns looked for in the documents.
LINE_PATTERNS = ("[0-9]{3}-[0-9]{4}", "[A-Z]{4,}", "token")
ID_PATTERNS = ("([0-9]{3}-[0-9]{4})", '"([0-9a-f]{40})"', "([A-Z]{4,})")

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
STATUSES = ("F", "O", "P")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _plain(df: DataFrame) -> DataFrame:
    columns = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            column = column.cast("string")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def _query(function: Query, name: str | None = None) -> Query:
    """Register a query under its function's name, or another where a builder has that name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _plain(function(spark, folder))

    run.__name__ = name or function.__name__
    run.__doc__ = function.__doc__
    QUERIES[run.__name__] = run
    return run


def _query_as(name: str) -> Callable[[Query], Query]:
    return lambda function: _query(function, name)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


class Tables(dict):
    """Tables by name, each built when it is first asked for."""

    def __init__(self, names: Iterable[str], build: Callable[[str], DataFrame]):
        super().__init__()
        self._names, self._build = tuple(names), build

    def __missing__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise KeyError(name)
        self[name] = self._build(name)
        return self[name]

    def all(self) -> dict[str, DataFrame]:
        return {name: self[name] for name in self._names}


DIMENSIONS = ("silver_date_dim", "silver_item", "silver_store", "silver_customer")

# What several branches of one query are built on. Gold tables are projections of silver ones, of
# which a branch reads the columns it needs; the fact is staged where more than one branch reads it.
STAGED = SILVER_TABLES
ANNOTATED = "annotated_sales"


class Star:
    """Bronze, silver and gold frames over one folder, built on first use.

    ``enforced=False`` leaves the row rules out, so the issue queries have something to find.
    ``staged`` names tables that are stored when first asked for, as a layer run stores them, so
    that what is built on them several times reads them instead of deriving them again.
    """

    def __init__(self, spark: SparkSession, folder: str, enforced: bool = True, staged: Iterable[str] = ()):
        self.spark, self.folder, self.enforced = spark, folder, enforced
        self._staged, self._place = frozenset(staged), None
        self._bronze = Tables(SOURCES, lambda name: self._kept(name, retail_bronze(spark, folder, name)))
        self._silver = Tables(SILVER_TABLES, lambda name: self._kept(name, self._build_silver(name)))
        self._gold = Tables(GOLD_TABLES, lambda name: self._kept(name, self._build_gold(name)))

    def _kept(self, name: str, table: DataFrame) -> DataFrame:
        if name not in self._staged:
            return table
        self._place = self._place or shared_folder(self.spark, "star")
        return stored(table, self._place, name)

    def bronze_table(self, name: str) -> DataFrame:
        return self._bronze[name]

    def silver_table(self, name: str) -> DataFrame:
        return self._silver[name]

    def gold_table(self, name: str) -> DataFrame:
        return self._gold[name]

    @property
    def bronze(self) -> dict[str, DataFrame]:
        return self._bronze.all()

    @property
    def silver(self) -> dict[str, DataFrame]:
        return self._silver.all()

    @property
    def gold(self) -> dict[str, DataFrame]:
        return self._gold.all()

    @property
    def dims(self) -> dict[str, DataFrame]:
        return {name: self._silver[name] for name in DIMENSIONS}

    @property
    def sales(self) -> DataFrame:
        return self._silver["silver_store_sales"]

    def _build_silver(self, name: str) -> DataFrame:
        if name == "silver_store_sales":
            if ANNOTATED in self._staged and not self.enforced:
                return silver.resolved_sales(self.annotated, self.references)
            bronze = self._bronze["bronze_store_sales"]
            return silver.silver_sales(bronze, self.references, SALES_TIES, enforced=self.enforced)
        bronze = self._bronze[name.replace("silver_", "bronze_", 1)]
        # Loads of one key differ in time, so the load time alone decides.
        return silver.BUILDERS[name](bronze, tie_break=(), enforced=self.enforced)

    def _build_gold(self, name: str) -> DataFrame:
        if name == "gold_top_items_month":
            days, items = self._gold["gold_dim_date"], self._gold["gold_dim_item"]
            # Gold items are the silver ones, whose keys are counted where they are stored and many.
            words = self.references[1].words
            known = None if words is None else replace(gold.item_reference(items), words=words)
            return gold.top_items_month(self._gold["gold_fact_store_sales"], days, items, items=known)
        source, build = {
            "gold_dim_date": ("silver_date_dim", gold.gold_date),
            "gold_dim_item": ("silver_item", gold.gold_item),
            "gold_dim_store": ("silver_store", gold.gold_store),
            "gold_dim_customer": ("silver_customer", partial(gold.gold_customer, as_of=AS_OF)),
            "gold_fact_store_sales": ("silver_store_sales", gold.gold_sales),
        }[name]
        return build(self._silver[source])

    @cached_property
    def references(self) -> list:
        found = silver.sales_references(*[self._silver[n] for n in DIMENSIONS])
        return counted(found) if self._staged.issuperset(DIMENSIONS) else found

    @cached_property
    def annotated(self) -> DataFrame:
        flagged = silver.annotated_sales(self._bronze["bronze_store_sales"], self.references, SALES_TIES)
        return self._kept(ANNOTATED, flagged)

    @property
    def typed_sales(self) -> DataFrame:
        """The raw fact in silver types, duplicates included."""
        return SALES.project(self._bronze["bronze_store_sales"])


# --- ingest, casts, keys -------------------------------------------------------------------


@_query_as("bronze_ingest")
def bronze_ingest_rows(spark: SparkSession, folder: str) -> DataFrame:
    return bronze_ingest(_table(spark, folder, "lineitem"), "lineitem").drop("ingestion_timestamp")


@_query
def cast_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Prices that do not fit decimal(7,2) become NULL."""
    price = F.col("l_extendedprice").try_cast("decimal(7,2)")
    return _table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").try_cast("int").alias("quantity"),
        price.alias("extended_price"),
        (F.col("l_extendedprice").isNotNull() & price.isNull()).alias("cast_failed"),
        F.col("l_shipdate").try_cast("date").alias("ship_date"),
    )


@_query
def cast_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Failed casts per money column when the fact's totals are scaled up by ten."""
    raw = Star(spark, folder).bronze_table("bronze_store_sales")
    return SALES.cast_failures(raw.withColumn("ss_net_paid", F.col("ss_net_paid") * 10)).select(
        "ss_net_paid", "ss_ext_list_price", "ss_quantity"
    )


@_query
def cast_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """Fact rows rejected for lost values: totals times ten, and some keys beyond their types."""
    star = Star(spark, folder)
    raw = star.bronze_table("bronze_store_sales").withColumns(
        {
            "ss_net_paid": F.col("ss_net_paid") * 10,
            "ss_customer_sk": F.when(F.col("ss_ticket_number") % 50 == 0, F.lit(3_000_000_000) + F.col("ss_customer_sk"))
            .otherwise(F.col("ss_customer_sk"))
        }
    )
    annotated = silver.annotated_sales(raw, star.references, SALES_TIES)
    lost = silver.sales_quarantine(annotated).where("issue_reason = 'CAST_FAILED'")
    return lost.select("key_1", "key_2", "rule_id", "issue_reason", "cast_failed")


@_query
def cast_failure_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Values that do not fit, per column of every bronze table."""
    return cast_failure_report(Star(spark, folder).bronze)


@_query_as("trim_to_null")
def trim_to_null_rows(spark: SparkSession, folder: str) -> DataFrame:
    padded = F.when(F.col("c_custkey") % 7 == 0, F.lit("   ")).otherwise(
        F.concat(F.lit("  "), F.col("c_name"), F.lit(" "))
    )
    return _table(spark, folder, "customer").select(
        "c_custkey", trim_to_null(padded).alias("clean_name"), F.trim(padded).alias("trimmed_name")
    )


@_query_as("latest_by_key")
def latest_by_key_rows(spark: SparkSession, folder: str) -> DataFrame:
    return latest_by_key(
        _table(spark, folder, "lineitem"),
        ["l_orderkey", "l_partkey"],
        "l_shipdate",
        ["l_linenumber", "l_suppkey"],
    )


@_query_as("replicate")
def replicate_rows(spark: SparkSession, folder: str) -> DataFrame:
    return kpi.replicate(_table(spark, folder, "lineitem"), 2).select(
        "l_orderkey", "l_linenumber", "l_partkey", "scale_factor_copy"
    )


@_query
def replicate_offset(spark: SparkSession, folder: str) -> DataFrame:
    """Copies with shifted keys survive deduplication."""
    orders = _table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return kpi.replicate(orders, 3, {"o_orderkey": F.lit(10_000_000_000)})


# --- silver --------------------------------------------------------------------------------


@_query
def silver_date(spark: SparkSession, folder: str) -> DataFrame:
    return Star(spark, folder).silver_table("silver_date_dim")


@_query
def silver_item(spark: SparkSession, folder: str) -> DataFrame:
    return Star(spark, folder).silver_table("silver_item")


@_query
def silver_item_validate_first(spark: SparkSession, folder: str) -> DataFrame:
    """An older good version stands in where the latest one is bad."""
    bronze = Star(spark, folder).bronze_table("bronze_item")
    return silver.silver_item(bronze, tie_break=(), validate_first=True)


@_query
def silver_store(spark: SparkSession, folder: str) -> DataFrame:
    return Star(spark, folder).silver_table("silver_store")


@_query
def silver_customer(spark: SparkSession, folder: str) -> DataFrame:
    return Star(spark, folder).silver_table("silver_customer")


@_query
def silver_sales(spark: SparkSession, folder: str) -> DataFrame:
    return Star(spark, folder).sales


@_query
def silver_sales_split(spark: SparkSession, folder: str) -> DataFrame:
    """The silver fact taken from the annotated fact; equal to the direct one."""
    return silver.kept_sales(Star(spark, folder).annotated)


# --- references ----------------------------------------------------------------------------

_FK_COLUMNS = ("ss_ticket_number", "ss_item_sk", "ss_sold_time_sk", "ss_customer_sk", "ss_store_sk")


@_query
def fk_semi(spark: SparkSession, folder: str) -> DataFrame:
    star = Star(spark, folder)
    return keep_required(star.typed_sales, star.references[1]).select(*_FK_COLUMNS)


@_query
def fk_optional(spark: SparkSession, folder: str) -> DataFrame:
    star = Star(spark, folder)
    return keep_optional(star.typed_sales, star.references[3]).select(*_FK_COLUMNS)


@_query
def fk_orphans(spark: SparkSession, folder: str) -> DataFrame:
    star = Star(spark, folder)
    return orphans(star.typed_sales, star.references[2]).select(*_FK_COLUMNS)


@_query
def fk_flags(spark: SparkSession, folder: str) -> DataFrame:
    star = Star(spark, folder)
    flags = [r.flag for r in star.references]
    return reference_flags(star.typed_sales, star.references).select(*_FK_COLUMNS, *flags)


# --- gold ----------------------------------------------------------------------------------


@_query
def gold_date(spark: SparkSession, folder: str) -> DataFrame:
    return Star(spark, folder).gold_table("gold_dim_date")


@_query
def gold_item(spark: SparkSession, folder: str) -> DataFrame:
    return Star(spark, folder).gold_table("gold_dim_item")


@_query
def gold_store(spark: SparkSession, folder: str) -> DataFrame:
    return Star(spark, folder).gold_table("gold_dim_store")


@_query
def gold_customer(spark: SparkSession, folder: str) -> DataFrame:
    return Star(spark, folder).gold_table("gold_dim_customer")


@_query
def gold_sales(spark: SparkSession, folder: str) -> DataFrame:
    return Star(spark, folder).gold_table("gold_fact_store_sales")


@_query
def gold_sales_null_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Undefined ratios stay NULL; taken over the unenforced fact, where they occur."""
    return gold.gold_sales(Star(spark, folder, enforced=False).sales, null_ratio="null")


@_query
def top_items_month(spark: SparkSession, folder: str) -> DataFrame:
    return Star(spark, folder).gold_table("gold_top_items_month")


# --- quality -------------------------------------------------------------------------------


@_query
def monitor_counts(spark: SparkSession, folder: str) -> DataFrame:
    return expectation_report(Star(spark, folder).dims, "monitor")


@_query
def expectation_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every expectation counted on the tables before enforcement."""
    return expectation_report(Star(spark, folder, enforced=False, staged=DIMENSIONS).silver)


@_query
def dup_rows(spark: SparkSession, folder: str) -> DataFrame:
    return duplicate_row_count(_table(spark, folder, "lineitem"), ["l_orderkey", "l_partkey"])


@_query
def null_pct(spark: SparkSession, folder: str) -> DataFrame:
    sales = Star(spark, folder).bronze_table("bronze_store_sales")
    columns = ("ss_item_sk", "ss_store_sk", "ss_customer_sk", "ss_promo_sk", "ss_quantity")
    return sales.agg(
        row_count().alias("row_count"),
        *[count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns],
        *[pct_null(F.col(c)).alias(f"{c}_pct") for c in columns],
    )


@_query_as("bronze_metrics")
def bronze_table_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return bronze_metrics(Star(spark, folder).bronze).drop("observed_at")


@_query_as("bronze_observability")
def bronze_rule_observability(spark: SparkSession, folder: str) -> DataFrame:
    metrics = bronze_metrics(Star(spark, folder).bronze).drop("observed_at")
    return bronze_observability(metrics, catalog_frame(spark))


@_query
def rule_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """The catalog with the rows each rule governs."""
    star = Star(spark, folder, staged=STAGED)
    counts = kpi.row_counts({**star.bronze, **star.silver, **star.gold})
    return catalog_frame(spark).join(counts, "object_name", "left")


@_query
def dimension_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Dimension rows that the rules drop, with the rules they break."""
    star = Star(spark, folder)
    frames = [
        silver.dimension_rejects(n, silver.latest_dimension(n, star.bronze_table(n.replace("silver_", "bronze_", 1)), ()))
        for n in DIMENSIONS
    ]
    return reduce(DataFrame.unionByName, frames)


@_query
def silver_issues(spark: SparkSession, folder: str) -> DataFrame:
    return issues(Star(spark, folder, enforced=False, staged=DIMENSIONS).silver, SILVER_ISSUES).drop("observed_at")


@_query
def gold_issues(spark: SparkSession, folder: str) -> DataFrame:
    return issues(Star(spark, folder, enforced=False, staged=STAGED).gold, GOLD_ISSUES).drop("observed_at")


@_query
def sales_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    return silver.sales_quarantine(Star(spark, folder).annotated).drop("observed_at")


@_query_as("rule_status")
def silver_rule_status(spark: SparkSession, folder: str) -> DataFrame:
    return rule_status(Star(spark, folder, enforced=False, staged=DIMENSIONS).silver).drop("observed_at")


@_query_as("rule_scores")
def all_rule_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every catalog rule of all layers and kinds, with the rows that break it before enforcement."""
    star = Star(spark, folder, enforced=False, staged=(*DIMENSIONS, ANNOTATED))
    tables = {**star.bronze, **star.silver, **star.gold}
    # The enforced fact references resolve; what does not shows in the fact before that.
    tables["silver_store_sales"] = star.annotated
    return rule_scores(tables, star.references).drop("observed_at")


@_query_as("gold_metrics")
def gold_table_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return gold_metrics(Star(spark, folder, enforced=False, staged=STAGED).gold).drop("observed_at")


@_query_as("gold_observability")
def gold_rule_observability(spark: SparkSession, folder: str) -> DataFrame:
    metrics = gold_metrics(Star(spark, folder, enforced=False, staged=STAGED).gold).drop("observed_at")
    return gold_observability(metrics, catalog_frame(spark))


# --- sinks ---------------------------------------------------------------------------------


def _space(spark: SparkSession, purpose: str) -> TableSpace:
    folder = shared_folder(spark, purpose)
    return TableSpace(spark, folder.rsplit("/", 1)[1].replace("-", "_")).create(folder)


def _view_name(purpose: str) -> str:
    """A name of its own for every call, so two of them in one session do not meet."""
    return f"{purpose}_{uuid4().hex}"


def _settled(space: TableSpace, result: DataFrame) -> DataFrame:
    """A result of a few rows, taken before the tables behind it are dropped."""
    rows = result.collect()
    space.drop()
    return space.spark.createDataFrame(rows, result.schema)


@_query
def write_verify(spark: SparkSession, folder: str) -> DataFrame:
    """Store two gold tables and count what was stored."""
    star, space = Star(spark, folder), _space(spark, "verify")
    for name in ("gold_dim_item", "gold_dim_customer"):
        space.write(star.gold_table(name), name, f"{name} of one run")
    return _settled(space, kpi.row_counts({name: space.read(name) for name in space.tables()}))


@_query
def schema_reset(spark: SparkSession, folder: str) -> DataFrame:
    """Drop tables by prefix and count the rows of what is left."""
    space = _space(spark, "reset")
    orders = _table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    for name in ("i_orders", "d_orders", "keep_orders"):
        space.write(orders, name)
    space.reset(["i_", "d_"])
    return _settled(space, kpi.row_counts({name: space.read(name) for name in space.tables()}))


@_query
def overwrite_keeps_schema(spark: SparkSession, folder: str) -> DataFrame:
    """A second load of other types and other rows in a table whose columns stay as they are."""
    space, orders = _space(spark, "overwrite"), _table(spark, folder, "orders")
    first = orders.select("o_orderpriority", F.col("o_totalprice").cast("decimal(12,2)").alias("price"))
    space.write(first.where("price < 0"), "order_prices")
    second = orders.select("o_orderpriority", F.col("o_totalprice").cast("int").alias("price"))
    space.write(second, "order_prices", replace_schema=False)
    kept = space.read("order_prices").groupBy("o_orderpriority").agg(row_count().alias("orders"), F.sum("price").alias("price"))
    return _settled(space, kept)


@_query
def failed_load_keeps_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What readers see after a good load, a load that breaks half way, one that comes up short,
    and a good one with other columns."""
    space, orders = _space(spark, "loads"), _table(spark, folder, "orders")
    prices = orders.select("o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("decimal(12,2)").alias("price"))

    def seen(step: str) -> DataFrame:
        price = F.sum("price").alias("price")
        state = space.read("order_prices").groupBy("o_orderpriority").agg(row_count().alias("orders"), price)
        return spark.createDataFrame([(step, *r) for r in state.collect()], ["step", *state.columns])

    space.write(prices.where("o_orderpriority <> '5-LOW'"), "order_prices", least_rows=1)
    states = [seen("loaded")]
    breaking = F.when(F.col("o_orderkey") % 100 == 99, F.raise_error(F.lit("broken row"))).otherwise(F.col("price"))
    try:
        space.write(prices.withColumn("price", breaking.cast("decimal(12,2)")), "order_prices")
    except Exception as error:
        if "broken row" not in str(error):
            raise
        states.append(seen("load broke"))
    try:
        space.write(prices.where("price < 0"), "order_prices", least_rows=1)
    except TooFewRows:
        states.append(seen("load too small"))
    space.write(prices.withColumn("price", F.col("price") * 2).drop("o_orderkey"), "order_prices")
    states.append(seen("loaded again"))
    return _settled(space, reduce(DataFrame.unionByName, states))


@_query
def bucketed_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Latest rows, repeated keys and the profile of the raw fact, stored in buckets of its key."""
    space = _space(spark, "buckets")
    fact = Star(spark, folder).bronze_table("bronze_store_sales")
    space.write(fact, "bronze_store_sales", buckets=Buckets(8, SALES.key))
    return _settled(space, bucketed_report(space.read("bronze_store_sales")))


def bucketed_report(fact: DataFrame) -> DataFrame:
    """One row about the raw fact; where it lies in buckets of its key, no row is shuffled for it."""
    latest = latest_by_key(fact, SALES.key, tie_break=SALES_TIES)
    latest = latest.agg(row_count().alias("latest_rows"), F.sum("ss_quantity").cast("bigint").alias("latest_quantity"))
    repeated = duplicate_row_count(fact, SALES.key)
    profile = table_profile(fact, "bronze_store_sales", "RAW_MODEL", BRONZE_KEYS["bronze_store_sales"])
    # Three single rows side by side.
    return latest.crossJoin(repeated.withColumnRenamed("duplicate_row_count", "repeated_keys")).crossJoin(
        profile.select("row_count", "null_key_3_count", "null_key_4_count", "duplicate_row_count")
    )


MART_MONTHS = "year = 1997 AND month BETWEEN 3 AND 5"


@_query_as("top_items_of_months")
def top_items_of_some_months(spark: SparkSession, folder: str) -> DataFrame:
    """The monthly leaders of three months, over the fact stored by year and month."""
    star, space = Star(spark, folder), _space(spark, "periods")
    fact = gold.with_sold_period(star.gold_table("gold_fact_store_sales"))
    space.write(fact, "gold_fact_store_sales", partition_by=gold.SOLD_PERIOD)
    for name in ("gold_dim_date", "gold_dim_item"):
        space.write(star.gold_table(name), name)
    fact, days, items = (space.read(t) for t in ("gold_fact_store_sales", "gold_dim_date", "gold_dim_item"))
    return _settled(space, gold.top_items_of_months(fact, days, items, F.expr(MART_MONTHS)))


@_query_as("change_impact")
def impact_of_changes(spark: SparkSession, folder: str) -> DataFrame:
    """What a change of each table reaches, by the edges that a run of all layers recorded."""
    space = _space(spark, "impact")
    counts = run_all(space, retail_sources(spark, folder), "loaded_at", {"bronze_store_sales": SALES_TIES}, AS_OF)
    known = [(n, counts[n]) for n in (*SOURCES, *SILVER_TABLES, *GOLD_TABLES)]
    counted = spark.createDataFrame(known, "object_name string, row_count bigint")
    return _settled(space, change_impact(space.edges(), catalog_frame(spark), counted))


@_query_as("column_impact")
def impact_of_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Per column that a rule names: its rules and rows, and what lies behind its table."""
    space, star = _space(spark, "columns"), Star(spark, folder)
    run_all(space, retail_sources(spark, folder), "loaded_at", {"bronze_store_sales": SALES_TIES}, AS_OF)
    names = (*SOURCES, *SILVER_TABLES, *GOLD_TABLES)
    counts = kpi.row_counts({n: space.read(n) for n in names})
    return _settled(space, column_impact(space.edges(), catalog_frame(spark)).join(counts, "object_name"))


@_query
def view_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """A dataset that is only named: orders per status through a view."""
    space, name = TableSpace(spark, "default"), _view_name("orders")
    space.view(_table(spark, folder, "orders").select("o_orderstatus", "o_custkey"), name)
    return spark.sql(
        f"SELECT o_orderstatus, count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM {name} GROUP BY o_orderstatus"
    )


@_query
def publish_view(spark: SparkSession, folder: str) -> DataFrame:
    """A view stored as a table, with the row count that publishing returns."""
    space = _space(spark, "publish")
    customers = _table(spark, folder, "customer").groupBy("c_nationkey").agg(row_count().alias("customers"))
    count = space.publish(space.view(customers, _view_name("customers")), "customers_by_nation", "Customers per nation")
    return _settled(space, space.read("customers_by_nation").withColumn("published_rows", F.lit(count).cast("bigint")))


@_query
def layer_run(spark: SparkSession, folder: str) -> DataFrame:
    """All layers stored in one run: the rows of every bronze, silver and gold table."""
    space = _space(spark, "layers")
    counts = run_all(space, retail_sources(spark, folder), "loaded_at", {"bronze_store_sales": SALES_TIES}, AS_OF)
    names = (*SOURCES, *SILVER_TABLES, *GOLD_TABLES)
    rows = spark.createDataFrame([(n, counts[n]) for n in names], "object_name string, row_count bigint")
    return _settled(space, rows)


@_query
def key_config(spark: SparkSession, folder: str) -> DataFrame:
    """Key columns of every bronze table and the rows and distinct keys behind them."""
    star, frames = Star(spark, folder), []
    for name, keys in BRONZE_KEYS.items():
        per_key = star.bronze_table(name).groupBy(*keys).agg(row_count().alias("n"))
        frames.append(
            per_key.agg(F.sum("n").alias("row_count"), row_count().alias("distinct_keys")).select(
                F.lit(name).alias("object_name"), "row_count", "distinct_keys"
            )
        )
    config = key_config_frame(spark).withColumn("key_cols", F.array_join("key_cols", ", "))
    return config.join(reduce(DataFrame.unionByName, frames), "object_name")


@_query
def csv_summary(spark: SparkSession, folder: str) -> DataFrame:
    """A small summary written as CSV with a header and read back."""
    target = shared_folder(spark, "csv")
    shares = kpi.share_of_total(
        _table(spark, folder, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(18,2)")),
        ["o_orderpriority"],
        "price",
        F.col("o_orderstatus") == "F",
        "o_custkey",
    )
    write_csv(shares.select("o_orderpriority", "num_members", "num_subset_members"), target, single_file=True)
    schema = "o_orderpriority string, num_members bigint, num_subset_members bigint"
    return spark.read.schema(schema).option("header", True).csv(target)


@_query
def ordered_export(spark: SparkSession, folder: str) -> DataFrame:
    """Orders written in one order over all files: rows, first and last key, and places out of order."""
    target = shared_folder(spark, "ordered")
    orders = _table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    back = write_sorted(orders, target, ["o_custkey", "o_orderkey"], "csv")
    key = F.struct("o_custkey", "o_orderkey")
    rows = back.select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("place"), key.alias("key"))
    in_file = Window.partitionBy("file").orderBy("place")
    steps = rows.withColumn("wrong", F.lag("key").over(in_file) > F.col("key"))
    files = steps.groupBy("file").agg(
        row_count().alias("rows"), F.count_if("wrong").alias("wrong"), F.min("key").alias("first"), F.max("key").alias("last")
    )
    # One row per file from here on.
    files = files.withColumn("before", F.lag("last").over(Window.orderBy("file")))
    return files.agg(
        F.sum("rows").alias("row_count"),
        F.min("first.o_custkey").alias("first_customer"),
        F.max("last.o_custkey").alias("last_customer"),
        (F.sum("wrong") + F.count_if(F.col("before") > F.col("first"))).alias("out_of_order"),
    )


# --- indicators ----------------------------------------------------------------------------


def _priced_orders(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(18,2)"))


@_query
def group_means(spark: SparkSession, folder: str) -> DataFrame:
    lines = _table(spark, folder, "lineitem").select(
        "l_returnflag",
        "l_linestatus",
        F.col("l_quantity").cast("decimal(12,2)").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("price"),
        F.col("l_discount").cast("decimal(12,2)").alias("discount"),
        F.col("l_tax").cast("decimal(12,2)").alias("tax"),
        "l_linenumber",
    )
    measures = {
        "avg_quantity": "quantity",
        "avg_price": "price",
        "avg_discount": "discount",
        "avg_tax": "tax",
        "avg_linenumber": "l_linenumber",
    }
    return kpi.group_means(lines, ["l_returnflag"], measures, F.col("l_linestatus") == "O")


@_query
def share_of_total(spark: SparkSession, folder: str) -> DataFrame:
    return kpi.share_of_total(
        _priced_orders(spark, folder), ["o_orderpriority"], "price", F.col("o_orderstatus") == "F", "o_custkey"
    )


@_query
def share_of_total_by_layer(spark: SparkSession, folder: str) -> DataFrame:
    """The same share one level deeper, by priority and year."""
    orders = _priced_orders(spark, folder).withColumn("year", F.year("o_orderdate"))
    return kpi.share_of_total(
        orders, ["o_orderpriority", "year"], "price", F.col("o_orderstatus") == "F", "o_custkey"
    )


@_query
def reuse_kpi(spark: SparkSession, folder: str) -> DataFrame:
    return kpi.reuse(_table(spark, folder, "lineitem"), ["l_returnflag"], "l_partkey")


@_query
def left_fill(spark: SparkSession, folder: str) -> DataFrame:
    customers = _table(spark, folder, "customer").select(F.col("c_custkey").alias("custkey"), "c_name")
    urgent = _table(spark, folder, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    counts = urgent.groupBy(F.col("o_custkey").alias("custkey")).agg(row_count().alias("urgent_orders"))
    return kpi.left_fill(customers, counts, ["custkey"], {"urgent_orders": 0})


@_query
def pivot_share(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each priority's order value per status, in the fixed priority order."""
    orders = _priced_orders(spark, folder)
    per_status = orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.sum("price").alias("value"))
    return kpi.pivot_labels(
        per_status, "o_orderpriority", "o_orderstatus", STATUSES, "value", PRIORITIES
    )


@_query
def change_per_doubling(spark: SparkSession, folder: str) -> DataFrame:
    """What doubling the rows by plain copies does: row and price totals double, keys do not."""
    lines = _table(spark, folder, "lineitem").select(
        "l_returnflag", "l_orderkey", "l_partkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("price")
    )
    # The first copy belongs to both scales, so one pass over the input gives both.
    both, doubled = F.array(F.lit("1x"), F.lit("2x")), F.array(F.lit("2x"))
    copies = kpi.replicate(lines, 2).withColumn(
        "scale", F.explode(F.when(F.col("scale_factor_copy") == 1, both).otherwise(doubled))
    )
    per_key = copies.groupBy("scale", "l_returnflag", "l_orderkey", "l_partkey")
    scales = per_key.agg(row_count().alias("rows"), F.sum("price").alias("price"))
    measures = {"rows": F.col("rows"), "price": F.col("price"), "keys": F.lit(1)}
    return kpi.change_between(scales, ["l_returnflag"], "scale", "1x", "2x", measures)


@_query
def change_between_years(spark: SparkSession, folder: str) -> DataFrame:
    orders = _priced_orders(spark, folder).withColumn("year", F.year("o_orderdate"))
    measures = {"orders": F.lit(1), "price": F.col("price")}
    return kpi.change_between(orders, ["o_orderpriority"], "year", 1998, 1999, measures)


@_query
def growth_by_scale(spark: SparkSession, folder: str) -> DataFrame:
    """How orders, their value and their customers grow with the years that are loaded."""
    orders = _priced_orders(spark, folder)
    first = orders.agg(F.min(F.year("o_orderdate")).alias("first"), F.max(F.year("o_orderdate")).alias("last"))
    # An order belongs to all scales from its year on.
    dated = orders.select("o_custkey", "price", F.year("o_orderdate").alias("year")).crossJoin(F.broadcast(first))
    scales = F.sequence(F.col("year") - F.col("first") + 1, F.col("last") - F.col("first") + 1)
    loaded = dated.select("o_custkey", "price", F.explode(scales).alias("years"))
    per_customer = loaded.groupBy("years", "o_custkey").agg(row_count().alias("orders"), F.sum("price").alias("price"))
    per_scale = per_customer.groupBy("years").agg(
        F.sum("orders").alias("orders"), F.sum("price").alias("price"), row_count().alias("customers")
    )
    grown = kpi.growth(per_scale, [], "years", ["orders", "price", "customers"])
    return grown.withColumn("growth_exponent", F.round("growth_exponent", 9))


@_query
def distinct_keys_of_loads(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with orders up to each year, per priority, from one load per year.

    A load is read once; what is kept of it are the bitmaps of its keys.
    """
    place = shared_folder(spark, "loads")
    orders = _table(spark, folder, "orders").withColumn("year", F.year("o_orderdate"))
    years = [r.year for r in orders.select("year").distinct().orderBy("year").collect()]
    known, counts = None, []
    for year in years:
        load = key_bitmaps(orders.where(F.col("year") == year), "o_custkey", ["o_orderpriority"])
        known = stored(load if known is None else merged(known, load), place, f"known-{year}")
        counts.append(distinct_keys(known).withColumn("year", F.lit(year)))
    return reduce(DataFrame.unionByName, counts)


@_query
def rule_impact(spark: SparkSession, folder: str) -> DataFrame:
    star = Star(spark, folder)
    tables = {
        **star.bronze,
        "silver_date_dim": star.silver_table("silver_date_dim"),
        "silver_customer": star.silver_table("silver_customer"),
        "gold_dim_customer": star.gold_table("gold_dim_customer"),
    }
    return kpi.rule_impact(catalog_frame(spark), kpi.row_counts(tables))


# --- text ----------------------------------------------------------------------------------


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "documents")


@_query
def corpus_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts stored as text files of a few documents each and read back, per source."""
    place = shared_folder(spark, "corpus")
    writer = _documents(spark, folder).select("source", "text").write.partitionBy("source")
    writer.option("maxRecordsPerFile", 100).text(place)
    files = corpus.with_path_labels(corpus.text_files(spark, place, ".txt"))
    source = F.regexp_extract("path", "/source=([^/]+)/", 1)
    return files.groupBy(source.alias("source"), "layer", "is_data_quality").agg(
        F.sum(F.char_length("text")).alias("characters"),
        F.sum(F.size(corpus.code_lines(F.col("text")))).alias("code_lines"),
    )


@_query
def corpus_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of a source as one file, read back by block: lines, code lines, hits, identifiers."""
    place, setting = shared_folder(spark, "blocks"), "spark.sql.files.maxPartitionBytes"
    texts = _documents(spark, folder).select("source", "text").repartition("source")
    texts.write.partitionBy("source").text(place)
    size = spark.conf.get(setting)
    spark.conf.set(setting, "64k")  # so that files of the test tables have several blocks, too
    try:
        counts = corpus.file_counts(corpus.text_lines(spark, place, ".txt"), LINE_PATTERNS, ID_PATTERNS)
        counts = stored(counts, place + "-counts", "files")
    finally:
        spark.conf.set(setting, size)
    source = F.regexp_extract("path", "/source=([^/]+)/", 1)
    sums = [F.sum(c).alias(c) for c in ("code_lines", "pattern_lines", "identifiers")]
    return counts.groupBy(source.alias("source")).agg(*sums)


@_query
def path_and_unit_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels read from a job path and a variant name made of each event, and its value in minutes."""
    events = _table(spark, folder, "events")
    number = F.col("event_id")
    directory = F.when(number % 3 == 0, "/jobs/data_quality/").otherwise("/jobs/")
    path = F.concat(directory, F.lit("0"), (number % 4).cast("string"), F.lit("_"), F.col("event_type"), F.lit(".py"))
    named = events.withColumn("path", path).withColumn(
        "written_as", F.when(number % 5 == 0, "Declared").otherwise(F.col("event_type"))
    )
    return corpus.with_path_labels(named).select(
        "event_id",
        "layer",
        "job",
        "is_data_quality",
        variant_label("written_as").alias("variant"),
        seconds_to_minutes(F.col("value")).alias("minutes"),
    )


@_query
def pattern_lines(spark: SparkSession, folder: str) -> DataFrame:
    counted = corpus.pattern_lines(_documents(spark, folder), "text", LINE_PATTERNS)
    return counted.select("doc_id", "source", "code_lines", "pattern_lines")


@_query
def extract_ids(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.identifier_counts(_documents(spark, folder), "doc_id", "text", ID_PATTERNS)


@_query
def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", normalize_for_clones("text").alias("normalized"))


@_query
def clone_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.clone_report(_documents(spark, folder), "text", "source")


@_query_as("near_duplicates")
def near_duplicate_docs(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_documents(spark, folder), "doc_id", "text", 0.8)


@_query_as("near_edits")
def near_edited_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose address at most a fifth of its characters tells from that of an earlier page."""
    return near_edits(_table(spark, folder, "pages"), "page_id", "url", 0.8)


@_query
def kpi_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Shares, reuse, repeated blocks and the mean number of pattern lines per source."""
    docs = _documents(spark, folder)
    # The one pass over the texts for lines and identifiers; repeated blocks need their own shuffle.
    found = corpus.identifiers(F.col("text"), ID_PATTERNS).alias("identifiers")
    scanned = corpus.pattern_lines(docs, "text", LINE_PATTERNS).select(
        "source", "doc_id", "code_lines", "pattern_lines", found
    )
    lines = stored(scanned, shared_folder(spark, "summary"), "lines")
    share = kpi.share_of_total(lines, ["source"], "code_lines", F.col("pattern_lines") > 0, "doc_id")
    ids = lines.select("source", F.explode("identifiers").alias("identifier"))
    reused = kpi.reuse(ids, ["source"], "identifier")
    complexity = kpi.mean_where(
        lines, ["source"], "pattern_lines", F.col("pattern_lines") > 0, "avg_pattern_lines"
    )
    clones = corpus.clone_report(docs, "text", "source").select("source", "duplicated_blocks")
    counts = [c for c in (*reused.columns, *clones.columns) if c != "source"]
    combined = kpi.summary("source", share, reused, clones, complexity, zero=counts)
    ratio = F.coalesce(F.col("duplicated_blocks") / F.nullif(F.col("unique_items"), F.lit(0)), F.lit(0.0))
    return combined.withColumn("duplicate_block_ratio", ratio)

