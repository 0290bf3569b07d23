"""Shapes of physical plans that matter on large tables."""

import contextlib
import io
import re

import pytest

from oresmith.plans import gold, silver
from oresmith.plans.contracts import SALES
from oresmith.plans.queries import QUERIES, SALES_TIES, Star
from oresmith.quality.metrics import rule_status, table_profile

from conftest import SMALL


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fact_is_read_once_and_pruned(spark, star):
    plan = plan_of(star.sales)
    assert len(re.findall(r"FileScan parquet \[l_orderkey", plan)) == 1
    assert "l_extendedprice" not in plan and "o_totalprice" not in plan


def test_the_typed_fact_is_short_enough_to_be_compiled(spark):
    """The JVM leaves generated functions of more than 8,000 bytes uncompiled."""
    wider = {"int": "bigint", "decimal(7,2)": "decimal(12,2)"}
    raw = spark.range(1).selectExpr(*[f"CAST(id AS {wider.get(f.type, f.type)}) AS {f.name}" for f in SALES.fields])
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        SALES.checked(raw).explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown.getvalue())]
    assert sizes and max(sizes) < 8000


def test_fact_keys_are_limited_before_the_shuffle(star):
    assert "row_number(), 1, Partial" in plan_of(star.sales)


def test_mart_reads_four_fact_columns(spark, star, tmp_path):
    fact = star.gold["gold_fact_store_sales"]
    path = str(tmp_path / "fact")
    fact.write.parquet(path)
    stored = spark.read.parquet(path)
    mart = gold.top_items_month(stored, star.gold["gold_dim_date"], star.gold["gold_dim_item"])
    scan = [s for s in mart._jdf.queryExecution().toString().split("ReadSchema: ") if s.startswith("struct<sold_date_key")]
    assert scan and scan[0].startswith(
        "struct<sold_date_key:int,item_key:int,quantity_sold:int,total_sales_price:decimal(7,2),net_profit"
    )


def test_row_rules_reach_the_scan(spark, star, tmp_path):
    path = str(tmp_path / "bronze")
    star.bronze["bronze_customer"].write.parquet(path)
    plan = plan_of(silver.silver_customer(spark.read.parquet(path), tie_break=()))
    assert "PushedFilters: [IsNotNull(c_customer_sk)" in plan


def test_one_scan_per_table_for_status_and_profile(spark, raw_star, tmp_path):
    path = str(tmp_path / "sales")
    raw_star.sales.write.parquet(path)
    stored = spark.read.parquet(path)
    assert plan_of(rule_status({"silver_store_sales": stored})).count("FileScan") == 1
    profile = plan_of(table_profile(stored, "t", "RAW_MODEL", ["ss_ticket_number", "ss_item_sk"]))
    assert profile.count("FileScan") == 1
    assert "partial_count" in profile


def test_no_python_workers_and_no_products(spark):
    frames = Star(spark, SMALL, enforced=False)
    for df in (*frames.silver.values(), *frames.gold.values(), frames.annotated):
        plan = plan_of(df)
        for node in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert node not in plan


def test_ties_are_needed_only_where_loads_repeat(star):
    assert silver.latest_sales(star.bronze["bronze_store_sales"], SALES_TIES).count() == 5942


@pytest.mark.parametrize(
    "name, scans",
    [
        ("sales_quarantine", {"bronze_store_sales": 1, "silver_store_sales": 0, "gold_fact_store_sales": 0}),
        ("silver_issues", {"bronze_store_sales": 0, "silver_store_sales": 1, "silver_item": 1}),
        ("rule_status", {"bronze_store_sales": 0, "silver_store_sales": 1, "silver_item": 1}),
        ("expectation_counts", {"bronze_store_sales": 0, "silver_store_sales": 1, "silver_item": 1}),
        # The fact's own row, and the monthly leaders made of it.
        ("gold_issues", {"silver_store_sales": 0, "gold_fact_store_sales": 2}),
        ("gold_metrics", {"silver_store_sales": 0, "gold_fact_store_sales": 2}),
        ("gold_observability", {"silver_store_sales": 0, "gold_fact_store_sales": 2}),
        ("rule_catalog", {"bronze_store_sales": 1, "silver_store_sales": 1, "gold_fact_store_sales": 2}),
    ],
)
def test_quality_queries_derive_the_fact_once(spark, name, scans):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")  # whole paths in the plan
    try:
        plan = plan_of(QUERIES[name](spark, SMALL))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "lineitem.parquet" not in plan
    assert {t: len(re.findall(rf"/star-[0-9a-f]+/{t}\b", plan)) for t in scans} == scans


def test_one_pass_over_texts_and_lines(spark):
    assert "documents.parquet" not in plan_of(QUERIES["kpi_summary"](spark, SMALL))
    assert "documents.parquet" not in plan_of(QUERIES["clone_blocks"](spark, SMALL))
    assert plan_of(QUERIES["change_per_doubling"](spark, SMALL)).count("lineitem.parquet") == 1


def shuffles(df):
    """Exchanges that deal rows by a key; those to a single task carry one row per task."""
    return re.findall(r"Exchange hashpartitioning\([^)]*\)", plan_of(df))


def test_buckets_save_the_shuffles(spark, raw_star):
    from oresmith.operators.keys import duplicate_row_count, latest_by_key
    from oresmith.operators.references import Reference, keep_required
    from oresmith.plans.contracts import SALES
    from oresmith.plans.queries import bucketed_report
    from oresmith.rules.catalog import BRONZE_KEYS
    from oresmith.session import shared_folder
    from oresmith.sources.tables import Buckets, TableSpace

    folder = shared_folder(spark, "bucketed")
    space = TableSpace(spark, folder.rsplit("/", 1)[1].replace("-", "_")).create(folder)
    raw = raw_star.bronze_table("bronze_store_sales")
    space.write(raw, "fact", buckets=Buckets(4, SALES.key))
    fact = space.read("fact")
    assert len(shuffles(latest_by_key(raw, SALES.key, tie_break=SALES_TIES))) >= 1
    assert not shuffles(latest_by_key(fact, SALES.key, tie_break=SALES_TIES))
    assert not shuffles(duplicate_row_count(fact, SALES.key))
    assert not shuffles(table_profile(fact, "t", "RAW_MODEL", BRONZE_KEYS["bronze_store_sales"]))
    assert not shuffles(bucketed_report(fact))
    # A fact and a dimension in buckets of the reference join without a shuffle, too.
    typed = raw_star.typed_sales.select("ss_item_sk", "ss_ticket_number")
    space.write(typed, "by_item", buckets=Buckets(4, ("ss_item_sk",)))
    space.write(raw_star.silver_table("silver_item").select("i_item_sk"), "items", buckets=Buckets(4, ("i_item_sk",)))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = keep_required(space.read("by_item"), Reference("ss_item_sk", space.read("items"), "i_item_sk", "ok", required=True))
        assert "SortMergeJoin" in plan_of(joined) and not shuffles(joined)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    space.drop()


def test_the_mart_of_some_months_reads_their_partitions(spark, star):
    from pyspark.sql import functions as F

    from oresmith.plans.queries import MART_MONTHS
    from oresmith.session import shared_folder
    from oresmith.sources.tables import TableSpace

    folder = shared_folder(spark, "periods")
    space = TableSpace(spark, folder.rsplit("/", 1)[1].replace("-", "_")).create(folder)
    space.write(gold.with_sold_period(star.gold_table("gold_fact_store_sales")), "fact", partition_by=gold.SOLD_PERIOD)
    for name in ("gold_dim_date", "gold_dim_item"):
        space.write(star.gold_table(name), name)
    date_dim, items = space.read("gold_dim_date"), space.read("gold_dim_item")
    some = gold.top_items_of_months(space.read("fact"), date_dim, items, F.expr(MART_MONTHS))
    assert "dynamicpruning" in plan_of(some)
    assert some.count() == 30
    # Files that were read, by the scan of the fact in the plan that ran.
    some.collect()
    nodes, found = [some._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        elif "QueryStage" in name:
            nodes.append(node.plan())
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
        if name.startswith("Scan parquet") and "sold_year" in node.toString():
            found.append(node.metrics().apply("numFiles").value())
    everything = len(space.read("fact").inputFiles())
    assert found and max(found) <= everything / 10
    space.drop()


def test_all_rules_of_a_table_in_one_pass(spark, raw_star, tmp_path):
    from oresmith.quality.metrics import rule_scores

    path = str(tmp_path / "bronze")
    raw_star.bronze_table("bronze_store_sales").write.parquet(path)
    scored = rule_scores({"bronze_store_sales": spark.read.parquet(path)})
    assert plan_of(scored).count("FileScan") == 1 and scored.count() == 5


def test_incomplete_keys_need_no_second_pass(spark, star, tmp_path):
    path = str(tmp_path / "raw")
    star.bronze_table("bronze_store_sales").write.parquet(path)
    latest = silver.latest_sales(spark.read.parquet(path), SALES_TIES)
    plan = plan_of(latest)
    assert plan.count("FileScan") == 1 and "row_number(), 1, Partial" in plan and "Union" not in plan
