from dataclasses import replace
from decimal import Decimal

from pyspark.sql import functions as F

from oresmith.operators.references import key_words
from oresmith.plans import gold, silver
from oresmith.plans.contracts import CUSTOMER, DATE, ITEM, LINEAGE, SALES, STORE
from oresmith.plans.layers import run_all
from oresmith.plans.queries import AS_OF, SALES_TIES
from oresmith.quality.enforce import expectation_report
from oresmith.quality.issues import ISSUE_COLUMNS, issues
from oresmith.quality.metrics import bronze_metrics, gold_metrics, rule_status, table_profile
from oresmith.rules.catalog import GOLD_ISSUES, QUARANTINE_RULES, SILVER_ISSUES
from oresmith.session import shared_folder
from oresmith.sources.retail import retail_sources
from oresmith.sources.tables import TableSpace

from conftest import SMALL


def same_rows(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    left, right = a.select(*columns), b.select(*columns)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def test_contract_shapes(star):
    assert [len(c.fields) for c in (SALES, DATE, ITEM, STORE, CUSTOMER)] == [23, 28, 22, 29, 19]
    assert len(star.dims["silver_date_dim"].columns) == 32
    assert [len(star.gold[t].columns) for t in star.gold] == [29, 26, 31, 23, 28, 11]
    types = dict(star.sales.dtypes)
    assert types["ss_ticket_number"] == "bigint" and types["ss_net_paid"] == "decimal(7,2)"
    gold_types = dict(star.gold["gold_fact_store_sales"].dtypes)
    assert gold_types["discount_percentage"] == "decimal(15,2)"
    assert dict(star.gold["gold_top_items_month"].dtypes)["total_revenue"] == "decimal(17,2)"


def test_casts_that_do_not_fit_become_null(spark):
    raw = spark.createDataFrame([("12", "100000.00"), ("x", "99999.99"), (None, None)], "i_item_sk string, i_current_price string")
    narrow = type(ITEM)("t", ("i_item_sk",), tuple(f for f in ITEM.fields if f.name in raw.columns))
    assert [tuple(r) for r in narrow.project(raw).collect()] == [
        (12, None),
        (None, Decimal("99999.99")),
        (None, None),
    ]
    assert tuple(narrow.cast_failures(raw).first()) == (1, 1)
    wide = narrow.with_types({"i_current_price": "decimal(12,2)"})
    assert wide.project(raw).first()[1] == Decimal("100000.00")


def test_one_row_per_key(star):
    for name, key in (("silver_item", "i_item_sk"), ("silver_date_dim", "d_date_sk")):
        table = star.dims[name]
        assert table.count() == table.select(key).distinct().count()
    assert star.sales.count() == star.sales.select("ss_ticket_number", "ss_item_sk").distinct().count()


def test_kept_and_quarantined_rows_are_the_deduplicated_input(star):
    keys = ["ss_ticket_number", "ss_item_sk"]
    latest = silver.latest_sales(star.bronze["bronze_store_sales"], SALES_TIES).select(*keys)
    kept = silver.kept_sales(star.annotated)
    rejected = silver.sales_quarantine(star.annotated).select(
        F.col("key_1").cast("bigint").alias(keys[0]), F.col("key_2").cast("int").alias(keys[1])
    )
    assert same_rows(kept.select(*keys).union(rejected.distinct()), latest)
    assert same_rows(kept, star.sales)


def test_incomplete_keys_are_quarantined_one_by_one(star, spark):
    bronze = star.bronze["bronze_store_sales"]
    lost = bronze.limit(1).withColumn("ss_item_sk", F.lit(None).cast("bigint"))
    annotated = silver.annotated_sales(lost.union(lost).union(lost), star.references, SALES_TIES)
    rows = silver.sales_quarantine(annotated, variant="imperative").where("rule_id = 'IP_SILVER_010'").collect()
    assert [r.issue_reason for r in rows] == ["NULL_ITEM_SK"] * 3
    assert rows[0].paradigm == "imperative"


def test_quarantine_columns(star):
    assert tuple(silver.sales_quarantine(star.annotated).columns) == ISSUE_COLUMNS + silver.QUARANTINE_CONTEXT


def test_validate_first_falls_back_to_an_older_version(spark):
    fields = {f.name: "x" if f.type == "string" else None for f in ITEM.fields}
    base = {**fields, "i_item_sk": "1", "i_item_id": "I1", "i_wholesale_cost": "1"}
    versions = [
        {**base, "i_current_price": "5", "ingestion_timestamp": 1, "source_table": "item"},
        {**base, "i_current_price": "-5", "ingestion_timestamp": 2, "source_table": "item"},
    ]
    names = [*fields, *LINEAGE]
    rows = [tuple(v[n] for n in names) for v in versions]
    schema = ", ".join(f"{n} {'int' if n == 'ingestion_timestamp' else 'string'}" for n in names)
    bronze = spark.createDataFrame(rows, schema)
    assert silver.silver_item(bronze).count() == 0
    assert silver.silver_item(bronze, validate_first=True).first().i_current_price == 5


def test_at_most_ten_leaders_per_month(star):
    top = star.gold["gold_top_items_month"]
    per_month = top.groupBy("year", "month").agg(F.count("*").alias("n"), F.max("revenue_rank").alias("r"))
    assert per_month.where("n > 10 OR n <> r").isEmpty()
    stamped = gold.top_items_month(
        star.gold["gold_fact_store_sales"], star.gold["gold_dim_date"], star.gold["gold_dim_item"], 3, F.current_timestamp()
    )
    assert stamped.columns[-1] == "aggregation_timestamp"
    assert stamped.agg(F.max("revenue_rank")).first()[0] == 3


def test_leaders_are_the_same_where_names_are_joined_last(star):
    fact, days, items = (star.gold[t] for t in ("gold_fact_store_sales", "gold_dim_date", "gold_dim_item"))
    some = items.where("item_key % 3 > 0")  # the others resolve nowhere and leave their places
    known = replace(gold.item_reference(some), words=key_words(some, "item_key").count())
    joined = gold.top_items_month(fact, days, some)
    assert same_rows(gold.top_items_month(fact, days, some, items=known), joined)
    assert joined.where("item_key % 3 = 0").isEmpty() and not joined.isEmpty()


def test_issues_agree_with_status_and_metrics(raw_star):
    silver_rows = issues(raw_star.silver, SILVER_ISSUES)
    assert tuple(silver_rows.columns) == ISSUE_COLUMNS
    per_rule = {r.rule_id: r["count"] for r in silver_rows.groupBy("rule_id").count().collect()}
    status = {r.rule_id: r for r in rule_status(raw_star.silver).collect()}
    assert len(status) == 12
    assert status["DP_SILVER_012"].violating_rows == per_rule["DP_SILVER_012"]
    assert status["DP_SILVER_012"].rule_status == "FAIL"
    assert status["DP_SILVER_001"].rule_status == "PASS"
    for r in status.values():
        assert r.violating_rows + r.matching_rows == raw_star.silver[r.object_name].count()

    gold_rows = issues(raw_star.gold, GOLD_ISSUES)
    per_rule = {r.rule_id: r["count"] for r in gold_rows.groupBy("rule_id").count().collect()}
    metrics = {r.object_name: r for r in gold_metrics(raw_star.gold).collect()}
    assert len(metrics) == 6
    fact = metrics["gold_fact_store_sales"]
    assert fact.negative_value_count == per_rule["DP_GOLD_004"]
    assert fact.null_business_key_count == per_rule["DP_GOLD_005"]
    assert fact.issue_count <= fact.negative_value_count + fact.null_business_key_count
    assert metrics["gold_dim_customer"].issue_count == per_rule["DP_GOLD_003"]


def test_every_issue_of_a_row_is_listed_and_rows_are_read_once(raw_star):
    from oresmith.quality.issues import issue_frame

    sales = raw_star.bronze["bronze_store_sales"].withColumn("ss_net_paid", F.lit(-1)).withColumn("ss_quantity", F.lit(0))
    specs = [s for s in SILVER_ISSUES if s.object_name == "silver_store_sales"]
    frame = issue_frame(sales, specs)
    assert frame.count() == 2 * sales.count()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1


def test_profiles(spark, star):
    df = spark.createDataFrame([(1, None), (1, None), (None, 2)], "a int, b int")
    row = table_profile(df, "t", "RAW_MODEL", ["a", "b"]).first()
    assert (row.row_count, row.null_key_1_count, row.null_key_2_count, row.duplicate_row_count) == (3, 1, 2, 1)
    assert (row.pct_null_key_1, row.pct_null_key_2) == (33.33, 66.67)
    empty = table_profile(df.where("a > 5"), "t", "RAW_MODEL", ["a", "b"]).first()
    assert (empty.row_count, empty.null_key_1_count, empty.pct_null_key_1, empty.duplicate_row_count) == (0, 0, None, 0)
    metrics = bronze_metrics(star.bronze, "imperative")
    assert metrics.count() == 5 and "validation_mode" in metrics.columns
    assert metrics.where("object_name = 'bronze_item'").first().null_key_4_count is None


def test_quarantine_rules_cover_the_enforced_rules():
    assert {s.rule_id for s in QUARANTINE_RULES} == {
        "cast_contract",
        "DP_SILVER_010",
        "DP_SILVER_011",
        "DP_SILVER_012",
        "DP_SILVER_013",
        "fk_item_sk_positive",
        "sales_price_reasonable",
    }


def test_imperative_variant(raw_star):
    rows = issues(raw_star.silver, SILVER_ISSUES, "imperative")
    assert {r.rule_id[:3] for r in rows.select("rule_id").distinct().collect()} == {"IP_"}
    assert rows.where("paradigm <> 'imperative'").isEmpty()
    metrics = gold_metrics(raw_star.gold, "imperative").first()
    assert (metrics.object_type, metrics.validation_mode) == ("DELTA_TABLE", "post_load_validation")


def test_a_whole_run(spark, star):
    space = TableSpace(spark, "whole_run").create(shared_folder(spark, "whole_run"))
    counts = run_all(
        space, retail_sources(spark, SMALL), "loaded_at", {"bronze_store_sales": SALES_TIES}, AS_OF
    )
    assert counts["bronze_store_sales"] == 6000
    assert counts["silver_store_sales"] == star.sales.count()
    assert counts["dq_store_sales_quarantine"] == silver.sales_quarantine(star.annotated).count()
    assert counts["dq_bronze_observability"] == 17
    assert counts["dq_gold_observability"] == 7
    assert counts["dq_rule_catalog"] == 37
    assert counts["dq_silver_monitors"] == 6
    assert same_rows(space.read("gold_top_items_month"), star.gold["gold_top_items_month"])
    assert space.read("dq_silver_rule_status").where("rule_status = 'FAIL'").isEmpty()
    # Monitors counted during the write equal those counted on the stored tables.
    tables = {n: space.read(n) for n in ("silver_date_dim", "silver_item", "silver_store", "silver_customer")}
    assert same_rows(space.read("dq_silver_monitors"), expectation_report(tables, "monitor"))
    # What the run drops is recorded: by rule before enforcement, and row by row.
    dropped = {(r.object_name, r.expectation): r.failed_rows for r in space.read("dq_silver_dropped").collect()}
    assert dropped["silver_customer", "valid_birth_year"] > 0 or sum(dropped.values()) > 0
    for name in ("silver_date_dim", "silver_item", "silver_store", "silver_customer"):
        rejects = space.read("dq_dimension_rejects").where(F.col("object_name") == name).count()
        assert counts[name.replace("silver_", "staging_", 1)] == counts[name] + rejects
    failed = space.read("dq_cast_failures")
    assert failed.count() == 72
    lost = space.read("staging_store_sales_annotated").where("cast_failed IS NOT NULL").count()
    rejected = space.read("dq_store_sales_quarantine").where("issue_reason = 'CAST_FAILED'")
    assert rejected.count() == lost


def test_values_that_do_not_fit_are_rejected_with_their_raw_value(star):
    raw = star.bronze["bronze_store_sales"].withColumns(
        {
            "ss_ext_sales_price": F.col("ss_ext_sales_price") * 10,
            "ss_customer_sk": F.col("ss_customer_sk") + F.lit(3_000_000_000),
            "ss_store_sk": F.when(F.col("ss_store_sk") % 2 == 0, F.lit("x7")).otherwise(F.col("ss_store_sk").cast("string")),
        }
    )
    annotated = silver.annotated_sales(raw, star.references, SALES_TIES)
    kept, keys = silver.kept_sales(annotated), ["ss_ticket_number", "ss_item_sk"]
    rejected = silver.sales_quarantine(annotated)
    latest = silver.latest_sales(raw, SALES_TIES).select(*keys)
    both = kept.select(*keys).union(
        rejected.select(F.col("key_1").cast("bigint"), F.col("key_2").cast("int")).distinct()
    )
    assert same_rows(both, latest)
    # A kept row without a key came without one: no key was erased.
    raw_keys = raw.select(*[F.col(k).alias(f"raw_{k}") for k in keys], "ss_customer_sk", "ss_store_sk")
    erased = kept.where("ss_customer_sk IS NULL").join(
        raw_keys.where("ss_customer_sk IS NOT NULL"),
        (F.col("ss_ticket_number") == F.col("raw_ss_ticket_number")) & (F.col("ss_item_sk") == F.col("raw_ss_item_sk")),
        "left_semi",
    )
    assert erased.isEmpty()
    text = rejected.where("issue_reason = 'CAST_FAILED'").select("cast_failed").first()[0]
    assert "ss_customer_sk=30000" in text or "ss_store_sk=x7" in text or "ss_ext_sales_price=" in text
