from collections import Counter

from pyspark.sql import functions as F

from oresmith.quality.enforce import enforce, expectation_report, monitored
from oresmith.rules import catalog as c
from oresmith.rules.model import Expectation, Reason, any_reason, first_reason, holds, variant_rule_id


def test_catalog_counts(spark):
    rows = c.catalog_frame(spark).collect()
    assert len(rows) == len({r.rule_id for r in rows}) == 37
    assert Counter(r.rule_type for r in rows) == {"MONITOR": 17, "EXPECT": 19, "OBSERVE": 1}
    assert Counter(r.severity for r in rows) == {"HIGH": 16, "LOW": 12, "MEDIUM": 9}
    assert Counter(r.rule_group for r in rows) == {
        "KEY_COMPLETENESS": 12,
        "KEY_VALIDITY": 6,
        "DUPLICATE_MONITORING": 5,
        "BUSINESS_VALUE": 5,
        "BUSINESS_KEY": 5,
        "DOMAIN_VALIDITY": 2,
        "REFERENTIAL_VALIDITY": 1,
        "MEASURE_VALIDITY": 1,
    }
    assert not any(f.nullable for f in c.CATALOG_SCHEMA)


def test_key_config(spark):
    rows = {r.object_name: r.key_cols for r in c.key_config_frame(spark).collect()}
    assert rows == {t: list(k) for t, k in c.BRONZE_KEYS.items()}


def test_every_predicate_can_be_evaluated(star, raw_star):
    tables = {**star.bronze, **raw_star.silver, **raw_star.gold}
    for r in c.RULES:
        if r.kind == "predicate":
            tables[r.object_name].select(holds(r.expression))
    for e in c.EXTRA_EXPECTATIONS:
        tables[e.object_name].select(holds(e.predicate))


def test_expectation_counts():
    dropped = Counter(e.object_name for e in c.EXTRA_EXPECTATIONS if e.action == "drop")
    monitors = [e for e in c.EXTRA_EXPECTATIONS if e.action == "monitor"]
    assert len(monitors) == 6
    assert dropped["silver_store_sales"] == 2
    assert [e.name for e in c.expectations("silver_store_sales")][:3] == [
        "DP_SILVER_010",
        "DP_SILVER_011",
        "DP_SILVER_012",
    ]


def test_null_fails_a_rule(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "x int")
    rule = Expectation("positive", "t", "x > 0")
    assert [r.x for r in enforce(df, [rule]).collect()] == [1]
    assert [r[0] for r in df.select(holds("x > 0")).collect()] == [True, False, False]


def test_first_reason_wins(spark):
    reasons = (Reason("MISSING", "x IS NULL"), Reason("NEGATIVE", "x < 0"), Reason("ODD", "x % 2 <> 0"))
    df = spark.createDataFrame([(None,), (-1,), (3,), (2,)], "x int")
    got = [tuple(r) for r in df.select(first_reason(reasons), any_reason(reasons)).collect()]
    assert got == [("MISSING", True), ("NEGATIVE", True), ("ODD", True), ("UNKNOWN", False)]


def test_variant_ids():
    assert variant_rule_id("DP_SILVER_010", "imperative") == "IP_SILVER_010"
    assert variant_rule_id("DP_SILVER_010", "declarative") == "DP_SILVER_010"
    assert variant_rule_id("BRZ_SS_KEY_01", "imperative") == "BRZ_SS_KEY_01"


def test_report_and_observation_agree(star, spark):
    table = star.dims["silver_store"]
    report = {r.expectation: r.failed_rows for r in expectation_report({"silver_store": table}, "monitor").collect()}
    watched, observation = monitored(table, "silver_store")
    watched.write.format("noop").mode("overwrite").save()
    counts = observation.get
    assert counts.pop("row_count") == table.count()
    assert counts == report
    assert any(report.values())


def test_report_on_empty_table(star):
    table = star.dims["silver_item"].where(F.lit(False))
    rows = expectation_report({"silver_item": table}).collect()
    assert rows and all((r.passed_rows, r.failed_rows) == (0, 0) for r in rows)
