from pyspark.sql import functions as F

from oresmith.operators import kpi
from oresmith.rules.catalog import catalog_frame


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_replicate(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert rows(kpi.replicate(df, 2)) == [(1, "a", 1), (1, "a", 2), (2, "b", 1), (2, "b", 2)]
    assert kpi.replicate(df, 3, {"k": F.lit(100)}).select("k").distinct().count() == 6


def test_group_means_by_scope(spark):
    df = spark.createDataFrame([("x", 1.0, True), ("x", 2.0, None), ("y", 5.0, False)], "g string, v double, q boolean")
    got = rows(kpi.group_means(df, ["g"], {"mean": "v"}, F.col("q")))
    assert got == [("x", "all", 1.5), ("x", "main", 2.0), ("x", "quality", 1.0), ("y", "all", 5.0), ("y", "main", 5.0)]


def test_share_of_total(spark):
    df = spark.createDataFrame(
        [("g", "m1", 3, True), ("g", "m1", 1, False), ("g", "m2", 4, None), ("z", "m3", 0, True)],
        "g string, m string, v int, s boolean",
    )
    got = rows(kpi.share_of_total(df, ["g"], "v", F.col("s"), "m"))
    assert got == [("g", 8, 3, 2, 1, 37.5), ("z", 0, 0, 1, 1, 0.0)]


def test_reuse(spark):
    df = spark.createDataFrame([("g", "a")] * 3 + [("g", "b"), ("g", None)], "g string, i string")
    assert rows(kpi.reuse(df, ["g"], "i")) == [("g", 2, 4, 2, 2.0, 1.0)]


def test_left_fill(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, 7)], "k int, n bigint")
    got = kpi.left_fill(left, right, ["k"], {"n": 0})
    assert rows(got) == [(1, 7), (2, 0)] and dict(got.dtypes)["n"] == "int"


def test_pivot_keeps_the_given_order(spark):
    df = spark.createDataFrame(
        [("gold", "a", 1), ("bronze", "a", 2), ("bronze", "b", 3), ("other", "a", 9)], "layer string, p string, v int"
    )
    wide = kpi.pivot_labels(df, "layer", "p", ["a", "b"], "v", ["catalog", "bronze", "silver", "gold"])
    assert [tuple(r) for r in wide.collect()] == [("bronze", 2, 3, 2), ("gold", 1, None, 4), ("other", 9, None, 5)]


def test_pivot_loses_no_row_and_no_label(spark):
    df = spark.createDataFrame(
        [("x", "a", 1), ("x", "a", 2), ("x", "z", 4), ("x", None, 8), (None, "a", 16)], "layer string, p string, v int"
    )
    wide = kpi.pivot_labels(df, "layer", "p", ["a"], "v", ["x"], other="rest")
    assert [tuple(r) for r in wide.collect()] == [("x", 3, 12, 1), (None, 16, None, 2)]


def test_impact_of_an_object_without_a_count_is_unknown(spark):
    catalog = spark.createDataFrame([("r1", "a"), ("r2", "b")], "rule_id string, object_name string")
    counts = spark.createDataFrame([("a", 5)], "object_name string, row_count bigint")
    known = kpi.rule_impact(catalog, counts, [kpi.Scenario("one", "object_name = 'a'"), kpi.Scenario("two", "true")])
    assert {r.change_scenario: r.rows_governed for r in known.collect()} == {"one": 5, "two": None}


def test_change_per_doubling_matches_published_figures(spark):
    df = spark.createDataFrame(
        [("declarative", "1x", 843.2, 18.39), ("declarative", "2x", 751.67, 22.84),
         ("imperative", "1x", 1417.6, 28.39), ("imperative", "2x", 1487.33, 49.67)],
        "pipeline string, scale string, runtime double, cost double",
    )
    measures = {"runtime": F.col("runtime"), "cost": F.col("cost")}
    got = kpi.change_between(df, ["pipeline"], "scale", "1x", "2x", measures)
    assert rows(got.select("pipeline", "runtime_change_pct", "cost_change_pct")) == [
        ("declarative", -10.86, 24.2),
        ("imperative", 4.92, 74.96),
    ]


def test_rule_impact(spark):
    counts = spark.createDataFrame([("silver_date_dim", 10), ("bronze_customer", 5)], "object_name string, row_count bigint")
    got = {r.change_scenario: r for r in kpi.rule_impact(catalog_frame(spark), counts).collect()}
    customer = got["every_customer_table"]
    assert (customer.objects_touched, customer.touch_points, customer.complexity_score) == (3, 5, 15)
    complete = got["all_key_completeness_rules"]
    assert (complete.objects_touched, complete.touch_points, complete.complexity_score) == (5, 12, 60)
    single = got["first_silver_rule"]
    assert (single.objects_touched, single.touch_points, single.rows_governed) == (1, 1, 10)


def test_mean_and_summary(spark):
    df = spark.createDataFrame([("g", 2), ("g", 4), ("g", 0)], "g string, v int")
    mean = kpi.mean_where(df, ["g"], "v", F.col("v") > 0, "mean_v")
    assert rows(kpi.summary("g", df.groupBy("g").count(), mean)) == [("g", 3, 3.0)]
    lacking = kpi.summary("g", df.groupBy("g").count(), mean.where("false"), zero=["mean_v"])
    assert rows(lacking) == [("g", 3, 0.0)]


def test_growth_over_scales(spark):
    rows = [("x", s, 3 * s, s * s, 5, s - 1) for s in (1, 2, 4, 8)] + [("y", 1, 7, 7, 7, 7)]
    df = spark.createDataFrame(rows, "g string, s int, linear int, square int, fixed int, shifted int")
    found = kpi.growth(df, ["g"], "s", ["linear", "square", "fixed", "shifted"]).collect()
    at = {(r.g, r.measure, r.scale): r for r in found}
    assert len(found) == 20
    assert [round(at["x", m, 8.0].growth_exponent, 9) for m in ("linear", "square", "fixed")] == [1.0, 2.0, 0.0]
    assert [at["x", "square", s].change_pct for s in (1.0, 2.0, 4.0)] == [None, 300.0, 300.0]
    assert (at["x", "linear", 4.0].previous_scale, at["x", "linear", 4.0].previous_value) == (2.0, 6.0)
    # One scale gives no slope, and a value of zero no logarithm.
    assert at["y", "linear", 1.0].growth_exponent is None
    assert at["x", "shifted", 1.0].value == 0 and at["x", "shifted", 2.0].change_pct is None
