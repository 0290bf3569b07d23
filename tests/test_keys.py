from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oresmith.operators.keys import (
    duplicate_row_count,
    latest_by_key,
    latest_of_complete_keys,
    top_n,
)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


ROWS = [(1, 1, 10, "a"), (1, 2, 20, "b"), (1, 2, 15, "c"), (2, None, 5, "d"), (None, 3, 1, "e"), (None, 4, 1, "f")]


def test_latest_takes_the_newest_then_the_tie_break(spark):
    df = spark.createDataFrame(ROWS, "k int, ingestion_timestamp int, n int, v string")
    got = {(r.k, r.v) for r in latest_by_key(df, ["k"], tie_break=["n"]).collect()}
    assert got == {(1, "b"), (2, "d"), (None, "f")}


def test_default_tie_break_is_deterministic(spark):
    df = spark.createDataFrame([(1, 1, x) for x in range(50)], "k int, ingestion_timestamp int, n int")
    for parts in (1, 4, 7):
        assert latest_by_key(df.repartition(parts), ["k"]).collect()[0].n == 49


def test_rows_without_a_key_all_stay(spark):
    df = spark.createDataFrame(ROWS, "k int, ingestion_timestamp int, n int, v string")
    got = {(r.k, r.v) for r in latest_of_complete_keys(df, ["k"], tie_break=["n"]).collect()}
    assert got == {(1, "b"), (2, "d"), (None, "e"), (None, "f")}


def test_top_n_ranks_every_partition(spark):
    df = spark.createDataFrame([(p, x) for p in (1, 2) for x in range(5)], "p int, x int")
    got = {(r.p, r.x, r.rank) for r in top_n(df, 2, ["p"], [F.col("x").desc()], "rank").collect()}
    assert got == {(1, 4, 1), (1, 3, 2), (2, 4, 1), (2, 3, 2)}


def test_ranks_are_limited_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 3).withColumn("ingestion_timestamp", F.col("id"))
    for frame in (latest_by_key(df, ["k"]), top_n(df, 10, ["k"], [F.col("id").desc()], "rank")):
        plan = plan_of(frame)
        assert "row_number(), 1, Partial" in plan or "row_number(), 10, Partial" in plan
        assert plan.count("WindowGroupLimit") == 2


def test_duplicates(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 1), (2, None), (2, None), (3, 1)], "a int, b int")
    assert duplicate_row_count(df, ["a", "b"]).first()[0] == 3
    assert duplicate_row_count(df.where("a > 9"), ["a", "b"]).first()[0] == 0


small = st.one_of(st.none(), st.integers(0, 3))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(small, small, st.integers(0, 5)), min_size=1, max_size=30))
def test_latest_matches_plain_python(spark, rows):
    df = spark.createDataFrame(rows, "k int, ingestion_timestamp int, n int")
    best = {}
    for k, at, n in rows:
        rank = (-1 if at is None else at, n)
        if k not in best or rank > best[k]:
            best[k] = rank
    got = {r.k: (-1 if r.ingestion_timestamp is None else r.ingestion_timestamp, r.n) for r in latest_by_key(df, ["k"]).collect()}
    assert got == best
    repeats = len(rows) - len(best)
    assert duplicate_row_count(df, ["k"]).first()[0] == repeats
