"""Distinct counts that loads add to, against counting all rows again."""

import random

from pyspark.sql import functions as F

from oresmith.operators.distinct_counts import distinct_keys, key_bitmaps, merged


def test_loads_add_up_to_the_whole(spark):
    choose = random.Random(2)
    keys = [choose.choice([0, 1, -1, 5, 32768, 32769, -32768, -32769, 10**12, choose.randrange(-70000, 70000)]) for _ in range(3000)]
    rows = [(choose.choice("abc"), k if choose.random() < 0.95 else None, i % 4) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "g string, k long, load int")
    loads = [key_bitmaps(df.where(F.col("load") == i), "k", ["g"]) for i in range(4)]
    found = {r.g: r.distinct_keys for r in distinct_keys(merged(*loads)).collect()}
    assert found == {r.g: r.n for r in df.groupBy("g").agg(F.count_distinct("k").alias("n")).collect()}
    whole = distinct_keys(merged(merged(key_bitmaps(df.where("load < 2"), "k")), key_bitmaps(df, "k")))
    assert whole.first().distinct_keys == len({k for _, k, _ in rows if k is not None})


def test_no_rows_and_no_keys(spark):
    empty = spark.createDataFrame([(None,)], "k long")
    assert distinct_keys(key_bitmaps(empty, "k")).first().distinct_keys == 0
    assert key_bitmaps(empty.where("false"), "k").count() == 0


def test_a_load_of_copies_stays_small(spark):
    many = spark.range(200_000).selectExpr("id % 10 AS k")
    assert key_bitmaps(many, "k").count() <= 2
