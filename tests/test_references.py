from dataclasses import replace

import pytest

from oresmith.operators.references import (
    Reference,
    counted,
    keep_optional,
    keep_required,
    keep_resolved,
    key_words,
    orphans,
    reference_flags,
)


@pytest.fixture(params=["broadcast", "shuffle"])
def join_mode(request, spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if request.param == "shuffle":
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield request.param
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def frames(spark):
    fact = spark.createDataFrame(
        [(1, 10, 100), (2, 11, None), (3, None, 100), (4, 99, 999), (5, 10, 999)],
        "id bigint, item int, store int",
    )
    items = spark.createDataFrame([(10,), (11,)], "i int")
    stores = spark.createDataFrame([(100,), (None,)], "s int")
    return fact, Reference("item", items, "i", "item_ok", required=True), Reference("store", stores, "s", "store_ok")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_filters(frames, join_mode):
    fact, item, store = frames
    assert ids(keep_required(fact, item)) == [1, 2, 5]
    assert ids(keep_optional(fact, store)) == [1, 2, 3]
    assert ids(orphans(fact, store)) == [4, 5]
    assert ids(orphans(fact, item)) == [4]
    assert ids(keep_resolved(fact, [store, item])) == [1, 2]


def test_flags(frames, join_mode):
    fact, item, store = frames
    got = {r.id: (r.item_ok, r.store_ok) for r in reference_flags(fact, [item, store]).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 1), 4: (0, 0), 5: (1, 0)}


def test_repeated_dimension_keys_do_not_multiply_rows(frames, spark):
    fact, _, _ = frames
    doubled = Reference("item", spark.createDataFrame([(10,), (10,)], "i int"), "i", "ok")
    assert reference_flags(fact, [doubled], unique=False).count() == fact.count()
    assert ids(keep_optional(fact, doubled, unique=False)) == [1, 3, 5]


def test_missing_keys_are_spread_over_shuffle_partitions(spark):
    from pyspark.sql import functions as F

    from oresmith.operators.references import _salt

    fact = spark.range(4000).withColumn("fk", F.lit(None).cast("int"))
    keys = fact.select("fk", _salt("fk", ["id"]).alias("salt"))
    per_partition = keys.repartition(8, "fk", "salt").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in per_partition) < 1000
    assert keys.where("salt <= 0").count() == 0


@pytest.mark.parametrize("kind, present", [("string", ["S1", "x", ""]), ("bigint", [-(1 << 40), -(1 << 60), (1 << 62)])])
def test_keys_of_any_type(spark, join_mode, kind, present):
    fact = spark.createDataFrame([(n, k) for n, k in enumerate([*present, None])], f"id bigint, fk {kind}")
    dim = spark.createDataFrame([(k,) for k in present[:2]], f"k {kind}")
    ref = Reference("fk", dim, "k", "ok")
    assert [r.ok for r in reference_flags(fact, [ref]).orderBy("id").collect()] == [1, 1, 0, 1]
    assert ids(keep_optional(fact, ref)) == [0, 1, 3]
    assert ids(keep_required(fact, ref)) == [0, 1]
    assert ids(orphans(fact, ref)) == [2]


def test_one_hot_key_gives_the_same_result(spark, join_mode):
    from pyspark.sql import functions as F

    fact = spark.range(3000).withColumn("fk", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).cast("int"))
    dim = spark.range(10).select(F.col("id").cast("int").alias("k"))
    flagged = reference_flags(fact, [Reference("fk", dim, "k", "ok")])
    assert flagged.count() == 3000
    assert flagged.where("ok = 1").count() == fact.where("fk < 10").count()


LONGEST = (1 << 63) - 1


@pytest.mark.parametrize("kind, of_fact", [("int", "int"), ("bigint", "int"), ("smallint", "bigint"), ("bigint", "bigint")])
@pytest.mark.parametrize("required", [True, False])
def test_counted_references_give_the_same(spark, join_mode, kind, of_fact, required):
    keys = [0, 1, 63, 64, 127, 128, 500, -1, -64, -65, -300, 63, None, None]
    sought = [*range(-310, -295), *range(-70, 200), 500, 501, None, None]
    if kind == of_fact == "bigint":
        keys += [LONGEST, -LONGEST - 1]
        sought += [LONGEST, LONGEST - 1, -LONGEST - 1, -LONGEST]
    dim = spark.createDataFrame([(k,) for k in keys], f"k {kind}")
    fact = spark.createDataFrame([(n, k) for n, k in enumerate(sought)], f"id bigint, fk {of_fact}")
    few = Reference("fk", dim, "k", "ok", required)
    ref = replace(few, words=key_words(dim, "k").count())
    assert counted([few]) == [few if join_mode == "broadcast" else ref]
    assert ref.words <= len(set(keys)) - 1
    present = {n for n, k in enumerate(sought) if k is not None and k in keys}
    missing = {n for n, k in enumerate(sought) if k is None}
    flagged = reference_flags(fact, [ref])
    assert flagged.columns == ["id", "fk", "ok"] and flagged.count() == len(sought)
    assert {r.id for r in flagged.where("ok = 1").collect()} == (present if required else present | missing)
    assert ids(keep_required(fact, ref)) == sorted(present)
    assert ids(keep_optional(fact, ref)) == sorted(present if required else present | missing)
    assert ids(orphans(fact, ref)) == sorted(set(range(len(sought))) - present - missing)


def test_an_empty_dimension_resolves_nothing(spark, join_mode):
    fact = spark.createDataFrame([(1, 5), (2, None)], "id bigint, fk int")
    ref = Reference("fk", spark.createDataFrame([], "k int"), "k", "ok")
    assert counted([ref])[0].words == (None if join_mode == "broadcast" else 0)
    ref = replace(ref, words=0)
    assert ids(keep_optional(fact, ref)) == [2] and ids(keep_required(fact, ref)) == []


def test_keys_that_are_no_whole_numbers_stay_uncounted(spark, join_mode):
    fact = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, fk string")
    text = Reference("fk", spark.createDataFrame([("a",)], "k string"), "k", "ok")
    ref, beside = counted([text, Reference("id", spark.range(65), "id", "id_ok")])
    assert beside.words == (None if join_mode == "broadcast" else 2)
    assert counted([text]) == [text] and ref.words is None and ids(keep_required(fact, ref)) == [1]


@pytest.mark.parametrize("apart, join", [(1, "BroadcastHashJoin"), (64, "SortMergeJoin")])
def test_stored_keys_are_broadcast_by_their_number(spark, tmp_path, apart, join):
    """By its compressed file the dimension looks small, whatever its keys take in memory."""
    rows = spark.range(100_000).selectExpr(f"CAST(id * {apart} AS INT) AS k", *[f"'the same text' AS c{n}" for n in range(20)])
    rows.write.parquet(str(tmp_path / "dim"))
    dim = spark.read.parquet(str(tmp_path / "dim"))
    fact = spark.range(1000).selectExpr("id", "CAST(id AS INT) AS fk")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        ref = Reference("fk", dim, "k", "ok")
        plain = reference_flags(fact, [ref])._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plain  # 100,000 keys of 24 bytes, by Spark's estimate
        sized = reference_flags(fact, counted([ref]))
        assert join in sized._jdf.queryExecution().executedPlan().toString()
        assert sized.where("ok = 1").count() == (1000 if apart == 1 else 16)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_missing_keys_are_spread_where_words_are_shuffled(spark):
    from pyspark.sql import functions as F

    from oresmith.operators.references import _with_bits

    fact = spark.range(4000).withColumn("fk", F.lit(None).cast("int"))
    ref = Reference("fk", spark.range(10).selectExpr("CAST(id AS INT) AS k"), "k", "ok", words=1)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined, _ = _with_bits(fact, ref)
        per_partition = joined.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in per_partition) == 4000 and max(r["count"] for r in per_partition) < 1000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("query", ["change_impact", "column_impact", "layer_run", "rule_scores"])
def test_references_to_stored_dimensions_are_counted(spark, monkeypatch, query):
    from oresmith.plans import gold, silver
    from oresmith.plans.queries import QUERIES

    from conftest import SMALL

    references, flags, leaders = [], silver.annotated_sales, gold.top_items_month

    def annotated(bronze, refs, tie_break=None):
        references.extend(refs)
        return flags(bronze, refs, tie_break)

    def top_items(*tables, items=None):
        references.append(items)
        return leaders(*tables, items=items)

    monkeypatch.setattr(silver, "annotated_sales", annotated)
    monkeypatch.setattr(gold, "top_items_month", top_items)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")  # five keys, so every dimension has many
    try:
        QUERIES[query](spark, SMALL)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(references) == 5 and all(r is not None and r.words is not None for r in references)
