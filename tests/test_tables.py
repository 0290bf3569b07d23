import pytest

from oresmith.session import apply_scale_settings, shared_folder, shuffle_partitions, stored_bytes
from oresmith.sources.tables import Buckets, LayerFailed, TableSpace, TooFewRows, run_layer, write_csv, write_sorted


@pytest.fixture
def space(spark, request):
    name = request.node.name.replace("[", "_").replace("]", "")
    return TableSpace(spark, name).create(shared_folder(spark, name))


def test_names(space):
    assert space.qualified("t") == f"`spark_catalog`.`{space.database}`.`t`"


def test_overwrite_replaces_rows_and_schema(space, spark):
    space.write(spark.range(3), "t", comment="it's three")
    assert space.count("t") == 3
    comment = spark.sql(f"DESCRIBE TABLE EXTENDED {space.qualified('t')}").where("col_name = 'Comment'").first()
    assert comment.data_type == "it's three"
    space.write(spark.range(2).selectExpr("id AS other", "'x' AS s"), "t")
    assert space.read("t").columns == ["other", "s"]
    assert space.count("t") == 2


def test_overwrite_that_keeps_the_schema(space, spark):
    space.write(spark.range(3), "t")
    space.write(spark.range(5).selectExpr("CAST(id AS INT) AS id"), "t", replace_schema=False)
    assert space.read("t").dtypes == [("id", "bigint")]
    with pytest.raises(ValueError):
        space.write(spark.range(5).selectExpr("id AS other"), "t", replace_schema=False)
    assert space.count("t") == 5


def test_partitioned_write(space, spark):
    space.write(spark.range(10).selectExpr("id", "id % 2 AS p"), "t", partition_by=["p"])
    assert space.read("t").where("p = 1").count() == 5


def test_reset(space, spark):
    for name in ("i_a", "d_b", "keep"):
        space.write(spark.range(1), name)
    assert space.reset(["i_", "d_"]) == ["d_b", "i_a"]
    assert space.tables() == ["keep"]
    assert space.reset() == ["keep"]
    assert space.tables() == []


def test_layer_run_reads_what_was_stored(space, spark):
    counts = run_layer(space, {"a": lambda s: spark.range(4), "b": lambda s: s.read("a").where("id > 1")})
    assert counts == {"a": 4, "b": 2}


def test_view_is_not_stored(space, spark):
    assert space.view(spark.range(4), "a_view").count() == 4
    assert space.tables() == []


def test_shuffle_sizing():
    assert shuffle_partitions(0, 200) == 200
    assert shuffle_partitions(1 << 40, 200) == 4000
    assert shuffle_partitions(10 << 40, 200) == 20480
    assert shuffle_partitions(100 << 40, 200) == shuffle_partitions(1 << 50, 200) == 30000
    assert shuffle_partitions(128 << 20, 1) == 4


def test_scale_settings_follow_the_input(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    assert stored_bytes(spark, [str(tmp_path)]) > 1000
    apply_scale_settings(spark, [str(tmp_path)])
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum") == "8"


@pytest.mark.parametrize("single_file", [True, False])
def test_csv(spark, single_file):
    folder = shared_folder(spark, "csv")
    write_csv(spark.range(3).selectExpr("id", "'a,b' AS s"), folder, single_file)
    back = spark.read.option("header", True).schema("id bigint, s string").csv(folder)
    assert sorted(tuple(r) for r in back.collect()) == [(0, "a,b"), (1, "a,b"), (2, "a,b")]


def test_shared_folder_follows_the_session(spark):
    folder = shared_folder(spark, "x")
    assert folder.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert folder != shared_folder(spark, "x")


def broken(spark):
    """Rows of which one cannot be computed, found only while they are written."""
    return spark.range(100).selectExpr("if(id = 57, raise_error('bad row'), id) AS id")


@pytest.mark.parametrize("layout", [{}, {"partition_by": ["p"]}, {"buckets": Buckets(2, ("id",))}])
def test_a_failed_load_leaves_the_table(space, spark, layout):
    rows = spark.range(10).selectExpr("id", "id % 2 AS p")
    assert space.write(rows, "t", "first", **layout) == 10
    folder = space.version_folder("t")
    with pytest.raises(Exception, match="bad row"):
        space.write(broken(spark).selectExpr("id", "id % 2 AS p"), "t", **layout)
    with pytest.raises(TooFewRows):
        space.write(rows.where("id < 3"), "t", least_rows=4, **layout)
    assert space.count("t") == 10 and space.version_folder("t") == folder
    assert space.tables() == ["t"]
    # The next good load takes the name, the version before stays until it is discarded.
    assert space.write(rows.where("id < 5"), "t", **layout) == 5
    assert space.count("t") == 5 and space.version_folder("t") != folder
    assert spark.read.parquet(folder).count() == 10
    assert space.discard_versions("t") >= 1 and space.count("t") == 5
    assert space.discard_versions("t") == 0


def test_a_failed_first_load_leaves_no_table(space, spark):
    with pytest.raises(Exception, match="bad row"):
        space.write(broken(spark), "t")
    assert space.tables() == []


def test_equal_definitions_switch_the_place_only(space, spark):
    space.write(spark.range(3), "t", "kept comment")
    space.set_properties("t", {"team": "me"})
    space.write(spark.range(7), "t")
    assert space.count("t") == 7 and space.properties("t")["team"] == "me"


def test_a_table_can_be_made_from_itself(space, spark):
    space.write(spark.range(5), "t")
    space.write(space.read("t").where("id > 1"), "t")
    assert space.count("t") == 3


def test_a_failed_switch_gives_the_name_back(space, spark, monkeypatch):
    space.write(spark.range(3), "t")
    rename = TableSpace._rename

    def fail_once(self, old, new):
        if new == "t" and not fail_once.failed:
            fail_once.failed = True
            raise RuntimeError("catalog away")
        rename(self, old, new)

    fail_once.failed = False
    monkeypatch.setattr(TableSpace, "_rename", fail_once)
    with pytest.raises(RuntimeError, match="catalog away"):
        space.write(spark.range(2).selectExpr("id AS other"), "t")
    assert space.read("t").columns == ["id"] and space.count("t") == 3


def test_layer_run_orders_itself(space, spark):
    started = []

    def noted(name, build):
        def run(s):
            started.append(name)
            return build(s)

        return run

    builders = {
        "d": noted("d", lambda s: s.read("b").join(s.read("c"), "id")),
        "c": noted("c", lambda s: s.read("a").where("id > 1")),
        "b": noted("b", lambda s: s.read("a")),
        "a": noted("a", lambda s: spark.range(4)),
    }
    assert run_layer(space, builders) == {"d": 2, "c": 2, "b": 4, "a": 4}
    edges = sorted(tuple(r) for r in space.edges().collect())
    assert edges == [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c")]


def test_a_cycle_is_rejected(space, spark):
    builders = {"a": lambda s: s.read("b"), "b": lambda s: s.read("c"), "c": lambda s: s.read("a"), "x": lambda s: spark.range(1)}
    with pytest.raises(ValueError, match="wait for each other"):
        run_layer(space, builders)
    assert space.tables() == ["x"]


def test_a_failed_run_resumes(space, spark):
    built, trouble = [], [True]

    def build(name, frame):
        def run(s):
            rows = frame(s)
            built.append(name)
            return broken(spark) if name == "b" and trouble else rows

        return run

    builders = {
        "c": build("c", lambda s: s.read("b").where("id < 2")),
        "b": build("b", lambda s: s.read("a")),
        "a": build("a", lambda s: spark.range(3)),
        "other": build("other", lambda s: s.read("a")),
    }
    with pytest.raises(LayerFailed, match="bad row") as failure:
        run_layer(space, builders, run_id="monday")
    assert failure.value.counts == {"a": 3, "other": 3} and set(failure.value.failed) == {"b"}
    assert space.tables() == ["a", "other"]
    trouble.clear()
    built.clear()
    assert run_layer(space, builders, run_id="monday") == {"c": 2, "b": 3, "a": 3, "other": 3}
    assert sorted(built) == ["b", "c"]
    # Another run builds everything anew.
    built.clear()
    run_layer(space, builders, run_id="tuesday")
    assert sorted(built) == ["a", "b", "c", "other"]


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_sorted_files(spark, tmp_path, format):
    rows = spark.range(5000).selectExpr("cast((id * 7919) % 1000 AS int) AS k", "id", "if(id % 50 = 0, null, 'x') AS s").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored = write_sorted(rows, str(tmp_path / "sorted"), ["k", "id"], format)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    per_file = stored.selectExpr("_metadata.file_name AS f", "_metadata.file_block_start AS b", "k", "id", "s").collect()
    names = sorted({r.f for r in per_file})
    assert len(names) > 3
    in_order = [(r.k, r.id) for f in names for r in per_file if r.f == f]
    assert in_order == sorted(in_order) and len(in_order) == 5000
    assert sum(r.s is None for r in per_file) == 100
