"""Helpers that several operators share: stored steps, row hashing, connected components."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local_root: list[str] = []
_made: list[str] = []  # step folders, for whom it may concern


def ship_package(spark: SparkSession) -> None:
    """Let Spark hand this package to its Python workers, once per application.

    Needed where the package is not installed on the executors.
    """
    context = spark.sparkContext
    if getattr(context, "_oresmith_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="oresmith-package-")
    archive = shutil.make_archive(f"{folder}/oresmith-package", "zip", package.parent, package.name)
    context.addPyFile(archive)
    context._oresmith_shipped = True


def step_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir`` for the stored steps of one call.

    Only a session that runs wholly inside one process (``local[...]``) may do without that
    setting; anywhere else executors could not see each other's files, so the call fails.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local_root:
            _local_root.append(tempfile.mkdtemp(prefix="llm-steps-"))
        root = _local_root[0]
    folder = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"
    _made.append(folder)
    return folder


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def steps_removed(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the step folders that calls inside it have made.

    Only for results that are stored inside it: frames made of these steps cannot be read any more.
    """
    before, _made[:] = list(_made), []
    try:
        yield
        for folder in _made:
            remove_folder(spark, folder)
    finally:
        _made[:] = before


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The frame written out and read back: a lost executor costs no more than this step."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_remainder(id_column: str | Column, parts: int = 4) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``; NULL for a NULL id."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.crc32(column.cast("string").cast("binary")) % parts


def held_out(id_column: str | Column, part: int = 2) -> Column:
    """Whether the row's label must not be learned from; a row without an id is not held out."""
    return F.coalesce(id_remainder(id_column) == part, F.lit(False))


def bounded(df: DataFrame, rows: int) -> bool:
    """Whether the frame has at most ``rows`` rows; reads no more than that many and one."""
    return df.limit(rows + 1).count() <= rows


def semi_join(big: DataFrame, keys: DataFrame, on: list[str], broadcast_rows: int) -> DataFrame:
    """Rows of ``big`` with a match in the stored ``keys``.

    The keys are broadcast only after a count has shown that there are few of them.
    """
    few = keys.count() <= broadcast_rows
    return big.join(F.broadcast(keys) if few else keys, on, "left_semi")


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of ``edges``(a, b).

    Each round points every node at its smallest neighbour, follows those pointers to their
    end by doubling, and replaces the links by links between end points. Stars finish in one
    round, paths in as many doublings as the logarithm of their length. All steps are stored;
    the driver sees row counts only. An empty frame gives an empty result; links with a NULL
    end and links of a node to itself are ignored.
    """
    edges = edges.select("a", "b").where("a <> b")
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    links = stored(both, folder, "links-0")
    labels, step = None, 0
    while links.count():
        step += 1
        parents = links.groupBy("a").agg(F.min("b").alias("least"))
        parents = parents.select(F.col("a").alias("node"), F.least("a", "least").alias("parent"))
        parents = stored(parents, folder, f"parents-{step}-0")
        jump = 0
        while True:
            jump += 1
            above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            jumped = parents.join(above, "parent").select("node", F.col("above").alias("parent"))
            jumped = stored(jumped, folder, f"parents-{step}-{jump}")
            moved = jumped.join(parents.withColumnRenamed("parent", "before"), "node")
            done = not moved.where("parent <> before").limit(1).count()
            parents = jumped
            if done:
                break
        if labels is None:
            labels = parents
        else:
            here = parents.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
            labels = labels.join(here, "parent", "left")
            labels = labels.select("node", F.coalesce("root", "parent").alias("parent"))
            labels = stored(labels, folder, f"labels-{step}")
        ends = links.join(parents.toDF("a", "end_a"), "a").join(parents.toDF("b", "end_b"), "b")
        ends = ends.where("end_a <> end_b").select(F.col("end_a").alias("a"), F.col("end_b").alias("b"))
        links = stored(ends.distinct(), folder, f"links-{step}")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.select("node", F.col("parent").alias("component"))


def rank_within(df: DataFrame, group: str, salt: str, order: list[str]) -> DataFrame:
    """Adds ``rank``, the row's place from 0 within its group, without one task per group.

    Rows are numbered within (group, salt); the few counts per pair give every salt its
    start. ``df`` must be stored, and ``salt`` a stored column, so that a repeated task
    numbers the same rows alike.
    """
    counts = df.groupBy(group, salt).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(group).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, salt, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start_rank"))
    within = Window.partitionBy(group, salt).orderBy(*order)
    local = df.withColumn("local_rank", F.row_number().over(within) - 1)
    ranked = local.join(starts, [group, salt])
    return ranked.withColumn("rank", F.col("start_rank") + F.col("local_rank")).drop("start_rank", "local_rank")
