"""Session settings and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings that keep the joins and aggregations healthy on large, skewed inputs.
SCALE_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even where that costs the next operator an extra shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

_MIB = 1 << 20
SMALL_PARTITION, LARGE_PARTITION = 128 * _MIB, 2048 * _MIB
MANY_PARTITIONS, MOST_PARTITIONS = 4_000, 30_000


def local_session(app: str = "oresmith", cores: str = "8", **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in {**SCALE_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    if "spark.checkpoint.dir" not in conf:
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="oresmith-"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stored_bytes(spark: SparkSession, paths: Sequence[str]) -> int:
    """Bytes of the files at or below the paths; only their listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]


def shuffle_partitions(input_bytes: int, at_least: int, expansion: int = 4) -> int:
    """How many partitions a shuffle of the whole input should start with.

    Columnar files grow by about ``expansion`` when their rows are shuffled. Partitions are
    small while there are few of them; beyond ``MANY_PARTITIONS`` they grow up to
    ``LARGE_PARTITION`` before their number grows further, and that never exceeds
    ``MOST_PARTITIONS``: the map output index of every task holds an entry per partition, and
    the driver one per task. Larger partitions are sorted in runs on disk, nothing is dropped.
    """
    moved = input_bytes * expansion
    small, large = -(-moved // SMALL_PARTITION), -(-moved // LARGE_PARTITION)
    return max(at_least, min(MOST_PARTITIONS, max(min(small, MANY_PARTITIONS), large)))


def apply_scale_settings(spark: SparkSession, paths: Sequence[str] = ()) -> SparkSession:
    """Switch on the adaptive settings in a session someone else created; once, at its start.

    ``paths`` are the tables that its queries read; shuffles then start with enough partitions
    for them, and adaptive execution merges those that turn out small.
    """
    for key, value in SCALE_SETTINGS.items():
        spark.conf.set(key, value)
    if paths:
        configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
        wanted = shuffle_partitions(stored_bytes(spark, paths), configured)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))
    return spark


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes up to which the session lets the smaller side of a join be broadcast; -1: never."""
    return spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


_single_process_root: list[str] = []


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, storage that every executor reaches.

    Without that setting the call fails, except in a session that runs wholly inside one
    process (``local[...]``), where there are no other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _single_process_root:
            _single_process_root.append(tempfile.mkdtemp(prefix="oresmith-"))
        root = _single_process_root[0]
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Written out and read back, so later steps do not compute it again."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
