"""Merkle manifest of a table, with a membership witness for every row, by streaming append.

Rows are leaves; every ``ARITY`` consecutive nodes of a level have one parent, the last ones maybe
fewer. An appender takes digests in order and holds, per level, the finished subtrees of the run
that is still open. The leaves of a subtree have a partial witness: the siblings met so far, and
their places. When a run is complete, its members' digests extend the witnesses of the leaves
below them, and its own digest is appended one level up.

The streams are aligned: a block holds ``ARITY ** LEVELS`` consecutive leaves of a tree, so each
ends with one digest, whatever comes after. Blocks are appended independently of each other. Their
roots are appended in the same way, in blocks of block roots, until every tree has one root; the
roots of the trees are then appended to the tree above them. At last the witnesses are put
together from the top down: that of a block's root extends those of all its leaves.

No task holds more than one block. A tree of any size is spread over the cluster by its blocks,
and the joins between the levels meet at most a block's worth of rows under a key. Rows are
numbered within their tree by a range partitioning and counts per partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oresmith.llm.common import rank_within, step_folder, stored

ARITY = 3
LEVELS = 7  # levels of a block, which has 3 ** 7 = 2,187 leaves
_DIGEST = 32


def digest_of(digests: Sequence[bytes]) -> bytes:
    """sha256 of the digests' lowercase hex text, one after the other."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


class Appender:
    """An open Merkle tree. ``siblings`` and ``shapes`` are the partial witnesses of its leaves:
    the digests beside the way up, and per level a byte of run length * 16 + own place."""

    def __init__(self, arity: int = ARITY):
        self.arity = arity
        self.open: list[list[tuple[bytes, int, int]]] = [[]]
        self.siblings: list[bytearray] = []
        self.shapes: list[bytearray] = []

    def append(self, digest: bytes) -> None:
        leaf = len(self.siblings)
        self.siblings.append(bytearray())
        self.shapes.append(bytearray())
        self._add(0, digest, leaf, leaf + 1)

    def _add(self, level: int, digest: bytes, first: int, end: int) -> None:
        """A finished subtree over the leaves from ``first`` to before ``end``."""
        if level == len(self.open):
            self.open.append([])
        run = self.open[level]
        run.append((digest, first, end))
        if len(run) == self.arity:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [digest for digest, _, _ in run]
        for place, (_, first, end) in enumerate(run):
            beside = b"".join(digests[:place] + digests[place + 1 :])
            shape = len(run) * 16 + place
            for leaf in range(first, end):
                self.siblings[leaf] += beside
                self.shapes[leaf].append(shape)
        self._add(level + 1, digest_of(digests), run[0][1], run[-1][2])

    def finish(self, height: int) -> bytes:
        """Complete the open runs of the levels below ``height``; the digest there."""
        for level in range(height):
            if level < len(self.open) and self.open[level]:
                self._complete(level)
        return self.open[height][0][0]


def fold(leaf: bytes, siblings: bytes, shape: bytes) -> bytes:
    """The root that a leaf and its witness lead to."""
    node, at = leaf, 0
    for code in shape:
        length, place = divmod(code, 16)
        beside = [siblings[i : i + _DIGEST] for i in range(at, at + _DIGEST * (length - 1), _DIGEST)]
        at += _DIGEST * (length - 1)
        node = digest_of(beside[:place] + [node] + beside[place:])
    return node


def least_height(leaves: int, arity: int = ARITY) -> int:
    height = 0
    while arity**height < leaves:
        height += 1
    return height


# ---------------------------------------------------------------- on tables


def row_digest(columns: Sequence[str | Column]) -> Column:
    """Hex sha256 of the values: each its UTF-8 byte count, a colon and itself, or ``-`` for NULL."""
    parts = []
    for column in columns:
        value = (F.col(column) if isinstance(column, str) else column).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, order: Sequence[str], folder: str, name: str) -> DataFrame:
    """``rows`` (tree, ...) with ``rank`` from 0 within the tree and its number of rows ``n``.

    ``rows`` must be stored. No tree meets in one task: the places of a range partition follow
    from the counts of those before it.
    """
    parts = rows.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id())
    parts = stored(parts, folder, f"{name}-parts")
    ranked = rank_within(parts, "tree", "part", list(order))
    sizes = parts.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    # The size of a tree goes to its parts first, of which a large tree has many.
    sizes = sizes.groupBy("tree").agg(F.sum("n").alias("n"), F.collect_list("part").alias("parts"))
    sizes = sizes.select("tree", "n", F.explode("parts").alias("part"))
    return ranked.join(sizes, ["tree", "part"]).drop("part")


def append_blocks(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The rows of ``nodes`` (tree, rank, n, digest, ...) with ``siblings`` and ``shape``, their
    witnesses inside the block, and ``root``, the block's root, in the block's first row."""
    size = ARITY**levels
    names = list(nodes.columns)
    schema = T.StructType(list(nodes.schema.fields)).add("siblings", "binary").add("shape", "binary").add("root", "binary")

    def append(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        tree = Appender()
        for digest in table.column("digest").to_pylist():
            tree.append(digest)
        n = table.column("n")[0].as_py()
        root = tree.finish(levels if n > size else least_height(n))
        witness = [
            pa.array([bytes(s) for s in tree.siblings], pa.binary()),
            pa.array([bytes(s) for s in tree.shapes], pa.binary()),
            pa.array([root] + [None] * (len(table) - 1), pa.binary()),
        ]
        columns = [table.column(name) for name in names]
        return pa.Table.from_arrays(columns + witness, names=names + ["siblings", "shape", "root"])

    block = F.expr(f"rank div {size}").alias("block")
    return nodes.groupBy("tree", block).applyInArrow(append, schema)


def grow(nodes: DataFrame, folder: str, name: str, levels: int = LEVELS) -> list[DataFrame]:
    """The stored tables of ``append_blocks``: of ``nodes``, of their block roots, and so on, up
    to one in which every tree is one block."""
    size, grown = ARITY**levels, []
    while True:
        done = stored(append_blocks(nodes, levels), folder, f"{name}-{len(grown)}")
        grown.append(done)
        if not done.where(F.col("n") > size).limit(1).count():
            return grown
        nodes = done.where("root IS NOT NULL").select(
            "tree",
            F.expr(f"rank div {size}").alias("rank"),
            F.expr(f"(n + {size - 1}) div {size}").alias("n"),
            F.col("root").alias("digest"),
        )


def roots(grown: list[DataFrame]) -> DataFrame:
    return grown[-1].where("root IS NOT NULL").select("tree", "root")


def whole_witnesses(grown: list[DataFrame], above: DataFrame | None = None, levels: int = LEVELS) -> DataFrame:
    """The rows of the lowest table with their witnesses up to the tree's root, or, by ``above``
    (tree, siblings, shape, ...) further up; ``above`` adds its other columns."""
    size = ARITY**levels
    keep = [c for c in grown[0].columns if c not in {"siblings", "shape", "root", "n", "digest"}]
    joined = F.concat("siblings", "more_siblings").alias("siblings"), F.concat("shape", "more_shape").alias("shape")
    extra: list[str] = []
    upper, on = None, ["tree"]
    if above is not None:
        extra = [c for c in above.columns if c not in {"tree", "siblings", "shape"}]
        upper = above.withColumnsRenamed({"siblings": "more_siblings", "shape": "more_shape"})
    for at in range(len(grown) - 1, -1, -1):
        here = grown[at].drop("root", "n", "digest")
        columns = keep if at == 0 else ["tree", "rank"]
        if upper is None:
            here = here.select(*columns, "siblings", "shape")
        else:
            here = here.withColumn("block", F.expr(f"rank div {size}")).join(upper, on)
            here = here.select(*columns, *joined, *extra)
        upper = here.withColumnsRenamed({"rank": "block", "siblings": "more_siblings", "shape": "more_shape"})
        on = ["tree", "block"]
    return here


def _folded(leaf: pd.Series, siblings: pd.Series, shape: pd.Series) -> pd.Series:
    return pd.Series([fold(*row) for row in zip(leaf, siblings, shape)], dtype=object)


def folded(leaf: Column, siblings: Column, shape: Column) -> Column:
    """The root that leaf digests and their witnesses lead to."""
    return F.pandas_udf(_folded, T.BinaryType())(leaf, siblings, shape)


def manifest(
    rows: DataFrame, tree_column: str, order_column: str, columns: Sequence[str], keep: dict[str, Column], levels: int = LEVELS
) -> DataFrame:
    """The ``keep`` columns, leaf, subroot, root, siblings, shape of every row; digests as binary.

    The rows of a tree (one per value of ``tree_column``, NULL included) are its leaves, ascending by
    ``order_column``, NULL first; rows that repeat it are ordered by their digests, and equal rows
    are leaves of their own. The roots of the trees, ordered by ``tree_column`` (text by its
    UTF-8 bytes, NULL first), are the leaves of the tree that gives ``root``. The witness
    (``siblings``, ``shape``) leads from the leaf to ``root``. A lone leaf is a root already, with
    an empty witness; an empty table gives an empty result. Extra columns play no part. The steps
    are stored, and the call runs the jobs that fill them.
    """
    folder = step_folder(rows.sparkSession, "merkle")
    tree = F.struct(F.col(f"`{tree_column}`").isNotNull().alias("present"), F.col(f"`{tree_column}`").alias("value"))
    kept = [column.alias(f"keep_{name}") for name, column in keep.items()]
    leaves = rows.select(
        tree.alias("tree"),
        F.col(f"`{order_column}`").alias("order"),
        F.unhex(row_digest([F.col(f"`{c}`") for c in columns])).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
        *kept,
    )
    leaves = stored(leaves, folder, "leaves")
    # The row's number only keeps equal rows apart, which a range could not cut otherwise.
    ranked = numbered(leaves, ["order", "digest", "row"], folder, "leaves")
    ranked = ranked.withColumn("leaf", F.col("digest")).drop("order", "row")
    grown = grow(ranked, folder, "leaves", levels)

    subroots = roots(grown).select(F.lit("all").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("digest"))
    subroots = numbered(stored(subroots, folder, "subroots"), ["of"], folder, "subroots")
    subroots = subroots.withColumn("subroot", F.col("digest"))
    above = grow(subroots, folder, "subroots", levels)
    top = roots(above).first()
    ways = whole_witnesses(above, levels=levels).drop("tree", "rank").withColumnRenamed("of", "tree")
    ways = stored(ways.withColumn("root", F.lit(top["root"] if top else None).cast("binary")), folder, "ways")

    whole = whole_witnesses(grown, ways, levels)
    return whole.select(
        *[F.col(f"keep_{name}").alias(name) for name in keep], "leaf", "subroot", "root", "siblings", "shape"
    )
