"""Exact Jaccard join of word-shingle sets by PartEnum signatures.

Sets whose Jaccard index is at least ``percent`` differ in few shingles: their symmetric
difference is at most (a + b)(100 - percent) / (100 + percent) for sizes a and b. Sizes are cut
into bands so that such sets lie in the same or in neighbouring bands, and for a pair of
neighbouring bands the largest sizes bound the difference by some k. The shingle domain is
partitioned by a hash into groups of ``_PARTS`` parts each. For every subset of all but
``_LEFT_OUT`` parts of a group, the shingles in it are one signature: sets that differ in no more
parts of a group than are left out share a signature of it. There are so many groups that sets
within the bound share at least one; with larger k some more groups are taken, so that they share
at least c. Bands of a bound of 0 need none: there only equal sets are similar.

Of c shared signatures c - 1 can be spared. So every set drops the c - 1 that most sets have, in
one order for all: the rarest of the shared ones is kept by both sets. This takes away passages
and empty parts that many sets have in common, and sets that share less than c with all others.

Equal sets are one node. The sets under one signature are never paired with each other:

1. each is compared with the most central set under the signature, which joins nearly all
   members of a family of copies into one component;
2. where several components are left under a signature, sets outside the largest one are compared
   with those of other components, in blocks of bounded size, by sketches of one bit for each of
   4 (k + 1) parts (sets differ at least as often as their sketches). A block gives a spanning
   forest of what is close by sketch, less edges than it has rows, and these are verified;
3. only where an edge proves wrong, the sets that are still close by sketch to another component
   are compared whole, inside the blocks, and a block gives a spanning forest of true links.

All steps are exact. Links inside a component are not needed, since the result is each
document's component. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oresmith.llm.common import components, semi_join, step_folder, stored

WIDTH, PERCENT = 3, 90
_LEFT_OUT, _PARTS = 1, 3  # parts left out of a signature, and parts of a group
_BLOCK = 256
_BITS = 4  # of a sketch, for each shingle that may differ
_FEW = 300_000  # ids, broadcast only below


# ---------------------------------------------------------------- sets of shingles


_PLACES = 256
# One random number for each place in a word and byte there; longer words start over, with a factor.
_NUMBERS = np.random.default_rng(20).integers(1, 1 << 64, _PLACES * 256, dtype=np.uint64)


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words, what ASCII white space separates, in their order."""
    data = np.frombuffer(text, dtype=np.uint8)
    at = np.flatnonzero((data != 32) & (data - np.uint8(9) > 4))  # 9 to 13 and 32 are white space
    if not len(at):
        return np.empty(0, dtype=np.uint64)
    begins = np.empty(len(at), dtype=bool)
    begins[0] = True
    np.not_equal(at[1:], at[:-1] + 1, out=begins[1:])
    first = np.flatnonzero(begins)
    place = at - np.repeat(at[first], np.diff(np.append(first, len(at))))
    numbers = _NUMBERS[place % _PLACES * 256 + data[at]]
    if place.max() >= _PLACES:
        numbers = numbers * (place // _PLACES * 2 + 1).astype(np.uint64)
    return np.add.reduceat(numbers, first)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of the distinct word shingles of a whole text, ascending.

    Words are what ASCII white space separates, with A-Z in lower case. A text of fewer words
    than ``width`` is one shingle; one without words, or NULL, has none.
    """
    hashes = word_hashes((text or "").encode("utf-8", "replace").lower())
    if not len(hashes):
        return hashes
    runs = max(1, len(hashes) - width + 1)
    taken = min(width, len(hashes))
    total = np.full(runs, taken, dtype=np.uint64)
    for i in range(taken):
        total = total * np.uint64(0xD1B54A32D192ED03) + hashes[i : i + runs]
    total = np.sort(_mixed(total))
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


# ---------------------------------------------------------------- signatures


@lru_cache(maxsize=8)
def bands(percent: int, largest: int) -> np.ndarray:
    """The largest size of each band, until one is at least ``largest``."""
    ends, low = [], 1
    while not ends or ends[-1] < largest:
        ends.append(low * 100 // percent)
        low = ends[-1] + 1
    return np.array(ends, dtype=np.int64)


def band_of(size: int, percent: int) -> int:
    return int(np.searchsorted(bands(percent, 1 << 31), size))


def most_different(sizes: int | np.ndarray, percent: int):
    """The largest symmetric difference of similar sets whose sizes have the given sum."""
    return sizes * (100 - percent) // (100 + percent)


@lru_cache(maxsize=4096)
def band_bound(band: int, percent: int) -> int:
    """The bound k for pairs with sizes in this band or the one before."""
    return int(most_different(2 * int(bands(percent, 1 << 31)[band]), percent))


def least_shared(k: int, groups: int) -> int:
    """The fewest signatures that sets share that differ in at most k shingles."""
    shared = [comb(max(0, _PARTS - d), _PARTS - _LEFT_OUT) for d in range(_PARTS + 1)]
    total, left = groups * shared[0], k
    # Each further part that differs costs a group less, so all groups lose a first one first.
    for d in range(_PARTS):
        spent = min(left, groups)
        total -= spent * (shared[d] - shared[d + 1])
        left -= spent
    return total


@lru_cache(maxsize=4096)
def groups_of(k: int) -> int:
    """How many groups of parts the bound k gets: one signature is shared, more with larger k."""
    groups = 1
    while least_shared(k, groups) < 1 + k // 8:
        groups += 1
    return groups


@lru_cache(maxsize=4096)
def to_spare(band: int, percent: int) -> int:
    """How many of its shared signatures for this band a set need not keep."""
    k = band_bound(band, percent)
    return least_shared(k, groups_of(k)) - 1 if k else 0


class Spread:
    """A set's shingles spread over the domain once, to be cut into any number of parts."""

    def __init__(self, values: np.ndarray):
        self.low = _mixed(values + np.uint64(1))
        self.sorted = np.sort(self.low)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(_mixed(self.sorted ^ np.uint64(0x5851F42D4C957F2D)), out=self.sums[1:])

    def node(self) -> int:
        """The set's number: a signed 64-bit hash."""
        return int(_signed(_mixed(self.sums[-1:] + np.uint64(len(self.low))))[0])

    def part_sums(self, parts: int) -> np.ndarray:
        """For each of equal parts of the domain, a checksum of the shingles in it."""
        edges = np.searchsorted(self.sorted, _edges(parts))
        found = np.empty(parts, dtype=np.uint64)
        found[:-1] = self.sums[edges]
        found[-1] = self.sums[-1]
        found[1:] -= found[:-1].copy()
        return found


@lru_cache(maxsize=1024)
def _edges(parts: int) -> np.ndarray:
    """Where all parts but the first begin."""
    return np.array([(i << 64) // parts for i in range(1, parts)], dtype=np.uint64)


@lru_cache(maxsize=1024)
def _names(band: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that tell apart the parts, and the subsets of each group (rows), of one band."""
    part = np.arange(groups * _PARTS, dtype=np.uint64) + np.uint64(band << 32)
    subset = np.arange(groups * comb(_PARTS, _LEFT_OUT), dtype=np.uint64) + np.uint64((band << 32) + (1 << 31))
    return _mixed(part), _mixed(subset).reshape(-1, groups)


def signatures(values: np.ndarray | Spread, band: int, percent: int) -> np.ndarray:
    """Signatures of a set for pairs in this band or the one before; none where k is 0.

    The lowest bit tells whether the band's number is odd.
    """
    k = band_bound(band, percent)
    if not k:
        return np.empty(0, dtype=np.uint64)
    spread, groups = values if isinstance(values, Spread) else Spread(values), groups_of(k)
    parts, subsets = _names(band, groups)
    sums = _mixed(spread.part_sums(groups * _PARTS) + parts).reshape(_PARTS, groups)
    total = subsets.copy()
    for row, kept in zip(total, combinations(range(_PARTS), _PARTS - _LEFT_OUT)):
        for place, part in enumerate(kept):
            row += sums[part] * np.uint64(2 * place + 1)
    return total.ravel() & ~np.uint64(1) | np.uint64(band & 1)


def sketch(values: np.ndarray | Spread, band: int, percent: int, bits: int = _BITS) -> bytes:
    """One bit for each of ``bits`` (k + 1) parts or more: whether it holds an odd number of shingles.

    Every shingle of only one of two sets turns one bit, so they differ at least as often as their bits do.
    """
    low = values.low if isinstance(values, Spread) else Spread(values).low
    parts = bits * max(16, band_bound(band, percent) + 1)
    part = ((low & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int64)
    return np.packbits(np.bincount(part, minlength=parts) & 1 > 0).tobytes()


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def _described_sets(texts: Column, width: int, percent: int, bits: int) -> Column:
    """struct(n, node, odd, spare, next_spare, own, following): size and hash of a set, whether its
    band is odd, what it has to spare and its sketch for its own band and for the next."""
    schema = T.StructType().add("n", "integer").add("node", "long").add("odd", "integer")
    schema = schema.add("spare", "integer").add("next_spare", "integer")
    schema = schema.add("own", "binary").add("following", "binary")

    def described(s: np.ndarray) -> tuple:
        if not len(s):
            return 0, None, 0, 0, 0, None, None
        band = band_of(len(s), percent)
        spread = Spread(s)
        spare, sketches = [to_spare(b, percent) for b in (band, band + 1)], [sketch(spread, b, percent, bits) for b in (band, band + 1)]
        return len(s), spread.node(), band & 1, *spare, *sketches

    @F.pandas_udf(schema)
    def made(values: pd.Series) -> pd.DataFrame:
        return _frame([described(shingles(text, width)) for text in values], schema.names)

    return made(texts)


def _signature_rows(width: int, percent: int):
    """(signature, node) of the texts' sets, each set once a task."""
    schema = pa.schema([("signature", pa.int64()), ("node", pa.int64())])

    def batch(found: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
        node = np.repeat(np.array(nodes, dtype=np.int64), [len(f) for f in found])
        return pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(found))), pa.array(node)], schema=schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        found, nodes, held = [], [], 0
        for texts in batches:
            for text in texts.column(0):
                s = shingles(text.as_py(), width)
                if not len(s):
                    continue
                spread = Spread(s)
                node = spread.node()
                if node in seen:
                    continue
                seen.add(node)
                band = band_of(len(s), percent)
                found.append(np.concatenate([signatures(spread, b, percent) for b in (band, band + 1)]))
                nodes.append(node)
                held += len(found[-1])
                if held > 100_000:
                    yield batch(found, nodes)
                    found, nodes, held = [], [], 0
        if found:
            yield batch(found, nodes)

    return rows


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (signature, node), each once, those of signatures with several nodes.

    The last row of a batch is held back until the next shows whether its signature goes on.
    """
    held = np.empty((2, 0), dtype=np.int64)
    before = False  # whether the row held back follows one of its signature

    def out(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1])], names=["signature", "node"])

    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy() for c in ("signature", "node")])
        rows = np.concatenate([held, rows], axis=1)
        if not rows.shape[1]:
            continue
        rows = rows[:, np.concatenate([[True], np.any(rows[:, 1:] != rows[:, :-1], axis=0)])]
        goes_on = rows[0, 1:] == rows[0, :-1]
        follows = np.concatenate([[before], goes_on])
        yield out(rows[:, :-1][:, goes_on | follows[:-1]])
        held, before = rows[:, -1:], bool(follows[-1])
    if before:
        yield out(held)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """Rows as a frame whose nodes stay whole numbers beside missing ones."""
    columns = dict(zip(names, zip(*rows))) if rows else {name: () for name in names}
    return pd.DataFrame({k: pd.Series(v, dtype="Int64" if k == "node" else None) for k, v in columns.items()})


def _whole_sets(texts: Column, width: int) -> Column:
    """struct(node, shingles, packed): the set itself, as numbers and as their bytes."""
    schema = T.StructType().add("node", "long").add("shingles", T.ArrayType(T.LongType())).add("packed", "binary")

    @F.pandas_udf(schema)
    def made(values: pd.Series) -> pd.DataFrame:
        rows = []
        for text in values:
            s = shingles(text, width)
            whole = _signed(s)
            rows.append((Spread(s).node(), whole, whole.tobytes()) if len(s) else (None, None, None))
        return _frame(rows, ["node", "shingles", "packed"])

    # Not to be run ahead of the join that picks the texts, to filter on its result.
    return made.asNondeterministic()(texts)


# ---------------------------------------------------------------- comparison of sets


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of nodes whose sets reach the similarity, by their whole sets."""
    mine = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    theirs = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(mine, "a").join(theirs, "b")
    common = F.size(F.array_intersect("x", "y"))
    both = both.select("a", "b", common.alias("i"), (F.size("x") + F.size("y")).alias("sizes"))
    return both.where(100 * F.col("i") >= percent * (F.col("sizes") - F.col("i"))).select("a", "b")


def _close_by_sketch(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b, sizes, marks) that their sketches leave within the bound.

    ``marks`` is 2 where a's sketch is that of its own band, plus 1 where b's is.
    """

    def different(x: pd.Series, y: pd.Series) -> pd.Series:
        counts = [np.bitwise_count(np.frombuffer(s, np.uint8) ^ np.frombuffer(t, np.uint8)).sum(dtype=int) for s, t in zip(x, y)]
        return pd.Series(counts, dtype="int32")

    both = pairs
    for end, own in (("a", F.col("marks") >= 2), ("b", F.col("marks") % 2 == 1)):
        both = both.join(sketches.withColumnRenamed("node", end), end)
        both = both.withColumn(f"mark_{end}", F.when(own, F.col("own_mark")).otherwise(F.col("next_mark")))
        both = both.drop("own_mark", "next_mark")
    bound = F.expr(f"sizes * {100 - percent} div {100 + percent}")
    return both.where(F.pandas_udf(different, T.IntegerType())("mark_a", "mark_b") <= bound).select("a", "b")


_KEYS = ["signature", "at", "against"]


def _blocks(percent: int, output: str):
    """What is close in blocks of rows (signature, at, against, outside, node, n, component, mark),
    sorted by the first three.

    In a block the rows ``at`` it are compared with the outside rows dealt ``against`` them, where
    components differ. ``output`` is ``forest``: edges (a, b) of a spanning forest of what is close
    by sketch; ``doubtful``: nodes (a, a) that are close by sketch to another component;
    ``links``: a spanning forest of what is similar by whole sets, which ``mark`` then holds.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(here: dict[str, np.ndarray], there: dict[str, np.ndarray]) -> list[tuple[int, int]]:
        node, n, component, inside = here["node"], here["n"], here["component"], ~here["outside"]
        if output == "links":
            marks = [np.frombuffer(m, np.int64) for m in here["mark"]]
        else:
            marks = np.frombuffer(b"".join(here["mark"]), np.uint8).reshape(len(node), -1)
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                parent[c] = c = parent.get(parent[c], parent[c])
            return c

        found = []
        for other, m, its, mark in zip(there["node"].tolist(), there["n"].tolist(), there["component"].tolist(), there["mark"]):
            # Two outside rows meet twice, once from each side.
            bound = most_different(n + m, percent)
            at = np.flatnonzero((component != its) & (inside | (node < other)) & (bound >= np.abs(n - m)))
            if not len(at):
                continue
            if output == "links":
                mark = np.frombuffer(mark, np.int64)
                common = np.array([len(np.intersect1d(mark, marks[i], assume_unique=True)) for i in at], dtype=int)
                at = at[100 * common >= percent * (n[at] + m - common)]
            else:
                bits = np.bitwise_count(marks[at] ^ np.frombuffer(mark, np.uint8)).sum(1, dtype=int)
                at = at[bits <= bound[at]]
            for i in at.tolist():
                if output == "doubtful":
                    found += [(int(node[i]),) * 2, (other,) * 2]
                    continue
                x, y = root(int(component[i])), root(its)
                if x != y:
                    parent[x] = y
                    found.append((min(int(node[i]), other), max(int(node[i]), other)))
        return found

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray] = {}
        found: set[tuple[int, int]] = set()

        def compare_all(rows: dict[str, np.ndarray], borders: list[int]) -> None:
            for start, end in zip(borders[:-1], borders[1:]):
                here = rows["here"][start:end]
                if here.any() and not here.all():
                    part = {c: v[start:end] for c, v in rows.items()}
                    found.update(compare({c: v[here] for c, v in part.items()}, {c: v[~here] for c, v in part.items()}))

        for batch in batches:
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            rows = {c: np.concatenate([rest[c], v]) if rest else v for c, v in rows.items()}
            size = len(rows["node"])
            if not size:
                continue
            new = np.zeros(size - 1, dtype=bool)
            for key in _KEYS:
                new |= rows[key][1:] != rows[key][:-1]
            borders = [0, *(np.flatnonzero(new) + 1).tolist()]
            compare_all(rows, borders)
            rest = {c: v[borders[-1] :] for c, v in rows.items()}
            if len(found) > 100_000:
                yield _batch(found, schema)
                found.clear()
        if rest:
            compare_all(rest, [0, len(rest["node"])])
        if found:
            yield _batch(found, schema)

    return blocks


def _batch(pairs: set[tuple[int, int]], schema: pa.Schema) -> pa.RecordBatch:
    columns = np.array(sorted(pairs), dtype=np.int64).T
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)


def _mixed_blocks(members: DataFrame, known: DataFrame, folder: str, name: str) -> DataFrame:
    """(signature, at, against, here, outside, node, n, own, component): the members of signatures
    under which several components are left, dealt into blocks.

    Sets outside the largest component of a signature are compared with all others under it, so
    with one large family and few others the rows are little more than the members.
    """
    labelled = members.join(known, "node", "left")
    labelled = stored(labelled.withColumn("component", F.coalesce("component", "node")), folder, f"{name}-labelled")
    parts = labelled.groupBy("signature", "component").agg(F.count(F.lit(1)).alias("size"))
    mixed = parts.groupBy("signature").agg(
        F.max(F.struct("size", "component")).alias("main"), F.sum("size").alias("held"), F.count(F.lit(1)).alias("parts")
    )
    blocks = [F.ceil(c / _BLOCK).cast("int") for c in (F.col("held"), F.col("held") - F.col("main.size"))]
    mixed = mixed.where("parts > 1").select(
        "signature", F.col("main.component").alias("main"), blocks[0].alias("rows"), blocks[1].alias("columns")
    )
    mixed = stored(mixed, folder, f"{name}-mixed")
    dealt = labelled.join(mixed, "signature").withColumn("outside", F.col("component") != F.col("main"))

    def block(of: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.col(of)).cast("int")

    def every(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    rest = [F.col(c) for c in ("outside", "node", "n", "own", "component")]
    here = dealt.select("signature", block("rows").alias("at"), every("columns").alias("against"), F.lit(True).alias("here"), *rest)
    there = dealt.where("outside").select(
        "signature", every("rows").alias("at"), block("columns").alias("against"), F.lit(False).alias("here"), *rest
    )
    return here.union(there)


def _in_blocks(dealt: DataFrame, percent: int, output: str) -> DataFrame:
    """(a, b) of the dealt rows with their ``mark``."""
    columns = [*_KEYS, "here", "outside", "node", "n", "component", "mark"]
    rows = dealt.select(*columns).repartition(*_KEYS).sortWithinPartitions(*_KEYS)
    return rows.mapInArrow(_blocks(percent, output), "a long, b long").distinct()


def jaccard_components(
    docs: DataFrame, id_column: str, text_column: str, percent: int = PERCENT, width: int = WIDTH
) -> DataFrame:
    """id, n_shingles, component_id for every row of ``docs``.

    Documents are linked when 100 times the common shingles are at least ``percent`` times all
    shingles of the two; ``component_id`` is the smallest id that links reach. Documents
    without words (NULL, empty, blank) are linked with nothing and keep their own id. Rows that
    repeat an id count one by one; a NULL id takes part in links and is never the smallest.
    The steps are stored, and the call runs the jobs that fill them.
    """
    folder = step_folder(docs.sparkSession, "jaccard-join")
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    made = source.select("id", _described_sets(F.col("text"), width, percent, _BITS).alias("s"))
    rows = stored(made.select("id", "s.*"), folder, "described-sets")
    columns = [c for c in rows.columns if c not in {"id", "node"}]
    nodes = rows.where("n > 0").groupBy("node").agg(
        *[F.min(c).alias(c) for c in columns], F.min("id").alias("least"), F.count(F.lit(1)).alias("times")
    )
    nodes = stored(nodes, folder, "nodes")

    # Signatures that several sets share, and the sets under them; none of them is stored before.
    signed = source.select("text").mapInArrow(_signature_rows(width, percent), "signature long, node long")
    signed = signed.repartition("signature").sortWithinPartitions("signature", "node")
    shared = stored(signed.mapInArrow(_shared_rows, "signature long, node long"), folder, "shared")
    # What a set can spare goes, the commonest first.
    held = shared.groupBy("signature").agg(F.count(F.lit(1)).alias("held"))
    ranked = shared.join(held, "signature").join(nodes.select("node", "n", "odd", "spare", "next_spare"), "node")
    own = (F.col("signature") % 2 != 0) == (F.col("odd") == 1)
    common_first = Window.partitionBy("node", "own").orderBy(F.desc("held"), "signature")
    ranked = ranked.withColumn("own", own).withColumn("place", F.row_number().over(common_first))
    kept = ranked.where(F.col("place") > F.when(F.col("own"), F.col("spare")).otherwise(F.col("next_spare")))
    kept = stored(kept.select("signature", "node", "n", "own"), folder, "kept")
    held = kept.groupBy("signature").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    members = stored(kept.join(held, "signature"), folder, "members")
    sketches = nodes.select("node", F.col("own").alias("own_mark"), F.col("following").alias("next_mark"))

    def sets_of(pairs: DataFrame, name: str) -> DataFrame:
        """(node, shingles) of the nodes in the pairs, from one document each."""
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        ends = stored(ends, folder, f"{name}-ends")
        chosen = nodes.join(ends, "node", "left_semi").select(F.col("least").alias("id"))
        ids = stored(chosen.where("id IS NOT NULL").distinct(), folder, f"{name}-ids")
        texts = semi_join(source, ids, ["id"], _FEW).union(source.where("id IS NULL"))
        sets = texts.select(_whole_sets(F.col("text"), width).alias("s")).select("s.*")
        sets = sets.join(ends, "node", "left_semi").dropDuplicates(["node"])
        return stored(sets, folder, f"{name}-sets")

    # First step: every set against the most central one under each of its signatures.
    central = members.groupBy("node").agg(F.sum("held").alias("weight"))
    weighted = stored(members.join(central, "node").drop("held"), folder, "weighted")
    heads = weighted.groupBy("signature").agg(F.max(F.struct("weight", "node", "n", "own")).alias("head"))
    heads = heads.select("signature", F.col("head.node").alias("head"), F.col("head.n").alias("m"), F.col("head.own").alias("head_own"))
    heads = stored(heads, folder, "heads")
    near_size = F.expr(f"(n + m) * {100 - percent} div {100 + percent} >= abs(n - m)")
    star = weighted.join(heads, "signature").where("node <> head").where(near_size)
    star = star.select(
        F.least("node", "head").alias("a"),
        F.greatest("node", "head").alias("b"),
        (F.col("n") + F.col("m")).alias("sizes"),
        F.expr("if(if(node < head, own, head_own), 2, 0) + if(if(node < head, head_own, own), 1, 0)").alias("marks"),
    )
    star = stored(star.groupBy("a", "b", "sizes").agg(F.min("marks").alias("marks")), folder, "star")
    near = stored(_close_by_sketch(star, sketches, percent), folder, "star-close")
    links = stored(_linked(near, sets_of(near, "star"), percent), folder, "star-links")
    known = components(links, f"{folder}/star-components")
    # A head has been compared with all sets under its signature.
    others = weighted.join(heads.select("signature", "head"), "signature").where("node <> head")
    others = stored(others.select("signature", "node", "n", "own"), folder, "others")

    # Second step: sets of different components under a signature, by sketch, in blocks.
    def marked(blocks: DataFrame) -> DataFrame:
        mark = F.when(F.col("own"), F.col("own_mark")).otherwise(F.col("next_mark")).alias("mark")
        return blocks.join(sketches, "node").select(*blocks.columns, mark)

    late = _in_blocks(marked(_mixed_blocks(others, known, folder, "forest")), percent, "forest")
    late = stored(late, folder, "forest")
    if late.limit(1).count():
        true = stored(_linked(late, sets_of(late, "forest"), percent), folder, "forest-links")
        links = stored(links.union(true), folder, "links")
        known = components(links, f"{folder}/forest-components")
        if true.count() < late.count():
            # Third step: a wrong edge may hide a true one, so what is still close is compared whole.
            blocks = stored(_mixed_blocks(others, known, folder, "whole"), folder, "whole-blocks")
            doubtful = stored(_in_blocks(marked(blocks), percent, "doubtful"), folder, "doubtful")
            whole = sets_of(doubtful, "whole").select("node", F.col("packed").alias("mark"))
            true = stored(_in_blocks(blocks.join(whole, "node"), percent, "links"), folder, "whole-links")
            links = stored(links.union(true), folder, "all-links")
            known = components(links, f"{folder}/all-components")
    labels = known

    # The smallest id of every component, for nodes of several documents or with links.
    grouped = nodes.join(labels, "node", "left").where("times > 1 OR component IS NOT NULL")
    grouped = grouped.select("node", "least", F.coalesce("component", "node").alias("component"))
    grouped = stored(grouped, folder, "grouped")
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(stored(least, folder, "least"), "component").select("node", "component_id")
    named = stored(named, folder, "named")
    found = rows.select("id", "n", "node").join(named, "node", "left")
    return found.select(
        F.col("id").alias(id_column),
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
    )
