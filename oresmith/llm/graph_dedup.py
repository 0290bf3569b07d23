"""Near-duplicate vectors by range search on a flat, robust-pruned graph.

Vectors are cut into overlapping shards: each goes to its nearest cluster, its home, and to the
next nearest. Within a shard, every vector gets its nearest others as candidates, of which robust
pruning keeps those that no kept one already covers; the lists of all shards are united per
vector. Then each vector is searched for in every shard that can be the home of a vector
within range, by its place between the centres, and each find counts at its home only: a greedy
search from the shard's medoids walks towards the vector, and around what is in range the search
spreads until it meets nothing new. A sample of every search is audited against a comparison with
the whole shard; where too little was found, that shard is compared exhaustively. As no other
shard can hold a partner's home, these audits together cover all rows of a label. What is found
is verified in double precision.

Exactly equal vectors of a label are one node with a count. A shard that outgrows its bound is
dealt into disjoint parts by a hash, and its queries into blocks; each block is searched for in
every part and the counts add up, so a group of near copies of any size never meets in one task
and no pair leaves a task: a task returns counts and one root per vector of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oresmith.llm.common import components, step_folder, stored
from oresmith.llm.vectors import sample_matrices, stacked, unit, usable_vectors

COSINE = 0.98
TARGET = 8192  # vectors per cluster, over all labels
PART = 2048  # vectors of one label in one part of a shard, and queries in one block
CLUSTERS, CLUSTER_SAMPLE = 1024, 20_000
OVERLAP = 2
DEGREE, FAR, CANDIDATES, ALPHA = 24, 2, 48, 1.2
BEAM = 32
AUDITED, RECALL = 32, 0.97


# ---------------------------------------------------------------- clusters


def cluster_centres(sample: np.ndarray, clusters: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on a bounded sample of unit vectors; no more centres than vectors."""
    centres = sample[np.linspace(0, len(sample) - 1, min(clusters, len(sample))).astype(int)]
    for _ in range(rounds):
        nearest = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def clusters_to_search(unit: np.ndarray, centres: np.ndarray, cosine: float) -> list[np.ndarray]:
    """For each unit vector its OVERLAP nearest clusters, nearest first, then all others that can be home of a partner.

    A partner p whose home is c lies no further from c than from the vector's own centre o, so
    p (c - o) is not negative; over all p within range its largest value is that of a p on the
    border of the range, in the plane of the vector and c - o.
    """
    gram, squares = centres @ centres.T, np.einsum("cd,cd->c", centres, centres)
    chosen = []
    for part in _slices(unit, 1024):
        sims = part @ centres.T
        order = np.argsort(-sims, axis=1, kind="stable")
        home = order[:, 0]
        along = sims - sims[np.arange(len(part)), home][:, None]
        across = np.sqrt(np.maximum(squares + squares[home][:, None] - 2 * gram[home] - along**2, 0))
        within = cosine * along + np.sqrt(max(1 - cosine**2, 0)) * across >= -1e-9
        taken = np.take_along_axis(within, order, 1)
        taken[:, :OVERLAP] = True
        chosen += [o[t].astype(np.int32) for o, t in zip(order, taken)]
    return chosen


# ---------------------------------------------------------------- graph of one shard


def robust_prune(x: np.ndarray, rows: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` of each row's candidates (nearest first, -1 for none), -1 where fewer.

    The nearest candidate left is kept, and drops all others that are ``alpha`` times nearer to
    it than to the row.
    """
    held = np.where(candidates < 0, rows[:, None], candidates)
    vectors = x[held]
    to_row = np.sqrt(np.maximum(2 - 2 * np.einsum("ncd,nd->nc", vectors, x[rows]), 0))
    alive = candidates >= 0
    kept = np.full((len(rows), degree), -1, dtype=np.int64)
    line = np.arange(len(rows))
    for step in range(degree):
        first = alive.argmax(1)
        some = alive[line, first]
        if not some.any():
            break
        kept[:, step] = np.where(some, candidates[line, first], -1)
        to_kept = np.sqrt(np.maximum(2 - 2 * np.einsum("ncd,nd->nc", vectors, vectors[line, first]), 0))
        alive &= alpha * to_kept > to_row
        alive[line, first] = False
    return kept


def shard_graph(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> np.ndarray:
    """Neighbour rows of every row: pruned, with every edge in both directions, -1 where fewer."""
    n = len(x)
    if n == 1:
        return np.full((1, 1), -1, dtype=np.int64)
    near = min(candidates, n - 1)
    kept = []
    for start in range(0, n, 512):
        rows = np.arange(start, min(start + 512, n))
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = -np.inf
        best = np.argpartition(-sims, near - 1, axis=1)[:, :near]
        order = np.argsort(-np.take_along_axis(sims, best, 1), axis=1, kind="stable")
        kept.append(robust_prune(x, rows, np.take_along_axis(best, order, 1), degree, alpha))
    # A few random edges, as in the random graph that such builds start from, connect far parts.
    far = np.random.default_rng(n).integers(0, n - 1, (n, FAR))
    far += far >= np.arange(n)[:, None]
    forward = np.concatenate([np.concatenate(kept), far], 1)
    source = np.repeat(np.arange(n), forward.shape[1])
    target = forward.ravel()
    source, target = source[target >= 0], target[target >= 0]
    both = np.unique(np.concatenate([source * n + target, target * n + source]))
    source, target = both // n, both % n
    sims = np.einsum("ed,ed->e", x[source], x[target])
    order = np.lexsort((-sims, source))
    source, target = source[order], target[order]
    place = np.arange(len(source)) - np.searchsorted(source, source, "left")
    most = 2 * (degree + FAR)
    within = place < most
    graph = np.full((n, most), -1, dtype=np.int64)
    graph[source[within], place[within]] = target[within]
    return graph


def medoids(x: np.ndarray, count: int = 8) -> np.ndarray:
    """The rows nearest to the mean of all and to the means of ``count`` slices."""
    means = [x.mean(0)] + [x[i::count].mean(0) for i in range(min(count, len(x)))]
    return np.unique((x @ np.array(means).T).argmax(0))


def range_search(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, queries: np.ndarray, cosine: float, beam: int = BEAM) -> np.ndarray:
    """found[q, row]: rows within range of each query that greedy search and spreading meet."""
    n, q = len(x), len(queries)
    width = min(beam, n)
    line = np.arange(q)[:, None]
    visited, found = np.zeros((q, n), dtype=bool), np.zeros((q, n), dtype=bool)
    # A little below the range still counts while spreading, so a thin spot does not end it.
    spread = cosine - 0.1

    at = np.broadcast_to(starts, (q, len(starts)))
    sims = queries @ x[starts].T
    visited[:, starts] = True
    found[:, starts] = sims >= spread
    nodes = np.full((q, width), -1, dtype=np.int64)
    values = np.full((q, width), -np.inf, dtype=x.dtype)
    opened = np.ones((q, width), dtype=bool)
    fresh_nodes, fresh_values = at, sims
    for _ in range(4 * beam):
        all_nodes = np.concatenate([nodes, fresh_nodes], 1)
        all_values = np.concatenate([values, fresh_values], 1)
        all_opened = np.concatenate([opened, fresh_nodes < 0], 1)
        order = np.argsort(-all_values, axis=1, kind="stable")[:, :width]
        nodes, values = all_nodes[line, order], all_values[line, order]
        opened = all_opened[line, order] | (nodes < 0)
        first = (~opened).argmax(1)
        some = ~opened[line[:, 0], first]
        if not some.any():
            break
        opened[line[:, 0], first] = True
        around = np.where(some[:, None], graph[nodes[line[:, 0], first]], -1)
        around = np.where((around >= 0) & ~visited[line, around], around, -1)
        visited[np.broadcast_to(line, around.shape)[around >= 0], around[around >= 0]] = True
        sims = np.einsum("qcd,qd->qc", x[around], queries)
        sims = np.where(around >= 0, sims, -np.inf)
        hit = sims >= spread
        found[np.broadcast_to(line, around.shape)[hit], around[hit]] = True
        fresh_nodes, fresh_values = around, sims

    border = np.flatnonzero(found)
    while len(border):
        following = []
        for part in np.array_split(border, max(1, len(border) // 20_000)):
            query, node = part // n, part % n
            around = graph[node]
            key = (query[:, None] * n + around)[around >= 0]
            key = np.unique(key[~visited.ravel()[key]])
            visited.ravel()[key] = True
            near = np.einsum("ed,ed->e", x[key % n], queries[key // n]) >= spread
            following.append(key[near])
        border = np.concatenate(following)
        found.ravel()[border] = True
    return found


# ---------------------------------------------------------------- links of one part of a shard


def _verified(exact: np.ndarray, queries: np.ndarray, pairs: np.ndarray, n: int, cosine: float) -> np.ndarray:
    """The pairs (query * n + row) whose cosine, of the original vectors, reaches the bound."""
    kept = []
    # Scaled by powers of two, which changes no digit, so squares neither overflow nor vanish.
    exact, queries = (np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) for x in (exact, queries))
    lengths = np.sqrt(np.einsum("nd,nd->n", exact, exact)), np.sqrt(np.einsum("nd,nd->n", queries, queries))
    for part in np.array_split(pairs, max(1, len(pairs) // 100_000)):
        q, row = part // n, part % n
        dots = np.einsum("ed,ed->e", queries[q], exact[row])
        kept.append(part[dots / (lengths[1][q] * lengths[0][row]) >= cosine])
    return np.concatenate(kept)


def _roots_of_links(query_ids: np.ndarray, ids: np.ndarray, q: np.ndarray, row: np.ndarray) -> list[tuple[int, int]]:
    """(node, root) for every end of the links (q[i], row[i]); as many as there are ends."""
    of_query, of_row = query_ids.copy(), ids.copy()
    while True:
        before = of_row.copy()
        np.minimum.at(of_query, q, of_row[row])
        np.minimum.at(of_row, row, of_query[q])
        if (of_row == before).all():
            break
    asking, rows = np.unique(q), np.unique(row)
    nodes = np.concatenate([query_ids[asking], ids[rows]]).tolist()
    return list(zip(nodes, np.concatenate([of_query[asking], of_row[rows]]).tolist()))


def _links(members: pd.DataFrame, queries: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """(id, links, root) for the queries and the members they link with, in one part of a shard.

    ``links`` counts the other vectors within range that are at home here, copies included;
    ``root`` joins those that links of this part connect. Vectors without any are left out.
    """
    members = members.sort_values("id", kind="stable")
    ids, times = members["id"].to_numpy(np.int64), members["times"].to_numpy(np.int64)
    home = members["home"].to_numpy(bool)
    exact, asked = stacked(members["vector"]), stacked(queries["vector"])
    query_ids = queries["id"].to_numpy(np.int64)
    scaled, scaled_asked = unit(exact).astype(np.float32), unit(asked).astype(np.float32)

    n = len(ids)
    lists = [np.asarray(a, dtype=np.int64) for a in members["neighbours"]]
    graph = np.full((n, max(1, max(map(len, lists)))), -1, dtype=np.int64)
    for row, neighbours in enumerate(lists):
        place = np.searchsorted(ids, neighbours)
        place[place == n] = 0
        here = place[ids[place] == neighbours]
        graph[row, : len(here)] = here

    audited = np.linspace(0, len(asked) - 1, min(AUDITED, len(asked))).astype(int)
    starts = medoids(scaled)
    searched = [range_search(scaled, graph, starts, part, cosine) for part in _slices(scaled_asked)]
    # A query's own row, which every search finds, says nothing.
    truth = (scaled_asked[audited] @ scaled.T >= cosine) & (query_ids[audited][:, None] != ids[None, :])
    seen = np.concatenate([np.zeros((0, n), bool), *searched])[audited] if len(searched) else truth
    exhaustive = (truth & seen).sum() < RECALL * truth.sum()

    counts = np.zeros(len(asked), dtype=np.int64)
    parent = {int(i): int(i) for i in query_ids}

    def root(node: int) -> int:
        while parent[node] != node:
            parent[node] = parent[parent[node]]
            node = parent[node]
        return node

    first = 0
    for part, found in zip(_slices(scaled_asked), searched):
        hits = (part @ scaled.T >= cosine - 1e-4) if exhaustive else found
        pairs = np.flatnonzero(hits & home)
        pairs = _verified(exact, asked[first : first + len(part)], pairs, n, cosine)
        q, row = pairs // n + first, pairs % n
        other = ids[row] != query_ids[q]
        q, row = q[other], row[other]
        np.add.at(counts, q, times[row])
        for a, b in _roots_of_links(query_ids, ids, q, row):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        first += len(part)
    of_query = dict(zip(query_ids.tolist(), counts.tolist()))
    nodes = [i for i in parent if of_query.get(i, 0) or root(i) != i]
    return pd.DataFrame(
        {"id": nodes, "links": [of_query.get(i, 0) for i in nodes], "root": [root(i) for i in nodes]}
    ).astype("int64")


def _slices(rows: np.ndarray, size: int = 256) -> list[np.ndarray]:
    return [rows[i : i + size] for i in range(0, len(rows), size)]


# ---------------------------------------------------------------- all vectors


def linked_vectors(
    df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
    cosine: float = COSINE,
) -> DataFrame:
    """id, n_links, component_id, kept for every row of ``df``.

    Two vectors are linked when their labels are equal and not NULL and their cosine is at least
    ``cosine``. Vectors that are NULL, zero or hold NULL or non-finite components are linked with
    nothing, like rows without a label; vectors of different numbers of components are not linked
    with each other and have clusters of their own. ``component_id`` is the
    smallest id that links reach and ``kept`` says whether it is the row's own. Rows that repeat
    an id are vectors of their own in the counts. Rows without an id get no links.
    """
    spark = df.sparkSession
    folder = step_folder(spark, "graph-dedup")
    rows = df.select(F.col(id_column).alias("vid"), F.col(vector_column).alias("vector"), F.col(label_column).alias("label"))
    # A node is a label with a vector; its number is a hash of both.
    labelled = F.col("vid").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
    rows = rows.withColumn("node", F.when(labelled, F.xxhash64("label", "vector")))
    copies = rows.where("node IS NOT NULL").groupBy("node").agg(
        F.min("vid").alias("vec"), F.count(F.lit(1)).alias("times"), F.first("label").alias("label"), F.first("vector").alias("vector")
    )
    copies = stored(copies, folder, "copies")
    good = usable_vectors(copies, "node", "vector")
    known = copies.select(F.col("node").alias("id"), "vec", "times", F.col("label").alias("of"))
    nodes = good.join(known, "id").withColumn("label", F.concat_ws(":", "length", F.col("of").cast("string"))).drop("of")
    nodes = stored(nodes, folder, "nodes")

    totals = {r["length"]: r["count"] for r in nodes.groupBy("length").count().collect()}
    centres = {
        length: cluster_centres(unit(sample), min(CLUSTERS, -(-totals[length] // TARGET)))
        for length, sample in sample_matrices(nodes, CLUSTER_SAMPLE).items()
    }

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length, rows in batch.groupby(batch["vector"].map(len)):
                shards = clusters_to_search(unit(stacked(rows["vector"])), centres[length], cosine)
                yield pd.DataFrame({"id": rows["id"].to_numpy(), "shards": shards})

    places = nodes.select("id", "vector").mapInPandas(placed, "id long, shards array<int>")
    places = stored(places, folder, "places")
    held_in = F.posexplode(F.slice("shards", 1, OVERLAP)).alias("nearness", "shard")
    dealt = nodes.join(places, "id").select("id", "vector", "label", "times", held_in)
    dealt = stored(dealt.withColumn("home", F.col("nearness") == 0).drop("nearness"), folder, "dealt")
    searched_in = nodes.select("id", "label").join(places, "id").select("id", "label", F.explode("shards").alias("shard"))
    # One row for each label and cluster.
    sizes = dealt.groupBy("label", "shard").agg(F.count(F.lit(1)).alias("held"), F.sum(F.col("home").cast("int")).alias("at_home"))
    asking = searched_in.groupBy("label", "shard").agg(F.count(F.lit(1)).alias("asking"))
    sizes = sizes.join(asking, ["label", "shard"])
    sizes = sizes.select(
        "label",
        "shard",
        F.ceil(F.col("held") / PART).cast("int").alias("parts"),
        F.ceil(F.col("asking") / PART).cast("int").alias("blocks"),
        "at_home",
    )
    sizes = stored(sizes, folder, "sizes")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
    members = stored(dealt.join(sizes.drop("at_home"), ["label", "shard"]).select("*", part), folder, "members")

    def built(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        x = stacked(group["vector"])
        ids = group["id"].to_numpy(np.int64)
        graph = shard_graph(unit(x).astype(np.float32))
        return pd.DataFrame({"id": ids, "neighbours": [ids[g[g >= 0]] for g in graph]})

    lists = members.select("id", "vector", "label", "shard", "part").groupBy("label", "shard", "part")
    lists = lists.applyInPandas(built, "id long, neighbours array<long>")
    united = lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))
    united = stored(united, folder, "graph")

    key = ["label", "shard", "part", "block"]
    every_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    every_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    own_block = F.pmod(F.xxhash64(F.lit(3), "id"), F.col("blocks")).cast("int").alias("block")
    held = members.join(united, "id").select("label", "shard", "part", every_block, "id", "vector", "times", "home", "neighbours")
    asked = searched_in.join(sizes.where("at_home > 0"), ["label", "shard"])
    asked = asked.join(nodes.select("id", "vector"), "id").select("label", "shard", every_part, own_block, "id", "vector")
    asked = asked.toDF(*asked.columns)

    def searched(group: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(queries):
            return pd.DataFrame({"id": [], "links": [], "root": []}).astype("int64")
        return _links(group, queries, cosine)

    found = held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(searched, "id long, links long, root long")
    found = stored(found, folder, "found")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    edges = found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct()
    joined = components(edges, folder)

    # From nodes back to rows: copies link with each other and with all that their node links with.
    told = nodes.select("id", "vec", "times").join(links, "id", "left")
    told = told.join(joined.withColumnRenamed("node", "id"), "id", "left")
    told = told.select(
        "vec",
        F.col("id").alias("node"),
        F.coalesce("component", "id").alias("component"),
        (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"),
    )
    told = stored(told, folder, "told")
    least = stored(told.groupBy("component").agg(F.min("vec").alias("component_id")), folder, "least")
    named = told.where("n_links > 0").join(least, "component").select("node", "n_links", "component_id")
    result = rows.select("vid", "node").join(stored(named, folder, "named"), "node", "left")
    return result.select(
        F.col("vid").alias(id_column),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vid").alias("component_id"),
        F.coalesce(F.col("vid") == F.coalesce("component_id", "vid"), F.lit(False)).alias("kept"),
    )
