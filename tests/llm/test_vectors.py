import numpy as np
import pytest

from oresmith.llm import graph_dedup, permutation_index
from oresmith.llm.queries import QUERIES
from tests.conftest import SMALL


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, links string")


def brute_links(rows, cosine=0.98):
    usable = [i for i, (v, x, l) in enumerate(rows) if v is not None and l is not None and x is not None and all(c is not None and np.isfinite(c) for c in x) and any(x)]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for at, i in enumerate(usable):
        for j in usable[:at]:
            a, b = np.array(rows[i][1]), np.array(rows[j][1])
            if rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (v, _, _) in enumerate(rows):
        if v is not None:
            least[root(i)] = min(least.get(root(i), v), v)
    return [(v, links[i], least.get(root(i))) for i, (v, _, _) in enumerate(rows)]


def made_rows(copies=40, clusters=6, dim=16, noise=0.02, labels=2):
    choose, rows = np.random.default_rng(3), []
    for c in range(clusters):
        base = choose.normal(size=dim)
        for k in range(copies if c else 3 * copies):
            x = base + noise * choose.normal(size=dim)
            rows.append((len(rows), [float(v) for v in (base if k % 5 == 0 else x * (1 + k % 3))], c % labels))
    for _ in range(100):
        rows.append((len(rows), [float(v) for v in choose.normal(size=dim)], 0))
    return rows


@pytest.mark.parametrize("part", [2048, 64])
def test_links_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(graph_dedup, "PART", part)
    rows = made_rows()
    inf, nan = float("inf"), float("nan")
    odd = [None, [], [0.0] * 16, [1.0] + [None] * 15, [inf] * 16, [nan] * 16, [1.0, 2.0]]
    rows += [(900 + i, x, 0) for i, x in enumerate(odd)]
    rows += [(950, rows[0][1], None), (None, rows[0][1], 0), (951, rows[0][1], 5), (3, rows[3][1], rows[3][2])]
    found = graph_dedup.linked_vectors(frame(spark, [(*r, "x") for r in rows])).collect()
    got = sorted([(r["vec_id"], r["n_links"], r["component_id"]) for r in found], key=repr)
    assert got == sorted(brute_links(rows), key=repr)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in found)


def test_links_across_many_clusters(spark, monkeypatch):
    monkeypatch.setattr(graph_dedup, "TARGET", 32)
    choose, rows = np.random.default_rng(12), []
    for c in range(600):
        base = choose.normal(size=16)
        base /= np.linalg.norm(base)
        across = choose.normal(size=16)
        across -= (across @ base) * base
        angle = np.arccos(0.981)
        for x in (base, np.cos(angle) * base + np.sin(angle) * across / np.linalg.norm(across)):
            rows.append((len(rows), [float(v) for v in x], 0))
    found = graph_dedup.linked_vectors(frame(spark, [(*r, "x") for r in rows])).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == sorted(brute_links(rows))


def test_clusters_to_search_hold_every_partner():
    choose = np.random.default_rng(13)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centres, x = unit(choose.normal(size=(40, 8))), unit(choose.normal(size=(500, 8)))
    across = choose.normal(size=x.shape)
    across = unit(across - (across * x).sum(1, keepdims=True) * x)
    partners = 0.98 * x + np.sqrt(1 - 0.98**2) * across
    shards = graph_dedup.clusters_to_search(x, centres, 0.98)
    assert all(h in s for h, s in zip((partners @ centres.T).argmax(1), shards))
    assert np.mean([len(s) for s in shards]) < 20


def test_links_of_the_rarer_lengths(spark):
    rows = [(i, [float(v) for v in np.random.default_rng(i % 7).normal(size=3 + 2 * (i % 3 == 0))], i % 2) for i in range(60)]
    rows += [(100, [1e-200, 0.0], 0), (101, [1e200, 1e190], 0), (102, [0.0, 1.0], 0)]
    found = graph_dedup.linked_vectors(frame(spark, [(*r, "x") for r in rows])).collect()
    truth = brute_links([r for r in rows if r[0] < 100]) + [(100, 1, 100), (101, 1, 100), (102, 0, 102)]
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == sorted(truth)


def test_an_empty_table(spark):
    assert graph_dedup.linked_vectors(frame(spark, [])).count() == 0
    assert permutation_index.nearest(frame(spark, []), "id % 2 = 0").count() == 0


def test_robust_prune_keeps_the_nearest_and_drops_the_covered():
    x = np.array([[1, 0], [np.cos(0.1), np.sin(0.1)], [np.cos(0.11), np.sin(0.11)], [np.cos(-0.3), np.sin(-0.3)]])
    kept = graph_dedup.robust_prune(x, np.array([0]), np.array([[1, 2, 3]]), 3, 1.2)
    assert kept.tolist() == [[1, 3, -1]]


def test_range_search_spreads_through_a_chain():
    angles = np.concatenate([np.arange(40) * 0.05, np.linspace(2.4, 5.5, 60)])
    x = np.stack([np.cos(angles), np.sin(angles)], 1)
    found = graph_dedup.range_search(x, graph_dedup.shard_graph(x, 4, 8), graph_dedup.medoids(x), x, 0.98)
    truth = x @ x.T >= 0.98
    assert (found & truth).sum() == truth.sum()


def brute_nearest(rows, queries, k=20):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows])
    result = {}
    for q in queries:
        others = ids != q
        scores = x[others] @ x[ids == q][0]
        best = np.lexsort((ids[others], -scores))[:k]
        result[q] = list(zip(ids[others][best].tolist(), scores[best].tolist()))
    return result


def test_nearest_with_ties_and_odd_vectors(spark):
    rows = made_rows(copies=10, clusters=4)
    odd = [(900, None, 0), (920, [0.0] * 16, 0), (940, [float("nan")] * 16, 0), (None, rows[0][1], 0), (960, [1.0], 0)]
    found = permutation_index.nearest(frame(spark, [(*r, "x") for r in rows + odd]), "id % 20 = 0").collect()
    truth = brute_nearest(rows, [r[0] for r in rows if r[0] % 20 == 0])
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert {q: [v for v, _ in near] for q, near in got.items()} == {q: [v for v, _ in near] for q, near in truth.items()}
    assert all(np.allclose([s for _, s in got[q]], [s for _, s in truth[q]]) for q in truth)


def test_fewer_candidates_than_asked_for(spark):
    rows = [(i, [float(i), 1.0], 0, "x") for i in range(5)]
    found = permutation_index.nearest(frame(spark, rows), "id = 0").collect()
    assert sorted((r["rank"], r["vec_id"]) for r in found) == [(1, 1), (2, 2), (3, 3), (4, 4)]


def shapes(kind, n, dim):
    choose = np.random.default_rng(9)
    if kind == "clusters":
        return choose.normal(size=(50, dim))[choose.integers(0, 50, n)] + 0.3 * choose.normal(size=(n, dim))
    x = choose.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x * np.exp(choose.normal(size=(n, 1))) if kind == "lengths" else x


@pytest.mark.parametrize("kind", ["sphere", "lengths", "clusters"])
def test_recall_at_production_size(spark, kind):
    """10,000 vectors, several blocks: evenly spread, of very different lengths, in clusters."""
    x = shapes(kind, 10_000, 64)
    rows = [(i, [float(c) for c in v], 0, "x") for i, v in enumerate(x)]
    found = permutation_index.nearest(frame(spark, rows).repartition(8), "id % 200 = 0").collect()
    truth = brute_nearest(rows, range(0, 10_000, 200))
    hits = sum((r["vec_id"] in {v for v, _ in truth[r["query_id"]]}) for r in found)
    assert len(found) == 50 * 20 and hits >= 0.9 * len(found)
    scores = {(q, v): s for q, near in truth.items() for v, s in near}
    assert all(abs(r["score"] - scores[r["query_id"], r["vec_id"]]) < 1e-12 for r in found if (r["query_id"], r["vec_id"]) in scores)


def test_files_hold_what_they_should_and_agreement_is_the_footrule():
    choose = np.random.default_rng(4)
    x, pivots = choose.normal(size=(300, 8)), permutation_index.unit(choose.normal(size=(40, 8)))
    near = permutation_index.nearest_pivots(x, pivots, 6)
    assert [list(r) for r in near] == [list(np.argsort(-(permutation_index.unit(v[None])[0] @ pivots.T), kind="stable")[:6]) for v in x]
    files = permutation_index.InvertedFiles(near, 40)
    asked = near[7][:4]
    gain = files.agreement(asked)
    for row, held in enumerate(near):
        places = [list(held).index(p) if p in held else 6 for p in asked]
        assert gain[row] == sum(max(0, 6 - abs(place - at)) * (place < 6) for at, place in enumerate(places))
    # Rows that no file of the query holds are not touched.
    assert (gain == 0).sum() == sum(not set(held) & set(asked) for held in near) > 0


def test_other_lengths_are_searched_apart(spark):
    choose = np.random.default_rng(6)
    rows = [(i, [float(c) for c in choose.normal(size=3 if i % 3 else 5)], 0, "x") for i in range(60)]
    rows += [(100 + i, [10.0**e, -(10.0**e), 10.0**e], 0, "x") for i, e in enumerate((-300, -150, 150, 300))]
    found = permutation_index.nearest(frame(spark, rows), "id % 20 = 0", k=5).collect()
    for query in (0, 20, 40, 100):
        own = next(r for r in rows if r[0] == query)
        alike = [r for r in rows if len(r[1]) == len(own[1])]
        with np.errstate(over="ignore"):
            truth = brute_nearest(alike, [query], 5)[query]
        assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == query] == [v for v, _ in truth]


def test_queries_on_the_tables(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in table]
    found = QUERIES["op2_permutation_index"](spark, SMALL).collect()
    truth = brute_nearest(rows, [r[0] for r in rows if r[0] % 20 == 0])
    hits = sum(r["vec_id"] in {v for v, _ in truth[r["query_id"]]} for r in found)
    assert len(found) == sum(map(len, truth.values())) and hits >= 0.9 * len(found)
    links = QUERIES["op1_pruned_graph"](spark, SMALL).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in links) == sorted(brute_links(rows))
