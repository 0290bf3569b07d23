import random
import re
from itertools import combinations

import numpy as np
import pytest

from oresmith.llm import partenum


def brute(docs, percent=90, width=3):
    sets = []
    for _, text in docs:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lower)
        runs = range(max(1, len(words) - width + 1))
        sets.append({tuple(words[i : i + width]) for i in runs} if words else set())
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(range(len(docs)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            parent[root(a)] = root(b)
    ids = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            ids[root(i)] = min(ids.get(root(i), doc), doc)
    return sorted([(doc, len(sets[i]), ids.get(root(i))) for i, (doc, _) in enumerate(docs)], key=repr)


def families(seed, sizes, copies, edits):
    choose, docs = random.Random(seed), []
    words = [f"w{i}" for i in range(400)]
    for size in sizes:
        base = [choose.choice(words) for _ in range(size)]
        for _ in range(copies):
            text = list(base)
            for _ in range(choose.choice(edits)):
                text[choose.randrange(len(text))] = choose.choice(words)
            if choose.random() < 0.3:
                text.append(choose.choice(words))
            docs.append((7 * len(docs) % 1009, " ".join(text)))
    return docs


def got(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    return sorted([tuple(r) for r in partenum.jaccard_components(frame, "doc_id", "text").collect()], key=repr)


def test_small_and_large_sets(spark):
    docs = families(5, [1, 2, 3, 5, 9, 12, 13, 30, 80, 200], 9, [0, 0, 1, 1, 2, 3])
    docs += [(2001, None), (2002, ""), (2003, " \n "), (2004, "Ünï Code TEXT"), (2005, "Ünï code text"), (2006, "ünï code text")]
    assert got(spark, docs) == brute(docs)


def test_a_family_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(partenum, "_BLOCK", 16)
    docs = families(6, [140], 120, [0, 1, 2, 3, 4, 5, 6])
    assert got(spark, docs) == brute(docs)


def test_joins_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(partenum, "_FEW", 0)
    docs = families(7, [20, 60], 6, [0, 1, 2])
    assert got(spark, docs) == brute(docs)


def near_pairs(percent, seed, times=300):
    """Pairs of sets around the bound, with all signatures of each by band."""
    choose = np.random.default_rng(seed)
    for _ in range(times):
        n = int(choose.integers(5, 400))
        most = n * (100 - percent) // 150 + 1
        a = np.unique(choose.integers(0, 1 << 63, n, dtype=np.uint64))
        new = choose.integers(0, 1 << 63, int(choose.integers(0, most)), dtype=np.uint64)
        b = np.unique(np.concatenate([a[int(choose.integers(0, most)) :], new]))
        common = len(np.intersect1d(a, b))
        if 100 * common >= percent * (len(a) + len(b) - common) and not np.array_equal(a, b):
            bands = [partenum.band_of(len(s), percent) for s in (a, b)]
            yield [{band + i: partenum.signatures(s, band + i, percent) for i in (0, 1)} for s, band in zip((a, b), bands)]


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_share_signatures(percent):
    """As many as the bound says, under the band of the larger set; the lowest bit tells the band."""
    pairs = list(near_pairs(percent, percent))
    assert len(pairs) > 50
    for a, b in pairs:
        band = max(set(a) & set(b)) if max(a) != max(b) else min(a)
        shared = set(a[band].tolist()) & set(b[band].tolist())
        assert len(shared) > partenum.to_spare(band, percent) >= 0
        assert all(s % 2 == band % 2 for s in shared)


def test_signatures_are_subsets_of_several_parts():
    values = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    band = partenum.band_of(len(values), 80)
    k, found = partenum.band_bound(band, 80), partenum.signatures(values, band, 80)
    groups = partenum.groups_of(k)
    assert len(found) == len(set(found.tolist())) == groups * 3
    # A change of one shingle changes two of the three subsets of its group.
    changed = partenum.signatures(values[1:], band, 80)
    assert len(set(found.tolist()) - set(changed.tolist())) == 2


@pytest.mark.parametrize("groups", [1, 2, 5])
def test_least_shared_by_trying(groups):
    """Every way to spread k differences over the parts of the groups."""
    from itertools import product

    def shared(spread):
        of_group = [spread[3 * g : 3 * g + 3] for g in range(groups)]
        return sum(sum(not (x or y) for x, y in combinations(parts, 2)) for parts in of_group)

    for spread in product([0, 1], repeat=3 * min(groups, 3)):
        if groups <= 3:
            assert shared(spread) >= partenum.least_shared(sum(spread), groups)
    for k in range(2 * groups):
        worst = [0] * (3 * groups)
        for at in [3 * g for g in range(groups)][:k] + [3 * g + 1 for g in range(groups)][: max(0, k - groups)]:
            worst[at] = 1
        assert shared(worst) == partenum.least_shared(k, groups)


def test_rows_of_shared_signatures_across_batches():
    import pyarrow as pa

    choose = random.Random(3)
    for _ in range(200):
        rows = sorted((choose.randrange(6), choose.randrange(3)) for _ in range(choose.randint(0, 20)))
        batches, at = [], 0
        while at < len(rows):
            size = choose.randint(0, 4)
            part = rows[at : at + size]
            batches.append(pa.RecordBatch.from_pydict({"signature": pa.array([r[0] for r in part], pa.int64()), "node": pa.array([r[1] for r in part], pa.int64())}))
            at += size
        found = [tuple(r.values()) for b in partenum._shared_rows(iter(batches)) for r in b.to_pylist()]
        several = {s for s in range(6) if len({n for x, n in rows if x == s}) > 1}
        assert found == sorted({r for r in rows if r[0] in several})


def test_wrong_edges_by_sketch_hide_no_link(spark, monkeypatch):
    """With sketches that tell nothing apart, what is close by sketch is mostly wrong."""
    monkeypatch.setattr(partenum, "_BITS", 1)
    monkeypatch.setattr(partenum, "_BLOCK", 4)
    docs = families(9, [40, 40, 90, 150], 14, [0, 2, 4, 6, 9])
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = partenum.jaccard_components(frame, "doc_id", "text", percent=80, width=2).collect()
    assert sorted([tuple(r) for r in rows], key=repr) == brute(docs, 80, 2)


def test_chains_of_copies(spark, monkeypatch):
    """Each text is near the one before only, so no text is near the most central one's copies."""
    monkeypatch.setattr(partenum, "_BLOCK", 8)
    choose, words = random.Random(4), [f"v{i}" for i in range(3000)]
    text, docs = [choose.choice(words) for _ in range(150)], []
    for i in range(60):
        for _ in range(3):
            text[choose.randrange(150)] = choose.choice(words)
        docs.append((i, " ".join(text)))
    assert got(spark, docs) == brute(docs)


def test_a_sketch_never_overstates_the_difference():
    choose = np.random.default_rng(2)
    for _ in range(100):
        a = np.unique(choose.integers(0, 1 << 63, 100, dtype=np.uint64))
        b = np.unique(np.concatenate([a[10:], choose.integers(0, 1 << 63, 7, dtype=np.uint64)]))
        x, y = (np.frombuffer(partenum.sketch(s, 30, 90), np.uint8) for s in (a, b))
        assert (x != y).sum() <= len(np.setxor1d(a, b))


def test_a_sketch_is_small_and_tells_other_sets_apart():
    choose = np.random.default_rng(4)
    for n, percent in [(1757, 80), (1757, 90), (100, 80)]:
        band = partenum.band_of(n, percent)
        a, b = (np.frombuffer(partenum.sketch(np.unique(choose.integers(0, 1 << 63, n, dtype=np.uint64)), band, percent), np.uint8) for _ in "ab")
        assert len(a) <= max(8, partenum.band_bound(band, percent) / 2 + 1)
        assert np.bitwise_count(a ^ b).sum(dtype=int) > partenum.most_different(2 * n, percent)


def test_five_words_and_four_fifths(spark, monkeypatch):
    docs = families(8, [5, 12, 30, 80, 200], 12, [0, 1, 2, 3, 4])
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(partenum, "_BLOCK", 4)
    rows = partenum.jaccard_components(frame, "doc_id", "text", percent=80, width=5).collect()
    assert sorted([tuple(r) for r in rows], key=repr) == brute(docs, 80, 5)


def test_odd_rows(spark, odd_docs):
    rows = partenum.jaccard_components(odd_docs, "doc_id", "text").collect()
    found = sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows], key=repr)
    assert found == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 1, 5), (6, 1, 6)], key=repr)
    assert partenum.jaccard_components(odd_docs.where("false"), "doc_id", "text").count() == 0


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(60)], [(5, 5), (3, 9), (9, 4), (8, 7)], [(0, i) for i in range(1, 40)]])
def test_components(spark, edges, tmp_path):
    from oresmith.llm.common import components

    frame = spark.createDataFrame(edges, "a long, b long")
    found = {r["node"]: r["component"] for r in components(frame, str(tmp_path)).collect()}
    least = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in edges:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert found == least
