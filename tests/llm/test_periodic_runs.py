import hashlib
import random
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from oresmith.llm import periodic_runs
from oresmith.llm.queries import QUERIES


def brute(words, least=periodic_runs.MIN_LENGTH):
    """Every period tried at every place; the least period of a stretch counts."""
    n, found = len(words), {}
    for period in range(1, n // 2 + 1):
        i = 0
        while i + period < n:
            j = i
            while j + period < n and words[j] == words[j + period]:
                j += 1
            if j + period - i >= max(least, 2 * period):
                found.setdefault((i, j + period - i), period)
            i = max(j, i + 1)
    return sorted((start, length, period) for (start, length), period in found.items())


def made(choose):
    letters, words = choose.choice(["a", "ab", "ab", "abc", "abcdefgh"]), []
    while len(words) < choose.randint(1, 90):
        words += [choose.choice(letters) for _ in range(choose.randint(1, 14))] * choose.randint(1, 5)
    return words


@pytest.mark.parametrize("seed", range(5))
def test_runs_against_brute_force(seed):
    choose = random.Random(seed)
    for _ in range(400):
        words = made(choose)
        assert periodic_runs.find_runs([w.encode() for w in words]) == brute(words)


def test_automaton_finds_short_runs_too():
    """Without the islands, from runs of two words on."""
    choose = random.Random(9)
    for _ in range(400):
        words = made(choose)
        assert periodic_runs.runs_of_ids([ord(w) for w in words], 2) == brute(words, 2)


def test_long_runs():
    words = [b"%d" % (i % 777) for i in range(100_000)]
    assert periodic_runs.find_runs(words) == [(0, 100_000, 777)]
    assert periodic_runs.find_runs([b"x"] * 100_000) == [(0, 100_000, 1)]
    # Two stretches that share words have two runs.
    words = b"a b c d e f a b c d e f a b c d d e f a b c d d e f a b c d".split()
    assert periodic_runs.find_runs(words) == brute(words) != []


def result(doc, text):
    """The contract's columns by the definition."""
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    n, h = len(words), crc32(str(doc).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    longest = (best[1], -best[0], best[2], -best[0] * 1000 // best[2]) if best else (None,) * 4
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc, len(runs), *longest, *[hashlib.sha256(t.encode()).hexdigest() for t in (lines, kept)])


def test_query_against_brute_force(spark, tmp_path):
    choose = random.Random(1)
    rows = [(i, "\n\t ".join(made(choose)) + choose.choice(["", " ", "\n"])) for i in range(400)]
    rows += [(1000 + i, " ".join(f"w{choose.randrange(500)}" for _ in range(choose.randint(1, 60)))) for i in range(300)]
    rows += [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "é é " * 20), (2004, "x y z " * 9)]
    assert sum(crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 40
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == sorted(result(*row) for row in rows)


def test_odd_rows(spark, odd_docs):
    clashing = odd_docs.withColumn("runs", F.lit("x")).withColumn("n_words", F.lit(-1))
    found = clashing.select("*", periodic_runs.periodic_runs(F.col("text")).alias("found")).collect()
    assert len(found) == 8 and {r["runs"] for r in found} == {"x"}
    by_id = {r["doc_id"]: r["found"] for r in found}
    assert (by_id[2]["n_words"], by_id[2]["runs"], by_id[2]["collapsed"]) == (0, [], "")
    assert [tuple(run) for run in by_id[5]["runs"]] == [(0, 20_000, 1)] and by_id[5]["collapsed"] == "word"
    empty = clashing.where("false").select(periodic_runs.periodic_runs(F.col("text")))
    assert empty.count() == 0
