import random

import pytest
from pyspark.sql import functions as F

from oresmith.llm import exact_dedup
from oresmith.llm.queries import QUERIES


def brute(rows):
    """(id, keep_id, group_size) per row, and how many rows of each (id, text) group stay."""
    groups = {}
    for doc, text in rows:
        groups.setdefault(text or "", []).append(doc)
    keep = {t: max((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    return sorted(((d, keep[t or ""], len(groups[t or ""])) for d, t in rows), key=repr), len(groups)


def few_digests(text):
    """A digest that stands for many texts."""
    return F.unhex(F.md5(F.substring(text, 1, 1)))


@pytest.mark.parametrize("hot", [3, 1000])
@pytest.mark.parametrize("digest", [exact_dedup.sha256_digest, few_digests])
def test_against_brute_force(spark, hot, digest):
    choose = random.Random(hot)
    texts = ["".join(choose.choice("ab \n") for _ in range(choose.randint(0, 4))) for _ in range(80)]
    texts += ["a third of all rows"] * 60 + [None, "", " ", "É", "é", "é"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(None, "a third of all rows"), (None, "only without an id"), (None, "only without an id"), (3, texts[3])]
    choose.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = exact_dedup.exact_groups(frame, "doc_id", "text", digest, hot).collect()
    expected, groups = brute(rows)
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"]) for r in found], key=repr) == expected
    kept = [r for r in found if r["kept"]]
    assert len(kept) == groups and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_long_texts_that_differ_at_the_end(spark):
    long = "word " * 100_000
    rows = [(1, long), (2, long + "x"), (3, long), (4, long + "y")]
    found = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", few_digests)
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in found.collect()) == [
        (1, 3, False), (2, 2, True), (3, 3, True), (4, 4, True)
    ]


def test_normalised_text(spark):
    frame = spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "a c")], "id long, body string")
    found = exact_dedup.exact_groups(frame, "id", F.lower("body"))
    assert sorted((r["id"], r["keep_id"]) for r in found.collect()) == [(1, 2), (2, 2), (3, 3)]


def test_odd_rows_keep_their_columns(spark, odd_docs):
    clashing = odd_docs.selectExpr("*", "'x' AS digest", "1 AS row", "2 AS n", "3 AS key", "4 AS keep_id")
    assert exact_dedup.exact_groups(clashing, "doc_id", "text").count() == 8
    left = exact_dedup.without_copies(clashing, "doc_id", "text")
    assert left.columns == clashing.columns
    # NULL and empty texts are equal; a row without an id goes where another has one.
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3, 4, 5, 6]
    assert exact_dedup.without_copies(clashing.where("false"), "doc_id", "text").count() == 0


def test_frequent_digests_stay_few(spark, monkeypatch):
    """The bound of "many" grows with the table, so what is broadcast does not."""
    monkeypatch.setattr(exact_dedup, "MOST_HOT", 2)
    rows = [(i, f"text {i % 20}") for i in range(100)]
    found = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", hot=3)
    assert {(r["group_size"], r["keep_id"] % 20 == r["doc_id"] % 20) for r in found.collect()} == {(5, True)}
    assert found.where("kept").count() == 20


def test_no_python_in_the_plan(spark, odd_docs):
    plan = exact_dedup.exact_groups(odd_docs, "doc_id", "text")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert "op12_salted_exact_dedup" in QUERIES
