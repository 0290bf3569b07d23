"""Scores of predicates, keys and references, several kinds on one table."""

import pytest

from oresmith.operators.references import Reference
from oresmith.plans import queries
from oresmith.quality.metrics import rule_scores
from oresmith.rules.catalog import RULES
from oresmith.rules.model import Rule

from conftest import SMALL

RULE_SET = [
    Rule("a_key", "silver_t", "G", "a IS NOT NULL", "EXPECT", "HIGH"),
    Rule("a_once", "silver_t", "G", "duplicate(a)", "MONITOR", "LOW", kind="duplicate", columns=("a",)),
    Rule("ab_once", "silver_t", "G", "duplicate(a, b)", "MONITOR", "LOW", kind="duplicate", columns=("a", "b")),
    Rule("c_once", "silver_t", "G", "duplicate(c)", "MONITOR", "LOW", kind="duplicate", columns=("c",)),
    Rule("positive", "silver_t", "G", "b > 0", "EXPECT", "HIGH"),
    Rule("refers", "silver_t", "G", "foreign_key(c)", "OBSERVE", "LOW", kind="foreign_key", columns=("c",)),
]


def scores(df, references=()):
    found = rule_scores({"silver_t": df}, references, rules=RULE_SET).collect()
    return {r.rule_id: (r.rule_status, r.violating_rows, r.matching_rows) for r in found}


def test_every_kind_on_one_table(spark):
    rows = [(1, 1, 7), (1, 1, 8), (1, 2, 9), (None, 3, 7), (None, 3, None), (2, None, 5), (3, -1, 5)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    keys = spark.createDataFrame([(7,), (8,), (5,)], "k int")
    assert scores(df, [Reference("c", keys, "k", "c_ok")]) == {
        "a_key": ("FAIL", 2, 5),
        "a_once": ("FAIL", 3, 4),  # missing keys count as equal
        "ab_once": ("FAIL", 2, 5),
        "c_once": ("FAIL", 2, 5),
        "positive": ("FAIL", 2, 5),  # NULL is not positive
        "refers": ("FAIL", 1, 6),  # a missing key may be
    }
    required = scores(df, [Reference("c", keys, "k", "c_ok", required=True)])
    assert required["refers"] == ("FAIL", 2, 5)


def test_an_empty_table_passes(spark):
    keys = spark.createDataFrame([], "k int")
    empty = scores(spark.createDataFrame([], "a int, b int, c int"), [Reference("c", keys, "k", "c_ok")])
    assert set(empty.values()) == {("PASS", 0, 0)}


def test_the_whole_catalog_has_a_score(raw_star):
    tables = {**raw_star.bronze, **raw_star.silver, **raw_star.gold}
    found = rule_scores(tables, raw_star.references).collect()
    assert sorted(r.rule_id for r in found) == sorted(r.rule_id for r in RULES) and len(found) == 37
    assert {r.rule_kind for r in found} == {"predicate", "duplicate", "foreign_key"}


@pytest.mark.parametrize(
    ("query", "fact"),
    [
        ("silver_issues", set()),
        ("expectation_counts", set()),
        ("rule_status", set()),
        ("gold_issues", {"silver_store_sales"}),
        ("rule_scores", {"annotated_sales"}),
    ],
)
def test_the_fact_is_stored_only_where_several_branches_read_it(spark, monkeypatch, query, fact):
    names = []

    def recorded(df, folder, name):
        names.append(name)
        return df

    monkeypatch.setattr(queries, "stored", recorded)
    queries.QUERIES[query](spark, SMALL)
    assert {n for n in names if n.endswith("_sales")} == fact
