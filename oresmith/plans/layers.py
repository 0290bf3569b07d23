"""The layer jobs: bronze, silver, gold and quality tables, ordered by what they read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, Observation

from oresmith.operators.references import counted
from oresmith.plans import gold, silver
from oresmith.plans.bronze import SOURCES, bronze_ingest
from oresmith.plans.contracts import cast_failure_report
from oresmith.quality.enforce import expectation_report, monitor_report, monitored
from oresmith.quality.issues import issues
from oresmith.quality.metrics import (
    bronze_metrics,
    bronze_observability,
    gold_metrics,
    gold_observability,
    rule_status,
)
from oresmith.rules.catalog import GOLD_ISSUES, SILVER_ISSUES, catalog_frame, expectations
from oresmith.rules.model import DECLARATIVE
from oresmith.sources.tables import Buckets, Builder, TableSpace, run_layer

SILVER_TABLES = ("silver_date_dim", "silver_item", "silver_store", "silver_customer", "silver_store_sales")
GOLD_TABLES = (
    "gold_dim_date",
    "gold_dim_item",
    "gold_dim_store",
    "gold_dim_customer",
    "gold_fact_store_sales",
    "gold_top_items_month",
)
COMMENTS = {
    **{name: f"Raw rows of {source} with lineage" for name, source in SOURCES.items()},
    **{name: "Typed, cleaned, deduplicated and validated rows" for name in SILVER_TABLES},
    **{name: "Business names and derived measures" for name in GOLD_TABLES},
    "dq_store_sales_quarantine": "Fact rows kept out of silver, one row per broken rule",
    "dq_rule_catalog": "Rules of all layers",
    "dq_dimension_rejects": "Dimension rows kept out of silver, with the rules they break",
    "dq_cast_failures": "Values that do not fit their types, counted per column",
    "dq_silver_dropped": "Rows that pass and fail each enforced rule, counted before enforcement",
}
ANNOTATED = "staging_store_sales_annotated"


def staged(silver_table: str) -> str:
    """The table of a dimension's latest rows before its rules."""
    return silver_table.replace("silver_", "staging_", 1)


def bronze_builders(sources: Mapping[str, DataFrame], loaded_at: str | None = None) -> dict[str, Builder]:
    """``loaded_at`` names a source column that holds the load time; otherwise it is now."""

    def build(name: str) -> Builder:
        source = sources[name]
        if loaded_at is None:
            return lambda _: bronze_ingest(source, name)
        return lambda _: bronze_ingest(source, name, source[loaded_at]).drop(loaded_at)

    return {bronze: build(name) for bronze, name in SOURCES.items()}


def silver_builders(
    tie_break: Mapping[str, Sequence[str]] | None = None,
    variant: str = DECLARATIVE,
    observations: dict[str, Observation] | None = None,
) -> dict[str, Builder]:
    """Dimensions, then the fact.

    Every table is deduplicated once, into a staging table; the silver table and what is kept
    out of it are two filters over that. ``observations`` receives the monitors of every
    dimension, counted while it is written.
    """
    ties = tie_break or {}

    def latest(name: str) -> Builder:
        bronze = name.replace("silver_", "bronze_", 1)
        return lambda s: silver.latest_dimension(name, s.read(bronze), ties.get(bronze))

    def kept(name: str) -> Builder:
        def build(s: TableSpace) -> DataFrame:
            rows = silver.kept_dimension(name, s.read(staged(name)))
            if observations is not None and expectations(name, "monitor"):
                rows, observations[name] = monitored(rows, name)
            return rows

        return build

    def rejects(s: TableSpace) -> DataFrame:
        frames = [silver.dimension_rejects(n, s.read(staged(n))) for n in silver.BUILDERS]
        return reduce(DataFrame.unionByName, frames)

    def annotate(s: TableSpace) -> DataFrame:
        dims = [s.read(t) for t in ("silver_date_dim", "silver_item", "silver_store", "silver_customer")]
        references = counted(silver.sales_references(*dims))
        return silver.annotated_sales(
            s.read("bronze_store_sales"), references, ties.get("bronze_store_sales")
        )

    return {
        **{staged(name): latest(name) for name in silver.BUILDERS},
        **{name: kept(name) for name in silver.BUILDERS},
        "dq_dimension_rejects": rejects,
        ANNOTATED: annotate,
        "silver_store_sales": lambda s: silver.kept_sales(s.read(ANNOTATED)),
        "dq_store_sales_quarantine": lambda s: silver.sales_quarantine(s.read(ANNOTATED), variant=variant),
    }


def gold_builders(as_of: date | None = None, null_ratio: str = "zero") -> dict[str, Builder]:
    def leaders(s: TableSpace) -> DataFrame:
        fact, days, items = (s.read(t) for t in ("gold_fact_store_sales", "gold_dim_date", "gold_dim_item"))
        known = counted([gold.item_reference(items)])[0]
        return gold.top_items_month(fact, days, items, items=None if known.words is None else known)

    return {
        "gold_dim_date": lambda s: gold.gold_date(s.read("silver_date_dim")),
        "gold_dim_item": lambda s: gold.gold_item(s.read("silver_item")),
        "gold_dim_store": lambda s: gold.gold_store(s.read("silver_store")),
        "gold_dim_customer": lambda s: gold.gold_customer(s.read("silver_customer"), as_of),
        "gold_fact_store_sales": lambda s: gold.gold_sales(s.read("silver_store_sales"), null_ratio),
        "gold_top_items_month": leaders,
    }


def quality_builders(
    variant: str = DECLARATIVE, observations: Mapping[str, Observation] | None = None
) -> dict[str, Builder]:
    """Quality tables over what is stored; monitors from ``observations`` where they are given."""

    def monitors(s: TableSpace) -> DataFrame:
        # Reading the tables makes this one wait until they are written and their monitors counted.
        tables = stored(s, SILVER_TABLES)
        watched = {n for n in SILVER_TABLES if expectations(n, "monitor")}
        if observations is not None and watched <= set(observations):
            return monitor_report(s.spark, observations)
        return expectation_report(tables, "monitor")

    def stored(s: TableSpace, names: Sequence[str]) -> dict[str, DataFrame]:
        return {n: s.read(n) for n in names}

    return {
        "dq_rule_catalog": lambda s: catalog_frame(s.spark),
        "dq_bronze_metrics": lambda s: bronze_metrics(stored(s, tuple(SOURCES)), variant),
        "dq_bronze_observability": lambda s: bronze_observability(
            s.read("dq_bronze_metrics").drop("validation_mode"), s.read("dq_rule_catalog")
        ),
        "dq_cast_failures": lambda s: cast_failure_report(stored(s, tuple(SOURCES))),
        "dq_silver_dropped": lambda s: expectation_report(
            {**{n: s.read(staged(n)) for n in silver.BUILDERS}, "silver_store_sales": s.read(ANNOTATED)}, "drop"
        ),
        "dq_silver_monitors": monitors,
        "dq_silver_issues": lambda s: issues(stored(s, SILVER_TABLES), SILVER_ISSUES, variant),
        "dq_silver_rule_status": lambda s: rule_status(stored(s, SILVER_TABLES), variant=variant),
        "dq_gold_issues": lambda s: issues(stored(s, GOLD_TABLES), GOLD_ISSUES, variant),
        "dq_gold_metrics": lambda s: gold_metrics(stored(s, GOLD_TABLES), variant),
        "dq_gold_observability": lambda s: gold_observability(
            s.read("dq_gold_metrics"), s.read("dq_rule_catalog")
        ),
    }


def run_all(
    space: TableSpace,
    sources: Mapping[str, DataFrame],
    loaded_at: str | None = None,
    tie_break: Mapping[str, Sequence[str]] | None = None,
    as_of: date | None = None,
    variant: str = DECLARATIVE,
    partition_by: Mapping[str, Sequence[str]] | None = None,
    buckets: Mapping[str, Buckets] | None = None,
    run_id: str | None = None,
) -> dict[str, int]:
    """All layers of one run; returns the stored row count per table.

    With the ``run_id`` of a run that failed, only what it did not store is built.
    """
    null_ratio = "zero" if variant == DECLARATIVE else "null"
    observations: dict[str, Observation] = {}
    builders = {
        **bronze_builders(sources, loaded_at),
        **silver_builders(tie_break, variant, observations),
        **gold_builders(as_of, null_ratio),
        **quality_builders(variant, observations),
    }
    return run_layer(space, builders, COMMENTS, partition_by, buckets, run_id)
