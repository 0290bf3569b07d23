"""Enforcing and monitoring expectations."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from oresmith.functions.aggregates import count_if, row_count
from oresmith.rules.catalog import expectations
from oresmith.rules.model import Expectation, violates


def enforce(df: DataFrame, rules: Iterable[Expectation]) -> DataFrame:
    """Keep the rows on which every predicate is true; NULL is not true."""
    return df.where(" AND ".join(f"({rule.predicate})" for rule in rules))


def enforce_table(df: DataFrame, object_name: str) -> DataFrame:
    """Apply the dropping expectations of a silver table."""
    return enforce(df, expectations(object_name, "drop"))


def failed_expectations(object_name: str, action: str | None = None) -> list[Column]:
    """Per expectation of a table, its name where a row fails it, else NULL."""
    return [F.when(violates(r.predicate), F.lit(r.name)) for r in expectations(object_name, action)]


def expectation_report(tables: Mapping[str, DataFrame], action: str | None = None) -> DataFrame:
    """One row per expectation: rows that pass and rows that fail. Each table is read once."""
    frames = []
    for name, df in tables.items():
        rules = expectations(name, action)
        if not rules:
            continue
        counts = df.agg(
            row_count().alias("n"),
            *[count_if(violates(r.predicate)).alias(f"f{i}") for i, r in enumerate(rules)],
        )
        rows = [
            F.struct(
                F.lit(name).alias("object_name"),
                F.lit(r.name).alias("expectation"),
                F.lit(r.action).alias("action"),
                (F.col("n") - F.col(f"f{i}")).alias("passed_rows"),
                F.col(f"f{i}").alias("failed_rows"),
            )
            for i, r in enumerate(rules)
        ]
        frames.append(counts.select(F.inline(F.array(*rows))))
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def monitored(df: DataFrame, object_name: str) -> tuple[DataFrame, Observation]:
    """Count the failures of a table's monitors while it is written.

    The counts travel with the job that consumes the returned frame; read them from the
    observation's ``get`` afterwards.
    """
    observation = Observation(f"{object_name}_monitors")
    counts = [count_if(violates(r.predicate)).alias(r.name) for r in expectations(object_name, "monitor")]
    return df.observe(observation, row_count().alias("row_count"), *counts), observation


REPORT_SCHEMA = "object_name string, expectation string, action string, passed_rows bigint, failed_rows bigint"


def monitor_report(spark: SparkSession, observations: Mapping[str, Observation]) -> DataFrame:
    """``expectation_report`` of the monitors, from what was counted while tables were written."""
    rows = []
    for name, observation in observations.items():
        counts = observation.get
        for rule in expectations(name, "monitor"):
            failed = counts[rule.name]
            rows.append((name, rule.name, rule.action, counts["row_count"] - failed, failed))
    return spark.createDataFrame(rows, REPORT_SCHEMA)
