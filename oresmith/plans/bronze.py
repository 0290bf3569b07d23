"""Bronze: source rows untouched, plus lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bronze table and source table names.
SOURCES = {
    "bronze_store_sales": "store_sales",
    "bronze_date_dim": "date_dim",
    "bronze_item": "item",
    "bronze_store": "store",
    "bronze_customer": "customer",
}


def bronze_ingest(source: DataFrame, source_table: str, loaded_at: Column | None = None) -> DataFrame:
    """All source columns, the load time and the source's name."""
    stamp = F.current_timestamp() if loaded_at is None else loaded_at
    return source.withColumn("ingestion_timestamp", stamp).withColumn("source_table", F.lit(source_table))
