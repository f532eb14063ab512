"""The domain tables with redelivered rows counted once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.session import table


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """One row for each key, the one that came last; rows with a null key are left out.

    Aggregates instead of sorting, so rows of one key combine before the shuffle.
    """
    columns = [c for c in df.columns if c != key]
    row = F.max_by(F.struct(*columns), F.struct(F.col(at).isNotNull(), F.col(at)))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(row.alias("_row")).select(key, *(F.col(f"_row.{c}").alias(c) for c in columns))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "doc_sections"), "section_id", "ingested_at")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "bench_items"), "item_no", "loaded_at")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "run_records"), "rec_id", "arrived_at")


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last override of each item id; of equal times the one with the highest number."""
    df = table(spark, sf_dir, "label_overrides")
    columns = [c for c in df.columns if c != "id"]
    return df.where("id is not null").groupBy("id").agg(F.max_by(F.struct(*columns), F.struct("reviewed_at", "override_no")).alias("_row")).select("id", *(F.col(f"_row.{c}").alias(c) for c in columns))


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "study_docs")


#: The same in DuckDB's SQL.
SQL = {
    "sections": "sections AS (SELECT * FROM doc_sections QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY ingested_at DESC) = 1)",
    "items": "items AS (SELECT * FROM bench_items QUALIFY row_number() OVER (PARTITION BY item_no ORDER BY loaded_at DESC) = 1)",
    "records": "records AS (SELECT * FROM run_records QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY arrived_at DESC) = 1)",
    "overrides": "overrides AS (SELECT * FROM label_overrides QUALIFY row_number() OVER (PARTITION BY id ORDER BY reviewed_at DESC, override_no DESC) = 1)",
}
