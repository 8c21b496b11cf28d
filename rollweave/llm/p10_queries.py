"""Problem 10: documents with garbled text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollweave.llm.garbling import affected_units, restored
from rollweave.session import table


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least one garbled place."""
    return affected_units(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("doc").alias("doc_id")).distinct()


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The original text of the affected documents, as far as it can be had."""
    return restored(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("doc", "doc_id")


def queries() -> dict:
    return {"p10_found": p10_found, "p10_restored": p10_restored}


def oracle_sql() -> dict[str, str]:
    return {}
