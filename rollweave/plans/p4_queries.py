"""Problem 4: skills packed in one field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollweave.operators.packed import dictionary, explode_packed
from rollweave.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each skill of each application."""
    reference = table(spark, sf_dir, "reference_items").filter(F.col("list_name") == "skills_list")
    known = dictionary(reference, "canonical_value")
    return explode_packed(table(spark, sf_dir, "ats"), "skills_list", known, ["ats_id"], value="skill")


def queries() -> dict:
    return {"p4_found": p4_found}


def oracle_sql() -> dict[str, str]:
    return {}
