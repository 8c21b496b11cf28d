"""Problem 7: typed titles, countries and skills and the reference entries they mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollweave.llm.canonical import match_values, matchers
from rollweave.llm.vocabulary import ALIASES
from rollweave.operators.packed import dictionary, explode_packed
from rollweave.session import cut, table

def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ats_id``, ``field_name``, ``pos`` and ``value`` of every typed value."""
    ats = table(spark, sf_dir, "ats")
    known = dictionary(table(spark, sf_dir, "reference_items").filter(F.col("list_name") == "skills_list"), "canonical_value")
    skills = explode_packed(ats, "skills_list", known, ["ats_id"]).select("ats_id", F.lit("skills_list").alias("field_name"), F.col("pos").cast("int").alias("pos"), "value")
    single = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.lit(1).alias("pos"), F.col(c).alias("value")) for c in ("job_title", "location_country")]))
    return ats.select("ats_id", single.alias("v")).select("ats_id", "v.*").filter(F.col("value") != "").unionByName(skills)


def other_names(spark: SparkSession) -> DataFrame:
    """Table of other names of entries: ``list_name``, ``canonical_value``, ``other_name``, ``place``."""
    rows = [(n, v, o, k) for n, names in ALIASES.items() for v, others in names.items() for k, o in enumerate(others)]
    return spark.createDataFrame(rows, "list_name string, canonical_value string, other_name string, place int")


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = matchers(table(spark, sf_dir, "reference_items"), other_names(spark), titles=("job_title",))
    return match_values(cut(typed_values(spark, sf_dir)), "field_name", "value", lists)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry that each typed value means, 0 for none."""
    return _matched(spark, sf_dir).select("ats_id", "field_name", "pos", "item_id")


def p7_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values without an entry and how often they are typed."""
    return _matched(spark, sf_dir).filter(F.col("item_id") == 0).groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict:
    return {"p7_found": p7_found, "p7_misses": p7_misses}


def oracle_sql() -> dict[str, str]:
    return {}
