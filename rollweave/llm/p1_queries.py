"""Problem 1: rows of recruiters and applications that describe the same person."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollweave.llm.linkage import common_givens, common_hosts, linked, profile, profiles
from rollweave.session import store, table


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``side`` (0 recruiter, 1 application), ``row`` and the profile ``p`` of every row of both tables, and the ``spelling`` of its name and the ``firm`` as typed."""
    rec, ats = table(spark, sf_dir, "recruiter"), table(spark, sf_dir, "ats")
    rows = rec.select(F.lit(0).alias("side"), F.col("rec_id").alias("row"), "name", F.col("email").alias("mail"), "phone", F.col("current_company").alias("firm")).unionByName(
        ats.select(F.lit(1).alias("side"), F.col("ats_id").alias("row"), F.col("applicant_name").alias("name"), F.col("contact_email").alias("mail"), F.col("contact_phone").alias("phone"), F.col("current_employer").alias("firm"))
    )
    hosts, givens = common_hosts(rows.select("mail")), common_givens(rows.select("name"))
    return rows.select("side", "row", F.col("name").alias("spelling"), "firm", profile(F.col("name"), F.col("mail"), F.col("phone"), F.col("firm"), hosts, givens).alias("p"))


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of rows of one person with its confidence."""
    rows = store(profiles(people(spark, sf_dir)))
    edges = linked(rows.select("node", "side", "p"), across=True)
    left = rows.filter("side = 0").select(F.col("node").alias("u"), F.col("row").alias("rec_id"))
    right = rows.filter("side = 1").select(F.col("node").alias("v"), F.col("row").alias("ats_id"))
    return edges.join(left, "u").join(right, "v").select("rec_id", "ats_id", "confidence")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of rows of one person."""
    return p1_links(spark, sf_dir).select("rec_id", "ats_id")


def queries() -> dict:
    return {"p1_found": p1_found, "p1_links": p1_links}


def oracle_sql() -> dict[str, str]:
    return {}
