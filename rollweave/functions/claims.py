"""Claims: one row per value that one source gives for one field of one record.

``ord`` is a struct that orders all claims as they were delivered (source, row, field, item); every "first wins" refers to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXPERIENCE = "struct<company:string,title:string,start:string,end:string,summary:string>"
EDUCATION = "struct<institution:string,degree:string,field:string,end_year:string>"
ORD = "struct<source:int,row:bigint,field:int,item:int>"
SCHEMA = f"ord {ORD}, candidate_key string, field string, value_text string, value_exp {EXPERIENCE}, value_edu {EDUCATION}, source string, method string, raw_confidence double, metadata map<string,string>"

#: Numbers of the sources in the order in which they are read (fixed values).
SOURCES = {"recruiter_csv": 0, "ats_json": 1, "github_api": 2, "github_readme_regex": 2, "github_readme_llm": 2, "resume_pdf": 3, "resume_llm": 4}


def empty_claims(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def claim(field: str, text: Column | None, method: str, confidence: float, exp: Column | None = None, edu: Column | None = None, source: str | None = None) -> Column:
    """One claim as a struct; it drops out later if it holds no value."""
    return F.struct(
        F.lit(field).alias("field"),
        (F.lit(None) if text is None else F.regexp_replace(text, r"^\s+|\s+$", "")).cast("string").alias("value_text"),
        (F.lit(None) if exp is None else exp).cast(EXPERIENCE).alias("value_exp"),
        (F.lit(None) if edu is None else edu).cast(EDUCATION).alias("value_edu"),
        F.lit(method).alias("method"),
        F.lit(confidence).cast("double").alias("raw_confidence"),
        F.lit(source).cast("string").alias("src"),
    )


def shred(df: DataFrame, key: Column, row: Column, lists: list[Column], source: str, metadata: Column | None = None) -> DataFrame:
    """Claims of a wide table. ``lists`` are arrays of ``claim`` structs in the order of delivery; claims without a value are left out."""
    flat = df.select(key.alias("candidate_key"), row.cast("bigint").alias("__row"), (metadata if metadata is not None else F.lit(None)).cast("map<string,string>").alias("metadata"), F.posexplode(F.array(*lists)).alias("__f", "__list"))
    each = flat.filter(F.col("candidate_key").isNotNull()).select("candidate_key", "__row", "metadata", "__f", F.posexplode("__list").alias("__i", "c"))
    each = each.filter((F.coalesce(F.col("c.value_text"), F.lit("")) != "") | F.col("c.value_exp").isNotNull() | F.col("c.value_edu").isNotNull())
    src = F.coalesce(F.col("c.src"), F.lit(source))
    order = F.struct(F.lit(SOURCES[source]).alias("source"), F.col("__row").alias("row"), F.col("__f").alias("field"), F.col("__i").alias("item")).cast(ORD)
    return each.select(order.alias("ord"), "candidate_key", "c.field", "c.value_text", "c.value_exp", "c.value_edu", src.alias("source"), "c.method", "c.raw_confidence", "metadata")


def split_list(text: Column) -> Column:
    """Items between commas, semicolons and bars, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text, r"[,;|]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
