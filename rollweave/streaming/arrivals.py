"""Applicant records as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollweave.sources.ats import json_claims


def arriving_records(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Streaming ``payload`` and ``arrived`` (time of the file) of the lines of text files, one JSON object a line."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return lines.select(F.col("value").alias("payload"), F.col("_metadata.file_modification_time").alias("arrived"))


def arriving_claims(records: DataFrame) -> DataFrame:
    """Streaming claims of ``arriving_records``; a record's number is the hash of its text, so a line delivered twice gives the same claims."""
    return json_claims(records, "payload", F.xxhash64("payload"))


def arrivals(records: DataFrame, late: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """Records per tumbling window of arrival, late ones up to ``late`` included; lines that aren't objects are counted apart."""
    ok = F.coalesce(F.schema_of_variant(F.try_parse_json("payload")).startswith("OBJECT"), F.lit(False))
    timed = records.withWatermark("arrived", late)
    g = timed.groupBy(F.window("arrived", window)).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.when(ok, 1).otherwise(0)).alias("records"))
    return g.select(F.col("window.start").alias("since"), F.col("window.end").alias("until"), "lines", "records")
