"""Delimited files with a header: one claim per filled cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollweave.functions.claims import claim, empty_claims, shred, split_list
from rollweave.functions.normalize import blank_to_null
from rollweave.functions.places import parse_location
from rollweave.sources.columns import FIELDS, clean_column
from rollweave.sources.files import exists

CONFIDENCE = 0.95


def table_claims(df: DataFrame, row: Column | None = None, source: str = "recruiter_csv", confidence: float = CONFIDENCE) -> DataFrame:
    """Claims of a wide table of text columns. Columns that aren't known are ignored; a row without a name and an address is left out.

    The record's key is the lower-case address, else the name; for it only the first column of either kind counts. ``skills`` cells are
    split; a ``location`` cell that can't be read is taken for a city.
    """
    known = [(c, clean_column(c)) for c in df.columns if clean_column(c) in FIELDS]
    first = {k: next((c for c, n in known if n == k), None) for k in ("email", "name")}
    cell = lambda c: blank_to_null(F.col(f"`{c}`").cast("string"))
    ids = [cell(c) for c in first.values() if c]
    if not ids:
        return empty_claims(df.sparkSession)
    at = F.monotonically_increasing_id() if row is None else row
    work = df.withColumn("__at", at)
    lists = []
    for c, name in known:
        text, field = cell(c), FIELDS[name]
        if name == "skills":
            lists.append(F.transform(F.coalesce(split_list(text), F.array().cast("array<string>")), lambda s: claim("skills", s, "direct_copy", confidence)))
        elif name == "location":
            work = work.withColumn("__place", parse_location(text, df.sparkSession))
            parsed = F.array(*[claim(f"location.{p}", F.col(f"__place.{p}"), "location_parse", confidence) for p in ("city", "region", "country")])
            found = F.coalesce(F.col("__place.city"), F.col("__place.region"), F.col("__place.country")).isNotNull()
            lists.append(F.when(found, parsed).otherwise(F.array(claim(field, text, "direct_copy", confidence))))
        else:
            lists.append(F.array(claim(field, text, "direct_copy", confidence)))
    return shred(work, F.lower(F.coalesce(*ids)), F.col("__at"), lists, source, F.create_map(F.lit("row"), (F.col("__at") + 2).cast("string")))


class CsvSource:
    """UTF-8 files with a header; quotes are doubled inside quoted cells, which may hold line ends."""

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        if not exists(spark, path):
            return empty_claims(spark)
        df = spark.read.option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path, header=True, inferSchema=False)
        return table_claims(df) if df.columns else empty_claims(spark)
