"""Problem 5: periods of employment and the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollweave.functions.months import is_open_end, month_index, month_text
from rollweave.operators.intervals import OPEN_END, merge_periods
from rollweave.session import table

TABLE = "candidates_combined_1ab46684"


def stint_months(stints: Column) -> Column:
    """``array<struct<s, e>>`` of month numbers of an ``experience`` array."""
    return F.transform(
        stints,
        lambda x: F.struct(month_index(x["start"]).alias("s"), F.when(is_open_end(x["end"]), F.lit(OPEN_END)).otherwise(month_index(x["end"])).cast("int").alias("e")),
    )


def _periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    stints = table(spark, sf_dir, TABLE).select("row_id", F.explode(stint_months(F.col("experience"))).alias("x")).select("row_id", "x.s", "x.e")
    return merge_periods(stints, ["row_id"], "s", "e")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each gap of each row, in months."""
    return _periods(spark, sf_dir).filter("gap_start IS NOT NULL").select("row_id", month_text(F.col("gap_start")).alias("gap_from"), month_text(F.col("gap_end")).alias("gap_to"))


def p5_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each continuous period of each row; an open period has no last month."""
    return _periods(spark, sf_dir).select("row_id", "period_no", month_text(F.col("period_start")).alias("period_from"), F.when(F.col("period_end") < OPEN_END, month_text(F.col("period_end"))).alias("period_to"))


_STINTS = """
raw AS (SELECT row_id, lower(trim(s."start")) AS a, lower(trim(s."end")) AS b
        FROM (SELECT row_id, unnest(experience) AS s FROM candidates_combined_1ab46684)),
months AS (SELECT row_id,
  CASE WHEN regexp_matches(a, '^\\d{4}-\\d{1,2}(-\\d{1,2})?$') THEN CAST(a[1:4] AS INT) * 12 + CAST(regexp_extract(a, '^\\d{4}-(\\d{1,2})', 1) AS INT) - 1
       WHEN regexp_matches(a, '^\\d{1,2}/\\d{4}$') THEN CAST(a[-4:] AS INT) * 12 + CAST(regexp_extract(a, '^(\\d+)/', 1) AS INT) - 1
       WHEN regexp_matches(a, '^[a-z]{3,} +\\d{4}$') THEN CAST(a[-4:] AS INT) * 12 + list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], a[1:3]) - 1
       WHEN regexp_matches(a, '^\\d{4}$') THEN CAST(a AS INT) * 12 END AS s,
  CASE WHEN b IS NULL OR b IN ('', 'present', 'current', 'now', 'ongoing', 'today', 'till date', 'to date', 'till now') THEN 1000000
       WHEN regexp_matches(b, '^\\d{4}-\\d{1,2}(-\\d{1,2})?$') THEN CAST(b[1:4] AS INT) * 12 + CAST(regexp_extract(b, '^\\d{4}-(\\d{1,2})', 1) AS INT) - 1
       WHEN regexp_matches(b, '^\\d{1,2}/\\d{4}$') THEN CAST(b[-4:] AS INT) * 12 + CAST(regexp_extract(b, '^(\\d+)/', 1) AS INT) - 1
       WHEN regexp_matches(b, '^[a-z]{3,} +\\d{4}$') THEN CAST(b[-4:] AS INT) * 12 + list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], b[1:3]) - 1
       WHEN regexp_matches(b, '^\\d{4}$') THEN CAST(b AS INT) * 12 END AS e
  FROM raw),
runs AS (SELECT *, max(e) OVER (PARTITION BY row_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
         FROM months WHERE s IS NOT NULL AND e >= s)
"""

_MONTH = "lpad(CAST({0} // 12 AS VARCHAR), 4, '0') || '-' || lpad(CAST({0} % 12 + 1 AS VARCHAR), 2, '0')"


def queries() -> dict:
    return {"p5_found": p5_found, "p5_periods": p5_periods}


def oracle_sql() -> dict[str, str]:
    gap = f"WITH {_STINTS} SELECT row_id, {_MONTH.format('(reach + 1)')} AS gap_from, {_MONTH.format('(s - 1)')} AS gap_to FROM runs WHERE s > reach + 1"
    periods = f"""WITH {_STINTS},
labelled AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM runs)
SELECT row_id, CAST(n AS INT) AS period_no, {_MONTH.format('min(s)')} AS period_from,
       CASE WHEN max(e) < 1000000 THEN {_MONTH.format('max(e)')} END AS period_to FROM labelled GROUP BY row_id, n"""
    return {"p5_found": gap, "p5_periods": periods}
