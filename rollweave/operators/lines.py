"""Lines of documents and rows in an order: headings that hold for what follows, entries, neighbours.

Each works within one document or entity; a long document's lines are sorted and streamed, never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines_of(df: DataFrame, doc: str, text: str) -> DataFrame:
    """``doc``, ``line_no`` (from 0) and ``line`` of every line of every text; null texts have none."""
    return df.select(F.col(doc), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def fill_sections(lines: DataFrame, doc: str, heading: Column) -> DataFrame:
    """Lines with ``section``: the last non-null ``heading`` at or above them, null before the first."""
    w = Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(heading, ignorenulls=True).over(w))


def number_entries(df: DataFrame, keys: list[str], order: list[str], opens: Column) -> DataFrame:
    """Rows with ``entry``: how many rows of the group so far fulfil ``opens``; 0 before the first."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("entry", F.sum(F.when(opens, 1).otherwise(0)).over(w))


def look_back(df: DataFrame, keys: list[str], order: list[str], value: Column, reach: int, name: str = "context") -> DataFrame:
    """Rows with the nearest non-null ``value`` of the ``reach`` rows before them."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.coalesce(*[F.lag(value, i).over(w) for i in range(1, reach + 1)]))
