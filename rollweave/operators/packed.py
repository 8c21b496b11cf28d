"""Several values packed in one field: one row per value, with its position."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollweave.functions.segmentation import fold, segment

#: Most characters of a dictionary of whole values that is sent to every task.
MOST_DICTIONARY_CHARS = 64_000_000


def dictionary(values: DataFrame, column: str, most_chars: int = MOST_DICTIONARY_CHARS) -> list[str]:
    """Distinct non-null values of a reference column, sorted. Its size is checked first; a dictionary above the bound is an error."""
    chars = values.agg(F.sum(F.length(F.col(column)))).first()[0] or 0
    if chars > most_chars:
        raise ValueError(f"the dictionary has {chars} characters, more than {most_chars}")
    return sorted(r[0] for r in values.select(F.col(column)).filter(F.col(column).isNotNull()).distinct().collect())


def packed_values(spark: SparkSession, cell: Column, known: list[str]) -> Column:
    """Array of the values packed in ``cell``; empty for a null or blank cell. ``known`` are whole values that no delimiter may cut; each executor gets them once."""
    shared = spark.sparkContext.broadcast(frozenset(fold(k) for k in known))

    @F.pandas_udf("array<string>")
    def split(cells: pd.Series) -> pd.Series:
        memo: dict[str, list[str]] = {}
        out, folded = [], shared.value
        for c in cells:
            if c is None or c != c:
                out.append([])
            else:
                if c not in memo:
                    memo[c] = segment(c, folded)
                out.append(memo[c])
        return pd.Series(out)

    return split(cell)


def explode_packed(df: DataFrame, cell: str, known: list[str], keep: list[str], value: str = "value", pos: str = "pos") -> DataFrame:
    """``keep`` columns, ``pos`` (bigint, from 1) and ``value`` for each value of ``cell``; blank cells give no rows."""
    cells = df.filter(F.trim(F.coalesce(F.col(f"`{cell}`"), F.lit(""))) != "")
    packed = cells.select(*[F.col(f"`{c}`") for c in keep], packed_values(df.sparkSession, F.col(f"`{cell}`"), known).alias("__values"))
    return packed.select(*[F.col(f"`{c}`") for c in keep], F.posexplode("__values").alias("__pos", "__value")).select(*[F.col(f"`{c}`") for c in keep], (F.col("__pos") + 1).cast("bigint").alias(pos), F.col("__value").alias(value))
