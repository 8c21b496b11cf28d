"""Looking at neighbours in an order, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous(df: DataFrame, keys: list[str], order: list[str], bucket: Column, cols: list[str], name: str = "prev") -> DataFrame:
    """``df`` with the struct ``name`` of ``cols`` of the row before it in its group, null for a group's first row.

    ``bucket`` must grow with the order. Windows run within (keys, bucket); the first row of a bucket gets the last row of the
    nearest earlier one from a table with one row per bucket. A group with most of all rows is thus spread over its buckets.
    """
    inner = Window.partitionBy(*keys, "__b").orderBy(*order)
    rows = df.withColumn("__b", bucket).withColumn("__p", F.lag(F.struct(*cols)).over(inner)).withColumn("__n", F.row_number().over(inner))
    last = rows.groupBy(*keys, "__b").agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("__last"))
    carried = last.withColumn("__before", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__b"))).drop("__last").withColumn("__n", F.lit(1))
    return rows.join(carried, [*keys, "__b", "__n"], "left").withColumn(name, F.coalesce("__p", "__before")).drop("__b", "__p", "__n", "__before")
