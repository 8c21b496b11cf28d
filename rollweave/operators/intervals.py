"""Overlapping and gapped intervals: continuous periods and the gaps between them.

Both forms follow one method: sort by start per entity, compare each start with the running maximum of the previous ends, number
the islands cumulatively, aggregate the periods and take the gaps from what lies between neighbours.

* ``row_periods`` works on intervals packed in an array of one row. It needs no shuffle at all.
* ``merge_periods`` works on one interval a row. It collapses equal starts before the shuffle and runs its windows in buckets of
  starts, carrying maxima and counts from bucket to bucket, so an entity with a third of all rows never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: End of an interval that never ends.
OPEN_END = 10**6


def row_periods(intervals: Column, touch: int = 1) -> Column:
    """Periods of an ``array<struct<s int, e int>>`` (both ends included) as an array of the same type, in order.

    Intervals with a null or inverted bound are left out; intervals at most ``touch`` apart are one period. A null array gives an
    empty one; repeated intervals change nothing.
    """
    valid = F.array_sort(F.filter(F.coalesce(intervals, F.array()), lambda x: x["s"].isNotNull() & (x["e"] >= x["s"])))
    kind = "array<struct<s:int,e:int>>"

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))
        return F.when((F.size(done) > 0) & (x["s"] <= F.try_element_at(done, F.lit(-1))["e"] + touch), joined).otherwise(F.concat(done, F.array(x))).cast(kind)

    def safe(done: Column, x: Column) -> Column:
        return F.when(F.size(done) == 0, F.array(x).cast(kind)).otherwise(step(done, x))

    return F.aggregate(valid.cast(kind), F.array().cast(kind), safe)


def period_gaps(periods: Column) -> Column:
    """Gaps between the periods of ``row_periods``: ``array<struct<s int, e int>>``, empty with fewer than two periods."""
    n = F.greatest(F.size(periods) - 1, F.lit(0))
    return F.transform(
        F.slice(periods, 1, n),
        lambda x, i: F.struct((x["e"] + 1).alias("s"), (F.get(periods, i + 1)["s"] - 1).alias("e")),
    )


def merge_periods(df: DataFrame, keys: list[str], start: str, end: str, touch: int = 1, bucket: int = 120) -> DataFrame:
    """One row per continuous period: ``keys``, ``period_no`` (from 1), ``period_start``, ``period_end``, ``gap_start``, ``gap_end``.

    ``start`` and ``end`` are integers, both included; ``end`` may be ``OPEN_END``. The gap columns tell the gap before the period
    and are null for the first. Rows with a null or inverted bound are left out, repeated rows change nothing, null keys form a
    group of their own, other columns are dropped, an empty table gives an empty result.
    """
    k = [f"__k{i}" for i in range(len(keys))]
    src = df.select(*[F.col(f"`{c}`").alias(a) for a, c in zip(k, keys, strict=True)], F.col(f"`{start}`").cast("int").alias("s"), F.col(f"`{end}`").cast("int").alias("e"))
    one = src.filter(F.col("s").isNotNull() & (F.col("e") >= F.col("s"))).groupBy(*k, "s").agg(F.max("e").alias("e")).withColumn("b", F.floor(F.col("s") / bucket))
    upto = Window.partitionBy(*k, "b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*k).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)

    def carried(rows: DataFrame, agg: Column, over: Column) -> DataFrame:
        """``rows`` with ``c``: ``over`` the per-bucket aggregates ``g`` of all earlier buckets of the key."""
        per = rows.groupBy(*k, "b").agg(agg.alias("g")).select(*[F.col(x).alias(f"{x}_r") for x in k], F.col("b").alias("b_r"), F.col("g"), *[F.col(x) for x in k], "b")
        per = per.withColumn("c", over).drop("g", *k, "b")
        on = F.col("b") == F.col("b_r")
        for x in k:
            on &= F.col(x).eqNullSafe(F.col(f"{x}_r"))
        return rows.join(per, on, "left").drop("b_r", *[f"{x}_r" for x in k])

    seen = carried(one, F.max("e"), F.max("g").over(before)).withColumn("reach", F.greatest(F.max("e").over(upto), F.col("c"))).drop("c")
    fresh = seen.withColumn("new", F.when(F.col("reach").isNull() | (F.col("s") > F.col("reach") + touch), 1).otherwise(0))
    label = carried(fresh, F.sum("new"), F.sum("g").over(before))
    here = F.sum("new").over(Window.partitionBy(*k, "b").orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
    label = label.withColumn("period_no", (F.coalesce(F.col("c"), F.lit(0)) + here).cast("int"))
    out = label.groupBy(*k, "period_no").agg(F.min("s").alias("period_start"), F.max("e").alias("period_end"), F.max(F.when(F.col("new") == 1, F.col("reach") + 1)).alias("gap_start"))
    return out.select(*[F.col(a).alias(c) for a, c in zip(k, keys, strict=True)], "period_no", "period_start", "period_end", "gap_start", F.when(F.col("gap_start").isNotNull(), F.col("period_start") - 1).alias("gap_end"))
