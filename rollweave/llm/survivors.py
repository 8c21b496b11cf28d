"""Best representative of each duplicate group, by iterative truth discovery.

Claims (group, field, value, source, time) vote for their value with the weight of their source. Votes and source reliability are
estimated in turn: a value's support is its share of the weight in its group and field, a source's reliability is the mean
support of the values it claims, starting from the sources' given trust. The rounds end when no reliability moves by more than
``tolerance``. The value with the most support survives, and stands for it the freshest row that claims it.

A source has one vote for each value it claims, however many copies it delivers. The vote of a claim that is overtaken counts by
``OVERTAKEN`` only: a later claim of a source at least as trusted, or one as late of a more trusted source, has taken its place. So a
value that has been replaced can't be voted back by its old copies, and among values that are up to date the votes decide.

Every round is two aggregates over the votes, which are first collapsed to one row per (group, field, value, source); only the
reliability per source goes through the driver, and the number of sources is checked. No group is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollweave.session import cut

#: Most sources whose reliability is kept on the driver.
MOST_SOURCES = 10_000
#: Weight of the vote of a claim that is overtaken.
OVERTAKEN = 0.02
#: How many claims the given trust of a source counts for, so that a source with a handful of claims isn't judged by luck.
PRIOR = 10


def truth_discovery(votes: DataFrame, trust: dict[str, float], tolerance: float = 0.005, most_rounds: int = 100) -> tuple[dict[str, float], DataFrame]:
    """Reliability per source and the support of each value: ``gid``, ``field``, ``value``, ``support`` (0 to 1, summing to 1 per group and field).

    ``votes`` has ``gid``, ``field``, ``value``, ``source`` and the weight ``n`` and should be cheap to read again. ``trust`` gives starting
    reliabilities; other sources start at the least of them. An empty table gives the trust back and no support. ``most_rounds`` without an
    end are an error.
    """
    least = min(trust.values(), default=0.5)
    sources = [r[0] for r in votes.select("source").distinct().limit(MOST_SOURCES + 1).collect()]
    if len(sources) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    now = {s: trust.get(s, least) for s in sources}
    # groups in which all votes agree give every source a support of 1 in every round, so they are counted once
    per = votes.groupBy("gid", "field").agg((F.min("value") != F.max("value")).alias("split"))
    told = cut(votes.join(per, ["gid", "field"]))
    split = told.filter("split").drop("split")
    unanimous = {r[0]: r[1] for r in told.filter("NOT split").groupBy("source").agg(F.sum("n")).collect()}
    for _ in range(most_rounds):
        weighted = _support(split, now)
        got = {r[0]: (r[1], r[2]) for r in split.join(weighted, ["gid", "field", "value"]).groupBy("source").agg(F.sum(F.col("n") * F.col("support")), F.sum("n")).collect()}
        new = {}
        for s in sources:
            total, n = got.get(s, (0.0, 0.0))
            agree = unanimous.get(s, 0.0)
            new[s] = (total + agree + PRIOR * trust.get(s, least)) / (n + agree + PRIOR)
        moved = max((abs(new[s] - now[s]) for s in sources), default=0.0)
        now = new
        if moved <= tolerance:
            break
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return now, _support(votes, now)


def _support(votes: DataFrame, reliability: dict[str, float]) -> DataFrame:
    table = votes.sparkSession.createDataFrame(sorted(reliability.items()), "source string, reliability double")
    value = votes.join(F.broadcast(table), "source").groupBy("gid", "field", "value").agg(F.sum(F.col("n") * F.col("reliability")).alias("w"))
    total = value.groupBy("gid", "field").agg(F.sum("w").alias("t"))
    return value.join(total, ["gid", "field"]).select("gid", "field", "value", (F.col("w") / F.greatest(F.col("t"), F.lit(1e-12))).alias("support"))


def survivors(claims: DataFrame, rank: dict[str, int], tolerance: float = 0.005) -> DataFrame:
    """One claim per (``gid``, ``field``): ``gid``, ``field``, ``row``, ``value``, ``support``.

    ``claims`` has ``gid``, ``field``, ``row`` (unique), ``value`` (compared as given), ``source`` and ``at``; claims with a null
    group, field or value don't count, a null source ranks behind all known ones, a null time is older than any. ``rank`` orders
    the sources, 0 best, at most ``MOST_SOURCES``. The value with the most support survives; equal support goes to the later, then the
    better ranked, then the lower row, and so does the choice among the rows that claim the value, those not overtaken first. Repeated
    rows are separate claims with one vote. An empty table gives an empty result.
    """
    if len(rank) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    worst = max(rank.values(), default=0) + 1
    spark = claims.sparkSession
    usable = claims.filter(F.col("gid").isNotNull() & F.col("field").isNotNull() & F.col("value").isNotNull()).select(
        "gid", "field", "row", "value", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("at", F.lit("0001-01-01").cast("timestamp_ntz").cast(dict(claims.dtypes)["at"])).alias("at")
    )
    usable = cut(usable.join(F.broadcast(spark.createDataFrame(sorted(rank.items()), "source string, rank int")), "source", "left").withColumn("rank", F.coalesce("rank", F.lit(worst))))
    # per rank the latest claim: one row per group, field and rank
    latest = usable.groupBy("gid", "field", "rank").agg(F.max("at").alias("at"))
    by_rank = latest.groupBy("gid", "field").agg(F.map_from_entries(F.collect_list(F.struct("rank", "at"))).alias("latest"))
    overtaken = F.exists(
        F.map_entries("latest"),
        lambda e: ((e["value"] > F.col("at")) & (e["key"] <= F.col("rank"))) | ((e["value"] >= F.col("at")) & (e["key"] < F.col("rank"))),
    )
    weighed = cut(usable.join(by_rank, ["gid", "field"]).withColumn("n", F.when(overtaken, OVERTAKEN).otherwise(1.0)).drop("latest"))
    votes = cut(weighed.groupBy("gid", "field", "value", "source").agg(F.max("n").alias("n")))
    _, support = truth_discovery(votes, {s: 1 - r / (worst + 1) for s, r in rank.items()}, tolerance)
    best = F.max_by(F.struct("row", "value", "support"), F.struct(F.round("support", 9), "n", "at", -F.col("rank"), -F.col("row")))
    return weighed.join(support, ["gid", "field", "value"]).groupBy("gid", "field").agg(best.alias("b")).select("gid", "field", "b.row", "b.value", "b.support")
