"""The joins of the sequential rule: whole, and without tables that are sent to the driver."""

import random

from pyspark.sql import functions as F

from rollweave.operators import resolve
from rollweave.operators.merge import normalized
from rollweave.operators.resolve import _ratio_keys, alike_names, greedy_clusters, lcs_ratio
from rollweave.session import store
from rollweave.sources.csv import table_claims


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_names_meet_by_segments_as_by_brute_force(spark):
    rnd = random.Random(7)
    names = set()
    for _ in range(40):
        base = "".join(rnd.choice("abcde ") for _ in range(rnd.randrange(3, 30))).strip() or "a"
        for _ in range(5):
            x = list(base)
            for _ in range(rnd.randrange(0, 4)):
                x.insert(rnd.randrange(len(x) + 1), rnd.choice("abcde")) if rnd.random() < 0.5 else x.pop(rnd.randrange(len(x))) if len(x) > 1 else None
            names.add("".join(x))
    want = {(a, b) for a in names for b in names if a != b and lcs_ratio(a, b) >= 90}
    got = alike_names(spark.createDataFrame([("f", n) for n in names], "company string, sorted string")).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want) > 50


def test_a_name_meets_others_by_few_segments():
    assert len(_ratio_keys("alexander maximus", False)) + len(_ratio_keys("alexander maximus", True)) < 30


def test_segments_of_names_are_not_broadcast(spark):
    people = spark.range(100).select(F.lit("f").alias("company"), F.concat(F.lit("ann kalovric "), F.col("id").cast("string")).alias("sorted"))
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 0
    p = plan(alike_names(people))
    assert "Broadcast" not in p and p.count("SortMergeJoin") == 1


def test_rounds_are_not_broadcast_and_keep_only_their_last_labels(spark, monkeypatch):
    """Records 0 and 2 share a key, 3 has the name of 2 and 4 a name alike to that of 3."""
    entities = store(spark.createDataFrame([(0, "Ann Kalovric", "f"), (1, "Bob Reston", "f"), (2, "Ann Maria Kalovric", "g"), (3, "Ann Maria Kalovric", "g"), (4, "Ann Maria Kalovrik", "g")], "ent bigint, name string, company string"))
    keys = store(spark.createDataFrame([(0, "emails", "a@x.io"), (2, "emails", "a@x.io")], "ent bigint, kind string, key string"))
    plans, kept = [], []

    def watched(df, *done):
        plans.append(plan(df))
        kept.append(store(df, *done))
        return kept[-1]

    monkeypatch.setattr(resolve, "store", watched)
    got = {r["ent"]: r["cluster_id"] for r in greedy_clusters(entities, keys).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0, 4: 0}
    assert len(plans) > 6 and not any("Broadcast" in p for p in plans)
    assert sum("stored_at" in k.__dict__ for k in kept) == 2  # the names of the last look-up and the labels


def test_claims_meet_their_cluster_without_a_broadcast(spark):
    people = spark.range(20).select(F.concat(F.lit("Ann "), F.col("id").cast("string")).alias("name"), F.lit("Germany").alias("country"), F.col("id"))
    claims = table_claims(people.select("name", "country", "id"), F.col("id")).withColumns({"cluster_id": F.col("ord.row"), "member": F.col("ord.row")})
    p = plan(normalized(claims))
    assert "Broadcast" not in p and "SortMergeJoin" in p
