"""Which source records describe one entity: exact keys first, then alike names in one firm, in the order of arrival.

The rule is sequential: a record joins the earliest cluster that shares a key with it, else the first cluster of its firm that has an
alike name, else it opens a cluster; clusters are never merged. Since a record's cluster depends on earlier records only, the rule is
the one fixed point of "label = least label of the earlier records I match", and it is reached by repeating that step for all records
at once. The least label of the earlier records of a key is a running minimum, taken in buckets of the order of arrival, so neither a hot
key nor a large component is ever gathered in one task.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollweave.functions.normalize import github_login, norm_email, norm_name, token_sorted
from rollweave.functions.phones import norm_phone
from rollweave.functions.segments import cuts
from rollweave.functions.tables import NAME_RATIO
from rollweave.session import drop, store

#: Records whose arrival falls in one bucket are looked at by one window.
BUCKET = 2**33


def source_entities(claims: DataFrame) -> DataFrame:
    """One row per (source, candidate_key): ``ent`` (grows with arrival), ``name`` and ``company``, each the first that is given."""
    value = F.col("value_text")
    name = F.when(F.col("field") == "full_name", norm_name(value))
    firm = F.when(F.col("field") == "current_company", F.nullif(F.lower(F.trim(value)), F.lit("")))
    e = claims.groupBy("source", "candidate_key").agg(
        F.min("ord").alias("first"),
        F.min_by(name, F.when(name.isNotNull(), F.col("ord"))).alias("name"),
        F.min_by(firm, F.when(firm.isNotNull(), F.col("ord"))).alias("company"),
    )
    return e.orderBy("first").withColumn("ent", F.monotonically_increasing_id())


def identity_keys(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """``ent``, ``kind`` and ``key`` of the addresses, numbers and profiles of every record, each once."""
    value = F.col("value_text")
    c = claims.filter(F.col("field").isin("emails", "phones", "links.github")).select("source", "candidate_key", "field", "value_text").distinct()
    key = F.when(F.col("field") == "emails", norm_email(value)).when(F.col("field") == "phones", norm_phone(F.when(F.col("field") == "phones", value))).otherwise(github_login(value))
    keyed = c.select("source", "candidate_key", F.col("field").alias("kind"), key.alias("key")).filter(F.col("key").isNotNull())
    return keyed.join(entities.select("source", "candidate_key", "ent").hint("merge"), ["source", "candidate_key"]).select("ent", "kind", "key").distinct()


def _most(total: int) -> int:
    """Most insertions and deletions between two texts of this total length whose ratio is at least ``NAME_RATIO``."""
    return int((1 - NAME_RATIO / 100) * total + 1e-9)


@lru_cache(maxsize=1000)
def _ratio_shapes(length: int, probe: bool) -> list[tuple[int, int, int, int]]:
    """Length and number of a segment, start and length of the substring: of the segments of a text, or for ``probe`` of what may be one of a text that isn't longer.

    With one segment more than changes, one segment is whole and has as many changes before it as segments; each change moves it by one.
    """
    far = (200 - NAME_RATIO) / NAME_RATIO  # longest partner, as a multiple
    parts = lambda n: list(enumerate(cuts(n, _most(int(n + n * far + 1e-9)))))
    if not probe:
        return [(length, i, p, n) for i, (p, n) in parts(length)]
    out = []
    for other in range(int(length / far), length + 1):
        less = length - other
        k = _most(length + other)
        k -= (k - less) % 2
        for i, (p, n) in parts(other)[: max(k, -1) + 1]:
            out += [(other, i, p + moved, n) for moved in range(-i, i + 1, 2) if abs(less - moved) <= k - i and 0 <= p + moved <= length - n]
    return out


def _ratio_keys(text: str, probe: bool) -> list[str]:
    """Segments by which two texts of a ratio of at least ``NAME_RATIO`` meet; the longer one probes, of two equally long ones both do."""
    return list({f"{n}:{i}:{text[p : p + size]}" for n, i, p, size in _ratio_shapes(len(text), probe)})


def alike_names(people: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of different sorted names of one ``company`` whose ratio 200 * LCS / (len a + len b) is at least ``NAME_RATIO``.

    A name has many segments, of which the planner's estimates know nothing, so the join is a merge: neither side is ever sent to the driver.
    """

    def keys(probe: bool) -> Column:
        @F.pandas_udf("array<string>")
        def run(s: pd.Series) -> pd.Series:
            return pd.Series([_ratio_keys(x, probe) for x in s])

        return F.explode(run("sorted"))

    d = store(people.select("company", "sorted").distinct())
    index = d.withColumn("k", keys(False)).select("company", F.xxhash64("k").alias("k"), F.col("sorted").alias("a"))
    probe = d.withColumn("k", keys(True)).select("company", F.xxhash64("k").alias("k"), F.col("sorted").alias("b"))
    most = (1 - NAME_RATIO / 100) * (F.length("a") + F.length("b"))
    once = (F.length("a") < F.length("b")) | ((F.length("a") == F.length("b")) & (F.col("a") < F.col("b")))
    near = index.hint("merge").join(probe.hint("merge"), ["company", "k"]).filter(once & (F.levenshtein("a", "b") <= most + 1e-9)).select("company", "a", "b").distinct()

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([lcs_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    # each pair is found once and given both ways
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return near.filter(ratio("a", "b") >= NAME_RATIO).select("company", ways.alias("w")).select("company", "w.a", "w.b")


def lcs_ratio(a: str, b: str) -> float:
    """200 * length of the longest common subsequence / total length; 100 for two empty texts."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        diag = 0
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], (diag + 1 if x == y else max(row[j], row[j - 1]))
    return 200.0 * row[-1] / (len(a) + len(b))


def _least_before(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (``ent``, ``c``) with ``m``, the least ``c`` of the earlier rows of the same keys."""
    inner = Window.partitionBy(*keys, "b").orderBy("ent").rowsBetween(Window.unboundedPreceding, -1)
    r = rows.withColumn("b", F.floor(F.col("ent") / BUCKET)).withColumn("m1", F.min("c").over(inner))
    per = r.groupBy(*keys, "b").agg(F.min("c").alias("g")).withColumn("m2", F.min("g").over(Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1))).drop("g")
    return r.join(per.hint("merge"), [*keys, "b"]).withColumn("m", F.least(F.coalesce("m1", "m2"), F.coalesce("m2", "m1"))).drop("b", "m1", "m2")


def greedy_clusters(entities: DataFrame, keys: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """``ent`` and ``cluster_id`` (the first record of the cluster) by the sequential rule. Records without keys, name or firm stay alone.

    ``entities`` has ``ent``, ``name`` and ``company``, ``keys`` has ``ent``, ``kind`` and ``key``. Steps are stored, not
    checkpointed: a checkpoint keeps the planner's estimate of its size, which joins and exploded lists put far off, and the files of all rounds.
    Joins are merges, as in ``connected``, so that no table of records is sent to the driver.
    """
    e = store(entities.select("ent", "company", "name", token_sorted(F.col("name")).alias("sorted")))
    keys = store(keys)
    # whether an earlier record shares a key doesn't depend on labels
    hit = _least_before(keys.withColumn("c", F.col("ent")), ["kind", "key"]).filter("m IS NOT NULL").select("ent").distinct()
    alone = store(e.join(hit.hint("merge"), "ent", "left_anti").filter(F.col("sorted").isNotNull() & F.col("company").isNotNull()).select("ent", "company", F.col("sorted").alias("b")))
    named = e.filter(F.col("sorted").isNotNull() & F.col("company").isNotNull())
    pairs = alike_names(named).select("company", F.col("a").alias("b"), F.col("b").alias("to"))
    # earlier records of the firm with the same or an alike name; per name only the earliest of each cluster matters, so names are joined, not records
    wanted = store(alone.unionByName(alone.join(pairs.hint("merge"), ["company", "b"]).select("ent", "company", F.col("to").alias("b"))).distinct(), alone)
    label = store(e.select("ent", F.col("ent").alias("c")))
    for _ in range(most_rounds):
        merged = label.hint("merge")
        exact = _least_before(keys.join(merged, "ent"), ["kind", "key"]).groupBy("ent").agg(F.min("m").alias("x"))
        member = named.join(merged, "ent")
        arrival = member.groupBy("company", "c").agg(F.min("ent").alias("arrived"))
        faces = member.groupBy("company", "sorted", "c").agg(F.min("ent").alias("since")).withColumnRenamed("sorted", "b")
        options = wanted.join(faces.hint("merge"), ["company", "b"]).filter(F.col("since") < F.col("ent")).join(arrival.hint("merge"), ["company", "c"])
        fuzzy = options.groupBy("ent").agg(F.min_by("c", "arrived").alias("z"))
        new = label.join(exact.hint("merge"), "ent", "left").join(fuzzy.hint("merge"), "ent", "left").select("ent", F.col("c").alias("old"), F.coalesce("x", "z", "ent").alias("c"))
        label = store(new, label)
        if not label.filter(F.col("c") != F.col("old")).limit(1).count():
            break
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    for done in (e, keys, wanted):
        drop(done)
    return label.select("ent", F.col("c").alias("cluster_id"))


def resolve(claims: DataFrame) -> DataFrame:
    """``claims`` with ``cluster_id`` and ``member`` (order of the record in the cluster)."""
    entities = store(source_entities(claims))
    placed = greedy_clusters(entities, identity_keys(claims, entities)).join(entities.select("ent", "source", "candidate_key").hint("merge"), "ent")
    return claims.join(placed.select("source", "candidate_key", F.col("ent").alias("member"), "cluster_id").hint("merge"), ["source", "candidate_key"])
