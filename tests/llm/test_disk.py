import random
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import functions as F

from rollweave.llm.linkage import ATTRIBUTES, candidate_edges, linked, profile, profiles
from rollweave.operators.components import connected
from rollweave.session import ensure_checkpoint_dir, store


def people(spark, rows):
    df = spark.createDataFrame(rows, "side int, row bigint, name string, mail string, phone string, firm string")
    return profiles(df.select("side", "row", profile(F.col("name"), F.col("mail"), F.col("phone"), F.col("firm"), [], ["ann", "bob"]).alias("p")))


def flat(table):
    return table.select("node", "side", *[F.col(f"p.{a}").alias(a) for a in ATTRIBUTES if a != "firm"], F.array_join("p.firm", " ").alias("firm"))


def held(spark):
    ensure_checkpoint_dir(spark)
    folder = Path(urlparse(spark.sparkContext.getCheckpointDir()).path)
    return sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())


def test_linking_keeps_less_on_disk_than_it_reads(spark):
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnoprstuvwz") for _ in range(n))
    rows = []
    for k in range(3000):
        name, firm, phone = f"{word(5).title()} {word(9).title()}", f"{word(6).title()} Marine", f"411 {rnd.randrange(100, 999)} {rnd.randrange(1000, 9999)}"
        rows += [(0, 2 * k, name, f"{word(12)}@{word(6)}.example", phone, firm), (1, 2 * k + 1, name, None, phone, firm)]
    table = store(people(spark, rows).select("node", "side", "p"))
    size, before = sum(f.stat().st_size for f in Path(urlparse(table.stored_at).path).glob("*.parquet")), held(spark)
    assert linked(table, across=True).count() >= 3000
    assert held(spark) - before < size


def test_firm_letters_alone_make_no_candidates(spark):
    rows = [(0, 1, "Ann Kalovric", None, None, "Krydo Marine"), (1, 2, "Ann Kalovric", None, None, "Kelvo Motors"), (1, 3, "Ann Kalovrik", None, None, "Krydo Marin")]
    table = people(spark, rows)
    node = {r["row"]: r["node"] for r in table.collect()}
    for across in (True, False):
        got = {frozenset((r["u"], r["v"])) for r in candidate_edges(flat(table), across).collect()}
        assert got == {frozenset((node[1], node[3]))}


def test_what_is_stored_can_be_dropped(spark):
    one = store(spark.range(1000))
    path = Path(urlparse(one.stored_at).path)
    two = store(one.filter("id > 10"), one)
    assert two.count() == 989 and not path.exists() and Path(urlparse(two.stored_at).path).exists()


def test_components_drop_their_rounds(spark):
    edges = store(spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    before = held(spark)
    assert {r["component"] for r in connected(edges, "a", "b", local_edges=0).collect()} == {0}
    # no more than the last labels
    assert held(spark) - before < 100_000
