import os
import time

from rollweave.streaming.arrivals import arrivals, arriving_claims, arriving_records


def test_arriving_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text('{"name": "Ada Poe", "email": "a@x.org"}\nbroken\n')
    (folder / "b.txt").write_text('{"name": "Bo Lee"}\n{"name": "Bo Lee"}\n')
    now = time.time()
    os.utime(folder / "b.txt", (now, now))
    records = arriving_records(spark, str(folder))
    q = arriving_claims(records).writeStream.format("memory").queryName("claims_now").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    rows = spark.table("claims_now").collect()
    assert sorted((r["field"], r["value_text"]) for r in rows) == [("emails", "a@x.org"), ("full_name", "Ada Poe"), ("full_name", "Bo Lee"), ("full_name", "Bo Lee")]
    assert len({r["ord"]["row"] for r in rows if r["value_text"] == "Bo Lee"}) == 1
    q = arrivals(records).writeStream.format("memory").queryName("arrivals_now").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.table("arrivals_now").selectExpr("sum(lines)", "sum(records)").first()
    assert tuple(got) == (4, 3)
