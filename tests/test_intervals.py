import random

from pyspark.sql import functions as F

from rollweave.functions.months import is_open_end, month_index, month_text
from rollweave.operators.intervals import OPEN_END, merge_periods, period_gaps, row_periods


def brute(spans, touch=1):
    out = []
    for s, e in sorted((s, e) for s, e in spans if s is not None and e is not None and e >= s):
        if out and s <= out[-1][1] + touch:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def test_both_forms_equal_brute_force(spark):
    rnd = random.Random(4)
    groups = {k: [(rnd.choice([None, *range(60)]), rnd.choice([None, OPEN_END, *range(60)])) for _ in range(rnd.choice([0, 1, 3, 9]))] for k in range(60)}
    groups[None] = [(3, 5), (3, 5), (9, 2)]
    groups["hot"] = [(rnd.randrange(5000), rnd.randrange(5000)) for _ in range(3000)]
    rows = [(str(k) if k is not None else None, s, e, "x") for k, v in groups.items() for s, e in v]
    df = spark.createDataFrame(rows, "g string, s int, e int, period_no string")
    got = {}
    for r in merge_periods(df, ["g"], "s", "e", bucket=7).collect():
        got.setdefault(r["g"], []).append((r["period_no"], r["period_start"], r["period_end"], r["gap_start"], r["gap_end"]))
    for k, v in groups.items():
        want = brute(v)
        mine = sorted(got.get(str(k) if k is not None else None, []))
        assert [(a, b) for _, a, b, _, _ in mine] == want
        assert [n for n, *_ in mine] == list(range(1, len(want) + 1))
        assert [(g, h) for _, _, _, g, h in mine[1:]] == [(x[1] + 1, y[0] - 1) for x, y in zip(want, want[1:])]
    arrays = spark.createDataFrame([(str(k), [{"s": s, "e": e} for s, e in v]) for k, v in groups.items() if k != "hot"] + [("null", None)], "g string, a array<struct<s:int,e:int>>")
    for r in arrays.select("g", row_periods(F.col("a")).alias("p")).withColumn("gaps", period_gaps(F.col("p"))).collect():
        want = brute(groups.get(int(r["g"]), []) if r["g"].isdigit() else groups[None] if r["g"] == "None" else [])
        assert [tuple(x) for x in r["p"]] == want
        assert [tuple(x) for x in r["gaps"]] == [(x[1] + 1, y[0] - 1) for x, y in zip(want, want[1:])]


def test_empty_table(spark):
    assert merge_periods(spark.createDataFrame([], "g int, s int, e int"), ["g"], "s", "e").count() == 0


def test_months(spark):
    texts = ["2019-11", " 2019-1 ", "2014-11-09", "03/2020", "March 2006", "Aug 2008", "2014", "2014-13", "00/2020", "long ago", "", None, "Foo 2020"]
    want = ["2019-11", "2019-01", "2014-11", "2020-03", "2006-03", "2008-08", "2014-01", None, None, None, None, None, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(month_text(month_index(F.col("t")))).collect()] == want
    assert [r[0] for r in spark.createDataFrame([(t,) for t in ("Present", " now", "", None, "2020")], "t string").select(is_open_end(F.col("t"))).collect()] == [True, True, True, True, False]
