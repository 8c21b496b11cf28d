import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rollweave.functions.segments import index_hashes, index_keys, probe_hashes, probe_keys
from rollweave.llm import names as N
from rollweave.llm.canonical import Matcher, compact, deletes, fold, match_values, matchers, title_forms, weighted_distance
from rollweave.llm.linkage import linked, profile, profiles
from rollweave.llm.survivors import survivors, truth_discovery
from rollweave.llm.variants import firm_groups, pairs_within, person_groups
from rollweave.llm.vocabulary import TITLES


def osa(a, b):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def slip(rnd, s):
    i = rnd.randrange(len(s))
    return rnd.choice([s[:i] + s[i + 1 :], s[:i] + rnd.choice("abz") + s[i:], s[:i] + rnd.choice("abz") + s[i + 1 :], s[:i] + s[i : i + 2][::-1] + s[i + 2 :]])


def test_segments_meet_within_their_edits():
    rnd = random.Random(6)
    for _ in range(3000):
        a = "".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 14)))
        b = slip(rnd, a)
        assert osa(a, b) > 1 or index_keys(a, 1) & probe_keys(b, 1)
        c = slip(rnd, b) if b else b
        assert osa(a, c) > 1 or index_keys(a, 1) & probe_keys(c, 1)


def test_banded_distance_equals_the_full_one():
    rnd = random.Random(7)
    for _ in range(2000):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 8))) for _ in range(2))
        for k in (1, 2, 3):
            assert N.edits(a, b, k) == min(osa(a, b) if a and b else max(len(a), len(b)), k + 1)
        if a and b:
            assert weighted_distance(a, b)[0] >= osa(a, b)


@pytest.mark.parametrize(
    ("text", "given", "surname"),
    [
        ("Ewa Selorver", "ewa", "selorver"), ("Selorver, Ewa", "ewa", "selorver"), ("SELORVER Ewa", "ewa", "selorver"), ("Selorver, Ewa K.", "ewa", "selorver"), ("Ewa K. Selorver", "ewa", "selorver"), ("Ewa Sel orver", "ewa", "selorver"),
        ("Dr. Ewa Selorver", "ewa", "selorver"), ("Ewa Selorver, PhD", "ewa", "selorver"), ("Ewa Selorver Jr.", "ewa", "selorver"), ("Ewa Selorver (they)", "ewa", "selorver"), ("Ewa “Evi” Selorver", "ewa", "selorver"), ("EwaSelorver", "ewa", "selorver"),
        ("Zoë  Ölberg", "zoe", "olberg"), ("E. Selorver", "e", "selorver"), ("selorver ewa", "selorver", "ewa"),
    ],
)
def test_names(text, given, surname):
    n = N.parse_name(text)
    assert (n.given, n.surname) == (given, surname)


def test_parts():
    assert N.parse_name("Selorver Ewa", frozenset(["ewa"]))[:2] == ("ewa", "selorver")
    assert all(N.parse_name(t) is None for t in (None, "", "Ewa", "a@b.example", "??", "-"))
    assert N.given_likeness("bill", "william") == 1 and N.given_likeness("w", "william") == 0.5 and N.given_likeness("ewa", "uma") == 0
    assert {N.phone_key(p) for p in ("(411) 555-0123", "+1 411 555 0123", "0014115550123", "411.555.0123 x9", "tel: 411 5550123")} == {"4115550123"}
    assert N.phone_key("0000000") is None and N.phone_key(None) is None and N.phone_key("12") is None
    assert N.mail_parts(" A.b+jobs@@H.example;") == ("a.b", "h.example") and N.mail_parts("n/a") is None and N.mail_parts("x at h.test") == ("x", "h.test")
    one = [N.parse_firm(f) for f in ("Krydo Marine Corp", "KRYDO Marine", "Krydo-Marine", "KrydoMarine", "Marine, Krydo", "The Krydo Marine Company", "Krydo Marine (Corp)")]
    assert N.parse_firm("Krydo Marine GmbH") == N.parse_firm("Krydo Marine G.m.b.H.") == N.parse_firm("Marine, Krydo") == N.parse_firm("KrydoMarine A.G.") == one[0]
    boxes = [N.box_names(b, N.Name("vincent", "kreosquist", "")) for b in ("vincent.kreosquist", "vkreosquist92", "vincentkreosquits", "vince_kreosquist", "kreosquist.v.12", "family.kreosquist", "ann.other", "")]
    assert boxes == [1.0, 0.8, 1.0, 0.9, 0.8, 0, 0, 0]
    assert len(set(one)) == 1 and N.parse_firm("self-employed") is None and N.parse_firm("-") is None and N.parse_firm(None) is None
    assert N.firm_likeness(one[0], N.parse_firm("Krydo Systems Ltd")) == 0 and N.firm_likeness(one[0], N.parse_firm("KRM")) == 0.6


def people(spark, rows):
    df = spark.createDataFrame(rows, "side int, row bigint, name string, mail string, phone string, firm string")
    return df.select("side", "row", F.col("name").alias("spelling"), "firm", profile(F.col("name"), F.col("mail"), F.col("phone"), F.col("firm"), [], ["ann", "bob", "zoe", "liz"]).alias("p"))


PEOPLE = [
    (0, 1, "Ann Kalovric", "ann.kalovric@a.example", "411 555 0101", "Krydo Marine Corp"),
    (0, 2, "Ann Kalovric", "ann.kalovric@a.example", "411 555 0101", "Krydo Marine Corp"),
    (0, 3, "Bob Tarenzo", None, "411 555 0202", None),
    (0, 4, None, "zoe.malgrin@b.example", "411 555 0303", None),
    (0, 5, "Liz Doranvel", None, None, "Optfe Foods AG"),
    (0, 6, "Ann Kalovric", None, "411 555 0909", "Other Textiles"),
    (0, 7, None, None, None, None),
    (0, 8, "", "", "", ""),
    (1, 11, "Kalovric, Ann", None, "(411) 555-0101", None),
    (1, 12, "A. Kalovric", "ann.kalovric+cv@a.example", None, None),
    (1, 13, "Zoe Malgrin", None, "4115550303", None),
    (1, 14, "Max Otherman", None, "411 555 0202", None),
    (1, 15, "Elizabeth Doranvle", None, "411 555 0606", "OPTFE Foods"),
    (1, 16, None, None, None, None),
]


def test_links(spark):
    rows = profiles(people(spark, PEOPLE))
    edges = {(r["u"], r["v"]): r["confidence"] for r in linked(rows.select("node", "side", "p"), across=True).collect()}
    node = {r["row"]: r["node"] for r in rows.collect()}
    assert node[1] == node[2]
    want = {(1, 11), (2, 11), (1, 12), (2, 12), (4, 13), (5, 15)}
    got = {(a, b) for a in node for b in node if (node[a], node[b]) in edges and a < 10 < b}
    assert got == want and all(0 < c <= 1 for c in edges.values())
    assert linked(rows.limit(0).select("node", "side", "p"), across=True).count() == 0


@pytest.mark.parametrize("across", [True, False])
def test_a_hot_line_links_what_brute_force_links(spark, across):
    rnd = random.Random(11)
    stems = ["Kalovric", "Tarenzo", "Malgrinov", "Brundenolt", "Doranvelik", "Selorver"]
    rows = [(k // 6 % 2, k, f"{rnd.choice(['Ann', 'Anna', 'Bob', 'Zoe', 'Zoey'])} {s if rnd.random() < 0.3 else slip(rnd, s).title()}", None, "411 555 0101", None) for k, s in enumerate(stems * 40)]
    nodes = profiles(people(spark, rows))
    node = {r["row"]: r["node"] for r in nodes.collect()}
    name = {node[r[1]]: N.parse_name(r[2], frozenset(["ann", "bob", "zoe"])) for r in rows}
    side = {node[r[1]]: r[0] for r in rows}
    got = {(r["u"], r["v"]) for r in linked(nodes.select("node", "side", "p"), across).collect()}
    want = {(u, v) for u in name for v in name if (side[u] == 0 and side[v] == 1 if across else u < v) and N.name_likeness(name[u], name[v]) >= 0.4}
    assert len(want) > 400 and want <= got
    assert all(N.surname_likeness(name[u].surname, name[v].surname) or N.edits(name[u].surname, name[v].surname, 3) <= 3 for u, v in got)


def test_rows_without_a_name_keep_their_links_on_a_hot_line(spark):
    rows = [(k % 2, k, f"Bob {a}{b}{c}", None, "411 555 0101", None) for k, (a, b, c) in enumerate((a, b, c) for a in ("Fil", "Mor", "Tes", "Wal") for b in ("enst", "igo", "urb", "avel") for c in ("one", "ook", "ield", "orth", "and", "esk"))]
    rows += [(0, 5000, None, "zoe.malgrinov@a.example", "411 555 0101", None), (1, 5001, "Zoe Malgrinov", None, "411 555 0101", None), (1, 5002, "Z. Malgrinov", None, "411 555 0101", None)]
    table = profiles(people(spark, rows))
    node = {r["row"]: r["node"] for r in table.collect()}
    got = {(r["u"], r["v"]) for r in linked(table.select("node", "side", "p"), across=True).collect()}
    assert {v for u, v in got if u == node[5000]} == {node[5001], node[5002]}


@pytest.mark.parametrize("across", [True, False])
def test_large_classes_link_alike_given_names(spark, across):
    givens = ["Alexander", "Al", "A", "Alexandra", "Alxeandre", "Andrew", "Drew", "Anna", "Ana", "Agnieszka", "Aga"]
    rows = [(side, 100 * side + k, f"{g} Kalovric", f"box{side}{k}@a.example", None, "Krydo Marine") for side in (0, 1) for k, g in enumerate(givens)]
    nodes = profiles(people(spark, rows))
    node = {r["row"]: r["node"] for r in nodes.collect()}
    plain = {node[r[1]]: (N.plain(r[2].split()[0]), r[0]) for r in rows}
    got = {(r["u"], r["v"]) for r in linked(nodes.select("node", "side", "p"), across).collect()}
    full = {(u, v) for u, (g, s) in plain.items() for v, (h, t) in plain.items() if (s == 0 and t == 1 if across else u < v) and min(len(g), len(h)) > 1 and N.given_likeness(g, h) >= 0.4}
    assert full == {e for e in got if min(len(plain[e[0]][0]), len(plain[e[1]][0])) > 1}


def test_namesakes_of_one_firm_are_tied_without_all_pairs(spark):
    rows = [(k % 2, k, "Ann Kalovric", f"box{k}@a.example" if k % 3 else None, f"411 555 {k:04d}", ("Krydo Marine", "KRYDO Marine Corp", "Krydo Marnie", "KRM")[k % 4]) for k in range(300)]
    rows += [(0, 900, "A. Kalovric", None, "411 555 0007", None), (1, 901, "Ann Kalovric", None, "411 777 0000", "Other Textiles")]
    table = people(spark, rows)
    nodes = profiles(table).select("node", "side", "p")
    edges = linked(nodes, across=False)
    assert nodes.count() == 302 and edges.count() < 5 * 300
    groups = {}
    for r in person_groups(table).collect():
        groups.setdefault(r["spelling"], set()).add(r["component"])
    assert len(groups["Ann Kalovric"]) == 2 and groups["A. Kalovric"] < groups["Ann Kalovric"]


def test_repeats_tell_slips_from_surnames(spark):
    # one surname that comes again as often as the other isn't its slip, however many rows there are
    for m in (1, 6):
        rows = [(0, k, "Ann Kalovric", None, f"411 555 1{k:03d}", "Krydo Marine") for k in range(m)] + [(1, 100 + k, "Ann Kalovrik", None, f"411 555 2{k:03d}", "Krydo Marine") for k in range(m)]
        rows += [(0, 200 + k, "Bob Tarenzo", None, f"411 555 3{k:03d}", "Krydo Marine") for k in range(10 * m)] + [(1, 400 + k, "Bob Tarenzzo", None, f"411 555 4{k:03d}", "Krydo Marine") for k in range(m)]
        table = profiles(people(spark, rows))
        node = {r["row"]: r["node"] for r in table.collect()}
        got = {(r["u"], r["v"]) for r in linked(table.select("node", "side", "p"), across=True).collect()}
        assert ((node[0], node[100]) in got) == (m == 1) and (node[200], node[400]) in got


def test_neighbours_back_weak_edges(spark):
    # the firm alone doesn't make a slip of a surname that comes again, but a row that bears both over a line does
    rows = [(0, 1, "Ann Kalovric", None, "411 555 0101", "Krydo Marine"), (0, 2, "Ann Kalovric", None, "411 555 0102", "Other Textiles"), (1, 3, "Ann Kalovrik", None, "411 555 0103", "Krydo Marine"), (1, 4, "Ann Kalovrik", None, "411 555 0104", "Bolt Foods")]
    for more, backed in (((), False), (((1, 5, "Ann Kalovrik", None, "411 555 0101", None),), True)):
        table = profiles(people(spark, [*rows, *more]))
        node = {r["row"]: r["node"] for r in table.collect()}
        got = {(r["u"], r["v"]) for r in linked(table.select("node", "side", "p"), across=True).collect()}
        assert ((node[1], node[3]) in got) == backed


def test_hashed_segments_meet_within_their_edits(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 14))) for _ in range(60)]
    texts = sorted({*base, *(slip(rnd, a) for a in base), *(slip(rnd, b) for b in (slip(rnd, a) for a in base) if b)} - {""})
    df = spark.createDataFrame([(t,) for t in texts], "t string")

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            diag, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (x != y))
        return row[-1]

    for k in (2, 3, 4):
        keys = {r["t"]: (set(r["i"]), set(r["p"])) for r in df.select("t", index_hashes(F.col("t"), k, F.lit("b")).alias("i"), probe_hashes(F.col("t"), k, F.lit("b")).alias("p")).collect()}
        assert all(keys[a][0] & keys[b][1] for a in texts for b in texts if len(a) <= len(b) and lev(a, b) <= k)


def test_spellings(spark):
    groups = person_groups(people(spark, PEOPLE))
    got = {tuple(r) for r in pairs_within(groups, "component", "spelling").collect()}
    assert ("Ann Kalovric", "Kalovric, Ann") in got and ("Elizabeth Doranvle", "Liz Doranvel") in got and ("A. Kalovric", "Ann Kalovric") in got
    assert not any("Otherman" in a + b or a == "" for a, b in got)
    firms = ["Krydo Marine Corp"] * 5 + ["KRYDO Marine", "Kryydo Marine Corp", "Krydo Systems Ltd", "KRM", "freelance", None, "", "Krydo Marine Corp "]
    df = spark.createDataFrame([(f,) for f in firms], "e string")
    none = spark.createDataFrame([], "component bigint, spelling string")
    pairs = {tuple(r) for r in pairs_within(firm_groups(df, "e", none), "firm", "spelling").collect()}
    same = sorted(["Krydo Marine Corp", "KRYDO Marine", "Kryydo Marine Corp", "KRM", "Krydo Marine Corp "])
    assert pairs == {(a, b) for a in same for b in same if a < b}


def test_survivors_and_reliability(spark):
    t = lambda d: datetime(2024, 1, d)
    rows = [
        ("g", "name", 1, "a b", "good", t(1)), ("g", "name", 2, "a b", "bad", t(9)), ("g", "name", 3, "x y", "good", t(9)), ("g", "name", 4, None, "good", t(20)),
        ("h", "name", 5, "p q", "bad", t(2)), ("h", "name", 6, "p q", "good", t(2)), ("i", "name", 7, "s", None, None), ("i", "mail", 8, None, "good", t(1)), (None, "name", 9, "z", "good", t(1)),
        ("k", "name", 10, "u", "bad", t(3)), ("k", "name", 11, "w", "good", t(1)), ("k", "name", 12, "w", "good", t(1)),
        # old copies of a replaced value don't vote it back
        *[("l", "name", 20 + i, "old", s, t(1)) for i, s in enumerate(("bad", "bad", "other", None))], ("l", "name", 30, "new", "bad", t(5)),
    ]
    df = spark.createDataFrame(rows, "gid string, field string, row bigint, value string, source string, at timestamp")
    got = {(r["gid"], r["field"]): r["row"] for r in survivors(df, {"good": 0, "bad": 1}).collect()}
    # k: neither claim beats the other, the better supported value stays
    assert got == {("g", "name"): 3, ("h", "name"): 6, ("i", "name"): 7, ("k", "name"): 11, ("l", "name"): 30}
    assert survivors(df.limit(0), {"good": 0}).count() == 0
    votes = spark.createDataFrame([(f"g{i}", "f", "right" if s != "c" else f"wrong{i}", s, 1) for i in range(30) for s in "abc"], "gid string, field string, value string, source string, n bigint")
    reliability, support = truth_discovery(votes, {"a": 0.5, "b": 0.5, "c": 0.5})
    assert reliability["c"] < 0.3 < 0.7 < reliability["a"]
    assert {r["value"] for r in support.filter("support > 0.5").collect()} == {"right"}


def test_votes_overrule_the_newest_claim(spark):
    # "fresh" is always later than the better trusted "a", and neither is overtaken; what the other groups tell of "fresh" decides
    t = lambda d: datetime(2024, 1, d)
    pair = [("g", "f", 1, "of a", "a", t(1)), ("g", "f", 2, "of fresh", "fresh", t(9))]
    got = {}
    for good in (True, False):
        rows = list(pair)
        for i in range(60):
            rows += [(f"h{i}", "f", 100 * i + 10, "x", "a", t(1)), (f"h{i}", "f", 100 * i + 11, "x" if not good or i % 3 else "y", "a2", t(1)), (f"h{i}", "f", 100 * i + 12, ("y" if i % 3 == 0 else "z") if good else f"no{i}", "fresh", t(9))]
            rows += [(f"h{i}", "f", 100 * i + 13, rows[-1][3], "fresh2", t(9))] if good else []
        df = spark.createDataFrame(rows, "gid string, field string, row bigint, value string, source string, at timestamp")
        got[good] = {r["gid"]: r["row"] for r in survivors(df, {"a": 0, "a2": 0, "fresh": 1, "fresh2": 1}).collect()}["g"]
    assert got == {True: 2, False: 1}


def test_matcher():
    m = Matcher([(1, "Software Engineer"), (2, "Data Analyst"), (3, "Sales Manager")], TITLES, titles=True)
    want = {"software engineer": 1, "Sotfware Engineer": 1, "Sr. Programmer (remote)": 1, "Engineer, Software, Platform team": 1, "lead data analyst - contract": 2, "Analyst (Data) (m/f/x)": 2, "Junior Head of Sales": 3, "oboist": 0, "": 0, " ": 0, "x" * 5000: 0}
    assert {k: m.find(k) for k in want} == want
    assert m.find("DATA  ANALYST II") == 2 and "data analyst" in title_forms("senior data analyst (remote)")
    c = Matcher([(4, "Niger"), (5, "Nigeria"), (6, "CI/CD"), (7, "C#"), (8, "C++")])
    assert [c.find(x) for x in ("niger", "Nigria", "ci-cd", "c#", "C ++", "none")] == [4, 5, 6, 7, 8, 0]
    assert fold("  Ä  b ") == "ä b" and compact("Node.JS!") == "nodejs" and deletes("abc", 1) == {"abc", "ab", "ac", "bc"}


def test_match_values(spark):
    df = spark.createDataFrame([("l", "Pyhton", 0), ("l", None, 0), ("l", "", 0), ("no", "Python", 0), ("l", "python", 0), ("l", "Snake", 7), ("l", "Pyhton", 0)], "list string, v string, n int")
    entries = spark.createDataFrame([("l", 9, "Python"), ("l", 10, None), ("k", 11, "Python")], "list_name string, item_id bigint, canonical_value string")
    aliases = spark.createDataFrame([("l", " PYTHON", "snake", 0), ("k", "Python", "other", 0), ("x", "none", "none", 0)], "list_name string, canonical_value string, other_name string, place int")
    m = matchers(entries, aliases)
    got = sorted((r["list"], r["v"] or "-", r["item_id"]) for r in match_values(df, "list", "v", m).collect())
    assert got == [("l", "-", 0), ("l", "-", 0), ("l", "Pyhton", 9), ("l", "Pyhton", 9), ("l", "Snake", 9), ("l", "python", 9), ("no", "Python", 0)]
    assert m["l"].counts == {9: 2} and match_values(df.limit(0), "list", "v", m).count() == 0
    with pytest.raises(ValueError, match="too long"):
        matchers(entries, aliases, most_entries=1)
    with pytest.raises(ValueError, match="strings"):
        Matcher([(i, f"{i:030d}") for i in range(3000)])
