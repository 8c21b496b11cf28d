import json
from datetime import datetime

from rollweave.functions.tree_edit import Node, assign, edit_script, parse_type
from rollweave.operators.drift import file_schemas, one_table, same_fields, schema_changes


def test_assignment_is_minimal():
    import itertools
    import random

    rnd = random.Random(1)
    for n in (1, 2, 4, 6):
        cost = [[rnd.random() for _ in range(n)] for _ in range(n)]
        best = min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert abs(sum(cost[i][j] for i, j in enumerate(assign(cost))) - best) < 1e-9


def test_edit_script_kinds():
    old = [Node("applicant_name", "string", 0b0111), Node("yoe", "integer"), Node("gone", "string", 0b110000), Node("flag", "string")]
    new = [Node("candidateName", "string", 0b1110), Node("yoe", "decimal"), Node("flag", "boolean"), Node("interview_slot", "string", 0b11000000)]
    kinds = {(e.kind, e.before, e.after) for e in edit_script(old, new)}
    assert kinds == {("renamed", "applicant_name", "candidateName"), ("retyped", "yoe", "yoe"), ("retyped", "flag", "flag"), ("removed", "gone", ""), ("added", "", "interview_slot")}
    assert edit_script(old, list(reversed(old))) == []
    # what the whole corpus says goes before the two files
    told = edit_script(old, new, known={("applicant_name", "candidateName"): 0.0, ("gone", "interview_slot"): 0.9})
    assert {(e.kind, e.before, e.after) for e in told} >= {("renamed", "gone", "interview_slot"), ("removed", "applicant_name", ""), ("added", "", "candidateName")}


def test_moves_below_the_top():
    old = [Node("city", "string", 0b11), Node("contact", "object", children=[Node("phone", "string")])]
    new = [Node("contact", "object", children=[Node("phone", "string")]), Node("place", "object", children=[Node("town", "string", 0b11)])]
    assert ("moved", "city", "place.town") in {(e.kind, e.before, e.after) for e in edit_script(old, new, deep=True)}


def test_types():
    assert parse_type("DECIMAL(2,1)")[0] == "decimal" and parse_type("DECIMAL(23,0)")[0] == "integer" and parse_type("VOID")[0] == ""
    kind, kids = parse_type("OBJECT<a: BIGINT, b: OBJECT<c: ARRAY<STRING>>>")
    assert kind == "object" and [(k.label, k.type) for k in kids] == [("a", "integer"), ("b", "object")] and kids[1].children[0].type == "array"


def day(n):
    return datetime(2024, 1, n)


ROWS = [
    ("a", 2, day(5), '{"full_name": "Ann Poe", "yoe": 2.5, "extra": null}'),
    ("a", 1, day(3), '{"applicant_name": "Ann Poe", "yoe": 2}'),
    ("a", 1, day(3), '{"applicant_name": null, "yoe": 2}'),
    ("a", 1, day(3), "broken"),
    ("a", 1, day(3), None),
    ("a", 3, day(9), '{"full_name": {"given": "Ann", "family": "Poe"}, "yoe": 1.5}'),
    ("b", 9, day(4), '{"applicant_name": "Ann Poe", "name": "A. P.", "feed": [1, 2], "more": {"k": [true]}, "o d\'d": "x", "skills_list": "a; b,,c", "tags": [{"t": 1}]}'),
]


def test_changes_and_table(spark):
    df = spark.createDataFrame(ROWS, "feed string, file_no bigint, exported_at timestamp, payload string")
    schemas = file_schemas(df, "feed", "file_no", "exported_at", "payload")
    changes = schema_changes(schemas)
    got = {tuple(r) for r in changes.collect()}
    assert got == {
        ("a", 2, "renamed", "applicant_name", "full_name"),
        ("a", 2, "retyped", "yoe", "yoe"),
        ("a", 2, "added", "", "extra"),
        ("a", 3, "retyped", "full_name", "full_name"),
        ("a", 3, "removed", "extra", ""),
    }
    one = one_table(df, "payload", same_fields(schemas, changes), ["feed", "file_no"])
    rows = one.select("file_no", "applicant_name", "years_of_experience").collect()
    assert sorted((r[0], r[1] or "", r[2] or 0) for r in rows) == [(1, "", 0), (1, "", 0), (1, "", 2.0), (1, "Ann Poe", 2.0), (2, "Ann Poe", 2.5), (3, "Ann Poe", 1.5), (9, "Ann Poe", 0)]
    # every key has a column, arrays and objects stay whole, and what another key of the same field says isn't lost
    last = one.filter("file_no = 9").first().asDict()
    assert (last["feed"], last["feed_field"], last["more"], last["o_d_d"], last["skills_list"], last["tags"], last["also"]) == ("b", "1; 2", '{"k":[true]}', "x", ["a", "b", "c"], '[{"t":1}]', {"name": '"A. P."'})
    # a key that no field knows is kept too
    assert one_table(df, "payload", {"yoe": ["yoe"]}, ["file_no"]).filter("file_no = 9").first()["also"].keys() == {"applicant_name", "name", "feed", "more", "o d'd", "skills_list", "tags"}


def test_renames_are_told_by_values_alone(spark):
    # no word of the keys is shared; the cities are, and keys that stand side by side in a file are never one field
    cities = ["Lyon", "Oslo", "Pune", "Bern"]
    rows = [("f", n, day(1 + n), json.dumps({("p" if n % 2 else "q"): cities[(n + k) % 4], "r": cities[(n * k) % 4], "s": f"{n}{k}x"})) for n in range(8) for k in range(6)]
    schemas = file_schemas(spark.createDataFrame(rows, "feed string, file_no bigint, exported_at timestamp, payload string"), "feed", "file_no", "exported_at", "payload")
    assert {(r["change_kind"], r["field_before"]) for r in schema_changes(schemas).collect()} == {("renamed", "p"), ("renamed", "q")}
    both = schema_changes(file_schemas(spark.createDataFrame([*rows, ("g", 1, day(2), '{"p": "Lyon", "q": "Oslo"}'), ("g", 2, day(3), '{"q": "Oslo", "p": "Pune"}')], "feed string, file_no bigint, exported_at timestamp, payload string"), "feed", "file_no", "exported_at", "payload"))
    assert {r["change_kind"] for r in both.collect()} == {"added", "removed"}


def test_long_feed_takes_the_next_earlier_file(spark):
    rows = [("f", n, datetime(2024, 1 + n // 5, 1 + n % 5), json.dumps({f"k{n}": 1, "same": "x"})) for n in range(40)]
    got = schema_changes(file_schemas(spark.createDataFrame(rows, "feed string, file_no bigint, exported_at timestamp, payload string"), "feed", "file_no", "exported_at", "payload")).collect()
    removed = {(r["file"], r["field_before"]) for r in got if r["field_before"].startswith("k")}
    assert removed == {(n, f"k{n - 1}") for n in range(1, 40)}


def test_empty(spark):
    df = spark.createDataFrame([], "feed string, file_no bigint, exported_at timestamp, payload string")
    assert schema_changes(file_schemas(df, "feed", "file_no", "exported_at", "payload")).count() == 0


def test_deep_changes(spark):
    rows = [("f", 1, day(1), '{"contact": {"phone": "1", "city": "Lyon"}, "a": [1]}'), ("f", 2, day(2), '{"contact": {"phone": 1, "city": "Lyon", "fax": "2"}, "a": ["x"]}')]
    df = spark.createDataFrame(rows, "feed string, file_no bigint, exported_at timestamp, payload string")
    flat, deep = ({tuple(r)[2:] for r in schema_changes(file_schemas(df, "feed", "file_no", "exported_at", "payload", d), d).collect()} for d in (False, True))
    assert flat == set() and deep == {("retyped", "contact.phone", "contact.phone"), ("added", "", "contact.fax")}


def test_nested_fields_are_part_of_the_schemas(spark):
    rows = [("f", 1, day(1), '{"contact": {"phone": "1"}, "jobs": [{"firm": "x"}], "a": 1}'), ("f", 1, day(1), '{"contact": {"city": "Lyon", "at": {"zip": 5}}}'), ("f", 2, day(2), '{"contact": {"phone": 1}, "jobs": [{"firm": 1, "until": "y"}], "a": 1}')]
    df = spark.createDataFrame(rows, "feed string, file_no bigint, exported_at timestamp, payload string")
    schemas = file_schemas(df, "feed", "file_no", "exported_at", "payload")
    held = {(r["file"], x["key"]): x["nested"] for r in schemas.collect() for x in r["fields"]}
    tree = dict((k.label, (k.type, [c.label for c in k.children])) for k in parse_type(held[1, "contact"])[1])
    assert tree == {"at": ("object", ["zip"]), "city": ("string", []), "phone": ("string", [])}
    assert [(k.label, k.type) for k in parse_type(held[2, "jobs"])[1]] == [("firm", "integer"), ("until", "string")]
    assert len({r["signature"] for r in schemas.collect()}) == 2
    # only the top level is told unless more is asked for
    assert schema_changes(schemas).count() == 0
    assert {tuple(r)[2:] for r in schema_changes(schemas, True).collect()} >= {("retyped", "contact.phone", "contact.phone"), ("removed", "contact.city", ""), ("retyped", "jobs.firm", "jobs.firm"), ("added", "", "jobs.until")}
