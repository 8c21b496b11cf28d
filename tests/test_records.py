import json
import random

import pytest
from pyspark.sql import functions as F

from rollweave.functions import phones
from rollweave.functions.normalize import github_login, norm_country, norm_date, norm_email, norm_name, norm_skill, norm_url, strip_markdown, username
from rollweave.functions.places import Places
from rollweave.functions.text_fields import best_page, repair_spacing
from rollweave.operators.components import connected
from rollweave.operators.merge import years_of
from rollweave.operators.project import Config, confidence_band, path_get, project_json, project_struct, validation_errors
from rollweave.operators.resolve import alike_names, greedy_clusters, lcs_ratio
from rollweave.plans.pipeline import list_configs, list_samples, load_config, read_sources, run
from rollweave.sources.ats import AtsSource, json_claims
from rollweave.sources.csv import CsvSource
from rollweave.sources.answers import agreed_place, parse_answer
from rollweave.sources.documents import docx_text, model_claims, text_claims
from rollweave.sources.models import ChatRoute, chain, read_settings, routes_of
from rollweave.sources.profiles import user_claims


def apply(spark, f, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    return [r[0] for r in df.select(f(F.col("t"))).collect()]


def test_scalar_normalizers(spark):
    assert apply(spark, norm_email, [" A@B.Co ", "a@b", None, "x"]) == ["a@b.co", None, None, None]
    assert apply(spark, norm_name, ["  o'neil  mcDONALD ", "", None, "jean-luc"]) == ["O'Neil Mcdonald", None, None, "Jean-Luc"]
    assert [tuple(r) for r in apply(spark, norm_date, ["2020-3-1", "13/2020", "March 2020", "Sept 2020", "2020", "Present", "", None, "soon"])] == [
        ("2020-03", "exact"), ("2020-13", "exact"), ("2020-03", "exact"), (None, "unparseable"), ("2020-01", "year_only_approximated"), (None, "present"), (None, "present"), (None, "present"), (None, "unparseable"),
    ]
    assert [tuple(r) for r in apply(spark, norm_skill, ["K8s", "ci / cd", "machine vision", ""])] == [("Kubernetes", True), ("CI/CD", True), ("Machine Vision", False), ("", False)]
    assert apply(spark, norm_url, ["(https://www.a.io/x/),", "HTTP://b.c"]) == ["a.io/x", "b.c"]
    assert apply(spark, github_login, ["https://github.com/Octo/repo?x", "octo", "gitlab.com/x", "-bad", ""]) == ["octo", "octo", None, None, None]
    assert apply(spark, username, ["﻿Octo", "https://github.com/Octo/", "github.com/Octo?tab=x"]) == ["Octo", "Octo", "Octo"]
    assert apply(spark, strip_markdown, ["![a](b) [t](u) <i>x</i> `c`"]) == ["  t  x  c"]
    assert apply(spark, lambda c: norm_country(c, spark), ["uk", "zz", "usa", "Germany", "DEU", "Ivory Coast", "nowhere land", None, ""]) == ["UK", "ZZ", "US", "DE", "DE", "CI", None, None, None]
    assert apply(spark, lambda c: norm_country(c, spark, strict=True), ["uk", "zz", "Germany."]) == ["GB", None, "DE"]
    assert apply(spark, lambda c: confidence_band(F.length(c) / 10), ["x" * 8, "x" * 5, "x"]) == ["high", "medium", "low"]


def test_phones():
    assert phones.normalize("(212) 555-1234") == "+12125551234" and phones.normalize("+15550101") is None and phones.normalize("abc") is None
    assert phones.normalize("+44 7911 123456") == "+447911123456" and phones.normalize("") is None and phones.normalize(None) is None
    assert [phones.normalize(x) for x in ("+31 6 12345678", "+351 912 345 678", "+7 912 345-67-89", "+55 11 91234-5678", "+81 3-1234-5678", "+999 123456789")] == ["+31612345678", "+351912345678", "+79123456789", "+5511912345678", "+81312345678", None]
    assert phones.normalize("0612345678", "NL") == "+31612345678" and phones.with_candidates("0612345678", ["nl"]) == ("+31612345678", "NL") and phones.with_candidates("06 1234 5678", ["NL"]) == (None, None)
    assert phones.with_candidates("07911 123456", ["GB"]) == ("+447911123456", "GB")
    assert phones.with_candidates("07911 123456", ["IN", "GB"]) == ("+447911123456", "GB")
    assert phones.with_candidates("98765 43210", ["IN"]) == ("+919876543210", None) or phones.with_candidates("9876543210", ["IN"])[0] == "+919876543210"


def test_places():
    p = Places({"us": "US", "india": "IN", "in": "IN", "united kingdom": "GB"})
    assert p.read("San Francisco, CA") == ("San Francisco", "CA", "US") and p.read("London, United Kingdom") == ("London", None, "GB")
    assert p.read("Bengaluru, Karnataka, India") == ("Bengaluru", "Karnataka", "IN") and p.read("Austin TX") == ("Austin", "TX", "US")
    assert p.read("Remote") is None and p.read("") is None and p.read(None) is None and p.read("a@b, CA") is None


def greedy(entities):
    """The sequential rule, written down as it is stated."""
    clusters, where, firms = [], {}, {}
    for ent, keys, name, firm in entities:
        hits = sorted({where[m] for m, ks, _, _ in [x for c in clusters for x in c] if set(ks) & set(keys)})
        at = hits[0] if hits else None
        if at is None and name and firm:
            for c in firms.get(firm, []):
                if any(n and f == firm and lcs_ratio(" ".join(sorted(n.split())), " ".join(sorted(name.split()))) >= 90 for _, _, n, f in clusters[c]):
                    at = c
                    break
        if at is None:
            at = len(clusters)
            clusters.append([])
        clusters[at].append((ent, keys, name, firm))
        where[ent] = at
        if firm and at not in firms.setdefault(firm, []):
            firms[firm].append(at)
    return {x[0]: clusters[c][0][0] for x in [y for cl in clusters for y in cl] for c in [where[x[0]]]}


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_the_sequential_rule(spark, seed):
    rnd = random.Random(seed)
    names = ["jon smith", "john smith", "smith john", "jane doe", "jane m doe", "bob", None]
    rows = [(i * 2**31, [("email", f"k{rnd.randrange(25)}") for _ in range(rnd.choice([0, 1, 1, 2]))], rnd.choice(names), rnd.choice(["acme", "bolt", None])) for i in range(60)]
    df = spark.createDataFrame([(e, n, c) for e, _, n, c in rows], "ent bigint, name string, company string")
    keys = spark.createDataFrame([(e, a, b) for e, k, _, _ in rows for a, b in k], "ent bigint, kind string, key string").distinct()
    got = {r["ent"]: r["cluster_id"] for r in greedy_clusters(df, keys).collect()}
    assert got == greedy(rows)


def test_alike_names_find_every_pair(spark):
    rnd = random.Random(3)
    words = ["alexander petrov", "alexandre petrov", "petrova alexandra", "jon smith", "john smith", "jonn smithe", "maria del carmen lopez", "maria d carmen lopez"]
    words += ["".join(rnd.choice("abcd ") for _ in range(rnd.randrange(1, 25))).strip() or "x" for _ in range(60)]
    got = {(r["a"], r["b"]) for r in alike_names(spark.createDataFrame([("f", w) for w in words], "company string, sorted string")).collect()}
    assert got == {(a, b) for a in set(words) for b in set(words) if a != b and lcs_ratio(a, b) >= 90}


@pytest.mark.parametrize("local_edges", [0, 10**6])
def test_components(spark, local_edges):
    rnd = random.Random(2)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(500, 501 + i) for i in range(50)]
    parent = {x: x for e in [*edges, (7, 7)] for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(parent[a], parent[b])
            changed |= parent[a] != m or parent[b] != m
            parent[a] = parent[b] = m
    many = spark.createDataFrame([*edges, *edges[:9], (None, 1), (1, None), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in connected(many, "a", "b", local_edges=local_edges).collect()}
    assert got == parent
    assert connected(spark.createDataFrame([], "a bigint, b bigint"), "a", "b", local_edges=local_edges).count() == 0
    named = connected(spark.createDataFrame([("é", "z"), ("b", "é"), ("x", "y")], "a string, b string"), "a", "b", local_edges=local_edges)
    assert {r["node"]: r["component"] for r in named.collect()} == {"é": "b", "z": "b", "b": "b", "x": "x", "y": "x"}


CSV = "Candidate Name,Email Address,Mobile,Company,Position,Tech Stack,Ignored\nAda Poe,ada@x.org,(212) 555-0147,Acme,Engineer,\"Python; React | AWS\",z\nBo Lee,,,Bolt,,,\n,,+15550101,Acme,Engineer,,\nCy Fox,not-a-mail,12,Acme,Lead,,\n"
DOC = {"applicants": [{"applicant_name": "Ada Poe", "contact_email": "ADA@x.org", "job_title": "Sr. Engineer", "location_city": "Austin", "location_state": "TX", "location_country": "USA", "skills_list": ["python", "py", "Weaving"], "work_history": [{"employer": "Acme", "role": "Engineer", "start_date": "2021-01", "end_date": None}, {"note": 1}], "education": {"school": "U", "degree_type": "BS", "graduation_year": 2020}}, "junk", {"profile": {"name": "Di"}, "contact": {"phones": ["+44 7911 123456"]}, "location": "Bengaluru, Karnataka, India", "skills": "a, b; c"}]}


def test_pipeline_from_files(spark, tmp_path):
    (tmp_path / "r.csv").write_text(CSV, encoding="utf-8")
    (tmp_path / "a.json").write_text(json.dumps(DOC), encoding="utf-8")
    r = run(spark, [("csv", CsvSource(), str(tmp_path / "r.csv")), ("ats", AtsSource(), str(tmp_path / "a.json")), ("none", CsvSource(), str(tmp_path / "no.csv"))], load_config("full"), as_of=2026 * 12 + 7)
    assert r.status == {"csv": "ok", "ats": "ok", "none": "(empty/not found)"}
    g = {x["full_name"]: x for x in r.merged.golden.collect()}
    assert set(g) == {"Ada Poe", "Bo Lee", "Cy Fox", "Di"}
    ada = g["Ada Poe"]
    assert ada["emails"] == ["ada@x.org"] and ada["phones"] == ["+12125550147"] and ada["headline"] == "Engineer" and ada["years_experience"] == 5.5
    assert [(s["name"], s["confidence"], s["sources"]) for s in ada["skills"]] == [("Python", 1.0, ["ats_json", "recruiter_csv"]), ("React", 0.95, ["recruiter_csv"]), ("AWS", 0.95, ["recruiter_csv"]), ("Weaving", 0.5, ["ats_json"])]
    # name, mail agree (1.0), phone, city, state, country .95, skills .85, experience and education .85, derived years .60: mean over ten fields
    assert ada["overall_confidence"] == pytest.approx((1 + 1 + 0.95 * 4 + 0.85 + 0.85 * 2 + 0.6) / 10)
    assert g["Di"]["phones"] == ["+447911123456"] and g["Di"]["location"]["country"] == "IN" and len(g["Di"]["skills"]) == 3
    assert {(x["field"], x["chosen"]) for x in r.merged.conflicts.collect()} == {("title", "recruiter_csv")}
    assert {(x["field"], x["value"]) for x in r.merged.rejections.collect()} == {("emails", "not-a-mail"), ("phones", "12")}
    s = r.summary()
    assert s["records"] == 4 and s["conflicts_found"] == 1 and s["rejections"] == 2


def test_nothing_to_read(spark, tmp_path):
    claims, status = read_sources(spark, [("x", AtsSource(), str(tmp_path / "no.json"))])
    assert claims.count() == 0 and status == {"x": "(empty/not found)"}
    assert json_claims(spark.createDataFrame([("{not valid",), (None,), ("[]",), ('{"skills": "a"}',)], "p string"), "p").count() == 0
    assert run(spark, []).summary()["records"] == 0


def test_years(spark):
    df = spark.createDataFrame([([("2020-01", "2020-07"), ("2020-05", None)],), ([("x", "y")],), ([],), (None,)], "e array<struct<start:string,end:string>>")
    assert [r[0] for r in df.select(years_of(F.col("e"), 2021 * 12 + 1)).collect()] == [1.0, None, None, None]


def test_projection_and_validation(spark):
    df = spark.createDataFrame([("1", "A", ["x", None], {"city": None}, 2.0), ("2", None, [], None, None)], "candidate_id string, full_name string, emails array<string>, location struct<city:string>, years double")
    cols = {p: path_get(df.schema, p)[0] for p in ("full_name", "emails[0]", "emails[5]", "emails[]", "location.city", "no.such", "emails[x]")}
    r = df.select(*[c.alias(p.replace(".", "_")) for p, c in cols.items()]).first()
    assert tuple(r) == ("A", "x", None, ["x"], None, None, None)
    strict = Config.of({"fields": [{"path": "n", "from": "full_name", "required": True}], "include_confidence": False, "on_missing": "error"})
    p = {x["candidate_id"]: x for x in project_struct(df, strict).collect()}
    assert p["1"]["record"]["n"] == "A" and p["1"]["error"] is None and p["2"]["record"] is None and "n" in p["2"]["error"]
    omit = Config.of({"fields": [{"path": "n", "from": "full_name"}, {"path": "place", "from": "location", "type": "object"}, {"path": "mail", "from": "emails", "type": "string[]"}], "include_confidence": False, "on_missing": "omit"})
    j = {x["candidate_id"]: json.loads(x["json"]) for x in project_json(df, omit).collect()}
    assert j == {"1": {"n": "A", "place": {"city": None}, "mail": ["x", None]}, "2": {}}
    check = Config.of({"fields": [{"path": "a", "type": "string[]"}, {"path": "b", "required": True}, {"path": "c", "type": "number"}]})
    docs = spark.createDataFrame([(json.dumps({"a": ["x", 1], "c": True, "overall_confidence": "hi"}),), ("{",), (None,)], "j string")
    errs = [[(e["field"]) for e in r[0]] for r in docs.select(validation_errors(F.col("j"), check)).collect()]
    assert errs == [["a[1]", "b", "overall_confidence", "provenance"], [""], [""]]
    for bad in ({}, {"fields": [{}]}, {"fields": [], "on_missing": "x"}, {"fields": [{"path": "a"}, {"path": "a.b"}]}):
        with pytest.raises(ValueError, match="."):
            Config.of(bad)
    assert [c["name"] for c in list_configs()] == ["brief", "contact", "full"]


RESUME = "J A N E\nP O E\njane@x.org | (212) 555-0147 | Austin, TX\ngithub.com/jpoe\nSkills\nLanguages: Python, Cobol and Weaving\nTools: Loom work\nExperience\nEngineer Jan 2020 - Present\nAcme Remote\nBuilt looms\nEducation\nState University\nBachelor of Science in Looms 2012 - 2016\n"


RESUME_2 = """Bo Lee
bo@lee.io
+91 98765 43210
https://www.linkedin.com/in/bolee/ , bolee.dev
PROFESSIONAL SUMMARY
Developerwith applicationusing React based tools,andworking fast .
Work Experience
• Senior Dev | Jan 2019 to Dec 2021
Bolt - Remote
- shippedthings
- more Remote
Junior Dev 2017 – 2019
Nut Inc
Education
B.Tech in CS, IIT Delhi 2013-2017
CGPA 9
MIT Boston, Master of Science 2018
Technical Skills & Tools
Knows: C++, Go; weaving and Excel
Hands on NLP and SQL
Craft: felting, 40 projects, weaving
Projects
see github.com/bo/x and http://foo.bar/doi 2125550147
Skills
Soft: Python
"""


def test_documents(spark):
    df = spark.createDataFrame([(1, RESUME), (2, RESUME_2), (3, ""), (4, None), (5, "  \n "), (6, "x")], "n int, t string")
    rows = text_claims(df, "t", F.col("n")).orderBy("ord").collect()
    got = {n: [(r["field"], r["value_text"] or tuple(r["value_exp"] or r["value_edu"])) for r in rows if r["ord"]["row"] == n] for n in range(1, 7)}
    assert {r["ord"]["row"]: r["candidate_key"] for r in rows} == {1: "jane@x.org", 2: "bo@lee.io", 6: "x"}
    assert got[1] == [
        ("full_name", "Jane Poe"), ("emails", "jane@x.org"), ("phones", "(212) 555-0147"), ("links.github", "github.com/jpoe"), ("location.city", "Austin"), ("location.region", "TX"), ("location.country", "US"),
        ("skills", "Python"), ("skills", "Loom work"), ("experience", ("Acme", "Engineer", "Jan 2020", "Present", "Built looms")), ("education", ("State University", "Bachelor of Science", "Looms", "2016")),
    ]
    assert got[2] == [
        ("full_name", "Bo Lee"), ("emails", "bo@lee.io"), ("phones", "+91 98765 4321"), ("links.linkedin", "linkedin.com/in/bolee"), ("links.portfolio", "bolee.dev"), ("links.other", "github.com/bo"), ("links.other", "foo.bar/doi"),
        ("skills", "C++"), ("skills", "Excel"), ("skills", "SQL"), ("skills", "NLP"), ("skills", "felting"), ("skills", "weaving"), ("skills", "Python"),
        ("experience", ("Bolt", "Senior Dev", "Jan 2019", "Dec 2021", "shippedthings")), ("experience", ("Nut Inc", "Junior", "Dev 2017", "2019", None)),
        ("education", ("B.Tech in CS, IIT Delhi 2013-2017", "B.Tech", "CS, IIT Delhi", "2017")), ("education", ("MIT Boston", "Master of Science", None, "2018")),
        ("headline", "Developerwith application using React-based tools, and working fast."),
    ]
    assert got[3] == got[4] == got[5] == [] and got[6] == [("full_name", "x")]
    assert text_claims(df.limit(0), "t", F.col("n")).count() == 0
    assert apply(spark, best_page, ["see docs.rs/x and https://me.github.io and a.b", "node.js and x", None]) == ["https://me.github.io", None, None]
    assert apply(spark, repair_spacing, ["  a  b ,c ", "", None, "bymigratinga webchatbotusing x"]) == ["a b, c", None, None, "by migrating a web chatbotusing x"]


def test_answers(spark):
    parsed = apply(spark, lambda c: F.to_json(parse_answer(c)), ['```json\n{"a": 1}\n```', "no", "[1]", None, "{broken"])
    assert parsed == ['{"a":1}', None, None, None, None]
    df = spark.createDataFrame([("doc",), (None,), ("boom",), ("",)], "t string")

    def model(prompt):
        if "boom" in prompt:
            raise OSError("down")
        return '{"full_name": "ed POE", "emails": ["E@x.org", "bad", 7, "e@X.org"], "phones": ["(212) 555-0147", "12"], "location": {"city": "Pune", "region": "IN"}, "skills": ["Tools: py, weaving; k8s", 3], "links": {"github": " github.com/ed "}, "experience": [{"company": "A", "start": "March 2020", "end": "now"}, {"start": "2020"}, "x"], "education": [{"institution": "U", "end_year": "in 2012"}, {}]}'

    rows = [(r["field"], r["value_text"] or tuple(r["value_exp"] or r["value_edu"])) for r in model_claims(df, "t", model).orderBy("ord").collect()]
    assert rows == [
        ("full_name", "Ed Poe"), ("emails", "e@x.org"), ("phones", "+12125550147"), ("location.city", "Pune"), ("location.country", "IN"), ("links.github", "github.com/ed"), ("skills", "Python"), ("skills", "Weaving"), ("skills", "Kubernetes"), ("skills", "3"),
        ("experience", ("A", "", "2020-03", None, None)), ("education", ("U", None, None, "2012")),
    ]
    p, pune = Places({"us": "US", "usa": "US", "india": "IN", "in": "IN"}), ("Pune", None, "IN")
    assert agreed_place("Austin, TX", pune, p) == pune and agreed_place("Austin, TX, USA", pune, p) == ("Austin", "TX", "US") and agreed_place("Austin, TX", None, p) == ("Austin", "TX", "US")
    assert agreed_place({"city": "Delhi", "country": "USA"}, pune, p) == pune and agreed_place({"city": "Oslo", "region": "Oslo County", "country": "India"}, pune, p) == ("Oslo", "Oslo County", "IN")
    assert agreed_place({}, pune, p) == pune and agreed_place(None, None, p) is None and agreed_place({"full": "Delhi, India"}, None, p) == ("Delhi", None, "IN") and agreed_place({"city": "Delhi", "region": "IN"}, None, p) == ("Delhi", None, "IN")


def test_model_routes(tmp_path):
    (tmp_path / ".env").write_text('# a\n\nMODEL_URL="http://a.test"\nMODEL_NAME = one\nMODEL_TOKEN=\'t\'\nbroken\nMODEL2_URL=http://b.test\nMODEL2_TIMEOUT=5\nHELD=file\n', encoding="utf-8-sig")
    settings = read_settings([str(tmp_path / "none"), str(tmp_path / ".env")], {"HELD": "env"})
    routes = routes_of(settings)
    assert routes == [ChatRoute("http://a.test", "one", "t"), ChatRoute("http://b.test", "", "", 5.0)] and settings["HELD"] == "env" and routes_of({}) == []
    asked = []

    def post(url, headers, body, timeout):
        asked.append((url, headers.get("Authorization"), json.loads(body)["messages"][1]["content"], timeout))
        return (503, '{"error": {"message": "busy"}}') if url.startswith("http://a") else (200, '{"choices": [{"message": {"content": "{}"}}]}')

    assert chain(routes, post)("hi") == "{}" and asked == [("http://a.test", "Bearer t", "hi", 90.0), ("http://b.test", None, "hi", 5.0)]
    for said, answer in ((503, '{"error": {"message": "busy"}}'), (500, '{"error": "down"}'), (404, "gone"), (200, "[]")):
        with pytest.raises(RuntimeError, match="busy|down|gone|choice"):
            chain(routes[:1], lambda *a: (said, answer))("x")  # noqa: B023
    with pytest.raises(RuntimeError, match="no route"):
        chain([])("x")
    (tmp_path / "resumes").mkdir()
    for f in ("b.csv", "a.csv", "x.json", "resumes/r.pdf", "resumes/n.md"):
        (tmp_path / f).write_text("")
    assert {k: [x["name"] for x in v] for k, v in list_samples(str(tmp_path)).items()} == {"csv": ["a.csv", "b.csv"], "ats": ["x.json"], "github": [], "resumes": ["r.pdf"]}
    assert list_samples(str(tmp_path / "none")) == {}


def test_docx_and_profiles(spark):
    import base64
    import io
    import zipfile

    xml = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>'
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", xml)
    assert docx_text(b.getvalue()) == "One\nTwo"
    saved = {"/users/octo": {"login": "octo", "name": "Octo Cat", "email": None, "location": "Austin, TX", "company": "@Acme", "html_url": "https://github.com/octo"}, "/users/octo/repos?per_page=100": [{"language": "Go", "fork": False}, {"language": "C", "fork": True}], "/repos/octo/octo/readme": {"encoding": "base64", "content": base64.b64encode(b"I like Python and Docker").decode()}}
    saved["/users/plain"] = {"login": "plain"}
    saved["/users/plain/repos?per_page=100"] = [{"language": "Go", "fork": False}] * 100
    saved["/users/plain/repos?per_page=100&page=2"] = [{"language": "Rust", "fork": False}]
    saved["/repos/plain/plain/readme"] = {"encoding": "none", "download_url": "https://raw.test/plain"}
    saved["https://raw.test/plain"] = "# Hi there\nI build small looms for large rooms.\nBased in: Austin, TX\nhttps://plain.github.io/"
    users = spark.createDataFrame([("octo",), ("https://github.com/octo",), ("nobody",), ("plain",)], "u string")
    got = {(r["candidate_key"], r["field"], r["value_text"], r["source"]) for r in user_claims(users, "u", saved.get).collect()}
    octo = {("octo cat", f, v, s) for f, v, s in (("full_name", "Octo Cat", "github_api"), ("location.region", "TX", "github_api"), ("current_company", "Acme", "github_api"), ("skills", "Go", "github_api"), ("skills", "Docker", "github_readme_regex"))}
    plain = {("plain", f, v, s) for f, v, s in (("skills", "Go", "github_api"), ("skills", "Rust", "github_api"), ("headline", "I build small looms for large rooms.", "github_readme_regex"), ("links.portfolio", "https://plain.github.io/", "github_readme_regex"), ("location.city", "Austin", "github_readme_regex"), ("links.github", "https://github.com/plain", "github_readme_regex"))}
    assert octo | plain <= got and ("octo cat", "skills", "C", "github_api") not in got and len({k for k, *_ in got}) == 2
    more = user_claims(users, "u", saved.get, lambda prompt: '{"full_name": "pl AIN", "skills": ["py"]}' if "looms" in prompt else "?")
    assert {(r["candidate_key"], r["field"], r["value_text"]) for r in more.filter("source = 'github_readme_llm'").collect()} == {("plain", "full_name", "Pl Ain"), ("plain", "skills", "Python"), ("plain", "links.github", "https://github.com/plain")}
