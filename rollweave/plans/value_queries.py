"""Queries that run the record model's operators over whole tables and give their values, each with SQL of its own logic."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollweave.functions import tables as T
from rollweave.functions.normalize import clean_line, github_login, iso_countries, norm_name, norm_text, token_sorted, username
from rollweave.functions.phones import norm_phone_in
from rollweave.functions.places import location_segments, parse_location
from rollweave.functions.text_fields import best_page, emails_in, known_terms, phones_in, profile_links, readme_headline, readme_text, repair_spacing
from rollweave.operators.merge import merge
from rollweave.operators.project import Config, error_text, project_json, project_struct, validation_errors
from rollweave.operators.resolve import greedy_clusters, identity_keys, source_entities
from rollweave.plans.pipeline import consolidate, write_json_lines
from rollweave.plans.record_queries import _GOLDEN, _STRIP, _TITLE, AS_OF, _date, _golden, _norm_email
from rollweave.session import cut, ensure_checkpoint_dir, table
from rollweave.sources.answers import answer_lists
from rollweave.sources.ats import AtsSource, json_claims
from rollweave.sources.csv import CsvSource, table_claims
from rollweave.sources.documents import text_claims


def text_normalize(spark: SparkSession, sf: str) -> DataFrame:
    t = norm_text(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.length(t).cast("bigint").alias("chars"), F.md5(t.cast("binary")).alias("digest"))


def line_clean(spark: SparkSession, sf: str) -> DataFrame:
    t = F.array_join(F.transform(F.split("text", "\n"), clean_line), "\n")
    return table(spark, sf, "documents").select("doc_id", F.md5(t.cast("binary")).alias("digest"))


def document_terms(spark: SparkSession, sf: str) -> DataFrame:
    terms = F.array_join(known_terms(F.col("text"), T.RESUME_SKILLS), "|")
    return table(spark, sf, "documents").select("doc_id", terms.alias("terms")).filter("terms <> ''")


def user_names(spark: SparkSession, sf: str) -> DataFrame:
    local = F.split("email", "@")[0]
    r = table(spark, sf, "recruiter").filter("email IS NOT NULL")
    return r.select("rec_id", username(F.concat(F.lit(" https://www.github.com/"), local, F.lit("/repo?tab=x "))).alias("user"), github_login(F.concat(F.lit("http://GitHub.com/"), local)).alias("login"), github_login(local).alias("bare_login"))


def contact_scan(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat_ws(" | ", "name", "email", "phone")
    r = table(spark, sf, "recruiter")
    return r.select("rec_id", F.array_join(emails_in(line), " ").alias("emails"), F.array_join(phones_in(F.array(line, F.concat(F.lit("see http://x.test/ "), "phone"))), ";").alias("phones"))


def profile_urls(spark: SparkSession, sf: str) -> DataFrame:
    local = F.split("email", "@")[0]
    text = F.concat(F.lit("see https://www.linkedin.com/in/"), local, F.lit("/, (LinkedIn.com/in/"), local, F.lit(") and linkedin.com/in/"), local, F.lit(" or github.com/a."))
    r = table(spark, sf, "recruiter").filter(F.col("email").rlike(r"^[a-z0-9.]+@"))
    return r.select("rec_id", F.array_join(profile_links(text, T.LINKEDIN_IN), " ").alias("linkedin"), F.array_join(profile_links(text, T.GITHUB_IN), " ").alias("github"))


def readme_pages(spark: SparkSession, sf: str) -> DataFrame:
    local = F.regexp_extract("email", r"^([a-z]+)", 1)
    text = F.concat(F.lit("# "), local, F.lit("\nHello and welcome to my page here\nread https://docs."), local, F.lit(".test/blog and https://"), local, F.lit(".github.io/, www."), local, F.lit("-portfolio.test or node.js\nI keep small looms in large rooms.\nBased in Austin, TX\n"))
    r = table(spark, sf, "recruiter").filter("email RLIKE '^[a-z]{3,}'")
    t = readme_text(text)
    return r.select("rec_id", best_page(t).alias("page"), readme_headline(t, local).alias("headline"))


def spacing_repair(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "ats").select("ats_id", repair_spacing(F.concat_ws(" ,", "applicant_name", "job_title", "skills_list")).alias("text"))


def place_parts(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat_ws(" | ", "contact_email", F.concat_ws(", ", "location_city", "location_state"), "location_country")
    return table(spark, sf, "ats").select("ats_id", F.array_join(location_segments(line), "~").alias("segments"))


def place_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Cities with a country as typed: only what names a country strictly is taken for one."""
    p = parse_location(F.concat(F.lit("Location: "), F.col("location_city"), F.lit(" (now), "), F.col("location_country")), spark)
    a = table(spark, sf, "ats").filter("location_city IS NOT NULL AND location_country IS NOT NULL AND NOT contains(concat(location_city, location_country), ',') AND location_country RLIKE '[A-Za-z]'")
    return a.select("ats_id", p.alias("p")).select("ats_id", "p.city", "p.region", "p.country")


def phone_regions(spark: SparkSession, sf: str) -> DataFrame:
    p = norm_phone_in(F.col("contact_phone"), F.array(F.lit(" us ")))
    return table(spark, sf, "ats").select("ats_id", p.alias("p")).select("ats_id", F.col("p.value").alias("phone"), F.col("p.region").alias("region")).filter("phone IS NOT NULL")


def _rec_claims(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "recruiter")
    named = r.select("rec_id", F.col("name").alias("Candidate Name"), F.col("email").alias("E-mail"), F.col("email").alias("email address"), F.col("phone").alias("MOBILE"), F.col("current_company").alias("Employer"), F.col("title").alias("position"), F.lit("x").alias("unknown"))
    return table_claims(named, F.col("rec_id"))


def aliased_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Claims of a table whose headers are other names, one of them unknown."""
    c = _rec_claims(spark, sf)
    return c.select(F.col("ord.row").alias("rec_id"), "candidate_key", "field", F.col("value_text").alias("value"), "source", "method", F.col("raw_confidence").alias("confidence"))


def entity_names(spark: SparkSession, sf: str) -> DataFrame:
    return source_entities(_rec_claims(spark, sf)).select("candidate_key", F.col("first.row").alias("first_row"), "name", "company")


def entity_keys(spark: SparkSession, sf: str) -> DataFrame:
    c = _rec_claims(spark, sf)
    e = cut(source_entities(c))
    return identity_keys(c, e).join(e, "ent").select("candidate_key", "kind", "key")


def cluster_rule(spark: SparkSession, sf: str) -> DataFrame:
    """The sequential rule over rows of recruiters: shared addresses first, then alike names in one firm."""
    r = table(spark, sf, "recruiter").select(F.col("rec_id").alias("ent"), norm_name(F.col("name")).alias("name"), F.nullif(F.lower(F.trim("current_company")), F.lit("")).alias("company"), F.lower(F.trim("email")).alias("key"))
    keys = r.filter("key RLIKE '^[a-z0-9._%+-]+@[a-z0-9.-]+[.][a-z]{2,}$'").select("ent", F.lit("mail").alias("kind"), "key")
    return greedy_clusters(r.select("ent", "name", "company"), keys).select(F.col("ent").alias("rec_id"), "cluster_id")


def _merged(spark: SparkSession, sf: str):
    c = _rec_claims(spark, sf)
    return merge(c.withColumn("cluster_id", F.col("candidate_key")).withColumn("member", F.col("ord.row")), AS_OF)


def merge_golden(spark: SparkSession, sf: str) -> DataFrame:
    g = _merged(spark, sf).golden
    prov = F.array_join(F.transform("provenance", lambda p: F.concat_ws(":", p["field"], p["source"], p["method"])), " ")
    fc = F.array_join(F.transform("field_confidences", lambda f: F.concat_ws(":", f["field"], F.format_number(f["confidence"], 2), f["has_conflict"].cast("string"))), " ")
    return g.select("cluster_id", "candidate_id", "full_name", F.array_join("emails", "|").alias("emails"), F.array_join("phones", "|").alias("phones"), "headline", prov.alias("provenance"), fc.alias("confidences"), F.round("overall_confidence", 4).alias("overall"))


def merge_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf).conflicts.select("cluster_id", "field", F.array_join("sources", "|").alias("sources"), "chosen")


def merge_rejections(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf).rejections


def merge_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf).null_fields


def run_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Summary of a run over names and titles alone, which share no key, so every record stays alone."""
    config = Config.of({"fields": [{"path": "name", "from": "full_name"}, {"path": "headline", "from": "headline"}], "include_confidence": False})
    told = consolidate(_rec_claims(spark, sf).filter("field IN ('full_name', 'title')"), config, AS_OF).summary()
    return spark.createDataFrame([{k: v for k, v in told.items() if isinstance(v, int)}])


def json_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every claim of every delivered line with a value that isn't nested."""
    r = table(spark, sf, "ats_raw").filter("payload NOT LIKE '%{%{%'")
    c = json_claims(r, "payload", F.col("file_no") * 1000 + F.col("line_no"))
    return c.select(F.col("ord.row").alias("line"), "candidate_key", "field", F.col("value_text").alias("value"))


def history_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Work and schooling of applications, given as JSON."""
    a = table(spark, sf, "ats").select("ats_id", F.to_json(F.struct(F.lit("x@y.zz").alias("email"), F.col("work_history").alias("jobs"), F.col("education"))).alias("payload"))
    c = json_claims(a, "payload", F.col("ats_id")).filter("field IN ('experience', 'education')")
    e, d = F.col("value_exp"), F.col("value_edu")
    return c.select(F.col("ord.row").alias("ats_id"), "field", F.coalesce(e["company"], d["institution"]).alias("place"), F.coalesce(e["title"], d["degree"]).alias("what"), F.coalesce(e["start"], d["field"]).alias("a"), F.coalesce(e["end"], d["end_year"]).alias("b"))


def place_claims(spark: SparkSession, sf: str) -> DataFrame:
    """A location in one text, in JSON and in a column: "City, TX" is read everywhere, other texts are a city in a column and nothing in JSON."""
    a = table(spark, sf, "ats").filter("location_city RLIKE '^[A-Z][a-z]+$'").select("ats_id", F.when(F.col("ats_id") % 2 == 0, F.concat("location_city", F.lit(", TX"))).otherwise(F.col("location_city")).alias("location"))
    j = json_claims(a.select("ats_id", F.to_json(F.struct(F.lit("N N").alias("name"), F.col("location"))).alias("p")), "p", F.col("ats_id"))
    t = table_claims(a.select("ats_id", F.lit("N N").alias("name"), "location"), F.col("ats_id"))
    return j.unionByName(t).filter("field LIKE 'location%'").select(F.col("ord.row").alias("ats_id"), "source", "field", F.col("value_text").alias("value"), "method")


_CLEAN = r"[^A-Za-z ]"


def _resumes(spark: SparkSession, sf: str) -> DataFrame:
    """Applications written out as résumés: a top, skills, stints of fixed dates and schools."""
    only = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), _CLEAN, ""), " +", " "))
    a = table(spark, sf, "ats").filter("applicant_name RLIKE '^[A-Z][a-z]+ [A-Z][a-z]+$'")
    stints = F.transform("work_history", lambda w, i: F.concat(F.lit("• Xq "), only(w["role"]), F.lit(" | Jan "), (2000 + i).cast("string"), F.lit(" - Present\nFq "), only(w["employer"]), F.lit(" - Remote\nkept looms, number "), i.cast("string")))
    schools = F.transform("education", lambda e, i: F.concat(F.lit("School of Q"), i.cast("string"), F.lit("\nBachelor of Arts in "), only(e["major"]), F.lit(" 2001 - "), (2004 + i).cast("string")))
    text = F.concat_ws("\n", "applicant_name", F.concat(F.lit("mail"), F.col("ats_id").cast("string"), F.lit("@x.test | Reno, NV")), F.lit("github.com/u1"), F.lit("Skills"), F.lit("Languages: Python, C++ and Weaving"), F.lit("Craft: felting; spinning"), F.lit("Work Experience"), F.array_join(stints, "\n"), F.lit("EDUCATION"), F.array_join(schools, "\n"), F.lit("Profile"), F.lit("Weaver ,at heart"))
    return a.select("ats_id", text.alias("text"))


def resume_values(spark: SparkSession, sf: str) -> DataFrame:
    """Everything that the résumés say, read back line by line."""
    c = text_claims(_resumes(spark, sf), "text", F.col("ats_id"))
    e, d = F.col("value_exp"), F.col("value_edu")
    value = F.when(e.isNotNull(), F.concat_ws("~", e["title"], e["company"], e["start"], e["end"], e["summary"])).when(d.isNotNull(), F.concat_ws("~", d["institution"], d["degree"], d["field"], d["end_year"])).otherwise(F.col("value_text"))
    return c.select(F.col("ord.row").alias("ats_id"), "candidate_key", "field", value.alias("value"), "method", F.col("raw_confidence").alias("confidence"))


def answer_values(spark: SparkSession, sf: str) -> DataFrame:
    """Answers in a code fence, cleaned: names, addresses, numbers, the starts of stints and the years of schools."""
    a = table(spark, sf, "ats")
    name = F.when(F.col("applicant_name").rlike("^[A-Za-z]{2,11} [A-Z][a-z]{1,10}$"), F.col("applicant_name"))
    obj = F.struct(
        name.alias("full_name"), F.array(F.col("contact_email"), F.upper("contact_email"), F.lit("none")).alias("emails"), F.array(F.col("contact_phone"), F.col("contact_phone")).alias("phones"),
        F.transform("work_history", lambda w: F.struct(w["employer"].alias("company"), w["start_date"].alias("start"))).alias("experience"), F.transform("education", lambda e: F.struct(e["school"].alias("institution"), F.concat(F.lit("in "), e["graduation_year"]).alias("end_year"))).alias("education"),
    )
    d = a.select("ats_id", F.concat(F.lit("Here:\n```json\n"), F.to_json(obj), F.lit("\n```")).alias("answer"))
    nowhere = F.struct(*[F.lit(None).cast("string").alias(p) for p in ("city", "region", "country")])
    x, _, lists = answer_lists(d, nowhere, ("llm_extraction_qwen", 0.55))
    each = x.select("ats_id", F.explode(F.flatten(F.array(*lists))).alias("c")).select("ats_id", "c.*")
    value = F.when(F.col("field") == "full_name", F.regexp_replace("value_text", "[a-z]", "")).otherwise(F.coalesce("value_text", "value_exp.start", "value_edu.end_year"))
    return each.select("ats_id", "field", value.alias("value")).filter("value IS NOT NULL")


def project_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every kind of path, type and normalizer of a configuration, and required fields that stop a record."""
    fields = [
        {"path": "a.name", "from": "full_name", "required": True}, {"path": "a.first", "from": "phones[0]", "type": "string", "normalize": "E.164"}, {"path": "skills", "from": "skills[].name", "type": "string[]", "normalize": "canonical"},
        {"path": "one", "from": "skills[1].confidence", "type": "number"}, {"path": "list", "from": "headline", "type": "string[]"}, {"path": "place", "from": "location", "type": "object"}, {"path": "nothing", "from": "no.where"}, {"path": "far", "from": "phones[99]"},
    ]
    p = project_struct(_golden(spark, sf), Config.of({"fields": fields, "include_confidence": True, "on_missing": "error"}), ("row_id",))
    r = F.col("record")
    return p.select("row_id", r["a"]["name"].alias("name"), F.array_join(r["skills"], "|").alias("skills"), r["one"].alias("one"), F.array_join(r["list"], "|").alias("list"), r["place"]["country"].alias("country"), r["nothing"].alias("nothing"), r["far"].alias("far"), F.round(r["overall_confidence"], 6).alias("confidence"), F.size(r["provenance"]).cast("bigint").alias("sources"), "error")


def validate_values(spark: SparkSession, sf: str) -> DataFrame:
    """Messages of a strict shape over records of another one."""
    shape = Config.of({"fields": [{"path": "name", "from": "full_name"}, {"path": "phones", "from": "phones", "type": "string[]"}, {"path": "years", "from": "years_experience", "type": "number"}, {"path": "place", "from": "location", "type": "object"}], "include_confidence": False, "on_missing": "omit"})
    strict = Config.of({"fields": [{"path": "name", "required": True}, {"path": "phones", "type": "number"}, {"path": "years", "type": "string"}, {"path": "place", "type": "object[]"}, {"path": "gone", "required": True}], "include_confidence": True, "on_missing": "error"})
    j = project_json(_golden(spark, sf), shape, ("row_id",))
    return j.select("row_id", F.explode(validation_errors(F.col("json"), strict)).alias("e")).select("row_id", error_text(F.col("e")).alias("message"))


def _folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/files-{uuid.uuid4()}"


def csv_files(spark: SparkSession, sf: str) -> DataFrame:
    """Recruiters written as delimited files with other headers, and read back as claims."""
    path = _folder(spark)
    r = table(spark, sf, "recruiter").select(F.col("name").alias("Full Name"), F.col("email").alias("Email"), F.col("phone").alias("Phone Number"), F.col("current_company").alias("Company"), F.col("title").alias("Job Title"))
    r.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return CsvSource().read(spark, path).select("candidate_key", "field", F.col("value_text").alias("value"), "source")


def json_files(spark: SparkSession, sf: str) -> DataFrame:
    """Applications written as documents of some two thousand records each, and read back as claims."""
    path = _folder(spark)
    a = table(spark, sf, "ats").select((F.col("ats_id") % F.lit(10_000_019) / 2000).cast("int").alias("doc"), F.struct("applicant_name", "contact_email", "contact_phone", "current_employer", "job_title").alias("r"))
    a.groupBy("doc").agg(F.to_json(F.struct(F.collect_list("r").alias("candidates"))).alias("value")).write.partitionBy("doc").text(path)
    return AtsSource().read(spark, path).select("candidate_key", "field", F.col("value_text").alias("value"), "source")


def json_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Projected records written as JSON lines and read back."""
    path = _folder(spark)
    config = Config.of({"fields": [{"path": "id", "from": "candidate_id"}, {"path": "name", "from": "full_name"}, {"path": "mail", "from": "emails[0]"}], "include_confidence": False})
    write_json_lines(project_json(_golden(spark, sf), config, ("row_id",)), path)
    return spark.read.schema("id string, name string, mail string").json(path)


_FUNCTIONS = (
    csv_files, json_files, json_lines, text_normalize, line_clean, document_terms, user_names, contact_scan, profile_urls, readme_pages, spacing_repair, place_parts, place_parse, phone_regions, aliased_columns, entity_names, entity_keys, cluster_rule, merge_golden, merge_conflicts, merge_rejections, merge_nulls, run_counts,
    json_values, history_claims, place_claims, resume_values, answer_values, project_values, validate_values,
)


def queries() -> dict:
    return {f.__name__: f for f in _FUNCTIONS}



def _countries() -> tuple[str, str] | None:
    """ISO names and codes as rows, with the strict aliases and without, from the running session; the SQL of places needs one."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return None
    rows = lambda table: ", ".join("('" + k.replace("'", "''") + f"', '{c}')" for k, c in sorted(table.items()))
    iso = iso_countries(spark)
    return rows({**iso, **dict(list(T.COUNTRY_ALIASES.items())[:12])}), rows(iso)


#: Ratio of two texts: 200 * longest common subsequence / total length, by rows of the usual table.
_LCS = """list_reduce(string_split({a}, ''), lambda r, x: list_reduce(range(1, len({b}) + 1), lambda t, j: list_append(t, CASE WHEN x = {b}[j] THEN r[j] + 1 ELSE greatest(r[j + 1], t[-1]) END), [0::BIGINT]), list_transform(range(len({b}) + 1), lambda z: 0::BIGINT))[-1]"""


def _valid_us(c: str) -> str:
    """Ten digits of a US number, null for anything else; a number with + must be of country 1."""
    body = f"regexp_replace(trim({c}), '\\s*(ext\\.?|x|#)\\s*\\d{{1,6}}\\s*$', '', 'i')"
    digits = f"regexp_replace({body}, '[^0-9]', '', 'g')"
    shape = f"regexp_full_match(regexp_replace({body}, '^tel:\\s*', '', 'i'), '[\\d\\s().\\-/+]*(?:\\d[\\s().\\-/]*){{5,}}')"
    area = "[2-9]\\d{2}[2-9]\\d{6}"
    return f"CASE WHEN {shape} THEN CASE WHEN contains({body}, '+') THEN CASE WHEN regexp_full_match({digits}, '1{area}') THEN {digits}[2:] WHEN regexp_full_match({digits}, '11{area}') THEN {digits}[3:] END WHEN regexp_full_match({digits}, '{area}') THEN {digits} WHEN regexp_full_match({digits}, '1{area}') THEN {digits}[2:] END END"


def _grouped_us(c: str) -> str:
    """The same where the groups of digits are those of the country, or the number begins with +."""
    groups = f"list_transform(regexp_extract_all({c}, '\\d+'), lambda g: len(g))"
    return f"CASE WHEN trim({c})[1] = '+' OR len({groups}) <= 1 OR {groups} = [3, 3, 4] THEN {_valid_us(c)} END"


def oracle_sql() -> dict[str, str]:
    q = lambda t: t.replace("'", "''")
    skills = ", ".join(f"('{q(k)}', '{q(v)}')" for k, v in T.SKILL_NAMES.items())
    misread = "regexp_replace(text, '\\r\\n?', chr(10), 'g')"
    for wrong, right in (("â€“", "–"), ("â€”", "—"), ("Â·", "·"), ("â€¢", "•")):
        misread = f"replace({misread}, '{wrong}', '{right}')"
    word = "[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]"
    normal = f"regexp_replace(regexp_replace({misread}, '({word})-\\s*\\n\\s*({word})', '\\1\\2', 'g'), '[ \\t]+', ' ', 'g')"
    escaped = lambda t: "".join("\\" + c if c in ".+*?()[]{}|^$\\" else c for c in q(t.lower()))
    terms = ", ".join(f"CASE WHEN regexp_matches(low, '[^a-z0-9.+#-]{escaped(t)}[^a-z0-9.+#-]') THEN '{q(t)}' END" for t in T.RESUME_SKILLS)
    login = lambda x: f"CASE WHEN regexp_full_match(lower(regexp_extract(regexp_replace({x}, '^/+', ''), '^([^/?#]*)', 1)), '[a-z0-9]([a-z0-9-]{{0,37}}[a-z0-9])?') THEN lower(regexp_extract(regexp_replace({x}, '^/+', ''), '^([^/?#]*)', 1)) END"
    key = f"lower(coalesce(nullif({_STRIP.format('email')}, ''), nullif({_STRIP.format('name')}, '')))"
    cells = " UNION ALL ".join(f"SELECT rec_id, key, '{f}' AS field, {_STRIP.format(c)} AS value FROM k WHERE {_STRIP.format(c)} <> ''" for c, f in (("name", "full_name"), ("email", "emails"), ("phone", "phones"), ("current_company", "current_company"), ("title", "title")))
    claims = f"k AS (SELECT *, {key} AS key FROM recruiter), c AS (SELECT * FROM ({cells}) WHERE key IS NOT NULL)"
    titled = _TITLE.format("trim(regexp_replace(value, '\\s+', ' ', 'g'))")
    norm = f"n AS (SELECT *, CASE field WHEN 'full_name' THEN {titled} WHEN 'emails' THEN {_norm_email('value')} WHEN 'phones' THEN '+1' || {_grouped_us('value')} ELSE nullif(trim(value, ' '), '') END AS norm FROM c)"
    scalars = "s AS (SELECT key, field, arg_min(norm, rec_id) AS value, count(DISTINCT norm) > 1 AS conflict, CASE WHEN count(DISTINCT norm) > 1 THEN 0.6::DOUBLE WHEN count(*) > 1 THEN 1.0::DOUBLE ELSE 0.95::DOUBLE END AS conf FROM n WHERE field IN ('full_name', 'title', 'current_company') AND norm <> '' GROUP BY key, field)"
    lists = "d AS (SELECT key, field, norm, min(rec_id) AS first, count(*) AS m FROM n WHERE field IN ('emails', 'phones') AND norm <> '' GROUP BY key, field, norm), l AS (SELECT key, field, string_agg(norm, '|' ORDER BY first) AS list, arg_min(norm, first) AS value, count(*) AS k, CASE WHEN count(*) = 1 AND sum(m) > 1 THEN 1.0::DOUBLE ELSE 0.95::DOUBLE END AS conf FROM d GROUP BY key, field)"
    parts = f"{claims}, {norm}, {scalars}, {lists}"
    golden = f"""g AS (SELECT key, max(value) FILTER (field = 'full_name') AS name, max(value) FILTER (field = 'title') AS title, max(value) FILTER (field = 'current_company') AS firm, max(conf) FILTER (field = 'full_name') AS nc, bool_or(conflict) FILTER (field = 'full_name') AS nx FROM s GROUP BY key),
m AS (SELECT DISTINCT c.key, g.name, title, firm, nc, nx, e.list AS emails, e.value AS mail, e.k AS ek, e.conf AS ec, p.list AS phones, p.k AS pk, p.conf AS pc FROM c LEFT JOIN g USING (key) LEFT JOIN l e ON e.key = c.key AND e.field = 'emails' LEFT JOIN l p ON p.key = c.key AND p.field = 'phones')"""
    flat = {"full_name": ("applicant_name", "name", "full_name", "candidate_name"), "emails": ("contact_email", "email", "email_address", "primary_email"), "phones": ("contact_phone", "phone", "phone_number", "mobile"), "current_company": ("current_employer", "company", "employer", "current_company"), "title": ("job_title", "title", "role", "position"), "location.city": ("location_city", "city"), "location.region": ("location_state", "state", "region"), "location.country": ("location_country", "country"), "skills": ("skills_list", "skills", "skillset", "tech_stack"), "years_experience": ("years_of_experience", "experience_years", "yoe")}
    keyed = ", ".join(f"('{k}', '{f}', {i})" for f, ks in flat.items() for i, k in enumerate(ks))
    only = lambda c: f"trim(regexp_replace(regexp_replace(coalesce({c}, ''), '[^A-Za-z ]', '', 'g'), ' +', ' ', 'g'))"
    strip = lambda c: f"nullif({_STRIP.format(c)}, '')"
    start, _ = _date("w.start_date")
    out = {
        "csv_files": f"WITH {claims} SELECT key AS candidate_key, field, value, 'recruiter_csv' AS source FROM c",
        "json_files": "WITH k AS (SELECT *, " + f"lower(trim(coalesce({strip('contact_email')}, {strip('applicant_name')}), ' '))" + " AS key FROM ats) " + " UNION ALL ".join(f"SELECT key AS candidate_key, '{f}' AS field, {strip(c)} AS value, 'ats_json' AS source FROM k WHERE key IS NOT NULL AND {strip(c)} IS NOT NULL" for c, f in (("applicant_name", "full_name"), ("contact_email", "emails"), ("contact_phone", "phones"), ("current_employer", "current_company"), ("job_title", "title"))),
        "json_lines": f"WITH {_GOLDEN} SELECT candidate_id AS id, fn AS name, mail FROM g",
        "text_normalize": f"SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM (SELECT doc_id, {normal} AS t FROM documents)",
        "line_clean": "SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda l: trim(regexp_replace(regexp_replace(trim(l, ' '), '^\\s*[-*•·▪▫‣◦]+\\s*', ''), '\\s+', ' ', 'g'), ' ')), chr(10))) AS digest FROM documents",
        "document_terms": f"SELECT * FROM (SELECT doc_id, concat_ws('|', {terms}) AS terms FROM (SELECT doc_id, ' ' || lower(text) || ' ' AS low FROM documents)) WHERE terms <> ''",
        "user_names": f"""WITH r AS (SELECT rec_id, string_split(email, '@')[1] AS l FROM recruiter WHERE email IS NOT NULL), b AS (SELECT *, regexp_replace(trim(l, ' '), '^https?://', '', 'i') AS t FROM r)
SELECT rec_id, nullif(regexp_extract(l || '/repo?tab=x', '^([^/?#\\s]*)', 1), '') AS "user", {login("rtrim(l, ' ')")} AS login, CASE WHEN NOT regexp_matches(t, '[/.]') THEN {login('t')} END AS bare_login FROM b""",
        "contact_scan": f"""WITH r AS (SELECT rec_id, concat_ws(' | ', name, email, phone) AS line FROM recruiter), e AS (SELECT rec_id, line, regexp_extract_all(line, '{T.EMAIL_IN}') AS m, list_filter(list_transform(regexp_extract_all(line, '{T.PHONE_IN}'), lambda p: trim(p, ' ')), lambda p: p[1] = '+' OR length(regexp_replace(p, '\\D', '', 'g')) >= 10) AS p FROM r)
SELECT rec_id, array_to_string(list_filter(m, lambda x, i: list_position(m, x) = i), ' ') AS emails, CASE WHEN regexp_matches(lower(line), 'http://|https://|doi|document/|ieee') THEN '' ELSE array_to_string(p, ';') END AS phones FROM e""",
        "profile_urls": "SELECT rec_id, 'linkedin.com/in/' || l || ' LinkedIn.com/in/' || l AS linkedin, 'github.com/a' AS github FROM (SELECT rec_id, regexp_replace(string_split(email, '@')[1], '[.]+$', '') AS l FROM recruiter WHERE regexp_matches(email, '^[a-z0-9.]+@'))",
        "readme_pages": "SELECT rec_id, 'https://' || l || '.github.io/' AS page, CASE WHEN NOT contains('i keep small looms in large rooms.', l) THEN 'I keep small looms in large rooms.' END AS headline FROM (SELECT rec_id, regexp_extract(email, '^([a-z]+)', 1) AS l FROM recruiter WHERE regexp_matches(email, '^[a-z]{3,}'))",
        "place_parts": "SELECT ats_id, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(trim(concat_ws(' | ', contact_email, concat_ws(', ', location_city, location_state), location_country), ' '), '\\s{2,}', ' | ', 'g'), '\\s*[|;/•·]\\s*'), lambda p: regexp_replace(p, '^[ -]+|[ -]+$', '', 'g')), lambda p: p <> ''), '~') AS segments FROM ats",
        "phone_regions": f"SELECT ats_id, '+1' || n AS phone, CASE WHEN trim(contact_phone)[1] <> '+' THEN 'US' END AS region FROM (SELECT ats_id, contact_phone, {_grouped_us('contact_phone')} AS n FROM ats) WHERE n IS NOT NULL",
        "aliased_columns": f"WITH {claims} SELECT rec_id, key AS candidate_key, field, value, 'recruiter_csv' AS source, 'direct_copy' AS method, 0.95::DOUBLE AS confidence FROM c",
        "entity_names": f"WITH {claims}, t AS (SELECT *, {titled} AS titled FROM c) SELECT key AS candidate_key, min(rec_id) AS first_row, arg_min(titled, rec_id) FILTER (field = 'full_name') AS name, arg_min(lower(trim(value, ' ')), rec_id) FILTER (field = 'current_company') AS company FROM t GROUP BY key",
        "entity_keys": f"WITH {claims}, y AS (SELECT key AS candidate_key, field AS kind, CASE field WHEN 'emails' THEN {_norm_email('value')} ELSE '+1' || {_valid_us('value')} END AS key FROM c WHERE field IN ('emails', 'phones')) SELECT DISTINCT candidate_key, kind, key FROM y WHERE key IS NOT NULL",
        "merge_golden": f"""WITH {parts}, {golden}
SELECT key AS cluster_id, sha256(coalesce(mail, CASE WHEN name IS NOT NULL OR firm IS NOT NULL THEN coalesce(name, '') || '|' || coalesce(firm, '') END, 'unknown'))[1:16] AS candidate_id, name AS full_name, coalesce(emails, '') AS emails, coalesce(phones, '') AS phones, title AS headline,
 concat_ws(' ', CASE WHEN name IS NOT NULL THEN 'full_name:recruiter_csv:direct_copy' END, CASE WHEN ek > 0 THEN trim(repeat('emails:recruiter_csv:direct_copy ', ek)) END, CASE WHEN pk > 0 THEN trim(repeat('phones:recruiter_csv:direct_copy ', pk)) END) AS provenance,
 concat_ws(' ', 'full_name:' || printf('%.2f', nc) || ':' || nx::VARCHAR, 'emails:' || printf('%.2f', ec) || ':false', 'phones:' || printf('%.2f', pc) || ':false') AS confidences,
 round(coalesce((coalesce(nc, 0) + coalesce(ec, 0) + coalesce(pc, 0)) / 10.0::DOUBLE, 0), 4) AS overall FROM m""",
        "merge_conflicts": f"WITH {parts} SELECT key AS cluster_id, field, 'recruiter_csv' AS sources, 'recruiter_csv' AS chosen FROM s WHERE conflict",
        "merge_rejections": f"WITH {claims}, {norm} SELECT key AS cluster_id, field, value, 'normalization_failed' AS reason, 'recruiter_csv' AS source FROM n WHERE field IN ('emails', 'phones') AND norm IS NULL",
        "merge_nulls": f"WITH {parts}, {golden} SELECT key AS cluster_id, unnest(list_filter([CASE WHEN name IS NULL THEN 'full_name' END, CASE WHEN title IS NULL THEN 'headline' END, 'years_experience', CASE WHEN emails IS NULL THEN 'emails' END, CASE WHEN phones IS NULL THEN 'phones' END, 'skills'], lambda x: x IS NOT NULL)) AS field FROM m",
        "run_counts": f"""WITH {claims}, b AS (SELECT * FROM c WHERE field IN ('full_name', 'title')), n AS (SELECT *, CASE field WHEN 'full_name' THEN {titled} ELSE value END AS norm FROM b), s AS (SELECT key, field, count(DISTINCT norm) AS d FROM n GROUP BY key, field), r AS (SELECT key, count(*) AS held FROM s GROUP BY key)
SELECT (SELECT count(*) FROM b) AS claims, (SELECT count(*) FROM r) AS records, (SELECT count(*) FROM s WHERE d > 1) AS conflicts_found, 0 AS rejections, (SELECT CAST(sum(6 - held) AS BIGINT) FROM r) AS null_fields, 0 AS validation_errors""",
        "json_values": f"""WITH known(k, field, place) AS (VALUES {keyed}), r AS (SELECT row_number() OVER () AS id, file_no * 1000 + line_no AS line, payload FROM ats_raw WHERE payload NOT LIKE '%{{%{{%' AND json_valid(payload) AND json_type(payload) = 'OBJECT'),
p AS (SELECT id, line, payload, unnest(json_keys(payload)) AS k FROM r), x AS (SELECT id, line, field, place, json_extract(payload, '$."' || k || '"') AS x FROM p JOIN known USING (k)),
t AS (SELECT id, line, field, place, unnest(CASE json_type(x) WHEN 'ARRAY' THEN x ->> '$[*]' WHEN 'NULL' THEN []::VARCHAR[] ELSE CASE field WHEN 'skills' THEN regexp_split_to_array(x ->> '$', '[,;|]') ELSE [x ->> '$'] END END) AS v FROM x),
u AS (SELECT id, line, field, place, {_STRIP.format('v')} AS value FROM t WHERE {_STRIP.format('v')} <> ''),
w AS (SELECT id, lower(coalesce(arg_min(value, place) FILTER (field = 'emails'), arg_min(value, place) FILTER (field = 'full_name'))) AS key FROM u GROUP BY id)
SELECT line, key AS candidate_key, field, value FROM u JOIN w USING (id) WHERE key IS NOT NULL""",
        "history_claims": f"""WITH j AS (SELECT ats_id, unnest(work_history) AS w FROM ats), e AS (SELECT ats_id, unnest(education) AS e FROM ats)
SELECT ats_id, 'experience' AS field, {strip('w.employer')} AS place, {strip('w."role"')} AS what, {strip('w.start_date')} AS a, {strip('w.end_date')} AS b FROM j WHERE {strip('w.employer')} IS NOT NULL OR {strip('w."role"')} IS NOT NULL
UNION ALL SELECT ats_id, 'education', {strip('e.school')}, {strip('e.degree_type')}, {strip('e.major')}, e.graduation_year::VARCHAR FROM e WHERE {strip('e.school')} IS NOT NULL""",
        "place_claims": """WITH a AS (SELECT ats_id, location_city AS city FROM ats WHERE regexp_full_match(location_city, '[A-Z][a-z]+')), s(source) AS (VALUES ('ats_json'), ('recruiter_csv'))
SELECT ats_id, source, field, CASE field WHEN 'location.city' THEN city WHEN 'location.region' THEN 'TX' ELSE 'US' END AS value, 'location_parse' AS method FROM a JOIN s ON ats_id % 2 = 0 JOIN (VALUES ('location.city'), ('location.region'), ('location.country')) f(field) ON true
UNION ALL SELECT ats_id, 'recruiter_csv', 'location.city', city, 'direct_copy' FROM a WHERE ats_id % 2 = 1""",
        "resume_values": f"""WITH a AS (SELECT ats_id, applicant_name, 'mail' || ats_id || '@x.test' AS key, work_history, education FROM ats WHERE regexp_full_match(applicant_name, '[A-Z][a-z]+ [A-Z][a-z]+')),
j AS (SELECT ats_id, key, unnest(work_history) AS w, unnest(range(len(work_history))) AS i FROM a), s AS (SELECT ats_id, key, unnest(education) AS e, unnest(range(len(education))) AS i FROM a),
f(field, value, method, confidence) AS (VALUES ('links.github', 'github.com/u1', 'regex_extract', 0.7), ('location.city', 'Reno', 'contact_location_parse', 0.62), ('location.region', 'NV', 'contact_location_parse', 0.62), ('location.country', 'US', 'contact_location_parse', 0.62),
 ('skills', 'Python', 'section_parse', 0.65), ('skills', 'C++', 'section_parse', 0.65), ('skills', 'felting', 'section_parse', 0.65), ('skills', 'spinning', 'section_parse', 0.65), ('headline', 'Weaver, at heart', 'section_parse', 0.65))
SELECT ats_id, key AS candidate_key, field, value, method, confidence::DOUBLE AS confidence FROM a JOIN f ON true
UNION ALL SELECT ats_id, key, 'full_name', applicant_name, 'first_line_heuristic', 0.65 FROM a UNION ALL SELECT ats_id, key, 'emails', key, 'regex_extract', 0.7 FROM a UNION ALL SELECT ats_id, key, 'phones', ats_id::VARCHAR, 'regex_extract', 0.7 FROM a
UNION ALL SELECT ats_id, key, 'experience', concat_ws('~', trim('Xq ' || {only('w."role"')}), trim('Fq ' || {only('w.employer')}), 'Jan ' || (2000 + i), 'Present', 'kept looms, number ' || i), 'section_parse', 0.65 FROM j
UNION ALL SELECT ats_id, key, 'education', concat_ws('~', 'School of Q' || i, 'Bachelor of Arts', CASE {only('e.major')} WHEN '' THEN 'in' ELSE {only('e.major')} END, 2004 + i), 'section_parse', 0.65 FROM s""",
        "answer_values": f"""WITH j AS (SELECT ats_id, unnest(work_history) AS w FROM ats), s AS (SELECT ats_id, unnest(education) AS e FROM ats)
SELECT * FROM (SELECT ats_id, 'full_name' AS field, regexp_replace({_TITLE.format('applicant_name')}, '[a-z]', '', 'g') AS value FROM ats WHERE regexp_full_match(applicant_name, '[A-Za-z]{{2,11}} [A-Z][a-z]{{1,10}}')
UNION ALL SELECT ats_id, 'emails', {_norm_email('contact_email')} FROM ats UNION ALL SELECT ats_id, 'phones', '+1' || {_valid_us('contact_phone')} FROM ats
UNION ALL SELECT ats_id, 'experience', {start} FROM j WHERE {strip('w.employer')} IS NOT NULL UNION ALL SELECT ats_id, 'education', nullif(regexp_extract(e.graduation_year::VARCHAR, '\\d{{4}}'), '') FROM s WHERE {strip('e.school')} IS NOT NULL) WHERE value IS NOT NULL""",
        "project_values": f"""WITH {_GOLDEN}, t(k, v) AS (VALUES {skills}), x AS (SELECT row_id, unnest(skills).name AS raw, unnest(range(len(skills))) AS i FROM g), y AS (SELECT row_id, string_agg(coalesce(v, {_TITLE.format(_STRIP.format('raw'))}), '|' ORDER BY i) AS list FROM x LEFT JOIN t ON k = lower({_STRIP.format('raw')}) GROUP BY row_id)
SELECT row_id, fn AS name, CASE WHEN fn IS NOT NULL THEN y.list END AS skills, CASE WHEN fn IS NOT NULL THEN g.skills[2].confidence END AS one, CASE WHEN fn IS NOT NULL THEN headline END AS list, CASE WHEN fn IS NOT NULL THEN location.country END AS country, NULL::VARCHAR AS nothing, NULL::VARCHAR AS far,
 CASE WHEN fn IS NOT NULL THEN round(overall_confidence, 6) END AS confidence, CASE WHEN fn IS NOT NULL THEN len(provenance) END AS sources, CASE WHEN fn IS NULL THEN 'Required fields missing: a.name' END AS error FROM g LEFT JOIN y USING (row_id)""",
        "validate_values": f"""WITH {_GOLDEN} SELECT row_id, unnest(list_filter([CASE WHEN fn IS NULL THEN '[name] required field is missing' END, CASE WHEN len(phones) > 0 THEN '[phones] expected number, got array' END, CASE WHEN years_experience IS NOT NULL THEN '[years] expected string, got decimal' END,
 CASE WHEN location IS NOT NULL THEN '[place] expected object[], got object' END, '[gone] required field is missing', '[overall_confidence] is missing', '[provenance] is missing'], lambda m: m IS NOT NULL)) AS message FROM g""",
        "cluster_rule": f"""WITH RECURSIVE e AS MATERIALIZED (SELECT rec_id AS ent, array_to_string(list_sort(list_filter(string_split(nullif({_TITLE.format("trim(regexp_replace(name, '\\s+', ' ', 'g'))")}, ''), ' '), lambda w: w <> '')), ' ') AS n, nullif(lower(trim(current_company, ' ')), '') AS f,
 CASE WHEN regexp_full_match(lower(trim(email, ' ')), '[a-z0-9._%+-]+@[a-z0-9.-]+[.][a-z]{{2,}}') THEN lower(trim(email, ' ')) END AS key FROM recruiter),
x AS MATERIALIZED (SELECT ent, min(ent) OVER (PARTITION BY key) AS head FROM e WHERE key IS NOT NULL),
w AS MATERIALIZED (SELECT f, n, count(*) AS m FROM e WHERE n <> '' AND f IS NOT NULL GROUP BY f, n),
near AS MATERIALIZED (SELECT a.f, a.n AS a, b.n AS b FROM w a JOIN w b ON a.f = b.f AND a.n < b.n AND levenshtein(a.n, b.n) <= 0.1 * (len(a.n) + len(b.n)) + 1e-9),
alike AS MATERIALIZED (SELECT f, a, b FROM (SELECT *, {_LCS.format(a='a', b='b')} AS common FROM near) WHERE 200.0 * common / (len(a) + len(b)) >= 90),
pair AS MATERIALIZED (SELECT f, a, b FROM alike UNION ALL SELECT f, b, a FROM alike UNION ALL SELECT f, n, n FROM w),
seek AS MATERIALIZED (SELECT e.ent, e.f, p.b AS n FROM e JOIN pair p ON p.f = e.f AND p.a = e.n WHERE e.ent NOT IN (SELECT ent FROM x WHERE ent > head)),
lab(r, ent, c) AS (SELECT 0, ent, ent FROM e UNION ALL
 SELECT q.r + 1, q.ent, coalesce(h.c, z.c, q.ent) FROM lab q LEFT JOIN x ON x.ent = q.ent AND x.ent > x.head LEFT JOIN lab h ON h.ent = x.head
 LEFT JOIN (SELECT s.ent, arg_min(m.c, v.arrived) AS c FROM seek s JOIN e o ON o.f = s.f AND o.n = s.n AND o.ent < s.ent JOIN lab m ON m.ent = o.ent JOIN (SELECT e.f, lab.c, min(e.ent) AS arrived FROM e JOIN lab USING (ent) WHERE e.n <> '' AND e.f IS NOT NULL GROUP BY e.f, lab.c) v ON v.f = s.f AND v.c = m.c GROUP BY s.ent) z ON z.ent = q.ent
 WHERE q.r < 15)
SELECT ent AS rec_id, c AS cluster_id FROM lab WHERE r = 15""",
    }
    sorted_name = lambda c: f"array_to_string(list_sort(list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')), ' ')"
    near = f"""w AS MATERIALIZED (SELECT DISTINCT f, n FROM e WHERE n <> '' AND f IS NOT NULL),
near AS MATERIALIZED (SELECT a.f, a.n AS a, b.n AS b FROM w a JOIN w b ON a.f = b.f AND a.n < b.n AND levenshtein(a.n, b.n) <= 0.1 * (len(a.n) + len(b.n)) + 1e-9),
alike AS MATERIALIZED (SELECT f, a, b FROM (SELECT *, {_LCS.format(a='a', b='b')} AS common FROM near) WHERE 200.0 * common / (len(a) + len(b)) >= 90)"""
    out["fuzzy_block_join"] = f"""WITH e AS MATERIALIZED (SELECT nullif(lower(trim(current_company, ' ')), '') AS f, {sorted_name(_TITLE.format("trim(name, ' ')"))} AS n FROM recruiter), {near} SELECT f AS company, a, b FROM alike"""
    ats_key = f"lower(trim(coalesce({strip('contact_email')}, {strip('applicant_name')}), ' '))"
    sources = {"recruiter_csv": ("recruiter", "rec_id", key, "name", "email", "phone", "current_company", 0), "ats_json": ("ats", "ats_id", ats_key, "applicant_name", "contact_email", "contact_phone", "current_employer", 1)}
    rows = " UNION ALL ".join(f"SELECT '{src}' AS source, {i} AS o, {row} AS row, {k} AS key, {strip(n)} AS name, {strip(m)} AS mail, {strip(p)} AS phone, {strip(c)} AS firm FROM {t}" for src, (t, row, k, n, m, p, c, i) in sources.items())
    out["greedy_clusters"] = f"""WITH RECURSIVE r AS MATERIALIZED (SELECT * FROM ({rows}) WHERE key IS NOT NULL),
y AS MATERIALIZED (SELECT source, key, min((o, row)) AS first, arg_min({_TITLE.format("trim(regexp_replace(name, '\\s+', ' ', 'g'))")}, row) FILTER (name IS NOT NULL) AS name, arg_min(lower(trim(firm, ' ')), row) FILTER (firm IS NOT NULL) AS f FROM r GROUP BY source, key),
e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY first) AS ent, source, key, f, {sorted_name('name')} AS n FROM y),
k AS MATERIALIZED (SELECT DISTINCT ent, kind, v FROM (SELECT e.ent, 'mail' AS kind, {_norm_email('mail')} AS v FROM r JOIN e USING (source, key) UNION ALL SELECT e.ent, 'phone', {_valid_us('phone')} FROM r JOIN e USING (source, key)) WHERE v IS NOT NULL),
x AS MATERIALIZED (SELECT DISTINCT a.ent, b.ent AS before FROM k a JOIN k b ON a.kind = b.kind AND a.v = b.v AND b.ent < a.ent),
{near},
pair AS MATERIALIZED (SELECT f, a, b FROM alike UNION ALL SELECT f, b, a FROM alike UNION ALL SELECT f, n, n FROM w),
seek AS MATERIALIZED (SELECT e.ent, o.ent AS before, e.f FROM e JOIN pair p ON p.f = e.f AND p.a = e.n JOIN e o ON o.f = e.f AND o.n = p.b AND o.ent < e.ent WHERE e.ent NOT IN (SELECT ent FROM x)),
lab(r, ent, c) AS (SELECT 0, ent, ent FROM e UNION ALL
 SELECT q.r + 1, q.ent, coalesce(h.c, z.c, q.ent) FROM lab q LEFT JOIN (SELECT x.ent, min(lab.c) AS c FROM x JOIN lab ON lab.ent = x.before GROUP BY x.ent) h ON h.ent = q.ent
 LEFT JOIN (SELECT s.ent, arg_min(m.c, v.arrived) AS c FROM seek s JOIN lab m ON m.ent = s.before JOIN (SELECT e.f, lab.c, min(e.ent) AS arrived FROM e JOIN lab USING (ent) WHERE e.n <> '' AND e.f IS NOT NULL GROUP BY e.f, lab.c) v ON v.f = s.f AND v.c = m.c GROUP BY s.ent) z ON z.ent = q.ent
 WHERE q.r < 20),
g AS (SELECT c, count(*) AS records, count(DISTINCT source) AS sources FROM lab JOIN e USING (ent) WHERE r = 20 GROUP BY c)
SELECT e.source, e.key AS candidate_key, records, sources FROM g JOIN e ON e.ent = g.c"""
    # without look-around: what stands before and after a new blank is matched and put back
    text = "trim(regexp_replace(concat_ws(' ,', applicant_name, job_title, skills_list), '\\s+', ' ', 'g'))"
    text = f"regexp_replace({text}, '([a-z])([A-Z][a-z]|(?:AI|API|REST|React|Expo)\\b)', '\\1 \\2', 'g')"
    steps = [f"p0 AS MATERIALIZED (SELECT ats_id, {text} AS t FROM ats)"]
    swaps = [(f"([a-z]{{4}})({w}(?:[a-z]|-|$))", "\\1 \\2") for w in T.JOINED_WORDS] + [(escaped(a), q(b)) for a, b in T.JOINED_TEXTS.items()]
    for i in range(0, len(swaps), 12):
        t = "t"
        for pattern, to in swaps[i : i + 12]:
            t = f"regexp_replace({t}, '{pattern}', '{to}', 'gi')"
        steps.append(f"p{i // 12 + 1} AS MATERIALIZED (SELECT ats_id, {t} AS t FROM p{i // 12})")
    last = f"p{len(steps) - 1}"
    out["spacing_repair"] = f"""WITH {", ".join(steps)}, j AS (SELECT ats_id, CASE WHEN regexp_matches(p0.t, '[A-Za-z]{{12}}') THEN l.t ELSE p0.t END AS t FROM p0 JOIN {last} l USING (ats_id)),
k AS (SELECT ats_id, regexp_replace(regexp_replace(t, '\\bReact based\\b', 'React-based', 'gi'), '\\bAI driven\\b', 'AI-driven', 'gi') AS t FROM j)
SELECT ats_id, nullif(trim(regexp_replace(regexp_replace(regexp_replace(t, '([,;:])([A-Za-z])', '\\1 \\2', 'g'), '\\s+([,.;:])', '\\1', 'g'), '\\s+', ' ', 'g')), '') AS text FROM k"""
    if known := _countries():
        lands, iso = known
        states = ", ".join(f"('{q(k)}', '{c}')" for k, c in {**T.US_STATES, **{c.lower(): c for c in T.US_STATES.values()}}.items())
        clean = "trim(regexp_replace(regexp_replace(location_city || ' , ' || location_country, '\\([^)]*\\)', ' ', 'g'), '\\s+', ' ', 'g'), ' -.,')"
        out["place_parse"] = f"""WITH land(k, c) AS (VALUES {lands}), st(k, c) AS (VALUES {states}), a AS (SELECT ats_id, string_split({clean}, ',') AS p, {clean} AS t FROM ats WHERE location_city IS NOT NULL AND location_country IS NOT NULL AND NOT contains(location_city || location_country, ',') AND regexp_matches(location_country, '[A-Za-z]')),
b AS (SELECT ats_id, t, trim(p[1], ' -') AS city, trim(p[2], ' -') AS rest, length(trim(p[1], ' -')) > 1 AND NOT regexp_matches(p[1], '\\d') AND regexp_matches(p[1], '[A-Za-z]') AND NOT regexp_matches(t, '@|\\b(github|linkedin|portfolio|https?|www)\\b', 'i') AS ok FROM a)
SELECT ats_id, CASE WHEN ok THEN city END AS city, CASE WHEN ok THEN coalesce(st.c, CASE WHEN land.c IS NULL THEN rest END) END AS region, CASE WHEN ok THEN CASE WHEN st.c IS NOT NULL THEN 'US' ELSE land.c END END AS country
FROM b LEFT JOIN st ON st.k = lower(trim(trim(rest), '.')) LEFT JOIN land ON land.k = lower(trim(trim(rest), '.'))"""
        out["country_lookup"] = f"""WITH land(k, c) AS (VALUES {lands}), iso(k, c) AS (VALUES {iso}), other(k, c) AS (VALUES {", ".join(f"('{q(k)}', '{c}')" for k, c in T.COUNTRY_ALIASES.items())}),
a AS (SELECT ats_id, {_STRIP.format('location_country')} AS t FROM ats), b AS (SELECT ats_id, t, lower(t) AS low, lower(trim(t, '.')) AS s FROM a),
held AS (SELECT ats_id, arg_min(every.c, every.k) AS c FROM b JOIN iso every ON length(every.k) > 3 AND length(low) > 3 AND contains(every.k, low) GROUP BY ats_id)
SELECT b.ats_id, CASE WHEN s <> '' THEN land.c END AS strict_code, CASE WHEN low = '' THEN NULL WHEN length(low) = 2 THEN upper(t) ELSE coalesce(CASE WHEN length(low) = 3 THEN iso3.c END, other.c, iso3.c, held.c) END AS code
FROM b LEFT JOIN land ON land.k = s LEFT JOIN iso iso3 ON iso3.k = low LEFT JOIN other ON other.k = low LEFT JOIN held USING (ats_id)"""
    return out
