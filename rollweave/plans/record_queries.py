"""Queries of the record model's own operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollweave.functions.claims import split_list
from rollweave.functions.normalize import blank_to_null, norm_country, norm_date, norm_email, norm_skill, norm_url, strip_markdown, title_case, token_sorted
from rollweave.functions.phones import norm_phone
from rollweave.functions.tables import MONTH_NAMES, SKILL_NAMES
from rollweave.operators.components import connected
from rollweave.operators.lines import fill_sections, lines_of, look_back, number_entries
from rollweave.operators.merge import candidate_id, merge_list, merge_scalar, merge_skills, overall_confidence, source_rank, years_of
from rollweave.operators.project import Config, confidence_band, project_json, project_struct, validation_errors
from rollweave.operators.resolve import alike_names, resolve
from rollweave.plans.pipeline import consolidate, load_config
from rollweave.session import cut, table
from rollweave.sources.ats import json_claims
from rollweave.sources.csv import table_claims
from rollweave.sources.documents import text_claims

PEOPLE = "candidates_combined_1ab46684"
AS_OF = 2026 * 12 + 7


def _order_claims(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    source = F.when(F.col("o_orderstatus") == "F", "recruiter_csv").when(F.col("o_orderstatus") == "O", "github_api").otherwise("elsewhere")
    sure = F.when(F.col("o_orderstatus") == "F", 0.95).when(F.col("o_orderstatus") == "O", 0.7).otherwise(0.55)
    c = o.select(F.col("o_custkey").alias("entity"), F.lit("full_name").alias("field"), F.col("o_orderpriority").alias("norm"), source.alias("source"), F.lit("direct_copy").alias("method"), sure.alias("raw_confidence"), F.col("o_orderkey").alias("at"))
    return c.withColumn("rank", source_rank(F.col("field"), F.col("source")))


_ORDER_CLAIMS = """c AS (SELECT o_custkey AS entity, o_orderpriority AS norm, o_orderkey AS o_at,
 CASE o_orderstatus WHEN 'F' THEN 'recruiter_csv' WHEN 'O' THEN 'github_api' ELSE 'elsewhere' END AS source,
 CASE o_orderstatus WHEN 'F' THEN 0.95::DOUBLE WHEN 'O' THEN 0.7::DOUBLE ELSE 0.55::DOUBLE END AS conf,
 CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 4 ELSE 7 END AS rank FROM orders)"""


def scalar_merge(spark: SparkSession, sf: str) -> DataFrame:
    return merge_scalar(_order_claims(spark, sf), ["entity", "field"]).select("entity", "value", "source", F.round("confidence", 4).alias("confidence"), "has_conflict", F.array_join("sources", "|").alias("sources"))


def list_merge_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return merge_list(_order_claims(spark, sf), ["entity", "field"]).select("entity", F.array_join("values", "|").alias("values_in_order"), F.round("confidence", 4).alias("confidence"))


def skill_merge(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, PEOPLE).select(F.col("candidate_id").alias("entity"), F.col("row_id"), F.posexplode("skills").alias("i", "s")).select("entity", F.struct("row_id", "i").alias("at"), "s", F.explode("s.sources").alias("source"))
    k = norm_skill(F.col("s.name"))
    m = merge_skills(c.select("entity", "at", F.col("s.confidence").alias("raw_confidence"), "source", k["name"].alias("norm"), k["verified"].alias("verified")), ["entity"])
    return m.select("entity", F.explode("skills").alias("s")).select("entity", F.col("s.name").alias("skill"), F.array_join("s.sources", ", ").alias("sources"), F.round("s.confidence", 4).alias("confidence"))


def unpivot_claims(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "recruiter").select("name", "email", "phone", "current_company", "title", "rec_id")
    return table_claims(r, F.col("rec_id")).groupBy("field", "source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("candidate_key").alias("people"))


def cell_split_explode(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "ats").select("ats_id", F.posexplode(split_list(F.col("skills_list"))).alias("p", "item")).select("ats_id", F.col("p").cast("bigint").alias("pos"), "item")


def json_path_claims(spark: SparkSession, sf: str) -> DataFrame:
    c = json_claims(table(spark, sf, "ats_raw"), "payload")
    return c.groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def normalize_email(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "recruiter").select("rec_id", norm_email(F.col("email")).alias("email_norm")).filter("email_norm IS NOT NULL")


def rejections_log(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "ats").select("ats_id", F.lit("emails").alias("field"), F.col("contact_email").alias("value"))
    return r.filter(blank_to_null(F.col("value")).isNotNull() & norm_email(F.col("value")).isNull()).withColumn("reason", F.lit("normalization_failed"))


def phone_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "ats").select("ats_id", norm_phone(F.col("contact_phone")).alias("phone")).filter("phone IS NOT NULL")


def url_normalize(spark: SparkSession, sf: str) -> DataFrame:
    u = F.concat(F.lit("(HTTPS://www."), F.split("email", "@")[1], F.lit("/"), F.split("email", "@")[0], F.lit("/),"))
    return table(spark, sf, "recruiter").filter(F.size(F.split("email", "@")) == 2).select("rec_id", norm_url(u).alias("url"))


def strip_markup(spark: SparkSession, sf: str) -> DataFrame:
    t = strip_markdown(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.length(t).cast("bigint").alias("chars"), F.md5(t.cast("binary")).alias("digest"))


def name_title(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "recruiter").filter("name IS NOT NULL").select("rec_id", title_case(F.col("name")).alias("titled"))


def date_normalize(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "ats").select("ats_id", F.posexplode("work_history").alias("p", "w")).select("ats_id", F.col("p").cast("bigint").alias("pos"), norm_date(F.col("w.start_date")).alias("s"), norm_date(F.col("w.end_date")).alias("e"))
    return d.select("ats_id", "pos", F.col("s.value").alias("start_value"), F.col("s.tag").alias("start_tag"), F.col("e.value").alias("end_value"), F.col("e.tag").alias("end_tag"))


def country_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "ats").select("ats_id", norm_country(F.col("location_country"), spark, strict=True).alias("strict_code"), norm_country(F.col("location_country"), spark).alias("code"))


def skill_lookup(spark: SparkSession, sf: str) -> DataFrame:
    k = norm_skill(F.col("item"))
    return cell_split_explode(spark, sf).select("ats_id", "pos", k["name"].alias("skill"), k["verified"].alias("verified"))


def _normal_stints(col: str = "experience"):
    return F.transform(col, lambda x: F.struct(norm_date(x["start"])["value"].alias("start"), norm_date(x["end"])["value"].alias("end")))


def interval_union(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, PEOPLE).select("row_id", years_of(_normal_stints(), AS_OF).alias("years"))


def years_fallback(spark: SparkSession, sf: str) -> DataFrame:
    y = years_of(_normal_stints(), AS_OF)
    return table(spark, sf, PEOPLE).select("row_id", F.coalesce("years_experience", y).alias("years"), (F.col("years_experience").isNull() & y.isNotNull()).alias("derived"))


def exact_match_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "recruiter").select("rec_id", norm_email(F.col("email")).alias("key")).filter("key IS NOT NULL")
    star = e.groupBy("key").agg(F.min("rec_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return e.join(star, "key").filter("rec_id > first_id").select("key", "first_id", "rec_id")


def fuzzy_block_join(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "recruiter")
    people = r.select(F.nullif(F.lower(F.trim("current_company")), F.lit("")).alias("company"), token_sorted(title_case(F.trim("name"))).alias("sorted")).filter("company IS NOT NULL AND sorted <> ''")
    return alike_names(people).filter("a < b")


def connected_entities(spark: SparkSession, sf: str) -> DataFrame:
    return connected(exact_match_edges(spark, sf).unionByName(_phone_edges(spark, sf)), "first_id", "rec_id")


def _phone_edges(spark: SparkSession, sf: str) -> DataFrame:
    digits = F.regexp_replace("phone", r"[^0-9]", "")
    e = table(spark, sf, "recruiter").select("rec_id", F.when(F.length(digits) >= 10, F.substring(digits, -10, 10)).alias("key")).filter("key IS NOT NULL")
    star = e.groupBy("key").agg(F.min("rec_id").alias("first_id"))
    return e.join(star, "key").filter("rec_id > first_id").select("key", "first_id", "rec_id")


def _people_claims(spark: SparkSession, sf: str) -> DataFrame:
    rec = table(spark, sf, "recruiter").select("rec_id", "name", "email", "phone", "current_company", "title")
    ats = table(spark, sf, "ats").select("ats_id", F.to_json(F.struct("applicant_name", "contact_email", "contact_phone", "current_employer", "job_title", "location_city", "location_state", "location_country", "skills_list", "years_of_experience", "education", "work_history")).alias("payload"))
    return table_claims(rec, F.col("rec_id")).unionByName(json_claims(ats, "payload", F.col("ats_id")))


def greedy_clusters(spark: SparkSession, sf: str) -> DataFrame:
    placed = resolve(cut(_people_claims(spark, sf))).select("source", "candidate_key", "member", "cluster_id").distinct()
    first = F.min_by(F.struct("source", "candidate_key"), "member").alias("first")
    return placed.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("source").alias("sources"), first).select("first.source", "first.candidate_key", "records", "sources")


def pipeline_records(spark: SparkSession, sf: str) -> DataFrame:
    r = consolidate(_people_claims(spark, sf), load_config("full"), AS_OF)
    return r.merged.golden.select("candidate_id", "full_name", F.size("emails").alias("emails"), F.size("phones").alias("phones"), F.size("skills").alias("skills"), "years_experience", "overall_confidence")


def pipeline_output(spark: SparkSession, sf: str) -> DataFrame:
    """The whole pipeline over recruiters, applications and résumés: every projected record and what its validation says."""
    docs = table(spark, sf, "documents").filter("doc_kind = 'resume'")
    r = consolidate(_people_claims(spark, sf).unionByName(text_claims(docs, "text", F.col("doc_id"))), load_config("full"), AS_OF)
    errors = r.errors.groupBy("candidate_id").agg(F.array_join(F.array_sort(F.collect_set("error")), "; ").alias("errors"))
    return r.records.join(errors, "candidate_id", "left").select("candidate_id", "json", "errors")


def resume_claims(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").filter("doc_kind = 'resume'")
    return text_claims(docs, "text", F.col("doc_id")).groupBy("field", "method").agg(F.count(F.lit(1)).alias("n"))


def section_fill(spark: SparkSession, sf: str) -> DataFrame:
    heading = F.when(F.col("line").rlike("^#+ "), F.regexp_replace("line", "^#+ +", ""))
    filled = fill_sections(lines_of(table(spark, sf, "documents"), "doc_id", "text"), "doc_id", heading)
    return filled.filter("section IS NOT NULL").groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("n_lines"))


def entry_sessionize(spark: SparkSession, sf: str) -> DataFrame:
    e = number_entries(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "click")
    return e.groupBy("user_id", "entry").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


def lookback_context(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(F.col("event_type") == "click", F.col("event_id"))
    return look_back(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], v, 2).filter("context IS NOT NULL").select("event_id", "context")


def priority_topk(spark: SparkSession, sf: str) -> DataFrame:
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey")))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.o_orderkey", "b.o_totalprice")


def record_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, PEOPLE).select("row_id", overall_confidence(F.transform("skills", lambda s: s["confidence"])).alias("confidence"))


def record_id(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "recruiter")
    return r.select("rec_id", candidate_id(norm_email(F.col("email")), blank_to_null(F.col("name")), blank_to_null(F.col("current_company"))).alias("record_key"))


def _golden(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, PEOPLE)
    mail = F.filter(F.array(norm_email(F.col("primary_email"))), lambda x: x.isNotNull())
    return p.select("row_id", "candidate_id", blank_to_null(F.col("full_name")).alias("full_name"), mail.alias("emails"), "phones", "location", "headline", "years_experience", "skills", "experience", "overall_confidence", "provenance")


def project_config(spark: SparkSession, sf: str) -> DataFrame:
    config = Config.of({"fields": [{"path": "who.name", "from": "full_name"}, {"path": "who.mail", "from": "emails[0]"}, {"path": "top", "from": "skills[0].name"}, {"path": "skills", "from": "skills[].name", "type": "string[]"}, {"path": "city", "from": "location.city"}, {"path": "years", "from": "years_experience", "type": "number"}], "include_confidence": False})
    p = project_struct(_golden(spark, sf), config, ("row_id",))
    return p.select("row_id", F.col("record.who.name").alias("name"), F.col("record.who.mail").alias("mail"), F.col("record.top").alias("top"), F.array_join("record.skills", "|").alias("skills"), F.col("record.city").alias("city"), F.col("record.years").alias("years"))


def project_omit(spark: SparkSession, sf: str) -> DataFrame:
    config = Config.of({"fields": [{"path": "name", "from": "full_name"}, {"path": "headline", "from": "headline"}, {"path": "mail", "from": "emails[0]"}], "include_confidence": False, "on_missing": "omit"})
    j = project_json(_golden(spark, sf), config, ("row_id",))
    return j.select("row_id", F.coalesce(F.array_join(F.json_object_keys("json"), ","), F.lit("")).alias("keys"))


def validate_errors(spark: SparkSession, sf: str) -> DataFrame:
    shape = Config.of({"fields": [{"path": "name", "from": "full_name"}, {"path": "phones", "from": "phones", "type": "string[]"}, {"path": "years", "from": "years_experience", "type": "number"}], "include_confidence": True})
    strict = Config.of({"fields": [{"path": "name", "required": True}, {"path": "phones", "type": "number"}, {"path": "years", "type": "string"}, {"path": "gone", "required": True}], "include_confidence": True})
    j = project_json(_golden(spark, sf), shape, ("row_id",))
    return j.select("row_id", F.explode(validation_errors(F.col("json"), strict)).alias("e")).groupBy(F.col("e.field").alias("field")).agg(F.count(F.lit(1)).alias("n"))


def null_field_counts(spark: SparkSession, sf: str) -> DataFrame:
    g = _golden(spark, sf)
    lost = F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("full_name", "headline", "years_experience")], *[F.when(F.size(c) == 0, F.lit(c)) for c in ("emails", "phones", "skills")])
    return g.select(F.explode(F.filter(lost, lambda x: x.isNotNull())).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = merge_scalar(_order_claims(spark, sf), ["entity", "field"])
    return s.agg(F.count(F.lit(1)).alias("records"), F.sum(F.col("has_conflict").cast("int")).alias("conflicts_found"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def record_bands(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, PEOPLE).groupBy(confidence_band(F.col("overall_confidence")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


_FUNCTIONS = (
    scalar_merge, list_merge_distinct, skill_merge, unpivot_claims, cell_split_explode, json_path_claims, normalize_email, rejections_log, phone_normalize, url_normalize, strip_markup, name_title, date_normalize, country_lookup, skill_lookup,
    interval_union, years_fallback, exact_match_edges, fuzzy_block_join, connected_entities, greedy_clusters, pipeline_records, pipeline_output, resume_claims, section_fill, entry_sessionize, lookback_context, priority_topk, record_confidence, record_id,
    project_config, project_omit, validate_errors, null_field_counts, run_summary, record_bands,
)


def queries() -> dict:
    return {f.__name__: f for f in _FUNCTIONS}


_EMAIL = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_TITLE = r"array_to_string(list_transform(regexp_extract_all({0}, '(\p{{L}}+|\P{{L}}+)'), lambda p: upper(p[1:1]) || lower(p[2:])), '')"


def _norm_email(c: str) -> str:
    t = f"lower({_STRIP.format(c)})"
    return f"CASE WHEN regexp_matches({t}, '{_EMAIL}') THEN {t} END"


def _date(c: str) -> tuple[str, str]:
    t = _STRIP.format(c)
    months = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in MONTH_NAMES.items()) + "}"
    month = f"{months}[lower(regexp_extract({t}, '^([A-Za-z]+)\\s+\\d{{4}}$', 1))]"
    present = f"({t} IS NULL OR lower({t}) IN ('', 'present', 'current', 'now', 'ongoing'))"
    exact = f"""CASE WHEN regexp_matches({t}, '^\\d{{4}}-\\d{{1,2}}(-\\d{{1,2}})?$') THEN {t}[1:4] || '-' || lpad(regexp_extract({t}, '^\\d{{4}}-(\\d{{1,2}})', 1), 2, '0')
 WHEN regexp_matches({t}, '^\\d{{1,2}}/\\d{{4}}$') THEN {t}[-4:] || '-' || lpad(regexp_extract({t}, '^(\\d+)/', 1), 2, '0')
 WHEN regexp_matches({t}, '^[A-Za-z]+\\s+\\d{{4}}$') THEN {t}[-4:] || '-' || {month} END"""
    value = f"CASE WHEN NOT {present} THEN coalesce({exact}, CASE WHEN regexp_matches({t}, '^\\d{{4}}$') THEN {t} || '-01' END) END"
    tag = f"CASE WHEN {present} THEN 'present' WHEN ({exact}) IS NOT NULL THEN 'exact' WHEN regexp_matches({t}, '^\\d{{4}}$') THEN 'year_only_approximated' ELSE 'unparseable' END"
    return value, tag


_PHONE_KEY = r"CASE WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 10 THEN right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) END"
_GOLDEN = f"""g AS (SELECT *, nullif({_STRIP.format('full_name')}, '') AS fn, {_norm_email('primary_email')} AS mail FROM {PEOPLE})"""


def _years() -> str:
    start, _ = _date('s."start"')
    end, _ = _date('s."end"')
    index = "TRY_CAST(split_part({0}, '-', 1) AS INT) * 12 + TRY_CAST(split_part({0}, '-', 2) AS INT)"
    return f"""st AS (SELECT row_id, {start} AS a, {end} AS b FROM (SELECT row_id, unnest(experience) AS s FROM {PEOPLE})),
iv AS (SELECT row_id, {index.format('a')} AS s, coalesce({index.format('b')}, {AS_OF}) AS e FROM st WHERE a IS NOT NULL),
ru AS (SELECT *, max(e) OVER (PARTITION BY row_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv WHERE e >= s),
la AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM ru),
pe AS (SELECT row_id, n, max(e) - min(s) AS m FROM la GROUP BY row_id, n),
yr AS (SELECT row_id, round(sum(m) / 12.0::DOUBLE, 1) AS y FROM pe GROUP BY row_id)"""


def oracle_sql() -> dict[str, str]:
    skills = ", ".join("('" + k.replace("'", "''") + f"', '{v}')" for k, v in SKILL_NAMES.items())
    split = r"SELECT ats_id, item, (row_number() OVER (PARTITION BY ats_id ORDER BY i)) - 1 AS pos FROM (SELECT ats_id, regexp_replace(item, '^\s+|\s+$', '', 'g') AS item, i FROM (SELECT ats_id, unnest(regexp_split_to_array(skills_list, '[,;|]')) AS item, generate_subscripts(regexp_split_to_array(skills_list, '[,;|]'), 1) AS i FROM ats)) WHERE item <> ''"
    flat = {"full_name": ("applicant_name", "name", "full_name", "candidate_name"), "emails": ("contact_email", "email", "email_address", "primary_email"), "phones": ("contact_phone", "phone", "phone_number", "mobile"), "current_company": ("current_employer", "company", "employer", "current_company"), "title": ("job_title", "title", "role", "position"), "location.city": ("location_city", "city"), "location.region": ("location_state", "state", "region"), "location.country": ("location_country", "country"), "skills": ("skills_list", "skills", "skillset", "tech_stack"), "years_experience": ("years_of_experience", "experience_years", "yoe")}
    listed = lambda k, f: f"len(list_filter(regexp_split_to_array(payload ->> '$.{k}', '[,;|]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> ''))" if f == "skills" else "1"
    count = lambda k, f: f"CASE json_type(payload, '$.{k}') WHEN 'ARRAY' THEN json_array_length(payload, '$.{k}') WHEN 'NULL' THEN 0 ELSE CASE WHEN trim(payload ->> '$.{k}') <> '' THEN {listed(k, f)} ELSE 0 END END"
    named = " OR ".join(f"coalesce({count(k, f)}, 0) > 0" for f in ("full_name", "emails") for k in flat[f])
    json_counts = " UNION ALL ".join(f"SELECT '{f}' AS field, CAST(sum({' + '.join(f'coalesce({count(k, f)}, 0)' for k in keys)}) AS BIGINT) AS n FROM r" for f, keys in flat.items())
    (sv, st), (ev, et) = _date("w.start_date"), _date("w.end_date")
    cells = " UNION ALL ".join(f"SELECT '{f}' AS field, key FROM k WHERE coalesce({_STRIP.format(c)}, '') <> ''" for c, f in (("name", "full_name"), ("email", "emails"), ("phone", "phones"), ("current_company", "current_company"), ("title", "title")))
    mails = f"e AS (SELECT rec_id, {_norm_email('email')} AS key FROM recruiter), s AS (SELECT key, min(rec_id) AS first_id FROM e WHERE key IS NOT NULL GROUP BY key)"
    return {
        "scalar_merge": f"""WITH {_ORDER_CLAIMS}, b AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY rank, o_at) AS rn FROM c),
a AS (SELECT entity, count(DISTINCT norm) AS d, count(*) AS n, max(conf) AS top, string_agg(DISTINCT source, '|' ORDER BY source) AS sources FROM c GROUP BY entity)
SELECT a.entity, b.norm AS value, b.source, round(CASE WHEN d > 1 THEN 0.6::DOUBLE WHEN n > 1 THEN least(1.0::DOUBLE, top + 0.1::DOUBLE) ELSE top END, 4) AS confidence, d > 1 AS has_conflict, sources FROM a JOIN b ON a.entity = b.entity AND rn = 1""",
        "list_merge_distinct": f"""WITH {_ORDER_CLAIMS}, d AS (SELECT entity, norm, min(o_at) AS o_at, max(conf) AS top, count(*) AS n FROM c GROUP BY entity, norm)
SELECT entity, string_agg(norm, '|' ORDER BY o_at) AS values_in_order, round(CASE WHEN count(*) = 1 AND sum(n) > 1 THEN least(1.0::DOUBLE, max(top) + 0.1::DOUBLE) ELSE max(top) END, 4) AS confidence FROM d GROUP BY entity""",
        "skill_merge": f"""WITH t(k, v) AS (VALUES {skills}), x AS (SELECT candidate_id AS entity, unnest(skills) AS s FROM {PEOPLE}),
y AS (SELECT entity, s.name AS raw, s.confidence AS conf, unnest(s.sources) AS source FROM x),
z AS (SELECT entity, coalesce(v, {_TITLE.format('raw')}) AS skill, v IS NOT NULL AS ok, conf, source FROM y LEFT JOIN t ON lower({_STRIP.format('raw')}) = k),
m AS (SELECT entity, skill, bool_or(ok) AS ok, max(conf) AS top, count(DISTINCT source) AS n, string_agg(DISTINCT source, ', ' ORDER BY source) AS sources FROM z GROUP BY entity, skill)
SELECT entity, skill, sources, round(CASE WHEN ok THEN CASE WHEN n > 1 THEN least(1.0::DOUBLE, top + 0.1::DOUBLE) ELSE top END ELSE least(0.5::DOUBLE, top) END, 2) AS confidence FROM m""",
        "unpivot_claims": f"""WITH k AS (SELECT *, lower(coalesce(nullif({_STRIP.format('email')}, ''), nullif({_STRIP.format('name')}, ''))) AS key FROM recruiter), c AS ({cells})
SELECT field, 'recruiter_csv' AS source, count(*) AS n, count(DISTINCT key) AS people FROM c WHERE key IS NOT NULL GROUP BY field""",
        "cell_split_explode": f"SELECT ats_id, CAST(pos AS BIGINT) AS pos, item FROM ({split})",
        "json_path_claims": f"WITH r AS (SELECT payload FROM ats_raw WHERE {named}) SELECT * FROM ({json_counts}) WHERE n > 0",
        "normalize_email": f"SELECT * FROM (SELECT rec_id, {_norm_email('email')} AS email_norm FROM recruiter) WHERE email_norm IS NOT NULL",
        "rejections_log": f"SELECT ats_id, 'emails' AS field, contact_email AS value, 'normalization_failed' AS reason FROM ats WHERE {_STRIP.format('contact_email')} <> '' AND ({_norm_email('contact_email')}) IS NULL",
        "phone_normalize": r"""WITH b AS (SELECT ats_id, regexp_replace(contact_phone, '\s*(ext\.?|x|#)\s*\d{1,6}\s*$', '', 'i') AS body FROM ats),
d AS (SELECT ats_id, body, regexp_replace(body, '[^0-9]', '', 'g') AS d FROM b WHERE NOT contains(body, '+') OR regexp_replace(body, '[^0-9]', '', 'g')[1] = '1'),
n AS (SELECT ats_id, CASE WHEN regexp_full_match(d, '[2-9]\d{2}[2-9]\d{6}') AND NOT contains(body, '+') THEN d WHEN regexp_full_match(d, '1[2-9]\d{2}[2-9]\d{6}') THEN d[2:] END AS n FROM d)
SELECT ats_id, '+1' || n AS phone FROM n WHERE n IS NOT NULL""",
        "url_normalize": r"""SELECT rec_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim('(HTTPS://www.' || split_part(email, '@', 2) || '/' || split_part(email, '@', 1) || '/),'),
 '^[()\[\]{}<>]+|[()\[\]{}<>]+$', '', 'g'), '[).,;]+$', ''), '^https?://', '', 'i'), '^www\.', '', 'i'), '/+$', '') AS url FROM recruiter WHERE len(string_split(email, '@')) = 2""",
        "strip_markup": r"""SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!\[[^\]]*\]\([^)]+\)', ' ', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '<[^>]+>', ' ', 'g'), '`{1,3}([^`]*)`{1,3}', '\1', 'g') AS t FROM documents)""",
        "name_title": f"SELECT rec_id, {_TITLE.format('name')} AS titled FROM recruiter WHERE name IS NOT NULL",
        "date_normalize": f"SELECT ats_id, CAST(i - 1 AS BIGINT) AS pos, {sv} AS start_value, {st} AS start_tag, {ev} AS end_value, {et} AS end_tag FROM (SELECT ats_id, unnest(work_history) AS w, generate_subscripts(work_history, 1) AS i FROM ats)",
        "skill_lookup": f"WITH t(k, v) AS (VALUES {skills}) SELECT ats_id, CAST(pos AS BIGINT) AS pos, coalesce(v, {_TITLE.format(_STRIP.format('item'))}) AS skill, v IS NOT NULL AS verified FROM ({split}) LEFT JOIN t ON lower({_STRIP.format('item')}) = k",
        "interval_union": f"WITH {_years()} SELECT p.row_id, y AS years FROM {PEOPLE} p LEFT JOIN yr USING (row_id)",
        "years_fallback": f"WITH {_years()} SELECT p.row_id, coalesce(years_experience, y) AS years, years_experience IS NULL AND y IS NOT NULL AS derived FROM {PEOPLE} p LEFT JOIN yr USING (row_id)",
        "exact_match_edges": f"WITH {mails} SELECT e.key, first_id, rec_id FROM e JOIN s ON e.key = s.key WHERE rec_id > first_id",
        "connected_entities": f"""WITH RECURSIVE {mails}, f AS (SELECT rec_id, {_PHONE_KEY} AS key FROM recruiter), g AS (SELECT key, min(rec_id) AS first_id FROM f WHERE key IS NOT NULL GROUP BY key),
d AS (SELECT rec_id AS a, first_id AS b FROM e JOIN s ON e.key = s.key WHERE rec_id > first_id UNION SELECT rec_id, first_id FROM f JOIN g ON f.key = g.key WHERE rec_id > first_id),
u AS (SELECT a, b FROM d UNION SELECT b, a FROM d), w(node, c) AS (SELECT a, a FROM u UNION SELECT u.b, w.c FROM w JOIN u ON u.a = w.node)
SELECT node, min(c) AS component FROM w GROUP BY node""",
        "section_fill": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
f AS (SELECT doc_id, last_value(CASE WHEN regexp_matches(line, '^#+ ') THEN regexp_replace(line, '^#+ +', '') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM l)
SELECT doc_id, section, count(*) AS n_lines FROM f WHERE section IS NOT NULL GROUP BY doc_id, section""",
        "entry_sessionize": "SELECT user_id, CAST(entry AS BIGINT) AS entry, count(*) AS n, min(event_id) AS first_event FROM (SELECT *, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS entry FROM events) GROUP BY user_id, entry",
        "lookback_context": "SELECT event_id, context FROM (SELECT event_id, coalesce(lag(v, 1) OVER w, lag(v, 2) OVER w) AS context FROM (SELECT *, CASE WHEN event_type = 'click' THEN event_id END AS v FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE context IS NOT NULL",
        "priority_topk": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1",
        "record_confidence": f"SELECT row_id, CASE WHEN len(skills) = 0 THEN 0.0::DOUBLE ELSE round(CAST(list_sum(list_transform(skills, lambda s: s.confidence)) / len(skills) * least(len(skills) / 10.0::DOUBLE, 1.0::DOUBLE) AS DECIMAL(18, 12)), 4)::DOUBLE END AS confidence FROM {PEOPLE}",
        "record_id": f"""SELECT rec_id, sha256(coalesce(m, CASE WHEN n IS NOT NULL OR c IS NOT NULL THEN coalesce(n, '') || '|' || coalesce(c, '') END, 'unknown'))[1:16] AS record_key
FROM (SELECT rec_id, {_norm_email('email')} AS m, nullif({_STRIP.format('name')}, '') AS n, nullif({_STRIP.format('current_company')}, '') AS c FROM recruiter)""",
        "project_config": f"WITH {_GOLDEN} SELECT row_id, fn AS name, mail, skills[1].name AS top, CASE WHEN len(skills) > 0 THEN array_to_string(list_transform(skills, lambda s: s.name), '|') END AS skills, location.city AS city, years_experience AS years FROM g",
        "project_omit": f"WITH {_GOLDEN} SELECT row_id, concat_ws(',', CASE WHEN fn IS NOT NULL THEN 'name' END, CASE WHEN headline IS NOT NULL THEN 'headline' END, CASE WHEN mail IS NOT NULL THEN 'mail' END) AS keys FROM g",
        "validate_errors": f"WITH {_GOLDEN} SELECT * FROM (SELECT 'phones' AS field, count(*) FILTER (len(phones) > 0) AS n FROM g UNION ALL SELECT 'years', count(*) FILTER (years_experience IS NOT NULL) FROM g UNION ALL SELECT 'gone', count(*) FROM g) WHERE n > 0",
        "null_field_counts": f"""WITH {_GOLDEN} SELECT * FROM (SELECT 'full_name' AS field, count(*) FILTER (fn IS NULL) AS n FROM g UNION ALL SELECT 'headline', count(*) FILTER (headline IS NULL) FROM g UNION ALL SELECT 'years_experience', count(*) FILTER (years_experience IS NULL) FROM g
UNION ALL SELECT 'emails', count(*) FILTER (mail IS NULL) FROM g UNION ALL SELECT 'phones', count(*) FILTER (len(phones) = 0) FROM g UNION ALL SELECT 'skills', count(*) FILTER (len(skills) = 0) FROM g) WHERE n > 0""",
        "run_summary": f"""WITH {_ORDER_CLAIMS}, a AS (SELECT entity, count(DISTINCT norm) AS d, count(*) AS n, max(conf) AS top FROM c GROUP BY entity)
SELECT count(*) AS records, CAST(sum(CASE WHEN d > 1 THEN 1 ELSE 0 END) AS BIGINT) AS conflicts_found, round(avg(CASE WHEN d > 1 THEN 0.6::DOUBLE WHEN n > 1 THEN least(1.0::DOUBLE, top + 0.1::DOUBLE) ELSE top END), 6) AS mean_confidence FROM a""",
        "record_bands": f"SELECT CASE WHEN overall_confidence >= 0.8 THEN 'high' WHEN overall_confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM {PEOPLE} GROUP BY 1",
    }
