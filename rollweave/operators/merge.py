"""One golden record per cluster of claims, with provenance, confidence, conflicts and rejections.

All merges are aggregates over (cluster, field); claims are normalized once and read from the checkpoint by every merge. Where the model
says "first", the order is the arrival of the record in its cluster, then the order of its claims.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollweave.functions.normalize import norm_country, norm_date, norm_email, norm_name, norm_skill
from rollweave.functions.phones import norm_phone_in
from rollweave.functions.tables import AGREEMENT, CONFLICT, DERIVED, EXPECTED_FIELDS, HISTORY, SOURCE_ORDER, UNVERIFIED
from rollweave.operators.intervals import row_periods
from rollweave.session import cut

#: Scalar fields in the order in which they are scored; links are merged alike but aren't scored.
SCALARS = ("full_name", "location.city", "location.region", "location.country", "headline", "years_experience", "title", "current_company")
LINKS = ("links.linkedin", "links.github", "links.portfolio")
EXP = "array<struct<company:string,title:string,start:string,end:string,summary:string>>"
EDU = "array<struct<institution:string,degree:string,field:string,end_year:int>>"
PROV = "array<struct<field:string,source:string,method:string>>"


def source_rank(field: Column, source: Column) -> Column:
    """Rank of a source for a field, 0 best; the number of listed sources for one that isn't listed, 0 for fields that rank none."""
    rank = F.lit(0)
    for names in dict.fromkeys(SOURCE_ORDER.values()):
        of = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in names]), source), F.lit(0)) - 1, F.lit(len(names))).cast("int")
        rank = F.when(field.isin(*[f for f, o in SOURCE_ORDER.items() if o == names]), of).otherwise(rank)
    return rank


def merge_scalar(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Per ``keys`` (with ``field`` among them): ``value``, ``source``, ``method``, ``confidence``, ``has_conflict`` and ``sources``.

    ``claims`` has ``norm``, ``raw_confidence``, ``source``, ``method``, ``rank`` and ``at`` (order). Null and blank values don't count.
    One distinct value keeps its best confidence, raised by agreement if several claims give it; several values leave the best ranked, earliest one with the
    confidence of a conflict. Groups without a value have no row.
    """
    c = claims.filter(F.coalesce("norm", F.lit("")) != "")
    best = F.min_by(F.struct("norm", "source", "method"), F.struct("rank", "at"))
    g = c.groupBy(*keys).agg(
        best.alias("b"), (F.min("norm") != F.max("norm")).alias("has_conflict"), F.count(F.lit(1)).alias("n"), F.max("raw_confidence").alias("top"),
        F.collect_set("source").alias("all_sources"),
    )
    # agreement counts claims, not sources
    conf = F.when(F.col("has_conflict"), F.lit(CONFLICT)).when(F.col("n") > 1, F.least(F.lit(1.0), F.col("top") + AGREEMENT)).otherwise(F.col("top"))
    return g.select(*keys, F.col("b.norm").alias("value"), F.col("b.source").alias("source"), F.col("b.method").alias("method"), conf.cast("double").alias("confidence"), "has_conflict", F.array_sort("all_sources").alias("sources"))


def merge_list(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Per ``keys``: ``values`` in order of first appearance, their ``prov`` and one ``confidence``.

    ``claims`` as for ``merge_scalar``. The confidence is the best of the valid claims, raised by agreement if they all give one value.
    """
    c = claims.filter(F.coalesce("norm", F.lit("")) != "")
    one = c.groupBy(*keys, "norm").agg(F.min_by(F.struct("at", "source", "method"), "at").alias("f"), F.max("raw_confidence").alias("top"), F.count(F.lit(1)).alias("n"))
    g = one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("f.at").alias("at"), F.col("norm").alias("value"), F.col("f.source").alias("source"), F.col("f.method").alias("method")))).alias("l"), F.max("top").alias("top"), F.sum("n").alias("n"))
    conf = F.when((F.size("l") == 1) & (F.col("n") > 1), F.least(F.lit(1.0), F.col("top") + AGREEMENT)).otherwise(F.col("top"))
    return g.select(*keys, F.transform("l", lambda x: x["value"]).alias("values"), F.transform("l", lambda x: F.struct(x["source"].alias("source"), x["method"].alias("method"))).alias("prov"), conf.cast("double").alias("confidence"))


def merge_skills(claims: DataFrame, keys: list[str]) -> DataFrame:
    """Per ``keys``: ``skills`` (name, confidence, sources) in order of first appearance, their ``prov`` and the mean ``confidence``.

    ``claims`` has ``norm``, ``verified``, ``raw_confidence``, ``source`` and ``at``. A skill from several sources gains by agreement; one
    outside the taxonomy stays below the cap.
    """
    c = claims.filter(F.coalesce("norm", F.lit("")) != "")
    one = c.groupBy(*keys, "norm").agg(F.min("at").alias("at"), F.array_sort(F.collect_set("source")).alias("sources"), F.max("raw_confidence").alias("top"), F.max("verified").alias("verified"))
    conf = F.when(F.size("sources") > 1, F.least(F.lit(1.0), F.col("top") + AGREEMENT)).otherwise(F.col("top"))
    one = one.withColumn("confidence", F.round(F.when(F.col("verified"), conf).otherwise(F.least(conf, F.lit(UNVERIFIED))), 2))
    g = one.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "norm", "confidence", "sources", "verified"))).alias("l"), F.round(F.avg("confidence"), 2).alias("confidence"))
    skill = F.transform("l", lambda x: F.struct(x["norm"].alias("name"), x["confidence"].alias("confidence"), x["sources"].alias("sources")))
    prov = F.transform("l", lambda x: F.struct(F.concat(F.lit("skills."), x["norm"]).alias("field"), F.array_join(x["sources"], ", ").alias("source"), F.when(x["verified"], "taxonomy_match").otherwise("passthrough").alias("method")))
    return g.select(*keys, skill.alias("skills"), prov.alias("prov"), "confidence")


def years_of(experience: Column, as_of: int) -> Column:
    """Years covered by stints (``start`` and ``end`` as ``YYYY-MM``), overlaps counted once; open and broken ends are ``as_of`` (a month number). Null without any."""
    month = lambda t: F.when(t.rlike(r"^\d+-\d+$"), F.split(t, "-")[0].cast("int") * 12 + F.split(t, "-")[1].cast("int"))
    spans = F.transform(experience, lambda x: F.struct(month(x["start"]).alias("s"), F.coalesce(month(x["end"]), F.lit(as_of)).cast("int").alias("e")))
    merged = row_periods(spans, touch=0)
    total = F.aggregate(merged, F.lit(0), lambda acc, x: acc + x["e"] - x["s"])
    return F.when(F.size(merged) > 0, F.round(total / 12.0, 1))


def overall_confidence(confidences: Column) -> Column:
    """Mean of the field confidences, scaled down while fewer fields than expected have one; 0 without any."""
    n = F.size(confidences)
    mean = F.aggregate(confidences, F.lit(0.0), lambda acc, x: acc + x) / n
    return F.when(n > 0, F.round(mean * F.least(n / F.lit(float(EXPECTED_FIELDS)), F.lit(1.0)), 4)).otherwise(F.lit(0.0))


def candidate_id(email: Column, name: Column, company: Column) -> Column:
    """Sixteen hex digits of the hash of the first address, else of name and company, else of ``unknown``."""
    seed = F.coalesce(email, F.when(name.isNotNull() | company.isNotNull(), F.concat(F.coalesce(name, F.lit("")), F.lit("|"), F.coalesce(company, F.lit("")))), F.lit("unknown"))
    return F.substring(F.sha2(seed, 256), 1, 16)


@dataclass
class Merged:
    """Golden records and what the merge left behind."""

    golden: DataFrame
    conflicts: DataFrame
    rejections: DataFrame
    null_fields: DataFrame


def normalized(claims: DataFrame) -> DataFrame:
    """Claims of resolved records with ``norm``, ``verified``, ``rank`` and ``at``."""
    spark = claims.sparkSession
    c = claims.withColumn("at", F.struct("member", "ord"))
    # regions in which a cluster's local phone numbers are tried, the most certain country first
    land = c.filter(F.col("field") == "location.country").withColumn("land", norm_country(F.col("value_text"), spark)).filter(F.col("land").isNotNull())
    lands = land.groupBy("cluster_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("raw_confidence")).alias("c"), "at", "land"))), lambda x: x["land"])).alias("regions"))
    c = c.join(lands.hint("merge"), "cluster_id", "left")
    text, field = F.col("value_text"), F.col("field")
    only = lambda f: F.when(field == f, text)
    phone = norm_phone_in(only("phones"), F.coalesce("regions", F.array().cast("array<string>")))
    c = c.withColumn("__phone", phone).withColumn("__skill", norm_skill(only("skills")))
    norm = (
        F.when(field == "full_name", norm_name(text)).when(field == "emails", norm_email(text)).when(field == "phones", F.col("__phone.value")).when(field == "location.country", norm_country(only("location.country"), spark))
        .when(field == "skills", F.col("__skill.name")).otherwise(F.nullif(F.trim(text), F.lit("")))
    )
    out = c.withColumn("norm", norm).withColumn("verified", F.col("__skill.verified")).withColumn("rank", source_rank(field, F.col("source")))
    used = F.when(F.col("__phone.region").isNotNull(), F.map_concat(F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.create_map(F.lit("region_used"), F.col("__phone.region"), F.lit("region_source"), F.lit("inferred_from_location")))).otherwise(F.col("metadata"))
    return out.withColumn("metadata", used).drop("__phone", "__skill", "regions")


def _histories(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    exp = c.filter((F.col("field") == "experience") & (F.coalesce(F.trim("value_exp.company"), F.trim("value_exp.title"), F.lit("")) != ""))
    x = F.struct(F.col("value_exp.company").alias("company"), F.col("value_exp.title").alias("title"), norm_date(F.col("value_exp.start"))["value"].alias("start"), norm_date(F.col("value_exp.end"))["value"].alias("end"), F.col("value_exp.summary").alias("summary"))
    exp = exp.withColumn("x", x).withColumn("key", F.concat_ws("|", F.coalesce(F.lower("x.company"), F.lit("")), F.coalesce(F.lower("x.title"), F.lit("")), F.coalesce("x.start", F.lit(""))))
    edu = c.filter((F.col("field") == "education") & (F.coalesce(F.trim("value_edu.institution"), F.lit("")) != ""))
    y = F.struct(F.col("value_edu.institution").alias("institution"), F.col("value_edu.degree").alias("degree"), F.col("value_edu.field").alias("field"), F.col("value_edu.end_year").try_cast("int").alias("end_year"))
    edu = edu.withColumn("x", y).withColumn("key", F.concat_ws("|", F.lower("x.institution"), F.coalesce(F.lower("x.degree"), F.lit("None"))))

    def first(df: DataFrame, name: str, kind: str) -> DataFrame:
        one = df.groupBy("cluster_id", "key").agg(F.min_by(F.struct("at", "x", "source", "method"), "at").alias("f"))
        g = one.groupBy("cluster_id").agg(F.array_sort(F.collect_list("f"), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)).alias("l"))
        prov = F.transform("l", lambda f: F.struct(F.lit(name).alias("field"), f["source"].alias("source"), f["method"].alias("method")))
        return g.select("cluster_id", F.transform("l", lambda f: f["x"]).cast(kind).alias(name), prov.cast(PROV).alias(f"{name}_prov"))

    return first(exp, "experience", EXP), first(edu, "education", EDU)


def merge(resolved: DataFrame, as_of: int) -> Merged:
    """Golden records of resolved claims (``cluster_id`` and ``member`` beside the columns of a claim). ``as_of`` is the month number of "today"."""
    c = cut(normalized(resolved))
    base = c.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("__claims"))
    s = cut(merge_scalar(c.filter(F.col("field").isin(*SCALARS, *LINKS)), ["cluster_id", "field"]))
    wide = s.groupBy("cluster_id").agg(*[F.max(F.when(F.col("field") == f, F.struct("value", "source", "method", "confidence", "has_conflict"))).alias(f.replace(".", "_")) for f in (*SCALARS, *LINKS)])
    lists = merge_list(c.filter(F.col("field").isin("emails", "phones")), ["cluster_id", "field"])
    wide_lists = lists.groupBy("cluster_id").agg(*[F.max(F.when(F.col("field") == f, F.struct("values", "prov", "confidence"))).alias(f) for f in ("emails", "phones")])
    skills = merge_skills(c.filter(F.col("field") == "skills"), ["cluster_id"]).select("cluster_id", F.struct("skills", "prov", "confidence").alias("sk"))
    other = c.filter(F.col("field") == "links.other").groupBy("cluster_id").agg(F.array_sort(F.collect_set("norm")).alias("links_other"))
    exp, edu = _histories(c)
    j = base
    for part in (wide, wide_lists, skills, other, exp, edu):
        # a merge, as all parts lie by cluster already; estimates of lists are too low for a broadcast
        j = j.join(part.hint("merge"), "cluster_id", "left")
    none = F.lit(None)
    empty = F.array().cast("array<string>")
    given_years = F.col("years_experience.value").try_cast("double")
    derived = years_of(F.coalesce("experience", F.array().cast(EXP)), as_of)
    is_derived = given_years.isNull() & derived.isNotNull()

    def p(f: str) -> Column:
        col = f.replace(".", "_")
        return F.when(F.col(col).isNotNull(), F.array(F.struct(F.lit(f).alias("field"), F.col(f"{col}.source").alias("source"), F.col(f"{col}.method").alias("method")))).otherwise(F.array()).cast(PROV)

    def lp(f: str) -> Column:
        return F.coalesce(F.transform(f"{f}.prov", lambda x: F.struct(F.lit(f).alias("field"), x["source"].alias("source"), x["method"].alias("method"))), F.array()).cast(PROV)

    def fc(name: str, confidence: Column, conflict: Column | None = None, when: Column | None = None) -> Column:
        one = F.struct(F.lit(name).alias("field"), confidence.cast("double").alias("confidence"), (F.lit(False) if conflict is None else conflict).alias("has_conflict"))
        return F.when(confidence.isNotNull() if when is None else when, one)

    years_prov = F.when(is_derived, F.array(F.struct(F.lit("years_experience").alias("field"), F.lit("derived").alias("source"), F.lit("computed_from_experience_dates").alias("method")))).otherwise(p("years_experience")).cast(PROV)
    prov = F.concat(p("full_name"), lp("emails"), lp("phones"), p("location.city"), p("location.region"), p("location.country"), *[p(f) for f in LINKS], p("headline"), F.coalesce("sk.prov", F.array()).cast(PROV), F.coalesce("experience_prov", F.array().cast(PROV)), F.coalesce("education_prov", F.array().cast(PROV)), years_prov)
    scalar_fc = lambda f: fc(f, F.col(f"{f.replace('.', '_')}.confidence"), F.col(f"{f.replace('.', '_')}.has_conflict"))
    confs = F.filter(
        F.array(
            scalar_fc("full_name"), fc("emails", F.col("emails.confidence")), fc("phones", F.col("phones.confidence")), scalar_fc("location.city"), scalar_fc("location.region"), scalar_fc("location.country"), scalar_fc("headline"), fc("skills", F.col("sk.confidence")),
            fc("experience", F.lit(HISTORY), when=F.col("experience").isNotNull()), fc("education", F.lit(HISTORY), when=F.col("education").isNotNull()),
            F.when(is_derived, F.struct(F.lit("years_experience").alias("field"), F.lit(DERIVED).cast("double").alias("confidence"), F.lit(False).alias("has_conflict"))).otherwise(scalar_fc("years_experience")),
        ),
        lambda x: x.isNotNull(),
    )
    v = lambda f: F.col(f"{f.replace('.', '_')}.value")
    golden = j.select(
        "cluster_id", candidate_id(F.get(F.col("emails.values"), F.lit(0)), v("full_name"), v("current_company")).alias("candidate_id"), v("full_name").alias("full_name"), F.coalesce("emails.values", empty).alias("emails"), F.coalesce("phones.values", empty).alias("phones"),
        F.struct(v("location.city").alias("city"), v("location.region").alias("region"), v("location.country").alias("country")).alias("location"),
        F.struct(v("links.linkedin").alias("linkedin"), v("links.github").alias("github"), v("links.portfolio").alias("portfolio"), F.coalesce("links_other", empty).alias("other")).alias("links"),
        F.coalesce(v("headline"), v("title")).alias("headline"), F.coalesce(given_years, derived).alias("years_experience"), F.coalesce("sk.skills", F.array().cast("array<struct<name:string,confidence:double,sources:array<string>>>")).alias("skills"),
        F.coalesce("experience", F.array().cast(EXP)).alias("experience"), F.coalesce("education", F.array().cast(EDU)).alias("education"), prov.alias("provenance"), overall_confidence(F.transform(confs, lambda x: x["confidence"])).alias("overall_confidence"), confs.alias("field_confidences"),
    )
    golden = cut(golden)
    conflicts = s.filter("has_conflict").select("cluster_id", "field", "sources", F.col("source").alias("chosen"))
    rejections = c.filter(F.col("field").isin("emails", "phones") & F.col("norm").isNull() & (F.coalesce(F.trim("value_text"), F.lit("")) != "")).select("cluster_id", "field", F.col("value_text").alias("value"), F.lit("normalization_failed").alias("reason"), "source")
    missing = F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in ("full_name", "headline", "years_experience")], *[F.when(F.size(f) == 0, F.lit(f)) for f in ("emails", "phones", "skills")])
    nulls = golden.select("cluster_id", F.explode(F.filter(missing, lambda x: x.isNotNull())).alias("field"))
    return Merged(golden, conflicts, rejections, nulls)
