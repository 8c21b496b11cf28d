"""JSON documents of applicants, whatever their keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollweave.functions.claims import claim, empty_claims, shred, split_list
from rollweave.functions.normalize import blank_to_null
from rollweave.functions.places import parse_location
from rollweave.sources.files import exists

CONFIDENCE = 0.95

#: Keys of one record in the order in which they give claims, and their fields; lists are split (fixed values).
KEYS: tuple[tuple[str, str], ...] = (
    ("applicant_name", "full_name"), ("contact_email", "emails"), ("contact_phone", "phones"), ("current_employer", "current_company"), ("job_title", "title"), ("location_city", "location.city"), ("location_state", "location.region"),
    ("location_country", "location.country"), ("skills_list", "skills"), ("years_of_experience", "years_experience"), ("name", "full_name"), ("full_name", "full_name"), ("candidate_name", "full_name"), ("email", "emails"),
    ("email_address", "emails"), ("primary_email", "emails"), ("phone", "phones"), ("phone_number", "phones"), ("mobile", "phones"), ("company", "current_company"), ("employer", "current_company"), ("current_company", "current_company"),
    ("title", "title"), ("role", "title"), ("position", "title"), ("city", "location.city"), ("state", "location.region"), ("region", "location.region"), ("country", "location.country"), ("skills", "skills"), ("skillset", "skills"),
    ("tech_stack", "skills"), ("experience_years", "years_experience"), ("yoe", "years_experience"),
)

#: Fields of nested records: the first path with a value counts (fixed values).
PATHS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("full_name", ("profile.name", "personal.name", "candidate.name")),
    ("emails", ("contact.email", "contact.emails", "profile.email")),
    ("phones", ("contact.phone", "contact.phones", "profile.phone")),
    ("location.city", ("location.city", "address.city")),
    ("location.region", ("location.state", "location.region", "address.state")),
    ("location.country", ("location.country", "address.country")),
)

#: Where the records of a document may lie, keys of schooling and of work and the names of their parts (fixed values).
RECORDS = ("applicants", "candidates", "records", "data")
SCHOOLING = ("education", "educations", "schools")
WORK = ("work_history", "experience", "experiences", "jobs")
SCHOOL_PARTS = {"institution": ("school", "institution", "university"), "degree": ("degree_type", "degree"), "field": ("major", "field", "field_of_study"), "end_year": ("graduation_year", "end_year", "year")}
WORK_PARTS = {"company": ("employer", "company", "organization"), "title": ("role", "title", "position"), "start": ("start_date", "start"), "end": ("end_date", "end"), "summary": ("summary", "description")}


#: Parts of the nested objects that ``PATHS`` name.
_NESTED: dict[str, list[str]] = {}
for _, _paths in PATHS:
    for _p in _paths:
        _NESTED.setdefault(_p.split(".")[0], [])
        if _p.split(".")[1] not in _NESTED[_p.split(".")[0]]:
            _NESTED[_p.split(".")[0]].append(_p.split(".")[1])
_NO_TEXTS = "array<string>"


def _record(payload: Column) -> Column:
    """All keys that count, as texts, in one parse: arrays and objects are given as JSON."""
    names = dict.fromkeys([k for k, _ in KEYS] + list(_NESTED) + list(SCHOOLING) + list(WORK))
    return F.from_json(payload, ", ".join(f"`{n}` string" for n in names))


def _texts(raw: Column, split: bool) -> Column:
    """Values in a text as ``_record`` gives it: the items of an array, the parts of a list, else the text itself; blanks stay out."""
    one = blank_to_null(raw)
    single = split_list(one) if split else F.array(one)
    items = F.when(one.startswith("["), F.coalesce(F.from_json(one, _NO_TEXTS), single)).otherwise(single)
    return F.filter(F.coalesce(F.when(one.isNotNull(), items), F.array().cast(_NO_TEXTS)), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")


def _items(raw: list[Column], parts: dict[str, tuple[str, ...]]) -> Column:
    """Records under the first of the keys that holds any, with their parts; an object counts as a list of one."""
    names = dict.fromkeys(n for ns in parts.values() for n in ns)
    kind = "array<struct<" + ",".join(f"`{n}`:string" for n in names) + ">>"
    lists = [F.when(r.rlike(r"^\s*[\[{]"), F.from_json(r, kind)) for r in raw]
    found = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], F.array().cast(kind))
    return F.transform(F.filter(found, lambda x: x.isNotNull()), lambda x: F.struct(*[F.coalesce(*[blank_to_null(x[n]) for n in ns]).alias(p) for p, ns in parts.items()]))


def _copy(field: str) -> Callable[[Column], Column]:
    return lambda s: claim(field, s, "direct_copy", CONFIDENCE)


def json_claims(df: DataFrame, payload: str, row: Column | None = None) -> DataFrame:
    """Claims of JSON objects, one a row. A payload that isn't one, and a record without a name and an address, gives none; unknown keys are ignored. A text that is a JSON array counts as one."""
    spark = df.sparkSession
    work = df.withColumn("__at", F.monotonically_increasing_id() if row is None else row)
    # the generator keeps the parse in one place; as a plain column it would be inlined into every use of a key
    work = work.withColumn("__r", F.explode(F.array(_record(F.col(payload)))))
    raw = lambda k: F.col(f"__r.`{k}`")
    place = F.coalesce(*[F.when(~raw(k).rlike(r"^\s*[\[{]"), blank_to_null(raw(k))) for k in ("location", "address")])
    work = work.withColumn("__place", parse_location(place, spark))
    for k, parts in _NESTED.items():
        work = work.withColumn(f"__n_{k}", F.when(raw(k).startswith("{"), F.from_json(raw(k), ", ".join(f"`{p}` string" for p in parts))))
    nested = lambda p: F.col(f"__n_{p.split('.')[0]}.`{p.split('.')[1]}`")
    # texts of every key and path, again in one place
    every = dict.fromkeys([k for k, _ in KEYS] + [p for _, paths in PATHS for p in paths])
    split = {k for k, f in KEYS if f == "skills"}
    texts = F.struct(*[_texts(nested(k) if "." in k else raw(k), k in split).alias(k.replace(".", "_of_")) for k in every])
    work = work.withColumn("__t", F.explode(F.array(texts)))
    at = lambda k: F.col(f"__t.`{k.replace('.', '_of_')}`")
    first = lambda keys: F.coalesce(*[F.get(at(k), F.lit(0)) for k in keys])
    mail = first(("contact_email", "email", "email_address", "primary_email", "contact.email", "contact.emails", "profile.email"))
    name = first(("applicant_name", "name", "full_name", "candidate_name", "profile.name", "personal.name", "candidate.name"))
    lists = [F.transform(at(k), _copy(f)) for k, f in KEYS]
    for f, paths in PATHS:
        found = F.coalesce(*[F.when(F.size(at(p)) > 0, at(p)) for p in paths], F.array().cast(_NO_TEXTS))
        lists.append(F.transform(found, _copy(f)))
    lists.append(F.array(*[claim(f"location.{p}", F.col(f"__place.{p}"), "location_parse", CONFIDENCE) for p in ("city", "region", "country")]))
    schools = F.filter(_items([raw(k) for k in SCHOOLING], SCHOOL_PARTS), lambda e: e["institution"].isNotNull())
    lists.append(F.transform(schools, lambda e: claim("education", None, "direct_copy", CONFIDENCE, edu=e)))
    jobs = F.filter(_items([raw(k) for k in WORK], WORK_PARTS), lambda e: e["company"].isNotNull() | e["title"].isNotNull())
    lists.append(F.transform(jobs, lambda e: claim("experience", None, "direct_copy", CONFIDENCE, exp=e)))
    return shred(work, F.lower(F.trim(F.coalesce(mail, name))), F.col("__at"), lists, "ats_json")


def records(spark: SparkSession, path: str) -> DataFrame:
    """``payload`` of each record of JSON documents: a list, or an object with the list under one of ``RECORDS``. Broken documents give none."""
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    kind = F.schema_of_variant("v")
    lists = F.coalesce(F.when(kind.startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")), *[F.try_variant_get("v", f"$.{k}", "array<variant>") for k in RECORDS])
    return whole.select(F.explode(lists).alias("r")).select(F.to_json("r").alias("payload"))


class AtsSource:
    def read(self, spark: SparkSession, path: str) -> DataFrame:
        return json_claims(records(spark, path), "payload") if exists(spark, path) else empty_claims(spark)
