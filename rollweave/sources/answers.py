"""Answers of a language model as claims: the JSON object in each answer, cleaned field by field."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollweave.functions.claims import claim
from rollweave.functions.normalize import iso_countries, norm_date, norm_email, norm_name, norm_skill
from rollweave.functions.phones import norm_phone_list
from rollweave.functions.places import Places
from rollweave.functions.text_fields import repair_spacing
from rollweave.sources.files import log

PROMPT = "Read the document below and answer with one JSON object with the keys full_name, emails, phones, location (city, region, country), links (linkedin, github, portfolio), headline, skills, experience (company, title, start, end, summary) and education (institution, degree, field, end_year). Use null for what the document does not say.\n\n"


def ask(texts: DataFrame, keys: list[str], text: str, model: Callable[[str], str], prompt_chars: int | None = None) -> DataFrame:
    """``keys`` and ``answer`` of ``model`` (prompt -> answer) for each text; null for null and blank texts, and for a failing call, with a warning.

    ``prompt_chars`` cuts the text in the prompt where a model takes no more; by default the whole text goes in.
    """
    kinds = dict(texts.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers = []
            for t in b[text]:
                try:
                    answers.append(model(PROMPT + t[:prompt_chars]) if isinstance(t, str) and t.strip() else None)
                except Exception as e:  # noqa: BLE001 a single call must not stop the source
                    log.warning("no answer: %s", e)
                    answers.append(None)
            yield pd.DataFrame({**{k: b[k] for k in keys}, "answer": pd.Series(answers, dtype=object)})

    return texts.select(*keys, text).mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", answer string")


def parse_answer(answer: Column) -> Column:
    """The JSON object in an answer as a variant, whatever stands around it; null if there is none."""
    v = F.try_parse_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def clean_text(v: Column, path: str = "$") -> Column:
    """Text at a path of a variant, spacing repaired; null for a blank."""
    return repair_spacing(F.try_variant_get(v, path, "string"))


def _items(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _texts(v: Column, path: str) -> Column:
    return F.filter(F.transform(_items(v, path), lambda x: F.try_variant_get(x, "$", "string")), lambda t: t.isNotNull())


def clean_emails(v: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(_texts(v, "$.emails"), norm_email), lambda m: m.isNotNull()))


def clean_phones(v: Column) -> Column:
    return F.array_distinct(F.filter(norm_phone_list(_texts(v, "$.phones")), lambda p: p.isNotNull()))


def clean_skills(v: Column) -> Column:
    """Parts of the skills after a label, between commas and semicolons, by their canonical names."""
    said = F.filter(F.transform(_texts(v, "$.skills"), repair_spacing), lambda s: s.isNotNull())
    parts = F.flatten(F.transform(said, lambda s: F.split(F.regexp_replace(s, r"^[^:]*:", ""), "[,;]")))
    return F.array_distinct(F.transform(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""), lambda p: norm_skill(p)["name"]))


def clean_experience(v: Column) -> Column:
    one = lambda x: F.struct(
        F.coalesce(clean_text(x, "$.company"), F.lit("")).alias("company"), F.coalesce(clean_text(x, "$.title"), F.lit("")).alias("title"),
        norm_date(F.try_variant_get(x, "$.start", "string"))["value"].alias("start"), norm_date(F.try_variant_get(x, "$.end", "string"))["value"].alias("end"), clean_text(x, "$.summary").alias("summary"),
    )
    objects = F.filter(_items(v, "$.experience"), lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    return F.filter(F.transform(objects, one), lambda e: (e["company"] != "") | (e["title"] != ""))


def clean_education(v: Column) -> Column:
    year = lambda x: F.nullif(F.regexp_extract(F.try_variant_get(x, "$.end_year", "string"), r"\d{4}", 0), F.lit(""))
    one = lambda x: F.struct(clean_text(x, "$.institution").alias("institution"), clean_text(x, "$.degree").alias("degree"), clean_text(x, "$.field").alias("field"), year(x).alias("end_year"))
    objects = F.filter(_items(v, "$.education"), lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    return F.filter(F.transform(objects, one), lambda e: e["institution"].isNotNull())


Place = tuple[str | None, str | None, str | None]
_SAYS_US = re.compile(r"\b(?:united states|usa|u\.s\.a\.|u\.s\.|us)\b")


def agreed_place(said: str | dict | None, seen: Place | None, places: Places) -> Place | None:
    """Location an answer gives, checked against the one the text itself shows (``seen``).

    Models guess the US: where the text shows another country and the answer doesn't name the US, the text is right. A country in place of
    a region is moved; an answer without a location gives the text's.
    """
    abroad = seen if seen and seen[2] and seen[2] != "US" else None
    if isinstance(said, str):
        place, words = places.read(said), said
    elif isinstance(said, dict):
        part = lambda *names: next((str(said[n]).strip() for n in names if said.get(n) and str(said[n]).strip()), None)
        words = part("raw", "text", "full", "address")
        place = places.read(words) if words else None
        if not place:
            words = json.dumps(said)
            city, region, land = part("city"), part("region", "state", "province"), part("country")
            land = places.country(land) if land else None
            if land == "US" and abroad:
                return abroad[0] or city, abroad[1], abroad[2]
            if region and not land and len(region) <= 3 and (meant := places.country(region)):
                region, land = None, meant
            elif city and land:
                city, region, land = places.read(", ".join(p for p in (city, region, land) if p)) or (city, region, land)
            place = (city, region, land) if city or region or land else None
    else:
        return seen
    if place and place[2] == "US" and abroad and not _SAYS_US.search((words or "").lower()):
        return abroad[0] or place[0], abroad[1], abroad[2]
    return place or seen


def clean_place(v: Column, seen: Column, spark: SparkSession) -> Column:
    """``struct<city, region, country>`` of an answer; ``seen`` is the struct that the text itself shows."""
    table = dict(iso_countries(spark))

    @F.pandas_udf("city string, region string, country string")
    def run(said: pd.Series, seen: pd.DataFrame) -> pd.DataFrame:
        places, out = Places(table), []
        for s, (c, r, k) in zip(said, seen.itertuples(index=False), strict=True):
            given = json.loads(s) if isinstance(s, str) else None
            out.append(agreed_place(given, (c, r, k) if c or r or k else None, places) or (None, None, None))
        return pd.DataFrame(out, columns=["city", "region", "country"])

    return run(F.to_json(F.try_variant_get(v, "$.location", "variant")), seen)


def answer_lists(answers: DataFrame, seen: Column, how: tuple[str, float], source: str | None = None) -> tuple[DataFrame, Column, list[Column]]:
    """``answers`` (with ``answer``) that hold an object, the key of each and the arrays of its claims in the order of delivery. Fields of a wrong kind are left out."""
    spark = answers.sparkSession
    d = answers.withColumn("__v", parse_answer(F.col("answer"))).filter("__v IS NOT NULL")
    v = F.col("__v")
    d = d.withColumn("__place", clean_place(v, seen, spark)).withColumn("__phones", clean_phones(v)).withColumn("__emails", clean_emails(v)).withColumn("__name", norm_name(clean_text(v, "$.full_name")))
    one = lambda field, value: F.array(claim(field, value, *how, source=source))
    many = lambda field, values: F.transform(values, lambda x: claim(field, x, *how, source=source))
    lists = [one("full_name", F.col("__name")), many("emails", F.col("__emails")), many("phones", F.col("__phones"))]
    lists += [one(f"location.{p}", F.col(f"__place.{p}")) for p in ("city", "region", "country")]
    lists += [one(f"links.{k}", clean_text(v, f"$.links.{k}")) for k in ("linkedin", "github", "portfolio")] + [one("headline", clean_text(v, "$.headline")), many("skills", clean_skills(v))]
    lists.append(F.transform(clean_experience(v), lambda e: claim("experience", None, *how, exp=e, source=source)))
    lists.append(F.transform(clean_education(v), lambda e: claim("education", None, *how, edu=e, source=source)))
    key = F.coalesce(F.get("__emails", F.lit(0)), F.get("__phones", F.lit(0)), F.lower(F.coalesce("__name", F.lit("unknown"))))
    return d, key, lists
