"""Public profiles by user name. What fetches them is a parameter; tests and offline runs replay saved answers."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollweave.functions import tables
from rollweave.functions.claims import EDUCATION, EXPERIENCE, claim, empty_claims, shred
from rollweave.functions.normalize import iso_countries, username
from rollweave.functions.places import Places
from rollweave.functions.text_fields import best_page, first_place, found, known_terms, readme_headline, readme_places, readme_text
from rollweave.session import cut
from rollweave.sources.answers import answer_lists, ask, clean_text
from rollweave.sources.files import exists, log

Fetch = Callable[[str], Any]

_CLAIMS = f"array<struct<field:string,value_text:string,value_exp:{EXPERIENCE},value_edu:{EDUCATION},method:string,raw_confidence:double,src:string>>"


def http_fetch(path: str) -> Any:
    """JSON of a path of the public REST interface, or the text of a whole address; null for anything but success."""
    import json
    import urllib.request

    try:
        with urllib.request.urlopen(path if path.startswith("https://") else f"https://api.github.com{path}", timeout=10) as r:
            return r.read().decode("utf-8", "replace") if path.startswith("https://") else json.load(r)
    except (OSError, ValueError):
        return None


def _languages(user: str, fetch: Fetch, page_size: int = 100) -> list[str]:
    """Languages of all repositories of a user that aren't copies of others', sorted; page by page until one isn't full."""
    out: set[str] = set()
    page = 1
    while True:
        repos = fetch(f"/users/{user}/repos?per_page={page_size}" + (f"&page={page}" if page > 1 else ""))
        if not isinstance(repos, list):
            return sorted(out)
        out |= {r["language"] for r in repos if isinstance(r, dict) and r.get("language") and not r.get("fork")}
        if len(repos) < page_size:
            return sorted(out)
        page += 1


def _readme(user: str, fetch: Fetch) -> str | None:
    """Text of a user's profile README: what the answer holds in base64, else what its download address gives."""
    readme = fetch(f"/repos/{user}/{user}/readme")
    if not isinstance(readme, dict):
        return None
    if readme.get("encoding") == "base64" and readme.get("content"):
        return base64.b64decode(readme["content"]).decode("utf-8", "replace")
    text = fetch(readme["download_url"]) if readme.get("download_url") else None
    return text if isinstance(text, str) else None


def profile_claims(user: str, fetch: Fetch, places: Places) -> tuple[str, list[tuple[str, str, str, float]], str | None]:
    """Key, (field, value, method, confidence) of a user's profile and repositories, and the text of the README."""
    me = fetch(f"/users/{user}")
    if not isinstance(me, dict):
        return user, [], None
    out = [(f, me[k], "api_field", 0.9) for k, f in (("name", "full_name"), ("email", "emails"), ("bio", "headline")) if me.get(k)]
    if me.get("location"):
        place = places.read(me["location"])
        out += [(f"location.{p}", v, "api_location_parse", 0.78) for p, v in zip(("city", "region", "country"), place) if v] if place else [("location.city", me["location"], "api_field", 0.7)]
    out += [(f, me[k], "api_field", 0.9) for k, f in (("blog", "links.portfolio"), ("html_url", "links.github")) if me.get(k)]
    if me.get("company"):
        out.append(("current_company", str(me["company"]).lstrip("@"), "api_field", 0.7))
    out += [("skills", x, "repo_language_analysis", 0.9) for x in _languages(user, fetch)]
    return str(me.get("email") or me.get("name") or me.get("login") or user).lower(), out, _readme(user, fetch)


def readme_lists(readmes: DataFrame, source: str = "github_readme_regex") -> tuple[DataFrame, list[Column]]:
    """``readmes`` (``u``, ``text``) and the arrays of claims of what each README says."""
    how = ("github_readme_regex", 0.72)
    d = readmes.withColumn("__t", readme_text(F.col("text")))
    t = F.col("__t")
    d = d.withColumn("__place", first_place(readme_places(t), readmes.sparkSession))
    one = lambda field, value, h=how: F.array(claim(field, value, *h, source=source))
    many = lambda field, values: F.transform(values, lambda x: claim(field, x, *how, source=source))
    lists = [one("links.github", F.concat(F.lit("https://github.com/"), F.col("u")), ("readme_identity", 0.72)), many("emails", F.array_distinct(F.transform(found(t, tables.EMAIL_IN), lambda m: F.lower(m))))]
    lists += [many("links.linkedin", F.array_distinct(found(t, tables.LINKEDIN_IN))), one("links.portfolio", best_page(t)), one("headline", readme_headline(t, F.col("u")))]
    lists += [F.array(*[claim(f"location.{p}", F.col(f"__place.{p}"), "readme_location_parse", 0.72, source=source) for p in ("city", "region", "country")]), many("skills", known_terms(t, tables.README_SKILLS))]
    return d, lists


def user_claims(users: DataFrame, column: str, fetch: Fetch, model: Callable[[str], str] | None = None) -> DataFrame:
    """Claims of the users in ``column``; a user who can't be fetched gives none and a warning. Each user is asked for once.

    With ``model`` (prompt -> answer), READMEs are also read by a language model.
    """
    table = dict(iso_countries(users.sparkSession))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = Places(table)
        for b in batches:
            out = []
            for row, u in zip(b["row"], b["u"], strict=True):
                try:
                    key, told, readme = profile_claims(u, fetch, places)
                    out.append((row, u, key, [{"field": f, "value": str(v), "method": m, "confidence": c} for f, v, m, c in told], readme))
                except Exception as e:  # noqa: BLE001 a single user must not stop the source
                    log.warning("user %s: %s", u, e)
            yield pd.DataFrame(out, columns=["row", "u", "key", "told", "text"])

    src = users.select(F.monotonically_increasing_id().alias("row"), username(F.col(column)).alias("u")).filter(F.col("u").isNotNull()).groupBy("u").agg(F.min("row").alias("row"))
    # what was fetched is kept, so that nobody is asked twice
    raw = cut(src.mapInPandas(read, "row bigint, u string, key string, told array<struct<field:string,value:string,method:string,confidence:double>>, text string"))
    same = claim("x", F.lit(""), "x", 0.0)
    told = F.transform("told", lambda x: same.withField("field", x["field"]).withField("value_text", F.trim(x["value"])).withField("method", x["method"]).withField("raw_confidence", x["confidence"]))
    d, lists = readme_lists(raw)
    given = F.col("text").isNotNull()
    lists = [told, *[F.when(given, x).otherwise(F.slice(x, 1, 0)) for x in lists]]
    by_user = lambda d, lists: shred(d, F.col("key"), F.col("row"), lists, "github_api", F.create_map(F.lit("username"), "u"))
    out = by_user(d, lists)
    if model is None:
        return out
    nowhere = F.struct(*[F.lit(None).cast("string").alias(p) for p in ("city", "region", "country")])
    sure = ("github_readme_llm", 0.58)
    asked, _, more = answer_lists(ask(raw.filter(given), ["row", "u", "key"], "text", model), nowhere, sure, "github_readme_llm")
    own = F.when(clean_text(F.col("__v"), "$.links.github").isNull(), F.array(claim("links.github", F.concat(F.lit("https://github.com/"), F.col("u")), "readme_identity", 0.58, source="github_readme_llm"))).otherwise(F.array())
    # after the claims by pattern, so "first" stays what it is without a model
    place = lambda c: c.withField("field", c["field"] + 1000)
    return out.unionByName(by_user(asked, [*more, own.cast(_CLAIMS)]).withColumn("ord", place(F.col("ord"))))


class ProfileSource:
    """A text file with a user or link per line; blank lines and lines that begin with ``#`` are skipped."""

    def __init__(self, fetch: Fetch = http_fetch, model: Callable[[str], str] | None = None):
        self.fetch, self.model = fetch, model

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        if not exists(spark, path):
            return empty_claims(spark)
        lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.trim("value").startswith("#"))
        return user_claims(lines, "value", self.fetch, self.model)
