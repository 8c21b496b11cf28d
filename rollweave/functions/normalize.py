"""Normalizers as column expressions; everything stays in generated code but phones and locations."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from rollweave.functions.tables import COUNTRY_ALIASES, MONTH_NAMES, SKILL_NAMES

EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"


def _map(table: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def blank_to_null(x: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.regexp_replace(x, r"^\s+|\s+$", ""), F.lit(""))


def norm_email(x: Column) -> Column:
    """Trimmed, lower-case address; null if it isn't one."""
    t = F.lower(F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.when(t.rlike(f"^{EMAIL}$"), t)


def title_case(x: Column) -> Column:
    """Upper case after anything but a letter, lower case after a letter: ``o'neil mcDONALD`` gives ``O'Neil Mcdonald``."""
    parts = F.regexp_extract_all(x, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 2**30)))), "")


def norm_name(x: Column) -> Column:
    """Blanks collapsed, title case; null for a blank."""
    return title_case(blank_to_null(F.regexp_replace(x, r"\s+", " ")))


def norm_date(x: Column) -> Column:
    """``struct<value, tag>``: ``YYYY-MM`` and ``exact``, ``year_only_approximated``, ``present`` or ``unparseable``; the month's range isn't checked."""
    t = F.regexp_replace(x, r"^\s+|\s+$", "")
    iso, slash, named = r"^(\d{4})-(\d{1,2})(?:-\d{1,2})?$", r"^(\d{1,2})/(\d{4})$", r"^([A-Za-z]+)\s+(\d{4})$"
    month = F.try_element_at(_map(MONTH_NAMES), F.lower(F.regexp_extract(t, named, 1)))
    two = lambda c: F.lpad(c, 2, "0")
    exact = (
        F.when(t.rlike(iso), F.concat(F.regexp_extract(t, iso, 1), F.lit("-"), two(F.regexp_extract(t, iso, 2))))
        .when(t.rlike(slash), F.concat(F.regexp_extract(t, slash, 2), F.lit("-"), two(F.regexp_extract(t, slash, 1))))
        .when(t.rlike(named), F.concat(F.regexp_extract(t, named, 2), F.lit("-"), month))
    )
    present = t.isNull() | F.lower(t).isin("", "present", "current", "now", "ongoing")
    year = t.rlike(r"^\d{4}$")
    tag = F.when(present, "present").when(exact.isNotNull(), "exact").when(year, "year_only_approximated").otherwise("unparseable")
    return F.struct(F.when(~present, F.coalesce(exact, F.when(year, F.concat(t, F.lit("-01"))))).alias("value"), tag.alias("tag"))


def norm_skill(x: Column) -> Column:
    """``struct<name, verified>``: the canonical skill, else the text in title case; a blank stays as it is."""
    key = F.lower(F.regexp_replace(x, r"^\s+|\s+$", ""))
    known = F.try_element_at(_map(SKILL_NAMES), key)
    return F.struct(F.coalesce(known, F.when(key == "", x).otherwise(title_case(F.regexp_replace(x, r"^\s+|\s+$", "")))).alias("name"), known.isNotNull().alias("verified"))


_COUNTRIES: dict[str, dict[str, str]] = {}


def iso_countries(spark: SparkSession) -> dict[str, str]:
    """Lower-case alpha-2 and alpha-3 codes and English names -> alpha-2, as the Java runtime knows ISO 3166."""
    if "all" not in _COUNTRIES:
        locale, out = spark._jvm.java.util.Locale, {}
        for code in locale.getISOCountries():
            here = locale("", code)
            out |= {code.lower(): code, here.getISO3Country().lower(): code, here.getDisplayCountry(locale.ENGLISH).lower(): code}
        _COUNTRIES["all"] = out
    return _COUNTRIES["all"]


def norm_country(x: Column, spark: SparkSession, strict: bool = False) -> Column:
    """Alpha-2 code of a country as typed, null if it can't be told.

    By default any two letters pass in upper case, as the record model has it; then codes of three letters, other names, English
    names and, last, a name that holds the text. ``strict`` checks two letters as well and doesn't look for names that hold the text.
    """
    table, others = iso_countries(spark), COUNTRY_ALIASES if not strict else dict(list(COUNTRY_ALIASES.items())[:12])
    names = sorted((n, c) for n, c in table.items() if len(n) > 3)

    @F.pandas_udf("string")
    def look(texts: pd.Series) -> pd.Series:
        memo: dict[str, str | None] = {}

        def one(t: str) -> str | None:
            t = t.strip().strip(".") if strict else t.strip()
            low = t.lower()
            if not low:
                return None
            if strict:
                return others.get(low) or table.get(low)
            if len(low) == 2:
                return t.upper()
            hit = (table.get(low) if len(low) == 3 else None) or others.get(low) or table.get(low)
            return hit or next((c for n, c in names if len(low) > 3 and low in n), None)

        for t in texts.dropna().unique():
            memo[t] = one(t)
        return texts.map(memo, na_action="ignore").astype(object).where(texts.notna(), None)

    return look(x)


def norm_url(x: Column) -> Column:
    """A link without brackets, closing punctuation, scheme, ``www.`` and the last slash."""
    t = F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"^[()\[\]{}<>]+|[()\[\]{}<>]+$", "")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[).,;]+$", ""), r"(?i)^https?://", ""), r"(?i)^www\.", "")
    return F.regexp_replace(t, r"/+$", "")


def github_login(x: Column) -> Column:
    """Lower-case login of a profile link or a bare login; null for other hosts and impossible logins."""
    t = F.regexp_replace(F.regexp_replace(F.trim(x), r"(?i)^https?://", ""), r"(?i)^www\.", "")
    path = F.when(F.lower(t).startswith("github.com/"), F.regexp_replace(t, r"^[^/]*/", "")).when(~t.rlike(r"[/.]"), t)
    login = F.lower(F.regexp_extract(F.regexp_replace(path, r"^/+", ""), r"^([^/?#]*)", 1))
    return F.when(login.rlike(r"^[a-z0-9](?:[a-z0-9-]{0,37}[a-z0-9])?$"), login)


def username(x: Column) -> Column:
    """Login in a list of users: without byte-order mark, scheme, host, path and query; its case stays."""
    t = F.regexp_replace(F.trim(F.regexp_replace(x, "^﻿", "")), r"(?i)^https?://(www\.)?|^www\.", "")
    t = F.regexp_replace(t, r"(?i)^github\.com/", "")
    return F.nullif(F.regexp_extract(t, r"^([^/?#\s]*)", 1), F.lit(""))


def strip_markdown(x: Column) -> Column:
    """Text without images, link targets, tags and code marks."""
    t = F.regexp_replace(x, r"!\[[^\]]*\]\([^)]+\)", " ")
    t = F.regexp_replace(t, r"\[([^\]]+)\]\([^)]+\)", "$1")
    return F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", " "), r"`{1,3}([^`]*)`{1,3}", "$1")


def norm_text(x: Column) -> Column:
    """One kind of line end, four common misread signs put right, words joined over line ends, blanks collapsed."""
    t = F.regexp_replace(x, r"\r\n?", "\n")
    for wrong, right in (("â€“", "–"), ("â€”", "—"), ("Â·", "·"), ("â€¢", "•")):
        t = F.replace(t, F.lit(wrong), F.lit(right))
    return F.regexp_replace(F.regexp_replace(t, r"(?U)(?<=\w)-\s*\n\s*(?=\w)", ""), r"[ \t]+", " ")


def clean_line(x: Column) -> Column:
    """A line without its bullet, blanks collapsed."""
    t = F.regexp_replace(F.trim(x), r"^\s*[-*•·▪▫‣◦]+\s*", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def token_sorted(x: Column) -> Column:
    """Words of a text in order, joined by one blank."""
    return F.array_join(F.array_sort(F.filter(F.split(x, r"\s+"), lambda w: w != "")), " ")


#: Normalizers that a configuration may name.
REGISTRY = {"email": norm_email, "name": norm_name, "url": norm_url, "text": norm_text, "canonical": lambda x: norm_skill(x)["name"]}
