"""Locations in free text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from rollweave.functions.normalize import iso_countries
from rollweave.functions.tables import COUNTRY_ALIASES, NO_LOCATIONS, US_STATES

_LABEL = re.compile(r"^\s*(?:location|based\s+in|current\s+location|address)\s*:\s*", re.I)
_NOT_PLACE = re.compile(r"@|\b(?:github|linkedin|portfolio|https?|www)\b", re.I)
_STREET = re.compile(r"\b(?:door|flat|house|plot|no\.?|street|line|colony|road|rd\.?)\b", re.I)
_STATES = {**US_STATES, **{c.lower(): c for c in US_STATES.values()}}


class Places:
    """Reads locations with a table of countries (lower-case name or code -> alpha-2)."""

    def __init__(self, countries: dict[str, str]):
        self.countries = {**countries, **dict(list(COUNTRY_ALIASES.items())[:12])}

    def country(self, text: str) -> str | None:
        return self.countries.get(text.strip().strip(".").lower())

    @staticmethod
    def state(text: str) -> str | None:
        return _STATES.get(text.strip().strip(".").lower())

    @staticmethod
    def is_place(text: str) -> bool:
        return len(text) > 1 and not re.search(r"\d", text) and not _NOT_PLACE.search(text) and re.search(r"[A-Za-z]", text) is not None

    def read(self, raw: str | None) -> tuple[str | None, str | None, str | None] | None:
        """City, region and country of a text, null if it isn't clearly a location."""
        text = re.sub(r"\s+", " ", re.sub(r"\([^)]*\)", " ", _LABEL.sub("", (raw or "").strip()))).strip(" -.,")
        if not text or text.lower() in NO_LOCATIONS or _NOT_PLACE.search(text):
            return None
        parts = [p for p in (x.strip(" -") for x in text.split(",")) if p]
        if len(parts) > 2 and (land := self.country(parts[-1])):
            address = len(parts) > 3 or _STREET.search(text)
            city, region = (parts[-2], None) if address else (parts[0], parts[1])
            if region and land == "US":
                region = self.state(region) or region
            return (city, region, land) if self.is_place(city) else None
        if len(parts) == 2:
            city, rest = parts
            if not self.is_place(city):
                return None
            if code := self.state(rest):
                return city, code, "US"
            land = self.country(rest)
            return (city, None, land) if land else (city, rest, None)
        words = text.split(" ")
        if len(words) > 1 and re.fullmatch(r"[A-Z]{2}", words[-1]) and (code := self.state(words[-1])):
            return " ".join(words[:-1]), code, "US"
        for k in range(1, len(words)):  # the longest country name that ends the text
            tail = " ".join(words[k:])
            if re.fullmatch(r"[A-Za-z][A-Za-z .]{1,30}", tail) and (land := self.country(tail)) and self.is_place(" ".join(words[:k])):
                return " ".join(words[:k]), None, land
        return None


def parse_location(x: Column, spark: SparkSession) -> Column:
    """``struct<city, region, country>``, with null fields if the text isn't clearly a location."""
    table = dict(iso_countries(spark))

    @F.pandas_udf("city string, region string, country string")
    def run(texts: pd.Series) -> pd.DataFrame:
        places = Places(table)
        return pd.DataFrame([places.read(t) or (None, None, None) if isinstance(t, str) else (None, None, None) for t in texts], columns=["city", "region", "country"])

    return run(x)


def location_segments(line: Column) -> Column:
    """Pieces of a contact line between bars, semicolons, slashes, dots and wide gaps."""
    parts = F.split(F.regexp_replace(F.trim(line), r"\s{2,}", " | "), r"\s*[|;/•·]\s*")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^[ -]+|[ -]+$", "")), lambda p: p != "")
