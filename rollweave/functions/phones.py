"""Phone numbers in E.164, from a numbering table of 55 countries; numbers of other countries are rejected."""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Plan(NamedTuple):
    code: str  # country code
    trunk: str  # prefix of national numbers
    valid: str  # pattern of a national number without prefix
    groups: tuple[tuple[str, tuple[int, ...]], ...]  # pattern -> lengths of the digit groups as written nationally, prefix included


#: Numbering plans, as published by the countries' authorities.
PLANS: dict[str, Plan] = {
    "US": Plan("1", "1", r"[2-9]\d{2}[2-9]\d{6}", ((r".*", (3, 3, 4)),)),
    "GB": Plan("44", "0", r"(?:7[1-57-9]\d{8}|20[378]\d{7}|1\d{8,9}|11[3-8]\d{7}|3\d{9}|8\d{9})", ((r"7", (5, 6)), (r"20", (3, 4, 4)), (r"1", (5, 6)))),
    "IN": Plan("91", "0", r"(?:[6-9]\d{9}|(?:11|2[02]|33|4[04]|79|80)[2-7]\d{7})", ((r"[6-9]\d{9}$", (6, 5)), (r"(?:11|2[02]|33|4[04])", (3, 4, 4)))),
    "AU": Plan("61", "0", r"(?:4\d{8}|[2378]\d{8})", ((r"4", (4, 3, 3)), (r"[2378]", (2, 4, 4)))),
    "DE": Plan("49", "0", r"(?:1[5-7]\d{8,9}|[2-9]\d{6,10})", ((r"1", (4, 7)),)),
    "FR": Plan("33", "0", r"[1-79]\d{8}", ((r".*", (2, 2, 2, 2, 2)),)),
    "SG": Plan("65", "", r"[3689]\d{7}", ((r".*", (4, 4)),)),
}
PLANS["CA"] = PLANS["US"]

#: Further plans, by lengths and first digits (code, trunk prefix, national number). Local numbers written in groups of digits are read only without a region to choose.
_MORE: dict[str, tuple[str, str, str]] = {
    "NL": ("31", "0", r"[1-9]\d{8}"), "BE": ("32", "0", r"[1-9]\d{7,8}"), "ES": ("34", "", r"[6-9]\d{8}"), "IT": ("39", "", r"(?:3\d{8,9}|0\d{5,10})"), "PT": ("351", "", r"[239]\d{8}"), "CH": ("41", "0", r"[2-9]\d{8}"), "AT": ("43", "0", r"[1-9]\d{6,12}"),
    "SE": ("46", "0", r"[1-9]\d{6,9}"), "NO": ("47", "", r"[2-9]\d{7}"), "DK": ("45", "", r"[2-9]\d{7}"), "FI": ("358", "0", r"[1-9]\d{5,10}"), "PL": ("48", "", r"[1-9]\d{8}"), "CZ": ("420", "", r"[2-79]\d{8}"), "IE": ("353", "0", r"[1-9]\d{6,9}"),
    "GR": ("30", "", r"[26]\d{9}"), "HU": ("36", "06", r"[1-9]\d{7,8}"), "RO": ("40", "0", r"[237]\d{8}"), "UA": ("380", "0", r"[3-9]\d{8}"), "RU": ("7", "8", r"[3489]\d{9}"), "TR": ("90", "0", r"[2-58]\d{9}"), "IL": ("972", "0", r"[2-9]\d{7,8}"),
    "AE": ("971", "0", r"[2-9]\d{7,8}"), "SA": ("966", "0", r"[15]\d{8}"), "EG": ("20", "0", r"(?:1[0125]\d{8}|[2-9]\d{7,8})"), "ZA": ("27", "0", r"[1-8]\d{8}"), "NG": ("234", "0", r"(?:[7-9]\d{9}|[1-9]\d{6,7})"), "KE": ("254", "0", r"(?:[17]\d{8}|[2-6]\d{6,8})"),
    "PK": ("92", "0", r"(?:3\d{9}|[2-9]\d{8,9})"), "BD": ("880", "0", r"(?:1[3-9]\d{8}|[2-9]\d{5,9})"), "LK": ("94", "0", r"[1-9]\d{8}"), "JP": ("81", "0", r"[1-9]\d{8,9}"), "KR": ("82", "0", r"[1-9]\d{7,9}"), "CN": ("86", "0", r"(?:1[3-9]\d{9}|[2-9]\d{8,10})"),
    "HK": ("852", "", r"[2-9]\d{7}"), "TW": ("886", "0", r"[2-9]\d{7,8}"), "PH": ("63", "0", r"(?:9\d{9}|[2-8]\d{7,9})"), "MY": ("60", "0", r"[1-9]\d{7,9}"), "ID": ("62", "0", r"[2-9]\d{7,11}"), "TH": ("66", "0", r"[2-9]\d{7,8}"), "VN": ("84", "0", r"[2-9]\d{8,9}"),
    "NZ": ("64", "0", r"[2-9]\d{7,9}"), "BR": ("55", "0", r"[1-9]{2}(?:9\d{8}|[2-5]\d{7})"), "MX": ("52", "", r"[2-9]\d{9}"), "AR": ("54", "0", r"9?[1-3]\d{9}"), "CL": ("56", "", r"[2-9]\d{8}"), "CO": ("57", "", r"(?:3\d{9}|60\d{8})"), "PE": ("51", "0", r"(?:9\d{8}|[1-8]\d{7})"),
}
PLANS |= {region: Plan(code, trunk, valid, ()) for region, (code, trunk, valid) in _MORE.items()}


def _national(raw: str, region: str) -> str | None:
    """Valid national number of a text in a region."""
    plan = PLANS.get(region)
    if not plan:
        return None
    body = re.split(r"(?i)\s*(?:ext\.?|x|#)\s*\d{1,6}\s*$", raw.strip())[0]
    if not re.fullmatch(r"[\d\s().\-/+]*(?:\d[\s().\-/]*){5,}", re.sub(r"(?i)^tel:\s*", "", body)):
        return None
    digits = re.sub(r"\D", "", body)
    if "+" in body:
        if not digits.startswith(plan.code):
            return None
        digits = digits[len(plan.code) :]
    tries = [digits, digits[len(plan.trunk) :] if plan.trunk and digits.startswith(plan.trunk) else ""]
    return next((d for d in tries if d and re.fullmatch(plan.valid, d)), None)


def normalize(raw: str | None, region: str = "US") -> str | None:
    """E.164 of a number; a number with ``+`` is read by its own country code."""
    if not raw or not raw.strip():
        return None
    if raw.strip().startswith("+"):
        return international(raw)
    n = _national(raw, region)
    return f"+{PLANS[region].code}{n}" if n else None


def international(raw: str) -> str | None:
    if not raw.strip().startswith("+"):
        return None
    for region, plan in PLANS.items():
        n = _national(raw, region)
        if n:
            return f"+{plan.code}{n}"
    return None


def _grouping_fits(raw: str, region: str, national: str) -> bool:
    got = [len(g) for g in re.findall(r"\d+", raw)]
    if len(got) <= 1:
        return True
    plan = PLANS[region]
    for pattern, groups in plan.groups:
        if re.match(pattern, national):
            return got == list(groups)
    return False


def with_candidates(raw: str | None, regions: list[str], fallback: str = "US") -> tuple[str | None, str | None]:
    """E.164 and the region it was read in: international first (no region), then the regions whose digit grouping fits, then ``fallback``."""
    if not raw or not raw.strip():
        return None, None
    direct = international(raw)
    if direct:
        return direct, None
    for region in dict.fromkeys([*(r.strip().upper() for r in regions if r and r.strip()), fallback]):
        n = _national(raw, region)
        if n and _grouping_fits(raw, region, n):
            return f"+{PLANS[region].code}{n}", region
    return None, None


def norm_phone(x: Column, region: str = "US") -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([normalize(t, region) if isinstance(t, str) else None for t in texts], dtype=object)

    return run(x)


def norm_phone_in(x: Column, regions: Column, fallback: str = "US") -> Column:
    """``struct<value, region>`` of a number given an array of regions."""

    @F.pandas_udf("value string, region string")
    def run(texts: pd.Series, tries: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([with_candidates(t if isinstance(t, str) else None, list(r) if r is not None else [], fallback) for t, r in zip(texts, tries, strict=True)], columns=["value", "region"])

    return run(x, regions)


def norm_phone_list(x: Column, region: str = "US") -> Column:
    """Each number of an array, null where it isn't one."""

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        return pd.Series([[normalize(t, region) if isinstance(t, str) else None for t in ts] if ts is not None else None for ts in lists], dtype=object)

    return run(x)
