"""What lines of free text say about a person, as column expressions over texts and arrays of lines."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from rollweave.functions import tables as T
from rollweave.functions.normalize import clean_line, iso_countries, norm_text, norm_url, strip_markdown, title_case
from rollweave.functions.places import Places, location_segments

NONE = "array<string>"


def none() -> Column:
    return F.array().cast(NONE)


def found(x: Column, pattern: str) -> Column:
    """All matches of a pattern in a text; none for null."""
    return F.coalesce(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), none())


def first_of(items: Column, keep: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(items, keep), F.lit(0))


def distinct_fold(items: Column) -> Column:
    """Items whose lower case hasn't come before, in order."""
    low = F.transform(items, lambda u: F.lower(u))
    return F.filter(items, lambda u, i: F.array_position(low, F.lower(u)) == i + 1)


def has_contact(line: Column) -> Column:
    return line.rlike(T.EMAIL_IN) | line.rlike(T.PHONE_IN) | line.rlike(T.LINKEDIN_IN) | line.rlike(T.GITHUB_IN) | line.rlike(T.LINK_IN)


def heading(line: Column) -> Column:
    """Section that a line opens, null for any other line."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in T.HEADINGS.items():
        out = out.when(line.rlike(pattern), name)
    return out


def emails_in(text: Column) -> Column:
    return F.array_distinct(found(text, T.EMAIL_IN))


def phones_in(lines: Column) -> Column:
    """Numbers of ten digits or with a plus, from lines without links and document numbers."""
    able = F.filter(lines, lambda x: ~F.lower(x).rlike("http://|https://|doi|document/|ieee"))
    raw = F.transform(F.flatten(F.transform(able, lambda x: found(x, T.PHONE_IN))), lambda p: F.trim(p))
    return F.filter(raw, lambda p: p.startswith("+") | (F.length(F.regexp_replace(p, r"\D", "")) >= 10))


def profile_links(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.filter(F.transform(found(text, pattern), norm_url), lambda u: u != ""))


def portfolio_links(text: Column, taken: Column) -> Column:
    """The first three links that aren't taken, degrees, version numbers, libraries or contest sites."""
    not_pages = "|".join([r"^$", r"^\d", rf"^(?:{'|'.join(map(re.escape, T.LIBRARIES))})$", r"^[bm]\.tech(?:/|$)", *map(re.escape, T.SKIPPED_HOSTS)])
    low = F.transform(taken, lambda u: F.lower(u))
    urls = F.filter(F.transform(found(text, T.LINK_IN), norm_url), lambda u: ~F.lower(u).rlike(not_pages) & ~u.rlike(T.DEGREE_HOST) & ~F.array_contains(low, F.lower(u)))
    return F.slice(distinct_fold(urls), 1, 3)


def known_terms(text: Column, terms: Iterable[str]) -> Column:
    """The terms that stand in a text as words of their own, in the order of ``terms``."""
    low = F.lower(text)
    each = [F.when(low.rlike(r"(?<![a-z0-9.+#-])" + re.escape(t.lower()).replace(r"\ ", " ") + r"(?![a-z0-9.+#-])"), F.lit(t)) for t in terms]
    return F.filter(F.array(*each), lambda t: t.isNotNull())


def listed_skills(line: Column) -> Column:
    """Values of a line ``kind: a, b`` that can be skills: short, few words, no phrases of work."""
    after = F.regexp_extract(line, r"^[^:]*:(.*)$", 1)
    parts = F.transform(F.split(after, r"[,;|]|\band\b"), lambda s: F.regexp_replace(clean_line(s), r"^[-–—·•. ]+|[-–—·•. ]+$", ""))
    return F.filter(parts, lambda s: F.length(s).between(2, 44) & (F.size(F.split(s, r"\s+")) <= 5) & ~F.lower(s).isin(*T.NO_SKILLS) & ~s.rlike(T.WORK_WORDS))


def repair_spacing(x: Column) -> Column:
    """Blanks collapsed, put where words were joined, and set right around punctuation; null for a blank."""
    t = F.trim(F.regexp_replace(x, r"\s+", " "))
    t = F.regexp_replace(t, r"(?<=[a-z])(?=[A-Z][a-z]|(?:AI|API|REST|React|Expo)\b)", " ")
    words = F.array(*[F.lit(w) for w in T.JOINED_WORDS])
    parted = F.aggregate(words, t, lambda acc, w: F.regexp_replace(acc, F.concat(F.lit("(?i)(?<=[a-z]{4})(?="), w, F.lit("(?:[a-z]|-|$))")), F.lit(" ")))
    pairs = F.array(*[F.struct(F.lit(f"(?i){re.escape(a)}").alias("a"), F.lit(b).alias("b")) for a, b in T.JOINED_TEXTS.items()])
    parted = F.aggregate(pairs, parted, lambda acc, p: F.regexp_replace(acc, p["a"], p["b"]))
    t = F.when(t.rlike("[A-Za-z]{12}"), parted).otherwise(t)  # only long runs of letters can be joined words
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)\bReact based\b", "React-based"), r"(?i)\bAI driven\b", "AI-driven")
    t = F.regexp_replace(F.regexp_replace(t, r"([,;:])(?=[A-Za-z])", "$1 "), r"\s+([,.;:])", "$1")
    return F.nullif(F.trim(F.regexp_replace(t, r"\s+", " ")), F.lit(""))


def person_name(lines: Column) -> Column:
    """Letter-spaced capitals at the top, else the first of eight lines that may be a name."""
    top = F.transform(F.slice(lines, 1, 8), clean_line)
    spaced = F.transform(F.slice(top, 1, 4), lambda x: x.rlike(r"^\p{Lu}(?: \p{Lu}){2,}$"))
    run = F.coalesce(F.nullif(F.array_position(spaced, False), F.lit(0)) - 1, F.size(spaced)).cast("int")
    letters = F.transform(F.slice(top, 1, run), lambda x: F.replace(x, F.lit(" ")))
    plain = first_of(top, lambda x: (x != "") & ~x.rlike(r"(?U)\d") & ~x.rlike(T.EMAIL_IN) & ~x.rlike(T.LINK_IN) & (F.size(F.split(x, " ")) <= 5) & ~x.rlike(T.HEADINGS["summary"]))
    return F.when(run > 0, title_case(F.array_join(letters, " "))).otherwise(plain)


def contact_lines(lines: Column) -> tuple[Column, Column]:
    """Lines about contact (the first five, and those of the first twelve with a contact, up to a heading) and all other lines."""
    zone = F.transform(F.slice(lines, 1, 12), lambda x, i: (i > 0) & (F.coalesce(heading(x), F.lit("contact")) != "contact"))
    end = F.coalesce(F.nullif(F.array_position(zone, True), F.lit(0)) - 1, F.lit(12))
    mine = lambda x, i: (i < end) & ((i < 5) | has_contact(x))
    return F.filter(lines, mine), F.filter(lines, lambda x, i: ~mine(x, i))


def place_candidates(lines: Column) -> Column:
    """Texts among the first twelve lines that may be a location, in order: parts of contact lines and of early lines with a comma, lines with a label."""

    def of(x: Column, i: Column) -> Column:
        rest = x
        for p in (T.EMAIL_IN, T.PHONE_IN, T.LINK_IN, r"\(cid:\d+\)"):
            rest = F.regexp_replace(rest, p, " ")
        rest = F.regexp_replace(F.regexp_replace(rest, r"\s+", " "), r"^[ |-]+|[ |-]+$", "")
        parts = F.concat(location_segments(x), F.filter(F.array(rest), lambda s: s != ""))
        return F.when(has_contact(x) | (i < 5) & x.contains(","), parts).when(x.rlike(T.PLACE_LABEL), F.array(x)).otherwise(none())

    return F.flatten(F.transform(F.slice(lines, 1, 12), of))


def first_place(candidates: Column, spark: SparkSession) -> Column:
    """``struct<city, region, country>`` of the first of the texts that is a location, with null fields if none is."""
    table = dict(iso_countries(spark))

    @F.pandas_udf("city string, region string, country string")
    def run(lists: pd.Series) -> pd.DataFrame:
        places = Places(table)
        return pd.DataFrame([next((p for p in map(places.read, texts if texts is not None else ()) if p), (None, None, None)) for texts in lists], columns=["city", "region", "country"])

    return run(candidates)


def best_page(text: Column) -> Column:
    """The likeliest personal page in a README: hosting for pages counts most, then words such as portfolio; blogs and docs count least; then the shorter, then the first."""
    urls = F.transform(found(text, T.README_LINK_IN), lambda u: F.regexp_replace(F.trim(u), r"[).,;]+$", ""))
    others = "|".join(map(re.escape, ("github.com", "linkedin.com", "shields.io", "github-readme-stats")))
    # without a scheme, a host of one label, of one letter first, or a library's name isn't a page
    bare = rf"^(?!https?://|www\.)(?:[^./]*(?:/|$)|[^./]?\.|(?:{'|'.join(map(re.escape, (*T.LIBRARIES, 'three.js')))})(?:/|$))"
    pages = F.filter(urls, lambda u: ~F.lower(u).rlike(others) & ~F.lower(u).rlike(bare))
    points = lambda u, value, words: F.when(F.lower(u).rlike("|".join(map(re.escape, words))), value).otherwise(0)
    scored = F.transform(distinct_fold(pages), lambda u, i: F.struct((points(u, 20, T.PAGE_HOSTS) + points(u, 10, T.PAGE_WORDS) - points(u, 10, T.OTHER_PAGES)).alias("score"), (-F.length(u)).alias("short"), (-i).alias("early"), u.alias("url")))
    return F.array_max(scored)["url"]


def readme_text(raw: Column) -> Column:
    return norm_text(strip_markdown(raw))


def readme_headline(text: Column, user: Column) -> Column:
    """First line of 20 to 220 characters that neither greets nor names the user."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[ #*`-]+|[ #*`-]+$", ""))
    return first_of(lines, lambda x: F.length(x).between(20, 220) & ~F.lower(x).contains(F.lower(user)) & ~F.lower(x).rlike("^(?:hi |hello |welcome )"))


def readme_places(text: Column) -> Column:
    """Lines with a label of a location among the first thirty."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[ #*`-]+|[ #*`-]+$", ""))
    return F.filter(F.slice(lines, 1, 30), lambda x: x.rlike(r"(?i)\b(?:location|based\s+in|current\s+location)\b"))
