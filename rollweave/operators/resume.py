"""Résumés as claims: lines, sections that hold for what follows a heading, entries that dates open, neighbours of lines.

Everything is one plan: what the top lines and the whole text say is read where the document stands; its lines are then spread, and
all windows and the final aggregate share one exchange by document. Only locations are read in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollweave.functions import tables as T
from rollweave.functions.claims import claim
from rollweave.functions.normalize import clean_line, norm_text
from rollweave.functions.text_fields import contact_lines, emails_in, first_place, heading, known_terms, listed_skills, none, person_name, phones_in, place_candidates, portfolio_links, profile_links, repair_spacing
from rollweave.operators.lines import fill_sections, look_back, number_entries

BY_PATTERN, BY_PLACE, BY_SECTION, BY_TOP = ("regex_extract", 0.70), ("contact_location_parse", 0.62), ("section_parse", 0.65), ("first_line_heuristic", 0.65)
LINKS = ("linkedin", "github", "portfolio", "other")


def _bare(x: Column) -> Column:
    return F.regexp_replace(x, r"^[ \-–—,|]+|[ \-–—,|]+$", "")


def top_fields(docs: DataFrame) -> DataFrame:
    """``doc``, ``lines`` (trimmed, blanks dropped) and ``top``: name, addresses, numbers, links and place of each document (``doc``, ``text``)."""
    d = docs.select("doc", norm_text(F.col("text")).alias("text"))
    d = d.withColumn("lines", F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    mine, others = contact_lines(F.col("lines"))
    d = d.withColumn("head", F.array_join(mine, "\n")).withColumn("body", F.array_join(others, "\n"))
    d = d.withColumn("linkedin", profile_links(F.col("head"), T.LINKEDIN_IN)).withColumn("github", profile_links(F.col("head"), T.GITHUB_IN))
    d = d.withColumn("portfolio", portfolio_links(F.col("head"), F.concat("linkedin", "github")))
    rest = F.concat(profile_links(F.col("body"), T.LINKEDIN_IN), profile_links(F.col("body"), T.GITHUB_IN), portfolio_links(F.col("body"), none()))
    d = d.withColumn("other", F.array_except(rest, F.concat("linkedin", "github", "portfolio")))
    name = person_name(F.col("lines"))
    top = F.struct(F.when(~name.rlike(rf"^{T.EMAIL_IN}"), name).alias("name"), name.alias("top_name"), emails_in(F.col("text")).alias("emails"), phones_in(F.col("lines")).alias("phones"), *LINKS, first_place(place_candidates(F.col("lines")), docs.sparkSession).alias("place"))
    return d.select("doc", "lines", top.alias("top"))


def section_lines(tops: DataFrame) -> DataFrame:
    """``doc``, ``line_no``, ``line``, ``section`` of all lines but headings, and ``top`` on the first row of each document."""
    lines = tops.select("doc", "top", F.posexplode_outer("lines").alias("line_no", "raw")).select("doc", F.coalesce("line_no", F.lit(0)).alias("line_no"), clean_line(F.col("raw")).alias("line"), F.when(F.coalesce("line_no", F.lit(0)) == 0, F.col("top")).alias("top"))
    filled = fill_sections(lines.withColumn("opens", heading(F.col("line"))), "doc", F.col("opens"))
    return filled.withColumn("section", F.when(F.col("opens").isNull() & (F.col("line") != ""), F.col("section"))).drop("opens")


def entries(lines: DataFrame) -> DataFrame:
    """Lines with what they say as parts of their section: ``skills``, ``job`` (dates open one, its firm is on the next line), ``entry``, ``school``."""
    order = Window.partitionBy("doc", "section").orderBy("line_no")
    x = lines.withColumn("below", F.lead("line").over(order))
    dated = F.col("line").rlike(T.DATE_SPAN)
    x = number_entries(x, ["doc", "section"], ["line_no"], dated)
    firm = _bare(F.regexp_replace("below", r"(?i)\b(?:Remote|Hybrid|Onsite|On-site)\b", ""))
    job = F.struct(F.coalesce(firm, F.lit("")).alias("company"), _bare(F.substring("line", F.lit(1), F.regexp_instr("line", F.lit(T.DATE_SPAN)) - 1)).alias("title"), F.regexp_extract("line", T.DATE_SPAN, 1).alias("start"), F.regexp_extract("line", T.DATE_SPAN, 2).alias("end"))
    x = x.withColumn("job", F.when(dated & (F.col("section") == "experience"), job))
    # the line of a degree: years from it and the next, its school before the degree or on one of the two lines above
    no_school = r"(?i)\b(?:CGPA|GPA|Score|Completed|Currently)\b"
    x = look_back(x, ["doc", "section"], ["line_no"], F.when(~F.col("line").rlike(T.DEGREE) & ~F.col("line").rlike(no_school), F.col("line")), 2, "above")
    at = F.regexp_instr("line", F.lit(T.DEGREE))
    degree = F.regexp_extract("line", T.DEGREE, 1)
    before = F.regexp_replace(F.substring("line", F.lit(1), at - 1), r"^[ ,|-]+|[ ,|-]+$", "")
    school = F.when(F.size(F.split(before, r"\s+")) > 1, before).otherwise(F.coalesce("above", F.lit("")))
    near = F.concat_ws(" ", "line", "below")
    years = F.regexp_extract_all(near, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))
    rest = F.get(F.split(F.substring("line", at + F.length(degree), F.length("line")), r"(?i)\||CGPA|GPA|Score|Completed|Currently"), F.lit(0))
    subject = F.regexp_replace(F.regexp_replace(rest, r"\b(?:19|20)\d{2}\b", ""), r"\s*(?:-|–|—|\bto\b)\s*", " ")
    subject = F.regexp_replace(F.regexp_replace(subject, r"^[ ,.\-–—()]+|[ ,.\-–—()]+$", ""), r"(?i)^(?:in|of)\s+", "")
    learnt = F.struct(F.coalesce(F.nullif(school, F.lit("")), F.col("line")).alias("institution"), degree.alias("degree"), F.nullif(subject, F.lit("")).alias("field"), F.when(~near.rlike(r"(?i)\b(?:present|current|currently)\b"), F.array_max(years)).alias("end_year"))
    x = x.withColumn("school", F.when((F.col("section") == "education") & (degree != "") & ~F.col("line").rlike(r"(?i)^(?:completed|currently)\b"), learnt))
    known = known_terms(F.col("line"), T.RESUME_SKILLS)
    return x.withColumn("skills", F.when(F.col("section") == "skills", F.when(F.size(known) > 0, known).when(F.col("line").contains(":"), listed_skills(F.col("line"))).otherwise(none())))


def resume_fields(docs: DataFrame) -> DataFrame:
    """One row per document (``doc`` unique, ``text`` not blank): ``top`` and the lists ``skills``, ``jobs``, ``schools``, and ``summary``."""
    x = entries(section_lines(top_fields(docs)))
    within = lambda name, *cols: F.array_sort(F.collect_list(F.when(F.col("section") == name, F.struct("line_no", *cols))))
    g = x.groupBy("doc").agg(
        F.max("top").alias("top"), within("skills", "skills").alias("skill_lines"), within("experience", "entry", "line", "job").alias("job_lines"),
        F.array_sort(F.collect_list(F.when(F.col("school").isNotNull(), F.struct("line_no", "school")))).alias("school_lines"), within("summary", "line").alias("summary_lines"),
    )
    told = lambda e: F.filter("job_lines", lambda y: (y["entry"] == e["entry"]) & y["job"].isNull() & (y["line"] != e["job"]["company"]) & ~y["line"].endswith(" Remote"))
    summed = lambda e: F.nullif(F.array_join(F.transform(told(e), lambda y: y["line"]), " "), F.lit(""))
    jobs = F.transform(F.filter("job_lines", lambda e: e["job"].isNotNull()), lambda e: F.struct(e["job"]["company"].alias("company"), e["job"]["title"].alias("title"), e["job"]["start"].alias("start"), e["job"]["end"].alias("end"), repair_spacing(summed(e)).alias("summary")))
    names = F.transform("school_lines", lambda s: F.lower(s["school"]["institution"]))
    schools = F.transform(F.filter("school_lines", lambda s, i: F.array_position(names, F.lower(s["school"]["institution"])) == i + 1), lambda s: s["school"])
    skills = F.array_distinct(F.flatten(F.transform("skill_lines", lambda s: s["skills"])))
    summary = repair_spacing(F.array_join(F.transform("summary_lines", lambda s: s["line"]), " "))
    return g.select("doc", "top", skills.alias("skills"), jobs.alias("jobs"), schools.alias("schools"), summary.alias("summary"))


def resume_lists(fields: DataFrame) -> tuple[DataFrame, Column, list[Column]]:
    """``resume_fields``, the key of each document and the arrays of its claims in the order of delivery."""
    top = lambda c: F.col(f"top.{c}")
    many = lambda field, values, how: F.transform(values, lambda v: claim(field, v, *how))
    lists = [F.array(claim("full_name", top("name"), *BY_TOP)), many("emails", top("emails"), BY_PATTERN), many("phones", top("phones"), BY_PATTERN)]
    lists += [many(f"links.{k}", top(k), BY_PATTERN) for k in LINKS]
    lists.append(F.array(*[claim(f"location.{p}", top(f"place.{p}"), *BY_PLACE) for p in ("city", "region", "country")]))
    lists += [many("skills", F.col("skills"), BY_SECTION), F.transform("jobs", lambda j: claim("experience", None, *BY_SECTION, exp=j)), F.transform("schools", lambda s: claim("education", None, *BY_SECTION, edu=s))]
    lists.append(F.array(claim("headline", F.col("summary"), *BY_SECTION)))
    key = F.lower(F.coalesce(F.get(top("emails"), F.lit(0)), top("top_name"), F.lit("unknown")))
    return fields, key, lists
