"""Month arithmetic on text dates. A month is an integer, ``year * 12 + month - 1``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mean "still going on" (fixed values).
PRESENT_WORDS = ("present", "current", "now", "ongoing", "today", "till date", "to date", "till now")

#: First three letters of the English month names, in order (fixed values).
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def month_index(text: Column) -> Column:
    """Month number of a text date, null if it isn't one.

    Reads ``YYYY``, ``YYYY-MM``, ``YYYY-MM-DD``, ``MM/YYYY`` and ``Month YYYY`` with blanks around; a bare year is its January,
    a day is ignored, a month outside 1..12 makes the text unreadable.
    """
    t = F.lower(F.trim(text))
    iso = F.regexp_extract(t, r"^(\d{4})[-/.](\d{1,2})(?:[-/.]\d{1,2})?$", 1)
    slash = F.regexp_extract(t, r"^(\d{1,2})[-/.](\d{4})$", 2)
    named = F.regexp_extract(t, r"^([a-z]{3})[a-z]*\.?,? +(\d{4})$", 1)
    mon = (
        F.when(iso != "", F.regexp_extract(t, r"^(\d{4})[-/.](\d{1,2})", 2).cast("int"))
        .when(slash != "", F.regexp_extract(t, r"^(\d{1,2})[-/.]", 1).cast("int"))
        .when(named != "", F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), named).cast("int"), F.lit(0)))
        .when(t.rlike(r"^\d{4}$"), F.lit(1))
    )
    year = F.nullif(F.regexp_extract(t, r"(\d{4})", 1), F.lit("")).cast("int")
    return F.when(mon.between(1, 12), year * 12 + mon - 1)


def is_open_end(text: Column) -> Column:
    """True for a null or blank end and for a word for the present."""
    return text.isNull() | F.lower(F.trim(text)).isin("", *PRESENT_WORDS)


def month_text(month: Column) -> Column:
    """``YYYY-MM`` of a month number."""
    year = F.floor(month / 12).cast("int")
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad((month - year * 12 + 1).cast("string"), 2, "0"))
