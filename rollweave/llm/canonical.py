"""Mapping typed values to the entries of a reference list, by a symmetric-delete dictionary.

The dictionary holds, for every entry and every other name of one, all strings that up to ``k`` deletions leave of it; a typed
value within ``k`` edits shares such a string with its entry. Hits are ranked by a weighted Damerau-Levenshtein distance (slips of
neighbouring keys, swapped and doubled letters are cheap), then by how often the entry itself is typed. The dictionary is
broadcast; its size is bounded by the reference list and checked. Values are looked up where they stand, with a memo per batch:
no value is shuffled, so none can be hot.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import comb

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollweave.llm.vocabulary import LEVELS, MODES
from rollweave.session import cut

#: Most rows of the reference lists and of the table of other names.
MOST_ENTRIES = 200_000

#: Most strings in the dictionary that is sent to every task; they take some 250 bytes each in a worker.
MOST_STRINGS = 1_000_000

#: Rows of the keyboard, for slips to a neighbouring key (fixed values).
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_AT = {c: (r, i + 0.5 * r) for r, row in enumerate(_ROWS) for i, c in enumerate(row)}


def fold(text: str) -> str:
    """Lower case, one blank between words, none around."""
    return " ".join(unicodedata.normalize("NFC", text).lower().split())


def compact(text: str) -> str:
    """Letters, digits and the signs that tell names apart, without accents."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return "".join(c for c in plain if c.isalnum() or c in "+#")


def reach(length: int) -> int:
    """Edits allowed for a value of this length: none below 6 characters, one below 14, else two."""
    return 0 if length < 6 else 1 if length < 14 else 2


def deletes(text: str, k: int) -> set[str]:
    """All strings that at most ``k`` deletions leave of ``text``."""
    out, last = {text}, {text}
    for _ in range(k):
        last = {s[:i] + s[i + 1 :] for s in last for i in range(len(s))}
        out |= last
    return out


def _near(a: str, b: str) -> bool:
    pa, pb = _AT.get(a), _AT.get(b)
    return pa is not None and pb is not None and abs(pa[0] - pb[0]) <= 1 and abs(pa[1] - pb[1]) <= 1.1


def weighted_distance(a: str, b: str) -> tuple[int, float]:
    """Damerau-Levenshtein distance (neighbouring swaps) as a count of edits and as a weight."""
    prev2: list[tuple[int, float]] = []
    prev = [(j, float(j)) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [(i, float(i))]
        for j, y in enumerate(b, 1):
            if x == y:
                best = prev[j - 1]
            else:
                sub = 0.7 if _near(x, y) else 1.0
                drop = 0.8 if i > 1 and a[i - 2] == x else 1.0
                put = 0.8 if j > 1 and b[j - 2] == y else 1.0
                best = min(
                    (prev[j - 1][0] + 1, prev[j - 1][1] + sub),
                    (prev[j][0] + 1, prev[j][1] + drop),
                    (row[j - 1][0] + 1, row[j - 1][1] + put),
                )
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    best = min(best, (prev2[j - 2][0] + 1, prev2[j - 2][1] + 0.75))
            row.append(best)
        prev2, prev = prev, row
    return prev[-1]


#: What may follow a title: a bracket, a part after a comma, a part after a dash or an at sign.
_LAST = re.compile(r"(?:\s*[(\[][^()\[\]]*[)\]]|\s*,(?:(?!\s[-–—@|]\s)[^,()\[\]])*|\s+[-–—@|]\s.*)\s*$")


def title_forms(folded: str) -> list[str]:
    """A title as typed, then without what follows it, one part after the other, each also without words for level and working mode."""

    def bare(t: str) -> str:
        words = t.split()
        while len(words) > 1 and words[0].strip(".,") in LEVELS:
            words = words[1:]
        while len(words) > 1 and words[-1].strip(".,") in (*LEVELS, *MODES) and words[-1].strip(".,") != "lead":
            words = words[:-1]
        return " ".join(words)

    forms, t = [], folded
    while t:
        forms += [t, bare(t)]
        shorter = _LAST.sub("", t)
        t = shorter if shorter != t else ""
    return [f for f in dict.fromkeys(forms) if f]


class Matcher:
    """Look-up in one reference list. ``entries``: (id, value); ``others``: value -> other names; ``counts``: id -> times typed exactly."""

    def __init__(self, entries: Iterable[tuple[int, str]], others: dict[str, tuple[str, ...]] | None = None, titles: bool = False):
        self.titles = titles
        self.exact: dict[str, int] = {}
        self.tight: dict[str, int] = {}
        self.near: dict[str, list[tuple[str, int]]] = {}
        self.counts: dict[int, int] = {}
        names: list[tuple[str, int]] = []
        entries = sorted(entries)
        for first in (True, False):
            for i, value in entries:
                for name in (value,) if first else (others or {}).get(value, ()):
                    f = fold(name)
                    if f and self.exact.setdefault(f, i) == i:
                        names.append((f, i))
                    self.tight.setdefault(compact(name), i)
        names = list(dict.fromkeys(names))
        most = sum(comb(len(f), j) for f, _ in names for j in range(reach(len(f)) + 1))
        if most > MOST_STRINGS:
            raise ValueError(f"the dictionary may have {most} strings, more than {MOST_STRINGS}")
        for f, i in names:
            for d in deletes(f, reach(len(f))):
                self.near.setdefault(d, []).append((f, i))
        self.size = most
        self.find = lru_cache(maxsize=100_000)(self._find)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "find"}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.find = lru_cache(maxsize=100_000)(self._find)

    def _find(self, value: str) -> int:
        folded = fold(value)
        forms = title_forms(folded) if self.titles else [folded]
        for f in forms:
            if f in self.exact:
                return self.exact[f]
        for f in forms:
            hit = self.tight.get(compact(f))
            if hit is not None and compact(f):
                return hit
        best: tuple[float, int, int] | None = None
        for f in forms:
            k = reach(len(f))
            if not k:
                continue
            seen = {n for d in deletes(f, k) for n in self.near.get(d, ())}
            for name, i in seen:
                edits, weight = weighted_distance(f, name)
                if edits <= min(k, reach(len(name))):
                    best = min(best or (9e9, 0, 0), (weight, -self.counts.get(i, 0), i))
        return best[2] if best else 0


def matchers(entries: DataFrame, aliases: DataFrame, titles: tuple[str, ...] = (), most_entries: int = MOST_ENTRIES) -> dict[str, Matcher]:
    """A matcher for each list of ``entries`` (``list_name``, ``item_id``, ``canonical_value``), with other names of its entries from ``aliases``.

    ``aliases`` has ``list_name``, ``canonical_value`` and ``other_name``; case and blanks of the canonical value don't matter, earlier
    ``place`` counts first. Lists named in ``titles`` are read as job titles. Both tables may have at most ``most_entries`` rows.
    """
    rows = entries.select("list_name", "item_id", "canonical_value").limit(most_entries + 1).collect()
    more = aliases.select("list_name", "canonical_value", "other_name", "place").limit(most_entries + 1).collect()
    if max(len(rows), len(more)) > most_entries:
        raise ValueError("the reference lists are too long")
    others: dict[tuple[str, str], list[str]] = {}
    for r in sorted(more, key=lambda r: (r["list_name"], r["place"])):
        others.setdefault((r["list_name"], fold(r["canonical_value"])), []).append(r["other_name"])
    out = {}
    for name in sorted({r["list_name"] for r in rows}):
        own = [(r["item_id"], r["canonical_value"]) for r in rows if r["list_name"] == name and r["canonical_value"]]
        out[name] = Matcher(own, {v: tuple(others.get((name, fold(v)), ())) for _, v in own}, titles=name in titles)
    return out


def exact_counts(values: DataFrame, list_col: str, value_col: str, count_col: str, matchers: dict[str, Matcher]) -> None:
    """Count how often each entry is typed as it is, over all ``values``, and give the counts to the matchers.

    Grouped before the join, so at most one row per name of the dictionaries reaches the driver.
    """
    spark: SparkSession = values.sparkSession
    names = spark.createDataFrame([(n, f, i) for n, m in matchers.items() for f, i in m.exact.items()], "list string, name string, item bigint")
    typed = values.select(F.col(list_col).alias("list"), F.lower(F.trim(F.regexp_replace(F.col(value_col), r"\s+", " "))).alias("name"), F.col(count_col).alias("n"))
    got = typed.join(F.broadcast(names), ["list", "name"]).groupBy("list", "item").agg(F.sum("n").alias("n")).collect()
    for r in got:
        matchers[r["list"]].counts[r["item"]] = r["n"]


def match_values(values: DataFrame, list_col: str, value_col: str, matchers: dict[str, Matcher]) -> DataFrame:
    """``values`` with ``item_id``, the entry that the value means in its list; 0 if there is none, or the value is null, or the list unknown.

    ``values`` should be cheap to read again. Values are counted, which leaves one row for each distinct one before the shuffle, then looked
    up and joined back; a value that a third of all rows hold is a heavy key of that join alone, which adaptive execution splits.
    """
    distinct = cut(values.filter(F.col(value_col).isNotNull()).groupBy(list_col, value_col).agg(F.count(F.lit(1)).alias("__n")))
    exact_counts(distinct, list_col, value_col, "__n", matchers)
    # looking up is the dearest step and its input is small: spread over all tasks
    spread = distinct.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = cut(spread.select(list_col, value_col, match_column(values.sparkSession, F.col(list_col), F.col(value_col), matchers).alias("item_id")))
    return values.join(found, [list_col, value_col], "left").withColumn("item_id", F.coalesce("item_id", F.lit(0).cast("bigint")))


def match_column(spark: SparkSession, list_col: Column, value_col: Column, matchers: dict[str, Matcher]) -> Column:
    """Entry id of a value in the list named by ``list_col``; 0 if there is none, or the value is null, or the list unknown."""
    size = sum(m.size for m in matchers.values())
    if size > MOST_STRINGS:
        raise ValueError(f"the dictionary has {size} strings, more than {MOST_STRINGS}")
    shared = spark.sparkContext.broadcast(matchers)

    @F.pandas_udf("bigint")
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        held = shared.value
        for names, values in batches:
            yield pd.Series([held[n].find(v) if v is not None and n in held else 0 for n, v in zip(names.to_numpy(), values.to_numpy(), strict=True)], dtype="int64")

    return find(list_col, value_col)
