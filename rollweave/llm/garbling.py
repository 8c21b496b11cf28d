"""Text garbled by a wrong character encoding: find it and restore it.

The units are the words of the corpus that hold a character outside ASCII, and the stretches of such characters within them. Every
distinct unit is garbled under every chain of wrong decoding (``garbled_forms``); the forms are hash-joined with the distinct units
of the corpus, which gives the dictionary of garbled units and their originals (``garbled_units``); the units of the documents are
hash-joined with that dictionary. A form counts only if it is told apart from clean text: its original must be at least as common.
Where both are equally common, the form must look odder than the original (``oddness``) or stand in a text with another unit garbled
by the same chain beyond doubt.

All counts are per distinct unit and distinct text (by a hash of it), so copies of a text count once, and a document repeated a million
times weighs on no single task: units are first collapsed within each batch of documents, then before the shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollweave.session import cut

#: Encodings in which UTF-8 bytes are read by mistake (fixed values).
MULTI = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "cp1253", "iso8859-7", "cp1254", "cp1257")
#: Encodings whose UTF-8 misreading is misread once more (fixed values).
TWICE = ("cp1252", "latin-1", "mac_roman", "cp437", "cp1250", "cp1251")
#: Pairs (written in, read as) of single-byte encodings (fixed values).
SINGLE = (
    ("cp1250", "cp1252"), ("iso8859-2", "cp1252"), ("iso8859-2", "latin-1"), ("cp1251", "cp1252"), ("cp1251", "latin-1"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"),
    ("koi8-r", "cp1252"), ("koi8-r", "latin-1"), ("cp866", "cp1251"), ("cp866", "cp1252"), ("cp1251", "cp866"), ("iso8859-5", "cp1251"), ("iso8859-5", "cp1252"), ("cp1253", "cp1252"), ("iso8859-7", "latin-1"), ("iso8859-7", "cp1252"), ("cp1253", "latin-1"),
    ("cp1254", "cp1252"), ("iso8859-9", "latin-1"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp437"), ("cp437", "cp1252"), ("cp1252", "cp850"), ("cp850", "cp1252"), ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("cp1252", "cp1253"), ("cp1252", "cp1254"), ("cp1250", "iso8859-2"),
)
#: Signs that may be garbled even where no clean text of the corpus holds them (fixed values).
SIGNS = ("﻿", " ", "’", "‘", "“", "”", "„", "–", "—", "…", "•", "€", "£", "§", "°", "·", "«", "»", "®", "©", "™", "½")

#: The replacement character.
LOST = "�"

_UNIT = re.compile(r"[0-9A-Za-z]*[^\x00-\x7f][0-9A-Za-z\u0080-\U0010ffff]*")
_STRETCH = re.compile(r"[^\x00-\x7f]+")
_LETTERS = re.compile(r"[^\W\d_]")


def _byte(b: int, codec: str) -> str:
    """A byte read in ``codec``; one without a meaning there becomes a control character, as browsers read it."""
    try:
        return bytes([b]).decode(codec)
    except UnicodeDecodeError:
        return chr(b)


_MAPS: dict[str, list[str]] = {}


def _table(codec: str) -> list[str]:
    if codec not in _MAPS:
        _MAPS[codec] = [_byte(b, codec) for b in range(256)]
    return _MAPS[codec]


def _read(data: bytes, codec: str) -> str:
    """``data`` read in ``codec``."""
    t = _table(codec)
    return "".join([t[b] for b in data])


def units(text: str) -> set[str]:
    """Distinct units of a text."""
    out = set()
    for w in _UNIT.findall(text):
        out.add(w)
        if not w[0] > "\x7f" or not w.isalpha() or w[-1] < "\x80":
            out.update(_STRETCH.findall(w))
    return out


def garbled_forms(word: str) -> dict[str, tuple[str, int]]:
    """Garbled form -> (chain, kind) of a clean unit. Kind 2: UTF-8 misread, 1: single bytes misread, 0: characters lost.

    Single-byte misreadings and losses are told only for words of three letters or more; shorter ones could be anything.
    """
    out: dict[str, tuple[str, int]] = {}
    try:
        data = word.encode("utf-8")
    except UnicodeEncodeError:
        return out
    once = {}
    for codec in MULTI:
        form = once[codec] = _read(data, codec)
        out.setdefault(form, (f"utf-8>{codec}", 2))
    for codec in TWICE:
        again = once[codec].encode("utf-8", "replace")
        for second in dict.fromkeys((codec, "cp1252")):
            out.setdefault(_read(again, second), (f"utf-8>{codec}>utf-8>{second}", 2))
    if len(word) >= 3 and len(_LETTERS.findall(word)) >= 3:
        for written, read in SINGLE:
            try:
                form = _read(word.encode(written), read)
            except UnicodeEncodeError:
                continue
            out.setdefault(form, (f"{written}>{read}", 1))
        out.setdefault("".join(c if c < "\x80" else LOST * len(c.encode()) for c in word), ("utf-8>lost", 0))
        out.setdefault("".join(c if c < "\x80" else LOST for c in word), ("one byte>lost", 0))
    out.pop(word, None)
    return out


def oddness(unit: str) -> int:
    """How unlike a word of any language a unit looks: signs outside ASCII, capitals after small letters, changes of script, runs of accented Latin letters."""
    odd, script, before = 0, "", ""
    for c in unit:
        if not c.isalpha():
            odd += c > "\x7f"
        else:
            now = "LATIN" if c < "\x80" else unicodedata.name(c, "?").partition(" ")[0]
            odd += script not in ("", now)
            odd += c.isupper() and before.islower()
            odd += now == "LATIN" and c > "\x7f" and before > "\x7f"
            script = now
        before = c
    return odd


def document_units(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``doc``, ``unit`` and ``body``, a hash of the text, for each distinct unit of each text; ASCII, empty and null texts have none."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, bodies = [], [], []
            for k, t, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if t and not t.isascii():
                    u = units(t)
                    ids += [k] * len(u)
                    found += u
                    bodies += [h] * len(u)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(found, pa.string()), pa.array(bodies, pa.int64())], ["doc", "unit", "body"])

    return docs.select(doc, text, F.xxhash64(text)).mapInArrow(scan, f"doc {dict(docs.dtypes)[doc]}, unit string, body bigint")


def garbled_units(doc_units: DataFrame) -> DataFrame:
    """The dictionary: ``unit``, ``original`` (null if it can't be told), ``chain``, ``kind``.

    One row per garbled unit of the corpus; the original is the most common one of all chains that lead to the unit, chains of
    UTF-8 first. Lost characters are restored only where one original alone fits.
    """
    spark = doc_units.sparkSession
    held = doc_units.select("unit", "body").distinct()
    known = cut(held.groupBy("unit").agg(F.count(F.lit(1)).alias("n")))
    signs = spark.createDataFrame([(s,) for s in SIGNS], "unit string").join(known, "unit", "left_anti").withColumn("n", F.lit(1).cast("bigint"))
    letters = known.select(F.explode(F.split("unit", "")).alias("c")).distinct()
    # characters of the whole corpus: at most the 1.1 million of Unicode
    alphabet = frozenset(r[0] for r in letters.collect())
    shared = spark.sparkContext.broadcast(alphabet)

    def garble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        real = shared.value.issuperset
        for batch in batches:
            forms, originals, chains, kinds, ns = [], [], [], [], []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if LOST in word:
                    continue
                for form, (chain, kind) in garbled_forms(word).items():
                    if real(form):
                        forms.append(form)
                        originals.append(word)
                        chains.append(chain)
                        kinds.append(kind)
                        ns.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), pa.array(originals, pa.string()), pa.array(chains, pa.string()), pa.array(kinds, pa.int32()), pa.array(ns, pa.int64())], ["unit", "original", "chain", "kind", "m"])

    # making the forms is the dearest step and its input is small: spread over all tasks
    spread = known.unionByName(signs).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    forms = spread.mapInArrow(garble, "unit string, original string, chain string, kind int, m bigint")
    hit = cut(forms.join(known, "unit").filter((F.col("kind") != 1) | (F.col("m") >= F.col("n"))))
    tie = (F.col("kind") == 1) & (F.col("m") == F.col("n"))
    odd = F.pandas_udf(lambda s: s.map(oddness).astype("int32"), "int")
    tied = hit.filter(tie)
    # chains that a text has gone through beyond doubt
    sure = hit.filter((F.col("kind") == 1) & ~tie).select("unit", "chain").distinct()
    gone = held.join(sure, "unit").select("body", "chain").distinct()
    backed = held.join(tied.select("unit", "chain"), "unit").join(gone, ["body", "chain"], "left_semi").select("unit", "chain").distinct()
    told_ties = cut(tied.filter(odd("unit") > odd("original")).unionByName(tied.join(backed, ["unit", "chain"], "left_semi")).distinct())
    hit = hit.filter(~tie).unionByName(told_ties.select(*hit.columns))
    # an original that is a garbled unit itself is the last resort
    dirty = hit.filter("kind > 0").select(F.col("unit").alias("original"), F.lit(False).alias("clean")).distinct()
    hit = hit.join(dirty, "original", "left").withColumn("clean", F.coalesce("clean", F.lit(True)))
    best = hit.groupBy("unit").agg(F.max_by(F.struct("original", "chain", "kind"), F.struct("clean", "kind", "m", "original")).alias("b"), F.count_distinct(F.when(F.col("clean"), F.col("original"))).alias("ways"))
    told = best.select("unit", F.when((F.col("b.kind") > 0) | (F.col("ways") == 1), F.col("b.original")).alias("original"), F.col("b.chain").alias("chain"), F.col("b.kind").alias("kind"))
    lost = known.filter(F.col("unit").contains(LOST)).select("unit")
    return lost.join(told, "unit", "full").select("unit", "original", F.coalesce("chain", F.lit("lost")).alias("chain"), F.coalesce("kind", F.lit(0)).alias("kind"))


def affected_units(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``doc``, ``unit``, ``original``, ``chain``, ``kind`` of every garbled unit of every document."""
    found = cut(document_units(docs, doc, text))
    return found.join(garbled_units(found), "unit").drop("body")


def _unread(stretch: str, chain: str) -> str | None:
    """What a stretch was before a chain of UTF-8 misreadings, null if it can't have come of it."""
    text = stretch
    for codec in reversed(chain.split(">")[1::2]):
        table = {c: b for b, c in enumerate(_table(codec))}
        try:
            text = bytes([table[c] if c in table else ord(c) for c in text]).decode("utf-8")
        except (ValueError, UnicodeDecodeError):
            return None
    return text if text.isprintable() else None


def restore(text: str, known: dict[str, str | None], chains: list[str]) -> tuple[str, int, int]:
    """Text with its garbled units replaced, the number of places replaced and of places left as they are.

    A word in ``known`` is replaced as a whole, else its stretches are; a stretch that isn't known is read back by the ``chains`` that
    the text was seen to have gone through.
    """
    done = left = 0

    def stretch(m: re.Match) -> str:
        nonlocal done, left
        s = m[0]
        to = known.get(s) or (next((r for c in chains if (r := _unread(s, c)) and r != s), None) if LOST not in s else None)
        done += to is not None
        left += to is None and (s in known or LOST in s)
        return to if to is not None else s

    def word(m: re.Match) -> str:
        nonlocal done
        to = known.get(m[0])
        if to is not None:
            done += 1
            return to
        return _STRETCH.sub(stretch, m[0])

    return _UNIT.sub(word, text), done, left


def restored(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``doc``, ``text`` as it was before, ``replaced`` and ``left`` places, for every affected document.

    The units of a document are gathered with it, never more than the document holds.
    """
    found = affected_units(docs, doc, text)
    chain = F.when(F.col("kind") == 2, F.col("chain"))
    per = found.groupBy("doc").agg(F.collect_list(F.struct("unit", "original")).alias("known"), F.array_sort(F.collect_set(chain)).alias("chains"))

    @F.pandas_udf("text string, replaced int, left int")
    def run(texts: pd.Series, known: pd.Series, chains: pd.Series) -> pd.DataFrame:
        rows = [restore(t, {u["unit"]: u["original"] for u in k}, list(c)) for t, k, c in zip(texts, known, chains, strict=True)]
        return pd.DataFrame(rows, columns=["text", "replaced", "left"])

    whole = docs.select(F.col(doc).alias("doc"), F.col(text).alias("__text")).join(per, "doc")
    return whole.select("doc", run("__text", "known", "chains").alias("r")).select("doc", "r.*")
