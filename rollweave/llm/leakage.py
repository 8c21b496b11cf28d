"""Evaluation texts leaking into training text: a positional inverted index and exact phrase look-up.

1. ``build_index`` reads every training text once and stores postings (term, document, position). Only terms of the evaluation
   vocabulary can match, and a shared run of ``run`` words lies within a stretch of at least ``run`` such terms, so postings
   outside such stretches are not stored; this loses no phrase.
2. ``phrase_matches`` orders the terms of every window of ``run`` evaluation words by their frequency in the index, looks up the
   rarest one, intersects its offset-adjusted postings with those of the next rarest, and checks the alignments that are left
   word by word, joining consecutive matches to runs.
3. ``proximity_matches`` finds documents that hold the rarest terms of an item close together in any order. Other words may stand
   between them, so stretches don't matter here: ``term_counts`` counts every term of the vocabulary in every text, and a second
   reading stores all postings of the terms that are the rarest of some item.

The vocabulary of all evaluation texts is sent to every task, so the corpus is read and indexed once however many of them there are; the
windows to look up go to the index in blocks of at most ``BLOCK_CHARS`` characters. A word is a run of letters or digits in lower case;
HTML tags count as spaces. Terms are kept as numbers of the vocabulary.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollweave.session import cut

#: Characters of evaluation text whose windows are broadcast at once.
BLOCK_CHARS = 4_000_000
#: Words of the evaluation vocabulary that are sent to every task at once; natural language rarely has more.
MOST_TERMS = 2_000_000

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?(?:[abipu]|em|strong|br|hr|span|div|li|ul|ol|h[1-6]|code|pre|td|tr|th|table|font|sup|sub)(?:\s[^<>]*)?/?>", re.I)


def words(text: str | None) -> list[str]:
    """Words of a text in order; none for null."""
    if not text:
        return []
    if "</" in text or "/>" in text or "<br" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(text.lower())


def item_blocks(items: DataFrame, item: str, text: str, block_chars: int = BLOCK_CHARS) -> list[DataFrame]:
    """The evaluation table cut into parts of at most ``block_chars`` characters (or one item), by a hash of the item."""
    total = items.agg(F.sum(F.length(text))).first()[0] or 0
    n = -(-total // max(1, block_chars // 2)) if total > block_chars else 1
    if n == 1:
        return [items]
    return [items.filter(F.pmod(F.xxhash64(item), F.lit(n)) == k) for k in range(n)]


def _tokens(items: DataFrame, item: str, text: str) -> list[tuple]:
    return [(r[0], words(r[1])) for r in items.select(item, text).filter(F.col(text).isNotNull()).distinct().collect()]


def vocabularies(items: DataFrame, text: str, most_terms: int = MOST_TERMS) -> list[dict[str, int]]:
    """Words of all evaluation texts with their numbers, in order: one vocabulary, or several of at most ``most_terms`` where one would be too large to send."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({w for t in batch.column(0) for w in words(t.as_py())}), pa.string())], ["w"])

    distinct = cut(items.select(text).mapInArrow(split, "w string").distinct())
    n = distinct.count()
    parts = max(1, -(-n // max(1, most_terms // 2))) if n > most_terms else 1
    picked = [distinct if parts == 1 else distinct.filter(F.pmod(F.xxhash64("w"), F.lit(parts)) == k) for k in range(parts)]
    return [{w: k * most_terms + i for i, w in enumerate(sorted(r[0] for r in p.collect()))} for k, p in enumerate(picked)]


def build_index(docs: DataFrame, doc: str, text: str, vocabulary: dict[str, int], run: int) -> DataFrame:
    """Postings ``doc``, ``term``, ``pos`` of all stretches of at least ``run`` words of the vocabulary. Null and short texts have none."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value.get
        for batch in batches:
            out_doc, out_term, out_pos = [], [], []
            for i, t in enumerate(batch.column(1)):
                found = [ids(w, -1) for w in words(t.as_py())]
                n, begin = len(found), 0
                if n < run:
                    continue
                while begin <= n - run:
                    # look at the far end first: a foreign word there rules out every start up to it
                    stop = begin + run - 1
                    while stop >= begin and found[stop] >= 0:
                        stop -= 1
                    if stop >= begin:
                        begin = stop + 1
                        continue
                    end = begin + run
                    while end < n and found[end] >= 0:
                        end += 1
                    key = batch.column(0)[i].as_py()
                    out_doc.extend([key] * (end - begin))
                    out_term.extend(found[begin:end])
                    out_pos.extend(range(begin, end))
                    begin = end + 1
            yield pa.RecordBatch.from_arrays([pa.array(out_doc, batch.schema.field(0).type), pa.array(out_term, pa.int32()), pa.array(out_pos, pa.int32())], ["doc", "term", "pos"])

    return docs.select(doc, text).mapInArrow(scan, f"doc {dict(docs.dtypes)[doc]}, term int, pos int")


def phrase_matches(index: DataFrame, tokens: DataFrame, run: int) -> DataFrame:
    """Exact matches of at least ``run`` consecutive words: ``doc``, ``item``, ``doc_pos``, ``item_pos``, ``length``.

    ``tokens`` holds the evaluation side: ``item``, ``ipos``, ``term``. It must be small enough to broadcast.
    """
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ranked = tokens.join(df, "term")
    # the two rarest terms of every window; a window with a term that the index lacks can't match
    inside = Window.partitionBy("item").orderBy("ipos").rowsBetween(0, run - 1)
    window = ranked.withColumn("w", F.array_sort(F.collect_list(F.struct("df", "ipos", "term")).over(inside))).withColumn("end", F.max("ipos").over(inside))
    window = window.filter((F.size("w") == run) & (F.col("end") == F.col("ipos") + run - 1))
    anchor = window.select("item", F.col("w")[0]["term"].alias("term"), F.col("w")[0]["ipos"].alias("ipos"), F.col("w")[1]["term"].alias("term2"), (F.col("w")[1]["ipos"] - F.col("w")[0]["ipos"]).alias("step")).distinct()
    first = index.join(F.broadcast(anchor), "term").select("doc", "item", (F.col("pos") - F.col("ipos")).alias("shift"), (F.col("pos") + F.col("step")).alias("pos"), F.col("term2").alias("term"))
    both = first.join(index, ["doc", "pos", "term"], "left_semi").select("doc", "item", "shift").distinct()
    laid = both.join(F.broadcast(tokens), "item").select("doc", "item", "shift", "ipos", "term", (F.col("shift") + F.col("ipos")).alias("pos"))
    same = laid.join(index, ["doc", "pos", "term"], "left_semi")
    island = F.col("ipos") - F.row_number().over(Window.partitionBy("doc", "item", "shift").orderBy("ipos"))
    runs = same.withColumn("island", island).groupBy("doc", "item", "shift", "island").agg(F.min("ipos").alias("item_pos"), F.count(F.lit(1)).cast("int").alias("length"))
    return runs.filter(F.col("length") >= run).select("doc", "item", (F.col("shift") + F.col("item_pos")).alias("doc_pos"), "item_pos", "length")


def term_counts(docs: DataFrame, text: str, vocabulary: dict[str, int]) -> DataFrame:
    """``term`` and ``df``, how often it occurs in all texts. Terms that don't occur have no row."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value.get
        for batch in batches:
            n = Counter(k for t in batch.column(0) for w in words(t.as_py()) if (k := ids(w)) is not None)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64())], ["term", "n"])

    return docs.select(text).mapInArrow(scan, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("df"))


def rarest_terms(counts: DataFrame, tokens: DataFrame, terms: int) -> DataFrame:
    """``item`` and ``term``: the ``terms`` rarest distinct terms of each item that occur at all. Items with fewer have none."""
    rare = tokens.join(counts, "term").select("item", "term", "df").distinct()
    rare = rare.groupBy("item").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "term"))), 1, terms).alias("r")).filter(F.size("r") == terms)
    return rare.select("item", F.explode("r.term").alias("term"))


def proximity_matches(index: DataFrame, rare: DataFrame, terms: int, span: int) -> DataFrame:
    """Documents with all ``terms`` rare terms of an item within ``span`` words, in any order: ``doc``, ``item``, ``doc_pos``.

    ``doc_pos`` is the first such place. ``index`` must hold every posting of the terms in ``rare`` (``item``, ``term``), which must be
    small enough to broadcast.
    """
    hits = index.join(F.broadcast(rare), "term")
    near = Window.partitionBy("doc", "item").orderBy("pos").rangeBetween(0, span - 1)
    return hits.withColumn("n", F.size(F.collect_set("term").over(near))).filter(F.col("n") == terms).groupBy("doc", "item").agg(F.min("pos").alias("doc_pos"))


def leaks(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, run: int = 12, block_chars: int = BLOCK_CHARS, near: tuple[int, int] | None = None, most_terms: int = MOST_TERMS) -> DataFrame:
    """All places where a document shares a run of at least ``run`` consecutive words with an item, as ``phrase_matches`` tells them.

    With ``near`` = (terms, span) the proximity matches instead, whatever ``run``. Null and empty texts and items of fewer than ``run``
    words, or ``terms`` distinct ones, have none; equal documents and equal items are all told. The postings are written to the
    checkpoint folder.
    """
    spark: SparkSession = docs.sparkSession
    kind = dict(items.dtypes)[item]
    parts = vocabularies(items, item_text, most_terms)
    vocabulary = {w: k for part in parts for w, k in part.items()}

    def tokens(block: DataFrame) -> DataFrame:
        rows = [(i, w) for i, w in _tokens(block, item, item_text) if near or len(w) >= run]
        return spark.createDataFrame([(i, p, vocabulary[w]) for i, ws in rows for p, w in enumerate(ws)], f"item {kind}, ipos int, term int")

    blocks = [tokens(b) for b in item_blocks(items, item, item_text, block_chars)]
    if near is None:
        if len(parts) == 1:
            index = cut(build_index(docs, doc, text, vocabulary, run))
        else:
            # the stretches of the whole vocabulary can't be told from parts of it; all postings are kept
            index = cut(reduce(DataFrame.unionByName, [build_index(docs, doc, text, part, 1) for part in parts]))
        found = [phrase_matches(index, t, run) for t in blocks]
    else:
        counts = cut(reduce(DataFrame.unionByName, [term_counts(docs, text, part) for part in parts]))
        rare = [cut(rarest_terms(counts, t, near[0])) for t in blocks]
        wanted = {r[0] for df in rare for r in df.select("term").distinct().collect()}  # no more than the vocabulary
        held = [{w: k for w, k in part.items() if k in wanted} for part in parts]
        index = cut(reduce(DataFrame.unionByName, [build_index(docs, doc, text, part, 1) for part in held]))
        found = [proximity_matches(index, r, *near) for r in rare]
    return reduce(DataFrame.unionByName, found)
