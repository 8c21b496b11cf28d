"""Problem 9: evaluation passages in the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollweave.llm.leakage import leaks
from rollweave.session import table


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with each item of which it holds twelve consecutive words."""
    found = leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold the eight rarest terms of an item within sixty words, in any order."""
    found = leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text", near=(8, 60))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.col("doc_pos").alias("first_word"))


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that leaked, the number of documents that hold them and the longest run."""
    found = leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")
    per = found.groupBy("item", "doc").agg(F.max("length").alias("length"))
    return per.groupBy(F.col("item").alias("item_id")).agg(F.count(F.lit(1)).alias("documents"), F.max("length").alias("longest_run"))


def queries() -> dict:
    return {"p9_found": p9_found, "p9_items": p9_items, "p9_near": p9_near}


def oracle_sql() -> dict[str, str]:
    found = r"""WITH d AS (SELECT doc_id AS id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{Nd}]+', ' ', 'g')), ' ') AS w FROM documents),
e AS (SELECT item_id AS id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{Nd}]+', ' ', 'g')), ' ') AS w FROM eval_items),
dw AS (SELECT id, hash(w[k:k+11]) AS h FROM (SELECT id, w, unnest(range(1, greatest(1, len(w) - 10))) AS k FROM d)),
ew AS (SELECT id, hash(w[k:k+11]) AS h FROM (SELECT id, w, unnest(range(1, greatest(1, len(w) - 10))) AS k FROM e))
SELECT DISTINCT dw.id AS doc_id, ew.id AS item_id FROM dw JOIN ew USING (h)"""
    grams = r"""WITH d AS (SELECT doc_id AS id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents),
e AS (SELECT item_id AS id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM eval_items)"""
    items = grams + r""",
dw AS (SELECT id, k, hash(w[k:k+11]) AS h FROM (SELECT id, w, unnest(range(1, greatest(1, len(w) - 10))) AS k FROM d)),
ew AS (SELECT id, k, hash(w[k:k+11]) AS h FROM (SELECT id, w, unnest(range(1, greatest(1, len(w) - 10))) AS k FROM e)),
m AS (SELECT dw.id AS doc_id, ew.id AS item_id, dw.k - ew.k AS shift, ew.k AS k FROM dw JOIN ew USING (h)),
r AS (SELECT doc_id, item_id, shift, k - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY k) AS island FROM m),
l AS (SELECT doc_id, item_id, count(*) + 11 AS length FROM r GROUP BY doc_id, item_id, shift, island)
SELECT item_id, count(DISTINCT doc_id) AS documents, CAST(max(length) AS INTEGER) AS longest_run FROM l GROUP BY item_id"""
    # HTML tags count as spaces; for positions that matters, for twelve words in a row of these tables it doesn't
    tags = r"""CASE WHEN contains(text, '</') OR contains(text, '/>') OR contains(text, '<br') THEN regexp_replace(text, '</?(?:[abipu]|em|strong|br|hr|span|div|li|ul|ol|h[1-6]|code|pre|td|tr|th|table|font|sup|sub)(?:\s[^<>]*)?/?>', ' ', 'gi') ELSE text END"""
    near = grams.replace("lower(text)", f"lower({tags})") + r""",
et AS (SELECT DISTINCT id, unnest(w) AS term FROM e), vocabulary AS (SELECT DISTINCT term FROM et),
dp AS MATERIALIZED (SELECT id, term, pos FROM (SELECT id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d) SEMI JOIN vocabulary USING (term)),
df AS (SELECT term, count(*) AS df FROM dp GROUP BY term),
rare AS (SELECT id AS item_id, term FROM (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY df, term) AS n, count(*) OVER (PARTITION BY id) AS m FROM et JOIN df USING (term)) WHERE n <= 8 AND m >= 8),
hit AS (SELECT dp.id AS doc_id, item_id, term, pos FROM dp JOIN rare USING (term)),
near AS (SELECT a.doc_id, a.item_id, a.pos FROM hit a JOIN hit b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.pos BETWEEN a.pos AND a.pos + 59 GROUP BY ALL HAVING count(DISTINCT b.term) = 8)
SELECT doc_id, item_id, CAST(min(pos) AS INTEGER) AS first_word FROM near GROUP BY doc_id, item_id"""
    return {"p9_found": found, "p9_items": items, "p9_near": near}
