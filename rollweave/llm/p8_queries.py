"""Problem 8: documents in containers of 2,048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollweave.llm.packing import pack_items, token_count
from rollweave.session import cut, table

CAPACITY = 2048


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", token_count(F.col("text")).alias("n_tokens"))
    return pack_items(sized, "doc_id", "n_tokens", CAPACITY).withColumnRenamed("item", "doc_id")


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document or piece of one."""
    return _packed(spark, sf_dir)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and share of space used, over all containers."""
    per = cut(_packed(spark, sf_dir)).groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), (F.sum("used") / (F.count(F.lit(1)) * CAPACITY)).alias("fill"))


def p8_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of any packing: every document is laid in, no container is overfull, nothing is cut that fits, and no piece but the last of a document is short."""
    p = cut(_packed(spark, sf_dir))
    over = p.groupBy("container").agg(F.sum("n_tokens").alias("used")).filter(F.col("used") > CAPACITY).agg(F.count(F.lit(1)).alias("overfull"))
    per = p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.max("piece").alias("last"), F.count_if(F.col("n_tokens") == CAPACITY).alias("full"), F.sum("n_tokens").alias("size"))
    wrong = (F.col("pieces") != F.col("last")) | (F.col("full") < F.col("pieces") - 1) | ((F.col("pieces") > 1) & (F.col("size") <= CAPACITY))
    cuts = per.agg(F.count(F.lit(1)).alias("documents"), F.count_if(wrong).alias("ill_cut"))
    return cuts.withColumn("k", F.lit(1)).join(over.withColumn("k", F.lit(1)), "k").drop("k")


def queries() -> dict:
    return {"p8_packed": p8_packed, "p8_fill": p8_fill, "p8_sound": p8_sound}


def oracle_sql() -> dict[str, str]:
    return {"p8_sound": "SELECT count(*) AS documents, 0::BIGINT AS ill_cut, 0::BIGINT AS overfull FROM documents"}
