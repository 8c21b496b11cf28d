"""Problem 3: one surviving record per candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollweave.llm.survivors import survivors
from rollweave.session import table

#: Words that stand in a name field without naming anybody (fixed values).
NO_NAMES = ("unknown", "candidate", "applicant", "test", "name", "anonymous", "nobody", "null", "none", "nan", "tbd", "confidential")


def usable_name(name: Column) -> Column:
    """True for a given and a family name written out: two words of two letters or more, no placeholder, no mailbox."""
    words = F.regexp_extract_all(name, F.lit(r"([\p{L}\p{M}][\p{L}\p{M}'’-]*[\p{L}\p{M}])"), 1)
    placeholder = F.exists(words, lambda w: F.lower(w).isin(*NO_NAMES))
    return F.coalesce((F.size(words) >= 2) & ~placeholder & ~name.rlike(r"[@\d]"), F.lit(False))


def usable_email(email: Column) -> Column:
    """True for ``local@host.tld`` and nothing else."""
    return F.coalesce(email.rlike(r"^[A-Za-z0-9._%+'-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"), F.lit(False))


def name_key(name: Column) -> Column:
    """A name whatever its case, order and punctuation, for counting votes."""
    return F.array_join(F.array_sort(F.regexp_extract_all(F.lower(name), F.lit(r"([\p{L}\p{M}]+)"), 1)), " ")


def _source(of: Column) -> Column:
    """Source of the provenance entry for a field."""
    return F.get(F.filter("provenance", lambda p: p["field"] == of), F.lit(0))["source"]


def _claims(df: DataFrame) -> DataFrame:
    name = F.struct(F.lit("full_name").alias("field"), F.when(usable_name(F.col("full_name")), name_key(F.col("full_name"))).alias("value"), _source(F.lit("full_name")).alias("source"))
    mail = F.struct(F.lit("primary_email").alias("field"), F.when(usable_email(F.col("primary_email")), F.lower("primary_email")).alias("value"), _source(F.lit("emails")).alias("source"))
    return df.select(F.col("candidate_id").alias("gid"), F.col("row_id").alias("row"), F.col("updated_at").alias("at"), F.explode(F.array(name, mail)).alias("c")).select("gid", "row", "at", "c.*")


def _survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "candidates_combined_1ab46684").filter(F.col("candidate_id").isNotNull())
    groups = df.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("candidate_id")
    rank = {r[0]: r[1] for r in table(spark, sf_dir, "source_trust").limit(10_001).collect()}
    if len(rank) > 10_000:
        raise ValueError("too many sources")
    return survivors(_claims(df.join(groups, "candidate_id", "left_semi")), rank)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving row of each field of each repeated candidate."""
    return _survivors(spark, sf_dir).select(F.col("gid").alias("candidate_id"), F.col("field").alias("field_name"), F.col("row").alias("row_id"))


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per repeated candidate, built field by field; every value with its row and source."""
    won = _survivors(spark, sf_dir)
    raw = table(spark, sf_dir, "candidates_combined_1ab46684")
    held = raw.select(F.col("row_id").alias("row"), "full_name", "primary_email", "provenance").join(won, "row")
    part = F.struct(F.when(F.col("field") == "full_name", F.col("full_name")).otherwise(F.col("primary_email")).alias("value"), F.col("row").alias("row"), _source(F.when(F.col("field") == "full_name", "full_name").otherwise("emails")).alias("source"), F.round("support", 6).alias("support"))
    wide = held.withColumn("part", part).groupBy(F.col("gid").alias("candidate_id")).agg(*[F.max(F.when(F.col("field") == f, F.col("part"))).alias(f) for f in ("full_name", "primary_email")])
    return wide.select("candidate_id", *[F.col(f"{f}.{c}").alias(f if c == "value" else f"{f}_{c}") for f in ("full_name", "primary_email") for c in ("value", "row", "source", "support")])


def queries() -> dict:
    return {"p3_found": p3_found, "p3_records": p3_records}


_USABLE_NAME = r"""regexp_matches(full_name, '[\p{L}\p{M}][\p{L}\p{M}''’-]*[\p{L}\p{M}].*[^\p{L}\p{M}''’-]+.*[\p{L}\p{M}][\p{L}\p{M}''’-]*[\p{L}\p{M}]')
  AND NOT regexp_matches(full_name, '[@0-9]')
  AND NOT regexp_matches(lower(full_name), '(^|[^\p{L}\p{M}''’-])(unknown|candidate|applicant|test|name|anonymous|nobody|null|none|nan|tbd|confidential)($|[^\p{L}\p{M}''’-])')"""


def _records_sql(rounds: int = 15) -> str:
    """Truth discovery written out round by round: support of each value by the sources' reliability, then the reliability by the support."""
    email = r"regexp_full_match(primary_email, '[A-Za-z0-9._%+''-]+@[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}')"
    claims = rf"""c0 AS (
  SELECT candidate_id AS gid, 'full_name' AS field, row_id, updated_at, full_name AS raw, array_to_string(list_sort(regexp_extract_all(lower(full_name), '[\p{{L}}\p{{M}}]+')), ' ') AS value, list_filter(provenance, lambda p: p.field = 'full_name')[1].source AS source FROM candidates_combined_1ab46684 WHERE {_USABLE_NAME}
  UNION ALL
  SELECT candidate_id, 'primary_email', row_id, updated_at, primary_email, lower(primary_email), list_filter(provenance, lambda p: p.field = 'emails')[1].source FROM candidates_combined_1ab46684 WHERE {email}),
w AS (SELECT max(trust_rank) + 1 AS worst FROM source_trust),
c AS MATERIALIZED (SELECT c0.* EXCLUDE (source), coalesce(c0.source, '') AS voter, c0.source, coalesce(trust_rank, worst) AS r FROM c0 CROSS JOIN w LEFT JOIN source_trust t ON t.source = c0.source WHERE gid IN (SELECT candidate_id FROM candidates_combined_1ab46684 GROUP BY 1 HAVING count(*) > 1)),
n AS MATERIALIZED (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM c b WHERE b.gid = a.gid AND b.field = a.field AND ((b.updated_at > a.updated_at AND b.r <= a.r) OR (b.updated_at >= a.updated_at AND b.r < a.r))) THEN 0.02::DOUBLE ELSE 1.0::DOUBLE END AS n FROM c a),
v AS MATERIALIZED (SELECT gid, field, value, voter, max(n) AS n FROM n GROUP BY ALL),
r0 AS MATERIALIZED (SELECT voter, 1 - coalesce(trust_rank, worst - 1) / (worst + 1.0::DOUBLE) AS prior, 1 - coalesce(trust_rank, worst - 1) / (worst + 1.0::DOUBLE) AS r, false AS done FROM (SELECT DISTINCT voter FROM v) CROSS JOIN w LEFT JOIN source_trust t ON t.source = voter)"""
    support = "SELECT gid, field, value, sum(n * r) / sum(sum(n * r)) OVER (PARTITION BY gid, field) AS support FROM v JOIN r{0} USING (voter) GROUP BY gid, field, value"
    steps = [
        f"""s{k} AS MATERIALIZED ({support.format(k)}),
u{k} AS (SELECT voter, sum(n * support) AS got, sum(n) AS cast_n FROM v JOIN s{k} USING (gid, field, value) GROUP BY voter),
r{k + 1} AS MATERIALIZED (SELECT voter, prior, CASE WHEN done THEN r ELSE new END AS r, done OR max(abs(new - r)) OVER () <= 0.005 AS done FROM (SELECT r{k}.*, (got + 10 * prior) / (cast_n + 10) AS new FROM r{k} JOIN u{k} USING (voter)))"""
        for k in range(rounds)
    ]
    won = f"""f AS ({support.format(rounds)}),
b AS (SELECT gid, field, raw, row_id, source, round(support, 6) AS support, row_number() OVER (PARTITION BY gid, field ORDER BY round(support, 9) DESC, n.n DESC, updated_at DESC, r, row_id) AS k FROM n JOIN f USING (gid, field, value))"""
    cols = ", ".join(f"max({c}) FILTER (field = '{f}') AS {f}{s}" for f in ("full_name", "primary_email") for c, s in (("raw", ""), ("row_id", "_row"), ("source", "_source"), ("support", "_support")))
    return f"WITH {claims}, {', '.join(steps)}, {won} SELECT gid AS candidate_id, {cols} FROM b WHERE k = 1 GROUP BY gid"


def oracle_sql() -> dict[str, str]:
    found = f"""WITH claims AS (
  SELECT candidate_id, 'full_name' AS field_name, row_id, updated_at, list_filter(provenance, lambda p: p.field = 'full_name')[1].source AS source
  FROM candidates_combined_1ab46684 WHERE {_USABLE_NAME}
  UNION ALL
  SELECT candidate_id, 'primary_email', row_id, updated_at, list_filter(provenance, lambda p: p.field = 'emails')[1].source
  FROM candidates_combined_1ab46684 WHERE regexp_full_match(primary_email, '[A-Za-z0-9._%+''-]+@[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?(\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{{2,}}')),
ranked AS (SELECT c.*, coalesce(t.trust_rank, 1000) AS r FROM claims c LEFT JOIN source_trust t USING (source)
  WHERE candidate_id IN (SELECT candidate_id FROM candidates_combined_1ab46684 GROUP BY 1 HAVING count(*) > 1))
SELECT candidate_id, field_name, row_id FROM ranked a WHERE NOT EXISTS (
  SELECT 1 FROM ranked b WHERE b.candidate_id = a.candidate_id AND b.field_name = a.field_name
    AND ((b.updated_at > a.updated_at AND b.r <= a.r) OR (b.updated_at >= a.updated_at AND b.r < a.r)))"""
    return {"p3_found": found, "p3_records": _records_sql()}
