"""Problem 6: applicant files whose schema drifts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollweave.functions.aliases import FIELD_ALIASES
from rollweave.operators.drift import file_schemas, one_table, same_fields, schema_changes
from rollweave.session import cut, table


def _schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(file_schemas(table(spark, sf_dir, "ats_raw"), "feed", "file_no", "exported_at", "payload"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each change of a file against the one before it in its feed."""
    return schema_changes(_schemas(spark, sf_dir)).withColumnRenamed("file", "file_no")


def p6_applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all files as one table of applicants, with every key of the payloads."""
    raw, schemas = table(spark, sf_dir, "ats_raw"), _schemas(spark, sf_dir)
    one = one_table(raw, "payload", same_fields(schemas, cut(schema_changes(schemas))), ["feed", "file_no", "line_no", "exported_at", "delivered_at"])
    return one.withColumn("skills_list", F.array_join("skills_list", "|")).withColumn("also", F.nullif(F.array_join(F.array_sort(F.map_keys("also")), "|"), F.lit("")))


def p6_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the one table: line, field and text; numbers as texts."""
    one = p6_applicants(spark, sf_dir)
    line = ["feed", "file_no", "line_no"]
    cells = [F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for c in one.columns if c not in (*line, "exported_at", "delivered_at")]
    return one.select(*line, F.explode(F.array(*cells)).alias("c")).select(*line, "c.*").filter("value <> ''")


def queries() -> dict:
    return {"p6_found": p6_found, "p6_applicants": p6_applicants, "p6_values": p6_values}


def oracle_sql() -> dict[str, str]:
    """Keys of known meaning are renames of one another; on these tables no other key is ever renamed."""
    known = ", ".join(f"('{a}', '{field}')" for field, names in FIELD_ALIASES.items() for a in (field, *names))
    placed = ", ".join(f"('{a}', '{field}', {i})" for field, names in FIELD_ALIASES.items() for i, a in enumerate((field, *names)))
    snake = r"lower(regexp_replace(key, '([a-z0-9])([A-Z])', '\1_\2', 'g'))"
    found = f"""WITH known(name, concept) AS (VALUES {known}),
k AS (SELECT feed, file_no, min(exported_at) OVER (PARTITION BY feed, file_no) AS sent, payload, unnest(json_keys(payload)) AS key FROM ats_raw),
t AS (SELECT feed, file_no, sent, key, CASE json_type(json_extract(payload, '$.' || key)) WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'decimal' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' END AS type FROM k),
f AS (SELECT feed, file_no, key, max(type) AS type, any_value(coalesce(concept, '?' || key)) AS concept FROM t LEFT JOIN known ON name = {snake} GROUP BY feed, file_no, key),
o AS (SELECT feed, file_no, lag(file_no) OVER (PARTITION BY feed ORDER BY sent, file_no) AS before FROM (SELECT DISTINCT feed, file_no, sent FROM k)),
b AS (SELECT o.feed, o.file_no, f.key, f.type, f.concept FROM o JOIN f ON f.feed = o.feed AND f.file_no = o.before),
a AS (SELECT o.feed, o.file_no, f.key, f.type, f.concept FROM o JOIN f USING (feed, file_no) WHERE before IS NOT NULL),
lost AS (SELECT * FROM b ANTI JOIN a USING (feed, file_no, key)), new AS (SELECT * FROM a ANTI JOIN b USING (feed, file_no, key))
SELECT feed, file_no, 'retyped' AS change_kind, key AS field_before, key AS field_after FROM a JOIN b USING (feed, file_no, key) WHERE a.type <> b.type
UNION ALL SELECT lost.feed, lost.file_no, 'renamed', lost.key, new.key FROM lost JOIN new USING (feed, file_no, concept)
UNION ALL SELECT feed, file_no, 'removed', key, '' FROM lost ANTI JOIN new USING (feed, file_no, concept)
UNION ALL SELECT feed, file_no, 'added', '', key FROM new ANTI JOIN lost USING (feed, file_no, concept)"""
    values = f"""WITH known(name, concept, place) AS (VALUES {placed}),
r AS (SELECT row_number() OVER () AS id, feed, file_no, line_no, payload FROM ats_raw WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'),
k AS (SELECT id, feed, file_no, line_no, payload, unnest(json_keys(payload)) AS key FROM r),
x AS (SELECT id, feed, file_no, line_no, key, coalesce(concept, {snake}) AS field, coalesce(place, 99) AS place, json_extract(payload, '$."' || key || '"') AS x FROM k LEFT JOIN known ON name = {snake}),
o AS (SELECT *, row_number() OVER (PARTITION BY id, field ORDER BY place, key) AS n FROM x WHERE json_type(x) <> 'NULL'),
t AS (SELECT *, CASE json_type(x) WHEN 'OBJECT' THEN concat_ws(' ', x ->> '$.given', x ->> '$.family') WHEN 'ARRAY' THEN CASE field WHEN 'skills_list' THEN array_to_string(x ->> '$[*]', '|') ELSE array_to_string(x ->> '$[*]', '; ') END
 ELSE CASE field WHEN 'skills_list' THEN array_to_string(list_filter(list_transform(regexp_split_to_array(x ->> '$', '[,;|]'), lambda s: trim(s)), lambda s: s <> ''), '|') ELSE trim(x ->> '$') END END AS text FROM o WHERE n = 1),
u AS (SELECT feed, file_no, line_no, field, CASE field WHEN 'years_of_experience' THEN CAST(TRY_CAST(nullif(regexp_extract(text, '-?[0-9]+([.][0-9]+)?'), '') AS DOUBLE) AS VARCHAR) ELSE text END AS value FROM t)
SELECT * FROM u WHERE value <> ''"""
    return {"p6_found": found, "p6_values": values}
