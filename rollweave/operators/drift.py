"""Schemas that drift between files: what changed from file to file, and one consistent table of everything.

``file_schemas`` reads each JSON payload once (as a variant, in the JVM) and reduces it to one row per file. ``schema_changes``
compares each file with the one before it in its feed by a minimum-cost tree edit script. ``one_table`` compiles the scripts
into a single projection that fits every file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollweave.functions.aliases import FIELD_ALIASES, plain_key
from rollweave.functions.tree_edit import Node, blend, edit_script, parse_type
from rollweave.operators.ordered import with_previous
from rollweave.session import cut

#: JSON types in the order in which a mixed field is named after the first it has, numbers last.
TYPES = ("object", "array", "string", "boolean", "decimal", "integer")

#: Bits of the signature of a field's values.
BITS = 512

def _json_type(schema: Column) -> Column:
    big = F.regexp_extract(schema, r"^DECIMAL\((\d+), *0\)", 1)
    return (
        F.when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "boolean")
        .when((schema == "BIGINT") | ((big != "") & (big.try_cast("int") > 18)), "integer")
        .when(schema.startswith("DECIMAL") | (schema == "DOUBLE") | (schema == "FLOAT"), "decimal")
    )


def _buckets(text: Column) -> Column:
    """Distinct numbers below ``BITS`` for the words of a text; numbers of more than two digits count alike."""
    words = F.split(F.regexp_replace(F.lower(text), r"\d{3,}", "#"), r"[^\p{L}\p{M}\p{N}#]+")
    return F.array_distinct(F.transform(F.array_remove(words, ""), lambda w: F.pmod(F.xxhash64(w), F.lit(BITS)).cast("int")))


def file_schemas(df: DataFrame, feed: str, file: str, order: str, payload: str, deep: bool = True) -> DataFrame:
    """One row per file: ``feed``, ``file``, ``order``, ``fields`` (sorted by key) and ``signature``, a text equal for equal schemas.

    A field has its key, JSON type ('' if only nulls were seen), the full type of what is nested in it, over all lines of the file (''
    without ``deep``, then schemas are compared by their top level alone), and a bit signature of the words of its values. Lines that aren't JSON objects, or are null, are left out; a file without any object has no row.
    """
    v = df.select(F.col(feed).alias("feed"), F.col(file).alias("file"), F.col(order).alias("at"), F.try_parse_json(F.col(payload)).alias("v"))
    v = v.filter(F.schema_of_variant("v").startswith("OBJECT"))
    kv = v.lateralJoin(v.sparkSession.tvf.variant_explode(F.col("v").outer()).alias("kv")).select("feed", "file", "at", F.col("kv.key").alias("key"), F.col("kv.value").alias("value")).filter(F.col("key").isNotNull())
    kv = kv.withColumn("type", _json_type(F.schema_of_variant("value")))
    whole = F.when(F.col("type") == "array", F.array_join(F.try_variant_get("value", "$", "array<string>"), " ")).when(F.col("type") == "object", F.array_join(F.map_values(F.from_json(F.to_json("value"), "map<string,string>")), " "))
    words = _buckets(whole.otherwise(F.try_variant_get("value", "$", "string")))
    each = kv.select("feed", "file", "at", "key", "type", F.explode_outer(words).alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("bit", F.lit(64)))
    per_key = each.groupBy("feed", "file", "key").agg(
        F.min("at").alias("at"),
        *[F.max(F.when(F.col("type") == t, True)).alias(f"is_{t}") for t in TYPES],
        F.array(*[F.coalesce(F.bit_or(F.when(F.floor(F.col("bit") / 64) == w, one)), F.lit(0)) for w in range(BITS // 64)]).alias("values"),
    )
    if deep:
        # merging nested types needs an aggregate on objects, which is slow, so only the values that have some go through it; the words are plain numbers
        trees = kv.filter(F.col("type").isin("object", "array")).groupBy("feed", "file", "key").agg(F.schema_of_variant_agg("value").alias("nested"))
        per_key = per_key.join(trees.select(F.col("feed").alias("f"), F.col("file").alias("n"), F.col("key").alias("k"), "nested"), F.col("feed").eqNullSafe(F.col("f")) & F.col("file").eqNullSafe(F.col("n")) & (F.col("key") == F.col("k")), "left").drop("f", "n", "k")
    else:
        per_key = per_key.withColumn("nested", F.lit(""))
    kind = F.coalesce(*[F.when(F.col(f"is_{t}"), F.lit(t)) for t in TYPES], F.lit(""))
    fields = F.array_sort(F.collect_list(F.struct("key", kind.alias("type"), F.when(kind.isin("object", "array"), F.col("nested")).otherwise("").alias("nested"), "values")))
    per_file = per_key.groupBy("feed", "file").agg(F.min("at").alias("at"), fields.alias("fields"))
    return per_file.withColumn("signature", F.to_json(F.transform("fields", lambda x: F.struct(x["key"], x["type"], x["nested"]))))


#: Most distinct pairs of key names that are compared, and most columns of the one table; key names are a vocabulary of the feeds' software, not of their data.
MOST_PAIRS, MOST_COLUMNS = 100_000, 10_000
#: Share of the files of the rarer of two keys that hold both, above which they are two fields.
TOGETHER = 0.1


def key_likeness(schemas: DataFrame, pairs: DataFrame) -> dict[tuple[str, str], float]:
    """Likeness of each pair ``a``, ``b`` of keys, as all files show it.

    The values of a key are profiled by the share of its files that hold each word; two keys are as alike as the cosine of their profiles
    (and their names) tells, and not at all if files hold both. Only distinct pairs reach the driver, at most ``MOST_PAIRS``; more is an error.
    """
    pairs = cut(pairs.distinct().limit(MOST_PAIRS + 1))
    if pairs.count() > MOST_PAIRS:
        raise ValueError("too many distinct pairs of changed keys")
    wanted = F.broadcast(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct())
    held = schemas.select("feed", "file", F.explode("fields").alias("x")).select("feed", "file", F.col("x.key").alias("key"), F.col("x.values").alias("values")).join(wanted, "key")
    bits = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.getbit(F.element_at("values", F.floor(i / 64).cast("int") + 1), F.pmod(i, F.lit(64))) == 1)
    total = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    share = cut(held.select("key", F.explode(bits).alias("bit")).groupBy("key", "bit").agg(F.count(F.lit(1)).alias("c")).join(total, "key").select("key", "bit", (F.col("c") / F.col("n")).alias("s")))
    size = share.groupBy("key").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("size"))
    of = lambda df, e: df.select(F.col("key").alias(e), *[F.col(c).alias(c if c in ("bit", "feed", "file") else f"{c}_{e}") for c in df.columns if c != "key"])
    dot = pairs.join(of(share, "a"), "a").join(of(share, "b"), ["b", "bit"]).groupBy("a", "b").agg(F.sum(F.col("s_a") * F.col("s_b")).alias("dot"))
    files = held.select("key", "feed", "file")
    both = pairs.join(of(files, "a"), "a").join(of(files, "b"), ["b", "feed", "file"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    told = pairs.join(of(total, "a"), "a").join(of(total, "b"), "b").join(both, ["a", "b"], "left").join(dot, ["a", "b"], "left").join(of(size, "a"), "a", "left").join(of(size, "b"), "b", "left")
    cosine = F.coalesce(F.col("dot") / (F.col("size_a") * F.col("size_b")), F.lit(0.0))
    apart = F.coalesce("both", F.lit(0)) > TOGETHER * F.least("n_a", "n_b")
    return {(r["a"], r["b"]): 0.0 if r["apart"] else blend(r["a"], r["b"], r["cosine"]) for r in told.select("a", "b", cosine.alias("cosine"), apart.alias("apart")).collect()}


def _node(x: dict) -> Node:
    bits = 0
    for w, word in enumerate(x["values"]):
        bits |= (int(word) & (2**64 - 1)) << (64 * w)
    kids = parse_type(x["nested"])[1] if x["type"] in ("object", "array") and x["nested"] else []
    return Node(x["key"], x["type"], bits, kids)


def schema_changes(schemas: DataFrame, deep: bool = False) -> DataFrame:
    """Each change of each file against the file before it in its feed: ``feed``, ``file``, ``change_kind``, ``field_before``, ``field_after``.

    Files are ordered by ``at``, then by ``file``; a feed's first file has no changes; files with an equal signature are passed
    over in the JVM. ``schemas``, one row per file, should be cheap to read again. Which keys can be one field under two names is told
    by ``key_likeness``. The script is of the whole trees; it is given for the top level, and with ``deep`` also for what changes below it
    and moves between levels.
    """
    both = with_previous(schemas, ["feed"], ["at", "file"], F.date_trunc("month", "at"), ["fields", "signature"])
    changed = cut(both.filter(F.col("prev").isNotNull() & (F.col("prev.signature") != F.col("signature"))).select("feed", "file", F.col("prev.fields").alias("old"), F.col("fields").alias("new")))
    keys = lambda c: F.transform(c, lambda x: x["key"])
    lost, found = F.array_except(keys("old"), keys("new")), F.array_except(keys("new"), keys("old"))
    known = key_likeness(schemas, changed.select(F.explode(lost).alias("a"), found.alias("f")).select("a", F.explode("f").alias("b")))
    shared = schemas.sparkSession.sparkContext.broadcast(known)

    def diff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r.feed, r.file, e.kind, e.before, e.after) for r in b.itertuples(index=False) for e in edit_script([_node(x) for x in r.old], [_node(x) for x in r.new], deep, shared.value)]
            yield pd.DataFrame(rows, columns=["feed", "file", "change_kind", "field_before", "field_after"])

    of = dict(schemas.dtypes)
    return changed.mapInPandas(diff, f"feed {of['feed']}, file {of['file']}, change_kind string, field_before string, field_after string")


def same_fields(schemas: DataFrame, changes: DataFrame, names: dict[str, tuple[str, ...]] = FIELD_ALIASES) -> dict[str, list[str]]:
    """Column -> all keys that carry it, for every key of ``schemas``.

    Keys that ``changes`` renames into one another are one column. A column is named after the entry of ``names`` (canonical name -> other
    names) that it belongs to, else after its first key; keys of different entries are never one column. Only distinct key names and
    pairs of them reach the driver, at most ``MOST_COLUMNS`` and ``MOST_PAIRS``; more is an error.
    """
    keys = [r[0] for r in schemas.select(F.explode(F.transform("fields", lambda x: x["key"])).alias("k")).distinct().limit(MOST_COLUMNS + 1).collect()]
    pairs = changes.filter(F.col("change_kind") == "renamed").select("field_before", "field_after").distinct().limit(MOST_PAIRS + 1).collect()
    if len(keys) > MOST_COLUMNS or len(pairs) > MOST_PAIRS:
        raise ValueError("too many distinct keys or renames for one projection")
    entry = {plain_key(n): f for f, others in names.items() for n in (f, *others)}
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in sorted(tuple(p) for p in pairs):
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    groups: dict[str, list[str]] = {}
    for x in sorted({*keys, *parent}):
        groups.setdefault(root(x), []).append(x)
    out = {f: [] for f in names}
    for members in groups.values():
        of = {entry[plain_key(m)] for m in members if plain_key(m) in entry}
        rest = [m for m in members if plain_key(m) not in entry]
        column = of.pop() if len(of) == 1 else plain_key(rest[0]) or rest[0] if rest else None
        for m in members:
            out.setdefault(entry.get(plain_key(m)) or column, []).append(m)
    # a key with its canonical name counts first, then the other names in their order
    place = {plain_key(n): i for f, others in names.items() for i, n in enumerate((f, *others))}
    return {f: sorted(ks, key=lambda k: (place.get(plain_key(k), len(place)), k)) for f, ks in out.items()}


def one_table(df: DataFrame, payload: str, fields: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """``keep``, a column for each of ``fields``, and ``also``, in one projection without a join.

    A value is the first of its field's keys that is present; where a line holds further keys of a field, or keys that ``fields`` doesn't
    know, ``also`` (key -> JSON) has them, so nothing is lost. Values are given as texts: an object with parts of a name becomes the name,
    given name first, any other object stays JSON; the items of an array are joined by "; ", unless they are objects, which stay JSON.
    ``skills_list`` is an array of texts, split at commas, semicolons and bars if it is one text; ``years_of_experience`` is the first
    number in the value. Blank texts, null and broken payloads give null fields. A field of the name of a column to keep gets ``_field`` added.
    """
    v = df.withColumn("__m", F.try_variant_get(F.try_parse_json(F.col(payload)), "$", "map<string,variant>"))
    m = F.map_filter("__m", lambda k, x: ~F.is_variant_null(x))
    v = v.withColumn("__m", m)

    def value(names: list[str]) -> Column:
        return F.coalesce(*[F.try_element_at("__m", F.lit(n)) for n in names], F.lit(None).cast("variant"))

    def flat(x: Column) -> Column:
        t = F.schema_of_variant(x)
        held = F.from_json(F.to_json(x), "map<string,string>")
        part = lambda *names: F.coalesce(*[F.try_element_at(held, F.lit(n)) for n in names])
        person = F.nullif(F.trim(F.concat_ws(" ", part("given", "given_name", "first", "first_name"), part("middle", "middle_name"), part("family", "family_name", "last", "last_name", "surname"))), F.lit(""))
        items = F.when(t.contains("OBJECT"), F.to_json(x)).otherwise(F.array_join(F.try_variant_get(x, "$", "array<string>"), "; "))
        return F.nullif(F.trim(F.when(t.startswith("OBJECT"), F.coalesce(person, F.to_json(x))).when(t.startswith("ARRAY"), items).otherwise(F.try_variant_get(x, "$", "string"))), F.lit(""))

    cols = []
    for f, names in sorted(fields.items()):
        x, name = value(names), f"{f}_field" if f in keep or f == "also" else f
        if f == "skills_list":
            t = F.schema_of_variant(x)
            split = F.filter(F.transform(F.split(F.try_variant_get(x, "$", "string"), r"[,;|]"), lambda s: F.trim(s)), lambda s: s != "")
            cols.append(F.when(t.startswith("ARRAY"), F.try_variant_get(x, "$", "array<string>")).otherwise(split).alias(name))
        elif f == "years_of_experience":
            cols.append(F.regexp_extract(flat(x), r"-?\d+(\.\d+)?", 0).try_cast("double").alias(name))
        else:
            cols.append(flat(x).alias(name))
    first = F.array(*[F.coalesce(*[F.when(F.map_contains_key("__m", n), F.lit(n)) for n in names], F.lit(None).cast("string")) for names in fields.values()]) if fields else F.array().cast("array<string>")
    also = F.transform_values(F.map_filter("__m", lambda k, x: ~F.coalesce(F.array_contains(first, k), F.lit(False))), lambda k, x: F.to_json(x))
    return v.select(*keep, *cols, also.alias("also"))
