"""Projection of golden records through a configuration, and validation of the result.

A configuration is compiled to column expressions. ``project_struct`` gives typed columns and holds nulls for what is missing;
``project_json`` gives one JSON text a record, from which the policy ``omit`` can leave keys out.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollweave.functions.normalize import norm_skill
from rollweave.functions.phones import norm_phone

POLICIES = ("null", "omit", "error")


@dataclass(frozen=True)
class FieldSpec:
    path: str
    source: str
    type: str = "string"
    required: bool = False
    normalize: str | None = None


@dataclass(frozen=True)
class Config:
    fields: tuple[FieldSpec, ...] = field(default_factory=tuple)
    include_confidence: bool = True
    on_missing: str = "null"

    @staticmethod
    def of(data: dict) -> Config:
        """Configuration from parsed JSON; ValueError if a key is missing, a policy unknown or an output path collides with another."""
        try:
            specs = tuple(FieldSpec(f["path"], f.get("from", f["path"]), f.get("type", "string"), bool(f.get("required", False)), f.get("normalize")) for f in data["fields"])
        except (KeyError, TypeError) as e:
            raise ValueError(f"configuration lacks {e}") from e
        policy = data.get("on_missing", "null")
        if policy not in POLICIES:
            raise ValueError(f"on_missing is {policy!r}, not one of {POLICIES}")
        paths = [s.path for s in specs]
        for p in paths:
            if any(q != p and q.startswith(p + ".") for q in paths):
                raise ValueError(f"output path {p!r} holds other paths")
        return Config(specs, bool(data.get("include_confidence", True)), policy)

    @staticmethod
    def load(path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            return Config.of(json.load(f))


_SEGMENT = re.compile(r"^(\w+)(?:\[(\d*)\])?$")


def _kind_of(kind: T.DataType, name: str) -> T.DataType | None:
    return next((f.dataType for f in kind.fields if f.name == name), None) if isinstance(kind, T.StructType) else None


def path_get(schema: T.StructType, path: str) -> tuple[Column, T.DataType]:
    """Column at a path such as ``a.b[0].c`` or ``a[].b`` and its type; a null string where the path leads nowhere.

    ``[]`` maps over an array and drops nulls; an index out of range is null.
    """
    nowhere = (F.lit(None).cast("string"), T.StringType())

    def walk(col: Column | None, kind: T.DataType, parts: list[str]) -> tuple[Column, T.DataType] | None:
        if not parts:
            return (col, kind) if col is not None else None
        m = _SEGMENT.match(parts[0])
        if not m or not (inner := _kind_of(kind, m[1])):
            return None
        here = F.col(f"`{m[1]}`") if col is None else col.getField(m[1])
        if m[2] is None:
            return walk(here, inner, parts[1:])
        if not isinstance(inner, T.ArrayType):
            return None
        if m[2]:
            return walk(F.get(here, F.lit(int(m[2]))), inner.elementType, parts[1:])
        below: list[T.DataType] = []

        def each(x: Column) -> Column:
            got = walk(x, inner.elementType, parts[1:])
            below.append(got[1] if got else T.StringType())
            return got[0] if got else F.lit(None).cast("string")

        mapped = F.transform(here, each) if parts[1:] else here
        return F.filter(mapped, lambda x: x.isNotNull()), T.ArrayType(below[0] if below else inner.elementType)

    return walk(None, schema, path.split(".")) or nowhere


def coerce(col: Column, kind: T.DataType, want: str) -> Column:
    """A value as the type that a configuration names; unknown types pass."""
    if want == "string":
        if isinstance(kind, T.ArrayType):
            return coerce(F.get(col, F.lit(0)), kind.elementType, want)
        return F.to_json(col) if isinstance(kind, T.StructType) else col.cast("string")
    if want == "string[]":
        if isinstance(kind, T.ArrayType):
            return F.transform(col, lambda x: F.to_json(x) if isinstance(kind.elementType, T.StructType) else x.cast("string"))
        return F.when(col.isNotNull(), F.array(coerce(col, kind, "string")))
    if want == "number":
        return col.try_cast("double") if not isinstance(kind, (T.ArrayType, T.StructType)) else F.lit(None).cast("double")
    return col


def _normalized(col: Column, kind: T.DataType, name: str | None) -> Column:
    many = isinstance(kind, T.ArrayType)
    if name == "canonical":
        return F.transform(col, lambda x: norm_skill(x)["name"]) if many else norm_skill(col)["name"]
    if name == "E.164" and not many:
        return F.coalesce(norm_phone(col), col)
    return col


def _values(schema: T.StructType, config: Config) -> list[tuple[FieldSpec, Column]]:
    out = []
    for s in config.fields:
        col, kind = path_get(schema, s.source)
        value = coerce(_normalized(col, kind, s.normalize), kind, s.type)
        # an empty list, text or object of a list type counts as missing
        out.append((s, F.when(F.size(value) > 0, value) if s.type in ("string[]", "object[]") or (isinstance(kind, T.ArrayType) and s.type not in ("string", "number")) else value))
    return out


def _nested(pairs: list[tuple[list[str], Column]]) -> list[Column]:
    """Columns of output paths, nested where they share a beginning, in order of first appearance."""
    out = []
    for head in dict.fromkeys(p[0] for p, _ in pairs):
        own = [(p[1:], c) for p, c in pairs if p[0] == head]
        out.append((own[0][1] if own[0][0] == [] else F.struct(*_nested(own))).alias(head))
    return out


def missing_required(schema: T.StructType, config: Config) -> Column:
    """Array of the output paths of required fields without a value, if the policy is ``error``; else empty."""
    lost = [F.when(v.isNull(), F.lit(s.path)) for s, v in _values(schema, config) if s.required] if config.on_missing == "error" else []
    return F.filter(F.array(*lost), lambda x: x.isNotNull()) if lost else F.array().cast("array<string>")


def project_struct(df: DataFrame, config: Config, keep: tuple[str, ...] = ("candidate_id",)) -> DataFrame:
    """``keep``, the struct ``record`` (null for a record with an error) and ``error`` (null without one)."""
    cols = _nested([(s.path.split("."), v) for s, v in _values(df.schema, config)])
    if config.include_confidence:
        cols += [F.col("overall_confidence").alias("overall_confidence"), F.col("provenance").alias("provenance")]
    lost = missing_required(df.schema, config)
    error = F.when(F.size(lost) > 0, F.concat(F.lit("Required fields missing: "), F.array_join(lost, ", ")))
    return df.select(*keep, F.when(error.isNull(), F.struct(*cols)).alias("record"), error.alias("error"))


def project_json(df: DataFrame, config: Config, keep: tuple[str, ...] = ("candidate_id",)) -> DataFrame:
    """``keep`` and ``json``: the projected record, or ``{"candidate_id", "error"}``. With ``omit``, top keys without a value are left out; nested nulls stay."""
    typed = project_struct(df, config, keep)
    options = {"ignoreNullFields": "false"}
    kinds = typed.schema["record"].dataType
    parts = []
    for f in kinds.fields:
        value = F.to_json(F.struct(F.col(f"record.`{f.name}`").alias(f.name)), options)
        inner = F.substring(value, 2, 2**30)
        parts.append(F.when(F.col(f"record.`{f.name}`").isNotNull() if config.on_missing == "omit" else F.lit(True), F.regexp_replace(inner, r"\}$", "")))
    body = F.concat(F.lit("{"), F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), ","), F.lit("}"))
    failed = F.to_json(F.struct(*keep, "error"))
    return typed.select(*keep, F.when(F.col("error").isNull(), body).otherwise(failed).alias("json"))


_JSON_KINDS = {"string": ("STRING",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN"), "object": ("OBJECT",), "object[]": ("ARRAY",), "string[]": ("ARRAY",)}


def validation_errors(json_col: Column, config: Config) -> Column:
    """``array<struct<field, message>>`` of everything in a JSON record that its configuration doesn't allow. A broken record has one error."""
    v = F.try_parse_json(json_col)
    errors = []
    for s in config.fields:
        here = F.try_variant_get(v, f"$.{s.path}", "variant")
        kind = F.schema_of_variant(here)
        absent = here.isNull() | (kind == "VOID")
        keyed = here.isNotNull()
        err = lambda m, at=s.path: F.struct(F.lit(at).alias("field"), (m if isinstance(m, Column) else F.lit(m)).alias("message"))
        if s.required and config.on_missing == "error":
            errors.append(F.when(absent, err("required field is missing")))
        elif s.required and config.on_missing == "null":
            errors.append(F.when(~keyed, err("required key is absent")))
        elif not s.required and config.on_missing == "omit":
            errors.append(F.when(keyed & absent, err("key is present without a value")))
        if s.type in _JSON_KINDS:
            fits = F.lit(False)
            for k in _JSON_KINDS[s.type]:
                fits |= kind.startswith(k)
            errors.append(F.when(~absent & ~fits, err(F.concat(F.lit(f"expected {s.type}, got "), F.lower(F.regexp_extract(kind, "^[A-Z]+", 0))))))
        if s.type == "string[]":
            items = F.try_variant_get(v, f"$.{s.path}", "array<variant>")
            bad = F.array_position(F.transform(items, lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID")) != "STRING"), True)
            errors.append(F.when(bad > 0, F.struct(F.concat(F.lit(f"{s.path}["), (bad - 1).cast("string"), F.lit("]")).alias("field"), F.lit("expected string").alias("message"))))
    if config.include_confidence:
        conf = F.schema_of_variant(F.try_variant_get(v, "$.overall_confidence", "variant"))
        errors.append(F.when(conf.isNull(), F.struct(F.lit("overall_confidence").alias("field"), F.lit("is missing").alias("message"))))
        errors.append(F.when(conf.isNotNull() & ~conf.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.struct(F.lit("overall_confidence").alias("field"), F.lit("must be a number").alias("message"))))
        errors.append(F.when(F.try_variant_get(v, "$.provenance", "variant").isNull(), F.struct(F.lit("provenance").alias("field"), F.lit("is missing").alias("message"))))
    kind = "array<struct<field:string,message:string>>"
    broken = F.array(F.struct(F.lit("").alias("field"), F.lit("not a JSON object").alias("message"))).cast(kind)
    return F.when(v.isNull(), broken).otherwise(F.filter(F.array(*errors), lambda x: x.isNotNull()).cast(kind))


def error_text(e: Column) -> Column:
    return F.format_string("[%s] %s", e["field"], e["message"])


def confidence_band(c: Column) -> Column:
    """``high`` from 0.8, ``medium`` from 0.5, else ``low``."""
    return F.when(c >= 0.8, "high").when(c >= 0.5, "medium").otherwise("low")
