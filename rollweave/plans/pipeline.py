"""From sources to validated records."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollweave.functions.claims import empty_claims
from rollweave.operators.merge import Merged, merge
from rollweave.operators.project import Config, error_text, project_json, validation_errors
from rollweave.operators.resolve import resolve
from rollweave.session import cut
from rollweave.sources.files import ClaimSource, log

CONFIGS = os.path.join(os.path.dirname(os.path.dirname(__file__)), "configs")


def load_config(path: str | None = None) -> Config:
    """A configuration by path or by the name of a preset; the full one if there is no such file."""
    tries = [path, os.path.join(CONFIGS, f"{path}.json")] if path else []
    return Config.load(next((p for p in tries if p and os.path.isfile(p)), os.path.join(CONFIGS, "full.json")))


def list_configs(folder: str = CONFIGS) -> list[dict]:
    """Name, number of fields and policy of the configurations in a folder, by file name; ``error`` for one that can't be read."""
    out = []
    for name in sorted(f for f in os.listdir(folder) if f.endswith(".json")):
        try:
            c = Config.load(os.path.join(folder, name))
            out.append({"name": name[:-5], "fields": len(c.fields), "on_missing": c.on_missing, "include_confidence": c.include_confidence})
        except ValueError:
            out.append({"name": name[:-5], "error": "parse_failed"})
    return out


#: Endings of the files that each kind of source reads, and the folder below, if any, where they lie.
SAMPLES: dict[str, tuple[str, tuple[str, ...]]] = {"csv": ("", (".csv",)), "ats": ("", (".json",)), "github": ("", (".txt",)), "resumes": ("resumes", (".pdf", ".docx"))}


def list_samples(folder: str) -> dict[str, list[dict[str, str]]]:
    """``name`` and ``path`` of the source files in a folder, by kind of source and name; no kinds for a folder that isn't there."""
    out: dict[str, list[dict[str, str]]] = {}
    for kind, (below, endings) in SAMPLES.items() if os.path.isdir(folder) else ():
        here = os.path.join(folder, below) if below else folder
        names = sorted(os.listdir(here)) if os.path.isdir(here) else []
        out[kind] = [{"name": n, "path": os.path.join(here, n)} for n in names if n.endswith(endings)]
    return out


@dataclass
class Result:
    """Lazy tables of one run. ``records`` has ``candidate_id`` and ``json``."""

    claims: DataFrame
    merged: Merged | None
    records: DataFrame | None
    errors: DataFrame | None
    status: dict[str, str] = field(default_factory=dict)

    def summary(self) -> dict:
        """Counts of the run."""
        if self.merged is None:
            return {"claims": 0, "records": 0, "sources": self.status}
        m = self.merged
        count = lambda df: df.count()
        return {"claims": count(self.claims), "records": count(m.golden), "conflicts_found": count(m.conflicts), "rejections": count(m.rejections), "null_fields": count(m.null_fields), "validation_errors": count(self.errors), "sources": self.status}


def read_sources(spark: SparkSession, sources: list[tuple[str, ClaimSource, str]]) -> tuple[DataFrame, dict[str, str]]:
    """Claims of (name, source, path) in their order and the status of each: ``ok``, ``(empty/not found)`` or ``(error)``."""
    parts, status = [], {}
    for name, source, path in sources:
        try:
            df = source.read(spark, path)
            status[name] = "ok" if df.limit(1).count() else "(empty/not found)"
            parts.append(df)
        except Exception as e:  # noqa: BLE001 one source must not stop the others
            log.warning("source %s: %s", name, e)
            status[name] = "(error)"
    return reduce(DataFrame.unionByName, parts, empty_claims(spark)), status


def consolidate(claims: DataFrame, config: Config, as_of: int, status: dict[str, str] | None = None) -> Result:
    """Resolve, merge, project and validate claims. Without any claim there is nothing after them."""
    claims = cut(claims)
    if not claims.limit(1).count():
        return Result(claims, None, None, None, status or {})
    merged = merge(resolve(claims), as_of)
    records = project_json(merged.golden, config)
    errors = records.select("candidate_id", F.explode(validation_errors(F.col("json"), config)).alias("e")).select("candidate_id", error_text(F.col("e")).alias("error"))
    return Result(claims, merged, records, errors, status or {})


def run(spark: SparkSession, sources: list[tuple[str, ClaimSource, str]], config: Config | None = None, as_of: int = 2026 * 12 + 7) -> Result:
    """The whole pipeline over file sources. ``as_of`` is the month number (year * 12 + month) up to which open stints count."""
    claims, status = read_sources(spark, sources)
    return consolidate(claims, config or load_config(), as_of, status)


def write_json_array(records: DataFrame, path: str) -> None:
    """One JSON array in one local file, for small results; ``write_json_lines`` is the sink for large ones."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("[\n")
        for i, r in enumerate(records.select("json").toLocalIterator()):
            f.write((",\n" if i else "") + r["json"])
        f.write("\n]\n")


def write_json_lines(records: DataFrame, path: str) -> None:
    records.select("json").write.mode("overwrite").text(path)
