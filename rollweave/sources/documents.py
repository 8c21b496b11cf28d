"""Résumés: text, files, and the answers of a language model about them."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollweave.functions.claims import empty_claims, shred
from rollweave.functions.normalize import norm_text
from rollweave.functions.text_fields import first_place, place_candidates
from rollweave.operators.resume import resume_fields, resume_lists
from rollweave.sources.answers import answer_lists, ask
from rollweave.sources.files import exists, log


def _texts(df: DataFrame, text: str, row: Column | None) -> DataFrame:
    src = df.select((F.monotonically_increasing_id() if row is None else row).cast("bigint").alias("doc"), F.col(text).alias("text"))
    return src.filter(F.trim("text") != "")


def text_claims(df: DataFrame, text: str, row: Column | None = None) -> DataFrame:
    """Claims of résumé texts, one a row; ``row`` numbers them, each number once. Null and blank texts give none."""
    fields, key, lists = resume_lists(resume_fields(_texts(df, text, row)))
    return shred(fields, key, F.col("doc"), lists, "resume_pdf")


def docx_text(data: bytes) -> str:
    """Paragraphs of a word-processor file that hold text, one a line."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    body = root.find(f"{w}body")
    paragraphs = ["".join(t.text or "" for t in p.iter(f"{w}t")) for p in (body.findall(f"{w}p") if body is not None else [])]
    return "\n".join(p for p in paragraphs if p.strip())


def pdf_text(data: bytes) -> str:
    """Text of the pages and their link targets, if the optional reader is installed."""
    import pdfplumber

    with pdfplumber.open(io.BytesIO(data)) as pdf:
        pages = [p.extract_text() or "" for p in pdf.pages]
        links = dict.fromkeys(h["uri"] for p in pdf.pages for h in p.hyperlinks if h.get("uri"))
    return "\n".join([*pages, *links])


def file_texts(spark: SparkSession, path: str) -> DataFrame:
    """``row`` (order of the file names) and ``text`` of the ``.pdf`` and ``.docx`` files of a file or folder."""
    files = spark.read.format("binaryFile").load(path).filter(F.lower("path").rlike(r"\.(pdf|docx)$")).orderBy("path").withColumn("row", F.monotonically_increasing_id()).select("row", "path", "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for p, data in zip(b["path"], b["content"], strict=True):
                try:
                    texts.append((docx_text if p.lower().endswith(".docx") else pdf_text)(data))
                except Exception as e:  # noqa: BLE001
                    log.warning("%s can't be read: %s", p, e)
                    texts.append(None)
            yield pd.DataFrame({"row": b["row"], "text": texts})

    return files.mapInPandas(read, "row bigint, text string")


class ResumeSource:
    def read(self, spark: SparkSession, path: str) -> DataFrame:
        return text_claims(file_texts(spark, path), "text", F.col("row")) if exists(spark, path) else empty_claims(spark)


def model_claims(df: DataFrame, text: str, model: Callable[[str], str], row: Column | None = None, prompt_chars: int | None = None) -> DataFrame:
    """Claims of what ``model`` (prompt -> answer) says of each text. A failing call or a broken answer gives none and a warning."""
    src = _texts(df, text, row)
    lines = F.filter(F.transform(F.split(norm_text(F.col("text")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    seen = src.withColumn("seen", first_place(place_candidates(lines), df.sparkSession))
    answers, key, lists = answer_lists(ask(seen, ["doc", "seen"], "text", model, prompt_chars), F.col("seen"), ("llm_extraction_qwen", 0.55))
    return shred(answers, key, F.col("doc"), lists, "resume_llm")
