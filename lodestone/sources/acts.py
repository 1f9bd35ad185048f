"""Statute acts in XML as section rows: parsed in tasks over binary files, completed by built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t

SECTION_TAG, TITLE_TAG, MOST_BYTES = "paragrahv", "aktinimi", 20 << 20
ROWS = "path string, act_title string, number string, text string, error string"


def _local(tag: object) -> str:
    return str(tag).rsplit("}", 1)[-1].lower()


def parse(data: bytes) -> tuple[str, list[tuple[str, str]]]:
    """The act's title and (section number, text) pairs. Document types and entities are refused."""
    if len(data) > MOST_BYTES or re.search(rb"<!\s*(DOCTYPE|ENTITY)", data, re.I):
        raise ValueError("too large, or with a document type")
    root = ElementTree.fromstring(data)
    squeezed = lambda e: re.sub(r"\s+", " ", " ".join(e.itertext())).strip()
    title = next((squeezed(e) for e in root.iter() if _local(e.tag) == TITLE_TAG and len(squeezed(e)) > 2), "")
    sections = []
    for e in root.iter():
        if _local(e.tag) != SECTION_TAG:
            continue
        anchor = re.fullmatch(r"para(\d+(?:b\d+|[a-z])?)", e.get("id", ""), re.I)
        number = next((squeezed(x) for x in e.iter() if _local(x.tag) in ("number", "paragrahvnr")), "")
        raw = anchor[1] if anchor else (re.match(r"\d+", number) or re.match(r"§\s*(\d+)", squeezed(e)) or [""])[-1 if not number else 0]
        if raw:
            sections.append((raw, squeezed(e)))
    return title, sections


def read_acts(spark: SparkSession, path: str) -> DataFrame:
    """path, act_title, number, text, error: one row per section, or one with an error for a file that can't be parsed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    title, sections = parse(bytes(content))
                    rows += [(name, title, number, body, None) for number, body in sections]
                except (ValueError, ElementTree.ParseError) as e:
                    rows.append((name, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "act_title", "number", "text", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, ROWS)


def sections(acts: DataFrame, prefix: F.Column) -> DataFrame:
    """Records by act and canonical number: of repeated numbers the longest text; id, title, section, hash."""
    rows = acts.filter("error is null").withColumn("section", t.canonical_section("number")).filter("section is not null")
    longest = F.row_number().over(Window.partitionBy("path", "section").orderBy(F.length("text").desc(), "text"))
    kept = rows.withColumn("r", longest).filter("r = 1")
    return kept.select(
        F.concat_ws("_", F.upper(prefix), "section").alias("id"), F.col("act_title").alias("law_name"), "section", t.section_heading("text").alias("title"), "text", F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash")
    )
