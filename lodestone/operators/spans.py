"""Documents as spans with exact offsets, and facts found in them: UDTFs for what depends on the position before."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, LEAST = 1200, 400
# Patterns of dates, amounts and references.
DATE = re.compile(r"\b(?:[0-3]?\d[.][01]?\d[.](?:19|20)\d{2}|(?:19|20)\d{2}-[01]\d-[0-3]\d)\b")
AMOUNT = re.compile(r"\b\d{1,3}(?:[ .]\d{3})*(?:,\d{1,2})?\s?(?:€|eurot?|EUR)(?!\w)", re.I)
SENTENCE = re.compile(r"[^\n.!?]+(?:[.!?]|$)")


def cut(text: str, size: int = SIZE, least: int = LEAST) -> Iterator[tuple[int, int]]:
    """[start, end) of consecutive spans: up to size characters, ended at the last line end or '. ' after least; white space trimmed off."""
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            at = max(text.rfind("\n", start + least, end), text.rfind(". ", start + least, end))
            end = at + 1 if at > 0 else end
        a, b = start, end
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            yield a, b
        start = end


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, seq, start, end, text of each span; text is exactly the document's [start, end)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(doc, k, a, b, text[a:b]) for doc, text in zip(frame["doc_id"], frame["text"], strict=True) for k, (a, b) in enumerate(cut(text or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "seq", "start", "end", "text"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, "doc_id long, seq int, start int, end int, text string")


def facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kind (date or amount), value, start, end, sentence; equal values at the same place once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                text = text or ""
                found = [(kind, m) for kind, pattern in (("date", DATE), ("amount", AMOUNT)) for m in pattern.finditer(text)]
                ends = [m.span() for m in SENTENCE.finditer(text)] if found else []
                for kind, m in found:
                    inside = next(((a, b) for a, b in ends if a <= m.start() < b), m.span())
                    rows.append((doc, kind, m[0], m.start(), m.end(), text[inside[0] : inside[1]].strip()))
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "value", "start", "end", "sentence"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, "doc_id long, kind string, value string, start int, end int, sentence string")
