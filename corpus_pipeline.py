"""A training-text pipeline: five stages over documents, each on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Null and empty texts, repeated rows and empty tables are
handled as the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, exact_dedup, near_dedup, sentencepieces, toxicity
from lodestone.llm.common import Scratch, read
from lodestone.llm.queries import PIECES, crc_fold


def _hidden(docs: DataFrame) -> DataFrame:
    """docs under working names, which no operator's own columns can clash with."""
    return docs.toDF(*(f"input{k}" for k in range(len(docs.columns))))


def _shown(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs under their own names."""
    return found.select(*(F.col(f"input{k}").alias(name) for k, name in enumerate(docs.columns)))


def _name(docs: DataFrame, column: str) -> str:
    return f"input{docs.columns.index(column)}"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), crc_fold(4) != 2)
    return _shown(toxicity.score(_hidden(docs), model, _name(docs, "text")).filter("predicted = 0"), docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id stays."""
    return exact_dedup.drop_duplicates(docs, Scratch(spark, "copies"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, the document with the smallest doc_id stays."""
    return near_dedup.drop_near_duplicates(docs, Scratch(spark, "near"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words benchmark windows cover a twentieth or more go."""
    found = decontaminate.find_contamination(_hidden(docs), read(spark, sf_dir, "benchmark"), Scratch(spark, "benchmark"), _name(docs, "text"))
    return _shown(decontaminate.judge(found).filter("not contaminated"), docs)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as SentencePiece ids, and the text that these decode to."""
    coded = sentencepieces.decode(sentencepieces.encode(docs.select("doc_id", "text", "lang", "source"), PIECES).drop("text"), PIECES)
    return coded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode_and_decode),
]

#: SQL can express neither the trained model nor the encoding; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
