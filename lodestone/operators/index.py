"""Inverted index of a corpus as tables: postings by term and by five-character beginning, document frequencies, lengths.

All are aggregates by term with map-side combine; nothing about the corpus is collected. A document's terms come from its
body and from its heading, and each posting says which.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

SCORE = "decimal(28,9)"


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", asked: DataFrame | None = None, body: F.Column | None = None, heading: F.Column | None = None) -> DataFrame:
    """doc_id, term, in_body, in_heading, tf, length for each distinct token of a document.

    With asked (a column term), only terms that begin as one of its terms: the others go before anything is shuffled.
    body and heading are the tokens, where they are not the text's own.
    """
    body = t.tokens(text_col) if body is None else body
    heading = t.tokens(t.section_heading(text_col)) if heading is None else heading
    both = docs.select(F.col(id_col).alias("doc_id"), body.alias("body"), heading.alias("heading"))
    both = both.withColumn("length", F.size("body").cast("long"))
    body = both.select("doc_id", "length", F.explode("body").alias("term"), F.lit(1).alias("b"), F.lit(0).alias("h"))
    heading = both.select("doc_id", "length", F.explode("heading").alias("term"), F.lit(0).alias("b"), F.lit(1).alias("h"))
    rows = body.unionByName(heading)
    if asked is not None:
        starts = asked.select(t.stem_key(F.col("term")).alias("start")).distinct()
        rows = rows.join(starts, t.stem_key(rows["term"]) == starts["start"], "left_semi")
    return rows.groupBy("doc_id", "term").agg((F.max("b") == 1).alias("in_body"), (F.max("h") == 1).alias("in_heading"), F.sum("b").alias("tf"), F.max("length").alias("length"))


def prefix_postings(terms: DataFrame) -> DataFrame:
    """As postings(), by the first five characters of tokens with five or more."""
    long = terms.filter(F.length("term") >= t.STEM).select("doc_id", t.stem_key(F.col("term")).alias("term"), "in_body", "in_heading", "tf", "length")
    return long.groupBy("doc_id", "term").agg(F.max("in_body").alias("in_body"), F.max("in_heading").alias("in_heading"), F.sum("tf").alias("tf"), F.max("length").alias("length"))


def by_start(terms: DataFrame) -> DataFrame:
    """doc_id, start, words, in_body, in_heading, length: a document's terms that begin alike, in one row."""
    word = F.struct("term", "in_body", "in_heading")
    return terms.groupBy("doc_id", t.stem_key(F.col("term")).alias("start")).agg(F.collect_list(word).alias("words"), F.max("in_body").alias("in_body"), F.max("in_heading").alias("in_heading"), F.max("length").alias("length"))


def doc_frequency(terms: DataFrame) -> DataFrame:
    """term, df over bodies."""
    return terms.filter("in_body").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(n: F.Column, df: F.Column) -> F.Column:
    """ln((N + 1) / (df + 1)) + 1, rounded so that engines agree."""
    return F.round(F.log((n + 1) / (df + 1)) + 1, 9).cast(SCORE)


def lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.size(t.tokens(text_col)).cast("long").alias("length"))


def length_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: documents and average tokens, each at least 1."""
    return lengths(docs, id_col, text_col).agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n_docs"), F.greatest(F.lit(1.0), F.coalesce(F.avg("length"), F.lit(0.0))).alias("avg_length"))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """query_id, term: distinct content tokens."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(F.array_distinct(t.content_tokens(text_col))).alias("term"))


def matches(terms: DataFrame, prefixes: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, doc_id, term, the document's length and how it matched: exact or by beginning, in body or heading.

    Equi-joins on the term and on its first five characters, combined by (query, document, term).
    """
    no = F.lit(False)
    exact = asked.join(terms, "term").select("query_id", "doc_id", "term", "length", F.col("in_body").alias("eb"), F.col("in_heading").alias("eh"), no.alias("pb"), no.alias("ph"))
    long = asked.filter(F.length("term") >= t.STEM).withColumn("prefix", t.stem_key(F.col("term")))
    near = long.join(prefixes.withColumnRenamed("term", "prefix"), "prefix").select("query_id", "doc_id", "term", "length", no.alias("eb"), no.alias("eh"), F.col("in_body").alias("pb"), F.col("in_heading").alias("ph"))
    return exact.unionByName(near).groupBy("query_id", "doc_id", "term").agg(*(F.max(c).alias(c) for c in ("eb", "eh", "pb", "ph", "length")))


def matched_stems(found: DataFrame) -> DataFrame:
    """query_id, doc_id, matched: distinct stems of query terms (three characters or more) that match."""
    return found.filter(F.length("term") >= 3).groupBy("query_id", "doc_id").agg(F.count_distinct(t.stem_key(F.col("term"))).alias("matched"))
