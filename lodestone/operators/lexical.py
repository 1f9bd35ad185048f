"""Lexical scorers over the inverted index, in decimals, so that sums don't depend on order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from ..sources.staging import written
from . import index as ix
from .termrows import Batch, TermRows, asked_pairs

# Weights of the field-aware scorer.
BODY, BODY_STEM, HEADING, HEADING_STEM = 2.4, 1.7, 4.5, 3.2
IDF_CAP, PER_STEM, BOTH, LEAST_SCORE = 5, 7, 2, 6


def capped(weight: float, value: Column) -> Column:
    return F.lit(weight).cast("decimal(3,1)") * F.least(F.lit(IDF_CAP).cast(ix.SCORE), F.coalesce(value, F.lit(1).cast(ix.SCORE)))


def prepared(docs: DataFrame, queries: DataFrame, query_id: str, query_text: str, id_col: str = "doc_id", text_col: str = "text") -> Batch | DataFrame:
    """What a batch of queries can meet, written once in the shared folder for scorers that read it several times: term rows, or postings by beginning of a batch that is too large to broadcast."""
    asked = ix.query_terms(queries, query_id, query_text)
    if (pairs := asked_pairs(asked)) is None:
        return written(ix.by_start(ix.postings(docs, id_col, text_col, asked)), "postings")
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = TermRows(own, pairs.column("term").to_pylist(), F.col("text"), t.section_heading("text"))
    return Batch(rows, pairs, asked.schema["query_id"].dataType)


def hits(asked: DataFrame, starts: DataFrame, more: list[str] | None = None) -> DataFrame:
    """query_id, doc_id, term, start, first_of_stem, length, more columns of starts, and how the term matched: eb, eh exactly in body or heading, pb, ph by beginning.

    One equi-join on the beginning: shorter terms are their own beginning, and an exact match is a match by beginning too.
    """
    first = F.row_number().over(Window.partitionBy("query_id", "start").orderBy("term")) == 1
    own = asked.withColumn("start", t.stem_key(F.col("term"))).withColumn("first_of_stem", first)
    exact = F.get(F.filter("words", lambda w: w["term"] == F.col("term")), F.lit(0))
    long = F.length("term") >= t.STEM
    joined = starts.join(own, "start").withColumn("exact", exact)
    is_set = lambda c: F.coalesce(c, F.lit(False))
    return joined.select(
        "query_id", "doc_id", "term", "start", "first_of_stem", "length", is_set(F.col("exact.in_body")).alias("eb"), is_set(F.col("exact.in_heading")).alias("eh"),
        (long & F.col("in_body")).alias("pb"), (long & F.col("in_heading")).alias("ph"), *(more or []),
    )


def score(docs: DataFrame, queries: DataFrame, query_id: str, query_text: str, id_col: str = "doc_id", text_col: str = "text", starts: Batch | DataFrame | None = None, k: int | None = None, least: int = 0) -> DataFrame:
    """query_id, doc_id, score, matched: weighted matches by field and rarity, matched stems, length factor; from the score `least`, and with k no fewer than each query's k best."""
    asked = ix.query_terms(queries, query_id, query_text)
    starts = starts or prepared(docs, queries, query_id, query_text, id_col, text_col)
    if isinstance(starts, Batch):
        return starts.lexical((BODY, BODY_STEM, HEADING, HEADING_STEM), IDF_CAP, PER_STEM, BOTH, least, k)
    stats = ix.length_stats(docs, id_col, text_col).first()  # two numbers
    n_docs, average = F.lit(stats["n_docs"]), stats["avg_length"]
    words = starts.select(F.explode("words").alias("w")).filter("w.in_body").groupBy(F.col("w.term").alias("term")).agg(F.count(F.lit(1)).alias("df"))
    rarity = words.join(asked.select("term").distinct(), "term", "left_semi").select("term", ix.idf(n_docs, F.col("df")).alias("idf"))
    shares = starts.filter("in_body").groupBy("start").agg(F.count(F.lit(1)).alias("df")).select("start", ix.idf(n_docs, F.col("df")).alias("pidf"))
    # The rarity of its terms goes with the query, which is small, rather than with each match.
    rare = asked.join(rarity, "term", "left").withColumn("start", t.stem_key(F.col("term"))).join(shares, "start", "left").select("query_id", "term", "idf", "pidf")
    return combined(hits(asked, starts).join(rare, ["query_id", "term"]), average).filter(F.col("score") >= least)


def combined(scored: DataFrame, average: float, most: bool = False) -> DataFrame:
    """query_id, doc_id, score, matched of hits with their rarity (idf, pidf); average: tokens of a document.

    most: a term that matches exactly and by beginning counts by the larger of the two, as it may be several documents' hit.
    """
    zero = F.lit(0).cast(ix.SCORE)

    def field(exact: str, near: str, weight: float, stem_weight: float) -> Column:
        whole, begun = F.when(F.col(exact), capped(weight, F.col("idf"))), F.when(F.col(near), capped(stem_weight, F.col("pidf")))
        return F.coalesce(F.greatest(whole, begun) if most else F.coalesce(whole, begun), zero)

    body, heading = field("eb", "pb", BODY, BODY_STEM), field("eh", "ph", HEADING, HEADING_STEM)
    sums = scored.groupBy("query_id", "doc_id").agg(F.sum((body + heading).cast(ix.SCORE)).alias("raw"), F.count_if(F.col("first_of_stem") & (F.length("term") >= 3)).alias("matched"), F.max("length").alias("length"))
    factor = F.greatest(F.lit(0.65), F.least(F.lit(1.25), F.lit(1.1) / (F.lit(0.6) + F.lit(0.4) * F.col("length") / F.lit(average))))
    # Narrow types keep all nine decimals of the sum.
    whole = F.col("raw").cast("decimal(20,9)") + (PER_STEM * F.col("matched")).cast("decimal(10,0)") + F.when(F.col("matched") >= 2, BOTH).otherwise(0)
    return sums.select("query_id", "doc_id", F.round(whole.cast("decimal(22,9)") * F.round(factor, 9).cast("decimal(12,9)"), 6).cast("decimal(18,6)").alias("score"), "matched")


def legacy_score(docs: DataFrame, queries: DataFrame, query_id: str, query_text: str, id_col: str = "doc_id", text_col: str = "text", starts: Batch | DataFrame | None = None, k: int | None = None) -> DataFrame:
    """query_id, doc_id, score: min(3 * exact, 18) + min(2 * by beginning, 12); with k no fewer than each query's k best."""
    starts = starts or prepared(docs, queries, query_id, query_text, id_col, text_col)
    if isinstance(starts, Batch):
        return starts.legacy(k)
    found = hits(ix.query_terms(queries, query_id, query_text), starts)
    counts = found.groupBy("query_id", "doc_id").agg(F.count_if("eb").alias("exact"), F.count_if(F.col("pb") & ~F.col("eb")).alias("near"))
    points = F.least(3 * F.col("exact"), F.lit(18)) + F.least(2 * F.col("near"), F.lit(12))
    return counts.select("query_id", "doc_id", points.cast("decimal(18,6)").alias("score")).filter("score > 0")


def ranked(scores: DataFrame, most: int | None = None, by: str = "query_id", item: str = "doc_id", value: str = "score") -> DataFrame:
    """Adds rank by falling score, then item; with most, the best only (Spark prunes these before the shuffle)."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.col(value).desc(), F.col(item))))
    return out if most is None else out.filter(F.col("rank") <= most)
