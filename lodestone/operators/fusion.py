"""Fusion and diversification of rankings: tables of (query_id, doc_id, rank)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K, DEPTH = 20, 200


def _stacked(rankings: list[DataFrame], extra) -> DataFrame:
    return reduce(DataFrame.unionByName, [r.select("query_id", "doc_id", "rank", extra(k).alias("x")) for k, r in enumerate(rankings)])


def rrf(rankings: list[DataFrame], weights: list[float], k: int = K) -> DataFrame:
    """query_id, doc_id, score, rank: sums of weight / (k + rank) over ranks up to DEPTH; weights of 0 are left out."""
    used = [(r, w) for r, w in zip(rankings, weights, strict=True) if w > 0]
    both = _stacked([r for r, _ in used], lambda i: F.lit(used[i][1])).filter(F.col("rank") <= DEPTH)
    part = (F.col("x") / (k + F.col("rank"))).cast("decimal(18,12)")
    sums = both.groupBy("query_id", "doc_id").agg(F.sum(part).cast("decimal(18,12)").alias("score"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")))


def round_robin(rankings: list[DataFrame], limit: int | None = None) -> DataFrame:
    """query_id, doc_id, rank: all first ranks in the order of the rankings, then all second; first occurrence counts."""
    first = _stacked(rankings, lambda k: F.lit(k)).groupBy("query_id", "doc_id").agg(F.min(F.struct("rank", "x")).alias("at"))
    out = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "doc_id"))).drop("at")
    return out if limit is None else out.filter(F.col("rank") <= limit)


def champions(lexical: DataFrame, dense: DataFrame, domains: DataFrame, depth: int) -> DataFrame:
    """query_id, doc_id, rank: the best dense hit of each domain that the lexical top supports with a matched stem.

    Queries with fewer than two such domains have none. domains: (doc_id, domain).
    """
    supported = lexical.filter((F.col("rank") <= depth) & (F.col("matched") >= 1)).join(domains, "doc_id").select("query_id", "domain").distinct()
    several = supported.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("query_id")
    hits = dense.join(domains, "doc_id").join(supported, ["query_id", "domain"], "left_semi").join(several, "query_id", "left_semi")
    best = hits.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "domain").orderBy("rank", "doc_id"))).filter("r = 1")
    return best.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id")).alias("rank"))


def reserve(fused: DataFrame, curated: DataFrame, slots: int) -> DataFrame:
    """The top slots, with a place for the best hit of each curated domain that they lack.

    fused: (query_id, doc_id, rank, domain, matched); curated: (query_id, domain). A missing domain's best hit with a
    matched stem takes a free slot or else that of the last hit of no curated domain; domains count in order of name.
    """
    marked = fused.join(curated.withColumn("curated", F.lit(True)), ["query_id", "domain"], "left").withColumn("curated", F.coalesce("curated", F.lit(False)))
    best = F.row_number().over(Window.partitionBy("query_id", "domain").orderBy("rank"))
    must = F.col("curated") & (F.col("matched") > 0) & (best == 1)
    placed = marked.withColumn("must", must).withColumn("turn", F.when(F.col("must"), 0).otherwise(1))
    pick = F.row_number().over(Window.partitionBy("query_id").orderBy("turn", "rank"))
    kept = placed.withColumn("pick", pick).filter(F.col("pick") <= slots)
    return kept.withColumn("slot", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).select("query_id", "doc_id", "slot", "domain", "must")
