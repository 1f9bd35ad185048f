"""Evaluation and metrics: recall rollups, two percentile definitions, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges of a key's values in percentile().
CUTS = 200


def recall(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """query_id, n_expected, n_found, hit_any, hit_all over the top k; queries without truth are left out."""
    top = results.filter(F.col("rank") <= k).select("query_id", "doc_id").withColumn("got", F.lit(1))
    joined = truth.join(top, ["query_id", "doc_id"], "left")
    sums = joined.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_expected"), F.count("got").alias("n_found"))
    return sums.withColumns({"hit_any": F.col("n_found") > 0, "hit_all": F.col("n_found") == F.col("n_expected")})


def rollup(rows: DataFrame, sets: list[list[str]], passed: str) -> DataFrame:
    """Passed and total by each grouping set; a null outcome doesn't count. One pass (grouping sets), not one per set."""
    names = sorted({c for s in sets for c in s})
    groups = [[F.col(c) for c in s] for s in sets]
    return rows.groupingSets(groups, *names).agg(F.count_if(passed).alias("passed"), F.count(passed).alias("total"), F.grouping_id(*names).cast("long").alias("level"))


def percentile(rows: DataFrame, by: str, value: str, p: float, kind: str = "nearest") -> DataFrame:
    """by, percentile, n: an element of the sorted values. 'floor': position int((n - 1) * p); 'nearest': ceil(n * p) - 1.

    Approximate bounds cut each key's values into `CUTS` ranges; their counts say in which the position lies, and only that
    range is numbered, by distinct value. So no task sorts a key.
    """
    kept = rows.filter(F.col(value).isNotNull()).select(by, value)
    steps = [k / CUTS for k in range(1, CUTS)]
    bounds = kept.groupBy(by).agg(F.percentile_approx(value, steps, 10 * CUTS).alias("bounds"), F.count(F.lit(1)).alias("n"))
    at = F.floor((F.col("n") - 1) * p) + 1 if kind == "floor" else F.greatest(F.ceil(F.col("n") * p), F.lit(1))
    placed = kept.join(bounds.withColumn("at", at), by).withColumn("cut", F.size(F.filter("bounds", lambda x: x < F.col(value))))
    values = placed.groupBy(by, "cut", "n", "at", value).agg(F.count(F.lit(1)).alias("c"))
    cuts = placed.groupBy(by, "cut", "at").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy(by).orderBy("cut")) - F.col("c")
    found = cuts.withColumn("before", before).filter((F.col("before") < F.col("at")) & (F.col("at") <= F.col("before") + F.col("c"))).select(by, "cut", "before")
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(by, "cut").orderBy(value))
    inner = values.join(found, [by, "cut"]).withColumn("upto", upto)
    return inner.filter((F.col("upto") >= F.col("at")) & (F.col("upto") - F.col("c") < F.col("at"))).select(by, F.col(value).alias("percentile"), "n")


def last_n(rows: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The last n rows of each key, as a ring buffer keeps them."""
    return rows.withColumn("back", F.row_number().over(Window.partitionBy(by).orderBy(*(F.col(c).desc() for c in order)))).filter(F.col("back") <= n)


def counters(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
