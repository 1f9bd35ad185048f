"""Hard-negative mining by slots: for each anchor and each of its positives, the best rows of other labels in a window of scores.

A row's score with an anchor is the inner product of their vectors in whole numbers. The window of a positive with score
s runs from low% to high% of s, both included, so windows of one anchor overlap.

1. Positives: the anchor's best rows of its own label (`grid`: anchors in blocks, all rows stream past them; each cell keeps the
   best by anchor, a ranking joins the cells).
2. The upper limits of an anchor's windows, each once and falling, split the scores into disjoint slots: slot j holds the
   scores up to limit j and above limit j + 1. A second pass over all rows of other labels keeps the best `negatives`
   of each slot in every cell, and nothing below the least lower limit of the slot's windows; a ranking joins the cells.
3. What a window can return from its upper limit downwards is the beginning of slot j, slot j + 1, and so on: the slots of an
   anchor, at most `positives` times `negatives` rows, are merged downwards once, and each positive takes the head of its
   suffix and leaves out what is below its lower limit.

Scores are exact: products are summed as doubles while no sum can pass 2^53, else as 64-bit integers; where these could
overflow an error is raised.

Edge cases: rows without id, label or vector, or with a component that is null or not finite, take no part, nor do vectors
of another length than the table's most frequent one. Equal scores go by the smaller id. An anchor never meets rows that
have its own id. Anchor rows that agree in id, label and vector are one anchor; such with one id but other label or vector
each have results of their own under that id. Other rows count as often as they occur. An anchor without positives, or
whose positives score below 0 (their windows are empty), has no rows. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch
from .grid import Best, matrix, meet, sound, usual_length

POSITIVES, NEGATIVES = 5, 3
#: Percent of the positive's score.
LOW, HIGH = 50, 95
SCALE = 256
#: Anchors that are multiplied with a slice of rows at once.
ANCHORS = 1024
FAR = 2**62


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers, exact."""
    largest = lambda m: max(-int(m.min(initial=0)), int(m.max(initial=0)))
    most = a.shape[1] * largest(a) * largest(b)
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    raise OverflowError("inner products exceed 64 bits")


def _positives(k: int):
    def run(asked: pa.Table, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors = asked["anchor_id"].to_numpy(), asked["label"].to_numpy(), matrix(asked["v"])
        best = Best(len(ids), k)
        for batch in rows:
            other, kinds, v = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), matrix(batch.column("v"))
            for label in np.unique(kinds):
                mine, cols = np.flatnonzero(labels == label), np.flatnonzero(kinds == label)
                for at in range(0, len(mine), ANCHORS):
                    a = mine[at : at + ANCHORS]
                    score = products(vectors[a], v[cols])
                    x, y = np.nonzero(best.beats(a, score, other[cols]) & (ids[a][:, None] != other[cols][None, :]))
                    best.offer(a[x], score[x, y], other[cols][y])
        yield _given(asked, best.group, best, "positive_id", "positive_score")

    return run


def _given(asked: pa.Table, anchor: np.ndarray, best: Best, name: str, score: str, **more: np.ndarray) -> pa.RecordBatch:
    columns = {"anchor_id": asked["anchor_id"].to_numpy()[anchor], "twin": asked["twin"].to_numpy()[anchor], **more, name: best.id, score: best.score}
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))


def _negatives(slots: int, k: int):
    def run(asked: pa.Table, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, vectors = asked["label"].to_numpy(), matrix(asked["v"])
        uppers, lows = (np.full((len(labels), slots + 1), fill) for fill in (-FAR, FAR))
        lists = asked["slots"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        x, y = np.repeat(np.arange(len(labels)), sizes), np.concatenate([np.arange(n) for n in sizes]) if len(sizes) else np.empty(0, int)
        flat = lists.flatten()
        uppers[x, y], lows[x, y] = flat.field("upper").to_numpy(), flat.field("lower").to_numpy()
        # A slot's windows end at its own upper limit or above; none of them reaches below its least lower limit.
        best = Best(len(labels) * slots, k)
        best.low[:] = lows[:, :slots].ravel()
        for batch in rows:
            other, kinds, v = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), matrix(batch.column("v"))
            for at in range(0, len(labels), ANCHORS):
                part = slice(at, at + ANCHORS)
                score = products(vectors[part], v)
                fits = (labels[part][:, None] != kinds[None, :]) & (score <= uppers[part, :1]) & (score >= lows[part, :slots].min(axis=1)[:, None])
                a, b = np.nonzero(fits)
                s, i = score[a, b], other[b]
                a += at
                slot = (uppers[a, :slots] >= s[:, None]).sum(axis=1) - 1
                group = a * slots + slot
                good = (s > best.low[group]) | ((s == best.low[group]) & (i < best.low_id[group]))
                best.offer(group[good], s[good], i[good])
        yield _given(asked, best.group // slots, best, "negative_id", "negative_score", slot=(best.group % slots).astype(np.int32))

    return run


def mine(
    rows: DataFrame, anchor: Column, scratch: Scratch, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
    id_col: str = "vec_id", label_col: str = "label", vector: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchor: which rows are anchors, over id_col."""
    is_anchor = F.coalesce(anchor, F.lit(False)).alias("is_anchor")
    good = rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & sound(vector))
    v = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v")
    used = good.filter(F.size(vector) == usual_length(good, vector)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), v, is_anchor)
    table = used.drop("is_anchor")
    twin = F.row_number().over(Window.partitionBy("anchor_id").orderBy("label", "v"))
    anchors = used.filter("is_anchor").select(F.col("vec_id").alias("anchor_id"), "label", "v").distinct().withColumn("twin", twin)
    anchors = scratch.cut(anchors, "anchors")

    def against(asked: DataFrame, kernel, schema: str) -> DataFrame:
        return meet(table, asked, kernel, schema, ["vec_id", "v"], ["anchor_id", "twin"], ["anchor_id", "twin", "vec_id", "label", "v"])

    key = ["anchor_id", "twin"]
    by_score = lambda name: [F.col(f"{name}_score").desc(), F.col(f"{name}_id")]
    place = lambda by, name: F.row_number().over(Window.partitionBy(*by).orderBy(*by_score(name)))
    near = against(anchors, _positives(positives), "anchor_id long, twin int, positive_id long, positive_score long")
    near = near.withColumn("place", place(key, "positive")).filter(F.col("place") <= positives).filter("positive_score >= 0")
    # The first pass over all rows is not made again for the second one and the merge.
    windows = scratch.cut(near, "positives").withColumn("upper", F.expr(f"({high} * positive_score) div 100")).withColumn("lower", F.expr(f"({low} * positive_score + 99) div 100"))
    limits = windows.groupBy(*key, "upper").agg(F.min("lower").alias("lower"))
    limits = limits.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("upper", "lower")), asc=False).alias("slots"))
    found = against(anchors.join(limits, key), _negatives(positives, negatives), "anchor_id long, twin int, slot int, negative_id long, negative_score long")
    found = found.withColumn("place", place([*key, "slot"], "negative")).filter(F.col("place") <= negatives)
    merged = found.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct((-F.col("negative_score")).alias("down"), F.col("negative_id").alias("id")))).alias("merged"))
    suffix = F.slice(F.filter("merged", lambda x: -x["down"] <= F.col("upper")), 1, negatives)
    out = windows.join(merged, key).select("anchor_id", "positive_id", "positive_score", F.posexplode(F.filter(suffix, lambda x: -x["down"] >= F.col("lower"))).alias("at", "negative"))
    return out.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("negative.id").alias("negative_id"), "positive_score", (-F.col("negative.down")).alias("negative_score"))
