"""Vector search: exact cosine top-k of a stated query set against all rows, in blocks.

The query set is broadcast in blocks of bounded size; every row is compared inside its own task, and each task keeps k
candidates a query before the shuffle, so what is shuffled is tasks * queries * k rows, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 4096
#: Rows that are compared with a block at once.
ROWS = 1024


def valid_vector(v: F.Column) -> F.Column:
    """Not empty, all elements present and finite."""
    return (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def cosine_topk(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", with_self: bool = False) -> DataFrame:
    """query_id, doc_id, score (6 decimals), rank. Invalid vectors and those of other dimensions are left out; a zero vector scores 0."""
    kept = rows.filter(valid_vector(F.col(vector))).select(F.col(id_col).cast("long").alias("doc_id"), F.col(vector).cast("array<double>").alias("v"))
    parts = []
    for block in _blocks(queries.filter(valid_vector(F.col(vector))).select(F.col(id_col).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v"))):
        shared = rows.sparkSession.sparkContext.broadcast(block)
        parts.append(kept.mapInArrow(_best(shared, k, with_self), "query_id long, doc_id long, score double"))
    if not parts:
        return rows.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    best = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of queries of one dimension each."""
    held: dict[int, tuple[list, list]] = {}
    for row in queries.toLocalIterator():
        ids, vectors = held.setdefault(len(row["v"]), ([], []))
        ids.append(row["q"])
        vectors.append(row["v"])
        if len(ids) == BLOCK:
            yield np.array(ids), _unit(np.array(vectors))
            del held[len(row["v"])]
    for ids, vectors in held.values():
        yield np.array(ids), _unit(np.array(vectors))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _best(shared, k: int, with_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, units = shared.value
        held: tuple | None = None
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            lists = batch.column("v")
            docs = batch.column("doc_id").to_numpy()
            lengths = np.diff(lists.offsets.to_numpy())  # flatten() follows a slice's offsets
            right = np.flatnonzero(lengths == units.shape[1])
            if not len(right):
                continue
            m = lists.flatten().to_numpy()[np.repeat(lengths == units.shape[1], lengths)].reshape(len(right), -1)
            score = np.round(units @ _unit(m).T, 6)
            if not with_self:
                score[ids[:, None] == docs[right][None, :]] = -np.inf
            names = np.broadcast_to(docs[right], score.shape)
            if held:
                score, names = np.concatenate([held[0], score], 1), np.concatenate([held[1], names], 1)
            order = np.lexsort((names, -score), axis=1)[:, :k]
            held = np.take_along_axis(score, order, 1), np.take_along_axis(names, order, 1)
        if held:
            q = np.repeat(ids, held[0].shape[1])
            real = np.isfinite(held[0].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(x[real]) for x in (q, held[1].ravel(), held[0].ravel())], names=["query_id", "doc_id", "score"])

    return run
