"""Approximate nearest neighbours by multi-index hashing.

1. A bounded sample (`SAMPLE` rows, dealt by a hash of the id) learns the codes: centring, principal directions, and a
   rotation by iterative quantisation, so that the signs of the rotated directions are one bit each (at most 64). The sample also tells
   how many bits differ between vectors at a given distance: `reach` of them by distance, `radius` for the nearest ones.
2. All rows are indexed in parts (`grid`): a part is coded, its codes are split into `PIECES` substrings, and each
   substring has a table of its own from value to rows.
3. A query's substrings are compared with the values of each table. By the pigeonhole principle a code that differs in at
   most R bits differs, in one of the substrings, by no more than that one's share (shares add up to R - PIECES + 1), so
   probing the values within the shares meets every code within R. What is met within R is ranked by the distance of the
   original vectors; a row that several tables give counts once.
4. R is the query's own: all bits until it holds k rows, then the radius, and less once its k-th distance shows that
   nearer rows differ by fewer bits. Each part gives k rows a query; a ranking joins the parts.

No bucket or candidate list is capped, and a bucket that holds very many rows is spread over the parts.

Edge cases: rows without id or vector, with a component that is null or not finite, or all of whose components are zero, take
no part, nor do vectors of another length than the table's most frequent one. A query never meets rows that have its own
id. Query rows that agree in id and vector are one query; others with one id each have results under that id. Other rows
count as often as they occur; equal distances go by the smaller id. Fewer than k rows give all of them. Empty tables give
no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .grid import Best, matrix, meet, sound, usual_length

SAMPLE = 20_000
BITS, PIECES = 64, 4
#: Share of the sample's nearest rows, and of the pairs at a distance, that the radius reaches.
REACHED = 0.98
#: Rows of the first part that a cell indexes, and of later ones.
FIRST, PART = 1024, 16_384
QUERIES = 256
PAIRS = 65_536


@dataclass
class Codes:
    """What turns a vector into a code, and how far to look."""

    mean: np.ndarray
    turn: np.ndarray
    bits: int
    radius: int
    distances: np.ndarray
    reach: np.ndarray

    def pieces(self, v: np.ndarray) -> np.ndarray:
        """The substrings of each row's code: as many columns of 16 bits as there are pieces."""
        signs = (v - self.mean) @ self.turn > 0
        shares = np.array_split(np.arange(self.bits), PIECES)
        return np.stack([signs[:, s] @ (1 << np.arange(len(s))) for s in shares], axis=1).astype(np.uint16)

    def radii(self, best: Best) -> np.ndarray:
        """Of each query, by the distance of its k-th row so far."""
        near = self.reach[np.searchsorted(self.distances, -best.low).clip(max=len(self.reach) - 1)] if len(self.reach) else np.full(len(best.low), self.bits)
        return np.where(best.full, np.minimum(near, self.radius), self.bits)


def learn(sample: np.ndarray, k: int, rounds: int = 40, probes: int = 256) -> Codes:
    """Codes for the rows of a sample. Too small a sample to tell how far to look gives a radius that leaves nothing out."""
    n, d = sample.shape
    bits = min(BITS, d)
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, directions = np.linalg.eigh(centred.T @ centred)
    main = directions[:, ::-1][:, :bits]
    seen = centred @ main
    rng = np.random.default_rng(12)
    rotation = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(seen @ rotation > 0, 1.0, -1.0).T @ seen)
        rotation = (u @ w).T
    codes = Codes(mean, main @ rotation, bits, bits, np.empty(0), np.empty(0, int))
    if n < 4 * probes:
        return codes
    pieces = codes.pieces(sample)
    q = rng.choice(n, probes, replace=False)
    square = np.maximum(0, (sample[q] ** 2).sum(1)[:, None] + (sample**2).sum(1)[None, :] - 2 * sample[q] @ sample.T)
    square[np.arange(probes), q] = np.inf
    differ = np.zeros(square.shape, np.int16)
    for p in range(PIECES):
        differ += np.bitwise_count(pieces[q, p][:, None] ^ pieces[None, :, p])
    nearest = np.argpartition(square, k, axis=1)[:, :k]
    codes.radius = int(np.ceil(np.quantile(np.take_along_axis(differ, nearest, 1), REACHED)))
    # Pairs by distance, 500 or more in each class; what is nearer than the first class reaches as far as it.
    order = np.argsort(square, axis=None)[: square.size // 4]
    classes = np.array_split(order, max(1, min(200, len(order) // 500)))
    codes.distances = np.sqrt(square.ravel()[[c[-1] for c in classes]])
    codes.reach = np.maximum.accumulate([int(np.ceil(np.quantile(differ.ravel()[c], REACHED))) for c in classes])
    return codes


def shares(radius: np.ndarray) -> np.ndarray:
    """How many bits each substring may differ, a row for each radius; -1 is never."""
    left = radius - PIECES + 1
    return np.stack([np.maximum(-1, (left + PIECES - 1 - p) // PIECES) for p in range(PIECES)], axis=1)


def probe(asked: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]], pieces: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of all codes within each query's radius. tables: of each substring the values and which of them a row has."""
    most = shares(radius)
    met = np.zeros((len(asked), len(pieces)), bool)
    for p, (values, which) in enumerate(tables):
        near = np.bitwise_count(asked[:, p][:, None] ^ values[None, :]).astype(np.int16) <= most[:, p][:, None]
        met |= near[:, which]
    q, r = np.nonzero(met)
    differ = np.bitwise_count(asked[q] ^ pieces[r]).sum(axis=1, dtype=np.int64)
    within = differ <= radius[q]
    return q[within], r[within]


def _search(codes: Codes, k: int):
    def run(asked: pa.Table, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = asked["query_id"].to_numpy(), matrix(asked["v"])
        own = codes.pieces(vectors)
        best = Best(len(ids), k, np.float64)
        for names, v in _parts(rows):
            pieces = codes.pieces(v)
            tables = [np.unique(pieces[:, p], return_inverse=True) for p in range(PIECES)]
            radius = codes.radii(best)
            for at in range(0, len(ids), QUERIES):
                q, r = probe(own[at : at + QUERIES], tables, pieces, radius[at : at + QUERIES])
                q += at
                for first in range(0, len(q), PAIRS):
                    x, y = q[first : first + PAIRS], r[first : first + PAIRS]
                    score = -np.sqrt(((vectors[x] - v[y]) ** 2).sum(axis=1))
                    good = (ids[x] != names[y]) & ((score > best.low[x]) | ((score == best.low[x]) & (names[y] < best.low_id[x])))
                    best.offer(x[good], score[good], names[y[good]])
        columns = {"query_id": ids[best.group], "twin": asked["twin"].to_numpy()[best.group], "vec_id": best.id, "score": -best.score}
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))

    return run


def _parts(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a cell's rows, a part at a time."""
    held, n, size = [], 0, FIRST
    for batch in rows:
        held.append(batch)
        n += batch.num_rows
        if n >= size:
            yield _joined(held)
            held, n, size = [], 0, PART
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([b.column("vec_id").to_numpy() for b in held]), np.concatenate([matrix(b.column("v")) for b in held])


def search(rows: DataFrame, query: Column, k: int = 10, sample: int = SAMPLE, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (the Euclidean distance). query: which rows are queries, over id_col."""
    good = rows.filter(F.col(id_col).isNotNull() & sound(vector) & F.exists(vector, lambda x: x != 0))
    is_query = F.coalesce(query, F.lit(False)).alias("is_query")
    used = good.filter(F.size(vector) == usual_length(good, vector)).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), is_query)
    out = "query_id long, rank int, vec_id long, score double"
    n = used.count()
    if not n:
        return rows.sparkSession.createDataFrame([], out)
    # A share of the rows by hash: as many as asked for, give or take the luck of the hash.
    few = used.filter(F.pmod(F.xxhash64(F.lit("sample"), "vec_id", "v"), F.lit(2**40)) < int(2**40 * min(1.0, sample / n)))
    learnt = matrix(few.select("v").toArrow()["v"]) if n > 1 else np.empty((0, 0))
    codes = learn(learnt if len(learnt) else np.zeros((1, usual_length(used, "v"))), k)
    twin = F.row_number().over(Window.partitionBy("query_id").orderBy("v"))
    asked = used.filter("is_query").select(F.col("vec_id").alias("query_id"), "v").distinct().withColumn("twin", twin)
    found = meet(used.drop("is_query"), asked, _search(codes, k), "query_id long, twin int, vec_id long, score double", ["vec_id", "v"], ["query_id", "twin"], ["query_id", "twin", "vec_id", "v"])
    rank = F.row_number().over(Window.partitionBy("query_id", "twin").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
