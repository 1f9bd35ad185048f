"""Meeting of a query set with all rows in blocks, where neither side passes through the driver or one task.

The query set is cut into blocks of about `block` rows, the table into parts, and each pair of a block and a part is a
cell that one task works on: the cell's queries come first and are held, its rows stream past them. Rows are shuffled
once for each block of queries, queries once for each part. A kernel keeps what it needs by query and gives few rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 65_536
#: Rows of a slice that a kernel gets at once.
SLICE = 1024
Kernel = Callable[[pa.Table, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def meet(rows: DataFrame, asked: DataFrame, kernel: Kernel, schema: str, deal: list[str], block_by: list[str], order: list[str], block: int = BLOCK, slice_rows: int = SLICE) -> DataFrame:
    """What kernel(asked of the cell, its rows in slices) gives over all cells.

    Columns of both sides are told apart by name; a name that both have must have one type. Rows go to parts by the hash
    of `deal`, queries to blocks by that of `block_by`; both sides are sorted by `order` within a cell, so that a task that
    runs again meets them as before.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-asked.count() // block))
    parts = max(1, -(-tasks // blocks))
    cells = blocks * parts
    part, of = (F.pmod(F.xxhash64(F.lit(name), *cols), F.lit(n)) for name, cols, n in (("part", deal, parts), ("block", block_by, blocks)))
    right = rows.withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("side", F.lit(1))
    left = asked.withColumn("block", of).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("side", F.lit(0))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("cell", (F.col("block") * parts + F.col("part")).cast("long")).drop("block", "part")
    dealt = both.withColumn("to", F.element_at(F.lit(_keys(spark, cells)), (F.col("cell") + 1).cast("int"))).repartition(cells, "to").drop("to")
    return dealt.sortWithinPartitions("cell", "side", *order).mapInArrow(_run(kernel, slice_rows), schema)


def _keys(spark, n: int) -> list[int]:
    """A key for each of n cells, such that Spark's hash deals these keys to n different tasks."""
    found = spark.range(0, 24 * n + 64).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("task")).agg(F.min("id").alias("key")).collect()
    keys = {r["task"]: r["key"] for r in found}
    return [keys.get(k, -1 - k) for k in range(n)]


def _run(kernel: Kernel, size: int):
    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
        for batch in batches:
            mark = 2 * batch.column("cell").to_numpy() + batch.column("side").to_numpy()
            for first, end in pairwise([0, *(np.flatnonzero(np.diff(mark)) + 1), batch.num_rows]):
                for k in range(first, end, size):
                    yield int(mark[k] // 2), int(mark[k] % 2), batch.slice(k, min(size, end - k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cell in groupby(slices(batches), key=lambda x: x[0]):
            asked: list[pa.RecordBatch] = []
            first = next((held for _, side, held in cell if side or asked.append(held)), None)
            if asked and first is not None:
                yield from kernel(pa.Table.from_batches(asked).combine_chunks(), _rest(first, cell))

    return run


def _rest(first: pa.RecordBatch, cell) -> Iterator[pa.RecordBatch]:
    yield first
    for _, _, batch in cell:
        yield batch


def matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equally long lists as a matrix."""
    whole = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)


class Best:
    """The k best of each of many groups, by falling score, then rising id."""

    def __init__(self, groups: int, k: int, score=np.int64):
        self.k = k
        self.group, self.score, self.id = np.empty(0, np.int64), np.empty(0, score), np.empty(0, np.int64)
        #: What the last of a full group has; a score that equals low counts if its id is smaller.
        self.low = np.full(groups, np.iinfo(np.int64).min if score is np.int64 else -np.inf, score)
        self.low_id = np.full(groups, np.iinfo(np.int64).max)
        self.full = np.zeros(groups, bool)

    def beats(self, groups: slice | np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which scores (a row for each group, a column for each id) would be among the best."""
        low = self.low[groups][:, None]
        return (score > low) | ((score == low) & (ids[None, :] < self.low_id[groups][:, None]))

    def offer(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(group):
            return
        g, s, i = np.concatenate([self.group, group]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((i, -s, g))
        g, s, i = g[order], s[order], i[order]
        place = np.arange(len(g)) - np.searchsorted(g, g)
        kept = place < self.k
        self.group, self.score, self.id = g[kept], s[kept], i[kept]
        last = place == self.k - 1
        self.low[g[last]], self.low_id[g[last]], self.full[g[last]] = s[last], i[last], True


def usual_length(rows: DataFrame, vector: str) -> int:
    """The most frequent length of a vector column, of equally frequent ones the longest."""
    found = rows.groupBy(F.size(vector).alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.col("rows").desc(), F.col("n").desc()).first()
    return found["n"] if found else 0


def sound(vector: str):
    """Present, not empty, all components present and finite."""
    v = F.col(vector)
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
