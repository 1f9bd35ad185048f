"""Ranked lexical search by NRA: sorted reads only, with a lower and an upper bound of every document's score.

Terms are runs of ASCII letters (lower-cased), digits and non-ASCII characters. A term in a document has the impact
w * ((10^9 * tf) div (1000 * tf + 12 * m)), with w = floor(1000 * ln((2N + 2) / (2 df + 1))) and the document's
m = 75 + (25 * n * N) div L; an item's score for a document is the sum of its terms' impacts, repeats included.

1. One pass counts every document's terms and writes them (`count_terms`); N, L and the document frequencies are
   aggregates of that table, counted in the task before they are shuffled. The items' terms get their weights by a join.
2. Items are met with all documents in parts (`grid`; items in blocks). Of `POSTINGS` postings or so at a time a part makes a list for
   each asked term, sorted by falling impact.
3. NRA by item: rounds read the lists further down, twice as far in each. A document's lower bound is the sum of what was read,
   its upper bound adds for each list that has not shown it the largest impact still unread there. Documents whose upper
   bound is below the k-th best lower bound (of this part and those before it) go. Reading goes on, in lists that some
   remaining document may still be in, until both bounds of all remaining documents are equal: then membership, ties and
   scores are settled. Each cell gives k rows an item; a ranking joins the cells.

Edge cases: null, empty and termless texts have no terms, are in no count and are never found. Items without terms, or none
of whose terms occur, have no rows. Items that share an id are one item whose terms add up; items without id are one
item without id. Every row of documents counts as a document of its own, repeated ids too; documents without id rank
behind others of the same score. Equal scores go by the smaller doc_id. Sums are 64-bit integers. Empty tables give no
rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, small, utf8_rows
from .decontaminate import words_of
from .grid import Best, meet

TOP = 20
#: Terms of the items in a block.
BLOCK_TERMS = 65_536
#: Postings of a part, and its documents at most.
POSTINGS, DOCUMENTS = 2_000_000, 16_384
#: Postings of each list that the first round reads.
DEPTH = 64
NO_ID, NO_ITEM = 2**63 - 1, -(2**63)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        ids, n, ends, terms, counts = [], [], [0], [], []
        for doc, utf8 in zip(batch.column("doc_id"), utf8_rows(batch, "text"), strict=True):
            words = words_of(utf8)
            if words:
                own = Counter(words)
                ids.append(doc.as_py())
                n.append(len(words))
                terms.extend(own)
                counts.extend(own.values())
                ends.append(len(terms))
        offsets = pa.array(ends, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(terms, pa.binary()), pa.array(counts, pa.int32()))]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])


def count_terms(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, terms, tfs of every document with a term, written once."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return scratch.cut(rows.mapInArrow(_counted, "doc_id long, n long, terms array<binary>, tfs array<int>"), "counts")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by term, added up over a stretch of the task's documents."""
    held, n = [], 0

    def added() -> pa.RecordBatch:
        found = pc.value_counts(pa.chunked_array(held))
        return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["term", "df"])

    for batch in batches:
        held.append(batch.column("terms").flatten())
        n += len(held[-1])
        if n >= POSTINGS:
            yield added()
            held, n = [], 0
    if held:
        yield added()


def weighted(counts: DataFrame, items: DataFrame, scratch: Scratch, item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, int, int]:
    """item_id, term, weight (w times the term's repeats in the item) of terms that occur; N and L."""
    totals = counts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    texts = items.select(F.coalesce(F.col(item_id).cast("long"), F.lit(NO_ITEM)).alias("doc_id"), F.col(item_text).cast("string").alias("text"))
    own = texts.mapInArrow(_counted, "doc_id long, n long, terms array<binary>, tfs array<int>")
    asked = own.select(F.col("doc_id").alias("item_id"), F.explode(F.arrays_zip("terms", "tfs")).alias("t")).groupBy("item_id", F.col("t.terms").alias("term")).agg(F.sum("t.tfs").alias("repeats"))
    df = counts.select("terms").mapInArrow(_frequencies, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    w = F.floor(1000 * F.log(F.lit(2.0 * totals["n"] + 2) / (2.0 * F.col("df") + 1))).cast("long")
    out = asked.join(df, "term").select("item_id", "term", (w * F.col("repeats")).alias("weight")).filter("weight > 0")
    return scratch.cut(out, "asked"), totals["n"], totals["l"]


def _search(documents: int, length: int, k: int, part: int, depth: int):
    def run(asked: pa.Table, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pc.unique(asked["term"].combine_chunks())
        items, of = np.unique(asked["item_id"].to_numpy(), return_inverse=True)
        terms, weights = pc.index_in(asked["term"].combine_chunks(), vocabulary).to_numpy(), asked["weight"].to_numpy()
        order = np.argsort(of, kind="stable")
        bounds = np.searchsorted(of[order], np.arange(len(items) + 1))
        best = Best(len(items), k)
        for ids, docs, which, impacts in _lists(rows, vocabulary, documents, length, part):
            starts = np.searchsorted(which, np.arange(len(vocabulary) + 1))
            for item in range(len(items)):
                mine = order[bounds[item] : bounds[item + 1]]
                lists = [(docs[a:b], impacts[a:b] * w) for t, w in zip(terms[mine], weights[mine], strict=True) for a, b in [starts[t : t + 2]] if b > a]
                if lists:
                    found, score = nra(lists, ids, k, int(best.low[item]) if best.full[item] else 1, depth)
                    best.offer(np.full(len(found), item), score, ids[found])
        names = ["item_id", "doc_id", "score"]
        yield pa.RecordBatch.from_arrays([pa.array(items[best.group]), pa.array(best.id), pa.array(best.score)], names=names)

    return run


def _lists(rows: Iterator[pa.RecordBatch], vocabulary: pa.Array, documents: int, length: int, part: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Parts of a cell's documents: their ids, and postings sorted by term and falling impact (document's place, term, impact before the weight)."""
    held, n, size = [], 0, 0
    for batch in rows:
        lists = batch.column("terms")
        term = pc.index_in(lists.flatten(), vocabulary)
        known = np.flatnonzero(term.is_valid().to_numpy(zero_copy_only=False))
        doc = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))[known]
        tf = batch.column("tfs").flatten().to_numpy()[known].astype(np.int64)
        # Bounds by document are Python's own integers: 25 * n * N may pass 64 bits.
        m = np.array([75 + 25 * x * documents // length for x in batch.column("n").to_pylist()], np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
        held.append((batch.column("doc_id").to_numpy(), doc + n, term.drop_null().to_numpy(), impact))
        n, size = n + batch.num_rows, size + len(known)
        if size >= POSTINGS or n >= part:
            yield _sorted(held)
            held, n, size = [], 0, 0
    if held:
        yield _sorted(held)


def _sorted(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    ids, docs, terms, impacts = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((docs, -impacts, terms))
    return ids, docs[order], terms[order], impacts[order]


def nra(lists: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, k: int, least: int, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the documents that may be among the k best and score `least` or more; both exact. lists: places and falling impacts.

    At most k places are returned unless more have the k-th score.
    """
    n, m = len(ids), len(lists)
    lower, unseen = np.zeros(n, np.int64), np.ones((m, n), bool)
    alive, at = np.arange(n), np.zeros(m, np.int64)
    needed = np.arange(m)
    while True:
        for j in needed:
            docs, impacts = lists[j]
            cut = slice(at[j], at[j] + depth)
            lower[docs[cut]] += impacts[cut]
            unseen[j, docs[cut]] = False
            at[j] = min(len(docs), at[j] + depth)
        # The most that a document can still get from each list; nothing from a list that was read to its end.
        left = np.array([lists[j][1][at[j]] if at[j] < len(lists[j][1]) else 0 for j in range(m)], np.int64)
        low = lower[alive]
        kth = max(least, int(np.partition(low, len(low) - k)[len(low) - k])) if len(low) >= k else least
        open_lists = np.flatnonzero(left)
        missing = unseen[np.ix_(open_lists, alive)]
        upper = low + (missing * left[open_lists][:, None]).sum(axis=0)
        stay = upper >= kth
        alive, missing = alive[stay], missing[:, stay]
        needed = open_lists[missing.any(axis=1)]
        if not len(needed):
            return alive, lower[alive]
        depth *= 2


def search(
    docs: DataFrame, items: DataFrame, scratch: Scratch, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    block_terms: int = BLOCK_TERMS, part: int = DOCUMENTS, depth: int = DEPTH,
) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of each item with the highest scores above 0."""
    counts = count_terms(docs, scratch, id_col, text_col)
    asked, documents, length = weighted(counts, items, scratch, item_id, item_text)
    rows = counts.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    found = meet(rows, asked, _search(documents, length, k, part, depth), "item_id long, doc_id long, score long", ["doc_id", "n"], ["item_id"], ["item_id", "term", "doc_id", "n"], block_terms)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id"))
    out = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.select(F.nullif("item_id", F.lit(NO_ITEM)).alias("item_id"), "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")
