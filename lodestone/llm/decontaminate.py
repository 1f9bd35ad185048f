"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A symbol is a word: a run of ASCII digits, ASCII letters (lower-cased) and non-ASCII characters. The patterns are the
windows of `window` consecutive words of each benchmark item; an item of fewer words, but not none, is one window.

Search, for patterns of one length m: a block is the last two words under the current position. The shift table gives
how far the position can move before that block could end a pattern's block; a block that no pattern holds moves it by
m - 1 words, so clean text is looked at about once in m words. Shift 0 means the block ends some pattern: the suffix
bucket of that block, divided by the patterns' first two words, lists the patterns to test, and a direct comparison of all m
words confirms. Items shorter than the
window have tables by their own length (a one-word pattern has a block of one word).

The tables are broadcast in blocks of at most `block_words` pattern words, whatever the benchmark's size; documents pass
once per block, and what earlier blocks found is carried in the row. Documents are never shuffled.

Edge cases: null or wordless texts have no words, no hits and are not contaminated. Wordless items never occur. An item
without id is reported under the empty id. Items that repeat an id count as one. Rows are judged one by one, so repeated
rows and repeated doc_ids each keep their own result. Other columns pass through unchanged, except that columns named
n_words, spans or items are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, small, utf8_rows

WINDOW = 13
BLOCK_WORDS = 500_000
#: Upper-case ASCII letters become lower-case; every other ASCII byte that is neither a digit nor a letter becomes a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(utf8: bytes) -> list[bytes]:
    # split(b" ") would keep empty strings; FOLD leaves no other white space than the space.
    return utf8.translate(FOLD).split()


class WuManber:
    """Tables for patterns of the same number of words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]], m: int):
        self.m, self.b = m, min(2, m)
        self.skip = m - self.b + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for p, ids in patterns.items():
            for end in range(self.b - 1, m):
                block = p[end - self.b + 1 : end + 1]
                self.shift[block] = min(self.shift.get(block, self.skip), m - 1 - end)
            self.bucket.setdefault(p[m - self.b :], {}).setdefault(p[: self.b], []).append((list(p), ids))

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(first word's position, items) of each occurrence, by position."""
        m, b, n, shift, bucket, skip = self.m, self.b, len(words), self.shift, self.bucket, self.skip
        at = m - 1
        while at < n:
            block = (words[at - 1], words[at]) if b == 2 else (words[at],)
            step = shift.get(block, skip)
            if step:
                at += step
                continue
            window = words[at - m + 1 : at + 1]
            for pattern, ids in bucket[block].get(tuple(window[:b]), ()):
                if pattern == window:
                    yield at - m + 1, ids
            at += 1


def tables(items: list[tuple[str, bytes]], window: int = WINDOW) -> list[WuManber]:
    """Search tables of (item id, text) pairs, one for each pattern length."""
    by: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for item, text in items:
        words = words_of(text)
        m = min(window, len(words))
        for k in range(len(words) - m + 1 if m else 0):
            ids = by.setdefault(m, {}).setdefault(tuple(words[k : k + m]), [])
            if item not in ids:
                ids.append(item)
    return [WuManber(patterns, m) for m, patterns in sorted(by.items())]


def search(words: list[bytes], machines: list[WuManber]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged [start, end) spans of hit words, and the items with windows that occur."""
    found, items = [], set()
    for machine in machines:
        for start, ids in machine.occurrences(words):
            found.append((start, start + machine.m))
            items.update(ids)
    return merged(found), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int, window: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's items in blocks of bounded size; one block at a time is on the driver."""
    block, n = [], 0
    for item, text in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("string")).toLocalIterator():
        words = words_of((text or "").encode())
        # A long item is cut into runs that share window - 1 words, so that each of its windows is in one of them.
        for k in range(0, max(1, len(words) - window + 1), block_words):
            own = words[k : k + block_words + window - 1]
            if block and n + len(own) > block_words:
                yield block
                block, n = [], 0
            block.append((item, b" ".join(own)))
            n += len(own)
    yield block


def _searcher(shared: Broadcast, window: int, text_col: str, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = tables(shared.value, window)
        for batch in small(batches):
            old = None if first else (batch.column("spans").to_pylist(), batch.column("items").to_pylist())
            counts, spans, items = [], [], []
            for k, utf8 in enumerate(utf8_rows(batch, text_col)):
                words = words_of(utf8)
                hit, names = search(words, machines)
                if old:
                    flat = old[0][k]
                    hit, names = merged(hit + list(zip(flat[::2], flat[1::2], strict=True))), names | set(old[1][k])
                counts.append(len(words))
                spans.append([x for span in hit for x in span])
                items.append(sorted(names))
            kept = [c for c in batch.schema.names if c not in ADDED]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))],
                names=[*kept, *ADDED],
            )

    return run


ADDED = ("n_words", "spans", "items")


def find_contamination(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with n_words, spans (word positions of hits: start, end, start, end, ...) and items (ids with occurring windows)."""
    out = docs.drop(*(c for c in ADDED if c != text_col))
    kept = [f for f in out.schema.fields if f.name not in ADDED]
    schema = T.StructType([*kept, T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])
    for k, block in enumerate(_blocks(benchmark, item_id, item_text, block_words, window)):
        if k:
            out = scratch.cut(out, "searched")
        shared = docs.sparkSession.sparkContext.broadcast(block)
        out = out.mapInArrow(_searcher(shared, window, text_col, not k), schema)
    return out


def judge(found: DataFrame, percent: int = 5) -> DataFrame:
    """Adds n_hit and contaminated: at least `percent` of the document's words are hit."""
    ends = F.aggregate(F.expr("filter(spans, (x, i) -> i % 2 = 1)"), F.lit(0).cast("long"), lambda a, x: a + x)
    starts = F.aggregate(F.expr("filter(spans, (x, i) -> i % 2 = 0)"), F.lit(0).cast("long"), lambda a, x: a + x)
    out = found.withColumn("n_hit", ends - starts)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))
