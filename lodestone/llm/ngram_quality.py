"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model trained on trusted text.

The model is over characters (`ORDER` of them) within a language: texts are lower-cased and runs of white space are one
space. Characters rather than words keep the n-grams that a stretch of text needs few, so that the count joins move a
small share of the input.

1. Trusted texts are split by a hash of their id: one half trains, the other gives the thresholds. Tasks count n-grams of
   their texts before the shuffle; lower orders are continuation counts of the next higher one. Discounts are estimated
   by language and order from the counts of counts; the empty context is the language's own, so each language has a model of its own.
2. The model is two sharded tables by 64-bit key: a discounted probability for each n-gram, a back-off weight for each
   context. They are never collected or broadcast.
3. Each block of texts (`ROWS` rows of a file that follow one another) lists the distinct keys of its texts. One join on the
   key fetches their values, which are written by block to the shared folder. The scoring pass reads the documents again, each block
   with its own values, so texts are never shuffled. A block is told by its file and row numbers, not by how a job splits
   its input, and a block without values is an error.
4. A document's perplexity is judged against the `QUANTILE` of its language's held-back trusted texts.

Edge cases: null and empty texts have one character, the end; no language is the language ''. A language without trusted texts has no
threshold and keeps all. Labels that are null, or of ids without a text, are not used. Rows that repeat a doc_id are
scored one by one. Without trusted texts every document is kept, with the perplexity of a uniform model. Docs that don't
come from files are written to the shared folder first. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as pads
import xxhash
from pyarrow import fs as arrow_fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small
from .near_dedup import mixed

ORDER = 4
QUANTILE = 0.99
#: The share of an unseen character, as one in so many.
CHARACTERS = 4096
BROADCAST_LABELS = 2_000_000
FLUSH = 2_000_000
#: Rows of a block.
ROWS = 8192
_rng = np.random.default_rng(77)
FACTORS = _rng.integers(1, 2**63, ORDER + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WHITE = re.compile(r"\s+")
END, BEGIN = 1, 2
#: No n-gram's key but by chance; its value is never used.
MARK = -(2**63)


@lru_cache(64)
def _alphabet(lang: str) -> np.ndarray:
    """Hashes of the basic plane's characters in a language."""
    return _salted(np.arange(1 << 16, dtype=np.uint64), lang)


def _salted(codes: np.ndarray, lang: str) -> np.ndarray:
    salt = np.uint64(xxhash.xxh64_intdigest(lang.encode()))
    return mixed(codes * np.uint64(0x9E3779B97F4A7C15) + mixed(np.array([salt]))[0])


def characters(text: str | None, lang: str | None) -> np.ndarray:
    """Hashes of the text's characters in its language, after ORDER - 1 begin marks and before an end mark."""
    plain = WHITE.sub(" ", (text or "").lower()).strip()
    codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), "<u4") + np.uint32(3)
    codes = np.concatenate([np.full(ORDER - 1, BEGIN, np.uint32), codes, np.full(1, END, np.uint32)])
    table = _alphabet(lang or "")
    return table.take(codes) if codes.max() < len(table) else _salted(codes.astype(np.uint64), lang or "")


#: Keys of a position: of its n-grams by falling order, and of their contexts.
COLUMNS = [f"g{n}" for n in range(ORDER, 0, -1)] + [f"c{n}" for n in range(ORDER - 1, -1, -1)]
WIDE = ", ".join(f"{c} long" for c in COLUMNS)


def keys_of(windows: np.ndarray, langs: np.ndarray) -> list[np.ndarray]:
    """COLUMNS of rows of ORDER characters, the last of which is the one that is predicted. langs: a number for the language of each row."""

    def key(mark: int, first: int, end: int) -> np.ndarray:
        out = np.full(len(windows), mark, np.uint64)
        for k in range(first, end):
            out += windows[:, k] * FACTORS[k - first]
        return out

    grams = [key(n, ORDER - n, ORDER) for n in range(ORDER, 0, -1)]
    # The empty context is the language's own.
    return [*grams, *(key(n + 100, ORDER - 1 - n, ORDER - 1) for n in range(ORDER - 1, 0, -1)), mixed(langs + np.uint64(100))]


class Grams:
    """The n-grams of some texts: the distinct windows, and for each position which of these it is."""

    def __init__(self, texts: list[np.ndarray]):
        chars = np.concatenate(texts)
        lengths = np.array([len(x) for x in texts])
        ends = np.cumsum(lengths)
        size = len(chars) - ORDER + 1
        top = np.zeros(size, np.uint64)
        for k in range(ORDER):
            top += chars[k : k + size] * FACTORS[k]
        inside = np.ones(size, bool)
        for k in range(1, ORDER):
            inside[ends[:-1] - k] = False  # windows that reach into the next text
        at = np.flatnonzero(inside)
        self.codes, uniques = pd.factorize(top[at].view(np.int64))
        first = np.empty(len(uniques), np.int64)
        first[self.codes[::-1]] = at[::-1]
        self.windows = np.lib.stride_tricks.sliding_window_view(chars, ORDER)[first]
        # Every text begins with its language's begin mark.
        self.langs = np.repeat(np.array([x[0] for x in texts], np.uint64), lengths)[first]
        self.counts = lengths - ORDER + 1  # scored positions of each text

    def keys(self) -> list[np.ndarray]:
        return keys_of(self.windows, self.langs)


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[object, Grams]]:
    """(block, n-grams) of a task's texts, some at a time; blocks are not mixed."""
    held, block, total = [], None, 0
    for batch in small(batches, 64):
        names = batch.column("block") if "block" in batch.schema.names else None
        for k, (text, lang) in enumerate(zip(batch.column("text"), batch.column("lang"), strict=True)):
            mine = names[k].as_py() if names is not None else None
            if held and (mine != block or total >= size):
                yield block, Grams(held)
                held, total = [], 0
            block = mine
            held.append(characters(text.as_py(), lang.as_py()))
            total += len(held[-1])
    if held:
        yield block, Grams(held)


def _train_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, grams in _gathered(batches, FLUSH):
        yield pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in grams.keys()), pa.array(np.bincount(grams.codes))], names=[*COLUMNS, "n"])


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict = {}
    for block, grams in _gathered(batches, FLUSH):
        new = pd.unique(np.concatenate(grams.keys()))
        old = seen.get(block)
        if old is not None:
            new = new[~np.isin(new, old)]
        seen = {block: new if old is None else np.concatenate([old, new])}
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(new), pa.string()), pa.array(new.view(np.int64))], names=["block", "key"])


def model_tables(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """key, value: of n-grams the discounted probability, of contexts the back-off weight. texts: (text, lang)."""
    top = texts.mapInArrow(_train_counts, f"{WIDE}, n long")
    first = lambda names: [F.first(c).alias(c) for c in names]
    level = scratch.cut(top.groupBy(f"g{ORDER}").agg(F.sum("n").alias("n"), *first([c for c in COLUMNS if c != f"g{ORDER}"])), "counts")
    out = None
    for n in range(ORDER, 0, -1):
        gram, context = f"g{n}", f"c{n - 1}"
        # Discounts by language, of which c0 is the key.
        kinds = level.groupBy(F.col("c0").alias("lang")).agg(*(F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)))
        kinds = scratch.cut(kinds.select("lang", *discounts()), f"discounts{n}")
        level = level.join(kinds, F.col("c0") == F.col("lang"))
        off = F.least(F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")), F.col("n"))
        level = level.withColumn("off", off).drop("lang", "d1", "d2", "d3")
        sums = level.groupBy(context).agg(F.sum("n").alias("total"), F.sum("off").alias("left"))
        values = level.join(sums, context).select(F.col(gram).alias("key"), ((F.col("n") - F.col("off")) / F.col("total")).alias("value"))
        weights = sums.select(F.col(context).alias("key"), (F.col("left") / F.col("total")).alias("value"))
        out = values.unionByName(weights) if out is None else out.unionByName(values).unionByName(weights)
        if n > 1:
            rest = [f"g{k}" for k in range(n - 2, 0, -1)] + [f"c{k}" for k in range(n - 2, -1, -1)]
            level = scratch.cut(level.groupBy(f"g{n - 1}").agg(F.count(F.lit(1)).alias("n"), *first(rest)), f"counts{n - 1}")
    return scratch.cut(out, "model")


def discounts() -> list:
    """Columns d1, d2, d3: the discounts of n-grams that occur once, twice and more, from the numbers n1 to n4 of n-grams that occur once to four times."""
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    out = []
    for k, plain in ((1, 0.5), (2, 0.75), (3, 0.9)):
        found = F.when(F.col(f"n{k}") > 0, k - (k + 1) * y * F.col(f"n{k + 1}") / F.nullif(F.col(f"n{k}"), F.lit(0))).otherwise(float(k))
        out.append(F.when((F.col("n1") == 0) | (F.col("n2") == 0), plain).otherwise(F.least(F.greatest(found, F.lit(0.05)), F.lit(k - 0.05))).alias(f"d{k}"))
    return out


def _score(root: str, floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, known = None, None
        for batch in small(batches, 256):
            names = batch.column("block").to_pylist()
            texts = [characters(t.as_py(), lang.as_py()) for t, lang in zip(batch.column("text"), batch.column("lang"), strict=True)]
            scores = np.empty(len(texts))
            cuts = [k for k in range(len(names)) if not k or names[k] != names[k - 1]]
            for start, end in zip(cuts, [*cuts[1:], len(names)], strict=True):
                if names[start] != block or known is None:
                    block, known = names[start], _values_of(root, names[start])
                scores[start:end] = perplexities(Grams(texts[start:end]), *known, floor)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(scores)], names=["doc_id", "lang", "perplexity"])

    return run


def _values_of(root: str, block: str) -> tuple[pd.Index, np.ndarray]:
    """The values that were fetched for a block; several tasks may have asked for a key."""
    system, base = arrow_fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
    path = f"{base}/block={block}"
    if system.get_file_info(path).type == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(f"no values were fetched for the texts of block {block}")
    table = pads.dataset(path, filesystem=system, format="parquet").to_table(columns=["key", "value"])
    keys, first = np.unique(table.column("key").to_numpy(), return_index=True)
    return pd.Index(keys), table.column("value").to_numpy()[first]


def perplexities(grams: Grams, keys: pd.Index, values: np.ndarray, floor: float) -> np.ndarray:
    """Of each text; a probability is worked out once for each distinct n-gram."""
    columns = grams.keys()
    found = [keys.get_indexer(c.view(np.int64)) if len(keys) else np.full(len(c), -1) for c in columns]
    take = lambda at, other: np.where(at >= 0, values[at], other) if len(values) else np.full(len(at), other)
    p = np.full(len(columns[0]), floor)
    for n in range(1, ORDER + 1):
        # A context that was never seen leaves all to the lower order.
        p = take(found[ORDER - n], 0.0) + take(found[ORDER + ORDER - n], 1.0) * p
    log = np.log(np.maximum(p, 1e-12))[grams.codes]
    starts = np.cumsum(grams.counts) - grams.counts
    return np.exp(-np.add.reduceat(log, starts) / grams.counts)


def judge(docs: DataFrame, labels: DataFrame, scratch: Scratch, quantile: float = QUANTILE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """doc_id, lang, perplexity, threshold and kept for every row of docs."""
    text, lang = F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang")
    split = F.md5(F.concat_ws("|", "_metadata.file_path", F.floor(F.col("_metadata.row_index") / ROWS))).alias("block")
    columns = [F.col(id_col).cast("long").alias("doc_id"), text, lang]
    try:
        rows = docs.select(split, *columns)
    except AnalysisException:
        rows = scratch.cut(docs.select(*columns), "docs").select(split, "doc_id", "text", "lang")

    trusted = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).alias("good")).filter("good > 0").select("doc_id")
    few = labels.select(id_col).limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))
    train = rows.join(F.broadcast(trusted) if few else trusted, "doc_id", "left_semi").filter(half == 0)
    model = model_tables(train.select("text", "lang"), scratch)

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    needed = rows.select("block", "text", "lang").mapInArrow(_needed, "block string, key long")
    root = scratch.path("values")
    # Every block has a row, even if none of its keys is in the model.
    blocks = rows.select("block").distinct().select("block", F.lit(MARK).alias("key"), F.lit(0.0).alias("value"))
    needed.join(model, "key").select("block", "key", "value").unionByName(blocks).repartition(tasks, "block").write.option("compression", "zstd").partitionBy("block").parquet(root)

    scores = scratch.cut(rows.mapInArrow(_score(root, 1 / CHARACTERS), "doc_id long, lang string, perplexity double"), "scores")
    bounds = scores.join(F.broadcast(trusted) if few else trusted, "doc_id", "left_semi").filter(half == 1).groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("threshold"))
    out = scores.join(bounds, "lang", "left")
    return out.select("doc_id", "lang", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))
