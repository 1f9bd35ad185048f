"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

1. The lexicon is learned by Spark from all labelled texts of the training fold that fall into its first half: words and
   word beginnings counted once per text, summed by shuffle, and kept where they mark toxic texts. At most `lexicon_size`
   terms are kept; that bounds what is broadcast.
2. Dense features, in one pass over a text: densities of lexicon hits (plain, by beginning, after undoing look-alike
   characters), their distance to second-person words, capitals, punctuation and obfuscation rates.
3. Trees are boosted on the features of a bounded sample of the labelled rows of the second half: the `sample` rows with
   the smallest hash of their id. A quarter of the sample fits the calibration (pool adjacent violators).
4. Scoring is a map over whole texts; nothing is shuffled.

Only the text is an input of a score. Edge cases: null, empty and wordless texts have zero features and get the score that
the trees give to these. Labels that are null, or of ids without a text, are not used; an id with several labels counts
as toxic if one says so. Without labelled rows of both kinds in the training fold, every score is the share of toxic
labels (0 if there are none). Other columns pass through; columns named score or predicted are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

THRESHOLD = 0.3
SAMPLE = 20_000
LEXICON = 1_000
#: Labels up to this many rows (16 bytes each) are broadcast to the texts; more are joined by shuffle.
BROADCAST_LABELS = 2_000_000
MEMO = 300_000
#: Second-person words of English, German, French and Spanish.
YOU = frozenset("you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer eure sie ihnen tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros os su sus".split())
#: Look-alike characters and the letters they stand for.
ALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"})
EDGE = ".,;:!?\"'()[]{}<>«»„“”‘’…-–—*_~`#/\\"
BEGINNINGS = (4, 5, 6)
HIT, STEM, ALIKE_HIT, PERSON, CAPITALS, MASKED, LONG_RUN = 1, 2, 4, 8, 16, 32, 64
MIXED = re.compile(r"[^\W\d_][\d@$*!|#€][^\W\d_]|[^\W\d_][*#]{2,}|(?:[^\W\d_][._\-*]){3,}[^\W\d_]")
RUN = re.compile(r"(\w)\1\1\1|[!?]{3,}")
FEATURES = ("hits", "hit_share", "stem_share", "distinct_hits", "alike_hits", "near_you", "near_you_share", "you_share", "capital_words", "capital_letters", "exclamations", "questions", "punctuation", "masked", "runs", "log_words", "hit_spread")


def folded(word: str) -> str:
    return word.strip(EDGE).lower()


def unmasked(word: str) -> str:
    """The word with look-alike characters undone and everything but letters dropped."""
    return "".join(c for c in word.strip(EDGE.replace("!", "")).lower().translate(ALIKE) if c.isalpha())


#: A to Z.
CAPITAL_BYTES = bytes(range(65, 91))


class Features:
    """Dense features of texts, given a lexicon of words and of beginnings (marked by a final *)."""

    def __init__(self, lexicon: list[str]):
        self.words = {t for t in lexicon if t[-1] != "*"}
        self.stems = {t[:-1] for t in lexicon if t[-1] == "*"}
        self.memo: dict[str, int] = {}

    def _code(self, word: str) -> int:
        low = folded(word)
        code = HIT * (low in self.words) | STEM * any(low[:n] in self.stems for n in BEGINNINGS) | PERSON * (low in YOU)
        if MIXED.search(word):
            code |= MASKED
            clear = unmasked(word)
            if clear != low and (clear in self.words or any(clear[:n] in self.stems for n in BEGINNINGS)):
                code |= ALIKE_HIT
        if len(low) > 2 and low.upper() in word and low != low.upper():
            code |= CAPITALS
        if RUN.search(word):
            code |= LONG_RUN
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[word] = code
        return code

    def row(self, text: str) -> list[float]:
        words = text.split()
        n = len(words)
        if not n:
            return [0.0] * len(FEATURES)
        get, code = self.memo.get, self._code
        codes = np.fromiter((c if (c := get(w)) is not None else code(w) for w in words), np.uint8, n)
        hit = np.flatnonzero(codes & (HIT | STEM | ALIKE_HIT))
        you = np.flatnonzero(codes & PERSON)
        near, distinct = 0, 0
        if len(hit):
            distinct = len({folded(words[k]) for k in hit.tolist()})
            if len(you):
                at = np.searchsorted(you, hit)
                gap = np.minimum(np.abs(hit - you[np.maximum(at - 1, 0)]), np.abs(you[np.minimum(at, len(you) - 1)] - hit))
                near = int((gap <= 5).sum())
        count = lambda bit: int(np.count_nonzero(codes & bit))
        exclamations, questions, size = text.count("!"), text.count("?"), len(text)
        marks = exclamations + questions + text.count(",") + text.count(".") + text.count("*") + text.count("#")
        utf8 = text.encode()
        upper = len(utf8) - len(utf8.translate(None, CAPITAL_BYTES))
        return [
            float(len(hit)), len(hit) / n, count(STEM) / n, float(distinct), float(count(ALIKE_HIT)), float(near), near / n, len(you) / n, count(CAPITALS) / n,
            upper / size, exclamations / n, questions / n, marks / size, count(MASKED) / n, count(LONG_RUN) / n, math.log1p(n), (hit[-1] - hit[0]) / n if len(hit) else 0.0,
        ]


def terms(text: str) -> set[str]:
    """Words of a text and their beginnings, each once."""
    out = set()
    for low in set(map(folded, text.split())):
        if 2 < len(low) <= 24:
            out.add(low)
            out.update(low[:n] + "*" for n in BEGINNINGS if len(low) >= n)
    return out


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each term, clean and toxic; combined in the task before the shuffle."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush():
        both = list(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([counts[0][t] for t in both], pa.int64()), pa.array([counts[1][t] for t in both], pa.int64())], names=["term", "clean", "toxic"])
        for c in counts:
            c.clear()
        return out

    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic"), strict=True):
            counts[toxic.as_py()].update(terms(text.as_py() or ""))
        if sum(map(len, counts)) > 500_000:
            yield flush()
    yield flush()


class Trees:
    """Boosted regression trees on logistic loss over binned features, all in numpy."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: int = 8):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.cuts: list[np.ndarray] = []
        self.grown: list[list[tuple]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, m = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        margin = np.full(n, self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            node, tree = np.zeros(n, np.int64), []
            for level in range(self.depth):
                tree.append(self._splits(binned, node, grad, hess, 1 << level))
                feature, cut = tree[-1]
                node = 2 * node + (binned[np.arange(n), feature[node]] > cut[node])
            total = 1 << self.depth
            g, h = np.bincount(node, grad, total), np.bincount(node, hess, total)
            leaves = self.rate * g / (h + 1.0)
            margin += leaves[node]
            self.grown.append((tree, leaves))
        return self

    def _splits(self, binned, node, grad, hess, nodes):
        best, feature, cut = np.full(nodes, 1e-9), np.zeros(nodes, np.int64), np.full(nodes, self.bins + 1)
        for j in range(binned.shape[1]):
            at, size = node * (self.bins + 1) + binned[:, j], nodes * (self.bins + 1)
            g, h, c = (np.bincount(at, w, size).reshape(nodes, -1).cumsum(1) for w in (grad, hess, None))
            left = g**2 / (h + 1.0)
            right = (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1.0)
            gain = np.where((c >= self.least) & (c[:, -1:] - c >= self.least), left + right - (g[:, -1:] ** 2 / (h[:, -1:] + 1.0)), -1.0)
            k = gain.argmax(1)
            value = gain[np.arange(nodes), k]
            better = value > best
            best[better], feature[better], cut[better] = value[better], j, k[better]
        return feature, cut

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1)
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for tree, leaves in self.grown:
            node = np.zeros(len(x), np.int64)
            for feature, cut in tree:
                node = 2 * node + (binned[rows, feature[node]] > cut[node])
            out += leaves[node]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing least-squares fit (pool adjacent violators), joined by straight lines."""
    x, at = np.unique(x, return_inverse=True)
    weight = np.bincount(at).astype(float)
    mean = np.bincount(at, y) / weight
    blocks: list[list[float]] = []
    for k in range(len(x)):
        blocks.append([mean[k], weight[k], k, k])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            w = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / w, w, a[2], b[3]])
    ends = [(x[int(k)], v) for v, _, first, last in blocks for k in sorted({first, last})]
    return np.array([e[0] for e in ends]), np.array([e[1] for e in ends])


class Model:
    def __init__(self, lexicon: list[str], trees: Trees | None, points: tuple | None, share: float):
        self.lexicon, self.trees, self.points, self.share = lexicon, trees, points, share

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        margin = self.trees.margin(x)
        # A small share of the uncalibrated value orders the rows that calibration ties.
        return 0.98 * np.interp(margin, *self.points) + 0.02 / (1 + np.exp(-margin))


def fit_rows(x: np.ndarray, y: np.ndarray, lexicon: list[str]) -> Model:
    if not len(y) or y.min() == y.max():
        return Model(lexicon, None, None, float(y.mean()) if len(y) else 0.0)
    held = np.arange(len(y)) % 4 == 3
    if len(y) < 40 or y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
        held[:] = True
        trees = Trees().fit(x, y)
    else:
        trees = Trees().fit(x[~held], y[~held])
    return Model(lexicon, trees, isotonic(trees.margin(x[held]), y[held]), float(y.mean()))


def train(docs: DataFrame, labels: DataFrame, in_training: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, lexicon_size: int = LEXICON) -> Model:
    """A model from the labelled rows of docs for which in_training, a condition on id_col, holds."""
    spark = docs.sparkSession
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).filter(in_training).groupBy(id_col).agg((F.max(label_col) > 0).cast("int").alias("toxic"))
    texts = docs.filter(F.col(id_col).isNotNull()).filter(in_training).select(id_col, F.col(text_col).cast("string").alias("text"))
    few = labels.select(id_col).limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    rows = texts.join(F.broadcast(known) if few else known, id_col)
    # The id's hash splits the fold: one half for the lexicon, one for the trees.
    half = F.pmod(F.xxhash64(F.lit("half"), F.col(id_col).cast("string")), F.lit(2))

    totals = rows.filter(half == 0).groupBy().agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    clean, toxic = totals["n"] - totals["toxic"], totals["toxic"]
    lexicon: list[str] = []
    if clean and toxic:
        counts = rows.filter(half == 0).select("text", "toxic").mapInArrow(_count_terms, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
        marked = counts.filter(F.col("toxic") >= max(3, 0.004 * toxic)).withColumn("odds", odds).filter(F.col("odds") >= 2.5)
        lexicon = [r["term"] for r in marked.orderBy((F.col("odds") * F.sqrt("toxic")).desc(), "term").limit(lexicon_size).select("term").collect()]

    shared = spark.sparkContext.broadcast(lexicon)
    kept = rows.filter(half == 1).withColumn("order", F.xxhash64(F.lit("sample"), F.col(id_col).cast("string"))).select("order", "toxic", "text")
    features = kept.mapInArrow(_features(shared), T.StructType([T.StructField("order", T.LongType()), T.StructField("toxic", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))]))
    got = features.orderBy("order", "toxic").limit(sample).collect()
    x = np.array([r["x"] for r in got], float).reshape(len(got), len(FEATURES))
    return fit_rows(x, np.array([r["toxic"] for r in got], float), lexicon)


def _features(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(shared.value)
        for batch in batches:
            rows = [features.row(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], names=["order", "toxic", "x"])

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = None
        for batch in batches:
            features = features or Features(shared.value.lexicon)
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.string())
            x = np.array([features.row(t.as_py() or "") for t in texts], float).reshape(batch.num_rows, len(FEATURES))
            p = np.clip(shared.value.score(x), 0.0, 1.0)
            names = [f.name for f in fields]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())], names=[*names, "score", "predicted"])

    return docs.mapInArrow(run, schema)
