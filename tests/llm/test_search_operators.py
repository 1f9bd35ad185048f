"""Hard negatives, nearest neighbours and ranked lexical search against brute force."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import hamming_ann, hard_negatives, lexical_search, queries
from lodestone.llm.common import Scratch
from lodestone.llm.grid import Best, meet

VECTORS = "vec_id long, embedding array<float>, label int, rank int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7) for r in rows], VECTORS)


def vectors(n: int, d: int = 8, seed: int = 1, repeat: int = 0) -> list:
    """n rows, of which the last `repeat` have one vector."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d))
    v[n - repeat :] = v[0]
    return [(k, [float(np.float32(x)) for x in v[k]], int(rng.integers(0, 4))) for k in range(n)]


def mined(rows, every: int, positives=5, negatives=3, low=50, high=95):
    used = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows]
    out = []
    for i, v, label in used:
        if i % every:
            continue
        score = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, kind) for j, w, kind in used if j != i]
        near = sorted(x for x in score if x[2] == label)[:positives]
        for s, j, _ in near:
            fits = sorted(x for x in score if x[2] != label and low * -s <= 100 * -x[0] <= high * -s)
            out += [(i, j, rank, n, -s, -t) for rank, (t, n, _) in enumerate(fits[:negatives], 1)]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize(("n", "repeat", "blocks"), [(300, 0, 65_536), (300, 120, 65_536), (260, 0, 7)])
def test_hard_negatives_brute_force(spark, monkeypatch, n, repeat, blocks):
    """Random vectors, a third of all rows with one vector (ties by id), and anchors in many blocks."""
    monkeypatch.setattr(hard_negatives.meet, "__defaults__", (blocks, 32))
    rows = vectors(n, repeat=repeat)
    got = hard_negatives.mine(table(spark, rows), F.col("vec_id") % 10 == 0, Scratch(spark, "test"))
    assert got.columns == COLUMNS
    want = mined(rows, 10)
    assert len(want) > 100 and sorted(tuple(r) for r in got.collect()) == want


def test_hard_negatives_edges(spark):
    """Nulls in any column, bad components, other lengths, zero vectors, few rows, negative scores, repeated anchors and no rows."""
    whole = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.75, 0.0], 2), (3, [0.5, 0.5], 2), (4, [0.0, 0.0], 1), (10, [0.0, -1.0], 3), (5, [0.0, 1.0], 3)]
    bad = [(None, [1.0, 0.0], 1), (6, None, 2), (7, [float("nan"), 0.0], 2), (8, [None, 0.5], 2), (9, [0.9, 0.0], None), (11, [0.9], 2), (12, [], 2), (13, [float("inf"), 0.0], 2)]
    got = lambda rows: sorted(tuple(r) for r in hard_negatives.mine(table(spark, rows), F.col("vec_id") % 10 == 0, Scratch(spark, "test")).collect())
    assert got(whole + bad) == mined(whole, 10) and mined(whole, 10)[0] == (0, 1, 1, 2, 65536, 49152)
    # The positive of score 0 has the window 0 to 0; that of anchor 10 scores below 0 and has none.
    assert (0, 4, 1, 5, 0, 0) in got(whole) and not [r for r in got(whole) if r[0] == 10]
    # A repeated anchor row is one anchor; a repeated other row counts twice.
    twice = got([*whole, whole[0], whole[2]])
    assert [r for r in twice if r[1] == 1] == [(0, 1, 1, 2, 65536, 49152), (0, 1, 2, 2, 65536, 49152), (0, 1, 3, 3, 65536, 32768)]
    assert got([]) == [] and got(whole[:1]) == []


def test_products_are_exact_or_refused():
    large = np.array([[2**40, 1]])
    with pytest.raises(OverflowError):
        hard_negatives.products(large, large)
    assert hard_negatives.products(np.array([[2**30, 1]]), np.array([[2**30, 1]])).tolist() == [[2**60 + 1]]


def nearest(rows, every: int, k: int = 10):
    out = []
    for i, v, _ in rows:
        if i % every == 0:
            found = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w, strict=True))), j) for j, w, _ in rows if j != i)[:k]
            out += [(i, rank, j, s) for rank, (s, j) in enumerate(found, 1)]
    return out


def recall(got, want) -> float:
    return len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) / len(want)


def test_nearest_neighbours_recall(spark):
    """4,000 rows of 32 components, learnt from a sample of 2,000: recall by brute force, and distances to the last bit or so."""
    rows = vectors(4000, 32, seed=3, repeat=300)
    got = [tuple(r) for r in hamming_ann.search(table(spark, rows), F.col("vec_id") % 100 == 0, sample=2000).collect()]
    want = nearest(rows, 100)
    assert len(got) == len(want) == 400 and recall(got, want) >= 0.9
    exact = {(q, i): s for q, _, i, s in want}
    assert all(abs(exact[q, i] - s) < 1e-12 for q, _, i, s in got if (q, i) in exact)
    for q in {r[0] for r in got}:
        own = sorted(r for r in got if r[0] == q)
        assert [r[1] for r in own] == list(range(1, 11)) and [(r[3], r[2]) for r in own] == sorted((r[3], r[2]) for r in own)


def test_given_table_recall(spark):
    """The registered query on the given table against brute force."""
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, list(r.embedding), 0) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = [tuple(r) for r in queries.op12_hamming_ann(spark, sf).select("query_id", "rank", "vec_id", "score").collect()]
    assert recall(got, nearest(rows, 100)) >= 0.9


def test_nearest_neighbours_edges(spark):
    whole = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], None), (2, [1.0, 0.0], 2), (3, [0.5, 0.5], 2), (100, [0.0, 2.0], 1)]
    bad = [(None, [1.0, 0.0], 1), (6, None, 2), (7, [float("nan"), 0.0], 2), (8, [None, 0.5], 2), (9, [0.0, 0.0], 1), (11, [0.9], 2), (12, [], 2), (200, [0.0, -0.0], 1)]
    got = lambda rows, k=10: sorted(tuple(r) for r in hamming_ann.search(table(spark, rows), F.col("vec_id") % 100 == 0, k).collect())
    assert got(whole + bad) == nearest(whole, 100)
    assert got(whole + bad, 2) == nearest(whole, 100, 2) and [r[2] for r in got(whole, 2) if r[0] == 0] == [1, 2]
    assert [r[2] for r in got([*whole, whole[0], whole[3]]) if r[0] == 0] == [1, 2, 3, 3, 100]
    assert got([]) == [] and got(whole[:1]) == [] and got(whole[1:4]) == []


def test_probing_meets_all_codes_within_the_radius():
    """Pigeonhole probing against a comparison of all codes."""
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 2**16, (3000, hamming_ann.PIECES)).astype(np.uint16)
    codes[:500] = codes[0] ^ (1 << rng.integers(0, 16, (500, hamming_ann.PIECES))).astype(np.uint16)
    asked = codes[:40]
    tables = [np.unique(codes[:, p], return_inverse=True) for p in range(hamming_ann.PIECES)]
    differ = np.bitwise_count(asked[:, None, :] ^ codes[None, :, :]).sum(axis=2)
    for radius in (0, 2, 3, 8, 25, 64):
        found = set(zip(*map(list, hamming_ann.probe(asked, tables, codes, np.full(40, radius))), strict=True))
        assert found == set(zip(*map(list, np.nonzero(differ <= radius)), strict=True))
    assert hamming_ann.shares(np.array([25, 2])).tolist() == [[6, 6, 5, 5], [0, 0, 0, -1]]


def ranked(docs, items, k=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    own = [(d if d is not None else 2**63 - 1, words(t)) for d, t in docs]
    own = [x for x in own if x[1]]
    n, total = len(own), sum(len(w) for _, w in own)
    df: dict = {}
    for _, w in own:
        for term in set(w):
            df[term] = df.get(term, 0) + 1
    out = []
    for item in sorted({i for i, _ in items}):
        terms = [x for i, t in items if i == item for x in words(t)]
        scores = []
        for d, w in own:
            m = 75 + 25 * len(w) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (1_000_000_000 * w.count(x) // (1000 * w.count(x) + 12 * m)) for x in terms if x in w)
            if s > 0:
                scores.append((-s, d))
        out += [(item, rank, d if d < 2**63 - 1 else None, -s) for rank, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return out


def searched(spark, docs, items, k=20, **more):
    left = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, n int, rank int")
    right = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, term string")
    return sorted((tuple(r) for r in lexical_search.search(left, right, Scratch(spark, "test"), k, **more).collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("block_terms", [65_536, 5])
def test_lexical_search_brute_force(spark, block_terms):
    """Zipf words, very long texts, equal scores beyond the last rank, lists that need several rounds, and small parts."""
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(f"W{x}" for x in rng.zipf(1.3, n) % 300)
    docs = [(k, text(int(rng.integers(1, 60)))) for k in range(400)] + [(1000 + k, "z5 z6 z7") for k in range(60)] + [(5000, text(60_000))]
    items = [(k, text(12)) for k in range(15)] + [(50, "z5 Z5 z6"), (51, "never-seen"), (52, "w1")]
    got = searched(spark, docs, items, block_terms=block_terms, part=40, depth=2)
    assert got == ranked(docs, items)
    assert [r[2] for r in got if r[0] == 50] == list(range(1000, 1020))


def test_lexical_search_edges(spark):
    docs = [(3, "Ähre-Äpfel x1"), (1, "Ähre x1"), (1, "Ähre x1"), (None, "Ähre x1"), (4, None), (5, ""), (6, " \t--"), (7, "x2"), (8, "x3 x4"), (9, "\x7fÄhre")]
    items = [(1, "Ähre"), (1, "x1"), (2, None), (3, ""), (4, "x1 X1"), (5, "ähre")]
    got = searched(spark, docs, items)
    assert got == ranked(docs, items) and [r[2] for r in got if r[0] == 4] == [1, 1, None, 3] and not [r for r in got if r[0] in (2, 3, 5)]
    assert [r[:3] for r in searched(spark, docs, [(None, "x2")])] == [(None, 1, 7)]
    assert searched(spark, [], items) == [] and searched(spark, docs, []) == [] and searched(spark, docs[4:7], items) == []


def test_nra_reads_no_more_than_it_needs():
    """A document that leads in all lists settles the first place without reading the long list to its end."""
    n = 10_000
    falling = np.arange(n, 0, -1, dtype=np.int64)
    lists = [(np.arange(n), falling * 5), (np.arange(n), falling)]
    reads = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice):
                reads.append(at.stop - at.start)
            return super().__getitem__(at)

    counted = [(d, s.view(Counted)) for d, s in lists]
    places, scores = lexical_search.nra(counted, np.arange(n), 1, 1)
    assert places.tolist() == [0] and scores.tolist() == [6 * n] and sum(reads) < n


def test_best_keeps_ties_by_id():
    best = Best(2, 2)
    best.offer(np.array([0, 0, 1]), np.array([5, 5, 1]), np.array([9, 8, 7]))
    best.offer(np.array([0, 0]), np.array([5, 4]), np.array([3, 1]))
    assert list(zip(best.group.tolist(), best.score.tolist(), best.id.tolist(), strict=True)) == [(0, 5, 3), (0, 5, 8), (1, 1, 7)]
    assert best.beats(np.array([0, 1]), np.array([[5, 5], [0, 0]]), np.array([7, 9])).tolist() == [[True, False], [True, True]]


def test_grid_meets_each_pair_once(spark):
    """Every query meets every row once, whatever the number of blocks."""
    import pyarrow as pa

    def kernel(asked, rows):
        for batch in rows:
            q, r = np.meshgrid(asked["q"].to_numpy(), batch.column("r").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(q.ravel()), pa.array(r.ravel())], names=["q", "r"])

    asked, rows = spark.range(30).withColumnRenamed("id", "q"), spark.range(500).withColumnRenamed("id", "r")
    for block in (4, 1000):
        got = meet(rows, asked, kernel, "q long, r long", ["r"], ["q"], ["q", "r"], block, 16)
        assert got.count() == got.distinct().count() == 15_000
