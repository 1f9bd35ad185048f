"""Term rows against the postings' joins and the tokens' expressions, and what the rankings shuffle."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators import lexical, termrows
from lodestone.plans import queries

ODD = [
    "", " ", "a", "Äiti JA õde, ÕUN!", "naïve ﬁne ½ ligature", "x\x00y zz", "tab\tand\nline", "emoji 😀😀ok word", "ＦＵＬＬ ｗｉｄｔｈ", "´acute´ …dots", "Kelvin İstanbul straße", "кир illic mid́dle",
    "123 45 a1 b2", "endsä", "é", "퟿ab",
]


def corpus(n=160, seed=3):
    rnd = random.Random(seed)
    words = ["maja", "majandus", "majanduse", "ja", "on", "oo", "kool", "koolis", "kooliõde", "x1", "12", "seaduse", "seadus", "abc"]
    line = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    docs = [(k, f"{line(rnd.randrange(0, 5))}. {line(rnd.randrange(0, 40))}") for k in range(n)] + [(900, None), (901, "")]
    asked = [(k, line(rnd.randrange(1, 8))) for k in range(9)] + [(50, None), (51, "puudub")]
    return docs, asked


def frames(spark, docs, asked):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(5, "doc_id"), spark.createDataFrame(asked, "q long, text string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_bytes_fold_as_the_expression_does(spark):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(ODD)], "k int, x string").select("k", F.concat(F.lower("x"), F.lit(" ")).alias("low"), t.tokens("x").alias("tokens")).orderBy("k").collect()
    text, begin, length, number = termrows.words_of(pa.array([r.low for r in df], pa.string()))
    got = [[] for _ in df]
    for b, n, k in zip(begin, length, number, strict=True):
        got[k].append(text[b : b + n].tobytes().decode())
    assert got == [list(r.tokens) for r in df]


def test_scores_are_those_of_the_joins(spark, monkeypatch):
    """A batch that is too large to broadcast is scored by joins; both give the same rows."""
    docs, asked = frames(spark, *corpus())
    new = rows(lexical.score(docs, asked, "q", "text")), rows(lexical.legacy_score(docs, asked, "q", "text"))
    monkeypatch.setattr(termrows, "MOST", 0)
    assert new == (rows(lexical.score(docs, asked, "q", "text")), rows(lexical.legacy_score(docs, asked, "q", "text"))) and len(new[0]) > 500


def test_best_are_those_of_all(spark, monkeypatch):
    """Ties are cut by id, in a task, across tasks, and with queries in several blocks."""
    docs, asked = frames(spark, *corpus())
    for blocks in (False, True):
        if blocks:
            monkeypatch.setattr(termrows, "HELD", 8)
            monkeypatch.setattr(termrows, "CELLS", 20)
        starts = lexical.prepared(docs, asked, "q", "text")
        for whole, best in ((lexical.score(docs, asked, "q", "text", least=6), lexical.score(docs, asked, "q", "text", starts=starts, k=4, least=6)), (lexical.legacy_score(docs, asked, "q", "text"), lexical.legacy_score(docs, asked, "q", "text", starts=starts, k=4))):
            assert rows(lexical.ranked(best, 4)) == rows(lexical.ranked(whole, 4)) and best.count() < whole.count()


def test_repeated_queries_and_documents_count_once(spark):
    """The SQL takes distinct pairs of query and term; a document's rows are one document."""
    docs, asked = corpus(40)
    once = rows(lexical.score(*frames(spark, docs, asked), "q", "text"))
    assert rows(lexical.score(*frames(spark, docs, [*asked, *asked]), "q", "text")) == once
    cut = rows(lexical.score(*frames(spark, [(1, "maja kool"), (1, "seadus"), (None, "kool"), (None, "maja")], [(1, "maja seadus")]), "q", "text"))
    assert [(r[0], r[1], r[3]) for r in cut] == [(1, 1, 2), (1, None, 1)]


def test_other_ids_and_no_rows(spark):
    docs = spark.createDataFrame([("b", "maja"), ("a", "maja"), ("c", "kool")], "doc_id string, text string")
    asked = spark.createDataFrame([("x", "maja"), (None, "kool")], "q string, text string")
    best = lexical.ranked(lexical.score(docs, asked, "q", "text", k=1), 1)
    assert {(r.query_id, r.doc_id) for r in best.collect()} == {("x", "a"), (None, "c")}
    assert lexical.score(docs.limit(0), asked, "q", "text", k=1).count() == 0 and lexical.score(docs, asked.limit(0), "q", "text").count() == 0


@pytest.fixture
def shuffled(spark):
    """Runs f; bytes that it shuffled."""
    store = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    def run(f):
        before = store()
        f()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
        return store() - before

    return run


@pytest.mark.parametrize("name", ["lexical_topk", "rrf_two", "best_sentence", "coverage_report"])
def test_texts_and_pairs_are_not_shuffled(spark, shuffled, monkeypatch, name):
    """Large files are not dealt again; pairs of a query and a document stay in the task that scores them."""
    monkeypatch.setattr(queries, "DEALT_BYTES", 0, raising=False)
    size = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").agg(F.sum(F.length("text"))).first()[0]
    assert shuffled(lambda: queries.QUERIES[name](spark, "/root/testdata/sf0.01").count()) < size / 4
