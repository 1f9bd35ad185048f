"""The whole scores by term rows against those by joins."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lodestone.operators import fieldscore, phrases, termrows
from lodestone.operators import interpret as ip
from lodestone.operators.fieldscore import Scored
from lodestone.operators.lexical import ranked

RULE = "rule long, form_ord int, form string, expand array<string>, domains array<string>, sections array<string>"


def scored(spark):
    rnd = random.Random(6)
    words = ["maja", "majandus", "majanduse", "ja", "on", "kool", "koolis", "õde", "12", "seaduse", "seadus", "korral", "pikk", "üür"]
    line = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    corpus = [(k, f"D_{k % 7}" if k % 3 else "kool", line(2) if k % 4 else None, [line(1), line(2)] if k % 5 else None, f"{line(rnd.randrange(0, 6))}. {line(rnd.randrange(0, 30))}", rnd.choice(["A", "B", None])) for k in range(150)] + [(900, "x", "", [], None, "A")]
    laws = spark.createDataFrame(corpus, "doc_id long, id string, title string, aliases array<string>, text string, domain string").repartition(4)
    queries = spark.createDataFrame([(k, line(rnd.randrange(1, 9))) for k in range(8)] + [(50, None), (51, "d 3 D_3 12")], "query_id long, text string")
    rules = spark.createDataFrame([(1, 0, "pikk", ["korral on", "seadus ja maja"], ["A"], []), (2, 0, "maja", ["koolis"], ["C"], [])], RULE)
    found = ip.interpret(queries, rules, ip.vocabulary(laws, "domain", "title", rules), spark.createDataFrame([], "id string"), "query_id", "text")
    return Scored(laws, queries, found, spark.createDataFrame([("uur", "kool"), ("maja", "ode")], "base string, related string"), spark.createDataFrame([("A", "kool"), ("B", "on m")], "domain string, keyword string"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_best_are_those_of_the_joins(spark, monkeypatch):
    """Both ways to find phrases, ids, titles, aliases, synonyms, domains without points, and documents without a domain."""
    s = scored(spark)
    new = [rows(ranked(s.best(9, 3, legacy), 9)) for legacy in (False, True)]
    monkeypatch.setattr(fieldscore, "SCANNED", 0)
    old = [rows(ranked(x.filter(F.col("score") >= 3), 9)) for x in (s.full().select("query_id", "doc_id", "score", "matched"), s.legacy())]
    assert new == old and len(new[0]) > 50
    monkeypatch.setattr(termrows, "MOST", 0)
    assert rows(ranked(scored(spark).best(9, 3, True), 9)) == old[1]


def test_phrases_in_texts_are_plain_substrings(spark):
    rnd = random.Random(9)
    words = ["ab", "a", "abc", "bcab", "c", "cab"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    docs = [(k, text(rnd.randrange(0, 40)) + rnd.choice(["", " ,", "!  C"])) for k in range(90)] + [(501, ""), (502, "õ ab  cab")]
    names = sorted({text(n) for n in (2, 2, 3, 3, 4) for _ in range(6)})
    df = spark.createDataFrame(docs, "doc_id long, body string")
    low = df.select("doc_id", F.concat(F.lower("body"), F.lit(" ")).alias("body"), F.lit(" ").alias("heading"))
    got = low.mapInArrow(termrows.phrases_in(spark.sparkContext.broadcast(names)), "doc_id long, phrase string, in_heading boolean")
    folded = df.select("doc_id", F.split(fieldscore.t.fold("body"), " ").alias("w"))
    want = phrases.occurrences(folded, "w", spark.createDataFrame([(p,) for p in names], "phrase string"))
    assert rows(got.select("doc_id", "phrase")) == rows(want) and want.count() > 100


def test_pairs_are_no_rows(spark, monkeypatch):
    """Nothing that grows with queries times documents is shuffled."""
    s = scored(spark)
    monkeypatch.setattr(Scored, "candidates", property(lambda self: 1 / 0), raising=False)
    assert s.best(3, 1, True).count() and s.best(3, 1).count()
