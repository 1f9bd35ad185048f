"""Operators on single texts and equal texts: brute force, exact round trips, held-out accuracy and edge cases."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, exact_dedup, sentencepieces, toxicity
from lodestone.llm.common import Scratch

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, digest string, n_words long, kept boolean"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, True) for i, t in rows], DOCS)


def test_exact_dedup_edges(spark):
    rows = [(5, "a  b"), (3, "a\tb"), (3, "a b"), (None, "a b"), (7, None), (6, ""), (None, "alone"), (9, "A b"), (4, " a b")]
    got = exact_dedup.decisions(docs_of(spark, rows), Scratch(spark, "t")).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.text_sha256): r for r in got}
    ab = hashlib.sha256(b"a b").hexdigest()
    assert (by[5, ab].keep_id, by[5, ab].group_size, by[5, ab].kept) == (3, 4, False)
    assert by[3, ab].kept and not by[None, ab].kept
    empty = hashlib.sha256(b"").hexdigest()
    assert (by[7, empty].keep_id, by[7, empty].kept) == (6, False)
    alone = by[None, hashlib.sha256(b"alone").hexdigest()]
    assert alone.keep_id is None and alone.kept
    left = exact_dedup.drop_duplicates(docs_of(spark, rows), Scratch(spark, "t"))
    assert left.columns == docs_of(spark, rows).columns
    assert sorted((str(r.doc_id), r.text) for r in left.select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("text")).collect()) == sorted([("3", "a b"), ("6", ""), ("None", "alone"), ("9", "A b"), ("4", " a b")])


def test_exact_dedup_empty_and_hot(spark):
    assert exact_dedup.decisions(docs_of(spark, []), Scratch(spark, "t")).count() == 0
    rows = [(i, "hot" if i % 3 else f"t{i % 60}") for i in range(3000)]
    got = {r.doc_id: r for r in exact_dedup.decisions(docs_of(spark, rows), Scratch(spark, "t"), support=0.01).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    assert all(got[i].keep_id == min(groups[t]) and got[i].group_size == len(groups[t]) for i, t in rows)
    left = exact_dedup.drop_duplicates(docs_of(spark, [*rows, (1, "hot"), (None, "hot"), (None, "t0")]), Scratch(spark, "t"), support=0.01)
    assert sorted((r.doc_id, r.text) for r in left.collect()) == sorted((min(ids), t) for t, ids in groups.items())


def test_wu_manber_against_brute_force():
    rnd = random.Random(4)
    for _ in range(300):
        alphabet = "abc"[: rnd.randint(1, 3)]
        word = lambda: rnd.choice(alphabet)
        items = [(str(k), " ".join(word() for _ in range(rnd.randint(0, 8))).encode()) for k in range(rnd.randint(0, 5))]
        words = [word().encode() for _ in range(rnd.randint(0, 40))]
        spans, found = decontaminate.search(words, decontaminate.tables(items, window=4))
        hit, names = set(), set()
        for name, text in items:
            w = text.split()
            m = min(4, len(w))
            for k in range(len(w) - m + 1 if m else 0):
                for p in range(len(words) - m + 1):
                    if words[p : p + m] == w[k : k + m]:
                        hit.update(range(p, p + m))
                        names.add(name)
        assert {x for a, b in spans for x in range(a, b)} == hit and found == names
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_decontamination_rows_blocks_and_edges(spark):
    bench = spark.createDataFrame([(1, "Alpha beta, GAMMA delta"), (2, None), (None, "né"), (3, "--"), (2, "omega psi")], "item_id long, text string")
    rows = [(1, "xx alpha BETA gamma-delta yy"), (2, None), (3, ""), (3, "NÉ né omega psi"), (4, "z " * 5000 + "omega psi")]
    for block in (1, 1000):
        found = decontaminate.judge(decontaminate.find_contamination(docs_of(spark, rows), bench, Scratch(spark, "t"), window=3, block_words=block))
        got = {(r.doc_id, r.text): (r.n_words, r.n_hit, r["items"], r.contaminated) for r in found.collect()}
        assert got[rows[0]] == (6, 4, ["1"], True)
        assert got[rows[1]] == got[rows[2]] == (0, 0, [], False)
        assert got[rows[3]] == (4, 3, ["", "2"], True)
        assert got[rows[4]] == (5002, 2, ["2"], False)
    nothing = spark.createDataFrame([], bench.schema)
    assert decontaminate.judge(decontaminate.find_contamination(docs_of(spark, rows), nothing, Scratch(spark, "t"))).filter("n_hit > 0").count() == 0


@pytest.fixture(scope="module")
def coder():
    model = sentencepieces.model_tables(MODEL)
    return sentencepieces.Encoder(model), sentencepieces.Decoder(model), sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abcdeinorst ▁éß.,\n!", max_size=80)))
def test_encoding_equals_the_library(coder, text):
    encoder, decoder, library = coder
    text = text.encode("utf-8", "ignore").decode()
    ids = encoder.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode(text)
    assert decoder.decode(ids) == library.decode(library.encode(text))


def test_encoding_of_pieces_and_bytes(coder):
    encoder, decoder, library = coder
    rnd = random.Random(2)
    pieces = list(encoder.ids)
    for _ in range(3000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 6)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text)
        ids = [rnd.randrange(3, 32000) if rnd.random() < 0.5 else rnd.randrange(3, 259) for _ in range(rnd.randint(0, 10))]
        assert decoder.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)
    for text in ("x" * 100_000, "the " * 50_000, "漢" * 1000, " " * 1001):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text)


def test_encoding_rows(spark):
    rows = [(1, None), (2, ""), (None, "a  b\n"), (2, "a▁b")]
    coded = sentencepieces.decode(sentencepieces.encode(docs_of(spark, rows).withColumn("ids", F.lit("clash")), MODEL), MODEL)
    got = {r.text: (np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in coded.collect()}
    assert got[None] == got[""] == ([1, 2], "")
    assert got["a  b\n"][1] == "a  b\n" and got["a▁b"][1] == "a b"
    assert sentencepieces.encode(docs_of(spark, []), MODEL).count() == 0


def test_trees_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    model = toxicity.fit_rows(x[:1500], y[:1500], [])
    assert ((model.score(x[1500:]) >= 0.5) == (y[1500:] == 1)).mean() > 0.95
    xs, ys = toxicity.isotonic(np.array([3.0, 1, 2, 2]), np.array([1.0, 1, 0, 0]))
    assert xs.tolist() == [1, 2, 3] and np.allclose(ys, [1 / 3, 1 / 3, 1])


def test_toxicity_held_out_and_edges(spark):
    rnd = random.Random(7)
    rows, labels = [], []
    for i in range(1200):
        words = [rnd.choice("aron belin cado dumar esto fermo gilda horn".split()) for _ in range(rnd.randint(20, 60))]
        if toxic := i % 6 == 0:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["grobble", "snurf", "YOU grobblesome"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), 1))
    docs = docs_of(spark, [*rows, (5000, None), (5001, ""), (None, "snurf"), (3, rows[3][1])]).withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, None, 1)], "doc_id long, toxic int, score int")
    train = F.col("doc_id") % 4 != 2
    model = toxicity.train(docs, lab, train)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 1204 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [(r.predicted, int(r.doc_id % 6 == 0)) for r in got if r.doc_id is not None and r.doc_id < 1200 and r.doc_id % 4 == 2]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    none = toxicity.train(docs, lab.filter("toxic = 0"), train)
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs_of(spark, []), model).count() == 0


def test_words_are_split_byte_exact():
    text = "Éa\x0bB\x1cc\x85d e\t\nF"
    plain = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    assert [w.decode() for w in decontaminate.words_of(text.encode())] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain)
