"""The pipeline's stages against brute force, each on its own input."""

from __future__ import annotations

import random
import re

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_set_operators import brute_components, near_rows, prose

import corpus_pipeline
from lodestone.llm.common import parted

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, path):
    rnd = random.Random(21)
    rows = [(i, t) for i, t in near_rows(9, 3, 8)]
    n = max(i for i, _ in rows)
    labels = [(i, 1, 0) for i, _ in rows]
    for k in range(1, 400):
        words = prose(rnd, rnd.randint(30, 70))
        if k % 5 == 0:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["grobble", "snurf"]))
        rows.append((n + k, " ".join(words)))
        labels.append((n + k, 1, int(k % 5 == 0)))
    items = [(k, " ".join(prose(rnd, 20))) for k in range(3)]
    rows += [(9000 + k, " ".join(prose(rnd, 30)) + " " + items[k][1].upper()) for k in range(3)]
    rows += [(9100, rows[0][1].replace(" ", "\n")), (9101, rows[40][1]), (9102, None), (9103, ""), (9104, "x y")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return {n + k for k in range(1, 400) if k % 5 == 0}, items


def test_stages_against_brute_force(spark, tmp_path):
    sf_dir = str(tmp_path)
    toxic, items = tables(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        stage(spark, docs, sf_dir).write.parquet(f"{sf_dir}/{name}")
        docs = spark.read.parquet(f"{sf_dir}/{name}")
        assert name == "sentencepiece" or docs.columns == columns
        seen[name] = before, docs.collect()
    ids = lambda rows: {r.doc_id for r in rows}

    before, after = seen["toxicity"]
    gone = {i for i, _ in before} - ids(after)
    assert len(gone & toxic) >= 0.95 * len(toxic) and len(gone - toxic) <= 4

    before, after = seen["exact_dedup"]
    first = {}
    for i, text in sorted(before):
        first.setdefault(re.sub("[ \t-\r]+", " ", text or ""), i)
    assert ids(after) == set(first.values())

    before, after = seen["minhash_near_dedup"]
    component, _ = brute_components(before)
    assert ids(after) == {i for i, c in component.items() if i == c}

    before, after = seen["benchmark_decontamination"]
    windows = {tuple(w[k : k + 13]) for _, t in items for w in [t.split()] for k in range(len(w) - 12)}
    clean = set()
    for i, text in before:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
        hit = {p for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows for p in range(k, k + 13)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean.add(i)
    assert ids(after) == clean and not clean & {9000, 9001, 9002}

    before, after = seen["sentencepiece"]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = dict(before)
    for r in after:
        wanted = library.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(wanted) and b"".join(x.to_bytes(4, "little") for x in wanted) == bytes(r.ids) and r.decoded == library.decode(wanted)
    assert ids(corpus_pipeline.run(spark, sf_dir).collect()) == ids(after)


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_pass_through(spark, tmp_path):
    """Columns that are named as an operator's own keep their values through the filtering stages."""
    tables(spark, str(tmp_path))
    mine = {"score": "mine", "predicted": "p", "n_words": "w", "spans": "s", "items": "i", "n_hit": "h", "contaminated": "c", "digest": "d", "keep_id": "k", "rest": "r"}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, value in mine.items():
        docs = docs.withColumn(name, F.lit(value))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert [r.asDict() for r in out.select(*mine).distinct().collect()] == [mine], name


def shuffled(spark, work):
    """work's result, and the bytes that its stages write to shuffles."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (found.apply(k) for k in range(found.size()))}

    before = stages()
    out = work()
    return out, sum(n for key, n in stages().items() if key not in before)


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies])
def test_texts_that_stay_are_not_shuffled(spark, tmp_path, stage):
    """Where the list of those that go is too long to broadcast, only marked rows meet it with their texts."""
    rnd = random.Random(31)
    texts = [" ".join(f"{rnd.getrandbits(64):x}" for _ in range(600)) for _ in range(400)]
    rows = [*enumerate(texts), *((1000 + k, texts[k]) for k in range(10)), (2000, None), (2001, ""), (None, texts[20]), (3, texts[3]), (None, "alone")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs, old = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, size = shuffled(spark, lambda: stage(spark, docs, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # Rows without an id go as copies in exact dedup only, a repeated row is one there; an empty set has no link.
    extra = [("None", "alone"), ("2000", "")] if stage is corpus_pipeline.drop_copies else [("None", "alone"), ("None", texts[20]), ("2000", ""), ("2001", ""), ("3", texts[3])]
    assert sorted((str(r.doc_id), r.text or "") for r in left) == sorted([*((str(k), t) for k, t in enumerate(texts)), *extra])
    assert size < sum(map(len, texts)) / 4


def test_parted_rows_are_whole(spark):
    rows = spark.createDataFrame([(k if k % 9 else None, f"t{k}") for k in range(20_000)], "id long, t string")
    for keys in (spark.range(0, 20_000, 40), spark.createDataFrame([(None,), (5,)], "id long"), spark.range(0)):
        near, far = parted(rows, keys, "id")
        assert near.columns == far.columns == rows.columns
        assert sorted(r.t for r in near.unionByName(far).collect()) == sorted(r.t for r in rows.collect())
        wanted = {r.id for r in keys.collect()}
        assert not wanted & {r.id for r in far.collect()} and near.count() < 20_000 / 6
