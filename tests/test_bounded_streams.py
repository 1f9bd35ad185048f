"""Rings and collections in state against their batch twins."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import evaluate
from lodestone.streaming import bounded


@pytest.fixture
def with_store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    bounded.use_state_store(spark)
    yield spark
    spark.conf.set(name, before)


def streamed(spark, tmp_path, df, parts, schema):
    """A stream of the parts of df, one a micro-batch, in order."""
    for k in range(parts):
        df.filter(f"part = {k}").drop("part").coalesce(1).write.parquet(f"{tmp_path}/in/{k:02d}")
    return spark.readStream.schema(df.drop("part").schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def run(df, tmp_path, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_last_values_as_in_a_batch(with_store, tmp_path):
    spark, rnd = with_store, random.Random(1)
    rows = [(k // 40, "ab"[rnd.random() < 0.3], k, float(rnd.randrange(1000))) for k in range(120)] + [(2, "b", 999, None)]
    df = spark.createDataFrame(rows, "part int, route string, t long, ms double").withColumn("at", F.timestamp_micros("t"))
    got = run(bounded.last_values(streamed(spark, tmp_path, df, 3, None), "route", "at", "t", "ms", 25), tmp_path, "ring", "update")
    last = {r.key: r for r in got}  # the last state of each key
    kept = evaluate.last_n(df.filter("ms is not null"), "route", ["t"], 25)
    want = {r["route"]: r.percentile for r in evaluate.percentile(kept, "route", "ms", 0.95).collect()}
    assert {k: r.percentile for k, r in last.items()} == want
    assert {k: (r.n_events, r.n_ring) for k, r in last.items()} == {k: (n := sum(x[1] == k and x[3] is not None for x in rows), min(25, n)) for k in "ab"}


def test_collections_lose_their_oldest(with_store, tmp_path):
    spark, rnd = with_store, random.Random(2)
    rows = [(k // 30, f"c{rnd.randrange(3)}", f"d{rnd.randrange(9)}", k) for k in range(90)]
    df = spark.createDataFrame(rows, "part int, key string, item string, t long").withColumn("at", F.timestamp_micros("t"))
    changes = bounded.collections(streamed(spark, tmp_path, df, 3, None), "key", "item", "at", 4)
    state: dict = {}
    for r in sorted(run(changes, tmp_path, "items", "append"), key=lambda r: (r.key, 0)):
        own = state.setdefault(r.key, {})
        if r.change == "evicted":
            own.pop(r["item"], None)
        else:
            assert (r.change == "replaced") == (r["item"] in own)
            own[r["item"]] = r["at"]
    # Batch twin: the four newest items of each collection by their last time.
    want: dict = {}
    for _, key, item, t in rows:
        want.setdefault(key, {})[item] = t
    assert state == {k: dict(sorted(v.items(), key=lambda x: -x[1])[:4]) for k, v in want.items()}


def test_collections_beyond_the_most_leave(with_store, tmp_path):
    """Two stages in one query: keys that were touched longest ago leave."""
    spark = with_store
    rows = [(0, "a", "x", 1), (0, "b", "x", 2), (1, "a", "y", 3), (1, "c", "x", 4), (2, "d", "x", 5)]
    df = spark.createDataFrame(rows, "part int, key string, item string, t long").withColumn("at", F.timestamp_micros("t"))
    changes = bounded.collections(streamed(spark, tmp_path, df, 3, None), "key", "item", "at", 4)
    got = run(bounded.evicted_keys(changes, 2), tmp_path, "gone", "append")
    assert [(r.key, r["at"]) for r in got] == [("b", 2), ("a", 3)]
