"""Requests and revisions that pass in order of days, against all pairs, and what that shuffles."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import revisions as rv


def day(k):
    return dt.date(2020, 1, 1) + dt.timedelta(days=k)


def tables(spark, n_acts=260, n_asked=500):
    rnd = random.Random(12)
    acts = [(rnd.choice([k, k // 2, None]) if k % 40 == 0 else k // 2, f"T{rnd.randrange(4)}", day(a := rnd.randrange(900)), None if k % 9 == 0 else day(a + rnd.choice([0, 1, 2, 7, 64, 65, 400, -3])), k % 18 == 0) for k in range(n_acts)] + [(900, "T1", None, day(5), False), (901, "alone", day(3), day(4), False)]
    asked = [(rnd.randrange(n_asked // 2), f"t{rnd.randrange(5)}", day(rnd.randrange(-5, 1400))) for _ in range(n_asked)] + [(9000, "t0", None), (None, "t1", day(50)), (None, "t2", day(60)), (9001, "alone", day(3)), (9002, "alone", day(4))]
    return acts, asked, spark.createDataFrame(acts, "act_id int, title string, valid_from date, valid_to date, open boolean"), spark.createDataFrame(asked, "request int, title string, as_of date")


@pytest.mark.parametrize("stretches", [8, 1, 5000])
def test_acts_of_all_pairs(spark, monkeypatch, stretches):
    """Requests with several rows, acts with several revisions, a null request and a null act."""
    monkeypatch.setattr(rv, "STRETCHES", min(stretches, 200), raising=False)
    acts, asked, revisions, requests = tables(spark)
    live = lambda title, d: {a for a, name, x, y, o in acts if d and a is not None and name.lower() == title and x and x <= d and (y and d < y or (y is None and o))}
    held = {q: set().union(*(live(t, d) for p, t, d in asked if p == q)) for q, _, _ in asked if q is not None}
    got = sorted(((r.request, r.n_acts, r.act_id) for r in rv.resolve(requests, revisions, F.lit(day(5000))).collect()), key=str)
    want = sorted(((q, len(s := held.get(q, set())), next(iter(s)) if len(s) == 1 and d else None) for q, _, d in asked), key=str)
    assert got == want and sum(n > 1 for _, n, _ in got) > 50


def test_no_revisions(spark):
    _, asked, revisions, requests = tables(spark)
    got = rv.resolve(requests, revisions.limit(0), F.lit(day(5000))).collect()
    assert len(got) == len(asked) and {r.reason for r in got} == {"unknown title", "no date"}


def test_requests_are_shuffled_once_a_key(spark):
    """By title and by request, not once for each length of interval."""
    rows = spark.range(40000, numPartitions=4)
    acts = rows.select(F.col("id").alias("act_id"), F.concat(F.lit("T"), F.col("id") % 50).alias("title"), F.date_add(F.lit(day(0)), (F.col("id") % 700).cast("int")).alias("valid_from"), (F.col("id") % 500).cast("int").alias("n"), F.lit(False).alias("open")).withColumn("valid_to", F.date_add("valid_from", F.col("n"))).limit(900)
    asked = rows.select(F.xxhash64("id").alias("request"), F.concat(F.lit("t"), F.col("id") % 50).alias("title"), F.date_add(F.lit(day(0)), (F.col("id") % 900).cast("int")).alias("as_of"))
    out = rv.resolve(asked, acts, F.lit(day(5000)))
    store = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = store()
    out.write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    assert store() - before < 40000 * 75
