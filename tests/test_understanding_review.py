"""Query understanding, forced hints, gates, reports and checks on small inputs: empty tables, nulls, ties and repeats."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import evaluate
from lodestone.operators import review as rv
from lodestone.operators import understanding as un


def test_phrases_and_domain_hints(spark):
    rows = spark.createDataFrame([("A", "Rahu tagamine"), ("B", "rahu"), ("C", "rahu"), ("D", "rahu"), ("A", None)], "d string, t string")
    voc = {r.term: r.domains for r in un.phrases(rows, "d", "t").collect()}
    assert voc["rahu"] == ["A", "B", "C", "D"] and voc["tagamine"] == ["A"] and voc["rahutagamine"] == ["A"]
    asked = spark.createDataFrame([(1, "rahu"), (1, "tagamine"), (2, "muu")], "query_id int, term string")
    assert [(r.query_id, r.domain) for r in un.domain_hints(asked, un.phrases(rows, "d", "t")).collect()] == [(1, "A")]
    assert un.phrases(rows.filter("false"), "d", "t").count() == 0


def test_expansions_keep_order_and_cap(spark):
    rules = spark.createDataFrame([(1, "abi politseinik", ["abipolitseinik", "korrakaitse"]), (2, "trahv", ["rahatrahv", "korrakaitse"]), (3, "muu", ["x"])], "rule int, form string, expand array<string>")
    q = spark.createDataFrame([(1, "Trahv: abi  politseinik!"), (2, "ei midagi"), (3, None)], "id int, t string")
    got = [(r.query_id, r.pos, r.term) for r in un.expansions(q, rules, "id", "t").orderBy("query_id", "pos").collect()]
    assert got == [(1, 1, "abipolitseinik"), (1, 2, "korrakaitse"), (1, 3, "rahatrahv")]
    assert un.expansions(q, rules, "id", "t", 1).count() == 1


def test_relevance_gate(spark):
    rows = [(0, 5, True, True, True, False), (3, 1, True, False, False, True), (3, 0, False, True, True, False), (3, 2, False, False, False, False), (3, 1, False, False, True, True)]
    df = spark.createDataFrame(rows, "n int, m int, h boolean, i boolean, s boolean, want boolean")
    assert df.filter(un.relevant(F.col("n"), F.col("m"), F.col("h"), F.col("i"), F.col("s")) != F.col("want")).count() == 0
    assert [r[0] for r in spark.createDataFrame([(5, 2, True), (5, 1, True), (6, 2, True)], "n int, m int, s boolean").select(un.relevant(F.col("n"), F.col("m"), F.lit(False), F.lit(False), F.col("s"), False)).collect()] == [True, False, False]


def test_forced_hints_make_room(spark):
    results = spark.createDataFrame([(1, k, float(10 - k)) for k in range(5)], "query_id int, doc_id int, score double")
    hints = spark.createDataFrame([(1, 9, 0), (1, 4, 1), (2, 7, 0)], "query_id int, doc_id int, place int")
    got = [(r.query_id, r.doc_id, float(r.score)) for r in un.force_hints(results, hints, 3).orderBy("query_id", "rank").collect()]
    assert got == [(1, 9, 11.0), (1, 4, 10.999), (1, 0, 10.0), (2, 7, 1.0)]


def test_lookups_and_gaps(spark):
    rows = spark.createDataFrame([("VOS_1", "a"), ("VOS_2", "b")], "id string, v string")
    got = {r.w: (r.v, r.found) for r in un.lookup(spark.createDataFrame([(" vos_1",), ("X",), (None,)], "w string"), rows, "w", "id").collect()}
    assert got == {" vos_1": ("a", True), "X": (None, False), None: (None, False)}
    expected = spark.createDataFrame([("q", "VOS_1"), ("q", "Y"), ("r", "Y"), ("r", "Z")], "q string, id string")
    assert [(r.q, r.n_missing) for r in un.corpus_gaps(expected, rows, "q", "id").collect()] == [("r", 2)]
    acts = spark.createDataFrame([("Töö seadus", 1), ("Koosolek", 2), ("koosolek", 3)], "t string, act int")
    found = {r.w: (r.act, r.n_acts) for r in un.exact_title(spark.createDataFrame([("TÖÖ  SEADUS",), ("koosolek",), ("muu",)], "w string"), acts, "w", "t", "act").collect()}
    assert found == {"TÖÖ  SEADUS": (1, 1), "koosolek": (None, 2), "muu": (None, 0)}
    names = spark.createDataFrame([("§ 12b",), ("§ 2",), ("lisa",), ("§ 12",)], "s string")
    assert [r.s for r in names.orderBy(*un.section_order(F.col("s"))).collect()] == ["§ 2", "§ 12", "§ 12b", "lisa"]


def test_historical_gate(spark):
    rows = spark.createDataFrame([("2020-01-01", None), (None, None)], "valid_from string, valid_to string")
    probes = spark.createDataFrame([("2019-01-01",), ("2026-01-01",), ("2030-01-01",)], "p string").select(F.col("p").cast("date").alias("probe"))
    gates = lambda r: [x.gate for x in un.historical_gate(r, probes, "2026-01-01").orderBy("probe").collect()]
    assert gates(rows) == ["unavailable", "ok", "future"] and gates(rows.limit(1)) == ["ok", "ok", "future"] and gates(rows.filter("false")) == ["unavailable", "ok", "future"]


def test_dates_hashes_kinds_and_citations(spark):
    values = ["2026-03-16+02:00", "2026-03-16Z", "16.03.2026", "2026-02-30", "2026-03-16+14:01", "2026-03-16+14:00", "x", None]
    got = [str(r[0]) for r in spark.createDataFrame([(v,) for v in values], "v string").select(rv.civil_date(F.col("v"))).collect()]
    assert got == ["2026-03-16"] * 3 + ["None"] * 2 + ["2026-03-16"] + ["None"] * 2
    one = spark.range(1)
    assert one.select(rv.hex64(F.lit("a" * 64)), rv.hex64(F.lit("A" * 64)), rv.hex64(F.lit(None).cast("string"))).first()[:] == (True, False, False)
    kinds = ["form_requirement", "remedy", "other", "authority"]
    assert [r.k for r in spark.createDataFrame([(k,) for k in kinds], "k string").orderBy(rv.kind_order(F.col("k"))).collect()] == ["authority", "remedy", "form_requirement", "other"]
    known = F.array(F.lit("VOS_123"), F.lit("TLS_5"))
    assert one.select(rv.repaired_citations(F.lit("a [vos 123] b [tls-5] c [abc 9]"), known)).first()[0] == "a [VOS_123] b [TLS_5] c [abc 9]"
    assert one.select(rv.excerpt(F.lit("KarS § 12. Esimene lause. Teine."))).first()[0] == "Esimene lause."
    long = one.select(rv.excerpt(F.lit("sõna " * 100))).first()[0]
    assert len(long) <= 321 and long.endswith("sõna…")
    assert one.select(rv.act_ids(F.lit("https://x.ee/akt/12345?a=1"))).first()[0] == ["12345"]


def test_reports(spark):
    rows = spark.createDataFrame([("a", True, True, True, False), ("a", False, True, True, False), ("b", False, True, None, False), ("c", False, False, True, True)], "k string, fallback boolean, passed boolean, safe boolean, mock boolean")
    got = {r.k: (r.fallback_rate, r.pass_rate, r.all_safe, r.accepted) for r in rv.model_report(rows, "k").collect()}
    assert got == {"a": (0.5, 1.0, True, False), "b": (0.0, 1.0, True, True), "c": (0.0, 0.0, True, False)}
    assert {r.k: r.holds for r in rv.all_true(rows, "k", ["passed", "safe"]).collect()} == {"a": True, "b": True, "c": False}
    top = rv.top_reasons(spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), ("c",)], "r string"), "r", 2).collect()
    assert [(r.r, r.n) for r in top] == [("a", 2), ("b", 2)]
    ledger = rv.stage_ledger(spark.createDataFrame([(1, "two", "failed")], "run int, stage string, status string"), ["one", "two"], "run").orderBy("place").collect()
    assert [(r.stage, r.status) for r in ledger] == [("one", "not_run"), ("two", "failed")]


def test_bounded_collections(spark):
    rows = [(k, f"i{n}", k * 100 + n) for k in range(5) for n in range(4)] + [(0, "i3", 900)]
    got = rv.bounded(spark.createDataFrame(rows, "k int, item string, at int"), "k", "item", ["at"], 2, 3).collect()
    assert {(r.k, r["item"]) for r in got} == {(0, "i3"), (0, "i2"), (4, "i3"), (4, "i2"), (3, "i3"), (3, "i2")}


def test_percentiles_with_ties_and_nulls(spark):
    values = {"a": [3.0, 1.0, 1.0, 1.0, 2.0], "b": [7.0], "c": [float(k % 37) for k in range(3000)]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("a", None), ("d", None)], "k string, v double")
    for p in (0.0, 0.5, 0.9, 0.95, 1.0):
        near = {r.k: r.percentile for r in evaluate.percentile(df, "k", "v", p).collect()}
        floor = {r.k: r.percentile for r in evaluate.percentile(df, "k", "v", p, "floor").collect()}
        for k, vs in values.items():
            assert near[k] == sorted(vs)[max(0, -int(-len(vs) * p // 1) - 1)] and floor[k] == sorted(vs)[int((len(vs) - 1) * p)]
        assert set(near) == set(values)
