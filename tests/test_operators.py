"""Operators on small hand-made tables."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from lodestone.operators import dense, evaluate, fusion, lexical, spans, temporal, verify
from lodestone.sources import acts, corpus
from lodestone.streaming import limits


def test_lexical_and_fusion(spark):
    docs = spark.createDataFrame([(1, "Leping tehakse kirjalikult. Leping kehtib kaks aastat"), (2, "Auto sõidab maanteel kiiresti"), (3, None), (4, "lepinguline suhe")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "kirjalik leping"), (8, "kui ja")], "q long, text string")
    got = lexical.ranked(lexical.score(docs, asked, "q", "text")).collect()
    assert [(r.query_id, r.doc_id, r.rank) for r in got] == [(7, 1, 1), (7, 4, 2)]
    assert got[0].matched == 2
    rank = lambda rows: spark.createDataFrame(rows, "query_id long, doc_id long, rank int")
    a, b = rank([(1, 10, 1), (1, 11, 2), (1, 12, 201)]), rank([(1, 11, 1), (1, 13, 2)])
    fused = fusion.rrf([a, b], [1.0, 1.0]).orderBy("rank").collect()
    assert [r.doc_id for r in fused] == [11, 10, 13]
    assert float(fused[0].score) == pytest.approx(1 / 22 + 1 / 21)
    assert [r.doc_id for r in fusion.round_robin([a, b], 3).orderBy("rank").collect()] == [10, 11, 13]
    lex = a.filter("rank < 10").withColumn("matched", F.lit(1))
    domains = spark.createDataFrame([(10, "A"), (11, "B"), (13, "C")], "doc_id long, domain string")
    assert [r.doc_id for r in fusion.champions(lex, b, domains, 10).collect()] == [11]


def test_reserved_slots(spark):
    fused = spark.createDataFrame([(1, 10, 1, "A", 1), (1, 11, 2, "A", 1), (1, 12, 3, "B", 1)], "query_id long, doc_id long, rank int, domain string, matched int")
    kept = fusion.reserve(fused, spark.createDataFrame([(1, "B")], "query_id long, domain string"), 2).orderBy("slot").collect()
    assert [r.doc_id for r in kept] == [10, 12]


def test_cosine_edges(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = dense.cosine_topk(rows, rows.filter("vec_id in (0, 3)"), 2).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got] == [(1, 1.0), (2, 0.0)]
    assert dense.cosine_topk(rows, rows.filter("false"), 2).count() == 0


def test_citations_and_evidence(spark):
    tail = "\nÕIGUSLIK KOHALDAMINE: Üür on liiga kõrge [VOS_3].\nSOOVITUSED: ei"
    answers = spark.createDataFrame([(1, "Leping kehtib [vos_3]." + tail), (2, "Seadus lubab seda." + tail), (3, "[VOS_9]" + tail), (4, "[VOS_3] pole osa"), (5, None)], "answer_id long, answer string")
    got = {r.answer_id: r for r in verify.verify_citations(answers, spark.createDataFrame([("VOS_3",)], "id string")).collect()}
    assert [got[k].verified for k in (1, 2, 3, 4, 5)] == [True, False, False, False, False]
    assert got[1].sources == ["VOS_3"] and got[3].n_unknown == 1
    claims = spark.createDataFrame([(1, 1, "a", "Tähtaeg on kolmkümmend päeva alates"), (1, 2, "b", "see siin ei ole olemas üldse kuskil"), (2, 1, "A ", "„tähtaeg on kolmkümmend PÄEVA"), (3, 1, "zz", "x" * 30)], "answer_id long, claim_id long, source_id string, evidence string")
    sources = spark.createDataFrame([("a", "<p>Tähtaeg on kolmkümmend päeva alates teatest „Tähtaeg on kolmkümmend päeva</p>"), ("b", "muu")], "source_id string, text string")
    assert {r.answer_id: r.accepted for r in verify.verify_evidence(claims, sources).collect()} == {1: False, 2: True, 3: False}


def test_support_and_coverage(spark):
    pairs = spark.createDataFrame([("Tähtaeg kolm päeva", "tähtaeg on kolm päeva"), ("Tähtaeg neli päeva", "tähtaeg on kolm päeva"), ("seega kehtib", "kehtib")], "c string, e string")
    assert [r.s for r in pairs.select(verify.claim_supported(F.col("c"), F.col("e")).alias("s")).collect()] == [True, False, False]
    duties = spark.createDataFrame([(1, "x", [["A_1"], ["B_1"]], None, None), (2, "x", [["A_1"]], [["maksma"]], "peab maksma"), (3, "x", [["C_9"]], None, None), (4, "x", [], None, None)], "request_id long, obligation string, groups array<array<string>>, terms array<array<string>>, answer_folded string")
    ids = spark.createDataFrame([(1, "A_1"), (1, "B_1"), (2, "A_1")], "request_id long, id string")
    got = {r.request_id: r.status for r in verify.coverage(duties, ids, ids.filter("id = 'A_1'")).collect()}
    assert got == {1: "ANSWER_MISSING", 2: "COVERED", 3: "SOURCE_MISSING", 4: "RULE_UNRESOLVED"}


def test_percentiles_and_spans(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in range(1, 21)], "k string, v double")
    assert evaluate.percentile(rows, "k", "v", 0.95, "floor").first()["percentile"] == 19.0
    assert evaluate.percentile(rows, "k", "v", 0.95).first()["percentile"] == 19.0
    text = "Lause üks. " * 300
    docs = spark.createDataFrame([(1, text), (2, None), (3, " \n "), (4, "Trahv on 4 000 eurot. Otsus 10.08.2026 ok.")], "doc_id long, text string")
    got = spans.spans(docs).filter("doc_id = 1").orderBy("seq").collect()
    assert all(text[r.start : r.end] == r.text and len(r.text) <= 1200 for r in got) and len(got) == 3
    assert {(r.kind, r.value) for r in spans.facts(docs).collect()} == {("amount", "4 000 eurot"), ("date", "10.08.2026")}


def test_validity(spark):
    day = lambda s: F.lit(s).cast("date")
    row = spark.range(1).select(
        temporal.valid_inclusive(day("2024-02-01"), day("2024-01-01"), day("2024-02-01")).alias("a"), temporal.valid_exclusive(day("2024-02-01"), day("2024-01-01"), day("2024-02-01")).alias("b"),
        temporal.valid_inclusive(day("2024-02-01"), day(None), day(None)).alias("c"), temporal.valid_exclusive(day("2024-02-01"), day(None), day(None)).alias("d"),
    ).first()
    assert list(row) == [True, False, True, False]


EVENTS = [("u", 1, 0), ("u", 2, 30), ("u", 3, 59), ("u", 4, 60), ("u", 5, 90), ("v", 6, 10)]


def events_of(spark):
    return spark.createDataFrame(EVENTS, "user string, id long, s long").select("user", "id", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("at"))


def test_rate_limit_batch_and_stream(spark, tmp_path):
    batch = {r.id: (r.allowed, r.retry_after) for r in temporal.rate_limit(events_of(spark), ["user"], "at", "id", 2, 60).collect()}
    assert batch == {1: (True, 0), 2: (True, 0), 3: (False, 1), 4: (True, 0), 5: (True, 0), 6: (True, 0)}
    for k, part in enumerate(("id <= 3", "id > 3")):
        events_of(spark).filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events_of(spark).schema).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    q = limits.rate_limit(stream, ["user"], "at", "id", 2, 60).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.id: (r.allowed, r.retry_after) for r in spark.sql("select * from limited").collect()} == batch
    s = limits.sessions(stream, "user", "at", 30).writeStream.outputMode("update").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "c2")).start()
    s.processAllAvailable()
    s.stop()
    twin = temporal.sessions(events_of(spark), "user", "at", 30, "id").groupBy("user", "session").agg(F.count(F.lit(1)).alias("n"))
    assert {(r.user, r.session, r.n_events) for r in spark.sql("select * from sessions").collect()} == {(r.user, r.session, r.n) for r in twin.collect()}


def test_corpus_scan_is_fail_closed(spark, tmp_path):
    good = {"id": "vos _1", "title": "t", "text": "Tekst", "source": "s", "domain": "vos", "law_name": "n", "section": "1", "url": "https://x/1", "content_hash": hashlib.sha256(b"Tekst").hexdigest(), "aliases": ["a"]}
    import json

    path = tmp_path / "laws.json"
    path.write_text(json.dumps({"laws": [good]}))
    assert [r.id for r in corpus.read_sections(spark, str(path), "https://x/").collect()] == ["VOS_1"]
    path.write_text(json.dumps([good, good | {"content_hash": "0", "url": "http://y"}]))
    with pytest.raises(corpus.CorpusError, match="hash|url|duplicate"):
        corpus.read_sections(spark, str(path), "https://x/")


def test_acts(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<akt xmlns='u'><aktinimi>Üürileping</aktinimi><paragrahv id='para95'><number>95</number>Lühike</paragrahv><paragrahv id='para95'><number>95</number>Palju pikem tekst</paragrahv><paragrahv id='para16b1'>§ 16¹ x</paragrahv></akt>")
    (tmp_path / "b.xml").write_text("<!DOCTYPE x><akt/>")
    rows = acts.read_acts(spark, str(tmp_path / "*.xml"))
    assert rows.filter("error is not null").count() == 1
    got = {r.id: r.text for r in acts.sections(rows, F.lit("vos")).collect()}
    assert set(got) == {"VOS_95", "VOS_16B1"} and "pikem" in got["VOS_95"]


def test_planning(spark):
    from lodestone.operators import planning as p

    rows = [
        ("Kaebuse tähtaeg on möödas, kas saan maksta trahvi osade kaupa?", ["missed_deadline", "challenge_decision", "payment_plan"], True, "urgent"),
        ("Mida teha?", ["next_steps"], False, "normal"),
        ("Kas see on nii?", ["rights_explanation"], False, "normal"),
        ("Ta ähvardab ja tähtaeg on ületatud", ["missed_deadline", "challenge_decision"], False, "immediate"),
        (None, [], False, "normal"),
    ]
    got = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "k int, x string").select("k", p.intents("x").alias("i"), p.is_fine("x").alias("f"), p.urgency("x", F.lit("2026-08-01").cast("date")).alias("u")).orderBy("k").collect()
    assert [(r.i, r.f, r.u) for r in got] == [r[1:] for r in rows]
    one = spark.createDataFrame([("Sain kiirmenetluse otsuse ja trahv 1 200 või 1500,50 eurot; tähtaeg 5.8.2026", "jah")], "a string, b string")
    row = one.select(
        p.fine_document("a").alias("d"), p.large_amount("a").alias("m"), p.routes("a", F.array(F.lit("payment_plan")), F.lit(True)).alias("r"), p.is_fragment("b").alias("g"),
        p.urgency(F.lit("tähtaeg 5.8.2026"), F.lit("2026-08-01").cast("date")).alias("u"), p.asks_identifier(F.lit("Mis on sinu täpne nimi?")).alias("n"), p.is_direct_question(F.lit("Kuidas edasi?")).alias("q"),
    ).first()
    assert row.d == "kiirmenetluse otsus" and row.m == "1500,50 eurot" and row.g and row.u == "attention" and row.n and row.q
    assert row.r == ["ABIPOLS_3", "ABIPOLS_16", "VTMS_19", "VTMS_57", "VTMS_114", "KARS_66", "VTMS_74", "VTMS_204"]
    cards = spark.createDataFrame([(1, 1, "a", True), (1, 2, "b", False), (1, 3, None, False)], "id int, revision int, title string, user_confirmed boolean")
    assert [tuple(r) for r in p.latest_cards(cards, "id", "revision", ["title"]).collect()] == [(1, 3, "a")]
    changes = spark.createDataFrame([(1, 3), (1, 2), (9, 1)], "id int, base int")
    assert sorted(r.accepted for r in p.apply_revisions(p.latest_cards(cards, "id", "revision", ["title"]), changes, "id", "base").collect()) == [False, False, True]


def test_provenance(spark, tmp_path):
    import json

    from lodestone.operators import provenance as pv

    case = {"source_kind": "case_law", "id": "CASE_3-1_X", "court_name": "Riigikohus \"a\"/b", "case_number": "3-1", "decision_date": "2024-02-29", "decision_type": "otsus", "court_level": "3", "canonical_url": "https://x.ee/a", "text": "Õ\n\tpikk tekst mis on üle kahekümne nelja märgi"}
    good = hashlib.sha256(json.dumps(case, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    rows = [case | {"record_sha256": good}, case | {"id": "CASE_B_1", "record_sha256": good}]
    frame = lambda r: spark.createDataFrame(r, ", ".join(f"{c} string" for c in [*pv.CASE_FIELDS, "record_sha256"]))
    assert [r.verified for r in pv.verify_case_law(frame([tuple(r[c] for c in [*pv.CASE_FIELDS, "record_sha256"]) for r in rows])).collect()] == [True, False]
    assert [r.verified for r in pv.verify_case_law(frame([tuple(rows[0][c] for c in [*pv.CASE_FIELDS, "record_sha256"])] * 2)).collect()] == [False, False]
    schema = "id string, display_name string, source_group string, authority_class string, source_kind string, jurisdiction string, canonical_hosts array<string>, allowed_claim_classes array<string>"
    sources = spark.createDataFrame([("A_1", "n", "g", "binding_local_law", "k", "EE", ["a.ee"], ["binding_rule"]), ("b", "n", "g", "nope", "k", "", ["..x"], ["court_holding"])], schema)
    assert {(r.id, r.rule) for r in pv.registry_violations(sources).collect()} == {("b", x) for x in ("id", "missing_jurisdiction", "authority", "hosts", "claims")}
    claims = spark.createDataFrame([("a_1", "binding_rule", "https://A.ee/x"), ("A_1", "binding_rule", "http://a.ee"), ("A_1", "court_holding", "https://a.ee"), ("A_1", "binding_rule", "https://u:p@a.ee")], "source_id string, claim_class string, url string")
    assert [r.url for r in pv.supported_claims(claims, sources).collect()] == ["https://A.ee/x"]
    row = spark.range(1).select(
        pv.binding_class(F.lit("RT I"), F.lit("Seadus")).alias("a"), pv.binding_class(F.lit("RT IV"), F.lit("seadus")).alias("b"), pv.binding_class(F.lit("RT IV"), F.lit("valla määrus")).alias("c"),
        pv.similar_questions(F.lit("Millal said otsuse kätte?"), F.lit("millal SAID selle otsuse kätte")).alias("s"), pv.case_id(F.lit("3-1/2"), F.lit("2024-01-01"), F.lit("otsus")).alias("id"),
        pv.status(F.lit(False), F.array(F.lit("EVIDENCE_VERIFIED")), F.array(F.lit("law")), F.lit(True)).alias("v"),
        pv.grounded_items(F.array(F.struct(F.lit("Üür tõusis").alias("evidence"), F.lit("x").alias("value")), F.struct(F.lit("puudub").alias("evidence"), F.lit("x").alias("value"))), F.lit("üür  TÕUSIS"), 5).alias("g"),
    ).first()
    assert row.a.source_id == "RT_NATIONAL_LAW" and row.b is None and row.c.authority == "binding_local_law"
    assert row.s and row.id == "CASE_3-1_2_2024-01-01_OTSUS" and row.v == "EVIDENCE_VERIFIED" and len(row.g) == 1
    corpus_ = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    vectors = spark.createDataFrame([(1, "h", [1.0]), (2, "h", [2.0])], "id long, content_hash string, vector array<double>")
    pv.write_index(vectors, corpus_, str(tmp_path / "ix"), "m", 1)
    assert pv.open_index(corpus_, str(tmp_path / "ix"), "m").count() == 2
    with pytest.raises(corpus.CorpusError, match="corpus, rows"):
        pv.open_index(corpus_.filter("doc_id = 1"), str(tmp_path / "ix"), "m")
