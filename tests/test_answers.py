"""Mentions of a registry, sections of answers, revisions in force and hash chains."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import mentions as mn
from lodestone.operators import obligations as ob
from lodestone.operators import revisions as rv


def found(spark, text, registry=((("VMS_1", "Väärteomenetluse seadustik")), ("LS_2", "Liiklus"), ("X3_1", "a.b"), ("nounder", None))):
    reg = spark.createDataFrame(list(registry), "id string, law_name string")
    return sorted((r.claim_no, tuple(r.terms)) for r in mn.uncited_mentions(spark.createDataFrame([(1, text), (2, None)], "answer_id long, answer string"), reg).collect())


def test_mentions_of_the_registry(spark):
    assert found(spark, "See on VMS järgi. Muu lause.") == [(0, ("VMS",))]
    # Whole words for short terms, whatever stands around that is no letter; longer ones anywhere.
    assert found(spark, "Vmsi ei ole. vms2 on. Xvms ei. Liikluses ei. (liiklus) on.") == [(0, ("VMS",)), (2, ("Liiklus",))]
    assert found(spark, "Uusväärteomenetluse SEADUSTIKUST loe.") == [(0, ("Väärteomenetluse seadustik",))]
    assert found(spark, "Vt A.B ja x3. Aga axb mitte.") == [(0, ("X3", "a.b"))]
    # A citation in the same claim is enough; statutes in general count without a term.
    assert found(spark, "VMS ütleb nii [VMS_1]. LS ütleb teisiti.") == [(1, ("LS",))] and found(spark, "Nii ütleb seadus.\nNagu § 5.") == [(0, ()), (1, ())]
    assert found(spark, "") == [] and found(spark, "VMS", registry=[]) == []


def test_answers_are_rejected_for_any_uncited_mention(spark):
    good = "Asi on nii.\nÕIGUSLIK KOHALDAMINE:\nSeda ütleb meile säte [vms_1].\nSOOVITUSED:\n- loe läbi"
    answers = spark.createDataFrame([(1, good), (2, good + " liiklus"), (3, "Tere")], "answer_id long, answer string")
    reg = spark.createDataFrame([("VMS_1", "x"), ("LS_2", "Liiklus")], "id string, law_name string")
    got = {r.answer_id: (r.verified, list(r.sources), r.n_uncited) for r in mn.verify_answers(answers, reg).collect()}
    assert got == {1: (True, ["VMS_1"], 0), 2: (False, [], 1), 3: (False, [], 0)}


def test_sections_with_places(spark):
    text = "Sissejuhatus\nkokkuvõte :  Esimene rida. \n\n 2) Teine\n• kolmas\nneljas\nSoovitused:\n- a\n\t1. b  \nMUU OSA:\nc"
    answers = spark.createDataFrame([(1, text), (2, "KOKKUVÕTE:"), (3, None), (4, "xKOKKUVÕTE: a")], "answer_id long, answer string")
    rows = mn.sections(answers, {"KOKKUVÕTE": 3, "SOOVITUSED": 5, "PUUDUB": 1}).orderBy("heading", "item_no").collect()
    assert [(r.answer_id, r.heading, r.item_no, r["item"]) for r in rows] == [(1, "KOKKUVÕTE", 1, "Esimene rida."), (1, "KOKKUVÕTE", 2, "Teine"), (1, "KOKKUVÕTE", 3, "kolmas"), (1, "SOOVITUSED", 1, "a"), (1, "SOOVITUSED", 2, "b")]
    assert all(text[r.start : r.end] == r["item"] for r in rows)


def day(k):
    return dt.date(2020, 1, 1) + dt.timedelta(days=k)


def test_days_meet_intervals(spark):
    """Random intervals, some open, empty or without start, against all pairs."""
    rnd = random.Random(5)
    spans = [(k, rnd.randrange(3), day(a := rnd.randrange(900)), None if k % 9 == 0 else day(a + rnd.choice([0, 1, 2, 7, 64, 65, 400, -3]))) for k in range(300)] + [(900, 1, None, day(5)), (901, 1, None, None)]
    asked = [(k, rnd.randrange(3), day(rnd.randrange(-5, 1400))) for k in range(200)] + [(900, 0, None)]
    got = rv.in_force(spark.createDataFrame(asked, "q int, k int, d date"), spark.createDataFrame(spans, "s int, k int, a date, b date"), ["k"], "d", "a", "b")
    want = {(q, s) for q, k, d in asked for s, kk, a, b in spans if k == kk and d and a and a <= d and (b is None or (d < b and a < b))}
    assert {(r.q, r.s) for r in got.collect()} == want and got.count() == len(want) > 500
    assert rv.in_force(spark.createDataFrame(asked, "q int, k int, d date"), spark.createDataFrame([], "s int, k int, a date, b date"), ["k"], "d", "a", "b").count() == 0


def test_the_revision_in_force(spark):
    """An end is exclusive; not yet in force, unknown ends, several acts and future days have no act."""
    rows = [
        (1, "Liiklusseadus", day(0), day(100), False), (2, "LIIKLUSSEADUS ", day(100), None, True), (3, "Katki", day(0), None, False), (4, "Kaks", day(0), None, True), (5, "kaks", day(50), day(60), False),
        (6, "Algus puudub", None, day(9), False),
    ]
    acts = spark.createDataFrame(rows, "act_id int, title string, valid_from date, valid_to date, open boolean")
    asked = [("a", "liiklusseadus", day(99)), ("b", "Liiklusseadus", day(100)), ("c", "Liiklusseadus", day(-1)), ("d", "Katki", day(1)), ("e", "Kaks", day(55)), ("f", "Kaks", day(60)), ("g", "Puudub", day(1)), ("h", "Kaks", day(5000)), ("i", "Kaks", None), ("j", "Algus puudub", day(1))]
    got = {r.request: (r.act_id, r.reason) for r in rv.resolve(spark.createDataFrame(asked, "request string, title string, as_of date"), acts, F.lit(day(3000))).collect()}
    assert got == {
        "a": (1, None), "b": (2, None), "c": (None, "not yet in force"), "d": (None, "incomplete interval"), "e": (None, "several acts"), "f": (4, None), "g": (None, "unknown title"),
        "h": (None, "future date"), "i": (None, "no date"), "j": (None, "incomplete interval"),
    }


@pytest.fixture
def chain(spark):
    files = spark.createDataFrame([(1, bytearray(b"<act/>")), (2, bytearray(b"x")), (2, bytearray(b"y"))], "act_id long, content binary")
    metadata = spark.createDataFrame([(k, 'Act "ä"', "RT_NATIONAL_LAW", "binding_national_law", "i", "seadus", day(0), None, "RT I") for k in (1, 2)], "act_id long, title string, source_id string, authority_class string, issuer string, act_type string, valid_from date, valid_to date, publication_series string")
    revisions = rv.files_to_revisions(files, metadata)
    sections = spark.createDataFrame([(1, "§ 5²", "Pea", "Tekst"), (1, "5b2", "Pea", "Tekst"), (1, "6", "", "a"), (1, "6", "", "b"), (1, "7", "", " ")], "act_id long, section string, heading string, text string")
    return revisions, sections


def test_chains_of_hashes(spark, chain):
    revisions, sections = chain
    (r,) = revisions.collect()
    fields = {"version": "revision-1", "act_id": "1", "title": 'Act "ä"', "source_id": "RT_NATIONAL_LAW", "authority_class": "binding_national_law", "issuer": "i", "act_type": "seadus", "valid_from": "2020-01-01", "valid_to": None, "publication_series": "RT I", "xml_sha256": hashlib.sha256(b"<act/>").hexdigest()}
    digest = lambda x: hashlib.sha256(json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert r.revision_sha256 == digest(fields)
    asked = spark.createDataFrame([(1, "vos", s, day(9)) for s in ("5 B2", "§5²", "6", "7", "8", "x")] + [(9, "", "5", day(9))], "act_id long, domain string, section string, as_of date")
    records = rv.retrieve(asked, revisions, sections, "https://s")
    got = {(x.act_id, x.section): x for x in records.collect()}
    one = got[1, "5B2"]
    assert (one.id, one.title, one.url, one.reason) == ("VOS_5B2", 'Act "ä" § 5B2 – Pea', "https://s/akt/1#para5b2", None)
    assert one.section_sha256 == digest({"version": "section-1", "act_id": "1", "section": "5B2", "revision_sha256": r.revision_sha256, "content_sha256": hashlib.sha256(b"Tekst").hexdigest()})
    assert {k[1]: x.reason for k, x in got.items() if k[0] == 1} == {"5B2": None, "6": "several texts", "7": "no such section", "8": "no such section", None: "no section number"} and got[9, "5"].reason == "unknown act"

    def reason(as_of=None, known=None, **change):
        spoilt = records.filter("section = '5B2'")
        for name, value in change.items():
            spoilt = spoilt.withColumn(name, F.lit(value))
        return rv.admit(spoilt, revisions if known is None else known, "https://s", as_of, F.lit(day(99))).collect()[0].reason

    assert reason() is None and reason(F.lit(day(9))) is None and reason(F.lit(day(8))) == "other date" and reason(known=revisions.limit(0)) == "unknown revision"
    assert reason(status="X") == "not verified" and reason(source_id="RT_LOCAL_LAW") == "authority disagrees" and reason(source_id=None) == "authority disagrees" and reason(canonical_url="https://s/akt/2") == "wrong act url"
    assert reason(url="https://s/akt/1?x#para5b2") == "wrong section url" and reason(as_of_date=day(100)) == "future date" and reason(as_of_date=None) == "no date" and reason(text=" ") == "no text"
    assert reason(text="Tekst.") == "content hash" and reason(xml_sha256="z") == "not a hash" and reason(section_sha256="0" * 64) == "section hash"
    # A chain that is whole in itself, but over another revision than the registry has.
    other = "0" * 64
    whole = digest({"version": "section-1", "act_id": "1", "section": "5B2", "revision_sha256": other, "content_sha256": hashlib.sha256(b"Tekst").hexdigest()})
    assert reason(revision_sha256=other, section_sha256=whole) == "revision hash"


def planned(spark, context, intents=(), flags=(), search="otsing"):
    rows = spark.createDataFrame([(1, context, search, list(intents), list(flags)), (2, None, None, None, None)], "request int, context string, search_text string, intents array<string>, flags array<string>")
    out = ob.plan(rows, ob.rules_table(spark)).orderBy("ord").collect()
    assert all(r.requirement == ob.KINDS[r.kind] for r in out)
    return [(r.kind, r.reason, r.query) for r in out]


def test_specific_obligations_replace_general_ones(spark):
    got = planned(spark, "küsimus", ["deadline", "find_authority", "next_steps", "document_help"])
    assert [g[:2] for g in got] == [("authority", "latest_turn_intent:find_authority"), ("procedure", "latest_turn_intent:procedure"), ("deadline", "latest_turn_intent:deadline")] and got[0][2].startswith("otsing pädev asutus")
    got = planned(spark, "Trahvi tähtaeg on möödas", ["deadline", "payment_plan", "challenge_decision"], ["fine"])
    assert [g[1] for g in got] == ["fine_context:missed_deadline", "fine_context:challenge_decision", "fine_context:payment_plan"]
    assert planned(spark, "Trahvi tähtaeg on pikk", ["deadline"], ["fine"])[0][2].startswith("rahatrahv väärteomenetlus kohaldatav")
    # Words of the context make it one of employment; the later of two that replace counts.
    got = planned(spark, "Tööandja KOONDAB suuliselt, kui pikk on aeg", ["deadline", "missed_deadline"], ["fine"])
    assert [g[1] for g in got] == ["employment_context:redundancy_basis", "employment_context:notice_period", "employment_context:termination_form"]
    assert planned(spark, "midagi") == [] and planned(spark, "x " * 900, ["deadline"], search="y " * 900)[0][2].startswith("y y") and len(planned(spark, "x", ["deadline"], search="y" * 900)[0][2]) < 560


def test_coverage_summaries(spark):
    rows = [(1, 2, "b", "ANSWER_MISSING"), (1, 1, "a", "ANSWER_MISSING"), (1, 3, "c", "COVERED"), (2, 1, "a", "ANSWER_MISSING"), (2, 2, "b", "SOURCE_MISSING"), (3, 1, "a", "RULE_UNRESOLVED")]
    got = {r.request_id: tuple(r)[1:] for r in ob.coverage_summary(spark.createDataFrame(rows, "request_id int, place int, obligation string, status string")).collect()}
    assert got == {1: (3, 1, [], ["a", "b"], [], True), 2: (2, 0, ["b"], ["a"], [], False), 3: (0, 0, [], [], ["a"], False)}
