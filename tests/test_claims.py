"""Claims, evidence, repair, coverage rules and intake pieces on small inputs: empty tables, nulls, ties and repeats."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import claims as cl

CLAIM = "claim_id int, source_id string, claim string, evidence string"
TEXT = "Tööandja peab töötaja palga maksma kokkulepitud päeval. Töötaja palga maksmise päev on kokku lepitud.\nMuu lause räägib hoopis teisest asjast."


def sources(spark):
    return spark.createDataFrame([("tls_1", TEXT), ("vos_2", None)], "source_id string, text string")


def test_recovery_takes_the_supported_sentence(spark):
    rows = [(1, "TLS_1", "Tööandja peab töötaja palga maksma", "vale tsitaat"), (2, "tls 1", "sõiduauto parkimine linnas", ""), (3, "TLS_1", "Tööandja peab palga maksma 3 päeva jooksul", ""), (4, "PUUDU_1", "Tööandja maksab", ""), (5, "TLS_1", None, None)]
    got = {r.claim_id: r.evidence for r in cl.recovered(spark.createDataFrame(rows, CLAIM), sources(spark)).collect()}
    assert got == {1: "Tööandja peab töötaja palga maksma kokkulepitud päeval."}
    assert cl.recovered(spark.createDataFrame([], CLAIM), sources(spark)).count() == 0


def test_repair_gate_names_its_reasons(spark):
    quote = "Muu lause räägib hoopis teisest asjast."
    rows = [(1, "TLS_1", "Tööandja peab töötaja palga maksma", "vale"), (2, "TLS_1", quote, quote), (3, "X_1", "a", "b"), (4, "TLS_1", " [TLS_1] ", quote), (5, "TLS_1", "sõiduauto parkimine linnas", ""), (6, "TLS_1", "sõiduauto parkimine linnas keelatud", quote)]
    got = {r.claim_id: (r.reason, r.recovered) for r in cl.repair_gate(spark.createDataFrame(rows, CLAIM), sources(spark)).collect()}
    assert got == {1: (None, True), 2: (None, False), 3: ("unknown_source", False), 4: ("empty_claim_text", False), 5: ("evidence_not_recoverable", False), 6: ("claim_not_supported_by_evidence", False)}


def test_verified_claims_keep_the_first_of_equals(spark):
    one, two = "Töötaja palga maksmise päev on kokku lepitud.", "Muu lause räägib hoopis teisest asjast."
    rows = [(1, 1, "TLS_1", "sõiduauto parkimine linnas keelatud", one), (1, 2, "TLS_1", one, one), (1, 3, "tls_1", two, two), (1, 4, "TLS_1", "lühike", "lühike"), (2, 1, "VOS_2", two, two)]
    df = spark.createDataFrame(rows, "answer_id int, pos int, source_id string, claim string, evidence string")
    got = [(r.answer_id, r.place, r.claim) for r in cl.verified_claims(df, sources(spark)).orderBy("answer_id", "place").collect()]
    assert got == [(1, 1, one), (1, 2, two)]


def test_diagnostics(spark):
    df = spark.createDataFrame([("kaks kuud tööandja palga maksma", "tööandja maksab 2 kuud palga"), (None, None)], "c string, e string")
    first, empty = (r.d for r in df.select(cl.diagnostics(F.col("c"), F.col("e")).alias("d")).collect())
    assert (first.n_words, first.n_shared, first.ratio) == (5, 3, 0.6) and first.missing_quantities == ["kaks"] and first.missing_words == ["kaks", "maksma"] and not first.passed
    assert (empty.n_words, empty.ratio, empty.passed) == (0, 0.0, False)


def test_targets_and_digest(spark):
    rows = [(1, 1, "a", True, [" ", "tls_1"], False), (1, 2, "b", False, ["x_1"], False), (2, 1, "a", True, ["x_1"], True), (3, 1, "a", True, [], False)]
    df = spark.createDataFrame(rows, "q int, place int, obligation string, enforced boolean, candidates array<string>, missing boolean")
    assert [(r.q, r.source_id) for r in cl.repair_targets(df, "q").collect()] == [(1, "TLS_1")]
    groups = spark.createDataFrame([(1, 1, [["X_1", "TLS_1"]]), (1, 2, [["TLS_1"], ["VOS_2"]]), (2, 1, [["X_1"]])], "q int, place int, groups array<array<string>>")
    (row,) = cl.source_digest(groups, sources(spark), "q").collect()
    assert row.ids == ["TLS_1"] and row.lines.split("\n")[0] == "Tööandja peab töötaja palga maksma kokkulepitud päeval [TLS_1]." and len(row.lines.split("\n")) == 2


def test_rule_problems(spark):
    rows = [("a", "a", "R1", [["A_1"]], [["x"]], "y"), ("b", "c", "R2", [["A_1"]], [], "y"), ("d", "d", "R3", [], [], "y"), ("e", "e", "R4", [[]], [], "y"), ("f", "f", "R5", [["a 1"]], [], "y"), ("g", "g", "R6", [["A_1"]], [[" "]], "y"), ("h", "h", "R7", [["A_1"]], None, " "), ("i", "i", "R8", [["A_1"]], [], "y"), ("j", "j", "R8", [["A_1"]], [], "y"), ("k", "k", None, [["A_1"]], [], "y"), ("l", "l", "R9", None, [], None)]
    df = spark.createDataFrame(rows, "key string, reason string, rule_id string, groups array<array<string>>, terms array<array<string>>, rationale string")
    got = {r.reason: r.problem for r in cl.rule_problems(df).collect()}
    again = "rule_id_empty_or_repeated"
    assert got == {"a": None, "c": "reason_mismatch", "d": "no_source_groups", "e": "empty_source_group", "f": "source_id_not_canonical", "g": "empty_term_group", "h": "no_rationale", "i": again, "j": again, "k": again, "l": "no_source_groups"}


def test_model_case(spark):
    rows = [(["tls_1"], [["TLS_1", "X"]], "Palk  makstakse", ["palk"], ["makstakse", "y"], True, "OK", False, False, (True, True)), (["a"], [["b"]], "x", [], [], True, "OK", False, False, (True, False)), ([], [], "x", [], [], True, "OK", False, False, (False, False)), (["a"], [], "x", ["z"], [], True, "OK", False, False, (True, False)), (["a"], [], "x", [], [], True, "OK", True, False, (True, False)), (["a"], [], "x", [], [], True, "", False, False, (False, False))]
    df = spark.createDataFrame([r[:-1] for r in rows], "s array<string>, g array<array<string>>, t string, e array<string>, o array<string>, c boolean, st string, f boolean, m boolean")
    got = [tuple(r.v) for r in df.select(cl.model_case(*(F.col(c) for c in df.columns)).alias("v")).collect()]
    assert got == [r[-1] for r in rows]


def test_chunks_keep_all_words(spark):
    rows = [("lühike",), ("",), (None,), ("aaaa bbb\ncccc ddd",), ("x" * 25,), ("aaaaaa. bbbbbb. cccccc",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r.chunks for r in cl.chunks(df, "t", 10, 4).collect()]
    assert got == [["lühike"], [], [], ["aaaa bbb", "cccc ddd"], ["x" * 10, "x" * 10, "x" * 5], ["aaaaaa", ". bbbbbb", ". cccccc"]]
    assert cl.chunks(df, "t", 10, 1).collect()[4].chunks == ["x" * 10 + "\n" + "x" * 9]


def test_questions_and_search_text(spark):
    said = ["Mis  on sinu isikukood?", "Millal see juhtus ?", "millal SEE juhtus ?", "", None, "Kas sa said otsuse"]
    df = spark.createDataFrame([(said,), ([],), (None,)], "q array<string>")
    assert df.select(cl.questions(F.col("q")).alias("q")).collect()[0].q == ["Millal see juhtus?", "Kas sa said otsuse?"]
    s = spark.createDataFrame([("lühike  tekst", "teema", ["a"]), ("pikk " * 10, "teema", ["a b", "A B", None]), ("pikk " * 10, None, None)], "o string, t string, p array<string>")
    got = [r.x for r in s.select(cl.search_text(F.col("o"), F.col("t"), F.col("p"), 20, 30).alias("x")).collect()]
    assert got == ["lühike tekst", "teema a b", ("pikk " * 6)]


def test_located_facts(spark):
    facts = spark.createDataFrame([(1, "10 EUR", 3), (1, "10 eur", 3), (1, "10 EUR", 9), (2, "x", 0)], "span int, value string, local int")
    spans = spark.createDataFrame([(1, 100)], "span int, start int")
    assert sorted(tuple(r) for r in cl.located(facts, spans, "span").collect()) == [(1, "10 EUR", 103, 109), (1, "10 EUR", 109, 115)]
