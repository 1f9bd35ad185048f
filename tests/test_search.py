"""Query interpretation, phrases by position and contained strings against brute force and stated cases."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lodestone.functions import python as py
from lodestone.operators import interpret as ip
from lodestone.operators import phrases
from lodestone.operators.fieldscore import Scored

RULE = "rule long, form_ord int, form string, expand array<string>, domains array<string>, sections array<string>"


def read(spark, text, rules=(), laws=(("ABIPOLS", "Abipolitseiniku seadus"),), sections=(), **more):
    rules = spark.createDataFrame(list(rules), RULE)
    named = spark.createDataFrame(list(laws), "domain string, phrase string")
    found = ip.interpret(
        spark.createDataFrame([(1, text), (2, None), (3, "a 1")], "q long, text string"), rules, ip.vocabulary(named, "domain", "phrase", rules),
        spark.createDataFrame([(s,) for s in sections], "id string"), "q", "text", **more,
    )
    assert found.matches.filter("query_id = 2").count() == 0
    return (
        [r.term for r in found.expanded.filter("query_id = 1").orderBy("pos").collect()],
        [(r.reason, r.original, r.candidate) for r in found.matches.filter("query_id = 1").orderBy("pos").collect()],
        {(r.domain, r.curated) for r in found.domains.filter("query_id = 1").collect()},
        {r.section for r in found.sections.filter("query_id = 1").collect()},
    )


def test_sequence_ratio_is_that_of_the_standard_library(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abca") for _ in range(rnd.randrange(0, 14)))
    pairs = [(word(), word()) for _ in range(500)] + [("abipoliteinuku", "abipolitseiniku"), ("", ""), ("a", "")]
    got = spark.createDataFrame(pairs, "a string, b string").select(py.sequence_ratio("a", "b").alias("r")).collect()
    assert [r.r for r in got] == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_typos_compounds_and_suffixes(spark):
    terms, matches, domains, _ = read(spark, "Kas abipoliteinuku võib mind kinni pidada?")
    assert terms == ["abipolitseiniku"] and matches == [("fuzzy", "abipoliteinuku", "abipolitseiniku")] and ("ABIPOLS", False) in domains
    terms, matches, _, _ = read(spark, "Kas abi politseiniku tegevus oli lubatud?")
    assert "abipolitseiniku" in terms and ("compound", "abi politseiniku", "abipolitseiniku") in matches
    assert read(spark, "kaks abi polit seiniku", laws=[("A", "abipolitseiniku")])[1] == [("compound", "abi polit seiniku", "abipolitseiniku")]
    assert read(spark, "Minu maasikamoos kukkus põrandale") == ([], [], set(), set())
    # A form without its suffix that is a term is an expansion, and no typo.
    assert read(spark, "avaldas", laws=[("A", "avalda seadus")])[:2] == (["avalda"], [])
    # Terms of more than three domains don't hint at these.
    assert read(spark, "seadus", laws=[(d, "seadus") for d in "ABCD"])[2] == set()


def test_rules_take_their_first_form(spark):
    rules = [
        (1, 0, "tood pole", ["koondamine"], ["TLS"], ["TLS_90"]), (1, 1, "pole", ["koondamine"], ["TLS"], ["TLS_90"]),
        (2, 0, "lahti", ["vallandamine", "koondamine"], ["TLS"], ["TLS_88"]), (3, 0, "mind lasti lahti sest", ["leping"], ["VOS"], []), (4, 0, "t pole", ["nothing"], ["X"], []),
    ]
    terms, matches, domains, sections = read(spark, "Mind lasti lahti, sest tööd pole!", rules)
    assert matches[:4] == [("lexicon", "tood pole", "koondamine"), ("lexicon", "lahti", "vallandamine"), ("lexicon", "lahti", "koondamine"), ("lexicon", "mind lasti lahti sest", "leping")]
    assert terms == ["koondamine", "vallandamine", "leping"] and sections == {"TLS_90", "TLS_88"} and domains == {("TLS", True), ("VOS", True)}


def test_span_patterns(spark):
    own = ["ABIPOLS_3", "ABIPOLS_16", "VTMS_19", "VTMS_57", "VTMS_114"]
    text = "Abipolitsei tegi mulle niisama seismise eest trahvi. Kas seda saab vaidlustada?"
    terms, matches, domains, sections = read(spark, text, sections=own)
    assert sections == set(own) and ("VTMS", True) in domains and "kaebuse tähtaeg" in terms
    # Sections that a rule has hinted at already, and terms that it gave, are not repeated; without known sections the pattern is silent.
    rule = (1, 0, "abipolitsei", ["kaebuse tähtaeg"], ["A"], own[:3])
    assert [m[2] for m in read(spark, text, [rule], sections=own)[1]].count("kaebuse tähtaeg") == 1
    other = [("A", "seadus")]
    assert read(spark, text, [(*rule[:5], own)], other, own)[0] == ["kaebuse tähtaeg"] and read(spark, text, laws=other)[0] == []
    both = ["VTMS_114", "VTMS_118", "KARS_66", "VTMS_57", "VTMS_74", "VTMS_204"]
    terms, _, domains, sections = read(spark, "Rahatrahvi kaebetähtaeg on möödas. Kas saan tähtaja ennistada ja trahvi maksta osade kaupa?", sections=both)
    assert sections == set(both) and {"tähtaja ennistamise taotlus", "rahatrahvi tasumine ositi"} <= set(terms) and {("KARS", True), ("VTMS", True)} <= domains


def test_a_full_list_ends_corrections(spark):
    """Tokens count as long as fewer than `most` terms stand before them; the list is cut."""
    rules = [(1, 0, "alpha", ["one", "two"], ["A"], [])]
    laws = [("A", "keyboardist"), ("B", "mustardseed"), ("C", "lanternfish")]
    text = "alpha keybordist mustarseed lanternfsh"
    terms, matches, domains, _ = read(spark, text, rules, laws, most=3)
    assert terms == ["one", "two", "keyboardist"] and [m[2] for m in matches] == terms and ("B", False) not in domains
    assert read(spark, text, rules, laws)[0] == ["one", "two", "keyboardist", "mustardseed", "lanternfish"]


def test_phrases_by_position_are_plain_substrings(spark):
    rnd = random.Random(9)
    words = ["ab", "a", "abc", "bcab", "c", "cab", "abcabc", "bc"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    docs = [(k, text(rnd.randrange(0, 40))) for k in range(120)] + [(500, text(4000)), (501, None), (502, ""), (503, "ab")]
    names = [text(n) for n in (2, 2, 2, 3, 3, 4, 5) for _ in range(6)] + ["ab ab ab", "ab"]
    df = spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", F.split("text", " ").alias("w"))
    got = {tuple(r) for r in phrases.occurrences(df, "w", spark.createDataFrame([(p,) for p in names], "phrase string")).collect()}
    assert got == {(d, p) for d, t in docs for p in set(names) if " " in p and p in (t or "")} and len(got) > 100
    assert phrases.occurrences(df, "w", spark.createDataFrame([], "phrase string")).count() == 0


def test_contained_strings(spark):
    rnd = random.Random(11)
    text = lambda n: "".join(rnd.choice("ab ") for _ in range(n))
    texts = [(k, text(60)) for k in range(40)] + [(90, ""), (91, None)]
    names = [text(n) for n in (1, 2, 3, 5, 8, 12, 13, 14) for _ in range(8)] + ["", None]
    got = {tuple(r) for r in phrases.contained(spark.createDataFrame(texts, "query_id long, f string"), spark.createDataFrame([(s,) for s in names], "s string")).collect()}
    assert got == {(q, s) for q, t in texts for s in set(names) if s and t and s in t} and len(got) > 100


def test_steps_of_the_scores(spark):
    """Ids, titles, aliases, keywords, hints, phrases and synonyms give their points; hints only where there is a score."""
    corpus = [
        (1, "VOS_308", "Üürileping", ["Korteri üür"], "Üürileping on leping.", "VOS"), (2, "VOS_309", "Muu", None, "Hoopis muud sõnad siin.", "VOS"),
        (3, "TLS_90", "Tähtaeg", ["koondamine"], "Koondamise korral on pikk tähtaeg ette nähtud.", "TLS"), (4, "X_1", None, [], None, "X"), (5, "eluruum", "", [], "midagi", "VOS"),
    ]
    laws = spark.createDataFrame(corpus, "doc_id long, id string, title string, aliases array<string>, text string, domain string")
    queries = spark.createDataFrame([(1, "Korteri üür ja üürileping"), (2, "pikk tahtaeg"), (3, "eluruum"), (4, None)], "query_id long, text string")
    rules = spark.createDataFrame([(1, 0, "pikk", ["korral on"], ["TLS"], [])], RULE)
    none = spark.createDataFrame([], "id string")
    found = ip.interpret(queries, rules, ip.vocabulary(laws.limit(0), "domain", "title", rules), none, "query_id", "text")
    keywords, synonyms = spark.createDataFrame([("VOS", "korter")], "domain string, keyword string"), spark.createDataFrame([("uur", "sonad")], "base string, related string")
    scored = Scored(laws, queries, found, synonyms, keywords)
    legacy = {(r.query_id, r.doc_id): float(r.score) for r in scored.legacy().collect()}
    # Title 8, alias 6, one exact token 3, keyword 4; the synonym alone gives the second document 3, and the keyword 4.
    assert legacy[1, 1] == 8 + 6 + 3 + 4 and legacy[1, 2] == 3 + 4
    # Title 8, two exact tokens 6; the phrase's words count by themselves in the legacy score only if they are tokens; curated hint 18.
    assert legacy[2, 3] == 8 + 6 + 2 + 18
    assert legacy[3, 5] == 15 and {q for q, _ in legacy} == {1, 2, 3}
    full = {(r.query_id, r.doc_id): (float(r.score), r.matched) for r in scored.full().collect()}
    assert set(full) == set(legacy) and full[2, 3][1] == 3 and full[2, 3][0] > 14 + 18 + 7 * 3 and full[1, 2][1] == 1


def test_no_rows(spark):
    with pytest.raises(Exception, match="no such column|UNRESOLVED_COLUMN"):
        phrases.contained(spark.createDataFrame([], "query_id long, f string"), spark.createDataFrame([], "x string")).collect()
    assert phrases.contained(spark.createDataFrame([], "query_id long, f string"), spark.createDataFrame([], "s string")).count() == 0
