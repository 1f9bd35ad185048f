"""Fail-closed verification: citations, quoted evidence, support of claims, concept relevance, coverage of obligations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

# Words of a claim that announce an inference, and words that don't count as content.
INFERENCE = ["mis tähendab", "seega", "järelikult", "mistõttu", "sellest tuleneb"]
FORBIDDEN = ["seega", "järelikult", "kindlasti", "vaieldamatult", "ebaseaduslik", "õigustühine", "kehtetu"]
LIGHT = ["selle", "ning", "kuid", "vaid", "tuleb", "saab", "peab"]
LAW_MENTION = r"(?iU)\b(VÕS|VOS|TLS|KarS|KrMS|TsMS|seadus|seaduse|paragrahv|paragrahvi)\b|§"
APPLICATION = r"(?isU)ÕIGUSLIK\s+KOHALDAMINE\s*:\s*(.*?)(?=\n\s*(?:SOOVITUSED|KASUTATUD\s+ALLIKAD)\s*:|\z)"


def content_words(c: Column) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(c, F.lit("[a-zõäöü]{4,}"), F.lit(0))), F.array(*map(F.lit, LIGHT)))


def evidence_valid(evidence: Column, source: Column, least: int = 24) -> Column:
    """The evidence in matching form has `least` characters and stands in the source."""
    e = t.evidence_form(evidence)
    return (F.length(e) >= least) & t.evidence_form(source).contains(e)


def claim_supported(claim: Column, evidence: Column) -> Column:
    """No inference of its own, no quantity that the evidence lacks, and half of four or more content words in it."""
    c, e = t.evidence_form(claim), t.evidence_form(evidence)
    inferred = F.lit(False)
    for marker in INFERENCE:
        inferred |= c.contains(marker) & ~e.contains(marker)
    words = content_words(c)
    known = F.size(F.array_intersect(words, F.regexp_extract_all(e, F.lit("[a-zõäöü]{4,}"), F.lit(0))))
    fits = (F.size(words) < 4) | (2 * known >= F.size(words))
    return (c != "") & ~inferred & (F.size(F.array_except(t.quantities(c), t.quantities(e))) == 0) & fits


def comparison_supported(claim: Column, law: Column, document: Column) -> Column:
    """No forbidden word, quantities and half of the content words from both inputs together, and a word from each."""
    c, a, b = (t.evidence_form(x) for x in (claim, law, document))
    bad = F.lit(False)
    for word in FORBIDDEN:
        bad |= c.contains(word)
    words = content_words(c)
    of = lambda x: F.array_intersect(words, F.regexp_extract_all(x, F.lit("[a-zõäöü]{4,}"), F.lit(0)))
    both = F.size(F.array_union(of(a), of(b)))
    quantities = F.size(F.array_except(t.quantities(c), t.quantities(F.concat_ws(" ", a, b)))) == 0
    return (c != "") & ~bad & quantities & ((F.size(words) < 4) | (2 * both >= F.size(words))) & (F.size(of(a)) > 0) & (F.size(of(b)) > 0)


def verify_citations(answers: DataFrame, known: DataFrame, answer_id: str = "answer_id", text_col: str = "answer", known_id: str = "id") -> DataFrame:
    """answer_id, n_cited, n_unknown, n_uncited_mentions, application_cited, verified and sources (empty unless verified).

    known: all ids that may be cited. Ids are compared by joins; an answer without citations, with an unknown one, with
    a claim that mentions a law without citing, or with an uncited claim in its application section is rejected.
    """
    base = answers.select(F.col(answer_id).alias("answer_id"), t.text(text_col).alias("answer"))
    cited = base.select("answer_id", F.explode(t.cited_ids("answer")).alias("id"))
    ids = known.select(t.record_id(known_id).alias("id")).distinct().withColumn("found", F.lit(True))
    checked = cited.join(ids, "id", "left").groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_cited"), F.count_if(F.col("found").isNull()).alias("n_unknown"), F.array_sort(F.collect_set("id")).alias("ids"))
    uncited = lambda c: ~c.rlike(t.CITATION)
    mentions = F.size(F.filter(t.claims("answer"), lambda c: c.rlike(LAW_MENTION) & uncited(c)))
    section = F.filter(t.claims(F.regexp_extract("answer", APPLICATION, 1)), lambda c: F.size(F.regexp_extract_all(c, F.lit("[A-Za-zÕÄÖÜõäöü]{2,}"), F.lit(0))) >= 3)
    out = base.select("answer_id", mentions.alias("n_uncited_mentions"), ((F.size(section) > 0) & F.forall(section, lambda c: ~uncited(c))).alias("application_cited"))
    out = out.join(checked, "answer_id", "left").fillna(0, ["n_cited", "n_unknown"])
    good = (F.col("n_cited") > 0) & (F.col("n_unknown") == 0) & (F.col("n_uncited_mentions") == 0) & F.col("application_cited")
    return out.select("answer_id", "n_cited", "n_unknown", "n_uncited_mentions", "application_cited", good.alias("verified"), F.when(good, F.col("ids")).otherwise(F.array().cast("array<string>")).alias("sources"))


def verify_evidence(claims: DataFrame, sources: DataFrame, least: int = 24) -> DataFrame:
    """answer_id and accepted: every claim's evidence is a quote of its source. One bad claim rejects the whole answer.

    claims: (answer_id, claim_id, source_id, evidence); sources: (source_id, text), joined on the id.
    """
    joined = claims.withColumn("key", t.canonical_id("source_id")).join(sources.select(t.canonical_id("source_id").alias("key"), F.col("text").alias("source")), "key", "left")
    ok = F.coalesce(evidence_valid(F.col("evidence"), F.col("source"), least), F.lit(False))
    return joined.groupBy("answer_id", "claim_id").agg(F.max(ok).alias("ok")).groupBy("answer_id").agg(F.min("ok").alias("accepted"))


def concepts(c: Column, patterns: dict[str, list[str]]) -> Column:
    """Names of the concepts of which a pattern is found."""
    hit = lambda ps: F.coalesce(F.greatest(*(c.rlike(p) for p in ps), F.lit(False)), F.lit(False))
    return F.array_compact(F.array(*(F.when(hit(ps), F.lit(name)) for name, ps in patterns.items())))


def anchored(asked: Column, given: Column, queries: dict[str, list[str]], anchors: dict[str, list[str]]) -> Column:
    """Every concept that is asked for is anchored in what is given."""
    return F.size(F.array_except(concepts(asked, queries), concepts(given, anchors))) == 0


def coverage(obligations: DataFrame, available: DataFrame, cited: DataFrame) -> DataFrame:
    """request_id, obligation, status of each obligation.

    obligations: (request_id, obligation, groups array<array<string>>, terms array<array<string>>, answer_folded).
    COVERED needs a cited source of each group and a term of each term group; without an available source of some group
    it is SOURCE_MISSING; without groups RULE_UNRESOLVED; else ANSWER_MISSING. available, cited: (request_id, id).
    """
    per = lambda df, name: df.groupBy("request_id").agg(F.collect_set(t.record_id("id")).alias(name))
    rows = obligations.join(per(available, "available"), "request_id", "left").join(per(cited, "cited"), "request_id", "left")
    none = F.array().cast("array<string>")
    has = lambda name: F.forall(F.col("groups"), lambda g: F.arrays_overlap(g, F.coalesce(F.col(name), none)))
    said = F.forall(F.coalesce(F.col("terms"), F.array().cast("array<array<string>>")), lambda g: F.exists(g, lambda w: F.col("answer_folded").contains(w)))
    status = F.when(F.size("groups") <= 0, "RULE_UNRESOLVED").when(~has("available"), "SOURCE_MISSING").when(has("cited") & (said | F.col("answer_folded").isNull()), "COVERED").otherwise("ANSWER_MISSING")
    return rows.select("request_id", "obligation", status.alias("status"))
