"""Claims and their evidence: diagnostics, recovery, gates, repair targets and digests; checks of coverage rules; pieces of an intake.

Claims meet their sources in equi-joins on the canonical id. What is ordered within an answer is an array of its claims,
since an answer has few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from . import planning, review, verify

# Words that don't count when evidence is looked for, beside verify.LIGHT.
LIGHTER = ["kohta", "korral", "alusel", "vastavalt"]
# A source id in a coverage rule.
RULE_SOURCE = "^[A-ZÕÄÖÜ0-9]+_[A-ZÕÄÖÜ0-9]+$"
# Phrasings of questions and what replaces them.
POLISH = [
    (r"(?iU)^Kas töötaja on teadlik,\s*millist konkreetset vigu teda süüdistatakse\??$", "Kas tööandja ütles, millises konkreetses rikkumises ta sind süüdistab?"),
    (r"(?iU)^Kui kaua kestis töösuhkus enne seda sündmust\??$", "Kui kaua olid enne vallandamist selle tööandja juures töötanud?"),
    (r"(?iU)\bmillist konkreetset vigu\b", "millistes konkreetsetes vigades"),
]


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def _words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit("[a-zõäöü]{4,}"), F.lit(0)))


def diagnostics(claim: Column, evidence: Column, most: int = 40) -> Column:
    """passed, n_words, n_shared, ratio (4 decimals), missing_quantities, missing_words (the first `most` in order) of verify.claim_supported()."""
    c, e = t.evidence_form(claim), t.evidence_form(evidence)
    words, known = verify.content_words(c), _words(e)
    shared = F.size(F.array_intersect(words, known))
    return F.struct(
        verify.claim_supported(claim, evidence).alias("passed"),
        F.size(words).alias("n_words"),
        shared.alias("n_shared"),
        F.when(F.size(words) > 0, F.round(shared / F.size(words), 4)).otherwise(F.lit(0.0)).alias("ratio"),
        F.array_sort(F.array_except(t.quantities(c), t.quantities(e))).alias("missing_quantities"),
        F.slice(F.array_sort(F.array_except(words, known)), 1, most).alias("missing_words"),
    )


def _sourced(claims: DataFrame, sources: DataFrame, how: str) -> DataFrame:
    """Claims with the text of their source as __source, null without one; of sources with equal ids the least text. Only sources that are named are shuffled."""
    keyed = claims.withColumn("__key", t.canonical_id("source_id"))
    named = sources.select(t.canonical_id("source_id").alias("__key"), t.text("text").alias("text")).join(keyed.select("__key").distinct(), "__key", "left_semi")
    own = named.groupBy("__key").agg(F.min("text").alias("__source"))
    return keyed.join(own, "__key", how).drop("__key")


def recovered(claims: DataFrame, sources: DataFrame, least: int = 24) -> DataFrame:
    """claim_id, evidence, overlap: the sentence of a claim's source that shares most words with claim and evidence, of equals the shortest, then the first.

    claims: (claim_id, source_id, claim, evidence). A sentence of `least` characters counts that shares two words (one where
    fewer than three are asked for) and supports the claim; claims without one have no row. Sentences are combined by claim
    before the shuffle.
    """
    wanted = F.array_except(_words(F.lower(F.concat_ws(" ", "claim", "evidence"))), F.array(*map(F.lit, verify.LIGHT + LIGHTER)))
    both = _sourced(claims.select("claim_id", "source_id", "claim", wanted.alias("q")).filter(F.size("q") > 0), sources, "inner")
    parts = both.select("claim_id", "claim", "q", F.posexplode(F.split("__source", r"(?<=[.!?])\s+|\n+")).alias("p", "s")).withColumn("s", _strip(F.col("s")))
    near = parts.withColumn("overlap", F.size(F.array_intersect("q", _words(F.lower("s"))))).filter(F.col("overlap") >= F.when(F.size("q") < 3, 1).otherwise(2))
    good = near.filter((F.length(t.evidence_form("s")) >= least) & verify.claim_supported(F.col("claim"), F.col("s")))
    best = good.groupBy("claim_id").agg(F.max(F.struct("overlap", (-F.length("s")).alias("l"), (-F.col("p")).alias("p"), "s")).alias("b"))
    return best.select("claim_id", F.col("b.s").alias("evidence"), F.col("b.overlap").alias("overlap"))


def verified_claims(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """answer_id, place, source_id, claim, evidence: what of an answer's claims (answer_id, pos, source_id, claim, evidence) holds, numbered from 1.

    Claims of unknown sources or with evidence that is no quote go; a claim that its evidence doesn't support is replaced by
    the evidence; of claims with equal text, or equal source and evidence, the first that stays is kept.
    """
    clean = claims.withColumns({"claim": review.generated(t.text("claim")), "evidence": review.generated(t.text("evidence"))})
    valid = _sourced(clean, sources, "inner").filter(verify.evidence_valid(F.col("evidence"), F.col("__source")))
    said = F.when(verify.claim_supported(F.col("claim"), F.col("evidence")), F.col("claim")).otherwise(F.col("evidence"))
    rows = valid.select("answer_id", "pos", t.canonical_id("source_id").alias("source_id"), said.alias("claim"), "evidence")
    rows = rows.withColumns({"form": t.evidence_form("claim"), "quote": t.evidence_form("evidence")}).filter("claim <> ''")
    listed = rows.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("pos", "source_id", "claim", "evidence", "form", "quote"))).alias("l"))
    same = lambda a, b: (a["form"] == b["form"]) | ((a["source_id"] == b["source_id"]) & (a["quote"] == b["quote"]))
    kept = F.aggregate("l", F.slice("l", 1, 0), lambda out, x: F.when(F.exists(out, lambda y: same(x, y)), out).otherwise(F.concat(out, F.array(x))))
    return listed.select("answer_id", F.posexplode(kept).alias("k", "c")).select("answer_id", (F.col("k") + 1).alias("place"), "c.source_id", "c.claim", "c.evidence")


def repair_gate(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """claim_id, reason (null for accepted claims), evidence (of accepted ones), recovered: claims (claim_id, source_id, claim, evidence) of a repair, with evidence recovered where it is no quote."""
    clean = claims.select("claim_id", "source_id", review.generated(t.text("claim")).alias("claim"), review.generated(t.text("evidence")).alias("evidence"))
    known = _sourced(clean, sources, "left").withColumn("exact", F.coalesce(verify.evidence_valid(F.col("evidence"), F.col("__source")), F.lit(False)))
    again = recovered(known.filter(~F.col("exact") & (F.col("claim") != "")), sources).select("claim_id", F.col("evidence").alias("__found"))
    reason = (
        F.when(F.col("__source").isNull(), "unknown_source")
        .when(F.col("claim") == "", "empty_claim_text")
        .when(~F.col("exact") & F.col("__found").isNull(), "evidence_not_recoverable")
        .when(F.col("exact") & ~verify.claim_supported(F.col("claim"), F.col("evidence")), "claim_not_supported_by_evidence")
    )
    out = known.join(again, "claim_id", "left").withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return out.select("claim_id", "reason", F.when(ok, F.coalesce("__found", "evidence")).alias("evidence"), (ok & ~F.col("exact")).alias("recovered"))


def repair_targets(rows: DataFrame, by: str) -> DataFrame:
    """by, place, obligation, source_id: the first candidate source of each enforced obligation; none where a source of the request is missing.

    rows: (by, place, obligation, enforced, candidates array<string>, missing boolean).
    """
    lacking = rows.filter("missing").select(by).distinct()
    first = F.get(F.filter(F.transform(F.col("candidates"), lambda c: t.record_id(c)), lambda c: c != ""), F.lit(0))
    return rows.filter("enforced").join(lacking, by, "left_anti").select(by, "place", "obligation", first.alias("source_id")).filter("source_id IS NOT NULL")


def source_digest(rows: DataFrame, sources: DataFrame, by: str, most: int = 2) -> DataFrame:
    """by, lines, ids: of each group's first source that is there, each source once, `most` sentences with its id.

    rows: (by, place, groups array<array<string>>); sources: (source_id, text).
    """
    groups = rows.select(by, "place", F.posexplode("groups").alias("g", "ids")).select(by, "place", "g", F.posexplode("ids").alias("i", "source_id"))
    groups = groups.withColumn("id", t.record_id("source_id"))
    named = sources.select(t.record_id("source_id").alias("id"), t.text("text").alias("text")).join(groups.select("id").distinct(), "id", "left_semi")
    there = groups.join(named.select("id").distinct(), "id", "left_semi")
    chosen = there.groupBy(by, "place", "g").agg(F.min_by("id", "i").alias("id")).groupBy(by, "id").agg(F.min(F.struct("place", "g")).alias("at"))
    line = lambda s: F.concat(F.regexp_replace(s, r"[.!?;:]+\z", ""), F.lit(" ["), F.col("id"), F.lit("]."))
    own = named.join(chosen.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    said = chosen.join(own, "id").select(by, "at", "id", F.transform(F.slice(t.sentences("text"), 1, most), line).alias("s")).filter(F.size("s") > 0)
    listed = said.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("at", "id", "s"))).alias("l"))
    return listed.select(by, F.array_join(F.flatten(F.transform("l", lambda x: x["s"])), "\n").alias("lines"), F.transform("l", lambda x: x["id"]).alias("ids"))


def rule_problems(rules: DataFrame) -> DataFrame:
    """reason, rule_id, problem (null where there is none) of coverage rules (key, reason, rule_id, groups, terms, rationale).

    A rule id that several rules have counts for all of them. The first problem is named.
    """
    times = rules.groupBy("rule_id").agg(F.count(F.lit(1)).alias("__n"))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    empty = lambda g: g.isNull() | (F.size(g) <= 0)
    groups, terms = F.coalesce("groups", F.array().cast("array<array<string>>")), F.coalesce("terms", F.array().cast("array<array<string>>"))
    problem = (
        F.when(blank(F.col("key")) | ~F.col("key").eqNullSafe(F.col("reason")), "reason_mismatch")
        .when(blank(F.col("rule_id")) | (F.coalesce("__n", F.lit(1)) > 1), "rule_id_empty_or_repeated")
        .when(F.size(groups) == 0, "no_source_groups")
        .when(F.exists(groups, empty), "empty_source_group")
        .when(F.exists(F.flatten(groups), lambda s: ~F.coalesce(s.rlike(RULE_SOURCE), F.lit(False))), "source_id_not_canonical")
        .when(F.exists(terms, lambda g: empty(g) | F.exists(g, blank)), "empty_term_group")
        .when(blank(F.col("rationale")), "no_rationale")
    )
    return rules.join(times, "rule_id", "left").select("reason", "rule_id", problem.alias("problem"))


def model_case(sources: Column, groups: Column, text: Column, every: Column, some: Column, completed: Column, status: Column, fallback: Column, mock: Column) -> Column:
    """safe: a completed run, with a status and a verified source, of no mock. passed: also by the model, with a source of each group, every phrase and some phrase."""
    upper = F.transform(sources, lambda s: F.upper(F.trim(s)))
    form = t.casefold(text)
    hit = F.forall(groups, lambda g: (F.size(g) == 0) | F.arrays_overlap(F.transform(g, lambda s: F.upper(F.trim(s))), upper))
    has = lambda p: form.contains(t.casefold(p))
    safe = completed & (F.coalesce(status, F.lit("")) != "") & (F.size(sources) > 0) & ~mock
    return F.struct(safe.alias("safe"), (safe & ~fallback & hit & F.forall(every, has) & ((F.size(some) == 0) | F.exists(some, has))).alias("passed"))


def chunks(rows: DataFrame, text: str, size: int = 15_000, most: int = 4) -> DataFrame:
    """Adds chunks: the text in up to `most` pieces of `size` characters, cut at the last line end, else the last sentence end, of a piece's second half, else at its end.

    What is left joins the last piece, which holds 2 * size characters. A text that fits is one chunk as it is.
    """
    whole = t.text(text)
    out = rows.withColumns({"__rest": whole, "chunks": F.array().cast("array<string>")})
    for _ in range(most):
        head = F.left("__rest", F.lit(size))
        at = lambda mark: F.length(head) - F.length(F.substring_index(head, mark, -1)) - len(mark)  # noqa: B023, E731
        out = out.withColumn("__cut", F.when(F.length("__rest") <= size, F.length("__rest")).when(at("\n") >= size // 2, at("\n")).when(at(". ") >= size // 2, at(". ")).otherwise(size))
        fits = F.length("__rest") <= size
        piece = F.when(fits, F.col("__rest")).otherwise(_strip(F.left("__rest", F.col("__cut"))))
        rest = F.when(fits, F.lit("")).otherwise(_strip(F.substring("__rest", F.col("__cut") + 1, F.length("__rest"))))
        out = out.withColumns({"chunks": F.when(F.col("__rest") == "", F.col("chunks")).otherwise(F.concat("chunks", F.array(piece))), "__rest": rest})
    last = F.left(F.concat(F.element_at("chunks", -1), F.lit("\n"), F.col("__rest")), F.lit(2 * size))
    joined = F.when(F.col("__rest") == "", F.col("chunks")).otherwise(F.concat(F.slice("chunks", 1, F.size("chunks") - 1), F.array(last)))
    whole_or_cut = F.when(F.length(whole) <= size, F.array(whole)).otherwise(joined)
    return out.withColumn("chunks", F.filter(whole_or_cut, lambda c: c != "")).drop("__rest", "__cut")


def unique_texts(values: Column, most: int, chars: int = 600) -> Column:
    """Values with white space collapsed, cut to `chars`, without blanks, each once whatever its case (the first stays), `most` at most."""
    clean = F.filter(F.transform(values, lambda v: F.left(F.trim(F.regexp_replace(t.text(v), r"[\s\x00]+", " ")), F.lit(chars))), lambda v: v != "")
    keys = F.transform(clean, lambda v: t.casefold(v))
    first = F.filter(F.arrays_zip(clean.alias("v"), keys.alias("k")), lambda x, i: F.array_position(keys, x["k"]) == i + 1)
    return F.slice(F.transform(first, lambda x: x["v"]), 1, most)


def questions(values: Column) -> Column:
    """Up to three questions of 220 characters, without those that ask for an identifier, reworded where a phrasing is known, each with a question mark."""

    def polish(q: Column) -> Column:
        out = F.regexp_replace(q, r"\s+([,.;:!?])", "$1")
        for pattern, value in POLISH:
            out = F.regexp_replace(out, pattern, value)
        return F.when(out.endswith("?"), out).otherwise(F.concat(out, F.lit("?")))

    return F.transform(F.filter(unique_texts(values, 3, 220), lambda q: ~planning.asks_identifier(q)), polish)


def search_text(original: Column, topic: Column, parts: Column, short: int = 3000, most: int = 2000) -> Column:
    """What is searched for: a short description as it is, a longer one by its topic and the evidence in `parts`, cut to `most`."""
    grounded = F.array_join(unique_texts(F.concat(F.array(t.text(topic)), F.coalesce(parts, F.array().cast("array<string>"))), 20), " ")
    squeezed = lambda c: F.left(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(most))
    return F.when((F.length(original) <= short) | (grounded == ""), squeezed(original)).otherwise(squeezed(grounded))


def located(facts: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """key, value, start, end: facts (key, value, local) placed in the whole document by their span's start; of facts with equal value (whatever its case), span and place one stays."""
    at = facts.join(spans.select(key, F.col("start").alias("__start")), key)
    put = at.select(key, "value", (F.col("__start") + F.col("local")).alias("start")).withColumn("__k", t.casefold("value"))
    return put.groupBy(key, "__k", "start").agg(F.min("value").alias("value")).select(key, "value", "start", (F.col("start") + F.length("value")).alias("end"))
