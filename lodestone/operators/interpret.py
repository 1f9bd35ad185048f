"""Query interpretation: one ordered expansion list a query, with domain and section hints and the matches behind them.

Stages, in this order: rules of a lexicon (the first form of a rule that the query has counts), span patterns, domains of
exact terms, neighbouring words written as one, and by token its forms without a suffix or else its likeliest correction.
The vocabulary has the terms of headings and rules with the domains they are used in. Everything is joins and windows by
query; the rules are looked up by their runs of words, corrections by shared trigrams.

A term is in the expansion list once, where it first came up; the list is cut at `most`. Tokens after the list is full are
not corrected.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import python as py
from ..functions import text as t
from ..sources.staging import written
from .understanding import EXPANSIONS, HINTS, phrases

THRESHOLD, SHORTLIST, LEAST = 0.82, 120, 5


@dataclass(frozen=True)
class Pattern:
    """Expansions and hints of queries whose folded text has, for each group of patterns, one of them.

    fresh: counts only where the rules have not hinted at all its sections already, and adds no match for terms of the rules.
    """

    name: str
    groups: list[list[str]]
    expand: list[str]
    domains: list[str]
    sections: list[str] = field(default_factory=list)
    fresh: bool = False


# Words, patterns, terms and section ids of three kinds of questions about fines.
FINE = [r"\b(?:trahv\w*|rahatrahv\w*|vaarte\w*)\b"]
PATTERNS = [
    Pattern(
        "abipolitsei … trahv", [[r"\babipolitsei\w*\b.{0,160}\btrahv\w*\b", r"\btrahv\w*\b.{0,160}\babipolitsei\w*\b"]],
        ["abipolitseiniku pädevus", "menetlusaluse isiku õigused", "kiirmenetluse otsus", "kaebuse tähtaeg"], ["ABIPOLS", "VTMS"],
        ["ABIPOLS_3", "ABIPOLS_16", "VTMS_19", "VTMS_57", "VTMS_114"], True,
    ),
    Pattern(
        "kaebetähtaeg möödas", [FINE, [r"\btahta\w*\b.{0,60}\b(?:moodas|uletatud|hiljaks|ennist\w*)\b", r"\bennist\w*\b.{0,60}\btahta\w*\b"]],
        ["kaebuse tähtaeg", "tähtaja ennistamise taotlus", "kaebuse läbi vaatamata jätmine"], ["VTMS"], ["VTMS_114", "VTMS_118"],
    ),
    Pattern(
        "järelmaks või osade kaupa", [FINE, [r"\b(?:jarelmaks\w*|osamak\w*|maksegraaf\w*|ositi)\b", r"\bosade\s+kaupa\b"]],
        ["rahatrahvi tasumine ositi", "osastatud rahatrahvi osamaksed", "rahatrahvi täitmisele pööramine"], ["KARS", "VTMS"], ["KARS_66", "VTMS_57", "VTMS_74", "VTMS_204"],
    ),
]


def vocabulary(rows: DataFrame, domain: str, text: str, rules: DataFrame | None = None) -> DataFrame:
    """term, domains of phrases (see understanding.phrases) and of the rules' expansions under the rules' domains."""
    named = rows.select(F.col(domain).alias("domain"), F.col(text).alias("phrase"))
    if rules is not None:
        of_rules = rules.select("rule", "expand", "domains").distinct().select(F.explode("expand").alias("phrase"), "domains").select(F.explode("domains").alias("domain"), "phrase")
        named = named.unionByName(of_rules)
    return phrases(named, "domain", "phrase", LEAST)


@dataclass(frozen=True)
class Interpretation:
    """matches: query_id, pos, original, candidate, score, domains, reason. expanded: query_id, pos, term.
    domains: query_id, domain, curated. sections: query_id, section."""

    matches: DataFrame
    expanded: DataFrame
    domains: DataFrame
    sections: DataFrame


def _runs(rules: DataFrame) -> list:
    lengths = sorted(r["n"] for r in rules.select(F.size(F.split("form", " ")).alias("n")).distinct().collect())
    none = F.array().cast("array<string>")
    run = lambda n: F.transform(F.sequence(F.lit(1), F.size("all") - (n - 1)), lambda k: F.array_join(F.slice("all", k, n), " "))
    return [none, *(F.col("w") if n == 1 else F.when(F.size("all") >= n, run(n)).otherwise(none) for n in lengths)]


def _cut(width: int):
    return lambda k: F.slice("w", k, width)


def _row(stage: int, a, b, original, candidate, score, domains, reason: str):
    """Columns of a step: what came up where, and on what ground."""
    return [
        F.col("query_id"), F.lit(stage).alias("stage"), F.coalesce(a, F.lit(0)).cast("long").alias("a"), b.cast("int").alias("b"), original.alias("original"), candidate.alias("candidate"),
        score.alias("score"), domains.alias("domains"), F.lit(reason).alias("reason"),
    ]


def corrections(tokens: DataFrame, terms: DataFrame, threshold: float = THRESHOLD, shortlist: int = SHORTLIST) -> DataFrame:
    """token, term, score: of each token the likeliest term.

    Among the `shortlist` terms with the most shared trigrams, 0.9 * sequence ratio + 0.1 * trigram Jaccard of `threshold` or
    more; lengths may differ by 4 or two fifths of the token's. Equals go by term.
    """
    grams = lambda rows, c: rows.select(c, F.explode(t.char_ngrams(F.col(c))).alias("gram"))
    hits = grams(tokens, "token").join(grams(terms, "term"), "gram").groupBy("token", "term").agg(F.count(F.lit(1)).alias("hits"))
    best = lambda *order: F.row_number().over(Window.partitionBy("token").orderBy(*order, "term"))
    short = hits.withColumn("k", best(F.col("hits").desc())).filter(F.col("k") <= shortlist).filter("token <> term")
    short = short.filter(F.abs(F.length("term") - F.length("token")) <= F.greatest(F.lit(4), F.floor(F.lit(0.4) * F.length("token"))))
    score = F.round(0.9 * py.sequence_ratio("token", "term") + 0.1 * t.jaccard(t.char_ngrams(F.col("token")), t.char_ngrams(F.col("term"))), 9)
    return short.withColumn("score", score).filter(F.col("score") >= threshold).withColumn("k", best(F.col("score").desc())).filter("k = 1").select("token", "term", "score")


def interpret(
    queries: DataFrame, rules: DataFrame, vocabulary: DataFrame, sections: DataFrame, query_id: str, text: str, patterns: list[Pattern] = PATTERNS, most: int = EXPANSIONS,
) -> Interpretation:
    """rules: (rule, form_ord, form, expand, domains, sections), forms and expansions folded. sections: (id) that exist; span patterns hint at these only."""
    asked = queries.select(F.col(query_id).alias("query_id"), t.fold(text).alias("f")).withColumn("all", F.split("f", " "))
    asked = asked.withColumn("w", F.filter("all", lambda x: F.length(x) >= 2)).filter(F.size("w") > 0)
    curated, one = F.lit(1.0), F.col("domains")

    # 1. Rules: a run of words is looked up; of a rule's forms the first counts.
    found = asked.select("query_id", F.explode(F.array_distinct(F.concat(*_runs(rules)))).alias("form")).join(rules, "form")
    found = found.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "rule").orderBy("form_ord"))).filter("k = 1").drop("k")
    found = written(found.select("query_id", "rule", "form", "expand", "domains", "sections"), "rules")
    by_rule = found.select("query_id", "rule", "form", one, F.posexplode("expand").alias("at", "term"))
    steps = by_rule.select(*_row(1, F.col("rule"), F.col("at"), F.col("form"), F.col("term"), curated, one, "lexicon"))
    hints = [found.select("query_id", F.explode("domains").alias("domain"), F.lit(True).alias("curated"))]
    section_hints = [found.select("query_id", F.explode("sections").alias("section"))]

    # 2. Span patterns.
    there = {r["id"] for r in sections.select("id").filter(F.col("id").isin([s for p in patterns for s in p.sections])).distinct().collect()} if patterns else set()
    hinted = found.groupBy("query_id").agg(F.flatten(F.collect_list("sections")).alias("has"))
    terms = by_rule.groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    base = asked.select("query_id", "f").join(hinted, "query_id", "left").join(terms, "query_id", "left")
    none = F.array().cast("array<string>")
    for k, p in enumerate(patterns):
        known = F.lit([s for s in p.sections if s in there]).cast("array<string>")
        hit = F.lit(True)
        for group in p.groups:
            hit = hit & F.array_contains(F.array(*(F.col("f").rlike(x) for x in group)), True)
        new = F.size(F.array_except(known, F.coalesce("has", none))) > 0
        fired = base.filter(hit & new if p.fresh else hit)
        expand = F.array_except(F.lit(p.expand), F.coalesce("terms", none)) if p.fresh else F.lit(p.expand)
        fired = fired.select("query_id", expand.alias("expand"), known.alias("sections"), F.lit(sorted(p.domains)).alias("domains"))
        steps = steps.unionByName(fired.select("query_id", one, F.posexplode("expand").alias("at", "term")).select(*_row(2, F.lit(k), F.col("at"), F.lit(p.name), F.col("term"), curated, one, "lexicon")))
        hints.append(fired.select("query_id", F.explode("domains").alias("domain"), F.lit(True).alias("curated")))
        section_hints.append(fired.select("query_id", F.explode("sections").alias("section")))

    # 3. Exact terms of few domains hint at these.
    tokens = asked.select("query_id", F.posexplode("w").alias("pos", "token"))
    few = lambda rows: rows.filter(F.size("domains") <= HINTS).select("query_id", F.explode("domains").alias("domain"), F.lit(False).alias("curated"))
    hints.append(few(tokens.select("query_id", F.col("token").alias("term")).distinct().join(vocabulary, "term")))

    # 4. Two, then three neighbouring words written as one.
    for width in (2, 3):
        parts = F.transform(F.sequence(F.lit(1), F.size("w") - (width - 1)), _cut(width))
        rows = asked.filter(F.size("w") >= width).select("query_id", F.posexplode(parts).alias("at", "parts")).filter(~F.exists("parts", lambda x: x.isin(t.STOPWORDS)))
        joined = rows.select("query_id", "at", F.array_join("parts", " ").alias("original"), F.array_join("parts", "").alias("term")).join(vocabulary, "term")
        steps = steps.unionByName(joined.select(*_row(4, F.lit(width), F.col("at"), F.col("original"), F.col("term"), curated, one, "compound")))
        hints.append(few(joined))

    # 5. By token: forms without a suffix that are terms; a token that has none and is no term is corrected.
    plain = written(tokens.filter(~F.col("token").isin(t.STOPWORDS)), "tokens")
    bare = plain.select("query_id", "pos", "token", F.posexplode(t.suffix_variants(F.col("token"))).alias("at", "term")).join(vocabulary, "term")
    steps = steps.unionByName(bare.select(*_row(5, F.col("pos"), F.col("at"), F.col("token"), F.col("term"), curated, one, "suffix")))
    names = plain.select("token").distinct().filter(F.length("token") >= LEAST)
    open_tokens = names.join(bare.select("token").distinct(), "token", "left_anti").join(vocabulary.select(F.col("term").alias("token")), "token", "left_anti")
    likely = plain.join(corrections(open_tokens, vocabulary.select("term")), "token").join(vocabulary, "term")
    steps = steps.unionByName(likely.select(*_row(5, F.col("pos"), F.lit(0), F.col("token"), F.col("term"), F.col("score"), one, "fuzzy")))

    # The list: each term where it first came up. Tokens count as long as fewer than `most` terms stand before them.
    order = ["stage", "a", "b"]
    first = F.row_number().over(Window.partitionBy("query_id", "candidate").orderBy(*order)) == 1
    marked = steps.withColumn("first", first.cast("int"))
    upto = F.sum("first").over(Window.partitionBy("query_id").orderBy("stage", "a"))
    same = F.sum("first").over(Window.partitionBy("query_id", "stage", "a"))
    kept = written(marked.withColumn("before", upto - same).filter((F.col("stage") < 5) | (F.col("before") < most)).drop("before"), "steps")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    expanded = kept.filter("first = 1").withColumn("pos", place).filter(F.col("pos") <= most).select("query_id", "pos", F.col("candidate").alias("term"))
    matches = kept.filter("reason <> 'suffix'").withColumn("pos", place).select("query_id", "pos", "original", "candidate", "score", "domains", "reason")
    hints.append(few(kept.filter("reason = 'fuzzy'")))
    domains, named = hints[0], section_hints[0]
    for more in hints[1:]:
        domains = domains.unionByName(more)
    for more in section_hints[1:]:
        named = named.unionByName(more)
    return Interpretation(matches, expanded, domains.groupBy("query_id", "domain").agg(F.bool_or("curated").alias("curated")), named.distinct())
