"""Query understanding and result shaping: vocabularies, expansions, gates, forced hints, lookups and rankings of spans.

All are joins and windows by query, document or term. Tables of rules and hints are ordinary inputs, joined by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t

#: Most expansions of a query, and most domains of a term that still hints at them.
EXPANSIONS, HINTS = 16, 3


def phrases(rows: DataFrame, domain: str, text: str, least: int = 6) -> DataFrame:
    """term, domains: content tokens of three characters or more, and tokens of two or three words written as one, with the domains they are used in."""
    words = F.filter(t.tokens(text), lambda w: (F.length(w) >= 3) & t.is_content(w))
    kept = rows.select(F.col(domain).alias("domain"), words.alias("w"))
    joined = F.when(F.size("w").between(2, 3) & (F.length(F.array_join("w", "")) >= least), F.array(F.array_join("w", ""))).otherwise(F.array().cast("array<string>"))
    terms = kept.select("domain", F.explode(F.array_union("w", joined)).alias("term"))
    return terms.groupBy("term").agg(F.array_sort(F.collect_set("domain")).alias("domains"))


def domain_hints(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """query_id, domain of exact terms that are used in one to three domains. asked: (query_id, term)."""
    few = vocabulary.filter(F.size("domains").between(1, HINTS))
    return asked.join(few, "term").select("query_id", F.explode("domains").alias("domain")).distinct()


def expansions(queries: DataFrame, rules: DataFrame, query_id: str, text: str, most: int = EXPANSIONS) -> DataFrame:
    """query_id, pos, term: of each rule with a form in the folded text its expansions, in order of rule and expansion, each once, `most` at most. rules: (rule, form, expand)."""
    asked = queries.select(F.col(query_id).alias("query_id"), F.split(t.fold(text), " ").alias("w"))
    # A form of n words is an equi-join with the text's runs of n words.
    run = lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda k: F.array_join(F.slice("w", k, n), " "))
    none = F.array().cast("array<string>")
    runs = F.concat(*(F.when(F.size("w") >= n, run(n)).otherwise(none) for n in (1, 2, 3)))
    found = asked.select("query_id", F.explode(F.array_distinct(runs)).alias("form")).join(rules, "form").select("query_id", "rule", F.posexplode("expand").alias("at", "term"))
    first = found.groupBy("query_id", "term").agg(F.min(F.struct("rule", "at")).alias("first"))
    order = Window.partitionBy("query_id").orderBy("first", "term")
    return first.select("query_id", F.row_number().over(order).alias("pos"), "term").filter(F.col("pos") <= most)


def relevant(n_tokens: Column, matched: Column, hinted: Column, intent: Column, signal: Column, understood: bool = True) -> Column:
    """Whether a query may have results: a hint or an intent term needs one match; without one a signal word is needed too."""
    plain = matched >= 1 if understood else (matched >= 2) & (matched / n_tokens >= 0.4)
    return F.when(n_tokens == 0, F.lit(False)).when(hinted | intent, matched >= 1).when(~signal, F.lit(False)).otherwise(plain)


def force_hints(results: DataFrame, hints: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score, rank of k results in which hinted documents come first.

    results: (query_id, doc_id, score). hints: (query_id, doc_id, place). A hint scores a thousandth a place above the best
    score; the weakest of the others make room.
    """
    best = results.groupBy("query_id").agg(F.max("score").alias("best"))
    forced = hints.join(best, "query_id", "left").select("query_id", "doc_id", (F.coalesce("best", F.lit(0)) + 1 - F.col("place") / 1000).cast("decimal(18,6)").alias("score"))
    rest = results.join(hints.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", F.col("score").cast("decimal(18,6)").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return forced.unionByName(rest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hinted_rows(hints: DataFrame, results: DataFrame, corpus: DataFrame, key: list[str], value: str) -> DataFrame:
    """Hints with their value from the results, else from the corpus, and which of them had it."""
    own = results.select(*key, F.col(value).alias("own"))
    whole = corpus.select(key[-1], F.col(value).alias("whole"))
    out = hints.join(own, key, "left").join(whole, key[-1], "left")
    return out.select(*key, F.coalesce("own", "whole").alias(value), F.when(F.col("own").isNotNull(), "result").when(F.col("whole").isNotNull(), "corpus").alias("origin"))


def lookup(ids: DataFrame, rows: DataFrame, wanted: str, key: str) -> DataFrame:
    """Rows of the ids, compared as canonical ids (trimmed, upper case); found says which ids have none."""
    asked = ids.select(F.col(wanted), F.upper(F.trim(wanted)).alias("__key")).distinct()
    return asked.join(rows.withColumn("__key", F.upper(F.trim(key))), "__key", "left").withColumn("found", F.col(key).isNotNull()).drop("__key")


def span_topk(spans: DataFrame, queries: DataFrame, by: str, k: int) -> DataFrame:
    """by, index, score, rank: spans (by, index, text) of what the query (by, text) is about, by 10 * shared tokens - index / 100, up to 20 of it; the earliest of equals."""
    asked = queries.select(by, F.array_distinct(t.content_tokens("text")).alias("q"))
    score = 10 * F.size(F.array_intersect("q", t.tokens("text"))) - F.least(F.col("index"), F.lit(20)) * F.lit(0.01).cast("decimal(3,2)")
    scored = spans.join(asked, by).select(by, "index", score.cast("decimal(12,2)").alias("score"))
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), "index")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def expected_ranks(ranking: DataFrame, truth: DataFrame) -> DataFrame:
    """query_id, doc_id, rank of each expected document; null where it was not found."""
    return truth.join(ranking.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")


def corpus_gaps(expected: DataFrame, corpus: DataFrame, by: str, key: str) -> DataFrame:
    """by, n_missing: those none of whose expected keys is in the corpus."""
    marked = expected.join(corpus.select(key).distinct().withColumn("__there", F.lit(1)), key, "left")
    return marked.groupBy(by).agg(F.count(F.lit(1)).alias("n_missing"), F.count("__there").alias("there")).filter("there = 0").drop("there")


def section_order(section: Column) -> tuple[Column, Column]:
    """Sort keys of a section: its leading number, 999999 without one, then the rest."""
    return F.coalesce(F.regexp_extract(section, r"(\d+)", 1).try_cast("int"), F.lit(999_999)), F.regexp_replace(section, r"^\D*\d+", "")


def exact_title(requests: DataFrame, acts: DataFrame, request: str, title: str, act: str) -> DataFrame:
    """request, act, n_acts: the act whose folded title equals the request's, where exactly one has it."""
    asked = requests.select(F.col(request), t.fold(request).alias("__t")).distinct()
    own = acts.groupBy(t.fold(title).alias("__t")).agg(F.min(act).alias("__act"), F.count_distinct(act).alias("n_acts"))
    return asked.join(own, "__t", "left").select(request, F.when(F.col("n_acts") == 1, F.col("__act")).alias(act), F.coalesce("n_acts", F.lit(0)).alias("n_acts"))


def unknown_references(rules: DataFrame, corpus: DataFrame, rule: str, refs: str, key: str) -> DataFrame:
    """rule, ref of references that the corpus has not."""
    return rules.select(rule, F.explode(refs).alias(key)).join(corpus.select(key).distinct(), key, "left_anti").select(rule, F.col(key).alias("ref")).distinct()


def first_wins(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """Of rows with the same upper-case key, the first."""
    named = rows.withColumn("__k", F.upper(F.trim(key)))
    return named.withColumn("__r", F.row_number().over(Window.partitionBy("__k").orderBy(*order))).filter("__r = 1").drop("__k", "__r")


def historical_gate(rows: DataFrame, probes: DataFrame, today: str) -> DataFrame:
    """probe, gate: 'ok' for today; 'future'; for the past 'ok' where every row has a validity bound, else 'unavailable'. probes: (probe) dates; rows: valid_from, valid_to."""
    whole = rows.agg(F.coalesce(F.bool_and(F.col("valid_from").isNotNull() | F.col("valid_to").isNotNull()), F.lit(False)).alias("whole")).first()["whole"]
    day = F.lit(today).cast("date")
    return probes.select("probe", F.when(F.col("probe") > day, "future").when((F.col("probe") == day) | F.lit(whole), "ok").otherwise("unavailable").alias("gate"))
