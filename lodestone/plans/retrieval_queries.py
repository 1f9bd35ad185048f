"""Registered queries of query understanding and result shaping, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import index as ix
from ..operators import lexical
from ..operators import understanding as un
from .queries import BASE, LEX, STOP, asked_of, both_rankings, docs_of, fold_sql, heading_sql, table, tokens_sql

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def content_sql(x: str) -> str:
    return f"list_filter({tokens_sql(x)}, lambda w: w NOT IN ({STOP}) AND NOT regexp_matches(w, '^[0-9]+$'))"


VOCABULARY = f"""
    pw AS (SELECT source, list_filter({content_sql(heading_sql('text'))}, lambda w: length(w) >= 3) AS w FROM documents),
    voc AS MATERIALIZED (
        SELECT term, list_sort(list(DISTINCT source)) AS domains FROM (
            SELECT source, unnest(w) AS term FROM pw UNION ALL SELECT source, array_to_string(w, '') FROM pw WHERE len(w) BETWEEN 2 AND 3 AND length(array_to_string(w, '')) >= 6
        ) GROUP BY term)"""


def vocabulary(spark, sf_dir):
    heads = docs_of(spark, sf_dir).withColumn("heading", t.section_heading("text"))
    return un.phrases(heads, "source", "heading")


@query(f"WITH {VOCABULARY} SELECT term, len(domains) AS n_domains, array_to_string(domains, ',') AS domains FROM voc")
def phrase_vocabulary(spark, sf_dir):
    """Terms of headings, and joined headings of two or three words, by source."""
    return vocabulary(spark, sf_dir).select("term", F.size("domains").alias("n_domains"), F.array_join("domains", ",").alias("domains"))


@query(f"WITH {BASE}, {VOCABULARY} SELECT DISTINCT query_id, domain FROM (SELECT query_id, unnest(domains) AS domain FROM qt JOIN voc ON qt.term = voc.term WHERE len(domains) BETWEEN 1 AND 3)")
def domain_hints(spark, sf_dir):
    return un.domain_hints(ix.query_terms(asked_of(spark, sf_dir), "item_id", "text"), vocabulary(spark, sf_dir))


#: (rule, form, expansions), as in a query lexicon.
RULES = [(1, "of the", ["article", "definite", "genitive"]), (2, "the", ["article", "determiner"]), (3, "que", ["what", "which"]), (4, "de la", ["of", "genitive"]), (5, "und", ["and", "also"]), (6, "in that", ["therein", "where", "which"]), (7, "and", ["also", "plus"])]
RULES_VALUES = ", ".join(f"({r}, '{form}', {words})" for r, form, words in RULES)


@query(f"""
    WITH r(rule, form, expand) AS (VALUES {RULES_VALUES}), q AS (SELECT item_id, ' ' || {fold_sql('text')} || ' ' AS f FROM benchmark),
    hit AS (SELECT item_id, rule, unnest(generate_series(0, len(expand) - 1)) AS p, unnest(expand) AS term FROM q JOIN r ON contains(f, ' ' || form || ' ')),
    one AS (SELECT item_id, term, min(rule * 100 + p) AS k FROM hit GROUP BY ALL)
    SELECT query_id, pos, term FROM (SELECT item_id AS query_id, term, row_number() OVER (PARTITION BY item_id ORDER BY k, term) AS pos FROM one) WHERE pos <= 4""")
def query_expansions(spark, sf_dir):
    """Expansions of the rules that match, four a query."""
    rules = spark.createDataFrame(RULES, "rule int, form string, expand array<string>")
    return un.expansions(asked_of(spark, sf_dir), rules, "item_id", "text", 4)


@query(f"WITH {BASE}, {VOCABULARY} SELECT query_id, count(*) AS n_terms, count_if(origin = 'domain') AS n_domain FROM (SELECT query_id, term, min(origin) AS origin FROM (SELECT query_id, term, 'own' AS origin FROM qt UNION ALL SELECT query_id, unnest(domains), 'domain' FROM qt JOIN voc ON qt.term = voc.term WHERE len(domains) <= 3) GROUP BY ALL) GROUP BY query_id")
def search_terms(spark, sf_dir):
    """A query's own terms and the domains that they hint at, as one set."""
    own = ix.query_terms(asked_of(spark, sf_dir), "item_id", "text")
    more = un.domain_hints(own, vocabulary(spark, sf_dir)).select("query_id", F.col("domain").alias("term"), F.lit("domain").alias("origin"))
    both = own.withColumn("origin", F.lit("own")).unionByName(more).groupBy("query_id", "term").agg(F.min("origin").alias("origin"))
    return both.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"), F.count_if(F.col("origin") == "domain").alias("n_domain"))


@query(f"""
    WITH {LEX}, {VOCABULARY}, q AS (SELECT item_id AS query_id, len(list_distinct({content_sql('text')})) AS n_tokens FROM benchmark),
    m AS (SELECT query_id, max(matched) AS matched FROM lex GROUP BY query_id),
    s AS (SELECT query_id, bool_or(len(domains) <= 3) AS intent, bool_or(len(domains) > 3) AS signal FROM qt JOIN voc ON qt.term = voc.term GROUP BY query_id)
    SELECT query_id, n_tokens, coalesce(matched, 0) AS matched, coalesce(intent, false) AS intent, coalesce(signal, false) AS signal,
           CASE WHEN n_tokens = 0 THEN false WHEN coalesce(intent, false) THEN coalesce(matched, 0) >= 1 WHEN NOT coalesce(signal, false) THEN false ELSE coalesce(matched, 0) >= 1 END AS relevant
    FROM q LEFT JOIN m USING (query_id) LEFT JOIN s USING (query_id)""")
def relevance_gate(spark, sf_dir):
    """Rare heading terms count as intent terms, common ones as signal words."""
    own = ix.query_terms(asked_of(spark, sf_dir), "item_id", "text")
    matched = lexical.score(docs_of(spark, sf_dir), asked_of(spark, sf_dir), "item_id", "text").groupBy("query_id").agg(F.max("matched").alias("matched"))
    words = own.join(vocabulary(spark, sf_dir), "term").groupBy("query_id").agg(F.bool_or(F.size("domains") <= un.HINTS).alias("intent"), F.bool_or(F.size("domains") > un.HINTS).alias("signal"))
    out = asked_of(spark, sf_dir).select(F.col("item_id").alias("query_id"), F.size(F.array_distinct(t.content_tokens("text"))).alias("n_tokens")).join(matched, "query_id", "left").join(words, "query_id", "left")
    out = out.select("query_id", "n_tokens", F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("intent", F.lit(False)).alias("intent"), F.coalesce("signal", F.lit(False)).alias("signal"))
    return out.withColumn("relevant", un.relevant(F.col("n_tokens"), F.col("matched"), F.lit(False), F.col("intent"), F.col("signal")))


@query(f"""
    WITH {LEX}, h AS (SELECT query_id, doc_id, rank - 3 AS place FROM legr WHERE rank BETWEEN 3 AND 5), r AS (SELECT query_id, doc_id, score FROM lexr WHERE rank <= 10),
    b AS (SELECT query_id, max(score) AS best FROM r GROUP BY query_id),
    a AS (
        SELECT query_id, doc_id, CAST(coalesce(best, 0) + 1 - CAST(place AS DECIMAL(10, 3)) / 1000 AS DECIMAL(18, 6)) AS score FROM h LEFT JOIN b USING (query_id)
        UNION ALL SELECT query_id, doc_id, score FROM r WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = r.query_id AND h.doc_id = r.doc_id))
    SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM a) WHERE rank <= 5""")
def forced_sections(spark, sf_dir):
    """Third to fifth of the legacy ranking as hints over the lexical ranking."""
    best, legacy = both_rankings(spark, sf_dir)
    hints = legacy.filter("rank between 3 and 5").select("query_id", "doc_id", (F.col("rank") - 3).alias("place"))
    return un.force_hints(best.filter("rank <= 10"), hints, 5)


@query(f"WITH {LEX}, h AS (SELECT query_id, doc_id FROM legr WHERE rank <= 5), r AS (SELECT query_id, doc_id, lang FROM lexr JOIN documents USING (doc_id) WHERE rank <= 5) SELECT h.query_id, h.doc_id, coalesce(r.lang, d.lang) AS lang, CASE WHEN r.lang IS NOT NULL THEN 'result' ELSE 'corpus' END AS origin FROM h LEFT JOIN r USING (query_id, doc_id) LEFT JOIN documents d ON h.doc_id = d.doc_id")
def hint_section_join(spark, sf_dir):
    docs = docs_of(spark, sf_dir).select("doc_id", "lang")
    best, legacy = both_rankings(spark, sf_dir)
    results = best.filter("rank <= 5").select("query_id", "doc_id").join(docs, "doc_id")
    return un.hinted_rows(legacy.filter("rank <= 5").select("query_id", "doc_id"), results, docs, ["query_id", "doc_id"], "lang")


@query(f"WITH {LEX} SELECT e.query_id, e.doc_id, lexr.rank FROM (SELECT query_id, doc_id FROM legr WHERE rank <= 5) e LEFT JOIN (SELECT * FROM lexr WHERE rank <= 200) lexr ON e.query_id = lexr.query_id AND e.doc_id = lexr.doc_id")
def expected_rank(spark, sf_dir):
    """Where the legacy ranking's best stand in the lexical ranking."""
    best, legacy = both_rankings(spark, sf_dir)
    return un.expected_ranks(best, legacy.filter("rank <= 5").select("query_id", "doc_id"))


LINES = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ') <> '')"


@query(f"""
    WITH q AS (SELECT doc_id, list_distinct({content_sql(heading_sql('text'))}) AS q FROM documents),
    s AS (SELECT doc_id, unnest(generate_series(0, len(l) - 1)) AS index, unnest(l) AS text FROM (SELECT doc_id, {LINES} AS l FROM documents)),
    c AS (SELECT doc_id, index, CAST(10 * len(list_intersect(q, {tokens_sql('text')})) - least(index, 20) * CAST(0.01 AS DECIMAL(3, 2)) AS DECIMAL(12, 2)) AS score FROM s JOIN q USING (doc_id))
    SELECT * FROM (SELECT doc_id, index, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, index) AS rank FROM c) WHERE rank <= 3""")
def span_topk(spark, sf_dir):
    """The three lines of each document that are most about its heading."""
    docs = docs_of(spark, sf_dir)
    lines = F.filter(F.split(t.text("text"), "\n"), lambda x: F.trim(x) != "")
    spans = docs.select("doc_id", F.posexplode(lines).alias("index", "text"))
    return un.span_topk(spans, docs.select("doc_id", t.section_heading("text").alias("text")), "doc_id", 3)


@query("SELECT w.wanted, c_custkey, c_mktsegment, c_custkey IS NOT NULL AS found FROM (SELECT DISTINCT ' ' || lower(s_name) AS s, replace(' ' || lower(s_name), 'supplier', 'customer') AS wanted FROM supplier) w LEFT JOIN customer ON upper(trim(w.wanted)) = upper(trim(c_name))")
def primary_key_lookup(spark, sf_dir):
    """Customers by names of other case and spacing."""
    ids = table(spark, sf_dir, "supplier").select(F.replace(F.concat(F.lit(" "), F.lower("s_name")), F.lit("supplier"), F.lit("customer")).alias("wanted"))
    return un.lookup(ids, table(spark, sf_dir, "customer"), "wanted", "c_name").select("wanted", "c_custkey", "c_mktsegment", "found")


@query("SELECT c_custkey, count(*) AS n_missing FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey WHERE o_custkey IS NULL GROUP BY c_custkey")
def corpus_gap(spark, sf_dir):
    """Customers none of whose keys is among the pending orders."""
    expected = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("o_custkey"))
    return un.corpus_gaps(expected, table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'"), "c_custkey", "o_custkey")


@query("SELECT * FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_type ORDER BY coalesce(TRY_CAST(nullif(regexp_extract(p_brand, '(\\d+)', 1), '') AS INT), 999999), regexp_replace(p_brand, '^\\D*\\d+', ''), p_partkey) AS place FROM part) WHERE place <= 50")
def section_sort(spark, sf_dir):
    """Brands by their number within a type."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("p_type").orderBy(*un.section_order(F.col("p_brand")), "p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.row_number().over(order).alias("place")).filter("place <= 50")


@query("WITH r AS (SELECT DISTINCT upper(p_name) || '!' AS request FROM part), a AS (SELECT lower(p_name) AS k, min(p_partkey) AS act, count(DISTINCT p_partkey) AS n FROM part GROUP BY 1) SELECT request, CASE WHEN n = 1 THEN act END AS p_partkey, coalesce(n, 0) AS n_acts FROM r LEFT JOIN a ON rtrim(lower(request), '!') = k")
def title_match(spark, sf_dir):
    """Parts by names in capitals; a name of several parts gives none."""
    parts = table(spark, sf_dir, "part")
    return un.exact_title(parts.select(F.concat(F.upper("p_name"), F.lit("!")).alias("request")), parts, "request", "p_name", "p_partkey")


@query("SELECT DISTINCT l_orderkey AS rule, l_partkey + 1000 AS ref FROM lineitem WHERE l_partkey + 1000 NOT IN (SELECT p_partkey FROM part)")
def lexicon_references(spark, sf_dir):
    """References of rules that the corpus has not: orders' parts, moved on by 1,000."""
    rules = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rule"), F.array(F.col("l_partkey") + 1000).alias("refs"))
    return un.unknown_references(rules, table(spark, sf_dir, "part"), "rule", "refs", "p_partkey")


@query("SELECT p_name, p_partkey FROM (SELECT p_name, p_partkey, row_number() OVER (PARTITION BY upper(trim(p_name)) ORDER BY p_partkey) AS r FROM part) WHERE r = 1")
def registry_first_wins(spark, sf_dir):
    return un.first_wins(table(spark, sf_dir, "part").select("p_name", "p_partkey"), F.col("p_name"), ["p_partkey"])


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS probe, CASE WHEN CAST(o_orderdate AS DATE) > DATE '1997-01-01' THEN 'future' ELSE 'ok' END AS gate FROM orders")
def historical_gate(spark, sf_dir):
    """Every line item has a bound, so the past is available."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return un.historical_gate(rows, table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("probe")).distinct(), "1997-01-01")
