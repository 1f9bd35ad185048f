"""Registered queries of reports, checks, bounded collections and conversations, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate
from ..operators import review as rv
from .queries import docs_of, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("SELECT quality, toxic, count(*) AS n, CAST(grouping_id(quality, toxic) AS BIGINT) AS level FROM labels GROUP BY GROUPING SETS ((quality, toxic), (quality), ())")
def feedback_counters(spark, sf_dir):
    return rv.labelled_counts(table(spark, sf_dir, "labels"), ["quality", "toxic"])


@query("SELECT n_regionkey, count(*) AS n, array_to_string(list_sort(list(DISTINCT n_name)), ',') AS names FROM nation GROUP BY n_regionkey")
def authority_counts(spark, sf_dir):
    return rv.members(table(spark, sf_dir, "nation"), "n_regionkey", "n_name").withColumn("names", F.array_join("names", ","))


@query("SELECT event_type, count(*) AS cases, count_if(value >= 1) AS has_value, count_if(props IS NOT NULL) AS has_props, least(count_if(value >= 1), count_if(props IS NOT NULL)) >= ceil(count(*) * CAST(0.9 AS DOUBLE)) AS accepted FROM events GROUP BY event_type")
def workflow_report(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("value") >= 1).alias("has_value"), F.col("props").isNotNull().alias("has_props"))
    return rv.check_report(rows, "event_type", ["has_value", "has_props"], 0.9)


@query("""SELECT user_id, count(*) AS cases, round(count_if(event_type = 'error') / count(*), 6) AS fallback_rate, round(count_if(event_type <> 'error') / count(*), 6) AS pass_rate, bool_and(value >= 0) AS all_safe,
    round(count_if(event_type = 'error') / count(*), 6) <= 0.25 AND round(count_if(event_type <> 'error') / count(*), 6) >= 0.75 AND bool_and(value >= 0) AS accepted FROM events GROUP BY user_id""")
def model_report(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", (F.col("event_type") == "error").alias("fallback"), (F.col("event_type") != "error").alias("passed"), (F.col("value") >= 0).alias("safe"), F.lit(False).alias("mock"))
    return rv.model_report(rows, "user_id")


@query("SELECT props, count(*) AS n FROM events WHERE event_type = 'error' AND props IS NOT NULL GROUP BY props ORDER BY n DESC, props LIMIT 5")
def failure_top5(spark, sf_dir):
    return rv.top_reasons(table(spark, sf_dir, "events").filter("event_type = 'error'"), "props")


@query("SELECT event_type, count(*) AS cases, count_if(value >= 5) AS passed, count_if(NOT value >= 5) AS failures, count_if(value >= 5) + count_if(NOT value >= 5) = count(*) AND count_if(NOT value >= 5) = count(DISTINCT CASE WHEN NOT value >= 5 THEN user_id END) AS consistent FROM events GROUP BY event_type")
def audit_arithmetic(spark, sf_dir):
    return rv.audit(table(spark, sf_dir, "events").withColumn("passed", F.col("value") >= 5), "event_type", "user_id", "passed")


@query("SELECT event_type, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS percentile, count(value) AS n FROM events GROUP BY event_type")
def latency_median(spark, sf_dir):
    return evaluate.percentile(table(spark, sf_dir, "events"), "event_type", "value", 0.5)


@query("SELECT o_custkey, coalesce(bool_and(coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice > 50000 END, true)), true) AS holds FROM orders GROUP BY o_custkey")
def tri_state_checks(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("dear", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") > 50_000))
    return rv.all_true(rows, "o_custkey", ["dear"])


@query("SELECT a.c_custkey, c.c_name, c.c_name IS NOT NULL AS found FROM (SELECT DISTINCT o_custkey * 2 AS c_custkey FROM orders) a LEFT JOIN customer c ON a.c_custkey = c.c_custkey")
def case_selection(spark, sf_dir):
    return rv.selected(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).alias("c_custkey")), "c_custkey", "c_name")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def civil_dates(spark, sf_dir):
    """Dates with and without an offset, and one whose offset is out of range."""
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    iso = F.date_format(day, "yyyy-MM-dd")
    written = F.when(k == 0, iso).when(k == 1, F.concat(iso, F.lit("+02:00"))).when(k == 2, F.date_format(day, "dd.MM.yyyy")).otherwise(F.concat(iso, F.lit("+15:00")))
    return table(spark, sf_dir, "orders").select("o_orderkey", rv.civil_date(written).alias("day"))


@query("SELECT doc_id, doc_id % 2 = 0 AS valid FROM documents")
def hash_field_check(spark, sf_dir):
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return docs_of(spark, sf_dir).select("doc_id", rv.hex64(F.when(F.col("doc_id") % 2 == 0, digest).otherwise(F.upper(F.concat(digest, F.lit("0"))))).alias("valid"))


@query("""
    WITH own AS (SELECT * FROM (SELECT user_id, event_type, event_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1),
    kept AS (SELECT * FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM own) WHERE place <= 3),
    alive AS (SELECT user_id FROM own GROUP BY user_id ORDER BY max((ts, event_id)) DESC, user_id LIMIT 100)
    SELECT user_id, event_type, event_id, place FROM kept WHERE user_id IN (SELECT user_id FROM alive)""")
def bounded_collection(spark, sf_dir):
    """Three kinds of event a user, the latest of each, for the 100 users of latest activity."""
    kept = rv.bounded(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"], 3, 100)
    return kept.select("user_id", "event_type", "event_id", "place")


@query("SELECT conv_id, string_agg(s, chr(10) ORDER BY turn) AS evidence, count(*) AS n_turns FROM (SELECT conv_id, turn, trim(coalesce(text, ''), ' ') AS s FROM conversations WHERE role = 'user') WHERE s <> '' GROUP BY conv_id")
def user_evidence(spark, sf_dir):
    return rv.user_evidence(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query("SELECT conv_id, turn, question, answer FROM (SELECT conv_id, turn, role, text AS question, lead(role) OVER w AS nr, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND nr = 'user'")
def answer_pairs(spark, sf_dir):
    return rv.answer_pairs(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query("SELECT source, count(*) AS rows, count_if(doc_id % 50 <> 7) AS equal, bool_and(doc_id % 50 <> 7) AS admitted FROM documents GROUP BY source")
def context_admission(spark, sf_dir):
    """A batch is admitted if all its rows equal the reference; here some have another text."""
    docs = docs_of(spark, sf_dir)
    rows = docs.select("source", "doc_id", "lang", F.when(F.col("doc_id") % 50 == 7, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return rv.admitted(rows, docs, "doc_id", ["lang", "text"], "source")


@query("SELECT c_custkey, CASE WHEN s_acctbal IS NOT NULL THEN s_acctbal ELSE c_acctbal END AS acctbal, CASE WHEN s_suppkey IS NULL THEN 'local_fallback' ELSE 'live' END AS origin FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def live_replacement(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("acctbal"))
    return rv.replaced(own, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("acctbal")), "c_custkey", "acctbal")


@query("SELECT origin, count(*) AS n FROM (SELECT CASE WHEN s_suppkey IS NULL THEN 'local_fallback' ELSE 'live' END AS origin FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey) GROUP BY origin")
def context_outcomes(spark, sf_dir):
    return evaluate.counters(live_replacement(spark, sf_dir), ["origin"])


@query("""
    WITH c AS (SELECT conv_id, turn, list_slice(string_split(coalesce(text, ''), ' '), 1, 3) AS w, role = 'system' AS flag FROM conversations),
    u AS (SELECT conv_id, word, min(turn * 10 + p) AS k FROM (SELECT conv_id, turn, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM c) GROUP BY ALL),
    n AS (SELECT conv_id, word, k, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS r FROM u)
    SELECT conv_id, string_agg(word, ' ' ORDER BY k) AS words, (SELECT bool_or(flag) FROM c WHERE c.conv_id = n.conv_id) AS flag FROM n WHERE r <= 8 GROUP BY conv_id""")
def chunk_merge(spark, sf_dir):
    """The first words of a conversation's turns as one list, each once, eight at most."""
    chunks = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.slice(F.split(F.coalesce("text", F.lit("")), " "), 1, 3).alias("words"), (F.col("role") == "system").alias("flag"))
    return rv.merged_chunks(chunks, "conv_id", "turn", "words", "flag", 8).withColumn("words", F.array_join("words", " "))


@query("SELECT page_id, CASE WHEN n = '' THEN NULL ELSE n END AS act FROM (SELECT page_id, regexp_extract(url, '(?:^|/)(\\d{3,})(?:[/?#]|$)', 1) AS n FROM pages)")
def act_id_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.get(rv.act_ids(F.col("url")), F.lit(0)).alias("act"))


@query("SELECT doc_id, left(array_to_string(list_filter([lang, source, text], lambda x: x IS NOT NULL AND trim(x, ' ') <> ''), chr(10)), 5000) AS passage FROM documents")
def rerank_passage(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", rv.passage("lang", "source", "text").alias("passage"))


@query("SELECT event_id, CASE event_type WHEN 'x' THEN 1 ELSE 7 END AS place FROM events")
def kind_order(spark, sf_dir):
    """No event is one of the fixed kinds, so all come last; the tests have the kinds."""
    return table(spark, sf_dir, "events").select("event_id", rv.kind_order(F.col("event_type")).alias("place"))


@query("""WITH s(place, stage) AS (VALUES (1, 'click'), (2, 'view'), (3, 'purchase'), (4, 'error'), (5, 'signup')), d AS (SELECT user_id, event_type AS stage, CASE WHEN max(value) >= 50 THEN 'completed' ELSE 'failed' END AS status FROM events GROUP BY ALL)
    SELECT u.user_id, place, s.stage, coalesce(status, 'not_run') AS status FROM (SELECT DISTINCT user_id FROM events) u, s LEFT JOIN d ON d.user_id = u.user_id AND d.stage = s.stage""")
def stage_ledger(spark, sf_dir):
    done = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("stage")).agg(F.when(F.max("value") >= 50, "completed").otherwise("failed").alias("status"))
    return rv.stage_ledger(done, ["click", "view", "purchase", "error", "signup"], "user_id")


@query("SELECT query_id, CASE WHEN s = 0 THEN 'limited' WHEN q OR s < n THEN 'conditional' ELSE 'supported' END AS label FROM (SELECT o_custkey AS query_id, count(*) AS n, count_if(o_orderstatus = 'F') AS s, bool_or(o_totalprice > 400000) AS q FROM orders GROUP BY 1)")
def confidence_label(spark, sf_dir):
    sums = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("query_id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("s"), F.bool_or(F.col("o_totalprice") > 400_000).alias("q"))
    return sums.select("query_id", rv.confidence(F.col("s"), F.col("n"), F.col("q")).alias("label"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '[NAT_' || (user_id % 20) || ']' ELSE '[nat ' || (user_id % 20 + 100) || ']' END || ' [x]' AS repaired FROM events")
def citation_repair(spark, sf_dir):
    known = F.array(*(F.lit(f"NAT_{k}") for k in range(20)))
    k = F.col("user_id") % 20
    said = F.concat(F.lit("[nat "), F.when(F.col("event_id") % 2 == 0, k).otherwise(k + 100).cast("string"), F.lit("] [x]"))
    return table(spark, sf_dir, "events").select("event_id", rv.repaired_citations(said, known).alias("repaired"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\[[A-Z0-9_]+\\]', '', 'g'), '(?m)^\\s*#{1,6}\\s.*$', '', 'g'), '\\s+', ' ', 'g'), ' ') AS plain FROM documents")
def generated_clean(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", rv.generated(F.coalesce("text", F.lit(""))).alias("plain"))


@query()
def first_excerpt(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", rv.excerpt(F.col("text")).alias("excerpt"))
