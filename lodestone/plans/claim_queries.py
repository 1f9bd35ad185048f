"""Registered queries of claims, evidence, repair and coverage rules, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import claims as cl
from .queries import CW, EVID, SENT, asked_of, docs_of, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


STRIP = "regexp_replace({x}, '^\\s+|\\s+\\z', '', 'g')"
GEN = "trim(regexp_replace(regexp_replace(regexp_replace({x}, '\\[[A-Z0-9_]+\\]', '', 'g'), '(?m)^\\s*#{{1,6}}\\s.*$', '', 'g'), '\\s+', ' ', 'g'), ' ')"
PARTS = "string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1))"
WORDS = "list_distinct(regexp_extract_all({x}, '[a-zõäöü]{{4,}}'))"
LIGHT = "'selle', 'ning', 'kuid', 'vaid', 'tuleb', 'saab', 'peab', 'kohta', 'korral', 'alusel', 'vastavalt'"


def _first_sentence(column: str):
    return F.get(F.split(t.text(column), r"(?<=[.!?])\s+|\n+"), F.lit(0))


@query(f"""
    WITH p AS (SELECT b.item_id, b.item_id * 3 AS doc_id, {EVID.format(x="coalesce(b.text, '')")} AS c, {EVID.format(x="coalesce(d.text, '')")} AS e FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id * 3),
    w AS (SELECT item_id, {CW.format(x='c')} AS cw, {WORDS.format(x='e')} AS ew FROM p),
    n AS (SELECT item_id, len(cw) AS n_words, len(list_filter(cw, lambda x: list_contains(ew, x))) AS n_shared, array_to_string(list_slice(list_sort(list_filter(cw, lambda x: NOT list_contains(ew, x))), 1, 40), ' ') AS missing FROM w)
    SELECT item_id, n_words, n_shared, CASE WHEN n_words > 0 THEN round(n_shared / n_words, 4) ELSE 0.0 END AS ratio, missing FROM n""")
def support_diagnostics(spark, sf_dir):
    """Each benchmark item as a claim about one document."""
    asked = asked_of(spark, sf_dir).select("item_id", (F.col("item_id") * 3).alias("doc_id"), F.col("text").alias("claim"))
    both = asked.join(docs_of(spark, sf_dir).select("doc_id", "text"), "doc_id", "left").select("item_id", cl.diagnostics(F.col("claim"), F.col("text")).alias("d"))
    return both.select("item_id", "d.n_words", "d.n_shared", "d.ratio", F.array_join("d.missing_words", " ").alias("missing"))


@query(f"""
    WITH c AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(array_to_string(list_slice(string_split(coalesce(text, ''), ' '), 3, 12), ' '), '[0-9]', '', 'g') AS claim FROM documents),
    q AS (SELECT doc_id, text, list_filter({WORDS.format(x='lower(claim)')}, lambda w: w NOT IN ({LIGHT})) AS q, {CW.format(x='cf')} AS cw FROM (SELECT *, {EVID.format(x='claim')} AS cf FROM c)),
    s AS (SELECT doc_id, q, cw, unnest(generate_series(1, len(p))) AS pos, {STRIP.format(x='unnest(p)')} AS s FROM (SELECT *, {PARTS} AS p FROM q)),
    o AS (SELECT *, len(list_filter(q, lambda w: list_contains(regexp_extract_all(lower(s), '[a-zõäöü]{{4,}}'), w))) AS overlap, {EVID.format(x='s')} AS e FROM s),
    g AS (SELECT * FROM o WHERE len(q) > 0 AND overlap >= CASE WHEN len(q) < 3 THEN 1 ELSE 2 END AND length(e) >= 24 AND (len(cw) < 4 OR 2 * len(list_filter(cw, lambda w: list_contains(regexp_extract_all(e, '[a-zõäöü]{{4,}}'), w))) >= len(cw)))
    SELECT claim_id, evidence, overlap FROM (SELECT doc_id AS claim_id, s AS evidence, overlap, row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, length(s), pos) AS r FROM g) WHERE r = 1""")
def evidence_recovery(spark, sf_dir):
    """Ten words of each document, without digits, as a claim whose evidence is lost. The texts have no inference markers."""
    said = F.regexp_replace(F.array_join(F.slice(F.split(t.text("text"), " "), 3, 10), " "), "[0-9]", "")
    docs = docs_of(spark, sf_dir)
    claims = docs.select(F.col("doc_id").alias("claim_id"), F.col("doc_id").cast("string").alias("source_id"), said.alias("claim"), F.lit("").alias("evidence"))
    return cl.recovered(claims, docs.select(F.col("doc_id").cast("string").alias("source_id"), "text"))


@query(f"""
    WITH c AS (SELECT doc_id - doc_id % 10 AS answer_id, doc_id AS pos, {GEN.format(x=f'{PARTS}[1]')} AS evidence, {EVID.format(x="coalesce(text, '')")} AS s FROM documents),
    v AS (SELECT answer_id, pos, evidence, {EVID.format(x='evidence')} AS form, s FROM c),
    f AS (SELECT *, row_number() OVER (PARTITION BY answer_id, form ORDER BY pos) AS r FROM v WHERE length(form) >= 24 AND contains(s, form))
    SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY pos) AS place, CAST(pos AS VARCHAR) AS source_id, evidence AS claim, evidence FROM f WHERE r = 1""")
def verified_claims(spark, sf_dir):
    """Answers of ten claims, each with the first sentence of a document as evidence; half of the claims say something else and are replaced."""
    docs = docs_of(spark, sf_dir)
    said = F.when(F.col("doc_id") % 2 == 0, _first_sentence("text")).otherwise("Qqqqq wwwww zzzzz xxxxx vvvvv.")
    claims = docs.select((F.col("doc_id") - F.col("doc_id") % 10).alias("answer_id"), F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("source_id"), said.alias("claim"), _first_sentence("text").alias("evidence"))
    return cl.verified_claims(claims, docs.select(F.col("doc_id").cast("string").alias("source_id"), "text"))


@query("""SELECT l_orderkey AS request_id, l_linenumber AS place, l_returnflag AS obligation, 'P_' || l_partkey AS source_id FROM lineitem
    WHERE l_returnflag <> 'N' AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 45)""")
def repair_targets(spark, sf_dir):
    """Line items as obligations of their order; returned ones are enforced, large ones lack a source."""
    parts = F.array(F.lit(" "), F.concat(F.lit("p_"), F.col("l_partkey").cast("string")))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("place"), F.col("l_returnflag").alias("obligation"), (F.col("l_returnflag") != "N").alias("enforced"), parts.alias("candidates"), (F.col("l_quantity") >= 45).alias("missing"))
    return cl.repair_targets(rows, "request_id")


@query(f"""
    WITH s AS (SELECT doc_id, 'D_' || doc_id AS id, list_transform(list_slice({SENT}, 1, 2), lambda x: regexp_replace(left(x, 700), '[.!?;:]+\\z', '') || ' [D_' || doc_id || '].') AS s FROM documents),
    g AS (SELECT item_id, 0 AS g, unnest([item_id * 70, item_id * 3]) AS d, unnest([0, 1]) AS i FROM benchmark UNION ALL SELECT item_id, 1, item_id * 2, 0 FROM benchmark),
    c AS (SELECT item_id, g, arg_min(doc_id, i) AS doc_id FROM g JOIN s ON d = doc_id GROUP BY item_id, g),
    u AS (SELECT item_id, doc_id, min(g) AS g FROM c GROUP BY item_id, doc_id)
    SELECT item_id, string_agg(array_to_string(s, chr(10)), chr(10) ORDER BY g) AS lines, string_agg(id, ' ' ORDER BY g) AS ids FROM u JOIN s USING (doc_id) WHERE len(s) > 0 GROUP BY item_id""")
def source_digest(spark, sf_dir):
    """Two groups of sources an item: the first has a choice of two documents, of which the first may not be there."""
    name = lambda k: F.concat(F.lit("D_"), (F.col("item_id") * k).cast("string"))
    rows = asked_of(spark, sf_dir).select("item_id", F.lit(1).alias("place"), F.array(F.array(name(70), name(3)), F.array(name(2))).alias("groups"))
    out = cl.source_digest(rows, docs_of(spark, sf_dir).select(F.concat(F.lit("D_"), F.col("doc_id").cast("string")).alias("source_id"), "text"), "item_id")
    return out.withColumn("ids", F.array_join("ids", " "))


@query("""
    WITH n AS (SELECT p_name, count(*) AS n FROM part GROUP BY p_name)
    SELECT p_name AS reason, p_name AS rule_id, CASE WHEN n > 1 THEN 'rule_id_empty_or_repeated' WHEN p_size > 45 THEN 'no_source_groups' WHEN p_size > 25 THEN 'source_id_not_canonical' WHEN p_size < 5 THEN 'no_rationale' END AS problem
    FROM part JOIN n USING (p_name)""")
def rule_check(spark, sf_dir):
    """Parts as coverage rules: names that repeat, sizes that stand for missing groups, raw ids and missing reasons."""
    own = F.when(F.col("p_size") > 25, F.lit("Brand#1")).otherwise("BRAND_1")
    groups = F.when(F.col("p_size") > 45, F.array().cast("array<array<string>>")).otherwise(F.array(F.array(own)))
    name = F.col("p_name")
    rules = table(spark, sf_dir, "part").select(name.alias("key"), name.alias("reason"), name.alias("rule_id"), groups.alias("groups"), F.array(F.array("p_type")).alias("terms"), F.when(F.col("p_size") >= 5, F.col("p_type")).otherwise(" ").alias("rationale"))
    return cl.rule_problems(rules)


def _chunk_sql(size: int, most: int) -> str:
    step = lambda k: f"""
    h{k} AS (SELECT *, left(rest, {size}) AS h FROM c{k - 1}),
    m{k} AS (SELECT *, length(h) - length(string_split(h, chr(10))[-1]) - 1 AS a, length(h) - length(string_split(h, '. ')[-1]) - 2 AS b FROM h{k}),
    n{k} AS (SELECT doc_id, rest, list, length(rest) <= {size} AS fits, CASE WHEN a >= {size // 2} THEN a WHEN b >= {size // 2} THEN b ELSE {size} END AS cut FROM m{k}),
    c{k} AS (SELECT doc_id, CASE WHEN fits THEN '' ELSE {STRIP.format(x='substring(rest, cut + 1)')} END AS rest, CASE WHEN rest = '' THEN list ELSE list_append(list, CASE WHEN fits THEN rest ELSE {STRIP.format(x='left(rest, cut)')} END) END AS list FROM n{k})"""  # noqa: E731
    steps = ",".join(step(k) for k in range(1, most + 1))
    return f"""
    WITH c0 AS (SELECT doc_id, coalesce(text, '') AS rest, CAST([] AS VARCHAR[]) AS list FROM documents),{steps},
    l AS (SELECT doc_id, list_filter(CASE WHEN rest = '' THEN list ELSE list_append(list[:-2], left(list[-1] || chr(10) || rest, {2 * size})) END, lambda x: x <> '') AS list FROM c{most})
    SELECT doc_id, len(list) AS n, md5(array_to_string(list, '|')) AS chunks_md5 FROM l"""


@query(_chunk_sql(300, 4))
def text_chunks(spark, sf_dir):
    """Descriptions in up to four pieces; pieces of 300 characters, so that these texts are cut."""
    cut = cl.chunks(docs_of(spark, sf_dir).select("doc_id", "text"), "text", 300, 4)
    return cut.select("doc_id", F.size("chunks").alias("n"), F.md5(F.array_join("chunks", "|")).alias("chunks_md5"))


@query("""
    WITH u AS (SELECT conv_id, turn, left(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), ' '), 220) AS q FROM conversations WHERE role = 'user'),
    d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(q) ORDER BY turn) AS r FROM u WHERE q <> ''),
    t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM d WHERE r = 1),
    p AS (SELECT conv_id, turn, regexp_replace(q, '\\s+([,.;:!?])', '\\1', 'g') AS q FROM t WHERE place <= 3)
    SELECT conv_id, string_agg(CASE WHEN ends_with(q, '?') THEN q ELSE q || '?' END, chr(10) ORDER BY turn) AS questions FROM p GROUP BY conv_id""")
def safe_questions(spark, sf_dir):
    """What users say as questions of a conversation. None asks for an identifier; the tests have those."""
    said = table(spark, sf_dir, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("l"))
    return said.select("conv_id", F.array_join(cl.questions(F.transform("l", lambda x: x["text"])), "\n").alias("questions")).filter("questions <> ''")
