"""Registered queries over the driver's tables, and the SQL that gives the same rows.

Benchmark items are the query batch and documents the corpus; source stands for a domain, events for requests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import python as py
from ..functions import text as t
from ..operators import dense, evaluate, fusion, lexical, spans, temporal, verify
from ..operators import index as ix
from ..operators.termrows import MOST
from ..sources.staging import written

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


STOP = ", ".join(f"'{w}'" for w in t.STOPWORDS)


def fold_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(strip_accents(lower(coalesce({x}, ''))), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def tokens_sql(x: str) -> str:
    return f"list_filter(string_split({fold_sql(x)}, ' '), lambda w: length(w) >= 2)"


def heading_sql(x: str) -> str:
    head = f"regexp_replace(left(coalesce({x}, ''), 500), '^[^§\\n]{{0,80}}§\\s*\\S+\\.?\\s*', '')"
    return f"trim(left(string_split_regex(string_split_regex({head}, '\\s\\d+\\s\\(\\d')[1], '[.!?](\\s|$)')[1], 180))"


BASE = f"""
    dt AS MATERIALIZED (SELECT doc_id, {tokens_sql('text')} AS body, {tokens_sql(heading_sql('text'))} AS heading FROM documents),
    body AS (SELECT doc_id, unnest(body) AS term FROM dt),
    head AS (SELECT doc_id, unnest(heading) AS term FROM dt),
    post AS MATERIALIZED (
        SELECT doc_id, term, max(b) AS b, max(h) AS h, sum(b) AS tf FROM (SELECT doc_id, term, 1 AS b, 0 AS h FROM body UNION ALL SELECT doc_id, term, 0, 1 FROM head) GROUP BY ALL
    ),
    pre AS MATERIALIZED (SELECT doc_id, left(term, 5) AS term, max(b) AS b, max(h) AS h FROM post WHERE length(term) >= 5 GROUP BY ALL),
    st AS (SELECT greatest(count(*), 1) AS n, greatest(1.0, coalesce(avg(len(body)), 0)) AS al FROM dt),
    qt AS MATERIALIZED (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest({tokens_sql('text')}) AS term FROM benchmark) WHERE term NOT IN ({STOP}) AND NOT regexp_matches(term, '^[0-9]+$')),
    hit AS MATERIALIZED (
        SELECT query_id, doc_id, term, max(eb) AS eb, max(eh) AS eh, max(pb) AS pb, max(ph) AS ph FROM (
            SELECT query_id, doc_id, qt.term, b AS eb, h AS eh, 0 AS pb, 0 AS ph FROM qt JOIN post ON qt.term = post.term
            UNION ALL SELECT query_id, doc_id, qt.term, 0, 0, b, h FROM qt JOIN pre ON length(qt.term) >= 5 AND left(qt.term, 5) = pre.term
        ) GROUP BY ALL
    ),
    df AS MATERIALIZED (SELECT term, CAST(round(ln((n + 1) / (count(*) + 1)) + 1, 9) AS DECIMAL(28, 9)) AS idf FROM post, st WHERE b = 1 GROUP BY term, n),
    pdf AS MATERIALIZED (SELECT term, CAST(round(ln((n + 1) / (count(*) + 1)) + 1, 9) AS DECIMAL(28, 9)) AS idf FROM pre, st WHERE b = 1 GROUP BY term, n)"""

LEX = f"""{BASE},
    lex0 AS (
        SELECT query_id, doc_id, sum(CAST(
            CASE WHEN eb = 1 THEN CAST(2.4 AS DECIMAL(3,1)) * least(5, coalesce(df.idf, 1)) WHEN pb = 1 THEN CAST(1.7 AS DECIMAL(3,1)) * least(5, coalesce(pdf.idf, 1)) ELSE 0 END
            + CASE WHEN eh = 1 THEN CAST(4.5 AS DECIMAL(3,1)) * least(5, coalesce(df.idf, 1)) WHEN ph = 1 THEN CAST(3.2 AS DECIMAL(3,1)) * least(5, coalesce(pdf.idf, 1)) ELSE 0 END AS DECIMAL(28, 9))) AS raw,
            count(DISTINCT CASE WHEN length(hit.term) >= 3 THEN left(hit.term, 5) END) AS matched
        FROM hit LEFT JOIN df ON hit.term = df.term LEFT JOIN pdf ON left(hit.term, 5) = pdf.term GROUP BY ALL
    ),
    lex AS MATERIALIZED (
        SELECT query_id, doc_id, matched, CAST(round(CAST(raw + 7 * matched + CASE WHEN matched >= 2 THEN 2 ELSE 0 END AS DECIMAL(22, 9))
            * CAST(round(greatest(0.65, least(1.25, CAST(1.1 AS DOUBLE) / (CAST(0.6 AS DOUBLE) + CAST(0.4 AS DOUBLE) * len(body) / al))), 9) AS DECIMAL(12, 9)), 6) AS DECIMAL(18, 6)) AS score
        FROM lex0 JOIN dt USING (doc_id), st
    ),
    lexr AS MATERIALIZED (SELECT query_id, doc_id, score, matched, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM lex WHERE score >= 6),
    leg AS (
        SELECT query_id, doc_id, CAST(least(3 * count_if(eb = 1), 18) + least(2 * count_if(pb = 1 AND eb = 0), 12) AS DECIMAL(18, 6)) AS score FROM hit GROUP BY ALL
    ),
    legr AS MATERIALIZED (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM leg WHERE score > 0)"""


def rrf_sql(parts: list[tuple[str, float]]) -> str:
    rows = " UNION ALL ".join(f"SELECT query_id, doc_id, CAST({w} / (20 + rank) AS DECIMAL(18, 12)) AS s FROM {r} WHERE rank <= 200" for r, w in parts)
    return f"SELECT query_id, doc_id, CAST(sum(s) AS DECIMAL(18, 12)) AS score, row_number() OVER (PARTITION BY query_id ORDER BY sum(s) DESC, doc_id) AS rank FROM ({rows}) GROUP BY query_id, doc_id"


#: Files of less are dealt to all cores.
DEALT_BYTES = 64 << 20


def docs_of(spark, sf_dir):
    """documents; where they are few and small files, dealt by doc_id, so that all cores have some. Large files are split as they are read, and their texts are not shuffled."""
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    small = len(docs.inputFiles()) < cores and docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < DEALT_BYTES
    return docs.repartition(cores, "doc_id") if small else docs


def asked_of(spark, sf_dir):
    return table(spark, sf_dir, "benchmark")


def postings_of(spark, sf_dir):
    """What the items can meet, for queries that score them in several ways."""
    return lexical.prepared(docs_of(spark, sf_dir), asked_of(spark, sf_dir), "item_id", "text")


def lexical_ranking(spark, sf_dir, starts=None, most=fusion.DEPTH):
    return lexical.ranked(lexical.score(docs_of(spark, sf_dir), asked_of(spark, sf_dir), "item_id", "text", starts=starts, k=most, least=lexical.LEAST_SCORE), most)


def both_rankings(spark, sf_dir):
    """The lexical and the legacy ranking over the same rows, written once each."""
    starts = postings_of(spark, sf_dir)
    return [written(lexical_ranking(spark, sf_dir, starts), "lexical-ranking"), written(legacy_ranking(spark, sf_dir, starts), "legacy-ranking")]


def legacy_ranking(spark, sf_dir, starts=None, most=fusion.DEPTH):
    return lexical.ranked(lexical.legacy_score(docs_of(spark, sf_dir), asked_of(spark, sf_dir), "item_id", "text", starts=starts, k=most), most)


@query(f"SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct, len(list_filter(w, lambda x: x NOT IN ({STOP}) AND NOT regexp_matches(x, '^[0-9]+$'))) AS n_content, md5(array_to_string(w, ' ')) AS tokens_md5 FROM (SELECT doc_id, {tokens_sql('text')} AS w FROM documents)")
def fold_tokens(spark, sf_dir):
    w = docs_of(spark, sf_dir).select("doc_id", t.tokens("text").alias("w"))
    return w.select("doc_id", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_distinct"), F.size(F.filter("w", t.is_content)).alias("n_content"), F.md5(F.array_join("w", " ")).alias("tokens_md5"))


@query(f"WITH {BASE} SELECT post.term, count(*) AS df, any_value(round(df.idf, 6)) AS idf FROM post JOIN df USING (term) WHERE b = 1 GROUP BY post.term")
def term_df_idf(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    n = F.lit(max(1, docs.count()))
    return ix.doc_frequency(ix.postings(docs)).select("term", "df", F.round(ix.idf(n, F.col("df")), 6).alias("idf"))


@query(f"WITH {BASE} SELECT term AS prefix, count(*) AS df FROM pre WHERE b = 1 GROUP BY term")
def prefix_df(spark, sf_dir):
    return ix.doc_frequency(ix.prefix_postings(ix.postings(docs_of(spark, sf_dir)))).withColumnRenamed("term", "prefix")


@query(f"WITH {BASE} SELECT n AS n_docs, round(al, 6) AS avg_length FROM st")
def doc_length_stats(spark, sf_dir):
    return ix.length_stats(docs_of(spark, sf_dir)).select("n_docs", F.round("avg_length", 6).alias("avg_length"))


@query(f"WITH {BASE} SELECT query_id, count(DISTINCT doc_id) AS n_candidates FROM hit GROUP BY query_id")
def candidate_join(spark, sf_dir):
    asked = ix.query_terms(asked_of(spark, sf_dir), "item_id", "text")
    terms = ix.postings(docs_of(spark, sf_dir), asked=asked)
    found = ix.matches(terms, ix.prefix_postings(terms), asked)
    return found.groupBy("query_id").agg(F.count_distinct("doc_id").alias("n_candidates"))


@query(f"SELECT item_id, doc_id FROM (SELECT item_id, {fold_sql('text')} AS f FROM benchmark) b JOIN (SELECT doc_id, {fold_sql('text')} AS f FROM documents) d ON b.f <> '' AND contains(' ' || d.f || ' ', ' ' || b.f || ' ')")
def containment_join(spark, sf_dir):
    """Whole-word containment as an equi-join: an item's first words are looked up among the documents' runs of as many words."""
    n = 3
    items = asked_of(spark, sf_dir).select("item_id", t.fold("text").alias("f")).filter("f <> ''").withColumn("w", F.split("f", " "))
    items = items.withColumns({"n": F.least(F.lit(n), F.size("w")), "key": F.array_join(F.slice("w", 1, n), " ")})
    words = docs_of(spark, sf_dir).select("doc_id", F.concat(F.lit(" "), t.fold("text"), F.lit(" ")).alias("whole"))
    w = words.withColumn("w", F.split(F.trim("whole"), " "))
    of = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - k + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, k), " "))
    lengths = [r["n"] for r in items.select("n").distinct().collect()] or [n]
    runs = F.flatten(F.array(*map(of, sorted(lengths))))
    keys = items.select("key").distinct()
    at = w.select("doc_id", F.explode(F.array_distinct(runs)).alias("key")).join(keys, "key", "left_semi")
    found = at.join(items, "key").join(words, "doc_id").filter(F.col("whole").contains(F.concat(F.lit(" "), F.col("f"), F.lit(" "))))
    return found.select("item_id", "doc_id")


@query(f"WITH {BASE} SELECT query_id, doc_id, count(DISTINCT left(term, 5)) AS matched FROM hit WHERE length(term) >= 3 GROUP BY ALL")
def matched_stems(spark, sf_dir):
    asked = ix.query_terms(asked_of(spark, sf_dir), "item_id", "text")
    terms = ix.postings(docs_of(spark, sf_dir), asked=asked)
    return ix.matched_stems(ix.matches(terms, ix.prefix_postings(terms), asked))


@query(f"WITH {LEX} SELECT query_id, doc_id, score, matched, rank FROM lexr WHERE rank <= 10")
def lexical_topk(spark, sf_dir):
    return lexical_ranking(spark, sf_dir, most=10)


@query(f"WITH {LEX} SELECT query_id, doc_id, score, rank FROM legr WHERE rank <= 10")
def legacy_topk(spark, sf_dir):
    return legacy_ranking(spark, sf_dir, most=10)


@query(f"WITH {LEX} SELECT * FROM ({rrf_sql([('lexr', 1.0), ('legr', 1.0)])}) WHERE rank <= 10")
def rrf_two(spark, sf_dir):
    return fusion.rrf(both_rankings(spark, sf_dir), [1.0, 1.0]).filter("rank <= 10")


CHAMPIONS = f"""{LEX},
    sup AS (SELECT DISTINCT query_id, source FROM lexr JOIN documents USING (doc_id) WHERE rank <= 15 AND matched >= 1),
    two AS (SELECT query_id FROM sup GROUP BY query_id HAVING count(*) >= 2),
    best AS (SELECT l.query_id, l.doc_id, l.rank, row_number() OVER (PARTITION BY l.query_id, d.source ORDER BY l.rank, l.doc_id) AS r
        FROM legr l JOIN documents d USING (doc_id) JOIN sup ON sup.query_id = l.query_id AND sup.source = d.source JOIN two ON two.query_id = l.query_id WHERE l.rank <= 200),
    champ AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS rank FROM best WHERE r = 1)"""


def champion_ranking(spark, sf_dir, rankings):
    domains = docs_of(spark, sf_dir).select("doc_id", F.col("source").alias("domain"))
    return fusion.champions(*rankings, domains, 15)


@query(f"WITH {CHAMPIONS} SELECT query_id, doc_id, rank FROM champ")
def domain_champions(spark, sf_dir):
    """The second ranking takes the place of the dense one."""
    return champion_ranking(spark, sf_dir, both_rankings(spark, sf_dir))


@query(f"WITH {CHAMPIONS} SELECT * FROM ({rrf_sql([('lexr', 1.0), ('legr', 1.0), ('champ', 0.75)])}) WHERE rank <= 10")
def rrf_weighted(spark, sf_dir):
    rankings = both_rankings(spark, sf_dir)
    return fusion.rrf([*rankings, champion_ranking(spark, sf_dir, rankings)], [1.0, 1.0, 0.75]).filter("rank <= 10")


ROBIN = "SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY min({at}), doc_id) AS rank FROM (SELECT query_id, doc_id, rank, 0 AS x FROM lexr WHERE rank <= 200 UNION ALL SELECT query_id, doc_id, rank, 1 FROM legr WHERE rank <= 200) GROUP BY query_id, doc_id"


@query(f"WITH {LEX} SELECT * FROM ({ROBIN.format(at='rank * 2 + x')})")
def round_robin(spark, sf_dir):
    return fusion.round_robin(both_rankings(spark, sf_dir))


@query(f"WITH {LEX} SELECT * FROM ({ROBIN.format(at='rank * 2 + x')}) WHERE rank <= 10")
def batch_round_robin(spark, sf_dir):
    """Limit min(12, max(6, 2 * 5))."""
    return fusion.round_robin(both_rankings(spark, sf_dir), 10)


COSINE = """
    WITH p AS (
        SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS score, q.label AS ql, d.label AS dl
        FROM embeddings q JOIN embeddings d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id
    ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM p)"""


def nearest(spark, sf_dir, k):
    rows = table(spark, sf_dir, "embeddings")
    return rows, dense.cosine_topk(rows, rows.filter("vec_id % 50 = 0"), k)


@query(f"{COSINE} SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 5")
def cosine_topk(spark, sf_dir):
    return nearest(spark, sf_dir, 5)[1]


@query(f"{COSINE} SELECT query_id, count_if(ql = dl) AS n_same, count(*) AS n FROM r WHERE rank <= 10 GROUP BY query_id")
def dense_recall_by_label(spark, sf_dir):
    rows, best = nearest(spark, sf_dir, 10)
    label = lambda name: rows.select(F.col("vec_id").alias(name), F.col("label").alias(f"l_{name}"))
    return best.join(label("query_id"), "query_id").join(label("doc_id"), "doc_id").groupBy("query_id").agg(F.count_if(F.col("l_query_id") == F.col("l_doc_id")).alias("n_same"), F.count(F.lit(1)).alias("n"))


@query("WITH i AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'stale' ELSE sha256(coalesce(text, '')) END AS h FROM documents) SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents JOIN i USING (doc_id) WHERE h = sha256(coalesce(text, ''))")
def stale_hash_join(spark, sf_dir):
    """Index rows whose hash is no longer the document's are dropped; here every seventh is spoilt."""
    docs = docs_of(spark, sf_dir).select("doc_id", F.sha2(t.text("text"), 256).alias("content_hash"))
    index = docs.select("doc_id", F.when(F.col("doc_id") % 7 == 0, "stale").otherwise(F.col("content_hash")).alias("content_hash"))
    return docs.join(index, ["doc_id", "content_hash"])


@query("""
    WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS h, n_chars, text FROM documents), m AS (SELECT h, count(*) AS n FROM h GROUP BY h)
    SELECT doc_id, rule FROM (
        SELECT doc_id, 'n_chars' AS rule FROM h WHERE n_chars IS DISTINCT FROM length(text)
        UNION ALL SELECT doc_id, 'empty' FROM h WHERE trim(coalesce(text, '')) = ''
        UNION ALL SELECT doc_id, 'duplicate_text' FROM h JOIN m USING (h) WHERE n > 1)""")
def integrity_violations(spark, sf_dir):
    from ..sources.corpus import violations

    return violations(docs_of(spark, sf_dir))


@query("""
    WITH b AS (SELECT doc_id // 1000 AS bucket, sha256(string_agg(CAST(doc_id AS VARCHAR) || '|' || sha256(coalesce(text, '')) || chr(10), '' ORDER BY doc_id)) AS h, count(*) AS n FROM documents GROUP BY 1)
    SELECT sum(n) AS n_docs, sha256(string_agg(CAST(bucket AS VARCHAR) || '|' || h || chr(10), '' ORDER BY bucket)) AS fingerprint FROM b""")
def corpus_fingerprint(spark, sf_dir):
    """Order-sensitive SHA-256 in two levels: of every thousand ids, then of these digests; only digests meet in one task."""
    from ..sources.corpus import fingerprint

    return fingerprint(docs_of(spark, sf_dir))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents")
def sha_content(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.sha2(F.encode(t.text("text"), "UTF-8"), 256).alias("content_hash"), F.octet_length(t.text("text")).cast("long").alias("n_bytes"))


@query(f"WITH q AS (SELECT DISTINCT unnest({tokens_sql('text')}) AS term FROM benchmark), g AS (SELECT DISTINCT term, CASE WHEN length(term) <= 3 THEN term ELSE substr(term, i, 3) END AS gram FROM (SELECT term, unnest(generate_series(1, greatest(length(term) - 2, 1))) AS i FROM q)) SELECT gram, count(*) AS n_terms FROM g GROUP BY gram")
def char_trigrams(spark, sf_dir):
    terms = asked_of(spark, sf_dir).select(F.explode(t.tokens("text")).alias("term")).distinct()
    return terms.select(F.explode(t.char_ngrams(F.col("term"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n_terms"))


GRAMS = f"""
    v AS (SELECT DISTINCT term FROM (SELECT unnest({tokens_sql('text')}) AS term FROM benchmark) WHERE length(term) >= 5),
    x AS (SELECT term, substr(term, 1, 2) || substr(term, 4) AS typo FROM v),
    g AS (SELECT DISTINCT term, substr(term, i, 3) AS gram FROM (SELECT term, unnest(generate_series(1, length(term) - 2)) AS i FROM v)),
    y AS (SELECT DISTINCT term AS origin, typo, substr(typo, i, 3) AS gram FROM (SELECT term, typo, unnest(generate_series(1, greatest(length(typo) - 2, 1))) AS i FROM x)),
    s AS (SELECT y.origin, y.typo, g.term, count(*) AS hits FROM y JOIN g USING (gram) WHERE abs(length(y.typo) - length(g.term)) <= greatest(4, CAST(floor(0.4 * length(y.typo)) AS INT)) GROUP BY ALL)"""


@query(f"WITH {GRAMS}, n AS (SELECT term, count(*) AS n FROM g GROUP BY term), m AS (SELECT origin, count(*) AS m FROM y GROUP BY origin) SELECT s.origin, s.typo, s.term, round(hits / (n + m - hits), 6) AS similarity FROM s JOIN n USING (term) JOIN m USING (origin) WHERE hits / (n + m - hits) >= 0.3")
def trigram_jaccard(spark, sf_dir):
    return shortlist(spark, sf_dir).select("origin", "typo", "term", F.round(t.jaccard(t.char_ngrams(F.col("typo")), t.char_ngrams(F.col("term"))), 6).alias("similarity")).filter(t.jaccard(t.char_ngrams(F.col("typo")), t.char_ngrams(F.col("term"))) >= 0.3)


def shortlist(spark, sf_dir) -> DataFrame:
    """origin, typo, term, hits: vocabulary terms that share trigrams with a token that misses a letter; by equi-join on trigrams."""
    v = asked_of(spark, sf_dir).select(F.explode(t.tokens("text")).alias("term")).distinct().filter("length(term) >= 5")
    typos = v.select(F.col("term").alias("origin"), F.concat(F.left("term", F.lit(2)), F.expr("substring(term, 4)")).alias("typo"))
    left = typos.select("origin", "typo", F.explode(t.char_ngrams(F.col("typo"))).alias("gram"))
    right = v.select("term", F.explode(t.char_ngrams(F.col("term"))).alias("gram"))
    near = F.abs(F.length("typo") - F.length("term")) <= F.greatest(F.lit(4), F.floor(F.lit(0.4) * F.length("typo")))
    return left.join(right, "gram").filter(near).groupBy("origin", "typo", "term").agg(F.count(F.lit(1)).alias("hits"))


@query()
def fuzzy_candidates(spark, sf_dir):
    """The best correction of each typo: 0.9 * sequence ratio + 0.1 * trigram Jaccard of at least 0.82, among 120 by shared trigrams."""
    short = shortlist(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("origin").orderBy(F.col("hits").desc(), "term"))).filter("r <= 120")
    score = F.round(0.9 * py.sequence_ratio("typo", "term") + 0.1 * t.jaccard(t.char_ngrams(F.col("typo")), t.char_ngrams(F.col("term"))), 6)
    best = short.withColumn("score", score).filter("score >= 0.82").withColumn("k", F.row_number().over(Window.partitionBy("origin").orderBy(F.col("score").desc(), "term"))).filter("k = 1")
    return best.select("origin", "typo", "term", "score")


SUFFIXES_SQL = ", ".join(f"CASE WHEN ends_with({{x}}, '{s}') AND length({{x}}) - {len(s)} >= 4 THEN left({{x}}, length({{x}}) - {len(s)}) END" for s in t.SUFFIXES)
SUFFIX_SQL = SUFFIXES_SQL.format(x="term")


@query(f"WITH {BASE}, v AS (SELECT DISTINCT term FROM post WHERE length(term) >= 5) SELECT DISTINCT term, variant FROM (SELECT term, unnest([{SUFFIX_SQL}]) AS variant FROM v) JOIN (SELECT DISTINCT term AS variant FROM post) USING (variant)")
def suffix_variants(spark, sf_dir):
    v = ix.postings(docs_of(spark, sf_dir)).select("term").distinct()
    made = v.filter("length(term) >= 5").select("term", F.explode(t.suffix_variants(F.col("term"))).alias("variant"))
    return made.join(v.select(F.col("term").alias("variant")), "variant", "left_semi").select("term", "variant")


@query(f"WITH {BASE}, w AS (SELECT query_id, i, ws[i] AS a, ws[i + 1] AS b FROM (SELECT query_id, ws, unnest(generate_series(1, len(ws) - 1)) AS i FROM (SELECT item_id AS query_id, {tokens_sql('text')} AS ws FROM benchmark) WHERE len(ws) > 1)) SELECT DISTINCT query_id, a || b AS joined FROM w JOIN (SELECT DISTINCT term FROM post) p ON a || b = p.term WHERE a NOT IN ({STOP}) AND b NOT IN ({STOP})")
def compound_join(spark, sf_dir):
    """Neighbouring tokens whose concatenation is a term of the corpus."""
    w = asked_of(spark, sf_dir).select(F.col("item_id").alias("query_id"), t.tokens("text").alias("w")).filter(F.size("w") > 1)
    pairs = w.select("query_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.struct(F.get("w", i).alias("a"), F.get("w", i + 1).alias("b")))).alias("p"))
    pairs = pairs.filter(~F.col("p.a").isin(t.STOPWORDS) & ~F.col("p.b").isin(t.STOPWORDS)).select("query_id", F.concat("p.a", "p.b").alias("joined")).distinct()
    return pairs.join(ix.postings(docs_of(spark, sf_dir)).select(F.col("term").alias("joined")).distinct(), "joined", "left_semi").select("query_id", "joined")


# Rules in the shape of a query lexicon: (forms, expansions). The first matching form of a rule counts.
RULES = [(["of the", "the"], ["article", "definite"]), (["que"], ["what"]), (["de la", "de"], ["of"]), (["und", "der die"], ["and"]), (["in that"], ["therein"])]
RULES_SQL = ", ".join(f"({k}, {j}, '{f}')" for k, (forms, _) in enumerate(RULES) for j, f in enumerate(forms))


@query(f"WITH r(rule, form_ord, form) AS (VALUES {RULES_SQL}), q AS (SELECT item_id, ' ' || {fold_sql('text')} || ' ' AS f FROM benchmark) SELECT item_id, rule, form FROM (SELECT item_id, rule, form, row_number() OVER (PARTITION BY item_id, rule ORDER BY form_ord) AS k FROM q JOIN r ON contains(f, ' ' || form || ' ')) WHERE k = 1")
def lexicon_expand(spark, sf_dir):
    """Matching rules of a small literal lexicon, as one expression per rule."""
    padded = asked_of(spark, sf_dir).select("item_id", F.concat(F.lit(" "), t.fold("text"), F.lit(" ")).alias("f"))
    hits = [F.struct(F.lit(k).alias("rule"), F.coalesce(*(F.when(F.col("f").contains(f" {f} "), F.lit(f)) for f in forms)).alias("form")) for k, (forms, _) in enumerate(RULES)]
    return padded.select("item_id", F.explode(F.filter(F.array(*hits), lambda h: h["form"].isNotNull())).alias("h")).select("item_id", "h.rule", "h.form")


@query("SELECT conv_id, turn, pos, clause FROM (SELECT conv_id, turn, unnest(generate_series(1, len(c))) AS pos, unnest(c) AS clause FROM (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(coalesce(text, ''), ';|,\\s+(?:and|y|und|et)\\s+'), lambda x: trim(x)), lambda x: length(x) >= 12)[1:3] AS c FROM conversations WHERE role = 'user'))")
def clause_split(spark, sf_dir):
    """Up to three clauses of twelve characters or more of a user's turn."""
    parts = F.transform(F.split(t.text("text"), r";|,\s+(?:and|y|und|et)\s+"), lambda x: F.trim(x))
    kept = F.slice(F.filter(parts, lambda x: F.length(x) >= 12), 1, 3)
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.posexplode(kept).alias("p", "clause")).select("conv_id", "turn", (F.col("p") + 1).alias("pos"), "clause")


@query(f"SELECT doc_id, {heading_sql('text')} AS heading FROM documents")
def section_heading(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", t.section_heading("text").alias("heading"))


@query(f"SELECT doc_id, term, n, r FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS r FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents) WHERE length(term) >= 4 AND term NOT IN ({STOP}) GROUP BY doc_id, term)) WHERE r <= 12")
def alias_top_terms(spark, sf_dir):
    terms = ix.postings(docs_of(spark, sf_dir)).filter((F.length("term") >= 4) & ~F.col("term").isin(t.STOPWORDS) & F.col("in_body"))
    return terms.select("doc_id", "term", F.col("tf").alias("n"), F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("tf").desc(), "term")).alias("r")).filter("r <= 12")


SENT = "list_filter(list_transform(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda s: trim(s)), lambda s: s <> '' AND len(string_split_regex(s, '\\s+')) >= 3)"


@query(f"SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(list_transform(s, lambda x: left(x, 700)), '|')) AS sentences_md5 FROM (SELECT doc_id, {SENT} AS s FROM documents)")
def sentence_split(spark, sf_dir):
    s = docs_of(spark, sf_dir).select("doc_id", t.sentences("text").alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("sentences_md5"))


@query("""
    WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, '')) AS n FROM documents),
    c AS (
        SELECT doc_id, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b FROM d
        UNION ALL
        SELECT doc_id, b, CASE WHEN b + 1200 >= n THEN n WHEN greatest(line, stop) > 0 THEN greatest(line, stop) + 1 ELSE b + 1200 END
        FROM (
            SELECT *, CASE WHEN contains(w, chr(10)) THEN b + 1200 - strpos(reverse(w), chr(10)) ELSE -1 END AS line, CASE WHEN contains(w, '. ') THEN b + 1199 - strpos(reverse(w), ' .') ELSE -1 END AS stop
            FROM (SELECT doc_id, b, n, substr(x, b + 401, 800) AS w FROM c JOIN d USING (doc_id) WHERE b < n))
    ),
    s AS (SELECT doc_id, a, substr(x, a + 1, b - a) AS raw FROM c JOIN d USING (doc_id) WHERE b > a),
    t AS (SELECT doc_id, a + length(raw) - length(regexp_replace(raw, '^\\s+', '')) AS start, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS text FROM s)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INT) AS seq, CAST(start AS INT) AS start, CAST(start + length(text) AS INT) AS "end", sha256(text) AS text_sha256 FROM t WHERE text <> ''""")
def spans_1200(spark, sf_dir):
    return spans.spans(docs_of(spark, sf_dir)).select("doc_id", "seq", "start", "end", F.sha2("text", 256).alias("text_sha256"))


@query(f"""
    WITH {LEX}, top AS (SELECT query_id, doc_id FROM lexr WHERE rank = 1),
    s AS (SELECT query_id, doc_id, pos, sentence FROM (SELECT query_id, doc_id, unnest(generate_series(1, len(s))) AS pos, unnest(s) AS sentence FROM (SELECT query_id, doc_id, {SENT} AS s FROM top JOIN documents USING (doc_id)))),
    o AS (SELECT query_id, doc_id, pos, left(sentence, 700) AS sentence, len(list_intersect(list_distinct({tokens_sql('left(sentence, 700)')}), (SELECT list(term) FROM qt WHERE qt.query_id = s.query_id))) AS overlap FROM s)
    SELECT query_id, doc_id, pos, overlap, sentence FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, pos) AS r FROM o) WHERE r = 1""")
def best_sentence(spark, sf_dir):
    """Of the best document of each query, the sentence that shares most content tokens; the earliest of equals."""
    top = written(lexical_ranking(spark, sf_dir, most=1).select("query_id", "doc_id"), "best")
    # One row a query: the texts stay where they are read.
    top = F.broadcast(top) if top.count() <= MOST else top
    s = top.join(docs_of(spark, sf_dir).select("doc_id", "text"), "doc_id").select("query_id", "doc_id", F.posexplode(t.sentences("text")).alias("p", "sentence"))
    words = asked_of(spark, sf_dir).select(F.col("item_id").alias("query_id"), F.array_distinct(t.content_tokens("text")).alias("q"))
    scored = s.join(words, "query_id").withColumn("overlap", F.size(F.array_intersect("q", t.tokens("sentence"))))
    best = scored.groupBy("query_id").agg(F.max_by(F.struct("doc_id", (F.col("p") + 1).alias("pos"), "overlap", "sentence"), F.struct("overlap", -F.col("p"))).alias("b"))
    return best.select("query_id", "b.*")


@query("SELECT doc_id, v AS value, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '(?i)\\b\\d{1,3}(?:[ .]\\d{3})*(?:,\\d{1,2})?\\s?(?:€|eur)')) AS v FROM documents) GROUP BY ALL")
def amount_extract(spark, sf_dir):
    found = F.regexp_extract_all(t.text("text"), F.lit(r"(?i)\b\d{1,3}(?:[ .]\d{3})*(?:,\d{1,2})?\s?(?:€|eur)"), F.lit(0))
    return docs_of(spark, sf_dir).select("doc_id", F.explode(found).alias("value")).groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))


@query()
def document_facts(spark, sf_dir):
    return spans.facts(docs_of(spark, sf_dir))


@query("SELECT page_id, url FROM pages WHERE starts_with(url, 'https://') AND regexp_matches(url, '^https://([a-z0-9-]+\\.)*example\\.(com|org)(/|$)') AND NOT contains(url, '?') AND NOT contains(url, '#')")
def url_host_filter(spark, sf_dir):
    """https pages of allowed hosts, without query or fragment."""
    host = F.try_parse_url("url", F.lit("HOST"))
    ok = (F.try_parse_url("url", F.lit("PROTOCOL")) == "https") & host.rlike(r"^([a-z0-9-]+\.)*example\.(com|org)$") & ~F.col("url").contains("?") & ~F.col("url").contains("#")
    return table(spark, sf_dir, "pages").filter(ok).select("page_id", "url")


@query()
def html_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", py.html_text("html").alias("text"))


@query("""
    WITH a AS (SELECT conv_id, turn, 'DOC_' || conv_id AS cited, CASE WHEN turn % 3 = 0 THEN 'ZZ_1' ELSE 'DOC_' || conv_id END AS second FROM conversations WHERE role = 'assistant')
    SELECT conv_id * 1000 + turn AS answer_id, CASE WHEN second = cited THEN 1 ELSE 2 END AS n_cited, CASE WHEN second <> cited THEN 1 ELSE 0 END + CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END AS n_unknown
    FROM a LEFT JOIN documents d ON d.doc_id = a.conv_id""")
def citation_check(spark, sf_dir):
    """Answers with citations put after their text, against the ids of documents."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    second = F.when(F.col("turn") % 3 == 0, " [zz_1]").otherwise("")
    answer = F.concat(t.text("text"), F.lit(" [ doc_"), F.col("conv_id").cast("string"), F.lit(" ]"), second)
    answers = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), answer.alias("answer"))
    known = docs_of(spark, sf_dir).select(F.concat(F.lit("DOC_"), F.col("doc_id").cast("string")).alias("id"))
    return verify.verify_citations(answers, known).select("answer_id", "n_cited", "n_unknown")


EVID = "trim(regexp_replace(translate(replace(lower(regexp_replace({x}, '<[^>]+>', ' ', 'g')), 'ß', 'ss'), '“”„–—', '\"\"\"--'), '\\s+', ' ', 'g'))"


@query(f"""
    WITH b AS (SELECT item_id, {EVID.format(x="coalesce(text, '')")} AS e FROM benchmark), d AS (SELECT doc_id, {EVID.format(x="coalesce(text, '')")} AS s FROM documents)
    SELECT item_id AS answer_id, length(e) >= 24 AND coalesce(contains(s, e), FALSE) AS accepted FROM b LEFT JOIN d ON doc_id = item_id * 3""")
def evidence_check(spark, sf_dir):
    """Each benchmark item as a quote of one document."""
    claims = asked_of(spark, sf_dir).select(F.col("item_id").alias("answer_id"), F.lit(1).alias("claim_id"), (F.col("item_id") * 3).cast("string").alias("source_id"), F.col("text").alias("evidence"))
    return verify.verify_evidence(claims, docs_of(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source_id"), "text"))


CW = "list_filter(list_distinct(regexp_extract_all({x}, '[a-zõäöü]{{4,}}')), lambda w: w NOT IN ('selle', 'ning', 'kuid', 'vaid', 'tuleb', 'saab', 'peab'))"


@query(f"""
    WITH p AS (SELECT doc_id, {EVID.format(x="coalesce(text, '')")} AS e, {EVID.format(x="coalesce(lead(text) OVER (ORDER BY doc_id), '')")} AS c FROM documents),
    w AS (SELECT doc_id, e, c, {CW.format(x='c')} AS cw, regexp_extract_all(e, '[a-zõäöü]{{4,}}') AS ew FROM p)
    SELECT doc_id, len(cw) AS n_words, len(list_filter(cw, lambda x: list_contains(ew, x))) AS n_shared, len(cw) < 4 OR 2 * len(list_filter(cw, lambda x: list_contains(ew, x))) >= len(cw) AS overlaps FROM w""")
def claim_support(spark, sf_dir):
    """Each document as the evidence of the next one's text: overlap of content words."""
    docs = docs_of(spark, sf_dir).select("doc_id", "text")
    ids = docs.select("doc_id")
    after = ids.join(ids.withColumnRenamed("doc_id", "next"), F.col("next") == F.col("doc_id") + 1, "left")
    pairs = docs.join(after, "doc_id").join(docs.select(F.col("doc_id").alias("next"), F.col("text").alias("claim")), "next", "left")
    words = pairs.select("doc_id", verify.content_words(t.evidence_form("claim")).alias("cw"), F.regexp_extract_all(t.evidence_form("text"), F.lit("[a-zõäöü]{4,}"), F.lit(0)).alias("ew"))
    shared = F.size(F.array_intersect("cw", "ew"))
    return words.select("doc_id", F.size("cw").alias("n_words"), shared.alias("n_shared"), ((F.size("cw") < 4) | (2 * shared >= F.size("cw"))).alias("overlaps"))


CONCEPTS = {"money": ["\\beur", "[0-9] ?%"], "person": ["\\bthe\\b.{0,40}\\bthat\\b"], "link": ["https?://", "www\\."]}


@query("""
    SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(x, '\\beur') OR regexp_matches(x, '[0-9] ?%') THEN 'money' END, CASE WHEN regexp_matches(x, '\\bthe\\b.{0,40}\\bthat\\b') THEN 'person' END,
        CASE WHEN regexp_matches(x, 'https?://') OR regexp_matches(x, 'www\\.') THEN 'link' END], lambda v: v IS NOT NULL), ',') AS concepts FROM (SELECT doc_id, lower(coalesce(text, '')) AS x FROM documents)""")
def concept_gate(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.array_join(verify.concepts(F.lower(t.text("text")), CONCEPTS), ",").alias("concepts"))


@query(f"""
    WITH {LEX}, a AS (SELECT query_id, list('DOC_' || doc_id) AS av, list('DOC_' || doc_id) FILTER (rank <= 2) AS ci FROM lexr WHERE rank <= 5 GROUP BY query_id)
    SELECT item_id AS request_id, CASE WHEN item_id % 5 = 0 THEN 'RULE_UNRESOLVED' WHEN a.av IS NULL OR NOT list_contains(a.av, 'DOC_' || top) THEN 'SOURCE_MISSING'
        WHEN list_contains(ci, 'DOC_' || top) THEN 'COVERED' ELSE 'ANSWER_MISSING' END AS status, 'source' AS obligation
    FROM (SELECT item_id, (item_id * 7) % 200 AS top FROM benchmark) LEFT JOIN a ON a.query_id = item_id""")
def coverage_report(spark, sf_dir):
    """One obligation per item: a fixed source that the top five must hold and the top two must cite."""
    group = F.array(F.array(F.concat(F.lit("DOC_"), ((F.col("item_id") * 7) % 200).cast("string"))))
    none = F.lit(None).cast("array<array<string>>")
    duties = asked_of(spark, sf_dir).select(F.col("item_id").alias("request_id"), F.lit("source").alias("obligation"), F.when(F.col("item_id") % 5 == 0, F.array().cast("array<array<string>>")).otherwise(group).alias("groups"), none.alias("terms"), F.lit(None).cast("string").alias("answer_folded"))
    top = written(lexical_ranking(spark, sf_dir, most=5), "ranking").select(F.col("query_id").alias("request_id"), F.concat(F.lit("DOC_"), F.col("doc_id").cast("string")).alias("id"), "rank")
    return verify.coverage(duties, top, top.filter("rank <= 2"))


@query(f"""
    WITH {LEX}, truth AS (SELECT item_id AS query_id, doc_id FROM (SELECT item_id, {fold_sql('text')} AS f FROM benchmark) b JOIN (SELECT doc_id, {fold_sql('text')} AS f FROM documents) d ON b.f <> '' AND contains(' ' || d.f || ' ', ' ' || b.f || ' ')),
    e AS (SELECT query_id, count(*) AS n_expected, count(l.rank) AS n_found FROM truth LEFT JOIN (SELECT * FROM lexr WHERE rank <= 5) l USING (query_id, doc_id) GROUP BY query_id)
    SELECT query_id, n_expected, n_found, n_found > 0 AS hit_any, n_found = n_expected AS hit_all FROM e""")
def eval_recall(spark, sf_dir):
    truth = containment_join(spark, sf_dir).withColumnRenamed("item_id", "query_id")
    return evaluate.recall(lexical_ranking(spark, sf_dir, most=5), truth, 5)


@query("SELECT lang, source, count_if(quality = 1) AS passed, count(quality) AS total, grouping(lang, source) AS level FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (lang), (source), (lang, source))")
def eval_grouping_sets(spark, sf_dir):
    rows = docs_of(spark, sf_dir).select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("good", F.col("quality") == 1)
    return evaluate.rollup(rows, [[], ["lang"], ["source"], ["lang", "source"]], "good")


PCT = "SELECT event_type, value AS percentile, n FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE r = {at}"


@query(PCT.format(at="CAST(floor((n - 1) * CAST(0.95 AS DOUBLE)) AS BIGINT) + 1"))
def percentile_floor(spark, sf_dir):
    return evaluate.percentile(table(spark, sf_dir, "events"), "event_type", "value", 0.95, "floor")


@query(PCT.format(at="greatest(CAST(ceil(n * CAST(0.95 AS DOUBLE)) AS BIGINT), 1)"))
def percentile_nearest(spark, sf_dir):
    return evaluate.percentile(table(spark, sf_dir, "events"), "event_type", "value", 0.95)


@query("SELECT event_type, count(*) AS n, max(value) AS max_value, min(event_id) AS first_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS b FROM events) WHERE b <= 500 GROUP BY event_type")
def latency_last500(spark, sf_dir):
    rows = evaluate.last_n(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], 500)
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("max_value"), F.min("event_id").alias("first_id"))


@query("SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS status, count(*) AS n FROM events GROUP BY ALL")
def status_counters(spark, sf_dir):
    return evaluate.counters(table(spark, sf_dir, "events").withColumn("status", F.floor(F.col("value") / 10)), ["event_type", "status"])


@query("SELECT o_orderkey FROM orders WHERE DATE '1996-06-15' >= CAST(o_orderdate AS DATE) AND DATE '1996-06-15' <= CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER)")
def validity_filter(spark, sf_dir):
    start = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").filter(temporal.valid_inclusive(F.lit("1996-06-15").cast("date"), start, F.date_add(start, (F.col("o_orderkey") % 60).cast("int")))).select("o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1996-06-15') WHERE r = 1")
def asof_revision(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return temporal.as_of(rows, "o_custkey", "o_orderdate", F.lit("1996-06-15").cast("date"), "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' AND length(text) >= 100 THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS request_turn FROM conversations")
def turn_carry_forward(spark, sf_dir):
    """The last substantive user turn that stands at each turn."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when((F.col("role") == "user") & (F.length("text") >= 100), F.col("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(own, ignorenulls=True).over(w).alias("request_turn"))


@query("SELECT conv_id, turn, role, md5(coalesce(text, '')) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
def latest_card(spark, sf_dir):
    last = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by(F.struct("turn", "role", "text"), "turn").alias("c"))
    return last.select("conv_id", "c.turn", "c.role", F.md5(t.text("c.text")).alias("text_md5"))


@query("""
    WITH g AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 86400000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, session, count(*) AS n_events FROM s GROUP BY ALL""")
def session_ttl(spark, sf_dir):
    rows = temporal.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 86_400, "event_id")
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n_events"))


@query("""
    WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
    st AS (
        SELECT user_id, event_type, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS recent, true AS allowed, CAST(0 AS BIGINT) AS retry_after FROM (SELECT DISTINCT user_id, event_type FROM e)
        UNION ALL
        SELECT user_id, event_type, event_id, rn, CASE WHEN len(r) < 2 THEN list_append(r, t) ELSE r END, len(r) < 2, CASE WHEN len(r) < 2 THEN 0 ELSE greatest(1, (604800000000 - (t - r[1]) + 999999) // 1000000) END
        FROM (SELECT e.*, list_filter(st.recent, lambda x: x > e.t - 604800000000) AS r FROM st JOIN e ON st.user_id = e.user_id AND st.event_type = e.event_type AND e.rn = st.rn + 1)
    )
    SELECT user_id, event_type, event_id, allowed, retry_after FROM st WHERE rn > 0""")
def rate_limit(spark, sf_dir):
    rows = temporal.rate_limit(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", 2, 7 * 86_400)
    return rows.select("user_id", "event_type", "event_id", "allowed", "retry_after")


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(sum(CAST(round(value, 6) AS DECIMAL(18, 6))), 6) AS total FROM events GROUP BY ALL")
def stream_counts(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 day").alias("w"))
    return days.agg(F.count(F.lit(1)).alias("n"), F.sum(F.round("value", 6).cast("decimal(18,6)")).alias("total")).select("event_type", F.col("w.start").alias("day"), "n", "total")


@query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3")
def topk_per_group(spark, sf_dir):
    best = lexical.ranked(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice"), 3, "p_brand", "p_partkey", "p_retailprice")
    return best.select("p_brand", "p_partkey", "p_retailprice")
