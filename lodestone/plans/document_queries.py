"""Registered queries of document sources and evidence, and the SQL that gives the same rows."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..operators import evidence as ev
from ..operators import mentions as mn
from ..operators import obligations as ob
from ..operators import revisions as rv
from ..sources import documents as sd
from ..sources.versions import blob_sha1
from .queries import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@F.pandas_udf(T.BinaryType())
def as_docx(s: pd.Series) -> pd.Series:
    """A DOCX whose body has the text's lines as paragraphs."""

    def one(text):
        escape = lambda x: "".join(c if c.isprintable() or c == "\t" else " " for c in x).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        lines = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in (text or "").split("\n"))
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("word/document.xml", f'<w:document xmlns:w="{sd.WORD[1:-1]}"><w:body>{lines}</w:body></w:document>')
        return held.getvalue()

    return s.map(one)


CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace({x}, '[ \\t]+', ' ', 'g'), '\\n[ \\t]+', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10))"
ASCII_SQL = "regexp_replace(coalesce(text, ''), '[^ -~\\n\\t]', '', 'g')"


@query(f"""
    WITH d AS (SELECT doc_id, doc_id % 9 AS k, {ASCII_SQL} AS x FROM documents),
    c AS (SELECT *, CASE WHEN k = 1 THEN array_to_string(list_filter(list_transform(string_split(x, chr(10)), lambda l: trim(l, ' ' || chr(9))), lambda l: l <> ''), chr(10)) ELSE x END AS body FROM d),
    e AS (SELECT *, {CLEAN.format(x='body')} AS clean FROM c)
    SELECT doc_id, CASE WHEN k IN (0, 2, 3, 8) THEN 'txt' WHEN k IN (1, 4) THEN 'docx' WHEN k = 5 THEN 'pdf' WHEN k = 6 THEN 'exe' ELSE 'png' END AS file_type,
           CASE WHEN k IN (0, 2) AND clean <> '' THEN 'text' WHEN k = 1 AND clean <> '' THEN 'docx' END AS method,
           CASE WHEN k IN (0, 1, 2) AND clean <> '' THEN length(left(clean, 120000)) END AS n_chars, CASE WHEN k IN (0, 1, 2) AND clean <> '' THEN md5(left(clean, 120000)) END AS text_md5,
           CASE WHEN k = 7 THEN 'recognition' END AS needs,
           CASE WHEN k = 8 OR (k IN (0, 3) AND x = '') THEN 'empty file' WHEN k = 3 THEN 'binary content in a text file' WHEN k = 4 THEN 'not a valid docx' WHEN k = 5 THEN 'not a valid pdf' WHEN k = 6 THEN 'unsupported kind of file'
                WHEN k IN (0, 1, 2) AND clean = '' THEN 'no readable text' END AS error
    FROM e""")
def document_scan(spark, sf_dir):
    """Documents as files of several kinds, some of them not what their names say."""
    x = F.regexp_replace(t.text("text"), r"[^ -~\n\t]", "")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 9).alias("k"), x.alias("x"))
    kind = F.when(F.col("k").isin(0, 2, 3, 8), "txt").when(F.col("k").isin(1, 4), "docx").when(F.col("k") == 5, "pdf").when(F.col("k") == 6, "exe").otherwise("png")
    plain = F.encode("x", "UTF-8")
    content = (
        F.when(F.col("k") == 0, plain).when(F.col("k") == 2, F.concat(F.lit(b"\xef\xbb\xbf"), plain)).when(F.col("k") == 3, F.encode("x", "UTF-16LE")).when(F.col("k") == 7, F.concat(F.lit(sd.SIGNATURES["png"]), plain))
        .when(F.col("k") == 8, F.lit(b"")).otherwise(F.concat(F.lit(b"x"), plain))
    )
    other = rows.filter("k <> 1").withColumn("content", content)
    files = other.unionByName(rows.filter("k = 1").withColumn("content", as_docx("x")))
    files = files.select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(" file."), F.upper(kind)).alias("path"), F.octet_length("content").cast("long").alias("length"), "content")
    found = sd.parse(files)
    return found.select(F.regexp_extract("file_name", r"^\d+", 0).cast("long").alias("doc_id"), "file_type", "method", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"), "needs", "error")


@query("SELECT doc_id, sha1(encode('blob ' || octet_length(encode(coalesce(text, '')))) || '\\x00'::BLOB || encode(coalesce(text, ''))) AS blob FROM documents")
def blob_names(spark, sf_dir):
    """The names that the texts would have as blobs of version control."""
    return table(spark, sf_dir, "documents").select("doc_id", blob_sha1(t.text("text")).alias("blob"))


FOLD_QUOTE = "trim(regexp_replace(lower({x}), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"
TRIM = "regexp_replace(coalesce({x}, ''), '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g')"
#: Variants of a claim: by doc_id % 13.
SPAN, STEP = 400, 13


@query(f"""
    WITH sp AS (
        SELECT doc_id, 'DOC-' || doc_id || '-P' || page AS span_id, page, (page - 1) * {SPAN} AS first, substr(text, (page - 1) * {SPAN} + 1, {SPAN}) AS text, CASE WHEN doc_id % 5 = 0 THEN 'ocr' ELSE 'text' END AS method
        FROM (SELECT doc_id, text, unnest(generate_series(1, least(3, (length(text) + {SPAN} - 1) // {SPAN}))) AS page FROM documents WHERE length(text) > 0)
    ), s AS (SELECT *, doc_id % {STEP} AS v, {TRIM.format(x='substr(text, 41, 60)')} AS q FROM sp WHERE page = 2 AND length(text) >= 120),
    a AS (
        SELECT doc_id, v, span_id, page, first, text, method, CASE WHEN v = 1 THEN upper(q) WHEN v = 2 THEN replace(q, ' ', '  ') WHEN v = 3 THEN 'zz' || q WHEN v = 4 THEN '' ELSE q END AS evidence,
               CASE WHEN v = 5 THEN page + 1 WHEN v = 6 THEN NULL ELSE page END AS said_page, CASE WHEN v = 7 THEN 0 WHEN v = 6 THEN NULL ELSE first + strpos(text, q) - 1 END AS said_start,
               CASE WHEN v = 8 THEN 7 WHEN v = 6 THEN NULL ELSE first + strpos(text, q) - 1 + length(q) END AS said_end,
               CASE WHEN v = 9 THEN 'DOCUMENT_TEXT_VERIFIED' WHEN method = 'ocr' THEN 'OCR_REVIEW_REQUIRED' ELSE 'DOCUMENT_TEXT_VERIFIED' END AS status, v = 10 AS unknown, v = 11 AS untold, v = 12 AS nosource FROM s
    ), r AS (
        SELECT *, CASE WHEN nosource THEN 'no sources' WHEN evidence = '' THEN 'no evidence' WHEN unknown THEN 'unknown source' WHEN NOT contains({FOLD_QUOTE.format(x='text')}, {FOLD_QUOTE.format(x='evidence')}) THEN 'not quoted' WHEN strpos(text, evidence) = 0 THEN 'not literal'
            WHEN said_page IS NOT NULL AND said_page <> page THEN 'wrong page' WHEN said_start IS NOT NULL AND said_start <> first + strpos(text, evidence) - 1 THEN 'wrong start'
            WHEN said_end IS NOT NULL AND said_end <> first + strpos(text, evidence) - 1 + length(evidence) THEN 'wrong end'
            WHEN untold OR status <> CASE WHEN method = 'ocr' THEN 'OCR_REVIEW_REQUIRED' ELSE 'DOCUMENT_TEXT_VERIFIED' END THEN 'kind and sources disagree' END AS reason FROM a
    )
    SELECT doc_id AS answer_id, reason IS NULL AS accepted, reason, CASE WHEN reason IS NULL THEN CAST(first + strpos(text, evidence) - 1 AS INT) END AS start, CASE WHEN reason IS NULL THEN CAST(first + strpos(text, evidence) - 1 + length(evidence) AS INT) END AS "end" FROM r""")
def evidence_offsets(spark, sf_dir):
    """Quotes of documents' second spans, with positions, in thirteen variants of which most are wrong in one respect."""
    docs = table(spark, sf_dir, "documents").filter(F.length("text") > 0)
    pages = F.explode(F.sequence(F.lit(1), F.least(F.lit(3), F.ceil(F.length("text") / SPAN).cast("int")))).alias("page")
    spans = docs.select("doc_id", "text", pages).withColumns({"start": (F.col("page") - 1) * SPAN, "text": F.substring("text", (F.col("page") - 1) * SPAN + 1, F.lit(SPAN))})
    spans = spans.select("doc_id", F.concat(F.lit("DOC-"), F.col("doc_id").cast("string"), F.lit("-P"), F.col("page").cast("string")).alias("span_id"), "page", "start", "text", F.when(F.col("doc_id") % 5 == 0, "ocr").otherwise("text").alias("method"))
    v, q = F.col("doc_id") % STEP, F.regexp_replace(F.substring("text", 41, 60), r"^[ \t\n\r\f\x0b]+|[ \t\n\r\f\x0b]+$", "")
    own = spans.filter((F.col("page") == 2) & (F.length("text") >= 120)).withColumns({"v": v, "q": q, "at": F.col("start") + F.instr("text", q) - 1})
    is_ = lambda *k: F.col("v").isin(*k)
    evidence = F.when(is_(1), F.upper("q")).when(is_(2), F.replace("q", F.lit(" "), F.lit("  "))).when(is_(3), F.concat(F.lit("zz"), "q")).when(is_(4), "").otherwise(F.col("q"))
    none = F.lit(None).cast("int")
    sources = own.filter(~is_(12)).select(
        F.col("doc_id").alias("answer_id"), F.lit(1).cast("long").alias("claim_id"), F.lit(1).alias("seq"), F.lit("document").alias("kind"), F.when(is_(10), "DOC-none").otherwise(F.lower("span_id")).alias("id"), evidence.alias("evidence"),
        F.when(is_(5), F.col("page") + 1).when(is_(6), none).otherwise(F.col("page")).alias("page"), F.when(is_(7), 0).when(is_(6), none).otherwise(F.col("at")).alias("start"), F.when(is_(8), 7).when(is_(6), none).otherwise(F.col("at") + F.length("q")).alias("end"),
    )
    status = F.when((F.col("method") == "ocr") & ~is_(9), ev.OCR_STATUS).otherwise("DOCUMENT_TEXT_VERIFIED")
    claims = own.select(F.col("doc_id").alias("answer_id"), F.lit(1).cast("long").alias("claim_id"), F.when(is_(11), "law").otherwise("document_excerpt").alias("kind"), F.lit("text").alias("text"), status.alias("status"))
    nothing = spark.createDataFrame([], "id string, text string, verified boolean")
    accepted, checked = ev.verify(claims, sources, nothing.drop("verified"), spans, nothing)
    where = checked.filter("reason is null").select("answer_id", "start", "end")
    out = accepted.join(where, "answer_id", "left")
    hidden = lambda c: F.when(F.col("accepted"), F.col(c)).alias(c)
    return out.select("answer_id", "accepted", "reason", hidden("start"), hidden("end"))


@query(f"""
    WITH s AS (SELECT doc_id, text, {TRIM.format(x="substr(text, 101, 50)")} AS q FROM documents WHERE length(text) >= 200),
    p AS (SELECT doc_id, text, q, CASE doc_id % 3 WHEN 0 THEN q WHEN 1 THEN upper(regexp_replace(q, '[ \\t\\n\\r]+', chr(9) || '  ', 'g')) ELSE q || '#' END AS quote FROM s WHERE regexp_full_match(q, '[ -~]+') AND regexp_full_match(text, '[ -~\\n\\t\\r]+')),
    m AS (SELECT *, regexp_extract(lower(text), regexp_replace(regexp_replace(lower(quote), '([^a-z0-9 \\t\\n\\r])', '\\\\\\1', 'g'), '[ \\t\\n\\r]+', '[[:space:]]+', 'g')) AS hit FROM p)
    SELECT doc_id, CASE WHEN strpos(text, quote) > 0 THEN CAST(strpos(text, quote) - 1 AS INT) WHEN hit <> '' THEN CAST(strpos(lower(text), hit) - 1 AS INT) END AS start,
           CASE WHEN strpos(text, quote) > 0 THEN CAST(strpos(text, quote) - 1 + length(quote) AS INT) WHEN hit <> '' THEN CAST(strpos(lower(text), hit) - 1 + length(hit) AS INT) END AS "end" FROM m""")
def quote_positions(spark, sf_dir):
    """Where quotes stand that differ from their text in case and white space; every third is not there."""
    q = F.regexp_replace(F.substring("text", 101, 50), r"^[ \t\n\r\f\x0b]+|[ \t\n\r\f\x0b]+$", "")
    docs = table(spark, sf_dir, "documents").filter(F.length("text") >= 200).withColumn("q", q).filter(F.col("q").rlike("^[ -~]+$") & F.col("text").rlike(r"^[ -~\n\t\r]+$"))
    k = F.col("doc_id") % 3
    quote = F.when(k == 0, F.col("q")).when(k == 1, F.upper(F.regexp_replace("q", r"[ \t\n\r]+", "\t  "))).otherwise(F.concat("q", F.lit("#")))
    return docs.select("doc_id", ev.located(F.col("text"), quote).alias("at")).select("doc_id", "at.start", "at.end")


CLAIM_SQL = "list_filter(list_transform(flatten(list_transform(string_split({x}, chr(10)), lambda l: string_split(regexp_replace(trim(l, ' ' || chr(9) || chr(13)), '([.!?])\\s+([A-ZÕÄÖÜ0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)))), lambda c: trim(c)), lambda c: c <> '')"
CITED = "\\[\\s*([A-ZÕÄÖÜa-zõäöü]+_\\d+(?:[Bb]\\d+|[A-Za-z])?)\\s*\\]"


@query(f"""
    WITH a AS (SELECT conv_id * 1000 + turn AS answer_id, coalesce(text, '') || CASE WHEN turn % 4 = 1 THEN ' See [doc_1].' ELSE '' END AS answer FROM conversations WHERE role = 'assistant'),
    w AS (SELECT doc_id, source, list_filter(string_split_regex(trim(left(coalesce(text, ''), 200)), '[ \\t\\n\\r]+'), lambda x: x <> '') AS w FROM documents),
    terms AS (SELECT DISTINCT term FROM (
        SELECT upper(source) || 'X' AS term FROM documents WHERE source IS NOT NULL
        UNION ALL SELECT array_to_string(list_slice(w, 1, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END), ' ') FROM w WHERE doc_id % 3 = 0) WHERE term <> ''),
    c AS (SELECT answer_id, k - 1 AS claim_no, cs[k] AS claim FROM (SELECT answer_id, cs, unnest(generate_series(1, len(cs))) AS k FROM (SELECT answer_id, {CLAIM_SQL.format(x='answer')} AS cs FROM a))),
    o AS (SELECT * FROM c WHERE NOT regexp_matches(claim, '{CITED}')),
    m AS (
        SELECT DISTINCT answer_id, claim_no, term FROM o JOIN terms ON CASE WHEN length(term) > 12 THEN contains(lower(claim), lower(term))
            ELSE contains(upper(replace(claim, 'ß', 'ss')), upper(term)) AND regexp_matches(upper(replace(claim, 'ß', 'ss')), '(^|[^A-ZÕÄÖÜ])' || regexp_replace(upper(term), '([^A-Za-z0-9 \\x80-\\x{{10FFFF}}])', '\\\\\\1', 'g') || '($|[^A-ZÕÄÖÜ])') END
    )
    SELECT o.answer_id, CAST(o.claim_no AS INT) AS claim_no, coalesce(ts, '') AS terms, md5(claim) AS claim_md5 FROM o LEFT JOIN (SELECT answer_id, claim_no, string_agg(term, '|' ORDER BY term) AS ts FROM m GROUP BY ALL) m USING (answer_id, claim_no)
    WHERE ts IS NOT NULL OR regexp_matches(claim, '(?i)(^|[^\\pL\\pN_])(VÕS|VOS|TLS|KarS|KrMS|TsMS|seadus|seaduse|paragrahv|paragrahvi)($|[^\\pL\\pN_])|§')""")
def uncited_mentions(spark, sf_dir):
    """Claims of assistants' turns that have a document's first words, or a source's name, without citing; every fourth turn ends with a citation."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    answers = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.concat(t.text("text"), F.when(F.col("turn") % 4 == 1, " See [doc_1].").otherwise("")).alias("answer"))
    docs = table(spark, sf_dir, "documents")
    w = F.filter(F.split(F.trim(F.left(t.text("text"), F.lit(200))), r"[ \t\n\r]+"), lambda x: x != "")
    name = F.when(F.col("doc_id") % 3 == 0, F.array_join(F.slice(w, 1, F.when(F.col("doc_id") % 2 == 0, 1).otherwise(2)), " "))
    registry = docs.select(F.concat("source", F.lit("x_"), F.col("doc_id").cast("string")).alias("id"), name.alias("law_name"))
    found = mn.uncited_mentions(answers, registry)
    return found.select("answer_id", "claim_no", F.array_join("terms", "|").alias("terms"), F.md5("claim").alias("claim_md5"))


HEADINGS = {"KOKKUVÕTE": 2, "SOOVITUSED": 3}


def section_sql(name: str, most: int) -> str:
    letters = "[A-ZÕÄÖÜa-zõäöü]"
    return f"""
        SELECT answer_id, '{name}' AS heading, list_slice(list_filter(list_transform(string_split(part, chr(10)), lambda l: trim(regexp_replace(l, '^\\s*([-•]|\\d+[.)])\\s*', ''), ' ' || chr(9) || chr(13))), lambda x: x <> ''), 1, {most}) AS items, rest
        FROM (SELECT answer_id, rest, CASE WHEN stop = '' THEN rest ELSE left(rest, strpos(rest, stop) - 1) END AS part FROM (
            SELECT *, regexp_extract(rest, '\\n{letters}[A-ZÕÄÖÜa-zõäöü\\s]+:') AS stop FROM (
                SELECT answer_id, substr(answer, strpos(answer, head) + length(head)) AS rest FROM (SELECT answer_id, answer, regexp_extract(answer, '(?i)(^|\\n){name}\\s*:\\s*') AS head FROM a) WHERE head <> '')))"""


@query(f"""
    WITH a AS (
        SELECT doc_id AS answer_id, 'kokkuvõte: ' || x || chr(10) || '1) ' || y || chr(10) || chr(10) || 'Soovitused :' || chr(10) || '- ' || y || chr(10) || '  • ' || x || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'MUU OSA: ' ELSE '' END || y || chr(10) || '3. ' || x AS answer
        FROM (SELECT doc_id, replace(substr(text, 1, 40), ':', ' ') AS x, replace(substr(text, 41, 60), ':', ' ') AS y FROM documents WHERE length(text) >= 120)
    ), s AS ({section_sql('KOKKUVÕTE', 2)} UNION ALL {section_sql('SOOVITUSED', 3)})
    SELECT answer_id, heading, CAST(k AS INT) AS item_no, items[k] AS item, TRUE AS there FROM (SELECT *, unnest(generate_series(1, len(items))) AS k FROM s)""")
def answer_sections(spark, sf_dir):
    """Answers with two known headings and another one, made of documents' beginnings; there: the item stands at its place."""
    docs = table(spark, sf_dir, "documents").filter(F.length("text") >= 120)
    x, y = (F.replace(F.substring("text", F.lit(a), F.lit(n)), F.lit(":"), F.lit(" ")) for a, n in ((1, 40), (41, 60)))
    lit = F.lit
    answer = F.concat(lit("kokkuvõte: "), x, lit("\n1) "), y, lit("\n\nSoovitused :\n- "), y, lit("\n  • "), x, lit("\n"), F.when(F.col("doc_id") % 2 == 0, "MUU OSA: ").otherwise(""), y, lit("\n3. "), x)
    answers = docs.select(F.col("doc_id").alias("answer_id"), answer.alias("answer"))
    found = mn.sections(answers, HEADINGS).join(answers, "answer_id")
    there = F.substring("answer", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("item")
    return found.select("answer_id", "heading", "item_no", "item", there.alias("there"))


@query("""
    WITH r AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS a, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 400 AS INT) END AS b, o_orderkey % 7 <> 0 OR o_orderkey % 14 = 0 AS whole FROM orders),
    q AS (SELECT l_orderkey * 10 + l_linenumber AS request, o_custkey, CAST(l_shipdate AS DATE) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    m AS (SELECT request, min(o_orderkey) AS act, count(DISTINCT o_orderkey) AS n FROM q JOIN r USING (o_custkey) WHERE whole AND d >= a AND d < coalesce(b, DATE '9999-01-01') GROUP BY request),
    k AS (SELECT o_custkey, min(CASE WHEN whole THEN a END) AS first, bool_or(NOT whole) AS holes FROM r GROUP BY o_custkey)
    SELECT request, CASE WHEN n = 1 THEN act END AS act_id, coalesce(n, 0) AS n_acts,
           CASE WHEN n > 1 THEN 'several acts' WHEN n = 1 THEN NULL WHEN first IS NULL OR holes THEN 'incomplete interval' WHEN d < first THEN 'not yet in force' ELSE 'no longer in force' END AS reason
    FROM q LEFT JOIN m USING (request) LEFT JOIN k USING (o_custkey)""")
def current_revision(spark, sf_dir):
    """Orders as revisions of their customer's act, shipping days as requests; every seventh end is missing, half of these are open."""
    orders = table(spark, sf_dir, "orders")
    key, start = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    title = F.concat(F.lit("Act "), F.col("o_custkey").cast("string")).alias("title")
    revisions = orders.select(key.alias("act_id"), title, start.alias("valid_from"), F.when(key % 7 != 0, F.date_add(start, (key % 400).cast("int"))).alias("valid_to"), (key % 14 == 0).alias("open"))
    lines = table(spark, sf_dir, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    requests = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request"), title, F.col("l_shipdate").cast("date").alias("as_of"))
    return rv.resolve(requests, revisions, F.lit("2100-01-01").cast("date"))


SITE = "https://acts.example"
#: A file's hash stands for all of a source's documents.
CHAIN = f"""
    s AS (SELECT source, sha256('file ' || source) AS x FROM documents WHERE source IS NOT NULL GROUP BY source),
    v AS (
        SELECT source, CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS act_id, x,
               sha256('{{"act_id":"' || CAST(regexp_extract(source, '[0-9]+') AS BIGINT) || '","act_type":"seadus","authority_class":"binding_national_law","issuer":"i","publication_series":"RT I","source_id":"RT_NATIONAL_LAW","title":"Act ' || source || '","valid_from":"2020-01-01","valid_to":null,"version":"revision-1","xml_sha256":"' || x || '"}}') AS rh FROM s
    ),
    d AS (SELECT doc_id, doc_id % 8 AS k, text, act_id, x, rh, sha256(text) AS ch FROM documents JOIN v USING (source) WHERE trim(coalesce(text, ''), ' ') <> ''),
    h AS (SELECT *, sha256('{{"act_id":"' || act_id || '","content_sha256":"' || ch || '","revision_sha256":"' || rh || '","section":"' || doc_id || '","version":"section-1"}}') AS sh FROM d)"""


@query(f"""
    WITH {CHAIN}
    SELECT doc_id, CASE WHEN k = 6 THEN sha256(sh) ELSE sh END AS section_sha256,
           CASE k WHEN 1 THEN 'content hash' WHEN 2 THEN 'section hash' WHEN 3 THEN 'wrong section url' WHEN 4 THEN 'future date' WHEN 5 THEN 'authority disagrees' WHEN 6 THEN 'section hash' WHEN 7 THEN 'unknown revision' END AS reason
    FROM h""")
def section_chain(spark, sf_dir):
    """Documents as sections of their source's act, retrieved with hashes and admitted again; seven of eight records are spoilt in one respect."""
    docs = table(spark, sf_dir, "documents").filter(F.trim(t.text("text")) != "").filter("source is not null")
    number = F.regexp_extract("source", "[0-9]+", 0).cast("long").alias("act_id")
    lit = F.lit
    acts = docs.select("source", number).distinct()
    files = acts.select("act_id", F.encode(F.concat(lit("file "), "source"), "UTF-8").alias("content"))
    metadata = acts.select(
        "act_id", F.concat(lit("Act "), "source").alias("title"), lit("RT_NATIONAL_LAW").alias("source_id"), lit("binding_national_law").alias("authority_class"), lit("i").alias("issuer"), lit("seadus").alias("act_type"),
        lit("2020-01-01").cast("date").alias("valid_from"), lit(None).cast("date").alias("valid_to"), lit("RT I").alias("publication_series"),
    )
    revisions = rv.files_to_revisions(files, metadata)
    sections = docs.select(number, F.col("doc_id").cast("string").alias("section"), lit("").alias("heading"), "text")
    requests = sections.select("act_id", lit("").alias("domain"), F.concat(lit("§ "), "section", lit(".")).alias("section"), lit("2024-01-01").alias("as_of"))
    records = rv.retrieve(requests, revisions, sections, SITE).withColumn("doc_id", F.col("section").cast("long"))
    is_ = lambda k: F.col("doc_id") % 8 == k
    spoilt = records.withColumns({
        "text": F.when(is_(1), F.concat("text", lit("!"))).otherwise(F.col("text")), "revision_sha256": F.when(is_(2), F.sha2("revision_sha256", 256)).otherwise(F.col("revision_sha256")),
        "url": F.when(is_(3), F.concat("url", lit("x"))).otherwise(F.col("url")), "as_of_date": F.when(is_(4), lit("2999-01-01").cast("date")).otherwise(F.col("as_of_date")),
        "authority_class": F.when(is_(5), "binding_local_law").otherwise(F.col("authority_class")), "section_sha256": F.when(is_(6), F.sha2("section_sha256", 256)).otherwise(F.col("section_sha256")),
    })
    checked = rv.admit(spoilt.filter(~is_(7)), revisions, SITE).unionByName(rv.admit(spoilt.filter(is_(7)), revisions.limit(0), SITE))
    return checked.select("doc_id", "section_sha256", "reason")


#: Rules over the items' own words.
ITEM_RULES = [
    (1, "what", "ask", None, [], True, "general   what", "intent:ask", False), (2, "what", "tell", None, [], True, "second what", "intent:tell", False), (3, "when", "tell", None, [], True, "general when", "intent:tell", False),
    (4, "when", None, "english", [["the "], ["of ", "to "]], False, "english when", "english:of", True), (5, "what", "ask", "latin", [], False, "latin what", "latin:ask", True), (6, "what", None, "latin", [["que"]], False, "latin que", "latin:que", True),
    (7, "form", None, "long", [], False, "form of long ones", "long", False),
]
ITEM_KINDS = {"what": "say what", "when": "say when", "form": "say how"}
ITEM_MARKS = {"latin": ["ción", " la "]}


def rules_sql() -> str:
    text = lambda x: "NULL" if x is None else f"'{x}'"
    return ", ".join(f"({p}, '{kind}', {text(intent)}, {text(flag)}, CAST({words} AS VARCHAR[][]), {scoped}, '{query}', '{reason}', {replaces})" for p, kind, intent, flag, words, scoped, query, reason, replaces in ITEM_RULES)


@query(f"""
    WITH r(place, kind, intent, flag, words, scoped, query, reason, replaces) AS (VALUES {rules_sql()}),
    q AS (
        SELECT item_id AS request, lower(coalesce(text, '')) AS c, text, list_filter([CASE WHEN item_id % 2 = 0 THEN 'ask' END, CASE WHEN item_id % 3 = 0 THEN 'tell' END], lambda x: x IS NOT NULL) AS intents,
               list_filter([CASE WHEN contains(lower(text), 'the ') THEN 'english' END, CASE WHEN length(text) > 250 THEN 'long' END, CASE WHEN contains(lower(text), 'ción') OR contains(lower(text), ' la ') THEN 'latin' END], lambda x: x IS NOT NULL) AS flags FROM benchmark
    ),
    m AS (
        SELECT request, kind, trim(left(trim(regexp_replace(CASE WHEN scoped THEN CASE WHEN list_contains(flags, 'latin') THEN 'scope of latin' ELSE left(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), 500) END || ' ' || query ELSE query END, '[ \\t\\n\\r]+', ' ', 'g')), 300)) AS query, reason, replaces, place
        FROM q JOIN r ON (intent IS NULL OR list_contains(intents, intent)) AND (flag IS NULL OR list_contains(flags, flag)) AND len(list_filter(words, lambda g: len(list_filter(g, lambda w: contains(c, w))) = 0)) = 0
    )
    SELECT request, CAST(CASE kind WHEN 'what' THEN 1 WHEN 'when' THEN 2 ELSE 3 END AS INT) AS ord, kind, query, CASE kind WHEN 'what' THEN 'say what' WHEN 'when' THEN 'say when' ELSE 'say how' END AS requirement, reason
    FROM m QUALIFY row_number() OVER (PARTITION BY request, kind ORDER BY replaces DESC, CASE WHEN replaces THEN -place ELSE place END) = 1""")
def obligations(spark, sf_dir):
    """Obligations of items by rules over their words and intents that go with their ids."""
    text = F.lower(t.text("text"))
    given = lambda *pairs: F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in pairs)))
    requests = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("request"), F.col("text").alias("context"), F.col("text").alias("search_text"), given(("ask", F.col("item_id") % 2 == 0), ("tell", F.col("item_id") % 3 == 0)).alias("intents"),
        given(("english", text.contains("the ")), ("long", F.length("text") > 250)).alias("flags"),
    )
    return ob.plan(requests, ob.rules_table(spark, ITEM_RULES), ITEM_MARKS, ITEM_KINDS, {"latin": "scope of latin"}, 300)
