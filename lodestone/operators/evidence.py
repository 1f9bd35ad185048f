"""Evidence of claims with positions: where a quote stands in its source, and whether kind, status, sources and positions agree.

Sources are statutes, court decisions and spans of documents. Only those that some claim names are joined with their texts. One
bad claim rejects the whole answer; `reason` says what was wrong, first things first.

A quote may differ from its source in letter case and white space. `located` still gives its place in the raw text, as the
quote is turned into a pattern that takes any white space where the quote has some.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t

# What a claim of each kind must rest on, its statuses, and wording that a claim about court decisions may not have.
KINDS = {
    "law": (["law"], ["EVIDENCE_VERIFIED", "CITATION_VERIFIED"]),
    "case_law": (["case_law"], ["CASE_LAW_EVIDENCE_VERIFIED"]),
    "inference": (["document", "law"], ["INPUTS_VERIFIED"]),
    "document_excerpt": (["document"], ["DOCUMENT_TEXT_VERIFIED"]),
}
OCR_STATUS = "OCR_REVIEW_REQUIRED"
PRECEDENT = r"(?iu)(?:siduv|kohustuslik)\s+(?:kohtu)?pretsedent|pretsedent\s+on\s+(?:õiguslikult\s+)?siduv"
LEAST_CASE = 24


def quote_pattern(quote: Column) -> Column:
    """A pattern for the quote in any letter case and with any white space where it has some."""
    kept = F.replace(F.trim(F.regexp_replace(t.text(quote), r"(?U)^\s+|\s+$", "")), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("(?iuU)\\Q"), F.regexp_replace(kept, r"(?U)\s+", r"\\E\\s+\\Q"), F.lit("\\E"))


def located(text: Column, quote: Column) -> Column:
    """struct(start, end) in the raw text of the first place where the quote stands: literally, or else but for case and white space. Null if nowhere, and for an empty quote."""
    raw = F.regexp_replace(t.text(quote), r"(?U)^\s+|\s+$", "")
    literal = F.instr(t.text(text), raw)
    near = F.regexp_instr(t.text(text), quote_pattern(quote))
    length = F.length(F.regexp_substr(t.text(text), quote_pattern(quote)))
    at = lambda start, size: F.struct((start - 1).cast("int").alias("start"), (start - 1 + size).cast("int").alias("end"))
    return F.when(F.length(raw) == 0, F.lit(None)).when(literal > 0, at(literal, F.length(raw))).when(near > 0, at(near, length))


def _references(wanted: DataFrame, laws: DataFrame, spans: DataFrame, cases: DataFrame) -> DataFrame:
    """kind, key, text, page, first, method of the sources that are wanted; of those with one id the greatest text."""
    none = lambda kind: F.lit(None).cast(kind)
    key = lambda c: t.record_id(c, dash=True)
    rows = laws.select(F.lit("law").alias("kind"), key("id").alias("key"), "text", none("int").alias("page"), none("int").alias("first"), none("string").alias("method"))
    rows = rows.unionByName(cases.select(F.lit("case_law").alias("kind"), key("id").alias("key"), "text", none("int").alias("page"), none("int").alias("first"), none("string").alias("method")))
    rows = rows.unionByName(spans.select(F.lit("document").alias("kind"), key("span_id").alias("key"), "text", F.col("page").cast("int").alias("page"), F.col("start").cast("int").alias("first"), F.coalesce("method", F.lit("text")).alias("method")))
    own = rows.join(wanted.select("kind", "key").distinct(), ["kind", "key"], "left_semi")
    return own.withColumn("k", F.row_number().over(Window.partitionBy("kind", "key").orderBy(F.col("text").desc()))).filter("k = 1").drop("k")


def check_sources(sources: DataFrame, laws: DataFrame, spans: DataFrame, cases: DataFrame) -> DataFrame:
    """sources with page, start, end and method as found, and reason (null where all is right).

    sources: answer_id, claim_id, seq, kind, id, evidence, page, start, end; laws: id, text; spans: span_id, text, page, start,
    method; cases: id, text. A document's quote has to stand there literally; positions that are supplied have to be right.
    """
    asked = sources.withColumns({"kind": F.lower(F.trim(t.text("kind"))), "key": t.record_id("id", dash=True)})
    met = asked.withColumnsRenamed({"page": "said_page", "start": "said_start", "end": "said_end"}).join(_references(asked, laws, spans, cases), ["kind", "key"], "left")
    raw = F.regexp_replace(t.text("evidence"), r"(?U)^\s+|\s+$", "")
    quote = t.casefold("evidence")
    there = t.casefold("text").contains(quote)
    literal = F.instr(t.text("text"), raw)
    start = F.coalesce("first", F.lit(0)) + literal - 1
    found = met.withColumns({"start": F.when((F.col("kind") == "document") & (literal > 0), start), "end": F.when((F.col("kind") == "document") & (literal > 0), start + F.length(raw))})
    other = lambda said, is_: F.col(said).isNotNull() & ~F.col(said).eqNullSafe(F.col(is_))
    is_document = F.col("kind") == "document"
    reason = (
        F.when(quote == "", "no evidence").when(~F.col("kind").isin("law", "case_law", "document"), "unknown kind").when(F.col("text").isNull(), "unknown source")
        .when((F.col("kind") == "case_law") & (F.length(raw) < LEAST_CASE), "short quote").when((F.col("kind") == "case_law") & (literal == 0), "not quoted")
        .when((F.col("kind") != "case_law") & ~there, "not quoted").when(is_document & (literal == 0), "not literal")
        .when(is_document & other("said_page", "page"), "wrong page").when(is_document & other("said_start", "start"), "wrong start").when(is_document & other("said_end", "end"), "wrong end")
    )
    return found.withColumn("reason", reason).select("answer_id", "claim_id", "seq", "kind", "id", "evidence", "page", "start", "end", "method", "reason")


def check_claims(claims: DataFrame, checked: DataFrame) -> DataFrame:
    """answer_id, claim_id, reason: of a claim without sources, with a bad one, or whose kind, status and sources don't agree. claims: answer_id, claim_id, kind, text, status."""
    own = checked.groupBy("answer_id", "claim_id").agg(
        F.min(F.when(F.col("reason").isNotNull(), F.struct("seq", "reason"))).alias("bad"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.bool_or(F.col("method") == "ocr").alias("ocr"),
    )
    met = claims.withColumns({"kind": F.lower(F.trim(t.text("kind"))), "status": F.upper(F.trim(t.text("status")))}).join(own, ["answer_id", "claim_id"], "left")
    fits = F.lit(False)
    for kind, (needs, statuses) in KINDS.items():
        status = F.col("status").isin(statuses)
        if kind == "document_excerpt":
            status = F.col("status") == F.when(F.coalesce("ocr", F.lit(False)), OCR_STATUS).otherwise(statuses[0])
        right = (F.col("kind") == kind) & status & F.col("kinds").eqNullSafe(F.lit(needs).cast("array<string>"))
        fits |= right & ~t.text("text").rlike(PRECEDENT) if kind == "case_law" else right
    reason = F.when(F.trim(t.text("text")) == "", "no text").when(F.col("kinds").isNull(), "no sources").when(F.col("bad").isNotNull(), F.col("bad.reason")).when(~fits, "kind and sources disagree")
    return met.select("answer_id", "claim_id", reason.alias("reason"))


def verify(claims: DataFrame, sources: DataFrame, laws: DataFrame, spans: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """answer_id, accepted, reason, claim_id (of the first bad claim); and the checked sources.

    cases: id, text, verified (see provenance.verify_case_law): a single record that is not verified rejects all answers.
    """
    bad_cases = cases.filter(~F.col("verified")).limit(1).count() > 0
    checked = check_sources(sources, laws, spans, cases)
    each = check_claims(claims, checked)
    first = F.min(F.when(F.col("reason").isNotNull(), F.struct("claim_id", "reason"))).alias("bad")
    out = each.groupBy("answer_id").agg(first)
    if bad_cases:
        return out.select("answer_id", F.lit(False).alias("accepted"), F.lit("case law is not verified").alias("reason"), F.lit(None).cast("long").alias("claim_id")), checked
    return out.select("answer_id", F.col("bad").isNull().alias("accepted"), F.col("bad.reason").alias("reason"), F.col("bad.claim_id").cast("long").alias("claim_id")), checked
