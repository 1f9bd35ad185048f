"""Provenance: digests of canonical JSON, case-law records, source registries, binding acts, vector indexes, claim status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.corpus import CorpusError, fingerprint

# The fields that a case-law record's hash covers.
CASE_FIELDS = ["source_kind", "id", "court_name", "case_number", "decision_date", "decision_type", "court_level", "canonical_url", "text"]
# Authority classes that may support each class of claim.
POLICY = {
    "binding_rule": ["binding_national_law", "binding_local_law", "binding_eu_law"],
    "court_holding": ["judicial_decision"],
    "legislative_history": ["legislative_history"],
    "draft_legislation": ["draft_legislation"],
    "official_notice": ["official_notice"],
    "institutional_interpretation": ["institutional_interpretation"],
    "regulator_guidance": ["regulator_guidance"],
    "secondary_analysis": ["secondary_analysis"],
}
HOST = r"^(?!\.)(?!.*\.\.)[a-z0-9.-]+$"


def json_string(c: Column) -> Column:
    """A string as compact JSON with non-ASCII characters as they are: what to_json gives."""
    wrapped = F.to_json(F.struct(F.coalesce(c.cast("string"), F.lit("")).alias("v")), {"ignoreNullFields": "false"})
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def canonical_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 of the JSON object of string fields with sorted keys and compact separators."""
    parts = [F.concat(F.lit(f'"{name}":'), json_string(value)) for name, value in sorted(fields.items())]
    return F.sha2(F.encode(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), "UTF-8"), 256)


def https_url(url: Column, hosts: Column | None = None) -> Column:
    """https with a host, without credentials; and a host of the given ones."""
    u = F.trim(t.text(url))
    ok = (F.try_parse_url(u, F.lit("PROTOCOL")) == "https") & F.try_parse_url(u, F.lit("HOST")).isNotNull() & F.try_parse_url(u, F.lit("USERINFO")).isNull()
    if hosts is not None:
        ok &= F.array_contains(hosts, F.lower(F.try_parse_url(u, F.lit("HOST"))))
    return F.coalesce(ok, F.lit(False))


def verify_case_law(records: DataFrame) -> DataFrame:
    """Adds verified: kind, id, nine filled fields, ISO date, https URL, 24 characters of text and a matching hash. A repeated id rejects all rows."""
    value = {c: F.trim(t.text(c)) for c in [*CASE_FIELDS, "record_sha256"]}
    exact = value | {"id": F.upper(value["id"]), "source_kind": F.lit("case_law")}
    filled = F.lit(True)
    for c in CASE_FIELDS[2:]:
        filled &= value[c] != ""
    ok = (
        filled & (F.lower(value["source_kind"]) == "case_law") & exact["id"].rlike(r"^CASE_[A-Z0-9][A-Z0-9_-]{2,120}$") & value["decision_date"].rlike(r"^\d{4}-\d{2}-\d{2}$")
        & F.try_to_date(value["decision_date"], "yyyy-MM-dd").isNotNull() & https_url(F.col("canonical_url")) & (F.length(value["text"]) >= 24)
        & (F.lower(value["record_sha256"]) == canonical_digest({c: exact[c] for c in CASE_FIELDS}))
    )
    twice = records.groupBy(F.upper(F.trim(t.text("id"))).alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    return records.withColumn("verified", F.coalesce(ok, F.lit(False)) & F.lit(not twice))


def case_id(number: Column, day: Column, kind: Column) -> Column:
    """CASE_ and the slug of the three; beyond 125 characters a prefix and twelve digits of the hash."""
    base = F.upper(F.concat_ws("_", number, day, kind))
    plain = F.regexp_replace(F.regexp_replace(base, "[^A-Z0-9-]+", "_"), "^_+|_+$", "")
    short = F.concat(F.lit("CASE_"), F.regexp_replace(F.left(plain, F.lit(107)), "_+$", ""), F.lit("_"), F.upper(F.left(F.sha2(F.encode(base, "UTF-8"), 256), F.lit(12))))
    return F.when(F.length(plain) <= 120, F.concat(F.lit("CASE_"), plain)).otherwise(short)


def registry_violations(sources: DataFrame) -> DataFrame:
    """id, rule of each broken rule of a source registry. sources: id, five text fields, canonical_hosts, allowed_claim_classes."""
    allowed = F.create_map(*(x for k, v in POLICY.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    every = sorted({a for v in POLICY.values() for a in v})
    hosts, classes = (F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("canonical_hosts", "allowed_claim_classes"))
    fits = lambda c: F.coalesce(F.array_contains(allowed[c], F.col("authority_class")), F.lit(False))
    rules = {
        "id": ~t.text("id").rlike("^[A-Z][A-Z0-9_]+$"),
        **{f"missing_{c}": F.trim(t.text(c)) == "" for c in ("display_name", "source_group", "authority_class", "source_kind", "jurisdiction")},
        "authority": ~t.text("authority_class").isin(every),
        "hosts": (F.size(hosts) == 0) | F.exists(hosts, lambda h: ~F.lower(h).rlike(HOST)) | (F.size(F.array_distinct(hosts)) < F.size(hosts)),
        "claims": (F.size(classes) == 0) | F.exists(classes, lambda c: ~fits(c)) | (F.size(F.array_distinct(classes)) < F.size(classes)),
    }
    each = sources.select("id", F.explode(F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())))).alias("rule"))
    twice = sources.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit("duplicate_id").alias("rule"))
    return each.unionByName(twice)


def supported_claims(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims (source_id, claim_class, url) whose source may support the class and owns the URL's host."""
    known = sources.select(F.upper(F.trim("id")).alias("source_key"), "canonical_hosts", "allowed_claim_classes")
    joined = claims.withColumn("source_key", F.upper(F.trim(t.text("source_id")))).join(known, "source_key")
    return joined.filter(F.array_contains("allowed_claim_classes", F.trim(t.text("claim_class"))) & https_url(F.col("url"), F.col("canonical_hosts"))).select(*claims.columns)


def binding_class(series: Column, act_type: Column) -> Column:
    """struct(source_id, authority) of a binding act, or null: exactly one act type as a whole word, in a series that binds."""
    x = F.lower(t.text(act_type))
    word = lambda w: x.rlike(rf"(?U)(?<!\w){w}(?!\w)")
    law, decree = word("seadus"), word("määrus")
    s = F.upper(F.trim(t.text(series)))
    named = lambda a, b: F.struct(F.lit(a).alias("source_id"), F.lit(b).alias("authority"))
    return F.when((s == "RT I") & (law != decree), named("RT_NATIONAL_LAW", "binding_national_law")).when((s == "RT IV") & decree & ~law, named("RT_LOCAL_LAW", "binding_local_law"))


def status(fallback: Column, statuses: Column, kinds: Column, evidence_valid: Column) -> Column:
    """Status of an answer from those of its claims; the first that applies."""
    verified = evidence_valid & (F.size(statuses) > 0) & F.forall(statuses, lambda s: s == "EVIDENCE_VERIFIED")
    return (
        F.when(fallback, "SOURCE_ONLY_FALLBACK").when(F.array_contains(statuses, "OCR_REVIEW_REQUIRED"), "OCR_REVIEW_REQUIRED").when(F.array_contains(kinds, "inference"), "INPUTS_VERIFIED")
        .when(verified, "EVIDENCE_VERIFIED").otherwise("CITATIONS_VERIFIED")
    )


def similar_questions(a: Column, b: Column) -> Column:
    """Equal when folded, or two shared terms that are 0.64 of the smaller set."""
    light = ["aga", "ega", "et", "ja", "kas", "kes", "kui", "mida", "milline", "millised", "mis", "ning", "on", "oli", "oled", "sa", "see", "sinu", "või"]
    terms = lambda c: F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(t.text(c)), F.lit("[a-zõäöüšž]{3,}"), F.lit(0))), F.array(*map(F.lit, light)))
    x, y = terms(a), terms(b)
    shared, least = F.size(F.array_intersect(x, y)), F.least(F.size(x), F.size(y))
    return (t.casefold(a) == t.casefold(b)) | ((shared >= 2) & (shared >= 0.64 * least))


def grounded_items(items: Column, original: Column, most: int) -> Column:
    """Of the first `most` items (structs with evidence and value), those whose evidence stands in the original and whose value is not empty."""
    whole = t.casefold(original)
    return F.filter(F.slice(items, 1, most), lambda i: (F.length(F.trim(t.text(i["evidence"]))) >= 2) & whole.contains(t.casefold(F.left(i["evidence"], F.lit(320)))) & (F.trim(t.text(i["value"])) != ""))


def write_index(vectors: DataFrame, corpus: DataFrame, path: str, model: str, dimension: int) -> None:
    """Vectors (id, content_hash, vector) with a one-row manifest, written last."""
    bad = vectors.filter((F.size("vector") != dimension) | F.exists("vector", lambda x: x.isNull() | F.isnan(x))).limit(1).count()
    if bad:
        raise CorpusError(f"a vector is not finite or has not {dimension} elements")
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    rows = vectors.sparkSession.read.parquet(f"{path}/vectors").count()
    manifest = fingerprint(corpus).select("fingerprint", F.lit(model).alias("model"), F.lit(dimension).alias("dimension"), F.lit(rows).cast("long").alias("row_count"))
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")


def open_index(corpus: DataFrame, path: str, model: str) -> DataFrame:
    """The vectors, if the manifest has this corpus, model and row count; else CorpusError."""
    spark = corpus.sparkSession
    manifest, vectors = spark.read.parquet(f"{path}/manifest").first(), spark.read.parquet(f"{path}/vectors")
    now = fingerprint(corpus).first()
    wrong = [name for name, ok in (("corpus", manifest["fingerprint"] == now["fingerprint"]), ("model", manifest["model"] == model), ("rows", manifest["row_count"] == now["n_docs"] == vectors.count())) if not ok]
    if wrong:
        raise CorpusError(f"the index doesn't fit: {', '.join(wrong)}")
    return vectors
