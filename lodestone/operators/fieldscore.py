"""The whole lexical score and its legacy form: terms by field and rarity, phrases, ids, titles, aliases, keywords and hints.

A query comes with its interpretation. Its search terms are its own content tokens, those of its expansions, and exact
synonyms of both; the legacy score takes all tokens and the expansions unsplit. Scores are decimals, so that sums don't
depend on order. A document takes part if a term of the query is one of its tokens, a beginning of one, or in its aliases,
or if its id is in the query.

Term postings are pruned by the queries' terms before they are shuffled, phrases are found by positions and ids, titles,
aliases and keywords by their beginnings (see phrases); documents themselves are never shuffled.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..sources.staging import written
from . import index as ix
from .interpret import Interpretation
from .lexical import BODY, BODY_STEM, BOTH, HEADING, HEADING_STEM, IDF_CAP, PER_STEM, capped, hits
from .phrases import contained, occurrences
from .termrows import HELD, IN_BODY, MOST, NANO, Asked, TermRows, Vocabulary, factor_of, asked_pairs, field_sums, phrases_in, scaled, taking_part, term_counts, weights

# Points of the scores.
ID, TITLE, ALIAS, PHRASE_HEADING, PHRASE_BODY, KEYWORD, CURATED, HINTED = 15, 8, 6, 30, 14, 4, 18, 2
#: Phrases that are looked for in each text; more are found by positions.
SCANNED = 500


def with_synonyms(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """query_id, term: with the words related to a term that equals their base. synonyms: (base, related)."""
    more = terms.join(synonyms, F.col("term") == F.col("base")).select("query_id", F.col("related").alias("term"))
    return terms.unionByName(more).distinct()


class Scored:
    """Scores of a batch of queries over a corpus.

    corpus: doc_id, id, title, aliases, text, domain. queries: query_id, text. keywords: domain, keyword. synonyms: base, related.
    What several scores read is written once (see staging).
    """

    def __init__(self, corpus: DataFrame, queries: DataFrame, found: Interpretation, synonyms: DataFrame, keywords: DataFrame):
        self.corpus, self.found, self.keywords = corpus, found, keywords
        self.queries = queries.select("query_id", t.fold("text").alias("f"), "text")
        expanded = found.expanded.select("query_id", "term")
        own = self.queries.select("query_id", F.explode(t.content_tokens("text")).alias("term"))
        self.terms = written(with_synonyms(own.unionByName(expanded.select("query_id", F.explode(t.content_tokens("term")).alias("term"))).distinct(), synonyms), "terms")
        raw = self.queries.select("query_id", F.explode(t.tokens("text")).alias("term"))
        self.legacy_terms = written(with_synonyms(raw.unionByName(expanded).distinct(), synonyms), "legacy-terms")
        both = self.terms.unionByName(self.legacy_terms)
        body = t.content_tokens(F.concat(t.text("title"), F.lit(" "), t.text("text")))
        heading = t.content_tokens(t.section_heading("text"))
        self.both, self.body, self.heading = both, body, heading
        self._meet()

    @cached_property
    def starts(self) -> DataFrame:
        return written(ix.by_start(ix.postings(self.corpus, asked=self.both.select("term").distinct(), body=self.body, heading=self.heading)), "postings")

    @cached_property
    def sizes(self) -> tuple[int, float]:
        """Documents, and tokens of one."""
        stats = self.corpus.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(self.body)).alias("average")).first()
        return max(1, stats["n"]), max(1.0, stats["average"] or 0.0)

    @cached_property
    def lengths(self) -> DataFrame:
        return self.corpus.select("doc_id", F.size(self.body).alias("length"))

    @cached_property
    def candidates(self) -> DataFrame:
        by_alias = self.both.distinct().join(self.alias_terms, "term").select("query_id", "doc_id")
        by_term = hits(self.both.distinct(), self.starts).filter(F.col("eb") | F.col("pb")).select("query_id", "doc_id")
        return written(by_term.unionByName(by_alias).unionByName(self.points.filter("named = 1").select("query_id", "doc_id")).distinct(), "candidates")

    def _meet(self) -> None:
        """Which ids, titles, aliases and keywords are in which queries."""
        names = self.corpus.select(
            "doc_id", "domain", F.lower("id").alias("id"), t.fold("id").alias("folded_id"), t.fold("title").alias("title"), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), t.fold).alias("aliases"),
        )
        strings = names.select(F.explode(F.concat(F.array("id", "folded_id", "title"), "aliases")).alias("s")).unionByName(self.keywords.select(F.col("keyword").alias("s")))
        inside = written(contained(self.queries, strings), "inside")
        there = inside.withColumnRenamed("s", "x")
        of = lambda column: names.select("doc_id", F.col(column).alias("x")).join(there, "x").select("query_id", "doc_id")
        aliases = names.select("doc_id", F.posexplode("aliases").alias("k", "x")).join(there, "x")
        points = [of("id").withColumn("id", F.lit(1)), of("title").withColumn("title", F.lit(1)), aliases.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).cast("int").alias("alias")), of("folded_id").withColumn("named", F.lit(1))]
        kinds = ["id", "title", "alias", "named"]
        rows = None
        for part in points:
            part = part.select("query_id", "doc_id", *(F.col(k) if k in part.columns else F.lit(0).alias(k) for k in kinds))
            rows = part if rows is None else rows.unionByName(part)
        self.points = written(rows.groupBy("query_id", "doc_id").agg(*(F.max(k).alias(k) for k in kinds)), "points")
        self.alias_terms = names.select("doc_id", F.explode("aliases").alias("a")).select("doc_id", F.explode(t.content_tokens("a")).alias("term")).distinct()
        self.domains = names.select("doc_id", "domain")
        self.spoken = inside

    def _bonus(self, terms: DataFrame) -> DataFrame:
        """query_id, domain, keyword, hint: points of a domain for a query."""
        asked = self.queries.select("query_id")
        said = self.keywords.join(self.spoken.withColumnRenamed("s", "keyword"), "keyword").select("query_id", "domain")
        named = self.keywords.join(terms.withColumnRenamed("term", "keyword"), "keyword").select("query_id", "domain")
        words = said.unionByName(named).distinct().withColumn("keyword", F.lit(KEYWORD)).withColumn("hint", F.lit(0))
        hints = self.found.domains.join(asked, "query_id", "left_semi").select("query_id", "domain", F.lit(0).alias("keyword"), F.when(F.col("curated"), CURATED).otherwise(HINTED).alias("hint"))
        return words.unionByName(hints).groupBy("query_id", "domain").agg(F.max("keyword").alias("keyword"), F.max("hint").alias("hint"))

    def _finish(self, scores: DataFrame, terms: DataFrame) -> DataFrame:
        """query_id, doc_id, score of scores (query_id, doc_id, base, ...) with the domains' points; hints count where there is a score."""
        bonus = scores.join(self.domains, "doc_id").join(self._bonus(terms), ["query_id", "domain"], "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        said = bonus.withColumn("s", F.col("base") + zero("keyword"))
        return said.withColumn("score", (F.col("s") + F.when(F.col("s") > 0, zero("hint")).otherwise(0)).cast("decimal(18,6)")).drop("domain", "base", "s", "keyword", "hint")

    def _named(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.points, ["query_id", "doc_id"], "left").na.fill(0, ["id", "title", "alias"])

    def phrases(self) -> DataFrame:
        """query_id, doc_id, points of the expansions of several words that documents have."""
        asked = self.found.expanded.select("query_id", t.fold("term").alias("phrase")).filter(F.col("phrase").contains(" ")).distinct()
        names = written(asked.select("phrase").distinct(), "phrases")
        known = [r["phrase"] for r in names.limit(SCANNED + 1).collect()]
        if len(known) <= SCANNED:
            closed = lambda c: F.concat(F.lower(c), F.lit(" "))
            texts = self.corpus.select("doc_id", closed(t.text("text")).alias("body"), closed(t.section_heading("text")).alias("heading"))
            schema = T.StructType([texts.schema["doc_id"], T.StructField("phrase", T.StringType()), T.StructField("in_heading", T.BooleanType())])
            found = texts.mapInArrow(phrases_in(self.corpus.sparkSession.sparkContext.broadcast(sorted(known))), schema)
            rows = found.withColumn("points", F.when(F.col("in_heading"), PHRASE_HEADING).otherwise(PHRASE_BODY))
        else:
            words = self.corpus.select("doc_id", F.split(t.fold("text"), " ").alias("w"), F.split(t.fold(t.section_heading("text")), " ").alias("h"))
            body, heading = occurrences(words, "w", names), occurrences(words, "h", names)
            rows = body.withColumn("points", F.lit(PHRASE_BODY)).unionByName(heading.withColumn("points", F.lit(PHRASE_HEADING)))
        where = rows.groupBy("doc_id", "phrase").agg(F.max("points").alias("points"))
        return asked.join(where, "phrase").groupBy("query_id", "doc_id").agg(F.sum("points").cast("int").alias("phrase_points"))

    def full(self) -> DataFrame:
        """query_id, doc_id, score, matched."""
        words = self.starts.select(F.explode("words").alias("w")).filter("w.in_body").groupBy(F.col("w.term").alias("term")).agg(F.count(F.lit(1)).alias("df"))
        n, average = F.lit(self.sizes[0]), self.sizes[1]
        rare = self.terms.join(words.select("term", ix.idf(n, F.col("df")).alias("idf")), "term", "left").withColumn("start", t.stem_key(F.col("term")))
        shares = self.starts.filter("in_body").groupBy("start").agg(F.count(F.lit(1)).alias("df")).select("start", ix.idf(n, F.col("df")).alias("pidf"))
        rare = rare.join(shares, "start", "left").select("query_id", "term", "idf", "pidf")
        hit = hits(self.terms, self.starts).join(rare, ["query_id", "term"])
        zero = F.lit(0).cast(ix.SCORE)
        body = F.when(F.col("eb"), capped(BODY, F.col("idf"))).when(F.col("pb"), capped(BODY_STEM, F.col("pidf"))).otherwise(zero)
        heading = F.when(F.col("eh"), capped(HEADING, F.col("idf"))).when(F.col("ph"), capped(HEADING_STEM, F.col("pidf"))).otherwise(zero)
        stem = F.col("first_of_stem") & (F.length("term") >= 3) & (F.col("eb") | F.col("pb"))
        sums = hit.groupBy("query_id", "doc_id").agg(F.sum((body + heading).cast(ix.SCORE)).alias("raw"), F.count_if(stem).alias("matched"))
        rows = self._named(self.candidates.join(sums, ["query_id", "doc_id"], "left").join(self.phrases(), ["query_id", "doc_id"], "left")).join(self.lengths, "doc_id")
        factor = F.greatest(F.lit(0.65), F.least(F.lit(1.25), F.lit(1.1) / (F.lit(0.6) + F.lit(0.4) * F.col("length") / F.lit(average))))
        matched = F.coalesce("matched", F.lit(0))
        more = ID * F.col("id") + TITLE * F.col("title") + PER_STEM * matched + F.when(matched >= 2, BOTH).otherwise(0) + F.coalesce("phrase_points", F.lit(0))
        base = F.coalesce("raw", zero).cast("decimal(20,9)") + more.cast("decimal(10,0)")
        base = F.round(base.cast("decimal(22,9)") * F.round(factor, 9).cast("decimal(12,9)"), 6).cast("decimal(18,6)")
        return self._finish(rows.select("query_id", "doc_id", base.alias("base"), matched.alias("matched")), self.terms)

    def legacy(self) -> DataFrame:
        """query_id, doc_id, score."""
        hit = hits(self.legacy_terms, self.starts).groupBy("query_id", "doc_id").agg(F.count_if("eb").alias("exact"), F.count_if(F.col("pb") & ~F.col("eb")).alias("near"))
        rows = self._named(self.candidates.join(hit, ["query_id", "doc_id"], "left").na.fill(0, ["exact", "near"]))
        base = ID * F.col("id") + TITLE * F.col("title") + ALIAS * F.col("alias") + F.least(3 * F.col("exact"), F.lit(18)) + F.least(2 * F.col("near"), F.lit(12))
        return self._finish(rows.select("query_id", "doc_id", base.cast("decimal(18,6)").alias("base")), self.legacy_terms)

    @cached_property
    def rows(self) -> TermRows | None:
        """Term rows for both scores, or None if the batch is too large to broadcast."""
        pairs = asked_pairs(self.both)
        if pairs is None or self.queries.count() > MOST:
            return None
        alias = F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " ")
        return TermRows(self.corpus, pairs.column("term").to_pylist(), F.concat(t.text("title"), F.lit(" "), t.text("text")), t.section_heading("text"), True, alias)

    def best(self, k: int, least: int, legacy: bool = False) -> DataFrame:
        """Of full(), or of legacy(), rows from the score `least`, no fewer than the k best of each query. Documents are scored one by one (see termrows), so pairs are no rows."""
        terms = self.legacy_terms if legacy else self.terms
        ids = self.queries.select("query_id").distinct().limit(MOST + 1).toArrow().column("query_id").combine_chunks()
        bonus = self._bonus(terms).limit(HELD + 1).toArrow()
        domains = bonus.column("domain").combine_chunks().unique().drop_null()
        if self.rows is None or bonus.num_rows > HELD or len(ids) * max(len(domains), k) > HELD:
            return (self.legacy() if legacy else self.full().select("query_id", "doc_id", "score", "matched")).filter(F.col("score") >= least)
        r = self.rows
        both, own = (Asked(r.words, asked_pairs(x), ids) for x in (self.both, terms))
        added = np.zeros((2, len(ids), len(domains) + 1), np.int64)
        at = pc.index_in(bonus.column("query_id"), value_set=ids).to_numpy(), pc.index_in(bonus.column("domain"), value_set=domains).fill_null(len(domains)).to_numpy()
        for into, c in zip(added, ("keyword", "hint"), strict=True):
            into[at] = bonus.column(c).to_numpy()
        added[:, :, -1] = 0  # of documents without a domain
        weight = None if legacy else weights(r.words, r.idf, r.pidf, (BODY, BODY_STEM, HEADING, HEADING_STEM), IDF_CAP)
        points = self.points.select("query_id", "doc_id", *(F.col(c).cast("int").alias(c) for c in POINTS[:4]), F.lit(0).alias("phrase"))
        if not legacy:
            points = points.unionByName(self.phrases().select("query_id", "doc_id", *(F.lit(0).alias(c) for c in POINTS[:4]), F.col("phrase_points").alias("phrase")))
        points = points.groupBy("doc_id").agg(*(F.collect_list(c).alias(c) for c in ("query_id", *POINTS)))
        side = self.domains.dropDuplicates(["doc_id"]).join(points, "doc_id", "left")
        rows = written(r.rows.join(side, "doc_id"), "scored-rows")
        model = own, weight, r.average, domains, added
        return r.scores(both, self.queries.schema["query_id"].dataType, _points, model, least * 10**6, k, [] if legacy else ["matched"], rows)


#: What a query and a document have by points.
POINTS = ("id", "title", "alias", "named", "phrase")


def _points(words: Vocabulary, both: Asked, model: tuple, batch: pa.RecordBatch):
    """Scores of a batch of rows as full() has them, or legacy() where there are no weights."""
    own, weight, average, domains, (keyword, hint) = model
    n = len(both.ids)
    lists = batch.column("query_id")
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    at = np.repeat(np.arange(batch.num_rows), sizes) * n + pc.index_in(lists.flatten(), value_set=both.ids).to_numpy(zero_copy_only=False).astype(np.int64)
    given = {c: np.zeros(batch.num_rows * n, np.int64) for c in POINTS}
    for c, into in given.items():
        np.add.at(into, at, batch.column(c).flatten().to_numpy(zero_copy_only=False))
    cell = np.flatnonzero(taking_part(words, both, batch) | (given["named"] > 0))
    row, query = np.divmod(cell, max(n, 1))
    given = {c: x[cell] for c, x in given.items()}
    said = ID * given["id"] + TITLE * given["title"]
    if weight is None:
        exact, near = (x[cell] for x in term_counts(words, own, batch))
        base, more = (said + ALIAS * given["alias"] + np.minimum(3 * exact, 18) + np.minimum(2 * near, 12)) * 10**6, []
    else:
        raw, matched = (x[cell] for x in field_sums(words, own, weight, batch, IN_BODY))
        factor = np.array([factor_of(x, average) for x in batch.column("length").to_pylist()], np.int64)
        base = scaled(raw + (said + PER_STEM * matched + BOTH * (matched >= 2) + given["phrase"]) * NANO, factor[row])
        more = [matched]
    domain = pc.index_in(batch.column("domain"), value_set=domains).fill_null(len(domains)).to_numpy(zero_copy_only=False)[row]
    s = base + keyword[query, domain] * 10**6
    return row, query, s + np.where(s > 0, hint[query, domain], 0) * 10**6, *more
