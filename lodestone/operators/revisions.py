"""Revisions of acts: which one is in force on a day, and chains of hashes from a file to a revision to its sections.

Days and validity intervals meet in an equi-join, however many revisions a title has: an interval is put into the one or two
blocks of days that it touches at the level where a block is about as long as the interval, and a day is looked up once in each
level that occurs. Ends are exclusive; an open end holds.

A section's hash covers its text and the hash of its revision, and a revision's hash covers its metadata and the hash of its
file. A record is admitted only if every hash is what it covers, and if its revision is the one that the registry of
revisions has.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as t
from .provenance import json_string

#: A day after all others, as days since 1970.
NEVER = 1 << 22
#: Stretches that all days are divided into, and the kinds of rows that pass there.
STRETCHES = 8
TITLE, SPAN, REQUEST = 0, 1, 2
# The version marks that hashes cover, statuses, and authority classes by source.
REVISION_VERSION, SECTION_VERSION = "revision-1", "section-1"
STATUS, EVIDENCE = "BINDING_SECTION_VERIFIED", "rt_live_verified"
AUTHORITIES = {"RT_NATIONAL_LAW": "binding_national_law", "RT_LOCAL_LAW": "binding_local_law"}


def in_force(requests: DataFrame, revisions: DataFrame, keys: list[str], day: str, start: str, end: str) -> DataFrame:
    """Rows of requests joined with the rows of revisions of equal keys whose interval has the day. Intervals without start, or not longer than nothing, have none."""
    number = lambda c: F.unix_date(F.col(c).cast("date"))
    spans = revisions.withColumns({"__a": number(start), "__b": F.coalesce(number(end), F.lit(NEVER))}).filter("__b > __a")
    spans = spans.withColumn("__level", F.ceil(F.log2((F.col("__b") - F.col("__a")).cast("double"))).cast("int"))
    block = lambda c: F.call_function("shiftright", c, F.col("__level"))
    spans = spans.withColumn("__block", F.explode(F.array_distinct(F.array(block(F.col("__a")), block(F.col("__b") - 1)))))
    levels = sorted(r["__level"] for r in spans.select("__level").distinct().collect())  # at most 23
    asked = requests.withColumn("__day", number(day)).withColumn("__level", F.explode(F.lit(levels).cast("array<int>"))).withColumn("__block", block(F.col("__day")))
    met = asked.join(spans, [*keys, "__level", "__block"]).filter((F.col("__day") >= F.col("__a")) & (F.col("__day") < F.col("__b")))
    return met.drop("__day", "__level", "__block", "__a", "__b")


def _swept(asked: DataFrame, own: DataFrame) -> DataFrame:
    """asked (request, k, as_of) with acts, those in force on the day, and of all the title's revisions: first, the earliest day of a whole one, and holes, if one is not whole. own: act_id, k, valid_from, valid_to, whole.

    Requests are shuffled once, with the intervals, by title and by stretch of days: of all the days of the intervals there are
    STRETCHES, so that a title with very many revisions or requests is not one task's. There they pass in order of days.
    """
    number = lambda c: F.unix_date(F.col(c).cast("date"))
    spans = own.filter("whole").select("act_id", "k", number("valid_from").alias("day"), F.coalesce(number("valid_to"), F.lit(NEVER)).alias("until")).filter("until > day and act_id is not null")
    days = spans.agg(F.min("day").alias("low"), F.max(F.when(F.col("until") < NEVER, F.col("until")).otherwise(F.col("day") + 1)).alias("high")).first()
    low, high = (days["low"], days["high"]) if days["low"] is not None else (0, 1)
    length = -(-(high - low) // STRETCHES)
    # Days before all intervals are in the first stretch, days after them in the last one.
    place = lambda day: F.greatest(F.lit(0), F.least(F.lit(STRETCHES - 1), F.floor((day - low) / length))).cast("int")
    kinds = {c: own.schema[c].dataType for c in ("act_id", "k")} | {c: asked.schema[c].dataType for c in ("request", "as_of")}
    types = {"k": kinds["k"], "place": T.IntegerType(), "day": T.IntegerType(), "kind": T.IntegerType(), "act_id": kinds["act_id"], "until": T.IntegerType(), "holes": T.BooleanType(), "request": kinds["request"], "as_of": kinds["as_of"]}
    rows = lambda df, **more: df.select(*((more[c] if c in more else F.lit(None)).cast(kind).alias(c) for c, kind in types.items()))
    known = own.groupBy("k").agg(F.min(F.when(F.col("whole"), number("valid_from"))).alias("until"), F.bool_or(~F.col("whole")).alias("holes"))
    titles = rows(known.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(STRETCHES - 1)))), k=F.col("k"), place=F.col("place"), kind=F.lit(TITLE), until=F.col("until"), holes=F.col("holes"))
    spans = spans.withColumn("place", F.explode(F.sequence(place(F.col("day")), place(F.col("until") - 1))))
    spans = rows(spans, k=F.col("k"), place=F.col("place"), day=F.col("day"), kind=F.lit(SPAN), act_id=F.col("act_id"), until=F.col("until"))
    day = F.coalesce(number("as_of"), F.lit(low - 1))
    asks = rows(asked.withColumn("day", day), k=F.col("k"), place=place(F.col("day")), day=F.col("day"), kind=F.lit(REQUEST), request=F.col("request"), as_of=F.col("as_of"))
    tasks = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = titles.unionByName(spans).unionByName(asks).repartition(tasks, "k", "place").sortWithinPartitions("k", "place", F.col("day").asc_nulls_first(), "kind")
    schema = T.StructType([T.StructField("request", kinds["request"]), T.StructField("as_of", kinds["as_of"]), T.StructField("first", T.IntegerType()), T.StructField("holes", T.BooleanType()), T.StructField("acts", T.ArrayType(kinds["act_id"]))])
    return met.mapInArrow(_sweep, schema).withColumn("first", F.date_from_unix_date("first"))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of title, stretch and day, the requests with the acts whose interval holds their day."""
    group, title, live = None, (None, None), []
    for batch in batches:
        at, first, holes, acts = [], [], [], []
        columns = (batch.column(c).to_pylist() for c in ("k", "place", "day", "kind", "act_id", "until", "holes"))
        for i, (k, place, day, kind, act, until, hole) in enumerate(zip(*columns, strict=True)):
            if group != (k, place):
                group, title, live = (k, place), (None, None), []
            if kind == TITLE:
                title = until, hole
            elif kind == SPAN:
                heapq.heappush(live, (until, i, act))
            else:
                while live and live[0][0] <= day:
                    heapq.heappop(live)
                at.append(i)
                first.append(title[0])
                holes.append(title[1])
                acts.append(sorted({a for _, _, a in live}))
        chosen = pa.array(at, pa.int64())
        values = [batch.column("request").take(chosen), batch.column("as_of").take(chosen), pa.array(first, pa.int32()), pa.array(holes, pa.bool_()), pa.array(acts, pa.list_(batch.column("act_id").type))]
        yield pa.RecordBatch.from_arrays(values, names=["request", "as_of", "first", "holes", "acts"])


def resolve(requests: DataFrame, revisions: DataFrame, today: Column | None = None) -> DataFrame:
    """request, act_id, n_acts, reason: the act with the requested title that is in force on the day, where exactly one is.

    requests: request, title, as_of. revisions: act_id, title, valid_from, valid_to (dates; an open end is null and `open`
    true, and an unknown end is null and `open` false). Titles are compared folded. The acts of a request's rows count together.
    """
    today = F.current_date() if today is None else today
    asked = requests.select("request", t.fold("title").alias("k"), F.col("as_of").cast("date").alias("as_of"))
    own = revisions.select("act_id", t.fold("title").alias("k"), "valid_from", "valid_to", (F.col("valid_from").isNotNull() & (F.col("valid_to").isNotNull() | F.col("open"))).alias("whole"))
    out = _swept(asked, own)
    every = F.array_distinct(F.flatten(F.collect_list(F.when(F.col("request").isNotNull(), F.col("acts"))).over(Window.partitionBy("request"))))
    out = out.withColumn("every", every).select("request", "as_of", "first", "holes", F.array_min("every").alias("act_id"), F.size("every").cast("long").alias("n_acts"))
    n = F.coalesce("n_acts", F.lit(0))
    reason = (
        F.when(F.col("as_of").isNull(), "no date").when(F.col("as_of") > today, "future date").when(F.col("holes").isNull(), "unknown title").when(n > 1, "several acts").when(n == 1, F.lit(None))
        .when(F.col("first").isNull() | F.col("holes"), "incomplete interval").when(F.col("as_of") < F.col("first"), "not yet in force").otherwise("no longer in force")
    )
    return out.select("request", F.when(reason.isNull(), F.col("act_id")).alias("act_id"), n.alias("n_acts"), reason.alias("reason"))


def chain_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 of a JSON object of strings and nulls with sorted keys and compact separators."""
    parts = [F.concat(F.lit(f'"{name}":'), F.when(value.isNull(), F.lit("null")).otherwise(json_string(value))) for name, value in sorted(fields.items())]
    return F.sha2(F.encode(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), "UTF-8"), 256)


REVISION_FIELDS = ["act_id", "title", "source_id", "authority_class", "issuer", "act_type", "valid_from", "valid_to", "publication_series", "xml_sha256"]


def revision_hash(version: str = REVISION_VERSION) -> Column:
    """Over REVISION_FIELDS of a row."""
    return chain_digest({"version": F.lit(version)} | {c: F.col(c).cast("string") for c in REVISION_FIELDS})


def section_hash(version: str = SECTION_VERSION) -> Column:
    """Over act_id, section, revision_sha256 and content_sha256 of a row."""
    return chain_digest({"version": F.lit(version)} | {c: F.col(c).cast("string") for c in ("act_id", "section", "revision_sha256", "content_sha256")})


def files_to_revisions(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """metadata (REVISION_FIELDS but xml_sha256) of the acts whose file is there once, with xml_sha256 and revision_sha256. files: act_id, content."""
    hashed = files.groupBy("act_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.sha2("content", 256)).alias("xml_sha256")).filter("n = 1").drop("n")
    return metadata.join(hashed, "act_id").withColumn("revision_sha256", revision_hash())


def retrieve(requests: DataFrame, revisions: DataFrame, sections: DataFrame, site: str) -> DataFrame:
    """A record for each wanted section of an act. requests: act_id, domain, section (as written), as_of. sections: act_id, section, heading, text.

    Sections are compared in canonical form and count once a request; `reason` says why a section has no record: it isn't
    there, or there with several texts.
    """
    asked = requests.select("act_id", F.upper(F.trim(t.text("domain"))).alias("domain"), t.canonical_section("section").alias("section"), F.col("as_of").cast("date").alias("as_of_date")).distinct()
    own = sections.select("act_id", t.canonical_section("section").alias("section"), F.trim(t.text("heading")).alias("heading"), "text").filter(F.trim(t.text("text")) != "").distinct()
    same = Window.partitionBy("act_id", "section")
    own = own.join(asked.select("act_id", "section").distinct(), ["act_id", "section"], "left_semi").withColumns({"n": F.count(F.lit(1)).over(same), "k": F.row_number().over(same.orderBy("heading", "text"))}).filter("k = 1").drop("k")
    out = asked.join(own, ["act_id", "section"], "left").join(revisions.select("act_id", "title", "source_id", "authority_class", "xml_sha256", "revision_sha256"), "act_id", "left")
    reason = F.when(F.col("revision_sha256").isNull(), "unknown act").when(F.col("section").isNull(), "no section number").when(F.col("n").isNull(), "no such section").when(F.col("n") > 1, "several texts")
    out = out.withColumns({"reason": reason, "content_sha256": F.sha2(F.encode("text", "UTF-8"), 256), "status": F.lit(STATUS), "evidence_source": F.lit(EVIDENCE)}).withColumn("section_sha256", section_hash())
    name = F.when(F.col("domain") != "", F.concat_ws("_", "domain", "section")).otherwise(F.concat_ws("_", F.lit("RT"), "act_id", "section"))
    title = F.concat(F.concat_ws(" § ", "title", "section"), F.when(F.col("heading") != "", F.concat(F.lit(" – "), "heading")).otherwise(""))
    page = F.concat(F.lit(f"{site}/akt/"), F.col("act_id").cast("string"))
    return out.select(
        name.alias("id"), title.alias("title"), "text", "act_id", "section", "source_id", "authority_class", "status", "evidence_source", "as_of_date", page.alias("canonical_url"), F.concat(page, F.lit("#para"), F.lower("section")).alias("url"),
        "content_sha256", "xml_sha256", "revision_sha256", "section_sha256", "reason",
    )


def admit(records: DataFrame, revisions: DataFrame, site: str, as_of: Column | None = None, today: Column | None = None) -> DataFrame:
    """Adds reason: what is wrong with a record first, null where it may be used. revisions: act_id, revision_sha256."""
    today = F.current_date() if today is None else today
    known = revisions.select(F.col("act_id").alias("act"), F.col("revision_sha256").alias("known_sha256"))
    met = records.drop("reason").join(known, records["act_id"] == F.col("act"), "left").drop("act")
    hexed = lambda c: F.coalesce(F.lower(F.trim(F.col(c))).rlike("^[0-9a-f]{64}$"), F.lit(False))
    same = lambda c, value: F.coalesce(F.lower(F.trim(t.text(c))) == value, F.lit(False))
    page = F.concat(F.lit(f"{site}/akt/"), F.col("act_id").cast("string"))
    authority = F.create_map(*(F.lit(x) for pair in AUTHORITIES.items() for x in pair))[F.coalesce("source_id", F.lit(""))]
    content = F.sha2(F.encode(t.text("text"), "UTF-8"), 256)
    day = F.try_to_date(F.col("as_of_date").cast("string"), "yyyy-MM-dd")
    chained = chain_digest({"version": F.lit(SECTION_VERSION), "act_id": F.col("act_id").cast("string"), "section": t.canonical_section("section"), "revision_sha256": F.lower(F.trim("revision_sha256")), "content_sha256": content})
    reason = (
        F.when(~F.col("status").eqNullSafe(STATUS) | ~F.col("evidence_source").eqNullSafe(EVIDENCE), "not verified").when(authority.isNull() | ~authority.eqNullSafe(F.col("authority_class")), "authority disagrees")
        .when(~t.text("act_id").rlike("^[0-9]+$"), "no act number").when(~F.col("canonical_url").eqNullSafe(page), "wrong act url")
        .when(~F.lower("url").eqNullSafe(F.lower(F.concat(page, F.lit("#para"), t.canonical_section("section")))), "wrong section url").when(day.isNull(), "no date").when(day > today, "future date")
        .when(F.lit(as_of is not None) & (day != (as_of if as_of is not None else day)), "other date").when(F.trim(t.text("text")) == "", "no text").when(~same("content_sha256", content), "content hash")
        .when(~hexed("revision_sha256") | ~hexed("xml_sha256") | ~hexed("section_sha256"), "not a hash").when(~same("section_sha256", chained), "section hash").when(F.col("known_sha256").isNull(), "unknown revision")
        .when(~same("revision_sha256", F.lower("known_sha256")), "revision hash")
    )
    return met.withColumn("reason", reason).drop("known_sha256")
