"""Exact dedup by a heavy-hitter split, in DataFrame functions only.

Texts are equal when they are identical after every run of ASCII white space is replaced by one space. A text is
represented by the SHA-256 of that form. The digests are written once as a narrow table; all that follows reads it.

1. A Misra-Gries summary (DataFrame.freqItems: Karp, Schenker and Papadimitriou's form, merged across tasks) names at
   most 1 / support digests, among them every digest with more than support * rows rows.
2. One exact, map-side combined count over the candidates verifies them: winners are those above the threshold.
3. Winners, at most 1 / support rows, are broadcast: their rows get their decision in the map task and are not shuffled
   by digest; `drop_duplicates` drops their copies there, with their texts.
4. The remaining digests, none of which holds more than support of the rows, are aggregated and joined by shuffle.

Edge cases: a null text counts as empty and equals other empty texts. A row without doc_id is never preferred; where no
row of a group has one, keep_id is null and all of them are kept, since nothing can name the one to keep. Rows that repeat a doc_id and text share
one decision in the report; `drop_duplicates` returns one of them. Other columns are ignored, whatever their names.
An empty table gives an empty report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, parted, text_of

WHITE = "[\\x20\\x09-\\x0D]+"
SUPPORT = 0.001


def text_digest(text):
    """SHA-256 (hex) of the text with each run of ASCII white space replaced by one space."""
    return F.sha2(F.encode(F.regexp_replace(text, WHITE, " "), "UTF-8"), 256)


def _totals(rows: DataFrame) -> DataFrame:
    """digest, keep_id and group_size."""
    return rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def _split(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, support: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest) of every row, written once, and the winners: digest, keep_id and group_size of those above the threshold."""
    spark = docs.sparkSession
    digests = scratch.cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(text_digest(text_of(text_col))).alias("digest")), "digests")
    named = spark.createDataFrame([(d,) for d in _frequent(digests, support)], "digest binary")
    counted = _totals(digests.join(F.broadcast(named), "digest", "left_semi"))
    rows = digests.count()
    return digests, scratch.cut(counted.filter(F.col("group_size") > support * rows), "winners")


def decisions(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    digests, winners = _split(docs, scratch, id_col, text_col, support)
    hot = digests.join(F.broadcast(winners), "digest")
    rest = digests.join(F.broadcast(winners), "digest", "left_anti")
    cold = rest.join(_totals(rest), "digest")
    return hot.unionByName(cold).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def _frequent(digests: DataFrame, support: float) -> list[bytes]:
    """Candidates of the Misra-Gries summary: at most 1 / support digests, which bounds what reaches the driver."""
    found = digests.select("digest").stat.freqItems(["digest"], support).first()[0]
    return [bytes(d) for d in found or []]


def drop_duplicates(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of docs that stay, with their columns: of equal texts the one with the smallest id.

    Copies of winners go in the map task, by the broadcast. Of the other rows, those that go are known as a narrow list of
    (id, digest), and ids that repeat with their text as another. Rows without a mark of such an id stay and are not shuffled;
    only the rest meets the lists, with its texts. Equal rows of one id are told apart where such rows exist.
    """
    digests, winners = _split(docs, scratch, id_col, text_col, support)
    # Groups without any id keep all their rows.
    rest = digests.join(F.broadcast(winners), "digest", "left_anti")
    several = _totals(rest).filter("group_size > 1 and keep_id is not null").select("digest", "keep_id")
    gone = rest.join(several, "digest").filter("not doc_id <=> keep_id").select("doc_id", "digest")
    hot_gone = digests.join(F.broadcast(winners), "digest").filter("keep_id is not null and doc_id is null").select("doc_id", "digest")
    listed = scratch.cut(gone.unionByName(hot_gone).distinct(), "gone")
    known, nameless = listed.filter("doc_id is not null"), listed.filter("doc_id is null").select("digest")
    again = scratch.cut(digests.filter("doc_id is not null").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "digest"), "again")

    hidden = docs.toDF(*(f"input{k}" for k in range(len(docs.columns))))
    own_id, own_text = (F.col(f"input{docs.columns.index(c)}") for c in (id_col, text_col))

    def without_winners(rows: DataFrame) -> DataFrame:
        found = rows.withColumn("digest", F.unhex(text_digest(F.coalesce(own_text.cast("string"), F.lit("")))))
        found = found.join(F.broadcast(winners.select("digest", "keep_id")), "digest", "left")
        return found.filter(F.col("keep_id").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).drop("keep_id")

    near, far = parted(hidden.withColumn("doc_id", own_id.cast("long")), listed.select("doc_id").unionByName(again.select("doc_id")), "doc_id")
    left = without_winners(near).join(known, ["doc_id", "digest"], "left_anti")
    if nameless.limit(1).count():
        left = left.filter("doc_id is not null").unionByName(left.filter("doc_id is null").join(nameless, "digest", "left_anti"))
    if again.limit(1).count():
        once = left.join(again, ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
        left = left.join(again, ["doc_id", "digest"], "left_anti").unionByName(once)
    left = left.unionByName(without_winners(far))
    return left.select(*(F.col(f"input{k}").alias(c) for k, c in enumerate(docs.columns)))
