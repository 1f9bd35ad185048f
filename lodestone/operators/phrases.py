"""Which strings occur in which texts, as equi-joins: short strings in queries by their beginning, phrases in documents by position.

Both find plain substrings of folded text, so a string may begin or end within a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a string by which it is looked up.
HEAD = 12
#: Characters on each side of a space by which two neighbouring words are looked up.
EDGE = 3


def _lengths(rows: DataFrame, *cols: Column) -> list[tuple]:
    """Distinct values of lengths that are bounded by HEAD or EDGE."""
    return sorted(tuple(r) for r in rows.select(*cols).distinct().collect())


def contained(texts: DataFrame, strings: DataFrame, by: str = "query_id", text: str = "f", string: str = "s") -> DataFrame:
    """by, string: which of the strings occur in which texts. For short texts: each of their stretches of the strings' lengths, HEAD at most, is a key."""
    named = strings.filter(F.col(string) != "").select(string).distinct().withColumn("n", F.least(F.lit(HEAD), F.length(string)))
    keyed = named.withColumn("key", F.left(string, F.col("n")))
    none = F.array().cast("array<string>")
    cut = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda k: F.substring(F.col(text), k, F.lit(n)))).otherwise(none)
    cuts = [cut(n) for (n,) in _lengths(named, F.col("n"))] or [none]
    keys = texts.select(by, F.explode(F.array_distinct(F.concat(*cuts))).alias("key"))
    met = keys.join(keyed.join(keys.select("key").distinct(), "key", "left_semi"), "key").select(by, string)
    return met.join(texts.select(by, text), by).filter(F.col(text).contains(F.col(string))).select(by, string)


def occurrences(docs: DataFrame, words: str, phrases: DataFrame, doc: str = "doc_id", phrase: str = "phrase") -> DataFrame:
    """doc, phrase: which phrases of two words or more occur in which documents, by intersecting positions.

    docs: (doc, words in order). A phrase is the list of its neighbouring word pairs. A pair occurs at a position where two
    neighbouring words of the document agree with it: the phrase's first word may be the end of the document's, its last one the
    beginning. The phrase occurs where all its pairs do, each at its own distance from the first. Only the document's pairs whose
    characters around the space are some phrase's are shuffled.
    """
    w = F.split(phrase, " ")
    named = phrases.select(phrase).distinct().filter(F.size(w) >= 2)
    pairs = named.select(phrase, (F.size(w) - 1).alias("n"), F.posexplode(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda k: F.struct(F.get(w, k).alias("l"), F.get(w, k + 1).alias("r")))).alias("at", "pair"))
    pairs = pairs.select(phrase, "n", "at", "pair.l", "pair.r").withColumns({"nl": F.least(F.lit(EDGE), F.length("l")), "nr": F.least(F.lit(EDGE), F.length("r"))})
    pairs = pairs.withColumn("key", F.concat_ws(" ", F.right("l", F.col("nl")), F.left("r", F.col("nr"))))
    own = docs.filter(F.size(words) >= 2).select(doc, F.posexplode(F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda k: F.struct(F.get(words, k).alias("a"), F.get(words, k + 1).alias("b")))).alias("pos", "p"))
    edges = [F.concat_ws(" ", F.right("p.a", F.lit(x)), F.left("p.b", F.lit(y))) for x, y in _lengths(pairs, F.col("nl"), F.col("nr"))]
    if not edges:
        return named.crossJoin(docs.select(doc).limit(0)).select(doc, phrase)
    own = own.select(doc, "pos", "p.a", "p.b", F.explode(F.array_distinct(F.array(*edges))).alias("key")).join(pairs.select("key").distinct(), "key", "left_semi")
    met = own.join(pairs, "key")
    left = F.when(F.col("at") == 0, F.col("a").endswith(F.col("l"))).otherwise(F.col("a") == F.col("l"))
    right = F.when(F.col("at") == F.col("n") - 1, F.col("b").startswith(F.col("r"))).otherwise(F.col("b") == F.col("r"))
    starts = met.filter(left & right).groupBy(doc, phrase, "n", (F.col("pos") - F.col("at")).alias("start")).agg(F.count_distinct("at").alias("met"))
    return starts.filter("met = n").select(doc, phrase).distinct()
