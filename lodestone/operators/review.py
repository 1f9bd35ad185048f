"""Reports over outcomes, checks of records, bounded collections and what is read from conversations and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Acceptance of the model evaluation.
MOST_FALLBACK, LEAST_PASS = 0.25, 0.75
# The order of obligations.
KINDS = ["authority", "procedure", "deadline", "remedy", "payment", "form_requirement"]


def labelled_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts by all of `by`, by the first of it, and in total; null stands for all."""
    sets = [[F.col(c) for c in by], [F.col(by[0])], []]
    return rows.groupingSets(sets, *(F.col(c) for c in by)).agg(F.count(F.lit(1)).alias("n"), F.grouping_id(*by).cast("long").alias("level"))


def members(rows: DataFrame, by: str, name: str) -> DataFrame:
    """by, n, names: the sorted names of each class. For classes of few members, such as registries."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(name)).alias("names"))


def check_report(rows: DataFrame, by: str, checks: list[str], floor: float) -> DataFrame:
    """by, cases, a sum for each check, accepted: each check passes in at least `floor` of the cases."""
    sums = rows.groupBy(by).agg(F.count(F.lit(1)).alias("cases"), *(F.count_if(c).alias(c) for c in checks))
    low = F.least(*(F.col(c) for c in checks)) if len(checks) > 1 else F.col(checks[0])
    return sums.withColumn("accepted", low >= F.ceil(F.col("cases") * floor))


def model_report(rows: DataFrame, by: str) -> DataFrame:
    """by, cases, fallback_rate, pass_rate, all_safe, accepted. rows: fallback, passed, safe, mock."""
    rate = lambda c: F.round(F.count_if(c) / F.count(F.lit(1)), 6)
    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("cases"), rate("fallback").alias("fallback_rate"), rate("passed").alias("pass_rate"), F.coalesce(F.bool_and("safe"), F.lit(True)).alias("all_safe"), F.coalesce(F.bool_or("mock"), F.lit(False)).alias("mock"))
    return out.withColumn("accepted", (F.col("fallback_rate") <= MOST_FALLBACK) & (F.col("pass_rate") >= LEAST_PASS) & F.col("all_safe") & ~F.col("mock")).drop("mock")


def top_reasons(rows: DataFrame, reason: str, k: int = 5) -> DataFrame:
    """The k most frequent reasons; of equals the first by name."""
    return rows.filter(F.col(reason).isNotNull()).groupBy(reason).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), reason).limit(k)


def audit(rows: DataFrame, by: str, case: str, passed: str) -> DataFrame:
    """by, cases, passed, failures, consistent: passed and failures add up to cases and no failed case is listed twice."""
    sums = rows.groupBy(by).agg(F.count(F.lit(1)).alias("cases"), F.count_if(passed).alias("passed"), F.count_if(~F.col(passed)).alias("failures"), F.count_distinct(F.when(~F.col(passed), F.col(case))).alias("distinct_failures"))
    return sums.withColumn("consistent", (F.col("passed") + F.col("failures") == F.col("cases")) & (F.col("failures") == F.col("distinct_failures"))).drop("distinct_failures")


def all_true(rows: DataFrame, by: str, checks: list[str]) -> DataFrame:
    """by, holds: every check that is not null is true; without any, true."""
    return rows.groupBy(by).agg(F.coalesce(F.bool_and(F.forall(F.array(*checks), lambda x: F.coalesce(x, F.lit(True)))), F.lit(True)).alias("holds"))


def selected(cases: DataFrame, ids: DataFrame, key: str, order: str) -> DataFrame:
    """The requested cases with their order, and a row with found = false for each unknown id."""
    asked = ids.select(key).distinct()
    return asked.join(cases.select(key, order), key, "left").withColumn("found", F.col(order).isNotNull())


def civil_date(value: Column) -> Column:
    """The date of 2026-03-16, 2026-03-16Z, 2026-03-16+02:00 (an offset up to 14:00 is checked, not applied) or 16.03.2026; else null."""
    iso = r"^(\d{4}-\d{2}-\d{2})(Z|[+-](?:0\d|1[0-3]):[0-5]\d|[+-]14:00)?$"
    own = F.when(value.rlike(iso), F.try_to_date(F.regexp_extract(value, iso, 1), "yyyy-MM-dd"))
    return F.coalesce(own, F.when(value.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), F.try_to_date(value, "dd.MM.yyyy")))


def hex64(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-f]{64}$"), F.lit(False))


def bounded(rows: DataFrame, key: str, item: str, at: list[str], items: int = 20, keys: int = 100) -> DataFrame:
    """What a store keeps that holds `items` items a key, the last of each id, and evicts the key that was updated longest ago beyond `keys` keys.

    Keys are ranked through a limit, not in one window.
    """
    last = Window.partitionBy(key, item).orderBy(*(F.col(c).desc() for c in at))
    own = rows.withColumn("__r", F.row_number().over(last)).filter("__r = 1").drop("__r")
    newest = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in at))
    kept = own.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= items)
    alive = own.groupBy(key).agg(F.max(F.struct(*at)).alias("__at")).orderBy(F.col("__at").desc(), key).limit(keys).select(key)
    return kept.join(alive, key, "left_semi")


def user_evidence(turns: DataFrame, conv: str, turn: str, role: str, text: str, most: int = 30_000) -> DataFrame:
    """conv, evidence, n_turns: what the user says, in order, without markers of answers; a conversation is one row."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?im)^\s*(answer|vastus)\s*:\s*", ""))
    own = turns.filter(F.col(role) == "user").select(conv, turn, plain.alias("__t")).filter("__t <> ''")
    # What begins beyond the cut is not gathered.
    before = F.sum(F.length("__t") + 1).over(Window.partitionBy(conv).orderBy(turn, "__t").rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(conv))).withColumn("__before", F.coalesce(before, F.lit(0))).filter(F.col("__before") < most)
    joined = own.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(turn, "__t"))).alias("__l"), F.max("__n").cast("int").alias("n_turns"))
    return joined.select(conv, F.left(F.array_join(F.transform("__l", lambda x: x["__t"]), "\n"), F.lit(most)).alias("evidence"), "n_turns")


def answer_pairs(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, question, answer: what the assistant says and the user's turn that follows it directly."""
    w = Window.partitionBy(conv).orderBy(turn)
    both = turns.select(conv, turn, role, F.col(text).alias("question"), F.lead(role).over(w).alias("__next"), F.lead(text).over(w).alias("answer"))
    return both.filter((F.col(role) == "assistant") & (F.col("__next") == "user")).select(conv, turn, "question", "answer")


def generated(value: Column) -> Column:
    """A generated text without [IDS], headings and repeated white space."""
    plain = F.regexp_replace(F.regexp_replace(value, r"\[[A-Z0-9_]+\]", ""), r"(?m)^\s*#{1,6}\s.*$", "")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def excerpt(value: Column, most: int = 320) -> Column:
    """The first sentence without a section mark, cut at a word with an ellipsis."""
    plain = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"^[^§\n]{0,80}§\s*\S+\.?\s*", "")
    first = F.trim(F.regexp_replace(F.regexp_extract(plain, r"(?s)^(.*?[.!?])(?:\s|$)", 1), r"\s+", " "))
    whole = F.when(first != "", first).otherwise(F.trim(F.regexp_replace(plain, r"\s+", " ")))
    cut = F.regexp_replace(F.left(whole, F.lit(most)), r"\s+\S*$", "")
    return F.when(F.length(whole) > most, F.concat(cut, F.lit("…"))).otherwise(whole)


def confidence(supported: Column, total: Column, conditional: Column) -> Column:
    """'limited' without support, 'conditional' where a condition is open or a part lacks support, else 'supported'."""
    return F.when(supported == 0, "limited").when(conditional | (supported < total), "conditional").otherwise("supported")


def repaired_citations(value: Column, known: Column) -> Column:
    """Marks such as [vos 123] as [VOS_123] where the array of known ids has it; others stay. Marks are found once and replaced by their value."""
    marks = F.array_distinct(F.regexp_extract_all(value, F.lit(r"\[([A-Za-z]+[ _-]\d+[A-Za-z0-9]*)\]"), F.lit(1)))
    canonical = lambda m: F.upper(F.regexp_replace(m, "[ _-]", "_"))
    swap = lambda out, m: F.when(F.array_contains(known, canonical(m)), F.replace(out, F.concat(F.lit("["), m, F.lit("]")), F.concat(F.lit("["), canonical(m), F.lit("]")))).otherwise(out)
    return F.aggregate(marks, value, swap)


def admitted(rows: DataFrame, reference: DataFrame, key: str, fields: list[str], batch: str) -> DataFrame:
    """batch, rows, equal, admitted: whether all rows of a batch equal the reference in all fields; one that differs rejects the batch."""
    whole = F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)  # digests are compared, not texts
    own = reference.select(key, whole.alias("__ref"))
    joined = rows.select(batch, key, whole.alias("__own")).join(own, key, "left").withColumn("__same", F.col("__own").eqNullSafe(F.col("__ref")))
    return joined.groupBy(batch).agg(F.count(F.lit(1)).alias("rows"), F.count_if("__same").alias("equal"), F.bool_and("__same").alias("admitted"))


def replaced(candidates: DataFrame, live: DataFrame, key: str, value: str) -> DataFrame:
    """Each candidate with the live value where there is one, else its own, labelled."""
    fresh = live.select(key, F.col(value).alias("__live"))
    return candidates.join(fresh, key, "left").select(key, F.coalesce("__live", value).alias(value), F.when(F.col("__live").isNull(), "local_fallback").otherwise("live").alias("origin"))


def merged_chunks(chunks: DataFrame, key: str, order: str, values: str, flag: str, most: int) -> DataFrame:
    """key, values, flag: the lists of a key's chunks as one, each value once, the first `most`; flag if any has it. A key has few chunks."""
    both = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, values))).alias("__l"), F.bool_or(flag).alias(flag))
    return both.select(key, F.slice(F.array_distinct(F.flatten(F.transform("__l", lambda x: x[values]))), 1, most).alias(values), flag)


def act_ids(value: Column) -> Column:
    """Ids of acts in a text, in order, each once: a number by itself, or the last part of an act's URL path."""
    return F.array_distinct(F.regexp_extract_all(value, F.lit(r"(?:^|/akt/|/)(\d{3,})(?=[/?#\s]|$)"), F.lit(1)))


def passage(*parts: str, most: int = 5000) -> Column:
    """What a reranker reads: the parts that are there, a line each."""
    return F.left(F.concat_ws("\n", *(F.when(F.trim(F.col(p)) != "", F.col(p)) for p in parts)), F.lit(most))


def kind_order(kind: Column) -> Column:
    """The place of a kind among KINDS; unknown ones come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KINDS)), kind), F.lit(0)), F.lit(len(KINDS) + 1))


def stage_ledger(done: DataFrame, stages: list[str], run: str) -> DataFrame:
    """run, place, stage, status: completed or failed as recorded, not_run for the others. done: (run, stage, status)."""
    named = F.explode(F.array(*(F.struct(F.lit(k).alias("place"), F.lit(s).alias("stage")) for k, s in enumerate(stages, 1)))).alias("s")
    every = done.select(run).distinct().select(run, named).select(run, "s.place", "s.stage")
    return every.join(done.select(run, "stage", "status"), [run, "stage"], "left").select(run, "place", "stage", F.coalesce("status", F.lit("not_run")).alias("status"))
