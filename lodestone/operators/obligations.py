"""What a request has to be answered on: obligations from a table of rules in which specific ones replace general ones.

A rule names its kind of obligation, and may ask for an intent, for a flag of the request, and for words of its context (one of
each group). Of the rules of a kind that apply, the last one that replaces counts, else the first. Requests meet rules by
intent in an equi-join; the table of rules is ordinary data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t

RULE = "place int, kind string, intent string, flag string, words array<array<string>>, scoped boolean, query string, reason string, replaces boolean"
MOST = 1200
#: What a rule without an intent is looked up by.
ANY = "*"

# Kinds in their order with what an answer has to say, words that mark a context, scopes, and rules.
KINDS = {
    "authority": "milline asutus või kohus on pädev ja kellele tuleb pöörduda",
    "procedure": "milline menetlus või õiguslik alus kirjeldatud olukorrale kohaldub",
    "deadline": "milline tähtaeg kohaldub või kas möödunud tähtaega saab ennistada",
    "remedy": "milline vaidlustamise või muu õiguskaitsevahend on kasutajal olemas",
    "payment": "kas rahatrahvi saab tasuda ositi ja millised täitmise tagajärjed võivad järgneda",
    "form_requirement": "milline vorminõue kehtib ja mis on vorminõude rikkumise tagajärg",
}
EMPLOYMENT = ["töölep", "töötaja", "tööandja", "valland", "koond"]
DEADLINE, MISSED = ["tähta", "tahta"], ["mööda", "moodas", "ület", "ulet", "hiljaks", "ennist"]
FORM = ["suulis", "kirjal", "vorminõ", "vormis", "vormi"]
SCOPES = {"fine": "rahatrahv väärteomenetlus", "employment": "tööleping töötaja tööandja"}
RULES = [
    (1, "authority", "find_authority", None, [], True, "pädev asutus kohus kellele esitada kuhu pöörduda", "latest_turn_intent:find_authority", False),
    (2, "procedure", "document_help", None, [], True, "kohaldatav menetlus avaldus taotlus järgmised sammud", "latest_turn_intent:procedure", False),
    (2, "procedure", "next_steps", None, [], True, "kohaldatav menetlus avaldus taotlus järgmised sammud", "latest_turn_intent:procedure", False),
    (3, "deadline", "deadline", None, [], True, "kohaldatav tähtaeg tähtaja arvestamine", "latest_turn_intent:deadline", False),
    (4, "remedy", "challenge_decision", None, [], True, "otsuse vaidlustamine kaebus vaie õiguskaitsevahend", "latest_turn_intent:challenge_decision", False),
    (5, "payment", "payment_plan", None, [], True, "tasumine ositi osamaksed maksegraafik täitmisele pööramine", "latest_turn_intent:payment_plan", False),
    (6, "deadline", "missed_deadline", "fine", [], False, "rahatrahv väärteomenetlus kaebuse tähtaja ennistamine tähtaja möödumine läbi vaatamata", "fine_context:missed_deadline", True),
    (6, "deadline", None, "fine", [DEADLINE, MISSED], False, "rahatrahv väärteomenetlus kaebuse tähtaja ennistamine tähtaja möödumine läbi vaatamata", "fine_context:missed_deadline", True),
    (7, "remedy", "challenge_decision", "fine", [], False, "rahatrahv väärteomenetluse otsuse vaidlustamine kaebus maakohtule menetlusaluse isiku õigused", "fine_context:challenge_decision", True),
    (8, "payment", "payment_plan", "fine", [], False, "rahatrahvi tasumine ositi mõjuv põhjus osamaksed kohtuväline menetleja täitmisele pööramine", "fine_context:payment_plan", True),
    (9, "procedure", None, "employment", [["koond"]], False, "töölepingu ülesütlemine koondamise tõttu töömahu vähenemine töö ümberkorraldamine teise töö pakkumine", "employment_context:redundancy_basis", True),
    (10, "deadline", "deadline", "employment", [["koond"]], False, "töölepingu ülesütlemise etteteatamise tähtaeg koondamine töötaja", "employment_context:notice_period", True),
    (10, "deadline", None, "employment", [["koond"], ["etteteat", "kui pikk"]], False, "töölepingu ülesütlemise etteteatamise tähtaeg koondamine töötaja", "employment_context:notice_period", True),
    (11, "form_requirement", None, "employment", [FORM], False, "töölepingu ülesütlemisavaldus kirjalikku taasesitamist võimaldav vorm tühine", "employment_context:termination_form", True),
]


def rules_table(spark: SparkSession, rules: list[tuple] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, RULE)


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def plan(requests: DataFrame, rules: DataFrame, markers: dict[str, list[str]] | None = None, kinds: dict[str, str] = KINDS, scopes: dict[str, str] = SCOPES, most: int = MOST) -> DataFrame:
    """request, ord, kind, query, requirement, reason.

    requests: request, context, search_text, intents, flags. markers add a flag where the context has one of its words. The scope
    of a general rule is that of the first of `scopes` that the request has as a flag, else its search text, else its context.
    """
    markers = {"employment": EMPLOYMENT} if markers is None else markers
    context = t.casefold_only("context")
    added = [F.when(F.exists(F.lit(words).cast("array<string>"), lambda w: F.col("c").contains(w)), F.lit(flag)) for flag, words in markers.items()]
    base = requests.withColumn("c", context)
    none = F.array().cast("array<string>")
    base = base.withColumn("flags", F.array_union(F.coalesce("flags", none), F.array_compact(F.array(*added)) if added else none))
    scope = F.coalesce(*(F.when(F.array_contains("flags", flag), F.lit(words)) for flag, words in scopes.items()), F.left(_squeezed(F.when(t.text("search_text") != "", F.col("search_text")).otherwise(F.col("c"))), F.lit(500)))
    asked = base.select("request", "c", "flags", scope.alias("scope"), F.explode(F.array_union(F.coalesce("intents", none), F.array(F.lit(ANY)))).alias("__intent"))
    met = asked.join(rules.withColumn("__intent", F.coalesce("intent", F.lit(ANY))), "__intent")
    fits = (F.col("flag").isNull() | F.array_contains("flags", F.col("flag"))) & F.forall("words", lambda group: F.exists(group, lambda w: F.col("c").contains(w)))
    query = F.trim(F.left(_squeezed(F.when(F.col("scoped"), F.concat_ws(" ", "scope", "query")).otherwise(F.col("query"))), F.lit(most)))
    found = met.filter(fits).select("request", "kind", query.alias("query"), "reason", "replaces", "place").filter("query <> ''")
    best = F.max_by(F.struct("query", "reason"), F.struct("replaces", F.when(F.col("replaces"), F.col("place")).otherwise(-F.col("place"))))
    order = F.array_position(F.lit(list(kinds)), F.col("kind")).cast("int")
    needs = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))[F.col("kind")]
    out = found.groupBy("request", "kind").agg(best.alias("b"))
    return out.select("request", order.alias("ord"), "kind", "b.query", needs.alias("requirement"), "b.reason")


def coverage_summary(rows: DataFrame) -> DataFrame:
    """request_id, enforced, covered, missing_sources, missing_answers, unresolved, needs_repair. rows: request_id, place, obligation, status (see verify.coverage).

    Lists are in order of place. A repair makes sense where an answer is missing and no source is.
    """
    of = lambda status: F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == status, F.struct("place", "obligation")))), lambda x: x["obligation"])
    out = rows.groupBy("request_id").agg(
        F.count_if(F.col("status") != "RULE_UNRESOLVED").alias("enforced"), F.count_if(F.col("status") == "COVERED").alias("covered"), of("SOURCE_MISSING").alias("missing_sources"),
        of("ANSWER_MISSING").alias("missing_answers"), of("RULE_UNRESOLVED").alias("unresolved"),
    )
    return out.withColumn("needs_repair", (F.size("missing_answers") > 0) & (F.size("missing_sources") == 0))
