"""Turns, intents, routes and urgency as column expressions; case cards as folds over revisions.

Intent patterns see folded text. The pattern lists, labels and route ids below are fixed values: results depend on them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t

# Intents in order, each with the patterns of which one has to be found.
INTENTS = {
    "missed_deadline": [
        r"\b(?:kaebe|kaebuse|vaide|vaidlustamise)?\s*tahta\w*\b.{0,55}\b(?:moodas|uletatud|hiljaks)\b",
        r"\b(?:moodas|uletatud|hiljaks)\b.{0,55}\btahta\w*\b",
        r"\btahta\w*\s+ennist\w*\b",
        r"\bennist\w*\s+tahta\w*\b",
    ],
    "challenge_decision": [r"\bvaidlust\w*\b", r"\bkaeb\w*\b", r"\bvaie\w*\b", r"\bei\s+(?:ole\s+)?noustu\b", r"\bei\s+ole\s+nous\b"],
    "payment_plan": [r"\bjarelmaks\w*\b", r"\bosamak\w*\b", r"\bmaksegraaf\w*\b", r"\bosade\s+kaupa\b", r"\b(?:maks\w*|tasu\w*)\b.{0,35}\bositi\b", r"\bositi\b.{0,35}\b(?:maks\w*|tasu\w*)\b"],
    "deadline": [r"\btahta\w*\b", r"\bmillal\b", r"\bkui\s+kaua\b"],
    "document_help": [r"\b(?:koosta|kirjuta|vormista)\w*\b.{0,45}\b(?:kaebus|vaie|avaldus|kiri|vastus|dokument)\w*\b", r"\babi\b.{0,35}\b(?:kaebuse|vaide|avalduse|kirja|vastuse|dokumendi)\b"],
    "find_authority": [r"\bkuhu\s+poord\w*\b", r"\bkellele\s+(?:esitada|saata)\w*\b", r"\bmis\s+asutus\w*\b"],
    "next_steps": [r"\bmida\s+(?:ma\s+)?peaksin\w*\b", r"\bmida\s+teha\b", r"\bkuidas\s+edasi\b"],
    "amount_or_claim": [r"\bkui\s+suur\b", r"\bsumma\b", r"\bnoue\w*\b"],
}
FINE = r"\b(?:trahv\w*|rahatrahv\w*|vaarte\w*|kiirmenetl\w*|luhimenetl\w*)\b"
# Exact documents in a fine case, first match wins.
FINE_DOCUMENTS = [
    (r"\bkiirmenetluse\s+otsus\w*\b", "kiirmenetluse otsus"), (r"\bluhimenetluse\s+otsus\w*\b", "lühimenetluse otsus"),
    (r"\buldmenetluses?\s+(?:tehtud\s+)?otsus\w*\b", "üldmenetluses tehtud otsus"), (r"\bhoiatustrahv\w*\b", "hoiatustrahvi trahviteade"),
]
# Words that set the urgency of a description.
ATTENTION = ["tähtaeg", "kohtukutse", "arest", "väljatõst", "valland", "vaidlusta"]
IMMEDIATE = ["ähvard", "vägivald", "peks", "tapab"]
MISSED = ["möödas", "ület", "hiljaks"]
# Identifiers that a question may not ask for, phrases of a clear request, opening words of a question.
IDENTIFIERS = ["isikukood", "telefoninumber", "telefoninumbri", "e-posti aadress", "emaili aadress", "kodune aadress", "elukoha aadress", "kontonumber", "pangakonto", "dokumendi number"]
REQUESTS = ["soovin teada", "tahan teada", "palun selgita", "mida teha", "mida peaksin", "mida ma peaksin", "kuidas edasi", "kuhu pöörduda"]
OPENINGS = "kas|kes|mida|millal|milline|millised|mitu|kui|kuidas|kuhu|miks|mille|millistel"
# Source ids by route.
BASE_ROUTE = ["ABIPOLS_3", "ABIPOLS_16", "VTMS_19"]
WARNING_ROUTE, SHORT_ROUTE, QUICK_ROUTE = [*BASE_ROUTE, "VTMS_54B2", "VTMS_54B5"], [*BASE_ROUTE, "VTMS_54B9", "VTMS_54B11"], [*BASE_ROUTE, "VTMS_57", "VTMS_114"]
MISSED_ROUTE, CHALLENGE_ROUTE, PAYMENT_ROUTE = ["VTMS_114", "VTMS_118"], ["VTMS_19", "VTMS_114"], ["KARS_66", "VTMS_57", "VTMS_74", "VTMS_204"]
REDUNDANCY_ROUTE, DISMISSAL_ROUTE = ["TLS_89", "TLS_97"], ["TLS_88", "TLS_95", "TLS_104"]

_none = lambda: F.array().cast("array<string>")
_list = lambda ids: F.array(*map(F.lit, ids))


def _any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(w) for w in words))


def intents(text: Column | str, most: int = 5) -> Column:
    """Intents of a text in order. A missed deadline also challenges the decision, and stands for a mere deadline question."""
    folded = t.fold(text)
    found = {name: reduce(lambda a, b: a | b, (folded.rlike(p) for p in patterns)) for name, patterns in INTENTS.items()}
    found["challenge_decision"] |= found["missed_deadline"]
    found["deadline"] &= ~found["missed_deadline"]
    out = F.array_compact(F.array(*(F.when(hit, F.lit(name)) for name, hit in found.items())))
    asks = (F.size(out) == 0) & t.text(text).contains("?")
    return F.when(asks, F.array(F.lit("rights_explanation"))).otherwise(F.slice(out, 1, most))


def is_fine(text: Column | str) -> Column:
    return t.fold(text).rlike(FINE)


def fine_document(text: Column | str) -> Column:
    """Label of the exact document, or empty."""
    folded = t.fold(text)
    return F.coalesce(*(F.when(folded.rlike(p), F.lit(label)) for p, label in FINE_DOCUMENTS), F.lit(""))


def large_amount(text: Column | str, least: float = 1000) -> Column:
    """The first amount in euros of `least` or more, as written; empty without one."""
    found = F.regexp_extract_all(t.text(text), F.lit(r"(?i)(?<!\d)\d{1,7}(?:[.,]\d{1,2})?\s*(?:€|eurot?\b|eur\b)"), F.lit(0))
    value = lambda a: F.replace(F.regexp_extract(a, r"^(\d+(?:[.,]\d+)?)", 1), F.lit(","), F.lit(".")).cast("double")
    return F.coalesce(F.get(F.filter(found, lambda a: value(a) >= least), F.lit(0)), F.lit(""))


def is_fragment(text: Column | str) -> Column:
    x = t.text(text)
    return (F.size(F.regexp_extract_all(x, F.lit("[A-Za-zÕÄÖÜõäöü]{2,}"), F.lit(0))) <= 2) & ~x.contains("?") & (F.length(x) <= 100)


def is_direct_question(text: Column | str) -> Column:
    x = t.text(text)
    return x.contains("?") & (F.size(F.regexp_extract_all(x, F.lit("[A-Za-zÕÄÖÜõäöü]{2,}"), F.lit(0))) <= 28) & x.rlike(rf"(?iU)^\s*(?:{OPENINGS})\b")


def is_clear_request(text: Column | str) -> Column:
    x = t.text(text)
    return x.contains("?") | _any(F.lower(x), REQUESTS)


def asks_identifier(question: Column | str) -> Column:
    x = F.lower(t.text(question))
    return _any(x, IDENTIFIERS) | x.rlike(r"(?U)\b(?:sinu|kasutaja|eraisiku|isiku|kliendi)\b.{0,45}\b(?:täpne\s+)?(?:ees-\s*ja\s+perekonna)?nimi\b")


def routes(text: Column | str, intents_: Column, fine: Column) -> Column:
    """Source ids that the description and its intents lead to, each once, document routes first."""
    x = t.casefold(text)
    document = (
        F.when(x.contains("hoiatustrahv") | x.contains("kirjalik hoiatamismenetlus") | (x.contains("mootorsõiduk") & x.contains("trahvitea")), _list(WARNING_ROUTE))
        .when(x.contains("lühimenetluse otsus") | x.contains("mõjutustrahv"), _list(SHORT_ROUTE))
        .when(x.contains("kiirmenetluse otsus"), _list(QUICK_ROUTE))
        .otherwise(_none())
    )
    has = lambda name: fine & F.array_contains(intents_, name)
    by_intent = F.when(has("missed_deadline"), _list(MISSED_ROUTE)).when(has("challenge_decision"), _list(CHALLENGE_ROUTE)).otherwise(_none())
    payment = F.when(has("payment_plan"), _list(PAYMENT_ROUTE)).otherwise(_none())
    work = _any(x, ["valland", "töölepingu üles", "tööleping üles", "koond"]) | (x.contains("töölep") & x.contains("üles"))
    employment = F.when(work & x.contains("koond"), _list(REDUNDANCY_ROUTE)).when(work, _list(DISMISSAL_ROUTE)).otherwise(_none())
    return F.array_distinct(F.concat(document, by_intent, payment, employment))


def observed_dates(text: Column | str) -> Column:
    """Calendar dates of this century that a text names, as written day.month.year or year-month-day."""
    x = t.text(text)
    dotted = F.transform(F.regexp_extract_all(x, F.lit(r"\b(?:0?[1-9]|[12]\d|3[01])[.](?:0?[1-9]|1[0-2])[.]20\d{2}\b"), F.lit(0)), lambda d: F.try_to_date(d, "d.M.yyyy"))
    dashed = F.transform(F.regexp_extract_all(x, F.lit(r"\b20\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b"), F.lit(0)), lambda d: F.try_to_date(d, "yyyy-MM-dd"))
    return F.array_distinct(F.array_compact(F.concat(dotted, dashed)))


def urgency(text: Column | str, today: Column) -> Column:
    """immediate, urgent, attention or normal. Immediate danger outranks a missed deadline; a near date counts only where nothing else does."""
    x = t.casefold(text)
    due = x.contains("tähtaeg")
    soon = F.exists(observed_dates(text), lambda d: F.date_diff(d, today).between(0, 7))
    return (
        F.when(_any(x, IMMEDIATE), "immediate").when(due & _any(x, MISSED), "urgent").when(_any(x, ATTENTION), "attention").when(soon & due, "attention").otherwise("normal")
    )


def carried_requests(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Adds request_turn: the last user turn up to each turn that is neither a fragment nor empty."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = F.when((F.col(role) == "user") & ~is_fragment(text), F.col(order))
    return turns.withColumn("request_turn", F.last(own, ignorenulls=True).over(w))


def latest_cards(revisions: DataFrame, key: str, revision: str, fields: list[str], confirmed: str = "user_confirmed") -> DataFrame:
    """The card of each key after all revisions: a field's value is the last confirmed one, else the last one."""
    order = F.col(revision)
    pick = lambda f: F.coalesce(F.max_by(f, F.when(F.col(confirmed) & F.col(f).isNotNull(), order)), F.max_by(f, F.when(F.col(f).isNotNull(), order)))
    return revisions.groupBy(key).agg(F.max(order).alias(revision), *(pick(f).alias(f) for f in fields))


def apply_revisions(current: DataFrame, changes: DataFrame, key: str, base: str, revision: str = "revision") -> DataFrame:
    """key, accepted, new revision: a change is accepted if it was made from the current revision, else it conflicts."""
    joined = changes.join(current.select(key, F.col(revision).alias("now")), key, "left")
    ok = F.coalesce(F.col(base) == F.col("now"), F.lit(False))
    return joined.select(key, ok.alias("accepted"), F.when(ok, F.col("now") + 1).otherwise(F.col("now")).alias(revision))
