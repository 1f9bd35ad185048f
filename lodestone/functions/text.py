"""Column functions over text: four normalisers, tokens, stems, n-grams, sentences, claims, quantities, ids.

All are built-in expressions, so they stay in generated JVM code. Null text counts as empty unless a docstring says otherwise.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content in a query. They are compared after folding, so accented entries never match.
STOPWORDS = (
    "aga ei ega et ja jah kas kes kui kuidas kaua kellel ma me mida miks millal milline millised millisel millistel millist millistest mis minu "
    "mind mul mulle nad ning on olen oli oma sa see seda selle siis ta tema te või voib võib võivad peab pean saab saan tahan soovin teha tegi "
    "tehtud tuleb olema olla palun kohta kasitatakse kasitletakse kehtib kehtivad loetakse reegel reeglid sisaldab sisaldama tahendab"
).split()
# Suffixes, tried in this order.
SUFFIXES = "dega tele delt dest desse telt test tesse ga le lt st sse ks ni na ta de te id sid d t l s".split()
# Number words by their base form.
NUMBER_WORDS = {
    "üks": ["üks", "ühe", "üht"], "kaks": ["kaks", "kahe", "kahte"], "kolm": ["kolm", "kolme"], "neli": ["neli", "nelja"], "viis": ["viis", "viie"], "kuus": ["kuus", "kuue"],
    "seitse": ["seitse", "seitsme"], "kaheksa": ["kaheksa"], "üheksa": ["üheksa"], "kümme": ["kümme", "kümne"], "sada": ["sada", "saja"], "tuhat": ["tuhat", "tuhande"],
}
STEM = 5


def text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


@cache
def _folds() -> tuple[str, str]:
    """Characters whose compatibility decomposition leaves one ASCII character, and that character."""
    pairs = []
    for code in range(0x80, min(sys.maxunicode, 0xFFFF) + 1):
        left = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(left) == 1:
            pairs.append((chr(code), left.lower()))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def fold(c: Column | str) -> Column:
    """Lower case, accents dropped, other non-ASCII characters removed, all but a-z and 0-9 as single spaces, trimmed.

    Characters that decompose into several ASCII characters (ligatures, fractions) are removed; fold_exact keeps them.
    """
    plain = F.regexp_replace(F.translate(F.lower(text(c)), *_folds()), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def casefold(c: Column | str) -> Column:
    """White space collapsed and trimmed, lower case with ß as ss."""
    return F.replace(F.lower(F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))), F.lit("ß"), F.lit("ss"))


def casefold_only(c: Column | str) -> Column:
    """Lower case with ß as ss; white space stays."""
    return F.replace(F.lower(text(c)), F.lit("ß"), F.lit("ss"))


def evidence_form(c: Column | str) -> Column:
    """For matching quotes: tags out, common entities resolved, case folded, quotes and dashes unified, white space collapsed."""
    out = text(c)
    for entity, value in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(value))
    out = F.replace(F.lower(F.regexp_replace(out, "<[^>]+>", " ")), F.lit("ß"), F.lit("ss"))
    out = F.translate(out, "“”„–—", '"""--')
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def record_id(c: Column | str, dash: bool = False) -> Column:
    """Upper case, without anything but letters (Estonian ones too), digits, underscores and, where asked, dashes."""
    return F.regexp_replace(F.upper(text(c)), "[^A-ZÕÄÖÜ0-9_-]" if dash else "[^A-ZÕÄÖÜ0-9_]", "")


def canonical_id(c: Column | str) -> Column:
    """Upper case without white space."""
    return F.upper(F.regexp_replace(text(c), r"(?U)\s+", ""))


def slug(c: Column | str, most: int = 60) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(F.trim(text(c)), "[^a-zA-Z0-9_.-]+", "-"), "^[-.]+|[-.]+$", ""), F.lit(most))


def tokens_of_fold(folded: Column) -> Column:
    return F.filter(F.split(folded, " "), lambda t: F.length(t) >= 2)


def tokens(c: Column | str) -> Column:
    """Tokens of two characters or more, with duplicates, in order."""
    return tokens_of_fold(fold(c))


def is_content(t: Column) -> Column:
    return ~t.isin(STOPWORDS) & ~t.rlike("^[0-9]+$")


def content_tokens(c: Column | str) -> Column:
    """Tokens that are neither stop words nor numbers."""
    return F.filter(tokens(c), is_content)


def stem_key(t: Column) -> Column:
    """The first five characters of a longer token."""
    return F.left(t, F.lit(STEM))


def char_ngrams(value: Column, n: int = 3) -> Column:
    """Distinct n-grams; the whole string where it is no longer than n; none for an empty one."""
    v = F.trim(value)
    grams = F.transform(F.sequence(F.lit(1), F.length(v) - n + 1), lambda i: F.substring(v, i, F.lit(n)))
    return F.when(F.length(v) == 0, F.array().cast("array<string>")).when(F.length(v) <= n, F.array(v)).otherwise(F.array_distinct(grams))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def suffix_variants(t: Column, least: int = 5) -> Column:
    """The token without each suffix that it ends in, where at least max(4, least - 1) characters are left."""
    bases = [F.when(t.endswith(s) & (F.length(t) - len(s) >= max(4, least - 1)), F.left(t, F.length(t) - len(s))) for s in SUFFIXES]
    return F.array_distinct(F.array_compact(F.array(*bases)))


def quantities(c: Column | str) -> Column:
    """Distinct quantities: digits with fraction or percent sign, and number words in their base form."""
    words = "|".join(w for forms in NUMBER_WORDS.values() for w in forms)
    found = F.transform(F.regexp_extract_all(text(c), F.lit(rf"(?iU)(?<!\w)(?:\d+(?:[.,]\d+)?%?|{words})(?!\w)"), F.lit(0)), F.lower)
    base = F.create_map(*(F.lit(x) for b, forms in NUMBER_WORDS.items() for f in forms for x in (f, b)))
    return F.array_distinct(F.transform(found, lambda q: F.coalesce(base[q], q)))


def sentences(c: Column | str, least_words: int = 3, most_chars: int = 700) -> Column:
    """Sentences of a text in order: split after . ! ? and at line ends, with enough words, cut to most_chars."""
    parts = F.transform(F.split(text(c), r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s))
    return F.transform(F.filter(parts, lambda s: (s != "") & (F.size(F.split(s, r"\s+")) >= least_words)), lambda s: F.left(s, F.lit(most_chars)))


def claims(c: Column | str) -> Column:
    """Claims of an answer: lines split after . ! ? where an upper-case letter or digit follows."""
    lines = F.flatten(F.transform(F.split(text(c), r"\R"), lambda line: F.split(F.trim(line), r"(?<=[.!?])\s+(?=[A-ZÕÄÖÜ0-9])")))
    return F.filter(F.transform(lines, lambda s: F.trim(s)), lambda s: s != "")


CITATION = r"\[\s*([A-ZÕÄÖÜa-zõäöü]+_\d+(?:[Bb]\d+|[A-Za-z])?)\s*\]"


def cited_ids(c: Column | str) -> Column:
    """Ids in brackets, canonical, each once in order of first mention."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text(c), F.lit(CITATION), F.lit(1)), lambda c: record_id(c)))


def section_heading(c: Column | str) -> Column:
    """From the first 500 characters: a leading 'X § N.' dropped, up to a numbered subsection or the first sentence, 180 characters."""
    head = F.regexp_replace(F.left(text(c), F.lit(500)), r"^[^§\n]{0,80}§\s*\S+\.?\s*", "")
    return F.trim(F.left(F.split(F.split(head, r"\s\d+\s\(\d")[0], r"[.!?](\s|$)")[0], F.lit(180)))


def retrieval_text(law_name: str, title: str, aliases: str, body: str, most: int = 6000) -> Column:
    """Name, title, at most 20 aliases and body on lines of their own; blank parts left out."""
    kept = lambda c: F.when(F.trim(text(c)) != "", F.trim(text(c)))
    listed = F.array_join(F.slice(F.coalesce(F.col(aliases), F.array().cast("array<string>")), 1, 20), "; ")
    return F.left(F.concat_ws("\n", kept(law_name), kept(title), F.when(listed != "", listed), kept(body)), F.lit(most))


def canonical_section(c: Column | str) -> Column:
    """'§ 3²', '3^2', '3 B2' and '3b2' as 3B2; '12a' as 12A; null where it is no section number."""
    s = F.upper(F.regexp_replace(F.replace(text(c), F.lit("§"), F.lit("")), r"(?U)\s+|\.$", ""))
    raised = F.regexp_replace(s, "([⁰¹²³⁴⁵⁶⁷⁸⁹]+)$", "^$1")
    s = F.replace(F.translate(raised, "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789"), F.lit("^"), F.lit("B"))
    return F.when(s.rlike("^[0-9]+(B[0-9]+|[A-Z])?$"), s)


def parse_date(c: Column | str) -> Column:
    """yyyy-MM-dd, d.M.yyyy or d/M/yyyy; null otherwise."""
    t = F.trim(text(c))
    return F.coalesce(*(F.try_to_date(t, f) for f in ("yyyy-MM-dd", "d.M.yyyy", "d/M/yyyy")))


def clean(c: Column | str) -> Column:
    """NUL out, tabs as spaces, at most two line ends in a row, trimmed."""
    return F.trim(F.regexp_replace(F.translate(text(c), "\t\x00", " "), r"\n{3,}", "\n\n"))


def strip_fences(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.trim(text(c)), r"^```[A-Za-z]*\s*|\s*```$", ""))
