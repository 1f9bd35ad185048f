"""Column functions: the four normalisers, tokens, suffixes, claims, quantities, ids and dates."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.functions import python as py
from lodestone.functions import text as t

CASES = [
    (t.fold, "Õigus ÄRA  3² Straße é", "oigus ara 32 strae e"),
    (t.fold, None, ""),
    (t.casefold, "  Straße\n\tÕun ", "strasse õun"),
    (t.evidence_form, "<b>„Tere”</b> &amp; –  Aeg", '"tere" & - aeg'),
    (t.record_id, " vos_ 3b2-x ", "VOS_3B2X"),
    (t.canonical_id, " av ts_1 ", "AVTS_1"),
    (t.tokens, "A bc, déf bc 7", ["bc", "def", "bc"]),
    (t.content_tokens, "kui voib Leping 2024 leping", ["leping", "leping"]),
    (t.claims, "Esimene. Teine lause! kolmas\nÜks 2. Kaks", ["Esimene.", "Teine lause! kolmas", "Üks 2.", "Kaks"]),
    (t.cited_ids, "x [ vos_3 ] y [VOS_3] [TLS_54B2] [no]", ["VOS_3", "TLS_54B2"]),
    (t.quantities, "Kahe kuu, 12,5% ja üks ning 12,5%", ["kaks", "12,5%", "üks"]),
    (t.canonical_section, "§ 3²", "3B2"),
    (t.canonical_section, "12 a.", "12A"),
    (t.canonical_section, "lg 3", None),
    (t.section_heading, "X § 12. Pealkiri siin. Muu", "Pealkiri siin"),
    (t.strip_fences, '```json\n{"a":1}\n```', '{"a":1}'),
    (t.sentences, "Üks kaks kolm. Neli viis.\nKuus seitse kaheksa", ["Üks kaks kolm.", "Kuus seitse kaheksa"]),
]


@pytest.mark.parametrize("case", CASES, ids=[f"{f.__name__}-{k}" for k, (f, _, _) in enumerate(CASES)])
def test_text(spark, case):
    f, given, wanted = case
    assert spark.createDataFrame([(given,)], "x string").select(f("x").alias("y")).first()["y"] == wanted


def test_more(spark):
    one = spark.createDataFrame([("lepingutest", "leping", "31.1.2024", "2024-02-30")], "a string, b string, c string, d string")
    row = one.select(
        t.suffix_variants(F.col("a")).alias("v"), t.char_ngrams(F.col("b")).alias("g"), t.jaccard(t.char_ngrams(F.col("a")), t.char_ngrams(F.col("b"))).alias("j"),
        t.parse_date("c").alias("c"), t.parse_date("d").alias("d"), py.sequence_ratio(F.lit("abipoliteinuku"), F.lit("abipolitseiniku")).alias("r"),
        py.first_json(F.lit('so {bad} then {"a": [1]} end')).alias("json"), py.html_text(F.lit("<p>A&amp;B<script>x</script></p><!-- c -->")).alias("html"), py.fold_exact(F.lit("ﬁ 3² õ")).alias("fold"),
    ).first()
    assert row["v"] == ["lepingu", "lepingute", "lepingutes"]
    assert row["g"] == ["lep", "epi", "pin", "ing"] and round(row["j"], 3) == round(4 / 9, 3)
    assert str(row["c"]) == "2024-01-31" and row["d"] is None
    assert round(row["r"], 4) == 0.8966
    assert row["json"] == '{"a":[1]}' and row["html"] == "A&B" and row["fold"] == "fi 32 o"
