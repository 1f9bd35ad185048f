"""What built-in functions cannot express, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import html
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TO_ASCII = str.maketrans("äöüõšž", "aouosz")


@F.pandas_udf(T.StringType())
def fold_exact(s: pd.Series) -> pd.Series:
    """As text.fold, with every compatibility decomposition."""

    def one(x):
        plain = unicodedata.normalize("NFKD", (x or "").lower().translate(TO_ASCII)).encode("ascii", "ignore").decode()
        return re.sub("[^a-z0-9]+", " ", plain).strip()

    return s.map(one)


def alike(a: str, b: str) -> int:
    """Characters of the longest common stretch (the first one in a, then in b), and of what is alike before and behind it."""
    if not a or not b:
        return 0
    ends, longest, at = [0] * (len(b) + 1), 0, (0, 0)
    for i, x in enumerate(a, 1):
        last = 0
        for j, y in enumerate(b, 1):
            # ends[j]: the common stretch that ends before i and at j; last: the one before it.
            last, ends[j] = ends[j], last + 1 if x == y else 0
            if ends[j] > longest:
                longest, at = ends[j], (i, j)
    if not longest:
        return 0
    i, j = at
    return longest + alike(a[: i - longest], b[: j - longest]) + alike(a[i:], b[j:])


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two strings: twice what is alike over both lengths; 1 for two empty ones."""
    return pd.Series([2.0 * alike(x or "", y or "") / ((len(x or "") + len(y or "")) or 1) if x or y else 1.0 for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StringType())
def html_text(s: pd.Series) -> pd.Series:
    """Text of an HTML page: script, style, comments and tags dropped, entities resolved, white space squeezed."""
    hidden = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.S | re.I)

    def one(x):
        plain = html.unescape(re.sub(r"<[^>]+>", " ", hidden.sub(" ", x or ""))).replace(" ", " ")
        return re.sub(r"\n{2,}", "\n", re.sub(r" *\n *", "\n", re.sub(r"[ \t\r\f\v]+", " ", plain))).strip()

    return s.map(one)


@F.pandas_udf(T.StringType())
def first_json(s: pd.Series) -> pd.Series:
    """The first decodable JSON object or array in a text, as compact JSON; null where there is none."""
    decoder = json.JSONDecoder()

    def one(x):
        for m in re.finditer(r"[\[{]", x or ""):
            try:
                return json.dumps(decoder.raw_decode(x, m.start())[0], ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                continue
        return None

    return s.map(one)
