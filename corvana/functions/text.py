"""Text normalisation as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvana.functions.constants import COMPOUNDS, STOPWORDS, VIETNAMESE

_NFC = None


def nfc(col: Column | str) -> Column:
    """Unicode NFC (Spark has no built-in form); null stays null. Arrow-batched."""
    global _NFC
    if _NFC is None:

        @F.pandas_udf("string")
        def compose(s: pd.Series) -> pd.Series:
            return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x), na_action="ignore")

        _NFC = compose
    return _NFC(col)


def match_form(col: Column | str) -> Column:
    """The form in which names and phrases are compared: lower case, signs to spaces, white space unified. Expects NFC."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def without_urls(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)https?://\S+|www\.\S+", "")


def without_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def feed_text(c: Column) -> Column:
    """Feed HTML to text: tags on one line removed (shortest first), common entities replaced, trimmed."""
    t = F.regexp_replace(c, "<.*?>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(t)


def without_symbols(c: Column) -> Column:
    """Delete all but word characters, white space, common punctuation."""
    return F.regexp_replace(c, r"""(?U)[^\w\s,.:;!?()\-+='"/\\]""", "")


def plain_letters(c: Column, keep_upper: bool = False) -> Column:
    """Signs to single spaces. By default capital letters with marks (but Đ) are taken for signs, as before lower-casing."""
    more = VIETNAMESE.upper() if keep_upper else ""
    return F.trim(F.regexp_replace(F.regexp_replace(c, rf"[^a-zA-Z0-9\s_đĐ{VIETNAMESE}{more}]", " "), r"\s+", " "))


def without_stopwords(c: Column, words: frozenset[str] = STOPWORDS) -> Column:
    stop = F.array(*[F.lit(w) for w in sorted(words)])
    return F.array_join(F.filter(F.split(F.trim(c), r"\s+"), lambda w: ~F.array_contains(stop, F.lower(w)) & (w != "")), " ")


def cleaned(c: Column, drop_stopwords: bool = True) -> Column:
    """URLs, tags, symbols and signs removed, lower case, stop words dropped; blank becomes null. Expects NFC."""
    t = F.lower(plain_letters(without_symbols(without_tags(without_urls(c)))))
    t = without_stopwords(t) if drop_stopwords else t
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.when(t != "", t)


def compounds(c: Column, phrases: tuple[str, ...] = COMPOUNDS) -> Column:
    """Longest-first joining of known compounds by '_', left to right. One alternation, longest phrases first, on word ends."""
    ordered = sorted(phrases, key=lambda p: (-len(p.split()), p))
    quoted = "|".join("\\Q" + p + "\\E" for p in ordered)
    marked = F.regexp_replace(F.lower(F.trim(c)), rf"(?<![^\s])({quoted})(?![^\s])", "\u0001$1\u0002")
    pieces = F.split(marked, "\u0002")
    joined = F.transform(pieces, lambda p: F.when(F.instr(p, "\u0001") > 0, F.concat(F.substring_index(p, "\u0001", 1), F.replace(F.substring_index(p, "\u0001", -1), F.lit(" "), F.lit("_")))).otherwise(p))
    return F.array_join(joined, "")


def query_cleaned(c: Column, words: frozenset[str] = STOPWORDS) -> Column:
    """A question as search words: lower case, compounds held together while stop words go. Expects NFC."""
    return F.replace(without_stopwords(compounds(c), words), F.lit("_"), F.lit(" "))


def label(c: Column, labels: dict[str, str], default: str) -> Column:
    m = F.create_map(*[F.lit(v) for kv in labels.items() for v in kv])
    return F.when(c.isNull() | (c == ""), F.lit(default)).otherwise(F.coalesce(m[F.upper(F.trim(c))], F.trim(c)))


def preview(c: Column, n: int = 200) -> Column:
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def content_hash(title: Column, content: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(content, F.lit(""))), 256)
