"""Text expressions: cleaning, sentences, chunks, flags, entities, lexicons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from finweave.functions import constants as K
from finweave.functions.num import div


def clean(text: Column) -> Column:
    """White space collapsed (also U+00A0), "Page n of m" dropped, trimmed."""
    t = F.regexp_replace(text, r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(t, r"Page \d+ of \d+", ""))


def clean_filing(text: Column) -> Column:
    """Lone page numbers, page marks and dot leaders dropped; blank lines kept to one."""
    t = F.regexp_replace(text, r"(?m)^[ \t]*\d+[ \t]*$", "")
    t = F.regexp_replace(t, r"(?i)page \d+ of \d+", "")
    t = F.regexp_replace(t, r"\.{5,}", "")
    t = F.regexp_replace(t, r"(?U)[^\S\n]+", " ")
    return F.trim(F.regexp_replace(t, r"\n\s*\n\s*", "\n\n"))


#: A run of what is in no word. Its letters are listed for speed alone: they are the first test.
NO_WORD = r"(?U)[^a-zA-Z\w]+"


def plain_words(text: Column) -> Column:
    """Everything but letters, digits and underscores as single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def sentences(text: Column) -> Column:
    """Parts after [.!?] and white space, trimmed, empty ones dropped."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) > 0)


def merged(parts: Column, least: int = 50) -> Column:
    """Neighbours joined while together they are shorter than ``least``."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, s: Column) -> Column:
        fits = F.length(acc["cur"]) + F.length(s) < least
        return F.when(acc["cur"] == "", F.struct(acc["done"].alias("done"), s.alias("cur"))).when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["cur"], F.lit(" "), s).alias("cur"))).otherwise(F.struct(F.array_append(acc["done"], acc["cur"]).alias("done"), s.alias("cur")))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["cur"])))


def windows(text: Column, size: int = 1200, overlap: int = 200) -> Column:
    """Character windows of ``size``, each ``size - overlap`` after the last."""
    at = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(F.length(text) > 0, F.transform(at, lambda i: F.substring(text, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def word_windows(text: Column, size: int = 512, overlap: int = 0) -> Column:
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    at = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(size - overlap))
    return F.when(F.size(words) > 0, F.transform(at, lambda i: F.array_join(F.slice(words, i, F.lit(size)), " "))).otherwise(F.array().cast("array<string>"))


def sliding(parts: Column, width: int = 3, stride: int = 1) -> Column:
    """Windows of ``width`` sentences; one short window if there are fewer."""
    n = F.size(parts)
    at = F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1)), F.lit(stride))
    return F.when(n > 0, F.transform(at, lambda i: F.array_join(F.slice(parts, i, F.lit(width)), " "))).otherwise(F.array().cast("array<string>"))


def chunk_id(document: Column, index: Column, text: Column) -> Column:
    return F.concat(F.lit("chunk_"), F.substring(F.md5(F.concat_ws("_", document, index, F.substring(text, 1, 100))), 1, 12))


def doc_id(text: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.md5(text), 1, 12))


def has_any(text: Column, words: Sequence[str]) -> Column:
    """Any of the words as part of the lower-case text."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def present(text: Column, words: Sequence[str]) -> Column:
    """How many different words are there."""
    low = F.lower(text)
    return reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in words])


def per_hundred(text: Column, words: Sequence[str]) -> Column:
    """Different words present, per hundred words of the text."""
    return F.coalesce(div(present(text, words) * 100, F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))), F.lit(0.0))


def entities(text: Column) -> Column:
    """Up to five dollar amounts, five percents and three years."""
    money = F.slice(F.regexp_extract_all(text, F.lit(r"\$[\d,]+(?:\.\d+)?(?:\s*(?:million|billion|thousand))?"), F.lit(0)), 1, 5)
    percent = F.slice(F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?%"), F.lit(0)), 1, 5)
    years = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b20\d{2}\b"), F.lit(0)))), 1, 3)
    return F.concat(money, percent, years)


def amount(text: Column, pattern: str) -> Column:
    """The first number that a pattern's group 1 finds, times what its match says."""
    hit = F.regexp_extract(text, pattern, 0)
    n = F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit("")).try_cast("double")
    low = F.lower(hit)
    return n * F.when(low.contains("billion"), 1e9).when(low.contains("million"), 1e6).otherwise(1.0)


_MONEY = r"\D{0,30}?\$?\s?([\d,]+(?:\.\d+)?)(?:\s*(?:million|billion))?"
#: Patterns of figures told in prose.
FIGURES = {
    "revenue": r"(?i)(?:total\s+)?(?:revenue|sales)" + _MONEY,
    "net_income": r"(?i)net\s+(?:income|earnings|profit)" + _MONEY,
    "eps": r"(?i)earnings\s+per\s+share" + _MONEY,
    "gross_margin": r"(?i)gross\s+margin\D{0,30}?([\d.]+)\s*%",
}


def strip_html(html: Column) -> Column:
    """Visible text of a simple page: scripts, styles and tags dropped, basic
    entities resolved."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "\n")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"\s*\n\s*", "\n"))


def sentiment(text: Column) -> dict[str, Column]:
    """Lexicon scores of a text: positive, negative, uncertainty per hundred
    words, overall in -1..1 and its label."""
    pos, neg = present(text, K.POSITIVE), present(text, K.NEGATIVE)
    overall = F.coalesce(div(pos - neg, pos + neg), F.lit(0.0))
    return {
        "positive": per_hundred(text, K.POSITIVE),
        "negative": per_hundred(text, K.NEGATIVE),
        "uncertainty": per_hundred(text, K.UNCERTAIN),
        "overall": overall,
        "label": F.when(overall > 0.1, "positive").when(overall < -0.1, "negative").otherwise("neutral"),
        "risk_mentions": present(text, K.RISK_INDICATORS),
        "opportunities": present(text, K.OPPORTUNITIES),
    }


def title_entities(text: Column) -> Column:
    """Runs of two or more capitalised words: a stand-in for a name tagger."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\b\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+"), F.lit(0))
