"""A small documents table with every awkward case."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, key string, score string, rank int, first int"
BASE = "the quick brown fox jumps over the lazy dog while seven quiet wizards watch from a distant hill and count the passing clouds before night falls on the old stone bridge near town"


def rows():
    long_ = " ".join(f"word{i % 977} plain{i % 31}" for i in range(40_000))
    out = [
        (0, BASE, "en", "a"),
        (1, BASE, "en", "a"),
        (1, BASE, "en", "a"),
        (2, BASE.replace("quick", "rapid"), "en", "b"),
        (3, None, "en", "b"),
        (4, "", None, None),
        (5, "   \n\t ", "de", None),
        (6, "one", "en", "c"),
        (7, "one two three four", "en", "c"),
        (None, "a text without an id but with words enough to count as one", "en", "a"),
        (8, long_, "fr", "a"),
        (9, "Größe ÄÖÜ été \U0001f600 <|endoftext|> 123 4.5%", "de", "c"),
        (10, " x y\x1cz", "es", "c"),
    ]
    return [(*r, len(r[1] or ""), "extra", "extra", "extra", 1, 1) for r in out]


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
