"""Documents: chunks, sections, tables, sentiment, topics."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finweave.functions import constants as K
from finweave.functions import text as X
from finweave.operators.batches import bounded, slices


def described(rows: DataFrame) -> DataFrame:
    """Adds id, counts, flags, entities and neighbours to (document_id, chunk_index, text)."""
    t = F.col("text")
    w = Window.partitionBy("document_id").orderBy("chunk_index")
    r = rows.withColumns(
        {
            "chunk_id": X.chunk_id(F.col("document_id").cast("string"), F.col("chunk_index").cast("string"), t),
            "word_count": F.size(F.filter(F.split(t, r"\s+"), lambda x: x != "")),
            "char_count": F.length(t),
            "has_financial_data": X.has_any(t, K.FINANCIAL_WORDS),
            "has_risk_mention": X.has_any(t, K.RISK_WORDS),
            "has_forward_looking": X.has_any(t, K.FORWARD_WORDS),
            "entities": X.entities(t),
        }
    )
    return r.withColumns({"prev_chunk_id": F.lag("chunk_id").over(w), "next_chunk_id": F.lead("chunk_id").over(w)})


def chunks(docs: DataFrame, parts: Column) -> DataFrame:
    """One row per element of ``parts`` (an array over the document's columns)."""
    return described(docs.select("document_id", F.posexplode(parts).alias("chunk_index", "text")))


def packed(text: str, size: int = 1000, overlap: int = 200) -> list[str]:
    """Sentences packed greedily to ``size``; the next chunk opens with the
    longest run of last sentences within ``overlap``; a longer sentence stands alone."""
    parts = [s for s in (p.strip() for p in re.split(r"(?<=[.!?])\s+", text)) if s]
    out, cur = [], []
    for s in parts:
        if cur and sum(map(len, cur)) + len(cur) + len(s) > size:
            out.append(" ".join(cur))
            keep: list[str] = []
            while cur and sum(map(len, keep)) + len(cur[-1]) <= overlap:
                keep.insert(0, cur.pop())
            cur = keep if sum(map(len, keep)) + len(s) <= size else []
        cur.append(s)
    return out + [" ".join(cur)] if cur else out


def cut_by(docs: DataFrame, cut: Callable[[str], list[str]]) -> DataFrame:
    """Described chunks of (document_id, text) by a function of a text, which
    runs on slices of bounded size and gives its rows slice by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            parts = [cut(t or "") for t in b["text"].to_pylist()]
            n = np.array([len(p) for p in parts], np.int64)
            index = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([b["document_id"].take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(index, pa.int32()), pa.array([c for p in parts for c in p], pa.string())], names=["document_id", "chunk_index", "text"])

    kind = docs.schema["document_id"].dataType.simpleString()
    return described(bounded(docs).select("document_id", "text").mapInArrow(run, f"document_id {kind}, chunk_index int, text string"))


def sentence_chunks(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Greedy packing carries state from sentence to sentence, so it is a
    Python step over slices of documents."""
    return cut_by(docs.select("document_id", X.clean(F.col("text")).alias("text")), lambda t: packed(t, size, overlap))


def paragraph_chunks(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Whole paragraphs (parts between blank lines, trimmed) together while
    they have at most ``size`` characters; a longer one is cut by sentences.
    Texts without paragraphs give no row."""
    return cut_by(docs, lambda t: by_paragraph(t, size, overlap))


def by_paragraph(text: str, size: int, overlap: int) -> list[str]:
    out: list[str] = []
    open_: list[str] = []
    held = 0
    for part in filter(None, (p.strip() for p in text.split("\n\n"))):
        if open_ and held + len(part) > size:
            out.append("\n\n".join(open_))
            open_, held = [], 0
        if len(part) > size:
            out += packed(part, size, overlap)
        else:
            open_.append(part)
            held += len(part)
    return out + (["\n\n".join(open_)] if open_ else [])


#: What folded text holds of each pattern; patterns that begin with "item" are tried where that word is, others are searched if all their words are there.
_FOLDED = [(item, re.compile(p.replace("(?i)", ""))) for item, (_, p) in K.SECTIONS.items()]
_SEARCHED = [(item, re.compile(q, re.M), re.findall(r"(?:[a-z]|\\&)+", re.sub(r"\\[a-z]", " ", q))) for item, ps in K.SECTION_ALTERNATES.items() for q in (p.replace("(?i)", "") for p in ps)]
_SEARCHED = [(item, p, [w.replace("\\", "") for w in words]) for item, p, words in _SEARCHED]
_ODD = str.maketrans("\u0130\u0131\u017f", "iis")


def folded(text: str) -> str:
    """The text in lower case, place by place, as patterns that ignore case read it."""
    return (text if text.isascii() else text.translate(_ODD) if any(c in text for c in "\u0130\u0131\u017f") else text).lower()


def openings(text: str) -> set[tuple[int, str]]:
    """(start, item) of every place where an item opens."""
    low = folded(text)
    found = {(m.start(), item) for item, p, words in _SEARCHED if all(w in low for w in words) for m in p.finditer(low)}
    ends = [0] * len(_FOLDED)
    at = low.find("item")
    while at >= 0:
        for k, (item, p) in enumerate(_FOLDED):
            if at >= ends[k] and (m := p.match(low, at)):
                found.add((at, item))
                ends[k] = m.end()
        at = low.find("item", at + 1)
    return found


def find_sections(text: str, least: int = 100, most: int = 500_000) -> list[tuple[str, int, str]]:
    """(item, start, text) between the places where items open; short ones are
    left out; the last occurrence of an item counts."""
    found = sorted(openings(text))
    out = {}
    for i, (at, item) in enumerate(found):
        body = text[at : found[i + 1][0] if i + 1 < len(found) else len(text)].strip()
        if len(body) >= least:
            out[item] = (item, at, body[:most])
    return sorted(out.values(), key=lambda s: s[1])


def sections(docs: DataFrame) -> DataFrame:
    """document_id, item, title, start and text of a filing's items. Match
    positions are beyond SQL, so documents go through in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [(i, *s) for i, t in enumerate(b["text"].to_pylist()) for s in find_sections(t or "")]
            i, item, start, text = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([b["document_id"].take(pa.array(i, pa.int64())), pa.array(item, pa.string()), pa.array(start, pa.int64()), pa.array(text, pa.string())], names=["document_id", "item", "start", "text"])

    kind = docs.schema["document_id"].dataType.simpleString()
    titles = F.create_map(*[x for i, (t, _) in K.SECTIONS.items() for x in (F.lit(i), F.lit(t))])
    s = bounded(docs).select("document_id", "text").mapInArrow(run, f"document_id {kind}, item string, start long, text string")
    return s.withColumn("title", titles[F.col("item")])


def section_statistics(found: DataFrame) -> DataFrame:
    n = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    return found.select("document_id", "item", F.regexp_extract("item", r"(\d+)", 1).cast("int").alias("number"), n.alias("words"), F.length("text").alias("chars")).orderBy("document_id", "number", "item")


def summary(text: Column, most: int = 500) -> Column:
    """The first characters, cut after the last full stop if that is beyond 70 percent."""
    head = F.substring(text, 1, most)
    last = F.length(head) - F.locate(".", F.reverse(head)) + 1
    return F.when(F.length(text) <= most, text).when((F.locate(".", F.reverse(head)) > 0) & (last > most * 0.7), F.substring(head, F.lit(1), last)).otherwise(F.concat(head, F.lit("...")))


def text_tables(text: str) -> list[list[list[str]]]:
    """Tables in plain text: neighbouring lines of two numbers or more, parted
    at two blanks or tabs."""
    out, cur = [], []
    for line in [*text.split("\n"), ""]:
        if len(re.findall(r"\d[\d,.]*", line)) >= 2:
            cur.append([c.strip() for c in re.split(r"\s{2,}|\t+", line.strip()) if c.strip()])
        elif cur:
            out.append(cur)
            cur = []
    return out


def tables(docs: DataFrame) -> DataFrame:
    """document_id, table, row and cells of the tables found in texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, k, i, r) for d, t in zip(b["document_id"], b["text"], strict=True) for k, tab in enumerate(text_tables(t or "")) for i, r in enumerate(tab)]
            yield pd.DataFrame(rows, columns=["document_id", "table", "row", "cells"])

    kind = docs.schema["document_id"].dataType.simpleString()
    return docs.select("document_id", "text").mapInPandas(run, f"document_id {kind}, table int, row int, cells array<string>")


class _Tables(HTMLParser):
    """Cells of every table row of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[list[list[str]]] = []
        self.open: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open:
            if not self.open[-1]:
                self.open[-1].append([])
            self.cell = []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None and self.open:
            self.open[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "table" and self.open:
            self.found.append([r for r in self.open.pop() if r])


def html_tables(html: str) -> list[list[list[str]]]:
    p = _Tables()
    p.feed(html)
    p.close()
    return [t for t in p.found if t]


def page_tables(pages: DataFrame) -> DataFrame:
    """document_id, table, row and cells of the tables of pages (document_id, text: HTML)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, k, i, r) for d, t in zip(b["document_id"], b["text"], strict=True) for k, tab in enumerate(html_tables(t or "")) for i, r in enumerate(tab)]
            yield pd.DataFrame(rows, columns=["document_id", "table", "row", "cells"])

    kind = pages.schema["document_id"].dataType.simpleString()
    return pages.select("document_id", "text").mapInPandas(run, f"document_id {kind}, table int, row int, cells array<string>")


def numeric(cell: Column) -> Column:
    """A cell as a number: $ , % dropped, brackets mean minus; null if it is none."""
    return F.replace(F.translate(cell, "$,%) ", ""), F.lit("("), F.lit("-")).try_cast("double")


def figures(docs: DataFrame) -> DataFrame:
    """Revenue, net income, earnings per share and gross margin told in a text."""
    return docs.select("document_id", *[X.amount(F.col("text"), p).alias(n) for n, p in X.FIGURES.items()])


def sentiment(docs: DataFrame) -> DataFrame:
    return docs.select("document_id", *[e.alias(n) for n, e in X.sentiment(F.col("text")).items()])


def document_sentiment(sections_: DataFrame) -> DataFrame:
    """Per document over its sections (document_id, position, text): mean,
    spread and trend of the overall score."""
    s = sections_.withColumn("score", X.sentiment(F.col("text"))["overall"])
    return s.groupBy("document_id").agg(F.avg("score").alias("mean_sentiment"), F.stddev_pop("score").alias("volatility"), F.regr_slope("score", F.col("position").cast("double")).alias("trend"), F.count(F.lit(1)).alias("sections"))


def risky_sentences(docs: DataFrame, words: tuple[str, ...] = K.RISK_INDICATORS, most: int = 10) -> DataFrame:
    """The first sentences of 20 to 500 characters that hold a word."""
    hit = F.filter(X.sentences(F.col("text")), lambda s: X.has_any(s, words) & (F.length(s) > 20) & (F.length(s) < 500))
    return docs.select("document_id", F.posexplode(F.slice(hit, 1, most)).alias("position", "sentence"))


def key_entities(docs: DataFrame, most: int = 10) -> DataFrame:
    """The most common names of the corpus with their share."""
    e = docs.select(F.explode(X.title_entities(F.col("text"))).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("mentions"))
    total = e.agg(F.sum("mentions").alias("total"))
    return e.orderBy(F.desc("mentions"), "entity").limit(most).crossJoin(F.broadcast(total)).select("entity", "mentions", (F.col("mentions") / F.col("total")).alias("share"))


def term_words(text: Column) -> Column:
    """Words of three characters or more: runs of letters, digits and underscores, in lower case."""
    return F.filter(F.transform(F.split(text, X.NO_WORD), F.lower), lambda w: F.length(w) > 2)


def word_pairs(words: Column) -> Column:
    """Neighbours among the words; null where one of them is null."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


#: Words that pairs are looked for among; where more are tied at the last place, all pairs are counted.
TIED = 10_000


def common_words(docs: DataFrame, most: int) -> list[str] | None:
    """The words that may be in one of the ``most`` most common terms of
    (words), None for all words: a pair is at most as common as either of its
    words, so these are the words as common as the last of the ``most`` best."""
    counts = docs.select(F.explode("words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).cache()
    best = counts.orderBy(F.desc("n"), "term").limit(most).collect()
    least = best[-1]["n"] if len(best) == most else 1
    found = [r["term"] for r in counts.filter(F.col("n") >= least).select("term").limit(TIED + 1).collect()]
    counts.unpersist()
    return found if len(found) <= TIED else None


def with_terms(docs: DataFrame, among: list[str] | None) -> DataFrame:
    """terms: words and pairs of neighbours that hold no other words than these."""
    d = docs.select((F.transform("words", lambda w: F.when(w.isin(among), w)) if among is not None else F.col("words")).alias("kept"))
    terms = F.filter(F.concat("kept", word_pairs(F.col("kept"))), lambda t: t.isNotNull())
    return d.select(F.coalesce(terms, F.array().cast("array<string>")).alias("terms"))


def common_terms(terms: DataFrame, most: int) -> list[str]:
    """The most common of (terms), ties by name."""
    counts = terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return [r["term"] for r in counts.orderBy(F.desc("n"), "term").limit(most).collect()]


def topics(docs: DataFrame, k: int = 10, vocabulary: int = 100, terms: int = 5, rounds: int = 10) -> DataFrame:
    """Topics of the corpus: counts of one- and two-word terms, LDA.

    Texts are read twice, for the words and for the terms that may be in the
    vocabulary. The terms and then their counts are kept, in memory or on disk:
    rounds go over the counts, not over texts."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizerModel

    d = docs.select(term_words(F.col("text")).alias("words"))
    held = with_terms(d, common_words(d, vocabulary)).persist(StorageLevel.DISK_ONLY)
    names = common_terms(held, vocabulary)
    cv = CountVectorizerModel.from_vocabulary(names, inputCol="terms", outputCol="features")
    counts = cv.transform(held).select("features").persist(StorageLevel.MEMORY_AND_DISK)
    found = LDA(k=k, seed=42, maxIter=rounds).fit(counts).describeTopics(terms)
    counts.unpersist()
    held.unpersist()
    return found.select("topic", F.transform("termIndices", lambda i: F.get(F.array(*[F.lit(v) for v in names]), i)).alias("terms"), F.col("termWeights").alias("weights"))
