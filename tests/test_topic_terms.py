"""Topics: the vocabulary of whole texts against plain counts, and how often texts are read."""

from __future__ import annotations

from collections import Counter

import pytest
import regex
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizerModel, NGram
from pyspark.sql import functions as F

from finweave.functions import text as X
from finweave.operators import text
from finweave.plans import texts as plan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return plan.documents(spark, SF).select("document_id", "text").cache()


def vocabulary(texts, most):
    seen = Counter()
    for t in texts:
        words = [w for w in regex.sub(r"[^\w\s]", " ", t or "").lower().split() if len(w) > 2]
        seen.update(words)
        seen.update(map(" ".join, zip(words, words[1:], strict=False)))
    return [t for t, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0].encode()))[:most]]


def terms(docs, most):
    d = docs.select(text.term_words(F.col("text")).alias("words"))
    return text.common_terms(text.with_terms(d, text.common_words(d, most)), most)


def test_terms_of_whole_texts(spark, docs, monkeypatch):
    want = vocabulary([r["text"] for r in docs.collect()], 300)
    assert terms(docs, 300) == want
    monkeypatch.setattr(text, "TIED", 3)
    assert terms(docs, 300) == want


def test_awkward_texts(spark):
    rows = ["the cat, the cat!\tthe cat", "", None, "Été été_1 don't", "one", "cat the cat"]
    docs = spark.createDataFrame([(t,) for t in rows], "text string")
    assert terms(docs, 4) == vocabulary(rows, 4) and terms(docs, 99) == vocabulary(rows, 99)


def test_topics_equal_those_of_all_terms(spark, docs):
    got = [(r["topic"], r["terms"], pytest.approx(r["weights"])) for r in text.topics(docs, rounds=3).orderBy("topic").collect()]
    names = vocabulary([r["text"] for r in docs.collect()], 100)
    d = docs.select(F.filter(F.split(F.lower(X.plain_words(F.col("text"))), " "), lambda w: F.length(w) > 2).alias("words"))
    d = NGram(n=2, inputCol="words", outputCol="pairs").transform(d).withColumn("terms", F.concat("words", "pairs"))
    found = LDA(k=10, seed=42, maxIter=3).fit(CountVectorizerModel.from_vocabulary(names, inputCol="terms", outputCol="features").transform(d)).describeTopics(5)
    assert [(r["topic"], [names[i] for i in r["termIndices"]], r["termWeights"]) for r in found.orderBy("topic").collect()] == got


def test_rounds_do_not_read_texts(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(t):
        read.add(1)
        return t

    docs = spark.range(40).select(F.col("id").alias("document_id"), seen(F.lit("rates rose again while banks lent less")).alias("text"))
    text.topics(docs, k=2, rounds=1).collect()
    once = read.value
    text.topics(docs, k=2, rounds=8).collect()
    assert read.value == 2 * once
