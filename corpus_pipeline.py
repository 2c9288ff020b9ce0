"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
documents. ``run`` writes every stage's result to the shared folder and reads
it back for the next, so a lost executor repeats a task and not the stages;
what a stage has read and written on the way is deleted then.

All stages take rows with nulls in any column, empty and very long texts,
repeated rows, empty tables and more columns of any name, which pass through
up to the last stage. Null texts count as empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finweave.llm import mixing, near, packing, pii, queries, shared, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; empty texts do, repeated rows score alike, and without labels all do."""
    return toxicity.accepted(docs, queries.table(spark, sf_dir, "labels"), least=0.7, most=12_000)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least doc_id (null ones last), then the least text hash. Empty texts are one group."""
    return near.deduplicated(docs, least=0.8)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms in the texts; n_chars follows. Null texts stay null."""
    return pii.pseudonymise(docs, pii.session_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources say; a null source is one of its own."""
    return mixing.mix(docs, weights=(5, 2, 1), most=3.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens; an empty text is its end id, documents that come more than once have pieces each time."""
    return packing.pack_documents(docs, queries.WORD_BPE, end_id=0, capacity=2048)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", replace_personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]
#: Scores, near copies and tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = queries.table(spark, sf_dir, "documents"), shared.written()
    for name, stage in STAGES:
        docs = shared.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        shared.forget(spark, since)
    return docs
