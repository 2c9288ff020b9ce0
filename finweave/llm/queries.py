"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finweave.llm import ann, chat, languages, media, middle, mixing, near, packing, pii, repair, secrets, tokens, toxicity

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3.0).select("doc_id", "size", "source_size", "target", "taken")


def op2_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), media.padded(F.col("text")).alias("payload"))
    stored = media.encode(docs).drop("payload")
    return media.digest(media.decode(stored))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"), least=0.8)


def op5_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotations(table(spark, sf_dir, "conversations"))


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), pii.session_key(spark)).select("doc_id", "text", "n_replaced")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), least=0.7, most=12_000)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents")).drop("spans_found")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE, end_id=0, capacity=2048).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokens.write_token_files(table(spark, sf_dir, "documents"), WORD_BPE, end_id=2)
    return tokens.read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digest(repair.repaired(table(spark, sf_dir, "conversations")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digest(middle.fill_in_middle(table(spark, sf_dir, "documents"), seed=7, rate=100, spm=50))


def op13_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identified(table(spark, sf_dir, "documents"), most=6_000).drop("runs")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_transport_streams": op2_transport_streams,
    "op3_near_duplicates": op3_near_duplicates,
    "op5_nearest_vectors": op5_nearest_vectors,
    "op6_perspectives": op6_perspectives,
    "op7_pseudonyms": op7_pseudonyms,
    "op9_toxicity": op9_toxicity,
    "op10_secrets": op10_secrets,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op8_token_files": op8_token_files,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_languages": op13_languages,
}
ORACLES: dict[str, str] = {
    "op1_mix_sources": mixing.SQL,
    "op6_perspectives": chat.SQL,
    "op11_conversation_repair": repair.SQL,
    "op12_fill_in_middle": middle.SQL,
}
