"""Keyed writes as frames: replace, ignore, update, delete, and files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def replace(old: DataFrame, new: DataFrame, keys: Sequence[str], last: Sequence[Column]) -> DataFrame:
    """INSERT OR REPLACE: rows of ``new`` win, of those that agree in the key
    the last by ``last``. Anti join and dedupe of the batch: the old table is
    shuffled once and not sorted."""
    batch = once(new, keys, last)
    return old.join(batch, list(keys), "left_anti").unionByName(batch.select(*old.columns))


def once(rows: DataFrame, keys: Sequence[str], last: Sequence[Column]) -> DataFrame:
    """One row of each key: the last by the order."""
    by = Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in last])
    return rows.withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n")


def ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], first: Sequence[Column]) -> DataFrame:
    """INSERT OR IGNORE: keys that are there stay; of a batch the first."""
    by = Window.partitionBy(*keys).orderBy(*[c.asc_nulls_last() for c in first])
    batch = new.withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n")
    return old.unionByName(batch.join(old, list(keys), "left_anti").select(*old.columns))


def update(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str], last: Sequence[Column]) -> DataFrame:
    """ON CONFLICT DO UPDATE of some columns; new keys are appended."""
    batch = once(new, keys, last)
    o, n = old.alias("o"), batch.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    there = F.col(f"o.{keys[0]}").isNotNull()
    arrived = F.col(f"n.{keys[0]}").isNotNull()
    out = [F.when(arrived & there & F.lit(c in columns) | ~there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns]
    return o.join(n, on, "full_outer").select(*out)


def delete(old: DataFrame, keys: DataFrame) -> DataFrame:
    return old.join(keys, keys.columns, "left_anti")


def to_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    """Chunks as a store takes them: defaults for missing fields, JSON metadata."""
    text = ("document_id", "section", "ticker")
    cols = {c: F.coalesce(F.col(c), F.lit("")) for c in text if c in chunks.columns}
    cols |= {c: F.coalesce(F.col(c), F.lit(0)) for c in ("fiscal_year", "chunk_index", "word_count") if c in chunks.columns}
    filled = chunks.withColumns(cols)
    return filled.withColumn("metadata", F.to_json(F.struct(*[c for c in filled.columns if c not in ("chunk_id", "text")])))


def export_embeddings(store: DataFrame, path: str) -> None:
    """Document, metadata as JSON and embedding, as Parquet."""
    meta = [c for c in store.columns if c not in ("text", "embedding")]
    to_parquet(store.select(F.col("text").alias("document"), F.to_json(F.struct(*meta)).alias("metadata"), "embedding"), path)
