"""Incremental build of a passage index, by ticker and year.

Below the root are ``chunks`` and ``manifest``, both partitioned by ticker and
fiscal year. A build compares content hashes with the manifest and writes the
partitions that differ; chunks come first, the manifest after, so a build that
is cut off is made good by the next one. Building again writes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finweave.functions import text as X

PARTITION = ["ticker", "fiscal_year"]
CHUNKS = "document_id string, content string, chunk_index int, chunk_id string, text string, ticker string, fiscal_year int"
MANIFEST = "document_id string, content string, chunks long, settings string, ticker string, fiscal_year int"


@dataclass(frozen=True)
class Index:
    """``root`` is a folder that all executors see."""

    root: str
    size: int = 1200
    overlap: int = 200

    @property
    def settings(self) -> str:
        return f"{self.size}/{self.overlap}"

    def _read(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        try:
            spark.read.parquet(f"{self.root}/{name}")
        except AnalysisException:  # not built yet
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def manifest(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "manifest", MANIFEST)

    def chunks(self, spark: SparkSession) -> DataFrame:
        """Passages of the documents that the manifest names, no others: what a
        build that was cut off has left is not seen."""
        known = self.manifest(spark).filter("document_id is not null").select(*PARTITION, "document_id", "content")
        return self._read(spark, "chunks", CHUNKS).join(known, [*PARTITION, "document_id", "content"], "left_semi")

    def pending(self, filings: DataFrame) -> DataFrame:
        """ticker, fiscal_year of partitions that a build would write: with a
        new or changed document, or one that the filings of the partition no
        longer hold. Partitions of which ``filings`` has nothing stay as they are."""
        spark = filings.sparkSession
        there = self.manifest(spark).select(*PARTITION, "document_id", "content", "settings")
        here = hashed(filings).withColumn("settings", F.lit(self.settings)).select(there.columns).distinct()
        both = here.withColumn("side", F.lit(1)).unionByName(there.withColumn("side", F.lit(2)))
        each = both.groupBy(*there.columns).agg(F.sum("side").alias("side"))
        return each.groupBy(*PARTITION).agg(F.max(F.col("side") % 2).alias("mine"), F.max((F.col("side") != 3).cast("int")).alias("differs")).filter("mine = 1 and differs = 1").select(*PARTITION)

    def build(self, filings: DataFrame) -> int:
        """Brings the index up to (ticker, fiscal_year, document_id, text);
        how many partitions were written. Of documents that are there twice in
        a partition that of the least hash counts; null texts have no passages;
        rows without ticker, year or id are left out."""
        spark = filings.sparkSession
        todo = self.pending(filings).cache()
        n = todo.count()
        if n:
            docs = hashed(filings).join(todo, PARTITION, "left_semi")
            made = docs.select("document_id", "content", F.posexplode(X.windows(F.col("text"), self.size, self.overlap)).alias("chunk_index", "text"), *PARTITION)
            made = made.withColumn("chunk_id", X.chunk_id(F.col("document_id"), F.col("chunk_index"), F.col("text"))).select([c.split()[0] for c in CHUNKS.split(", ")])
            counts = F.size(X.windows(F.col("text"), self.size, self.overlap)).cast("long")
            rows = docs.select("document_id", "content", F.coalesce(counts, F.lit(0)).alias("chunks"), F.lit(self.settings).alias("settings"), *PARTITION)
            for frame, name in ((made, "chunks"), (rows, "manifest")):
                frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITION).parquet(f"{self.root}/{name}")
        todo.unpersist()
        return n


def hashed(filings: DataFrame) -> DataFrame:
    """One row of each (ticker, fiscal_year, document_id), with the hash of its text."""
    rows = filings.select(F.col("ticker").cast("string"), F.col("fiscal_year").cast("int"), F.col("document_id").cast("string"), F.coalesce("text", F.lit("")).alias("text")).na.drop(subset=[*PARTITION, "document_id"])
    return rows.withColumn("content", F.sha2("text", 256)).groupBy(*PARTITION, "document_id").agg(F.min_by("text", "content").alias("text"), F.min("content").alias("content"))
