"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finweave.llm.shared import free, join_same, materialise, prefix_sum

#: Sources up to which their targets are sent to all executors.
BROADCAST_SOURCES = 100_000
#: Equally spaced offsets of which a source takes the one that comes nearest.
OFFSETS = 32
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of maximal runs of non-blank characters; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def stratum(size: Column) -> Column:
    """A size rounded down to its ten leading bits: keeps the order of sizes
    and has at most 512 values an octave."""
    low = F.greatest(F.lit(0), F.length(F.bin(size)) - 10)
    return (F.floor(size / F.pow(F.lit(2.0), low)) * F.pow(F.lit(2.0), low)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """source, source_size → target: the share by weight of all sizes, at most
    ``most`` times the source's size, the excess reshared by weight.

    Resharing ends where every source has least(most * size, weight * level);
    taken in order of most * size / weight, a source is at its cap if the
    level among it and all later ones exceeds that quotient. Running sums give
    it without a loop. The frame has one row per source.
    """
    cyc = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("w", F.element_at(cyc, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_quotient = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumn("capped", F.col("cap") * F.sum("w").over(by_quotient) <= left * F.col("w"))
    free = lambda x: F.when(~F.col("capped"), x).otherwise(F.lit(0.0))
    rest = F.sum("source_size").over(whole).cast("double") - F.sum(F.col("cap") - free(F.col("cap"))).over(whole)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(rest * F.col("w") / F.sum(free(F.col("w"))).over(whole))
    return s.select("source", "source_size", target.alias("target"))


def plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: str = "mix") -> DataFrame:
    """doc_id, source, digest (md5 of the text), size, source_size, target,
    copies and taken (copies * size) of every row.

    Each document is expected target / source_size times; these expectations
    are summed up within the source, small sizes first (so that each size gets
    its share and the taken words stay near the target), one offset in [0, 1)
    is added, and a document is emitted once for each integer its interval
    crosses. A few long documents can carry a small source away from its
    target, so the offset is one of OFFSETS equally spaced ones (shifted by
    a random part that depends on seed and source): that with which the taken
    words come nearest. Null texts have size 0, the null
    source comes last, sources without words have target 0 and no copies. Rows
    that repeat are placed one by one. Doc_ids that are null share a bucket
    with each other only.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"), words(F.col("text")).alias("size"), F.substring(key, 1, 2).alias("bucket"))
    rows = materialise(rows, "sizes").withColumn("stratum", stratum(F.col("size"))).withColumn("one", F.lit(1).cast("long"))
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    ranked = prefix_sum(rows, ["source"], ["stratum", "bucket"], [F.col("doc_id"), F.col("size"), F.col("digest")], "one", "rank")
    goal = materialise(goal, "targets")
    few = goal.count() <= BROADCAST_SOURCES
    met = join_same(ranked, F.broadcast(goal) if few else goal, ["source"])
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    shift = F.conv(F.substring(F.md5(F.concat(F.coalesce("source", F.lit("")), F.lit(f":{seed}"))), 1, 3), 16, 10).cast("double") / 4096
    met = materialise(met.select("doc_id", "source", "digest", "size", "source_size", "target", "rank", rate.alias("rate"), shift.alias("shift")), "ranked")

    def copies(offset: Column) -> Column:
        edge = lambda rank: F.floor(F.col("rate") * rank + (offset + F.col("shift")) / OFFSETS)
        return (edge(F.col("rank") + 1) - edge(F.col("rank"))).cast("long")

    sums = met.groupBy("source").agg(F.first("target").alias("target"), *[F.sum(copies(F.lit(k)) * F.col("size")).alias(f"s{k}") for k in range(OFFSETS)])
    near = F.array_min(F.array(*[F.struct(F.abs(F.col(f"s{k}") - F.col("target")).alias("off"), F.lit(k).alias("k")) for k in range(OFFSETS)]))
    chosen = sums.select("source", near["k"].alias("k"))
    met = join_same(met, F.broadcast(chosen) if few else chosen, ["source"])
    n = copies(F.col("k"))
    return met.select("doc_id", "source", "digest", "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: str = "mix") -> DataFrame:
    """The mixed corpus: every row as often as ``plan`` takes it, with the
    columns of ``docs``. Rows that agree in doc_id, source and text are repeats
    of one document: one of them stands for all, with their copies added up."""
    cols = docs.columns
    p = plan(docs, weights, most, seed).groupBy("doc_id", "source", "digest").agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows")).filter("__copies > 0")
    # names of its own beside those of docs
    d, s, g, n, rows, digest, i = (free(docs, x) for x in ("__d", "__s", "__g", "__copies", "__rows", "__digest", "__i"))
    p = materialise(p, "copies").withColumnsRenamed({"doc_id": d, "source": s, "digest": g, "__copies": n, "__rows": rows})
    keyed = docs.withColumn(digest, F.md5(F.coalesce("text", F.lit(""))))
    if not p.filter(F.col(rows) > 1).isEmpty():
        keyed = keyed.dropDuplicates(["doc_id", "source", digest])
    met = keyed.join(p, keyed["doc_id"].cast("long").eqNullSafe(p[d]) & keyed["source"].eqNullSafe(p[s]) & (keyed[digest] == p[g]))
    return met.withColumn(i, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*cols)


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2) AS bucket
  FROM documents
), cut AS (
  SELECT *, CAST(floor(size / pow(2.0, greatest(0, length(bin(size)) - 10))) * pow(2.0, greatest(0, length(bin(size)) - 10)) AS BIGINT) AS stratum FROM sized
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM cut GROUP BY source
), weighted AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM per
), levels AS (
  SELECT *, cap * sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS capped
  FROM weighted
), goal AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE
    (CAST(sum(source_size) OVER () AS DOUBLE) - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) * w / sum(CASE WHEN capped THEN 0 ELSE w END) OVER () END AS target
  FROM levels
), ranked AS (
  SELECT c.*, g.source_size, g.target,
         row_number() OVER (PARTITION BY c.source ORDER BY stratum, bucket, doc_id NULLS FIRST, size, digest) - 1 AS rank,
         CASE WHEN g.source_size > 0 THEN least(g.target / g.source_size, 3.0::DOUBLE) ELSE 0 END AS rate,
         CAST(('0x' || substr(md5(coalesce(c.source, '') || ':mix'), 1, 3)) AS INTEGER)::DOUBLE / 4096 AS shift
  FROM cut c JOIN goal g ON c.source IS NOT DISTINCT FROM g.source
), tried AS (
  SELECT source, k, abs(sum((floor(rate * (rank + 1) + (k + shift) / 32) - floor(rate * rank + (k + shift) / 32)) * size) - first(target)) AS off
  FROM ranked, (SELECT CAST(unnest(range(32)) AS DOUBLE) AS k) GROUP BY source, k
), chosen AS (
  SELECT source, k FROM tried QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, k) = 1
)
SELECT doc_id, size, source_size, target,
       CAST((floor(rate * (rank + 1) + (k + shift) / 32) - floor(rate * rank + (k + shift) / 32)) * size AS BIGINT) AS taken
FROM ranked r JOIN chosen c ON r.source IS NOT DISTINCT FROM c.source
"""
