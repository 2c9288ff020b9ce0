"""Lexical and vector retrieval, their fusion, and context for answers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finweave.functions.num import div
from finweave.operators.batches import bounded

# Okapi parameters, the share of the mean that negative idf is raised to, the fusion constant.
K1, B, EPSILON, RRF = 1.5, 0.75, 0.25, 60


def bm25(docs: DataFrame, query: str) -> DataFrame:
    """id and score of every document (id, text) that holds a query word.

    One pass makes lengths and document frequencies of the vocabulary (partial
    sums per task); only the query's words of a document take part after that."""
    terms = list(dict.fromkeys(query.lower().split()))
    d = docs.select("id", F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "").alias("words"))
    vocab = d.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    size = d.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("avgdl"))
    idf = vocab.crossJoin(F.broadcast(size)).withColumn("idf", F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean = idf.agg(F.avg("idf").alias("mean"))
    weight = idf.filter(F.col("term").isin(terms)).crossJoin(F.broadcast(mean)).select("term", "avgdl", F.when(F.col("idf") < 0, F.col("mean") * EPSILON).otherwise(F.col("idf")).alias("idf"))
    hits = d.select("id", F.size("words").alias("dl"), F.explode(F.filter("words", lambda w: w.isin(terms))).alias("term")).groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    s = hits.join(weight, "term")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return s.groupBy("id").agg(F.sum(part).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return div(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def similar(vectors: DataFrame, query: Sequence[float] | DataFrame, n: int = 10, where: dict[str, object] | None = None) -> DataFrame:
    """The n vectors (id, embedding) nearest to one query vector by cosine,
    among those whose columns equal ``where``. Filters come before the scores;
    each task keeps its n best."""
    v = vectors
    for k, x in (where or {}).items():
        if x is not None:
            v = v.filter(F.col(k) == x)
    if isinstance(query, DataFrame):
        v = v.crossJoin(F.broadcast(query.select(F.col("embedding").alias("__q")).limit(1)))
    else:
        v = v.withColumn("__q", F.array(*[F.lit(float(x)) for x in query]))
    return v.withColumn("similarity", cosine(F.col("embedding"), F.col("__q"))).drop("__q").orderBy(F.desc_nulls_last("similarity"), "id").limit(n)


def similar_to(vectors: DataFrame, id_: int, n: int = 5) -> DataFrame:
    """The nearest to a stored vector, itself left out."""
    return similar(vectors.filter(F.col("id") != id_), vectors.filter(F.col("id") == id_), n)


def blended(dense: DataFrame, lexical: DataFrame, n: int = 10, alpha: float = 0.5) -> DataFrame:
    """alpha * cosine + (1 - alpha) * score over the best score, of vector hits."""
    top = lexical.agg(F.max("score").alias("top"))
    j = dense.select("id", "similarity").join(lexical, "id", "left").crossJoin(F.broadcast(top))
    return j.select("id", (alpha * F.coalesce("similarity", F.lit(0.0)) + (1 - alpha) * F.coalesce(div("score", "top"), F.lit(0.0))).alias("hybrid_score")).orderBy(F.desc("hybrid_score"), "id").limit(n)


def fused(ranked: Sequence[tuple[DataFrame, str, float]], k: int = 6, depth: int = 50) -> DataFrame:
    """Weighted reciprocal ranks of (frame with id, its score column, weight),
    each over its ``depth`` best."""
    parts = None
    for df, score, weight in ranked:
        best = df.select("id", F.col(score).alias("s")).filter("s is not null").orderBy(F.desc("s"), "id").limit(depth)
        r = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("s"), "id"))).select("id", (F.lit(float(weight)) / (RRF + F.col("rank"))).alias("part"))
        parts = r if parts is None else parts.unionByName(r)
    return parts.groupBy("id").agg(F.sum("part").alias("rrf_score")).orderBy(F.desc("rrf_score"), "id").limit(k)


def _slots(docs: DataFrame, size: int) -> DataFrame:
    """id and embedding of each row by itself, from the hashes of its words; rows without words have none."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b["h"].value_lengths().to_numpy(zero_copy_only=False)
            h, row = b["h"].flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if len(h) else np.zeros(0, np.int64)
            tf = np.diff(np.append(first, len(h)))
            h, row = h[first], row[first]
            v = np.where((h >> 32) & 1, -1.0, 1.0) * (1 + np.log(tf))
            total = np.bincount(row * size + h % size, v, len(n) * size).astype(float).reshape(len(n), size)
            norm = np.sqrt((total * total).sum(1, keepdims=True))
            out = np.divide(total, norm, out=np.zeros_like(total), where=norm > 0)
            on = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(on)), pa.ListArray.from_arrays(pa.array(np.arange(len(on) + 1) * size, pa.int32()), pa.array(out[on].reshape(-1)))], names=["id", "embedding"])

    h = docs.select("id", F.transform(words, lambda w: F.xxhash64(w)).alias("h")).filter("h is not null")
    return bounded(h).mapInArrow(run, f"id {kind}, embedding array<double>")


def _added(docs: DataFrame, size: int) -> DataFrame:
    """The same over all rows of an id, whose slots are added up in partial aggregates."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    e = docs.select("id", F.explode(words).alias("w")).groupBy("id", F.xxhash64("w").alias("h")).agg(F.count(F.lit(1)).alias("tf"))
    sign = F.when(F.pmod(F.shiftright("h", 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    c = e.groupBy("id", F.pmod("h", F.lit(size)).cast("int").alias("slot")).agg(F.sum(sign * (1 + F.ln("tf"))).alias("v"))
    m = c.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(div(F.try_element_at("m", i), F.col("norm")), F.lit(0.0)))
    return m.select("id", raw.alias("embedding"))


#: Repeated ids that every task may hold; more are met in a shuffle.
FEW = 100_000


def embed(docs: DataFrame, size: int = 64) -> DataFrame:
    """A deterministic embedding: hashed words, signed, sublinear counts,
    scaled to length 1. Stands in where no model is at hand. Texts of one id
    count as one text; only words of ids that are repeated are exchanged."""
    docs = docs.select("id", "text")
    often = docs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("__id"))
    n = often.limit(FEW + 1).count()
    if not n:
        return _slots(docs, size)
    if n <= FEW:
        often = F.broadcast(often)
    same = F.col("id").eqNullSafe(F.col("__id"))
    return _slots(docs.join(often, same, "left_anti"), size).unionByName(_added(docs.join(often, same, "left_semi"), size))


def context(passages: DataFrame, most: int = 1200, by: Sequence[str] = ()) -> DataFrame:
    """One text (of each group ``by``) of ranked passages (rank, fy, section,
    source, text) with their labels; line breaks become blanks, long ones are
    cut."""
    t = F.replace("text", F.lit("\n"), F.lit(" "))
    cut = F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit(" ..."))).otherwise(t)
    line = F.concat(F.lit("[fy="), F.coalesce(F.col("fy").cast("string"), F.lit("")), F.lit(" section="), F.coalesce("section", F.lit("")), F.lit(" source="), F.coalesce("source", F.lit("")), F.lit("] "), cut)
    p = passages.select(*by, "rank", line.alias("line"))
    return p.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n\n").alias("context"))


ANSWER = "struct<answer:string,citations:array<struct<fy:string,section:string,source:string,snippet:string>>,derived_metrics:array<struct<name:string,value:double,formula:string,source:string>>,viz_suggestions:array<struct<type:string,title:string,data_refs:array<string>>>>"


def parsed_answer(raw: Column) -> Column:
    """A model's answer as a record: as it is, else from the first brace to
    the last, else the text alone."""
    inner = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    ok = lambda c: F.when(F.from_json(c, ANSWER)["answer"].isNotNull(), F.from_json(c, ANSWER))
    return F.coalesce(ok(raw), ok(inner), F.from_json(F.to_json(F.struct(raw.alias("answer"))), ANSWER))


def ratio_documents(ratios: DataFrame) -> DataFrame:
    """One text per year (ticker, fy, metric, value): a header and a line per metric."""
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("metric", "value"))), lambda x: F.concat(x["metric"], F.lit(": "), F.format_string("%.4f", x["value"]))), "\n")
    return ratios.groupBy("ticker", "fy").agg(F.concat(F.lit("Ratios of "), F.first("ticker"), F.lit(" in "), F.first("fy").cast("string"), F.lit("\n"), lines).alias("text"))
