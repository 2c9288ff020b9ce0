"""Sentiment about the names that a text mentions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finweave.functions import constants as K
from finweave.functions.num import div

#: Words on either side of a name that are its context.
REACH = 10
NAME = r"^\p{Lu}\p{Ll}+$"


def tokens(docs: DataFrame, marks: Sequence[str] | None = None) -> DataFrame:
    """document_id, at (place among the words, from 0), core (the word without
    what is no letter at its ends) and closed (something else than a letter
    ends the word) of (document_id, text); with ``marks`` only of words that
    hold a capital or are one of these."""
    words = F.filter(F.split(F.col("text"), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    each = docs.select("document_id", F.posexplode(words).alias("at", "word"))
    if marks is not None:
        each = each.filter(F.col("word").rlike(r"\p{Lu}|^[^\p{L}]*(?:" + "|".join(map(re.escape, marks)) + r")[^\p{L}]*$"))
    return each.select("document_id", "at", F.regexp_replace("word", r"^[^\p{L}]+|[^\p{L}]+$", "").alias("core"), F.col("word").rlike(r"[^\p{L}]$").alias("closed"))


def names(words: DataFrame) -> DataFrame:
    """document_id, start, last (places) and entity of runs of two or more
    capitalised words; a run goes on while nothing but a letter ends a word."""
    w = Window.partitionBy("document_id").orderBy("at")
    c = words.filter(F.col("core").rlike(NAME))
    opens = F.when((F.lag("at").over(w) == F.col("at") - 1) & ~F.lag("closed").over(w), 0).otherwise(1)
    c = c.withColumn("opens", opens).withColumn("run", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = c.groupBy("document_id", "run").agg(F.min("at").alias("start"), F.max("at").alias("last"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "core"))), lambda x: x["core"]), " ").alias("entity"))
    return runs.filter(F.col("last") > F.col("start")).drop("run")


def entity_sentiment(docs: DataFrame, positive: Sequence[str] = K.POSITIVE, negative: Sequence[str] = K.NEGATIVE, reach: int = REACH) -> DataFrame:
    """document_id, entity, mentions, positive and negative (words of the
    lexicon within ``reach`` words of a mention) and sentiment: the mean over
    mentions of (positive - negative) / (positive + negative), 0 without any.

    Only capitalised and lexicon words take part. They are sorted once by
    document and place; lexicon words within reach are the difference of two
    running counts, at a name's ends. Null texts have no names; repeated
    documents count each time.
    """
    words = tokens(docs, (*positive, *negative))
    mark = F.when(F.lower("core").isin(*positive), 1).when(F.lower("core").isin(*negative), -1)
    c = words.select("document_id", F.col("at").cast("long").alias("at"), "core", "closed", F.col("core").rlike(NAME).alias("name"), mark.alias("mark")).filter("name or mark is not null")
    w = Window.partitionBy("document_id").orderBy("at")
    goes_on = (F.lag("at").over(w) == F.col("at") - 1) & F.lag("name").over(w) & ~F.lag("closed").over(w)
    upto = lambda sign, to: F.count_if(F.col("mark") == sign).over(w.rangeBetween(Window.unboundedPreceding, to))
    c = c.withColumns({"opens": F.when(F.col("name") & ~F.coalesce(goes_on, F.lit(False)), 1).otherwise(0), "p0": upto(1, -reach - 1), "p1": upto(1, reach), "n0": upto(-1, -reach - 1), "n1": upto(-1, reach)})
    c = c.withColumn("run", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("name")
    entity = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "core"))), lambda x: x["core"]), " ")
    runs = c.groupBy("document_id", "run").agg((F.max("at") > F.min("at")).alias("long"), entity.alias("entity"), (F.max("p1") - F.min("p0")).alias("p"), (F.max("n1") - F.min("n0")).alias("n"))
    score = F.coalesce(div(F.col("p") - F.col("n"), F.col("p") + F.col("n")), F.lit(0.0))
    return runs.filter("long").groupBy("document_id", "entity").agg(F.count(F.lit(1)).alias("mentions"), F.sum("p").alias("positive"), F.sum("n").alias("negative"), F.avg(score).alias("sentiment"))
