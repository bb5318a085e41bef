"""Retrieval quality: accuracy of the first hit and precision at k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def top1(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(n, accuracy): share of questions with gold whose first hit is in it. hits: (qid, id, rank); gold: (qid, id)."""
    first = hits.where("rank = 1").join(gold.withColumn("good", F.lit(1.0)), ["qid", "id"], "left").select("qid", "good")
    return gold.select("qid").distinct().join(first, "qid", "left").agg(F.count("*").alias("n"), F.avg(F.coalesce("good", F.lit(0.0))).alias("accuracy"))


def precision_at(hits: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """(n, precision): mean over questions with gold of the share of their first k hits that are in it;
    a question without hits counts 0."""
    per = (
        hits.where(F.col("rank") <= k).join(gold.withColumn("good", F.lit(1.0)), ["qid", "id"], "left")
        .groupBy("qid").agg(F.avg(F.coalesce("good", F.lit(0.0))).alias("p"))
    )
    return gold.select("qid").distinct().join(per, "qid", "left").agg(F.count("*").alias("n"), F.avg(F.coalesce("p", F.lit(0.0))).alias("precision"))


def same_offence_at(hits: DataFrame, asked: DataFrame, keys: DataFrame, k: int = 5) -> DataFrame:
    """(n, precision): for narratives taken from decisions, the mean share of the first k hits that share an
    offence with the decision the narrative is from, which itself is no hit.

    hits: (qid, id, rank); asked: (qid, id) the decision behind each question; keys: (id, keys). Questions
    whose decision has no key don't count; one without hits counts 0.
    """
    own = asked.join(keys, "id").where(F.size("keys") > 0).select("qid", F.col("id").alias("own"), F.col("keys").alias("own_keys"))
    others = hits.join(own, "qid").where(F.col("id") != F.col("own"))
    others = others.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("r") <= k)
    met = others.join(keys, "id").select("qid", F.arrays_overlap("keys", "own_keys").cast("double").alias("good"))
    per = met.groupBy("qid").agg(F.avg("good").alias("p"))
    return own.select("qid").join(per, "qid", "left").agg(F.count("*").alias("n"), F.avg(F.coalesce("p", F.lit(0.0))).alias("precision"))


def on_thesis_at(hits: DataFrame, theses: DataFrame, texts: DataFrame, k: int = 5) -> DataFrame:
    """(n, precision): the mean share of each thesis question's first k hits whose text has its pattern.

    theses: (qid, pattern); texts: (id, text). Only the hits' texts are searched.
    """
    found = hits.where(F.col("rank") <= k).join(theses, "qid").join(texts, "id")
    per = found.groupBy("qid").agg(F.avg(F.regexp_like("text", F.col("pattern")).cast("double")).alias("p"))
    return theses.select("qid").join(per, "qid", "left").agg(F.count("*").alias("n"), F.avg(F.coalesce("p", F.lit(0.0))).alias("precision"))


def report(**measures: DataFrame) -> DataFrame:
    """(measure, n, value): one row for each named measure."""
    out = None
    for name, m in measures.items():
        row = m.toDF("n", "value").select(F.lit(name).alias("measure"), "n", "value")
        out = row if out is None else out.unionByName(row)
    return out
