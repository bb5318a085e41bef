"""BM25 index as three DataFrames, and the stored one for a signature of the sources."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

if TYPE_CHECKING:
    from .segments import Segments

#: Fixed values of the weighting: saturation, length normalisation, least average length.
K1, B, LEAST_AVERAGE = 1.2, 0.75, 1.0
VERSION = 2


@dataclass
class Index:
    """postings (term, id, weight), terms (term, df, idf), stats (n_docs, avg_len); one corpus.

    segments, with the average length: the stored form, which searches read by buckets and blocks.
    """

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    segments: Segments | None = None
    average: float = 0.0


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def weight(tf: Column, length: Column, average: Column, idf: Column) -> Column:
    """Grows with tf and falls with length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average)) * idf


def build(items: DataFrame, terms_col: str = "terms", id_col: str = "id") -> Index:
    """items: (id, terms array). Documents without terms count in the number and average length.

    Term counts, document frequencies and totals are partial aggregates. The one row of statistics is
    broadcast; the vocabulary is joined by term, where Spark may broadcast it by its size.
    """
    sized = items.select(F.col(id_col).alias("id"), F.col(terms_col).alias("terms"))
    stats = sized.agg(F.count("*").alias("n_docs"), F.greatest(F.avg(F.size("terms")), F.lit(LEAST_AVERAGE)).alias("avg_len"))
    counted = sized.select("id", F.size("terms").alias("len"), F.explode("terms").alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    df = counted.groupBy("term").agg(F.count("*").alias("df"))
    terms = df.crossJoin(F.broadcast(stats)).select("term", "df", idf(F.col("n_docs"), F.col("df")).alias("idf"))
    postings = (
        counted.join(terms, "term").crossJoin(F.broadcast(stats))
        .select("term", "id", weight(F.col("tf"), F.col("len"), F.col("avg_len"), F.col("idf")).alias("weight"))
    )
    return Index(postings, terms, stats)


def signature(spark: SparkSession, paths: list[str]) -> str:
    """Names an index by version and by each source's place, files' names, sizes and modification times."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    facts: list = [VERSION]
    for p in sorted(paths):
        facts.append(p)
        at = jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(conf)
        for s in fs.listStatus(at) if fs.exists(at) else []:
            facts.append([s.getPath().getName(), s.getLen(), s.getModificationTime()])
    return hashlib.sha256(json.dumps(facts).encode()).hexdigest()[:16]


def load_or_build(spark: SparkSession, root: str, sources: list[str], items, terms: Column | str = "terms", **options) -> Index:
    """The stored index for the sources' signature; one without a whole version is built again.

    items: a function that gives the (id, terms) DataFrame, called only if it is needed. terms, options: as
    segments.Segments and its add() take them.
    """
    from .segments import Segments

    stored = Segments(spark, f"{root}/{signature(spark, sources)}", **options)
    return (stored if stored.live else stored.add(items(), terms=terms)).index()
