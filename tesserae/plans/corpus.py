"""The test tables in the engine's terms: documents as items, orders as decisions, and questions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import offence_key, terms
from ..operators import index as I
from ..operators.segments import by_owner
from ..sources.stored import folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Texts over all tasks: a small table lies in one file, and term work is per row."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if df.sparkSession.sparkContext.master.startswith("local") else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text, instance, year)."""
    instance = F.when(F.col("lang").isin("en", "de"), "1ª instância").otherwise("2ª instância")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", instance.alias("instance"), (2015 + F.col("doc_id") % 10).cast("string").alias("year"))


@lru_cache(maxsize=None)
def _root(spark: SparkSession) -> str:
    return folder(spark, "indexes")


def index(spark: SparkSession, sf_dir: str) -> I.Index:
    """The documents' stored index, built when a query of this process first asks for it."""
    items = lambda: documents(spark, sf_dir).select("id", "text")
    return I.load_or_build(spark, f"{_root(spark)}/documents", [f"{sf_dir}/documents.parquet"], items, terms("text"))


def line_index(spark: SparkSession, sf_dir: str) -> I.Index:
    """The stored index of documents' lines (id, pos): lines stand for passages, so that SQL can cut them too."""
    def items():
        lines = documents(spark, sf_dir).select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        return lines.select(F.struct("id", "pos").alias("id"), "line")

    return I.load_or_build(spark, f"{_root(spark)}/lines", [f"{sf_dir}/documents.parquet"], items, terms("line"), block=by_owner)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, question): the benchmark's passages, whole."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, outcome, instance, year) of orders as decisions."""
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(status == "F", "deferido").when(status == "O", "indeferido").when(status == "P", "").alias("outcome"),
        F.col("o_orderpriority").alias("instance"), F.year("o_orderdate").cast("string").alias("year"),
    )


def order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, keys): distinct offence keys of an order, from its parts' names."""
    parts = table(spark, sf_dir, "part").select("p_partkey", offence_key("p_name").alias("key"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("p_partkey"))
    # Names repeat, so that parts lie small in files and shuffles: without the hint many of them are broadcast.
    return lines.join(parts.hint("merge"), "p_partkey").groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def key_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, name, n): the name of the first part with each key, and how many orders have it."""
    names = table(spark, sf_dir, "part").groupBy(offence_key("p_name").alias("key")).agg(F.min_by("p_name", "p_partkey").alias("name"))
    counts = order_keys(spark, sf_dir).select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    return names.join(counts, "key")
