"""Answers: a pluggable generator and the check of the sources that an answer cites."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.extract import answer_citations


class Generator(Protocol):
    """Adds answer to (qid, question, sources array<struct<number, passages>>)."""

    def answer(self, asked: DataFrame) -> DataFrame: ...


class Extractive:
    """The first sentence of each source, cited by its number: deterministic, no model."""

    def answer(self, asked: DataFrame) -> DataFrame:
        first = lambda s: F.regexp_extract(F.get(s["passages"], F.lit(0)), r"(?s)^(.{1,300}?(?:[.;:](?=\s|$)|$))", 1)
        return asked.withColumn("answer", F.array_join(F.transform("sources", lambda s: F.concat(first(s), F.lit(" ["), s["number"].cast("string"), F.lit("]"))), "\n"))


def answers(plan: DataFrame, questions: DataFrame, generator: Generator | None = None) -> DataFrame:
    """(qid, answer, cited, invalid, n_sources): plan as evidence.numbered() gives it."""
    grouped = plan.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("number", "passages"))).alias("sources"))
    asked = questions.join(grouped, "qid", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<struct<number:int,passages:array<string>>>")))
    return checked((generator or Extractive()).answer(asked), F.size("sources"))


def checked(answered: DataFrame, n_sources: Column) -> DataFrame:
    done = answered.withColumn("c", answer_citations("answer", n_sources))
    return done.select("qid", "answer", F.col("c.cited").alias("cited"), F.col("c.invalid").alias("invalid"), n_sources.alias("n_sources"))


def events(checked: DataFrame) -> DataFrame:
    """(qid, seq, event, body): what a client is told of each answer, in order: the number of its sources,
    its text, and at the end which of them it cites and which numbers are none, as JSON.

    checked: as answers() gives it.
    """
    told = F.array(
        F.struct(F.lit("sources").alias("event"), F.col("n_sources").cast("string").alias("body")),
        F.struct(F.lit("text").alias("event"), F.coalesce("answer", F.lit("")).alias("body")),
        F.struct(F.lit("end").alias("event"), F.to_json(F.struct("cited", "invalid")).alias("body")),
    )
    return checked.select("qid", F.posexplode(told).alias("seq", "e")).select("qid", "seq", "e.event", "e.body")
