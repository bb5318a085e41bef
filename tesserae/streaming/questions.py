"""A stream of questions answered in micro-batches by the batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.stored import owned

QUESTION = "qid long, question string, asked timestamp"


def read_questions(spark: SparkSession, folder: str, per_batch: int = 16) -> DataFrame:
    """Questions from JSON files that appear in a folder."""
    return spark.readStream.schema(QUESTION).option("maxFilesPerTrigger", per_batch).json(folder)


def answer_stream(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Runs answer() on each micro-batch and writes its rows to out, one folder for each batch.

    Questions that repeat within the delay are answered once. A batch that is tried again overwrites
    its own folder, so results are exact after a failure.
    """
    fresh = questions.withWatermark("asked", delay).dropDuplicatesWithinWatermark(["qid"])

    def write(batch: DataFrame, number: int) -> None:
        with owned():  # what the batch stores on its way goes with it
            answer(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(questions: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(window, n): questions by time window; late ones are dropped after the delay."""
    return questions.withWatermark("asked", delay).groupBy(F.window("asked", window)).agg(F.count("*").alias("n"))
