"""Conversations as a stream: each question with what its conversation said before, kept as state."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.text import terms
from ..operators.evidence import ANSWER_CHARS, FOLLOW_UP_TERMS, HISTORY_TURNS

TURN = "conv_id long, turn long, role string, text string, at timestamp"
ASKED = "conv_id long, turn long, query string, messages array<struct<role:string,content:string>>"
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A conversation that says nothing for so long is forgotten; turns may be late by so much.
IDLE_MS, DELAY = 30 * 60 * 1000, "1 day"


class Conversation(StatefulProcessor):
    """Holds a conversation's last questions with their answers, and how many terms make a question whole.

    A question is answered from the state before it; the turn after a question is its answer. Turns of
    one micro-batch go by number; a turn that arrives after a later one is taken as it comes.
    """

    def __init__(self, idle_ms: int = IDLE_MS):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.said = handle.getValueState("said", "pairs string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.said.get()
        # [question, answer or null] of the last questions; only the very last can still wait for its answer.
        pairs = json.loads(held[0]) if held is not None else []
        out, last = [], 0
        for row in pd.concat(rows).sort_values("turn", kind="stable").itertuples(index=False):
            last = max(last, row.at_ms)
            if pairs and pairs[-1][1] is None:
                pairs[-1][1] = row.text
            if row.role == "user":
                short = pairs and row.n_terms < FOLLOW_UP_TERMS
                query = f"{pairs[-1][0]} {row.text}" if short else row.text
                messages = [m for q, a in pairs for m in ({"role": "user", "content": q}, {"role": "assistant", "content": a[:ANSWER_CHARS]})]
                out.append((key[0], row.turn, query, messages))
                pairs = [*pairs, [row.text, None]][-HISTORY_TURNS:]
        self.said.update((json.dumps(pairs),))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(last) + self.idle_ms)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "query", "messages"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.said.clear()
        yield pd.DataFrame(columns=["conv_id", "turn", "query", "messages"])

    def close(self) -> None:
        pass


def read_turns(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """Turns from Parquet files that appear in a folder, a few files a micro-batch."""
    return spark.readStream.schema(TURN).option("maxFilesPerTrigger", files).parquet(folder)


def asked(turns: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """(conv_id, turn, query, messages) of every user turn: the question, with the one before in front
    if it is short, and the messages of the two turns before. Null texts are empty.

    A conversation is forgotten when the stream's time has passed its last turn by idle_ms. Time is that of the
    turns, so a stream that is read again forgets the same.
    """
    timed = turns.withColumn("at", F.coalesce("at", F.timestamp_millis(F.lit(0)))).withWatermark("at", DELAY)
    plain = timed.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), "at", F.unix_millis("at").alias("at_ms")).withColumn("n_terms", F.size(terms("text")))
    return plain.groupBy("conv_id").transformWithStateInPandas(Conversation(idle_ms), ASKED, "Append", "EventTime")


@contextmanager
def state_store(spark: SparkSession):
    """State of several kinds, and timers, need this store."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def run(turns: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes asked() of all turns that are there to out, a folder for each micro-batch; a batch that is
    tried again writes over its own folder."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return asked(turns).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
