"""Queries over streams of conversations, and over published tables."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ..operators import answer, evaluate, search
from ..sources import versions
from ..sources.stored import folder
from ..streaming import conversations as C
from .corpus import index, questions, table
from .evidence_queries import ORACLES as EVIDENCE
from .search_queries import ORACLES as SEARCH, _gold

#: Turns that arrive together: the first two, the next three, the rest.
ARRIVALS = ("turn < 2", "turn >= 2 AND turn < 5", "turn >= 5")


def _asked(spark, sf_dir):
    """Conversations written in three arrivals and read as a stream of as many micro-batches."""
    root = folder(spark, "stream")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + 60 * F.col("turn"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", at.alias("at"))
    with C.state_store(spark):
        for i, arrival in enumerate(ARRIVALS):
            # A folder is read whole in one micro-batch, so that a conversation's turns come in order.
            turns.where(arrival).coalesce(1).write.mode("append").parquet(f"{root}/in")
            C.run(C.read_turns(spark, f"{root}/in", 1_000_000), f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.schema(C.ASKED + ", batch int").parquet(f"{root}/out")


def _follow_ups(spark, sf_dir):
    return _asked(spark, sf_dir).select("conv_id", "turn", "query")


def _history(spark, sf_dir):
    rows = _asked(spark, sf_dir).select("conv_id", "turn", F.posexplode("messages").alias("pos", "m"))
    return rows.select("conv_id", "turn", "pos", "m.role", "m.content")


def _events(spark, sf_dir):
    """Events of every turn as an answer that cites sources by its place. The first write of them fails
    on its way, the second succeeds, the third is one more try of the second."""
    root = folder(spark, "events")
    cites = F.concat("text", F.lit(" ["), (F.col("turn") + 1).cast("string"), F.lit("] e ["), (F.col("conv_id") % 12).cast("string"), F.lit("]"))
    said = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("qid"), cites.alias("answer"))
    told = answer.events(answer.checked(said, F.lit(5)))
    broken = told.withColumn("body", F.when(F.col("qid.turn") == 1, F.raise_error(F.lit("a task fails"))).otherwise(F.col("body")))
    try:
        versions.publish(broken, root, "batch-0")
    except PySparkException as e:
        if "a task fails" not in str(e):
            raise
    for _ in range(2):
        versions.publish(told, root, "batch-0")
    versions.clean(spark, root)
    out = versions.published(spark, root)
    return out.select("qid.conv_id", "qid.turn", "seq", "event", "body")


def _report(spark, sf_dir):
    """The evaluation as published and read back."""
    root, ix = folder(spark, "report"), index(spark, sf_dir)
    hits, gold = search.bm25_top(ix, search.query_terms(questions(spark, sf_dir)), 5), _gold(spark, sf_dir)
    versions.publish(evaluate.report(top1=evaluate.top1(hits, gold), precision_at_5=evaluate.precision_at(hits, gold)), root)
    return versions.published(spark, root).select("measure", "n", F.round("value", 6).alias("value"))


QUERIES = {"stream_followups": _follow_ups, "stream_history": _history, "published_events": _events, "published_report": _report}

ORACLES = {
    "stream_followups": EVIDENCE["followup_query"],
    "stream_history": EVIDENCE["conversation_history"],
    "published_events": r"""
WITH a AS (SELECT conv_id, turn, text || ' [' || (turn + 1) || '] e [' || (conv_id % 12) || ']' AS answer FROM conversations),
c AS (SELECT *, list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\[(\d{1,2})\]', 1), lambda x: x::INT))) AS n FROM a),
e AS (SELECT *, '{"cited":[' || array_to_string(list_filter(n, lambda x: x BETWEEN 1 AND 5), ',') || '],"invalid":[' || array_to_string(list_filter(n, lambda x: x NOT BETWEEN 1 AND 5), ',') || ']}' AS over FROM c)
SELECT conv_id, turn, 0 AS seq, 'sources' AS event, '5' AS body FROM e UNION ALL SELECT conv_id, turn, 1, 'text', answer FROM e UNION ALL SELECT conv_id, turn, 2, 'end', over FROM e""",
    "published_report": f"SELECT 'top1' AS measure, n, accuracy AS value FROM ({SEARCH['eval_top1']}) UNION ALL SELECT 'precision_at_5', n, precision FROM ({SEARCH['eval_p_at_5']})",
}
