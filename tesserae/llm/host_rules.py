"""Host-level quality rules (operator 2).

Each document is measured and judged by its own base rules. Failures are then summed by host, each
host's failure rate is shrunk toward the corpus by a beta prior fitted to the hosts' rates (method
of moments), and the verdict on the host is joined back to its documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import _SPACES, maybe_broadcast, saved, steps, windows, word_hashes

#: Base rules: fewer words than this, or a larger percentage of words in repeated 3-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT = 50, 50, 3
#: A host is rejected when its shrunk failure rate exceeds this: most of what it serves fails.
MAX_HOST_RATE = 0.5
SYMBOLS = b"#*$%&|<>"

#: What isn't the first byte of a code point in a word.
_NOT_CHAR = _SPACES + bytes(range(0x80, 0xC0))


def repeated(h: np.ndarray) -> int:
    """Words, by their hashes, in a 3-word window found twice or more in the text, first included."""
    w = windows(h, REPEAT)
    if not len(w):
        return 0
    ranked = np.sort(w)
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.isin(w, ranked[1:][same])
    cover = np.zeros(len(h), bool)
    for j in range(REPEAT):
        cover[j : j + len(w)] |= twice
    return int(np.count_nonzero(cover))


def measure(text: bytes, h: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text with these words' hashes."""
    lines = [x for x in text.split(b"\n") if not x.isspace() and x]
    return (
        len(h), len(text.translate(None, _NOT_CHAR)), len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)), repeated(h),
    )


def _measured(batches):
    for *keys, texts in steps(batches):
        m = list(map(measure, texts, word_hashes(texts)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[0], pa.int64()), pa.array(keys[1], pa.string()), *(pa.array([x[i] for x in m], pa.int64()) for i in range(5))],
            names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        )


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"),
    )
    out = rows.mapInArrow(_measured, "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_verdicts(measured: DataFrame) -> DataFrame:
    """host, n, failed, rate (shrunk), rejected: one row per host; a null host is a host of its own.

    The beta prior has the corpus's rate m as mean. Its strength comes from how much more the hosts'
    rates differ than documents drawn alike would make them: with the spread S = sum n (rate - m)^2
    over k hosts of n documents, N in all, their correlation is
    r = (S / (m (1 - m)) - (k - 1)) / (N - sum n^2 / N - (k - 1)), and the strength 1 / r - 1. Where
    hosts differ by no more than chance, or can't tell (one host; one document each), it is N, so
    each is judged by the corpus. Sums are partial aggregates, so a host of any size meets as one row
    per task.
    """
    hosts = measured.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    sums = hosts.agg(
        F.count("*").alias("k"), F.sum("n").alias("total"), (F.sum("failed") / F.sum("n")).alias("m"),
        F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("ff"), F.sum((F.col("n") * F.col("n")).cast("double")).alias("nn"),
    )
    m, total, k = F.col("m"), F.col("total"), F.col("k")
    free = total - F.col("nn") / total - (k - 1)
    excess = F.when((m > 0) & (m < 1) & (free > 1e-9), ((F.col("ff") - m * m * total) / (m * (1 - m)) - (k - 1)) / free)
    strength = F.when(excess > 1 / (total + 1), 1 / excess - 1).otherwise(total.cast("double"))
    # The prior is one row.
    return hosts.join(F.broadcast(sums.select("m", F.greatest(strength, F.lit(0.0)).alias("strength"))), F.lit(True)).select(
        "host", "n", "failed", ((F.col("failed") + F.col("m") * F.col("strength")) / (F.col("n") + F.col("strength"))).alias("rate")
    ).withColumn("rejected", F.col("rate") > MAX_HOST_RATE)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document row: doc_id, host, the measures, base_failed, host_rate, kept.

    Null and empty texts have no words and fail; long texts are measured whole; repeated rows count
    as often as they occur; a rate of just the limit is kept; other columns are ignored; an empty table
    gives an empty table.
    """
    measured = saved(measures(docs, id_col, text_col, host_col), "measures")
    verdicts = saved(host_verdicts(measured), "hosts")
    hosts = maybe_broadcast(verdicts.select(F.col("host").alias("h"), F.col("rate").alias("host_rate"), "rejected"), verdicts.count())
    return measured.join(hosts, F.col("host").eqNullSafe(F.col("h")), "left").withColumn("kept", ~F.col("base_failed") & ~F.col("rejected")).drop("h", "rejected")


def _passing(text_at: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [(t or "").encode() for t in part.column(text_at).to_pylist()]
                m = list(map(measure, texts, word_hashes(texts)))
                yield part.filter(pa.array([x[0] >= MIN_WORDS and 100 * x[4] <= MAX_REPEAT_PERCENT * x[0] for x in m], pa.bool_()))

    return run


def passing(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs that judged() keeps, each judged by itself, with the same columns.

    No id is needed, so null and repeated ids are rows like others. Everything else as judged().
    """
    measured = measures(docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text"), F.col(host_col).alias("host")), "id", "text", "host")
    verdicts = saved(host_verdicts(measured).where("rejected").select("host"), "hosts")
    bad = maybe_broadcast(verdicts.select(F.col("host").alias("__rejected_host")), verdicts.count())
    left = docs.join(bad, docs[host_col].cast("string").eqNullSafe(F.col("__rejected_host")), "left_anti")
    return left.mapInArrow(_passing(docs.columns.index(text_col)), docs.schema)


def op2(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
