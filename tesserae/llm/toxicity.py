"""Toxicity by non-negative positive-unlabelled learning (operator 10).

Confirmed toxic documents are the positives; the other text is unlabelled, not negative. A linear
classifier over the set of a document's words and their beginnings minimises

    p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives)),

p the class prior; where the difference turns negative the step goes against it, so the classifier
can't fit unlabelled positives as negatives. It is trained in numpy on a bounded sample of labelled
rows: toxic ones as positives, and rows of both labels, with their label hidden, as the unlabelled
text, whose class prior is then that of the labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import id_and_bytes, saved, steps, word_hashes
from .labelled import held_out, share, training_labels

#: Labelled rows that training uses at most, chosen by a hash of their ids.
MAX_POSITIVE, MAX_UNLABELLED = 12_000, 24_000
#: log2 of the hashed features; a feature is used if it is so many times as frequent among positives
#: as among the unlabelled, by so many standard deviations.
HASH_BITS, MIN_LIFT, MIN_SIGMAS = 20, 2.0, 4.0
#: Bytes of the beginnings that are features too.
BEGINNINGS = (4, 5)
STEPS, RATE, DECAY = 250, 0.05, 2e-4
#: Bounds of the class prior; the prior where no label tells it.
PRIOR = (0.01, 0.5, 0.1)

_MASK = (1 << HASH_BITS) - 1
_TO_SPACE = bytes(32 if chr(b) in ".,;:!?\"'()[]{}*#|-_/\\<>" else b for b in range(256))


def features_of(text: bytes) -> set[bytes]:
    """Distinct words of a whole text, lower case, cut at punctuation, and the beginnings of longer
    ones, by which inflected and compound forms meet."""
    words = set(text.translate(_TO_SPACE).lower().split())
    out = set(words)
    for n in BEGINNINGS:
        out.update([b"^" + w[:n] for w in words if len(w) > n])
    return out


def hashed_features(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct feature numbers of each text."""
    return [np.unique(h & np.uint64(_MASK)).astype(np.uint32) for h in word_hashes([b" ".join(features_of(t)) for t in texts])]


def _hashed(batches):
    for label, texts in steps(batches):
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array([x.tobytes() for x in hashed_features(texts)], pa.binary())], names=["label", "words"])


def fit(words: list[np.ndarray], positive: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Hashed words, their weights and the bias of one classifier."""
    n_pos = int(positive.sum())
    flat = np.concatenate([*words, np.empty(0, np.uint32)])
    doc = np.repeat(np.arange(len(words)), [len(w) for w in words])
    n_unl = len(words) - n_pos
    prior = min(max(prior, PRIOR[0]), PRIOR[1])
    seen = np.bincount(flat[positive[doc]], minlength=1 << HASH_BITS)
    in_pos = seen / max(n_pos, 1)
    in_unl = (np.bincount(flat[~positive[doc]], minlength=1 << HASH_BITS) + 0.5) / (n_unl + 1)
    spread = np.sqrt(in_unl * (1 / max(n_pos, 1) + 1 / max(n_unl, 1)))
    used = np.flatnonzero((seen >= 3) & (in_pos >= MIN_LIFT * in_unl) & (in_pos - in_unl >= MIN_SIGMAS * spread))
    bias = float(np.log(prior / (1 - prior)))
    if not len(used) or not n_unl:
        return used[:0], np.zeros(0), bias
    place = np.full(1 << HASH_BITS, -1, np.int64)
    place[used] = np.arange(len(used))
    col = place[flat]
    doc, col = doc[col >= 0], col[col >= 0]
    # Centred by each word's share of all documents, so that common words start neutral.
    centre = np.bincount(col, minlength=len(used)) / len(words)
    w, b = np.zeros(len(used)), bias
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, STEPS + 1):
        z = np.bincount(doc, weights=w[col], minlength=len(words)) - centre @ w + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        soft = np.logaddexp(0, z)
        negative = soft[~positive].mean() - prior * soft[positive].mean()
        if negative >= 0:
            g = np.where(positive, prior * (p - 1) / n_pos - prior * p / n_pos, p / n_unl)
        else:
            g = np.where(positive, prior * p / n_pos, -p / n_unl)
        grad = np.append(np.bincount(col, weights=g[doc], minlength=len(used)) - centre * g.sum() + DECAY * w, g.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= step[:-1]
        b -= step[-1]
    return used, w, float(b - centre @ w)


def _train(prior: float):
    def run(table: pa.Table) -> pa.Table:
        words = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("words")]
        used, weights, bias = fit(words, np.array(table.column("label")) == 1, prior)
        return pa.table({"used": pa.array([used.astype(np.uint32).tobytes()]), "weights": pa.array([weights.tobytes()]), "bias": pa.array([bias])})

    return run


def _score(used: np.ndarray, weights: np.ndarray, bias: float):
    def run(batches):
        dense = np.zeros(1 << HASH_BITS)
        dense[used] = weights
        for ids, texts in steps(batches):
            z = np.array([dense[x].sum() for x in hashed_features(texts)], np.float64) + bias
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, n_folds: int = 5, held: int = 0) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted.

    Trained on labelled rows outside the held-out fold, each id once.
    Null and empty texts are scored by the bias alone; long texts are read whole; repeated rows get
    equal scores; without a toxic row, or if no document has its id, every score is the prior; other
    columns are never read; an empty table gives an empty table.
    """
    texts = id_and_bytes(docs)
    known = saved(training_labels(labels, "toxic", n_folds, held), "toxic")
    n, n_pos = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    prior = min(max(n_pos / n, PRIOR[0]), PRIOR[1]) if n_pos else PRIOR[2]
    used, weights, bias = np.zeros(0, np.uint32), np.zeros(0), float(np.log(prior / (1 - prior)))
    if n_pos:
        # Bounded, give or take the hash; an id whose rows repeat gives one text.
        positive = (F.col("label") == 1) & share("doc_id", min(1.0, MAX_POSITIVE / n_pos))
        roles = F.array_compact(F.array(F.when(positive, 1), F.when(share("doc_id", min(1.0, MAX_UNLABELLED / n)), 0)))
        chosen = known.select("doc_id", roles.alias("roles")).where(F.size("roles") > 0)
        sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "roles").agg(F.min("text").alias("text")).select(F.explode("roles").alias("label"), "text")
        # One task holds the bounded sample's features.
        model = sample.mapInArrow(_hashed, "label int, words binary").withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_train(prior), "used binary, weights binary, bias double").first()
        if model is not None:
            used, weights, bias = np.frombuffer(model["used"], np.uint32), np.frombuffer(model["weights"]), model["bias"]
    return (
        texts.mapInArrow(_score(used, weights, bias), "doc_id long, score double")
        .select("doc_id", held_out("doc_id", n_folds, held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    )


def op10(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
