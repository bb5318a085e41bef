"""Quality classifier (operator 6).

Statistics of the whole text go through random Fourier features, whose inner products approximate a
Gaussian kernel. Each partition sums its normal equations, one fold of the training rows at a time;
the sums are added, ridge weights solved, and an isotonic map, fitted on each fold's scores under the
other fold's weights, turns scores into probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import _SPACES, id_and_bytes, saved, steps, windows, word_hashes
from .labelled import held_out, share, training_labels

#: Labelled rows that a fit uses at most, chosen by a hash of their ids.
MAX_LABELLED = 200_000
#: Random features; ridge penalty for each training row; bins of the calibration; tasks of the fit.
FEATURES, RIDGE, BINS, FIT_TASKS = 256, 1e-5, 512, 8
SEED = 11

_CLASSES = (
    b"#*$%&|<>", b"!", b".,;:?", bytes(range(65, 91)), b"0123456789", bytes(range(0x80, 0xC0)), _SPACES, b"\n", b"{}[]()=/\\_",
)
STATISTICS = 19


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of statistics for each whole text."""
    return np.array(list(map(_statistics_of, texts, word_hashes(texts))), np.float64).reshape(-1, STATISTICS)


def _statistics_of(text: bytes, h: np.ndarray) -> np.ndarray:
    """All finite, also for the empty text. h: its words' hashes."""
    words = text.split()
    n, size = len(words), len(text)
    out = np.zeros(STATISTICS)
    out[0], out[1] = np.log1p(n), np.log1p(size)
    if not n:
        return out
    length = np.fromiter(map(len, words), np.int64, n)
    ranked = np.sort(h)
    new = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    out[2], out[3] = length.mean(), np.log1p(length.std())
    out[4] = len(new) / n
    out[5] = np.diff(np.append(new, n)).max() / n
    out[6] = np.count_nonzero(h[1:] == h[:-1]) / n
    w = np.sort(windows(h, 3))
    out[7] = np.count_nonzero(w[1:] == w[:-1]) / n
    lines = text.split(b"\n")
    out[8] = 1 - len(set(lines)) / len(lines)
    out[9] = np.log1p(size / len(lines))
    for i, c in enumerate(_CLASSES):
        out[10 + i] = (size - len(text.translate(None, c))) / size
    return out


def _training(batches):
    for folds, labels, texts in steps(batches):
        x = statistics(texts)
        yield pa.RecordBatch.from_arrays([
            pa.array(folds, pa.int32()), pa.array(labels, pa.int32()),
            pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), STATISTICS).cast(pa.list_(pa.float64())),
        ], names=["fold", "label", "x"])


@dataclass
class Model:
    """Everything that scoring needs; scores rise with the probability of label 1."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        raw = lift(x, self.mean, self.scale) @ self.weights
        # A thousandth of the raw score orders what the isotonic steps leave equal.
        return np.clip(0.999 * np.interp(raw, self.knots, self.values) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def lift(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    rng = np.random.default_rng(SEED)
    d = x.shape[1]
    direction = rng.normal(size=(d, FEATURES)) / np.sqrt(d)
    shift = rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((x - mean) / scale, -6, 6)
    return np.hstack((np.sqrt(2 / FEATURES) * np.cos(z @ direction + shift), np.ones((len(x), 1))))


def isotonic(score: np.ndarray, hits: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and rising values of bins with hits of count."""
    blocks: list[list[float]] = []
    for s, h, c in zip(score, hits, count):
        blocks.append([h, c, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            h2, c2, _, high = blocks.pop()
            blocks[-1][0] += h2
            blocks[-1][1] += c2
            blocks[-1][3] = high
    knots, values = [], []
    for h, c, low, high in blocks:
        for at in dict.fromkeys((low, high)):
            knots.append(at)
            values.append(h / c)
    return np.array(knots), np.array(values)


def _normal_equations(mean: np.ndarray, scale: np.ndarray):
    def run(batches):
        size = FEATURES + 1
        sums = [[np.zeros((size, size)), np.zeros(size), 0] for _ in range(2)]
        for folds, labels, xs in steps(batches, 4096):
            z, y, k = lift(np.array(xs, np.float64).reshape(-1, STATISTICS), mean, scale), np.array(labels, np.float64), np.array(folds)
            for f in (0, 1):
                own = k == f
                sums[f][0] += z[own].T @ z[own]
                sums[f][1] += z[own].T @ y[own]
                sums[f][2] += int(own.sum())
        yield pa.RecordBatch.from_arrays([
            pa.array([0, 1], pa.int32()), pa.array([s[0].tobytes() for s in sums]), pa.array([s[1].tobytes() for s in sums]), pa.array([s[2] for s in sums], pa.int64()),
        ], names=["fold", "gram", "moment", "n"])

    return run


def _binned(mean, scale, weights, low: float, high: float):
    """Out-of-fold scores, counted by bin."""
    def run(batches):
        hits, count = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
        for folds, labels, xs in steps(batches, 4096):
            z, k = lift(np.array(xs, np.float64).reshape(-1, STATISTICS), mean, scale), np.array(folds)
            raw = np.where(k == 0, z @ weights[1], z @ weights[0])
            at = np.clip(((raw - low) / (high - low) * BINS).astype(np.int64), 0, BINS - 1)
            hits += np.bincount(at, weights=np.array(labels, np.float64), minlength=BINS).astype(np.int64)
            count += np.bincount(at, minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS), pa.int32()), pa.array(hits), pa.array(count)], names=["bin", "hits", "n"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """labels: (doc_id, label 0/1), one row for an id. One class only, or none: a constant score.

    At most about MAX_LABELLED labels are used, so they can be broadcast; only labelled texts are
    measured for the fit.
    """
    n = labels.count()
    used = labels.where(share("doc_id", min(1.0, MAX_LABELLED / max(n, 1))))
    known = id_and_bytes(docs).join(F.broadcast(used), "doc_id").select(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).cast("int").alias("fold"), "label", "text")
    rows = saved(known.mapInArrow(_training, "fold int, label int, x array<double>").repartition(FIT_TASKS), "training")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    none = np.zeros(0)
    if len(counts) < 2:
        return Model(none, none, none, none, none, float(next(iter(counts), 0.5)))
    means = rows.agg(*[f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in range(STATISTICS)]).first()
    mean = np.array(means[:STATISTICS], float)
    scale = np.array([s if s > 1e-9 else 1.0 for s in means[STATISTICS:]], float)
    # At most FIT_TASKS rows for each fold come back, whatever the input.
    parts = rows.mapInArrow(_normal_equations(mean, scale), "fold int, gram binary, moment binary, n long").collect()
    size = FEATURES + 1
    gram = [sum(np.frombuffer(r["gram"]).reshape(size, size) for r in parts if r["fold"] == f) for f in (0, 1)]
    moment = [sum(np.frombuffer(r["moment"]) for r in parts if r["fold"] == f) for f in (0, 1)]
    total = [sum(r["n"] for r in parts if r["fold"] == f) for f in (0, 1)]
    solve = lambda a, b, k: np.linalg.solve(a + RIDGE * max(k, 1) * np.eye(size), b)
    by_fold = [solve(gram[f], moment[f], total[f]) for f in (0, 1)]
    weights = solve(gram[0] + gram[1], moment[0] + moment[1], sum(total))
    low, high = -0.5, 1.5
    bins = rows.mapInArrow(_binned(mean, scale, by_fold, low, high), "bin int, hits long, n long").groupBy("bin").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).where("n > 0").orderBy("bin").collect()
    centre = np.array([low + (r["bin"] + 0.5) * (high - low) / BINS for r in bins])
    knots, values = isotonic(centre, np.array([float(r["hits"]) for r in bins]), np.array([float(r["n"]) for r in bins]))
    return Model(mean, scale, weights, knots, values)


def _score(model: Model):
    def run(batches):
        for ids, texts in steps(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(model.score(statistics(texts)))], names=["doc_id", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, n_folds: int = 3, held: int = 1) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted.

    Fitted on labels outside the held-out fold (label 1: good). Null and empty texts are scored as
    empty; long texts are measured whole; repeated rows get equal scores; without both labels the
    score is constant; other columns are never read; an empty table gives an empty table.
    """
    model = fit(docs, training_labels(labels, "quality", n_folds, held))
    return (
        id_and_bytes(docs).mapInArrow(_score(model), "doc_id long, score double")
        .select("doc_id", held_out("doc_id", n_folds, held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    )


def _good(model: Model, text_at: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [(t or "").encode() for t in part.column(text_at).to_pylist()]
                yield part.filter(pa.array(model.score(statistics(texts)) >= 0.5))

    return run


def good(docs: DataFrame, labels: DataFrame, n_folds: int = 3, held: int = 1) -> DataFrame:
    """The rows of docs that quality_scores() predicts to be good, each judged by itself, with the same
    columns; null and repeated ids are rows like others."""
    model = fit(docs, training_labels(labels, "quality", n_folds, held))
    return docs.mapInArrow(_good(model, docs.columns.index("text")), docs.schema)


def op6(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
