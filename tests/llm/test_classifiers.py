import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import quality, toxicity
from tesserae.llm.labelled import training_labels


def accuracy(scores, labels, column):
    held = scores.where("held_out").join(labels, "doc_id")
    return held.agg(F.avg((F.col("predicted") == F.col(column)).cast("int"))).first()[0]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(9)
    vocab = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "st", "rm", "lly")]
    docs, labels = [], []
    for i in range(900):
        good, toxic = rng.random() < 0.8, rng.random() < 0.2
        words = rng.choices(vocab, k=rng.randrange(30, 200))
        if not good:
            words = [w for w in words[:20] for _ in range(6)] if rng.random() < 0.5 else [w.upper() + "!!" for w in words]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "grunk", "zarbo"]) + rng.choice(["", "ish", "ed"]))
        docs.append((i, " ".join(words), "en", "s", int(good)))
        if rng.random() < 0.7:
            labels.append((i, int(good), int(toxic)))
    docs += [(5000, None, "en", "s", 0), (5001, "", "en", "s", 0), (0, docs[0][1], "en", "s", 0)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score int"),
        spark.createDataFrame([*labels, (None, 1, 1), (labels[0][0], None, None)], "doc_id long, quality int, toxic int"),
    )


@pytest.mark.parametrize("scores, column, least", [(quality.quality_scores, "quality", 0.95), (toxicity.toxicity_scores, "toxic", 0.93)])
def test_held_out_accuracy_and_shape(tables, scores, column, least):
    docs, labels = tables
    out = scores(docs, labels).cache()
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").isEmpty()
    assert out.where("predicted <> case when score >= 0.5 then 1 else 0 end").isEmpty()
    assert accuracy(out, labels.dropna(), column) >= least
    assert out.where("doc_id = 0").select("score").distinct().count() == 1
    assert out.where("doc_id in (5000, 5001)").select("score").distinct().count() == 1


@pytest.mark.parametrize("scores", [quality.quality_scores, toxicity.toxicity_scores])
def test_without_labels_or_documents(tables, scores):
    docs, labels = tables
    assert scores(docs.limit(0), labels).count() == 0
    none = scores(docs.limit(20), labels.limit(0))
    assert none.count() == 20 and none.select("score").distinct().count() == 1


def test_positive_labels_without_documents(tables):
    """Nothing can be fitted, so every score is the prior, not a gap."""
    docs, _ = tables
    labels = docs.sparkSession.createDataFrame([(10_000 + i, 1, int(i < 10)) for i in range(40)], "doc_id long, quality int, toxic int")
    for scores in (toxicity.toxicity_scores, quality.quality_scores):
        got = scores(docs, labels)
        assert got.where("score is null or isnan(score) or score < 0 or score > 1").isEmpty() and got.select("score").distinct().count() == 1


@pytest.mark.parametrize("scores", [quality.quality_scores, toxicity.toxicity_scores])
def test_very_long_text_and_clashing_names(tables, scores):
    docs, labels = tables
    extra = docs.sparkSession.createDataFrame([(7000, "vile words " * 100_000, 1)], "doc_id long, text string, held_out int")
    got = scores(docs.unionByName(extra, allowMissingColumns=True).withColumn("label", F.lit(9)).withColumn("x", F.lit(9)), labels)
    assert got.where("doc_id = 7000").count() == 1 and got.where("score is null").isEmpty()


def test_good_rows_are_those_predicted(tables):
    docs, labels = tables
    want = sorted(r[0] for r in quality.quality_scores(docs, labels).where("predicted = 1").select("doc_id").collect())
    got = quality.good(docs, labels)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == want


def test_scores_restated_with_numpy(tables):
    """Ridge weights and isotonic map against the same from all training rows in one place."""
    docs, labels = tables
    known = {r["doc_id"]: r["label"] for r in training_labels(labels, "quality", 3, 1).collect()}
    fold = {r["doc_id"]: r["f"] for r in docs.select("doc_id", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(2)).alias("f")).collect()}
    train = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in known]
    x = quality.statistics([(t or "").encode() for _, t in train])
    y, f = np.array([known[i] for i, _ in train], float), np.array([fold[i] for i, _ in train])
    mean, scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    z = quality.lift(x, mean, scale)
    eye = np.eye(z.shape[1])
    ridge = lambda a: np.linalg.solve(z[a].T @ z[a] + quality.RIDGE * a.sum() * eye, z[a].T @ y[a])
    model = quality.fit(docs, training_labels(labels, "quality", 3, 1))
    assert np.allclose(z @ model.weights, z @ ridge(np.ones(len(y), bool)), atol=1e-4)
    raw = np.where(f == 0, z @ ridge(f == 1), z @ ridge(f == 0))
    at = np.clip(((raw + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    hits, count = np.bincount(at, y, quality.BINS), np.bincount(at, minlength=quality.BINS)
    some = count > 0
    knots, values = quality.isotonic(-0.5 + (np.flatnonzero(some) + 0.5) * 2 / quality.BINS, hits[some], count[some].astype(float))
    grid = np.linspace(-0.4, 1.4, 200)
    assert np.mean(np.abs(np.interp(grid, knots, values) - np.interp(grid, model.knots, model.values))) < 0.02


def test_toxicity_scores_restated(tables):
    """The query's scores are those of fit() on the labelled rows, each id's least text, the toxic ones once
    as positives and all with their label hidden; and its steps lower the plain risk."""
    docs, labels = tables
    known = {r["doc_id"]: r["label"] for r in training_labels(labels, "toxic", 5, 0).collect()}
    data = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    texts = {i: min(t for j, t in data if j == i) for i, _ in data if i in known}
    positives = [t for i, t in texts.items() if known[i] == 1]
    hidden = list(texts.values())
    x = toxicity.hashed_features([*positives, *hidden])
    positive = np.arange(len(x)) < len(positives)
    prior = sum(known.values()) / len(known)
    used, w, bias = toxicity.fit(x, positive, prior)
    dense = np.zeros(1 << toxicity.HASH_BITS)
    dense[used] = w
    want = {i: 1 / (1 + np.exp(-(dense[f].sum() + bias))) for (i, _), f in zip(data, toxicity.hashed_features([t for _, t in data]))}
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert all(abs(got[i] - s) < 1e-6 for i, s in want.items())

    def risk(z):
        loss = lambda v: np.logaddexp(0, -v)
        return prior * loss(z[positive]).mean() + max(0.0, loss(-z[~positive]).mean() - prior * loss(-z[positive]).mean())

    z = np.array([dense[f].sum() + bias for f in x])
    assert risk(z) < 0.5 * risk(np.full(len(x), np.log(prior / (1 - prior))))


@pytest.mark.parametrize("scores, column", [(quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_held_out_labels_are_not_learned_from(tables, scores, column):
    docs, labels = tables
    n, held = (3, 1) if column == "quality" else (5, 0)
    flipped = labels.withColumn(column, F.when(held_out("doc_id", n, held), 1 - F.col(column)).otherwise(F.col(column)))
    a, b = (scores(docs, x).groupBy("doc_id").agg(F.max("score").alias("s")) for x in (labels, flipped))
    assert a.join(b.withColumnRenamed("s", "t"), "doc_id").where("abs(s - t) > 1e-9").isEmpty()
    assert training_labels(labels, column, n, held).where(held_out("doc_id", n, held)).isEmpty()


def test_isotonic_rises_and_keeps_the_mean():
    rng = np.random.default_rng(1)
    score = np.sort(rng.uniform(size=50))
    count = rng.integers(1, 20, 50).astype(float)
    hits = np.floor(count * np.clip(score + rng.normal(0, 0.3, 50), 0, 1))
    knots, values = quality.isotonic(score, hits, count)
    assert (np.diff(values) >= 0).all() and (np.diff(knots) > 0).all()
    assert abs(np.sum(np.interp(score, knots, values) * count) - hits.sum()) < 1e-6


def test_kernel_is_approximated():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, quality.STATISTICS))
    z = quality.lift(x, np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS))[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * quality.STATISTICS))
    assert np.abs(z @ z.T - exact).mean() < 0.06


def test_positives_hidden_among_unlabelled_are_found():
    rng = np.random.default_rng(3)
    def doc(toxic):
        common = rng.integers(10, 60, 30)
        return np.unique(np.append(common, rng.integers(1000, 1010, 3) if toxic else [])).astype(np.uint32)
    positives, hidden, clean = [doc(True) for _ in range(200)], [doc(True) for _ in range(80)], [doc(False) for _ in range(720)]
    used, w, b = toxicity.fit([*positives, *hidden, *clean], np.arange(1000) < 200, 0.1)
    weight = dict(zip(used.tolist(), w.tolist()))
    score = lambda d: sum(weight.get(x, 0.0) for x in d.tolist()) + b
    assert np.mean([score(d) > 0 for d in hidden]) > 0.95 and np.mean([score(d) < 0 for d in clean]) > 0.95
