"""Inverted lists against the exact query."""

import numpy as np

from tesserae.operators import vector, vector_lists as L


def table(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids if ids is not None else range(len(x)), x)], "id long, vec array<double>").repartition(3)


def pairs(df):
    return sorted((r["qid"], r["id"], r["score"], r["rank"]) for r in df.collect())


def test_all_lists_give_the_exact_answer(spark, monkeypatch):
    monkeypatch.setattr(L, "CELL_ROWS", 16)
    monkeypatch.setattr(L, "QUERIES", 7)
    rng = np.random.default_rng(1)
    # Close ties, a vector that a third of the rows share, zeros, and rows whose bytes say little.
    x = np.vstack([rng.normal(size=(120, 12)), np.tile(rng.normal(size=12), (80, 1)), np.zeros((5, 12)), rng.normal(size=(20, 12)) * 1e6, rng.normal(size=(20, 12)) * 1e-9])
    docs = table(spark, x)
    q = docs.where("id % 20 = 0").withColumnRenamed("id", "qid")
    lists = L.build(docs, 6)
    assert lists.sizes.sum() == len(x) and lists.cells().max() > 4
    for k in (1, 10, 400):
        assert [r[:2] + r[3:] for r in pairs(lists.nearest(q, k, 6))] == [r[:2] + r[3:] for r in pairs(vector.nearest(docs, q, k))]


def test_recall_and_rows_met(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16)) * 3
    x = centres[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 16))
    docs = table(spark, x)
    q = docs.where("id % 50 = 0").withColumnRenamed("id", "qid")
    lists = L.build(docs)
    probes = lists.probes()
    exact, near = {r[:2] for r in pairs(vector.nearest(docs, q, 10))}, {r[:2] for r in pairs(lists.nearest(q, 10, probes))}
    assert len(exact & near) / len(exact) >= 0.9
    met = {r["qid"]: r["scanned"] for r in lists.scanned(q, probes).collect()}
    assert len(met) == 40 and max(met.values()) < 2000


def test_odd_vectors(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [0.0, 1.0]), (2, None), (3, [-1.0, 0.0])], "id long, vec array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.5]), (8, None)], "qid long, vec array<double>")
    lists = L.build(docs)
    got = sorted((r["qid"], r["id"] or 0, r["score"]) for r in lists.nearest(q, 9, 99).collect())
    assert got == [(7, 0, 0.5), (7, 1, 1.0), (7, 1, 1.0), (7, 3, -1.0)]
    empty = L.build(docs.where("id > 99"))
    assert empty.nearest(q, 3, 2).count() == 0 and empty.probes() == 1
