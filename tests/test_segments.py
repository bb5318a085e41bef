"""The stored index: changes, versions and top-k search by blocks, against an index built in one go."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.operators import block_scores as BS, index as I, search, segments as G
from tesserae.sources.stored import _OWNER, owned, stored

WORDS = [f"w{i}" for i in range(40)]


def items_of(spark, rows):
    return spark.createDataFrame(rows, "id long, terms array<string>")


def some(rnd, ids):
    return [(i, rnd.choice([None, [], [rnd.choice(WORDS[: rnd.randrange(1, 41)]) for _ in range(rnd.randrange(1, 30))]])) for i in ids]


def content(ix):
    return (
        {(r["term"], r["id"], round(r["weight"], 9)) for r in ix.postings.collect()}, {(r["term"], r["df"], round(r["idf"], 9)) for r in ix.terms.collect()},
        [(r["n_docs"], round(r["avg_len"], 9)) for r in ix.stats.collect()],
    )


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 4)
    monkeypatch.setattr(G, "SPLIT_DOCS", 16)


def test_changes_equal_one_build(spark, tmp_path, small):
    rnd = random.Random(1)
    first, second, third = some(rnd, range(0, 30)), some(rnd, range(30, 50)), some(rnd, [3, 4, 40, 77])
    ix = G.Segments(spark, f"file://{tmp_path}/ix", buckets=4)
    ix.add(items_of(spark, first)).add(items_of(spark, second))
    assert content(ix.index()) == content(I.build(items_of(spark, first + second).withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))))
    # 3, 4 and 40 change, 10 goes, 999 was never there; 4 is removed twice.
    ix.remove(spark.createDataFrame([(i,) for i in (3, 4, 4, 10, 40, 999)], "id long")).add(items_of(spark, third))
    gone = {3, 4, 10, 40}
    final = [(i, t or []) for i, t in first + second if i not in gone] + [(i, t or []) for i, t in third]
    want = content(I.build(items_of(spark, final)))
    assert content(ix.index()) == want
    assert content(G.Segments(spark, f"file://{tmp_path}/ix").index()) == want
    before = len(list((tmp_path / "ix").iterdir()))
    ix.compact()
    assert len(ix.live) == 1 and content(ix.index()) == want
    ix.vacuum()
    assert len(list((tmp_path / "ix").iterdir())) == 2 < before
    assert content(G.Segments(spark, f"file://{tmp_path}/ix").index()) == want


def test_top_k_skips_blocks_and_loses_nothing(spark, tmp_path, small, monkeypatch):
    rnd = random.Random(2)
    rows = some(rnd, range(400)) + [(i, ["w0", "w1", "w2"] * 5) for i in (402, 405, 409)]
    ix = G.Segments(spark, f"file://{tmp_path}/ix", buckets=4).add(items_of(spark, rows[:300])).add(items_of(spark, rows[300:])).remove(spark.createDataFrame([(405,), (7,)], "id long")).index()
    asked = spark.createDataFrame([(q, t) for q, terms in enumerate([["w0", "w1", "w2"], ["w39"], ["w5", "w38", "absent"], ["absent"], WORDS]) for t in terms], "qid long, term string")
    opened = []
    plain = search._opened
    monkeypatch.setattr(search, "_opened", lambda i, a, n, b, chosen=None: (opened.append(chosen.count()), plain(i, a, n, b, chosen))[1])
    for k in (1, 3, 50):
        got = {tuple(r) for r in search.bm25_top(ix, asked, k).select("qid", "id", "score", "rank").collect()}
        every = search.rank(plain(ix, *search._weighed(ix, asked)).where("score > 0"), k)
        flat = I.build(items_of(spark, [(i, t or []) for i, t in rows if i not in (405, 7)]))
        assert got == {tuple(r) for r in every.select("qid", "id", "score", "rank").collect()}
        assert got == {tuple(r) for r in search.bm25_top(flat, asked, k).select("qid", "id", "score", "rank").collect()}
    pairs = plain(ix, *search._weighed(ix, asked)).select("qid", "block").distinct().count()
    assert opened[0] + opened[1] < pairs / 2


def test_questions_beyond_the_broadcast_limit(spark, tmp_path, small, monkeypatch):
    rows = some(random.Random(3), range(60))
    ix = G.build_stored(items_of(spark, rows), f"file://{tmp_path}/ix")
    asked = spark.createDataFrame([(q, t) for q in range(5) for t in WORDS[q : q + 6]], "qid long, term string")
    want = {tuple(r) for r in search.bm25(ix, asked).collect()}
    monkeypatch.setattr(search, "BROADCAST_ROWS", 2)
    assert want and {tuple(r) for r in search.bm25(ix, asked).collect()} == want
    assert {tuple(r)[:3] for r in search.bm25_top(ix, asked, 100).collect()} == want


def test_passages_lie_in_their_items_blocks(spark, tmp_path, small):
    rows = spark.createDataFrame([((i, p), ["a", f"b{p}"]) for i in range(9) for p in range(3)], "id struct<id:long,pos:int>, terms array<string>")
    ix = G.build_stored(rows, f"file://{tmp_path}/ix", block=G.by_owner)
    assert {r["block"] for r in ix.segments.postings().collect()} == {0, 1, 2}
    asked = spark.createDataFrame([(0, "b2")], "qid long, term string")
    assert {(r["id"]["id"], r["id"]["pos"]) for r in search.bm25(ix, asked).collect()} == {(i, 2) for i in range(9)}


def test_searches_read_their_buckets_only(spark, tmp_path):
    ix = G.build_stored(items_of(spark, [(i, WORDS) for i in range(5)]), f"file://{tmp_path}/ix", buckets=32)
    asked = spark.createDataFrame([(0, "w3")], "qid long, term string")
    plan = search.bm25(ix, asked)._jdf.queryExecution().executedPlan().toString()
    of = spark.range(1).select(G.bucket(F.lit("w3"), 32)).first()[0]
    # One partition of 32 stands in the scan's partition filter.
    assert f"(bucket#" in plan and f"= {of})" in plan


def test_versions(spark, tmp_path):
    root = f"file://{tmp_path}/ix"
    empty = G.Segments(spark, root).index()
    assert empty.terms.count() == 0 and empty.postings.count() == 0 and empty.stats.first()["avg_len"] == 1.0
    one, other = G.Segments(spark, root), G.Segments(spark, root)
    one.add(items_of(spark, [(1, ["a"])]))
    versions = tmp_path / "ix" / "versions"
    assert [p.name for p in versions.iterdir() if not p.name.startswith(".")] == ["0"]
    # A version that was cut short doesn't count; the one before does.
    (versions / "1").write_text('{"buckets": 32, "segm')
    assert content(G.Segments(spark, root).index()) == content(one.index())
    # Who read the state before the first version can't write over it; who reads now goes on after the broken one.
    with pytest.raises(Exception, match="exist"):
        other.add(items_of(spark, [(2, ["b"])]))
    assert G.Segments(spark, root).add(items_of(spark, [(2, ["b"])])).index().terms.count() == 2
    assert sorted(p.name for p in versions.iterdir() if not p.name.startswith(".")) == ["0", "1", "2"]


def test_tables_go_with_their_owner(spark):
    from pathlib import Path

    with owned():
        kept = stored(spark.range(3))
        path = Path(_OWNER.get()[0][1].removeprefix("file://"))
        assert path.exists() and kept.count() == 3
    assert not path.exists()


def test_best_of_blocks_is_the_best_of_all(spark, tmp_path, small, monkeypatch):
    """Blocks cut by batches and steps: the k best of a task, ties by id, of items and of items' passages."""
    rnd = random.Random(4)
    lots = some(rnd, range(90))
    passages = [((i, p), t or []) for i in range(30) for p, (_, t) in enumerate(some(rnd, range(4)))]
    asked = spark.createDataFrame([(q, t) for q in range(7) for t in WORDS[q : 3 * q + 2]] + [(99, "absent")], "qid int, term string")
    ix = G.build_stored(items_of(spark, lots), f"file://{tmp_path}/ix")
    lines = G.build_stored(spark.createDataFrame(passages, "id struct<id:long,pos:int>, terms array<string>"), f"file://{tmp_path}/lines", block=G.by_owner)
    monkeypatch.setattr(search, "LISTED_ROWS", 3 if tmp_path.name.endswith("1") else 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    for k in (1, 3, 200):
        for i, owner in ((ix, None), (lines, "id")):
            every = search.bm25(i, asked)
            every = search.best_passage(every, F.col("id.id")) if owner else every
            found = search.best(i, asked, k, owner)
            assert found.schema["qid"].dataType.simpleString() == "int" and "Window" not in found._jdf.queryExecution().executedPlan().toString()
            want = {tuple(r) for r in search.rank(every.where("score > 0"), k).select("qid", "id", "score", "rank").collect()}
            assert want and {tuple(r) for r in search.rank(found, k).select("qid", "id", "score", "rank").collect()} == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("owner", [None, "id"])
def test_steps_and_cuts_of_block_scores(owner, monkeypatch):
    """Small steps and cuts between them find what one step finds."""
    rnd = random.Random(5)
    kind = pa.list_(pa.struct([("id", pa.int64()), ("pos", pa.int32())])) if owner else pa.list_(pa.int64())
    rows = []
    for block in range(5):
        for _ in range(12):
            ids = sorted(rnd.sample([(block * 10 + i, p) for i in range(10) for p in range(2)], rnd.randrange(1, 12))) if owner else sorted(rnd.sample(range(block * 10, block * 10 + 10), rnd.randrange(1, 9)))
            rows.append({"block": block, "ids": [{"id": i, "pos": p} for i, p in ids] if owner else ids, "tfs": [rnd.randrange(1, 5) for _ in ids], "lens": [rnd.randrange(5, 9) for _ in ids], "idf": rnd.random(), "qids": rnd.sample(range(9), rnd.randrange(1, 9))})
    table = pa.Table.from_pylist(rows, pa.schema([("block", pa.int64()), ("ids", kind), ("tfs", pa.list_(pa.int32())), ("lens", pa.list_(pa.int32())), ("idf", pa.float64()), ("qids", pa.list_(pa.int64()))]))
    run = lambda k, n: [tuple(r.values()) for b in BS.best_of_blocks(k, 6.5, owner, 9)(table.to_batches(n)) for r in b.to_pylist()]
    scores = {}
    for r in rows:
        for i, tf, size in zip(r["ids"], r["tfs"], r["lens"]):
            for q in r["qids"]:
                at = (q, i["id"], i["pos"]) if owner else (q, i, 0)
                scores[at] = scores.get(at, 0) + tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / 6.5)) * r["idf"]
    best = {}
    for (q, i, _), x in scores.items():
        best[q, i] = max(best.get((q, i), 0), round(x, 9))
    want = [(q, i, x) for q in range(9) for x, i in [(-y, j) for y, j in sorted((-x, i) for (p, i), x in best.items() if p == q)[:4]]]
    assert run(4, 1000) == want
    monkeypatch.setattr(BS, "STEP_SCORES", 15)
    monkeypatch.setattr(BS, "GATHERED", 20)
    assert run(4, 5) == want


def test_tasks_of_a_build_follow_the_blocks(spark, tmp_path, monkeypatch):
    """What a task counts or sorts is bounded: tasks are not merged to Spark's advisory size, however few bytes they have."""
    monkeypatch.setattr(G, "BLOCK", 4)
    monkeypatch.setattr(G, "SPLIT_DOCS", 16)
    monkeypatch.setattr(G, "TASK_BLOCKS", 2, raising=False)
    items = spark.createDataFrame([(i, [f"t{i % 7}", f"u{i}"]) for i in range(160)], "id long, terms array<string>")
    ix = G.Segments(spark, str(tmp_path / "ix"), buckets=2).add(items)
    folders = {}
    for f in (tmp_path / "ix").glob("add-*/postings/bucket=*/*.parquet"):
        folders.setdefault(f.parent.name, []).append(f)
    # 40 blocks, 4 to a file: before, one task wrote a bucket whole.
    assert len(folders) == 2 and sum(map(len, folders.values())) > 6
    rows = ix.postings().groupBy("term").agg(F.sum("n").alias("n")).collect()
    assert {r["term"]: r["n"] for r in rows} == {G.EVERY: 160, **{f"t{k}": len(range(k, 160, 7)) for k in range(7)}, **{f"u{i}": 1 for i in range(160)}}


@pytest.mark.parametrize("listed", [1, 1000])
def test_best_under_a_filter_is_the_best_of_what_passes(spark, tmp_path, monkeypatch, listed):
    """Blocks are scored under each question's filter, so that scores of all items are neither shuffled nor ranked."""
    monkeypatch.setattr(search, "LISTED_ROWS", listed)
    monkeypatch.setattr(G, "BLOCK", 16)
    rnd = random.Random(6)
    lots = some(rnd, range(90))
    passages = [((i, p), t or []) for i in range(60) for p, (_, t) in enumerate(some(rnd, range(3)))]
    asked = spark.createDataFrame([(q, t) for q in range(7) for t in WORDS[q : 3 * q + 2]], "qid int, term string")
    # Ids from 80 on are no items; one kind is null; a rule that nothing passes is dropped; question 6 has no filter row.
    items = spark.createDataFrame([(i, None if i % 9 == 0 else f"{i % 2 + 1}a", str(2015 + i % 4)) for i in range(80)], "id long, instance string, year string")
    filters = spark.createDataFrame([(0, None, None), (1, "1", None), (2, "2", "2016"), (3, "1", "1999"), (4, None, "2018"), (5, "1a", None)], "qid int, instance string, year string")
    ix = G.build_stored(items_of(spark, lots), f"file://{tmp_path}/ix")
    lines = G.build_stored(spark.createDataFrame(passages, "id struct<id:long,pos:int>, terms array<string>"), f"file://{tmp_path}/lines", block=G.by_owner)
    for k in (1, 4, 200):
        for i, owner in ((ix, None), (lines, "id")):
            every = search.bm25(i, asked)
            every = search.best_passage(every, F.col("id.id")) if owner else every
            every = search.filtered(every, items, filters).where("score > 0")
            found = search.best(i, asked, k, owner, only=(items, filters))
            assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
            want = {tuple(r) for r in search.rank(every, k).select("qid", "id", "score", "rank").collect()}
            assert want and {tuple(r) for r in search.rank(found, k).select("qid", "id", "score", "rank").collect()} == want
    monkeypatch.setattr(search, "KINDS", 2)
    found = search.best(ix, asked, 4, only=(items, filters))
    want = {tuple(r) for r in search.rank(search.filtered(search.bm25(ix, asked), items, filters), 4).select("qid", "id", "score").collect()}
    assert {tuple(r) for r in search.rank(found, 4).select("qid", "id", "score").collect()} == want


def test_questions_of_a_block_are_listed_once(spark, tmp_path, small, monkeypatch):
    """What a task sorts grows with its postings, not with these times the questions that a block is opened for."""
    rnd = random.Random(7)
    ix = G.build_stored(items_of(spark, some(rnd, range(200))), f"file://{tmp_path}/ix")
    asked = spark.createDataFrame([(q, t) for q in range(30) for t in WORDS[q % 7 : 3 * q % 40 + 3]], "qid long, term string")
    weighed = search._weighed(ix, asked)
    chosen = search.bm25(ix, asked).where("qid % 3 > 0 or id < 100").select("qid", F.floor(F.col("id") / 4).alias("block")).distinct()
    best = search.best_of_blocks

    def spied(*a):
        def spy(batches):
            for b in batches:
                rows = b.to_pylist()
                if any(r["wanted"] is not None and r["ids"] is not None for r in rows):
                    raise ValueError("questions beside a posting")
                yield from ()

        return spy

    monkeypatch.setattr(search, "best_of_blocks", spied)
    assert search._best(ix, *weighed, 3, chosen=chosen).count() == 0
    monkeypatch.setattr(search, "best_of_blocks", best)
    for listed in (1, 1000):
        monkeypatch.setattr(search, "LISTED_ROWS", listed)
        every = search._opened(ix, *weighed, chosen).where("score > 0")
        want = {tuple(r) for r in search.rank(every.select("qid", "id", "score"), 3).collect()}
        assert want and {tuple(r) for r in search.rank(search._best(ix, *weighed, 3, chosen=chosen), 3).collect()} == want
