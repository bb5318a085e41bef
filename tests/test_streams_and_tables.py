"""Conversation state over micro-batches, published tables, ordinals over files, passages, the count cube."""

import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tesserae.operators import chunk, evaluate, evidence, panorama as P
from tesserae.sources import records as R, versions
from tesserae.streaming import conversations as C

START = 1_700_000_000


def streamed(spark, tmp_path, arrivals):
    """What each arrival of (conv_id, turn, role, text, minute) adds, in turn."""
    out = []
    with C.state_store(spark):
        for rows in arrivals:
            df = spark.createDataFrame([(c, t, r, x, START + 60 * m) for c, t, r, x, m in rows], "conv_id long, turn long, role string, text string, m long")
            df.select("conv_id", "turn", "role", "text", F.timestamp_seconds("m").alias("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            C.run(C.read_turns(spark, f"{tmp_path}/in", 100), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
            seen = {tuple(r) for r in spark.read.schema(C.ASKED + ", batch int").parquet(f"{tmp_path}/out").select("conv_id", "turn", "query", F.to_json("messages")).collect()}
            out.append(seen - set().union(*out) if out else seen)
    return out


def test_state_lives_between_batches_and_ends_when_idle(spark, tmp_path):
    two = "um auto sobre mesas e cadeiras no passeio público sem alvará de funcionamento"
    first = [(1, 0, "user", two, 0), (1, 1, "assistant", "x" * 900, 1), (2, 0, "system", "regras", 0), (2, 1, "user", None, 0)]
    second = [(1, 3, "assistant", None, 3), (1, 2, "user", "e o prazo?", 2), (2, 2, "user", "oi", 1)]
    # Days later: what was said before is forgotten in a batch whose time shows that it is over.
    third = [(9, 0, "user", "outro", 60 * 24 * 5)]
    fourth = [(1, 4, "user", "e agora?", 60 * 24 * 5)]
    got = streamed(spark, tmp_path, [first, second, third, fourth])
    pair = lambda q, a: [{"role": "user", "content": q}, {"role": "assistant", "content": a}]
    plain = lambda rows: {(c, t, q, json.dumps(json.loads(m))) for c, t, q, m in rows}
    assert plain(got[0]) == {(1, 0, two, "[]"), (2, 1, "", "[]")}
    assert plain(got[1]) == {(1, 2, f"{two} e o prazo?", json.dumps(pair(two, "x" * 800))), (2, 2, " oi", json.dumps(pair("", "oi")))}
    assert plain(got[3]) == {(1, 4, "e agora?", "[]")}


def test_stream_equals_the_batch(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", "assistant"]), " ".join(rnd.choice(["mesa", "alvará", "prazo", "multa", "junta"]) for _ in range(rnd.randrange(0, 12))), t) for c in range(12) for t in range(9)]
    got = streamed(spark, tmp_path, [[r for r in rows if r[1] in turns] for turns in (range(0, 3), range(3, 4), range(4, 9))])
    turns = [(c, t, x, next((y for d, u, _, y, _ in rows if (d, u) == (c, t + 1)), "")) for c, t, r, x, _ in rows if r == "user"]
    table = spark.createDataFrame(turns, "conv_id long, turn long, question string, answer string")
    asked = evidence.follow_ups(table).select("conv_id", "turn", "query").join(evidence.history(table), ["conv_id", "turn"])
    assert set().union(*got) == {tuple(r) for r in asked.select("conv_id", "turn", "query", F.to_json("messages")).collect()}


def test_published_tables_hold_each_write_once(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    assert versions.published(spark, root) is None
    rows = spark.range(40).withColumn("v", F.lit("a"))
    broken = rows.repartition(4).withColumn("v", F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.lit("a")))
    with pytest.raises(PySparkException, match="lost"):
        versions.publish(broken, root, "w")
    assert versions.published(spark, root) is None
    for _ in range(2):
        versions.publish(rows, root, "w")
    versions.publish(rows.select((F.col("id") + 40).alias("id")), root)
    held = versions.published(spark, root).collect()
    assert sorted(r["id"] for r in held) == list(range(80)) and {r["v"] for r in held if r["id"] >= 40} == {None}
    assert versions.clean(spark, root) == 1 and versions.published(spark, root).count() == 80


def test_ordinals_follow_files_and_lines(spark, tmp_path):
    lines = [json.dumps({"file_id": f"f{i}", "texto": "é" * (i % 90)}) for i in range(3000)]
    for name, part in (("b", lines[1000:2990]), ("a", lines[:1000]), ("c", lines[2990:]), ("d", [])):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(part) + "\n\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("8k", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = R.read_jsonl(spark, f"file://{tmp_path}", R.OPINIONS)
            assert {r["id"]: r["file_id"] for r in got.collect()} == {i: f"f{i}" for i in range(3000)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    empty = tmp_path / "none"
    empty.mkdir()
    assert R.read_jsonl(spark, f"file://{empty}", R.OPINIONS).count() == 0


def _folded(lines, target):
    """Passages as the rules say, one character string at a time."""
    paragraphs, held, chars = [], [], 0
    for line in [*lines, ""]:
        chars += len(line)
        held += [line] if line else []
        if line == "" or (chars > 200 and line[-1] in ".:;"):
            paragraphs += [" ".join(held)] if held else []
            held, chars = [], 0
    out, now = [], ""
    for p in paragraphs:
        cut = False
        while len(p) > 1.6 * target:
            at = p[: int(1.4 * target)].rfind(". ", int(0.6 * target))
            at = at + 1 if at >= 0 else target
            out += [now, p[:at].strip()] if not cut else [p[:at].strip()]
            now, cut, p = "", True, p[at:].strip()
        if now and len(now) + len(p) > target:
            out, now = [*out, now], ""
        now = f"{now} {p}" if now else p
    return [x for x in [*out, now] if len(x) > 25]


def test_passages_against_their_rules():
    rnd = random.Random(5)
    for _ in range(400):
        lines = [" ".join(rnd.choice(["mesa.", "alvará", "x", "prazo;", "da junta:"]) for _ in range(rnd.randrange(0, 60))) for _ in range(rnd.randrange(0, 12))]
        for target in (30, 120, 650):
            assert chunk.passages_of(lines, target) == _folded(lines, target)


def test_a_paragraph_of_ten_megabytes(spark):
    text = "Uma frase do voto. " * 550_000
    one = spark.createDataFrame([(text,)], "t string").select(chunk.passages(chunk.clean_lines("t")).alias("p")).first()["p"]
    assert all(len(p) <= 1.6 * 650 for p in one) and " ".join(one) == text.strip()


def test_clean_lines_keeps_what_looks_like_a_mark(spark):
    text = "a\x0012\nb\nb\nc\x005"
    assert spark.createDataFrame([(text,)], "t string").select(chunk.clean_lines("t").alias("l")).first()["l"] == ["a\x0012", "b", "c\x005"]


def test_cube_counts_items_once(spark):
    rnd = random.Random(9)
    items = [(i, rnd.choice([None, [], ["a"], ["b", "a"], ["a", "b", "a"], ["c"]]), rnd.choice(["deferido", "", None]), rnd.choice(["1ª", "2ª", None]), rnd.choice(["", "2020", "2021"])) for i in range(300)]
    asked = [(0, None, None, None), (1, ["a", "b", "a"], None, None), (2, ["c", "zz"], "1", "2020"), (3, None, "2", None), (4, [], None, None), (5, None, "9", None)]
    cells = P.cube(spark.createDataFrame(items, "id long, keys array<string>, outcome string, instance string, year string"))
    got = {tuple(r) for r in P.panorama(P.selected(cells, spark.createDataFrame(asked, "rid long, keys array<string>, instance string, year string"))).select("rid", "facet", "value", "n").collect()}
    want = {}
    for rid, keys, instance, year in asked:
        for _, own, outcome, inst, y in items:
            if (keys is None or set(keys) & set(own or [])) and (instance is None or (inst or "").startswith(instance)) and (year is None or y == year):
                for facet, value in (("total", ""), ("outcome", outcome or "não identificado"), ("instance", inst or ""), ("year", y)):
                    if facet != "year" or value:
                        want[rid, facet, value] = want.get((rid, facet, value), 0) + 1
    assert got == {(*k, n) for k, n in want.items()}


def test_cells_are_not_broadcast(spark, tmp_path):
    """A small file of cells can hold many: the requests for keys are broadcast to them, not they to these."""
    P.cube(spark.range(200).selectExpr("array(cast(id as string)) keys", "'' outcome", "'1' instance", "'2020' year")).write.parquet(f"{tmp_path}/cells")
    asked = spark.createDataFrame([(1, ["7", "9"], None, None)], "rid long, keys array<string>, instance string, year string")
    chosen = P.selected(spark.read.parquet(f"{tmp_path}/cells"), asked)
    joins = [x for x in chosen._jdf.queryExecution().executedPlan().toString().split("\n") if "Join [key#" in x]
    assert len(joins) == 1 and "BuildRight" in joins[0] and chosen.count() == 2


def test_narratives_and_theses(spark):
    keys = spark.createDataFrame([(1, ["k"]), (2, ["k", "j"]), (3, ["j"]), (4, [])], "id long, keys array<string>")
    hits = spark.createDataFrame([(10, 1, 1), (10, 2, 2), (10, 3, 3), (12, 1, 1)], "qid long, id long, rank int")
    asked = spark.createDataFrame([(10, 1), (11, 2), (12, 4)], "qid long, id long")
    assert tuple(evaluate.same_offence_at(hits, asked, keys).first()) == (2, 0.25)
    theses = spark.createDataFrame([(10, "a|b"), (13, "x")], "qid long, pattern string")
    texts = spark.createDataFrame([(1, "aa"), (2, "c"), (3, "b")], "id long, text string")
    assert tuple(evaluate.on_thesis_at(hits, theses, texts, 2).first()) == (2, 0.25)
