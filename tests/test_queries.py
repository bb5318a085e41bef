"""Every query with SQL against DuckDB on the smallest test tables; the rest give rows."""

import os

import duckdb
import pytest

from tesserae.plans import ORACLES, QUERIES, search_queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(repr(tuple(round(float(x), 6) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    got = df.select(sorted(df.columns)).collect()
    if name not in ORACLES:
        assert got
        return
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert plain(got) == plain(duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in sorted(df.columns))} FROM ({ORACLES[name]})").fetchall())


def test_gold_holds_documents_of_any_rank(spark, tmp_path):
    """Sixty short documents of the same words outrank the one that holds the passage."""
    passage = "alpha beta gamma delta"
    texts = {i: "beta alpha delta gamma" for i in range(60)} | {60: f"{'other words here ' * 200}x{passage}y end", 61: "a one-word b", 62: None}
    spark.createDataFrame([(i, t, "en", "s") for i, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, "one-word"), (3, ""), (4, None), (5, "absent from all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {tuple(r) for r in search_queries._gold(spark, str(tmp_path)).collect()} == {(1, 60), (2, 61)}
    assert QUERIES["eval_top1"](spark, str(tmp_path)).first()["n"] == 2


def test_whole_plan_against_counts(spark, duck):
    """Named decisions, guidance and panoramas of the whole plan follow from the tables."""
    plan = QUERIES["evidence_plan_all"](spark, SF_DIR).collect()
    by = {}
    for r in sorted(plan, key=lambda r: r["number"]):
        by.setdefault(r["qid"], []).append(r)
    assert all([r["number"] for r in rows] == list(range(1, len(rows) + 1)) for rows in by.values())
    order = ["guidance", "statute", "opinion", "decision", "panorama"]
    assert all((k := [order.index(r["kind"]) for r in rows]) == sorted(k) for rows in by.values())
    held = {i for (i,) in duck.sql("SELECT doc_id FROM documents").fetchall()}
    for (item,) in duck.sql("SELECT item_id FROM benchmark WHERE item_id % 4 = 1").fetchall():
        named = [r["ref"] for r in by.get(item, []) if r["reason"] == "citada na pergunta"]
        assert named == ([str(item)] if item in held else [])
    for n, total in duck.sql("SELECT doc_id % 25, count(*) FROM documents WHERE lang NOT IN ('en', 'de') GROUP BY 1").fetchall():
        rows = by[1_000_000 + n]
        assert [r["ref"] for r in rows if r["kind"] == "guidance"] == [f"guidance#{n}"]
        first = next(r["passages"] for r in rows if r["kind"] == "panorama").splitlines()
        assert first[0].endswith(f"quadra q{100 + n}") and first[1] == f"Total de decisões no acervo: {total} (2ª instância: {total})"


def test_plan_of_passages_has_statutes(spark):
    """The benchmark's passages are laws too, so the statute tier of their plan isn't empty."""
    plan = QUERIES["evidence_plan"](spark, SF_DIR).collect()
    assert {"statute", "decision"} <= {r["kind"] for r in plan}
