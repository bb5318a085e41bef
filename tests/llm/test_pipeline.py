"""The pipeline's stages against plain restatements, and the queries that SQL can express."""

import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from test_ngram_join import brute as plain_components
from test_substring_dedup import WORD, brute as plain_removal
from test_text_operators import plain_measures

import corpus_pipeline
from tesserae.llm import registry
from tesserae.llm.sql import ORACLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def make(spark, folder):
    rng = random.Random(12)
    vocab = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "st", "rm", "lly", "x")]
    passage = rng.choices(vocab, k=60)
    docs, labels = [], []
    for i in range(260):
        good = rng.random() < 0.8
        words = rng.choices(vocab, k=rng.randrange(55, 200))
        if docs and rng.random() < 0.2:
            words = docs[rng.randrange(len(docs))][1].split()
            words[rng.randrange(len(words))] = "changed"
        elif not good:
            words = [w for w in words[:12] for _ in range(8)]
        elif rng.random() < 0.3:
            words[20:20] = passage
        docs.append((i, " ".join(words), "en", f"src{i % 4}", 0))
        labels.append((i, int(len(set(words)) > 40), 0))
    docs += [(900, None, "en", "src0", 0), (901, "", "en", None, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_stages_against_plain_versions(spark, tmp_path):
    from tokenizers import Tokenizer
    import public_tokenizers

    source = {d[0]: d for d in make(spark, tmp_path)}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{i}")
        docs = spark.read.parquet(f"{tmp_path}/stage{i}")
        kept.append([tuple(r) for r in docs.collect()])
        assert i == 4 or docs.columns == columns
    after = [{r[0]: r[1] for r in k} for k in kept]
    # Quality: rows come through unchanged, repeated words go, varied ones stay.
    assert all(tuple(source[r[0]]) == r for r in kept[0])
    varied = [i for i, d in source.items() if len(set((d[1] or "").split())) > 40]
    assert sum(i in after[0] for i in varied) >= 0.97 * len(varied) and len(after[0]) < len(source)
    # Rules: what fails by itself goes; no host here is bad as a whole.
    def passes(t):
        n, *_, repeated = plain_measures(t)
        return n >= 50 and 100 * repeated <= 50 * n
    assert set(after[1]) == {i for i, t in after[0].items() if passes(t)}
    # Near copies: the least id of each component stays.
    assert set(after[2]) == {i for i, _, c in plain_components(sorted(after[1].items())) if i == c} and len(after[2]) < len(after[1])
    # Passages: removed words as counted over what came in.
    removed = {i: gone for i, _, gone, _ in plain_removal(sorted(after[2].items()))}
    assert set(after[3]) == set(after[2]) and any(removed.values())
    for i, t in after[3].items():
        assert len(WORD.findall(t or "")) == len(WORD.findall(after[2][i] or "")) - removed[i]
        assert removed[i] or t == after[2][i]
    # Packing: every id of every text in one piece.
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for doc, start, length, crc, total, *_ in sorted(kept[4]):
        pieces.setdefault(doc, []).append((start, length, crc, total))
    assert set(pieces) == set(after[3])
    for i, t in after[3].items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert [(s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids)) for s, n, *_ in pieces[i]] == pieces[i] and sum(n for _, n, *_ in pieces[i]) == len(ids)


def test_stages_decide_by_row(spark, tmp_path):
    """Rows without an id, of one id, equal rows and no rows."""
    make(spark, tmp_path)
    rng = random.Random(1)
    text = lambda n=80: " ".join(f"{rng.choice('bdfg')}{rng.choice('aeiou')}n{rng.randrange(500)}" for _ in range(n))
    a, b, c, d = text(), text(), text(), text(3000)
    rows = [(None, "two words"), (None, a), (7, "too short"), (7, b), (8, c), (8, c), (9, d), (9, d), (10, b + " end"), (None, None)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, cls int, __row int, spans int"
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or ""), 1, 2, 3) for i, t in rows], columns)
    texts = lambda df: sorted((str(r["doc_id"]), r["text"] or "") for r in df.collect())
    good = sorted((str(i), t) for i, t in rows if t and len(t) > 60)
    assert texts(corpus_pipeline.rules_stage(spark, docs, str(tmp_path))) == good
    once = sorted([("None", a), ("7", b), ("8", c), ("9", d), ("None", "two words"), ("7", "too short"), ("None", "")])
    assert texts(corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path))) == once
    stripped = corpus_pipeline.substring_stage(spark, docs, str(tmp_path))
    assert texts(stripped) == sorted([("None", "two words"), ("None", a), ("7", "too short"), ("7", ""), ("8", ""), ("8", ""), ("9", ""), ("9", ""), ("10", "end"), ("None", "")])
    assert stripped.columns == docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns), name


def test_run_gives_the_last_stages_rows(spark, tmp_path):
    make(spark, tmp_path)
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_with_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = registry.queries()[name](spark, SF_DIR)
    names = sorted(df.columns)
    want = c.sql(f"SELECT {', '.join(names)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select(names).collect()))) == sorted(map(repr, want))
