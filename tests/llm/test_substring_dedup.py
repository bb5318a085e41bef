import hashlib
import random
import re

import numpy as np
import pytest

from tesserae.llm import substring_dedup as sd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k=sd.WINDOW):
    """Removed words by counting every window's exact word tuple."""
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = {}
    for _, w in words:
        for j in range(len(w) - k + 1):
            seen[tuple(w[j : j + k])] = seen.get(tuple(w[j : j + k]), 0) + 1
    out = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - k + 1):
            if seen[tuple(w[j : j + k])] > 1:
                gone.update(range(j, j + k))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(spark, tmp_path, rows, docs_of):
    docs_of(rows).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in sd.op4(spark, str(tmp_path)).collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(300)]
    passages = [rng.choices(vocab, k=n) for n in (34, 35, 36, 50, 80, 300)]
    rows = []
    for _ in range(150):
        w = rng.choices(vocab, k=rng.randrange(1, 120))
        for p in rng.sample(passages, k=rng.randrange(0, 3)):
            at = rng.randrange(len(w) + 1)
            cut = rng.randrange(0, 8)
            w[at:at] = p[cut:]
        rows.append(" ".join(w))
    rows += ["x " * 34, "x " * 35, "y " * 36, "a b c " * 40, "a b " * 17 + "a", None, "", " \n\t ", rows[0], rows[0], "é ü\xa0z " * 30]
    return list(enumerate(rows))


def test_against_brute_force(spark, tmp_path, docs_of, corpus):
    assert result(spark, tmp_path, corpus, docs_of) == brute(corpus)


def test_hot_anchors_and_small_batches_change_nothing(spark, tmp_path, docs_of, corpus, monkeypatch):
    monkeypatch.setattr(sd, "HOT_BLOCKS", 3)
    monkeypatch.setattr(sd, "HOT_TIMES", 0)
    monkeypatch.setattr(sd, "MAX_SLOT_BITS", 20)
    monkeypatch.setattr(sd, "FLUSH_WORDS", 500)
    assert result(spark, tmp_path, corpus, docs_of) == brute(corpus)


def test_repeated_and_null_ids(spark, tmp_path, docs_of):
    long = " ".join(f"q{i}" for i in range(40))
    rows = [(1, long), (1, "other text"), (None, long + " tail"), (2, "short"), (2, "short")]
    assert result(spark, tmp_path, rows, docs_of) == brute(rows)


def test_empty_table_and_texts_without_words(spark, docs_of):
    assert sd.remove_duplicates(docs_of([(1, "a")]).limit(0)).count() == 0
    assert sd.strip_duplicates(docs_of([(1, "a")]).limit(0)).count() == 0
    got = [tuple(r) for r in sd.remove_duplicates(docs_of([(0, None), (1, ""), (2, " \n")])).collect()]
    assert sorted(got) == [(i, 0, 0, "", []) for i in range(3)]


def test_very_long_texts(spark, tmp_path, docs_of):
    rng = random.Random(4)
    w = [f"z{rng.randrange(5000)}" for _ in range(60_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[50_000:50_200])), (3, "same " * 30_000), (4, " ".join(w[:40_000]) + " end")]
    assert result(spark, tmp_path, rows, docs_of) == brute(rows)


def test_factors_and_their_references(docs_of, corpus):
    """Each factor is the same words at its reference, which is another place."""
    rows = [(i, t) for i, t in corpus if t]
    words = {i: WORD.findall(t) for i, t in rows}
    n = 0
    for r in sd.remove_duplicates(docs_of(rows)).collect():
        for f in r["factors"]:
            n += 1
            assert f["length"] >= sd.WINDOW and (f["ref"], f["at"]) != (r["doc_id"], f["start"])
            assert words[f["ref"]][f["at"] : f["at"] + f["length"]] == words[r["doc_id"]][f["start"] : f["start"] + f["length"]]
    assert n > 100


def test_longest_matches_and_the_greedy_parse():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes = rng.integers(1, 12, 12)
        window = rng.integers(1, rng.integers(2, 9), sizes.sum()).astype(np.uint64)
        remaining = np.concatenate([np.arange(n, 0, -1) for n in sizes])
        length, place = sd.longest_matches(window, np.zeros(len(window), np.uint64), remaining)

        def common(p, q):
            k = 0
            while k < min(remaining[p], remaining[q]) and window[p + k] == window[q + k]:
                k += 1
            return k

        want = [max(common(p, q) for q in range(len(window)) if q != p) for p in range(len(window))]
        assert length.tolist() == want
        assert all(n == 0 or (q != p and common(p, q) == n) for p, (n, q) in enumerate(zip(length, place)))
        taken, at = [], 0
        while at < len(window):
            if want[at]:
                taken.append(at)
            at += max(1, want[at])
        assert sorted(sd.greedy_factors(length, remaining).tolist()) == taken


def test_strip_keeps_columns_and_untouched_texts(docs_of):
    long = " ".join(f"q{i}" for i in range(40))
    rows = [(1, long + "  end\n"), (2, "begin " + long), (3, "as  it\nis"), (4, None)]
    got = {r["doc_id"]: r for r in sd.strip_duplicates(docs_of(rows)).collect()}
    assert {i: r["text"] for i, r in got.items()} == {1: "end", 2: "begin", 3: "as  it\nis", 4: None}
    assert got[1]["n_chars"] == 3 and got[3]["n_chars"] == 0 and got[1]["cls"] == 7


def test_clashing_column_names(spark):
    long = " ".join(f"q{i}" for i in range(40))
    rows = [(1, long + " a", "s", 5, "r"), (2, "b " + long, "t", 6, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, key_id int, row string")
    assert sorted(tuple(r) for r in sd.strip_duplicates(docs).collect()) == [(1, "a", "s", 5, "r"), (2, "b", "t", 6, "q")]


def test_a_bucket_stands_for_few_megabytes_of_text(spark, monkeypatch):
    class Stop(Exception):
        pass

    def factor(n, n_shards):
        raise Stop(n)

    monkeypatch.setattr(sd, "_factor", factor)
    rows = spark.range(80).selectExpr("id as key_id", "id as key_hash", "cast(repeat('a b c d ', 65536) as binary) as text")
    with pytest.raises(Stop) as stop:
        sd.duplicate_spans(rows)
    assert stop.value.args[0] >= 80 * (1 << 19) // (4 << 20)


def test_contents_of_blocks_are_hashed_alike_in_small_steps(monkeypatch):
    rng = np.random.default_rng(5)
    length = rng.integers(1, 40, 300)
    at = np.cumsum(length) - length
    window = rng.integers(0, 1 << 62, length.sum()).astype(np.uint64)
    whole = sd._contents(window, at, length)
    for step in (1, 16, 1000):
        monkeypatch.setattr(sd, "STEP_WINDOWS", step)
        assert (sd._contents(window, at, length) == whole).all()
