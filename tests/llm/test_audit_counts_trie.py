"""Filter audit, token counts and the conversation trie against plain restatements."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import public_tokenizers
import pytest

from tesserae.llm.filter_audit import RemovalPolynomial, audit
from tesserae.llm.prefix_trie import trie
from tesserae.llm.token_counts import counter, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# ---------------------------------------------------------------- filter audit

def audited(rows, labels):
    """Every order applied to every document; rows: (doc_id, text, lang)."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    parts = defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t):
            fails.add("C")
        if re.search(r"[#$%&*|]", t):
            fails.add("D")
        if i is not None and t in least and least[t] < i:
            fails.add("E")
        parts[lang or ""].append((i, fails))
    out, removed_by = [], Counter()
    for part, docs in parts.items():
        for order in map("".join, permutations("ABCDE")):
            alive = list(docs)
            for step, f in enumerate(order, 1):
                gone = [(i, x) for i, x in alive if f in x]
                alive = [(i, x) for i, x in alive if f not in x]
                removed_by[part, f] += len(gone)
                out.append([part, order, step, len(alive), len(gone), sum(f in x for _, x in docs) - len(gone), sum(x == {f} for _, x in docs),
                            sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)])
    return sorted((*r, removed_by[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_equals_applying_every_order(spark):
    rnd = random.Random(3)
    texts = [None, "", "\x0b \x1c", "A# b", "one two " * 150, " ".join(f"w{i}" for i in range(250)), " ".join(f"W{i}" for i in range(250)), "ÄÖ é 漢字 *", "x " * 30_000]
    rows = [(i, rnd.choice(texts), rnd.choice(["en", "de", "", None])) for i in range(60)]
    rows += [(None, "A# b", "en"), (None, "only here", "en"), (7, "A# b", "en"), (7, "A# b", "en"), (7, "A# b", "de"), rows[0], (-5, "one two " * 150, "fr")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 50)] + [(3, 1, 1), (None, 1, 1), (900, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, mask long, same long")
    found = audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert sorted(map(tuple, found)) == audited(rows, labels)


def test_audit_without_documents_or_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(spark.createDataFrame([], "doc_id long, text string, lang string"), none).count() == 0
    rows = audit(spark.createDataFrame([(1, "a", "x")], "doc_id long, text string, lang string"), none).collect()
    assert len(rows) == 600 and {r["good_lost"] for r in rows} == {0} and {r["kept"] for r in rows if r["step"] == 5} == {0}


def test_polynomial_values_are_fair_shares():
    """Against the average over all orders, with a share of more filters than the query has."""
    rnd = random.Random(1)
    counts = {m: rnd.randrange(50) for m in range(64)}
    f = RemovalPolynomial(counts, 6)
    for i in range(6):
        total = 0
        for order in permutations(range(6)):
            before = sum(1 << j for j in order[: order.index(i)])
            total += sum(n for m, n in counts.items() if m >> i & 1 and not m & before)
        assert f.shapley(i) * 720 == total
    assert all(f.corner[at] == sum(n for m, n in counts.items() if m & at) for at in range(64))


# ---------------------------------------------------------------- token counts

def library(texts):
    import sentencepiece

    return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(texts, num_threads=1)]


def odd_texts():
    rnd = random.Random(11)
    letters = ["ab", "abc ", "▁ a", "aehinrst .,'\n0", "éüß漢字😀 \t\0a", "<s></unk>0xA ", "  　▁▁▁", "=-*/#_ \r", "".join(map(chr, range(0x20, 0x3000, 7)))]
    out = ["", " ", "  ", "a  b", "<s> <unk> </s> <0x41>", "▁", "\0", "﷽" * 40, " " * 5000 + "x", "=" * 3000, "0" * 2000, "a" * 3000, "\n" * 100 + " a"]
    out += ["".join(rnd.choice(rnd_of) for _ in range(rnd.randrange(400))) for rnd_of in letters for _ in range(60)]
    return out


def test_counts_equal_the_library():
    texts = odd_texts()
    assert counter(MODEL).counts(texts) == library(texts)


def test_counts_of_long_texts_and_words():
    rnd = random.Random(2)
    words = ["".join(rnd.choice("aeinrst") for _ in range(rnd.randrange(1, 9))) for _ in range(60_000)]
    texts = [" ".join(words), "".join(words[:6000]), "  ".join(words) + " " * 50_000]
    assert counter(MODEL).counts(texts) == library(texts)


def test_memory_turns_over(monkeypatch):
    from tesserae.llm import token_counts as module

    monkeypatch.setattr(module, "BOUND", 50)
    monkeypatch.setattr(module, "WORDS", 40)
    texts = odd_texts()[-200:]
    assert module.Counter(MODEL).counts(texts) == library(texts)


def test_token_counts_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "漢字😀"), (4, "word " * 200_000)]
    docs = spark.createDataFrame([(i, t, 9, True) for i, t in rows], "doc_id long, text string, n_tokens long, over_limit boolean")
    found = token_counts(docs, MODEL, 4096).collect()
    n = library([t or "" for _, t in rows])
    assert sorted(map(repr, map(tuple, found))) == sorted(repr((i, len((t or "").encode()), k, k > 4096)) for (i, t), k in zip(rows, n))
    assert token_counts(docs.where("doc_id > 99"), MODEL).count() == 0


# ---------------------------------------------------------------- conversation trie

def tried(rows):
    """Every prefix of every rebuilt conversation as a key; rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saves = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saves[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
    return sorted(
        repr((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saves[k],
              hashlib.sha256(",".join(str(c) for c in sorted(m) if whole[c] == k).encode()).hexdigest()))
        for k, m in members.items()
    )


def rebuilt(spark, rows):
    table = spark.createDataFrame([(*r, 5, "x") for r in rows], "conv_id long, turn long, role string, text string, at long, path string")
    return sorted(repr(tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))) for r in trie(table.repartition(3)).collect())


def test_trie_of_shared_prefixes(spark):
    rnd = random.Random(8)
    rows = []
    for c in [*range(0, 60), *range(205, 230), 300, 301, 777]:
        for turn in range(rnd.randrange(1, 7)):
            rows.append((c, turn, "user" if turn % 2 else None, rnd.choice(["a", "bé", "漢字 x", None, ""])))
    assert rebuilt(spark, rows) == tried(rows)


def test_trie_of_odd_rows(spark):
    rows = [
        (None, 0, "user", "lost"), (1, None, "user", "first"), (1, 2, "a", "b"), (1, 2, "a", "b"), (1, 2, "ab", ""), (1, 2, "", "ab"),
        (100, 0, "u", "x"), (108, 0, "u", "own"), (5, 0, None, None), (-3, 0, "u", "y"), (-3, 1, "u", "z"), (-100, 0, "u", "w"),
    ]
    assert rebuilt(spark, rows) == tried(rows)
    assert rebuilt(spark, []) == []


def test_trie_of_long_conversations_and_snapshots(spark, monkeypatch):
    """A conversation over many blocks, snapshots of it, and many equal conversations."""
    from tesserae.llm import prefix_trie as module

    monkeypatch.setattr(module, "DEPTHS", 64)
    monkeypatch.setattr(module, "IDS", 16)
    long = [(0, t, "u", f"turn {t}") for t in range(700)]
    snapshots = [(c, t, "u", f"turn {t}") for c in (101, 150, 202, 303, 404) for t in range(c)]
    equal = [(c, t, "u", "same") for c in range(1000, 1090) for t in range(8)]
    rows = long + snapshots + equal + [(500, 0, "u", "w" * 200_000)]
    assert rebuilt(spark, rows) == tried(rows)


def test_shares_are_whole_for_any_masks():
    rnd = random.Random(4)
    for _ in range(50):
        f = RemovalPolynomial({m: rnd.randrange(10) for m in range(32)})
        assert all((f.shapley(i) * 120).denominator == 1 for i in range(5))
        assert sum(f.shapley(i) for i in range(5)) == f.corner[31]


@pytest.mark.parametrize("marks", ["a", "▁", " "])
def test_runs_of_one_character(marks):
    texts = [marks * n for n in (1, 2, 3, 15, 16, 17, 31, 33, 64, 200)]
    assert counter(MODEL).counts(texts) == library(texts)
