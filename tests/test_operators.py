"""Chunking, sources, index, search, counts, evidence and answers on small inputs."""

import io
import json
import math
import zipfile
from collections import Counter

import pytest
from hypothesis import given, strategies as st
from pyspark.sql import SparkSession, functions as F

from tesserae.functions.text import terms
from tesserae.operators import answer, chunk, evaluate, evidence as E, index as I, panorama as P, search, vector
from tesserae.operators.segments import build_stored
from tesserae.sources import binary, records as R
from tesserae.streaming import questions as Q


def rows(df):
    return [tuple(r) for r in df.collect()]


# ------------------------------------------------------------------ chunking


def test_passages_keep_near_their_target():
    got = chunk.passages_of([f"Linha número {i} com algum texto." for i in range(200)], 650)
    assert len(got) > 5 and max(map(len, got)) <= 1040
    assert chunk.passages_of(["curto"], 650) == []
    assert chunk.passages_of(["x" * 3000], 650)[0] == "x" * 650


@given(st.lists(st.text("ab .:\n", max_size=80), max_size=60), st.integers(50, 900))
def test_passages_lose_no_long_text(lines, target):
    lines = [" ".join(x.split()) for x in lines]
    got = chunk.passages_of(lines, target)
    assert all(len(p) > 25 and len(p) <= 2 * target + 1 for p in got)
    assert sum(len(p.replace(" ", "")) for p in got) <= sum(len(x.replace(" ", "")) for x in lines)


def test_clean_lines(value):
    assert value(chunk.clean_lines, "Cabeçalho\n a  b \n1 / 2\nCabeçalho\n\n\nfim\n") == ["Cabeçalho", "a b", "", "", "fim"]
    assert value(chunk.clean_lines, "") == []
    many = [f"line {i % 3000}" for i in range(6000)]
    assert value(chunk.clean_lines, "\n".join(many)) == many[:3000]


def searched():
    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame(list(TEXTS.items()), "id long, text string")
    return {r["id"]: r["t"] for r in df.select("id", terms("text").alias("t")).collect()}


def topics_of(spark, paragraphs):
    rows = chunk.topics(spark.createDataFrame([(7, paragraphs)], "id long, paragraphs array<string>")).orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(len(rows)))
    return [(r["title"], r["body"]) for r in rows]


def test_topics(spark):
    got = topics_of(spark, [
        "SUMÁRIO", "1 - Dupla visita - Pg. 3", "Texto de apresentação", "CAPÍTULO VI – TEMAS DE DIREITO", "1 - Dupla visita.", "A dupla visita vale.",
        "1.1 - Mesas e cadeiras", "Inciso:", "I - uma coisa", "2 - Outro", "Fim.",
    ])
    assert [t for t, _ in got] == ["Apresentação", "CAPÍTULO VI – TEMAS DE DIREITO › 1 - Dupla visita.", "CAPÍTULO VI – TEMAS DE DIREITO › 1 - Dupla visita. › 1.1 - Mesas e cadeiras", "CAPÍTULO VI – TEMAS DE DIREITO › 2 - Outro"]
    assert "I - uma coisa" in got[2][1] and not any("Pg." in b for _, b in got)
    glued = topics_of(spark, ["1- Alvará de localização - com ressalvas. " + "O alvará é exigido. " * 12])
    assert glued[0][0].endswith("1 - Alvará de localização") and glued[0][1].startswith("com ressalvas.")


def test_paragraphs(value):
    assert value(chunk.paragraphs_of_text, "um\ndois\n\n \ntrês\n\n") == ["um dois", "três"]


# ------------------------------------------------------------------ sources


def test_struck_text_and_notes(spark):
    text = "Art. 1º - Velha regra.\nArt. 1º - Nova regra.\nArt. 1º com redação dada pela Lei nº 9."
    df = spark.createDataFrame([(text, [[0, 22]])], "t string, s array<array<int>>")
    got = df.select(R.without_struck("t", F.col("s"), F.lit(0), F.length("t"))).first()[0]
    assert got.strip().startswith("Art. 1º - Nova regra.") and "Velha" not in got
    note = spark.createDataFrame([("Inciso I com redação dada pelo Decreto 1",), ("§ 2º - revogada pelo uso",), ("a | revogado por | b",)], "x string")
    assert [r[0] for r in note.select(R.is_note(F.col("x"))).collect()] == [True, False, False]


def test_decisions_from_json_lines(spark, tmp_path):
    raw = [
        {"file_id": "a", "nome_arquivo": "a.pdf", "protocolo": "31.00960807/2025-31", "assunto": "Cancelamento", "instancia": "2a_instancia", "autos": [{"numero": "20250012345an", "infracao": " Mesas em calçada "}],
         "texto": "SESSÃO 11/02/2026\nJIJFI-II\n" + "Relato do caso em questão, com detalhes. " * 40 + "\nDO MÉRITO\n" + "Razões da decisão, uma a uma. " * 40 + "\nDISPOSITIVO DA DECISÃO\nANTE O EXPOSTO, DEFIRO."},
        {"file_id": "b", "texto": None, "autos": None, "extra": 1},
    ]
    (tmp_path / "d.jsonl").write_text("\n".join(json.dumps(r) for r in raw), encoding="utf-8")
    df = R.decisions(R.read_jsonl(spark, f"file://{tmp_path}/d.jsonl", R.DECISIONS))
    a, b = df.orderBy("id").collect()
    assert (a["id"], a["outcome"], a["date"], a["year"], a["panel"], a["instance"]) == (0, "deferido", "2026-02-11", "2026", "2", "2ª instância")
    assert a["keys"] == ["mesas em calcada"] and a["reasoning"] > 0 and len(a["passages"]) > 2 and "calcada" in a["terms"]
    assert (b["id"], b["outcome"], b["passages"], b["keys"], b["protocol"]) == (1, "", [], [], "")
    assert set(rows(R.reference_ids(df))) == {("notice", "20250012345AN", 0), ("notice", "20250012345", 0), ("protocol", "3100960807202531", 0)}
    assert rows(R.offence_names(df)) == [("mesas em calcada", "Mesas em calçada", 1)]
    head = df.where("id = 0").select(R.header()).first()[0]
    assert head.splitlines()[0] == "Protocolo 31.00960807/2025-31 · 2ª instância · JIJF 2 · sessão de 11/02/2026 · resultado: deferido"


def test_opinions_guidance_and_statutes(spark, tmp_path):
    long = "Uma frase de orientação técnica bem comprida. " * 60
    data = [{"file_id": "p", "nome_arquivo": "Parecer 1.docx", "categoria": "obras", "texto": long}, {"file_id": "g", "nome_arquivo": "Entendimento Juntas 2024.pdf", "texto": "Abertura do texto com algum tamanho.\n\n1 - Tema\n\n" + long}]
    (tmp_path / "o.jsonl").write_text("\n".join(map(json.dumps, data)), encoding="utf-8")
    raw = R.read_jsonl(spark, f"file://{tmp_path}/o.jsonl", R.OPINIONS)
    found = R.opinions(raw).collect()
    assert len(found) > 1 and found[0]["title"].startswith("Parecer 1 (obras, parte 1/") and {r["file_id"] for r in found} == {"p"}
    assert [r["title"] for r in R.guidance(raw).orderBy("id").collect()] == ["Apresentação", "Apresentação › 1 - Tema"]
    law = {"categoria": "Lei 8.616", "texto": "Art. 13 - " + "texto da lei " * 5 + "\nArt. 14 - x", "dispositivos": [
        {"tipo": "artigo", "rotulo": "Art. 13", "numero": "13", "contexto": "Cap. I", "inicio": 0, "fim": 75, "revogado": False},
        {"tipo": "artigo", "rotulo": "Art. 14", "numero": "14", "inicio": 76, "fim": 88}, {"tipo": "anexo", "inicio": 0, "fim": 75}]}
    (tmp_path / "l.jsonl").write_text(json.dumps(law), encoding="utf-8")
    units = R.statutes(R.read_jsonl(spark, f"file://{tmp_path}/l.jsonl", R.STATUTES))
    assert [(r["title"], r["subject"]) for r in units.collect()] == [("Lei 8.616, Art. 13", "Cap. I")]
    assert [tuple(r["cited"]) for r in R.articles(units).collect()] == [("lei", 8616, "13")]


def test_docx_and_encoder(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p w:a="1"><w:r><w:t>Um &amp;</w:t><w:t xml:space="preserve">  dois</w:t></w:r></w:p><w:p ></w:p><w:p>\n<w:t>três</w:t></w:p></w:body></w:document>')
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.docx").write_bytes(data.getvalue())
    (tmp_path / "docs/b.docx").write_bytes(b"not a zip")
    got = {r["path"][-6:]: r["paragraphs"] for r in binary.read_docx(spark, f"file://{tmp_path}/docs").collect()}
    assert got == {"a.docx": ["Um & dois", "três"], "b.docx": []}
    model = tmp_path / "model"
    model.mkdir()
    (model / "modelo.json").write_text(json.dumps({"ids": ["x", "y"], "dim": 2, "vocab": ["mesa", "casa"], "idf": [1.0, 2.0]}))
    (model / "termos.bin").write_bytes(bytes([1, 0, 0, 1]))
    (model / "docs.bin").write_bytes(bytes([127, 0, 0, 127]))
    items = spark.createDataFrame([(0, "x"), (1, "y")], "id long, file_id string")
    words, docs = binary.read_encoder(spark, f"file://{model}", items)
    q = vector.encode_questions(spark.createDataFrame([(7, "a casa, a casa")], "qid long, question string"), words)
    assert rows(vector.nearest(docs, q, 1).select("qid", "id", "rank")) == [(7, 1, 1)]
    assert binary.read_encoder(spark, f"file://{model}", items.withColumn("file_id", F.lit("z"))) is None


# ------------------------------------------------------------------ index and search


TEXTS = {1: "mesa cadeira passeio", 2: "mesa mesa alvara", 3: "alvara ruido noite", 4: ""}


@pytest.fixture(scope="module")
def index(spark):
    return I.build(spark.createDataFrame(list(TEXTS.items()), "id long, t string").select("id", terms("t").alias("terms")))


def plain_bm25(query):
    docs = {i: searched()[i] for i in TEXTS}
    avg = max(sum(map(len, docs.values())) / len(docs), 1.0)
    df = Counter(t for d in docs.values() for t in set(d))
    out = {}
    for i, d in docs.items():
        score = sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(d) / avg)) for t, n in Counter(d).items() if t in query)
        if score:
            out[i] = round(score, 6)
    return out


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, question string")


def test_bm25_follows_its_formula(spark, index):
    got = search.bm25(index, search.query_terms(ask(spark, "mesa alvara mesa"), expanded=False)).collect()
    assert {r["id"]: round(r["score"], 6) for r in got} == plain_bm25({"mesa", "alvara"})


def test_index_is_stored_by_signature(spark, tmp_path, index):
    source = tmp_path / "s.jsonl"
    source.write_text("{}")
    calls = []

    def items():
        calls.append(1)
        return spark.createDataFrame([(1, ["mesa"])], "id long, terms array<string>")

    for _ in range(2):
        assert I.load_or_build(spark, f"file://{tmp_path}/ix", [f"file://{source}"], items).terms.count() == 1
    assert len(calls) == 1
    source.write_text("{} changed")
    I.load_or_build(spark, f"file://{tmp_path}/ix", [f"file://{source}"], items)
    assert len(calls) == 2


def test_fusion_filters_and_direct_hits(spark):
    scores = spark.createDataFrame([(0, 1, 3.0), (0, 2, 2.0), (0, 3, 2.0), (0, 4, 0.0)], "qid long, id long, score double")
    fused = search.fuse([scores, scores.where("id <> 1")], direct=spark.createDataFrame([(0, 4)], "qid long, id long"))
    got = {r["id"]: r["fused"] for r in fused.collect()}
    assert got[4] == 1.0 and abs(got[2] - (1 / 62 + 1 / 61)) < 1e-9 and abs(got[1] - 1 / 61) < 1e-9
    assert [r["id"] for r in search.top(fused, 2).orderBy("rank").collect()] == [4, 2]
    items = spark.createDataFrame([(1, "1ª instância", "2024"), (2, "2ª instância", "2024"), (3, "2ª instância", "2023"), (4, "", "")], "id long, instance string, year string")
    for instance, year, want in (("2ª", None, {2, 3}), ("2ª", "2024", {2}), ("2ª", "1999", {1, 2, 3, 4}), (None, None, {1, 2, 3, 4})):
        f = spark.createDataFrame([(0, instance, year)], "qid long, instance string, year string")
        assert {r["id"] for r in search.filtered(scores, items, f).collect()} == want
    asked = spark.createDataFrame([(0,), (1,)], "qid long")
    assert search.dense_fill(scores, items, asked).count() == 4
    dense = search.dense_fill(scores, items, asked, spark.createDataFrame([(0, "2ª", None)], "qid long, instance string, year string"))
    order = search.rank(search.fuse([dense], fill=True), 9, "fused").orderBy("rank").collect()
    assert [r["id"] for r in order] == [2, 3, 1, 4]


def test_fusion_does_not_depend_on_the_order_of_lists(spark):
    a = spark.createDataFrame([(0, 1, 3.0), (0, 2, 2.0)], "qid long, id long, score double")
    b = spark.createDataFrame([(0, 2, 9.0), (0, 3, 1.0)], "qid long, id long, score double")
    assert sorted(rows(search.fuse([a, b]))) == sorted(rows(search.fuse([b, a])))


def test_coverage_takes_one_item_per_file(spark, index):
    items = spark.createDataFrame([(i, "f" if i < 3 else "g", searched()[i]) for i in TEXTS], "id long, file_id string, present array<string>")
    got = search.coverage(index, search.query_terms(ask(spark, "mesa alvara"), expanded=False), items, 2).orderBy("rank").collect()
    assert [r["id"] for r in got] == [2, 3] and abs(got[0]["coverage"] - 1) < 1e-9 and got[0]["strength"] > got[1]["strength"]


def test_passages_of_the_same_terms_tie(spark):
    """0.1 + 0.2 + 0.3 is more than 0.3 + 0.2 + 0.1 in doubles; of equal passages the later one is better."""
    chosen = spark.createDataFrame([(0, 1, 0, 2)], "qid long, id long, reasoning int, n_passages int")
    passages = spark.createDataFrame([(1, 0, "alfa beta gama"), (1, 1, "gama beta alfa")], "id long, pos int, passage string")
    q = spark.createDataFrame([(0, t) for t in ("alfa", "beta", "gama")], "qid long, term string")
    idf = spark.createDataFrame([("alfa", 0.1), ("beta", 0.2), ("gama", 0.3)], "term string, idf double")
    assert [r["passages"] for r in E.best_passages(chosen, passages, q, idf, 1).collect()] == [["gama beta alfa"]]


def test_coverage_finds_files_behind_many_items_of_one(spark):
    """Twenty items of one file are better than those of two others, over both forms of index."""
    texts = [(i, "mesa alvara") for i in range(20)] + [(20, "mesa alvara outro"), (21, "mesa alvara outro mais longe"), (22, "sem nada aqui")]
    held = spark.createDataFrame(texts, "id long, text string").select("id", terms("text").alias("terms"))
    items = held.select("id", F.when(F.col("id") < 20, "f").when(F.col("id") == 21, "g").alias("file_id"), F.col("terms").alias("present"))
    q = search.query_terms(ask(spark, "mesa alvara"), expanded=False)
    found = [sorted(rows(search.coverage(ix, q, items, 3).select("rank", "id", "coverage"))) for ix in (I.build(held), build_stored(held))]
    assert found[0] == found[1] == [(1, 0, 1.0), (2, 20, 1.0), (3, 21, 1.0)]


def test_direct_references_prefer_protocols(spark):
    ids = spark.createDataFrame([("protocol", "3100960807202531", 1), ("notice", "3100960807202531", 2), ("notice", "20250012345AN", 3), ("notice", "123456789012", 4)], "kind string, key string, id long")
    q = ask(spark, "auto 20250012345an e protocolo 31.00960807/2025-31 e 123456789012 e 20250012345AN")
    assert [r["id"] for r in search.direct_references(q, ids).orderBy("ord").collect()] == [3, 1, 4]


def test_nearest_in_blocks_and_neighbours(spark, monkeypatch):
    monkeypatch.setattr(vector, "QUERY_BLOCK", 1)
    monkeypatch.setattr(vector, "ROW_BLOCK", 2)
    docs = spark.createDataFrame([(i, [float(i == 1), float(i), 1.0]) for i in range(5)], "id long, vec array<double>").repartition(3)
    q = docs.where("id in (1, 4)").withColumnRenamed("id", "qid")
    assert sorted(rows(vector.nearest(docs, q, 2).select("qid", "id", "rank"))) == [(1, 3, 2), (1, 4, 1), (4, 3, 2), (4, 4, 1)]
    assert (4, 4) not in [(r["qid"], r["id"]) for r in vector.similar_items(docs, q.select("qid"), 2).collect()]
    assert vector.nearest(docs, q.limit(0), 2).count() == 0


# ------------------------------------------------------------------ counts


def test_panorama_counts_and_text(spark):
    items = spark.createDataFrame([(i, ["k1"] if i < 8 else ["k2", "k1"], "deferido" if i % 8 == 0 else "", "1ª instância", "2024" if i else "") for i in range(16)], "id long, keys array<string>, outcome string, instance string, year string")
    requests = spark.createDataFrame([(0, None, None, None), (1, ["k2", "k1"], None, None), (2, ["k2"], "9", None)], "rid long, keys array<string>, instance string, year string")
    counts = P.panorama(P.selected(P.cube(items), requests))
    got = {tuple(r[:3]): r[3] for r in rows(counts)}
    assert got[(0, "total", "")] == 16 and got[(1, "total", "")] == 16 and got[(0, "outcome", "não identificado")] == 14 and got[(0, "year", "2024")] == 15
    assert sum(n for (r, f, _), n in got.items() if r == 0 and f == "outcome") == 16 and not any(r == 2 for r, *_ in got)
    names = spark.createDataFrame([("k1", "MESA", 16), ("k2", "CADEIRA", 8)], "key string, name string, n long")
    text = {r["rid"]: r["body"] for r in P.panorama_text(counts, P.label(names, requests)).collect()}
    assert text[0].splitlines()[:3] == ["Infração: todas (acervo inteiro)", "Total de decisões no acervo: 16 (1ª instância: 16)", "- DEFERIDO: 2 de 16 (12%)"]
    assert text[1].startswith("Infração: Cadeira (e mais 1 variante(s)") and 2 not in text


def test_articles_need_two_decisions_or_the_only_one(spark):
    articles = spark.createDataFrame([(("lei", 8616, str(a)), a) for a in (1, 2, 3)], "cited struct<kind:string,num:int,art:string>, at long")
    notices = spark.createDataFrame([(1, "Lei 8.616, art. 1 e 2"), (2, "Lei 8.616 art. 2"), (1, "Lei 8.616, art. 2")], "id long, provision string")
    hits = spark.createDataFrame([(0, 1), (0, 2), (1, 1)], "qid long, id long")
    q = ask(spark, "conforme o art. 3 da Lei 8.616", "nada")
    assert sorted(rows(P.cited_articles(q, hits, notices, articles))) == [(0, 1, 3), (0, 2, 2), (1, 1, 1), (1, 2, 2)]


# ------------------------------------------------------------------ evidence and answers


def test_budget_and_full_reasoning(spark):
    df = spark.createDataFrame([(["a" * 500, "DECIDIDO e mais", "b" * 500, "c" * 500], "DECIDIDO")], "p array<string>, o string")
    cut = df.select(E.budget("p", 700, F.col("o"))).first()[0]
    assert [len(x) for x in cut] == [500, 200]
    full = df.select(E.full_reasoning("p", F.lit(0), F.col("o"), 3600), E.full_reasoning("p", F.lit(2), F.col("o"), 600), E.full_reasoning("p", F.lit(-1), F.col("o"))).first()
    assert [len(x) for x in full[0]] == [500] and [len(x) for x in full[1]] == [500, 100] and full[2] is None
    whole = df.select(E.whole_or_best(F.col("p"), F.lit(None).cast("array<string>"), 10), E.whole_or_best(F.col("p"), F.col("p"), 5000)).first()
    assert whole[0] == ["a" * 10] and len(whole[1]) == 4


def test_follow_ups_history_and_prompt(spark):
    turns = spark.createDataFrame([(1, i, q, "r" * 900) for i, q in enumerate(["mesas no passeio público sem licença municipal vigente", "e em 2024?", "outra"])], "conv_id long, turn long, question string, answer string")
    asked = {r["turn"]: r["query"] for r in E.follow_ups(turns).collect()}
    assert asked[1].endswith("vigente e em 2024?") and asked[2] == "e em 2024? outra"
    said = {r["turn"]: r["messages"] for r in E.history(turns).collect()}
    assert [len(said[i]) for i in range(3)] == [0, 2, 4] and len(said[2][1]["content"]) == 800
    p = turns.where("turn = 0").select(E.prompt("SYS", F.lit(None).cast("array<struct<role:string,content:string>>"), F.lit("[1] fonte"), F.col("question"))).first()[0]
    assert [m["role"] for m in p] == ["system", "user"] and p[1]["content"].startswith("FONTES:\n\n[1] fonte\n\nPERGUNTA: mesas")


def test_plan_numbers_answers_and_checks(spark):
    tier = lambda kind, n: spark.createDataFrame([(0, i, kind, f"{kind}{i}", [f"Frase {kind}{i}. Resto."], "") for i in range(1, n + 1)], "qid long, ord int, kind string, ref string, passages array<string>, reason string")
    plan = E.numbered(tier("guidance", 1), tier("statute", 2), tier("decision", 1))
    assert [(r["number"], r["ref"]) for r in plan.orderBy("number").collect()] == [(1, "guidance1"), (2, "statute1"), (3, "statute2"), (4, "decision1")]
    out = answer.answers(plan, ask(spark, "q", "sem fontes")).orderBy("qid").collect()
    assert out[0]["cited"] == [1, 2, 3, 4] and out[0]["invalid"] == [] and out[1]["answer"] == "" and out[1]["n_sources"] == 0
    text = plan.where("number = 1").select(E.source_text(F.col("number"), F.col("kind"), F.lit("CAB"), F.col("passages"), F.lit("x"))).first()[0]
    assert text == "[1] CAB\nTrecho: «Frase guidance1. Resto.»"
    tiers = E.statute_tier(spark.createDataFrame([(0, 1, 5)], "qid long, ord int, at long"), spark.createDataFrame([(0, 5, 0.9, 0.9), (0, 6, 0.9, 0.9), (0, 7, 0.4, 0.9)], "qid long, at long, coverage double, strength double"))
    assert sorted(rows(tiers.select("ord", "at"))) == [(1, 5), (2, 6)]


def test_metrics(spark):
    hits = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 9, 1)], "qid long, id long, rank int")
    gold = spark.createDataFrame([(0, 1), (1, 8), (2, 7)], "qid long, id long")
    assert abs(evaluate.top1(hits, gold).first()["accuracy"] - 1 / 3) < 1e-9
    assert abs(evaluate.precision_at(hits, gold).first()["precision"] - 1 / 6) < 1e-9


def test_question_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"qid": 1, "question": "x", "asked": "2024-01-01T00:00:00"}\n{"qid": 1, "question": "x", "asked": "2024-01-01T00:00:01"}\n{"qid": 2, "question": "y", "asked": "2024-01-01T00:10:00"}')
    q = Q.answer_stream(Q.read_questions(spark, str(tmp_path / "in")), lambda b: b.select("qid", F.upper("question").alias("answer")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sorted(rows(spark.read.parquet(str(tmp_path / "out")).select("qid", "answer"))) == [(1, "X"), (2, "Y")]


def test_topics_order_titles_not_texts(spark):
    items = spark.createDataFrame([(i, ["abertura", "1 - Um", "texto", "1.1 - " + "Longo " * 40 + "- resto", "fim"]) for i in range(3)], "id long, paragraphs array<string>")
    found = chunk.topics(items)
    # Windows come before, over titles; before, all paragraphs went through them.
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r)[1:] for r in found.where("id = 2").orderBy("pos").collect()] == [
        (0, "Apresentação", "abertura"), (1, "Apresentação › 1 - Um", "texto"), (2, "Apresentação › 1 - Um › 1.1 - " + ("Longo " * 40).strip(), "resto\n\nfim"),
    ]
