"""The evidence plan end to end over a small corpus of all four collections."""

import json

import pytest

from tesserae.operators import answer, assistant
from tesserae.sources import records as R

REASONS = "O relatório descreve o caso com todos os detalhes da vistoria. " * 12 + "\nDO MÉRITO\n" + "As mesas e cadeiras ocupavam o passeio sem licença. " * 16


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")

    def table(name, rows, schema):
        (folder / name).write_text("\n".join(json.dumps(r) for r in rows), encoding="utf-8")
        return R.read_jsonl(spark, f"file://{folder}/{name}", schema)

    votes = [
        {"file_id": f"v{i}", "nome_arquivo": f"v{i}.pdf", "protocolo": f"31.0096080{i}/2024-31", "instancia": "2a_instancia" if i % 2 else "1a", "assunto": "Cancelamento",
         "texto": f"SESSÃO 11/02/202{4 + i % 2}\n{REASONS}\nDISPOSITIVO DA DECISÃO\nANTE O EXPOSTO, {'DEFIRO' if i < 2 else 'INDEFIRO'} o pedido.",
         "autos": [{"numero": f"2024001234{i}AN", "infracao": "Mesas e cadeiras no passeio", "dispositivo_legal_transgredido": "LEI 8.616/03 - ART. 13"}]}
        for i in range(5)
    ]
    votes.append({"file_id": "v9", "texto": "Ruído noturno em bar, com medição de decibéis no local. " * 20, "autos": [{"numero": "20240099999AN", "infracao": "Ruído"}]})
    law = "Art. 13 - É proibida a colocação de mesas e cadeiras no passeio sem licença."
    return assistant.Corpus(
        R.decisions(table("v.jsonl", votes, R.DECISIONS)),
        R.guidance(table("o.jsonl", [{"file_id": "g", "nome_arquivo": "Entendimento Juntas 2024", "texto": "1 - Mesas e cadeiras no passeio\n\nA licença é exigida para mesas e cadeiras no passeio."}], R.OPINIONS)),
        R.statutes(table("l.jsonl", [{"categoria": "Lei 8.616", "texto": law, "dispositivos": [{"tipo": "artigo", "rotulo": "Art. 13", "numero": "13", "inicio": 0, "fim": len(law)}]}], R.STATUTES)),
        R.opinions(table("p.jsonl", [{"file_id": "p", "nome_arquivo": "Parecer mesas.pdf", "categoria": "obras", "texto": "Orientação sobre mesas e cadeiras no passeio público da cidade."}], R.OPINIONS)),
    )


def test_plan_in_order_of_authority(spark, corpus):
    q = spark.createDataFrame([
        (0, "quantas decisões sobre mesas e cadeiras no passeio?"), (1, "qual o resultado do protocolo 31.00960802/2024-31?"), (2, "quantos xyzzy na segunda instância?"),
    ], "qid long, question string")
    df = assistant.prepare(corpus, q)
    plan = df.orderBy("qid", "number").collect()
    by = {i: [r for r in plan if r["qid"] == i] for i in range(3)}
    kinds = [r["kind"] for r in by[0]]
    assert kinds == ["guidance", "statute", "opinion", *["decision"] * 5, "panorama"] and [r["number"] for r in by[0]] == list(range(1, 10))
    assert by[0][-1]["passages"][0].splitlines()[1].startswith("Total de decisões no acervo: 5 (")
    cited = next(r for r in by[1] if r["reason"] == "citada na pergunta")
    assert cited["ref"] == "2" and "MÉRITO" in cited["passages"][0]
    assert by[2][-1]["kind"] == "panorama" and "todas (acervo inteiro)" in by[2][-1]["passages"][0] and "2ª instância: 2" in by[2][-1]["passages"][0]
    checked = {r["qid"]: r for r in answer.answers(spark.createDataFrame(plan, df.schema), q).collect()}
    assert checked[0]["cited"] == list(range(1, 10)) and not checked[0]["invalid"]


def test_status(corpus):
    assert {r["kind"]: r["files"] for r in assistant.status(corpus).collect()} == {"decision": 6, "guidance": 1, "statute": 1, "opinion": 1}
