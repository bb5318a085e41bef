"""Expected values of the text, extraction and citation functions."""

import unicodedata

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tesserae.functions import citations as C, extract as X, text as T


def test_terms(value):
    assert value(T.terms, "Cadeiras e MESAS no passeio") == ["cadeira", "mesa", "passeio"]
    assert value(T.terms, "2025s 1234s avós às ônibus") == ["2025", "1234", "avos", "onibu"]
    assert value(T.terms, None) == []


def test_expansion(value):
    assert "intempestividade" in value(T.expand, "defesa fora do prazo")
    assert value(T.expand, "nada disso") == "nada disso"


def test_normalisation_drops_ordinals_and_dashes(value):
    assert value(T.normalize, "2ª Instância – São João") == "2 instancia  sao joao"
    assert value(T.plain_upper, "art. 5º às 30° é") == "ART. 5O AS 30O E"


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=30), min_size=1, max_size=20))
def test_normalize_equals_its_definition(spark, texts):
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.normalize("t")).collect()]
    assert all(g.isascii() for g in got)
    # Characters that the two languages lower differently lie beyond the accented Latin letters.
    plain = [(g, t) for g, t in zip(got, texts) if all(ord(c) < 0x250 and c != "İ" for c in t)]
    assert [g for g, _ in plain] == ["".join(c for c in unicodedata.normalize("NFD", t.lower()) if c < "\x80") for _, t in plain]


def test_keys_and_display(value):
    assert value(T.offence_key, "  Mesas/cadeiras: em   ÁREA pública! ") == "mesas cadeiras em area publica"
    assert value(T.capitalize, "SEM ALVARÁ") == "Sem alvará" and value(T.capitalize, "") == ""
    assert value(T.strip_extension, "Parecer 1.PDF") == "Parecer 1" and value(T.display_date, "2024-05-01") == "01/05/2024"


def test_session_date(value):
    text = "SESSÃO DE JULGAMENTO 11/02/2026\n" + "x " * 50
    assert value(X.session_date, text, "31.00960807/2025-31") == "2026-02-11"
    assert value(X.session_date, "SESSÃO 17/12/2016", "31.0001/2025-02") == ""
    assert value(X.session_date, "fim. Belo Horizonte, 3 de março de 2024.", "") == "2024-03-03"
    assert value(X.session_date, "SESSÃO 31/13/2024 de 30/02/2024", "") == ""


def test_outcomes(value):
    body = "relato INDEFIRO antes\nDISPOSITIVO DA DECISÃO: INDEFIRO\nDispositivo da decisão\nAnte o exposto, DEFIRO PARCIALMENTE o pedido"
    assert value(X.outcome, body) == "parcialmente deferido"
    assert value(X.outcome, "DEFIRO") == "" and value(X.outcome, "dispositivo da decisão: processo extinto, defiro") == "extinto"


def test_subject_panel_and_operative_part(value):
    assert value(X.clean_subject, "31.00960807/2025-31 Cancelamento: autos  2025AN AUTUADO(S): Fulano") == "Cancelamento: autos 2025AN"
    assert value(X.panel, "Junta Integrada de Julgamento Fiscal - III") == "3" and value(X.panel, "JIJFI-II") == "2" and value(X.panel, "x") == ""
    text = "relatório " * 60 + "\nANTE O EXPOSTO, defiro o pedido formulado na defesa apresentada. Belo Horizonte, 1 de maio"
    assert value(X.operative_part, text) == "ANTE O EXPOSTO, defiro o pedido formulado na defesa apresentada."
    assert len(value(X.operative_part, "y" * 2000)) == 700


def test_reasoning_start(spark):
    df = spark.createDataFrame([(["FUNDAMENTAÇÃO cedo demais", "b", "c", "d", "DO MÉRITO: e", "f"],), (["a", "b"],), ([],)], "p array<string>")
    assert [r[0] for r in df.select(X.reasoning_start("p")).collect()] == [4, -1, -1]


def test_question_filters_and_flags(value):
    f = value(X.question_filters, "e na 2ª instância em 2024?")
    assert (f["instance"], f["year"]) == ("2ª", "2024")
    f = value(X.question_filters, "protocolo 31.00960807/2025-31 e auto 20250012345AB")
    assert (f["instance"], f["year"]) == (None, None)
    assert value(X.question_filters, "entre 2024 e 2024")["year"] is None
    assert value(X.is_quantitative, "Quantos foram deferidos?") and not value(X.is_quantitative, "qual o prazo?")
    assert value(X.asks_opinion, "há PARECER sobre isso?")


def test_answer_citations(value):
    c = value(lambda a: X.answer_citations(a, F.lit(3)), "<think>[9]</think> sim [2][1] e [7], [123]")
    assert (c["cited"], c["invalid"]) == ([1, 2], [7])


def test_direct_reference_numbers(value):
    assert value(X.notice_refs, "auto 20250012345 ab e 123456789XY") == ["20250012345AB", "123456789XY"]
    assert value(X.digit_refs, "protocolo 31.00960807/2025-31") == ["3100960807202531"]


def cited(rows):
    return [(r["kind"], r["num"], r["art"]) for r in rows]


def test_citations(value):
    got = cited(value(C.citations, "LEI 9725/09 - ART. 31, DECRETO 13842/10, ARTS. 84 E 89-B § 2º, 10 a 12"))
    assert got == sorted([("lei", 9725, "31"), *(("decreto", 13842, a) for a in ("84", "89-B", "10", "11", "12"))])
    assert cited(value(C.citations, "sem norma, art. 3")) == [] and cited(value(C.citations, "Lei 8.616 sem artigo")) != [("lei", 8616, "8")]
    assert len(cited(value(C.citations, "Lei 8.616, arts. 1 a 40"))) == 2


def test_question_citations_come_in_order(value):
    assert cited(value(C.question_citations, "o art. 13 da Lei 8.616/03 e a LEI 9725/09 - ART. 31")) == [("lei", 8616, "13"), ("lei", 9725, "31")]


def test_citations_compute_each_step_once(spark):
    """The expansion of ranges stood three times in the plan, and the text's split in every law's steps."""
    from tesserae.functions.citations import citations

    df = spark.createDataFrame([("LEI 9.725/09 - ARTS. 1 A 3 E 90-B § 2º, DECRETO 13.842/10, ART. 4",), (None,), ("LEI 1.234",)], "t string")
    out = df.select(citations("t").alias("c"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ATE)") == 1 and plan.count("MUNICIPAL") == 1
    assert [[(x["kind"], x["num"], x["art"]) for x in r["c"] or []] for r in out.collect()] == [
        [("decreto", 13842, "4"), ("lei", 9725, "1"), ("lei", 9725, "2"), ("lei", 9725, "3"), ("lei", 9725, "90-B")], [], [],
    ]
