"""Queries over text functions, extraction and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citations as C, extract as X, text as T
from ..operators import chunk
from ..sources.records import without_struck
from . import sql as S
from .corpus import documents, spread, table


def _column(name, c, source="documents", key="doc_id", text="text"):
    def run(spark, sf_dir):
        return spread(table(spark, sf_dir, source)).select(F.col(key), c(F.col(text)).alias(name))

    return run


def _decision(c):
    """Documents dressed as decisions: a session line, the text, an operative part by id."""
    return F.concat(
        F.lit("SESSÃO DE JULGAMENTO de "), F.lpad((c % 28 + 1).cast("string"), 2, "0"), F.lit("/"), F.lpad((c % 12 + 1).cast("string"), 2, "0"), F.lit("/"),
        (2005 + c % 30).cast("string"), F.lit("\nJIJFI-"), F.element_at(F.array(*map(F.lit, ("I", "II", "III", "IV", "V"))), (c % 5 + 1).cast("int")), F.lit("\n"), F.col("text"),
        F.lit("\nDISPOSITIVO DA DECISÃO\nAnte o exposto, "),
        F.element_at(F.array(*map(F.lit, _PHRASES)), (c % len(_PHRASES) + 1).cast("int")), F.lit(".\nBelo Horizonte, 3 de março de 2024"),
    )


_PHRASES = ("DEFIRO o pedido", "INDEFIRO o pedido", "DEFIRO PARCIALMENTE o pedido", "NÃO SE CONHECE do recurso", "julgo EXTINTO o processo", "converto em diligência", "nada a decidir")
_SQL_DECISION = f"""SELECT doc_id, 'SESSÃO DE JULGAMENTO de ' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || '/' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') || '/' || (2005 + doc_id % 30)
  || chr(10) || 'JIJFI-' || (['I', 'II', 'III', 'IV', 'V'])[doc_id % 5 + 1] || chr(10) || text || chr(10) || 'DISPOSITIVO DA DECISÃO' || chr(10) || 'Ante o exposto, '
  || ([{', '.join(map(S.quoted, _PHRASES))}])[doc_id % {len(_PHRASES)} + 1] || '.' || chr(10) || 'Belo Horizonte, 3 de março de 2024' AS t FROM documents"""


def _decisions(**columns):
    def run(spark, sf_dir):
        d = spread(table(spark, sf_dir, "documents")).select("doc_id", _decision(F.col("doc_id")).alias("t"))
        return d.select("doc_id", *[c(F.col("t")).alias(n) for n, c in columns.items()])

    return run


_ASKED = [
    "e na 2ª instância em 2024?", "primeira instancia, 2019", "protocolo 31.00960807/2025-31 auto 20250012345AB", "quantos em 2018 e 2019?", "o conselho decide", "2024, repito, 2024",
]


def _questions(spark):
    return spark.createDataFrame(list(enumerate(_ASKED)), "qid long, question string")


def _filters(spark, sf_dir):
    asked = _questions(spark).join(table(spark, sf_dir, "benchmark").select("item_id"), F.lit(True))
    f = X.question_filters(F.concat_ws(" ", "question", F.col("item_id").cast("string")))
    return asked.select("qid", "item_id", f["instance"].alias("instance"), f["year"].alias("year"))


_SQL_ASKED = "(VALUES " + ", ".join(f"({i}, {S.quoted(q)})" for i, q in enumerate(_ASKED)) + ") AS a(qid, question)"


def _provisions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    text = F.concat(F.lit("LEI 9.725/09 - ARTS. "), (k % 40 + 1).cast("string"), F.lit(" A "), (k % 40 + 3).cast("string"), F.lit(" E "), (k % 7 + 90).cast("string"), F.lit("-B § 2º, DECRETO 13.842/10, ART. "), (k % 9 + 1).cast("string"))
    return o.select("o_orderkey", F.explode(C.citations(text)).alias("c")).select("o_orderkey", "c.kind", "c.num", "c.art")


def _answers(spark, sf_dir):
    c = spread(table(spark, sf_dir, "conversations"))
    answer = F.concat(F.lit("<think>[77]</think> "), F.col("text"), F.lit(" ["), (F.col("turn") + 1).cast("string"), F.lit("] e ["), (F.col("conv_id") % 12).cast("string"), F.lit("]"))
    a = X.answer_citations(answer, F.lit(5))
    return c.select("conv_id", "turn", F.array_join(F.transform(a["cited"], lambda n: n.cast("string")), ",").alias("cited"), F.array_join(F.transform(a["invalid"], lambda n: n.cast("string")), ",").alias("invalid"))


def _lines(spark, sf_dir):
    return spread(documents(spark, sf_dir)).select("id", F.posexplode(chunk.clean_lines("text")).alias("pos", "line"))


def _passages(spark, sf_dir):
    return spread(documents(spark, sf_dir)).select("id", F.posexplode(chunk.passages(chunk.clean_lines("text"))).alias("pos", "passage"))


def _paragraphs(spark, sf_dir):
    return spread(documents(spark, sf_dir)).select("id", F.posexplode(chunk.paragraphs_of_text(F.regexp_replace("text", "\\.\n", ".\n\n"))).alias("pos", "paragraph"))


def _topics(spark, sf_dir):
    """Each document as a guidance text: its lines as topics of two chapters."""
    lines = F.split(F.col("text"), "\n")
    half = F.floor(F.size(lines) / 2)
    marked = F.flatten(F.transform(lines, lambda x, i: F.array(
        F.when(i == 0, "CAPÍTULO I - GERAL").when(i == half, "CAPÍTULO II – ESPECIAL").otherwise("Sumário - Pg. 3"), F.concat((i % 3 + 1).cast("string"), F.lit(" - "), x), F.concat((i % 3 + 1).cast("string"), F.lit(".1 - "), x), x)))
    return chunk.topics(spread(documents(spark, sf_dir)).select("id", marked.alias("paragraphs")))


def _struck(spark, sf_dir):
    """Every document from its fifth character on, less characters 10 to 20 and 15 to 40."""
    iv = F.array(F.array(F.lit(15), F.lit(40)), F.array(F.lit(10), F.lit(20)))
    return spread(documents(spark, sf_dir)).select("id", without_struck("text", iv, F.lit(5), F.length("text")).alias("body"))


_J = "array_to_string({}, ' ')"
QUERIES = {
    "normalize_text": _column("plain", T.normalize),
    "tokenize": _column("tokens", lambda c: F.array_join(T.tokens(c), " ")),
    "terms": _column("terms", lambda c: F.array_join(T.terms(c), " ")),
    "offence_key": _column("key", T.offence_key),
    "digits_only": _column("digits", T.digits_only),
    "expand_query": _column("expanded", T.expand, "benchmark", "item_id"),
    "plain_upper": _column("upper_text", T.plain_upper),
    "capitalize_text": _column("capital", T.capitalize, "benchmark", "item_id"),
    "quantitative_flag": _column("quantitative", X.is_quantitative),
    "opinion_flag": _column("asked", X.asks_opinion),
    "classify_outcome": _decisions(outcome=X.outcome, code=X.outcome_code),
    "extract_dates": _decisions(session=X.session_date, panel=X.panel),
    "clean_subject": _column("subject", X.clean_subject),
    "operative_part": _decisions(operative=X.operative_part),
    "question_filters": _filters,
    "provision_citations": _provisions,
    "answer_citations": _answers,
    "clean_lines": _lines,
    "passages": _passages,
    "paragraphs": _paragraphs,
    "topics": _topics,
    "struck_text": _struck,
}

_WINDOW = rf"regexp_extract(upper({S.norm('t')}), '(?s)^.*(DISPOSITIVO DA DECIS.{{0,680}})', 1)"
_CODE = "CASE " + " ".join(f"WHEN regexp_matches({_WINDOW}, {S.quoted(p)}) THEN {c}" for c, p in X.OUTCOME_PATTERNS) + " ELSE 0 END"
_OPERATIVE = X.OPERATIVE.replace("(?iu)", "(?i)")
_HEAD = r"regexp_extract(left(t, 1500), '(?i)SESS[ÃA]O[^\n]{0,60}?(\d{2})/(\d{2})/(20\d{2})', "
ORACLES = {
    "normalize_text": f"SELECT doc_id, {S.norm('text')} AS plain FROM documents",
    "tokenize": f"SELECT doc_id, {_J.format('regexp_extract_all(' + S.norm('text') + chr(44) + ' ' + S.quoted('[a-z]{3,}') + ')')} AS tokens FROM documents",
    "terms": f"SELECT doc_id, {_J.format(S.terms('text'))} AS terms FROM documents",
    "offence_key": f"SELECT doc_id, {S.key('text')} AS key FROM documents",
    "digits_only": r"SELECT doc_id, regexp_replace(text, '\D', '', 'g') AS digits FROM documents",
    "expand_query": f"SELECT item_id, {S.expand('text')} AS expanded FROM benchmark",
    "plain_upper": "SELECT doc_id, replace(replace(strip_accents(upper(replace(text, 'ß', 'SS'))), 'º', 'O'), '°', 'O') AS upper_text FROM documents",
    "capitalize_text": "SELECT item_id, upper(left(text, 1)) || lower(substr(text, 2)) AS capital FROM benchmark",
    "quantitative_flag": f"SELECT doc_id, regexp_matches({S.norm('text')}, {S.quoted(X.QUANTITATIVE)}) AS quantitative FROM documents",
    "opinion_flag": "SELECT doc_id, regexp_matches(text, '(?i)parecer|orienta|dilu|gesle|nota orientativa') AS asked FROM documents",
    "classify_outcome": f"SELECT doc_id, ([{', '.join(map(S.quoted, X.OUTCOMES))}])[code + 1] AS outcome, code FROM (SELECT doc_id, {_CODE} AS code FROM ({_SQL_DECISION}))",
    "extract_dates": f"""SELECT doc_id, CASE WHEN y <= '2030' THEN y || '-' || m || '-' || d ELSE '2024-03-03' END AS session, (doc_id % 5 + 1)::VARCHAR AS panel
FROM (SELECT doc_id, {_HEAD}3) AS y, {_HEAD}2) AS m, {_HEAD}1) AS d FROM ({_SQL_DECISION}))""",
    "clean_subject": r"""SELECT doc_id, left(trim(regexp_replace(regexp_replace(regexp_replace(text, '(?s)(\bAUTUADO\(S\)|\bCPF/CNPJ|\bREPRESENTANTE).*$', ''), '^\s*\d{2}\.[\d./_-]+\s*', ''), '\s+', ' ', 'g')), 300) AS subject FROM documents""",
    "operative_part": rf"""
WITH m AS (SELECT doc_id, t, length(regexp_extract(t, {S.quoted('(?s)^(.*)(?:' + _OPERATIVE + ')')}, 1)) AS before, regexp_matches(t, {S.quoted(_OPERATIVE)}) AS found FROM ({_SQL_DECISION})),
p AS (SELECT doc_id, trim(regexp_replace(substr(t, (CASE WHEN found AND before > length(t) * 0.4 THEN before ELSE greatest(length(t) - 700, 0) END) + 1, 900), '[\s\x0b\x{{85}}\p{{Z}}]+', ' ', 'g')) AS part FROM m),
s AS (SELECT *, length(regexp_extract(part, {S.quoted('(?s)^(.*?)(?:' + X.SIGNATURE + ')')}, 1)) AS sign FROM p)
SELECT doc_id, CASE WHEN regexp_matches(part, {S.quoted(X.SIGNATURE)}) AND sign > 40 THEN trim(left(part, sign)) ELSE part END AS operative FROM s""",
    "question_filters": f"""SELECT qid, item_id, CASE WHEN qid IN (0, 4) THEN '2ª' WHEN qid = 1 THEN '1ª' END AS instance,
CASE qid WHEN 0 THEN '2024' WHEN 1 THEN '2019' END AS year FROM {_SQL_ASKED}, benchmark""",
    "provision_citations": """
WITH o AS (SELECT o_orderkey, o_orderkey % 40 + 1 AS a, o_orderkey % 7 + 90 AS e, o_orderkey % 9 + 1 AS d FROM orders)
SELECT DISTINCT o_orderkey, kind, num, art FROM (
  SELECT o_orderkey, 'lei' AS kind, 9725 AS num, unnest([a::VARCHAR, (a + 1)::VARCHAR, (a + 2)::VARCHAR, e || '-B']) AS art FROM o
  UNION ALL SELECT o_orderkey, 'decreto', 13842, d::VARCHAR FROM o)""",
    "answer_citations": r"""
WITH a AS (SELECT conv_id, turn, list_sort(list_distinct(list_transform(regexp_extract_all(text || ' [' || (turn + 1) || '] e [' || (conv_id % 12) || ']', '\[(\d{1,2})\]', 1), lambda x: x::INT))) AS n FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter(n, lambda x: x BETWEEN 1 AND 5), ',') AS cited, array_to_string(list_filter(n, lambda x: x NOT BETWEEN 1 AND 5), ',') AS invalid FROM a""",
    "clean_lines": r"""
WITH raw AS (SELECT doc_id AS id, regexp_replace(text, '\n$', '') AS text FROM documents),
l AS (SELECT id, generate_subscripts(s, 1) AS i, trim(regexp_replace(unnest(s), '[ \t]+', ' ', 'g')) AS line FROM (SELECT id, string_split(text, chr(10)) AS s FROM raw)),
k AS (SELECT *, row_number() OVER (PARTITION BY id, line ORDER BY i) AS nth FROM l)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY i) - 1)::INT AS pos, line FROM k
WHERE NOT regexp_full_match(line, '\d{1,2}\s*/\s*\d{1,2}') AND (line = '' OR length(line) >= 90 OR nth = 1)""",
    "paragraphs": r"""
WITH p AS (SELECT doc_id AS id, regexp_split_to_array(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), '\n\s*\n') AS s FROM documents),
l AS (SELECT id, generate_subscripts(s, 1) AS i, trim(regexp_replace(unnest(s), '\s+', ' ', 'g')) AS paragraph FROM p)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY i) - 1)::INT AS pos, paragraph FROM l WHERE paragraph <> ''""",
    "struck_text": r"SELECT doc_id AS id, regexp_replace(regexp_replace(substr(text, 6, 5) || substr(text, 41), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS body FROM documents",
}
