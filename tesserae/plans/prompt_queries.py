"""Queries over sources as they stand in files, in the index, in the prompt and in the evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions.text import normalize
from ..operators import assistant, evaluate, evidence as E, search
from ..operators.segments import build_stored
from ..sources import records as R
from ..sources.stored import folder, stored
from . import sql as S
from .corpus import table
from .evidence_queries import ORACLES as EVIDENCE, _history
from .source_queries import _asked, N_ARTICLES, N_OFFENCES, _DECISIONS, _UNIT, ORACLES as SOURCES, _corpus, _raw_decisions, _raw_guidance, _raw_opinions, _raw_statutes
from .text_queries import ORACLES as TEXTS, _SQL_DECISION

#: Files that the records are written to.
FILES = 5


def _scanned(spark, sf_dir):
    """Decisions written as JSON lines in several files, in order, and read back as records."""
    root = folder(spark, "jsonl")
    raw = _raw_decisions(spark, sf_dir)
    raw.repartitionByRange(FILES, "id").sortWithinPartitions("id").drop("id").write.json(root)
    return R.read_jsonl(spark, root, R.DECISIONS)


def _scanned_decisions(spark, sf_dir):
    return R.decisions(_scanned(spark, sf_dir)).select("id", "file_id", "title", "protocol", "subject", "instance", "outcome", "date", "panel", "year", F.array_join("keys", ",").alias("keys"))


def _indexed(items, key):
    return items.select(key, F.size("terms").alias("n"), F.md5(F.array_join("terms", " ")).alias("digest"))


def _indexed_statutes(spark, sf_dir):
    return _indexed(R.statutes(_raw_statutes(spark, sf_dir)), F.col("at.id").alias("id"))


def _indexed_opinions(spark, sf_dir):
    return _indexed(R.opinions(_raw_opinions(spark, sf_dir)), F.col("at.id").alias("id"))


def _shown(spark, sf_dir):
    """Decisions as the numbered sources of an answer, with a passage each."""
    items = R.decisions(_raw_decisions(spark, sf_dir))
    return items.withColumn("number", (F.col("id") % 9 + 1).cast("int")).withColumn("shown", F.array(F.col("subject"), F.col("protocol"))).withColumn("reason", F.lit("semelhante"))


def _source_texts(spark, sf_dir):
    return _shown(spark, sf_dir).select("id", E.source_text(F.col("number"), F.col("kind"), R.header(), F.col("shown"), F.col("operative")).alias("body"))


def _summaries(spark, sf_dir):
    s = _shown(spark, sf_dir).select("id", E.summary(F.col("number")).alias("s"))
    return s.select("id", "s.numero", "s.tipo", "s.titulo", "s.contexto", "s.texto", "s.protocolo", "s.instancia", "s.data", "s.resultado", F.array_join("s.infracoes", "|").alias("infracoes"), "s.link", "s.motivo", "s.dispositivo")


def _prompts(spark, sf_dir):
    """The prompt of each question in a conversation that has gone on for a while, message by message."""
    said = _history(spark, sf_dir).groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "content"))).alias("m"))
    earlier = said.select("conv_id", "turn", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("earlier"))
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text").join(earlier, ["conv_id", "turn"])
    built = E.prompt("Responda com as fontes.", F.col("earlier"), F.concat(F.lit("[1] conversa "), F.col("conv_id").cast("string")), F.col("text"))
    return asked.select("conv_id", "turn", F.posexplode(built).alias("pos", "x")).select("conv_id", "turn", "pos", "x.role", "x.content")


def _narrative_hits(spark, sf_dir):
    """Each benchmark passage that names an offence, asked as the narrative of the decision of its number."""
    corpus = _corpus(spark, sf_dir)
    keys = corpus.decisions.select("id", "keys")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("item_id").alias("id"), "text")
    q = search.query_terms(asked.select("qid", F.concat(F.col("text"), F.lit(" comercio irregular na quadra q"), (100 + F.col("id") % N_OFFENCES).cast("string")).alias("question")))
    return search.bm25_top(build_stored(corpus.decisions.select("id", "terms")), q, 6), asked.select("qid", "id"), keys


def _narratives(spark, sf_dir):
    hits, asked, keys = _narrative_hits(spark, sf_dir)
    return evaluate.same_offence_at(hits, asked, keys).select("n", F.round("precision", 6).alias("precision"))


# Ten questions on theses, and the pattern that a decision on each has in its text.
THESES = (
    ("Defesa apresentada fora do prazo é analisada?", r"intempestiv"),
    ("O recurso foi protocolado depois do prazo legal, a Junta conhece?", r"intempestiv"),
    ("Quem assina a defesa sem procuração pode recorrer?", r"ilegitim|sem procura|nao (esta|estando) (legalmente )?representad"),
    ("Pessoa que não é dona do imóvel pode apresentar defesa?", r"ilegitim"),
    ("O que acontece quando o auto já foi pago ou a irregularidade deixou de existir antes do julgamento?", r"perda d[oe] objeto|extint"),
    ("A Junta concede mais tempo para cumprir as exigências da notificação?", r"prorroga"),
    ("Erro no endereço do auto de infração leva ao cancelamento?", r"endere[cç]o"),
    ("Microempresa tem direito à dupla visita antes da multa?", r"dupla visita"),
    ("A Junta pode converter o julgamento em diligência para ouvir a fiscalização?", r"dilig[eê]ncia"),
    ("Auto lavrado sem descrição suficiente da conduta é nulo?", r"nulidade|\bnulo\b|vicio|v[ií]cio"),
)
#: What the dressed decisions say, so that some are on a thesis: by id, over their text.
SAID = ("defesa intempestiva", "ilegitimidade da parte sem procuração", "perda do objeto, auto extinto", "prorrogação do prazo das exigências", "erro no endereço do auto", "dupla visita à microempresa", "nulidade do auto por vício", "")


def _said(c):
    return F.element_at(F.array(*map(F.lit, SAID)), (c % len(SAID) + 1).cast("int"))


def _theses(spark, sf_dir):
    """The ten questions against decisions that say one of a few things."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat_ws(" ", _said(F.col("doc_id")), "text").alias("text"))
    docs = stored(docs.select("id", normalize("text").alias("text")))
    theses = spark.createDataFrame([(i, q, p) for i, (q, p) in enumerate(THESES)], "qid long, question string, pattern string")
    ix = build_stored(docs.select("id", search.terms("text").alias("terms")))
    hits = search.bm25_top(ix, search.query_terms(theses), 5)
    return evaluate.on_thesis_at(hits, theses, docs).select("n", F.round("precision", 6).alias("precision"))


def _tier_of(tier):
    def run(spark, sf_dir):
        asked = _asked(spark, sf_dir).withColumn("query", F.col("question"))
        return tier(_corpus(spark, sf_dir), asked).select("qid", "ord", "ref", F.array_join("passages", "|").alias("passages"), "reason")

    return run


QUERIES = {
    "plan_guidance": _tier_of(assistant.guidance_tier),
    "plan_opinions": _tier_of(assistant.opinion_tier),
    "source_decision_files": _scanned_decisions,
    "indexed_decisions": lambda s, d: _indexed(R.decisions(_raw_decisions(s, d)), "id"),
    "indexed_opinions": _indexed_opinions,
    "indexed_guidance": lambda s, d: _indexed(R.guidance(_raw_guidance(s, d)), "id"),
    "indexed_statutes": _indexed_statutes,
    "source_texts": _source_texts,
    "source_summaries": _summaries,
    "prompts": _prompts,
    "eval_narratives": _narratives,
    "eval_theses": _theses,
}

_DIGEST = "len(t)::INT AS n, md5(array_to_string(t, ' ')) AS digest"
_DECISION_TERMS = S.terms(f"concat_ws(' ', 'Recurso em ' || lang, ' comércio irregular na quadra Q' || (100 + doc_id % {N_OFFENCES}) || ' LEI 9.725/09 - ART. ' || (doc_id % {N_ARTICLES}), t)")
_TOPIC = "'1.' || (n_nationkey + 1) || ' - Comércio irregular na quadra Q' || (100 + n_nationkey)"
_OPERATIVE = f"op AS ({TEXTS['operative_part']})"
_HEADERS = f"hd AS ({SOURCES['decision_headers']})"
_ASKED = """asked AS (SELECT item_id AS qid, CASE item_id % 4 WHEN 0 THEN 'quantas decisões: ' WHEN 1 THEN 'qual o resultado do protocolo 31.' || lpad(item_id::VARCHAR, 8, '0') || '/2024-31? '
  WHEN 2 THEN 'há parecer sobre ' ELSE '' END || text AS question FROM benchmark UNION ALL SELECT 1000000 + n_nationkey, 'quantos casos de comércio irregular na quadra Q' || (100 + n_nationkey) || ' na 2ª instância?' FROM nation)"""


def _covered(items: str) -> str:
    """CTEs to the best item of each question by BM25, with its coverage and strength. items: (id, t: terms
    indexed, present: terms of what is shown)."""
    return f"""items AS ({items}), {S.index('SELECT id, t FROM items')}, {_ASKED},
q AS (SELECT qid, unnest(list_distinct({S.terms('question')})) AS term FROM asked), {S.BM25},
best AS (SELECT * FROM {S.ranked('bm', 1)}), known AS (SELECT qid, term, idf FROM q JOIN terms USING (term)), total AS (SELECT qid, sum(idf) AS total FROM known GROUP BY qid),
pres AS (SELECT DISTINCT id, unnest(present) AS term FROM items), met AS (SELECT best.qid, sum(idf) AS met FROM best JOIN known ON known.qid = best.qid JOIN pres ON pres.id = best.id AND pres.term = known.term GROUP BY best.qid),
cov AS (SELECT best.qid, id, coalesce(met, 0) / total AS coverage, score / total AS strength FROM best JOIN total USING (qid) LEFT JOIN met USING (qid))"""


_BODY = "'O comércio irregular na quadra Q' || (100 + n_nationkey) || ' depende de licença prévia.'"
_PASSAGE = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
ORACLES = {
    "plan_guidance": f"""WITH {_covered(f"SELECT n_nationkey AS id, {S.terms(f"concat_ws(' ', {_TOPIC}, 'Apresentação › ' || {_TOPIC}, {_BODY})")} AS t, {S.terms(f"concat_ws(' ', 'Apresentação › ' || {_TOPIC}, '', {_BODY})")} AS present, {_BODY} AS body FROM nation")}
SELECT qid, 1::BIGINT AS ord, 'guidance#' || id AS ref, body AS passages, 'entendimento' AS reason FROM cov JOIN items USING (id) WHERE coverage >= 0.5 AND strength >= 0.85""",
    "plan_opinions": f"""WITH {_covered(f"SELECT item_id AS id, {S.terms("concat_ws(' ', 'Parecer ' || item_id || '.docx', text)")} AS t, {S.terms(f"concat_ws(' ', 'Parecer ' || item_id || ' (obras, parte 1/1)', '', {_PASSAGE})")} AS present, {_PASSAGE} AS body FROM benchmark WHERE item_id % 10 <> 0")}
SELECT qid, 1::BIGINT AS ord, 'p' || id AS ref, left(body, 1100) AS passages, 'parecer' AS reason FROM cov JOIN items USING (id) JOIN asked USING (qid)
WHERE coverage >= 0.7 OR (coverage >= 0.4 AND regexp_matches(question, {S.quoted(X.OPINION_ASKED.replace('(?iu)', '(?i)'))}))""",
    "source_decision_files": f"WITH {_DECISIONS} SELECT * REPLACE (row_number() OVER (ORDER BY id) - 1 AS id), left(date, 4) AS year FROM dec",
    "indexed_decisions": f"SELECT doc_id AS id, {_DIGEST} FROM (SELECT doc_id, {_DECISION_TERMS} AS t FROM ({_SQL_DECISION}) JOIN documents USING (doc_id))",
    "indexed_opinions": f"SELECT id, {_DIGEST} FROM (SELECT item_id AS id, {S.terms("concat_ws(' ', 'Parecer ' || item_id || '.docx', text)")} AS t FROM benchmark WHERE item_id % 10 <> 0)",
    "indexed_guidance": f"""SELECT id, {_DIGEST} FROM (SELECT n_nationkey::BIGINT AS id, {S.terms(f"concat_ws(' ', {_TOPIC}, 'Apresentação › ' || {_TOPIC}, 'O comércio irregular na quadra Q' || (100 + n_nationkey) || ' depende de licença prévia.')")} AS t FROM nation)""",
    "indexed_statutes": f"SELECT id, {_DIGEST} FROM (SELECT id, {S.terms("concat_ws(' ', 'Lei 9.725, ' || label, 'Geral', left(t, 20) || substr(t, 31))")} AS t FROM ({_UNIT}))",
    "source_texts": f"""WITH {_DECISIONS}, {_HEADERS}, {_OPERATIVE}
SELECT dec.id, concat_ws(chr(10), '[' || (dec.id % 9 + 1) || '] ' || header, 'Trecho: «' || subject || '»' || chr(10) || 'Trecho: «' || protocol || '»', CASE WHEN operative <> '' THEN 'Decisão: «' || left(operative, 700) || '»' END) AS body
FROM dec JOIN hd ON hd.id = dec.id JOIN op ON op.doc_id = dec.id""",
    "source_summaries": f"""WITH {_DECISIONS}, {_OPERATIVE}
SELECT dec.id, (dec.id % 9 + 1)::INT AS numero, 'decision' AS tipo, 'Protocolo ' || protocol AS titulo, '' AS contexto, '' AS texto, protocol AS protocolo, instance AS instancia, date AS data, outcome AS resultado,
  'Comércio irregular na quadra q' || (100 + dec.id % {N_OFFENCES}) AS infracoes, '' AS link, 'semelhante' AS motivo, left(operative, 400) AS dispositivo FROM dec JOIN op ON op.doc_id = dec.id""",
    "prompts": f"""WITH h AS ({EVIDENCE['conversation_history']}), q AS (SELECT conv_id, turn, text, (SELECT max(pos) FROM h WHERE h.conv_id = c.conv_id AND h.turn = c.turn) AS last FROM conversations c WHERE role = 'user')
SELECT conv_id, turn, 0 AS pos, 'system' AS role, 'Responda com as fontes.' AS content FROM q WHERE last IS NOT NULL UNION ALL SELECT conv_id, turn, pos + 1, role, content FROM h
UNION ALL SELECT conv_id, turn, last + 2, 'user', 'FONTES:' || chr(10) || chr(10) || '[1] conversa ' || conv_id || chr(10) || chr(10) || 'PERGUNTA: ' || text FROM q WHERE last IS NOT NULL""",
    "eval_narratives": f"""WITH {S.index(f'SELECT doc_id AS id, {_DECISION_TERMS} AS t FROM ({_SQL_DECISION}) JOIN documents USING (doc_id)')},
q AS (SELECT item_id AS qid, unnest(list_distinct({S.terms(S.expand(f"text || ' comercio irregular na quadra q' || (100 + item_id % {N_OFFENCES})"))})) AS term FROM benchmark), {S.BM25},
h AS (SELECT * FROM {S.ranked('bm', 6)}), own AS (SELECT item_id AS qid FROM benchmark JOIN documents ON doc_id = item_id),
o AS (SELECT qid, id FROM h WHERE id <> qid QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank) <= 5),
p AS (SELECT qid, avg((id % {N_OFFENCES} = qid % {N_OFFENCES})::INT) AS p FROM o GROUP BY qid)
SELECT count(*) AS n, round(avg(coalesce(p, 0)), 6) AS precision FROM own LEFT JOIN p USING (qid)""",
    "eval_theses": f"""WITH x AS (SELECT doc_id AS id, {S.norm(f"concat_ws(' ', ([{', '.join(map(S.quoted, SAID))}])[doc_id % {len(SAID)} + 1], text)")} AS text FROM documents), {S.index(f'SELECT id, {S.terms("text")} AS t FROM x')},
th AS (SELECT * FROM (VALUES {', '.join(f'({i}, {S.quoted(a)}, {S.quoted(b)})' for i, (a, b) in enumerate(THESES))}) v(qid, question, pattern)),
q AS (SELECT qid, unnest(list_distinct({S.terms(S.expand('question'))})) AS term FROM th), {S.BM25},
p AS (SELECT h.qid, avg(regexp_matches(x.text, pattern)::INT) AS p FROM {S.ranked('bm', 5)} h JOIN x USING (id) JOIN th ON th.qid = h.qid GROUP BY h.qid)
SELECT count(*) AS n, round(avg(coalesce(p, 0)), 6) AS precision FROM th LEFT JOIN p USING (qid)""",
}
