"""Queries over the record sources and the whole evidence plan, with the test tables dressed as records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as X, text as T
from ..operators import assistant, evidence as E, vector
from ..sources import records as R
from . import sql as S
from .corpus import spread, table
from .text_queries import _CODE, _SQL_DECISION, _decision

#: How many offences, laws' articles and panels the dressed records name.
N_OFFENCES, N_ARTICLES = 25, 30


def _raw_decisions(spark, sf_dir):
    """Documents as decisions: one notice each, an offence by id, a protocol of 2024."""
    i = F.col("doc_id")
    n = lambda c: c.cast("string")
    protocol = F.concat(F.lit("31."), F.lpad(n(i), 8, "0"), F.lit("/2024-31"))
    notice = F.struct(
        F.concat(F.lpad(n(i), 10, "0"), F.lit("AN")).alias("numero"), F.lit(None).cast("string").alias("tipo"), F.concat(F.lit(" comércio irregular na quadra Q"), n(100 + i % N_OFFENCES)).alias("infracao"),
        F.concat(F.lit("LEI 9.725/09 - ART. "), n(i % N_ARTICLES)).alias("dispositivo_legal_transgredido"), F.lit(None).cast("string").alias("lei"),
    )
    return spread(table(spark, sf_dir, "documents")).select(
        i.alias("id"), F.concat(F.lit("d"), n(i)).alias("file_id"), F.concat(F.lit("voto "), n(i), F.lit(".PDF")).alias("nome_arquivo"), protocol.alias("protocolo"),
        F.concat(protocol, F.lit("  Recurso  em "), F.col("lang"), F.lit(" AUTUADO(S) alguém")).alias("assunto"),
        F.when(F.col("lang").isin("en", "de"), "1a_instancia").otherwise("2a_instancia").alias("instancia"), _decision(i).alias("texto"), F.lit(None).cast("string").alias("drive_view_url"), F.array(notice).alias("autos"),
    )


def _raw_statutes(spark, sf_dir):
    """Benchmark passages as laws: an article with struck characters and a note, a revoked one, a paragraph."""
    b = table(spark, sf_dir, "benchmark")
    i = F.col("item_id").cast("string")
    body = F.concat(F.lit("Art. "), i, F.lit(" - "), "text", F.lit("\nArtigo com redação dada pela Lei 1"))
    unit = lambda kind, gone: F.struct(
        F.lit(kind).alias("tipo"), F.concat(F.lit("Art. "), i).alias("rotulo"), F.lit("Geral").alias("contexto"), (F.col("item_id") % N_ARTICLES).cast("string").alias("numero"),
        F.lit(0).alias("inicio"), F.length(body).alias("fim"), F.lit(gone).alias("revogado"),
    )
    return b.select(
        F.col("item_id").alias("id"), F.lit("Lei 9.725").alias("categoria"), body.alias("texto"), F.array(F.array(F.lit(24), F.lit(30)), F.array(F.lit(20), F.lit(26))).alias("riscado"),
        F.lit(None).cast("string").alias("drive_view_url"), F.array(unit("artigo", True), unit("paragrafo", False), unit("artigo", False)).alias("dispositivos"),
    )


def _raw_opinions(spark, sf_dir):
    """Benchmark passages as opinions; every tenth is a guidance document of another year."""
    i = F.col("item_id")
    name = F.when(i % 10 == 0, F.concat(F.lit("Entendimento Juntas 2019 "), i.cast("string"))).otherwise(F.concat(F.lit("Parecer "), i.cast("string"), F.lit(".docx")))
    return table(spark, sf_dir, "benchmark").select(
        i.alias("id"), F.concat(F.lit("p"), i.cast("string")).alias("file_id"), name.alias("nome_arquivo"), F.lit("obras").alias("categoria"), F.col("text").alias("texto"), F.lit(None).cast("string").alias("drive_view_url")
    )


def _raw_guidance(spark, sf_dir):
    """One guidance document with a topic for each nation; nations are a fixed number of rows."""
    block = (100 + F.col("n_nationkey")).cast("string")
    topic = F.concat(F.lit("1."), (F.col("n_nationkey") + 1).cast("string"), F.lit(" - Comércio irregular na quadra Q"), block, F.lit("\n\nO comércio irregular na quadra Q"), block, F.lit(" depende de licença prévia."))
    one = table(spark, sf_dir, "nation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", topic.alias("t")))), lambda x: x["t"]), "\n\n").alias("texto"))
    return one.select(
        F.lit(0).cast("long").alias("id"), F.lit("g").alias("file_id"), F.lit("Entendimento Juntas 2024").alias("nome_arquivo"), F.lit("").alias("categoria"), "texto", F.lit("").alias("drive_view_url")
    )


def _corpus(spark, sf_dir):
    return assistant.Corpus(
        R.decisions(_raw_decisions(spark, sf_dir)), R.guidance(_raw_guidance(spark, sf_dir)), R.statutes(_raw_statutes(spark, sf_dir)), R.opinions(_raw_opinions(spark, sf_dir)),
    )


def _asked(spark, sf_dir):
    """Benchmark passages asked in four ways, and a question on the offence by each nation's number."""
    i = F.col("item_id")
    protocol = F.concat(F.lit("qual o resultado do protocolo 31."), F.lpad(i.cast("string"), 8, "0"), F.lit("/2024-31? "))
    lead = F.when(i % 4 == 0, "quantas decisões: ").when(i % 4 == 1, protocol).when(i % 4 == 2, "há parecer sobre ").otherwise("")
    nation = table(spark, sf_dir, "nation").select((1_000_000 + F.col("n_nationkey")).cast("long").alias("qid"), F.concat(F.lit("quantos casos de comércio irregular na quadra Q"), (100 + F.col("n_nationkey")).cast("string"), F.lit(" na 2ª instância?")).alias("question"))
    return table(spark, sf_dir, "benchmark").select(i.cast("long").alias("qid"), F.concat(lead, "text").alias("question")).unionByName(nation)


def _whole_plan(spark, sf_dir):
    """All tiers: guidance, statutes, opinion, named and found decisions, panoramas."""
    plan = assistant.prepare(_corpus(spark, sf_dir), _asked(spark, sf_dir))
    return plan.select("qid", "number", "kind", "ref", F.array_join("passages", "\n").alias("passages"), "reason")


def _decisions(spark, sf_dir):
    d = R.decisions(_raw_decisions(spark, sf_dir))
    return d.select("id", "file_id", "title", "protocol", "subject", "instance", "outcome", "date", "panel", "year", F.array_join("keys", ",").alias("keys"))


def _headers(spark, sf_dir):
    return R.decisions(_raw_decisions(spark, sf_dir)).select("id", R.header().alias("header"))


def _statutes(spark, sf_dir):
    s = R.statutes(_raw_statutes(spark, sf_dir))
    return s.select("at.id", "at.pos", "file_id", "title", "subject", "unit", "law", "number", F.array_join("passages", " ").alias("body"))


def _articles(spark, sf_dir):
    return R.articles(R.statutes(_raw_statutes(spark, sf_dir))).select("cited.kind", "cited.num", "cited.art", "at.id", "at.pos")


def _opinions(spark, sf_dir):
    return R.opinions(_raw_opinions(spark, sf_dir)).select("at.id", "at.pos", "file_id", "title", F.get("passages", F.lit(0)).alias("passage"))


def _dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.display_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("shown"), T.strip_extension(F.concat("o_orderpriority", F.lit(".DocX"))).alias("title"))


def _marked_lines(spark, sf_dir):
    """Lines of each document, with the mark of the reasoning before one of them."""
    lines = F.split("text", "\n")
    mark = F.col("doc_id") % F.size(lines)
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.transform(lines, lambda x, i: F.when(i == mark, F.concat(F.lit("do mérito: "), x)).otherwise(x)).alias("passages"))


def _reasoning(spark, sf_dir):
    return _marked_lines(spark, sf_dir).select("doc_id", X.reasoning_start("passages").alias("start"))


def _full(spark, sf_dir):
    whole = E.full_reasoning("passages", F.col("doc_id") % 3 - 1, F.element_at("passages", -1), 600)
    return _marked_lines(spark, sf_dir).select("doc_id", F.array_join(whole, "|").alias("reasoning"))


def _narratives(spark, sf_dir):
    dressed = F.concat(F.lit("Relatório. Considerações  Fiscais: 20240001234AN "), F.col("text"), F.lit(" EM SUA DEFESA nada disse"))
    dressed = F.regexp_replace(dressed, "Considerações  Fiscais", "Considerações Fiscais")
    return spread(table(spark, sf_dir, "documents")).select("doc_id", X.inspector_narrative(dressed).alias("narrative"))


def _flags(spark, sf_dir):
    lead = F.element_at(F.array(*map(F.lit, _LEADS)), (F.col("doc_id") % len(_LEADS) + 1).cast("int"))
    q = F.concat(lead, F.coalesce("text", F.lit("")))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", X.is_quantitative(q).alias("quantitative"), X.asks_opinion(q).alias("asked"))


_LEADS = ("Quantos casos de ", "Há PARECER sobre ", "Com que frequência há orientação de ", "", "PROPORÇÃO de ")


def _vectors(spark, sf_dir):
    """Words take the embedding and a weight by their length."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    words = q.select(F.explode(T.tokens("question")).alias("term")).distinct().withColumn("vec_id", F.length("term").cast("long"))
    known = words.join(table(spark, sf_dir, "embeddings"), "vec_id").select("term", (1 + F.col("vec_id") / 10).alias("idf"), F.col("embedding").cast("array<double>").alias("vec"))
    return vector.encode_questions(q, known).select("qid", F.posexplode("vec").alias("i", "x")).withColumn("x", F.round("x", 6))


QUERIES = {
    "source_decisions": _decisions,
    "decision_headers": _headers,
    "reference_ids": lambda s, d: R.reference_ids(R.decisions(_raw_decisions(s, d))),
    "offence_names": lambda s, d: R.offence_names(R.decisions(_raw_decisions(s, d))),
    "source_statutes": _statutes,
    "statute_articles": _articles,
    "source_opinions": _opinions,
    "corpus_status": lambda s, d: assistant.status(_corpus(s, d)),
    "display_fields": _dates,
    "reasoning_start": _reasoning,
    "full_reasoning": _full,
    "inspector_narrative": _narratives,
    "question_flags": _flags,
    "query_vectors": _vectors,
    "evidence_plan_all": _whole_plan,
}

_ID = "lpad(doc_id::VARCHAR, 8, '0')"
_DATE = r"regexp_extract(left(t, 1500), '(?i)SESS[ÃA]O[^\n]{0,60}?(\d{2})/(\d{2})/(20\d{2})', "
_DECISIONS = f"""dec AS (SELECT doc_id AS id, 'd' || doc_id AS file_id, 'voto ' || doc_id || '.PDF' AS title, '31.' || {_ID} || '/2024-31' AS protocol, 'Recurso em ' || lang AS subject,
  CASE WHEN lang IN ('en', 'de') THEN '1ª instância' ELSE '2ª instância' END AS instance, ([{', '.join(map(S.quoted, X.OUTCOMES))}])[{_CODE} + 1] AS outcome,
  CASE WHEN {_DATE}3) BETWEEN '2024' AND '2030' THEN {_DATE}3) || '-' || {_DATE}2) || '-' || {_DATE}1) ELSE '2024-03-03' END AS date, (doc_id % 5 + 1)::VARCHAR AS panel,
  'comercio irregular na quadra q' || (100 + doc_id % {N_OFFENCES}) AS keys FROM ({_SQL_DECISION}) JOIN documents USING (doc_id))"""
_LINES = "ln AS (SELECT doc_id, n, i, CASE WHEN i = doc_id % n THEN 'do mérito: ' || line ELSE line END AS line FROM (SELECT doc_id, len(s) AS n, unnest(s) AS line, generate_subscripts(s, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)))"
_SQL_LEAD = f"([{', '.join(map(S.quoted, _LEADS))}])[doc_id % {len(_LEADS)} + 1] || coalesce(text, '')"
_UNIT = f"SELECT item_id AS id, 2 AS pos, item_id, 'Art. ' || item_id AS label, (item_id % {N_ARTICLES})::VARCHAR AS number, 'Art. ' || item_id || ' - ' || text AS t FROM benchmark"
ORACLES = {
    "source_decisions": f"WITH {_DECISIONS} SELECT *, left(date, 4) AS year FROM dec",
    "decision_headers": f"""WITH {_DECISIONS} SELECT id, 'Protocolo ' || protocol || ' · ' || instance || ' · JIJF ' || panel || ' · sessão de ' || substr(date, 9) || '/' || substr(date, 6, 2) || '/' || left(date, 4)
  || ' · resultado: ' || CASE outcome WHEN '' THEN 'não identificado' ELSE outcome END || chr(10) || 'Assunto: ' || subject || chr(10)
  || 'Auto ' || lpad(id::VARCHAR, 10, '0') || 'AN: Comércio irregular na quadra q' || (100 + id % {N_OFFENCES}) || ' (LEI 9.725/09 - ART. ' || (id % {N_ARTICLES}) || ')' AS header FROM dec""",
    "reference_ids": f"""SELECT 'notice' AS kind, lpad(doc_id::VARCHAR, 10, '0') || 'AN' AS key, doc_id AS id FROM documents UNION ALL SELECT 'notice', lpad(doc_id::VARCHAR, 10, '0'), doc_id FROM documents
UNION ALL SELECT 'protocol', '31' || {_ID} || '202431', doc_id FROM documents""",
    "offence_names": f"SELECT 'comercio irregular na quadra q' || (100 + doc_id % {N_OFFENCES}) AS key, 'comércio irregular na quadra Q' || (100 + doc_id % {N_OFFENCES}) AS name, count(*) AS n FROM documents GROUP BY ALL",
    "source_statutes": rf"""SELECT id, pos, 'Lei 9.725#' || label AS file_id, 'Lei 9.725, ' || label AS title, 'Geral' AS subject, 'artigo' AS unit, 'Lei 9.725' AS law, number,
  trim(regexp_replace(left(t, 20) || substr(t, 31), '\s+', ' ', 'g')) AS body FROM ({_UNIT})""",
    "statute_articles": f"SELECT 'lei' AS kind, 9725 AS num, number AS art, min(id) AS id, 2 AS pos FROM ({_UNIT}) GROUP BY number",
    "source_opinions": r"SELECT item_id AS id, 0 AS pos, 'p' || item_id AS file_id, 'Parecer ' || item_id || ' (obras, parte 1/1)' AS title, trim(regexp_replace(text, '\s+', ' ', 'g')) AS passage FROM benchmark WHERE item_id % 10 <> 0",
    "corpus_status": """SELECT 'decision' AS kind, count(*) AS files FROM documents UNION ALL SELECT 'guidance', count(*) FROM nation UNION ALL SELECT 'statute', count(*) FROM benchmark
UNION ALL SELECT 'opinion', count(*) FROM benchmark WHERE item_id % 10 <> 0""",
    "display_fields": "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS shown, o_orderpriority AS title FROM orders",
    "reasoning_start": rf"""WITH {_LINES} SELECT doc_id, coalesce(min(i) FILTER (i >= n // 4 AND regexp_matches(left(line, 200), {S.quoted(X.REASONING.replace('(?ium)', '(?im)'))})), -1)::INT AS start FROM ln GROUP BY doc_id""",
    "full_reasoning": f"""WITH {_LINES}, op AS (SELECT doc_id, left(line, 60) AS mark FROM ln WHERE i = n - 1),
a AS (SELECT *, mark <> '' AND contains(line, mark) AS held FROM ln JOIN op USING (doc_id) WHERE doc_id % 3 > 0 AND i >= doc_id % 3 - 1),
b AS (SELECT *, coalesce(sum(length(line)) OVER w, 0) AS used, coalesce(sum(held::INT) OVER (PARTITION BY doc_id ORDER BY i), 0) AS ended FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT doc_id, string_agg(left(line, (600 - used)::BIGINT), '|' ORDER BY i) AS r FROM b WHERE ended = 0 AND used < 600 GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN coalesce(r, '') END AS reasoning FROM documents LEFT JOIN c USING (doc_id)""",
    "inspector_narrative": rf"""SELECT doc_id, left(regexp_replace(regexp_extract('Relatório. Considerações Fiscais: 20240001234AN ' || text || ' EM SUA DEFESA nada disse', {S.quoted(X.INSPECTOR.replace('(?ius)', '(?is)'))}, 1), {S.quoted(X.NOTICE_NUMBER)}, '', 'g'), 600) AS narrative FROM documents""",
    "question_flags": f"""SELECT doc_id, regexp_matches({S.norm('q')}, {S.quoted(X.QUANTITATIVE)}) AS quantitative, regexp_matches(q, {S.quoted(X.OPINION_ASKED.replace('(?iu)', '(?i)'))}) AS asked
FROM (SELECT doc_id, {_SQL_LEAD} AS q FROM documents)""",
    "query_vectors": f"""WITH w AS (SELECT qid, term, (1 + ln(count(*))) * (1 + length(term) / 10.0) AS w FROM (SELECT item_id AS qid, unnest(regexp_extract_all({S.norm('text')}, '[a-z]{{3,}}')) AS term FROM benchmark) GROUP BY qid, term),
x AS (SELECT qid, i, sum(w * v) AS x FROM (SELECT qid, w, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM w JOIN embeddings ON vec_id = length(term)) GROUP BY qid, i)
SELECT qid, i::INT AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY qid)), 6) AS x FROM x""",
}
