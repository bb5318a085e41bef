"""Queries over evidence assembly, conversations and answers."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.text import terms
from ..operators import answer, assistant, chunk, evidence as E, search
from ..sources import records as R
from . import sql as S
from .corpus import documents, index, questions, spread, table
from .source_queries import _raw_decisions, _raw_statutes


def _turns(spark, sf_dir):
    """User turns as questions, with the reply that follows: (conv_id, turn, question, answer)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("answer", F.lead("text").over(w))
    return c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), F.coalesce("answer", F.lit("")).alias("answer"))


def _follow_up(spark, sf_dir):
    return E.follow_ups(_turns(spark, sf_dir)).select("conv_id", "turn", "query")


def _history(spark, sf_dir):
    rows = E.history(_turns(spark, sf_dir)).select("conv_id", "turn", F.posexplode("messages").alias("pos", "m"))
    return rows.select("conv_id", "turn", "pos", "m.role", "m.content")


def _lines(spark, sf_dir):
    """Lines stand for passages, so that SQL can cut them too."""
    return spread(documents(spark, sf_dir)).select("id", F.split("text", "\n").alias("passages"))


def _chosen(spark, sf_dir):
    """Each question's best three documents; the reasoning starts at the second line of even ids."""
    hits = search.rank(search.best(index(spark, sf_dir), search.query_terms(questions(spark, sf_dir)), 3), 3)
    sizes = _lines(spark, sf_dir).select("id", F.size("passages").alias("n_passages"))
    return hits.join(sizes, "id").select("qid", "id", "rank", "n_passages", F.when(F.col("id") % 2 == 0, 1).otherwise(-1).alias("reasoning"))


def _best(spark, sf_dir):
    passages = _lines(spark, sf_dir).select("id", F.posexplode("passages").alias("pos", "passage"))
    q = search.query_terms(questions(spark, sf_dir))
    return E.best_passages(_chosen(spark, sf_dir), passages, q, index(spark, sf_dir).terms, 2)


def _best_passages(spark, sf_dir):
    return _best(spark, sf_dir).select("qid", "id", F.array_join("passages", "\n").alias("passages"))


def _budget(spark, sf_dir):
    cut = E.budget(F.col("passages"), 600, F.element_at("passages", -1))
    return _lines(spark, sf_dir).select("id", F.size(cut).alias("n"), F.length(F.array_join(cut, "")).alias("chars"))


def _plan_rows(spark, sf_dir):
    """The engine's plan of the benchmark's passages as questions, all tiers: documents stand for guidance and
    opinions, by coverage search of their stored index, and dressed as records for decisions; benchmark passages
    for statutes."""
    docs = spread(documents(spark, sf_dir)).select(
        "id", F.concat(F.lit("d"), "id").alias("file_id"), F.lit("").alias("title"), F.lit("").alias("subject"),
        chunk.passages(chunk.clean_lines("text")).alias("passages"), terms("text").alias("terms"),
    )
    ix = index(spark, sf_dir)
    corpus = assistant.Corpus(
        R.decisions(_raw_decisions(spark, sf_dir)), docs, R.statutes(_raw_statutes(spark, sf_dir)), docs, side_indexes={"guidance": ix, "opinions": ix},
    )
    return assistant.prepare(corpus, questions(spark, sf_dir))


def _plan(spark, sf_dir):
    return _plan_rows(spark, sf_dir).select("qid", "number", "kind", "ref", F.array_join("passages", "\n").alias("passages"), "reason")


def _answers(spark, sf_dir):
    out = answer.answers(_plan_rows(spark, sf_dir), questions(spark, sf_dir))
    return out.select("qid", "answer", F.size("cited").alias("n_cited"), F.size("invalid").alias("n_invalid"), "n_sources")


QUERIES = {
    "followup_query": _follow_up,
    "conversation_history": _history,
    "best_passages": _best_passages,
    "passage_budget": _budget,
    "evidence_plan": _plan,
    "extractive_answers": _answers,
}

_TURNS = "turns AS (SELECT conv_id, turn, text AS question, coalesce(next, '') AS answer FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) WHERE role = 'user')"
_W = f"WITH {S.index(S.DOCUMENTS)}, {S.QUESTIONS}, {S.BM25}"
ORACLES = {
    "followup_query": f"WITH {_TURNS}, l AS (SELECT *, lag(question) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM turns) SELECT conv_id, turn, CASE WHEN before IS NOT NULL AND len({S.terms('question')}) < 7 THEN before || ' ' || question ELSE question END AS query FROM l",
    "conversation_history": f"""WITH {_TURNS}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM turns),
p AS (SELECT a.conv_id, a.turn, b.question, left(b.answer, 800) AS answer, b.i - greatest(a.i - 2, 1) AS k FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.i BETWEEN a.i - 2 AND a.i - 1)
SELECT conv_id, turn, (2 * k)::INT AS pos, 'user' AS role, question AS content FROM p UNION ALL SELECT conv_id, turn, (2 * k + 1)::INT, 'assistant', answer FROM p""",
    "best_passages": f"""{_W},
ln AS (SELECT id, pos, line, count(*) OVER (PARTITION BY id) AS np FROM (SELECT doc_id AS id, unnest(s) AS line, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))),
lt AS (SELECT id, pos, unnest(list_distinct({S.terms('line')})) AS term FROM ln),
met AS (SELECT r.qid, lt.id, lt.pos, sum(idf) AS idf FROM {S.ranked('bm', 3)} r JOIN lt USING (id) JOIN q ON q.qid = r.qid AND q.term = lt.term JOIN terms ON terms.term = lt.term GROUP BY ALL),
n AS (SELECT qid, id, pos, line, idf * CASE WHEN id % 2 = 0 THEN CASE WHEN pos >= 1 THEN 1.6 ELSE 1.0 END ELSE 1 + 0.5 * pos / np END AS note FROM met JOIN ln USING (id, pos)),
k AS (SELECT * FROM n WHERE note > 0 QUALIFY row_number() OVER (PARTITION BY qid, id ORDER BY note DESC, pos DESC) <= 2)
SELECT qid, id, string_agg(line, chr(10) ORDER BY pos) AS passages FROM k GROUP BY qid, id""",
    "passage_budget": """WITH ln AS (SELECT doc_id AS id, unnest(s) AS line, generate_subscripts(s, 1) AS i, left(s[-1], 80) AS mark FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
a AS (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM ln WHERE mark = '' OR NOT contains(line, mark)),
b AS (SELECT id, count(*)::INT AS n, sum(length(left(line, greatest(200, 600 - used)::BIGINT)))::INT AS chars FROM a WHERE used < 600 GROUP BY id)
SELECT doc_id AS id, coalesce(n, 0) AS n, coalesce(chars, 0) AS chars FROM documents LEFT JOIN b ON id = doc_id""",
}
