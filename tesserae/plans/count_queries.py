"""Queries over exact counts, offences and cited articles; orders stand for decisions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import index as I, panorama as P
from ..functions.text import PROCESS_WORDS, terms
from ..sources.stored import stored
from . import sql as S
from .corpus import key_names, order_keys, orders, table


def _requests(spark):
    """Everything; one offence; two offences in one year; one offence under a filter that nothing passes."""
    rows = [(0, None, None, None), (1, ["small ring"], None, None), (2, ["red widget", "blue bolt"], None, "1997"), (3, ["small ring"], "9", None), (4, None, "1", None)]
    return spark.createDataFrame(rows, "rid long, keys array<string>, instance string, year string")


def _counts(spark, sf_dir):
    cells = stored(P.cube(orders(spark, sf_dir).join(order_keys(spark, sf_dir), "id", "left")))
    return P.panorama(P.selected(cells, _requests(spark)))


def _facet(name):
    return lambda spark, sf_dir: _counts(spark, sf_dir).where(F.col("facet") == name).select("rid", "value", "n")


def _text(spark, sf_dir):
    return P.panorama_text(_counts(spark, sf_dir), P.label(key_names(spark, sf_dir), _requests(spark)))


def _questions(spark, sf_dir):
    """One question for each part name: (qid, question)."""
    names = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("qid"))
    return names.select("qid", F.concat(F.lit("o auto sobre "), "p_name", F.lit(" foi anulado?")).alias("question"))


def _hits(spark, sf_dir):
    """The 20 dearest orders with a question's part: (qid, id, place)."""
    q = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("qid"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name").join(q, "p_name")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_orderkey").alias("id")).join(part, "p_partkey").select("qid", "id").distinct()
    priced = lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice"), "id")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("o_totalprice").desc(), "id")) - 1
    return priced.withColumn("place", place).where("place < 20").select("qid", "id", "place")


def _share(spark, sf_dir):
    return P.offence_share(_hits(spark, sf_dir), order_keys(spark, sf_dir)).select("qid", "key", F.round("share", 6).alias("share"))


def _candidates(spark, sf_dir):
    names = key_names(spark, sf_dir)
    idf = I.build(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), terms("p_name").alias("terms"))).terms
    found = P.offence_candidates(_questions(spark, sf_dir), _hits(spark, sf_dir), order_keys(spark, sf_dir), names, idf)
    return found.select("qid", "ord", F.array_join("keys", "|").alias("keys"))


def _frequency(spark, sf_dir):
    return key_names(spark, sf_dir)


def _cited(spark, sf_dir):
    """Provisions by order; the articles in force are those of even number."""
    notices = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Lei 9.725/09 - art. "), (F.col("o_orderkey") % 5 * 2 + 2).cast("string"), F.lit(" e 7")).alias("provision"))
    cited = F.struct(F.lit("lei").alias("kind"), F.lit(9725).alias("num"), (F.col("id") * 2).cast("string").alias("art"))
    articles = spark.range(1, 8).select(cited.alias("cited"), (F.col("id") * 2).alias("at"))
    questions = _questions(spark, sf_dir).withColumn("question", F.when(F.col("qid") % 2 == 0, F.concat("question", F.lit(" conforme o art. 12 da Lei 9.725"))).otherwise(F.col("question")))
    return P.cited_articles(questions, _hits(spark, sf_dir), notices, articles)


QUERIES = {
    "panorama_total": _facet("total"),
    "panorama_outcome": _facet("outcome"),
    "panorama_instance": _facet("instance"),
    "panorama_year": _facet("year"),
    "panorama_text": _text,
    "offence_frequency": _frequency,
    "offence_share": _share,
    "offence_candidates": _candidates,
    "top_citations": _cited,
}

_CHOSEN = f"""
parts AS (SELECT p_partkey, p_name, {S.key('p_name')} AS key FROM part),
ok AS (SELECT DISTINCT l_orderkey AS id, key FROM lineitem JOIN parts ON p_partkey = l_partkey),
o AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'deferido' WHEN 'O' THEN 'indeferido' ELSE 'não identificado' END AS outcome, o_orderpriority AS instance, year(o_orderdate)::VARCHAR AS year FROM orders),
r AS (SELECT * FROM (VALUES (0, NULL, NULL, NULL), (1, ['small ring'], NULL, NULL), (2, ['red widget', 'blue bolt'], NULL, '1997'), (3, ['small ring'], '9', NULL), (4, NULL, '1', NULL)) AS x(rid, keys, fi, fy)),
chosen AS (SELECT rid, o.* FROM r, o WHERE (keys IS NULL OR EXISTS (SELECT 1 FROM ok WHERE ok.id = o.id AND list_contains(keys, ok.key))) AND (fi IS NULL OR starts_with(instance, fi)) AND (fy IS NULL OR year = fy))"""
_HITS = """
qn AS (SELECT p_name, min(p_partkey) AS qid FROM part GROUP BY p_name),
hits AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY o_totalprice DESC, id) - 1 AS place FROM (SELECT DISTINCT qid, l_orderkey AS id FROM lineitem JOIN part ON p_partkey = l_partkey JOIN qn USING (p_name)) JOIN orders ON o_orderkey = id QUALIFY place < 20)"""
_KEYN = "kn AS (SELECT key, arg_min(p_name, p_partkey) AS name FROM parts GROUP BY key), kc AS (SELECT key, count(*) AS n FROM ok GROUP BY key), names AS (SELECT key, name, n FROM kn JOIN kc USING (key))"
_SHARE = "nk AS (SELECT id, count(*) AS k FROM ok GROUP BY id), tot AS (SELECT qid, sum(1.0 / (place + 3)) AS t FROM hits GROUP BY qid), share AS (SELECT qid, key, sum(1.0 / (place + 3) / k) / any_value(t) AS share FROM hits JOIN nk USING (id) JOIN ok USING (id) JOIN tot USING (qid) GROUP BY qid, key)"


def _count(column):
    return f"WITH {_CHOSEN} SELECT rid, {column} AS value, count(*) AS n FROM chosen GROUP BY ALL"


_ALWAYS = [f"'- {n.upper()}: ' || coalesce({c}, 0) || ' de ' || total || ' (' || round_even(100.0 * coalesce({c}, 0) / total, 0)::INT || '%)'" for n, c in zip(P.OUTCOME_ORDER, ("d", "0", "i", "0"))]
ORACLES = {
    "panorama_total": _count("''"),
    "panorama_outcome": _count("outcome"),
    "panorama_instance": _count("instance"),
    "panorama_year": _count("year"),
    "panorama_text": f"""WITH {_CHOSEN}, {_KEYN},
t AS (SELECT rid, count(*) AS total, count(*) FILTER (outcome = 'deferido') AS d, count(*) FILTER (outcome = 'indeferido') AS i, count(*) FILTER (outcome = 'não identificado') AS u FROM chosen GROUP BY rid),
ins AS (SELECT rid, string_agg(instance || ': ' || n, '; ' ORDER BY n DESC, instance) AS s FROM (SELECT rid, instance, count(*) AS n FROM chosen GROUP BY ALL) GROUP BY rid),
ys AS (SELECT rid, string_agg(year || ': ' || n, ', ' ORDER BY year) AS s FROM (SELECT * FROM (SELECT rid, year, count(*) AS n FROM chosen GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY year DESC) <= 6) GROUP BY rid),
l AS (SELECT rid, CASE WHEN keys IS NULL THEN 'todas (acervo inteiro)' ELSE upper(left(name, 1)) || lower(substr(name, 2)) || CASE WHEN len(keys) > 1 THEN ' (e mais ' || (len(keys) - 1) || ' variante(s) do código no SIF)' ELSE '' END END AS label FROM r LEFT JOIN names ON key = keys[1])
SELECT rid, concat_ws(chr(10), 'Infração: ' || label, 'Total de decisões no acervo: ' || total || ' (' || ins.s || ')', {', '.join(_ALWAYS)},
  CASE WHEN u > 0 THEN '- NÃO IDENTIFICADO: ' || u || ' de ' || total || ' (' || round_even(100.0 * u / total, 0)::INT || '%)' END, 'Decisões por ano (últimos): ' || ys.s) AS body
FROM t JOIN ins USING (rid) JOIN ys USING (rid) JOIN l USING (rid)""",
    "offence_frequency": f"WITH {_CHOSEN}, {_KEYN} SELECT key, name, n FROM names",
    "offence_share": f"WITH {_CHOSEN}, {_HITS}, {_SHARE} SELECT qid, key, round(share, 6) AS share FROM share",
    "offence_candidates": f"""WITH {_CHOSEN}, {_HITS}, {_KEYN}, {_SHARE}, {S.index("SELECT p_partkey AS id, " + S.terms('p_name') + " AS t FROM part")},
qt AS (SELECT qid, unnest(list_distinct({S.terms("'o auto sobre ' || p_name || ' foi anulado?'")})) AS term FROM qn),
asked AS (SELECT qid, term, idf FROM qt JOIN terms USING (term) WHERE term NOT IN (SELECT unnest({S.terms(S.quoted(PROCESS_WORDS))}))),
nt AS (SELECT key, unnest(list_distinct({S.terms('name')})) AS term FROM names),
cov AS (SELECT a.qid, nt.key, sum(idf) / any_value(t) AS coverage FROM asked a JOIN nt USING (term) JOIN (SELECT qid, sum(idf) AS t FROM asked GROUP BY qid) tt ON tt.qid = a.qid GROUP BY ALL),
b AS (SELECT qid, key, coalesce(coverage, 0) AS c, coalesce(share, 0) AS s FROM cov FULL JOIN share USING (qid, key)),
cand AS (SELECT qid, key, n, array_to_string(string_split(key, ' ')[1:6], ' ') AS root, c + 0.5 * s + 0.05 * log10(1 + n) AS note FROM b JOIN names USING (key) WHERE c >= 0.3 OR s >= 0.5),
near AS (SELECT * FROM cand QUALIFY note >= max(note) OVER (PARTITION BY qid) - 0.1),
one AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY qid, root ORDER BY note DESC, n DESC, key DESC) = 1),
top AS (SELECT qid, root, row_number() OVER (PARTITION BY qid ORDER BY note DESC, n DESC, key DESC) AS ord FROM one QUALIFY ord <= 2)
SELECT qid, ord, string_agg(key, '|' ORDER BY n DESC, key) AS keys FROM top JOIN names ON array_to_string(string_split(key, ' ')[1:6], ' ') = root GROUP BY qid, ord""",
    "top_citations": f"""WITH {_HITS},
c AS (SELECT qid, o_orderkey % 5 * 2 + 2 AS "at", count(DISTINCT id) AS n FROM hits JOIN orders ON o_orderkey = id GROUP BY ALL),
nh AS (SELECT qid, count(DISTINCT id) AS h FROM hits GROUP BY qid),
u AS (SELECT qid, 0 AS tier, 0 AS rank, 12 AS "at" FROM qn WHERE qid % 2 = 0 UNION ALL SELECT qid, 1, -n, "at" FROM c JOIN nh USING (qid) WHERE n >= CASE WHEN h = 1 THEN 1 ELSE 2 END),
d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY qid, "at" ORDER BY tier, rank) = 1)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY tier, rank, "at") AS ord, "at" FROM d QUALIFY ord <= 2""",
}
