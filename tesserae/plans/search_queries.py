"""Queries over the index, search, fusion, vectors and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import terms
from ..operators import evaluate, search, vector, vector_lists
from ..operators.segments import Segments
from ..sources.stored import folder
from . import sql as S
from .corpus import documents, index, line_index, questions, spread, table

K = 10


def _bm25_one(spark, sf_dir):
    q = spark.createDataFrame([(0, "the thing that was ering over and under")], "qid long, question string")
    hits = search.bm25_top(index(spark, sf_dir), search.query_terms(q), K)
    return hits.select("id", F.round("score", 6).alias("score"), "rank")


def _bm25(spark, sf_dir):
    return search.bm25(index(spark, sf_dir), search.query_terms(questions(spark, sf_dir)))


def _best(spark, sf_dir, k=K):
    return search.best(index(spark, sf_dir), search.query_terms(questions(spark, sf_dir)), k)


def _ranked(scores, k=K):
    return search.rank(scores, k).select("qid", "id", F.round("score", 6).alias("score"), "rank")


def _best_lines(spark, sf_dir, qterms, k):
    """Documents by their best line."""
    return search.best(line_index(spark, sf_dir), qterms, k, owner="id")


def _passage_max(spark, sf_dir):
    return _ranked(_best_lines(spark, sf_dir, search.query_terms(questions(spark, sf_dir)), K))


def _rrf(spark, sf_dir):
    q = search.query_terms(questions(spark, sf_dir))
    fused = search.fuse([search.best(index(spark, sf_dir), q, search.DEPTH), _best_lines(spark, sf_dir, q, search.DEPTH)])
    return search.top(fused, K).select("qid", "id", "rank", F.round("score", 6).alias("score"))


def _filters(spark, sf_dir):
    """Each question's filters by its id; every seventh asks for a year that no document has."""
    q = F.col("qid")
    return questions(spark, sf_dir).select(
        "qid", F.when(q % 3 == 0, "1ª").when(q % 3 == 1, "2ª").alias("instance"), F.when(q % 7 == 0, "1999").when(q % 2 == 0, (2015 + q % 10).cast("string")).alias("year")
    )


def _filtered(spark, sf_dir):
    only = documents(spark, sf_dir).select("id", "instance", "year"), _filters(spark, sf_dir)
    return _ranked(search.best(index(spark, sf_dir), search.query_terms(questions(spark, sf_dir)), K, only=only))


def _coverage(spark, sf_dir):
    items = documents(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("file_id")), "id")
    q = search.query_terms(questions(spark, sf_dir), expanded=False)
    found = search.coverage(index(spark, sf_dir), q, spread(items).select("id", "file_id", F.array_distinct(terms("text")).alias("present")), 2)
    return found.select("qid", "id", "rank", F.round("coverage", 6).alias("coverage"), F.round("strength", 6).alias("strength"))


def _direct(spark, sf_dir):
    """Orders named by number in questions made from customers: a protocol, else a notice."""
    o = table(spark, sf_dir, "orders")
    key = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    ids = o.select(F.when(F.col("o_orderkey") % 2 == 0, "protocol").otherwise("notice").alias("kind"), key.alias("key"), F.col("o_orderkey").alias("id"))
    asked = o.select(F.col("o_custkey").alias("qid"), key.alias("k"))
    q = asked.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("k")), lambda x: F.concat(F.lit("sobre "), F.substring(x, 1, 6), F.lit("."), F.substring(x, 7, 6))), " ").alias("question"))
    return search.direct_references(q, ids)


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


def _vector_topk(spark, sf_dir):
    """Query set: every row whose id is divisible by 50, against all rows."""
    v = _vectors(spark, sf_dir)
    return vector.nearest(v, v.where("id % 50 = 0").withColumnRenamed("id", "qid"), K).select("qid", "id", F.round("score", 6).alias("score"), "rank")


def _lists(spark, sf_dir):
    """The lists, and the stated query set: every row whose id is divisible by 50."""
    v = _vectors(spark, sf_dir)
    return vector_lists.build(v), v.where("id % 50 = 0").withColumnRenamed("id", "qid")


def _all_lists(spark, sf_dir):
    """All lists probed: bytes, bounds and second look must give the exact answer."""
    lists, q = _lists(spark, sf_dir)
    return lists.nearest(q, K, len(lists.centroids)).select("qid", "id", F.round("score", 6).alias("score"), "rank")


def _list_recall(spark, sf_dir):
    """Recall of the lists against the exact query, with as many probes as the sample asks for, and the
    rows that a query meets on average."""
    lists, q = _lists(spark, sf_dir)
    probes = lists.probes(k=K)
    near, exact = lists.nearest(q, K, probes).select("qid", "id"), vector.nearest(_vectors(spark, sf_dir), q, K).select("qid", "id")
    found = exact.join(near.withColumn("hit", F.lit(1)), ["qid", "id"], "left").agg(F.count_distinct("qid").alias("n_queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    met = lists.scanned(q, probes).agg(F.avg("scanned").alias("scanned"))
    return found.crossJoin(F.broadcast(met)).select("n_queries", "recall", "scanned", F.lit(int(lists.sizes.sum())).alias("n_rows"), F.lit(probes).alias("probes"), F.lit(len(lists.centroids)).alias("n_lists"))


def _similar(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return vector.similar_items(v, v.where("id % 50 = 0").select(F.col("id").alias("qid")), 3).select("qid", "id", F.round("score", 6).alias("score"), "rank")


def _hybrid(spark, sf_dir):
    """BM25 of the documents and vectors of equal ids; documents without a vector have no vector rank."""
    v = _vectors(spark, sf_dir)
    q = questions(spark, sf_dir)
    near = vector.nearest(v, v.withColumnRenamed("id", "qid").join(q.select("qid"), "qid"), search.DEPTH)
    fused = search.fuse([_best(spark, sf_dir, search.DEPTH), near.select("qid", "id", "score")])
    return search.top(fused, K).select("qid", "id", "rank", F.round("score", 6).alias("score"))


def _gold(spark, sf_dir):
    """Documents that hold a benchmark passage word for word, whatever their rank.

    All words of a passage but its first and last, which may be cut, are whole words of its holders:
    these are found through the rarest of them, or one by one for passages without such words.
    """
    words = lambda c: F.split(c, "\\s+")
    q = questions(spark, sf_dir).where("question rlike '\\\\S'")
    docs = documents(spark, sf_dir).select("id", "text")
    inner = q.select("qid", F.explode(F.array_distinct(F.slice(words("question"), 2, F.greatest(F.size(words("question")) - 2, F.lit(0))))).alias("word"))
    held = spread(docs).select("id", F.explode(F.array_distinct(words("text"))).alias("word")).join(inner.select("word").distinct(), "word")
    rarest = inner.join(held.groupBy("word").agg(F.count("*").alias("n")), "word").groupBy("qid").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    pairs = rarest.join(held, "word").select("qid", "id")
    short = q.where(F.size(words("question")) < 3).select("qid").crossJoin(docs.select("id"))
    both = pairs.unionByName(short).join(q, "qid").join(docs, "id")
    return both.where(F.col("text").contains(F.col("question"))).select("qid", "id")


def _top1(spark, sf_dir):
    return evaluate.top1(search.rank(_best(spark, sf_dir, 1), 1), _gold(spark, sf_dir)).select("n", F.round("accuracy", 6).alias("accuracy"))


def _precision(spark, sf_dir):
    return evaluate.precision_at(search.rank(_best(spark, sf_dir, 5), 5), _gold(spark, sf_dir)).select("n", F.round("precision", 6).alias("precision"))


def _terms(spark, sf_dir):
    return index(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def _postings(spark, sf_dir):
    return index(spark, sf_dir).postings.select("term", "id", F.round("weight", 6).alias("weight"))


def _weights(postings, terms):
    """(term, df, total, heaviest): an index by its terms."""
    return postings.join(terms, "term").groupBy("term", "df").agg(F.round(F.sum("weight"), 5).alias("total"), F.round(F.max("weight"), 6).alias("heaviest"))


def _term_weights(spark, sf_dir):
    ix = index(spark, sf_dir)
    return _weights(ix.postings, ix.terms)


def _changed_index(spark, sf_dir):
    """The documents indexed in steps: those of even ids and a stale form of some others, from which
    then all even ids of one lang and the stale ones are removed, then what is missing is added. The
    state read from all segments, and after compaction."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    even, stale = F.col("id") % 2 == 0, F.col("id") % 10 == 1
    ix = Segments(spark, folder(spark, "changes"))
    ix.add(docs.where(even | stale), terms=F.when(stale, F.array(F.lit("stale"), F.lit("x1"))).otherwise(terms("text")))
    ix.remove(docs.where(stale | (even & (F.col("lang") == "en"))))
    ix.add(docs.where(~even | (F.col("lang") == "en")), terms=terms("text"))
    merged = ix.index()
    compacted = ix.compact().index()
    out = [_weights(x.postings, x.terms).withColumn("state", F.lit(n)) for x, n in ((merged, "merged"), (compacted, "compacted"))]
    return out[0].unionByName(out[1])


def _best_blocks(spark, sf_dir):
    """The best three documents of each question, with blocks skipped that can't hold one of them."""
    hits = search.bm25_top(index(spark, sf_dir), search.query_terms(questions(spark, sf_dir), expanded=False), 3)
    return hits.select("qid", "id", F.round("score", 6).alias("score"), "rank")


def _stats(spark, sf_dir):
    return index(spark, sf_dir).stats.select("n_docs", F.round("avg_len", 6).alias("avg_len"))


QUERIES = {
    "search_bm25": _bm25_one,
    "index_df_idf": _terms,
    "index_postings": _postings,
    "index_term_weights": _term_weights,
    "index_changes": _changed_index,
    "search_top_blocks": _best_blocks,
    "corpus_stats": _stats,
    "search_bm25_batch": lambda s, d: _ranked(_best(s, d)),
    "search_passage_max": _passage_max,
    "search_rrf": _rrf,
    "search_filtered": _filtered,
    "search_coverage": _coverage,
    "direct_refs": _direct,
    "vector_topk": _vector_topk,
    "vector_lists_exact": _all_lists,
    "vector_lists_recall": _list_recall,
    "similar_items": _similar,
    "hybrid_rrf": _hybrid,
    "eval_top1": _top1,
    "eval_p_at_5": _precision,
}

_INDEX = S.index(S.DOCUMENTS)
_WITH = f"WITH {_INDEX}, {S.QUESTIONS}, {S.BM25}"
_LINES = S.index(f"SELECT doc_id * 1000000 + pos AS id, {S.terms('line')} AS t FROM (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))", "_l")
_PASSAGE = "pm AS (SELECT qid, id // 1000000 AS id, greatest(max(score), 0) AS score FROM (SELECT qid, id, round(sum(weight), 9) AS score FROM postings_l JOIN q USING (term) GROUP BY qid, id) GROUP BY ALL)"
_TOP = f"SELECT qid, id, rank, round(score / max(score) OVER (PARTITION BY qid), 6) AS score FROM (SELECT * FROM {S.ranked('fused', K)})"
_FUSED = "fused AS (SELECT qid, id, round(sum(1.0 / (60 + rank)), 12) AS score FROM ({}) GROUP BY ALL)"
_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings)"
_GOLD = r"g AS (SELECT item_id AS qid, doc_id AS id FROM benchmark, documents WHERE regexp_matches(benchmark.text, '\S') AND contains(documents.text, benchmark.text))"
_WEIGHTS = "SELECT term, df, round(sum(weight), 5) AS total, round(max(weight), 6) AS heaviest FROM postings JOIN terms USING (term) GROUP BY term, df"
ORACLES = {
    "search_bm25": f"""WITH {_INDEX}, q AS (SELECT 0 AS qid, unnest(list_distinct({S.terms(S.expand("'the thing that was ering over and under'"))})) AS term), {S.BM25}
SELECT id, round(score, 6) AS score, rank FROM {S.ranked('bm', K)}""",
    "index_df_idf": f"WITH {_INDEX} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "index_postings": f"WITH {_INDEX} SELECT term, id, round(weight, 6) AS weight FROM postings",
    "index_term_weights": f"WITH {_INDEX} {_WEIGHTS}",
    "index_changes": f"WITH {_INDEX}, w AS ({_WEIGHTS}) SELECT w.*, state FROM w, (SELECT unnest(['merged', 'compacted']) AS state)",
    "search_top_blocks": f"WITH {_INDEX}, q AS (SELECT item_id AS qid, unnest(list_distinct({S.terms('text')})) AS term FROM benchmark), {S.BM25} SELECT qid, id, round(score, 6) AS score, rank FROM {S.ranked('bm', 3)}",
    "corpus_stats": f"WITH {_INDEX} SELECT n_docs, round(avg_len, 6) AS avg_len FROM stats",
    "search_bm25_batch": f"{_WITH} SELECT qid, id, round(score, 6) AS score, rank FROM {S.ranked('bm', K)}",
    "search_passage_max": f"WITH {_LINES}, {S.QUESTIONS}, {_PASSAGE} SELECT qid, id, round(score, 6) AS score, rank FROM {S.ranked('pm', K)}",
    "search_rrf": f"{_WITH}, {_LINES}, {_PASSAGE}, {_FUSED.format('SELECT qid, id, rank FROM ' + S.ranked('bm', 400) + ' UNION ALL SELECT qid, id, rank FROM ' + S.ranked('pm', 400))} {_TOP}",
    "search_filtered": f"""{_WITH}, {S.ITEMS},
f AS (SELECT item_id AS qid, CASE item_id % 3 WHEN 0 THEN '1ª' WHEN 1 THEN '2ª' END AS fi, CASE WHEN item_id % 7 = 0 THEN '1999' WHEN item_id % 2 = 0 THEN (2015 + item_id % 10)::VARCHAR END AS fy FROM benchmark),
alive AS (SELECT f.*, EXISTS (SELECT 1 FROM items WHERE (fi IS NULL OR starts_with(instance, fi)) AND (fy IS NULL OR year = fy)) AS alive FROM f),
kept AS (SELECT qid, id, score FROM bm JOIN items USING (id) JOIN alive USING (qid) WHERE NOT alive OR ((fi IS NULL OR starts_with(instance, fi)) AND (fy IS NULL OR year = fy)))
SELECT qid, id, round(score, 6) AS score, rank FROM {S.ranked('kept', K)}""",
    "search_coverage": f"""WITH {_INDEX}, q AS (SELECT item_id AS qid, unnest(list_distinct({S.terms('text')})) AS term FROM benchmark), {S.BM25},
pool AS (SELECT b.*, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank, source FROM bm b JOIN documents ON doc_id = b.id WHERE score > 0),
one AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY qid, source ORDER BY rank) = 1),
best AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM one QUALIFY place <= 2),
known AS (SELECT qid, term, idf FROM q JOIN terms USING (term)), total AS (SELECT qid, sum(idf) AS t FROM known GROUP BY qid),
cov AS (SELECT b.qid, b.id, sum(k.idf) AS c FROM best b JOIN known k ON k.qid = b.qid JOIN (SELECT DISTINCT id, term FROM c) p ON p.id = b.id AND p.term = k.term GROUP BY ALL)
SELECT b.qid, b.id, b.place AS rank, round(coalesce(c, 0) / t, 6) AS coverage, round(score / t, 6) AS strength FROM best b JOIN total USING (qid) LEFT JOIN cov ON cov.qid = b.qid AND cov.id = b.id""",
    "direct_refs": "SELECT o_custkey AS qid, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord FROM orders",
    "vector_topk": f"WITH {_V}, n AS (SELECT a.id AS qid, b.id, round(list_dot_product(a.vec, b.vec), 9) AS score FROM v a, v b WHERE a.id % 50 = 0) SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY n.score DESC, id) AS rank FROM n QUALIFY rank <= {K}",
    "vector_lists_exact": f"WITH {_V}, n AS (SELECT a.id AS qid, b.id, round(list_dot_product(a.vec, b.vec), 9) AS score FROM v a, v b WHERE a.id % 50 = 0) SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY n.score DESC, id) AS rank FROM n QUALIFY rank <= {K}",
    "similar_items": f"WITH {_V}, n AS (SELECT a.id AS qid, b.id, round(list_dot_product(a.vec, b.vec), 9) AS score FROM v a, v b WHERE a.id % 50 = 0 AND a.id <> b.id) SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY n.score DESC, id) AS rank FROM n QUALIFY rank <= 3",
    "hybrid_rrf": f"""{_WITH}, {_V}, n AS (SELECT a.id AS qid, b.id, round(list_dot_product(a.vec, b.vec), 9) AS score FROM v a JOIN benchmark ON item_id = a.id, v b),
nk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM n QUALIFY rank <= 400),
{_FUSED.format('SELECT qid, id, rank FROM ' + S.ranked('bm', 400) + ' UNION ALL SELECT qid, id, rank FROM nk WHERE score > 0')} {_TOP}""",
    "eval_top1": f"{_WITH}, {_GOLD}, h AS (SELECT * FROM {S.ranked('bm', 1)}) SELECT count(*) AS n, round(avg(coalesce(good, 0)), 6) AS accuracy FROM (SELECT DISTINCT qid FROM g) LEFT JOIN (SELECT h.qid, 1.0 AS good FROM h JOIN g ON g.qid = h.qid AND g.id = h.id) USING (qid)",
    "eval_p_at_5": f"{_WITH}, {_GOLD}, h AS (SELECT * FROM {S.ranked('bm', 5)}), p AS (SELECT h.qid, avg(CASE WHEN g.id IS NULL THEN 0.0 ELSE 1.0 END) AS p FROM h LEFT JOIN g ON g.qid = h.qid AND g.id = h.id GROUP BY h.qid) SELECT count(*) AS n, round(avg(coalesce(p, 0)), 6) AS precision FROM (SELECT DISTINCT qid FROM g) LEFT JOIN p USING (qid)",
}
