"""Pieces of DuckDB SQL that restate the text functions."""

from ..functions.text import EXPANSIONS, STOPWORDS


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def norm(x: str) -> str:
    return rf"regexp_replace(strip_accents(lower(coalesce({x}, ''))), '[^\x00-\x7f]', '', 'g')"


def terms(x: str) -> str:
    stop = ", ".join(quoted(w) for w in sorted(set(STOPWORDS.split())))
    return (
        f"list_transform(list_filter(regexp_extract_all({norm(x)}, '[a-z0-9]{{2,}}'), lambda w: w NOT IN ({stop})), "
        "lambda w: left(CASE WHEN length(w) > 4 AND w LIKE '%s' AND NOT regexp_full_match(w, '[0-9]+') THEN left(w, length(w) - 1) ELSE w END, 7))"
    )


def expand(x: str) -> str:
    plain = norm(x)
    return f"concat_ws(' ', coalesce({x}, ''), " + ", ".join(f"CASE WHEN regexp_matches({plain}, {quoted(p)}) THEN {quoted(w)} END" for p, w in EXPANSIONS) + ")"


def key(x: str) -> str:
    return rf"left(trim(regexp_replace(regexp_replace({norm(x)}, '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')), 160)"


def index(relation: str, suffix: str = "") -> str:
    """CTEs stats, terms and postings over a relation (id, t: terms)."""
    s = suffix
    return f"""
d{s} AS ({relation}),
stats{s} AS (SELECT count(*) AS n_docs, greatest(avg(len(t)), 1.0) AS avg_len FROM d{s}),
c{s} AS (SELECT id, term, l, count(*) AS tf FROM (SELECT id, len(t) AS l, unnest(t) AS term FROM d{s}) GROUP BY ALL),
terms{s} AS (SELECT term, count(*) AS df, ln(1 + (any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM c{s}, stats{s} GROUP BY term),
postings{s} AS (SELECT term, id, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avg_len)) * idf AS weight FROM c{s} JOIN terms{s} USING (term), stats{s})"""


def ranked(relation: str, depth: int, score: str = "score") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {score} DESC, id) AS rank FROM {relation} WHERE {score} > 0 QUALIFY rank <= {depth})"


DOCUMENTS = f"SELECT doc_id AS id, {terms('text')} AS t FROM documents"
QUESTIONS = f"q AS (SELECT item_id AS qid, text AS question, unnest(list_distinct({terms(expand('text'))})) AS term FROM benchmark)"
BM25 = "bm AS (SELECT qid, id, round(sum(weight), 9) AS score FROM postings JOIN q USING (term) GROUP BY qid, id)"
ITEMS = """items AS (SELECT doc_id AS id, CASE WHEN lang IN ('en', 'de') THEN '1ª instância' ELSE '2ª instância' END AS instance,
  (2015 + doc_id % 10)::VARCHAR AS year FROM documents)"""
