"""Exact counts over the whole collection, offences a question is about, most cited articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.citations import citations, question_citations
from ..functions.text import capitalize, process_terms, terms

# The order in which outcomes are listed; the first four also when zero.
OUTCOME_ORDER = ("deferido", "parcialmente deferido", "indeferido", "não conhecido", "extinto", "diligência", "não identificado")
ALWAYS, LAST_YEARS, UNKNOWN = 4, 6, OUTCOME_ORDER[-1]
# Gates and weights of offence candidates.
COVERAGE, SHARE, SHARE_WEIGHT, COUNT_WEIGHT, MARGIN, GROUPS, ROOT_WORDS = 0.3, 0.5, 0.5, 0.05, 0.1, 2, 6
#: Added to a hit's place, from 0, in its weight.
PLACE = 3
#: Keys of requests up to which they are broadcast.
BROADCAST_ROWS = 100_000


def cube(items: DataFrame) -> DataFrame:
    """(cell, keys, outcome, instance, year, n): items counted by their set of keys and their facets.

    items: (keys, outcome, instance, year). An item lies in one cell, so cells of several keys add up
    without counting it twice. An empty or null outcome is 'não identificado', null keys are no keys.
    Store it and any number of requests meet its cells, not the items.
    """
    outcome = F.when(F.coalesce("outcome", F.lit("")) == "", UNKNOWN).otherwise(F.col("outcome"))
    keys = F.array_sort(F.array_distinct(F.coalesce("keys", F.array().cast("array<string>"))))
    # Partial aggregates: a combination that a third of all items share is one row of each task.
    cells = items.groupBy(keys.alias("keys"), outcome.alias("outcome"), "instance", "year").agg(F.count("*").alias("n"))
    return cells.withColumn("cell", F.struct("keys", "outcome", "instance", "year"))


def selected(cells: DataFrame, requests: DataFrame) -> DataFrame:
    """(rid, outcome, instance, year, n): the cells that each request counts, each once.

    cells: as cube() gives them. requests: (rid, keys, instance, year); null keys: all items, null
    filters: none. A filter that nothing passes selects nothing. Requests are
    broadcast if few, cells never: they lie small in a file, so that Spark would take many for few.
    """
    r = requests.select("rid", F.col("keys").alias("r_keys"), F.col("instance").alias("r_instance"), F.col("year").alias("r_year"))
    passes = (F.col("r_instance").isNull() | F.col("instance").startswith(F.col("r_instance"))) & (F.col("r_year").isNull() | (F.col("year") == F.col("r_year")))
    pick = ["rid", "outcome", "instance", "year", "n"]
    keyed = r.where("r_keys is not null").withColumn("key", F.explode(F.array_distinct("r_keys")))
    keyed = F.broadcast(keyed) if keyed.count() <= BROADCAST_ROWS else keyed.hint("merge")
    by_key = cells.withColumn("key", F.explode("keys")).join(keyed, "key").where(passes)
    by_key = by_key.groupBy("rid", "cell").agg(*(F.first(c).alias(c) for c in pick[1:]))
    # Requests for everything meet the facets alone: as many rows as there are kinds of decision.
    whole = r.where("r_keys is null")
    facets = cells.groupBy("outcome", "instance", "year").agg(F.sum("n").alias("n"))
    kinds = facets.select("instance", "year").distinct()
    filters = whole.select("r_instance", "r_year").distinct().join(kinds, passes)
    everything = whole.withColumnsRenamed({"r_instance": "w_instance", "r_year": "w_year"}).join(
        filters, F.col("w_instance").eqNullSafe(F.col("r_instance")) & F.col("w_year").eqNullSafe(F.col("r_year"))
    ).select("rid", F.col("instance").alias("k_instance"), F.col("year").alias("k_year"))
    everything = everything.join(facets, F.col("k_instance").eqNullSafe(F.col("instance")) & F.col("k_year").eqNullSafe(F.col("year")))
    return by_key.select(pick).unionByName(everything.select(pick))


def panorama(chosen: DataFrame) -> DataFrame:
    """(rid, facet, value, n): totals and counts by outcome, instance and non-empty year in one pass.

    chosen: cells as selected() gives them.
    """
    facets = F.array(
        F.struct(F.lit("total").alias("facet"), F.lit("").alias("value")), *[F.struct(F.lit(c).alias("facet"), F.coalesce(c, F.lit("")).alias("value")) for c in ("outcome", "instance", "year")],
    )
    combined = chosen.groupBy("rid", "outcome", "instance", "year").agg(F.sum("n").alias("n"))
    long = combined.select("rid", F.explode(facets).alias("f"), "n").select("rid", "f.facet", "f.value", "n")
    return long.where("not (facet = 'year' and value = '')").groupBy("rid", "facet", "value").agg(F.sum("n").alias("n"))


def percent(part: Column, whole: Column) -> Column:
    """Half-even whole percentage, as text."""
    return F.bround(100.0 * part / whole, 0).cast("long").cast("string")


def panorama_text(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """(rid, body): the counts as text; requests that count nothing have no row. labels: (rid, label)."""
    listed = counts.groupBy("rid").agg(
        F.sum(F.when(F.col("facet") == "total", F.col("n"))).alias("total"),
        F.map_from_entries(F.collect_list(F.when(F.col("facet") == "outcome", F.struct("value", "n")))).alias("outcomes"),
        F.array_sort(F.collect_list(F.when(F.col("facet") == "instance", F.struct((-F.col("n")).alias("r"), "value", "n")))).alias("instances"),
        F.array_sort(F.collect_list(F.when(F.col("facet") == "year", F.struct("value", "n")))).alias("years"),
    )
    join = lambda parts, sep: F.array_join(parts, sep)
    pair = lambda e: F.concat(e["value"], F.lit(": "), e["n"].cast("string"))
    total = F.col("total")
    lines = []
    for i, name in enumerate(OUTCOME_ORDER):
        n = F.coalesce(F.try_element_at("outcomes", F.lit(name)), F.lit(0).cast("long"))
        line = F.concat(F.lit(f"- {name.upper()}: "), n.cast("string"), F.lit(" de "), total.cast("string"), F.lit(" ("), percent(n, total), F.lit("%)"))
        lines.append(line if i < ALWAYS else F.when(n > 0, line))
    years = F.slice("years", F.greatest(F.size("years") - LAST_YEARS + 1, F.lit(1)), LAST_YEARS)
    body = F.concat_ws(
        "\n", F.concat(F.lit("Infração: "), "label"),
        F.concat(F.lit("Total de decisões no acervo: "), total.cast("string"), F.lit(" ("), join(F.transform("instances", pair), "; "), F.lit(")")),
        *lines, F.concat(F.lit("Decisões por ano (últimos): "), join(F.transform(years, pair), ", ")),
    )
    return listed.where("total > 0").join(labels, "rid").select("rid", body.alias("body"))


def label(names: DataFrame, groups: DataFrame) -> DataFrame:
    """(rid, label): the first key's display name and how many variants stand beside it."""
    more = F.size("keys") - 1
    suffix = F.when(more > 0, F.concat(F.lit(" (e mais "), more.cast("string"), F.lit(" variante(s) do código no SIF)"))).otherwise("")
    return (
        groups.withColumn("key", F.get("keys", F.lit(0))).join(names.select("key", "name"), "key", "left")
        .select("rid", F.when(F.col("keys").isNull(), "todas (acervo inteiro)").otherwise(F.concat(capitalize(F.coalesce("name", "key")), suffix)).alias("label"))
    )


def offence_share(hits: DataFrame, keys: DataFrame) -> DataFrame:
    """(qid, key, share): each key's part of the weights 1 / (place + 3) of a question's hits, a hit's
    weight divided among its keys. hits: (qid, id, place from 0); keys: (id, keys)."""
    w = 1 / (F.col("place") + PLACE)
    total = hits.groupBy("qid").agg(F.sum(w).alias("total"))
    spread = hits.join(keys, "id").select("qid", F.explode("keys").alias("key"), (w / F.size("keys")).alias("w"))
    return spread.groupBy("qid", "key").agg(F.sum("w").alias("w")).join(total, "qid").select("qid", "key", (F.col("w") / F.col("total")).alias("share"))


def offence_candidates(questions: DataFrame, hits: DataFrame, keys: DataFrame, names: DataFrame, idf: DataFrame, column: str = "question") -> DataFrame:
    """(qid, ord, keys): up to two groups of offence keys that a question is about.

    names: (key, name, n). A name qualifies by the question's idf that it covers, or by its share of
    the hits; what scores within the margin of the best stays, one group for each beginning of keys.
    Names are met through their terms, not one by one.
    """
    asked = questions.select("qid", F.explode(F.array_distinct(terms(column))).alias("term")).join(F.broadcast(process_terms(questions.sparkSession)), "term", "left_anti").join(idf.select("term", "idf"), "term")
    total = asked.groupBy("qid").agg(F.sum("idf").alias("total_idf"))
    named = names.select("key", F.explode(F.array_distinct(terms("name"))).alias("term"))
    covered = asked.join(named, "term").groupBy("qid", "key").agg(F.sum("idf").alias("common")).join(total, "qid").select("qid", "key", (F.col("common") / F.col("total_idf")).alias("coverage"))
    both = covered.join(offence_share(hits, keys), ["qid", "key"], "full").select("qid", "key", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("share", F.lit(0.0)).alias("share"))
    good = both.where((F.col("coverage") >= COVERAGE) | (F.col("share") >= SHARE)).join(names, "key")
    note = F.col("coverage") + SHARE_WEIGHT * F.col("share") + COUNT_WEIGHT * F.log10(1 + F.col("n"))
    root = F.substring_index("key", " ", ROOT_WORDS)
    good = good.select("qid", "key", note.alias("note"), "n", root.alias("root"))
    good = good.withColumn("best", F.max("note").over(Window.partitionBy("qid"))).where("note >= best - %s" % MARGIN)
    order = [F.col("note").desc(), F.col("n").desc(), F.col("key").desc()]
    first = good.withColumn("r", F.row_number().over(Window.partitionBy("qid", "root").orderBy(*order))).where("r = 1")
    roots = first.withColumn("ord", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("ord") <= GROUPS).select("qid", "ord", "root")
    members = names.select("key", F.col("n"), root.alias("root"))
    return (
        roots.join(members, "root").groupBy("qid", "ord")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("r"), "key"))), lambda e: e["key"]).alias("keys"))
    )


def cited_articles(questions: DataFrame, hits: DataFrame, notices: DataFrame, articles: DataFrame, limit: int = 2, column: str = "question") -> DataFrame:
    """(qid, ord, at): articles the question cites, then those that most of its decisions cite.

    hits: (qid, id); notices: (id, provision text); articles: (cited, at). An article counts once for a
    decision and needs two of them, or the only one; ties go to the smaller at.
    """
    asked = questions.select("qid", F.posexplode(question_citations(column)).alias("pos", "cited")).join(articles, "cited").select("qid", F.lit(0).alias("tier"), F.col("pos").cast("long").alias("rank"), "at")
    cited = notices.select("id", F.explode(citations("provision")).alias("cited")).join(articles, "cited").select("id", "at").distinct()
    least = F.when(F.col("n_hits") == 1, 1).otherwise(2)
    counted = (
        hits.join(cited, "id").groupBy("qid", "at").agg(F.count_distinct("id").alias("n"))
        .join(hits.groupBy("qid").agg(F.count_distinct("id").alias("n_hits")), "qid").where(F.col("n") >= least)
        .select("qid", F.lit(1).alias("tier"), (-F.col("n")).alias("rank"), "at")
    )
    once = asked.union(counted).groupBy("qid", "at").agg(F.min(F.struct("tier", "rank", "at")).alias("o"))
    return once.withColumn("ord", F.row_number().over(Window.partitionBy("qid").orderBy("o"))).where(F.col("ord") <= limit).select("qid", "ord", "at")
