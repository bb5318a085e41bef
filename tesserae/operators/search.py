"""BM25 scoring, passage maxima, reciprocal-rank fusion, coverage search and direct references.

Questions are a DataFrame (qid, ...), so many are answered in one plan. Ties go to the smaller id.
Lists hold only items that pass the filter and score above 0. With dense_fill() and fuse(fill=True)
zero scores and items that fail the filter are ranked last, up to the depth, as a dense ranking would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType, StringType, StructType

from ..functions.text import expand, terms
from ..sources.stored import stored
from .block_scores import best_of_blocks
from .index import Index, weight
from .segments import bucket, by_owner, unpacked

#: Rank offset and depth of the fusion, boost of items named by number.
OFFSET, DEPTH, DIRECT = 60, 400, 1.0
#: Digits of scores: equal items tie whatever the order in which their weights were added.
DIGITS = 9
#: Question terms, and blocks, up to which a side is broadcast.
BROADCAST_ROWS = 1_000_000
#: Documents for which the best of a task are listed, and listed question terms that are broadcast.
TASK_DOCS, LISTED_ROWS = 50_000, 100_000
#: Kinds of items, and of filters, that are judged once and for all instead of item by item.
KINDS = 2_000
#: Items, as a multiple of k, whose blocks are opened first; what sums of rounded weights may differ by.
FIRST, SLACK = 2, 1e-6


def query_terms(questions: DataFrame, column: str = "question", expanded: bool = True) -> DataFrame:
    """(qid, term): distinct terms of each question."""
    c = expand(column) if expanded else F.col(column)
    return questions.select("qid", F.explode(F.array_distinct(terms(c))).alias("term"))


def bm25(index: Index, qterms: DataFrame) -> DataFrame:
    """(qid, id, score): the sum of the weights of the question's terms. A stored index is read by the
    buckets of these terms."""
    if index.segments is None:
        return index.postings.join(qterms, "term").groupBy("qid", "id").agg(F.round(F.sum("weight"), DIGITS).alias("score"))
    asked, n_asked, buckets = _weighed(index, qterms)
    return _opened(index, asked, n_asked, buckets).select("qid", "id", "score")


def best_of_files(index: Index, qterms: DataFrame, k: int, files: DataFrame) -> DataFrame:
    """(qid, id, score): of the items of files (id, file_id) at least those k that are best by bm25() among
    the best of each file, with a score above 0.

    A task keeps k items of each question, as in best(). Where blocks can't be scored by themselves, all
    scores are reduced to one for each file.
    """
    if _by_blocks(index, qterms, None) and isinstance(files.schema["id"].dataType, IntegralType) and isinstance(files.schema["file_id"].dataType, StringType):
        return _best(index, *_weighed(index, qterms), k, files=files)
    scores = bm25(index, qterms).where("score > 0").join(files.select("id", "file_id"), "id")
    one = scores.groupBy("qid", "file_id").agg(F.min(F.struct((-F.col("score")).alias("less"), "id")).alias("first"))
    return rank(one.select("qid", "first.id", (-F.col("first.less")).alias("score")), k).drop("rank")


def best(index: Index, qterms: DataFrame, k: int, owner: str | None = None, only: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(qid, id, score): at least the k best of bm25() that score above 0, from which rank() takes the k best.

    owner: a field of the ids; then id is its value and score that of its best passage, as by best_passage().
    only: items and filters, one row for each, of whose scores filtered() leaves those that are ranked.
    A task scores block after block and keeps its k best: neither its memory nor what is shuffled then
    grows with the items. Where ids were removed from the index, or filters and what they compare are of
    very many kinds, all scores are shuffled and ranked.
    """
    judged = _judged(*only) if only and _by_blocks(index, qterms, owner) else None
    if not _by_blocks(index, qterms, owner) or only and not judged:
        scores = bm25(index, qterms)
        scores = best_passage(scores, F.col(f"id.{owner}")) if owner else scores
        scores = filtered(scores, *only) if only else scores
        return rank(scores.where("score > 0"), k).drop("rank")
    asked, n_asked, buckets = _weighed(index, qterms)
    return _best(index, asked, n_asked, buckets, k, owner, judged=judged)


def _judged(items: DataFrame, filters: DataFrame) -> tuple[DataFrame, DataFrame, list[list[bool]]] | None:
    """(id, kind) of the items, (qid, rule) of the filters, and for each rule which kinds it lets through, all
    if none would pass; None where kinds or rules are too many, or not strings."""
    names = ["instance", "year"]
    spark = items.sparkSession
    text = all(isinstance(x.schema[c].dataType, StringType) for x in (items, filters) for c in names)
    if not text or not isinstance(items.schema["id"].dataType, IntegralType):
        return None
    kinds, rules = ([tuple(r) for r in x.select(*names).distinct().limit(KINDS + 1).collect()] for x in (items, filters))
    if max(len(kinds), len(rules)) > KINDS:
        return None
    passes = [[(i is None or a is not None and a.startswith(i)) and (y is None or b == y) for a, b in kinds] for i, y in rules]

    def number(df: DataFrame, found: list[tuple], key: str, name: str) -> DataFrame:
        listed = spark.createDataFrame([(*r, n) for n, r in enumerate(found)], f"k_instance string, k_year string, {name} int")
        same = F.col("instance").eqNullSafe(F.col("k_instance")) & F.col("year").eqNullSafe(F.col("k_year"))
        return df.join(F.broadcast(listed), same).select(key, name)

    return number(items, kinds, "id", "kind"), number(filters, rules, "qid", "rule"), [p if any(p) else [True] * len(p) for p in passes]


def _by_blocks(index: Index, qterms: DataFrame, owner: str | None) -> bool:
    """Whether blocks can be scored by themselves: numbers as ids and no removed ones."""
    if index.segments is None or index.segments.gone() is not None or not isinstance(qterms.schema["qid"].dataType, IntegralType):
        return False
    held = index.postings.schema["id"].dataType
    fields = held.fields if isinstance(held, StructType) else []
    whole = all(isinstance(f.dataType, IntegralType) for f in fields) if owner else isinstance(held, IntegralType)
    # Blocks of an owner's passages hold all of them.
    return whole and (owner is None or owner == "id" and index.segments.block is by_owner)


def _best(index: Index, asked: DataFrame, n_asked: int, buckets: list[int], k: int, owner: str | None = None, chosen: DataFrame | None = None, judged: tuple | None = None, files: DataFrame | None = None) -> DataFrame:
    """best() of all blocks, or of chosen (qid, block); judged: as _judged() gives it. files: as best_of_files() takes them."""
    spark = asked.sparkSession
    few = n_asked <= LISTED_ROWS
    qid = F.col("qid").cast("long")
    if judged:
        each = F.collect_list(F.struct(qid.alias("qid"), "rule"))
        listed = asked.join(judged[1], "qid").groupBy("term").agg(F.first("idf").alias("idf"), each.alias("each"))
        listed = listed.select("term", "idf", F.col("each.qid").alias("qids"), F.col("each.rule").alias("rules"))
    else:
        listed = asked.groupBy("term").agg(F.first("idf").alias("idf"), F.collect_list(qid).alias("qids"))
    held = index.segments.postings(buckets).select("block", "term", "ids", "tfs", "lens")
    held = held.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi") if few else held.join(listed, "term")
    if chosen is not None:
        # A block's questions go with its postings, as one row more: beside each of them they would be most of a task's memory.
        wanted = stored(chosen.groupBy("block").agg(F.collect_set(qid).alias("wanted")))
        blocks = wanted.select("block")
        held = held.join(F.broadcast(blocks) if wanted.count() <= LISTED_ROWS else blocks, "block", "left_semi")
        held = held.unionByName(wanted, allowMissingColumns=True)
    if judged:
        # A block's items and their kinds go with its postings, as one row more.
        item = F.struct(F.col("id").alias(owner)) if owner else F.col("id")
        packed = judged[0].groupBy(index.segments.block(item).alias("block")).agg(F.collect_list(F.struct(F.col("id").cast("long").alias("id"), "kind")).alias("each"))
        held = held.unionByName(packed.select("block", F.col("each.id").alias("items"), F.col("each.kind").alias("kinds")), allowMissingColumns=True)
    if files is not None:
        packed = files.groupBy(index.segments.block(F.col("id")).alias("block")).agg(F.collect_list(F.struct(F.col("id").cast("long").alias("id"), F.col("file_id").cast("binary").alias("file"))).alias("each"))
        held = held.unionByName(packed.select("block", F.col("each.id").alias("items"), F.col("each.file").alias("files")), allowMissingColumns=True)
    tasks = max(2 * spark.sparkContext.defaultParallelism, index.segments.totals()[0] // TASK_DOCS + 1)
    rows = held.repartition(tasks, "block")
    rows = rows.join(F.broadcast(listed), "term", "inner" if judged is None and chosen is None and files is None else "left") if few else rows
    rows = rows.sortWithinPartitions("block").drop("term")
    found = rows.mapInArrow(best_of_blocks(k, index.average, owner, DIGITS, judged and judged[2]), "qid long, id long, score double")
    kinds = asked.schema["qid"].dataType, index.postings.schema["id"].dataType
    return found.select(F.col("qid").cast(kinds[0]), F.col("id").cast(kinds[1][owner].dataType if owner else kinds[1]), "score")


def bm25_top(index: Index, qterms: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): the k best of bm25(), without opening every block of a stored index.

    Bounds come from the largest count and least length of each term in each block. Blocks of the
    highest bounds, enough for k items, are opened first; the k-th best score in them is one that a
    block's bound has to reach. Scores and ranks are those of all blocks; what is skipped can't enter.
    """
    if index.segments is None:
        return rank(bm25(index, qterms).where("score > 0"), k)
    asked, n_asked, buckets = _weighed(index, qterms)
    tops = index.segments.postings(buckets).select("term", "block", "max_tf", "min_len", "n")
    most = weight(F.col("max_tf"), F.col("min_len"), F.lit(index.average), F.col("idf"))
    # Segments of a block hold different items, so what they add up to bounds each of them.
    bounds = tops.join(_small(asked, n_asked), "term").groupBy("qid", "block").agg(F.sum(most).alias("bound"), F.max("n").alias("n"))
    bounds = stored(bounds)
    order = Window.partitionBy("qid").orderBy(F.col("bound").desc(), "block")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = bounds.withColumn("before", before).where(F.col("before") < FIRST * k).select("qid", "block")
    if _by_blocks(index, qterms, None):
        opened = lambda chosen: _best(index, asked, n_asked, buckets, k, chosen=chosen)
    else:
        opened = lambda chosen: _opened(index, asked, n_asked, buckets, chosen).where("score > 0")
    one = stored(rank(opened(first), k))
    least = one.where(F.col("rank") == k).select("qid", F.col("score").alias("least"))
    rest = bounds.join(first, ["qid", "block"], "left_anti").join(least, "qid", "left")
    rest = rest.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK)).select("qid", "block")
    two = rank(opened(rest), k)
    return rank(one.unionByName(two).select("qid", "id", "score"), k)


def _weighed(index: Index, qterms: DataFrame) -> tuple[DataFrame, int, list[int]]:
    """Known question terms (qid, term, idf), their number, and the buckets that hold them (a fixed
    number at most)."""
    asked = stored(qterms.join(index.terms.select("term", "idf"), "term").select("qid", "term", "idf"))
    of = bucket(F.col("term"), index.segments.buckets)
    seen = asked.groupBy(of.alias("b")).agg(F.count("*").alias("n")).collect()
    return asked, sum(r["n"] for r in seen), sorted(r["b"] for r in seen)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _opened(index: Index, asked: DataFrame, n_asked: int, buckets: list[int], chosen: DataFrame | None = None) -> DataFrame:
    """(block, qid, id, score) of all blocks, or of chosen (qid, block).

    Packed postings are dealt by block before they are unpacked, and all of an item's lie in its block:
    the sums need no shuffle of their own, and what is shuffled doesn't grow with the questions.
    """
    held = index.segments.postings(buckets).select("seg", "block", "term", "ids", "tfs", "lens")
    if n_asked <= BROADCAST_ROWS:
        held = held.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    if chosen is not None:
        wanted = stored(chosen.groupBy("block").agg(F.collect_set("qid").alias("wanted")))
        blocks = wanted.select("block")
        held = held.join(_small(blocks, wanted.count()), "block", "left_semi")
    rows = held.repartition("block").join(_small(asked, n_asked), "term")
    if n_asked > BROADCAST_ROWS:
        rows = rows.repartition("block")
    if chosen is not None:
        # Only now, so that the lists are neither shuffled nor sorted beside each posting.
        pairs = wanted.agg(F.sum(F.size("wanted")).alias("n")).first()["n"] or 0
        rows = rows.join(_small(wanted, pairs), "block").where(F.array_contains("wanted", F.col("qid"))).drop("wanted")
    rows = index.segments.alive(unpacked(rows, "seg", "block", "qid", "idf"))
    one = weight(F.col("tf"), F.col("len"), F.lit(index.average), F.col("idf"))
    return rows.groupBy("block", "qid", "id").agg(F.round(F.sum(one), DIGITS).alias("score"))


def query_idf(index: Index, qterms: DataFrame) -> DataFrame:
    """(qid, total_idf) over the known terms."""
    return index.terms.join(qterms, "term").groupBy("qid").agg(F.sum("idf").alias("total_idf"))


def best_passage(scores: DataFrame, owner: DataFrame | Column) -> DataFrame:
    """(qid, id, score): each item's best passage, 0 at least. owner: (passage id as id, item), or the
    item as an expression of the passage's id, which spares the join."""
    named = scores.withColumn("item", owner) if isinstance(owner, Column) else scores.join(owner, "id")
    return named.groupBy("qid", "item").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score")).withColumnRenamed("item", "id")


def rank(scores: DataFrame, depth: int, score: str = "score") -> DataFrame:
    """Adds rank 1..depth within each question; only that many rows of a question stay."""
    w = Window.partitionBy("qid").orderBy(F.col(score).desc(), F.col("id"))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth)


def filtered(scores: DataFrame, items: DataFrame, filters: DataFrame) -> DataFrame:
    """Scores of the items that pass their question's filters; of all, if no item of the corpus passes.

    items: (id, instance, year); filters: (qid, instance, year), null where not set.
    """
    f = filters.select("qid", F.col("instance").alias("f_instance"), F.col("year").alias("f_year"))
    passes = (F.col("f_instance").isNull() | F.col("instance").startswith(F.col("f_instance"))) & (F.col("f_year").isNull() | (F.col("year") == F.col("f_year")))
    # Distinct filters and distinct (instance, year) are few: this decides which filters match anything.
    kinds = items.select("instance", "year").distinct()
    alive = (
        f.select("f_instance", "f_year").distinct().join(kinds, passes, "left_semi").select("f_instance", "f_year", F.lit(True).alias("alive"))
    )
    f = f.join(alive.withColumnsRenamed({"f_instance": "ai", "f_year": "ay"}), F.col("f_instance").eqNullSafe(F.col("ai")) & F.col("f_year").eqNullSafe(F.col("ay")), "left").select("qid", "f_instance", "f_year", F.coalesce("alive", F.lit(False)).alias("alive"))
    return scores.join(items.select("id", "instance", "year"), "id").join(f, "qid").where(passes | ~F.col("alive")).select(scores.columns)


def fuse(lists: list[DataFrame], weights: list[float] | None = None, depth: int = DEPTH, direct: DataFrame | None = None, fill: bool = False) -> DataFrame:
    """(qid, id, fused): the sum of weight / (60 + rank) over the lists, plus 1 for named items.

    fill: a list counts whole for each question for which anything in it scores above 0.
    """
    scored = lambda x: x.join(x.where("score > 0").select("qid").distinct(), "qid", "left_semi") if fill else x.where("score > 0")
    parts = [
        rank(scored(scores), depth).select("qid", "id", (F.lit(w) / (OFFSET + F.col("rank"))).alias("part"))
        for scores, w in zip(lists, weights or [1.0] * len(lists))
    ]
    if direct is not None:
        parts.append(direct.select("qid", "id", F.lit(DIRECT).alias("part")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("qid", "id").agg(F.round(F.sum("part"), DIGITS + 3).alias("fused"))


def top(fused: DataFrame, k: int) -> DataFrame:
    """(qid, id, rank, score): the k best, scores divided by the best one's."""
    ranked = rank(fused.where("fused > 0"), k, "fused")
    return ranked.select("qid", "id", "rank", (F.col("fused") / F.max("fused").over(Window.partitionBy("qid"))).alias("score"))


def dense_fill(scores: DataFrame, items: DataFrame, questions: DataFrame, filters: DataFrame | None = None) -> DataFrame:
    """Every item for every question that has any score, zeros included: what a dense ranking sees.
    Items that fail their question's filter score -1.

    For small corpora and question sets only: the result has one row for each pair.
    """
    scored = questions.select("qid").join(scores.select("qid").distinct(), "qid", "left_semi")
    dense = scored.crossJoin(items.select("id")).join(scores, ["qid", "id"], "left").select("qid", "id", F.coalesce("score", F.lit(0.0)).alias("score"))
    if filters is None:
        return dense
    passed = filtered(dense, items, filters).select("qid", "id", F.lit(True).alias("passed"))
    return dense.join(passed, ["qid", "id"], "left").select("qid", "id", F.when(F.col("passed"), F.col("score")).otherwise(-1.0).alias("score"))


def coverage(index: Index, qterms: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(qid, id, coverage, strength, rank): the best k items, one for each file.

    items: (id, file_id, present), present the distinct terms of title, subject and passages. Files are
    as many as the question meets, however many of its best items lie in one. coverage: the share of the
    question's idf present in the item; strength: BM25 over the question's idf.
    """
    pool = best_of_files(index, qterms, k, items.select("id", "file_id")).join(items, "id")
    first = Window.partitionBy("qid", "file_id").orderBy(F.col("score").desc(), "id")
    pool = rank(pool.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n"), k)
    known = index.terms.join(qterms, "term").select("qid", "term", "idf")
    total = known.groupBy("qid").agg(F.sum("idf").alias("total_idf"))
    return (
        pool.join(known, "qid").join(total, "qid")
        .groupBy("qid", "id", "rank", "score", "total_idf")
        .agg(F.sum(F.when(F.array_contains("present", F.col("term")), F.col("idf")).otherwise(0.0)).alias("covered"))
        .select("qid", "id", (F.col("covered") / F.col("total_idf")).alias("coverage"), (F.col("score") / F.col("total_idf")).alias("strength"), "rank")
    )


def direct_references(questions: DataFrame, ids: DataFrame, column: str = "question") -> DataFrame:
    """(qid, id, ord): items that a question names by notice or protocol number, in order, each once.

    ids: (kind 'notice' or 'protocol', key, id). A long number is a protocol if one has it, else a
    notice.
    """
    from ..functions.extract import digit_refs, notice_refs

    asked = questions.select("qid", F.posexplode(F.concat(
        F.transform(notice_refs(column), lambda x: F.struct(F.lit("notice").alias("want"), x.alias("key"))),
        F.transform(digit_refs(column), lambda x: F.struct(F.lit("either").alias("want"), x.alias("key"))),
    )).alias("pos", "r")).select("qid", "pos", "r.want", "r.key")
    hits = asked.join(ids, "key").where("kind = 'notice' or want = 'either'")
    best = F.max(F.col("kind") == "protocol").over(Window.partitionBy("qid", "pos"))
    kept = hits.withColumn("protocols", best).where((F.col("want") == "notice") | ((F.col("kind") == "protocol") == F.col("protocols")))
    once = kept.groupBy("qid", "id").agg(F.min(F.struct("pos", "id")).alias("at"))
    return once.select("qid", "id", F.row_number().over(Window.partitionBy("qid").orderBy("at")).alias("ord"))
