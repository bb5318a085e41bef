"""The whole evidence plan for a batch of questions over the four collections."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import extract as X
from ..functions.text import terms
from ..sources.records import articles, offence_names, reference_ids
from ..sources.stored import stored
from . import evidence as E, index as I, panorama as P, search, vector
from .segments import build_stored, by_owner


@dataclass
class Corpus:
    """Item rows as the sources give them; any but decisions may be missing.

    encoder: (terms, docs) of binary.read_encoder(). Items (kept) and indexes are written to the shared
    folder once per object, as every tier reads them; give a stored index (index.load_or_build) as decision_index,
    those of the other collections by name as side_indexes.
    """

    decisions: DataFrame
    guidance: DataFrame | None = None
    statutes: DataFrame | None = None
    opinions: DataFrame | None = None
    encoder: tuple[DataFrame, DataFrame] | None = None
    decision_index: I.Index | None = None
    side_indexes: dict[str, I.Index] | None = None

    @cached_property
    def kept(self) -> Corpus:
        """The same corpus over stored items."""
        side = lambda x: None if x is None else stored(x)
        return Corpus(stored(self.decisions), side(self.guidance), side(self.statutes), side(self.opinions), self.encoder, self.decision_index, self.side_indexes)

    @cached_property
    def _sides(self) -> dict[str, tuple[DataFrame, I.Index]]:
        return {}

    @cached_property
    def index(self) -> I.Index:
        return self.decision_index or build_stored(self.decisions)

    @cached_property
    def passages(self) -> DataFrame:
        return self.decisions.select("id", F.posexplode("passages").alias("pos", "passage"))

    @cached_property
    def passage_index(self) -> I.Index:
        return build_stored(self.passages.select(F.struct("id", "pos").alias("id"), terms("passage").alias("terms")), block=by_owner)

    @cached_property
    def cube(self) -> DataFrame:
        """Decisions counted once for every panorama."""
        return stored(P.cube(self.decisions))

    @cached_property
    def names(self) -> DataFrame:
        return offence_names(self.decisions)

    def side(self, name: str) -> tuple[DataFrame, I.Index] | None:
        """(items with id, file_id, present and their fields; index) of guidance, statutes or opinions."""
        items = getattr(self, name)
        if items is None:
            return None
        if name in self._sides:
            return self._sides[name]
        if "id" not in items.columns:
            items = items.withColumnRenamed("at", "id")
        if "subject" not in items.columns:
            items = items.withColumn("subject", F.lit(""))
        present = F.array_distinct(terms(F.concat_ws(" ", "title", "subject", F.array_join("passages", " "))))
        index = (self.side_indexes or {}).get(name) or _kept(I.build(items.select("id", "terms")))
        self._sides[name] = stored(items.withColumn("present", present)), index
        return self._sides[name]


def _kept(index: I.Index) -> I.Index:
    return I.Index(stored(index.postings), stored(index.terms), stored(index.stats))


def retrieve(corpus: Corpus, asked: DataFrame, filters: DataFrame, k: int) -> DataFrame:
    """(qid, id, rank, score): decision, best-passage and vector lists of the query, fused."""
    q = search.query_terms(asked, "query")
    only = corpus.decisions.select("id", "instance", "year"), filters
    passed = [search.best(corpus.index, q, search.DEPTH, only=only), search.best(corpus.passage_index, q, search.DEPTH, owner="id", only=only)]
    if corpus.encoder:
        words, docs = corpus.encoder
        near = vector.nearest(docs, vector.encode_questions(asked, words, "query"), search.DEPTH).select("qid", "id", "score")
        passed.append(search.filtered(near, *only))
    return search.top(search.fuse(passed), k)


def _passages(corpus: Corpus, chosen: DataFrame, q: DataFrame, n: int, limit: int) -> DataFrame:
    """(qid, id, passages): the n best under a budget; without any that scores, none."""
    found = E.best_passages(chosen, corpus.passages, q, corpus.index.terms, n)
    both = chosen.join(found, ["qid", "id"], "left")
    none = F.array().cast("array<string>")
    return both.withColumn("passages", E.budget(F.coalesce("passages", none), limit, F.col("operative")))


def _tier(rows: DataFrame, kind: str, order: Column, passages: Column, reason: str, ref: Column | None = None) -> DataFrame:
    return rows.select("qid", order.alias("ord"), F.lit(kind).alias("kind"), (F.col("id").cast("string") if ref is None else ref).alias("ref"), passages.alias("passages"), F.lit(reason).alias("reason"))


def _side_tier(corpus: Corpus, name: str, hits: DataFrame, q: DataFrame, items: DataFrame, limit: int, reason: str, order: Column) -> DataFrame:
    """Whole items if they fit, else their three best passages, else the head of the first."""
    rows = hits.join(items.select("id", "file_id", F.col("passages").alias("all")), "id")
    sized = rows.select("qid", "id", F.size("all").alias("n_passages"), F.lit(-1).alias("reasoning"))
    best = E.best_passages(sized, items.select("id", F.posexplode("passages").alias("pos", "passage")), q, corpus.index.terms, 3)
    both = rows.join(best, ["qid", "id"], "left")
    cut = E.budget(F.coalesce("passages", F.array().cast("array<string>")), limit, F.lit(""))
    return _tier(both, name, order, E.whole_or_best(F.col("all"), cut, limit), reason, F.col("file_id"))


def prepare(corpus: Corpus, questions: DataFrame, limits: E.Limits = E.Limits()) -> DataFrame:
    """(qid, number, kind, ref, passages, reason) in order of authority.

    questions: (qid, question) and, where follow-ups were resolved, query. ref is a decision's id, or
    another source's file_id. A question that names decisions gets these with their reasoning and their
    nearest neighbours; others get what retrieval finds.
    """
    corpus = corpus.kept
    asked = questions if "query" in questions.columns else questions.withColumn("query", F.col("question"))
    own, merged = X.question_filters("question"), X.question_filters("query")
    unset = own["instance"].isNull() & own["year"].isNull()
    filters = asked.select("qid", *[F.when(unset, merged[x]).otherwise(own[x]).alias(x) for x in ("instance", "year")])
    q, plain = search.query_terms(asked, "query"), search.query_terms(asked, "query", expanded=False)
    fields = corpus.decisions.select("id", "passages", "reasoning", "operative", F.size("passages").alias("n_passages"))

    direct = stored(search.direct_references(asked, reference_ids(corpus.decisions)))
    free = asked.join(direct.select("qid").distinct(), "qid", "left_anti")
    found = stored(retrieve(corpus, free, filters, limits.retrieved))
    hits = direct.select("qid", "id", (F.col("ord") - 1).alias("place")).unionByName(found.select("qid", "id", (F.col("rank") - 1).alias("place")))

    named = direct.where(F.col("ord") <= limits.cited).join(fields.withColumnRenamed("passages", "all"), "id")
    best = _passages(corpus, named.select("qid", "id", "ord", "reasoning", "operative", "n_passages", "all"), q, 4, limits.cited_chars)
    tiers = [_tier(best, "decision", F.col("ord"), F.coalesce(E.full_reasoning("all", F.col("reasoning"), F.col("operative"), limits.cited_chars), F.col("passages")), "citada na pergunta")]
    if corpus.encoder:
        docs = corpus.encoder[1]
        first = direct.where("ord = 1").select("qid", F.col("id").alias("of"))
        near = vector.similar_items(docs, first.select(F.col("of").alias("qid")).distinct(), limits.similar).select(F.col("qid").alias("of"), "id", "rank")
        like = first.join(near, "of").join(fields.drop("passages"), "id")
        tiers.append(_tier(_passages(corpus, like, q, 1, limits.similar_chars), "decision", F.col("rank") + limits.cited, F.col("passages"), "semelhante"))
    shown = found.where(F.col("rank") <= limits.decisions).join(fields.drop("passages"), "id")
    tiers.append(_tier(_passages(corpus, shown, q, limits.decision_passages, limits.decision_chars), "decision", F.col("rank"), F.col("passages"), ""))
    decisions = tiers[0]
    for t in tiers[1:]:
        decisions = decisions.unionByName(t)

    before = []
    if corpus.guidance is not None:
        before.append(guidance_tier(corpus, asked, limits))
    if side := corpus.side("statutes"):
        notices = corpus.decisions.select("id", F.explode("notices.dispositivo_legal_transgredido").alias("provision"))
        cited = P.cited_articles(asked, hits.where(F.col("place") < limits.decisions), notices, articles(corpus.statutes), column="query")
        best = search.coverage(side[1], plain, side[0], 1).select("qid", F.col("id").alias("at"), "coverage", "strength")
        chosen = E.statute_tier(cited, best, limits.statutes).withColumnRenamed("at", "id")
        before.append(_side_tier(corpus, "statute", chosen, q, side[0], limits.statute_chars, "legislação", F.col("ord")))
    if corpus.opinions is not None:
        before.append(opinion_tier(corpus, asked, limits))
    return E.numbered(*before, decisions, panoramas(corpus, asked, hits, direct, filters))


def guidance_tier(corpus: Corpus, asked: DataFrame, limits: E.Limits = E.Limits()) -> DataFrame:
    """The topic that covers most of a question (qid, query), if it passes the gates."""
    items, index = corpus.side("guidance")
    found = search.coverage(index, search.query_terms(asked, "query", expanded=False), items, 1)
    good = found.where((F.col("coverage") >= E.COVERAGE) & (F.col("strength") >= E.STRENGTH))
    return _side_tier(corpus, "guidance", good, search.query_terms(asked, "query"), items, limits.guidance_chars, "entendimento", F.col("rank"))


def opinion_tier(corpus: Corpus, asked: DataFrame, limits: E.Limits = E.Limits()) -> DataFrame:
    """The opinion's passage that covers most of a question (qid, query), by the gate for questions that ask
    for an opinion or the one for others."""
    items, index = corpus.side("opinions")
    hit = search.coverage(index, search.query_terms(asked, "query", expanded=False), items, 1)
    hit = hit.join(asked.select("qid", X.asks_opinion("query").alias("asked")), "qid").where(E.opinion_gate(F.col("coverage"), F.col("asked")))
    hit = hit.join(items.select("id", "file_id", "passages"), "id")
    return _tier(hit, "opinion", F.col("rank"), F.array(F.left(F.get("passages", F.lit(0)), F.lit(limits.opinion_chars))), "parecer", F.col("file_id"))


def panoramas(corpus: Corpus, asked: DataFrame, hits: DataFrame, direct: DataFrame, filters: DataFrame) -> DataFrame:
    """The counts of the offences that a question is about; of everything, for a quantitative question
    with neither an offence nor a named decision. Empty counts are left out."""
    groups = stored(P.offence_candidates(asked, hits, corpus.decisions.select("id", "keys"), corpus.names, corpus.index.terms, "query").select("qid", "ord", "keys"))
    whole = asked.where(X.is_quantitative("question")).join(groups, "qid", "left_anti").join(direct, "qid", "left_anti").select("qid", F.lit(1).alias("ord"), F.lit(None).cast("array<string>").alias("keys"))
    requests = groups.unionByName(whole).join(filters, "qid").withColumn("rid", F.struct("qid", "ord"))
    counts = P.panorama(P.selected(corpus.cube, requests))
    bodies = P.panorama_text(counts, P.label(corpus.names, requests))
    return bodies.select(F.col("rid.qid").alias("qid"), F.col("rid.ord").alias("ord"), F.lit("panorama").alias("kind"), F.lit("panorama").alias("ref"), F.array("body").alias("passages"), F.lit("panorama").alias("reason"))


def status(corpus: Corpus) -> DataFrame:
    """One row: how many files of each kind the corpus holds."""
    parts = [corpus.decisions.select("file_id", F.lit("decision").alias("kind"))]
    parts += [x.select("file_id", F.lit(k).alias("kind")) for k, x in (("guidance", corpus.guidance), ("statute", corpus.statutes), ("opinion", corpus.opinions)) if x is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("kind").agg(F.count_distinct("file_id").alias("files"))


