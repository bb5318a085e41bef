"""Evidence: passage selection under budgets, follow-ups, the numbered plan, prompt and summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import capitalize, strip_extension, terms

# Boosts of passages, short follow-ups, history, gates of the tiers.
REASONING_BOOST, POSITION_BOOST, FOLLOW_UP_TERMS = 1.6, 0.5, 7
HISTORY_TURNS, ANSWER_CHARS, OPERATIVE_CHARS = 2, 800, 700
COVERAGE, STRENGTH, OPINION, OPINION_ASKED = 0.5, 0.85, 0.7, 0.4
LEAST_CUT = 200


@dataclass(frozen=True)
class Limits:
    """Sizes of the evidence: sources and characters by tier."""

    decisions: int = 5
    decision_chars: int = 1100
    decision_passages: int = 2
    cited: int = 3
    cited_chars: int = 3600
    similar: int = 2
    similar_chars: int = 600
    guidance_chars: int = 1800
    statutes: int = 3
    statute_chars: int = 1000
    opinion_chars: int = 1100
    retrieved: int = 20


def best_passages(chosen: DataFrame, passages: DataFrame, qterms: DataFrame, idf: DataFrame, n: int) -> DataFrame:
    """(qid, id, passages): the n best passages of each chosen item, in document order.

    chosen: (qid, id, reasoning, n_passages); passages: (id, pos, passage). A passage scores the idf of
    the question's terms in it, raised from the reasoning on, or toward the end if that isn't known;
    ties go to the later passage; none scores 0. Sums go by size, so that passages of the same terms tie
    whatever the order in which joins deliver them.
    """
    rows = chosen.join(passages, "id")
    in_order = F.aggregate(F.array_sort(F.collect_list("idf")), F.lit(0.0), lambda a, x: a + x)
    met = (
        rows.select("qid", "id", "pos", F.explode(F.array_distinct(terms("passage"))).alias("term"))
        .join(qterms, ["qid", "term"]).join(idf.select("term", "idf"), "term").groupBy("qid", "id", "pos").agg(in_order.alias("idf"))
    )
    boost = F.when(F.col("reasoning") >= 0, F.when(F.col("pos") >= F.col("reasoning"), REASONING_BOOST).otherwise(1.0)).otherwise(1 + POSITION_BOOST * F.col("pos") / F.greatest("n_passages", F.lit(1)))
    scored = rows.join(met, ["qid", "id", "pos"]).withColumn("note", F.col("idf") * boost).where("note > 0")
    w = Window.partitionBy("qid", "id").orderBy(F.col("note").desc(), F.col("pos").desc())
    kept = scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    return kept.groupBy("qid", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "passage"))), lambda e: e["passage"]).alias("passages"))


def _fold(passages: Column, limit: int, operative: Column, head: int, skip: bool, least: int) -> Column:
    """Passages cut to what is left of a budget; one that holds the operative part's head is skipped, or ends it."""
    mark = F.left(F.coalesce(operative, F.lit("")), F.lit(head))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("used"), F.lit(False).alias("done"))

    def step(s: Column, p: Column) -> Column:
        held = (mark != "") & p.contains(mark)
        cut = F.left(p, F.greatest(F.lit(least), F.lit(limit) - s["used"]))
        used = s["used"] + F.length(cut)
        taken = F.struct(F.array_append(s["out"], cut).alias("out"), used.alias("used"), (used >= limit).alias("done"))
        ended = F.struct(s["out"].alias("out"), s["used"].alias("used"), F.lit(not skip).alias("done"))
        return F.when(s["done"], s).when(held, ended).otherwise(taken)

    return F.aggregate(passages, start, step, lambda s: s["out"])


def budget(passages: Column | str, limit: int, operative: Column) -> Column:
    """Passages cut to max(200, what is left of limit); those that repeat the operative part go."""
    return _fold(F.col(passages) if isinstance(passages, str) else passages, limit, operative, 80, True, LEAST_CUT)


def full_reasoning(passages: Column | str, reasoning: Column, operative: Column, limit: int = 3600) -> Column:
    """Passages from the reasoning on, up to the operative part or the limit; null without reasoning."""
    p = F.col(passages) if isinstance(passages, str) else passages
    return F.when(reasoning >= 0, _fold(F.slice(p, F.greatest(reasoning, F.lit(0)) + 1, F.greatest(F.size(p), F.lit(1))), limit, operative, 60, False, 0))


def whole_or_best(passages: Column, best: Column, limit: int) -> Column:
    """All passages if they fit the limit, else the best ones, else the head of the first."""
    size = F.aggregate(passages, F.lit(0), lambda a, x: a + F.length(x))
    return F.when(size <= limit, passages).when(F.size(F.coalesce(best, F.array().cast("array<string>"))) > 0, best).otherwise(F.array(F.left(F.get(passages, F.lit(0)), F.lit(limit))))


def follow_ups(turns: DataFrame) -> DataFrame:
    """Adds query: a question of fewer than seven terms takes the previous question of its conversation
    in front. turns: (conv_id, turn, question)."""
    before = F.lag("question").over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.withColumn("before", before).withColumn(
        "query", F.when((F.size(terms("question")) < FOLLOW_UP_TERMS) & F.col("before").isNotNull(), F.concat_ws(" ", "before", "question")).otherwise(F.col("question"))
    ).drop("before")


def history(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, messages): the two turns before each, as messages; answers cut to 800 characters.

    turns: (conv_id, turn, question, answer).
    """
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-HISTORY_TURNS, -1)
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    pair = F.array(message("user", F.col("question")), message("assistant", F.left("answer", F.lit(ANSWER_CHARS))))
    return turns.select("conv_id", "turn", F.flatten(F.collect_list(pair).over(w)).alias("messages"))


def numbered(*tiers: DataFrame) -> DataFrame:
    """(qid, number, kind, ref, passages, reason): the tiers' rows in order, numbered within a question.

    Each tier: (qid, ord, kind, ref, passages, reason). Order: guidance, statutes, opinion, decisions,
    panoramas.
    """
    out = None
    for i, t in enumerate(tiers):
        t = t.select("qid", F.lit(i).alias("tier"), F.col("ord").cast("long").alias("ord"), "kind", "ref", "passages", "reason")
        out = t if out is None else out.unionByName(t)
    return out.withColumn("number", F.row_number().over(Window.partitionBy("qid").orderBy("tier", "ord"))).select("qid", "number", "kind", "ref", "passages", "reason")


def statute_tier(cited: DataFrame, found: DataFrame, limit: int = Limits.statutes) -> DataFrame:
    """(qid, ord, at): cited articles, then the best hit that passes the gates, each once.

    cited: (qid, ord, at); found: (qid, at, coverage, strength).
    """
    good = found.where((F.col("coverage") >= COVERAGE) & (F.col("strength") >= STRENGTH)).select("qid", F.lit(1 << 20).cast("int").alias("ord"), "at")
    once = cited.select("qid", F.col("ord").cast("int").alias("ord"), "at").union(good).groupBy("qid", "at").agg(F.min("ord").alias("ord"))
    return once.withColumn("ord", F.row_number().over(Window.partitionBy("qid").orderBy("ord", "at"))).where(F.col("ord") <= limit)


def opinion_gate(coverage: Column, asked: Column) -> Column:
    return (coverage >= OPINION) | (asked & (coverage >= OPINION_ASKED))


def source_text(number: Column, kind: Column, header: Column, passages: Column, operative: Column) -> Column:
    """A numbered source as it stands in the prompt."""
    mark = F.concat(F.lit("["), number.cast("string"), F.lit("] "))
    quoted = F.transform(passages, lambda p: F.concat(F.lit("Trecho: «"), p, F.lit("»")))
    decided = F.when(~kind.isin("guidance", "statute", "opinion") & (F.coalesce(operative, F.lit("")) != ""), F.concat(F.lit("Decisão: «"), F.left(operative, F.lit(OPERATIVE_CHARS)), F.lit("»")))
    panorama = F.concat(mark, F.lit("PANORAMA (contagem exata de todo o acervo, pelo gabarito do SIF)\n"), F.get(passages, F.lit(0)))
    return F.when(kind == "panorama", panorama).otherwise(F.concat_ws("\n", F.concat(mark, header), F.array_join(quoted, "\n"), decided))


def prompt(system: str, history: Column, sources: Column, question: Column) -> Column:
    """array<struct<role, content>>: system text, earlier turns, then sources and question."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    body = F.concat_ws("\n\n", F.lit("FONTES:"), sources, F.concat(F.lit("PERGUNTA: "), question))
    empty = F.array().cast("array<struct<role:string,content:string>>")
    return F.concat(F.array(message("system", F.lit(system))), F.coalesce(history, empty), F.array(message("user", body)))


def summary(number: Column) -> Column:
    """struct of a source's display fields, over an item row with kind, passages, reason and the item's fields."""
    offences = F.array_sort(F.array_distinct(F.transform(F.filter("notices", lambda a: F.coalesce(a["infracao"], F.lit("")) != ""), lambda a: capitalize(F.trim(a["infracao"])))))
    decision, panorama = F.col("kind") == "decision", F.col("kind") == "panorama"
    return F.struct(
        number.alias("numero"), F.col("kind").alias("tipo"), F.when(decision, F.concat(F.lit("Protocolo "), "protocol")).otherwise(F.col("title")).alias("titulo"),
        F.when(F.col("kind") == "statute", F.col("subject")).otherwise("").alias("contexto"), F.when(panorama, F.get("passages", F.lit(0))).otherwise("").alias("texto"),
        F.when(F.col("protocol") != "", F.col("protocol")).otherwise(F.left(strip_extension("title"), F.lit(70))).alias("protocolo"),
        F.col("instance").alias("instancia"), F.col("date").alias("data"), F.col("outcome").alias("resultado"), offences.alias("infracoes"), F.col("link").alias("link"),
        F.col("reason").alias("motivo"), F.left("operative", F.lit(400)).alias("dispositivo"),
    )
