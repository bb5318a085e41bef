"""Filter interaction audit by multilinear-extension Shapley values (operator 11).

A document's mask tells which filters it fails. Of a part's mask counts the removal polynomial is
formed: multilinear in one variable by filter, its value at a corner of the cube is the number of
documents that the filters set to one remove. A filter's Shapley value is its partial derivative,
integrated along the diagonal with exact rationals; corners give what every order of filters keeps.

Only hashes, ids and masks are shuffled, and only one row of masks by part reaches a worker.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import maybe_broadcast, saved, table

FILTERS = "ABCDE"
SPACE, WORDS_LEAST, DISTINCT_SHARE, CAPITAL_SHARE = r"[\x20\x09-\x0D]+", 200, 50, 3
MARKS = r"[#$%&*|]"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_NUMBERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
AUDIT = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((n, pa.int64()) for n in _NUMBERS)])


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails: few words, few distinct words, many capitals, marks."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    fails = [n < WORDS_LEAST, 100 * distinct < DISTINCT_SHARE * n, 100 * capitals > CAPITAL_SHARE * F.length(text), text.rlike(MARKS)]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n): how many rows of an id and part fail which filters. E is failed by rows
    whose text a smaller id has anywhere in docs.

    The smallest id of each text comes from a partial aggregate by the text's hash; it meets only its
    own rows again, by hash and id, so a text that a third of all rows share is no hot key.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("same"), text_mask(text).alias("mask"),
    )
    rows = saved(rows.groupBy("same", "doc_id", "part", "mask").agg(F.count("*").alias("n")), "masks")
    first = rows.groupBy("same").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["same", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"), "n")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by mask, and those of them that labels marks so."""
    rows = saved(masks(docs), "flagged")
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
        .where("doc_id IS NOT NULL AND (good OR toxic)")
        .groupBy("doc_id").agg(F.max(F.coalesce("good", F.lit(False))).alias("good"), F.max(F.coalesce("toxic", F.lit(False))).alias("toxic"))
    )
    marked = saved(marked, "marked")
    marked = maybe_broadcast(marked, marked.count())
    number = lambda c: F.when(F.col(c), F.col("n")).otherwise(0)
    all_ = rows.select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    some = rows.join(marked, "doc_id").select("part", "mask", F.lit(0).alias("n"), number("good").alias("good"), number("toxic").alias("toxic"))
    return all_.unionByName(some).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


class RemovalPolynomial:
    """Documents that the chosen filters remove, as a multilinear polynomial of a part's mask counts."""

    def __init__(self, counts: dict[int, int], k: int = len(FILTERS)):
        self.k = k
        # A document of mask m is removed by 1 - prod(1 - x_i for i in m): by inclusion and exclusion
        # it adds to the coefficient of every non-empty set within m, with the sign of the set's size.
        self.coefficient = [0] * (1 << k)
        for s in range(1, 1 << k):
            sign = 1 if s.bit_count() % 2 else -1
            self.coefficient[s] = sign * sum(n for m, n in counts.items() if m & s == s)
        self.corner = [sum(c for s, c in enumerate(self.coefficient) if s & at == s) for at in range(1 << k)]

    def derivative(self, i: int) -> dict[int, int]:
        """The partial derivative by the i-th variable: coefficients by set."""
        return {s ^ (1 << i): c for s, c in enumerate(self.coefficient) if s >> i & 1 and c}

    def shapley(self, i: int) -> Fraction:
        """The derivative integrated from 0 to 1 along the diagonal, where a set of size d is t^d."""
        return sum((Fraction(c, s.bit_count() + 1) for s, c in self.derivative(i).items()), Fraction(0))


def _orders(counts: dict[int, tuple[int, int, int]]):
    """A part's rows: order, step, and its numbers."""
    n, good, toxic = (RemovalPolynomial({m: c[j] for m, c in counts.items()}) for j in range(3))
    total, full = sum(c[0] for c in counts.values()), (1 << n.k) - 1
    scaled = [n.shapley(i) * factorial(n.k) for i in range(n.k)]
    for order in permutations(range(n.k)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = n.corner[after] - n.corner[before]
            yield (
                "".join(FILTERS[j] for j in order), step, total - n.corner[after], removed, n.corner[1 << i] - removed,
                n.corner[full] - n.corner[full ^ 1 << i], good.corner[after] - good.corner[before], toxic.corner[after] - toxic.corner[before],
                int(scaled[i]),
            )
            before = after


def _audit(batches):
    for batch in batches:
        for part, held in zip(*(c.to_pylist() for c in batch.columns)):
            rows = [(part, *row) for row in _orders({x["mask"]: (x["n"], x["good"], x["toxic"]) for x in held})]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), AUDIT)], schema=AUDIT)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step: part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley (over all orders, hence whole).

    docs: (doc_id, text, lang); labels: (doc_id, quality, toxic). A part is a lang; null is the empty
    string. Null and empty texts have no words. Rows of one id and text are each other's equals, not
    copies; a null id has no smaller one and is no smaller one, and no label. Of several labels of an
    id the one that marks it counts. Texts are hashed and measured whole; other columns are ignored;
    without documents there is no part and no row.
    """
    by_part = mask_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("held"))
    return by_part.mapInArrow(_audit, "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in _NUMBERS))


def op11(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
