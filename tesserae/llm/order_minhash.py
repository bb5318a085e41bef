"""Order MinHash fingerprints in DataFrame expressions only (operator 9).

A text's k-mers are its runs of three words (the last two runs are shorter), each numbered by its
occurrence in the text, so repeats count. Every numbered k-mer has one hash, which also deals it to
one of 32 components (one-permutation hashing). A component takes its two least k-mers, puts them
back in text order and hashes the pair: texts agree in a component when the same k-mers stand in the
same order, so the share of agreeing components falls with edit distance. All numbered k-mers are
ranked, whatever a text's length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

COMPONENTS, LEAST = 32, 2
#: Documents in a range of ids, on average at most.
BUCKET_ROWS = 20_000
_LOWEST = -(1 << 63)


def with_components(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add array<struct<bin, hash>>: the filled components of a text in order of their number.

    Equal texts have equal components. Texts without words have none. Each array is a column of its
    own, so that no lambda computes it again for each element.
    """
    c = lambda name: f"__{out}_{name}"
    words, sorted_, again, first, every, least, ordered = map(c, ("words", "sorted", "again", "first", "every", "least", "ordered"))
    at = lambda a, i: F.get(F.col(a), i)
    df = df.withColumn(words, F.array_remove(F.split(F.col(text), "[ \\x09-\\x0D]+"), ""))
    # b: hash of the k-mer; i: its place.
    df = df.withColumn(sorted_, F.sort_array(F.transform(words, lambda x, i: F.struct(F.xxhash64(x, at(words, i + 1), at(words, i + 2)).alias("b"), i.alias("i")))))
    repeats = lambda e, j: (j > 0) & (at(sorted_, j - 1)["b"] == e["b"])
    df = df.withColumn(again, F.filter(sorted_, repeats))
    # Where each repeated k-mer begins among the repeats.
    df = df.withColumn(
        first,
        F.filter(
            F.transform(again, lambda e, j: F.struct(e["b"].alias("b"), j.alias("j"))),
            lambda e: (e["j"] == 0) | (at(again, e["j"] - 1)["b"] != e["b"]),
        ),
    )
    # v: hash of the k-mer with its occurrence number; the first occurrence keeps the k-mer's hash.
    entry = lambda v, e: F.struct(F.pmod(v, F.lit(COMPONENTS)).cast("int").alias("bin"), v.alias("v"), e["i"].alias("i"))
    # By index, as slice copies the whole array each time.
    later = F.flatten(F.transform(first, lambda r, k: F.transform(
        F.sequence(r["j"], F.coalesce(at(first, k + 1)["j"], F.size(again)) - 1), lambda j: entry(F.xxhash64(r["b"], j - r["j"] + 1), at(again, j))
    )))
    df = df.withColumn(again, later)
    df = df.withColumn(every, F.sort_array(F.concat(F.transform(F.filter(sorted_, lambda e, j: ~repeats(e, j)), lambda e: entry(e["b"], e)), F.col(again))))
    two = F.filter(every, lambda e, j: (j < LEAST) | (at(every, j - LEAST)["bin"] != e["bin"]))
    df = df.withColumn(least, F.transform(two, lambda e: F.struct(e["bin"].alias("bin"), e["i"].alias("i"), e["v"].alias("v"))))
    df = df.withColumn(ordered, F.sort_array(least))
    pair = lambda e, j: F.xxhash64(e["v"], F.when(at(ordered, j + 1)["bin"] == e["bin"], at(ordered, j + 1)["v"]))
    df = df.withColumn(
        out,
        F.filter(
            F.transform(ordered, lambda e, j: F.when(
                (j == 0) | (at(ordered, j - 1)["bin"] != e["bin"]), F.struct(e["bin"].alias("bin"), pair(e, j).alias("hash"))
            )),
            lambda e: e.isNotNull(),
        ),
    )
    return df.drop(words, sorted_, again, first, every, least, ordered)


def fingerprint(components: str) -> Column:
    """Text form: number:hash in hex, by one space."""
    return F.array_join(F.transform(components, lambda e: F.concat(F.hex(e["bin"]), F.lit(":"), F.lower(F.hex(e["hash"])))), " ")


def likeness(a: str, b: str) -> Column:
    """Agreeing components over those that either text fills; 1 if neither fills any."""
    bins = lambda x: F.transform(x, lambda e: e["bin"])
    filled = F.size(F.array_union(bins(a), bins(b)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def _below(cuts: str, key: str, n: int, or_equal: bool) -> Column:
    """How many of up to n rising cuts lie below key, by binary search."""
    def step(at: Column, width: Column) -> Column:
        cut = F.get(F.col(cuts), at + width - 1)
        return F.when(cut <= F.col(key) if or_equal else cut < F.col(key), at + width).otherwise(at)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))]), F.lit(0), step)


def ranged(rows: DataFrame, n: int, key: str, tie: str) -> DataFrame:
    """Add __range (0 to n - 1): rows by rising key, and by falling tie under one key.

    The cuts are approximate quantiles of key, in one broadcast row. A key that stands for several
    cuts is split over their ranges by its ties, so a hot key is not one range.
    """
    cuts = rows.agg(F.percentile_approx(key, F.lit(np.arange(1, n) / n), F.lit(max(10_000, 20 * n))).alias("__cuts"))
    rows = rows.join(F.broadcast(cuts), F.lit(True)).withColumn("__low", _below("__cuts", key, n, False)).withColumn("__high", _below("__cuts", key, n, True))
    share = F.col(tie) / F.lit(2.0**64) + 0.5
    return rows.withColumn("__range", F.col("__high") - F.least(F.floor(share * (F.col("__high") - F.col("__low") + 1)).cast("int"), F.col("__high") - F.col("__low"))).drop("__cuts", "__low", "__high")


def with_next(rows: DataFrame, n_rows: int, key: str, tie: str, text: str, components: str) -> DataFrame:
    """Add the components of text, and next_<text>, next_<components>: those of the next row by falling
    key and rising tie; after the last, the first.

    A window runs in each range of keys, and the first row of the next range stands as a sentinel at
    each range's end, so nothing is ordered in one task. Only texts are shuffled; components are
    computed behind the shuffle.
    """
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_rows // BUCKET_ROWS + 1)
    rows = ranged(rows, n, key, tie)
    heads = rows.groupBy("__range").agg(F.max(F.struct(F.col(key).alias("key"), F.bitwise_not(tie).alias("tie"))).alias("h"))
    # One row for each range, ordered together: n of them.
    by_range = Window.orderBy("__range")
    heads = heads.select(
        F.col("__range").alias("r"), F.col("h.key").alias("k"), F.bitwise_not("h.tie").alias("t"),
        F.coalesce(F.lead("__range").over(by_range), F.min("__range").over(Window.partitionBy())).alias("serves"),
    )
    heads = F.broadcast(heads) if n <= 1_000_000 else heads
    firsts = rows.join(heads, (F.col("__range") == F.col("r")) & (F.col(key) == F.col("k")) & (F.col(tie) == F.col("t")))
    firsts = firsts.groupBy("serves").agg(F.first(text).alias(text)).select(F.col("serves").alias("__range"), text, F.lit(1).alias("__sentinel"))
    rows = rows.withColumn("__sentinel", F.lit(0)).unionByName(firsts, allowMissingColumns=True).repartition(n, "__range")
    rows = with_components(rows, text, components)
    w = Window.partitionBy("__range").orderBy("__sentinel", F.col(key).desc(), tie)
    return rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in (text, components)]).where("__sentinel = 0").drop("__range", "__sentinel")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    Null texts count as empty; two texts without words are alike (1), one is unlike any other (0); long
    texts are read whole; repeated ids follow one another in an order fixed by their texts' hashes; null
    ids come last; a lone document is its own next; other columns are ignored; an empty table gives
    an empty table.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LOWEST)).alias("__key"),
        text.alias("text"), F.xxhash64(text).alias("__tie"),
    )
    rows = with_next(rows, rows.count(), "__key", "__tie", "text", "own")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", "own", "next_own", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"))
    rows = with_components(rows, "edited", "other")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("own").alias("fingerprint"),
        fingerprint("other").alias("edited_fingerprint"), likeness("own", "other").alias("near_edited"), likeness("own", "next_own").alias("near_next"),
    )


def op9(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return fingerprints(table(spark, sf_dir, "documents"))
