"""Chat formatting by cumulative-snapshot collapse (operator 1).

A chat that is logged after every turn appears as many conversations, each a prefix of the next. The
hash of a turn covers its place, role and text; the xor of a conversation's hashes up to a turn is
its rolling prefix hash there. A conversation whose whole hash is a proper prefix hash of any other
is a snapshot and goes by anti-join; of equal conversations the least id stays. What remains is
rendered turn by turn.

Only ids and hashes are shuffled. A text leaves its task in two cases: its row occurs more than once,
or the conversations that stay are too many to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import BROADCAST_ROWS, maybe_broadcast, saved, table

#: Turns that one window covers; longer conversations are cut into blocks whose xors are chained.
BLOCK_TURNS = 256
#: What stands before the role, between role and text, and after the text.
OPEN, SEP, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, a, b, block): every row with its 128-bit hash and its block. Null
    roles and texts become empty; a null turn stands before all others."""
    plain = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return plain.select(
        "*", F.xxhash64("turn", "role", "text").alias("a"), F.xxhash64("text", "turn", F.lit(1), "role").alias("b"),
        F.floor(F.col("turn") / BLOCK_TURNS).alias("block"),
    )


def distinct_rows(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, block, a, b, n): each row once, as its hash, with how often it occurs."""
    return turns.groupBy("conv_id", "turn", "block", "a", "b").agg(F.count("*").alias("n"))


def prefix_hashes(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, n_turns, p, q): the 128-bit hash of all rows up to each turn, and how many rows
    the turn has; rows: distinct_rows().

    Rows are summed by turn, then by block of turns; only block sums of one conversation meet, so a
    conversation with a third of all rows is spread over its blocks.
    """
    by_turn = rows.groupBy("conv_id", "block", "turn").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.count("*").alias("n_turns"))
    inner = Window.partitionBy("conv_id", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")).select(
        F.col("conv_id").alias("c"), F.col("block").alias("k"),
        F.coalesce(F.bit_xor("a").over(outer), F.lit(0)).alias("base_a"), F.coalesce(F.bit_xor("b").over(outer), F.lit(0)).alias("base_b"),
    )
    rolled = by_turn.select("conv_id", "block", "turn", "n_turns", F.bit_xor("a").over(inner).alias("a"), F.bit_xor("b").over(inner).alias("b"))
    return rolled.join(base, rolled["conv_id"].eqNullSafe(base["c"]) & (rolled["block"] == base["k"])).select(
        "conv_id", "turn", "n_turns", F.col("a").bitwiseXOR(F.col("base_a")).alias("p"), F.col("b").bitwiseXOR(F.col("base_b")).alias("q")
    )


def maximal_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of conversations that prefix no other; the least id of equal ones.

    Prefixes end at a turn's end: rows that share a turn are one turn, so a conversation that holds
    only some of another's rows of a turn is no snapshot of it. The last turn and the number of rows
    of a conversation come from one aggregate over its prefixes.
    """
    rolled = saved(prefix_hashes(rows), "prefixes")
    ends = rolled.groupBy("conv_id").agg(F.max_by(F.struct("p", "q"), "turn").alias("h"), F.sum("n_turns").alias("n_turns"))
    whole = ends.groupBy("h.p", "h.q").agg(F.min("conv_id").alias("conv_id"), F.first("n_turns").alias("n_turns"))
    # Equal conversations hold the hash once each as their end; a proper prefix adds to that.
    known = rolled.groupBy("p", "q").agg(F.count("*").alias("n"))
    closed = ends.groupBy("h.p", "h.q").agg(F.count("*").alias("m"))
    prefixes = known.join(closed, ["p", "q"]).where("n > m").select("p", "q")
    return whole.join(prefixes, ["p", "q"], "left_anti").select("conv_id", "n_turns")


def rendered() -> Column:
    return F.concat(F.lit(OPEN), F.col("role"), F.lit(SEP), F.col("text"), F.lit(CLOSE))


def _of(turns: DataFrame, kept: DataFrame, rows: DataFrame, n_kept: int) -> DataFrame:
    """The turns of the kept conversations. Beyond the broadcast limit they meet by conversation and
    block, so that a long conversation isn't one key."""
    if n_kept <= BROADCAST_ROWS:
        k = F.broadcast(kept.select(F.col("conv_id").alias("c"), "n_turns"))
        return turns.join(k, turns["conv_id"].eqNullSafe(k["c"])).drop("c")
    held = rows.select(F.col("conv_id").alias("c"), F.col("block").alias("k")).distinct()
    held = held.join(kept, held["c"].eqNullSafe(kept["conv_id"])).select("c", "k", "n_turns")
    return turns.join(held, turns["conv_id"].eqNullSafe(held["c"]) & (turns["block"] == held["k"])).drop("c", "k")


def collapse(conversations: DataFrame) -> DataFrame:
    """One row per turn of each maximal conversation: conv_id, turn, n_turns, rendered.

    The turns' renderings in order make up the chat; they stay rows, so no conversation has to fit in
    one task, and texts of any length are only read. Repeated rows count once. A conversation whose id
    is null is one like others. Other columns are ignored; an empty table gives an empty table.
    """
    turns = hashed_turns(conversations)
    rows = saved(distinct_rows(turns), "rows")
    kept = saved(maximal_conversations(rows), "kept")
    out = _of(turns, kept, rows, kept.count())
    columns = ["conv_id", "turn", "n_turns", rendered().alias("rendered")]
    several = rows.where("n > 1").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("a").alias("x"), F.col("b").alias("y"))
    n_several = several.count()
    if n_several == 0:
        return out.select(columns)
    several = maybe_broadcast(several, n_several)
    same = out["conv_id"].eqNullSafe(several["c"]) & (out["turn"] == several["t"]) & (out["a"] == several["x"]) & (out["b"] == several["y"])
    once, more = out.join(several, same, "left_anti"), out.join(several, same, "left_semi")
    return once.select(columns).unionByName(more.select(columns).distinct())


def op1(spark, sf_dir: str) -> DataFrame:
    return collapse(table(spark, sf_dir, "conversations"))
