"""Conversation prefix trie by Patricia construction (operator 13).

Conversations that share their first turns share the nodes of those turns. A rolling hash of the
turns so far names a node; a partial aggregate over all of them counts its members. Nodes with one
child where no conversation ends are unary: they and the branch, end or leaf point below have the
same members, so their smallest member and number name the compressed edge. Conversations are sorted
by the points that they pass, which puts every subtree's members side by side; a point's aggregate
is then a difference of running sums along that order. Unary nodes get theirs from the point
below and the suffix sums of their edge.

Texts are read once; hashes, ids and sizes are shuffled. Long conversations and edges are cut into
blocks whose sums are chained, and conversations that are equal are spread by their ids.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import saved, table

#: A conversation starts with up to HEADS - 1 turns of the first of its block of BLOCK ids.
HEADS, BLOCK = 6, 100
#: Depths that one window covers, and ids that are joined into one string.
DEPTHS, IDS = 1024, 4096

NODE = ["d", "p", "q"]
_UP_TO = (Window.unboundedPreceding, Window.currentRow)
_BEFORE = (Window.unboundedPreceding, -1)
_EMPTY = hashlib.sha256().hexdigest()
ENDS = pa.schema([("d", pa.int64()), ("p", pa.int64()), ("q", pa.int64()), ("ends_sha256", pa.string())])


def _partition(at: str | Column) -> Column:
    """The sorted partition of a row that monotonically_increasing_id() numbered."""
    return F.shiftright(at, 33)


def _added(sums: DataFrame, keys: list[str], block: str, columns: list[str]) -> DataFrame:
    """What all blocks before each block add up to."""
    w = Window.partitionBy(*keys).orderBy(block).rowsBetween(*_BEFORE)
    return sums.select(*keys, block, *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_before") for c in columns))


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, depth, same, size) and conversations (conv_id, base, n_head, n_turns).

    pos counts a conversation's own turns from 1; depth is their place in the rebuilt one, null for
    those that it replaces; n_turns counts the rebuilt turns, n_head those from conversation base.
    Rows are sorted by range, so that a conversation that holds a third of them lies in many tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("same"),
        F.length(text).cast("long").alias("size"), F.monotonically_increasing_id().alias("row"),
    )
    key = ["conv_id", "turn", "same", "row"]
    ordered = saved(rows.repartitionByRange(*key).sortWithinPartitions(*key).select("conv_id", "same", "size", F.monotonically_increasing_id().alias("at")), "ordered")
    runs = ordered.groupBy("conv_id", _partition("at").alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    runs = runs.join(_added(runs, ["conv_id"], "part", ["n"]), ["conv_id", "part"])
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    own = saved(runs.groupBy("conv_id").agg(F.sum("n").alias("n")).select("conv_id", "n", heads.alias("h"), (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base")), "own")
    of_base = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    n_head = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = saved(own.join(of_base, "base", "left").select("conv_id", "base", "h", n_head.alias("n_head"), (n_head + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")), "convs")
    pos = F.col("at") - F.col("first") + F.col("n_before") + 1
    places = runs.select("conv_id", F.col("part").alias("in_part"), "first", "n_before").join(convs.select("conv_id", "h", "n_head"), "conv_id").withColumnRenamed("conv_id", "c")
    turns = ordered.join(places, (ordered["conv_id"] == places["c"]) & (_partition("at") == places["in_part"]))
    turns = turns.select("conv_id", pos.alias("pos"), F.when(pos > F.col("h"), pos - F.col("h") + F.col("n_head")).alias("depth"), "same", "size")
    return saved(turns, "turns"), convs


def paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, d, p, q, up_p, up_q, size): a row for every turn of every rebuilt conversation, with
    the 128-bit hash of the turns up to it and up to the one before."""
    heads = turns.where(f"pos < {HEADS}").select(F.col("conv_id").alias("base"), F.col("pos").alias("d"), "same", "size")
    heads = convs.where("n_head > 0").select("conv_id", "base", "n_head").join(heads, "base").where("d <= n_head")
    rows = turns.where("depth IS NOT NULL").select("conv_id", F.col("depth").alias("d"), "same", "size").unionByName(heads.select("conv_id", "d", "same", "size"))
    rows = saved(rows.select("conv_id", "d", "size", F.xxhash64("d", "same").alias("a"), F.xxhash64("same", "d").alias("b"), F.floor(F.col("d") / DEPTHS).alias("block")), "rebuilt")
    inner = Window.partitionBy("conv_id", "block").orderBy("d").rowsBetween(*_UP_TO)
    outer = Window.partitionBy("conv_id").orderBy("block").rowsBetween(*_BEFORE)
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    blocks = blocks.select("conv_id", "block", *(F.coalesce(F.bit_xor(c).over(outer), F.lit(0)).alias(f"{c}_before") for c in "ab"))
    rolled = rows.withColumns({"p": F.bit_xor("a").over(inner), "q": F.bit_xor("b").over(inner)}).join(blocks, ["conv_id", "block"])
    p, q = F.col("p").bitwiseXOR(F.col("a_before")), F.col("q").bitwiseXOR(F.col("b_before"))
    return saved(rolled.select("conv_id", "d", p.alias("p"), q.alias("q"), p.bitwiseXOR(F.col("a")).alias("up_p"), q.bitwiseXOR(F.col("b")).alias("up_q"), "size"), "paths")


def nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(d, p, q, conv_id, n, weight, up_p, up_q): every node with its members counted, and what sharing
    its last text saves."""
    found = rows.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("up_p").alias("up_p"), F.first("up_q").alias("up_q"),
    )
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).where("n > 0").select(
        *(F.lit(0).cast("long").alias(c) for c in NODE), "conv_id", "n", *(F.lit(0).cast("long").alias(c) for c in ("size", "up_p", "up_q")),
    )
    return saved(found.unionByName(root).withColumn("weight", (F.col("n") - 1) * F.col("size")), "nodes")


def edges(tree: DataFrame) -> DataFrame:
    """(conv_id, n, top, d, p, q, up_p, up_q, weight, n_children): compressed edges, from the depth
    top down to the point (d, p, q); up is the point above."""
    held = tree.groupBy("conv_id", "n").agg(
        F.min("d").alias("top"), F.max(F.struct(*NODE)).alias("point"), F.min(F.struct("d", "up_p", "up_q")).alias("up"), F.sum("weight").alias("weight"),
    ).select("conv_id", "n", "top", "point.*", "up.up_p", "up.up_q", "weight")
    held = saved(held, "edges")
    children = held.where("top > 0").groupBy((F.col("top") - 1).alias("d"), F.col("up_p").alias("p"), F.col("up_q").alias("q")).agg(F.count("*").alias("n_children"))
    return saved(held.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "points")


def sorted_conversations(rows: DataFrame, points: DataFrame, convs: DataFrame) -> DataFrame:
    """(at, conv_id, path): conversations in the order of the points that they pass, then of their ids."""
    passed = rows.join(points.select(*NODE), NODE).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*NODE))).alias("path"))
    root = F.struct(*(F.lit(0).cast("long").alias(c) for c in NODE))
    path = F.concat(F.array(root), F.coalesce("path", F.array().cast("array<struct<d:bigint,p:bigint,q:bigint>>")))
    named = convs.select("conv_id").join(passed, "conv_id", "left").select("conv_id", path.alias("path"))
    return saved(named.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").select(F.monotonically_increasing_id().alias("at"), "conv_id", "path"), "sorted")


def totals(points: DataFrame, order: DataFrame) -> DataFrame:
    """Adds n_leaves and saved, sums over each edge and all below it.

    A point belongs to the first conversation, in order, that passes it. Those of its subtree lie from
    that one to the last that passes it; of the first one's own points only those further down count.
    """
    spans = order.select("at", F.inline("path")).groupBy(*NODE).agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    placed = saved(points.join(spans, NODE).withColumn("leaf", (F.col("n_children") == 0).cast("long")), "placed")
    owned = placed.groupBy(F.col("lo").alias("at")).agg(F.sum("weight").alias("weight"), F.sum("leaf").alias("leaf"))
    along = order.select("at").join(owned, "at", "left").select("at", _partition("at").alias("part"), F.coalesce("weight", F.lit(0)).alias("weight"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    parts = along.groupBy("part").agg(F.sum("weight").alias("weight"), F.sum("leaf").alias("leaf")).withColumn("one", F.lit(1))
    w = Window.partitionBy("part").orderBy("at").rowsBetween(*_UP_TO)
    running = along.withColumns({c: F.sum(c).over(w) for c in ("weight", "leaf")}).join(_added(parts, ["one"], "part", ["weight", "leaf"]).drop("one"), "part")
    running = saved(running.select("at", (F.col("weight") + F.col("weight_before")).alias("w"), (F.col("leaf") + F.col("leaf_before")).alias("l")), "running")
    lower = Window.partitionBy("lo").orderBy(F.col("d").desc()).rowsBetween(*_UP_TO)
    first, last = (running.select(F.col("at").alias(c), F.col("w").alias(f"w_{c}"), F.col("l").alias(f"l_{c}")) for c in ("lo", "hi"))
    out = placed.withColumns({"own_w": F.sum("weight").over(lower), "own_l": F.sum("leaf").over(lower)}).join(first, "lo").join(last, "hi")
    return out.select(*points.columns, (F.col("l_hi") - F.col("l_lo") + F.col("own_l")).alias("n_leaves"), (F.col("w_hi") - F.col("w_lo") + F.col("own_w")).alias("saved"))


def _hashed(batches):
    """The hash of each node's chunks of ids, which come in order; only one node's state is held."""
    key, digest = None, None
    for batch in batches:
        out = []
        for d, p, q, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
            if (d, p, q) != key:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = (d, p, q), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ENDS)], schema=ENDS)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*key, digest.hexdigest()), ENDS)], schema=ENDS)


def ends(order: DataFrame) -> DataFrame:
    """(d, p, q, ends_sha256) of nodes where conversations end. Equal conversations lie side by side by
    ascending ids, so blocks of rows give strings of bounded length and a node hashes few of them."""
    last = F.element_at("path", -1)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = order.select(last.alias("end"), "conv_id", "at").groupBy("end", F.floor(F.col("at") / IDS).alias("chunk")).agg(ids.alias("ids"))
    chunks = chunks.select("end.*", "chunk", "ids").repartition(*NODE).sortWithinPartitions(*NODE, "chunk")
    return chunks.mapInArrow(_hashed, "d long, p long, q long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns go by number, a null number first; rows of one number by the SHA-256 of role and text, each
    a turn of its own, repeated rows too. Null roles and texts are empty; rows without a conv_id are no
    conversation's. Texts of any length are hashed and counted whole; other columns are ignored.
    Without conversations there is no node.
    """
    turns, convs = numbered(conversations)
    rows = paths(turns, convs)
    tree = nodes(rows, convs)
    points = edges(tree)
    order = sorted_conversations(rows, points, convs)
    summed = totals(points, order)
    above = points.select((F.col("d") + 1).alias("top"), F.col("p").alias("up_p"), F.col("q").alias("up_q"), F.col("conv_id").alias("above"))
    edge = summed.join(above, ["top", "up_p", "up_q"], "left").select(
        F.col("conv_id").alias("e_conv"), F.col("n").alias("e_n"), "top", F.col("d").alias("bottom"), "n_children", "n_leaves", "above", (F.col("saved") - F.col("weight")).alias("below"),
    )
    blocked = tree.withColumn("block", -F.floor(F.col("d") / DEPTHS))
    sums = blocked.groupBy("conv_id", "n", "block").agg(F.sum("weight").alias("weight"))
    inner = Window.partitionBy("conv_id", "n", "block").orderBy(F.col("d").desc()).rowsBetween(*_UP_TO)
    suffix = blocked.withColumn("suffix", F.sum("weight").over(inner)).join(_added(sums, ["conv_id", "n"], "block", ["weight"]), ["conv_id", "n", "block"])
    full = suffix.join(edge, (F.col("conv_id") == F.col("e_conv")) & (F.col("n") == F.col("e_n"))).join(ends(order), NODE, "left")
    return full.select(
        "conv_id", F.col("d").alias("depth"),
        F.when(F.col("d") == 0, None).when(F.col("d") == F.col("top"), F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(F.col("d") == F.col("bottom"), F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        F.col("n_leaves").cast("long").alias("n_leaves"), (F.col("below") + F.col("suffix") + F.col("weight_before")).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )


def op13(spark, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))
