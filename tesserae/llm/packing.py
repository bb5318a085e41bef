"""Packing documents into fixed windows by best-fit decreasing (operator 7).

A document's ids are cut into full windows, which fill a sequence each; what remains is packed,
longest first, each piece into the open window with the least sufficient room. A segment tree over
room (0..size) counts the open windows below each node, so that window is found in log(size) steps.
Pieces are dealt by a hash to bins of bounded size, each packed alone: the padding of a bin is about
one window, and bins grow in number, not in size, with the input.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import give_back, saved, steps
from .tokens import json_encoder

WINDOW = 2048
#: The id that ends every document.
END = (1).to_bytes(4, "little")
#: Pieces in a bin, on average, at most.
BIN_PIECES = 50_000
#: Equal pieces that are numbered at once.
COPIES = 10_000

PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


class OpenWindows:
    """Open windows by room left; tightest(n) finds the least room of at least n."""

    def __init__(self, size: int):
        self.half = 1 << size.bit_length()
        self.count = [0] * (2 * self.half)
        self.by_room: dict[int, list[int]] = defaultdict(list)

    def _add(self, room: int, by: int) -> None:
        at = room + self.half
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, window: int, room: int) -> None:
        self.by_room[room].append(window)
        self._add(room, 1)

    def tightest(self, n: int) -> int | None:
        at = n + self.half
        while not self.count[at]:  # up to the first ancestor with an open window to the right
            while at & 1:
                at >>= 1
            if at == 0:
                return None
            at += 1
        while at < self.half:  # down, leftmost first
            at *= 2
            if not self.count[at]:
                at += 1
        return at - self.half

    def take(self, room: int) -> int:
        self._add(room, -1)
        return self.by_room[room].pop()


def best_fit_decreasing(lengths: list[int], size: int = WINDOW) -> list[tuple[int, int]]:
    """(window, offset) for each length, in the order given: longest first gives best-fit decreasing."""
    open_, used, out = OpenWindows(size), [], []
    for n in lengths:
        room = open_.tightest(n)
        if room is None:
            window = len(used)
            used.append(0)
            room = size
        else:
            window = open_.take(room)
        out.append((window, used[window]))
        used[window] += n
        if room > n:
            open_.put(window, room - n)
    return out


def _pieces(path: str, pattern: str, size: int):
    def run(batches):
        encoder = json_encoder(path, pattern)
        for keys, texts in steps(batches, owner="tokens"):
            rows: list[tuple] = []
            for key, text in zip(keys, texts):
                ids = encoder.encode(text) + END
                total = len(ids) // 4
                for at in range(0, total, size):
                    n = min(size, total - at)
                    rows.append((key, at, n, zlib.crc32(memoryview(ids)[4 * at : 4 * (at + n)]), total))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5, schema=PIECE)
        encoder.rest()
        give_back("tokens")

    return run


def _pack(n_bins: int, size: int):
    def run(table: pa.Table) -> pa.Table:
        number = table.column("bin")[0].as_py()
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        placed = best_fit_decreasing(table.column("length").to_pylist(), size)
        return (
            table.select(PIECE.names)
            .append_column("sequence_id", pa.array([w * n_bins + number for w, _ in placed], pa.int64()))
            .append_column("offset", pa.array([o for _, o in placed], pa.int64()))
        )

    return run


def pack(docs: DataFrame, path: str, pattern: str, size: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Ids come from the tokenizers file at path (its place on every executor), those of its added tokens
    too where their strings stand in a text; each document ends with id 1. Null texts count as empty: one
    piece of one id. Repeated rows are packed as often as they occur, dealt to bins by their number; pieces
    of one length go by id and start; other columns, of clashing names too, are ignored; an empty table
    gives an empty table. Long texts are encoded whole. Equal tables give equal rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pieces = saved(texts.mapInArrow(_pieces(path, pattern, size), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"), "pieces")
    n_bins = pieces.count() // BIN_PIECES + 1
    # Equal pieces are counted and numbered, so that they spread over the bins the same way each time.
    of = [F.col(c) for c in PIECE.names]
    counted = pieces.groupBy(*of).agg(F.count("*").alias("copies"))
    many = counted.select(*of, "copies", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("copies") - 1).cast("long"), F.lit(COPIES).cast("long"))).alias("from"))
    copies = many.select(*of, F.explode(F.sequence("from", F.least(F.col("from") + COPIES, F.col("copies")) - 1)).alias("copy"))
    dealt = copies.withColumn("bin", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "copy"), F.lit(n_bins)).cast("int"))
    return dealt.groupBy("bin").applyInArrow(_pack(n_bins, size), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op7(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return packed(table(spark, sf_dir, "documents"))
