"""A stored BM25 index in segments: packed postings, partitioned by a hash of their term.

A posting row holds one term in one block of neighbouring ids: the ids with their counts and lengths,
and the largest count and least length, which bound every weight in the block whatever the averages
become. A search reads its terms' buckets only, and a top-k search first reads the bounds alone and
opens just the blocks that can reach the k-th best score.

Segments hold counts, not weights, so a change adds a segment: new postings, or ids that are gone with
what they take from the frequencies. Frequencies and totals are summed on reading. A version file names
the live segments; it is written last and never overwritten, so a reader sees a whole index or the one
before. Compaction writes one segment in place of all.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources import versions
from ..sources.stored import folder, reclaim
from .index import LEAST_AVERAGE, Index, idf, weight

#: Parts by term; ids in a block; documents for which a bucket is one file; blocks that a task counts.
BUCKETS, BLOCK, SPLIT_DOCS, TASK_BLOCKS = 32, 512, 131_072, 16
#: Posted for every document, so that one pass also lists those without terms; no term is empty.
EVERY = ""


def by_id(c: Column) -> Column:
    """Blocks of neighbouring ids, for dense long ids."""
    return F.floor(c / BLOCK)


def by_owner(c: Column) -> Column:
    """Blocks of passages (id, pos): those of neighbouring items."""
    return F.floor(c["id"] / BLOCK)


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _rows(block: int, term: pa.Array, ids: pa.Array, tf: np.ndarray, length: np.ndarray, starts: np.ndarray) -> pa.Table:
    """Packed rows of postings that lie one after another; starts: where each term's begin."""
    offsets = pa.array(np.r_[starts, len(tf)].astype(np.int32))
    if pa.types.is_struct(ids.type):  # fields that can't be null here may be so in the packed rows' type
        ids = pa.StructArray.from_arrays(ids.flatten(), names=[f.name for f in ids.type])
    listed = lambda x: pa.ListArray.from_arrays(offsets, x)
    return pa.table({
        "block": pa.array(np.full(len(starts), block), pa.int64()), "term": term, "n": pa.array(np.diff(np.r_[starts, len(tf)]), pa.int64()),
        "max_tf": pa.array(np.maximum.reduceat(tf, starts), pa.int32()), "min_len": pa.array(np.minimum.reduceat(length, starts), pa.int32()),
        "ids": listed(ids), "tfs": listed(pa.array(tf, pa.int32())), "lens": listed(pa.array(length, pa.int32())),
    })


def _counted(rows: pa.Table) -> pa.Table:
    """Packed rows of one block of documents (block, id, terms)."""
    if pa.types.is_integer(rows.schema.field("id").type):
        rows = rows.sort_by("id")  # neighbours' files compress better; other ids stay as they come
    ids, lists, n = rows.column("id").combine_chunks(), rows.column("terms").combine_chunks(), rows.num_rows
    length = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten().dictionary_encode()
    # EVERY comes first, once for each document.
    code = np.r_[np.zeros(n, np.int64), words.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1]
    key, tf = np.unique(code * n + np.r_[np.arange(n), np.repeat(np.arange(n), length)], return_counts=True)
    code, doc = key // n, key % n
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    names = pa.concat_arrays([pa.array([EVERY], words.dictionary.type), words.dictionary])
    return _rows(rows.column("block")[0].as_py(), names.take(pa.array(code[starts])), ids.take(pa.array(doc)), tf, length[doc], starts)


def _merged(rows: pa.Table) -> pa.Table:
    """Packed rows of one block of postings (block, term, id, len, tf)."""
    words = rows.column("term").combine_chunks().dictionary_encode()
    order = np.argsort(words.indices.to_numpy(zero_copy_only=False), kind="stable")
    rows, code = rows.take(pa.array(order)), words.indices.to_numpy(zero_copy_only=False)[order]
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    number = lambda c: rows.column(c).to_numpy().astype(np.int64)
    return _rows(rows.column("block")[0].as_py(), words.dictionary.take(pa.array(code[starts])), rows.column("id").combine_chunks(), number("tf"), number("len"), starts)


def unpacked(rows: DataFrame, *columns: str) -> DataFrame:
    """(columns, id, tf, len): a row for each id of packed postings."""
    zipped = F.explode(F.arrays_zip("ids", "tfs", "lens")).alias("e")
    return rows.select(*columns, zipped).select(*columns, F.col("e.ids").alias("id"), F.col("e.tfs").alias("tf"), F.col("e.lens").alias("len"))


class Segments:
    """An index under root, which executors share. Ids are of any type that block can deal."""

    def __init__(self, spark: SparkSession, root: str, block: Callable[[Column], Column] = by_id, buckets: int = BUCKETS):
        self.spark, self.root, self.block = spark, root.rstrip("/"), block
        self.number, held = versions.latest(spark, self.root)
        self.buckets = held.get("buckets", buckets)
        self.live: list[dict] = held.get("segments", [])

    def _commit(self, segments: list[dict]) -> None:
        """The next version after the one that was read; an error if another writer wrote that."""
        versions.commit(self.spark, self.root, self.number + 1, {"buckets": self.buckets, "segments": segments})
        self.number, self.live = self.number + 1, segments

    # ------------------------------------------------------------ changes

    def add(self, items: DataFrame, id_col: str = "id", terms: Column | str = "terms") -> Segments:
        """A segment for items (id, terms array), whose ids the index doesn't hold or has removed. terms may be
        an expression of other columns: then these are shuffled, as texts are smaller than their terms.

        Documents without terms, or with null ones, count; ids are unique, so a block is bounded. Rows are
        dealt by block once; a block is counted and packed by itself, and a term of
        all documents is spread over its blocks' files.
        """
        words = F.coalesce(F.col(terms) if isinstance(terms, str) else terms, F.array().cast("array<string>"))
        block = self.block(F.col(id_col))
        n_blocks = items.agg(F.approx_count_distinct(block).alias("n")).first()["n"]
        rows = items.withColumn("block", block).repartition(n_blocks // TASK_BLOCKS + 1, "block").select("block", F.col(id_col).alias("id"), words.alias("terms"))
        self._commit([*self.live, self._write(f"add-{uuid.uuid4().hex}", rows, _counted, n_blocks)])
        reclaim(self.spark)
        return self

    def _write(self, name: str, rows: DataFrame, pack: Callable[[pa.Table], pa.Table], n_blocks: int) -> dict:
        """Writes a segment from rows of blocks, a block of bounded size at once; gives its entry in a version.

        A file holds a bucket's terms in some blocks, and there are as many tasks as files: what a task sorts
        doesn't grow with the index, so that it isn't spilled.
        """
        own = rows.schema["id"].dataType.simpleString()
        packed = rows.groupBy("block").applyInArrow(pack, f"block long, term string, n long, max_tf int, min_len int, ids array<{own}>, tfs array<int>, lens array<int>")
        packed = packed.withColumn("bucket", bucket(F.col("term"), self.buckets))
        split = F.floor(F.col("block") * BLOCK / SPLIT_DOCS)
        packed.repartition(self.buckets * (n_blocks * BLOCK // SPLIT_DOCS + 1), "bucket", split).sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{self.root}/{name}/postings")
        held = self.spark.read.schema(packed.schema).parquet(f"{self.root}/{name}/postings")
        held.where(F.col("term") != EVERY).groupBy("bucket", "term").agg(F.sum("n").alias("df")).repartition("bucket").sortWithinPartitions("term").write.parquet(f"{self.root}/{name}/terms")
        listed = held.where((F.col("term") == EVERY) & (F.col("bucket") == bucket(F.lit(EVERY), self.buckets)))
        return {"name": name, **_totals(unpacked(listed))}

    def remove(self, ids: DataFrame, id_col: str = "id") -> Segments:
        """A segment of ids that are gone: what they take from frequencies and totals. Unknown ids take nothing."""
        gone = ids.select(F.col(id_col).alias("id")).distinct()
        name = f"remove-{uuid.uuid4().hex}"
        mine = self._entries().where(F.col("term") != EVERY).join(gone, "id", "left_semi")
        mine.groupBy("bucket", "term").agg((-F.count("*")).alias("df")).write.parquet(f"{self.root}/{name}/terms")
        self.documents().join(gone, "id", "left_semi").write.parquet(f"{self.root}/{name}/ids")
        totals = _totals(self.spark.read.parquet(f"{self.root}/{name}/ids"))
        self._commit([*self.live, {"name": name, "gone": True, **{k: -v for k, v in totals.items()}}])
        return self

    def compact(self) -> Segments:
        """One segment in place of all. The old ones stay for their readers until vacuum()."""
        n_blocks = self.postings().agg(F.approx_count_distinct("block").alias("n")).first()["n"]
        rows = self._entries().select("block", "term", "id", "len", "tf").repartition(n_blocks // TASK_BLOCKS + 1, "block")
        self._commit([self._write(f"add-{uuid.uuid4().hex}", rows, _merged, n_blocks)])
        reclaim(self.spark)
        return self

    def vacuum(self) -> None:
        """Delete segments that the last version doesn't name."""
        kept = {s["name"] for s in self.live} | {"versions"}
        for name in versions.names(self.spark, self.root):
            if name not in kept:
                versions.delete(self.spark, f"{self.root}/{name}")

    # ------------------------------------------------------------ reading

    def totals(self) -> tuple[int, int]:
        """Documents and terms in all, kept in the version."""
        return sum(s["n_docs"] for s in self.live), sum(s["total"] for s in self.live)

    def postings(self, buckets: list[int] | None = None) -> DataFrame:
        """(seg, bucket, term, block, n, max_tf, min_len, ids, tfs, lens) of all segments, or of some buckets."""
        parts = [
            self.spark.read.parquet(f"{self.root}/{s['name']}/postings").withColumn("seg", F.lit(i))
            for i, s in enumerate(self.live) if not s.get("gone") and s["n_docs"]
        ]
        out = parts[0] if parts else self.spark.createDataFrame([], "block long, term string, n long, max_tf int, min_len int, ids array<long>, tfs array<int>, lens array<int>, bucket int, seg int")
        for p in parts[1:]:
            out = out.unionByName(p)
        return out if buckets is None else out.where(F.col("bucket").isin(buckets))

    def gone(self) -> DataFrame | None:
        """(id, until): removed ids, for segments before until."""
        parts = [self.spark.read.parquet(f"{self.root}/{s['name']}/ids").withColumn("until", F.lit(i)) for i, s in enumerate(self.live) if s.get("gone")]
        out = parts[0] if parts else None
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.groupBy("id").agg(F.max("until").alias("until")) if out is not None else None

    def alive(self, rows: DataFrame) -> DataFrame:
        """Rows (seg, id, ...) without those whose id was removed after its segment."""
        gone = self.gone()
        if gone is None:
            return rows
        gone = gone.withColumnRenamed("id", "gone_id")
        return rows.join(gone, (rows["id"] == gone["gone_id"]) & (rows["seg"] < gone["until"]), "left_anti")

    def _entries(self, buckets: list[int] | None = None) -> DataFrame:
        return self.alive(unpacked(self.postings(buckets), "seg", "bucket", "block", "term"))

    def documents(self) -> DataFrame:
        """(id, len) of the documents in the index."""
        every = F.lit(EVERY)
        return self._entries([self.spark.range(1).select(bucket(every, self.buckets)).first()[0]]).where(F.col("term") == every).select("id", "len")

    def index(self) -> Index:
        """postings, terms and stats as index.build() gives them, and the segments to search by blocks."""
        n_docs, total = self.totals()
        average = max(total / n_docs, LEAST_AVERAGE) if n_docs else LEAST_AVERAGE
        stats = self.spark.range(1).select(F.lit(n_docs).cast("long").alias("n_docs"), F.lit(average).alias("avg_len"))
        parts = [self.spark.read.parquet(f"{self.root}/{s['name']}/terms") for s in self.live]
        held = parts[0] if parts else self.spark.createDataFrame([], "bucket int, term string, df long")
        for p in parts[1:]:
            held = held.unionByName(p)
        if len(parts) > 1:
            held = held.groupBy("bucket", "term").agg(F.sum("df").alias("df")).where("df > 0")
        terms = held.select("term", "df", idf(F.lit(n_docs), F.col("df")).alias("idf"))
        entries = self._entries().where(F.col("term") != EVERY).join(terms, "term")
        postings = entries.select("term", "id", weight(F.col("tf"), F.col("len"), F.lit(average), F.col("idf")).alias("weight"))
        return Index(postings, terms, stats, self, average)


def _totals(documents: DataFrame) -> dict[str, int]:
    """Documents and their terms."""
    return documents.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.col("len").cast("long")), F.lit(0)).alias("total")).first().asDict()


def build_stored(items: DataFrame, root: str | None = None, terms: Column | str = "terms", **options) -> Index:
    """items (id, terms) as a new stored index of one segment; without a root, in a folder of the present owner."""
    return Segments(items.sparkSession, root or folder(items.sparkSession, "index"), **options).add(items, terms=terms).index()
