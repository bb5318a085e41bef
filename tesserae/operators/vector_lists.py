"""Nearest rows through inverted lists: coarse centroids, signed bytes with error bounds, an exact second look.

Centroids are fitted on a bounded sample; every row lies in the list of its nearest centroid. A search
sends each query to the lists whose centroids it likes best. There it meets the rows' bytes, and the
bound on what rounding can change tells which rows may be among the k best; only these are looked at
in full. So within the lists searched the answer is exact, and recall is a matter of probes alone.

Lists are cut into cells of bounded size, so a vector that a third of all rows share is many cells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.stored import stored

#: Rows that centroids are fitted on, lists at most, rows in a cell, and rounds of fitting.
SAMPLE, MAX_LISTS, CELL_ROWS, ROUNDS = 20_000, 4096, 16_384, 8
#: Rows of the sample that the number of probes is judged by.
TRIED = 512
#: Queries that a cell holds at once, and candidates up to which they are broadcast.
QUERIES, BROADCAST_ROWS = 1024, 1_000_000
#: Digits of scores, as in vector.nearest().
DIGITS = 9

_ROWS = "row long, id long, list int, scale double, error double, codes binary, vec array<double>"
_MET = pa.schema([("qid", pa.int64()), ("row", pa.int64()), ("lower", pa.float64()), ("upper", pa.float64())])


def fit(sample: np.ndarray, n_lists: int) -> np.ndarray:
    """Centroids by rounds of assignment and averaging, from rows at even steps of the sample."""
    at = sample[np.linspace(0, len(sample) - 1, n_lists).astype(int)].copy()
    for _ in range(ROUNDS):
        own = nearest_centroid(sample, at)
        held = np.bincount(own, minlength=n_lists)
        for d in range(sample.shape[1]):
            total = np.bincount(own, sample[:, d], n_lists)
            at[:, d] = np.where(held, total / np.maximum(held, 1), at[:, d])
    return at


def nearest_centroid(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids**2).sum(1) / 2
    return np.concatenate([(rows[i : i + 4096] @ centroids.T - half).argmax(1) for i in range(0, len(rows), 4096)]) if len(rows) else np.zeros(0, int)


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)) if len(column) else np.zeros((0, 0))


@dataclass
class VectorLists:
    """rows: as stored by build(); centroids; how many rows each list holds."""

    rows: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray
    sample: np.ndarray

    def probes(self, recall: float = 0.95, k: int = 10) -> int:
        """Lists to search for that share of the k nearest rows, judged by TRIED rows of the sample as
        queries against the sample. Rows nearer than any of the sample lie in likelier lists still."""
        tried = self.sample[:TRIED]
        near = np.argsort(-(tried @ self.sample.T), 1, kind="stable")[:, :k]
        place = np.argsort(np.argsort(-(tried @ self.centroids.T), 1, kind="stable"), 1)
        of = np.take_along_axis(place, nearest_centroid(self.sample, self.centroids)[near], 1)
        return int(np.quantile(of, recall, method="higher")) + 1 if of.size else 1

    def cells(self) -> np.ndarray:
        return self.sizes // CELL_ROWS + 1

    def probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """(qid, vec, list, cell): each query beside the cells of its probes lists."""
        centroids, cells = self.centroids, self.cells()

        def run(batches):
            for batch in batches:
                q = _matrix(batch.column("vec"))
                if not len(q):
                    continue
                for i, best in enumerate(np.argsort(-(q @ centroids.T), 1, kind="stable")[:, :probes]):
                    lists = np.repeat(best, cells[best])
                    cell = np.concatenate([np.arange(n) for n in cells[best]])
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(lists), batch.column("qid")[i].as_py()), pa.int64()), pa.array([q[i]] * len(lists), pa.list_(pa.float64())),
                        pa.array(lists, pa.int32()), pa.array(cell, pa.int32()),
                    ], ["qid", "vec", "list", "cell"])

        return queries.mapInArrow(run, "qid long, vec array<double>, list int, cell int")

    def scanned(self, queries: DataFrame, probes: int) -> DataFrame:
        """(qid, scanned): rows of bytes that each query meets."""
        sizes, centroids = self.sizes, self.centroids
        if not sizes.any():
            return _queries(queries).select("qid", F.lit(0).cast("long").alias("scanned"))

        def run(batches):
            for batch in batches:
                q = _matrix(batch.column("vec"))
                if len(q):
                    best = np.argsort(-(q @ centroids.T), 1, kind="stable")[:, :probes]
                    yield pa.RecordBatch.from_arrays([batch.column("qid"), pa.array(sizes[best].sum(1), pa.int64())], ["qid", "scanned"])

        return _queries(queries).mapInArrow(run, "qid long, scanned long")

    def nearest(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """(qid, id, score, rank): the k rows of the largest dot product in each query's lists, ties to
        the smaller id. queries: (qid, vec), the stated query set; null vectors find nothing."""
        if not self.sizes.any():
            return self.rows.select(F.col("row").alias("qid"), "id", F.col("scale").alias("score"), F.col("list").alias("rank"))
        asked = stored(_queries(queries))
        cell = F.pmod(F.col("row"), F.element_at(F.lit(self.cells().tolist()), F.col("list") + 1)).cast("int")
        left, right = self.probed(asked, probes), self.rows.select("row", "id", "list", cell.alias("cell"), "scale", "error", "codes")
        met = left.groupBy("list", "cell").cogroup(right.groupBy("list", "cell")).applyInArrow(_met(k), "qid long, row long, lower double, upper double")
        met = stored(met)
        order = Window.partitionBy("qid").orderBy(F.col("lower").desc(), "row")
        least = met.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("qid", F.col("lower").alias("least"))
        close = stored(met.join(least, "qid", "left").where(F.col("least").isNull() | (F.col("upper") >= F.col("least"))).select("qid", "row"))
        n = close.count()
        looked = self.rows.select("row", "id", F.col("vec").alias("held")).join(F.broadcast(close) if n <= BROADCAST_ROWS else close, "row")
        dot = F.aggregate(F.zip_with("held", "vec", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        scores = looked.join(asked, "qid").select("qid", "id", F.round(dot, DIGITS).alias("score"))
        best = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
        return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _queries(queries: DataFrame) -> DataFrame:
    return queries.select(F.col("qid").cast("long").alias("qid"), F.col("vec").cast("array<double>").alias("vec")).where("vec is not null")


def _met(k: int):
    """Rows of a cell that may be among a query's k best, with bounds on their scores."""
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return _MET.empty_table()
        codes = np.stack([np.frombuffer(x, np.int8) for x in rows.column("codes").to_pylist()]).astype(np.float64)
        held = codes * rows.column("scale").to_numpy()[:, None]
        error, row = rows.column("error").to_numpy(), rows.column("row").to_numpy()
        out = []
        for at in range(0, queries.num_rows, QUERIES):
            part = queries.slice(at, QUERIES)
            q = _matrix(part.column("vec").combine_chunks())
            near = q @ held.T
            off = np.linalg.norm(q, axis=1)[:, None] * error[None] + 10.0**-DIGITS
            lower, upper = near - off, near + off
            floor = -np.partition(-lower, k - 1, 1)[:, k - 1] if near.shape[1] > k else np.full(len(q), -np.inf)
            i, j = np.nonzero(upper >= floor[:, None])
            out.append(pa.table([part.column("qid").to_numpy()[i], row[j], lower[i, j], upper[i, j]], schema=_MET))
        return pa.concat_tables(out)

    return run


def build(docs: DataFrame, n_lists: int | None = None) -> VectorLists:
    """Lists over docs (id, vec); rows of null vectors are in none. Repeated ids are rows of their own.

    The sample, at most SAMPLE rows by a hash of their ids, is all that comes to the driver, beside one
    number by list. All vectors have one length.
    """
    rows = docs.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).where("vec is not null")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    sample = [r["vec"] for r in rows.orderBy(F.xxhash64("id", "row")).limit(SAMPLE).select("vec").collect()]
    if not sample:
        return VectorLists(docs.sparkSession.createDataFrame([], _ROWS), np.zeros((1, 1)), np.zeros(1, int), np.zeros((0, 1)))
    wanted = n_lists or int(rows.count() ** 0.5)
    sample = np.array(sample)
    centroids = fit(sample, max(1, min(MAX_LISTS, len(sample), wanted)))

    def assign(batches):
        for batch in batches:
            x = _matrix(batch.column("vec"))
            if len(x):
                scale = np.maximum(np.abs(x).max(1), 1e-300) / 127
                codes = np.rint(x / scale[:, None]).astype(np.int8)
                error = np.linalg.norm(x - codes * scale[:, None], axis=1)
                yield pa.RecordBatch.from_arrays([
                    batch.column("row"), batch.column("id"), pa.array(nearest_centroid(x, centroids), pa.int32()), pa.array(scale), pa.array(error),
                    pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("vec"),
                ], ["row", "id", "list", "scale", "error", "codes", "vec"])

    held = stored(rows.select("row", "id", "vec").mapInArrow(assign, _ROWS).repartition("list", F.pmod("row", F.lit(64))).sortWithinPartitions("list"))
    sizes = np.zeros(len(centroids), int)
    for r in held.groupBy("list").agg(F.count("*").alias("n")).collect():
        sizes[r["list"]] = r["n"]
    return VectorLists(held, centroids, sizes, sample)
