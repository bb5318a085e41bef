"""Shared helpers: whole-text Arrow iteration, word hashing, scratch tables, size-checked joins.

Words are maximal runs outside space, \\t, \\n, \\v, \\f and \\r, which is exactly how
``bytes.split()`` cuts, so texts travel as binary and are never decoded for word work.
"""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows up to which a side of a join may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Texts that one step of a Python worker holds as Python objects.
STEP_ROWS = 256

_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text binary); a null text becomes the empty text, other columns are left out."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"),
    )


def steps(batches, rows: int = STEP_ROWS, owner: str = ""):
    """Lists of the columns of a few rows at a time, so long texts don't pile up as objects. owner: whose
    memory the worker keeps at the end, as its next task may be of the same kind."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield [c.to_pylist() for c in part.columns]
    give_back(owner)


#: What workers remember between tasks, by owner: a function that forgets it.
_REMEMBERED: dict[str, Callable[[], None]] = {}


def remembers(owner: str, forget: Callable[[], None]) -> None:
    _REMEMBERED[owner] = forget


def give_back(owner: str = "") -> None:
    """Forget what other operators' tasks remembered in this worker, and return freed memory to the
    system, so that a worker that waits for its next task holds little."""
    for name, forget in _REMEMBERED.items():
        if name != owner:
            forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64) on an array, wrapping."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Bytes of text that are hashed at once, and the length from which a word is hashed by itself.
HASH_BYTES, LONG_WORD = 1 << 19, 32
_SPACES = bytes([0x20, *range(0x09, 0x0E)])
_IS_WORD = np.array([b not in _SPACES for b in range(256)])
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_LOWERED = _BYTE[np.frombuffer(bytes(range(256)).lower(), np.uint8)]


def _word_hashes(data: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of data: a wrapping polynomial over its bytes by prefix sums,
    mixed with its length. Long words take a hash of their own, as polynomials of long strings with
    a structure can agree."""
    b = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = _IS_WORD[b]
    turn = np.diff(inside)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    power, inverse = _powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((_LOWERED if lower else _BYTE)[b] * power[: len(b)], out=total[1:])
    length = (end - start).astype(np.uint64)
    h = mix((total[end] - total[start]) * inverse[start] + length * _U(_BASE))
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        word = data[start[i] : end[i]]
        h[i] = xxhash.xxh64_intdigest(word.lower() if lower else word, LONG_WORD)
    return h, start


def _pieces(text: bytes):
    """A text in parts of about HASH_BYTES, cut at white space."""
    at = 0
    while len(text) - at > HASH_BYTES:
        end = at + HASH_BYTES
        while end < len(text) and text[end] not in _SPACES:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def word_hashes(texts: list[bytes], lower: bool = False) -> list[np.ndarray]:
    """64-bit hashes of each text's words in order; with lower, A-Z count as a-z.

    Texts are hashed many at a time in numpy, so no dictionary of words is kept.
    """
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0

    def flush():
        if held:
            h, start = _word_hashes(b"\n".join(held), lower)
            ends = np.cumsum([len(t) + 1 for t in held])
            out.extend(np.split(h, np.searchsorted(start, ends[:-1])))
            held.clear()

    for text in texts:
        if len(text) > HASH_BYTES:
            flush()
            size = 0
            out.append(np.concatenate([_word_hashes(x, lower)[0] for x in _pieces(text)]))
            continue
        held.append(text)
        size += len(text)
        if size > HASH_BYTES:
            flush()
            size = 0
    flush()
    return out


#: Odd multipliers by position; a window's hash is the mixed wrapped sum of its words' products.
_ODD = [int(v) for v in mix(np.arange(1, 65, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)]


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    s = h[:n] * _U(_ODD[0])
    for j in range(1, k):
        s += h[j : j + n] * _U(_ODD[j])
    return mix(s)


_BASE = 0x9E3779B97F4A7C15 | 1


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse, at least n of each."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 15)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS


def arrow(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


# ---------------------------------------------------------------- scratch tables

#: Lists of scratch tables, the innermost owner last. The first belongs to the process.
_OWNERS: list[list[tuple[SparkSession, str]]] = [[]]


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir, else the context's checkpoint
    folder. Only a local master gets a folder of our own; a cluster without one is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        given = context._jsc.sc().getCheckpointDir()
        if given.isDefined():
            return given.get().rstrip("/")
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir("file:///tmp/checkpoints")
        root = context._jsc.sc().getCheckpointDir().get()
    return root.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tesserae-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    own_later(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def own_later(spark: SparkSession, path: str) -> None:
    """Have the folder above path deleted when its owner ends."""
    _OWNERS[-1].append((spark, path))


def discard(*tables: DataFrame) -> None:
    """Delete saved tables that nothing still to be computed reads."""
    for t in tables:
        for owner in _OWNERS:
            if (t.sparkSession, t.scratch_path) in owner:
                owner.remove((t.sparkSession, t.scratch_path))
                _delete(t.sparkSession, t.scratch_path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path).getParent()
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def owned():
    """Tables saved inside are deleted at the end, those of other calls are not: results that read
    them must have been written by then."""
    _OWNERS.append([])
    try:
        yield
    finally:
        for spark, path in _OWNERS.pop():
            _delete(spark, path)


def _at_exit() -> None:
    for owner in _OWNERS:
        for spark, path in owner:
            if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
                _delete(spark, path)


atexit.register(_at_exit)


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast df only if its counted rows are few; otherwise Spark shuffles both sides."""
    return F.broadcast(df) if rows <= limit else df


#: Bytes of text that a bucket's share of the input stands for, and buckets at most: a packed row for
#: each bucket has to stay worth its overhead.
BUCKET_BYTES, MAX_BUCKETS = 16 << 20, 1 << 16


def text_bytes(rows: DataFrame) -> int:
    return rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first()["n"]


def buckets(rows: DataFrame, each: int = BUCKET_BYTES) -> int:
    """Buckets for a table with a text column, from its bytes; one for each shuffle partition at least."""
    by_bytes = min(MAX_BUCKETS, text_bytes(rows) // each + 1)
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), by_bytes)
