"""Substring removal by relative Lempel-Ziv parsing (operator 4).

Reference blocks. A window is 35 consecutive words. Its anchor is the least hash among its 16-word
runs, so equal windows have equal anchors wherever they stand. A block is a maximal run of windows
with one anchor (about ten windows). The whole corpus is cut into blocks; all of them are reference,
and those with one anchor meet in one bucket.

Parsing. A bucket indexes its blocks by a suffix array over their windows: the longest match of the
words from a place on is its common prefix with one of its two neighbours in that order, which stand
elsewhere. Every block is parsed greedily against it: at a word, the longest factor found there is
taken together with its reference position. Where a factor ends, each word of its last 34 could begin
another window; so the parse goes on at the first window that isn't whole inside the factor, not at the
factor's end. Windows without a match are literals. Factors of 35 words and more are the duplicate
spans, and they cover exactly the windows that start elsewhere too.

Work. Blocks of equal content that one worker sees are factors of one another at once: one of them is
sent to the bucket, the others only give their spans. Anchors in a slot that very many blocks share are
hot: their windows go one by one by their own hashes, so a frequent passage with many neighbourhoods
spreads over all buckets. Slots are counted over the whole corpus. Windows match by a 64-bit hash of
their words and by the 64-bit hash that is their anchor.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import _powers, buckets, give_back, maybe_broadcast, mix, saved, steps, text_bytes, word_hashes

#: Words in a window, in a run that can be its anchor, and runs in a window.
WINDOW, RUN = 35, 16
RUNS = WINDOW - RUN + 1
#: A slot of anchors is hot from this many blocks, or from so many times the mean, if more.
HOT_BLOCKS, HOT_TIMES = 4096, 4
#: Bytes of text to a block, and blocks to a slot, by which slots are numbered; log2 of slots at most.
BLOCK_TEXT, SLOT_BLOCKS, MAX_SLOT_BITS = 65, 64, 22
#: Words that a worker gathers before it sends blocks to the buckets, and windows that it hashes at once.
FLUSH_WORDS, STEP_WINDOWS = 1_500_000, 1 << 17
#: Bytes of text to a bucket: what a worker holds of one is some twenty times its words' hashes.
BUCKET_TEXT = 4 << 20
#: Bytes of text to a shard of the spans.
SHARD_BYTES = 256 << 20
#: Spans up to this many rows and bytes are broadcast to the texts.
BROADCAST_SPANS, BROADCAST_BYTES = 250_000, 64 << 20

_U = np.uint64
_LOWEST = -(1 << 63)
#: A factor: start and length in words, the document of its reference and the start there.
SPAN = np.dtype([("start", "<u4"), ("length", "<u4"), ("ref", "<i8"), ("at", "<u4")])


def _sliding_min(g: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every k consecutive values."""
    m, step = g, 1
    while step * 2 <= k:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    return np.minimum(m[: len(g) - k + 1], m[k - step :])


def windows_and_anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and anchor of every window of a document, from its words' hashes."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    power, inverse = _powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h) * power[: len(h)], out=total[1:])
    window = mix((total[WINDOW:] - total[:n]) * inverse[:n])
    runs = len(h) - RUN + 1
    run = mix((total[RUN:] - total[:runs]) * inverse[:runs] ^ _U(0xA5A5A5A5A5A5A5A5))
    return window, _sliding_min(run, RUNS)


def blocks(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal runs of windows with one anchor."""
    start = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    return start, np.diff(np.append(start, len(anchor)))


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each range in turn."""
    return np.repeat(start - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())


def _contents(window: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of each block's windows in order; at: where a block begins in window."""
    out = np.empty(len(at), np.uint64)
    cuts = np.unique(np.searchsorted(at, np.arange(0, at[-1] + 1, STEP_WINDOWS)))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
        place = _ranges(np.zeros(b - a, np.int64), length[a:b]).astype(np.uint64)
        part = window[at[a] : at[a] + len(place)]
        out[a:b] = np.add.reduceat(mix(part + place * _U(0x9E3779B97F4A7C15)), at[a:b] - at[a])
    return mix(out + length.astype(np.uint64))


# ---------------------------------------------------------------- slots of anchors


def _slots(batches, bits: int, n_shards: int):
    """(shard, slots, counts): this task's blocks by slot of their anchors."""
    count = np.zeros(1 << bits, np.int64)
    for (texts,) in steps(batches):
        for h in word_hashes(texts):
            _, anchor = windows_and_anchors(h)
            if len(anchor):
                np.add.at(count, (anchor[blocks(anchor)[0]] >> _U(64 - bits)).astype(np.int64), 1)
    used = np.flatnonzero(count)
    cuts = np.searchsorted(used, np.arange(n_shards + 1) * (1 << bits) // n_shards)
    rows = [(i, used[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
    yield pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1].astype(np.uint32).tobytes() for r in rows], pa.binary()),
        pa.array([count[r[1]].tobytes() for r in rows], pa.binary()),
    ], names=["shard", "slots", "counts"])


def _hot(least: int):
    def run(table: pa.Table) -> pa.Table:
        slot, count = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table.column(c)]) for c, t in (("slots", np.uint32), ("counts", np.int64)))
        used, back = np.unique(slot, return_inverse=True)
        total = np.zeros(len(used), np.int64)
        np.add.at(total, back, count)
        return pa.table({"hot": pa.array([used[total >= least].tobytes()], pa.binary())})

    return run


def _hot_slots(rows: DataFrame, size: int) -> tuple[bytes, int]:
    """The hot slots, one bit each, and log2 of the number of slots. Fixed by the size of the table."""
    n = size // BLOCK_TEXT + 1
    bits = min(MAX_SLOT_BITS, max(10, (n // SLOT_BLOCKS).bit_length()))
    least = max(HOT_BLOCKS, HOT_TIMES * n >> bits)
    n_shards = min(1 << 10, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = rows.select("text").mapInArrow(lambda it: _slots(it, bits, n_shards), "shard int, slots binary, counts binary").groupBy("shard").applyInArrow(_hot(least), "hot binary").collect()
    hot = np.zeros(1 << bits, bool)
    for r in found:
        hot[np.frombuffer(r["hot"], np.uint32)] = True
    return np.packbits(hot).tobytes(), bits


# ---------------------------------------------------------------- sending blocks

_COLUMNS = ("ids", "hashes", "owners", "starts", "lengths", "anchors", "windows", "spans")
SENT = pa.schema([("bucket", pa.int32()), *((x, pa.binary()) for x in _COLUMNS)])
_SENT = "bucket int, " + ", ".join(f"{x} binary" for x in _COLUMNS)


def _shard(hashes: np.ndarray, n: int) -> np.ndarray:
    return (mix(hashes.astype(np.uint64)) % _U(n)).astype(np.int64)


def _by_shard(ids: np.ndarray, hashes: np.ndarray, owner: np.ndarray, span: np.ndarray, n_shards: int):
    """(shard, ids, hashes, owners, spans) rows of spans of documents, packed."""
    if not len(owner):
        return
    shard = _shard(hashes, n_shards)[owner]
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(order))):
        used, local = np.unique(owner[order[a:b]], return_inverse=True)
        yield int(shard[order[a]]), ids[used].tobytes(), hashes[used].tobytes(), local.astype(np.uint32).tobytes(), span[order[a:b]].tobytes()


def _send(batches, n_buckets: int, n_shards: int, shared):
    """Blocks for the buckets; under n_buckets and beyond, spans for the shards that are known here."""
    hot_slots, bits = shared.value
    hot_slots = np.frombuffer(hot_slots, np.uint8)
    ids, hashes, owners, starts, lengths, anchors, keys, wins, words = [], [], [], [], [], [], [], [], 0

    def flush():
        key, anchor, start, length = (np.concatenate(x) for x in (keys, anchors, starts, lengths))
        owner = np.repeat(np.arange(len(ids)), owners)
        window = np.concatenate(wins)
        wins.clear()
        at = np.cumsum(length) - length
        content = _contents(window, at, length) ^ anchor
        _, first, back, times = np.unique(content, return_index=True, return_inverse=True, return_counts=True)
        known_ids, known_hashes = np.array(ids, np.int64), np.array(hashes, np.int64)
        for x in (ids, hashes, owners, starts, lengths, anchors, keys):
            x.clear()
        # Equal blocks are factors of the first of them, and that of the last.
        again = np.flatnonzero(times[back] > 1)
        last = np.zeros(len(first), np.int64)
        last[back] = np.arange(len(back))
        other = np.where(first[back[again]] == again, last[back[again]], first[back[again]])
        span = np.zeros(len(again), SPAN)
        span["start"], span["length"], span["ref"], span["at"] = start[again], length[again] + WINDOW - 1, known_ids[owner[other]], start[other]
        rows = [(n_buckets + s, i, h, o, None, None, None, None, x) for s, i, h, o, x in _by_shard(known_ids, known_hashes, owner[again], span, n_shards)]
        bucket = (((key[first] >> _U(32)) * _U(n_buckets)) >> _U(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        for b in range(n_buckets):
            own = first[order[cuts[b] : cuts[b + 1]]]
            if len(own):
                used, local = np.unique(owner[own], return_inverse=True)
                rows.append((
                    b, known_ids[used].tobytes(), known_hashes[used].tobytes(), local.astype(np.uint32).tobytes(), start[own].astype(np.uint32).tobytes(),
                    length[own].astype(np.uint32).tobytes(), anchor[own].tobytes(), window[_ranges(at[own], length[own])].tobytes(), None,
                ))
            if len(rows) >= 64:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SENT)], schema=SENT)
                rows.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SENT)], schema=SENT)
        del window, content, back, key, anchor
        give_back()

    for doc, code, texts in steps(batches):
        for i, c, h in zip(doc, code, word_hashes(texts)):
            window, anchor = windows_and_anchors(h)
            if not len(window):
                continue
            start, length = blocks(anchor)
            anchor = anchor[start]
            key = mix(anchor)
            slot = (anchor >> _U(64 - bits)).astype(np.int64)
            hot = (hot_slots[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1
            if hot.any():
                loose = _ranges(start[hot], length[hot])
                key = np.concatenate((key[~hot], mix(window[loose])))
                anchor = np.concatenate((anchor[~hot], np.repeat(anchor[hot], length[hot])))
                start = np.concatenate((start[~hot], loose))
                length = np.concatenate((length[~hot], np.ones(len(loose), np.int64)))
                window = window[_ranges(start, length)]
            for held, x in zip((ids, hashes, owners, starts, lengths, anchors, keys, wins), (i, c, len(start), start, length, anchor, key, window)):
                held.append(x)
            words += len(window)
            if words >= FLUSH_WORDS:
                yield from flush()
                words = 0
    if ids:
        yield from flush()
    give_back()


# ---------------------------------------------------------------- the parse


def longest_matches(window: np.ndarray, anchor: np.ndarray, remaining: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window, in how many consecutive windows it and the next ones match another place, and
    that place; 0 and -1 without a match. remaining: windows from here to its block's end, itself included.

    A suffix array by prefix doubling; the longest match of a suffix is with a neighbour in it.
    """
    n = len(window)
    length, place = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    # Only windows with an equal one can match; the rest are cut out first.
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    some = np.zeros(n, bool)
    some[order[1:][same]] = True
    some[order[:-1][same]] = True
    where = np.flatnonzero(some)
    if not len(where):
        return length, place
    # Windows left in the run of such windows, within the block.
    ends = np.append((where[1:] != where[:-1] + 1) | (remaining[where[:-1]] == 1), True)
    left = np.flatnonzero(ends)[np.cumsum(ends) - ends] - np.arange(len(where)) + 1
    ranks, width = [_pair_rank(window[where], anchor[where])], 1
    while width < left.max():
        after = np.zeros(len(where), np.int64)
        more = np.flatnonzero(left > width)
        after[more] = ranks[-1][more + width] + 1
        ranks.append(_pair_rank(ranks[-1], after))
        width *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        width, r = 1 << level, ranks[level]
        go = np.flatnonzero((left[a] >= common + width) & (left[b] >= common + width))
        equal = r[a[go] + common[go]] == r[b[go] + common[go]]
        # A rank covers width windows, or up to the run's end, which both reach here.
        common[go[equal]] += width
    best, at = np.zeros(len(where), np.int64), np.full(len(where), -1, np.int64)
    best[a], at[a] = common, np.where(common > 0, b, -1)
    better = common > best[b]
    best[b[better]], at[b[better]] = common[better], a[better]
    length[where], place[where] = best, np.where(at >= 0, where[at], -1)
    return length, place


def _pair_rank(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rank of each pair (x, y) among the distinct ones."""
    order = np.lexsort((y, x))
    new = np.concatenate(([0], ((x[order[1:]] != x[order[:-1]]) | (y[order[1:]] != y[order[:-1]])).cumsum()))
    rank = np.empty(len(x), np.int64)
    rank[order] = new
    return rank


def greedy_factors(length: np.ndarray, remaining: np.ndarray) -> np.ndarray:
    """Places where a greedy parse of every block takes a factor: the longest match there; then on to
    the first window that the factor doesn't hold whole. All blocks are parsed at once, a factor a turn."""
    n = len(length)
    match = length > 0
    # The next window with a match, and its block's end.
    following = np.append(np.where(match, np.arange(n), n), n)
    following = np.minimum.accumulate(following[::-1])[::-1]
    end = np.arange(n) + remaining
    first = np.flatnonzero(np.concatenate(([True], end[1:] != end[:-1])))
    at, out = first, []
    limit = end[first]
    while len(at):
        at = following[at]
        keep = at < limit
        at, limit = at[keep], limit[keep]
        out.append(at)
        at = np.minimum(at + length[at], limit)
    return np.concatenate(out) if out else first[:0]


def _factor(n_buckets: int, n_shards: int):
    """Blocks of one bucket to packed factors; rows of a shard pass through."""

    def run(table: pa.Table) -> pa.Table:
        give_back()
        rows = table.to_pylist()
        if rows[0]["bucket"] >= n_buckets:
            return pa.table([pa.array([r["bucket"] - n_buckets for r in rows], pa.int32()), *(pa.array([r[x] for r in rows], pa.binary()) for x in ("ids", "hashes", "owners", "spans"))], schema=SHARDS)
        read = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rows])
        ids, hashes, window, anchor = read("ids", np.int64), read("hashes", np.int64), read("windows", np.uint64), read("anchors", np.uint64)
        start, size = read("starts", np.uint32).astype(np.int64), read("lengths", np.uint32).astype(np.int64)
        base = np.cumsum([0, *(len(r["ids"]) // 8 for r in rows[:-1])])
        owner = np.concatenate([np.frombuffer(r["owners"], np.uint32) + b for r, b in zip(rows, base)])
        del rows
        block = np.repeat(np.arange(len(size)), size)
        offset = _ranges(np.zeros(len(size), np.int64), size)
        remaining = size[block] - offset
        length, place = longest_matches(window, anchor[block], remaining)
        at = greedy_factors(length, remaining)
        span = np.zeros(len(at), SPAN)
        span["start"], span["length"] = start[block[at]] + offset[at], length[at] + WINDOW - 1
        span["ref"], span["at"] = ids[owner[block[place[at]]]], start[block[place[at]]] + offset[place[at]]
        out = list(_by_shard(ids, hashes, owner[block[at]], span, n_shards))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), SHARDS)], schema=SHARDS) if out else SHARDS.empty_table()

    return run


SHARDS = pa.schema([("shard", pa.int32()), *((x, pa.binary()) for x in ("ids", "hashes", "owners", "spans"))])
SPANS = pa.schema([("key_id", pa.int64()), ("key_hash", pa.int64()), ("spans", pa.binary())])


def _merge(table: pa.Table) -> pa.Table:
    """A shard's spans by document, in order of their starts."""
    rows = table.to_pylist()
    owner, span, ids, hashes, n = [], [], [], [], 0
    for r in rows:
        ids.append(np.frombuffer(r["ids"], np.int64))
        hashes.append(np.frombuffer(r["hashes"], np.int64))
        owner.append(np.frombuffer(r["owners"], np.uint32) + n)
        span.append(np.frombuffer(r["spans"], SPAN))
        n += len(ids[-1])
    ids, hashes, owner, span = map(np.concatenate, (ids, hashes, owner, span))
    doc = _pair_rank(ids, hashes)
    order = np.lexsort((span["start"], doc[owner]))
    span, doc, owner = span[order], doc[owner][order], owner[order]
    cut = np.flatnonzero(np.diff(doc, prepend=-1))
    lead = owner[cut]
    return pa.table([pa.array(ids[lead]), pa.array(hashes[lead]), pa.array([span[a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(span)))], pa.binary())], schema=SPANS)


# ---------------------------------------------------------------- applying the factors


def kept_words(words: list[bytes], spans: bytes | None) -> list[bytes]:
    """The words that no factor covers."""
    if not spans:
        return words
    s = np.frombuffer(spans, SPAN)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, s["start"], 1)
    np.add.at(edge, s["start"] + s["length"], -1)
    return list(compress(words, (np.cumsum(edge)[:-1] == 0).tolist()))


def _apply(batches):
    for ids, texts, spans in steps(batches):
        n, kept, factors = [], [], []
        for text, found in zip(texts, spans):
            words = text.split()
            left = kept_words(words, found)
            n.append((len(words), len(words) - len(left)))
            kept.append(b" ".join(left).decode())
            factors.append([dict(zip(SPAN.names, f)) for f in np.frombuffer(found or b"", SPAN).tolist()])
        yield pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([x[0] for x in n], pa.int64()), pa.array([x[1] for x in n], pa.int64()), pa.array(kept, pa.string()),
            pa.array(factors, pa.list_(pa.struct([(x, pa.int64()) for x in SPAN.names]))),
        ], names=["doc_id", "n_words", "n_removed", "kept", "factors"])


def _digest(batches):
    for ids, texts, spans in steps(batches):
        out = []
        for text, found in zip(texts, spans):
            words = text.split()
            kept = kept_words(words, found)
            out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        yield pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array([x[0] for x in out], pa.int64()),
            pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string()),
        ], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _text(text_col: str):
    return F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))


def _key(id_col: str, text_col: str):
    """A row's key: id and a hash of id and text, so that a repeated id with another text stays apart."""
    key = F.col(id_col).cast("long")
    return F.coalesce(key, F.lit(_LOWEST)).alias("key_id"), F.xxhash64(key, _text(text_col)).alias("key_hash")


def duplicate_spans(rows: DataFrame) -> DataFrame:
    """(key_id, key_hash, spans), written: for each document with repeated windows its packed factors.

    rows: (key_id long, key_hash long, text binary). Documents of fewer than 35 words have no window;
    rows of equal key are copies, found as such; an empty table gives an empty table. Long texts are
    parsed whole; a worker holds one of them at a time.
    """
    n, size = buckets(rows, BUCKET_TEXT), text_bytes(rows)
    n_shards = min(1 << 12, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES + 1))
    shared = rows.sparkSession.sparkContext.broadcast(_hot_slots(rows, size))
    spans = saved(
        rows.select("key_id", "key_hash", "text").mapInArrow(lambda it: _send(it, n, n_shards, shared), _SENT)
        .groupBy("bucket").applyInArrow(_factor(n, n_shards), "shard int, ids binary, hashes binary, owners binary, spans binary")
        .groupBy("shard").applyInArrow(_merge, "key_id long, key_hash long, spans binary"), "spans",
    )
    shared.destroy()
    return spans


def _with_spans(docs: DataFrame, id_col: str, text_col: str, *columns) -> DataFrame:
    """columns of docs and each row's spans, null where it has none."""
    rows = docs.select(*_key(id_col, text_col), _text(text_col).alias("text"))
    spans = duplicate_spans(rows)
    # A row of spans is a key and a few bytes for each factor; broadcast only if few and small.
    n, size = spans.agg(F.count("*"), F.coalesce(F.sum(F.length("spans")), F.lit(0))).first()
    spans = maybe_broadcast(spans, n if size <= BROADCAST_BYTES else 1 << 62, BROADCAST_SPANS)
    key_id, key_hash = _key(id_col, text_col)
    keyed = docs.select(F.struct(*columns).alias("row"), key_id, key_hash)
    return keyed.join(spans, ["key_id", "key_hash"], "left").select("row.*", "spans")


def remove_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_words, n_removed, kept text, factors.

    Every word inside a window that also starts elsewhere (same document included) goes. Null texts
    count as empty; texts under 35 words stay whole; repeated rows remove one another; of equal windows
    none is preferred, so ties don't arise; other columns, also of clashing names, are ignored; an empty
    table gives an empty table; long texts are read whole. kept holds the remaining words joined by one
    space; factors lists start, length (in words), ref and at: the document (of a null id, the least
    long) and the word where the same words stand too.
    """
    rows = _with_spans(docs, id_col, text_col, F.col(id_col).cast("long").alias("doc_id"), _text(text_col).alias("text"))
    factor = "array<struct<" + ", ".join(f"{x}: long" for x in SPAN.names) + ">>"
    return rows.mapInArrow(_apply, f"doc_id long, n_words long, n_removed long, kept string, factors {factor}")


def _strip(fields: list[str], text_col: str, schema: pa.Schema):
    """Replace the text of documents that lose words, and n_chars with it; other rows stay as they are."""
    text_at = fields.index(text_col)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, spans = part.column(text_at).to_pylist(), part.column(len(fields)).to_pylist()
                columns = [part.column(i) for i in range(len(fields))]
                cut = {i: b" ".join(kept_words(texts[i].encode().split(), s)).decode() for i, s in enumerate(spans) if s}
                texts = [cut.get(i, t) for i, t in enumerate(texts)]
                columns[text_at] = pa.array(texts, schema.field(text_at).type)
                if "n_chars" in fields:
                    k = fields.index("n_chars")
                    chars = [len(cut[i]) if i in cut else n for i, n in enumerate(columns[k].to_pylist())]
                    columns[k] = pa.array(chars, schema.field(k).type)
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def strip_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated passages cut from text; same columns and rows. n_chars, where there is one,
    follows a text that was cut; texts that lose nothing, null ones too, stay as they are to the byte.
    Everything else as remove_duplicates()."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = _with_spans(docs, id_col, text_col, *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    return rows.mapInArrow(_strip(docs.columns, text_col, to_arrow_schema(docs.schema)), docs.schema)


def op4(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    rows = _with_spans(docs, "doc_id", "text", F.col("doc_id").cast("long").alias("doc_id"), _text("text").alias("text"))
    return rows.mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
