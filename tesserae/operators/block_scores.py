"""The best items of a block of packed postings, block after block of a task, by numpy inside Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .index import B, K1

#: Scores that a step holds at once, and candidates that a task gathers before it cuts them to the best.
STEP_SCORES, GATHERED = 2_000_000, 1_000_000
FOUND = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


def _columns(ids: pa.Array, owner: str | None):
    """The owner of each column of a block's scores, the column of each posting, and where owners begin."""
    if owner is None:
        names, column = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)
        return names, column, None
    fields = [f.to_numpy(zero_copy_only=False) for f in ids.flatten()]
    own = ids.field(owner).to_numpy(zero_copy_only=False)
    order = np.lexsort([*fields, own])
    new = np.zeros(len(order), bool)
    for f in (own, *fields):
        new[1:] |= f[order][1:] != f[order][:-1]
    column = np.empty(len(order), np.int64)
    column[order] = np.cumsum(new)
    names = own[order][np.flatnonzero(np.r_[True, new[1:]])]
    starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
    return names[starts], column, starts


def _kinds(listed: pa.Table, names: np.ndarray) -> np.ndarray:
    """The kind of each name; that of unlisted ones is -1."""
    listed = listed.combine_chunks()
    ids, kinds = (np.concatenate([np.empty(0, np.int64), *(x.flatten().to_numpy(zero_copy_only=False) for x in listed.column(c).chunks)]).astype(np.int64) for c in ("items", "kinds"))
    if not len(ids):
        return np.full(len(names), -1)
    order = np.argsort(ids, kind="stable")
    ids, kinds = ids[order], kinds[order]
    at = np.minimum(np.searchsorted(ids, names), len(ids) - 1)
    return np.where(ids[at] == names, kinds[at], -1)


def _files(listed: pa.Table, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the listed items that are among the names: their columns, by file and then by id; where files begin
    there; each file as bytes, empty if it is null."""
    ids = np.array([i for r in listed.column("items").to_pylist() for i in r], np.int64)
    file = np.array([b"" if f is None else b"=" + f for r in listed.column("files").to_pylist() for f in r], object)
    at = np.minimum(np.searchsorted(names, ids), len(names) - 1)
    held = names[at] == ids
    file, code = np.unique(file[held], return_inverse=True)
    order = np.lexsort((at[held], code))
    return at[held][order], np.flatnonzero(np.r_[True, np.diff(code[order]) > 0])[: len(file)], file


def _scored(rows: pa.Table, k: int, average: float, owner: str | None, digits: int, passes: np.ndarray | None) -> Iterator[tuple]:
    """(qids, ids, scores) of at least the k best of each question in the block of rows, ties included.
    If rows list files: (qids, ids, scores, files) of the best of each of the k best files."""
    # A row without postings lists items or questions; one whose term no question with a filter has is nobody's.
    listed = rows.filter(pc.is_valid(rows.column("kinds"))) if passes is not None else None
    wanted = rows.filter(pc.is_valid(rows.column("wanted"))) if "wanted" in rows.column_names else None
    filed = rows.filter(pc.is_valid(rows.column("files"))) if "files" in rows.column_names else None
    rows = rows.filter(pc.is_valid(rows.column("qids")))
    if not rows.num_rows:
        return
    rows = rows.combine_chunks()
    take = lambda c: rows.column(c).combine_chunks()
    lists = take("ids")
    length = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    tf, size = (take(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in ("tfs", "lens"))
    names, column, starts = _columns(lists.flatten(), owner)
    weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / average)) * np.repeat(take("idf").to_numpy(), length)
    asked = take("qids")
    qid = asked.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(length)), asked.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    rule = np.zeros(len(qid), np.int64) if passes is None else take("rules").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    kind = None if passes is None else _kinds(listed, names)
    if wanted is not None:
        keep = np.isin(qid, wanted.column("wanted").combine_chunks().flatten().to_numpy(zero_copy_only=False))
        qid, row, rule = qid[keep], row[keep], rule[keep]
    if not len(qid):
        return
    first = np.cumsum(length) - length
    order = np.argsort(qid, kind="stable")
    qid, row, rule = qid[order], row[order], rule[order]
    asking, begin = np.unique(qid, return_index=True)
    m = int(column.max()) + 1
    place, file_starts, file = (None, None, None) if filed is None else _files(filed, names)
    if place is not None and not len(place):
        return
    widest = m if place is None else max(m, len(place))
    # Questions go in runs: their scores, and the postings that they meet, are bounded for any number of them.
    met = np.add.reduceat(length[row], begin)
    cost = np.cumsum(np.maximum(met, widest))
    rule = rule[begin]
    begin = np.r_[begin, len(qid)]
    at = 0
    while at < len(asking):
        end = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + STEP_SCORES, "right")))
        own, n = row[begin[at] : begin[end]], end - at
        which = np.repeat(np.repeat(np.arange(n), np.diff(begin[at : end + 1])), length[own])
        posting = np.repeat(first[own] - (np.cumsum(length[own]) - length[own]), length[own]) + np.arange(len(which))
        scores = np.bincount(which * m + column[posting], weight[posting], n * m).reshape(n, m).round(digits)
        if starts is not None:
            scores = np.maximum.reduceat(scores, starts, axis=1)
        if passes is not None:
            scores[~passes[rule[at:end]][:, kind]] = 0
        if place is not None:
            each = scores[:, place]
            scores = np.maximum.reduceat(each, file_starts, axis=1)
        good = scores > 0
        if scores.shape[1] > k:
            good &= scores >= np.partition(scores, scores.shape[1] - k, axis=1)[:, [scores.shape[1] - k]]
        q, i = np.nonzero(good)
        if place is None:
            yield asking[at + q], names[i], scores[q, i]
        else:
            # The first of a file's items that reach its score has the least id.
            of = np.repeat(np.arange(len(file)), np.diff(np.r_[file_starts, len(place)]))
            row, item = np.nonzero((each == scores[:, of]) & good[:, of])
            _, first_one = np.unique(row * len(file) + of[item], return_index=True)
            row, item = row[first_one], item[first_one]
            yield asking[at + row], names[place[item]], each[row, item], file[of[item]]
        at = end


def _cut(found: list[tuple], k: int) -> tuple:
    """The k best of each question, one of each file if files are given: the highest score first, then the smaller id."""
    qid, ids, score, *file = (np.concatenate(x) for x in zip(*found))
    if file:
        code = np.unique(file[0], return_inverse=True)[1]
        order = np.lexsort((ids, -score, code, qid))
        one = order[np.r_[True, (np.diff(qid[order]) != 0) | (np.diff(code[order]) != 0)][: len(order)]]
        qid, ids, score, file = qid[one], ids[one], score[one], [file[0][one]]
    order = np.lexsort((ids, -score, qid))
    qid = qid[order]
    start = np.flatnonzero(np.r_[True, qid[1:] != qid[:-1]])
    place = np.arange(len(qid)) - np.repeat(start, np.diff(np.r_[start, len(qid)]))
    order = order[place < k]
    return qid[place < k], ids[order], score[order], *(f[order] for f in file)


def best_of_blocks(k: int, average: float, owner: str | None, digits: int, passes: list[list[bool]] | None = None) -> Callable:
    """For mapInArrow over rows (block, idf, ids, tfs, lens, qids) that are sorted by block and hold whole blocks:
    (qid, id, score), the k best of each question in this task. With a column wanted, a block has a row that lists
    in it which questions count there; without such a row none does. With a column files, rows (items, files) list a
    block's items and their files, and the k best of each question are of different files; unlisted items don't count.

    passes: which kinds each rule lets through. Rows then have rules, a question's beside it in qids, and a block
    has rows (items, kinds); items that no such row lists pass no rule.
    """
    passes = None if passes is None else np.array([[*p, False] for p in passes], bool).reshape(len(passes), -1)

    def run(batches):
        found, gathered = [], 0
        for rows in _blocks(batches):
            for part in _scored(rows, k, average, owner, digits, passes):
                found.append(part)
                gathered += len(part[0])
                if gathered > GATHERED:
                    found = [_cut(found, k)]
                    # What stays of many questions is gathered anew from where it stands.
                    gathered = len(found[0][0]) // 2
        if found:
            out = _cut(found, k)
            for at in range(0, len(out[0]), 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 65_536], f.type) for x, f in zip(out[:3], FOUND)], schema=FOUND)

    return run


def _blocks(batches) -> Iterator[pa.Table]:
    """The rows of each block, though batches may cut it."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column(batch.schema.get_field_index("block")).to_numpy(zero_copy_only=False)
        cuts = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            part = pa.Table.from_batches([batch.slice(a, b - a)])
            if held and held[0].column("block")[0].as_py() != block[a]:
                yield pa.concat_tables(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held)
