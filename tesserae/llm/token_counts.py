"""Token counts by rank-synchronous array merging (operator 12).

A sentencepiece BPE model joins, again and again, the neighbouring symbols whose joint piece ranks
first, the leftmost of equals. Here many pre-tokens lie one after another in one numpy array, ragged
by an owner index. Each round finds every sequence's lowest rank and applies that pair in all
sequences at once, at all of its places that the one-by-one order would reach before anything better
could arise. Symbols that survive are counted; characters outside the vocabulary count their bytes.

Pre-tokens are cut only where no piece of the vocabulary reaches across, which the vocabulary itself
tells, so the counts are the library's. Counts of short pre-tokens are remembered by the worker.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import give_back, remembers, steps, table

#: A document with more tokens than this is over the limit.
LIMIT = 4096
#: Pre-tokens in a generation of a worker's memory, and the longest that is remembered.
BOUND, LONGEST = 600_000, 48
#: Pre-tokens and characters that are looked up at once.
WORDS, CHARS = 1 << 16, 1 << 18
SPACE = "▁"
#: A sequence is finished one join at a time where a round may make one join in so many or fewer.
STUCK = 32

COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
_NONE = np.iinfo(np.int32).max


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message's fields; bytes where the length is given."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


def read_pieces(model: bytes) -> list[tuple[str, float]]:
    """(piece, score) of all pieces that text can become by merging. Control, unknown and byte pieces
    are no text; pieces that a user defined are cut out before merging, which isn't done here."""
    out = []
    for number, entry in _fields(model):
        if number == 1:
            f = dict(_fields(entry))
            kind = f.get(3, 1)
            if kind == 4:
                raise ValueError("a model with pieces defined by a user")
            if kind in (1, 5):
                out.append((f[1].decode(), float(np.frombuffer(f.get(2, bytes(4)), "<f4")[0])))
    return out


class Merger:
    """Merges many sequences at once under a vocabulary of (piece, score); the higher score goes first."""

    def __init__(self, pieces: list[tuple[str, float]]):
        score = dict(pieces)
        letters = {c for p in score for c in p}
        # Symbol 0 stands for every character that no piece holds.
        self.symbol = {s: i for i, s in enumerate([*score, *sorted(letters - score.keys())], 1)}
        self.known = score.keys()
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.width = len(self.symbol) + 1
        self.of_code = np.zeros(0x110000, np.int32)
        for c in letters:
            self.of_code[ord(c)] = self.symbol[c]
        #: Characters that only stand alone, as no piece has them: tokens are their bytes.
        self.alone = np.array([False, *(s not in score for s in self.symbol)])
        keys, rank, joint = [], [], []
        for p in score:
            for i in range(1, len(p)):
                if p[:i] in self.symbol and p[i:] in self.symbol:
                    keys.append(self.symbol[p[:i]] * self.width + self.symbol[p[i:]])
                    rank.append(order[score[p]])
                    joint.append(self.symbol[p])
        self._table(np.array(keys, np.int64), np.array(rank, np.int32), np.array(joint, np.int32))

    def _table(self, keys, rank, joint) -> None:
        """Open addressing by a multiplicative hash; an empty slot ends a search."""
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rank, self.joint = np.full(1 << bits, _NONE, np.int32), np.zeros(1 << bits, np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] < 0
            slots, first = np.unique(at[todo[free]], return_index=True)
            put = todo[free][first]
            self.keys[slots], self.rank[slots], self.joint[slots] = keys[put], rank[put], joint[put]
            todo = np.setdiff1d(todo, put)
            at[todo] = (at[todo] + 1) & self.mask

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look_up(self, left, right):
        """Slots of pairs of symbols; an empty slot, whose rank is no rank, for pairs that don't join."""
        keys = left.astype(np.int64) * self.width + right
        at = self._slot(keys)
        found = self.keys[at]
        todo = np.flatnonzero((found != keys) & (found >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            found = self.keys[at[todo]]
            todo = todo[(found != keys[todo]) & (found >= 0)]
        return at

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each word, each merged as a text of its own."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        owner = np.repeat(np.arange(len(words)), lengths)
        sym = self.of_code[codes]
        lone = (sym == 0) | self.alone[sym]
        utf8 = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        # Merging removes a symbol, so the count starts from all of them.
        out = np.bincount(owner, np.where(lone, utf8, 1), len(words)).astype(np.int64)
        slot = np.zeros(len(sym), np.int64)
        rank = np.full(len(sym), _NONE, np.int32)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        slot[inner] = self.look_up(sym[inner], sym[inner + 1])
        rank[inner] = self.rank[slot[inner]]
        while len(sym):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, starts)
            size = np.diff(np.r_[starts, len(sym)])
            best = np.repeat(best, size)
            open_ = best < _NONE
            if not open_.all():
                sym, owner, slot, rank, best = (x[open_] for x in (sym, owner, slot, rank, best))
                if not len(sym):
                    break
            at = self._places(rank == best)
            ordered = self._in_order(sym, owner, slot, best, at)
            stuck = self._stuck(owner[at], ordered)
            if len(stuck):
                for i in stuck.tolist():
                    a, b = np.searchsorted(owner, [i, i + 1])
                    out[i] -= self._one_by_one(sym[a:b].tolist())
                rest = ~np.isin(owner, stuck)
                sym, owner, slot, rank = (x[rest] for x in (sym, owner, slot, rank))
                continue
            at = at[ordered]
            out -= np.bincount(owner[at], minlength=len(out))
            sym[at] = self.joint[slot[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            sym, owner, slot, rank = (x[keep] for x in (sym, owner, slot, rank))
            at = moved[at]
            changed = np.zeros(len(sym), bool)
            changed[at] = changed[at[at > 0] - 1] = True
            new = np.flatnonzero(changed)
            rank[new] = _NONE
            new = new[new < len(sym) - 1]
            new = new[owner[new] == owner[new + 1]]
            slot[new] = self.look_up(sym[new], sym[new + 1])
            rank[new] = self.rank[slot[new]]
        return out

    @staticmethod
    def _stuck(owner: np.ndarray, ordered: np.ndarray) -> np.ndarray:
        """Sequences of which a round may join one place in STUCK or fewer: equal pieces that grow into
        one another from the left, as long runs of spaces do."""
        if ordered.all():
            return owner[:0]
        ids, at, n = np.unique(owner, return_inverse=True, return_counts=True)
        return ids[np.bincount(at, ordered, len(ids)) * STUCK < n]

    def _one_by_one(self, sym: list[int]) -> int:
        """Joins made in one sequence in the order of rank and place, by a queue over linked symbols."""
        n = len(sym)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue: list[tuple[int, int, int, int, int]] = []

        def add(places):
            left = np.array([sym[i] for i in places], np.int64)
            right = np.array([sym[after[i]] for i in places], np.int64)
            slots = self.look_up(left, right)
            for i, a, b, rank, joint in zip(places, left.tolist(), right.tolist(), self.rank[slots].tolist(), self.joint[slots].tolist()):
                if rank < _NONE:
                    heapq.heappush(queue, (rank, i, a, b, joint))

        add(range(n - 1))
        made = 0
        while queue:
            _, i, a, b, joint = heapq.heappop(queue)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            made += 1
            sym[i], sym[j], after[i] = joint, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            add([x for x in (before[i], i) if x >= 0 and after[x] < n])
        return made

    @staticmethod
    def _places(hit: np.ndarray) -> np.ndarray:
        """Of places in a row, which overlap, every second from the left."""
        at = np.flatnonzero(hit)
        first = np.r_[True, np.diff(at) > 1]
        run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        return at[(np.arange(len(at)) - run) % 2 == 0]

    def _in_order(self, sym, owner, slot, best, at) -> np.ndarray:
        """Whether each place is joined before anything better, or as good and further left, arises in
        its sequence: up to and with the first place whose new symbol joins a neighbour that well."""
        new, n = self.joint[slot[at]], len(sym)
        before = np.maximum(at - 1, 0)
        after_joint = np.r_[False, (at[1:] - at[:-1] == 2) & (owner[at[1:]] == owner[at[:-1]])]
        left = np.where(after_joint, np.r_[0, new[:-1]], sym[before])
        has_left = (at > 0) & (owner[before] == owner[at])
        after = np.minimum(at + 2, n - 1)
        has_right = (at + 2 < n) & (owner[after] == owner[at])
        better = np.zeros(len(at), bool)
        for has, a, b in ((has_left, left, new), (has_right, new, sym[after])):
            i = np.flatnonzero(has)
            better[i] |= self.rank[self.look_up(a[i], b[i])] <= best[at[i]]
        if not better.any():
            return np.ones(len(at), bool)
        earlier = np.cumsum(better) - better
        first = np.r_[True, owner[at[1:]] != owner[at[:-1]]]
        base = earlier[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        return earlier == base


class Counter:
    """Counts tokens of whole texts as the library for a sentencepiece BPE model does."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalized = library.normalize
        pieces = read_pieces(library.serialized_model_proto())
        self.merger = Merger(pieces)
        several = [p for p, _ in pieces if len(p) > 1]
        inner = set("".join(several))
        lone = "".join(c for c in map(chr, range(128)) if c not in inner)
        #: No piece goes on with a space behind another character: texts are cut before spaces.
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in several)
        #: Marks that no piece has behind a letter: words are cut before them.
        marks = re.escape("".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and not any(re.search(f"[A-Za-z]{re.escape(c)}", p) for p in several)))
        lone = re.escape(lone)
        word = rf"{SPACE}+[^{SPACE}{lone}]*|[^{SPACE}{lone}]+" if self.cuts else rf"[^{lone}]+"
        if self.cuts and marks:
            word = rf"{SPACE}*[A-Za-z]+(?=[{marks}])|{word}"
        self.words = re.compile(rf"{word}|[{lone}]" if lone else word).findall
        self.memory: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def _parts(self, text: str):
        """A normalised text in parts of about CHARS characters that are cut where pre-tokens are."""
        at = 0
        while self.cuts and len(text) - at > CHARS:
            end = text.find(SPACE, at + CHARS)
            while end > 0 and text[end - 1] == SPACE:
                end = text.find(SPACE, end + 1)
            if end < 0:
                break
            yield text[at:end]
            at = end
        yield text[at:]

    def _learn(self, words: list[str]) -> list[str]:
        """Have the memory hold every word; new ones are merged, a bounded number of characters at once.
        Gives the words that are too long to be remembered."""
        fresh = set(words).difference(self.memory)
        for w in fresh.intersection(self.older):
            self.memory[w] = self.older[w]
            fresh.discard(w)
        held, size = [], 0
        for i, w in enumerate(fresh, 1):
            held.append(w)
            size += len(w)
            if size >= CHARS or i == len(fresh):
                self.memory.update(zip(held, self.merger.counts(held).tolist()))
                held, size = [], 0
        return [w for w in fresh if len(w) > LONGEST]

    def _forget(self, long: list[str]) -> None:
        """Long words go at once, others by generations."""
        for w in long:
            del self.memory[w]
        if len(self.memory) > BOUND:
            self.older, self.memory = self.memory, {}

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush():
            nonlocal size
            long = self._learn([w for _, words in held for w in words])
            for i, words in held:
                out[i] += sum(map(self.memory.__getitem__, words))
            self._forget(long)
            held.clear()
            size = 0

        for i, text in enumerate(texts):
            for part in self._parts(self.normalized(text) if text else ""):
                words = self.words(part)
                held.append((i, words))
                size += len(words)
                if size >= WORDS:
                    flush()
        flush()
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


remembers("counts", counter.cache_clear)


def _count(path: str, limit: int):
    def run(batches):
        count = counter(path)
        for keys, texts in steps(batches, owner="counts"):
            n = count.counts(texts)
            sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], schema=COUNTS)
        count.older = {}
        give_back("counts")

    return run


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than limit tokens).

    path: a sentencepiece BPE model's place on every executor. Null and empty texts have no bytes and
    no tokens; special pieces' strings in a text are ordinary text, as the library takes them. Repeated
    rows are counted alike, null ids stay null, other columns are ignored, an empty table gives an
    empty table. A very long text is merged in parts, so its task holds the text and little more.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(_count(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op12(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
