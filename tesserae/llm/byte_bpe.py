"""Byte-level BPE encoding and decoding over Arrow batches (operator 3).

Encoding maps a match's bytes to printable characters and runs the tokenizers library on them; one
character of a token is one byte, so token lengths give the offsets. Decoding takes the ids'
characters back through the reversed byte table, a few ids at a time; text is read from the bytes by an
incremental UTF-8 decoder, which holds a character that is split over tokens until it is whole.
"""

from __future__ import annotations

import codecs
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import steps
from .tokens import Encoder, rank_encoder, to_bytes


def encode_with_offsets(encoder: Encoder, text: str) -> tuple[list[int], list[tuple[int, int]]]:
    """Ids of a text and, for each, its start and end in the text's UTF-8 bytes."""
    ids, offsets, at = [], [], 0
    for piece in encoder.match(text):
        for t in encoder.tokens(piece):
            ids.append(t.id)
            n = len(t.value)  # one character of the value is one byte
            offsets.append((at, at + n))
            at += n
    return ids, offsets


def char_offsets(text: str, offsets: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte offsets as code points: a token that holds part of a character covers all of it."""
    data = np.frombuffer(text.encode(), np.uint8)
    number = np.cumsum((data & 0xC0) != 0x80) - 1
    return [(int(number[a]), int(number[b - 1]) + 1) for a, b in offsets]


#: Ids that are decoded at once.
CHUNK = 4096


def decode(table: list[str], ids):
    """The bytes of ids, a chunk at a time."""
    for at in range(0, len(ids), CHUNK):
        yield to_bytes("".join(map(table.__getitem__, ids[at : at + CHUNK])))


def decode_text(chunks) -> str:
    """The text of chunks of bytes that may end within a character; what is no UTF-8 becomes U+FFFD."""
    read = codecs.getincrementaldecoder("utf-8")("replace")
    return "".join([read.decode(c) for c in chunks]) + read.decode(b"", True)


@lru_cache(maxsize=4)
def _lengths(path: str, pattern: str) -> np.ndarray:
    """Bytes of each id."""
    return np.array([len(t) for t in rank_encoder(path, pattern)[1]], np.int64)


def _rows(path: str, pattern: str):
    def run(batches):
        encoder, table = rank_encoder(path, pattern)
        lengths = _lengths(path, pattern)
        names = [str(i) for i in range(len(table))]
        for keys, texts in steps(batches, owner="tokens"):
            out = []
            for key, text in zip(keys, texts):
                ids = np.frombuffer(encoder.encode(text), "<u4")
                ends = np.cumsum(lengths[ids])
                ids = ids.tolist()
                data = b"".join(decode(table, ids))
                # Ends of tokens, by their offsets, that lie before a continuation byte split a character.
                split = np.count_nonzero(np.frombuffer(data, np.uint8)[ends[:-1]] & 0xC0 == 0x80)
                out.append((key, len(ids), hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(data).hexdigest(), int(ends[-1]) if ids else 0, int(split)))
            columns = zip(*out) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ROUND_TRIP)], schema=ROUND_TRIP)
        encoder.rest()

    return run


ROUND_TRIP = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("n_bytes", pa.int64()), ("n_split_chars", pa.int64())])


def _encoded(path: str, pattern: str):
    def run(batches):
        encoder, table = rank_encoder(path, pattern)
        for keys, texts in steps(batches, owner="tokens"):
            both = [encode_with_offsets(encoder, t) for t in texts]
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, pa.int64()), pa.array([b[0] for b in both], pa.list_(pa.int32())),
                pa.array([[c for ab in b[1] for c in ab] for b in both], pa.list_(pa.int64())),
            ], names=["doc_id", "ids", "offsets"])

    return run


def _decoded(path: str, pattern: str):
    def run(batches):
        table = rank_encoder(path, pattern)[1]
        for keys, ids in steps(batches, owner="tokens"):
            data = [list(decode(table, x or [])) for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([b"".join(x) for x in data], pa.binary()), pa.array(map(decode_text, data), pa.string())], names=["doc_id", "data", "text"])

    return run


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def encode(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids, offsets) per row: offsets holds start, end in UTF-8 bytes for each id in turn.

    path is the rank file's place on every executor. Null texts count as empty (no ids); other
    columns are ignored; an empty table gives an empty table.
    """
    return _texts(docs).mapInArrow(_encoded(path, pattern or default_pattern()), "doc_id long, ids array<int>, offsets array<long>")


def decode_ids(encoded: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """(doc_id, data, text): the bytes that (doc_id, ids) stand for and the text that they spell; null ids
    give no bytes; a character whose bytes are cut off or wrong becomes U+FFFD in text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(path, pattern or default_pattern()), "doc_id long, data binary, text string")


def round_trip(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, n_split_chars per row: encodes whole texts,
    however long, then decodes the ids.

    n_bytes is the last token's end offset, n_split_chars the number of tokens that end within a
    character. Null texts count as empty; repeated rows give equal rows; other columns are ignored; an
    empty table gives an empty table.
    """
    return _texts(docs).mapInArrow(_rows(path, pattern or default_pattern()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, n_split_chars long")


def op3(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
