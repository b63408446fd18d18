"""Packing documents along a space-filling curve.

A document's token counts are hashed to random signs in a few dimensions. The
projected vector is a point, its Hilbert key a place on a curve that runs
close by for close points. Documents are range-sorted by key, and each range
is cut into sequences of ``LENGTH`` tokens in that order, so that a sequence
holds documents that resemble each other. Documents are cut where a sequence
ends; the last tokens of a range go to sequences whose lengths are powers of
two. No token is padding and none is left out.

Tokens come from a public byte-level vocabulary file.

Defined cases: a null text is empty and still has its end token; equal texts
are neighbours; repeated rows are documents of their own; an empty table gives
no sequences.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occgraph.llm.common import pieces
from occgraph.session import materialize

LENGTH = 1024
END = 0
DIMENSIONS = 4
BITS = 12
#: Fixed value: the pattern by which byte-level vocabularies of this kind cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters, digits and punctuation on which all regular expression engines agree.
_UNUSUAL = re.compile(r"[^ -~\n\t¡-¬®-ɏ‐-‧€]")


def merge_ranks(names: dict[str, int]) -> dict[bytes, int]:
    """Ranks of byte strings from the printable names of a byte-level vocabulary file."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    return {bytes(byte_of[c] for c in name): i for name, i in names.items() if all(c in byte_of for c in name)}


class Tokens:
    """Token ids of texts, as little-endian 16-bit arrays.

    The vocabulary file's merges are in the order of its ids, so a faster
    encoder with the same ranks gives the same ids. Texts with characters
    whose class may differ between engines, or that hold one of the file's added
    tokens, go through the file's own tokenizer.
    """

    def __init__(self, vocabulary: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = tuple(special)
        names = {n: i for n, i in self.tokenizer.get_vocab().items() if n not in special}
        if max(names.values()) >= 1 << 16:
            raise ValueError("ids must fit into 16 bits")
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=merge_ranks(names), special_tokens={})

    def ids(self, text: str) -> bytes:
        if not text.isascii() and _UNUSUAL.search(text) or any(c in text for c in _CONTROL) or any(t in text for t in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u2").tobytes()


_CONTROL = "".join(map(chr, [*range(9), *range(11, 32), 127]))


@functools.cache
def tokens_of(vocabulary: str) -> Tokens:
    """One for all tasks of a worker process."""
    return Tokens(vocabulary)


@functools.cache
def projection(dimensions: int, size: int = 1 << 16) -> np.ndarray:
    """A row of random signs for every token id, the hash that projects token counts; small ids, which are frequent, weigh little."""
    signs = np.random.default_rng(7).choice(np.array([-1, 1], np.float32), size=(size, dimensions))
    return signs * np.clip(np.arange(size, dtype=np.float32) / 5000, 0.02, 1)[:, None]


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of points with ``bits`` bits a coordinate (Skilling's transposed form), a row each."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, t)
            x[i] ^= t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t ^= np.where(x[n - 1] & (1 << b), (1 << b) - 1, 0)
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = key << 1 | ((v ^ t) >> b & 1)
    return key


def curve_keys(documents: list[np.ndarray], signs: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of documents' projected token counts, taken by the square root of their lengths."""
    vectors = np.zeros((len(documents), signs.shape[1]))
    for i, ids in enumerate(documents):
        for a in range(0, len(ids), 1 << 16):
            vectors[i] += signs[ids[a : a + (1 << 16)]].sum(axis=0)
        vectors[i] /= max(1.0, len(ids) ** 0.5)
    cells = np.clip((np.tanh(vectors) + 1) / 2 * (1 << bits), 0, (1 << bits) - 1)
    return hilbert_keys(cells.astype(np.int64), bits)


def tokenized(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """``doc_id``, ``curve`` (Hilbert key), ``ids`` (16-bit, the end token last)."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, signs = tokens_of(vocabulary), projection(dimensions)
        end = np.array([END], "<u2").tobytes()
        for batch in batches:
            for start, run in pieces(batch.column(1)):
                packed = [tokens.ids(t.decode("utf-8", "replace")) for t in run]
                keys = curve_keys([np.frombuffer(p, "<u2") for p in packed], signs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(run)), pa.array(keys, pa.int64()), pa.array([p + end for p in packed], pa.binary())],
                                                 ["doc_id", "curve", "ids"])

    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, curve long, ids binary"
    return kept.mapInArrow(mapped, schema)


def _cut(batches: Iterator[pa.RecordBatch], length: int, task: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Pieces of one range. The tokens of the unfinished sequence are held back until it is full or the range ends."""
    sequence, open_rows, used = 0, [], 0  # open_rows: (doc_id, start, ids, doc_tokens) of the unfinished sequence
    kind = None

    def rows_of(parts: list, sequence: int) -> list[tuple]:
        out, offset = [], 0
        for doc, start, ids, total in parts:
            out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, (task << 40) + sequence, offset, ids.tobytes() if with_ids else None))
            offset += len(ids)
        return out

    for batch in batches:
        kind = batch.schema.field(0).type
        for first in range(0, batch.num_rows, 512):
            some = batch.slice(first, 512)
            rows: list[tuple] = []
            for doc, packed in zip(some.column(0).to_pylist(), some.column(2).to_pylist(), strict=True):
                ids = np.frombuffer(packed, "<u2")
                at = 0
                while at < len(ids):
                    part = ids[at : at + length - used]
                    open_rows.append((doc, at, part, len(ids)))
                    at, used = at + len(part), used + len(part)
                    if used == length:
                        rows += rows_of(open_rows, sequence)
                        sequence, open_rows, used = sequence + 1, [], 0
            yield rows_batch(rows, kind)
    rows = []
    while used:  # what is left, in powers of two
        room = 1 << (used.bit_length() - 1)
        taken, used = [], used - room
        while room:
            doc, start, ids, total = open_rows.pop(0)
            if len(ids) > room:
                open_rows.insert(0, (doc, start + room, ids[room:], total))
                ids = ids[:room]
            taken.append((doc, start, ids, total))
            room -= len(ids)
        rows += rows_of(taken, sequence)
        sequence += 1
    if rows:
        yield rows_batch(rows, kind)


PIECE = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
         ("offset", pa.int64()), ("ids", pa.binary())]


def rows_batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type, *[t for _, t in PIECE]]
    columns = zip(*rows, strict=True) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", *[n for n, _ in PIECE]])


def pack(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, with_ids: bool = True, owner: str = "packing") -> DataFrame:
    """One row a piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, ``ids`` (null if not asked for)."""
    if length & (length - 1):
        raise ValueError("the sequence length must be a power of two")
    # written once: drawing the ranges reads it a first time
    rows = materialize(tokenized(docs, vocabulary, doc_id, text), owner)
    ordered = rows.repartitionByRange("curve", "doc_id", F.xxhash64("ids")).sortWithinPartitions("curve", "doc_id", F.xxhash64("ids"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield from _cut(batches, length, TaskContext.get().partitionId(), with_ids)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return ordered.mapInArrow(mapped, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
