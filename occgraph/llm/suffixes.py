"""Removal of repeated passages by a distributed merge sort of suffixes.

A byte goes if it lies in a string of ``MIN_BYTES`` bytes that also starts
anywhere else. Suffixes (their first ``MIN_BYTES`` bytes) are sorted, and a
suffix repeats if it shares that many bytes with a neighbour in the order.

*Which suffixes.* Sorting one for every byte isn't needed. Each window of
``MIN_BYTES`` bytes takes the least hash among its first ``WINDOW`` places as
its anchor; equal windows have equal anchors, and neighbouring windows share
one: a unit. What every window of a unit contains, its core, is hashed; a unit
whose core is nowhere else has no repeated window. Of units with equal cores
those with equal bytes throughout are one entry with a multiplicity, so
thousands of copies cost one suffix. Units that share the core but not all,
at the ends of a passage, are cut into pieces of ``FINE`` windows and go
through the same once more; what is then still unequal is entered with a
suffix for each of its windows. Hashes only rule out and collapse; whether an
entry repeats is read from the sorted order.

*The sort.* Each task sorts its suffixes into a run, cuts the run at sampled
splitters and front-codes the parts: of each suffix only what differs from the
one before. A bucket's parts are merged by a loser tree that knows, for every
suffix, how many bytes it shares with the last one given out: suffixes are
compared from there on, or not at all when these numbers differ. The numbers
of the winners are the shared lengths of neighbours that the result needs.
Equal suffixes are in one bucket, as the cuts are whole suffixes.

*Words.* ``words_without_repeats`` asks the same of words: a word goes if it lies
in a run of ``MIN_WORDS`` words that also starts anywhere else, whatever white
space is between them. A text is written as its words' 64-bit hashes, 8 bytes
each, and goes through the sort above in windows of 8 * ``MIN_WORDS`` bytes.

Defined cases: null texts are empty; texts shorter than a window lose
nothing; repeated rows repeat each other and lose all they hold; long texts
are cut into units as others are.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occgraph.llm.common import free_name, marked, pieces
from occgraph.session import clear_materialized, materialize

MIN_BYTES = 400
MIN_WORDS = 50
WINDOW = 128
FINE = 16
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
RUN = 32_768
BUCKET = 131_072


# --- units ---------------------------------------------------------------------

def units(text: bytes, size: int = MIN_BYTES, window: int = WINDOW) -> tuple[list[int], list[int], list[int]]:
    """Anchor, first window and last window of each unit of a text."""
    n = len(text) - size + 1
    if n < 1:
        return [], [], []
    places = n + window - 1
    hashed = np.ndarray((places,), "<u8", text, 0, (1,)) * np.uint64(0x9E3779B97F4A7C15)
    hashed ^= hashed >> np.uint64(29)
    hashed *= np.uint64(0xBF58476D1CE4E5B9)
    hashed &= np.uint64(0xFFFFFFFF00000000)
    hashed |= np.arange(places, dtype=np.uint64)
    step = 1
    while step < window:  # a power of two: the least over twice as many places
        hashed = np.minimum(hashed[:-step], hashed[step:])
        step *= 2
    anchor = (hashed[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edge = np.flatnonzero(np.diff(anchor)) + 1
    first = np.concatenate([[0], edge])
    return anchor[first].tolist(), first.tolist(), np.concatenate([edge - 1, [n - 1]]).tolist()


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _unit_rows(size: int, code: Callable[[bytes], bytes]):
    digest = xxhash.xxh3_64_intdigest

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, run in pieces(batch.column(2)):
                own: list[tuple] = []
                counts = []
                for text in map(code, run):
                    anchors, first, last = units(text, size)
                    counts.append(len(anchors))
                    own += [(_signed(digest(text[a : a + size - WINDOW + 1])), _signed(digest(text[lo : hi + size])), lo, hi - lo + 1, WINDOW - (a - lo))
                            for a, lo, hi in zip(anchors, first, last, strict=True)]
                rows = np.repeat(np.arange(start, start + len(run)), counts)
                columns = zip(*own, strict=True) if own else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)),
                     *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int16()), strict=True)]],
                    ["t1", "t2", "core", "content", "lo", "n", "shift"])

    return mapped


def _classes(rows: DataFrame, rep: list[str], owner: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose core is not alone, and one row a (core, content).

    The latter has its multiplicity ``mult``, a representative, a number
    ``entry`` and ``dense``: are there other contents with this core, and is
    any of them single?
    """
    shared = rows.groupBy("core").agg(F.sum("mult").alias("times")).filter("times > 1").select("core")
    # written first: a join of two plain tables may split a core that a third of all rows have
    shared, met = materialize(shared, owner), free_name(rows, "core_is_shared")
    members = materialize(marked(rows, ["core"], shared, met).filter(met).drop(met).join(shared, "core"), owner)
    kinds = members.groupBy("core", "content").agg(F.sum("mult").alias("mult"), F.min(F.struct(*rep)).alias("rep"))
    kinds = materialize(kinds, owner)
    groups = kinds.groupBy("core").agg((F.count("*") > 1).alias("many"), F.min("mult").alias("least"))
    classes = kinds.join(groups, "core").select(
        "core", "content", "mult", "rep.*", (F.col("many") & (F.col("least") == 1)).alias("dense"), F.monotonically_increasing_id().alias("entry"))
    return members, materialize(classes, owner)


def _rows_by_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), F.col("text")).alias("t2"), "text")


def _texts_of(docs: DataFrame, classes: DataFrame, size: int, owner: str, code: Callable[[bytes], bytes]) -> DataFrame:
    """``entry``, ``mult``, ``n``, ``dense`` and the bytes of each class: all of its unit, or its first window if not dense."""
    wanted = classes.groupBy("t1", "t2").agg(F.collect_list(F.struct("entry", "mult", "lo", "n", "shift", "dense")).alias("units"))
    some = marked(docs, ["t1", "t2"], classes.select("t1", "t2"), "has_units").filter("has_units").drop("has_units")
    found = some.join(wanted, ["t1", "t2"]).dropDuplicates(["t1", "t2"]).select("text", "units")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, run in pieces(batch.column(0)):
                rows = [(u["entry"], u["mult"], u["n"], u["shift"], u["dense"], text[u["lo"] : u["lo"] + size - 1 + (u["n"] if u["dense"] else 1)])
                        for text, own in zip(map(code, run), batch.column(1).slice(start, len(run)).to_pylist(), strict=True) for u in own]
                yield _batch(rows, [("entry", pa.int64()), ("mult", pa.int64()), ("n", pa.int32()), ("shift", pa.int16()), ("dense", pa.bool_()), ("bytes", pa.binary())])

    return materialize(found.mapInArrow(mapped, "entry long, mult long, n int, shift short, dense boolean, bytes binary"), owner)


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _fine_rows(size: int):
    """Pieces of ``FINE`` windows of dense units, counted from the anchor, since equal windows lie equally far from theirs.

    A piece's core is what all windows of its place in the count contain, whether or not the unit has them all.
    """
    digest = xxhash.xxh3_64_intdigest

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for unit, n, shift, text, mult in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                at = 0
                while at < n:
                    upto = min(n, at + FINE - (at + shift) % FINE)
                    body = text[at : upto - 1 + size]
                    core_from = at + FINE - (at + shift) % FINE - 1
                    rows.append((unit, at, upto - at, mult, _signed(digest(text[core_from : core_from + size - FINE + 1])), _signed(digest(body))))
                    at = upto
            yield _batch(rows, [("unit", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("mult", pa.int64()), ("core", pa.int64()), ("content", pa.int64())])

    return mapped


# --- runs, splitters, merge -------------------------------------------------------

def shared_lengths(ordered: np.ndarray) -> np.ndarray:
    """Of each row of a matrix of sorted strings, the bytes it shares with the row before; 0 for the first."""
    out = np.zeros(len(ordered), np.uint16)
    for i in range(1, len(ordered), 4096):
        here = ordered[i : i + 4096]
        differs = here != ordered[i - 1 : i - 1 + len(here)]
        first = differs.argmax(axis=1)
        out[i : i + len(here)] = np.where(differs[np.arange(len(here)), first], first, ordered.shape[1])
    return out


def front_code(strings: list[bytes], shared: np.ndarray, ids: np.ndarray, places: np.ndarray) -> bytes:
    """A run's part: for each string only what follows the bytes it shares with the one before."""
    if len(strings):
        shared = shared.copy()
        shared[0] = 0
    tails = b"".join([s[h:] for s, h in zip(strings, shared.tolist(), strict=True)])
    body = np.uint32(len(strings)).tobytes() + ids.astype("<i8").tobytes() + places.astype("<u2").tobytes() + shared.astype("<u2").tobytes() + tails
    return zstandard.ZstdCompressor(level=1).compress(body)


def read_part(part: bytes, size: int) -> Iterator[tuple[int, bytes, int, int]]:
    """(bytes shared with the one before, string, id, place) of a front-coded part, in order."""
    body = zstandard.ZstdDecompressor().decompress(part)
    n = int(np.frombuffer(body, "<u4", 1)[0])
    ids = np.frombuffer(body, "<i8", n, 4).tolist()
    places = np.frombuffer(body, "<u2", n, 4 + 8 * n).tolist()
    shared = np.frombuffer(body, "<u2", n, 4 + 10 * n).tolist()
    at, last = 4 + 12 * n, b""
    for h, i, p in zip(shared, ids, places, strict=True):
        last = last[:h] + body[at : at + size - h]
        at += size - h
        yield h, last, i, p


def _mismatch(a: bytes, b: bytes, known: int) -> int:
    """Bytes that two strings of equal length share, from ``known`` on."""
    x, y = a[known:], b[known:]
    if x[:16] == y[:16] and x == y:
        return len(a)
    if x[:16] != y[:16]:
        x, y = x[:16], y[:16]
    return known + len(x) - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) // 8


def merge(parts: list[Iterator[tuple[int, bytes, int, int]]]) -> Iterator[tuple[int, int, int]]:
    """Merge sorted runs; (shared bytes with the one given out before, id, place).

    A loser tree. ``known[r]`` is how many bytes run r's next string shares
    with the string its path's winner gave out: more means smaller, and only
    equal numbers lead to a comparison, from that byte on.
    """
    k = 1
    while k < len(parts):
        k *= 2
    heads: list[tuple[int, bytes, int, int] | None] = [next(p, None) for p in parts] + [None] * (k - len(parts))
    known = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = heads[a], heads[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        h, g = known[a], known[b]
        if h > g:
            return a, b
        if g > h:
            return b, a
        s, t = x[1], y[1]
        m = _mismatch(s, t, h)
        if m == len(s) or s[m] < t[m]:
            known[b] = m
            return a, b
        known[a] = m
        return b, a

    losers, winners = [0] * k, list(range(k))
    level = k
    while level > 1:
        level //= 2
        for node in range(level):
            winners[node], losers[level + node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[0]
    while heads[best] is not None:
        yield known[best], heads[best][2], heads[best][3]
        heads[best] = following = next(parts[best], None)
        known[best] = following[0] if following else 0
        node = (best + k) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2


def repeated_suffixes(entries: DataFrame, size: int = MIN_BYTES, owner: str = "suffixes") -> DataFrame:
    """``entry``, ``place`` of suffixes that share ``size`` bytes with another.

    ``entries``: ``bytes`` and ``spans`` (array of ``at``, ``n``, ``entry``,
    ``twice``): the suffixes of ``n`` places of the bytes from ``at`` on, each
    standing for more than one if ``twice``.
    """
    total = entries.agg(F.sum(F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["n"]))).first()[0] or 0
    buckets = -(-total // BUCKET) or 1
    one_in = max(1, total // (256 * buckets))

    def strings(batch: pa.RecordBatch) -> Iterator[tuple[bytes, int, int]]:
        for text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for x in spans:
                for place in range(x["n"]):
                    yield text[x["at"] + place : x["at"] + place + size], 2 * x["entry"] + x["twice"], place

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked = [s for s, i, place in strings(batch) if xxhash.xxh32_intdigest(s) % one_in == 0]
            yield pa.RecordBatch.from_arrays([pa.array(picked, pa.binary())], ["s"])

    splitters: list[bytes] = []
    if buckets > 1:  # about 256 strings a bucket
        sample = sorted(bytes(r[0]) for r in entries.select("bytes", "spans").mapInArrow(sampled, "s binary").distinct().collect())
        splitters = [sample[len(sample) * i // buckets] for i in range(1, buckets)] if len(sample) >= buckets else sample
    cuts = sorted(set(splitters))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, int]] = []

        def written() -> pa.RecordBatch:
            held.sort()
            ordered = [x[0] for x in held]
            shared = shared_lengths(np.frombuffer(b"".join(ordered), np.uint8).reshape(-1, size))
            ids, places = np.array([x[1] for x in held], np.int64), np.array([x[2] for x in held])
            edges = [0, *[bisect_left(ordered, c) for c in cuts], len(held)]
            rows = [(bucket, front_code(ordered[i:j], shared[i:j], ids[i:j], places[i:j]))
                    for bucket, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if i < j]
            return _batch(rows, [("bucket", pa.int32()), ("part", pa.binary())])

        for batch in batches:
            for row in strings(batch):
                held.append(row)
                if len(held) == RUN:
                    yield written()
                    held = []
        if held:
            yield written()

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        before, given = (0, 0), True  # the last suffix, and whether it needs no more telling
        for h, number, place in merge([read_part(p, size) for p in table.column("part").to_pylist()]):
            again = h >= size
            if again and not given:
                out.append(before)
            before, given = (number >> 1, place), again or bool(number & 1)
            if given:
                out.append(before)
        return pa.Table.from_batches([_batch(out, [("entry", pa.int64()), ("place", pa.int32())])])

    parts = entries.select("bytes", "spans").mapInArrow(runs, "bucket int, part binary")
    return parts.groupBy("bucket").applyInArrow(merged, "entry long, place int")


# --- the whole ----------------------------------------------------------------------

def _code(start: Column, end: Column) -> Column:
    """A span as one number, so that spans of a text sort as numbers do."""
    return F.shiftleft(start.cast("long"), 32).bitwiseOR(end.cast("long"))


def joined_spans(codes: np.ndarray) -> np.ndarray:
    """Spans in order, with overlapping and touching ones made one."""
    codes = np.sort(codes)
    start, end = codes >> 32, np.maximum.accumulate(codes & 0xFFFFFFFF)
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new] << 32 | end[np.concatenate([new[1:], [True]])]


def _span_lists(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key its ``span`` numbers in order and joined: ``spans``. There are at most as many as the text has bytes."""
    lists = rows.groupBy(*keys).agg(F.collect_set("span").alias("spans"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined = [joined_spans(x.values.to_numpy()) for x in batch.column(len(keys))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(joined, pa.list_(pa.int64()))], [*keys, "spans"])

    return lists.select(*keys, "spans").mapInArrow(mapped, lists.select(*keys, "spans").schema)


def _start() -> Column:
    return F.shiftright("code", 32)


def _end() -> Column:
    return F.col("code").bitwiseAND(F.lit(0xFFFFFFFF))


def repeated_spans(docs: DataFrame, size: int = MIN_BYTES, owner: str = "suffixes", code: Callable[[bytes], bytes] = bytes) -> DataFrame:
    """``t1``, ``t2`` (hashes of a text) and ``spans`` of the bytes that repeat, for every text that has any.

    ``docs`` has one column, ``text``. With ``code`` the bytes are those that it makes of a text.
    """
    texts = _rows_by_text(docs)
    all_units = materialize(texts.mapInArrow(_unit_rows(size, code), "t1 long, t2 long, core long, content long, lo int, n int, shift short").withColumn(
        "mult", F.lit(1).cast("long")), f"{owner}_units")
    members, classes = _classes(all_units, ["t1", "t2", "lo", "n", "shift"], owner)
    clear_materialized(docs.sparkSession, f"{owner}_units")  # most of them are nowhere else; the others are in members
    found = _texts_of(texts, classes, size, owner, code)
    dense = found.filter("dense").select("entry", "n", "shift", "bytes", "mult")
    fine_rows = materialize(dense.mapInArrow(_fine_rows(size), "unit long, at int, n int, mult long, core long, content long"), owner)
    fine_members, fine = _classes(fine_rows, ["unit", "at", "n"], owner)

    twice = F.col("mult") > 1
    whole = found.filter("NOT dense").select("bytes", F.array(F.struct(
        F.lit(0).alias("at"), F.lit(1).alias("n"), F.col("entry").alias("entry"), twice.cast("int").alias("twice"))).alias("spans"))
    span = F.struct("at", F.when(F.col("dense"), F.col("n")).otherwise(F.lit(1)).alias("n"), (-1 - F.col("entry")).alias("entry"), twice.cast("int").alias("twice"))
    fine_spans = fine.groupBy(F.col("unit").alias("entry")).agg(F.collect_list(span).alias("spans"))
    parts = found.filter("dense").select("entry", "bytes").join(fine_spans, "entry").select("bytes", "spans")
    hits = materialize(repeated_suffixes(materialize(whole.unionByName(parts), owner), size, owner), owner)

    # back from entries to pieces, from pieces to units, from units to texts
    fine_hits = hits.filter("entry < 0").select((-1 - F.col("entry")).alias("entry"), "place").join(fine.select("entry", "core", "content", "n", "dense"), "entry")
    last = F.when(F.col("dense"), F.col("place")).otherwise(F.col("n") - 1)
    piece_spans = _span_lists(fine_hits.select("core", "content", _code(F.col("place"), last + size).alias("span")), ["core", "content"])
    in_units = fine_members.select("unit", "at", "core", "content").join(piece_spans, ["core", "content"]).select(
        F.col("unit").alias("entry"), "at", F.explode("spans").alias("code")).select("entry", _code(F.col("at") + _start(), F.col("at") + _end()).alias("span"))
    whole_hits = hits.filter("entry >= 0").join(classes.select("entry", "n"), "entry").select("entry", _code(F.lit(0), F.col("n") - 1 + size).alias("span"))
    unit_spans = _span_lists(whole_hits.unionByName(in_units), ["entry"])
    by_content = materialize(unit_spans.join(classes.select("entry", "core", "content"), "entry").select("core", "content", "spans"), owner)
    places = members.select("t1", "t2", "lo", "core", "content").join(by_content, ["core", "content"]).select(
        "t1", "t2", "lo", F.explode("spans").alias("code")).select("t1", "t2", _code(F.col("lo") + _start(), F.col("lo") + _end()).alias("span"))
    return materialize(_span_lists(places, ["t1", "t2"]), owner)


def without_repeats(docs: DataFrame, text: str = "text", size: int = MIN_BYTES, into: str = "repeats", owner: str = "suffixes") -> DataFrame:
    """All columns of ``docs`` (but one called ``into``) and ``into``: the spans of bytes that go (start times 2^32 plus end, in order; null for none)."""
    docs = docs.drop(into)
    return _with_spans(docs, text, repeated_spans(docs.select(F.col(text).alias("text")), size, owner), into)


def _with_spans(docs: DataFrame, text: str, spans: DataFrame, into: str) -> DataFrame:
    h1, h2 = free_name(docs, "text_hash_1"), free_name(docs, "text_hash_2")
    found = spans.select(F.col("t1").alias(h1), F.col("t2").alias(h2), F.col("spans").alias(into))
    keyed = docs.withColumns({h1: F.xxhash64(F.col(text)), h2: F.xxhash64(F.lit(1), F.col(text))})
    met = free_name(keyed, "has_spans")
    split = marked(keyed, [h1, h2], found.select(h1, h2), met)
    without = split.filter(~F.col(met)).select(*docs.columns, F.lit(None).cast(found.schema[into].dataType).alias(into))
    return split.filter(met).join(found, [h1, h2], "left").select(*docs.columns, into).unionByName(without)


def kept_bytes(text: bytes, spans: list[int] | None) -> bytes:
    if spans is None or not len(spans):
        return text
    edges = [0, *[int(x) for s in spans for x in (s >> 32, s & 0xFFFFFFFF)], len(text)]
    return b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])


def removal_digest(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``kept_text`` of rows with ``doc_id``, ``text``, ``repeats``.

    The hash is of the remaining bytes; in ``kept_text`` characters cut in two are dropped.
    """

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, run in pieces(batch.column(1)):
                out = []
                for doc, text, spans in zip(batch.column(0).slice(start, len(run)).to_pylist(), run, batch.column(2).slice(start, len(run)).to_pylist(), strict=True):
                    kept = kept_bytes(text, spans)
                    out.append((doc, len(text), len(text) - len(kept), len(spans or ()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
                yield _batch(out, [("doc_id", batch.schema.field(0).type), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "repeats").mapInArrow(mapped, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def cut_text(text: str = "text", repeats: str = "repeats") -> Column:
    """The text without its repeated bytes, as a column; characters cut in two are dropped."""
    @F.pandas_udf("string")
    def cut(column: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None else kept_bytes(t.encode(), s).decode("utf-8", "ignore")
                          for t, s in zip(column, spans, strict=True)], dtype=object)

    return F.when(F.col(repeats).isNull(), F.col(text)).otherwise(cut(F.col(text), F.col(repeats)))


# --- windows of words ---------------------------------------------------------------

_CODE = 8


def word_codes(text: bytes) -> bytes:
    """The hashes of a text's words, 8 bytes each."""
    return b"".join(map(xxhash.xxh3_64_digest, text.split()))


def words_without_repeats(docs: DataFrame, text: str = "text", words: int = MIN_WORDS, into: str = "repeats", owner: str = "suffixes") -> DataFrame:
    """Like ``without_repeats``, by windows of words: the spans are numbers of words (start times 2^32 plus end, in order; null for none)."""
    whole = lambda s: F.shiftleft(F.ceil(F.shiftright(s, 32) / _CODE).cast("long"), 32).bitwiseOR(F.floor(s.bitwiseAND(F.lit(0xFFFFFFFF)) / _CODE).cast("long"))
    # a part of a word's hash may be shared by chance: only whole words count
    spans = repeated_spans(docs.select(F.col(text).alias("text")), words * _CODE, owner, word_codes).withColumn("spans", F.transform("spans", whole))
    return _with_spans(docs.drop(into), text, spans, into)


def kept_words(text: bytes, spans: list[int] | None) -> bytes:
    """The text without the words of the spans and the white space after them."""
    if spans is None or not len(spans):
        return text
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    return kept_bytes(text, [starts[s >> 32] << 32 | starts[s & 0xFFFFFFFF] for s in map(int, spans)])


def cut_words(text: str = "text", repeats: str = "repeats") -> Column:
    """The text without its repeated words, as a column."""
    @F.pandas_udf("string")
    def cut(column: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None else kept_words(t.encode(), s).decode() for t, s in zip(column, spans, strict=True)], dtype=object)

    return F.when(F.col(repeats).isNull(), F.col(text)).otherwise(cut(F.col(text), F.col(repeats)))
