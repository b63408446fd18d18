"""A hidden Markov language model over whole texts.

Every token has a class: frequent words one of their own, other words one by
their spelling (first and last letters), the end of a text its own. Hidden
states emit classes, and a class emits its words by their counts in the
training texts (Witten-Bell: a class's distinct words are its mass for words
never seen). The probability of a text is the sum over all state paths, which
the scaled forward recursion computes exactly, times the words' shares in
their classes.

Baum-Welch runs over all training texts: each task adds up the expected
transitions and emissions of its texts, the tasks' sums are added in groups,
and one model of fixed size comes to the driver. The first model is clustered
from a bounded sample, ``SEED_TEXTS`` texts.

Words outside the ``HEAD`` most frequent ones are looked up by a join, so the
vocabulary may be as large as the corpus makes it.

Defined cases: a null text is empty and consists of its end; a null id counts
as empty text when rows are dealt to training and held-out; repeated rows each
count and each get a score; without training texts every word is unknown.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occgraph.llm.common import pieces
from occgraph.session import materialize

STATES = 6
ROUNDS = 4
OWN = 3000  # words with a class of their own
SPELLINGS = 1024
CLASSES = OWN + SPELLINGS + 1
END = CLASSES - 1
HEAD = 65_536
SEED_TEXTS = 2000
SEED_TOKENS = 4000
BATCH_TOKENS = 1 << 20
FLUSH = 500_000


@dataclass
class Model:
    start: np.ndarray  # (states,)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (classes, states)


@dataclass
class Words:
    """What coding needs of the vocabulary: bounded tables."""

    head: dict[bytes, tuple[int, int]]  # word -> (class, count)
    class_total: np.ndarray  # by spelling: tokens + distinct words
    class_kinds: np.ndarray  # by spelling: distinct words
    tokens: int  # training tokens, ends included
    kinds: int  # distinct training tokens
    texts: int  # training texts


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def spelling(word: bytes) -> int:
    """Class of a word by its first letter and its last two, and whether it has other than ASCII letters."""
    core = word.strip(b".,;:!?\"'()[]")
    return OWN + xxhash.xxh32_intdigest(core[:1] + b"|" + core[-3:] + (b"|" if core.isascii() else b"+")) % SPELLINGS


# --- vocabulary ------------------------------------------------------------------

def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def written() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for _, run in pieces(batch.column(0)):
            for text in run:
                held.update(text.lower().split())
            if len(held) > FLUSH:
                yield written()
                held.clear()
    yield written()


def _by_spelling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, kinds = np.zeros(SPELLINGS, np.int64), np.zeros(SPELLINGS, np.int64)
    for batch in batches:
        codes = np.array([spelling(w) - OWN for w in batch.column(0).cast(pa.binary()).to_pylist()], np.int64)
        np.add.at(total, codes, batch.column(1).to_numpy())
        np.add.at(kinds, codes, 1)
    yield pa.RecordBatch.from_arrays([pa.array(range(SPELLINGS), pa.int32()), pa.array(total), pa.array(kinds)], ["spelling", "tokens", "kinds"])


def vocabulary(docs: DataFrame, owner: str) -> tuple[DataFrame, Words]:
    """``word``, ``n`` of the training texts, and the bounded tables. ``docs``: ``text``, ``held_out``."""
    training = docs.filter("NOT held_out")
    vocab = materialize(training.select("text").mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), owner)
    texts = training.count()
    # words by their counts: at most HEAD counts, and then the words above the last count that all fit in
    by_count = vocab.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(HEAD).collect()
    least, room = None, HEAD
    for r in by_count:
        room -= r["words"]
        if room < 0:
            break
        least = r["n"]
    top = [] if least is None else sorted(vocab.filter(F.col("n") >= least).collect(), key=lambda r: (-r["n"], r["word"]))
    sums = vocab.agg(F.sum("n"), F.count("*")).first()
    own = [r["word"] for r in top[:OWN]]
    head = {r["word"].encode(): (i if i < OWN else spelling(r["word"].encode()), r["n"]) for i, r in enumerate(top)}
    lone = vocab.mapInArrow(_by_spelling, "spelling int, tokens long, kinds long").groupBy("spelling").agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds"))
    total, kinds = np.zeros(SPELLINGS, np.int64), np.zeros(SPELLINGS, np.int64)
    for r in lone.collect():
        total[r["spelling"]], kinds[r["spelling"]] = r["tokens"], r["kinds"]
    for word in own:  # these are not words of their spelling's class
        at = spelling(word.encode()) - OWN
        total[at] -= head[word.encode()][1]
        kinds[at] -= 1
    return vocab, Words(head, total + kinds, kinds, (sums[0] or 0) + texts, sums[1] + (texts > 0), texts)


# --- coding ------------------------------------------------------------------------

def _coded(words: Words):
    total = np.log10(np.maximum(words.class_total, 1)).tolist()
    own_ends = float(np.log10(words.texts + 1))
    # by word: its class, log10 of its count and one, log10 of its share in its class
    scores = {w: (code, math.log10(n + 1), 0.0 if code < OWN else math.log10(n) - total[code - OWN]) for w, (code, n) in words.head.items()}

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_class: dict[bytes, int] = {}
        get = scores.get
        for batch in batches:
            for start, run in pieces(batch.column(1)):
                rows = []
                for text in run:
                    tokens = text.lower().split()
                    counts = Counter(tokens)
                    number: dict[bytes, int] = {}
                    base = share = 0.0
                    known = 0
                    tail: list[tuple[bytes, int, int]] = []
                    for word, times in counts.items():
                        found = get(word)
                        if found is not None:
                            code, log_count, log_share = found
                            known += times
                            base += times * log_count
                            share += times * log_share
                        else:
                            code = known_class.get(word)
                            if code is None:
                                if len(known_class) > 300_000:
                                    known_class.clear()
                                code = known_class[word] = spelling(word)
                            share -= times * total[code - OWN]
                            tail.append((word, code, times))
                        number[word] = code
                    codes = np.fromiter(map(number.__getitem__, tokens), np.uint16, len(tokens))
                    rows.append((np.append(codes, np.uint16(END)).tobytes(), len(tokens) + 1, known + (words.texts > 0), base + own_ends, share,
                                 [t[0].decode("utf-8", "replace") for t in tail], [t[1] for t in tail], [t[2] for t in tail]))
                own = list(zip(*rows, strict=True))
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int16()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(run)), batch.column(2).slice(start, len(run)), *[pa.array(c, t) for c, t in zip(own, kinds, strict=True)]],
                    ["doc_id", "held_out", "codes", "n_tokens", "head_known", "head_base", "share", "tail", "tail_class", "tail_times"])

    return mapped


def coded(docs: DataFrame, words: Words, owner: str) -> DataFrame:
    """Rows with their class codes, what the head's words add to the scores, and the other words to look up."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", "held_out").mapInArrow(
        _coded(words), f"doc_id {kind}, held_out boolean, codes binary, n_tokens long, head_known long, head_base double, share double, "
        "tail array<string>, tail_class array<short>, tail_times array<int>")
    return materialize(rows.withColumn("row_of_copy", F.monotonically_increasing_id()), owner)


# --- the recursions --------------------------------------------------------------------

def _time_major(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, longest first, laid out step by step: codes, the steps' offsets, and which text stands where in each step."""
    lengths = np.array([len(c) for c in codes])
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
    offsets = np.concatenate([[0], np.cumsum(active)])
    flat = np.concatenate([codes[i] for i in order])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    step = np.arange(len(flat)) - np.repeat(starts, lengths)
    laid = np.empty(len(flat), np.int64)
    laid[offsets[step] + np.repeat(np.arange(len(lengths)), lengths)] = flat
    return laid, offsets, order


def forward(model: Model, laid: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward probabilities, the scales, and each text's log likelihood (natural, in laid-out order)."""
    alpha = model.emit[laid]
    scale = np.empty(len(laid))
    for t in range(len(offsets) - 1):
        a, b = offsets[t], offsets[t + 1]
        here = alpha[a:b]
        here *= model.start if t == 0 else alpha[offsets[t - 1] : offsets[t - 1] + b - a] @ model.move
        total = here.sum(axis=1)
        here /= total[:, None]
        scale[a:b] = total
    logs = np.log(scale)
    place = np.arange(len(laid)) - np.repeat(offsets[:-1], np.diff(offsets))
    return alpha, scale, np.bincount(place, weights=logs, minlength=n)


def expected_counts(model: Model, laid: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions of the texts under the model."""
    alpha, scale, _ = forward(model, laid, offsets, n)
    states = len(model.start)
    moves = np.zeros((states, states))
    beta = np.ones((0, states))
    for t in range(len(offsets) - 2, -1, -1):
        a, b = offsets[t], offsets[t + 1]
        going = len(beta)  # texts that go on
        after = np.ones((b - a, states))
        if going:
            nxt = slice(offsets[t + 1], offsets[t + 1] + going)
            weighed = model.emit[laid[nxt]] * beta / scale[nxt, None]
            after[:going] = weighed @ model.move.T
            moves += alpha[a : a + going].T @ weighed
        beta = after
        alpha[a:b] *= after  # now the states' probabilities given the whole text
    emitted = np.stack([np.bincount(laid, weights=alpha[:, k], minlength=CLASSES) for k in range(states)], axis=1)
    return alpha[: offsets[1]].sum(axis=0), moves * model.move, emitted


def _code_batches(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    start, held, size = 0, [], 0
    for i, x in enumerate(batch.column(column).to_pylist()):
        held.append(np.frombuffer(x, np.uint16))
        size += len(held[-1])
        if size >= BATCH_TOKENS:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


def _maximized(start: np.ndarray, moves: np.ndarray, emitted: np.ndarray) -> Model:
    start, moves, emitted = start + 0.1, moves + 0.1, emitted + 0.01
    return Model(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emitted / emitted.sum(axis=0))


def first_model(sample: list[np.ndarray], states: int) -> Model:
    """States from clusters of texts: seeds far from each other, then a few rounds of nearest centres."""
    if not sample:
        return Model(np.full(states, 1 / states), np.full((states, states), 1 / states), np.full((CLASSES, states), 1 / CLASSES))
    counts = np.stack([np.bincount(c[:SEED_TOKENS], minlength=CLASSES) for c in sample]).astype(np.float32)
    points = np.sqrt(counts / counts.sum(axis=1, keepdims=True))
    seeds = [int(counts.sum(axis=1).argmax())]
    near = points @ points[seeds[0]]
    long = counts.sum(axis=1) >= min(100, np.median(counts.sum(axis=1)))
    for _ in range(states - 1):
        seeds.append(int(np.where(long, near, 2).argmin()))
        near = np.maximum(near, points @ points[seeds[-1]])
    centres = points[seeds]
    for _ in range(8):
        own = (points @ centres.T).argmax(axis=1)
        centres = np.stack([np.sqrt((s := counts[own == k].sum(axis=0) + 0.01) / s.sum()) for k in range(states)])
    emitted = np.stack([counts[own == k].sum(axis=0) for k in range(states)], axis=1).astype(np.float64) + 0.05
    move = np.full((states, states), 0.02 / max(1, states - 1)) + np.eye(states) * 0.98
    start = np.bincount(own, minlength=states) + 1.0
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emitted / emitted.sum(axis=0))


GROUPS = 32


def train(rows: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all rows with ``codes`` that aren't held out."""
    training = rows.filter("NOT held_out")
    # the least hashes; those that can't be among them stay where they are
    some = min(1.0, 2 * SEED_TEXTS / max(1, training.count()))
    hashed = training.select("codes", F.xxhash64("row_of_copy").alias("h")).filter(F.col("h") <= min((1 << 63) - 1, int(some * (1 << 64)) - (1 << 63)))
    sample = hashed.orderBy("h").limit(SEED_TEXTS).select(F.substring("codes", 1, 2 * SEED_TOKENS)).collect()
    model = first_model([np.frombuffer(bytes(r[0]), np.uint16) for r in sample], states)
    width = states + states * states + CLASSES * states

    for _ in range(rounds):
        def counted(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(width)
            for batch in batches:
                for _, codes in _code_batches(batch, 0):
                    laid, offsets, _ = _time_major(codes)
                    sums += np.concatenate([x.ravel() for x in expected_counts(model, laid, offsets, len(codes))])
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

        def added(table: pa.Table) -> pa.Table:
            total = np.zeros(width)
            for x in table.column("sums").to_pylist():
                total += np.frombuffer(x)
            return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})

        parts = training.select("codes").mapInArrow(counted, "sums binary").withColumn("part", F.spark_partition_id() % GROUPS)
        total = np.zeros(width)
        for r in parts.groupBy("part").applyInArrow(added, "sums binary").collect():  # at most GROUPS models
            total += np.frombuffer(r[0])
        start, moves, emitted = np.split(total, [states, states + states * states])
        model = _maximized(start, moves.reshape(states, states), emitted.reshape(CLASSES, states))
    return model


def likelihoods(rows: DataFrame, model: Model) -> DataFrame:
    """All columns but the codes and words, and ``path_log10``: log10 of the summed probability of all state paths."""
    out = ["doc_id", "held_out", "n_tokens", "head_known", "head_base", "share", "row_of_copy"]
    schema = rows.select(*out, F.lit(0.0).alias("path_log10")).schema

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs: list[np.ndarray] = [np.zeros(0)]
            for _, codes in _code_batches(batch, len(out)):
                laid, offsets, order = _time_major(codes)
                found = np.empty(len(codes))
                found[order] = forward(model, laid, offsets, len(codes))[2]
                logs.append(found / np.log(10))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(out)], pa.array(np.concatenate(logs))], [*out, "path_log10"])

    return rows.select(*out, "codes").mapInArrow(mapped, schema)


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS, owner: str = "hmm") -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` for every row."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held_out(F.col(doc_id)).alias("held_out"))
    vocab, words = vocabulary(docs, owner)
    rows = coded(docs, words, owner)
    model = train(rows, states, rounds)
    kinds = docs.sparkSession.createDataFrame([(OWN + i, float(np.log10(max(1, k)))) for i, k in enumerate(words.class_kinds.tolist())], "tail_class short, unknown double")
    tail = rows.select("row_of_copy", F.explode(F.arrays_zip("tail", "tail_class", "tail_times")).alias("x")).select(
        "row_of_copy", F.col("x.tail").alias("word"), F.col("x.tail_class").alias("tail_class"), F.col("x.tail_times").alias("times"))
    looked_up = tail.join(vocab, "word", "left").join(F.broadcast(kinds), "tail_class")  # one row a spelling
    sums = looked_up.groupBy("row_of_copy").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("base"),
        F.sum(F.col("times") * F.when(F.col("n").isNull(), F.col("unknown")).otherwise(F.log10("n"))).alias("tail_share"))
    scored = likelihoods(rows, model).join(sums, "row_of_copy", "left")
    every = float(np.log10(words.tokens + words.kinds + 1))
    nothing = F.lit(0.0)
    return scored.select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("base", nothing) - F.col("n_tokens") * every).alias("base_score"),
        (F.col("path_log10") + F.col("share") + F.coalesce("tail_share", nothing)).alias("score"))
