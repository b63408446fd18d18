r"""Phrase collocations from a weighted de Bruijn graph.

Texts are cut at punctuation into pieces and these into words. The graph of a
language has phrases of ``LONGEST - 1`` words as nodes and phrases of
``LONGEST`` words as edges, each as heavy as it occurs often; an edge leads from
its first words to its last ones. Only longest phrases are counted in texts, one
at each word, cut short at the end of a piece. All shorter counts follow: the
flow out of a node is what its edges weigh and what ends there, so

    count(p) = sum of the counts of p with one more word + count(p ends a piece).

A phrase is *inside* a longer one that occurs as often: the way on, or back, is
unary. Edges whose common node has no other way, in or out, form a path, found
by pointer doubling; along a path only the words that an edge adds bring new
shorter phrases.

Most long phrases of a corpus occur once. What is looked for occurs
``least`` times, and so does each pair of words in it. So pairs are counted
first, by their hashes, and the frequent ones set a bit in a map of ``BITS`` bits
(2 MiB) that goes to every task. A pair without its bit ends a run of words as
punctuation does. Equal hashes let some pairs pass; that costs work and changes
no result. The map's size is fixed, so on a corpus with more frequent pairs than
bits it saves less, and counts stay the same.

Skew: counts are summed in each task and again before every shuffle, so a
frequent word or pair is as many rows as there are tasks. Ranks are taken in
``SLICES`` slices of a language, then among their first ones.

Defined cases: a null text is empty, a null language ``und``; repeated rows
count as often as they are there; texts are read whole; ties in rank go to the
higher count, then to the lesser phrase by its bytes; an empty table gives an
empty table; columns beside the two named don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from occgraph.llm.common import pieces
from occgraph.session import materialize

LONGEST = 5
LEAST = 100
FIRST = 2000
BITS = 1 << 24
SLICES = 64
FLUSH = 500_000
UNKNOWN = "und"
#: A-Z to lower case, the tab to a space, what ends a piece to a byte that UTF-8 never has.
_END = b"\xff"
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + 10 * _END)
_COUNTS = "lang string, gram string, f long"


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, with ``_END`` between pieces and after the last."""
    return (text.translate(_PLAIN) + _END).replace(_END, b" \xff ").split()


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for start, run in pieces(batch.column("text")):
            yield from zip(langs[start : start + len(run)], run)


def _counted(grams: Callable[[str, bytes], list[bytes]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the grams of each text by language, passed on whenever ``FLUSH`` of them are held."""
    held: dict[str, Counter] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, found in held.items():
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "gram", "f"])
        held.clear()

    for lang, text in _texts(batches):
        held.setdefault(lang, Counter()).update(grams(lang, text))
        if sum(map(len, held.values())) >= FLUSH:
            yield from rows()
    yield from rows()


class _Hashes(dict):
    """Hashes of words, made when they are first seen; 0 for the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= FLUSH:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 42) | 1 if word != _END else 0
        return h


def _pair_hashes(words: list[bytes], hashes: _Hashes, lang: str) -> np.ndarray:
    """A hash of each word and the next one, by language; 0 where a piece ends."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    one, two = h[:-1], h[1:]
    mixed = (one * np.uint64(0x9E3779B97F4A7C15) ^ two) * np.uint64(0xBF58476D1CE4E5B9) ^ np.uint64(hashes[b"\xff" + lang.encode()])
    mixed ^= mixed >> np.uint64(32)
    return np.where((one != 0) & (two != 0), mixed | np.uint64(1 << 63), np.uint64(0))


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of pairs with their counts, summed over millions of words."""
    hashes, held, n = _Hashes(), [], 0

    def rows() -> pa.RecordBatch:
        found, times = np.unique(np.concatenate(held), return_counts=True)
        some = found != 0
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(found[some].view(np.int64)), pa.array(times[some].astype(np.int64))], names=["h", "f"])

    for lang, text in _texts(batches):
        held.append(_pair_hashes(words_of(text), hashes, lang))
        n += len(held[-1])
        if n >= 4 * FLUSH:
            yield rows()
            n = 0
    if held:
        yield rows()


def _count_edges(bits: Callable[[], bytes], longest: int):
    """From each word the next ``longest`` ones, or those up to the end of its run of frequent pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, hashes = np.frombuffer(bits(), np.uint8), _Hashes()

        def grams(lang: str, text: bytes) -> list[bytes]:
            words = words_of(text)
            h = _pair_hashes(words, hashes, lang)
            place = h & np.uint64(BITS - 1)
            passes = (h != 0) & (frequent[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            starts, stops = np.flatnonzero(passes), np.flatnonzero(~passes)  # the last pair ends a piece
            ends = np.minimum(stops[np.searchsorted(stops, starts)] + 1, starts + longest) if len(starts) else starts
            alone = [words[i] for i in stops.tolist() if words[i] != _END]
            return alone + [b" ".join(words[i:j]) for i, j in zip(starts.tolist(), ends.tolist())]

        return _counted(grams, batches)

    return run


def _words(phrase: str = "gram") -> Column:
    return F.size(F.split(phrase, " "))


def _first(phrase: str, n: int) -> Column:
    return F.substring_index(phrase, " ", n)


def _sum(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang", "gram").agg(F.sum("f").alias("f"))


def frequent_pairs(texts: DataFrame, least: int) -> bytes:
    """The bit map of pairs that occur ``least`` times; at most ``BITS`` / 64 rows come to the driver."""
    counts = texts.mapInArrow(_count_pairs, "h long, f long").groupBy("h").agg(F.sum("f").alias("f"))
    slots = counts.filter(F.col("f") >= least).groupBy(F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(BITS // 64 - 1)).alias("slot")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(h & 63 AS int))")).alias("bits")).toArrow()
    whole = np.zeros(BITS // 64, "<i8")
    whole[slots["slot"].to_numpy()] = slots["bits"].to_numpy()
    return whole.tobytes()


def edges(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, owner: str | None = None) -> DataFrame:
    """The graph: edges, and shorter grams that end a run (``lang``, ``gram``, ``f``)."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    bits = docs.sparkSession.sparkContext.broadcast(frequent_pairs(texts, least))
    return materialize(_sum(texts.mapInArrow(_count_edges(lambda: bits.value, longest), _COUNTS)), owner)


def phrase_counts(graph: DataFrame, longest: int = LONGEST, least: int = LEAST, owner: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Counts of all phrases of 1 to ``longest`` words that occur ``least`` times (``lang``, ``gram``, ``words``, ``f``), and of all words (``lang``, ``n``)."""
    sized = graph.withColumn("words", _words())
    level = sized.filter(F.col("words") == longest).drop("words")
    found = level.withColumn("words", F.lit(longest))
    for n in range(longest - 1, 0, -1):
        ends = sized.filter(F.col("words") == n).drop("words")
        level = materialize(_sum(level.withColumn("gram", _first("gram", n)).unionByName(ends)), owner)
        found = found.unionByName(level.withColumn("words", F.lit(n)))
    return materialize(found.filter(F.col("f") >= least), owner), level.groupBy("lang").agg(F.sum("f").alias("n"))


def unary_paths(counts: DataFrame, longest: int = LONGEST, owner: str | None = None) -> DataFrame:
    """Edges along compacted paths: ``lang``, ``gram``, ``f``, ``head`` (the path's first edge) and ``place`` (0 for the head).

    Two edges are on one path if all that comes into their common node comes
    by the one and all that leaves it leaves by the other. No path is a circle:
    each run of words ends.
    """
    heavy = counts.filter(F.col("words") == longest).select("lang", "gram", "f")
    nodes = counts.filter(F.col("words") == longest - 1).select("lang", F.col("gram").alias("node"), "f")
    after = nodes.join(heavy.withColumn("node", _first("gram", longest - 1)), ["lang", "node", "f"])
    before = heavy.select("lang", F.substring_index("gram", " ", 1 - longest).alias("node"), "f", F.col("gram").alias("before"))
    back = after.join(before, ["lang", "node", "f"]).select("lang", "gram", "before")
    state = heavy.join(back, ["lang", "gram"], "left").select(
        "lang", "gram", "f", F.coalesce("before", "gram").alias("head"), F.col("before").isNotNull().cast("long").alias("place"))
    while True:
        state = materialize(state, owner)
        if state.filter("place > 0").join(state.filter("place > 0").select("lang", F.col("gram").alias("head")), ["lang", "head"], "left_semi").isEmpty():
            return state
        ahead = state.select("lang", F.col("gram").alias("head"), F.col("head").alias("far"), F.col("place").alias("more"))
        state = state.join(ahead, ["lang", "head"]).select("lang", "gram", "f", F.col("far").alias("head"), (F.col("place") + F.col("more")).alias("place"))


def _shorter(longest: int, suffixes: bool) -> Column:
    """Phrases of two and more words inside ``gram``: all, or those that end it."""
    w, n = F.split("gram", " "), _words()
    ends = F.transform(F.sequence(F.lit(2), F.greatest(n - 1, F.lit(2))), lambda k: F.array_join(F.slice(w, n - k + 1, k), " "))
    if suffixes:
        return ends
    starts = F.sequence(F.lit(1), n - 1)
    every = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(2), F.greatest(n - i + 1, F.lit(2))), lambda k: F.array_join(F.slice(w, i, k), " "))))
    return F.filter(F.array_distinct(every), lambda p: p != F.col("gram"))


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Phrases of two and more words by their lowest-scoring cut: ``lang``, ``phrase``, ``words``, ``a``, ``l``, ``r``, ``n``, ``score``."""
    cuts = counts.filter("words >= 2").withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"left_part": F.expr("substring_index(gram, ' ', cut)"), "right_part": F.expr("substring_index(gram, ' ', cut - words)")})
    side = lambda part, f: counts.select("lang", F.col("gram").alias(part), F.col("f").alias(f))
    joined = cuts.join(side("left_part", "l"), ["lang", "left_part"]).join(side("right_part", "r"), ["lang", "right_part"]).join(totals, "lang")
    exact = joined.withColumn("score", F.expr(
        "(cast(1000 * f AS decimal(19, 0)) * cast(n AS decimal(19, 0))) div (cast(l AS decimal(19, 0)) * cast(r AS decimal(19, 0)))"))
    best = exact.groupBy("lang", "gram", "words", "f", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", F.col("gram").alias("phrase"), "words", F.col("f").alias("a"), "best.l", "best.r", "n", "best.score")


def inside_longer(counts: DataFrame, paths: DataFrame, percent: int = 100, longest: int = LONGEST) -> DataFrame:
    """The phrases (``lang``, ``phrase``) inside a longer one that occurs at least ``percent`` of a hundred times as often."""
    new = F.when(F.col("place") > 0, _shorter(longest, True)).otherwise(_shorter(longest, False))
    along = paths.select("lang", F.explode(new).alias("phrase"), F.col("f").alias("longer"))
    rest = counts.filter(F.col("words").between(3, longest - 1)).select("lang", F.explode(_shorter(longest, False)).alias("phrase"), F.col("f").alias("longer"))
    most = along.unionByName(rest).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    found = most.join(counts.select("lang", F.col("gram").alias("phrase"), "f"), ["lang", "phrase"])
    return found.filter(F.lit(100).cast("decimal(20,0)") * F.col("longer") >= F.lit(percent).cast("decimal(20,0)") * F.col("f")).select("lang", "phrase")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, first: int = FIRST, percent: int = 100, owner: str | None = None) -> DataFrame:
    """Each language's ``first`` phrases by score: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    The score is floor(1000 * a * n / (l * r)) of the lowest-scoring cut, in
    exact arithmetic. Copies are written under ``owner``.
    """
    counts, totals = phrase_counts(edges(docs, longest, least, owner), longest, least, owner)
    dropped = inside_longer(counts, unary_paths(counts, longest, owner), percent, longest)
    kept = scored(counts, totals).join(dropped, ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rank = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(*order))
    sliced = kept.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    ahead = sliced.withColumn("rank", rank("lang", "slice")).filter(F.col("rank") <= first)
    return ahead.withColumn("rank", rank("lang").cast("long")).filter(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
