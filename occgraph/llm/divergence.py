"""Quality rules by distribution divergence.

Each document's histogram of character classes and its histogram of common
words are compared with those of its language by the Jensen-Shannon distance.
The references are sums over all documents of a language, so they follow the
corpus; a reference is a few dozen numbers, whatever the corpus's size.

Defined cases: a null text counts as empty; an empty text has no words and
fails the base rules; a null language is compared with the reference of all
documents. Texts under a minimum length are not judged by a histogram they are
too short for. The references of the ``MAX_LANGS`` largest languages go to every
task; documents of any other one meet theirs in a join, in which no key is hot:
each holds a smaller part of the corpus than any of those.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occgraph.llm.common import free_name, texts
from occgraph.session import materialize

#: Frequent function words of four languages.
COMMON_WORDS = """
the of and to in a is that it for was with as be by on this are from at or not have an they which but
de la le et les des en un une du que qui dans pour est par sur pas plus au ce ne se avec il
der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat
el que y los del se las por con no una su para es al lo como mas pero sus
""".split()
WORD_BINS = {w.encode(): i + 1 for i, w in enumerate(dict.fromkeys(COMMON_WORDS))}  # bin 0: any other word
N_WORD = len(WORD_BINS) + 1
SYMBOLS = b"#*$%&|<>"
#: Character classes by byte; a character of several bytes counts once, at its first byte.
CLASSES = ["continuation", "lower", "upper", "digit", "space", "symbol", "other_ascii", "two_bytes", "three_bytes", "four_bytes"]
N_CLASS = len(CLASSES)
MAX_LANGS = 256


def _class_of(b: int) -> int:
    c = chr(b)
    if b >= 0xF0:
        return 9
    if b >= 0xE0:
        return 8
    if b >= 0xC0:
        return 7
    if b >= 0x80:
        return 0
    if b in SYMBOLS:
        return 5
    return 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if b == 32 or 9 <= b <= 13 else 6


CLASS_MATRIX = np.zeros((256, N_CLASS))
CLASS_MATRIX[np.arange(256), [_class_of(b) for b in range(256)]] = 1
_SYMBOL_BYTES = np.frombuffer(SYMBOLS, np.uint8)
_SPACE_BYTES = np.array([32, 9, 10, 11, 12, 13])


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict. Distances lie in [0, 1]."""

    min_words: int = 10
    max_repeat_percent: int = 20
    chars_from: int = 50  # judge the character classes of texts with at least so many words
    max_chars_distance: float = 0.30
    words_from: int = 50  # judge the common words of texts with at least so many words
    words_floor: float = 0.12  # what a text of any length may be away from its language
    words_noise: float = 12.2  # a sample of n words is away from what it is drawn from by a squared distance that falls with 1 / n

    def max_words_distance(self, n_words: int) -> float:
        return (self.words_floor**2 + self.words_noise / n_words) ** 0.5


def histograms(text: bytes, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of bytes, of character classes and of common words."""
    by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    common = np.zeros(N_WORD)
    for w in words:
        i = WORD_BINS.get(w)
        if i:
            common[i] += 1
    common[0] = len(words) - common.sum()
    return by_byte, by_byte @ CLASS_MATRIX, common


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows of ``width`` words that the text holds at least twice."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    window = codes[: n - width + 1]
    for step in range(1, width):
        window = window * len(ids) + codes[step : step + n - width + 1]
        if step < width - 1:  # small numbers again, so that no product overflows
            window = np.unique(window, return_inverse=True)[1]
    _, back, times = np.unique(window, return_inverse=True, return_counts=True)
    again = times[back] > 1
    if not again.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


def _reference_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str | None, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(1).to_pylist(), texts(batch.column(0)), strict=True):
            _, classes, common = histograms(text, text.lower().split())
            own = sums.setdefault(lang, np.zeros(N_CLASS + N_WORD))
            own[:N_CLASS] += classes
            own[N_CLASS:] += common
        if len(sums) > 4 * MAX_LANGS:  # a column of many values: hand on what there is
            yield _counts_batch(sums)
            sums = {}
    yield _counts_batch(sums)


def _counts_batch(sums: dict[str | None, np.ndarray]) -> pa.RecordBatch:
    rows = [(lang, i, float(n)) for lang, counts in sums.items() for i, n in enumerate(counts) if n]
    columns = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.float64()), strict=True)], ["lang", "bin", "n"])


def language_references(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[dict[str | None, np.ndarray], DataFrame | None]:
    """Histograms by language over all documents; under None those of all documents.

    The ``MAX_LANGS`` languages with the most words, ties by name, come to the driver
    as ``N_CLASS + N_WORD`` numbers each. All others are a table of ``lang`` and
    ``reference``; None if there are no others.
    """
    counts = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).mapInArrow(_reference_counts, "lang string, bin int, n double")
    counts = materialize(counts.groupBy("lang", "bin").agg(F.sum("n").alias("n")))
    rows = counts.groupBy("lang").agg(F.sum("n").alias("size"), F.collect_list(F.struct("bin", "n")).alias("bins")).filter("lang IS NOT NULL")
    known = rows.orderBy(F.desc("size"), "lang").limit(MAX_LANGS + 1).collect()
    whole = counts.groupBy("bin").agg(F.sum("n").alias("n")).collect()
    found = {None: np.zeros(N_CLASS + N_WORD)}
    for r in whole:
        found[None][r["bin"]] = r["n"]
    for r in known[:MAX_LANGS]:
        found[r["lang"]] = np.zeros(N_CLASS + N_WORD)
        for b in r["bins"]:
            found[r["lang"]][b["bin"]] = b["n"]
    if len(known) <= MAX_LANGS:
        return found, None
    by_bin = F.map_from_entries("bins")
    dense = F.transform(F.sequence(F.lit(0), F.lit(N_CLASS + N_WORD - 1)), lambda i: F.coalesce(F.try_element_at(by_bin, i), F.lit(0.0)))
    return found, rows.filter(~F.col("lang").isin([x for x in found if x is not None])).select("lang", dense.alias("reference"))


def _shares(counts: np.ndarray) -> np.ndarray:
    total = counts.sum()
    return counts / total if total else np.full(len(counts), 1 / len(counts))


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits: 0 for equal, 1 for disjoint histograms."""
    p, q = _shares(p), _shares(q)
    mid = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = np.where(p > 0, p * np.log2(p / mid), 0) + np.where(q > 0, q * np.log2(q / mid), 0)
    return float(np.sqrt(max(0.0, bits.sum() / 2)))


def judge(text: bytes, lang: str | None, references: dict[str | None, np.ndarray], rules: Rules) -> tuple:
    """The measures and the verdict on one text, in the order of ``VERDICT``."""
    words = text.split()
    lowered = text.lower()
    by_byte, classes, common = histograms(text, lowered.split())
    n_words = len(words)
    word_chars = int(classes[1:].sum() - by_byte[_SPACE_BYTES].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeats = repeated_words(words)
    base_failed = n_words < rules.min_words or 100 * repeats > rules.max_repeat_percent * n_words
    reference = references.get(lang, references[None])
    chars_distance = js_distance(classes[1:], reference[1:N_CLASS])
    words_distance = js_distance(common, reference[N_CLASS:])
    failed = (n_words >= rules.chars_from and chars_distance > rules.max_chars_distance) or (
        n_words >= rules.words_from and words_distance > rules.max_words_distance(n_words))
    return (n_words, word_chars, int(by_byte[_SYMBOL_BYTES].sum()), len(lines) - len(set(lines)), repeats, base_failed,
            chars_distance, words_distance, not (base_failed or failed))


VERDICT = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
           ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("chars_distance", pa.float64()),
           ("words_distance", pa.float64()), ("kept", pa.bool_())]


SQL_TYPES = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double"}


def quality_verdicts(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang", into: str = "verdict") -> DataFrame:
    """All columns of ``docs`` and a struct ``into``: the measures, both distances and ``kept``.

    One pass sums the references, a second judges each row by itself, so repeated
    rows get equal verdicts; only rows of a language beyond the largest are moved. A column of ``docs``
    that is called ``into`` is replaced.
    """
    references, others = language_references(docs, text, lang)
    names, types = zip(*VERDICT, strict=True)
    schema = ", ".join(f"{n} {SQL_TYPES[t]}" for n, t in VERDICT)

    def verdicts(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({n: pd.Series(v, dtype=d) for n, v, d in zip(
            names, zip(*rows, strict=True) if rows else itertools.repeat([], len(names)),
            [t.to_pandas_dtype() for t in types], strict=False)})

    @F.pandas_udf(schema)
    def judged(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for column, langs in parts:
            yield verdicts([judge((t or "").encode("utf-8", "replace"), x, references, rules) for t, x in zip(column, langs, strict=True)])

    known = docs.withColumn(into, judged(F.col(text), F.col(lang).cast("string")))
    if others is None:
        return known

    whole = references[None]

    @F.pandas_udf(schema)
    def judged_by(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for column, own in parts:  # a language of empty texts only has no reference
            yield verdicts([judge((t or "").encode("utf-8", "replace"), None, {None: whole if o is None else np.asarray(o)}, rules) for t, o in zip(column, own, strict=True)])

    names_in = [x for x in references if x is not None]
    at_hand = F.col(lang).isNull() | F.col(lang).cast("string").isin(names_in)
    key, own = free_name(docs, "reference_lang"), free_name(docs, "reference")
    joined = docs.filter(~at_hand).withColumn(key, F.col(lang).cast("string")).join(others.toDF(key, own), key, "left")
    last = joined.withColumn(into, judged_by(F.col(text), F.col(own)))
    return docs.filter(at_hand).withColumn(into, judged(F.col(text), F.col(lang).cast("string"))).select(*known.columns).union(last.select(*known.columns))
