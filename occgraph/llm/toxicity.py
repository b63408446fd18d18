"""Toxicity by cumulative-link ordinal regression.

A text's severity is a grade: 0 clean, 1 mild, 2 severe. One weight a word
serves all grades, with a threshold between each grade and the next:

    P(grade <= j) = 1 / (1 + exp(-(threshold_j - weights . x))).

The result is the expected grade and the grades' probabilities.

Everything is fitted to at most ``SAMPLE`` labelled texts, those with the least
hash of their ids. Features are words and the beginnings of words, chosen by
their document counts in these texts. Labels say toxic or not; a toxic text is
severe if it has at least as many words that mark toxic texts as the median
toxic text of the sample.

Defined cases: null and empty texts have no features and get the grade that
the thresholds alone give; a null label takes no part in fitting; of several
labels for an id the highest counts, of several texts the least; without labelled toxic texts everything
has grade 0. Repeated rows get equal scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occgraph.llm.common import texts
from occgraph.session import materialize

FEATURES = 4096
LONGEST = 12
BEGINNINGS = (4, 5, 6, 7)
LEAST_TEXTS = 5
SAMPLE = 20_000
GRADES = 3
LEAST_STRENGTH = 4.0  # log odds over their standard error, either way, that make a word a feature
MARK_ODDS = 3.0  # log odds from which a feature marks toxic texts
FLUSH = 300_000
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def words_of(text: bytes) -> Counter[str]:
    return Counter(_WORD.findall(text.decode("utf-8", "replace").lower()))


def forms_of(word: str) -> list[str]:
    """A word's features: itself, if it isn't long, and its beginnings, which inflected and compound words share."""
    return [word[:LONGEST], *[f"{word[:n]}-" for n in BEGINNINGS if len(word) > n]]


def features_of(words: Counter[str]) -> Counter[str]:
    found: Counter[str] = Counter()
    for word, times in words.items():
        for form in forms_of(word):
            found[form] += times
    return found


@dataclass
class Severity:
    """The fitted model; ``index`` numbers the words."""

    index: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def known(self, word: str) -> list[int]:
        return [i for i in map(self.index.get, forms_of(word)) if i is not None]

    def probabilities(self, text: bytes) -> np.ndarray:
        score = 0.0
        seen: Counter[int] = Counter()
        for word, times in words_of(text).items():
            for i in self.known(word):
                seen[i] += times
        for i, times in seen.items():
            score += self.weights[i] * float(np.log1p(times))
        upto = 1 / (1 + np.exp(-np.clip(self.thresholds - score, -500, 500)))
        return np.diff(np.concatenate([[0.0], upto, [1.0]]))


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

    def written() -> pa.RecordBatch:
        every = list(set(seen[0]) | set(seen[1]))
        return pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *[pa.array([s[w] for w in every], pa.int64()) for s in seen]], ["word", "clean", "toxic"])

    for batch in batches:
        for text, toxic in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            seen[toxic].update({form for word in words_of(text) for form in forms_of(word)})
        if len(seen[0]) + len(seen[1]) > FLUSH:
            yield written()
            for s in seen:
                s.clear()
    yield written()


def fit_thresholds(rows: list[tuple[list[int], list[float]]], grades: np.ndarray, features: int, rounds: int = 800, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds that maximise the penalised likelihood, by accelerated gradient steps."""
    count = len(rows)
    at = np.repeat(np.arange(count), [len(r[0]) for r in rows])
    column = np.array([i for r in rows for i in r[0]], np.int64)
    value = np.array([v for r in rows for v in r[1]])
    levels = int(grades.max()) + 1 if count else 1
    shares = np.array([(grades <= j).mean() for j in range(levels - 1)])
    thresholds = np.log(shares / (1 - shares))
    weights, speed_w, speed_t = np.zeros(features), np.zeros(features), np.zeros(levels - 1)
    # steps by a separable bound of the curvature: a feature's own values times all values beside them
    beside = 1 + np.bincount(at, weights=value, minlength=count)
    step_w = 1 / (0.25 * np.bincount(column, weights=value * beside[at], minlength=features) / max(1, count) + penalty)
    step_t = 1 / (0.25 * beside.mean() if count else 1.0)
    for r in range(rounds):
        momentum = r / (r + 3)
        w, t = weights + momentum * speed_w, thresholds + momentum * speed_t
        score = np.bincount(at, weights=value * w[column], minlength=count)
        edge = np.concatenate([[-np.inf], t, [np.inf]])
        with np.errstate(over="ignore"):
            above, below = 1 / (1 + np.exp(score - edge[grades + 1])), 1 / (1 + np.exp(score - edge[grades]))
        # of the log likelihood: by the score, and by the thresholds from the densities at both edges
        slope = above + below - 1
        mass = np.maximum(above - below, 1e-12)
        up, down = above * (1 - above) / mass, below * (1 - below) / mass
        grad_t = np.array([up[grades == j].sum() - down[grades == j + 1].sum() for j in range(levels - 1)]) / count
        grad_w = np.bincount(column, weights=value * slope[at], minlength=features) / count - penalty * w
        new_w, new_t = w + step_w * grad_w, np.sort(t + step_t * grad_t)
        speed_w, speed_t = new_w - weights, new_t - thresholds
        weights, thresholds = new_w, new_t
    return weights, thresholds


def fit_severity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", owner: str = "toxicity") -> Severity:
    """The model of the labelled texts of ``docs``."""
    known = labels.filter(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("label_id")).agg((F.max(toxic) > 0).cast("int").alias("is_toxic"))
    known = known.withColumn("h", F.xxhash64("label_id"))
    share = min(1.0, 1.5 * SAMPLE / max(1, known.count()))  # those that can't be among the least stay where they are
    least = known.filter(F.col("h") <= min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))).orderBy("h", "label_id").limit(SAMPLE)
    picked = F.broadcast(materialize(least, owner))  # at most SAMPLE rows
    labelled = materialize(docs.select(F.col(doc_id).alias("label_id"), F.col(text).alias("text")).join(picked, "label_id").groupBy(
        "label_id", "is_toxic").agg(F.min("text").alias("text")), owner)
    n = {r[0]: r[1] for r in labelled.groupBy("is_toxic").count().collect()}
    clean, bad = n.get(0, 0), n.get(1, 0)
    if not bad or not clean:
        return Severity({}, np.zeros(0), np.array([50.0, 60.0]))
    counts = labelled.select("text", "is_toxic").mapInArrow(_document_counts, "word string, clean long, toxic long").groupBy("word").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter(F.col("clean") + F.col("toxic") >= LEAST_TEXTS)
    odds = F.log((F.col("toxic") + 0.5) / (bad - F.col("toxic") + 0.5)) - F.log((F.col("clean") + 0.5) / (clean - F.col("clean") + 0.5))
    spread = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    chosen = counts.select("word", odds.alias("odds"), F.abs(odds / spread).alias("strength")).filter(F.col("strength") >= LEAST_STRENGTH).orderBy(
        F.desc("strength"), "word").limit(FEATURES).collect()
    index = {r["word"]: i for i, r in enumerate(chosen)}
    marks = {r["word"] for r in chosen if r["odds"] >= MARK_ODDS}

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values, hits = [], [], []
            for t in texts(batch.column(0)):
                words = words_of(t)
                own = [(index[f], float(np.log1p(c))) for f, c in features_of(words).items() if f in index]
                ids.append([i for i, _ in own])
                values.append([v for _, v in own])
                hits.append(sum(c for w, c in words.items() if not marks.isdisjoint(forms_of(w))))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64())), pa.array(hits, pa.int32())],
                                             ["is_toxic", "ids", "strengths", "hits"])

    sample = labelled.select("text", "is_toxic").mapInArrow(
        featured, "is_toxic int, ids array<int>, strengths array<double>, hits int").collect()
    toxic_hits = [r["hits"] for r in sample if r["is_toxic"]]
    severe = max(1.0, float(np.median(toxic_hits))) if toxic_hits else 1.0
    grades = np.array([0 if not r["is_toxic"] else 2 if r["hits"] >= severe else 1 for r in sample])
    for g in range(GRADES - 1):  # every grade needs a row for its threshold
        if not (grades == g).any() or not (grades > g).any():
            grades = np.where(grades > 0, 1, 0)
    if not grades.any() or grades.all():
        return Severity({}, np.zeros(0), np.array([50.0, 60.0]))
    weights, thresholds = fit_thresholds([(r["ids"], r["strengths"]) for r in sample], grades, len(index))
    return Severity(index, weights, thresholds)


def severity(docs: DataFrame, model: Severity, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and a struct ``severity``: ``expected`` grade, ``p_toxic`` (grade over 0), ``p_severe``, ``grade`` (the likeliest)."""

    @F.pandas_udf("expected double, p_toxic double, p_severe double, grade int")
    def graded(column: pd.Series) -> pd.DataFrame:
        rows = []
        for t in column:
            p = model.probabilities((t or "").encode("utf-8", "replace"))
            rows.append((float(p @ np.arange(len(p))), float(1 - p[0]), float(p[2]) if len(p) > 2 else 0.0, int(p.argmax())))
        return pd.DataFrame(rows, columns=["expected", "p_toxic", "p_severe", "grade"])

    return docs.withColumn("severity", graded(F.col(text)))
