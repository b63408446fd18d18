"""Very large JSON documents as rows, without holding one as a string.

A document is read in pieces that end at ``}``, which Spark's text reader cuts
at byte ranges like lines, so that a file is many splits. What a piece means
depends on what is open where it starts. A first pass tells for each split what
it does to that: which levels it closes, which keys and places it leaves, what
it opens, once as if it began inside a string and once as if outside. These few
values a split, put after one another on the driver, give every split its start,
and a second pass gives out the scalars with their paths.

Rows are (``file``, ``path``, ``start``, ``values``): a member of an object has its key
as the path's last element and one value; neighbouring scalars of an array are
one row with the place of the first, at most ``RUN`` of them. Strings come
unescaped, other scalars as they are written, JSON's null as null.

Defined cases: white space and key order don't matter; a key given twice gives
two rows; an empty file, or one that is no JSON, gives what can be read of it;
files that are compressed are one split each, as for every text reader.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = 8192
_TOKEN = re.compile(r'"((?:[^"\\]|\\.)*)"|([{}\[\],:])|([^\s{}\[\],:"]+)|(")', re.DOTALL)
_STRING_END = re.compile(r'((?:[^"\\]|\\.)*)"', re.DOTALL)
LEAVES = "file string, path array<string>, start long, values array<string>"


class Walk:
    """The open levels along a text, from what is open before it.

    A level is ``[key or None, place or None]``: an object's current key, an array's current place. Below the first known level a walk
    counts what it closes (``closed``) and what it changes on the level it is then in (``commas``, ``key``).
    """

    def __init__(self, levels: list[list] | None = None, inside: str | None = None):
        self.known = levels is not None
        self.levels = [list(x) for x in levels or []]
        self.closed, self.commas, self.key = 0, 0, None
        self.inside = inside  # the beginning of a string that isn't closed yet
        self.unclosed = inside is not None  # not since the start
        self.continued = False  # is the key the end of a string from before?
        self.held = ""
        self.word: str | None = None  # a string that is a key if a colon follows

    def feed(self, text: str) -> Iterator[tuple[list[list], str | None]]:
        """Scalars with the levels that are open around them."""
        text, at = self.held + text, 0
        self.held = ""
        if self.inside is not None:
            found = _STRING_END.match(text)
            if not found:
                cut = len(text) - (len(text) - len(text.rstrip("\\"))) % 2  # an escape isn't torn apart
                self.inside, self.held = self.inside + text[:cut], text[cut:]
                return
            self.word, self.inside, at = self.inside + found.group(1), None, found.end()
            self.continued, self.unclosed = self.unclosed, False
        for token in _TOKEN.finditer(text, at):
            string, mark, literal, torn = token.groups()
            if torn:
                rest = text[token.end() :]
                cut = len(rest) - (len(rest) - len(rest.rstrip("\\"))) % 2
                self.inside, self.held = rest[:cut], rest[cut:]
                return
            if mark == ":":
                self._named(self.word)
                self.word = None
                continue
            self.continued = self.continued and self.key is not None
            if self.word is not None:
                yield self.levels, _unescaped(self.word)
                self.word = None
            if string is not None:
                self.word = string
            elif literal is not None:
                yield self.levels, None if literal == "null" else literal
            elif mark in "{[":
                self.levels.append([None, None] if mark == "{" else [None, 0])
            elif mark in "}]":
                self._closed()
            elif mark == ",":
                self._next()
        if self.word is not None:  # no key: what follows begins with a closing brace
            yield self.levels, _unescaped(self.word)
            self.word = None

    def _named(self, word: str | None) -> None:
        if self.levels:
            self.levels[-1][0] = _unescaped(word or "")
        else:
            self.continued = self.continued and self.key is None
            self.key = word or ""  # as written: its beginning may lie before

    def _next(self) -> None:
        if not self.levels:
            self.commas += 1
        elif self.levels[-1][1] is not None:
            self.levels[-1][1] += 1

    def _closed(self) -> None:
        if self.levels:
            self.levels.pop()
        else:
            self.closed, self.commas, self.key, self.continued = self.closed + 1, 0, None, False

    def effect(self) -> dict:
        return {
            "closed": self.closed, "commas": self.commas, "key": self.key, "continued": self.continued, "levels": self.levels,
            "inside": None if self.inside is None else self.inside + self.held, "unclosed": self.unclosed}


def _unescaped(text: str) -> str:
    return json.loads(f'"{text}"', strict=False) if "\\" in text else text


def after(levels: list[list], effect: dict, inside: str | None = None) -> list[list]:
    """The levels that are open behind a split that began inside a string or not."""
    kept = [list(x) for x in (levels[: -effect["closed"]] if effect["closed"] else levels)]
    if kept and kept[-1][1] is not None:
        kept[-1][1] += effect["commas"]
    elif kept and effect["key"] is not None:
        kept[-1][0] = _unescaped((inside or "") * effect["continued"] + effect["key"])
    return kept + effect["levels"]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of all files with their split; every piece but a file's first comes behind a ``}``."""
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bool, str]]:
    """(split, is it new, text) in the order of the file."""
    now = None
    for batch in batches:
        files, splits, values = (c.to_pylist() for c in batch.columns)
        at = 0
        while at < len(files):
            key, upto = (files[at], splits[at]), at
            while upto < len(files) and (files[upto], splits[upto]) == key:
                upto += 1
            text = "}".join(v or "" for v in values[at:upto])
            first = key != now
            yield key, first, text if first and key[1] == 0 else "}" + text
            now, at = key, upto


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each split does, begun outside a string and inside one."""
    def row() -> pa.RecordBatch:
        effects = [json.dumps(walk.effect()) for walk in walks]
        return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int64()), *[pa.array([e]) for e in effects]], names=["file", "split", "outside", "inside"])

    now, walks = None, []
    for key, first, text in _by_split(batches):
        if first:
            if now is not None:
                yield row()
            now, walks = key, [Walk(), Walk(inside="")]
        for walk in walks:
            for _ in walk.feed(text):
                pass
    if now is not None:
        yield row()


def _leaves(starts: dict[tuple[str, int], tuple[list[list], str | None]]):
    """The scalars of each split, from its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        path, place, values = None, None, []

        def settle() -> None:
            nonlocal path, values
            if values:
                rows.append((now[0], list(path), place, values))
            path, values = None, []

        def written() -> pa.RecordBatch:
            files, paths, places, held = zip(*rows)
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(files, pa.string()), pa.array(paths, pa.list_(pa.string())), pa.array(places, pa.int64()), pa.array(held, pa.list_(pa.string()))], names=["file", "path", "start", "values"])

        now, walk = None, None
        for key, first, text in _by_split(batches):
            if first:
                settle()
                now, walk = key, Walk(*starts[key])
            for levels, value in walk.feed(text):
                top = levels[-1] if levels else [None, None]
                own = tuple(str(x[0] if x[1] is None else x[1]) for x in (levels if top[1] is None else levels[:-1]))
                if top[1] is None:
                    settle()
                    rows.append((now[0], list(own), None, [value]))
                else:
                    if own != path or top[1] != place + len(values) or len(values) == RUN:
                        settle()
                        path, place = own, top[1]
                    values.append(value)
            if len(rows) >= RUN:
                yield written()
        settle()
        if rows:
            yield written()

    return run


def json_leaves(spark: SparkSession, path: str) -> DataFrame:
    """``LEAVES`` of all JSON files at ``path``, each read in splits."""
    given = _pieces(spark, path)
    effects = sorted((r["file"], r["split"], r["outside"], r["inside"]) for r in given.mapInArrow(_effects, "file string, split long, outside string, inside string").collect())  # a row a split
    starts: dict[tuple[str, int], tuple[list[list], str | None]] = {}
    file = levels = inside = None
    for name, split, *both in effects:
        if name != file:
            file, levels, inside = name, [], None
        starts[name, split] = levels, inside
        effect = json.loads(both[inside is not None])
        if effect["unclosed"]:
            inside += effect["inside"]  # a string over several splits
        else:
            levels, inside = after(levels, effect, inside), effect["inside"]
    return given.mapInArrow(_leaves(starts), LEAVES)


# --- run documents -------------------------------------------------------------------

def _at(i: int) -> Column:
    return F.get("path", F.lit(i))


def _is(*names: str | None) -> Column:
    """Has the path these elements (None: any), and no more?"""
    same = F.size("path") == len(names)
    for i, name in enumerate(names):
        same = same & (_at(i) == name) if name is not None else same
    return same


def _seeded(leaves: DataFrame, rows: DataFrame) -> DataFrame:
    """``run`` replaced by ``seed``: the run's own member of that name, else its key."""
    own = leaves.filter(_is("runs", None, "seed")).select("file", _at(1).alias("run"), F.get("values", F.lit(0)).alias("own_seed"))
    return rows.join(own, ["file", "run"], "left").withColumn("seed", F.expr("try_cast(coalesce(own_seed, run) AS int)")).drop("own_seed", "run")


def predictions_of(leaves: DataFrame, layout: str) -> DataFrame:
    """``(file, seed, region, model, pos, y_true, y_prob)``, as ``runs.flatten_predictions`` gives them.

    A value is found by its path and its place, so the arrays of one prediction
    block may lie in different splits; blocks whose arrays differ in length are
    dropped whole.
    """
    fields = F.element_at("path", -1)
    if layout == "per_region":
        match, region, model = _is("runs", None, "per_region", None, "predictions", None, None), _at(3), _at(5)
    elif layout == "per_model":
        truth = _is("runs", None, "per_region", None, "y_true")
        match, region = truth | _is("runs", None, "per_region", None, "per_model", None, "y_prob"), _at(3)
        model = F.when(~truth, _at(5))
    elif layout == "model_first":
        graph = _is("runs", None, None, "per_region", None, "predictions", None)
        match = graph | _is("runs", None, "baselines", "predictions_per_region", None, None, None)
        region, model = _at(4), F.when(graph, _at(2)).otherwise(_at(5))
    else:
        raise ValueError(f"unknown layout {layout!r}")
    found = leaves.filter(match & fields.isin("y_true", "y_prob") & F.col("start").isNotNull()).select(
        "file", _at(1).alias("run"), region.alias("region"), model.alias("model"), fields.alias("field"), "start", F.posexplode("values").alias("i", "value"))
    cells = found.select("file", "run", "region", "model", "field", (F.col("start") + F.col("i")).cast("int").alias("pos"), "value")
    truths = cells.filter("field = 'y_true'").select("file", "run", "region", "model", "pos", F.expr("try_cast(value AS int)").alias("y_true"))
    probs = cells.filter("field = 'y_prob'").select("file", "run", "region", "model", "pos", F.expr("try_cast(value AS double)").alias("y_prob"))
    keys = ["file", "run", "region", "model", "pos"]
    block = ["file", "run", "region"] if layout == "per_model" else keys[:-1]  # one truth for all models of a region, or one a model
    both = probs.join(truths.select(*block, "pos", "y_true"), [*block, "pos"])
    lengths = truths.groupBy(*block).agg(F.count("*").alias("n_true"))
    sizes = probs.groupBy(*keys[:-1]).agg(F.count("*").alias("n_prob")).join(lengths, block)
    fits = sizes.filter("n_true = n_prob").select(*keys[:-1])
    return _seeded(leaves, both.join(fits, keys[:-1])).select("file", "seed", "region", "model", "pos", "y_true", "y_prob")


def metrics_of(leaves: DataFrame) -> DataFrame:
    """``(file, seed, region, model, metric, value)``, as ``runs.flatten_metrics`` gives them."""
    whole = _is("runs", None, None, None, None) & _at(2).isin("avg_metrics", "aggregated_metrics")
    region = _is("runs", None, "per_region", None, None, None, None) & _at(4).isin("test_metrics", "per_model")
    rows = leaves.filter((whole | region) & F.col("start").isNull()).select(
        "file", _at(1).alias("run"), F.when(region, _at(3)).alias("region"), F.when(region, _at(5)).otherwise(_at(3)).alias("model"),
        F.element_at("path", -1).alias("metric"), F.expr("try_cast(values[0] AS double)").alias("value"))
    return _seeded(leaves, rows.filter(F.col("value").isNotNull() & ~F.isnan("value"))).select("file", "seed", "region", "model", "metric", "value")
