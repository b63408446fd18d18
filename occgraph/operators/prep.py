"""Feature preparation fitted on some rows and applied to all.

Fitted state is a small JSON-ready object: means, deviations, medians, kept
columns and category lists. ``fit`` takes only the rows it may look at.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from itertools import accumulate

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occgraph.functions.hashing import hash_order
from occgraph.operators.ranking import medians
from occgraph.operators.splits import hash_rank
from occgraph.operators.table import require_coordinates
from occgraph.session import materialize

UNKNOWN = "Unknown"
NUMERIC = ("byte", "short", "int", "bigint", "smallint", "tinyint", "float", "double")
MAX_CATEGORIES = 5000
# fixed values: columns left out before model preparation
PREP_DROP = ["host_lith", "dep_type", "state_prov", "status", "commods", "ree_mins"]
COORDINATES = ["lat", "lon"]
# fixed values: mineral flags that the sweep without minerals leaves out
MINERAL_FLAGS = ["has_ilmenite", "has_magnetite", "has_barite", "has_zircon", "has_pyrochlore", "has_fluorite"]
# fixed values: deposit groups, which that sweep puts back and the sweep without lithology leaves out
GROUP_FLAGS = [
    "is_carbonatite_system", "is_alkaline_intrusive", "is_mafic_ultramafic", "is_felsic_pegmatite", "is_metamorphic_metasomatic",
    "is_sedimentary", "is_placer", "is_supergene_lateritic", "is_unclassified",
]
# fixed values: mineral flags close to the label, no targets of a probe for other minerals
LABEL_LIKE_MINERALS = ["has_zircon", "has_ilmenite", "has_pyrochlore", "has_fluorite", "has_magnetite"]


def zscore_state(fit_rows: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a constant column keeps scale 1."""
    r = fit_rows.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (r[f"m_{c}"], r[f"s_{c}"] or 1.0) for c in columns}


def zscore(df: DataFrame, state: dict[str, tuple[float, float]], suffix: str = "_z") -> DataFrame:
    return df.withColumns({c + suffix: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in state.items()})


def fixed_one_hot(column: str, categories: list[str], prefix: str) -> list[Column]:
    """Indicators of a fixed list; other values and nulls give all zeros."""
    return [F.coalesce((F.col(column) == c).cast("int"), F.lit(0)).alias(f"{prefix}_{c}") for c in categories]


def fit_categories(fit_rows: DataFrame, column: str, limit: int = MAX_CATEGORIES) -> list[str]:
    """Sorted values seen in the fit rows plus ``Unknown``; size-checked."""
    found = fit_rows.select(F.coalesce(F.col(column), F.lit(UNKNOWN)).alias("v")).distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} categories: use SparsePrep")
    return sorted({r["v"] for r in found} | {UNKNOWN})


def known_category(column: str, categories: list[str]) -> Column:
    """The value, or ``Unknown`` when it was not seen at fit time."""
    return F.when(F.col(column).isin(categories), F.col(column)).otherwise(UNKNOWN)


@dataclass
class FeaturePrep:
    """Drop, scale coordinates, prune sparse columns, impute, one-hot encode."""

    label: str = "label"
    id_col: str = "row_id"
    missing_threshold: float = 0.5
    drop_coordinates: bool = False
    always_keep: tuple[str, ...] = ("region",)
    without: tuple[str, ...] = ()  # families of features left out: minerals, lithology, places
    scale: dict = field(default_factory=dict)
    numeric: dict = field(default_factory=dict)
    categories: dict = field(default_factory=dict)

    def fit(self, fit_rows: DataFrame) -> FeaturePrep:
        rows = require_coordinates(fit_rows.drop(*PREP_DROP))
        self.scale = zscore_state(rows, COORDINATES)
        ratios = rows.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in rows.columns]).first()
        kept = [c for c in rows.columns if c not in (self.label, self.id_col, "role")
                and (ratios[c] < self.missing_threshold or c in self.always_keep)]
        if self.drop_coordinates:
            kept = [c for c in kept if c not in COORDINATES]
        kinds = dict(rows.dtypes)
        numbers = [c for c in kept if kinds[c] in NUMERIC]
        scaled = zscore(rows, self.scale, suffix="") if not self.drop_coordinates else rows
        self.numeric = medians(scaled, numbers) if numbers else {}
        self.categories = {c: fit_categories(rows, c) for c in kept if kinds[c] == "string"}
        return self

    def _all_names(self) -> list[str]:
        return list(self.numeric) + [f"{c}_{v}" for c, vs in self.categories.items() for v in vs]

    def names(self) -> list[str]:
        """Feature names in column order."""
        return candidate_columns(self._all_names(), **{family: False for family in self.without})

    def _columns(self) -> list[Column]:
        out = []
        for c, median in self.numeric.items():
            value = F.col(c).cast("double")
            if c in self.scale:
                m, s = self.scale[c]
                value = (value - F.lit(m)) / F.lit(s)
            out.append(F.coalesce(value, F.lit(0.0 if median is None else float(median))))
        for c, values in self.categories.items():
            known = known_category(c, values)
            out += [(known == v).cast("double") for v in values]
        kept = set(self.names())
        return [c for c, name in zip(out, self._all_names(), strict=True) if name in kept]

    def encode(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """Wide form, one column per feature, in a single projection."""
        return df.select(self.id_col, *keep, *[c.alias(n) for c, n in zip(self._columns(), self.names())])

    def transform(self, df: DataFrame, keep: list[str] = (), output: str = "features") -> DataFrame:
        """Vector form; the wide columns never exist as a schema."""
        return df.select(self.id_col, *keep, array_to_vector(F.array(*self._columns())).alias(output))

    def to_json(self) -> str:
        return json.dumps(asdict(self))  # key order is column order

    @classmethod
    def from_json(cls, text: str) -> FeaturePrep:
        state = json.loads(text)
        state["always_keep"], state["without"] = tuple(state["always_keep"]), tuple(state["without"])
        state["scale"] = {k: tuple(v) for k, v in state["scale"].items()}
        return cls(**state)


# --- wide categories --------------------------------------------------------------

def category_index(fit_rows: DataFrame, columns: list[str]) -> DataFrame:
    """``column``, ``value``, ``place`` (0, 1, ... in hash order), ``n_values``: the values of text columns seen in the fit rows, and ``Unknown``.

    A table of any size; nulls count as ``Unknown``.
    """
    seen = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(UNKNOWN)).alias("value")) for c in columns]))
    unknown = fit_rows.sparkSession.createDataFrame([(c, UNKNOWN) for c in columns], "column string, value string")
    values = fit_rows.select(seen.alias("x")).select("x.*").unionByName(unknown).distinct()
    ranked = hash_rank(values, ["column"], hash_order(F.col("column"), F.col("value")), tie="value")
    return ranked.select("column", "value", (F.col("place") - 1).alias("place"), F.col("place_n").alias("n_values"))


def with_places(df: DataFrame, index: DataFrame, columns: list[str], suffix: str = "_place") -> DataFrame:
    """``df`` with each text column's place in the index; an unseen value has that of ``Unknown``.

    One join a column, broadcast by the planner while the index is small.
    """
    unknown = {r["column"]: r["place"] for r in index.filter(F.col("value") == UNKNOWN).collect()}  # a row a column
    out = df
    for c in columns:
        mine = index.filter(F.col("column") == c).select(F.col("value").alias("seen_value"), F.col("place").alias(c + suffix))
        out = out.join(mine, F.coalesce(F.col(c), F.lit(UNKNOWN)) == F.col("seen_value"), "left").drop("seen_value").fillna({c + suffix: unknown[c]})
    return out


class SparsePrep:
    """Numbers (median for nulls) and one-hot categories of any number, as sparse vectors.

    What ``FeaturePrep`` does with dense columns for a few thousand categories;
    here the categories stay a table that is joined, nothing is listed in the
    plan, and a row holds its own few places.
    """

    def __init__(self, numbers: list[str], categories: list[str]):
        self.numbers, self.categories = numbers, categories

    def fit(self, fit_rows: DataFrame, owner: str | None = None) -> SparsePrep:
        self.medians = medians(fit_rows, self.numbers) if self.numbers else {}
        self.index = materialize(category_index(fit_rows, self.categories), owner)
        sizes = {r["column"]: r["n"] for r in self.index.groupBy("column").agg(F.max("n_values").alias("n")).collect()}
        ends = list(accumulate([sizes[c] for c in self.categories], initial=len(self.numbers)))
        self.offsets, self.width = dict(zip(self.categories, ends)), ends[-1]
        return self

    def transform(self, df: DataFrame, keep: list[str], output: str = "features") -> DataFrame:
        """``keep`` and the vector: the numbers in order, then each category column by its places.

        The vectors are made row by row: Spark's encoder and assembler describe
        every place of the vector on the driver.
        """
        width, n_numbers = self.width, len(self.numbers)

        @F.udf(VectorUDT())
        def sparse(numbers, places):
            if any(x != x for x in numbers):
                raise ValueError("NaN among the numbers")
            return Vectors.sparse(width, [*range(n_numbers), *places], [*numbers, *[1.0] * len(places)])

        numbers = [F.coalesce(F.col(c).cast("double"), F.lit(float(self.medians[c] or 0.0))).alias(f"{c}_number") for c in self.numbers]
        placed = with_places(df.select(*keep, *self.categories, *numbers), self.index, self.categories)
        values = F.array(*[F.col(f"{c}_number") for c in self.numbers]).cast("array<double>")
        places = F.array(*[F.col(f"{c}_place") + F.lit(self.offsets[c]) for c in self.categories]).cast("array<bigint>")
        return placed.select(*keep, sparse(values, places).alias(output))


def vector_sums(df: DataFrame, column: str) -> DataFrame:
    """``place``, ``total``: vectors of any width added up, a row a place that is set in any of them."""
    v = F.unwrap_udt(column)
    dense = F.transform(v["values"], lambda x, i: F.struct(i.alias("indices"), x.alias("values")))
    entries = F.when(v["indices"].isNull(), dense).otherwise(F.arrays_zip(v["indices"].alias("indices"), v["values"].alias("values")))
    return df.select(F.explode(entries).alias("x")).groupBy(F.col("x.indices").cast("long").alias("place")).agg(F.sum("x.values").alias("total"))


def candidate_columns(columns: list[str], *, coordinates: bool = True, minerals: bool = True, lithology: bool = True, places: bool = True) -> list[str]:
    """Feature names left after excluding whole families."""
    out = list(columns)
    if not coordinates:
        out = [c for c in out if c not in COORDINATES]
    if not minerals:
        out = [c for c in out if c not in MINERAL_FLAGS]
    if not lithology:
        out = [c for c in out if c not in GROUP_FLAGS]
    if not places:
        out = [c for c in out if not c.startswith(("region_", "country_"))]
    return out


def similarity_columns(selected: list[str]) -> list[str]:
    """Selected features that may enter edge similarity: all but coordinates."""
    return [c for c in selected if c not in COORDINATES]


NODE_MODES = {"features_only": (False, False), "no_score": (False, True), "no_edge_stats": (True, False), "full": (True, True)}


def node_features(selected: DataFrame, features: list[str], mode: str = "full", scores: DataFrame | None = None, stats: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Node inputs by mode: selected features, with or without the model score
    and the mean and max incoming edge weight."""
    if mode not in NODE_MODES:
        raise ValueError(f"mode must be one of {list(NODE_MODES)}, got {mode!r}")
    use_score, use_stats = NODE_MODES[mode]
    out, names = selected, list(features)
    if use_score:
        out, names = out.join(scores.select("row_id", "score"), "row_id"), [*names, "score"]
    if use_stats:
        out = out.join(stats.select("row_id", "mean_weight", "max_weight"), "row_id")
        names += ["mean_weight", "max_weight"]
    return out, names
