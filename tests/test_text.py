"""Text rules: one row per branch, quirks and non-ASCII words."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from occgraph.functions import rules as R
from occgraph.functions import text as X


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("out")).first()["out"]


@pytest.mark.parametrize("text, want", [
    ("HREE minerals", True), ("apatite, Ce", True), ("silver-rich quartz", True), ("cerium", False), ("trees", False),
    ("Y-bearing", True), ("monazite-(Ce)", True), ("galena", False), (None, False), ("", False),
])
def test_mentions(spark, text, want):
    assert one(spark, X.mentions_rare_earth(F.col("t")), t=text) is want


def test_listed_symbols_overlap(spark):
    assert one(spark, X.rare_earths_listed(F.col("t")), t="Dy-rich, REE") == ["DY", "REE_GENERIC", "Y"]
    assert one(spark, X.rare_earths_listed(F.col("t")), t=None) == []


def test_scrub_to_null(spark):
    assert one(spark, X.scrub_rare_earths(F.col("t")), t="Ce, HREE") is None
    assert one(spark, X.scrub_rare_earths(F.col("t")), t="apatite ,Ce,\tzircon") == "apatite, zircon"


def test_label_counts_empty_text(spark):
    from occgraph.operators.table import label_not_null

    df = spark.createDataFrame([("",), (None,), ("x",)], "t string")
    assert [r.label for r in df.select(label_not_null("t")).collect()] == [1, 0, 1]


def test_token_ending_in_parenthesis_needs_a_word_after(spark):
    df = spark.createDataFrame([("columbite-(Fe), rutile",), ("columbite-(Fe)x",)], "m string")
    assert [tuple(r) for r in df.select(*X.token_flags("m", ["columbite-(Fe)", "rutile"])).collect()] == [(0, 1), (1, 0)]
    assert X.token_column("columbite-(Fe)") == "has_columbite_Fe"


CASCADE = [
    ("granite", "Carbonatite", None, "granite", "Direct"),
    *[(None, None, (", ".join(every) if every else some[0]), outcome, "Tier2") for every, some, outcome in R.MINERAL_RULES],
    *[(None, words[0].upper(), None, outcome, "Unclassified" if outcome == "unclassified" else "Tier1") for words, _, _, outcome in R.DEPOSIT_RULES],
    *[(None, words[0], mins[0], special, "Tier2") for words, mins, special, _ in R.DEPOSIT_RULES if mins],
    (None, "(Unclassified?)", "garnet", "metamorphic rock (inferred, low confidence)", "Tier2"),
    (None, "Tailings; supergene", "garnet", "metamorphic rock (inferred, low confidence)", "Tier2"),
    (None, "nearly unclassified", "garnet", "unclassified", "Unclassified"),
    (None, None, None, "unclassified", "Unclassified"),
    (None, "Coal, Bauxite", None, "sedimentary rock", "Tier1"),
]


def test_host_rock_branches(spark):
    rows = [(i, h, d, m) for i, (h, d, m, _, _) in enumerate(CASCADE)]
    df = spark.createDataFrame(rows, "i int, host_lith string, dep_type string, sig_mins string")
    found = {r.i: (r.host_lith, r.host_lith_tier) for r in X.fill_host_rock(df).collect()}
    assert found == {i: (rock, tier) for i, (_, _, _, rock, tier) in enumerate(CASCADE)}


def test_terms(spark):
    assert one(spark, X.primary_deposits(F.col("t")), t="Placer (paleo)?; Tailings,  Skarn") == ["placer paleo", "skarn"]


@pytest.mark.parametrize("deposit, note, want", [
    *[(words[0], None, name) for name, words in R.SYSTEM_RULES], ("Bastnäsite vein", None, "vein"), ("Iron", None, "other"),
    ("Unknown", None, "unknown"), (None, None, "unknown"), (None, "in a skarn", "skarn"), ("MONAZITE PLACER", None, "placer"),
])
def test_system_class(spark, deposit, note, want):
    assert one(spark, X.system_class(F.col("d"), F.col("n"), F.lit(None).cast("string")), d=deposit, n=note) == want


def test_commodity_guard(spark):
    df = spark.createDataFrame([("Nb, U",), ("REE, Nb",), ("nb; Rare Earth",), (None,)], "c string")
    assert [r.commodity_count for r in df.select(*X.commodity_flags(F.col("c"))).collect()] == [2, 0, 0, 0]


def test_lithology_flags(spark):
    df = spark.createDataFrame([("Granite, sövite",), ("granitoid",), (None,)], "h string")
    flags = df.select(*X.lithology_flags(F.col("h"))).collect()
    assert flags[0].is_felsic_pegmatite == 1 and flags[0].is_carbonatite_system == 1
    assert sum(flags[1]) == 0 and sum(flags[2]) == 0
