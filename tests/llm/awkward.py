"""Documents that operators must not stumble over."""

from __future__ import annotations

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the house of the old man is on the hill and it was not far from the sea so that we went there on foot in the evening"
LONG = " ".join(f"{PROSE} {i}" for i in range(4000))
ROWS = [
    (0, None, None, None, None),
    (1, "", "en", "a", 0),
    (2, "   \n\t ", "en", "a", 6),
    (3, PROSE, "en", "a", len(PROSE)),
    (3, PROSE, "en", "a", len(PROSE)),  # a repeated row
    (4, PROSE + " again", "en", None, 0),
    (None, "an id is missing here but words are not", "en", "b", 1),
    (5, LONG, "en", "b", len(LONG)),
    (6, "é😀 漢字 ñandú \x00\x1f <s>", None, "c", 3),
    (7, "w", "xx", "c", 1),
]
#: Names that operators use for columns of their own.
CLASHES = ["verdict", "fingerprint", "component_id", "row_of_copy", "repeats", "severity", "size", "target", "copies", "t1", "core", "bin", "rank", "vector", "h", "root", "kept", "curve"]


def documents(spark, rows=None, clashes: bool = True):
    df = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES}) if clashes else df


def own_columns_kept(df) -> bool:
    """Do the clashing columns still hold what they held?"""
    return all(df.filter(F.col(c) != f"own {c}").isEmpty() for c in CLASHES)
