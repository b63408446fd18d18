"""What the corpus operators share: column access, bytes of text, random numbers from keys."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word: no ASCII white space. ``bytes.split()`` cuts at the same characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def with_row_key(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` and two columns that hash all others: rows with the same key are the same row, repeated."""
    names = [free_name(df, "row_key_1"), free_name(df, "row_key_2")]
    return df.withColumns({names[0]: F.xxhash64(*df.columns), names[1]: F.xxhash64(F.lit(1), *df.columns)}), names


def one_of_each(df: DataFrame, key: list[str], where: Column) -> DataFrame:
    """``df`` with one row of each key where the condition holds, and all other rows."""
    place = free_name(df, "place_in_key")
    return df.withColumn(place, F.row_number().over(W.partitionBy(*key).orderBy(*key))).filter((F.col(place) == 1) | ~where).drop(place)


#: Bits of a map of keys: 16 a key, and 8 MB at most.
_MAP = (1 << 15, 1 << 26)


def marked(df: DataFrame, key: list[str], wanted: DataFrame, into: str) -> DataFrame:
    """``df`` with a boolean ``into``: false only for rows whose key is not in ``wanted`` (its columns in the order of ``key``).

    A map of hash bits is broadcast, so a join that few rows can meet needn't
    shuffle the others. Some rows are marked by chance, one in 16 and, beyond
    four million keys, more: the join itself stays. ``wanted`` is read twice.
    """
    least, most = _MAP
    bits = min(most, max(least, 1 << (16 * wanted.count()).bit_length()))
    place = lambda columns: F.pmod(F.xxhash64(F.lit("map"), *columns), F.lit(bits)) + 1
    own = wanted.select(place([F.col(c) for c in wanted.columns]).alias("place"))
    bucket, bitmap = free_name(df, "map_bucket"), free_name(df, "map_bits")
    maps = own.groupBy(F.bitmap_bucket_number("place").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias(bitmap))
    here = F.bitmap_bit_position(place([F.col(c) for c in key]))
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.shiftright(here, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    is_set = F.floor(byte / F.pow(F.lit(2.0), F.pmod(here, F.lit(8)))).cast("long").bitwiseAND(F.lit(1)) == 1
    found = df.withColumn(bucket, F.bitmap_bucket_number(place([F.col(c) for c in key]))).join(F.broadcast(maps), bucket, "left")
    return found.select(*df.columns, F.coalesce(is_set, F.lit(False)).alias(into))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def pieces(column: pa.Array, rows: int = 256, size: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """The column's texts in runs of few rows and few bytes, each with its first row: bounded memory for long texts."""
    start, run, held = 0, [], 0
    for i in range(len(column)):
        run += texts(column.slice(i, 1))
        held += len(run[-1])
        if len(run) == rows or held >= size:
            yield start, run
            start, run, held = i + 1, [], 0
    if run:
        yield start, run


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) from the MD5 of the keys: the same on every cluster and in SQL; null counts as a key."""
    joined = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def uniform_sql(*keys: str) -> str:
    """DuckDB's twin of ``uniform``."""
    joined = "||'|'||".join(f"coalesce(({k})::VARCHAR, 'null')" for k in keys)
    return f"(('0x'||substr(md5({joined}),1,13))::BIGINT/{float(1 << 52)!r}::DOUBLE)"
