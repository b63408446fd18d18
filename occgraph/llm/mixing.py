"""Mixing sources to target weights by Pareto order sampling.

A source's target is shared out over its documents as expected copies. The
whole part is certain: every document gets it. The rest is a probability of
one more copy, and documents are ranked by random odds over inclusion odds,

    (u / (1 - u)) / (p / (1 - p)),

lowest first: Pareto order sampling, whose samples of a fixed size have
inclusion probabilities close to p. The size that is fixed here is the words
the source still lacks: documents are taken in that order until the next one
would pass it. The gap that leaves is filled by ``FILLS`` more runs in the same
order, each over documents of at most a quarter of the gap, so that every run
closes three quarters of it where such documents are left; documents that have
their extra copy come again after the others, up to the most copies allowed.

No key is sorted whole: running sums are taken over bins of the rank, and only
the bin in which a source's budget ends is sorted by rows.

Defined cases: null texts have size 0; a null source is a source, after all
others; a document of size 0 is taken 0 words. Repeated rows have equal ranks
and are interchangeable. Targets depend on sizes by source alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from occgraph.llm.common import WORD, free_name, one_of_each, uniform, with_row_key
from occgraph.session import clear_materialized, materialize

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
FILLS = 4
ROWS_PER_BIN = 2048
SALTS = 64


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``source``, ``source_size``, ``target`` from ``source``, ``source_size``: one row a source.

    Sources in code point order, null last, take the weights in turn and share
    the sum of all sizes. No target passes ``max_copies`` times its source;
    what it would have had beyond goes to the others by weight. That is the
    level at which the capped shares add up: sources are put in the order in
    which a rising level fills them. One row a source is sorted in one task.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    everything = W.orderBy(F.col("source").isNull(), F.col("source"))
    weighed = sizes.withColumn("w", F.element_at(cycle, ((F.row_number().over(everything) - 1) % len(weights) + 1).cast("int")).cast("long")).withColumn(
        "cap", F.col("source_size") * max_copies)
    filling = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before, here_on, whole = filling.rowsBetween(W.unboundedPreceding, -1), filling.rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(here_on)
    # the level's final value is the one of the first source that it doesn't fill
    levelled = weighed.withColumn("level", level).withColumn(
        "final", F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("at")))).over(whole)["at"])
    return levelled.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("final") * F.col("w"), F.col("cap").cast("double"))).alias("target"))


def _source_key() -> Column:
    return F.xxhash64(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")))


def _with_source(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """Join one row a source to rows, of which a source may have a third: its row is laid out for ``SALTS`` parts of them."""
    part = F.pmod(F.xxhash64("doc_id", "tie"), F.lit(SALTS)).cast("int")
    laid_out = by_source.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("part", part).join(laid_out, ["source_key", "part"]).drop("part")


def _one_run(state: DataFrame, share: int, bins: int, max_copies: int) -> DataFrame:
    """Take one more copy of rows in order of rank until the next would pass the source's budget; of rows with ``share`` times their size within it."""
    budgets = state.groupBy("source_key").agg((F.first("target") - F.sum((F.col("whole") + F.col("extra")) * F.col("size"))).alias("budget"))
    fits = F.col("odds").isNotNull() & (F.col("whole") + F.col("extra") < max_copies) & (F.col("size") * share <= F.col("budget"))
    order = F.least(F.floor(F.col("odds") / (1 + F.col("odds")) * bins), F.lit(bins - 1))
    bin_ = (F.col("extra") * (bins + 1) + F.coalesce(order, F.lit(bins))).cast("long")  # rows taken before come after those that weren't
    binned = _with_source(state, budgets).withColumn("bin", bin_).withColumn("fits", fits).withColumn("counted", F.when(F.col("fits"), F.col("size")).otherwise(F.lit(0)))
    sums = binned.groupBy("source_key", "bin").agg(F.sum("counted").alias("bin_size"))
    earlier = W.partitionBy("source_key").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    below = sums.select("source_key", "bin", F.coalesce(F.sum("bin_size").over(earlier), F.lit(0)).alias("below"))
    upto = W.partitionBy("source_key", "bin").orderBy("odds", F.col("doc_id").isNull(), "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, 0)
    placed = binned.join(below, ["source_key", "bin"]).withColumn("upto", F.col("below") + F.sum("counted").over(upto))
    now = F.col("fits") & (F.col("upto") <= F.col("budget"))
    return placed.withColumn("extra", F.col("extra") + now.cast("long")).select(*state.columns)


def mix_copies(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weight: str | None = None, row_key: list[str] | None = None,
               weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = 0, owner: str = "mixing") -> DataFrame:
    """``doc_id``, ``row_key``, ``source``, ``size``, ``source_size``, ``target``, ``copies`` for every row of ``docs``.

    ``weight`` names a column of rates, not negative: documents of a source
    are expected to be taken in proportion to it (null: 1); without it all at
    the same rate. ``row_key`` names two columns that are handed on as a struct.
    """
    rows = materialize(docs.select(
        F.col(doc_id).alias("doc_id"), F.struct(*[(F.col(row_key[i]) if row_key else F.lit(0).cast("long")).alias(f"k{i + 1}") for i in range(2)]).alias("row_key"), F.col(source).cast("string").alias("source"),
        word_count(F.col(text)).alias("size"), (F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)).alias("rate"),
        F.xxhash64(text).alias("tie")), owner)
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("rate")).alias("rated"), F.count("*").alias("n"))
    targets = source_targets(sums.select("source", "source_size"), weights, max_copies).alias("t")
    targets = materialize(targets.join(sums.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source"))).select(
        "t.source", "t.source_size", "target", "rated", "n").withColumn("source_key", _source_key()), owner)
    bins = max(1, (targets.agg(F.sum("n")).first()[0] or 0) // ROWS_PER_BIN)
    rate = F.try_divide(F.col("target"), F.col("rated")) * F.col("rate")
    u, p = uniform(F.lit(seed), F.col("doc_id")), F.col("expected") - F.floor("expected")
    drawn = _with_source(rows.withColumn("source_key", _source_key()), targets.select("source_key", "source_size", "target", "rated")).withColumn(
        "expected", F.least(F.lit(float(max_copies)), F.coalesce(rate, F.lit(0.0)))).withColumn("whole", F.floor("expected")).withColumn("u", u).withColumn(
        "odds", F.when(p > 0, (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))))
    state = materialize(drawn.select(
        "doc_id", "row_key", "source", "source_key", "size", "source_size", "target", "tie", "whole", "odds", F.lit(0).cast("long").alias("extra")), owner)
    for share in [1] + [4] * FILLS:
        state = materialize(_one_run(state, share, bins, max_copies), owner)
    return state.select("doc_id", "row_key", "source", "size", "source_size", "target", (F.col("whole") + F.col("extra")).alias("copies"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", owner: str = "mixing", **options) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken, every column as it was.

    Rows that are the same in all columns are one row with the sum of their copies.
    """
    clear_materialized(docs.sparkSession, owner)
    keyed, key = with_row_key(docs)
    times = free_name(docs, "copies")
    copies = mix_copies(keyed, doc_id, source, text, row_key=key, owner=owner, **options)
    sums = materialize(copies.groupBy(F.col("row_key.k1").alias(key[0]), F.col("row_key.k2").alias(key[1])).agg(
        F.sum("copies").cast("int").alias(times), F.count("*").alias("n")), owner)
    if not sums.filter("n > 1").isEmpty():
        keyed = one_of_each(keyed, key, F.lit(True))
    taken = sums.filter(F.col(times) > 0).select(*key, times)
    return keyed.join(taken, key).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
