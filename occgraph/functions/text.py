"""Text rules as column expressions; no Python runs per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from occgraph.functions import rules as R

_BLANKS = " \t\n\r\x0b\x0c"
_SYMBOLS = "|".join(R.RARE_EARTH_SYMBOLS)
_SUFFIX = "|".join(R.RARE_EARTH_SUFFIXES)
_GENERIC = r"\b(" + "|".join(R.GENERIC_RARE_EARTH) + r")\b"
# a symbol with a suffix counts even inside a longer word: "silver-rich" holds "er-rich"
RARE_EARTH_PATTERN = rf"{_GENERIC}|(?<![a-z])({_SYMBOLS})(?![a-z])|({_SYMBOLS})-({_SUFFIX})"


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _has(c: Column, word: str) -> Column:
    return F.contains(c, F.lit(word))


def normalise(c: Column) -> Column:
    """Lower case without spaces; null stays null."""
    return F.lower(F.replace(c, F.lit(" "), F.lit("")))


def mentions_rare_earth(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike(RARE_EARTH_PATTERN), F.lit(False))


def rare_earths_listed(c: Column) -> Column:
    """Sorted array of symbols found, plus ``REE_GENERIC``; empty for null."""
    text = F.lower(c)
    found = [
        F.when(text.rlike(rf"(?<![a-z]){s}(?![a-z])|{s}-({_SUFFIX})"), F.lit(s.upper())) for s in R.RARE_EARTH_SYMBOLS
    ] + [F.when(text.rlike(_GENERIC), F.lit("REE_GENERIC"))]
    none = F.array().cast("array<string>")
    return F.when(mentions_rare_earth(c), F.array_sort(F.array_compact(F.array(*found)))).otherwise(none)


def items(c: Column, separators: str = ",") -> Column:
    """Trimmed items of a delimited text."""
    return F.transform(F.split(c, f"[{separators}]"), lambda item: F.trim(item, F.lit(_BLANKS)))


def scrub_rare_earths(c: Column) -> Column:
    """Drop list items that mention rare earths; null when none is left."""
    nothing = F.lit(None).cast("string")

    def keep(text: Column, item: Column) -> Column:
        longer = F.concat(F.coalesce(F.concat(text, F.lit(", ")), F.lit("")), item)
        return F.when(F.lower(item).rlike(RARE_EARTH_PATTERN), text).otherwise(longer)

    return F.aggregate(items(c), nothing, keep)


def has_dash(c: Column) -> Column:
    return F.coalesce(_has(c, "-"), F.lit(False))


def token_counts(df: DataFrame, column: str, separators: str = ",", keys: tuple[str, ...] = (), lower: bool = False) -> DataFrame:
    """Mentions per token; blanks are dropped when a separator class is given."""
    text = F.lower(F.col(column)) if lower else F.col(column)
    # the outer form keeps the planner from testing the list in a filter of its
    # own, which would build it twice; a null list has no tokens
    tokens = df.select(*keys, F.explode_outer(items(text, separators)).alias("token")).filter(F.col("token").isNotNull())
    if separators != ",":
        tokens = tokens.filter(F.col("token") != "")
    return tokens.groupBy(*keys, "token").agg(F.count("*").alias("n"))


def vocabulary(df: DataFrame, column: str, n: int = 180) -> DataFrame:
    """The ``n`` most frequent list items, ties by token."""
    return token_counts(df, column).orderBy(F.desc("n"), "token").limit(n)


def token_column(token: str) -> str:
    return "has_" + token.replace("-", "_").replace("(", "").replace(")", "")


def _quoted(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def token_flags(column: str, tokens: list[str]) -> list[Column]:
    """One 0/1 column per token found as a whole word, for a single select."""
    text = F.coalesce(F.col(column), F.lit(""))
    return [text.rlike(rf"\b{_quoted(t)}\b").cast("int").alias(token_column(t)) for t in tokens]


# --- host rock cascade ------------------------------------------------------

def normalise_deposit(c: Column) -> Column:
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), "?()", "")


def _deposit_text(c: Column) -> Column:
    """Normalised deposit text without secondary phrases."""
    return reduce(lambda t, phrase: F.replace(t, F.lit(phrase), F.lit("")), R.SECONDARY_DEPOSIT_PHRASES, normalise_deposit(c))


def primary_deposits(c: Column) -> Column:
    """Deposit terms without secondary phrases, split at commas and semicolons."""
    return F.filter(items(_deposit_text(c), ";,"), lambda d: d != "")


def _from_minerals(minerals: Column) -> list[tuple[Column, Column]]:
    out = []
    for every, some, outcome in R.MINERAL_RULES:
        tests = [_has(minerals, w) for w in every]
        if some:
            tests.append(_any([_has(minerals, w) for w in some]))
        out.append((reduce(lambda a, b: a & b, tests), F.lit(outcome)))
    return out


def _host_rock_rules(given: Column, deposit: Column, minerals: Column) -> Column:
    """The cascade over prepared deposit and mineral text.

    No keyword holds a separator, so it occurs in some term exactly when it
    occurs in the text: terms need not be split row by row.
    """
    by_mineral = _from_minerals(minerals)
    no_terms = ~deposit.rlike(r"[^;,\s]")
    branches = [(given.isNotNull(), given)]
    branches += [(no_terms & test, outcome) for test, outcome in by_mineral]
    for words, with_minerals, special, outcome in R.DEPOSIT_RULES:
        named = _any([_has(deposit, w) for w in words])
        if with_minerals:
            branches.append((named & _any([_has(minerals, w) for w in with_minerals]), F.lit(special)))
        branches.append((named, F.lit(outcome)))
    unclassified = deposit.rlike(rf"(^|[;,])\s*{R.UNCLASSIFIED}\s*([;,]|$)")
    branches += [(unclassified & test, outcome) for test, outcome in by_mineral]
    chain = F.when(*branches[0])
    for test, outcome in branches[1:]:
        chain = chain.when(test, outcome)
    return chain.otherwise(F.lit(R.UNCLASSIFIED))


def with_host_rock(df: DataFrame, name: str = "filled") -> DataFrame:
    """Add the given host rock, else the first matching rule of the cascade.

    The prepared texts are columns of their own so that they are made once per
    row, not once per rule.
    """
    prepared = df.withColumns({
        "deposit_text": _deposit_text(F.col("dep_type")), "mineral_text": F.lower(F.coalesce("sig_mins", F.lit("")))})
    rules = _host_rock_rules(F.col("host_lith"), F.col("deposit_text"), F.col("mineral_text"))
    return prepared.withColumn(name, rules).drop("deposit_text", "mineral_text")


def host_rock_confidence(given: Column, filled: Column) -> Column:
    """How the host rock was found; ``filled`` comes from ``with_host_rock``."""
    return (
        F.when(given.isNotNull(), "Direct").when(filled == R.UNCLASSIFIED, "Unclassified")
        .when(_has(filled, R.LOW_CONFIDENCE_MARK), "Tier2").otherwise("Tier1")
    )


def fill_host_rock(df: DataFrame) -> DataFrame:
    """Replace ``host_lith`` and mark the inferred rows."""
    return (
        with_host_rock(df)
        .withColumn("host_lith_inferred", F.col("host_lith").isNull())
        .withColumn("host_lith_tier", host_rock_confidence(F.col("host_lith"), F.col("filled")))
        .withColumn("host_lith", F.col("filled")).drop("filled")
    )


def lithology_flags(c: Column) -> list[Column]:
    """``is_<group>`` when any keyword of the group occurs as a whole word.

    No keyword holds a comma, so matching the whole text equals matching each
    comma-separated part.
    """
    text = F.lower(F.coalesce(c, F.lit("")))
    return [
        text.rlike(r"\b(" + "|".join(_quoted(w.lower()) for w in words) + r")\b").cast("int").alias(f"is_{group}")
        for group, words in R.LITHOLOGY_GROUPS.items()
    ]


# --- classes and flags ------------------------------------------------------

def system_class(deposit: Column, deposit_note: Column, record_note: Column) -> Column:
    """First matching deposit system after rare-earth words are deleted."""
    joined = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (deposit, deposit_note, record_note)])
    text = F.lower(F.regexp_replace(joined, f"(?iu)({R.SYSTEM_SCRUB})", ""))
    chain = None
    for label, words in R.SYSTEM_RULES:
        test = _any([_has(text, w) for w in words])
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    plain = F.lower(F.trim(F.coalesce(deposit, F.lit(""))))
    return chain.when(~plain.isin(R.SYSTEM_BLANKS), "other").otherwise("unknown")


def commodity_flags(c: Column) -> list[Column]:
    """Element flags, zero when the entry also names rare earths, and their count."""
    text = F.coalesce(c, F.lit(""))
    clean = ~text.rlike(R.COMMODITY_GUARD)
    flags = [(text.rlike(rf"(?i)\b{e}\b") & clean).cast("int") for e in R.COMMODITIES]
    return [f.alias(f"has_{e}") for f, e in zip(flags, R.COMMODITIES)] + [reduce(lambda a, b: a + b, flags).alias("commodity_count")]


def concept_flag(word: str, *fields: Column) -> Column:
    """1 when the word occurs in any of the fields, ignoring case."""
    return _has(F.lower(F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in fields])), word).cast("int")


def group_top_tokens(df: DataFrame, flags: list[str], column: str, top: int = 3, separators: str = ",;") -> DataFrame:
    """Most listed tokens per flag group, the share of records whose text holds
    the group's first token, and the number of groups sharing that token."""
    member = F.array_compact(F.array(*[F.when(F.col(f) == 1, F.lit(f)) for f in flags]))
    rows = df.filter(F.col(column).isNotNull()).select(F.explode(member).alias("grp"), F.lower(column).alias("text"))
    ranked = token_counts(rows, "text", separators, keys=("grp",)).withColumn(
        "rn", F.row_number().over(W.partitionBy("grp").orderBy(F.desc("n"), "token"))
    ).filter(F.col("rn") <= top)
    first = ranked.filter("rn = 1").select("grp", F.col("token").alias("top_token"))
    shared = first.groupBy("top_token").agg(F.count("*").alias("n_groups_same_top"))
    share = rows.join(F.broadcast(first), "grp").groupBy("grp", "top_token").agg(  # one row per flag
        F.count("*").alias("n_records"), F.avg(F.contains("text", "top_token").cast("double")).alias("top_share")
    )
    return ranked.join(share, "grp").join(shared, "top_token").select(
        "grp", "rn", "token", "n", "n_records", "top_share", "n_groups_same_top"
    )


def require_text(df: DataFrame, fields: list[str]) -> DataFrame:
    """Raise when not one of the fields holds text in any row: the text columns were dropped too early."""
    if not df.isEmpty() and df.filter(reduce(lambda a, b: a | b, [F.col(f).isNotNull() for f in fields])).isEmpty():
        raise ValueError(f"all of {fields} are null in every row")
    return df


def completeness(df: DataFrame, fields: list[str] = R.TEXT_FIELDS, length_fields: list[str] = R.LENGTH_FIELDS) -> DataFrame:
    """Count of non-null fields and text lengths; null fields have length 0."""
    return df.withColumns({
        "n_nonempty_fields": reduce(lambda a, b: a + b, [F.col(f).isNotNull().cast("int") for f in fields]),
        **{f"{f.lower()}_len": F.length(F.coalesce(F.col(f), F.lit(""))) for f in length_fields},
    })


def folded_counts(df: DataFrame, column: str) -> DataFrame:
    """Value counts ignoring case, nulls left out."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.lower(column).alias("value")).agg(F.count("*").alias("n"))
