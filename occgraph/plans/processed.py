"""From the raw occurrence table to the processed table and the released graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occgraph.functions import rules as R
from occgraph.functions import text as X
from occgraph.operators import table as B
from occgraph.operators.graph import Graph, build_weighted_graph
from occgraph.session import materialize


def processed_table(raw: DataFrame, n_tokens: int = 180, drop_region: str | None = "Antarctica") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clean records, derive the label and all text flags.

    Returns the processed table, the lithology token counts and the records
    whose mineral list holds a dash (for review). Lithology is filled before
    the mineral list is scrubbed, because the rules read it.
    """
    kept = B.exclude_value(raw, "region", drop_region) if drop_region else raw
    filled = X.fill_host_rock(kept)
    labelled = filled.withColumn("ree_mins", X.normalise(F.col("ree_mins"))).withColumn("label", B.label_not_null("ree_mins"))
    scrubbed = materialize(labelled.withColumn("sig_mins", X.scrub_rare_earths(F.col("sig_mins"))))
    review = scrubbed.filter(X.has_dash(F.col("sig_mins"))).select("row_id", "id_no", "commods", "ree_mins", "sig_mins", "host_lith")
    tokens = [r["token"] for r in X.vocabulary(scrubbed, "sig_mins", n_tokens).collect()]  # at most n_tokens strings
    flags = X.token_flags("sig_mins", tokens)
    processed = scrubbed.select("*", *flags, *X.lithology_flags(F.col("host_lith"))).drop("sig_mins", "host_lith_inferred", "host_lith_tier")
    return B.drop_columns(processed, R.INGEST_DROP), X.token_counts(scrubbed, "host_lith"), review


def released_graph(processed: DataFrame, similarity: list[str], k: int = 15, alpha: float = 0.6, max_km: float = 2000.0) -> Graph:
    """The weighted graph over all processed records."""
    geo = F.array(*[F.col(f"`{c}`").cast("double") for c in similarity])
    nodes = processed.select("row_id", "region", "lat", "lon", "label", geo.alias("geo"))
    return build_weighted_graph(materialize(nodes), k, alpha=alpha, max_km=max_km)
