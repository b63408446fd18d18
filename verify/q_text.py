"""Row, column and text-rule operators."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from occgraph.functions import rules as R
from occgraph.functions import text as X
from occgraph.operators import table as B
from verify.registry import query
from verify.views import DOCS, OCC, PREDS, SITE_ATTRS, SITES, docs, occ, preds, site_attrs, sites, table, with_sql

_SYM = "|".join(R.RARE_EARTH_SYMBOLS)
_SUF = "|".join(R.RARE_EARTH_SUFFIXES)
_PAT = rf"\b(lree|hree|ree)\b|(^|[^a-z])({_SYM})([^a-z]|$)|({_SYM})-({_SUF})"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- rows, columns, predicates ----------------------------------------------

@query(with_sql([OCC], "SELECT row_id, region FROM occ WHERE region IS DISTINCT FROM 'ASIA'"))
def exclude_region_keep_null(spark, sf):
    return B.exclude_value(occ(spark, sf), "region", "ASIA").select("row_id", "region")


@query(with_sql([OCC], "SELECT row_id, region FROM occ WHERE region IS NOT NULL AND region <> 'ASIA'"))
def exclude_region_and_null(spark, sf):
    return B.exclude_value_and_null(occ(spark, sf), "region", "ASIA").select("row_id", "region")


@query(with_sql([OCC], "SELECT row_id, country, region FROM occ"))
def drop_listed_columns(spark, sf):
    return B.drop_columns(occ(spark, sf).select("row_id", "country", "region", "dep_note", "components"), ["dep_note", "components", "not_there"])


@query(with_sql([OCC], "SELECT row_id, (replace(lower(ree_mins),' ','') IS NOT NULL)::INT AS label FROM occ"))
def label_from_text(spark, sf):
    o = occ(spark, sf).withColumn("ree_mins", X.normalise(F.col("ree_mins")))
    return o.select("row_id", B.label_not_null("ree_mins"))


@query("SELECT c_custkey, c_acctbal FROM customer")
def pruned_scan(spark, sf):
    from occgraph.sources.io import scan

    return scan(spark, f"{sf}/customer.parquet", columns=["c_custkey", "c_acctbal"])


_SYS_TEXT = "lower(regexp_replace(coalesce(dep_type,'')||' '||coalesce(dep_note,'')||' '||coalesce(rec_note,''), " + q(f"(?i)({R.SYSTEM_SCRUB})") + ", '', 'g'))"
_SYS = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(t, {q(w)})" for w in words) + f" THEN {q(label)}" for label, words in R.SYSTEM_RULES
) + " WHEN lower(trim(coalesce(dep_type,''))) NOT IN ('','nan','unknown') THEN 'other' ELSE 'unknown' END"


@query(with_sql([OCC], f"""SELECT row_id, (components IS NOT NULL)::INT AS is_composite_system, (part_of IS NOT NULL)::INT AS is_part_of_complex,
  {_SYS} AS system_class, rec_type AS rec_type_raw FROM (SELECT *, {_SYS_TEXT} AS t FROM occ)"""))
def pre_drop_features(spark, sf):
    o = occ(spark, sf)
    return B.attach_by_row(o.select("row_id"), B.hierarchy_features(o))


@query(with_sql([OCC], "SELECT id_no, row_id, sig_mins FROM (SELECT *, row_number() OVER (PARTITION BY id_no ORDER BY row_id) AS rn FROM occ) WHERE rn = 1"))
def keep_first_dedup(spark, sf):
    return B.keep_first(occ(spark, sf).select("id_no", "row_id", "sig_mins"), "id_no")


@query(with_sql([SITE_ATTRS], " UNION ALL ".join(
    f"SELECT '{c}' AS field, round(avg(({c} IS NULL)::INT),6) AS missing_ratio, (avg(({c} IS NULL)::INT) < 0.5)::INT AS kept FROM site_attrs"
    for c in ("segment", "avg_total", "balance", "sparse_value"))))
def missing_ratio_prune(spark, sf):
    a = site_attrs(spark, sf).select("segment", "avg_total", "balance", "sparse_value")
    return B.missing_ratios(a).select("field", F.round("missing_ratio", 6).alias("missing_ratio"), (F.col("missing_ratio") < 0.5).cast("int").alias("kept"))


@query(with_sql([SITES], "SELECT count(*) AS n, count(*) FILTER (lat IS NULL OR lon IS NULL) AS n_missing FROM sites"))
def coordinate_report(spark, sf):
    return B.coordinate_report(B.require_coordinates(sites(spark, sf)))


@query(with_sql([PREDS], """SELECT model, seed, row_id, (y_prob >= 0.5)::INT AS y_class, greatest(0.0, least(1.0, round(y_prob*3-1,3))) AS clipped,
  CASE WHEN y_true=1 AND y_prob>=0.5 THEN 'TP' WHEN y_true=0 AND y_prob<0.5 THEN 'TN' WHEN y_true=0 THEN 'FP' ELSE 'FN' END AS outcome,
  CASE model WHEN 'm1' THEN 'Model One' WHEN 'm2' THEN 'Model Two' ELSE model END AS display FROM preds"""))
def threshold_clip_confusion(spark, sf):
    p = preds(spark, sf).withColumn("y_class", B.to_class(F.col("y_prob")))
    return p.select(
        "model", "seed", "row_id", "y_class", B.clip01(F.round(F.col("y_prob") * 3 - 1, 3)).alias("clipped"),
        B.confusion(F.col("y_true"), F.col("y_class")).alias("outcome"),
        B.display_names(F.col("model"), {"m1": "Model One", "m2": "Model Two"}).alias("display"))


@query(with_sql([SITE_ATTRS], "SELECT row_id, is_f1+is_f2+is_f3+is_f4+is_f5 AS n_flags FROM site_attrs"))
def flag_count(spark, sf):
    return site_attrs(spark, sf).select("row_id", B.count_flags(["is_f1", "is_f2", "is_f3", "is_f4", "is_f5"]).alias("n_flags"))


@query(with_sql([SITES], "SELECT row_id, country FROM (SELECT *, sum(label) OVER (PARTITION BY country) AS c FROM sites) WHERE c >= 28"))
def group_size_filter(spark, sf):
    return B.groups_of_size(sites(spark, sf), ["country"], 28, F.col("label") == 1).select("row_id", "country")


# --- text -------------------------------------------------------------------

@query(with_sql([OCC], "SELECT row_id, replace(lower(ree_mins),' ','') AS norm, coalesce(contains(sig_mins,'-'),false)::INT AS has_dash FROM occ"))
def normalised_text(spark, sf):
    return occ(spark, sf).select("row_id", X.normalise(F.col("ree_mins")).alias("norm"), X.has_dash(F.col("sig_mins")).cast("int").alias("has_dash"))


_LISTED = "[" + ", ".join(
    f"CASE WHEN regexp_matches(lower(sig_mins), {q(rf'(^|[^a-z]){s}([^a-z]|$)|{s}-({_SUF})')}) THEN {q(s.upper())} END" for s in R.RARE_EARTH_SYMBOLS
) + r", CASE WHEN regexp_matches(lower(sig_mins), '\b(lree|hree|ree)\b') THEN 'REE_GENERIC' END]"


@query(with_sql([OCC], f"""SELECT row_id, coalesce(regexp_matches(lower(sig_mins), {q(_PAT)}), false)::INT AS mentions,
  coalesce(array_to_string(list_sort(list_filter({_LISTED}, lambda x: x IS NOT NULL)), '|'), '') AS listed FROM occ"""))
def rare_earth_mentions(spark, sf):
    m = F.col("sig_mins")
    return occ(spark, sf).select("row_id", X.mentions_rare_earth(m).cast("int").alias("mentions"), F.array_join(X.rare_earths_listed(m), "|").alias("listed"))


_SCRUB = f"nullif(array_to_string(list_filter(list_transform(string_split(sig_mins, ','), lambda x: trim(x)), lambda x: NOT regexp_matches(lower(x), {q(_PAT)})), ', '), '')"
SCRUBBED = OCC + f", scrubbed AS (SELECT row_id, {_SCRUB} AS mins FROM occ)"


def scrubbed(spark, sf):
    return occ(spark, sf).select("row_id", X.scrub_rare_earths(F.col("sig_mins")).alias("mins"))


@query(with_sql([SCRUBBED], "SELECT row_id, mins FROM scrubbed"))
def list_scrub(spark, sf):
    return scrubbed(spark, sf)


_TOKENS = "tokens AS (SELECT trim(unnest(string_split(mins, ','))) AS token FROM scrubbed WHERE mins IS NOT NULL)"


@query(with_sql([SCRUBBED, _TOKENS], "SELECT token, count(*) AS n FROM tokens GROUP BY token ORDER BY n DESC, token LIMIT 12"))
def token_vocab_topn(spark, sf):
    return X.vocabulary(scrubbed(spark, sf), "mins", 12)


@query(with_sql([SCRUBBED, _TOKENS, "vocab AS (SELECT token FROM (SELECT token, count(*) AS n FROM tokens GROUP BY token ORDER BY n DESC, token LIMIT 12))"],
  r"""SELECT 'has_'||replace(replace(replace(token,'-','_'),'(',''),')','') AS flag,
      count(*) FILTER (regexp_matches(coalesce(mins,''), '\b'||regexp_escape(token)||'\b')) AS n_records FROM vocab, scrubbed GROUP BY token"""))
def token_indicators(spark, sf):
    s = scrubbed(spark, sf)
    tokens = [r["token"] for r in X.vocabulary(s, "mins", 12).collect()]  # at most n strings
    flags = s.select("row_id", *X.token_flags("mins", tokens))
    names = flags.columns[1:]
    sums = flags.agg(*[F.sum(f"`{c}`").alias(c) for c in names])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("flag"), F.col(f"`{c}`").alias("n_records")) for c in names])).alias("s")).select("s.*")


_NORM = "translate(lower(coalesce(dep_type,'')), '?()', '')"
_PRIMARY = "replace(replace(replace({0},'with residual enrichment',''),'supergene',''),'tailings','')".format(_NORM)
_TERMS = f"list_filter(list_transform(regexp_split_to_array({_PRIMARY}, '[;,]'), lambda x: trim(x)), lambda x: x <> '')"


@query(with_sql([OCC], f"SELECT row_id, {_NORM} AS norm, array_to_string({_TERMS}, '|') AS terms FROM occ"))
def primary_deposit_terms(spark, sf):
    d = F.col("dep_type")
    return occ(spark, sf).select("row_id", X.normalise_deposit(d).alias("norm"), F.array_join(X.primary_deposits(d), "|").alias("terms"))


def _mineral_cases(guard: str) -> str:
    out = ""
    for every, some, outcome in R.MINERAL_RULES:
        tests = [f"contains(m,{q(w)})" for w in every] + (["(" + " OR ".join(f"contains(m,{q(w)})" for w in some) + ")"] if some else [])
        out += f" WHEN {guard} AND {' AND '.join(tests)} THEN {q(outcome)}"
    return out


def _cascade() -> str:
    sql = "CASE WHEN host_lith IS NOT NULL THEN host_lith" + _mineral_cases("len(d)=0")
    for words, mins, special, outcome in R.DEPOSIT_RULES:
        hit = "len(list_filter(d, lambda x: " + " OR ".join(f"contains(x,{q(w)})" for w in words) + ")) > 0"
        if mins:
            sql += f" WHEN {hit} AND (" + " OR ".join(f"contains(m,{q(w)})" for w in mins) + f") THEN {q(special)}"
        sql += f" WHEN {hit} THEN {q(outcome)}"
    return sql + _mineral_cases("list_contains(d,'unclassified')") + " ELSE 'unclassified' END"


FILLED = OCC + f""", filled AS (SELECT *, CASE WHEN host_lith IS NOT NULL THEN 'Direct' WHEN filled='unclassified' THEN 'Unclassified'
  WHEN contains(filled,'(inferred, low confidence)') THEN 'Tier2' ELSE 'Tier1' END AS tier FROM
  (SELECT *, {_cascade()} AS filled FROM (SELECT *, {_TERMS} AS d, lower(coalesce(sig_mins,'')) AS m FROM occ)))"""


@query(with_sql([FILLED], "SELECT row_id, filled AS host_lith, (host_lith IS NULL)::INT AS inferred, tier FROM filled"))
def rule_cascade(spark, sf):
    return X.fill_host_rock(occ(spark, sf)).select(
        "row_id", "host_lith", F.col("host_lith_inferred").cast("int").alias("inferred"), F.col("host_lith_tier").alias("tier"))


@query(with_sql([FILLED], "SELECT tier, count(*) AS n, count(*) FILTER (host_lith IS NULL) AS n_inferred FROM filled GROUP BY tier"))
def filled_counts(spark, sf):
    return X.fill_host_rock(occ(spark, sf)).groupBy(F.col("host_lith_tier").alias("tier")).agg(
        F.count("*").alias("n"), F.count_if("host_lith_inferred").alias("n_inferred"))


def _group_sql(words):
    return q(r"\b(" + "|".join(re.escape(w) for w in words) + r")\b")


@query(with_sql([FILLED], "SELECT row_id, " + ", ".join(
    f"regexp_matches(lower(filled), {_group_sql(w)})::INT AS is_{g}" for g, w in R.LITHOLOGY_GROUPS.items()) + " FROM filled"))
def multilabel_flags(spark, sf):
    return X.fill_host_rock(occ(spark, sf)).select("row_id", *X.lithology_flags(F.col("host_lith")))


@query(with_sql([OCC], f"SELECT {_SYS} AS system_class, count(*) AS n FROM (SELECT *, {_SYS_TEXT} AS t FROM occ) GROUP BY 1"))
def ordered_keyword_class(spark, sf):
    return occ(spark, sf).groupBy(X.system_class(F.col("dep_type"), F.col("dep_note"), F.col("rec_note")).alias("system_class")).agg(F.count("*").alias("n"))


_FLAG = r"(regexp_matches(coalesce(commods,''), '(?i)\b{e}\b') AND NOT regexp_matches(coalesce(commods,''), '(?i)\bREE\b|rare earth'))::INT"


@query(with_sql([OCC], "SELECT row_id, " + ", ".join(_FLAG.format(e=e) + f" AS has_{e}" for e in R.COMMODITIES) + ", " +
                "+".join(_FLAG.format(e=e) for e in R.COMMODITIES) + " AS commodity_count FROM occ"))
def safe_flags(spark, sf):
    return occ(spark, sf).select("row_id", *X.commodity_flags(F.col("commods")))


_CONCEPT = "contains(lower(coalesce(dep_type,'')||' '||coalesce(dep_note,'')), 'adsorp')"


@query(with_sql([OCC], f"""SELECT region, count(*) AS n, sum({_CONCEPT}::INT)::BIGINT AS n_concept, round(avg((ree_mins IS NOT NULL)::INT) FILTER ({_CONCEPT}),6) AS positive_rate,
  round(avg((host_lith IS NULL)::INT) FILTER (NOT {_CONCEPT}),6) AS other_rate FROM occ GROUP BY region"""))
def concept_flag_rates(spark, sf):
    from occgraph.operators.analytics import concept_rates

    o = occ(spark, sf).withColumn("concept", X.concept_flag("adsorp", F.col("dep_type"), F.col("dep_note"))).withColumn(
        "label", B.label_not_null("ree_mins")).withColumn("miss", F.col("host_lith").isNull().cast("int"))
    r = concept_rates(o, ["region"])
    return r.select("region", "n", "n_concept", F.round("positive_rate", 6).alias("positive_rate"), F.round("other_rate", 6).alias("other_rate"))


_FLAGS3 = ["carbonatite_system", "sedimentary", "placer"]
_GTOP = [FILLED, "fl AS (SELECT lower(ree_mins) AS text, " + ", ".join(
    f"regexp_matches(lower(filled), {_group_sql(R.LITHOLOGY_GROUPS[g])}) AS is_{g}" for g in _FLAGS3) + " FROM filled WHERE ree_mins IS NOT NULL)",
    "g AS (" + " UNION ALL ".join(f"SELECT 'is_{g}' AS grp, text FROM fl WHERE is_{g}" for g in _FLAGS3) + ")",
    "c AS (SELECT grp, token, count(*) AS n, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, token) AS rn FROM (SELECT grp, trim(unnest(regexp_split_to_array(text,'[,;]'))) AS token FROM g) WHERE token<>'' GROUP BY 1,2)"]


@query(with_sql(_GTOP, """SELECT c.grp, c.rn, c.token, c.n, s.n_records, s.top_share, k.n_groups_same_top FROM c
  JOIN (SELECT g.grp, t.token AS top, count(*) AS n_records, round(avg(contains(text, t.token)::INT),6) AS top_share FROM g JOIN c t ON t.grp=g.grp AND t.rn=1 GROUP BY 1,2) s ON s.grp=c.grp
  JOIN (SELECT token, count(*) AS n_groups_same_top FROM c WHERE rn=1 GROUP BY 1) k ON k.token = s.top WHERE c.rn <= 3"""))
def group_top_tokens(spark, sf):
    o = X.fill_host_rock(occ(spark, sf))
    o = o.select("ree_mins", *X.lithology_flags(F.col("host_lith")))
    return X.group_top_tokens(o, [f"is_{g}" for g in _FLAGS3], "ree_mins").withColumn("top_share", F.round("top_share", 6))


_FIELDS = ["text", "lang", "source", "quality", "toxic"]


@query(with_sql([DOCS], "SELECT row_id, " + "+".join(f"({f} IS NOT NULL)::INT" for f in _FIELDS) + """ AS n_nonempty_fields,
  length(coalesce(text,'')) AS text_len, length(coalesce(lang,'')) AS lang_len FROM docs"""))
def text_length_features(spark, sf):
    return X.completeness(docs(spark, sf), _FIELDS, ["text", "lang"]).select("row_id", "n_nonempty_fields", "text_len", "lang_len")


@query(with_sql([FILLED], "SELECT trim(unnest(string_split(filled, ','))) AS token, count(*) AS n FROM filled GROUP BY 1"))
def token_frequency(spark, sf):
    return X.token_counts(X.fill_host_rock(occ(spark, sf)), "host_lith")


@query(with_sql([OCC], "SELECT lower(dep_type) AS value, count(*) AS n FROM occ WHERE dep_type IS NOT NULL AND host_lith = 'shale' GROUP BY 1"))
def folded_value_counts(spark, sf):
    return X.folded_counts(occ(spark, sf).filter("host_lith = 'shale'"), "dep_type")
