"""Fixture views over the driver tables, once as Spark frames and once as SQL.

Each view stands in for one input of the engine; both forms give equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occgraph.functions.hashing import hash_uniform

MODELS = {"m1": 0.5, "m2": 0.7, "m3": 0.9}
SEEDS = [42, 1, 2, 4, 7]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def u_sql(*parts: str) -> str:
    """DuckDB twin of ``hash_uniform`` over SQL string expressions."""
    key = "||'|'||".join(f"({p})::VARCHAR" for p in parts)
    return f"(('0x'||substr(md5({key}),1,8))::BIGINT/4294967296.0)"


# --- sites: coordinates, region, label --------------------------------------

def sites(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    raw_lon = F.lit(-170.0) + F.lit(14.2) * F.col("c_nationkey") + (F.col("c_custkey") * 104729 % 1200) / F.lit(100.0)
    return table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("row_id"), F.col("n_name").alias("country"), F.col("r_name").alias("region"),
        (F.col("c_acctbal") > 4500).cast("int").alias("label"),
        (F.lit(-60.0) + 24 * F.col("r_regionkey") + (F.col("c_custkey") * 7919 % 2000) / F.lit(100.0)).alias("lat"),
        F.when(raw_lon >= 180, raw_lon - 360).otherwise(raw_lon).alias("lon"),
    )


SITES = """sites AS (
  SELECT c_custkey AS row_id, n_name AS country, r_name AS region, (c_acctbal > 4500)::INT AS label,
         -60.0::DOUBLE + 24*r_regionkey + (c_custkey*7919%2000)/100.0::DOUBLE AS lat,
         CASE WHEN -170.0::DOUBLE + 14.2::DOUBLE*c_nationkey + (c_custkey*104729%1200)/100.0::DOUBLE >= 180
              THEN -170.0::DOUBLE + 14.2::DOUBLE*c_nationkey + (c_custkey*104729%1200)/100.0::DOUBLE - 360
              ELSE -170.0::DOUBLE + 14.2::DOUBLE*c_nationkey + (c_custkey*104729%1200)/100.0::DOUBLE END AS lon
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def hav_sql(a: str, b: str) -> str:
    return (
        f"(2*6371.0::DOUBLE*asin(sqrt(least(1.0::DOUBLE, pow(sin((radians({b}.lat)-radians({a}.lat))/2),2)"
        f"+cos(radians({a}.lat))*cos(radians({b}.lat))*pow(sin((radians({b}.lon)-radians({a}.lon))/2),2)))))"
    )


def knn_sql(name: str, k: int, q: str = "sites", p: str = "sites", exclude: bool = True, on: str = "TRUE", keys: str = "") -> str:
    """Brute-force twin of the neighbour join, as a CTE."""
    diff = "AND a.row_id <> b.row_id" if exclude else ""
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} src ORDER BY round(dist_km,6), dst) AS rn
      FROM (SELECT {keys} a.row_id AS src, b.row_id AS dst, {hav_sql('a','b')} AS dist_km
            FROM {q} a JOIN {p} b ON {on} {diff})) WHERE rn <= {k})"""


# --- site_attrs: numbers, nulls, one category, five overlapping flags -------

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
FLAGS = ["is_f1", "is_f2", "is_f3", "is_f4", "is_f5"]


def site_attrs(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n_orders"), F.avg("o_totalprice").alias("avg_total"),
        *[F.max(((F.col("o_orderpriority") == p) & (F.col("o_totalprice") > 350000)).cast("int")).alias(f) for p, f in zip(PRIORITIES, FLAGS)],
    )
    return table(spark, sf, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("row_id"), F.col("c_mktsegment").alias("segment"),
        F.coalesce("n_orders", F.lit(0)).alias("n_orders"), "avg_total",
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("sparse_value"),
        *[F.coalesce(f, F.lit(0)).alias(f) for f in FLAGS],
    )


SITE_ATTRS = f"""site_attrs AS (
  SELECT c_custkey AS row_id, c_mktsegment AS segment, coalesce(n_orders,0) AS n_orders, avg_total,
         CASE WHEN c_custkey%7<>0 THEN c_acctbal END AS balance, CASE WHEN c_custkey%3=0 THEN c_acctbal END AS sparse_value,
         {', '.join(f'coalesce({f},0) AS {f}' for f in FLAGS)}
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, avg(o_totalprice) AS avg_total,
         {', '.join(f"max((o_orderpriority='{p}' AND o_totalprice>350000)::INT) AS {f}" for p, f in zip(PRIORITIES, FLAGS))}
       FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey)"""


# --- preds: long prediction table -------------------------------------------

def preds(spark: SparkSession, sf: str) -> DataFrame:
    combos = F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(w).alias("w"), F.lit(s).alias("seed")) for m, w in MODELS.items() for s in SEEDS
    ])
    rows = sites(spark, sf).select("row_id", "region", F.col("label").alias("y_true"), F.explode(combos).alias("c")).select("*", "c.*")
    u1 = hash_uniform(F.col("model"), F.col("seed"), F.col("row_id"))
    u2 = hash_uniform(F.lit("b"), F.col("model"), F.col("seed"), F.col("row_id"))
    p = F.round(F.col("w") * u1 + (1 - F.col("w")) * F.col("y_true") * u2, 3)
    return rows.select(
        "model", "seed", "region", "row_id", "y_true", p.alias("y_prob")
    ).withColumn("y_pred", (F.col("y_prob") >= 0.5).cast("int"))


PREDS = SITES + f""", preds AS (
  SELECT *, (y_prob >= 0.5)::INT AS y_pred FROM (
  SELECT model, seed, region, row_id, label AS y_true,
         round(w*{u_sql('model','seed','row_id')} + (1-w)*label*{u_sql("'b'",'model','seed','row_id')}, 3) AS y_prob
  FROM sites, (VALUES {', '.join(f"('{m}',{w}::DOUBLE)" for m, w in MODELS.items())}) mm(model,w),
       (VALUES {', '.join(f'({s})' for s in SEEDS)}) ss(seed)))"""


# --- roles: a fixed train/val/test partition of the sites -------------------

def roles(spark: SparkSession, sf: str) -> DataFrame:
    u = hash_uniform(F.lit("role"), F.col("row_id"))
    return sites(spark, sf).withColumn("role", F.when(u < 0.2, "test").when(u < 0.36, "val").otherwise("train"))


ROLES = SITES + f""", roles AS (SELECT *, CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.36 THEN 'val' ELSE 'train' END AS role
  FROM (SELECT *, {u_sql("'role'", 'row_id')} AS u FROM sites))"""


# --- feats: a small feature vector per site, some all zero ------------------

FEATS_COLS = ["f0", "f1", "f2"]


def feats(spark: SparkSession, sf: str) -> DataFrame:
    a = site_attrs(spark, sf)
    zero = F.col("row_id") % 17 == 0
    f = [F.col("is_f1").cast("double"), F.col("n_orders") / F.lit(21.0), F.coalesce(F.col("balance"), F.lit(0.0)) / F.lit(9973.0)]
    return a.select("row_id", *[F.when(zero, 0.0).otherwise(c).alias(n) for c, n in zip(f, FEATS_COLS)]).withColumn(
        "geo", F.array(*FEATS_COLS)
    )


FEATS = SITE_ATTRS + """, feats AS (SELECT row_id, CASE WHEN row_id%17=0 THEN 0.0::DOUBLE ELSE is_f1::DOUBLE END AS f0,
  CASE WHEN row_id%17=0 THEN 0.0::DOUBLE ELSE n_orders/21.0::DOUBLE END AS f1,
  CASE WHEN row_id%17=0 THEN 0.0::DOUBLE ELSE coalesce(balance,0.0)/9973.0::DOUBLE END AS f2 FROM site_attrs)"""


# --- occ: raw occurrence text, one row per order ----------------------------

WORDS = {
    "mineral": [
        "apatite", "magnetite", "fluorite", "pyrite", "chalcopyrite", "calcite", "dolomite", "garnet", "quartz",
        "feldspar", "zircon", "monazite-(Ce)", "xenotime-(Y)", "Y-rich fluorite", "silver-rich galena", "HREE",
        "LREE phosphates", "Ce", "barite", "columbite-(Fe)", "rutile", "gold", "la-oxide", "sylvite", "cerussite",
    ],
    "deposit": [
        "Carbonatite", "Carbonatite with residual enrichment", "Alkaline igneous", "Iron oxide-apatite", "Other igneous",
        "Metamorphic", "Phosphorite", "Black shale", "Sedimentary", "Coal", "Bauxite", "Placer (paleo)?", "Fluorite deposit",
        "Uranium deposit", "Hydrothermal Fe-oxide", "Iron oxide", "Unclassified", "Tailings", "Supergene", "Skarn",
        "Clay, ion adsorption", "Vein; pegmatite", "Contact REE skarn", "Monazite placer", "unknown",
    ],
    "lith": [
        "carbonatite, dolomite", "Nepheline syenite", "granite, gneiss / schist", "sand, gravel", "bauxite, clay", "gabbro",
        "shale", "sandstone, siltstone", "unclassified", "beach sand", "granitoid", "fenite, urtite, laterite",
    ],
    "commodity": ["Nb, Ta", "Th, U", "REE, Nb", "P", "F, Zr", "rare earth elements, Th", "Fe", "zr; nb", "U; P; F"],
    "note": ["adsorption clays", "vein swarm", "no data", "alkali complex", "placer REE", "hydrothermal alteration", ""],
    "rectype": ["site", "site(?)", "district or area", "intrusion or complex", "mine"],
    "reemin": ["Monazite, xenotime", "bastnasite; monazite", "", "Xenotime", "apatite, Monazite; zircon", "allanite"],
}


def _pick(kind: str, *key):
    words = F.array(*[F.lit(w) for w in WORDS[kind]])
    return F.element_at(words, (F.floor(hash_uniform(F.lit(kind), *key) * len(WORDS[kind])) + 1).cast("int"))


def _pick_sql(kind: str, *key: str) -> str:
    words = "[" + ", ".join("'" + w + "'" for w in WORDS[kind]) + "]"
    return f"{words}[floor({u_sql(repr(kind), *key)}*{len(WORDS[kind])})::INT+1]"


_NULLS = {"dep_type": 0.12, "host_lith": 0.55, "commods": 0.2, "dep_note": 0.5, "rec_note": 0.6, "rec_type": 0.1, "ree_mins": 0.4,
          "components": 0.7, "part_of": 0.8}


def occ(spark: SparkSession, sf: str) -> DataFrame:
    place = sites(spark, sf).select(F.col("row_id").alias("o_custkey"), "region", "country", "lat", "lon")
    mineral = _pick("mineral", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")).alias("mineral")
    mins = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", mineral).groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "mineral")))["mineral"].alias("mins"))
    key = F.col("row_id")
    null = lambda name, c: F.when(hash_uniform(F.lit("null " + name), key) >= _NULLS[name], c).alias(name)
    dep = F.concat_ws("; ", _pick("deposit", key), F.when(key % 3 == 0, _pick("deposit", F.lit("2"), key)))
    return (
        table(spark, sf, "orders").repartition("o_orderkey").join(place, "o_custkey").join(mins, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .withColumn("row_id", F.col("o_orderkey"))
        .select(
            "row_id", (F.col("row_id") - F.when(F.col("row_id") % 50 == 49, 1).otherwise(0)).alias("id_no"),
            F.when(key % 37 != 0, F.col("region")).alias("region"), "country", "lat", "lon",
            null("dep_type", dep), F.when(key % 11 != 0, F.array_join("mins", ", ")).alias("sig_mins"),
            null("host_lith", _pick("lith", key)), null("commods", _pick("commodity", key)),
            null("dep_note", _pick("note", F.lit("d"), key)), null("rec_note", _pick("note", F.lit("r"), key)),
            null("rec_type", _pick("rectype", key)), null("ree_mins", _pick("reemin", key)),
            null("components", F.lit("yes")), null("part_of", F.lit("belt")),
        )
    )


def _null_sql(name: str, expr: str) -> str:
    tag = repr("null " + name)
    return f"CASE WHEN {u_sql(tag, 'row_id')} >= {_NULLS[name]} THEN {expr} END AS {name}"


OCC = SITES + f""", occ AS (SELECT row_id, row_id - CASE WHEN row_id%50=49 THEN 1 ELSE 0 END AS id_no,
   CASE WHEN row_id%37<>0 THEN region END AS region, country, lat, lon,
   {_null_sql('dep_type', f"concat_ws('; ', {_pick_sql('deposit','row_id')}, CASE WHEN row_id%3=0 THEN {_pick_sql('deposit', repr('2'), 'row_id')} END)")},
   CASE WHEN row_id%11<>0 THEN mins END AS sig_mins,
   {_null_sql('host_lith', _pick_sql('lith','row_id'))}, {_null_sql('commods', _pick_sql('commodity','row_id'))},
   {_null_sql('dep_note', _pick_sql('note', repr('d'), 'row_id'))}, {_null_sql('rec_note', _pick_sql('note', repr('r'), 'row_id'))},
   {_null_sql('rec_type', _pick_sql('rectype','row_id'))}, {_null_sql('ree_mins', _pick_sql('reemin','row_id'))},
   {_null_sql('components', "'yes'")}, {_null_sql('part_of', "'belt'")}
   FROM (SELECT o_orderkey AS row_id, s.region, s.country, s.lat, s.lon, mins FROM orders JOIN sites s ON o_custkey = s.row_id
     LEFT JOIN (SELECT l_orderkey, string_agg({_pick_sql('mineral','l_orderkey','l_linenumber','l_partkey')}, ', ' ORDER BY l_linenumber, l_partkey) AS mins
                FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey))"""


# --- docs: free text fields -------------------------------------------------

def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select(
        F.col("doc_id").alias("row_id"), "text", "source",
        F.when(F.col("lang") != "en", F.col("lang")).alias("lang"), "quality", "toxic",
    )


DOCS = """docs AS (SELECT d.doc_id AS row_id, text, source, CASE WHEN lang<>'en' THEN lang END AS lang, quality, toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def with_sql(ctes: list[str], body: str) -> str:
    return "WITH " + ", ".join(ctes) + " " + body
