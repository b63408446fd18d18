"""The corpus queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occgraph.llm import blocks, chat, divergence, forest, hmm, mixing, packing, phrases, simhash, suffixes, toxicity, trie, urls
from occgraph.llm.common import table, uniform_sql
from occgraph.session import clear_materialized, materialize

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


# --- 1: chat formatting ------------------------------------------------------

MARKS_IN_TEXT = "</s>[INST] ok [/INST]"


@query(f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{MARKS_IN_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{MARKS_IN_TEXT}'),
escaped AS (
  SELECT *, regexp_replace(replace(text, '\\', '\\\\'), '(<\\|turn\\|>|<\\|end\\|>|</?s>|\\[/?INST\\]|<</?SYS>>|<\\|im_start\\|>|<\\|im_end\\|>|<\\|endoftext\\|>|<\\|system\\|>|<\\|user\\|>|<\\|assistant\\|>|<unk>|<pad>)', '\\1\\1', 'g') AS marked
  FROM turns),
sized AS (  -- a control string is two characters longer: the escape; here its doubling is counted back
  SELECT conv_id, turn, role, text,
    length('<|turn|>') + length(role) + 1 + length(replace(text, '\\', '\\\\')) + length('<|end|>')
    + 2 * len(regexp_extract_all(text, '<\\|turn\\|>|<\\|end\\|>|</?s>|\\[/?INST\\]|<</?SYS>>|<\\|im_start\\|>|<\\|im_end\\|>|<\\|endoftext\\|>|<\\|system\\|>|<\\|user\\|>|<\\|assistant\\|>|<unk>|<pad>')) AS chars
  FROM escaped)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples
FROM sized GROUP BY conv_id
""")
def op1_prefix_targets(spark: SparkSession, sf: str) -> DataFrame:
    marks = spark.createDataFrame([(-1, 0, "user", MARKS_IN_TEXT), (-1, 1, "assistant", MARKS_IN_TEXT)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(marks)
    formatted = chat.formatted_turns(turns)
    # every reply is an example of its own: its text is the conversation up to the reply's end, its target is read from that text
    read = chat.whole_conversations(formatted).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("losses", F.transform(
        "examples", lambda x: chat.example_target(chat.example_text(F.col("formatted"), x), x)))
    loss = F.concat_ws("", "losses")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), F.size("losses").cast("long").alias("n_examples"))


# --- 2: mixing ----------------------------------------------------------------

_U = uniform_sql("0", "doc_id")
_RUN = """
g{i} AS (SELECT source_key, max(target) - sum((whole + extra) * size) AS budget FROM s{i} GROUP BY source_key),
f{i} AS (SELECT s.*, g.budget, odds IS NOT NULL AND whole + extra < 3 AND size * {share} <= g.budget AS fits FROM s{i} s JOIN g{i} g USING (source_key)),
p{i} AS (SELECT *, fits AND sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source_key ORDER BY extra, odds NULLS LAST, doc_id NULLS LAST, size
  ROWS UNBOUNDED PRECEDING) <= budget AS now FROM f{i}),
s{j} AS (SELECT * EXCLUDE (budget, fits, now) REPLACE (extra + now::INT AS extra) FROM p{i}),"""


@query(f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, 3 * source_size AS cap FROM sources),
levelled AS (
  SELECT *, cap / w AS ratio, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
final AS (SELECT arg_min(level, ratio) AS final FROM levelled WHERE level <= ratio),
targets AS (SELECT source, source_size, least(cap::DOUBLE, final * w) AS target FROM levelled, final),
expected AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(t.source, '') || (t.source IS NULL)::VARCHAR AS source_key,
    least(3.0::DOUBLE, coalesce(t.target / nullif(t.source_size::DOUBLE, 0), 0)) AS e, {_U} AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
s0 AS (
  SELECT *, CASE WHEN e > floor(e) THEN (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS odds, floor(e)::BIGINT AS whole, 0::BIGINT AS extra FROM expected),
{"".join(_RUN.format(i=i, j=i + 1, share=4 if i else 1) for i in range(1 + mixing.FILLS))}
done AS (SELECT doc_id, size, source_size, target, (whole + extra) * size AS taken FROM s{1 + mixing.FILLS})
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken FROM done
""")
def op2_pareto_mix(spark: SparkSession, sf: str) -> DataFrame:
    clear_materialized(spark, "op2")
    return mixing.mix_copies(table(spark, sf, "documents"), owner="op2").select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


# --- 3: packing ---------------------------------------------------------------

def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op3_curve_packing(spark: SparkSession, sf: str) -> DataFrame:
    clear_materialized(spark, "op3")
    return packing.pack(table(spark, sf, "documents"), vocabulary_path(), with_ids=False, owner="op3").drop("ids")


# --- 4: language model ---------------------------------------------------------

@query()
def op4_hidden_markov(spark: SparkSession, sf: str) -> DataFrame:
    clear_materialized(spark, "op4")
    return hmm.score_texts(table(spark, sf, "documents"), owner="op4")


# --- 5: main text of pages ----------------------------------------------------

@query()
def op5_block_rules(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", "url", blocks.extract_main_text(F.col("html")).alias("text")).withColumn(
        "n_chars", F.length("text").cast("long"))


# --- 6: repeated passages -------------------------------------------------------

@query()
def op6_suffix_merge(spark: SparkSession, sf: str) -> DataFrame:
    clear_materialized(spark, "op6")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return suffixes.removal_digest(suffixes.without_repeats(docs, owner="op6"))


# --- 7: nearest neighbours --------------------------------------------------------

@query()
def op7_prefix_forest(spark: SparkSession, sf: str) -> DataFrame:
    clear_materialized(spark, "op7")
    return forest.nearest_neighbours(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, owner="op7")


# --- 8: near duplicates by fingerprint ------------------------------------------

@query()
def op8_gray_simhash(spark: SparkSession, sf: str) -> DataFrame:
    clear_materialized(spark, "op8")
    found = simhash.near_duplicates(table(spark, sf, "documents"), owner="op8")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


# --- 9: toxicity ------------------------------------------------------------------

TOXIC_FROM = 0.5


@query()
def op9_ordinal_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    clear_materialized(spark, "op9")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit_severity(docs, table(spark, sf, "labels"), owner="op9")
    return toxicity.severity(docs, model).select("doc_id", "severity.*", (F.col("severity.p_toxic") >= TOXIC_FROM).alias("toxic"))


# --- 10: quality rules ----------------------------------------------------------

@query()
def op10_divergence_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = divergence.quality_verdicts(table(spark, sf, "documents"))
    return judged.select("doc_id", "verdict.*")


# --- 11: prefix trie -------------------------------------------------------------

#: crc32 by its bits: a byte is joined in, then eight shifts, each a -1 in the list.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END), 4294967295::BIGINT)"""


@query(f"""
WITH ids AS (
  SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, strlen(coalesce(text, ''))::BIGINT AS bytes
  FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (SELECT conv_id, id, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS n FROM ids),
convs AS (SELECT conv_id, count(*) AS own, conv_id - conv_id % {trie.FAMILY} AS donor, {_CRC} % {trie.SHARED} AS h FROM numbered GROUP BY conv_id),
sized AS (SELECT c.*, least(c.h, coalesce(d.own, 0)) AS taken FROM convs c LEFT JOIN convs d ON d.conv_id = c.donor),
rebuilt AS (
  SELECT s.conv_id, n.n AS depth, id, bytes FROM sized s JOIN numbered n ON n.conv_id = s.donor AND n.n <= s.h
  UNION ALL SELECT s.conv_id, s.taken + n.n - s.h, id, bytes FROM sized s JOIN numbered n ON n.conv_id = s.conv_id AND n.n > s.h
  UNION ALL SELECT conv_id, 0, '', 0 FROM sized),
paths AS (
  SELECT conv_id, depth, bytes, string_agg(id, '/') OVER w AS path, max(depth) OVER (PARTITION BY conv_id) AS length FROM rebuilt
  WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
nodes AS (
  SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved, (max(length) = any_value(depth))::INT AS leaf,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends_sha256
  FROM paths GROUP BY path),
ups AS (SELECT *, CASE WHEN depth > 0 THEN left(path, length(path) - 65) END AS up FROM nodes),
below AS (
  SELECT p.path, sum(n.saved)::BIGINT AS saved_tokens, sum(n.leaf)::BIGINT AS n_leaves
  FROM nodes n JOIN paths o ON o.conv_id = n.conv_id AND o.depth <= n.depth JOIN nodes p ON p.path = o.path GROUP BY p.path),
children AS (SELECT up AS path, count(*) AS n_children FROM ups WHERE up IS NOT NULL GROUP BY up)
SELECT u.conv_id, u.depth, p.conv_id AS parent_conv_id, u.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, u.ends_sha256
FROM ups u JOIN below USING (path) LEFT JOIN children USING (path) LEFT JOIN nodes p ON p.path = u.up
""")
def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    clear_materialized(spark, "op11")
    numbered = materialize(trie.numbered_turns(table(spark, sf, "conversations")), "op11")
    return trie.prefix_trie(*trie.shared_beginnings(numbered), owner="op11")


# --- 12: url filter --------------------------------------------------------------

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def _listed(strict: bool) -> str:
    terms = [(t, w) for t, w in urls.VOCABULARY.items() if (w >= urls.LIMIT) == strict]
    return "[" + ", ".join(f"{{'term': '{t}', 'weight': {w}}}" for t, w in terms) + "]"


@query(f"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(after, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules AS (SELECT *, regexp_extract(rule, '^[^/]*') AS rule_host, regexp_extract(rule, '/.*$') AS rule_path
  FROM (VALUES {", ".join(f"('{v}', '{r}')" for v, r in URL_RULES)}) AS t (ruling, rule)),
fitting AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(ruling, length(rule)) AS ruling
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id),
hits AS (
  SELECT *, translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS whole,
    list_filter({_listed(True)}, lambda t: regexp_matches(whole, '(^|[^a-z0-9])' || t.term || '($|[^a-z0-9])')) AS strict,
    list_filter({_listed(False)}, lambda t: regexp_matches(whole, '(^|[^a-z0-9])' || t.term || '($|[^a-z0-9])')) AS soft
  FROM parts),
weighed AS (SELECT *, (coalesce(list_sum(list_transform(strict, lambda t: t.weight)), 0) + coalesce(list_sum(list_transform(soft, lambda t: t.weight)), 0))::BIGINT AS weight FROM hits)
SELECT page_id, host, path, rule, coalesce(ruling, CASE WHEN weight >= {urls.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  len(strict)::BIGINT AS n_strict, len(soft)::BIGINT AS n_soft, weight
FROM weighed LEFT JOIN fitting USING (page_id)
""")
def op12_url_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return urls.url_verdicts(table(spark, sf, "pages").select("page_id", "url"), URL_RULES).select("page_id", "verdict.*")


# --- 13: phrases -------------------------------------------------------------------

@query(f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words), range(1, {phrases.LONGEST + 1}) AS t (k) WHERE i + k - 1 <= len(w)),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {phrases.LEAST}),
candidates AS (SELECT lang, k AS words, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k >= 2),
cuts AS (SELECT *, unnest(range(1, words)) AS cut FROM candidates),
scored AS (
  SELECT c.lang, c.words, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:words], ' ') JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT DISTINCT s.lang, s.phrase FROM lowest s JOIN candidates c ON c.lang = s.lang AND c.words > s.words AND 100 * c.a >= 100 * s.a
    AND contains(' ' || c.phrase || ' ', ' ' || s.phrase || ' ')),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest WHERE (lang, phrase) NOT IN (SELECT (lang, phrase) FROM inside))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {phrases.FIRST}
""")
def op13_phrase_graph(spark: SparkSession, sf: str) -> DataFrame:
    clear_materialized(spark, "op13")
    return phrases.collocations(table(spark, sf, "documents").select("lang", "text"), owner="op13")
