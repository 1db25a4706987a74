"""Registered queries of the corpus operators on the driver tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balltree, chunkcode, linedup, mixing, quality, recompress, sharding, simhash, tokens, topk, toxicity, trie, winnow
from ..scratch import scratch_path
from .common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_simhash_pivots")
def simhash_pivots(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, folder, "documents"), shingle=4, max_bits=4)
    return groups.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def token_table(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Documents written to token files and read back from them."""
    import public_tokenizers

    folder = scratch_path(spark, "tokens")
    written = tokens.write_tokens(
        docs, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2, separable=True
    )
    return tokens.read_tokens(spark, folder, written).withColumnRenamed("id", "doc_id")


@query("op8_zstd_token_frames")
def zstd_token_frames(spark: SparkSession, folder: str) -> DataFrame:
    return token_table(spark, table(spark, folder, "documents"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(coalesce({}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(_LOWER.format("text"))

_WINNOWING_SQL = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS k
  FROM items, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM docs, (SELECT DISTINCT n FROM windows) AS lengths, unnest(range(1, len(w) - n + 2)) AS t(i)),
hits AS (SELECT doc_id, i, n, item FROM places JOIN windows USING (n, k)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op6_winnowing", _WINNOWING_SQL)
def winnowing(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return winnow.contamination_report(winnow.contamination(docs, items, window=10))


_REPEATS_SQL = """
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS k FROM docs, unnest(range(1, len(w) - 33)) AS t(i)),
twice AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
gone AS (
  SELECT doc_id, list(DISTINCT p) AS g
  FROM windows JOIN twice USING (k), unnest(range(i, i + 35)) AS t(p) GROUP BY doc_id),
kept AS (
  SELECT doc_id, w, coalesce(len(g), 0) AS n, CASE WHEN g IS NULL THEN array_to_string(w, ' ')
    ELSE (SELECT coalesce(string_agg(w[p], ' ' ORDER BY p), '') FROM unnest(range(1, len(w) + 1)) AS t(p)
          WHERE NOT list_contains(g, p)) END AS text
  FROM docs LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n AS BIGINT) AS n_removed, sha256(text) AS kept_sha256 FROM kept
"""


@query("op7_recompression", _REPEATS_SQL)
def recompression(spark: SparkSession, folder: str) -> DataFrame:
    return recompress.remove_repeats(table(spark, folder, "documents"), window=35).withColumnRenamed("id", "doc_id")


@query("op2_bradley_terry")
def bradley_terry(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return quality.quality_scores(docs, labels).withColumnRenamed("id", "doc_id")


@query("op9_boosted_toxicity")
def boosted_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return toxicity.toxicity_scores(docs, labels, threshold=0.7).drop("text_hash").withColumnRenamed("id", "doc_id")


@query("op4_two_pass_shuffle")
def two_pass_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    rows = sharding.shard_documents(table(spark, folder, "documents").select("doc_id", "text"), shards=40)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return rows.select(
        F.col("row.doc_id").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


_LINES_SQL = """
WITH docs AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS LAST, CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT)) AS r,
    CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END AS l FROM documents),
windows AS (
  SELECT r, i, array_to_string(l[i : i + 2], chr(10)) AS k FROM docs, unnest(range(1, len(l) - 1)) AS t(i)),
later AS (
  SELECT r, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r, i) AS nth FROM windows) WHERE nth > 1),
gone AS (SELECT r, list(DISTINCT p) AS g FROM later, unnest(range(i, i + 3)) AS t(p) GROUP BY r)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN g IS NULL THEN array_to_string(l, chr(10))
    ELSE (SELECT coalesce(string_agg(l[p], chr(10) ORDER BY p), '') FROM unnest(range(1, len(l) + 1)) AS t(p)
          WHERE NOT list_contains(g, p)) END) AS kept_sha256
FROM docs LEFT JOIN gone USING (r)
"""


@query("op5_line_windows", _LINES_SQL)
def line_windows(spark: SparkSession, folder: str) -> DataFrame:
    kept = linedup.remove_later_windows(table(spark, folder, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_TOP_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256.0::DOUBLE * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@query("op3_uniform_threshold", _TOP_SQL)
def uniform_threshold(spark: SparkSession, folder: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, folder, "embeddings"), scale=256)
    return topk.top_inner_products(vectors, vectors.where("id % 50 = 0"), k=5)


# The tree of the mix: domains are groups of sources; numbers are weights among siblings.
DOMAIN_WEIGHTS = {"d0": 40, "d1": 30, "d2": 20, "d3": 10}
LANGUAGE_WEIGHTS = {"en": 50, "fr": 20, "de": 20, "es": 10}
MIX_SHARE = 0.6
MIX_EPOCHS = 2


def with_domain(docs: DataFrame) -> DataFrame:
    """The domain of a document is the last digit of its source's number modulo 4; "d3" without one."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9])$", 1)
    digit = F.when(number == "", F.lit(3)).otherwise(number.cast("int") % 4)
    return docs.withColumn("domain", F.concat(F.lit("d"), digit.cast("string")))


def mixed(docs: DataFrame, share: float, max_epochs: int) -> DataFrame:
    return mixing.choose_documents(
        with_domain(docs), ["domain", "lang", "source"], [DOMAIN_WEIGHTS, LANGUAGE_WEIGHTS, {}], [5, 5, 1],
        share=share, max_epochs=max_epochs, seed=3,
    )


def _level_sql(name: str, parents: list[str], source: str, weight: str) -> str:
    """SQL of one level of the tree: ``source`` has the parents' budgets."""
    path = ", ".join([*parents, name])
    by = "PARTITION BY " + (", ".join(parents) or "1")
    budget = f"JOIN {source} USING ({', '.join(parents)})" if parents else f"CROSS JOIN {source}"
    order = f"({by} ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
{name}_caps AS (
  SELECT {path}, CAST(sum(tokens) * {MIX_EPOCHS} AS DOUBLE) AS cap, CAST({weight} AS DOUBLE) AS weight
  FROM docs GROUP BY {path} HAVING sum(tokens) > 0),
{name}_rows AS (
  SELECT *, row_number() OVER ({by} ORDER BY cap / weight, {name}) AS place,
    (budget - coalesce(sum(cap) OVER {order}, 0)) / (sum(weight) OVER ({by}) - coalesce(sum(weight) OVER {order}, 0)) AS level
  FROM {name}_caps {budget}),
{name}_first AS (
  SELECT *, min(CASE WHEN cap / weight > level THEN place END) OVER ({by}) AS stop FROM {name}_rows),
{name}_budget AS (
  SELECT {path}, CASE WHEN stop IS NULL OR place < stop THEN cap
    ELSE weight * max(CASE WHEN place = stop THEN level END) OVER ({by}) END AS budget
  FROM {name}_first)"""


def _case(name: str, weights: dict[str, int], default: int) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {default} END"


_MIX_SQL = f"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    'd' || coalesce(CAST(TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9])$', 1) AS INTEGER) % 4 AS VARCHAR), '3') AS domain,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS tokens,
    coalesce(md5(text), '') AS digest, row_number() OVER (PARTITION BY doc_id, lang, source, text) AS copy
  FROM documents),
top_budget AS (SELECT CAST(floor({MIX_SHARE} * sum(tokens)) AS DOUBLE) AS budget FROM docs),
{_level_sql("domain", [], "top_budget", _case("domain", DOMAIN_WEIGHTS, 5))},
{_level_sql("lang", ["domain"], "domain_budget", _case("lang", LANGUAGE_WEIGHTS, 5))},
{_level_sql("source", ["domain", "lang"], "lang_budget", "1")},
leaves AS (SELECT domain, lang, source, sum(tokens) AS size FROM docs GROUP BY ALL),
plan AS (
  SELECT domain, lang, source, size, CAST(floor(coalesce(budget, 0)) AS BIGINT) AS budget
  FROM leaves LEFT JOIN source_budget USING (domain, lang, source)),
epochs AS (SELECT *, CASE WHEN size > 0 THEN budget // size ELSE 0 END AS whole FROM plan),
placed AS (
  SELECT docs.*, whole, budget - whole * size AS rest, sum(tokens) OVER (
    PARTITION BY domain, lang, source
    ORDER BY md5(concat_ws('|', '3', CAST(whole AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), ''), digest,
      CAST(copy AS VARCHAR), domain, lang, source))) AS upto
  FROM docs JOIN epochs USING (domain, lang, source))
SELECT doc_id, domain, lang, source, CAST(tokens AS BIGINT) AS tokens,
  CAST(whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS epochs FROM placed
"""


@query("op10_tree_budgets", _MIX_SQL)
def tree_budgets(spark: SparkSession, folder: str) -> DataFrame:
    taken = mixed(table(spark, folder, "documents"), MIX_SHARE, MIX_EPOCHS)
    return taken.select(F.col("id").alias("doc_id"), "domain", "lang", "source", "tokens", "epochs")


# crc32 of the decimal id, byte by byte and bit by bit; then modulo 9.
_TAKEN = """xor(4294967295, list_reduce(
    list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda crc, byte:
      list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, byte)), 4294967295)) % 9"""

_TRIE_SQL = f"""
WITH turns AS (
  SELECT conv_id, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS d,
    octet_length(encode(coalesce(text, ''))) AS bytes, turn FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT conv_id, d, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) - 1 AS place FROM turns),
convs AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, {_TAKEN} AS h FROM placed),
rows AS (
  SELECT c.conv_id, 0 AS part, p.place, p.d, p.bytes FROM convs AS c JOIN placed AS p ON p.conv_id = c.base AND p.place < c.h
  UNION ALL
  SELECT conv_id, 1, p.place, p.d, p.bytes FROM convs AS c JOIN placed AS p USING (conv_id) WHERE p.place >= c.h),
prefixes AS (
  SELECT conv_id, row_number() OVER w AS depth, md5(string_agg(d, '') OVER w) AS k, bytes FROM rows
  WINDOW w AS (PARTITION BY conv_id ORDER BY part, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
steps AS (SELECT *, lag(k) OVER w AS up, lead(k) OVER w IS NULL AS last FROM prefixes WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
nodes AS (
  SELECT depth, k, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '') AS ends
  FROM steps GROUP BY depth, k),
children AS (SELECT depth - 1 AS depth, up AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
own AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (depth, k)),
below AS (
  SELECT s.depth, s.k, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * o.bytes) AS saved
  FROM own AS o JOIN steps AS s ON s.conv_id = o.conv_id AND s.depth <= o.depth GROUP BY s.depth, s.k)
SELECT o.conv_id, CAST(o.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(o.ends) AS ends_sha256
FROM own AS o JOIN below USING (depth, k) LEFT JOIN nodes AS p ON p.depth = o.depth - 1 AND p.k = o.up
"""


@query("op13_depth_bands", _TRIE_SQL)
def depth_bands(spark: SparkSession, folder: str) -> DataFrame:
    turns = trie.ordered_turns(table(spark, folder, "conversations"))
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    rebuilt, sizes = trie.borrowed_beginnings(turns, F.col("conv") - F.col("conv") % 5, taken)
    return trie.prefix_trie(rebuilt, sizes)


@query("op12_chunk_reuse")
def chunk_reuse(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    source = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()
    coded = chunkcode.encode_documents(table(spark, folder, "documents"), source)
    return coded.select(
        F.col("id").alias("doc_id"), "n_tokens", F.lower(F.hex("ids_sha")).alias("ids_sha256"),
        F.lower(F.hex("text_sha")).alias("decoded_sha256"),
    )


_RANKED_TERMS = "regexp_extract_all(coalesce({}, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')".format(_LOWER.format("text"))

_RANKED_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_RANKED_TERMS} AS w FROM documents),
sizes AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM docs WHERE len(w) > 0),
asked AS (SELECT DISTINCT item_id, unnest({_RANKED_TERMS}) AS t FROM benchmark),
found AS (
  SELECT r, doc_id, len(w) AS m, t, count(*) AS tf
  FROM (SELECT r, doc_id, w, unnest(w) AS t FROM docs) WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weights AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight
  FROM (SELECT t, count(*) AS df FROM found GROUP BY t), sizes),
scores AS (
  SELECT item_id, r, doc_id,
    sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * m * sizes.n) // sizes.l))))) AS score
  FROM asked JOIN found USING (t) JOIN weights USING (t), sizes GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 50
"""


@query("op11_ball_tree", _RANKED_SQL)
def ball_tree(spark: SparkSession, folder: str) -> DataFrame:
    return balltree.ranked_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=50)
