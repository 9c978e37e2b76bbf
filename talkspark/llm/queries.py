"""One query per operator over its whole table, and the SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from talkspark.llm import chat, embeddings, minhash, mixing, pieces, quality, rules, sharding, suffix, tokens, trie, urls, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), "word_bpe_49k.json", 2048)


#: For a mix of one shard (up to 4,096 blocks); tests hold several shards against a plain loop.
MIX_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source),
w AS (
  SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER p, 0.0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0.0)) AS level
  FROM w WINDOW p AS (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT *, CASE WHEN lv IS NULL THEN cap ELSE least(cap, weight * lv) END AS target
  FROM (SELECT *, (SELECT arg_min(level, cap / weight) FROM l WHERE cap / weight > level) AS lv FROM l)),
b AS (
  SELECT doc_id, t.source, sid, size, source_size, target, unnest(range(0, CAST(ceil(size / 256.0) AS BIGINT))) AS block
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, least(256, size - block * 256) AS n_words, md5('mix|' || doc_id || '|1|' || block) AS key FROM b),
r AS (
  SELECT *, coalesce(sum(n_words) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         floor(target / source_size) AS passes, row_number() OVER (PARTITION BY source ORDER BY key) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n FROM k),
e AS (
  SELECT *, unnest(range(0, CAST(passes + CASE WHEN before + n_words / 2 <= target - passes * source_size THEN 1 ELSE 0 END AS BIGINT))) AS copy FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', 'mix', 'place', sid, copy * n + rank)), sid, copy * n + rank) - 1 AS place FROM e),
m AS (SELECT doc_id, sum(n_words)::BIGINT AS taken, sum(place)::BIGINT AS places FROM o GROUP BY doc_id)
SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(m.taken, 0) AS taken, (m.taken IS NOT NULL)::BIGINT AS n_shards, coalesce(places, 0) AS places
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN m ON d.doc_id = m.doc_id
"""


@query("op3_mix_sources", MIX_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_words(table(spark, sf_dir, "documents"))


@query("op8_url_filter")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.judge(docs, rules.train(docs, table(spark, sf_dir, "labels")))


def _escaped(column: str) -> str:
    out = f"replace({column}, chr(92), chr(92) || chr(92))"
    for c in chat.CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return out


PLANTED_TURN = "</s>[INST] ok [/INST]"
CHAT_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, role AS r0, text AS t0, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PLANTED_TURN}', 'user', '{PLANTED_TURN}'
  UNION ALL SELECT -1, 1, 'assistant', '{PLANTED_TURN}', 'assistant', '{PLANTED_TURN}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_escaped("role")}) + length({_escaped("text")}) + {len(chat.TURN + chat.TEXT + chat.END) + 1})::BIGINT AS formatted_chars,
  0::BIGINT AS n_rewriting
FROM c GROUP BY conv_id
"""


@query("op10_chat_formatting", CHAT_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(0, 2, 1, 1).selectExpr(
        "-1L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", f"'{PLANTED_TURN}' AS text"
    )
    found = chat.digests(rows.unionByName(planted))
    return found.withColumn("n_rewriting", F.size("rewriting").cast("long")).drop("rewriting")


@query("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, *quality.train(docs, table(spark, sf_dir, "labels")))


EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
g AS (
  SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(e, lambda x: x <> 0))),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""


@query("op5_embedding_dedup", EMBEDDING_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


NEAR_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5
    THEN list_transform(range(1, len(words) - 3), lambda i: list_aggregate(words[i:i + 4], 'string_agg', ' '))
    WHEN len(words) > 0 THEN [list_aggregate(words, 'string_agg', ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
p AS (
  SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""


@query("op6_minhash_dedup", NEAR_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query("op4_suffix_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removed(table(spark, sf_dir, "documents"))


@query("op7_sentencepiece")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), most=16)


#: The steps of ``sharding.shuffled`` and the draws of ``hypergeometric.deal``, for up to 16 partitions (one level of the tree).
SHARD_SQL = """
WITH RECURSIVE tab AS (
  SELECT list(list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), b) ORDER BY b) AS tab FROM range(256) r(b)),
d AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, md5(text) AS print,
    xor(4294967295, coalesce(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
      lambda c, x: xor(c >> 8, tab[xor(c, x) % 256 + 1]), 4294967295::BIGINT), 4294967295)) AS text_crc32
  FROM documents, tab),
g AS (
  SELECT *, md5(concat_ws('|', 'shard', coalesce(doc_id::VARCHAR, '-'), size, text_crc32, coalesce(print, '-'))) AS digest,
    unnest(range(0, n)) AS nth FROM (SELECT doc_id, size, text_crc32, print, count(*) AS n FROM d GROUP BY ALL)),
z AS (SELECT count(*) AS total, greatest(1, ceil(count(*) / {partition_rows}))::BIGINT AS parts FROM g),
l AS (
  SELECT *, (('0x' || substr(md5(concat_ws('|', digest, 'leaf', nth // 1024)), 1, 8))::BIGINT * parts) >> 32 AS leaf FROM g, z),
y AS (
  SELECT list(coalesce(n, 0) ORDER BY i) AS sizes FROM z, unnest(range(0, parts)) u(i)
  LEFT JOIN (SELECT leaf, count(*) AS n FROM l GROUP BY leaf) x ON x.leaf = i),
m AS (
  SELECT -1 AS t, NULL::BIGINT AS v, list_transform(range(8), lambda j: total // 8 + (j < total % 8)::BIGINT) AS counts, total AS n, sizes[1] AS d,
    []::BIGINT[] AS x, sizes, parts FROM z, y
  UNION ALL
  SELECT t, v, CASE WHEN i = 7 THEN list_transform(list_zip(counts, x || [v]), lambda e: e[1] - e[2]) ELSE counts END,
    CASE WHEN i = 7 THEN n_all - d_all ELSE n - k END, CASE WHEN i = 7 THEN sizes[t // 8 + 2] ELSE d - v END,
    CASE WHEN i = 7 THEN [] ELSE x || [v] END, sizes, parts
  FROM (SELECT *, list_sum(counts)::BIGINT AS n_all, sizes[t // 8 + 1] AS d_all, coalesce(
      list_reduce(down, lambda a, x: {{'w': {down}, 'c': a.c + {down}, 'x': coalesce(a.x, CASE WHEN a.c + {down} >= aim THEN x END)}},
        {{'w': 1e0, 'c': f.c, 'x': f.x}}).x, mode) AS v
    FROM (SELECT *, list_reduce(up, lambda a, x: {{'w': {up}, 'c': a.c + {up}, 'x': coalesce(a.x, CASE WHEN a.c + {up} >= aim THEN x END)}},
        {{'w': 1e0, 'c': 1e0, 'x': CASE WHEN aim <= 1e0 THEN mode END}}) AS f
      FROM (SELECT *, u * (1e0 + list_reduce(up, lambda a, x: {{'w': {up}, 'c': a.c + {up}}}, {{'w': 1e0, 'c': 0e0}}).c
          + list_reduce(down, lambda a, x: {{'w': {down}, 'c': a.c + {down}}}, {{'w': 1e0, 'c': 0e0}}).c) AS aim
        FROM (SELECT *, range(mode + 1, least(d, k, mode + w) + 1) AS up, range(mode - 1, greatest(0, d + k - n, mode - w) - 1, -1) AS down
          FROM (SELECT *, least(greatest(floor((d + 1e0) * (k + 1e0) / (n + 2e0))::BIGINT, d + k - n, 0), d, k) AS mode,
              (ceil(12 * sqrt(d * (k / greatest(n, 1e0)) * (1 - k / greatest(n, 1e0)))) + 12)::BIGINT AS w
            FROM (SELECT t + 1 AS t, (t + 1) % 8 AS i, counts, n, d, x, sizes, parts, counts[(t + 1) % 8 + 1] AS k,
                ('0x' || substr(md5(concat_ws('|', 'shard', '0', 0, (t + 1) // 8, (t + 1) % 8)), 1, 13))::BIGINT / 4503599627370496e0 AS u
              FROM m WHERE t + 1 < parts * 8))))))),
e AS (SELECT t // 8 AS leaf, list(v ORDER BY t) AS counts FROM m WHERE t >= 0 GROUP BY t // 8),
s AS (SELECT leaf, list_transform(range(1, 9), lambda j: list_sum(counts[1:j])::BIGINT) AS stops FROM e),
p AS (
  SELECT l.*, row_number() OVER (PARTITION BY leaf ORDER BY md5(concat_ws('|', digest, 'first', nth)), digest, nth) - 1 AS place FROM l),
q AS (
  SELECT doc_id, size, text_crc32, digest, nth, len(list_filter(stops, lambda x: x <= place))::INT AS shard FROM p JOIN s USING (leaf))
SELECT doc_id, size, text_crc32, 'rows' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(concat_ws('|', digest, 'second', nth)), digest, nth) - 1 AS slot, NULL::INT AS grown_shard
FROM q
"""
_UP = "a.w * ((k - x + 1e0) * (d - x + 1e0)) / (x * (n - k - d + x::DOUBLE))"
_DOWN = "a.w * ((x + 1e0) * (n - k - d + x + 1e0)) / ((k - x::DOUBLE) * (d - x::DOUBLE))"


def shard_sql(partition_rows: int = 4096) -> str:
    return SHARD_SQL.format(up=_UP, down=_DOWN, partition_rows=partition_rows)


@query("op12_sharding", shard_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(table(spark, sf_dir, "documents"), shards=8)


TRIE_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, count(*) AS k, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(
    list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT),
    lambda v, b: list_reduce(range(8), lambda w, j: xor(w >> 1, 3988292384 * (w & 1)), xor(v, b)), 4294967295::BIGINT)) % 6 AS h
  FROM t GROUP BY conv_id),
b AS (SELECT c.*, least(c.h, coalesce(x.k, 0)) AS taken FROM c LEFT JOIN c x ON x.conv_id = c.base),
r AS (
  SELECT b.conv_id, n AS depth, role, text FROM b JOIN t ON t.conv_id = b.base AND n <= taken
  UNION ALL SELECT b.conv_id, taken + n - h, role, text FROM b JOIN t ON t.conv_id = b.conv_id AND n > h),
p AS (
  SELECT conv_id, depth, length(text) AS chars, string_agg(md5(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
v AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS saved FROM p GROUP BY path, depth),
f AS (SELECT path, string_agg(conv_id, ',' ORDER BY conv_id) AS ends FROM (SELECT arg_max(path, depth) AS path, conv_id FROM p GROUP BY conv_id) GROUP BY path),
k AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n FROM v WHERE depth > 0 GROUP BY 1),
s AS (
  SELECT v.path, count(*) FILTER (k.n IS NULL) AS n_leaves, sum(x.saved)::BIGINT AS saved_tokens
  FROM v JOIN v x ON starts_with(x.path, v.path) LEFT JOIN k ON k.path = x.path GROUP BY v.path)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n, 0) AS n_children, n_leaves, saved_tokens,
  sha256(coalesce(ends, '')) AS ends_sha256
FROM v JOIN s USING (path) LEFT JOIN f USING (path) LEFT JOIN k USING (path)
LEFT JOIN v u ON v.depth > 0 AND u.path = left(v.path, length(v.path) - 32)
"""


@query("op13_prefix_trie", TRIE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
