"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from likeness.llm import (
    block_naming, bond, chat, fuzzy_lines, lengths, merkle, nn_descent, packing, pieces, ppm, simhash_trie, toxicity, wavelet)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn=None, *, sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register(fn) if fn else register


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_query
def op2_wavelet_shards(spark: SparkSession, folder: str) -> DataFrame:
    return wavelet.encoded_documents(_table(spark, folder, "documents")).select(
        "doc_id", "start", "n_tokens", "ids_crc32")


#: A-Z are lower-cased by themselves: DuckDB's lower() changes other letters too.
FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
EXACT_SQL = f"""
WITH t AS (SELECT doc_id, {FOLDED} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
 doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256 FROM t"""


@_query(sql=EXACT_SQL)
def op3_block_naming(spark: SparkSession, folder: str) -> DataFrame:
    return block_naming.exact_groups(_table(spark, folder, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


@_query
def op4_chat_rendering(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    kept = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], kept.schema)
    return chat.read_back(kept.union(extra))


@_query
def op5_piece_offsets(spark: SparkSession, folder: str) -> DataFrame:
    found = pieces.encoded(_table(spark, folder, "documents"))
    return found.select("doc_id", F.expr("length(ids) div 4").cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op6_fuzzy_lines(spark: SparkSession, folder: str) -> DataFrame:
    return fuzzy_lines.fuzzy_lines(_table(spark, folder, "documents")).select("doc_id", "line_no", "group_id", "kept")


@_query
def op7_length_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return lengths.length_report(lengths.token_counts(_table(spark, folder, "documents")))


@_query
def op8_nn_descent(spark: SparkSession, folder: str) -> DataFrame:
    return nn_descent.near_vectors(_table(spark, folder, "embeddings"))


@_query
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(_table(spark, folder, "documents"))


@_query
def op10_simhash_trie(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_trie.near_groups(_table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")


HARD_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a, p.b, p.score AS p_score, s.b AS other, s.score AS n_score,
  row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS place
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT a AS anchor_id, b AS positive_id, place::INT AS rank, other AS negative_id, p_score AS positive_score, n_score AS negative_score
FROM n WHERE place <= 5"""


@_query(sql=HARD_SQL)
def op11_bond_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return bond.hard_negatives(_table(spark, folder, "embeddings"))


@_query
def op12_ppm_language(spark: SparkSession, folder: str) -> DataFrame:
    return ppm.predicted(_table(spark, folder, "documents"))


#: DuckDB has no crc32: its lowest bit comes from the table of 256 remainders.
MANIFEST_SQL = """
WITH RECURSIVE bits AS (
 SELECT i, 0 AS step, i AS c FROM range(256) r(i)
 UNION ALL SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
d AS (SELECT doc_id, source, text,
  coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
  || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
  coalesce(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
   lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])) & 1 = 1, false) AS even
  FROM documents, crc),
leaf AS (SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS h,
  CASE WHEN even THEN sha256(head || coalesce(octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), ''), '-'))
   ELSE sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) END AS now,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
tree AS (
 SELECT source, 0 AS lvl, pos, h, n FROM leaf
 UNION ALL SELECT source, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM tree WHERE n > 1 GROUP BY source, lvl, pos // 3, n),
subroots AS (SELECT source, lvl AS height, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
crown AS (
 SELECT 0 AS lvl, pos, h, n FROM subroots
 UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM crown WHERE n > 1 GROUP BY lvl, pos // 3, n),
sibs AS (
 SELECT l.doc_id, t.lvl, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < l.pos // (3 ** t.lvl)::BIGINT), '') AS a,
  coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > l.pos // (3 ** t.lvl)::BIGINT), '') AS b
 FROM leaf l JOIN tree t ON t.source IS NOT DISTINCT FROM l.source AND t.n > 1 AND t.pos // 3 = l.pos // (3 ** (t.lvl + 1))::BIGINT GROUP BY ALL
 UNION ALL
 SELECT l.doc_id, s.height + c.lvl, coalesce(string_agg(c.h, '' ORDER BY c.pos) FILTER (c.pos < s.pos // (3 ** c.lvl)::BIGINT), ''),
  coalesce(string_agg(c.h, '' ORDER BY c.pos) FILTER (c.pos > s.pos // (3 ** c.lvl)::BIGINT), '')
 FROM leaf l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN crown c ON c.n > 1 AND c.pos // 3 = s.pos // (3 ** (c.lvl + 1))::BIGINT GROUP BY ALL),
folds AS (
 SELECT doc_id, 0 AS lvl, now AS h FROM leaf
 UNION ALL SELECT f.doc_id, f.lvl + 1, sha256(s.a || f.h || s.b) FROM folds f JOIN sibs s ON s.doc_id = f.doc_id AND s.lvl = f.lvl),
last AS (SELECT doc_id, max_by(h, lvl) AS h FROM folds GROUP BY doc_id),
proofs AS (SELECT doc_id, string_agg(a || b, '' ORDER BY lvl) AS p FROM sibs GROUP BY doc_id)
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, sha256(coalesce(p.p, '')) AS proof_sha256, last.h AS folded_root, last.h = r.h AS verified
FROM leaf l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN (SELECT h FROM crown WHERE n = 1) r ON true
JOIN last ON last.doc_id = l.doc_id LEFT JOIN proofs p ON p.doc_id = l.doc_id"""


@_query(sql=MANIFEST_SQL)
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(_table(spark, folder, "documents"))
