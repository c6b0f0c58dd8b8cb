"""The corpus operators as named queries over the test tables, and their SQL twins."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlab.llm import (best_fit, chat_format, dart_minhash, decontaminate, dual_tree, exact_topk, language_id, merkle,
                             quality_cnn, sharding, suffix_dedup, token_counts, token_files)
from incidentlab.llm.common import fold, scratch, ship, table
from incidentlab.llm.tokens import public_file

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def op2_best_fit_packing(spark, sf_dir):
    parts = best_fit.pieces(table(spark, sf_dir, "documents"), public_file("word_bpe_49k.json"))
    packed = best_fit.pack(parts)
    return packed.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op3_chat_formatting(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)],
                                    "conv_id long, turn long, role string, text string")
    return chat_format.conversation_digest(chat_format.format_turns(chat_format.text_parts(rows.unionByName(planted))))


@query
def op6_exact_topk(spark, sf_dir):
    rows = exact_topk.quantised(table(spark, sf_dir, "embeddings"))
    return exact_topk.top_k(rows, F.col("vec_id") % 20 == 0)


ORACLES["op6_exact_topk"] = """
WITH part AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM part q JOIN part c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""


@query
def op7_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_file("word_bpe_49k.json"))


@query
def op8_token_files(spark, sf_dir):
    folder = scratch(spark, "token-files")
    written = token_files.write_shards(table(spark, sf_dir, "documents"), folder, public_file("byte_bpe_50k.json"), 2)
    return token_files.read_shards(token_files.with_bases(spark, written), folder)


@query
def op5_minhash_near_dedup(spark, sf_dir):
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(language_id.training_rows(docs))
    held = (fold(F.col("doc_id"), 4) == 2).alias("held_out")
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held, "lang_pred", "score")


@query
def op4_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality_cnn.fit(docs, table(spark, sf_dir, "labels"))
    held = (fold(F.col("doc_id"), 5) == 0).alias("held_out")
    return quality_cnn.score(docs.select("doc_id", "text"), model).select("doc_id", held, "score", "predicted")


@query
def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), texts=())


@query
def op11_ranked_lexical_search(spark, sf_dir):
    return dual_tree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS_SQL = r"unnest(regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"

ORACLES["op11_ranked_lexical_search"] = f"""
WITH words AS (SELECT doc_id, {_TERMS_SQL.format('text')} AS term FROM documents),
held AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM held GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM held, corpus GROUP BY term, docs),
norms AS (SELECT doc_id, 100 - 50 + ((50 * n * docs) // terms) AS m FROM sizes, corpus),
asked AS (SELECT DISTINCT item_id, {_TERMS_SQL.format('text')} AS term FROM benchmark),
scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN norms USING (doc_id) GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50"""


@query
def op12_sharding(spark, sf_dir):
    text = F.coalesce(F.col("text"), F.lit(""))
    return sharding.assign(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


#: crc32 of the UTF-8 bytes of a text, byte by byte over the usual table of 256 remainders (``crc_table``).
_CRC_TABLE = """crc_table AS MATERIALIZED (SELECT list_transform(range(256)::BIGINT[], lambda i: list_reduce(range(8)::BIGINT[],
  lambda a, b: CASE WHEN a % 2 = 1 THEN xor(3988292384, a // 2) ELSE a // 2 END, i)) AS remainders)"""
_CRC = """xor(4294967295, list_reduce(list_transform(range(strlen({0}))::BIGINT[],
  lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT),
  lambda a, x: xor(a // 256, remainders[xor(a, x) % 256 + 1]), 4294967295::BIGINT))"""

ORACLES["op12_sharding"] = f"""
WITH {_CRC_TABLE},
bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) + 1 AS size FROM documents),
listed AS (SELECT doc_id, size, list_transform(range(size - 1)::BIGINT[], lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b FROM bytes),
ends AS (SELECT doc_id, CAST(sum(size) OVER (ORDER BY doc_id) AS BIGINT) AS upto, CAST(sum(size) OVER () AS BIGINT) AS whole FROM bytes),
cut AS (SELECT doc_id, CAST((8 * (2 * upto - size)) // (2 * whole) AS INTEGER) AS shard FROM ends JOIN bytes USING (doc_id))
SELECT doc_id, size, xor(4294967295, list_reduce(b, lambda a, x: xor(a // 256, remainders[xor(a, x) % 256 + 1]), 4294967295::BIGINT)) AS text_crc32,
  'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM listed JOIN cut USING (doc_id), crc_table"""


@query
def op13_merkle_manifest(spark, sf_dir):
    text = F.when(fold(F.col("doc_id"), 2) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    claimed = merkle.leaf_hash([*[F.col(c) for c in merkle.FIELDS[:-1]], text])
    rows = merkle.manifest(table(spark, sf_dir, "documents"), carry={"claimed": claimed})
    return merkle.verify(rows, "claimed").select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
                                                 "folded_root", "verified")


def _field_sql(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


_HASH_SQL = "sha256(" + " || ".join(_field_sql(c) for c in merkle.FIELDS[:-1]) + " || {})"
_NEXT_SQL = "list_transform(range((len(h) + 2) // 3), lambda i: sha256(array_to_string(h[3 * i + 1:3 * i + 3], '')))"
_BESIDE_SQL = """array_to_string(h[r - r % 3 + 1:r], '') AS lft, array_to_string(h[r + 2:r - r % 3 + 3], '') AS rgt"""

ORACLES["op13_merkle_manifest"] = f"""
WITH RECURSIVE {_CRC_TABLE},
odd AS (SELECT doc_id, {_CRC.format('CAST(doc_id AS VARCHAR)')} % 2 AS odd FROM documents, crc_table),
leaves AS (SELECT doc_id, coalesce('=' || source, '') AS g, {_HASH_SQL.format(_field_sql('text'))} AS leaf,
    {_HASH_SQL.format(_field_sql("CASE WHEN odd = 0 THEN replace(text, chr(10), '') ELSE text END"))} AS claimed,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r
  FROM documents JOIN odd USING (doc_id)),
levels AS (SELECT g, 0 AS level, list(leaf ORDER BY r) AS h FROM leaves GROUP BY g
  UNION ALL SELECT g, level + 1, {_NEXT_SQL} FROM levels WHERE len(h) > 1),
subroots AS (SELECT g, h[1] AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS r FROM levels WHERE len(h) = 1),
tops AS (SELECT 0 AS level, list(subroot ORDER BY r) AS h FROM subroots
  UNION ALL SELECT level + 1, {_NEXT_SQL} FROM tops WHERE len(h) > 1),
climb AS (SELECT g, 0 AS level, false AS top, r, doc_id, claimed AS folded, '' AS proof, false AS done FROM leaves
  UNION ALL
  (WITH here AS (SELECT c.*, s.r AS own, CASE WHEN c.top THEN t.h ELSE l.h END AS h
      FROM climb c LEFT JOIN levels l ON NOT c.top AND l.g = c.g AND l.level = c.level
      LEFT JOIN tops t ON c.top AND t.level = c.level JOIN subroots s ON s.g = c.g WHERE NOT c.done),
    beside AS (SELECT *, {_BESIDE_SQL} FROM here)
  SELECT g, CASE WHEN len(h) > 1 THEN level + 1 ELSE 0 END, top OR len(h) = 1, CASE WHEN len(h) > 1 THEN r // 3 ELSE own END, doc_id,
    CASE WHEN len(h) > 1 THEN sha256(lft || folded || rgt) ELSE folded END, CASE WHEN len(h) > 1 THEN proof || lft || rgt ELSE proof END,
    top AND len(h) = 1 FROM beside))
SELECT c.doc_id, leaf, subroot, t.h[1] AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.h[1] AS verified
FROM climb c JOIN leaves USING (doc_id) JOIN subroots s ON s.g = c.g, tops t WHERE c.done AND len(t.h) = 1"""
