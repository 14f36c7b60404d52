"""The queries of this package and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from verdigris.llm import chat, decontam, langid, lm, neardup, packing, pii, quality, rans, sharding
from verdigris.llm.common import crc_of_id

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return put


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: crc32 as SQL: bytes are taken from the hex form, eight polynomial steps make a table entry.
OP8_SQL = """
WITH RECURSIVE poly(i, k, c) AS (
  SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM poly WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS entries FROM poly WHERE k = 8),
texts AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents),
sums AS (
  SELECT t, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(t))::BIGINT), lambda p: ('0x' || substr(hex(encode(t)), 2 * p + 1, 2))::BIGINT)),
      lambda a, b: xor(a >> 8, entries[(xor(a & 255, b) + 1)::BIGINT])), 4294967295::BIGINT) AS crc
  FROM texts, crc),
keyed AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS stratum, octet_length(encode(coalesce(text, ''))) + 1 AS size, crc,
         md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents JOIN sums ON sums.t = coalesce(text, '')),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY key, doc_id) - 1 AS r, count(*) OVER (PARTITION BY stratum) AS n,
         (('0x' || substr(md5('7:' || stratum), 1, 6))::BIGINT::DOUBLE + 0.5) / 16777216 AS phase
  FROM keyed),
placed AS (
  SELECT *, row_number() OVER (ORDER BY (r + phase) / n, stratum, key, doc_id) - 1 AS position, count(*) OVER () AS total FROM ranked)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, (position * 16 // total)::INTEGER AS shard,
       (position - ((position * 16 // total) * total + 15) // 16)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed"""


@query("op8_proportional_interleave", OP8_SQL)
def op8_proportional_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleave(documents(spark, sf_dir), shards=16, seed=7)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP4_SQL = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(list_slice(w, p, p + 9), ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT k FROM windows),
grams AS (
  SELECT doc_id, p, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM lowered, lengths WHERE len(w) >= k)),
found AS (SELECT doc_id, p, k, item FROM grams JOIN windows USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""


@query("op4_aho_corasick_decontamination", OP4_SQL)
def op4_aho_corasick_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.scan(documents(spark, sf_dir).select("doc_id", "text"), items)
    digest = F.sha2(F.array_join("hit_items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


_STOPS = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
OP2_SQL = rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) > 2)),
twice AS (SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
repeats AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 3)) AS p FROM twice) GROUP BY rid),
counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[{quality.SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(list_filter(w, lambda x: lower(x) IN ({_STOPS})))::BIGINT AS n_stop_words,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM base LEFT JOIN repeats USING (rid)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars * 100 BETWEEN 200 * n_words AND 1400 * n_words AND n_symbols * 100 <= 10 * n_words
       AND n_stop_words * 100 >= 2 * n_words AND n_dup_lines * 100 <= 60 * n_lines AS kept
FROM failed"""


@query("op2_threshold_rules", OP2_SQL)
def op2_threshold_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op10_deficit_round_robin_packing")
def op10_deficit_round_robin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2, size=4096)


@query("op7_interleaved_rans")
def op7_interleaved_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = rans.write(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, vocabulary=50_257)
    return rans.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op5_ftrl_language_id")
def op5_ftrl_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_of_id() % 3 == 1
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


@query("op3_skip_chain_crf_pii")
def op3_skip_chain_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pii.detect(docs, pii.train(docs)).drop("text")


@query("op1_subword_lattice_likelihood")
def op1_subword_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = lm.score(docs, crc_of_id() % 7 != 2, public_tokenizers.path("piece_bpe_32k.model"))
    return scored.select("doc_id", (crc_of_id() % 7 == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


OP6_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
sized AS (SELECT *, length(role || text) + length(regexp_replace(role || text, '[^\\<>]', '', 'g')) + 17 AS chars FROM said)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""


@query("op6_chat_templates", OP6_SQL)
def op6_chat_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "\\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id bigint, turn bigint, role string, text string")
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat.read_back(talks.unionByName(planted))


@query("op9_chosen_path_join")
def op9_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
