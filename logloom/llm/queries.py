"""One query per operator over its whole table, and their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import chat, decontaminate, extraction, fingerprints, license_scan, middle, packing, quality, sharding, simhash, token_counts, token_files, whitening
from logloom.llm.text import documents
from logloom.session import scratch

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    token_files.write_token_files(documents(spark, sf_dir), path, public_tokenizers.path(WORD_TOKENIZER))
    return token_files.with_crc32(token_files.read_token_files(spark, path), "doc_id", "start", "n_tokens")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score_quality(documents(spark, sf_dir), labels).drop("text_hash")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(WORD_TOKENIZER))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_hash")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path(BYTE_TOKENIZER))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.fill_in_middle(documents(spark, sf_dir))
    text = middle.restored(F.col("output"), F.col("form"))
    digests = [F.sha2(c.cast("binary"), 256).alias(f"{name}_sha256") for name, c in (("output", F.col("output")), ("restored", text))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


#: The conversation that the contract adds: texts that look like marks.
ADDED_CONVERSATION = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*columns)
    rows = rows.unionByName(spark.createDataFrame(ADDED_CONVERSATION, rows.schema))
    records = rows.select(F.to_variant_object(F.struct(*columns)).alias("record"))
    turns = chat.canonical_turns(records)
    kind = rows.schema["conv_id"].dataType
    return chat.digests(chat.format_conversations(turns)).select(F.col("key").cast(kind).alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


QUERIES = {f.__name__: f for f in (op1_token_files, op2_quality_classifier, op3_license_scan, op4_fingerprints, op5_best_fit_packing, op6_html_extraction, op7_simhash_groups, op8_decontamination, op9_sharding, op10_token_counts, op11_embedding_whitening, op12_fill_in_middle, op13_chat_formatting)}

#: A document's lower-cased words; chr(92) keeps the pattern's escapes apart from Python's.
_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

ORACLES = {
    "op8_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, least(len(w), 13) AS n, list_slice(w, i, i + least(len(w), 13) - 1) AS win
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM windows),
        seen AS (
            SELECT r, n, i, list_slice(w, i, i + n - 1) AS win
            FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
        hits AS (SELECT DISTINCT r, seen.n, i, item_id FROM seen JOIN windows ON windows.n = seen.n AND windows.win = seen.win),
        places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h
                  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
            CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(h, sha256('')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)""",
}
