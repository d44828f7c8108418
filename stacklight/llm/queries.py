"""The driver's queries for the training-data operators, one opN_<name> for each, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from stacklight.llm import ann, bpe, chosen_path, chunk_dedup, html_text, licenses, mixing, suffix_dedup, toxicity, turns, warc, whitening, winnowing
from stacklight.llm.common import table


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = toxicity.scores(docs, model)
    return out.select("doc_id", (toxicity.fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.write_and_read(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    ppm = F.floor(F.col("probability") * 1e6 + 0.5).cast("bigint").alias("probability_ppm")
    residual = F.floor(F.col("residual") * 1e6 + 0.5).cast("bigint").alias("residual_ppm")
    return mixing.sampled(docs).select("doc_id", "source", "lang", "topic", "n_tokens", ppm, "selected", residual)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunk_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    each = out.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("pos", "whitened"))
    return each.select("vec_id", (F.col("pos") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.col("explained")[F.col("pos")].alias("explained"), "identity_error")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = turns.repair(turns.damaged(table(spark, sf_dir, "conversations")))
    return out.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", turns.digest().alias("repaired_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ann, op2_toxicity, op3_html_text, op4_license_scan, op5_suffix_dedup, op6_mixing, op7_ngram_join, op8_exact_dedup, op9_warc, op10_bpe, op11_whitening, op12_decontamination, op13_turn_repair)}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_mixing": mixing.oracle_sql(),
        "op8_exact_dedup": """
            WITH d AS (
                SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
                FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, text_sha256
            FROM d WINDOW w AS (PARTITION BY text_sha256)""",
        "op12_decontamination": winnowing.oracle_sql(),
        "op9_warc": """
            WITH p AS (
                SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
            f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
            SELECT page_id, payload_bytes, payload_digest,
                   CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
            FROM f""",
    }
