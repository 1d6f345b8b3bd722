"""The `opN_<name>` queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, exact_dedup, fill_in_middle, lm_scoring, media, minhash, mixing, ngram_join, packing, quality, substring_dedup, token_files, tokens, tool_calls
from .shared import cut, documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokens.public("word_bpe_49k.json"), end_id=1, capacity=4096)


def op3_progressive_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = cut(media.store_texts(documents(spark, sf_dir)), "media")
    return media.load_media(stored, tensors=True)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_score(documents(spark, sf_dir))


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.select(F.col("doc_id").alias("id"), quality.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))


def op5_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), graded(spark, sf_dir))


def op6_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.format_conversations(spark, sf_dir)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(documents(spark, sf_dir), k=3, percent=85)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_tokens(documents(spark, sf_dir), token_files.scratch_path(spark), tokens.public("byte_bpe_50k.json"), end_id=2)
    return token_files.read_tokens(spark, path)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("shuffle_key")


def op10_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(documents(spark, sf_dir), keep_text=True)
    # What remains may be cut within a character; such bytes show as U+FFFD here, the digest is of the bytes.
    return out.withColumn("kept_text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.arrange(documents(spark, sf_dir))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_in_middle.restored("output", "form"), 256).alias("restored_sha256"))


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_sets(documents(spark, sf_dir), k=4, percent=85)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("centroid")


OP1_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS points FROM documents),
g AS (SELECT norm, count(*)::BIGINT AS group_size, arg_min(doc_id, (-points, doc_id)) AS keep_id FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)
"""


def queries() -> dict[str, Query]:
    ops = (op1_exact_dedup, op2_best_fit_packing, op3_progressive_media, op4_lm_scoring, op5_ordinal_quality, op6_tool_call_linking, op7_minhash_near_dedup, op8_token_files, op9_mix_sources, op10_repeated_substrings, op11_fill_in_middle, op12_ngram_jaccard_join, op13_centroid_clustering)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op6_tool_call_linking": tool_calls.ORACLE, "op9_mix_sources": mixing.ORACLE, "op11_fill_in_middle": fill_in_middle.ORACLE, "op12_ngram_jaccard_join": ngram_join.ORACLE, "op13_centroid_clustering": centroids.ORACLE}
