"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, jaccard, langid, manifest, media, mixing, negatives, perplexity, pieces, substrings, tokens, topk, urls
from .common import load


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after replacing personal data, re-encoding only around the replacements."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return tokens.count_edited(tokens.personal_data_edits(docs)).withColumnRenamed("id", "doc_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(load(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in pieces and back: how many, a hash of the ids, and whether the decoded text is the text."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.encode_texts(docs, decode_too=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.hex(F.xxhash64("ids")).alias("ids_hash"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature: how many peak pairs the fingerprint has, and a hash of their codes in order of time."""
    out = media.wav_columns(load(spark, sf_dir, "documents"))
    feature = F.concat_ws(":", F.size("fingerprint"), F.hex(F.xxhash64("fingerprint")))
    return out.withColumn("feature", feature).drop("fingerprint")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(load(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    return urls.judge_urls(pages, urls.page_outcomes(pages)).select("page_id", "host", "path", "rule", "verdict")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.drop_repeats(load(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.score_texts(load(spark, sf_dir, "documents"))


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(load(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(load(spark, sf_dir, "embeddings").withColumn("label", label), F.col("id") % 100 == 0)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.merkle_manifest(load(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_token_counts, op3_language_id, op4_exact_dedup, op5_sentencepiece, op6_media_columns, op7_ngram_jaccard, op8_url_filter, op9_substring_dedup, op10_lm_score, op11_exact_top_k, op12_hard_negatives, op13_merkle_manifest)}
