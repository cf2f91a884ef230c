"""The queries of the operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, exact_dedup, exponion, filter_audit, html_text, lattice_lm, media, mixing, near_join, oracles, packing, quality, tokens, toxicity, url_filter

END = 2
BYTE_BPE, WORD_BPE, PIECES = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def op1_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = toxicity.fold(F.col("doc_id"), 10) == 0
    scores = lattice_lm.lm_scores(common.table(spark, sf_dir, "documents"), ~held_out, tokens.tokenizer_path(PIECES))
    return scores.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_url_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(common.table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_extendible_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.extendible_dedup(common.table(spark, sf_dir, "documents"))


def op4_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = common.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.quality_filter(common.table(spark, sf_dir, "documents"), trusted).withColumn("llr", F.round("llr", 9))


def op5_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(toxicity.fold(F.col("doc_id"), 4) != 2))
    return toxicity.score(docs, model).select(
        "doc_id", (toxicity.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op6_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(common.table(spark, sf_dir, "documents"))
    at = [F.round(F.get("positions", F.lit(k)), 9).alias(f"position_{k + 1}") for k in range(3)]
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", *at)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "tokens")
    made = tokens.write_tokens(common.table(spark, sf_dir, "documents"), path, tokens.tokenizer_path(BYTE_BPE), END)
    return tokens.read_tokens(spark, path, made)


def op8_count_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_groups(common.table(spark, sf_dir, "documents"))


def op9_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(common.table(spark, sf_dir, "pages"))


def op10_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(common.table(spark, sf_dir, "documents"), tokens.tokenizer_path(WORD_BPE), END)


def op11_first_failure_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op12_exponion_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters, _ = exponion.cluster(common.table(spark, sf_dir, "embeddings"))
    return clusters


def op13_wav_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.read_media(media.wav_column(common.table(spark, sf_dir, "documents")))
    return media.with_feature(read).drop("pairs")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
