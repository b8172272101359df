"""One query for each operator, over its whole table, with the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket, table


def op1_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm import score_documents

    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, bucket(F.col("doc_id"), 7) != 2, fixed_input=True)
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import base_failed, score_quality

    scored = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=("doc_id",))
    failed = base_failed()
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("good")).alias("kept"), "quality_probability",
    )


def op3_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import near_duplicate_classes

    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import removal_digest

    return removal_digest(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


def op6_anisotropic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearest import nearest

    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 100 == 0)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sp_encode import digest_frame

    return digest_frame(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score_toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    train = bucket(F.col("doc_id"), 5) != 0
    model = fit(docs, table(spark, sf_dir, "labels"), train)
    return score_toxicity(docs, model).select(
        "doc_id", (~train).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), "evidence",
    )


def op10_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_crf import fit, score_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    train = bucket(F.col("doc_id"), 5) != 0
    model = fit(docs, table(spark, sf_dir, "labels"), train)
    return score_lines(docs, model).select(
        "doc_id", (~train).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.3).cast("int").alias("predicted"),
    )


QUERIES = {f.__name__: f for f in (op1_ppm_scoring, op2_quality_rules, op3_chosen_path_join, op4_suffix_dedup, op5_license_scan, op6_anisotropic_neighbours, op7_sentencepiece, op8_best_fit_packing, op9_toxicity_neighbours, op10_line_crf_quality)}
ORACLES: dict[str, str] = {}
