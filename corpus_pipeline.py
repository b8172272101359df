"""The corpus pipeline: quality, toxicity, near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's docs.  All but the last return the columns of
``documents``; each works on all that the stage before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import near_duplicates, packing, quality_rules, suffix_dedup, toxicity
from ledgerloom.llm.common import bucket, materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that probably are bad, or of which most words are repeated windows."""
    repeats = 100 * F.col("n_repeat_words") > 50 * F.col("n_words")
    return quality_rules.score_rows(docs).filter(F.col("good") & ~repeats).select("row.*")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose nearest labelled examples are toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), bucket(F.col("doc_id"), 5) != 0)
    return toxicity.score_rows(docs, model).filter("tox.toxicity < 0.5").select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each class; rows of one id are told apart by their texts."""
    return near_duplicates.keep_first(docs).select(*docs.columns)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes later copies of passages of more than 50 words out of the texts, and keeps the first."""
    out = suffix_dedup.remove_passages(docs, keep="first")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; workers that serve the other stages too keep fewer chunks in mind."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cache=100_000)


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeated_passage_stage),
    ("packing", packing_stage),
]
#: Tokenizing and similarity classes can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
