"""Bounded, stratified samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_labels(labels: DataFrame, label: str, train: Column, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """At most ``per_class`` labelled ids of either class, in hash order, and what one of them stands for.

    An id with several rows counts once, by its highest label.  The weights
    are a class's size over its sample's.
    """
    known = labels.filter(train & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    parts = [known.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    weights = {c: sizes.get(c, 0) / max(1, min(per_class, sizes.get(c, 0))) for c in (0, 1)}
    return parts[0].unionByName(parts[1]), weights


def sampled_texts(docs: DataFrame, sample: DataFrame, text: str) -> DataFrame:
    """(doc_id, label, text) of sampled ids; the sample's bound is what makes the broadcast safe."""
    small = F.broadcast(sample)
    return docs.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(small, "doc_id")
