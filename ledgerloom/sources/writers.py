"""Writers of batches, payloads, scorecards, the evidence ledger and versions of the invoice ledger."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.fees import rupees


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file of the driver's, through Hadoop's file system."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_batch(folder: str, payments: DataFrame, bank: DataFrame, invoices: DataFrame, truth: DataFrame, seed: int, density: int) -> dict:
    """A batch as the readers take it: payments as JSON lines, statement, invoices and truth as CSV, and a manifest with its counts.

    The truth goes to a folder of its own that no reader opens.
    """
    spark, base = payments.sparkSession, folder.rstrip("/")
    payments.write.mode("overwrite").json(f"{base}/payments.json")
    money = [F.when(F.col(c) != 0, rupees(F.col(c))).alias(c) for c in ("debit", "credit")]
    bank.select("txn_date", "value_date", F.col("narration").alias("description"), "ref_no", *money, rupees(F.col("balance")).alias("balance")).write.mode("overwrite").option("header", True).csv(f"{base}/bank_statement.csv")
    invoices.withColumns({"gross_amount": rupees(F.col("gross")), "tds_amount": rupees(F.col("tds")), "net_receivable": rupees(F.col("net_receivable"))}).drop("gross", "tds").write.mode("overwrite").option("header", True).csv(f"{base}/invoices.csv")
    truth.write.mode("overwrite").json(f"{base}/_truth/ground_truth.json")
    meta = {"seed": seed, "payments_per_window": density, "payments": payments.count(), "bank_txns": bank.count(), "invoices": invoices.count()}
    _write_text(spark, f"{base}/manifest.json", json.dumps(meta))
    return meta


def write_payload(path: str, parts: dict[str, DataFrame]) -> None:
    """The parts of a run's payload as JSON lines, a folder for each."""
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")


def write_scorecard(path: str, scorecard: DataFrame, by_tier: DataFrame, bounds: DataFrame) -> dict:
    """Headline figures, those of each tier and their lower bounds as one small JSON file: a row and a few at any size."""
    out = {"headline": scorecard.first().asDict(), "tiers": [r.asDict() for r in by_tier.orderBy("tier").collect()], "lower_bounds": [r.asDict() for r in bounds.orderBy("tier").collect()]}
    _write_text(scorecard.sparkSession, path, json.dumps(out, sort_keys=True))
    return out


def append_evidence(path: str, accepted: DataFrame, rejected: DataFrame) -> None:
    """Adds to an evidence ledger; what it already holds for a credit and field stays, and a second word on it is kept as rejected."""
    spark = accepted.sparkSession
    fs, p = _fs(spark, f"{path.rstrip('/')}/accepted")
    if fs.exists(p):
        known = spark.read.parquet(f"{path}/accepted").select("txn_id", "field").distinct()
        again = accepted.join(known, ["txn_id", "field"], "left_semi").withColumn("reason", F.lit("duplicate"))
        rejected = rejected.unionByName(again)
        accepted = accepted.join(known, ["txn_id", "field"], "left_anti")
    rejected.write.mode("append").parquet(f"{path}/rejected")
    accepted.write.mode("append").parquet(f"{path}/accepted")


def read_evidence(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of a ledger; two accepted words on one credit and field stop the read."""
    accepted = spark.read.parquet(f"{path.rstrip('/')}/accepted")
    if bad := accepted.groupBy("txn_id", "field").count().filter("count > 1").limit(1).collect():
        raise ValueError(f"{path}: {bad[0]['txn_id']} has two accepted values of {bad[0]['field']}")
    return accepted, spark.read.parquet(f"{path.rstrip('/')}/rejected")


def replace_ledger(folder: str, invoices: DataFrame) -> str:
    """Writes a new version of the invoice ledger and points to it; earlier versions stay. Returns the version."""
    base, version = folder.rstrip("/"), f"v-{uuid.uuid4().hex}"
    spark = invoices.sparkSession
    invoices.write.parquet(f"{base}/{version}")
    _write_text(spark, f"{base}/CURRENT.tmp", "\n".join([*versions(spark, base), version]))
    _swap(spark, base)
    return version


def _swap(spark: SparkSession, base: str) -> None:
    """The new list of versions takes the old one's place by renaming."""
    fs, new = _fs(spark, f"{base}/CURRENT.tmp")
    _, cur = _fs(spark, f"{base}/CURRENT")
    if fs.exists(cur):
        fs.delete(cur, False)
    if not fs.rename(new, cur):
        raise OSError(f"{base}: the list of versions can't be replaced")


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Versions of a ledger, oldest first; a list left unfinished by a lost driver counts where the old one is gone."""
    base = folder.rstrip("/")
    for name in ("CURRENT", "CURRENT.tmp"):
        fs, p = _fs(spark, f"{base}/{name}")
        if fs.exists(p):
            return [r["value"] for r in spark.read.text(f"{base}/{name}").collect() if r["value"]]
    return []


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{versions(spark, folder)[-1]}")


def revert_ledger(spark: SparkSession, folder: str) -> str:
    """Back to the version before; the first one can't be reverted."""
    base, known = folder.rstrip("/"), versions(spark, folder)
    if len(known) < 2:
        raise ValueError(f"{folder}: there is no earlier version")
    _write_text(spark, f"{base}/CURRENT.tmp", "\n".join(known[:-1]))
    _swap(spark, base)
    return known[-2]
