"""Where intermediate state goes: the folder in spark.checkpoint.dir, which executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_SEEN: dict[tuple, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only in local mode, where all share one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]):
    """What ``make`` returns, made once for a session and folder; derived tables don't outlive their application."""
    key = (spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None) or "", sf_dir, name)
    if key not in _SEEN:
        made = make()
        key = (key[0], spark.conf.get("spark.checkpoint.dir", None) or "", *key[2:])
        _SEEN[key] = made
    return _SEEN[key]
