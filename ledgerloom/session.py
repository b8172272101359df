"""Session helpers."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import SparkSession


def let_workers_import(spark: SparkSession) -> None:
    """Puts the library's root on the path of Python workers that share the driver's files."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])


def together(*make: Callable[[], object]) -> list:
    """What each of ``make`` returns; their jobs run side by side, since a match is many short stages with planning between them."""
    with ThreadPoolExecutor(len(make)) as pool:
        return [f.result() for f in [pool.submit(m) for m in make]]
