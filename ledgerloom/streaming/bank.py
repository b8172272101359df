"""Bank lines as a stream against settled payments: an extension, for late lines.

A line is matched within the lookback; the watermark closes a day once no line
for it can still arrive, and only closed days are counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import params as P


def daily_totals(lines: DataFrame, time_column: str = "ts", amount: str = "value") -> DataFrame:
    """Counts and sums of each closed day, by tumbling windows behind a watermark."""
    return (
        lines.withWatermark(time_column, f"{P.LOOKBACK_DAYS} days")
        .groupBy(F.window(time_column, "1 day"))
        .agg(F.count("*").alias("n"), F.sum(amount).alias("total"))
        .select(F.col("window.start").alias("day"), "n", "total")
    )
