"""Closed days of a stream of bank lines."""

from ledgerloom.streaming.bank import daily_totals


def test_only_closed_days_are_counted(spark, tmp_path):
    schema = "ts timestamp, value long"
    out, source = str(tmp_path / "out"), str(tmp_path / "in")
    batches = [[("2020-01-01 10:00:00", 1), ("2020-01-01 23:00:00", 2)], [("2020-01-03 01:00:00", 4), ("2020-01-01 12:00:00", 8)], [("2020-01-12 00:00:00", 16)], [("2020-01-02 00:00:00", 32), ("2020-01-20 00:00:00", 64)]]
    for rows in batches:
        spark.createDataFrame(rows, "ts string, value long").selectExpr("cast(ts as timestamp) ts", "value").coalesce(1).write.mode("append").parquet(source)
        lines = spark.readStream.schema(schema).parquet(source)
        q = daily_totals(lines).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {str(r["day"])[:10]: (r["n"], r["total"]) for r in spark.read.parquet(out).collect()}
    assert got["2020-01-01"] == (3, 11) and got["2020-01-03"] == (1, 4) and "2020-01-20" not in got
    assert "2020-01-02" not in got  # the line came after its day had been closed
