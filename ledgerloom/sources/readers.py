"""Readers of gateway payments, bank statements, invoices, claims and batches, with their guards.

A bad row goes to a quarantine table with its place, or stops the read in
strict mode; it is never dropped in silence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.fees import fee_and_tax

PAYMENT_SCHEMA = "id string, amount long, currency string, status string, captured boolean, method string, order_id string, created_at long, description string, contact string, email string, provenance string, fee long, tax long, bank string, wallet string, bank_transaction_id string, error_reason string, invoice_id string, amount_refunded long, refund_status string, notes map<string,string>"
ORDER_SCHEMA = "id string, amount long, receipt string, created_at long, notes map<string,string>"
STATEMENT_COLUMNS = ("txn_date", "value_date", "description", "ref_no", "debit", "credit", "balance")
INVOICE_COLUMNS = ("invoice_no", "customer_name", "customer_gstin", "invoice_date", "due_date", "gross_amount", "tds_amount", "currency", "status", "po_reference")


def money(text: Column, blank_is_zero: bool = True) -> Column:
    """Rupee text to minor units; null where it isn't a number (or blank, where blank is an error)."""
    t = F.trim(F.regexp_replace(text, "[₹,]", ""))
    blank = t.isNull() | t.isin("", "-")
    value = F.bround(F.expr("1") * t.try_cast("decimal(38,4)") * 100, 0).cast("long")
    return F.when(blank, F.lit(0).cast("long") if blank_is_zero else F.lit(None).cast("long")).otherwise(value)


def need_columns(df: DataFrame, names: tuple[str, ...], path: str) -> None:
    """Stops a read whose file lacks a column."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"{path}: missing required column {missing[0]!r} (it has: {', '.join(sorted(df.columns))})")


def numbered(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``line_no`` by the order of files and of lines in them.

    Lines are counted by the pieces in which they are read; only those few
    counts are summed in order.  A piece keeps its own order, so no task holds
    more than its piece.
    """
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    rows = raw.select("*", file.alias("_file"), block.alias("_block"), F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_in"))
    counts = rows.groupBy("_file", "_block", "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each piece of a file
    starts = counts.withColumn("_before", before).drop("_n")
    place = F.row_number().over(Window.partitionBy("_file", "_block", "_part").orderBy("_in"))
    return rows.withColumn("_place", place).join(F.broadcast(starts), ["_file", "_block", "_part"]).withColumn("line_no", (F.col("_before") + F.col("_place")).cast("int")).select(*keys, "line_no")


def money_errors(raw: DataFrame, path: str, columns: dict[str, bool]) -> DataFrame:
    """(file, row, column, raw) of money cells that can't be read; ``columns`` says where a blank is zero.  ``raw`` has line_no; row 1 is the header."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("raw"), F.lit(z).alias("z"), money(F.col(c), z).alias("v")) for c, z in columns.items())))
    return raw.select((F.col("line_no") + 1).alias("row"), cells.alias("c")).filter("c.v is null").select(F.lit(path).alias("file"), "row", "c.column", "c.raw")


def _strict(errors: DataFrame, what: str) -> None:
    if first := errors.orderBy("row").limit(1).collect():
        e = first[0]
        raise ValueError(f"{e['file']} row {e['row']}, column {e['column']!r}: {e['raw']!r} is no {what}")


def currency_gate(df: DataFrame, column: str = "currency", strict: bool = False, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows in INR, and the rest with the reason; in strict mode the first other one stops the read."""
    ok = F.upper(F.trim(F.coalesce(column, F.lit("")))) == "INR"
    bad = df.filter(~ok).withColumn("reason", F.concat(F.lit("currency "), F.coalesce(column, F.lit("missing"))))
    if strict and (first := bad.limit(1).collect()):
        raise ValueError(f"{first[0][key] if key else 'a row'}: {first[0]['reason']} is not INR")
    return df.filter(ok), bad


def read_payments(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    raw = spark.read.schema(PAYMENT_SCHEMA).json(path, multiLine=True)
    if strict:
        currency_gate(raw, strict=True, key="id")
    return raw.withColumns(
        {
            "description": F.coalesce("description", F.lit("")),
            "provenance": F.coalesce("provenance", F.lit("S")),
            "amount_refunded": F.coalesce("amount_refunded", F.lit(0)),
            "pay_date": F.to_date(F.timestamp_seconds("created_at")),
            "customer_name": F.try_element_at("notes", F.lit("customer_name")),
            "invoice_no": F.try_element_at("notes", F.lit("invoice_no")),
        }
    )


def read_gateway(spark: SparkSession, payments_path: str, orders_path: str | None = None) -> DataFrame:
    """Raw gateway exports: captured or failed payments as they are (R1), and orders made into settled payments (R2).

    An order was never captured: its payment has a derived id, fees of the rate
    model, and its provenance says so.
    """
    items = spark.read.schema(f"items array<struct<{_struct(PAYMENT_SCHEMA)}>>").json(payments_path, multiLine=True)
    real = items.select(F.explode("items").alias("p")).select("p.*").withColumns({"currency": F.lit("INR"), "provenance": F.lit("R1"), "amount_refunded": F.coalesce("amount_refunded", F.lit(0))})
    if orders_path is None:
        return real
    orders = spark.read.schema(f"items array<struct<{_struct(ORDER_SCHEMA)}>>").json(orders_path, multiLine=True).select(F.explode("items").alias("o")).select("o.*")
    base, tax = fee_and_tax(F.col("amount"))
    given = {
        "id": F.concat(F.lit("pay_R2X"), F.substr("id", F.lit(7))), "amount": F.col("amount"), "currency": F.lit("INR"), "status": F.lit("captured"), "captured": F.lit(True), "method": F.lit("netbanking"),
        "order_id": F.col("id"), "created_at": F.col("created_at"), "description": F.concat(F.lit("#"), "receipt"), "provenance": F.lit("R2"), "fee": base + tax, "tax": tax, "amount_refunded": F.lit(0), "notes": F.col("notes"),
    }
    made = orders.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in real.schema.fields))
    return real.unionByName(made)


def _struct(schema: str) -> str:
    """Column definitions as the fields of a struct."""
    parts, depth, cur = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            parts.append(cur)
            cur = ""
        else:
            cur += ch
    return ", ".join(":".join(p.strip().split(" ", 1)) for p in (*parts, cur))


def read_statement(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Bank lines with ids by their place in the file; blank value dates take the booking date."""
    raw = spark.read.option("header", True).csv(path)
    need_columns(raw, STATEMENT_COLUMNS, path)
    out = numbered(raw, list(raw.columns))
    if strict:
        _strict(money_errors(out, path, {"debit": True, "credit": True, "balance": False}), "rupee amount")
    number = F.col("line_no").cast("string")
    return out.select(
        F.concat(F.lit("bank_txn_"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)).alias("id"), "line_no",
        F.col("txn_date").cast("date").alias("txn_date"),
        F.coalesce(F.nullif(F.trim("value_date"), F.lit("")), F.col("txn_date")).cast("date").alias("value_date"),
        "description", "ref_no", money(F.col("debit")).alias("debit"), money(F.col("credit")).alias("credit"), money(F.col("balance"), False).alias("balance"),
    )


def read_invoices(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    need_columns(raw, INVOICE_COLUMNS, path)
    if strict:
        currency_gate(raw, strict=True, key="invoice_no")
    return raw.select(
        "invoice_no", "customer_name", "customer_gstin", F.col("invoice_date").try_cast("date").alias("invoice_date"), F.col("due_date").try_cast("date").alias("due_date"),
        money(F.col("gross_amount")).alias("gross"), money(F.col("tds_amount")).alias("tds"), "currency", "status", "po_reference",
    )


def read_payer_directory(spark: SparkSession, path: str | None) -> DataFrame:
    """Authorised payers; without a file, none."""
    schema = "payer_name string, authorised_for_customer string, relationship string, on_record_since string"
    return spark.read.schema(schema).option("header", True).csv(path) if path and _exists(spark, path) else spark.createDataFrame([], schema)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """Third-party claims, ids parted by white space, semicolons or commas; blank rows are skipped.

    A row without a credit or without ids stops the read: an empty claim and an
    absent one mean different things.
    """
    raw = numbered(spark.read.option("header", True).csv(path), ["bank_txn_id", "payment_ids"])
    txn, text = F.trim(F.coalesce("bank_txn_id", F.lit(""))), F.coalesce("payment_ids", F.lit(""))
    ids = F.filter(F.split(F.regexp_replace(text, "[;,]", " "), r"\s+"), lambda x: x != "")
    rows = raw.select("line_no", txn.alias("bank_txn_id"), ids.alias("payment_ids")).filter((F.col("bank_txn_id") != "") | (F.size("payment_ids") > 0))
    if bad := rows.filter((F.col("bank_txn_id") == "") | (F.size("payment_ids") == 0)).orderBy("line_no").limit(1).collect():
        lacks = "an empty bank_txn_id" if not bad[0]["bank_txn_id"] else "no payment ids"
        raise ValueError(f"{path}: row {bad[0]['line_no'] + 1} has {lacks}")
    return rows.drop("line_no")


def check_manifest(spark: SparkSession, folder: str, seed: int | None = None, density: int | None = None) -> dict:
    """The manifest of a batch, none if it has none; a seed or density that was asked for has to be the batch's own."""
    path = f"{folder.rstrip('/')}/manifest.json"
    meta = spark.read.json(path, multiLine=True).first().asDict() if _exists(spark, path) else {}
    asked = {"seed": seed, "payments_per_window": density}
    wrong = [f"{k} {v} was asked for but the batch has {meta[k]}" for k, v in asked.items() if v is not None and k in meta and int(meta[k]) != v]
    if wrong:
        raise ValueError(f"{folder}: " + "; ".join(wrong))
    return meta


def balance_breaks(lines: DataFrame, partition: str, order: str) -> DataFrame:
    """Lines whose balance isn't the one before plus credit minus debit."""
    w = Window.partitionBy(partition).orderBy(order)
    expected = F.lag("balance").over(w) + F.col("credit") - F.col("debit")
    return lines.withColumn("expected", expected).filter("expected is not null and expected != balance")


def assert_continuity(lines: DataFrame, partition: str, order: str) -> int:
    """Rows whose running balance was verified, 0 where there are fewer than two or no balances; the first break stops it."""
    n, known = lines.agg(F.count("*"), F.max(F.col("balance") != 0)).first()
    if n < 2 or not known:
        return 0
    if bad := balance_breaks(lines, partition, order).orderBy(order).limit(1).collect():
        raise ValueError(f"balance breaks at {order} {bad[0][order]}: {bad[0]['balance']} instead of {bad[0]['expected']}, off by {bad[0]['balance'] - bad[0]['expected']}")
    return n


def ledger_errors(invoices: DataFrame) -> DataFrame:
    """Every error of an invoice ledger: blank or repeated numbers, negative amounts, missing dates."""
    n = F.col("_times")
    errors = F.array(
        F.when(F.coalesce(F.trim("invoice_no"), F.lit("")) == "", "blank invoice_no"),
        F.when((F.coalesce(F.trim("invoice_no"), F.lit("")) != "") & (n > 1), "repeated invoice_no"),
        F.when(F.col("gross").isNull() | (F.col("gross") < 0), "bad gross"),
        F.when(F.col("tds").isNull() | (F.col("tds") < 0), "bad tds"),
        F.when(F.col("invoice_date").isNull(), "bad invoice_date"),
    )
    counted = invoices.withColumn("_times", F.count("*").over(Window.partitionBy("invoice_no")))
    listed = counted.withColumn("error", F.explode(F.filter(errors, lambda e: e.isNotNull())))
    return listed.select("invoice_no", "error")
