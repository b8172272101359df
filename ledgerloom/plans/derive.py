"""The three sides of a reconciliation, derived from the star-schema tables.

Every rule is deterministic in the order key, so that SQL on the same tables
gives the same rows; ``plans/sql.py`` has it.  Among the lines stand third-party
payers, settlements split over two lines, wrong stated counts, garbled
narrations, shared invoices, and whole and partial claw-backs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.fees import fee_and_tax
from ledgerloom.session import let_workers_import

FAMILIES = ("KAVERI TEXTILES", "KAVERI TEXTILES PVT LTD", "MERIDIAN FOODS", "MERIDIAN FOODS LLP", "ORBIT STEEL", "ORBIT STEELWORKS", "LOTUS EXPORTS", "LOTUS EXPORTERS")
BANKS = ("HDFCN", "ICICR", "SBINX", "UTRAB")
THIRD_PARTY = "SUNRISE HOLDINGS"
EPOCH = "1970-01-01"


@dataclass(frozen=True)
class Sides:
    payments: DataFrame
    invoices: DataFrame
    bank: DataFrame


def _padded(prefix: str, key: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(key.cast("string"), width, "0"))


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def _div(a: Column, b: int) -> Column:
    """Whole quotient towards zero, as SQL's integer division has it."""
    return F.call_function("div", a.cast("long"), F.lit(b).cast("long"))


def _payment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments without the tax that their invoices withhold."""
    let_workers_import(spark)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    k = F.col("o_orderkey")
    amount = F.bround(F.col("o_totalprice") * 100).cast("long")
    day = F.to_date("o_orderdate")
    out = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        k.alias("key"),
        _padded("pay_", k, 9).alias("payment_id"),
        F.col("c_nationkey").cast("int").alias("merchant_id"),
        amount.alias("amount"),
        day.alias("pay_date"),
        (k % 33 != 0).alias("captured"),
        F.when(k % 41 == 0, _div(amount, 10)).otherwise(0).cast("long").alias("refunded"),
        _pick(FAMILIES, F.col("c_custkey")).alias("customer_name"),
        _padded("order_", k, 9).alias("order_id"),
        _padded("BTXN", k, 11).alias("bank_transaction_id"),
        _padded("#RCP", k, 9).alias("description"),
        ((F.col("o_orderpriority") == "5-LOW") & (k % 5 == 0)).alias("fee_hidden"),
        F.floor(F.datediff(day, F.lit(EPOCH).cast("date")) / 3).cast("int").alias("w"),
    )
    # The second payment of a merchant's three days may stand on the first one's invoice.
    group = Window.partitionBy("merchant_id", "w")
    first, place = F.min("key").over(group), F.row_number().over(group.orderBy("key")) - 1
    shared = (place == 1) & ((F.col("merchant_id") + F.col("w")) % 5 == 0) & (first % 20 != 0)
    out = out.withColumn("inv_key", F.when(F.col("key") % 20 != 0, F.when(shared, first).otherwise(F.col("key"))))
    number = F.concat(F.lit("INV-"), (1995 + F.col("inv_key") % 7).cast("string"), F.lit("-"), F.lpad(F.col("inv_key").cast("string"), 8, "0"))
    base, tax = fee_and_tax(F.col("amount"))
    return out.withColumns({"invoice_no": number, "true_fee": base + tax}).withColumn("fee", F.when(~F.col("fee_hidden"), F.col("true_fee"))).drop("fee_hidden")


def _ledger(rows: DataFrame) -> DataFrame:
    """One row for each invoice, with the tax withheld on it."""
    out = rows.filter("invoice_no is not null").groupBy("merchant_id", "invoice_no").agg(
        F.min("inv_key").alias("inv_key"), F.sum("amount").alias("gross"), F.min("pay_date").alias("invoice_date"),
        F.min(F.struct("key", "customer_name")).getField("customer_name").alias("customer_name"),
    )
    tds = F.when(F.col("inv_key") % 11 == 0, F.bround(F.col("gross") * F.lit(0.02))).otherwise(0).cast("long")
    return out.withColumn("tds", tds).drop("inv_key")


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments, each with the tax withheld on its invoice, looked up there."""
    rows = _payment_rows(spark, sf_dir)
    tds = _ledger(rows).select("merchant_id", "invoice_no", "tds")
    return rows.join(tds, ["merchant_id", "invoice_no"], "left").withColumn("tds", F.coalesce("tds", F.lit(0)).cast("long")).drop("inv_key")


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(_payment_rows(spark, sf_dir)).select(
        "invoice_no", "merchant_id", "customer_name", "invoice_date", "gross", "tds", (F.col("gross") - F.col("tds")).alias("net_receivable")
    )


def bank_lines(pay: DataFrame) -> DataFrame:
    """Credits, one for each settled payment or batch of up to five, and debits that claw some back."""
    settled = pay.filter(F.col("captured") & (F.col("key") % 47 != 0))
    place = F.row_number().over(Window.partitionBy("merchant_id", "w").orderBy("key")) - 1
    batched = (F.col("merchant_id") + F.col("w")) % 3 == 0
    settled = settled.withColumn("chunk", F.when(batched, F.floor(place / 5)).otherwise(place).cast("int"))
    # Tax is withheld once for each invoice of a settlement.
    again = F.row_number().over(Window.partitionBy("merchant_id", "w", "chunk", "invoice_no").orderBy("key")) > 1
    settled = settled.withColumn("withheld", F.when(F.col("invoice_no").isNotNull() & again, 0).otherwise(F.col("tds")))
    credit = (
        settled.groupBy("merchant_id", "w", "chunk")
        .agg(
            F.min("key").alias("key"), F.count("*").cast("int").alias("n"),
            F.sum(F.col("amount") - F.col("true_fee") - F.col("withheld") - F.col("refunded")).alias("credit"),
            F.min(F.struct("key", "customer_name")).getField("customer_name").alias("customer"),
            F.min(F.struct("key", F.coalesce("invoice_no", F.lit("")))).getField("col2").alias("inv"),
            F.min(F.struct("key", (F.col("amount") - F.col("true_fee") - F.col("tds") - F.col("refunded")).alias("net"))).getField("net").alias("first_net"),
        )
    )
    k, single = F.col("key"), F.col("n") == 1
    ref = F.when(single & (k % 29 == 0), _padded("BTXN", k, 11)).otherwise(F.concat(_pick(BANKS, k), F.lpad(k.cast("string"), 11, "0")))
    name = F.when(single & (k % 53 == 0), THIRD_PARTY).otherwise(F.col("customer"))
    digits = F.regexp_replace("inv", "[^0-9]", "")
    # Rows are multiplied in place: a union would derive everything once for each of its branches.
    split = single & (k % 59 == 0)
    credit = credit.withColumns({"ref": ref, "name": name, "split": split}).withColumn("part", F.explode(F.when(split, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("")))))
    head = _div(F.col("credit") * 4, 10)
    lines = credit.withColumn("credit", F.when(F.col("part") == "a", head).when(F.col("part") == "b", F.col("credit") - head).otherwise(F.col("credit")))
    quoted = (k % 4 == 0) & (F.col("inv") != "")
    garbled = (k % 31 == 0) & (F.col("inv") != "")
    kind = F.floor(k / 31) % 3
    narration = (
        F.when(F.col("split"), F.concat(F.lit("GATEWAY SETTLEMENT "), "ref", F.lit(" PART "), F.when(F.col("part") == "a", "1").otherwise("2"), F.lit(" OF 2")))
        .when(~single, F.concat(F.lit("GATEWAY SETTLEMENT "), "ref", F.lit(" "), (F.col("n") + (k % 61 == 0).cast("int")).cast("string"), F.lit(" TXNS")))
        .when(garbled & (kind == 0), F.concat(F.lit("BY CLG/"), "ref", F.lit("/"), "name", F.lit(" INV"), digits))
        .when(garbled & (kind == 1), F.concat(F.lit("INW REM "), F.lpad(k.cast("string"), 6, "0"), F.lit(" "), "name", F.lit(" "), F.translate("inv", "-", "/")))
        .when(garbled, F.concat(F.lit("*"), "ref", F.lit("* "), "name", F.lit(" - RECD")))
        .when(quoted, F.concat(F.lit("RTGS-"), "ref", F.lit("-"), "name", F.lit("-"), "inv"))
        .when(k % 3 == 0, F.concat(F.lit("NEFT-"), "ref", F.lit("-"), "name"))
        .when(k % 3 == 1, F.concat(F.lit("IMPS/"), "ref", F.lit("/"), "name", F.lit("/CR")))
        .otherwise(F.concat(F.lit("UPI/"), "ref", F.lit("/"), "name"))
    )
    date = F.date_add(F.lit(EPOCH).cast("date"), (3 * (F.col("w") + 1) + k % 3).cast("int"))
    credits = lines.select(
        F.concat(_padded("bt_", k, 9), "part").alias("txn_id"), "merchant_id", date.alias("txn_date"),
        F.when(k % 17 == 0, F.date_sub(date, 1)).otherwise(date).alias("value_date"), narration.alias("narration"),
        F.col("ref").alias("ref_no"), "credit", F.lit(0).cast("long").alias("debit"), "key", "n", "first_net",
    )
    outside, partial = k % 101 == 0, (F.col("n") > 1) & (k % 43 == 0)
    taken_back = (k % 37 == 0) | outside | partial
    both = credits.withColumn("is_debit", F.explode(F.when(taken_back, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    back, later = F.col("is_debit"), F.date_add("txn_date", (3 + k % 7).cast("int"))
    reversal = F.concat(F.lit("CHARGEBACK REV "), F.when(outside, F.concat(F.lit("EXTRN"), F.lpad(k.cast("string"), 11, "9"))).otherwise(F.col("ref_no")), F.lit(" DISPUTE"))
    values = {
        "txn_id": F.concat(F.lit("bd_"), F.substring("txn_id", 4, 10)), "txn_date": later, "value_date": later, "narration": reversal, "ref_no": _padded("DBTRV", k, 11),
        "credit": F.lit(0).cast("long"), "debit": F.when(partial & (k % 37 != 0) & ~outside, F.col("first_net")).otherwise(F.col("credit")),
    }
    return both.withColumns({c: F.when(back, v).otherwise(F.col(c)) for c, v in values.items()}).drop("n", "first_net")


def truth(pay: DataFrame) -> DataFrame:
    """(txn_id, payment_ids, relation, labels, expected): what each credit was derived from.

    A split line's answer is the payment that both lines settle.  A third
    party's payment should be refused: nothing in the batch allows it.
    """
    settled = pay.filter(F.col("captured") & (F.col("key") % 47 != 0))
    place = F.row_number().over(Window.partitionBy("merchant_id", "w").orderBy("key")) - 1
    batched = (F.col("merchant_id") + F.col("w")) % 3 == 0
    settled = settled.withColumn("chunk", F.when(batched, F.floor(place / 5)).otherwise(place).cast("int"))
    x = settled.groupBy("merchant_id", "w", "chunk").agg(
        F.min("key").alias("key"), F.count("*").alias("n"), F.sort_array(F.collect_list("payment_id")).alias("ids"), F.countDistinct("invoice_no").alias("invs"),
        F.count("invoice_no").alias("with_inv"), F.min(F.struct("key", F.coalesce("invoice_no", F.lit("")))).getField("col2").alias("inv"), F.max((F.col("refunded") > 0).cast("int")).alias("refunded"),
        F.max(F.col("fee").isNull().cast("int")).alias("hidden"),
    )
    k, single = F.col("key"), F.col("n") == 1
    split = single & (k % 59 == 0)
    tests = {
        "third_party_payer": single & (k % 53 == 0) & ~split, "split_settlement": split, "wrong_count": ~single & (k % 61 == 0), "garbled_narration": single & ~split & (k % 31 == 0) & (F.col("inv") != ""),
        "shared_invoice": F.col("invs") < F.col("with_inv"), "netted_refund": F.col("refunded") == 1, "unknown_fee": F.col("hidden") == 1, "advance": single & (F.col("inv") == ""),
    }
    labels = F.filter(F.array(*(F.when(t, name) for name, t in tests.items())), lambda v: v.isNotNull())
    relation = F.when(split, "split").when(single, "one_to_one").otherwise("many_to_one")
    expected = F.when(tests["third_party_payer"] | tests["wrong_count"], "refuse").otherwise("assign")
    lines = F.explode(F.when(split, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit(""))))
    x = x.select("key", F.array_join("ids", ",").alias("payment_ids"), relation.alias("relation"), labels.alias("labels"), expected.alias("expected"), lines.alias("part"))
    return x.select(F.concat(_padded("bt_", k, 9), "part").alias("txn_id"), "payment_ids", "relation", "labels", "expected")


def register(spark: SparkSession) -> DataFrame:
    """Who may pay for whom: the third party for every other customer, and a decoy."""
    rows = [(THIRD_PARTY + " PVT LTD", f, "parent") for f in FAMILIES[::2]] + [("SUNSET HOLDINGS", FAMILIES[1], "affiliate_decoy")]
    return spark.createDataFrame(rows, "payer_name string, authorised_for_customer string, relationship string")


def sides(spark: SparkSession, sf_dir: str) -> Sides:
    pay = payments(spark, sf_dir)
    return Sides(pay, invoices(spark, sf_dir), bank_lines(pay))
