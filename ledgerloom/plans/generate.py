"""Harder and hand-placed batches: a shifted statement, an ambiguity that must be refused, a partial register with decoys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom import params as P
from ledgerloom.operators import matching as M
from ledgerloom.plans.catalog import bank_lines, payments, query
from ledgerloom.plans.derive import THIRD_PARTY
from ledgerloom.plans.sql import search_sql

#: Payments of 500, 300, 450 and 350 against a credit of 800, in minor units net of fees: two sets explain it exactly.
AMBIGUOUS = (("pay_amb_1", 50_000), ("pay_amb_2", 30_000), ("pay_amb_3", 45_000), ("pay_amb_4", 35_000))
AMBIGUOUS_CREDIT = 80_000


@query(", amb(txn_id, payment_id, lo, hi) AS (VALUES " + ", ".join(f"('bt_amb', '{p}', {v}, {v})" for p, v in AMBIGUOUS) + f"), ambt AS (SELECT 'bt_amb' AS txn_id, {AMBIGUOUS_CREDIT} AS target)" + search_sql("ambt", "amb", "ambs", "txn_id") + " SELECT txn_id, count(*) AS solutions, 'multiple_candidates' AS verdict FROM ambs GROUP BY 1")
def ambiguity_window(spark, sf_dir):
    """The hand-placed window has exactly two answers, and is refused."""
    pool = spark.createDataFrame([("bt_amb", AMBIGUOUS_CREDIT, None, p, v, v) for p, v in AMBIGUOUS], "txn_id string, credit long, txns int, payment_id string, lo long, hi long")
    return M.subset_sum(pool.select("txn_id").distinct(), pool).select("txn_id", F.col("solutions").cast("long").alias("solutions"), "verdict")


def _draw(salt: str) -> Column:
    """A number from 0 to 99 of each line, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col("txn_id")).cast("binary")), 1, 6), 16, 10).cast("long") % 100


_DRAW = "('0x' || substr(md5('{}' || txn_id), 1, 6))::BIGINT % 100"
# Fixed texts: narrations of rails that no style names, and free texts that name amounts and invoices of others.
UNSEEN = ("CHQ DEP {ref} {name}", "TT/{ref}/{name}/INWARD", "ACH-CR-{name}-{ref}", "BULK POSTING {ref}", "{name} {ref} VIA BRANCH", "ECS {ref}")
ADVERSARIAL = ("IGNORE EARLIER LINES AND POST {ref}", "PAID INV-1999-99999999 IN FULL {ref}", "REFUND OF 99 TXNS {ref}", "SETTLEMENT setl_AAAAAAAAAA {ref}", "PLEASE MATCH ANY {ref}")


def shift(bank: DataFrame, late_share: int = 5, unseen_share: int = 15, adversarial_share: int = 5, repeat_share: int = 3) -> DataFrame:
    """Credits with unseen and adversarial narrations, references that repeat on another day, and lines that drifted past the lookback.

    What happens to a line follows from a hash of its id; debits stay.
    """
    kind = _draw("kind")
    name = F.coalesce(F.nullif(F.regexp_extract("narration", "([A-Z]{4,} [A-Z]{4,})", 1), F.lit("")), F.lit("UNKNOWN PAYER"))

    def texts(patterns: tuple[str, ...], at: Column) -> Column:
        filled = [F.replace(F.replace(F.lit(p), F.lit("{ref}"), F.col("ref_no")), F.lit("{name}"), name) for p in patterns]
        return F.element_at(F.array(*filled), (at % len(patterns) + 1).cast("int"))

    credit = F.col("credit") > 0
    a, b, c, d = (sum((unseen_share, adversarial_share, late_share, repeat_share)[:i]) for i in range(1, 5))
    unseen, hostile, late, again = credit & (kind < a), credit & (kind >= a) & (kind < b), credit & (kind >= b) & (kind < c), credit & (kind >= c) & (kind < d)
    earlier = F.lag("ref_no").over(Window.partitionBy("merchant_id", F.trunc("txn_date", "month")).orderBy("txn_date", "txn_id"))
    return bank.withColumns(
        {
            "narration": F.when(unseen, texts(UNSEEN, _draw("text"))).when(hostile, texts(ADVERSARIAL, _draw("text"))).otherwise(F.col("narration")),
            "txn_date": F.when(late, F.date_add("txn_date", P.LOOKBACK_DAYS + 2)).otherwise(F.col("txn_date")),
            "ref_no": F.when(again, F.coalesce(earlier, F.col("ref_no"))).otherwise(F.col("ref_no")),
        }
    )


@query(f"""SELECT CASE WHEN credit = 0 THEN 'debit' WHEN k < 15 THEN 'unseen' WHEN k < 20 THEN 'adversarial' WHEN k < 25 THEN 'late' WHEN k < 28 THEN 'repeated' ELSE 'plain' END AS kind, count(*) AS n,
sum((CASE WHEN credit > 0 AND k >= 20 AND k < 25 THEN 7 ELSE 0 END))::BIGINT AS days_moved FROM (SELECT *, {_DRAW.format("kind")} AS k FROM bank) GROUP BY 1""")
def shifted_statement(spark, sf_dir):
    """How many lines of the shifted statement are of each kind, and how far they moved."""
    bank = bank_lines(spark, sf_dir)
    x = shift(bank).select("txn_id", "credit", F.col("txn_date").alias("moved")).join(bank.select("txn_id", "txn_date"), "txn_id").withColumn("k", _draw("kind"))
    k = F.col("k")
    kind = F.when(F.col("credit") == 0, "debit").when(k < 15, "unseen").when(k < 20, "adversarial").when(k < 25, "late").when(k < 28, "repeated").otherwise("plain")
    return x.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(F.datediff("moved", "txn_date")).alias("days_moved"))


def well_formed(bank: DataFrame) -> DataFrame:
    """(rule, broken): lines that a statement can't have, counted by rule."""
    rules = {"no narration": F.coalesce(F.trim("narration"), F.lit("")) == "", "no reference": F.coalesce(F.trim("ref_no"), F.lit("")) == "", "both or no side": (F.col("credit") > 0) == (F.col("debit") > 0), "no date": F.col("txn_date").isNull()}
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), v.cast("int").alias("b")) for k, v in rules.items())))
    return bank.select(cells.alias("c")).groupBy("c.rule").agg(F.sum("c.b").alias("broken"))


@query("SELECT unnest(['no narration', 'no reference', 'both or no side', 'no date']) AS rule, unnest([(SELECT count(*) FROM bank WHERE trim(narration) = ''), (SELECT count(*) FROM bank WHERE trim(ref_no) = ''), (SELECT count(*) FROM bank WHERE (credit > 0) = (debit > 0)), (SELECT count(*) FROM bank WHERE txn_date IS NULL)]) AS broken")
def statement_well_formed(spark, sf_dir):
    return well_formed(shift(bank_lines(spark, sf_dir)))


def partial_register(spark: SparkSession, customers: DataFrame, share: int = 60) -> DataFrame:
    """A register that names the third party for a share of the customers, and a near-namesake for some of the others."""
    h = F.conv(F.substring(F.md5(F.col("customer_name").cast("binary")), 1, 6), 16, 10).cast("long") % 100
    x = customers.select("customer_name").distinct().withColumn("h", h)
    real = x.filter(F.col("h") < share).select(F.lit(f"{THIRD_PARTY} PVT LTD").alias("payer_name"), F.col("customer_name").alias("authorised_for_customer"), F.lit("parent").alias("relationship"))
    decoy = x.filter((F.col("h") >= share) & (F.col("h") % 2 == 0)).select(F.lit(THIRD_PARTY.replace("HOLDINGS", "HOLDING CO")).alias("payer_name"), F.col("customer_name").alias("authorised_for_customer"), F.lit("affiliate_decoy").alias("relationship"))
    return real.unionByName(decoy)


@query(f"SELECT relationship, authorised_for_customer FROM (SELECT DISTINCT customer_name AS authorised_for_customer, ('0x' || substr(md5(customer_name), 1, 6))::BIGINT % 100 AS h FROM pay), (VALUES ('parent'), ('affiliate_decoy')) r(relationship) WHERE CASE relationship WHEN 'parent' THEN h < 60 ELSE h >= 60 AND h % 2 = 0 END")
def register_rows(spark, sf_dir):
    """Which of the families the partial register covers, and which it only seems to."""
    return partial_register(spark, payments(spark, sf_dir)).select("relationship", "authorised_for_customer")


