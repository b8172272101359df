"""Registry of queries by operator, and the SQL that gives the same rows."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom import params as P
from ledgerloom.functions import fees, narration
from ledgerloom.operators import matching as M
from ledgerloom.operators import reconcile as R
from ledgerloom.plans import derive
from ledgerloom.plans.sql import MATCH, SIDES, fold
from ledgerloom.plans.storage import checkpoint, once
from ledgerloom.session import together
from ledgerloom.sources import readers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, after: str = ""):
    """Registers a query under its function's name, with the SQL that follows the derived sides (and ``after``)."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = SIDES + after + sql
        return f

    return put


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "payments", lambda: checkpoint(derive.payments(spark, sf_dir)))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "invoices", lambda: checkpoint(derive.invoices(spark, sf_dir)))


def bank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "bank", lambda: checkpoint(derive.bank_lines(payments(spark, sf_dir))))


def _credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "credits", lambda: checkpoint(M.parse(M.credit_lines(bank_lines(spark, sf_dir)))))


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.intervals(payments(spark, sf_dir))


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.candidate_pool(_credits(spark, sf_dir), _intervals(spark, sf_dir))


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every credit's closest payment of its pool."""
    return M.over_pools(_credits(spark, sf_dir), _intervals(spark, sf_dir), M.nearest, "txn_id string, payment_id string, residual long")


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "refs", lambda: checkpoint(M.reference_hits(_credits(spark, sf_dir), _intervals(spark, sf_dir))))


def _fitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "fitting", lambda: checkpoint(M.amount_hits(_credits(spark, sf_dir), _intervals(spark, sf_dir))))


def _u(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "u", lambda: checkpoint(M.chance_agreement(payments(spark, sf_dir), bank_lines(spark, sf_dir))))


def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = lambda: checkpoint(M.cascade(_credits(spark, sf_dir), _intervals(spark, sf_dir), _refs(spark, sf_dir), _fitting(spark, sf_dir)).drop("blocked"))
    return once(spark, sf_dir, "cascade", make)


def match_inputs(spark: SparkSession, sf_dir: str) -> R.Inputs:
    """What every match of a folder's own rows starts from, made once."""

    def make() -> R.Inputs:
        given = [f(spark, sf_dir) for f in (bank_lines, _credits)]
        sizes = lambda: checkpoint(M.pool_sizes(given[1], _intervals(spark, sf_dir)))
        return R.ready(*given, *together(lambda: checkpoint(_intervals(spark, sf_dir)), *(partial(f, spark, sf_dir) for f in (_u, _refs, _fitting)), sizes), checkpoint)

    return once(spark, sf_dir, "inputs", make)


def outcome(spark: SparkSession, sf_dir: str) -> R.Outcome:
    """The whole match of a folder, made once."""
    return once(spark, sf_dir, "outcome", lambda: R.match(match_inputs(spark, sf_dir), checkpoint))


@query("SELECT payment_id, merchant_id, amount, fee, tds, refunded, captured, customer_name, invoice_no, amount - coalesce(fee, 0) AS net FROM pay")
def payment_projection(spark, sf_dir):
    return payments(spark, sf_dir).select(
        "payment_id", "merchant_id", "amount", "fee", "tds", "refunded", "captured", "customer_name", "invoice_no",
        (F.col("amount") - F.coalesce("fee", F.lit(0))).alias("net"),
    )


@query("SELECT txn_id, merchant_id, txn_date, narration, ref_no, credit, debit, CASE WHEN credit > 0 THEN 'credit' ELSE 'debit' END AS direction FROM bank")
def bank_line_projection(spark, sf_dir):
    return bank_lines(spark, sf_dir).select(
        "txn_id", "merchant_id", "txn_date", "narration", "ref_no", "credit", "debit", F.when(F.col("credit") > 0, "credit").otherwise("debit").alias("direction")
    )


@query("SELECT invoice_no, merchant_id, customer_name, gross, tds, gross - tds AS net_receivable FROM inv")
def invoice_projection(spark, sf_dir):
    return invoices(spark, sf_dir).drop("invoice_date")


@query("SELECT txn_id, style, utr, quoted AS merchant_ref, settlement_id, txns, needs_recovery FROM parsed")
def narration_parse(spark, sf_dir):
    raw = M.parse(M.credit_lines(bank_lines(spark, sf_dir)), recover=False)
    return raw.select("txn_id", "style", "utr", "merchant_ref", "settlement_id", "txns", "needs_recovery")


@query("SELECT txn_id, name0 AS found, clean_name AS payer FROM parsed WHERE style <> 'settlement' UNION ALL SELECT txn_id, NULL, NULL FROM parsed WHERE style = 'settlement'")
def narration_name(spark, sf_dir):
    """Names as found, and as kept: those that hold their reference or a long number are withheld."""
    raw = M.parse(M.credit_lines(bank_lines(spark, sf_dir)), recover=False)
    return raw.select("txn_id", narration.payer_name(F.col("narration")).alias("found"), "payer")


@query("SELECT txn_id, recovered_ref, recovered_name FROM parsed WHERE needs_recovery")
def narration_recovery(spark, sf_dir):
    """What the offline tier reads in narrations that the patterns can't."""
    n = F.col("narration")
    return _credits(spark, sf_dir).filter("needs_recovery").select("txn_id", narration.recovered_ref(n).alias("recovered_ref"), narration.recovered_name(n).alias("recovered_name"))


@query("SELECT txn_id, merchant_ref, payer FROM parsed")
def narration_merged(spark, sf_dir):
    """Parsed fields with gaps filled; nothing that was read is overwritten."""
    return _credits(spark, sf_dir).select("txn_id", "merchant_ref", "payer")


@query(f"SELECT customer_name, {fold('customer_name')} AS folded, count(*) AS n FROM pay GROUP BY ALL")
def normalise_name(spark, sf_dir):
    p = payments(spark, sf_dir)
    return p.groupBy("customer_name", narration.normalise_name(F.col("customer_name")).alias("folded")).agg(F.count("*").alias("n"))


@query("SELECT payment_id, lo, hi, certain FROM ivl")
def net_interval(spark, sf_dir):
    return _intervals(spark, sf_dir).select("payment_id", "lo", "hi", "certain")


@query("SELECT payment_id, fee_base AS fee, true_fee - fee_base AS tax FROM pay")
def exact_fee_model(spark, sf_dir):
    base, tax = fees.fee_and_tax(F.col("amount"))
    return payments(spark, sf_dir).select("payment_id", base.alias("fee"), tax.alias("tax"))


@query("SELECT txn_id, sum(lo)::BIGINT AS lo, sum(hi)::BIGINT AS hi, bool_and(certain) AS certain, count(*) AS n FROM pool GROUP BY 1")
def interval_sum(spark, sf_dir):
    return _pool(spark, sf_dir).groupBy("txn_id").agg(
        F.sum("lo").alias("lo"), F.sum("hi").alias("hi"), F.bool_and("certain").alias("certain"), F.count("*").alias("n")
    )


@query("SELECT txn_id, payment_id, residual, abs(residual) <= 100 AS fits FROM pool")
def residual_tolerance_fit(spark, sf_dir):
    return _pool(spark, sf_dir).select("txn_id", "payment_id", "residual", fees.fits(F.col("credit"), F.col("lo"), F.col("hi")).alias("fits"))


@query("SELECT c.txn_id, greatest(2, count(p.payment_id)) AS pool_size FROM credits c LEFT JOIN pool p USING (txn_id) GROUP BY 1")
def candidate_pool_size(spark, sf_dir):
    return M.pool_sizes(_credits(spark, sf_dir), _intervals(spark, sf_dir))


@query("SELECT payment_id, count(*) OVER (PARTITION BY merchant_id ORDER BY pay_date - DATE '1970-01-01' RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS trailing FROM ivl")
def pool_range_window(spark, sf_dir):
    """Payments of a merchant's trailing six days, counted by day first: the window runs over days, not over payments."""
    p = _intervals(spark, sf_dir)
    return p.join(trailing_days(p), ["merchant_id", "pay_date"]).select("payment_id", "trailing")


def trailing_days(pay: DataFrame) -> DataFrame:
    """(merchant_id, pay_date, trailing): payments of each day and the LOOKBACK_DAYS before it."""
    daily = pay.groupBy("merchant_id", "pay_date").agg(F.count("*").alias("n"))
    reach = F.explode(F.sequence(F.col("pay_date"), F.date_add("pay_date", P.LOOKBACK_DAYS)))
    seen = daily.select("merchant_id", reach.alias("pay_date"), "n").groupBy("merchant_id", "pay_date").agg(F.sum("n").alias("trailing"))
    return seen.join(daily.select("merchant_id", "pay_date"), ["merchant_id", "pay_date"])


@query("SELECT merchant_id, max(n) AS worst, max(n) <= 200 AS within_bound FROM (SELECT merchant_id, count(*) OVER (PARTITION BY merchant_id ORDER BY pay_date - DATE '1970-01-01' RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS n FROM ivl) GROUP BY 1")
def pool_density(spark, sf_dir):
    """The fullest pool that a credit of each merchant could meet, against a bound."""
    return trailing_days(_intervals(spark, sf_dir)).groupBy("merchant_id").agg(F.max("trailing").alias("worst"), (F.max("trailing") <= 200).alias("within_bound"))


@query("SELECT * FROM t1")
def tier1_reference(spark, sf_dir):
    return M.tier1(_credits(spark, sf_dir), _intervals(spark, sf_dir)).withColumnsRenamed({"t1_hits": "hits", "t1_payment": "payment_id", "t1_residual": "residual"})


@query("SELECT * FROM t2")
def tier2_amount_date(spark, sf_dir):
    return M.tier2(M.amount_hits(_credits(spark, sf_dir), _intervals(spark, sf_dir))).withColumnsRenamed({"t2_hits": "hits", "t2_payment": "payment_id", "t2_residual": "residual"})


@query("SELECT txn_id, merchant_id, credit, txns, verdict, tier, payment_id, residual FROM cascade")
def tier12_cascade(spark, sf_dir):
    return _cascade(spark, sf_dir)


@query("SELECT txn_id, txns, verdict, txns IS NOT NULL AND txns <> 1 AND verdict = 'open' AS count_conflict FROM cascade")
def narration_count(spark, sf_dir):
    conflict = F.col("txns").isNotNull() & (F.col("txns") != 1) & (F.col("verdict") == "open")
    return _cascade(spark, sf_dir).select("txn_id", "txns", "verdict", conflict.alias("count_conflict"))


@query("""SELECT c.txn_id, count(*) AS pairs FROM cascade c JOIN pool a USING (txn_id) JOIN pool b USING (txn_id)
WHERE c.verdict = 'open' AND a.payment_id < b.payment_id AND greatest(a.lo + b.lo - c.credit, c.credit - a.hi - b.hi, 0) <= 100 GROUP BY 1""")
def subset_sum_pairs(spark, sf_dir):
    """Subsets of two, level-wise: what the bounded search finds at depth two."""
    open_ = _credits(spark, sf_dir).join(_cascade(spark, sf_dir).filter("verdict = 'open'").select("txn_id"), "txn_id", "left_semi")
    return M.over_pools(open_, _intervals(spark, sf_dir), M.fitting_pairs, "txn_id string, pairs long").filter("pairs > 0")


@query("""SELECT z.txn_id, z.verdict, coalesce(n.n, 0) AS pool_size, CASE WHEN n.n <= 20 THEN coalesce(s.n, 0) END AS solutions, CASE WHEN z.verdict = 'assign' THEN array_to_string(z.ids, ',') END AS payment_ids,
CASE WHEN z.verdict = 'assign' THEN z.residual END AS residual FROM (SELECT * REPLACE (CASE WHEN verdict = 'narration_count_conflict' AND tier = '' THEN 'no_candidate' ELSE verdict END AS verdict) FROM z1) z
SEMI JOIN (SELECT txn_id FROM y1 WHERE verdict = 'open') o USING (txn_id) LEFT JOIN n1 n USING (txn_id) LEFT JOIN (SELECT txn_id, least(n, 8) AS n FROM sum1) s USING (txn_id)""", MATCH)
def subset_sum_full(spark, sf_dir):
    """Every subset of up to six of a pool, for the credits that the cheaper tiers leave open."""
    open_ = _credits(spark, sf_dir).join(_cascade(spark, sf_dir).filter("verdict = 'open'").select("txn_id"), "txn_id", "left_semi")
    open_ = checkpoint(open_)
    return M.open_search(open_, _intervals(spark, sf_dir)).drop("margin")


@query("SELECT * FROM verdicts", MATCH)
def match_fixpoint(spark, sf_dir):
    """One verdict for every credit: rounds, veto, evidence-ranked contests, count conflicts and groups."""
    return outcome(spark, sf_dir).verdicts.drop("margin").withColumn("weight", F.round("weight", 6))


@query("SELECT * FROM u", MATCH)
def u_estimates(spark, sf_dir):
    """Chance agreement of names, first words, references and dates of each merchant."""
    return M.chance_agreement(payments(spark, sf_dir), bank_lines(spark, sf_dir))


@query("""SELECT txn_id, payment_id, count(*) OVER (PARTITION BY payment_id) AS claims, (count(*) OVER (PARTITION BY payment_id) = 1
 OR (strength = max(strength) OVER (PARTITION BY payment_id) AND count(*) OVER (PARTITION BY payment_id, strength) = 1)) AS granted
FROM (SELECT txn_id, payment_id, CASE WHEN tier = 'tier1_reference' THEN 3 ELSE 2 END AS strength FROM cascade WHERE verdict = 'assign')""")
def contest_resolution(spark, sf_dir):
    x = _cascade(spark, sf_dir).filter("verdict = 'assign'")
    s = x.select("txn_id", F.col("payment_id").alias("payment_ids"), F.when(F.col("tier") == "tier1_reference", 3).otherwise(2).alias("strength"))
    return M.resolve_contests(s).join(x.select("txn_id", "payment_id"), "txn_id").select("txn_id", "payment_id", F.col("rivals").alias("claims"), "granted")


@query("SELECT * FROM debit_class", MATCH)
def debit_classification(spark, sf_dir):
    """Whole and partial claw-backs of what was posted, ties to refusals, other statements, and debits that name nothing."""
    return outcome(spark, sf_dir).debits


@query("SELECT payment_id, amount FROM ivl WHERE payment_id NOT IN (SELECT unnest(ids) FROM posted)", MATCH)
def unassigned_after_match(spark, sf_dir):
    return outcome(spark, sf_dir).unassigned


@query("SELECT payment_id, amount FROM ivl WHERE payment_id NOT IN (SELECT payment_id FROM cascade WHERE payment_id IS NOT NULL)")
def unassigned_payments(spark, sf_dir):
    used = _cascade(spark, sf_dir).filter("payment_id is not null").select("payment_id")
    return _intervals(spark, sf_dir).join(used, "payment_id", "left_anti").select("payment_id", "amount")


@query("SELECT payment_id, count(*) AS n FROM (SELECT txn_id, arg_min(payment_id, (abs(residual), payment_id)) AS payment_id FROM pool GROUP BY 1) GROUP BY 1 HAVING count(*) > 1")
def double_posted(spark, sf_dir):
    """Payments that a matcher which never refuses posts to several credits."""
    return _nearest(spark, sf_dir).groupBy("payment_id").agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT verdict AS category, count(*) AS n, sum(credit)::BIGINT AS at_risk FROM cascade WHERE verdict <> 'assign' GROUP BY 1")
def exceptions_by_category(spark, sf_dir):
    return _cascade(spark, sf_dir).filter("verdict <> 'assign'").groupBy(F.col("verdict").alias("category")).agg(F.count("*").alias("n"), F.sum("credit").alias("at_risk"))


@query("SELECT count(*) AS n, sum((verdict = 'assign')::INT)::BIGINT AS assigned, round(avg((verdict = 'assign')::INT), 6) AS match_rate, sum((verdict NOT IN ('assign', 'open'))::INT)::BIGINT AS refused FROM cascade")
def headline_metrics(spark, sf_dir):
    a, r = (F.col("verdict") == "assign").cast("int"), (~F.col("verdict").isin("assign", "open")).cast("int")
    return _cascade(spark, sf_dir).agg(F.count("*").alias("n"), F.sum(a).alias("assigned"), F.round(F.avg(a), 6).alias("match_rate"), F.sum(r).alias("refused"))


@query("""SELECT txn_id, sum(credit - debit) OVER (PARTITION BY merchant_id ORDER BY txn_date, txn_id ROWS UNBOUNDED PRECEDING)::BIGINT + 5000000 AS balance FROM bank""")
def running_balance(spark, sf_dir):
    """Balances by merchant: totals of months first, so no window is larger than a merchant's month."""
    return statement_balances(bank_lines(spark, sf_dir)).select("txn_id", "balance")


def statement_balances(bank: DataFrame, opening: int = 5_000_000) -> DataFrame:
    """Lines with ``balance`` and ``line_no`` in the order (txn_date, txn_id) of their merchant.

    Two levels: the totals and counts of each merchant's months add up over the
    few months; within a month a window adds the lines.
    """
    x = bank.withColumn("month", R.month_of(F.col("txn_date"))).withColumn("move", F.col("credit") - F.col("debit"))
    before = Window.partitionBy("merchant_id").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    months = x.groupBy("merchant_id", "month").agg(F.sum("move").alias("total"), F.count("*").alias("n"))
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    months = months.select("merchant_id", "month", zero("total").alias("carried"), zero("n").alias("lines_before"))
    w = Window.partitionBy("merchant_id", "month").orderBy("txn_date", "txn_id")
    run = F.sum("move").over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumns({"run": run, "place": F.row_number().over(w)}).join(months, ["merchant_id", "month"])
    out = x.withColumns({"balance": F.col("carried") + F.col("run") + opening, "line_no": F.col("lines_before") + F.col("place")})
    return out.drop("month", "move", "carried", "lines_before", "run", "place")


_GIVEN = """, given AS (SELECT txn_id, merchant_id, credit, debit, row_number() OVER w AS line_no,
  sum(credit - debit) OVER (PARTITION BY merchant_id ORDER BY txn_date, txn_id ROWS UNBOUNDED PRECEDING)::BIGINT + 5000000 + CASE WHEN key % 97 = 0 THEN 700 ELSE 0 END AS balance
  FROM bank WINDOW w AS (PARTITION BY merchant_id ORDER BY txn_date, txn_id)) """


@query(_GIVEN + "SELECT txn_id, line_no, expected, balance FROM (SELECT *, lag(balance) OVER (PARTITION BY merchant_id ORDER BY line_no) + credit - debit AS expected FROM given) WHERE expected IS NOT NULL AND expected <> balance")
def balance_continuity(spark, sf_dir):
    """Lines of a statement whose given balance doesn't follow from the one before; some balances are off by design."""
    given = statement_balances(bank_lines(spark, sf_dir)).withColumn("balance", F.col("balance") + F.when(F.col("key") % 97 == 0, 700).otherwise(0))
    return readers.balance_breaks(given, "merchant_id", "line_no").select("txn_id", "line_no", "expected", "balance")


@query("SELECT 'bank_txn_' || lpad(row_number() OVER (PARTITION BY merchant_id ORDER BY txn_date, txn_id)::VARCHAR, 4, '0') AS id, merchant_id, txn_id FROM bank")
def renumbered_lines(spark, sf_dir):
    """Ids by position after sorting by date."""
    n = F.col("line_no").cast("string")
    number = F.concat(F.lit("bank_txn_"), F.when(F.length(n) < 4, F.lpad(n, 4, "0")).otherwise(n))
    return statement_balances(bank_lines(spark, sf_dir)).select(number.alias("id"), "merchant_id", "txn_id")


@query("SELECT payment_id, amount // 100 || '.' || lpad((amount % 100)::VARCHAR, 2, '0') AS text, amount AS parsed FROM pay")
def money_parse(spark, sf_dir):
    t = fees.rupees(F.col("amount"))
    return payments(spark, sf_dir).select("payment_id", t.alias("text"), readers.money(t).alias("parsed"))


@query("""SELECT invoice_no, unnest(list_filter([CASE WHEN n > 1 THEN 'repeated invoice_no' END, CASE WHEN gross < 0 THEN 'bad gross' END], lambda e: e IS NOT NULL)) AS error
FROM (SELECT invoice_no, CASE WHEN key % 211 = 0 THEN -amount ELSE amount END AS gross, count(*) OVER (PARTITION BY invoice_no) AS n FROM pay WHERE invoice_no IS NOT NULL)""")
def invoice_validation(spark, sf_dir):
    """A ledger with a line for each payment: shared invoices repeat, and some amounts are negative."""
    gross = F.when(F.col("key") % 211 == 0, -F.col("amount")).otherwise(F.col("amount"))
    ledger = payments(spark, sf_dir).filter("invoice_no is not null").select("invoice_no", gross.alias("gross"), "tds", F.col("pay_date").alias("invoice_date"))
    return readers.ledger_errors(ledger)


from ledgerloom.plans import reports, verify, evidence, generate  # noqa: E402, F401, I001  (register their queries)
