"""Queries that weigh, score against truth, verify and audit the whole match."""

from __future__ import annotations

import math
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import params as P
from ledgerloom.functions import fees, narration
from ledgerloom.operators import groups as G
from ledgerloom.operators import matching as M
from ledgerloom.operators import reconcile as R
from ledgerloom.plans import derive
from ledgerloom.plans.catalog import _cascade, _credits, _intervals, _u, bank_lines, match_inputs, outcome, payments, query
from ledgerloom.plans.sql import CHANCE, MATCH, THIRD_PARTY, evidence_sql, search_sql
from ledgerloom.plans.storage import checkpoint, once
from ledgerloom.session import together

SETTLED = "verdict IN ('assign', 'grouped')"
_CAND = CHANCE + ", cand AS MATERIALIZED (SELECT txn_id, [payment_id] AS ids FROM cascade WHERE verdict = 'assign')" + evidence_sql("cand", "ev")


# Probabilistic linkage and confidence


def _sizes(spark, sf_dir) -> DataFrame:
    return M.pool_sizes(_credits(spark, sf_dir), _intervals(spark, sf_dir))


@query(_CAND + """ SELECT txn_id, name_level, ref_level, round(field_weight, 6) AS field_weight, round(weight, 6) AS weight, (coalesce(name_level = 0, false) OR coalesce(ref_level = 0, false)) AND field_weight < 0 AS contradicts,
CASE WHEN weight IS NULL THEN 'no_evidence' WHEN weight >= 7 THEN 'match' WHEN weight >= 4 THEN 'review' ELSE 'non_match' END AS band, round(1 / (1 + pow(2.0, -weight)), 6) AS probability
FROM (SELECT *, CASE WHEN NOT nothing THEN -log2(pool_size - 1) + field_weight END AS weight FROM ev)""")
def fs_evidence(spark, sf_dir):
    """Names and references of every single match as log2 weights against chance, with the prior of its pool."""
    x = _cascade(spark, sf_dir).filter("verdict = 'assign'").select("txn_id", F.col("payment_id").alias("payment_ids"))
    w = M.evidence(x, M.with_facts(_credits(spark, sf_dir)), _intervals(spark, sf_dir), _u(spark, sf_dir), _sizes(spark, sf_dir))
    weight = F.col("weight")
    return w.select(
        "txn_id", "name_level", "ref_level", F.round("field_weight", 6).alias("field_weight"), F.round(weight, 6).alias("weight"), "contradicts",
        M.evidence_band(weight).alias("band"), F.round(M.evidence_probability(weight), 6).alias("probability"),
    )


@query("SELECT c.txn_id, c.txn_date - p.pay_date AS lag, CASE WHEN c.txn_date - p.pay_date BETWEEN 0 AND 5 THEN 2 ELSE 0 END AS date_level FROM cascade v JOIN credits c USING (txn_id) JOIN ivl p USING (payment_id) WHERE v.verdict = 'assign'")
def fs_date_level(spark, sf_dir):
    """The date comparison; it is defined, and takes no part in the weight, since dates chose the pool."""
    x = _cascade(spark, sf_dir).filter("verdict = 'assign'").select("txn_id", "payment_id").join(_credits(spark, sf_dir).select("txn_id", "txn_date"), "txn_id")
    lag = F.datediff("txn_date", "pay_date")
    level = F.when(lag.between(0, P.LOOKBACK_DAYS), 2).otherwise(0)
    return x.join(_intervals(spark, sf_dir).select("payment_id", "pay_date"), "payment_id").select("txn_id", lag.cast("long").alias("lag"), level.alias("date_level"))


@query("SELECT credit_weight AS weight, round(CASE WHEN credit_weight IS NULL THEN 0.5 WHEN credit_weight >= 7 THEN 1.0 WHEN credit_weight >= 4 THEN least(0.6, 0.5 + 0.1 * (credit_weight - 4) / 3) ELSE greatest(0.0, least(0.5, credit_weight / 8)) END, 6) AS scaled FROM (SELECT DISTINCT weight AS credit_weight FROM verdicts)", MATCH)
def confidence_scale(spark, sf_dir):
    """Every weight that the match came to, on the scale of the confidence: all four branches."""
    w = outcome(spark, sf_dir).verdicts.select(F.round("weight", 6).alias("weight")).distinct()
    return w.select("weight", F.round(M.scaled_weight(F.col("weight")), 6).alias("scaled"))


_SINGLE = """ single AS (SELECT v.txn_id, v.weight, v.payment_ids, v.tier, v.credit, greatest(0, 1 - abs(v.residual) / 100.0) * CASE WHEN p.certain THEN 1 ELSE 1 - 0.5 * least(1.0, (p.hi - p.lo) / 200.0) END AS tight
  FROM verdicts v JOIN ivl p ON p.payment_id = v.payment_ids WHERE v.verdict = 'assign' AND v.tier IN ('tier1_reference', 'tier2_amount_date')),
conf AS (SELECT *, 1 / (1 + exp(-(3.0 * tight + 2.0 + 1.5 * (CASE WHEN weight IS NULL THEN 0.5 WHEN weight >= 7 THEN 1.0 WHEN weight >= 4 THEN least(0.6, 0.5 + 0.1 * (weight - 4) / 3) ELSE greatest(0.0, least(0.5, weight / 8)) END) - 2.5))) AS confidence FROM single)"""


def _confident(spark, sf_dir) -> DataFrame:
    """Single assignments of the first two tiers with their confidence; their uniqueness is 1."""
    v = outcome(spark, sf_dir).verdicts.filter("verdict = 'assign' and tier in ('tier1_reference', 'tier2_amount_date')")
    x = v.join(_intervals(spark, sf_dir).select(F.col("payment_id").alias("payment_ids"), "lo", "hi", "certain"), "payment_ids")
    tight = fees.tightness(F.col("residual"), F.col("hi") - F.col("lo"), F.col("certain"))
    return x.withColumn("confidence", M.confidence(F.round("weight", 6), F.lit(1.0), tight, F.lit(1.0)))


@query("," + _SINGLE + " SELECT txn_id, round(confidence, 6) AS confidence FROM conf", MATCH)
def confidence_score(spark, sf_dir):
    return _confident(spark, sf_dir).select("txn_id", F.round("confidence", 6).alias("confidence"))


# Scoring against truth

_TRUTH = f""", truth0 AS (SELECT merchant_id, w, chunk, min(key) AS key, count(*) AS n, array_to_string(list_sort(list(payment_id)), ',') AS payment_ids, count(DISTINCT invoice_no) AS invs, count(invoice_no) AS with_inv,
    arg_min(coalesce(invoice_no, ''), key) AS inv, max((refunded > 0)::INT) AS refunded, max((fee IS NULL)::INT) AS hidden FROM chunked GROUP BY 1, 2, 3),
truth1 AS (SELECT *, n = 1 AND key % 59 = 0 AS split FROM truth0),
truth AS MATERIALIZED (SELECT 'bt_' || lpad(key::VARCHAR, 9, '0') || part AS txn_id, payment_ids, CASE WHEN split THEN 'split' WHEN n = 1 THEN 'one_to_one' ELSE 'many_to_one' END AS relation,
    list_filter([CASE WHEN n = 1 AND key % 53 = 0 AND NOT split THEN 'third_party_payer' END, CASE WHEN split THEN 'split_settlement' END, CASE WHEN n > 1 AND key % 61 = 0 THEN 'wrong_count' END,
      CASE WHEN n = 1 AND NOT split AND key % 31 = 0 AND inv <> '' THEN 'garbled_narration' END, CASE WHEN invs < with_inv THEN 'shared_invoice' END, CASE WHEN refunded = 1 THEN 'netted_refund' END,
      CASE WHEN hidden = 1 THEN 'unknown_fee' END, CASE WHEN n = 1 AND inv = '' THEN 'advance' END], lambda v: v IS NOT NULL) AS labels,
    CASE WHEN (n = 1 AND key % 53 = 0 AND NOT split) OR (n > 1 AND key % 61 = 0) THEN 'refuse' ELSE 'assign' END AS expected
  FROM truth1, (VALUES ('', false), ('a', true), ('b', true)) x(part, is_split) WHERE split = is_split),
scored AS MATERIALIZED (SELECT t.*, v.credit, v.verdict, v.tier, v.{SETTLED} AS settled, v.{SETTLED} AND v.payment_ids = t.payment_ids AS correct FROM truth t JOIN verdicts v USING (txn_id)) """
_SCORE = MATCH + _TRUTH


def scored(spark, sf_dir) -> DataFrame:
    """Every credit with its truth: settled, and whether the set of payments is exactly the right one."""

    def make() -> DataFrame:
        t = derive.truth(payments(spark, sf_dir))
        v = outcome(spark, sf_dir).verdicts.select("txn_id", "credit", "verdict", "tier", F.col("payment_ids").alias("got"))
        settled = F.col("verdict").isin("assign", "grouped")
        same = F.array_sort(F.split("got", ",")) == F.split("payment_ids", ",")
        return checkpoint(t.join(v, "txn_id").withColumns({"settled": settled, "correct": settled & F.coalesce(same, F.lit(False))}).drop("got"))

    return once(spark, sf_dir, "scored", make)


def _n(condition: Column) -> Column:
    return F.sum(F.coalesce(condition, F.lit(False)).cast("long"))


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)


@query("SELECT tier, count(*) AS n, sum(correct::INT)::BIGINT AS correct, round(avg(correct::INT), 6) AS precision FROM scored WHERE settled GROUP BY 1", _SCORE)
def precision_by_tier(spark, sf_dir):
    """All assignments of a tier, right or wrong, against the exact set of payments."""
    x = scored(spark, sf_dir).filter("settled").groupBy("tier")
    return x.agg(F.count("*").alias("n"), _n(F.col("correct")).alias("correct"), _ratio(_n(F.col("correct")), F.count("*")).alias("precision"))


@query("SELECT relation, count(*) AS n, sum(correct::INT)::BIGINT AS correct, round(avg(correct::INT), 6) AS recall FROM scored WHERE expected = 'assign' GROUP BY 1", _SCORE)
def recall_by_relation(spark, sf_dir):
    x = scored(spark, sf_dir).filter("expected = 'assign'").groupBy("relation")
    return x.agg(F.count("*").alias("n"), _n(F.col("correct")).alias("correct"), _ratio(_n(F.col("correct")), F.count("*")).alias("recall"))


@query("""SELECT label, sum((settled AND correct)::INT)::BIGINT AS matched, sum((settled AND NOT correct)::INT)::BIGINT AS wrong, sum((NOT settled AND verdict <> 'no_candidate')::INT)::BIGINT AS refused,
sum((verdict = 'no_candidate')::INT)::BIGINT AS silent, sum(CASE WHEN expected = 'assign' AND NOT correct THEN credit ELSE 0 END)::BIGINT AS shortfall FROM (SELECT *, unnest(labels) AS label FROM scored) GROUP BY 1""", _SCORE)
def outcome_by_defect(spark, sf_dir):
    """What became of the credits of each planted defect, and the money still to be matched there."""
    x = scored(spark, sf_dir).withColumn("label", F.explode("labels"))
    short = F.when((F.col("expected") == "assign") & ~F.col("correct"), F.col("credit")).otherwise(0)
    return x.groupBy("label").agg(
        _n(F.col("settled") & F.col("correct")).alias("matched"), _n(F.col("settled") & ~F.col("correct")).alias("wrong"),
        _n(~F.col("settled") & (F.col("verdict") != "no_candidate")).alias("refused"), _n(F.col("verdict") == "no_candidate").alias("silent"), F.sum(short).alias("shortfall"),
    )


@query("""SELECT count(*) AS credits, sum(settled::INT)::BIGINT AS settled, round(avg(settled::INT), 6) AS match_rate, round(sum(correct::INT) / sum(settled::INT), 6) AS precision,
round(avg((NOT settled AND verdict <> 'no_candidate')::INT), 6) AS refusal_rate, round(sum((NOT settled AND verdict <> 'no_candidate' AND expected = 'refuse')::INT) / sum((NOT settled AND verdict <> 'no_candidate')::INT), 6) AS refusal_correctness,
round(avg((expected = 'assign')::INT), 6) AS ceiling, (sum((expected = 'assign')::INT) - sum(correct::INT))::BIGINT AS shortfall FROM scored""", _SCORE)
def scorecard(spark, sf_dir):
    """Headline figures: match rate, precision, refusals and how right they are, the reachable ceiling and what lacks to it."""
    refused = ~F.col("settled") & (F.col("verdict") != "no_candidate")
    right, all_ = F.col("expected") == "assign", F.count("*")
    return scored(spark, sf_dir).agg(
        all_.alias("credits"), _n(F.col("settled")).alias("settled"), _ratio(_n(F.col("settled")), all_).alias("match_rate"), _ratio(_n(F.col("correct")), _n(F.col("settled"))).alias("precision"),
        _ratio(_n(refused), all_).alias("refusal_rate"), _ratio(_n(refused & ~right), _n(refused)).alias("refusal_correctness"), _ratio(_n(right), all_).alias("ceiling"),
        (_n(right) - _n(F.col("correct"))).alias("shortfall"),
    )


@query("," + _SINGLE + "SELECT least(9, floor(confidence * 10))::INT AS decile, round((least(9, floor(confidence * 10)) + 0.5) / 10, 2) AS midpoint, count(*) AS n, round(avg(correct::INT), 6) AS accuracy FROM conf JOIN scored USING (txn_id) GROUP BY 1, 2", _SCORE)
def confidence_deciles(spark, sf_dir):
    x = _confident(spark, sf_dir).select("txn_id", "confidence").join(scored(spark, sf_dir).select("txn_id", "correct"), "txn_id")
    decile = F.least(F.lit(9), F.floor(F.col("confidence") * 10).cast("int"))
    return x.groupBy(decile.alias("decile"), F.round((decile + 0.5) / 10, 2).alias("midpoint")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"))


@query("," + _SINGLE + "SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece, count(*) AS bins FROM (SELECT least(9, floor(confidence * 10)) AS d, count(*) AS n, avg(correct::INT) AS a, avg(confidence) AS c FROM conf JOIN scored USING (txn_id) GROUP BY 1)", _SCORE)
def calibration_error(spark, sf_dir):
    x = _confident(spark, sf_dir).select("txn_id", "confidence").join(scored(spark, sf_dir).select("txn_id", "correct"), "txn_id")
    bins = x.groupBy(F.least(F.lit(9), F.floor(F.col("confidence") * 10))).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("int")).alias("a"), F.avg("confidence").alias("c"))
    return bins.agg(F.round(F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n"), 6).alias("ece"), F.count("*").alias("bins"))


def clopper_pearson_lower(right: int, n: int, alpha: float = 0.05, steps: int = 200) -> float:
    """Exact lower bound of a share: the p at which ``right`` or more of ``n`` have probability alpha / 2."""
    if not right:
        return 0.0
    if right == n:
        return (alpha / 2) ** (1 / n)
    log_ways = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(right, n + 1)]
    lo, hi = 0.0, 1.0
    for _ in range(steps):
        p = (lo + hi) / 2
        tail = sum(math.exp(w + i * math.log(p) + (n - i) * math.log1p(-p)) for i, w in enumerate(log_ways, right)) if 0 < p < 1 else float(p >= 1)
        lo, hi = (p, hi) if tail < alpha / 2 else (lo, p)
    return (lo + hi) / 2


@query("""SELECT tier, correct, n, round(CASE WHEN correct = n THEN pow(0.025, 1.0 / n) ELSE lo END, 6) AS lower FROM (WITH RECURSIVE cells AS (SELECT tier, count(*) AS n, sum(correct::INT)::BIGINT AS correct FROM scored WHERE settled GROUP BY 1),
steps AS (SELECT tier, n, correct, 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM cells
  UNION ALL SELECT tier, n, correct, i + 1, CASE WHEN tail < 0.025 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN tail < 0.025 THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT *, list_sum(list_transform(range(correct, n + 1), lambda k: exp(lgamma(n + 1) - CASE WHEN k = 0 THEN 0 ELSE lgamma(k + 1) END - CASE WHEN k = n THEN 0 ELSE lgamma(n - k + 1) END + k * ln((lo + hi) / 2) + (n - k) * ln(1 - (lo + hi) / 2)))) AS tail FROM steps WHERE i < 45))
SELECT * FROM steps WHERE i = 45)""", _SCORE)
def precision_bounds(spark, sf_dir):
    """Exact lower 95 % bound of each tier's precision; four rows at any size, so the search runs on the driver."""
    rows = [(r["tier"], r["correct"], r["n"], round(clopper_pearson_lower(r["correct"], r["n"], steps=60), 6)) for r in precision_by_tier(spark, sf_dir).collect()]
    return spark.createDataFrame(rows, "tier string, correct long, n long, lower double")


_DRAW = f"substr(md5('991' || txn_id), 1, 8) < '{int(P.SAMPLED_SHARE * 2**32):08x}'"


def _strata(spark, sf_dir) -> DataFrame:
    """Settled credits with their stratum, whether they are drawn for inspection, and whether that finds them wrong."""
    large = F.col("credit") >= P.MATERIALITY
    drawn = F.substring(F.md5(F.concat(F.lit("991"), F.col("txn_id")).cast("binary")), 1, 8) < f"{int(P.SAMPLED_SHARE * 2**32):08x}"
    x = scored(spark, sf_dir).filter("settled")
    return x.select("txn_id", "credit", "correct", F.when(large, "above_materiality").otherwise("below_materiality").alias("stratum"), (large | drawn).alias("drawn"))


_STRATA = f"strata AS (SELECT txn_id, credit, correct, CASE WHEN credit >= {P.MATERIALITY} THEN 'above_materiality' ELSE 'below_materiality' END AS stratum, credit >= {P.MATERIALITY} OR {_DRAW} AS drawn FROM scored WHERE settled) "


@query("," + _STRATA + "SELECT stratum, count(*) AS n, sum(credit)::BIGINT AS total, sum(drawn::INT)::BIGINT AS sampled, sum(CASE WHEN drawn THEN credit ELSE 0 END)::BIGINT AS sampled_total, round(sum(CASE WHEN drawn THEN credit ELSE 0 END) / sum(credit), 6) AS coverage FROM strata GROUP BY 1", _SCORE)
def materiality_strata(spark, sf_dir):
    seen = F.sum(F.when(F.col("drawn"), F.col("credit")).otherwise(0))
    return _strata(spark, sf_dir).groupBy("stratum").agg(
        F.count("*").alias("n"), F.sum("credit").alias("total"), _n(F.col("drawn")).alias("sampled"), seen.alias("sampled_total"), _ratio(seen, F.sum("credit")).alias("coverage")
    )


@query("," + _STRATA + """SELECT stratum, wrong, CASE WHEN sampled = n THEN bad WHEN wrong = 0 THEN 0 ELSE floor(bad * (total / sampled_total)) END::BIGINT AS projected,
CASE WHEN sampled = n THEN bad WHEN wrong = 0 THEN floor(3.0 / sampled * total) ELSE floor(floor(bad * (total / sampled_total)) + 1.645 * sqrt(wrong / sampled * (1 - wrong / sampled) / sampled) * total) END::BIGINT AS upper_bound
FROM (SELECT stratum, count(*)::DOUBLE AS n, sum(credit)::DOUBLE AS total, sum(drawn::INT)::DOUBLE AS sampled, sum(CASE WHEN drawn THEN credit ELSE 0 END)::DOUBLE AS sampled_total, sum((drawn AND NOT correct)::INT)::DOUBLE AS wrong,
  sum(CASE WHEN drawn AND NOT correct THEN credit ELSE 0 END)::DOUBLE AS bad FROM strata GROUP BY 1)""", _SCORE)
def materiality_projection(spark, sf_dir):
    """Errors of the drawn items carried to their stratum: what was seen in full, the rule of three, or a mean with its allowance."""
    d = lambda c: c.cast("double")
    drawn, bad_ = F.col("drawn"), F.col("drawn") & ~F.col("correct")
    x = _strata(spark, sf_dir).groupBy("stratum").agg(
        d(F.count("*")).alias("n"), d(F.sum("credit")).alias("total"), d(_n(drawn)).alias("sampled"), d(F.sum(F.when(drawn, F.col("credit")).otherwise(0))).alias("sampled_total"),
        d(_n(bad_)).alias("wrong"), d(F.sum(F.when(bad_, F.col("credit")).otherwise(0))).alias("bad"),
    )
    whole, none, rate = F.col("sampled") == F.col("n"), F.col("wrong") == 0, F.try_divide(F.col("wrong"), F.col("sampled"))
    mean = F.floor(F.col("bad") * F.try_divide(F.col("total"), F.col("sampled_total")))
    allowance = 1.645 * F.sqrt(rate * (1 - rate) / F.col("sampled")) * F.col("total")
    projected = F.when(whole, F.col("bad")).when(none, 0.0).otherwise(mean)
    upper = F.when(whole, F.col("bad")).when(none, F.floor(3.0 / F.col("sampled") * F.col("total"))).otherwise(F.floor(mean + allowance))
    return x.select("stratum", F.col("wrong"), projected.cast("long").alias("projected"), upper.cast("long").alias("upper_bound"))


# Verification


@query(f"""SELECT v.txn_id AS settlement, v.residual AS stored, CASE WHEN v.credit < sum(p.lo) + x.back THEN v.credit - sum(p.lo) - x.back WHEN v.credit > sum(p.hi) + x.back THEN v.credit - sum(p.hi) - x.back ELSE 0 END AS recomputed
FROM verdicts v, unnest(string_split(v.payment_ids, ',')) AS q(payment_id), ivl p, (SELECT 0 AS back) x WHERE v.verdict = 'assign' AND p.payment_id = q.payment_id GROUP BY v.txn_id, v.residual, v.credit, x.back
UNION ALL SELECT g.txn_ids, NULL, CASE WHEN g.credit < sum(p.lo) THEN g.credit - sum(p.lo) WHEN g.credit > sum(p.hi) THEN g.credit - sum(p.hi) ELSE 0 END
FROM grp g, unnest(string_split(g.payment_ids, ',')) AS q(payment_id), ivl p WHERE g.outcome = 'granted' AND p.payment_id = q.payment_id GROUP BY g.txn_ids, g.credit""", MATCH)
def mr4_conservation(spark, sf_dir):
    """Residuals of settlements and groups computed again from payments, beside those that were stored."""
    out = outcome(spark, sf_dir)
    own = out.verdicts.filter("verdict = 'assign'").select(F.col("txn_id").alias("settlement"), "credit", "payment_ids", F.col("residual").alias("stored"))
    both = own.unionByName(out.groups.filter("outcome = 'granted'").select(F.col("txn_ids").alias("settlement"), "credit", "payment_ids", F.lit(None).cast("long").alias("stored")))
    x = both.withColumn("payment_id", F.explode(F.split("payment_ids", ","))).join(_intervals(spark, sf_dir).select("payment_id", "lo", "hi"), "payment_id")
    sums = x.groupBy("settlement", "credit", "stored").agg(F.sum("lo").alias("lo"), F.sum("hi").alias("hi"))
    return sums.select("settlement", "stored", fees.residual(F.col("credit"), F.col("lo"), F.col("hi")).alias("recomputed"))


@query(f"""SELECT 'credits' AS side, (SELECT count(*) FROM credits) AS given, count(*) AS accounted, count(DISTINCT txn_id) AS different FROM verdicts
UNION ALL SELECT 'debits', (SELECT count(*) FROM debits), count(*), count(DISTINCT debit_id) FROM debit_class
UNION ALL SELECT 'payments', (SELECT count(*) FROM ivl), count(*), count(DISTINCT payment_id) FROM (SELECT DISTINCT payment_ids, unnest(string_split(payment_ids, ',')) AS payment_id FROM verdicts WHERE {SETTLED} UNION ALL SELECT '', payment_id FROM ivl WHERE payment_id NOT IN (SELECT unnest(ids) FROM posted))
UNION ALL SELECT 'reversals', (SELECT count(*) FROM debit_class WHERE credit_id IS NOT NULL), count(*), count(DISTINCT d.debit_id) FROM debit_class d JOIN posted p ON p.txn_id = d.credit_id""", MATCH)
def mr5_closure(spark, sf_dir):
    """Every credit, debit and captured payment is accounted for once, and claw-backs only of what was posted."""
    out, bank = outcome(spark, sf_dir), bank_lines(spark, sf_dir)
    settled = out.verdicts.filter(SETTLED)
    used = settled.select("payment_ids").distinct().select(F.explode(F.split("payment_ids", ",")).alias("id")).unionByName(out.unassigned.select(F.col("payment_id").alias("id")))
    back = out.debits.filter("credit_id is not null")
    parts = (
        ("credits", M.credit_lines(bank), out.verdicts.select(F.col("txn_id").alias("id"))), ("debits", M.debit_lines(bank), out.debits.select(F.col("debit_id").alias("id"))),
        ("payments", _intervals(spark, sf_dir), used), ("reversals", back, back.join(settled.select(F.col("txn_id").alias("credit_id")), "credit_id", "left_semi").select(F.col("debit_id").alias("id"))),
    )

    def row(side: str, given: DataFrame, found: DataFrame) -> DataFrame:
        n = found.agg(F.count("*").alias("accounted"), F.countDistinct("id").alias("different"))
        return given.agg(F.count("*").alias("given")).join(n, F.lit(True)).select(F.lit(side).alias("side"), "given", "accounted", "different")

    return reduce(DataFrame.unionByName, (row(*p) for p in parts))


def _rerun(spark, sf_dir, name: str, bank: DataFrame, pay: DataFrame, parsed: DataFrame) -> R.Outcome:
    """A match of changed rows; what their narrations say is the same, line by line, so it comes with them (``parsed``)."""
    return once(spark, sf_dir, name, lambda: R.reconcile(bank, pay, checkpoint, parsed=parsed))


_PLAIN = "SELECT txn_id, verdict, payment_ids FROM verdicts"


@query(_PLAIN, MATCH)
def mr1_permuted(spark, sf_dir):
    """The match over rows in another order and other partitions: the same verdicts."""
    seed = 991
    out = _rerun(spark, sf_dir, "mr1", R.shuffled(bank_lines(spark, sf_dir), "txn_id", seed), R.shuffled(payments(spark, sf_dir), "payment_id", seed), R.shuffled(_credits(spark, sf_dir), "txn_id", seed))
    return out.verdicts.select("txn_id", "verdict", "payment_ids")


_SPLIT = "SELECT txn_id FROM verdicts v JOIN ivl p ON p.payment_id = v.payment_ids WHERE v.verdict = 'assign' AND p.certain AND p.amount >= 20000 AND v.tier = 'tier2_amount_date' ORDER BY md5('2002' || txn_id) LIMIT 5"


@query(_PLAIN + f" WHERE txn_id NOT IN ({_SPLIT})", MATCH)
def mr2_split(spark, sf_dir):
    """Five payments split in two, their credits moved by the change of the fee: all other credits keep their verdicts."""
    pay, bank = payments(spark, sf_dir), bank_lines(spark, sf_dir)
    v = outcome(spark, sf_dir).verdicts.filter("verdict = 'assign' and tier = 'tier2_amount_date'").select("txn_id", F.col("payment_ids").alias("payment_id"))
    fit = v.join(_intervals(spark, sf_dir).filter("certain and amount >= 20000"), "payment_id")
    some = checkpoint(fit.orderBy(F.md5(F.concat(F.lit("2002"), F.col("txn_id")).cast("binary"))).limit(5))
    half = F.floor(F.col("amount") / 2).cast("long")

    def part(suffix: str, amount: Column, tds: Column, refunded: Column) -> DataFrame:
        base, tax = fees.fee_and_tax(amount)
        cols = {"payment_id": F.concat("payment_id", F.lit(suffix)), "true_fee": base + tax, "fee": base + tax, "amount": amount, "tds": tds, "refunded": refunded}
        cols |= {"order_id": F.concat("order_id", F.lit(suffix)), "bank_transaction_id": F.concat("bank_transaction_id", F.lit(suffix)), "description": F.concat("description", F.lit(suffix))}
        return some.withColumns(cols).select(*pay.columns)

    a, b = part("_a", half, F.col("tds"), F.col("refunded")), part("_b", F.col("amount") - half, F.lit(0).cast("long"), F.lit(0).cast("long"))
    parts = checkpoint(a.unionByName(b))
    pieces = parts.groupBy(F.regexp_replace("payment_id", "_[ab]$", "").alias("payment_id")).agg(F.sum("fee").alias("fees"))
    delta = some.join(pieces, "payment_id").select("txn_id", (F.col("fees") - F.col("fee")).alias("delta"))

    def moved(lines: DataFrame) -> DataFrame:
        return lines.join(F.broadcast(delta), "txn_id", "left").withColumn("credit", F.col("credit") - F.coalesce("delta", F.lit(0))).select(*lines.columns)

    out = _rerun(spark, sf_dir, "mr2", moved(bank), pay.join(F.broadcast(some.select("payment_id")), "payment_id", "left_anti").unionByName(parts), moved(_credits(spark, sf_dir)))
    return out.verdicts.join(some.select("txn_id"), "txn_id", "left_anti").select("txn_id", "verdict", "payment_ids")


@query(_PLAIN, MATCH)
def mr3_augmentation(spark, sf_dir):
    """A payment that nothing can match, one for each merchant, changes no verdict."""
    pay, bank = payments(spark, sf_dir), bank_lines(spark, sf_dir)
    top = bank.groupBy("merchant_id").agg(F.max("credit").alias("m"), F.max("txn_date").alias("d"))
    values = {
        "payment_id": F.concat(F.lit("pay_none_"), F.col("merchant_id").cast("string")), "pay_date": F.date_add("d", 365), "amount": F.col("m") * 10, "captured": F.lit(True),
        "refunded": F.lit(0), "tds": F.lit(0), "true_fee": F.lit(0), "fee": F.lit(0), "key": F.lit(-1), "w": F.lit(-1), "merchant_id": F.col("merchant_id"),
    }
    odd = top.select(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in pay.schema.fields))
    return _rerun(spark, sf_dir, "mr3", bank, pay.unionByName(odd), _credits(spark, sf_dir)).verdicts.select("txn_id", "verdict", "payment_ids")


@query("SELECT txn_id, false AS settled FROM rounds WHERE verdict <> 'assign'", MATCH)
def mr6_residue(spark, sf_dir):
    """The rounds over the credits and payments that they left, with the whole batch's chance agreement: nothing more is settled."""
    out, bank = outcome(spark, sf_dir), bank_lines(spark, sf_dir)
    done = out.verdicts.filter("verdict = 'assign'")
    free = payments(spark, sf_dir).join(done.select(F.explode(F.split("payment_ids", ",")).alias("payment_id")), "payment_id", "left_anti")
    residue = M.credit_lines(bank).join(done.select("txn_id"), "txn_id", "left_anti")
    again = once(spark, sf_dir, "mr6", lambda: R.reconcile(residue, free, checkpoint, u=_u(spark, sf_dir), parsed=_credits(spark, sf_dir).join(done.select("txn_id"), "txn_id", "left_anti")))
    return again.verdicts.select("txn_id", (F.col("verdict") == "assign").alias("settled"))


def _ensemble(spark, sf_dir) -> tuple[R.Outcome, DataFrame]:
    """Three passes (``P.PERMUTATIONS_FAST``): the base and two over rows in other orders.

    A registered query runs on each round, so it takes the short ensemble;
    ``reconcile.ensemble`` runs as many as it is asked for.
    """

    def make():
        match_inputs(spark, sf_dir)  # the passes run side by side over what is made here
        pay, bank, credits = payments(spark, sf_dir), bank_lines(spark, sf_dir), _credits(spark, sf_dir)

        def one_pass(i: int) -> R.Outcome:
            seed = 991 + i - 1
            if not i:
                return outcome(spark, sf_dir)
            return _rerun(spark, sf_dir, "mr1" if i == 1 else f"pass{i}", R.shuffled(bank, "txn_id", seed), R.shuffled(pay, "payment_id", seed), R.shuffled(credits, "txn_id", seed))

        outs = together(*(partial(one_pass, i) for i in range(P.PERMUTATIONS_FAST)))
        runs = [out.verdicts.filter(SETTLED).select(F.lit(i).alias("pass"), "txn_id", "payment_ids") for i, out in enumerate(outs)]
        return outs[0], checkpoint(reduce(DataFrame.unionByName, runs))

    return once(spark, sf_dir, "ensemble", make)


@query("SELECT txn_id, payment_ids AS modal, 1.0::DOUBLE AS stability FROM posted", MATCH)
def permutation_stability(spark, sf_dir):
    """Share of the passes in which a credit gets its most frequent payments."""
    return G.stability(_ensemble(spark, sf_dir)[1], P.PERMUTATIONS_FAST)


@query(f"SELECT {P.PERMUTATIONS_FAST} AS passes, count(*) AS txns, 0::BIGINT AS unstable, 1.0::DOUBLE AS least, 1.0::DOUBLE AS mean FROM posted", MATCH)
def ensemble_summary(spark, sf_dir):
    return R.passes_summary(_ensemble(spark, sf_dir)[1], P.PERMUTATIONS_FAST)


@query(f"SELECT txn_id, verdict, payment_ids, CASE WHEN {SETTLED} THEN 1.0::DOUBLE END AS stability FROM verdicts", MATCH)
def gated_verdicts(spark, sf_dir):
    """Verdicts behind the gate: whatever a pass decides otherwise is refused as order-dependent."""
    base, runs = _ensemble(spark, sf_dir)
    return R.gate(base, runs, P.PERMUTATIONS_FAST).select("txn_id", "verdict", "payment_ids", "stability")


# A matcher that takes rows as they come, to show what the ensemble is for: each pass draws another order.
_GREEDY = """, picks AS (SELECT s.i AS pass, o.txn_id, arg_min(o.payment_id, md5(s.i || o.payment_id)) AS payment_ids FROM pool o, (VALUES (0), (1), (2), (3)) s(i) WHERE abs(o.residual) <= 2000000 GROUP BY 1, 2),
share AS (SELECT txn_id, max(n) / 4 AS stability FROM (SELECT txn_id, payment_ids, count(*) AS n FROM picks GROUP BY 1, 2) GROUP BY 1) """


@query(_GREEDY + "SELECT 4 AS passes, count(*) AS txns, sum((stability < 1)::INT)::BIGINT AS unstable, round(min(stability), 6) AS least, round(avg(stability), 6) AS mean FROM share")
def greedy_ensemble(spark, sf_dir):
    """The same summary over a matcher that depends on order: many credits are unstable."""
    pool = M.candidate_pool(_credits(spark, sf_dir), _intervals(spark, sf_dir)).filter(F.abs("residual") <= 2_000_000)
    runs = []
    for i in range(4):
        first = F.min_by("payment_id", F.md5(F.concat(F.lit(str(i)), F.col("payment_id")).cast("binary")))
        runs.append(pool.groupBy("txn_id").agg(first.alias("payment_ids")).select(F.lit(i).alias("pass"), "txn_id", "payment_ids"))
    return R.passes_summary(reduce(DataFrame.unionByName, runs), 4)


# Audit of a third party's claims

CONTEXT = "unique_only_in_context"


def audit(claims: DataFrame, bank: DataFrame, credits: DataFrame, pay: DataFrame, u: DataFrame) -> DataFrame:
    """(txn_id, check, paise) of each finding against claims (txn_id, group_key, payment_ids), without any truth.

    A payment is double-posted if two different groups claim it.  A claim that
    doesn't balance is checked no further.  Rivals are looked for in the pool
    that other claims leave, and, where there are none, in the whole window.
    """
    lines = credits.select("txn_id", "merchant_id", "credit", "txn_date")
    own = claims.select("txn_id", "group_key", F.explode("payment_ids").alias("payment_id"))
    owners = own.groupBy("payment_id").agg(F.countDistinct("group_key").alias("owners"))
    known = pay.select("payment_id", "pay_date", "lo", "hi")
    rows = own.join(owners, "payment_id").join(known, "payment_id", "left").join(lines, "txn_id", "left")
    per = rows.groupBy("txn_id", "group_key").agg(
        F.bool_or(F.col("lo").isNull() | F.col("credit").isNull()).alias("unknown"), F.max("owners").alias("owners"), F.sum("lo").alias("lo"), F.sum("hi").alias("hi"), F.first("credit").alias("credit"),
        F.first("merchant_id").alias("merchant_id"), F.sort_array(F.collect_set("payment_id")).alias("ids"),
    )
    totals = per.groupBy("group_key").agg(F.sum("credit").alias("total"), F.bool_or(F.col("credit").isNull()).alias("lacks"))
    per = checkpoint(per.join(totals, "group_key").withColumn("unknown", F.col("unknown") | F.col("lacks")))
    good = ~F.col("unknown")
    balanced = good & fees.fits(F.col("total"), F.col("lo"), F.col("hi"))
    held = per.filter(balanced).select("group_key", "total", "ids").dropDuplicates(["group_key"])
    # The union of a group's pools, and which of its payments other groups claim.
    window = M.candidate_pool(credits, pay).select("txn_id", "payment_id", "lo", "hi").join(per.filter(balanced).select("txn_id", "group_key"), "txn_id")
    window = window.select("group_key", "payment_id", "lo", "hi").distinct().join(owners, "payment_id", "left").join(held, "group_key")
    mine = F.array_contains("ids", F.col("payment_id"))
    window = checkpoint(window.withColumn("elsewhere", F.col("owners").isNotNull() & ~mine))
    outside = held.select("group_key", F.explode("ids").alias("payment_id")).join(window.select("group_key", "payment_id"), ["group_key", "payment_id"], "left_anti").select("group_key").distinct()

    def rivals(pool: DataFrame) -> DataFrame:
        """Groups whose pool has a fitting subset other than the claim."""
        items = pool.select(F.col("group_key").alias("txn_id"), F.col("total").alias("credit"), F.lit(None).cast("int").alias("txns"), "payment_id", "lo", "hi")
        found = M.subset_sum(items.select("txn_id").distinct(), items).select(F.col("txn_id").alias("group_key"), "verdict", "solutions", "payment_ids")
        same = F.coalesce(F.split("payment_ids", ",") == F.col("ids"), F.lit(False))
        return found.join(held.select("group_key", "ids"), "group_key").filter((F.col("solutions") > 1) | ((F.col("solutions") == 1) & ~same)).select("group_key")

    contextual = checkpoint(rivals(window.filter("not elsewhere")))
    raw = rivals(window.join(contextual, "group_key", "left_anti").join(window.filter("elsewhere").select("group_key").distinct(), "group_key", "left_semi"))
    sizes = M.pool_sizes(credits, pay)
    named = M.evidence(per.filter(balanced).select("txn_id", F.array_join("ids", ",").alias("payment_ids")), M.with_facts(credits), pay, u, sizes).filter("contradicts").select("txn_id")
    checks = (
        ("unknown_id", per.filter(~good)), ("double_posted", per.filter(good & (F.col("owners") > 1))), ("conservation", per.filter(good & ~balanced)),
        ("out_of_window", per.join(outside, "group_key", "left_semi")), ("underdetermined", per.join(contextual, "group_key", "left_semi")), (CONTEXT, per.join(raw, "group_key", "left_semi")),
        ("identity_contradicted", per.join(named, "txn_id", "left_semi")),
    )
    return reduce(DataFrame.unionByName, (x.select("txn_id", F.lit(name).alias("check"), F.coalesce("credit", F.lit(0)).alias("paise")) for name, x in checks))


def audit_summary(findings: DataFrame, claims: DataFrame, credits: DataFrame) -> DataFrame:
    """(claims, credits, coverage, surviving, survival, at_risk): each failed credit counts once, context findings not at all."""
    failed = findings.filter(F.col("check") != CONTEXT).dropDuplicates(["txn_id"]).agg(F.count("*").alias("failed"), F.coalesce(F.sum("paise"), F.lit(0)).alias("at_risk"))
    x = claims.agg(F.count("*").alias("claims")).join(credits.agg(F.count("*").alias("credits")), F.lit(True)).join(failed, F.lit(True))
    left = F.col("claims") - F.col("failed")
    return x.select("claims", "credits", _ratio(F.col("claims"), F.col("credits")).alias("coverage"), left.alias("surviving"), _ratio(left, F.col("claims")).alias("survival"), "at_risk")


def _naive_claims(spark, sf_dir) -> DataFrame:
    from ledgerloom.plans.reports import naive_matcher  # it registers its queries after these

    return naive_matcher(spark, sf_dir).select("txn_id", F.col("txn_id").alias("group_key"), F.array("payment_id").alias("payment_ids"))


def _naive_findings(spark, sf_dir) -> DataFrame:
    make = lambda: checkpoint(audit(_naive_claims(spark, sf_dir), bank_lines(spark, sf_dir), _credits(spark, sf_dir), _intervals(spark, sf_dir), _u(spark, sf_dir)))
    return once(spark, sf_dir, "naive-findings", make)


def _audit_sql(claims: str) -> str:
    """CTEs: ``findings`` (txn_id, check_, paise) for claims (txn_id, gkey, ids)."""
    return (
        CHANCE + f""", claim AS MATERIALIZED ({claims}),
own AS MATERIALIZED (SELECT txn_id, gkey, unnest(ids) AS payment_id FROM claim), owner AS MATERIALIZED (SELECT payment_id, count(DISTINCT gkey) AS owners FROM own GROUP BY 1),
per0 AS (SELECT o.txn_id, o.gkey, bool_or(p.lo IS NULL OR c.credit IS NULL) AS unknown, max(w.owners) AS owners, sum(p.lo) AS lo, sum(p.hi) AS hi, any_value(c.credit) AS credit, list_sort(list(DISTINCT o.payment_id)) AS ids
  FROM own o JOIN owner w USING (payment_id) LEFT JOIN ivl p ON p.payment_id = o.payment_id LEFT JOIN credits c ON c.txn_id = o.txn_id GROUP BY 1, 2),
per AS MATERIALIZED (SELECT *, NOT unknown AND greatest(lo - total, total - hi, 0) <= {P.TOLERANCE} AS balanced FROM (SELECT * REPLACE (unknown OR bool_or(credit IS NULL) OVER (PARTITION BY gkey) AS unknown), sum(credit) OVER (PARTITION BY gkey) AS total FROM per0)),
held AS MATERIALIZED (SELECT gkey, any_value(total) AS target, any_value(ids) AS ids FROM per WHERE balanced GROUP BY 1),
win AS MATERIALIZED (SELECT DISTINCT p.gkey, o.payment_id, o.lo, o.hi, w.owners IS NOT NULL AND NOT list_contains(h.ids, o.payment_id) AS elsewhere FROM pool o JOIN per p USING (txn_id) JOIN held h ON h.gkey = p.gkey LEFT JOIN owner w ON w.payment_id = o.payment_id WHERE p.balanced),
outw AS (SELECT DISTINCT gkey FROM (SELECT gkey, unnest(ids) AS payment_id FROM held) ANTI JOIN win USING (gkey, payment_id)),
ctx AS (SELECT gkey, payment_id, lo, hi FROM win WHERE NOT elsewhere), ctxs AS (SELECT c.* FROM ctx c SEMI JOIN (SELECT gkey FROM ctx GROUP BY 1 HAVING count(*) <= {P.MAX_POOL}) USING (gkey)), htgt AS (SELECT gkey, target FROM held)"""
        + search_sql("htgt", "ctxs", "csol", "gkey")
        + f""", crival AS MATERIALIZED (SELECT DISTINCT s.gkey FROM csol s JOIN held h USING (gkey) WHERE s.ids <> h.ids),
raws AS (SELECT w.gkey, w.payment_id, w.lo, w.hi FROM win w ANTI JOIN crival USING (gkey) SEMI JOIN (SELECT gkey FROM win GROUP BY 1 HAVING count(*) <= {P.MAX_POOL} AND bool_or(elsewhere)) USING (gkey))"""
        + search_sql("htgt", "raws", "rsol", "gkey")
        + """, rrival AS (SELECT DISTINCT s.gkey FROM rsol s JOIN held h USING (gkey) WHERE s.ids <> h.ids), held_claim AS (SELECT txn_id, ids FROM per WHERE balanced)"""
        + evidence_sql("held_claim", "aev")
        + """, findings AS MATERIALIZED (SELECT txn_id, 'unknown_id' AS check_, credit FROM per WHERE unknown UNION ALL SELECT txn_id, 'double_posted', credit FROM per WHERE NOT unknown AND owners > 1
  UNION ALL SELECT txn_id, 'conservation', credit FROM per WHERE NOT unknown AND NOT balanced UNION ALL SELECT txn_id, 'out_of_window', credit FROM per SEMI JOIN outw USING (gkey)
  UNION ALL SELECT txn_id, 'underdetermined', credit FROM per SEMI JOIN crival USING (gkey) UNION ALL SELECT txn_id, 'unique_only_in_context', credit FROM per SEMI JOIN rrival USING (gkey)
  UNION ALL SELECT p.txn_id, 'identity_contradicted', p.credit FROM per p JOIN aev e USING (txn_id) WHERE (coalesce(e.name_level = 0, false) OR coalesce(e.ref_level = 0, false)) AND e.field_weight < 0)"""
    )


_NAIVE_CLAIMS = "SELECT txn_id, txn_id AS gkey, [arg_min(payment_id, (abs(residual), payment_id))] AS ids FROM pool GROUP BY 1"
_SUMMARY = """ SELECT c.n AS claims, k.n AS credits, round(c.n / k.n, 6) AS coverage, c.n - f.n AS surviving, round((c.n - f.n) / c.n, 6) AS survival, f.at_risk FROM (SELECT count(*) AS n FROM claim) c, (SELECT count(*) AS n FROM credits) k,
(SELECT count(*) AS n, coalesce(sum(paise), 0)::BIGINT AS at_risk FROM (SELECT txn_id, any_value(coalesce(credit, 0)) AS paise FROM findings WHERE check_ <> 'unique_only_in_context' GROUP BY 1)) f"""


@query(_audit_sql(_NAIVE_CLAIMS) + ' SELECT txn_id, check_ AS "check", coalesce(credit, 0) AS paise FROM findings')
def claims_audit(spark, sf_dir):
    """Findings against a matcher that always takes the closest payment."""
    return _naive_findings(spark, sf_dir)


@query(_audit_sql(_NAIVE_CLAIMS) + _SUMMARY)
def audit_rollup(spark, sf_dir):
    return audit_summary(_naive_findings(spark, sf_dir), _naive_claims(spark, sf_dir), _credits(spark, sf_dir))


@query(_audit_sql(_NAIVE_CLAIMS) + ' SELECT check_ AS "check", count(*) AS n FROM findings GROUP BY 1')
def audit_by_check(spark, sf_dir):
    return _naive_findings(spark, sf_dir).groupBy("check").agg(F.count("*").alias("n"))


_ORDER = ("unknown_id", "double_posted", "conservation", "out_of_window", "underdetermined", CONTEXT, "identity_contradicted")


@query(_audit_sql(_NAIVE_CLAIMS) + f" SELECT txn_id, arg_min(check_, list_position({list(_ORDER)}, check_)) AS first_check FROM findings GROUP BY 1")
def first_finding(spark, sf_dir):
    """The first finding of each credit, in the order of the checks."""
    place = F.array_position(F.array(*map(F.lit, _ORDER)), F.col("check"))
    w = Window.partitionBy("txn_id").orderBy(place)
    return _naive_findings(spark, sf_dir).withColumn("r", F.row_number().over(w)).filter("r = 1").select("txn_id", F.col("check").alias("first_check"))


_OWN_CLAIMS = "SELECT v.txn_id, coalesce(g.gid, v.txn_id) AS gkey, string_split(v.payment_ids, ',') AS ids FROM verdicts v LEFT JOIN (SELECT unnest(string_split(txn_ids, '+')) AS txn_id, txn_ids AS gid FROM grp WHERE outcome = 'granted') g USING (txn_id) WHERE v.verdict IN ('assign', 'grouped')"
_OWN = MATCH + _audit_sql(_OWN_CLAIMS).replace(CHANCE, "", 1)


@query(_OWN + ' SELECT txn_id, check_ AS "check", coalesce(credit, 0) AS paise FROM findings')
def self_audit(spark, sf_dir):
    """The engine's own output as claims, groups kept together, under the same checks."""
    make = lambda: checkpoint(audit(R.as_claims(outcome(spark, sf_dir)), bank_lines(spark, sf_dir), _credits(spark, sf_dir), _intervals(spark, sf_dir), _u(spark, sf_dir)))
    return once(spark, sf_dir, "self-findings", make)


@query(_audit_sql(_NAIVE_CLAIMS) + """, truth0 AS (SELECT merchant_id, w, chunk, min(key) AS key, count(*) AS n, array_to_string(list_sort(list(payment_id)), ',') AS payment_ids FROM chunked GROUP BY 1, 2, 3),
truth AS (SELECT 'bt_' || lpad(key::VARCHAR, 9, '0') || part AS txn_id, payment_ids FROM truth0, (VALUES ('', false), ('a', true), ('b', true)) x(part, is_split) WHERE (n = 1 AND key % 59 = 0) = is_split),
seen AS (SELECT c.txn_id, array_to_string(c.ids, ',') <> t.payment_ids AS wrong, f.txn_id IS NOT NULL AS flagged FROM claim c JOIN truth t USING (txn_id) LEFT JOIN (SELECT DISTINCT txn_id FROM findings WHERE check_ <> 'unique_only_in_context') f USING (txn_id))
SELECT sum((wrong AND flagged)::INT)::BIGINT AS caught, sum((wrong AND NOT flagged)::INT)::BIGINT AS missed, sum((NOT wrong AND flagged)::INT)::BIGINT AS false_alarms, sum((NOT wrong AND NOT flagged)::INT)::BIGINT AS clean FROM seen""")
def audit_confusion(spark, sf_dir):
    """The audit as a detector of wrong claims, against the truth it never saw."""
    t = derive.truth(payments(spark, sf_dir)).select("txn_id", F.col("payment_ids").alias("right_ids"))
    flagged = _naive_findings(spark, sf_dir).filter(F.col("check") != CONTEXT).select("txn_id").distinct().withColumn("flagged", F.lit(True))
    x = _naive_claims(spark, sf_dir).join(t, "txn_id").join(flagged, "txn_id", "left").withColumns({"wrong": F.array_join("payment_ids", ",") != F.col("right_ids"), "flagged": F.coalesce("flagged", F.lit(False))})
    w, f = F.col("wrong"), F.col("flagged")
    return x.agg(_n(w & f).alias("caught"), _n(w & ~f).alias("missed"), _n(~w & f).alias("false_alarms"), _n(~w & ~f).alias("clean"))


@query(f"""SELECT payment_id, lo <= hi AS ordered, hi - lo <= amount AS bounded, amount >= {100 * P.TOLERANCE} AS above_tolerance FROM ivl""")
def input_guards(spark, sf_dir):
    """Sanity of what the matcher is given: intervals in order, within the amount, and amounts well above the tolerance."""
    x = _intervals(spark, sf_dir)
    return x.select("payment_id", (F.col("lo") <= F.col("hi")).alias("ordered"), (F.col("hi") - F.col("lo") <= F.col("amount")).alias("bounded"), (F.col("amount") >= 100 * P.TOLERANCE).alias("above_tolerance"))


@query(_TRUTH.split("scored AS")[0].rstrip().rstrip(",") + f"""SELECT t.txn_id, bool_and(c.txn_date - p.pay_date BETWEEN 0 AND {P.LOOKBACK_DAYS}) AS in_window, greatest(sum(p.lo) - any_value(c.credit), any_value(c.credit) - sum(p.hi), 0) <= {P.TOLERANCE} AS balances
FROM truth t, unnest(string_split(t.payment_ids, ',')) AS q(payment_id), credits c, ivl p WHERE c.txn_id = t.txn_id AND p.payment_id = q.payment_id AND t.relation <> 'split' GROUP BY 1""")
def truth_satisfiable(spark, sf_dir):
    """Whether the planted answer of each credit can be reached at all: within the window, and in balance."""
    t = derive.truth(payments(spark, sf_dir)).filter("relation <> 'split'").select("txn_id", F.explode(F.split("payment_ids", ",")).alias("payment_id"))
    x = t.join(bank_lines(spark, sf_dir).select("txn_id", "credit", "txn_date"), "txn_id").join(_intervals(spark, sf_dir).select("payment_id", "pay_date", "lo", "hi"), "payment_id")
    lag = F.datediff("txn_date", "pay_date")
    fit = fees.fits(F.first("credit"), F.sum("lo"), F.sum("hi"))
    return x.groupBy("txn_id").agg(F.bool_and(lag.between(0, P.LOOKBACK_DAYS)).alias("in_window"), fit.alias("balances"))


@query("SELECT merchant_id, month, txn_ids, payment_ids, credit, outcome FROM grp", MATCH)
def settlement_groups(spark, sf_dir):
    """Settlements that arrived as several lines, of which each merchant's month is searched."""
    return outcome(spark, sf_dir).groups


@query(f"SELECT merchant_id, sha256(string_agg(digest, ',' ORDER BY day)) AS digest FROM (SELECT v.merchant_id, c.txn_date AS day, sha256(string_agg(v.txn_id || '=' || v.payment_ids, ',' ORDER BY v.txn_id)) AS digest FROM verdicts v JOIN credits c USING (txn_id) WHERE v.{SETTLED} GROUP BY 1, 2) GROUP BY 1", MATCH)
def assignment_digest(spark, sf_dir):
    """A digest of each merchant's assignments: of its days' digests, so that no row holds more than a day."""
    pairs = F.concat("txn_id", F.lit("="), "payment_ids")
    x = outcome(spark, sf_dir).verdicts.filter(SETTLED).join(bank_lines(spark, sf_dir).select("txn_id", "txn_date"), "txn_id")

    def digest(parts: Column) -> Column:
        return F.sha2(F.array_join(F.array_sort(parts), ",").cast("binary"), 256)

    days = x.groupBy("merchant_id", "txn_date").agg(digest(F.collect_list(pairs)).alias("d"))
    inner = F.transform(F.array_sort(F.collect_list(F.struct("txn_date", "d"))), lambda v: v["d"])
    return days.groupBy("merchant_id").agg(F.sha2(F.array_join(inner, ",").cast("binary"), 256).alias("digest"))


@query(f"SELECT bank, payer = '{THIRD_PARTY}' AS third_party, count(*) AS n FROM (SELECT payer, CASE left(ref_no, 4) WHEN 'HDFC' THEN 'HDFC Bank' WHEN 'ICIC' THEN 'ICICI Bank' WHEN 'SBIN' THEN 'State Bank of India' ELSE left(ref_no, 4) END AS bank FROM parsed) GROUP BY ALL")
def banks_of_references(spark, sf_dir):
    bank, _ = narration.bank_of(F.col("ref_no"))
    return _credits(spark, sf_dir).groupBy(bank.alias("bank"), (F.col("payer") == THIRD_PARTY).alias("third_party")).agg(F.count("*").alias("n"))
