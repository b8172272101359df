"""Queries that report, route, audit and verify what the matching tiers decided."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import params as P
from ledgerloom.functions import fees, narration
from ledgerloom.operators import matching as M
from ledgerloom.plans.catalog import _cascade, _credits, _intervals, _nearest, _pool, bank_lines, invoices, outcome, payments, query
from ledgerloom.plans.sql import MATCH
from ledgerloom.plans.storage import checkpoint, once

# What open credits are called on a worklist until the subset search has seen them.
_CATEGORY = "CASE WHEN verdict = 'open' THEN 'no_candidate' ELSE verdict END"
_NOW = "2026-01-01 00:00:00"
_ROUTES = ", ".join(f"('{c}', '{d}', {P.DESKS[d][0]}, {str(P.DESKS[d][1]).lower()})" for c, d in P.DESK_OF.items())
_DESKS = ", ".join(f"('{d}', {h}, {str(i).lower()})" for d, (h, i) in P.DESKS.items())
#: Every credit's best single payment, right or wrong: the claims of a matcher that never refuses.
_NAIVE = """, naive AS (SELECT * FROM (SELECT txn_id, credit, payment_id, residual, row_number() OVER (PARTITION BY txn_id ORDER BY abs(residual), payment_id) AS r FROM pool) WHERE r = 1)"""


def _category() -> Column:
    return F.when(F.col("verdict") == "open", "no_candidate").otherwise(F.col("verdict"))


def _lookup(pairs: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def _open_items(spark, sf_dir) -> DataFrame:
    x = _cascade(spark, sf_dir).filter("verdict <> 'assign'").select("txn_id", "credit", _category().alias("category"))
    return x.withColumn("desk", _lookup(P.DESK_OF, F.col("category"))).withColumn("material", F.col("credit") >= P.MATERIALITY)


@query(f"""SELECT txn_id, category, desk, material, CASE WHEN material THEN greatest(1, hours // 2) ELSE hours END::INT AS sla_hours, strftime(TIMESTAMP '{_NOW}' + to_hours(CASE WHEN material THEN greatest(1, hours // 2) ELSE hours END), '%Y-%m-%d %H:%M:%S') AS due_at, internal
FROM (SELECT txn_id, credit >= {P.MATERIALITY} AS material, {_CATEGORY} AS category FROM cascade WHERE verdict <> 'assign') JOIN (VALUES {_ROUTES}) r(category, desk, hours, internal) USING (category)""")
def exception_routing(spark, sf_dir):
    """Desk and due time of every exception; a material one has half the time."""
    x = _open_items(spark, sf_dir)
    base = _lookup({d: h for d, (h, _) in P.DESKS.items()}, F.col("desk"))
    hours = F.when(F.col("material"), F.greatest(F.lit(1), F.floor(base / 2).cast("int"))).otherwise(base).cast("int")
    due = F.date_format(F.lit(_NOW).cast("timestamp") + F.make_dt_interval(hours=hours), "yyyy-MM-dd HH:mm:ss")
    return x.select("txn_id", "category", "desk", "material", hours.alias("sla_hours"), due.alias("due_at"), _lookup({d: i for d, (_, i) in P.DESKS.items()}, F.col("desk")).alias("internal"))


@query(f"""SELECT d.desk, d.internal, count(x.txn_id) AS n, coalesce(sum(x.credit), 0)::BIGINT AS at_risk, coalesce(sum((x.credit >= {P.MATERIALITY})::INT), 0)::BIGINT AS material
FROM (VALUES {_DESKS}) d(desk, hours, internal) LEFT JOIN (SELECT txn_id, credit, desk FROM cascade JOIN (VALUES {_ROUTES}) r(category, desk, hours, internal) ON category = {_CATEGORY} WHERE verdict <> 'assign') x USING (desk) GROUP BY ALL""")
def worklist_by_desk(spark, sf_dir):
    """Every desk, the idle ones too; aggregated before the join with the five desks."""
    desks = spark.createDataFrame([(d, i) for d, (_, i) in P.DESKS.items()], "desk string, internal boolean")
    x = _open_items(spark, sf_dir).groupBy("desk").agg(F.count("*").alias("n"), F.sum("credit").alias("at_risk"), F.sum(F.col("material").cast("int")).alias("material"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "at_risk", "material")]
    return desks.join(x, "desk", "left").select("desk", "internal", *zero)


@query("SELECT txn_id, payment_id, round(greatest(0, 1 - abs(residual) / 100.0) * CASE WHEN certain THEN 1 ELSE 1 - 0.5 * least(1.0, (hi - lo) / 200.0) END, 9) AS tightness FROM pool")
def residual_tightness(spark, sf_dir):
    t = fees.tightness(F.col("residual"), F.col("hi") - F.col("lo"), F.col("certain"))
    return _pool(spark, sf_dir).select("txn_id", "payment_id", F.round(t, 9).alias("tightness"))


@query(_NAIVE + " SELECT txn_id, payment_id, residual FROM naive")
def naive_matcher(spark, sf_dir):
    """Takes the closest payment of the pool whatever the evidence: what the audit is tried on."""
    return _nearest(spark, sf_dir)


@query("SELECT c.txn_id FROM credits c WHERE c.txn_id NOT IN (SELECT txn_id FROM pool) UNION ALL SELECT txn_id FROM debits")
def unexamined_lines(spark, sf_dir):
    """Bank lines that no candidate pool reaches, by subtraction."""
    seen = _pool(spark, sf_dir).select("txn_id").distinct()
    return bank_lines(spark, sf_dir).select("txn_id").join(seen, "txn_id", "left_anti")


@query("SELECT ref_no, count(*) AS n, min(txn_id) AS first_txn FROM (SELECT regexp_extract(narration, '([A-Z]{4,6}[0-9]{8,16})', 1) AS ref_no, txn_id FROM bank) WHERE ref_no <> '' GROUP BY 1 HAVING count(*) > 1")
def reference_siblings(spark, sf_dir):
    """References that several bank lines quote, a credit and its claw-back for one."""
    b = bank_lines(spark, sf_dir).select("txn_id", F.regexp_extract("narration", "([A-Z]{4,6}[0-9]{8,16})", 1).alias("ref_no"))
    return b.filter("ref_no <> ''").groupBy("ref_no").agg(F.count("*").alias("n"), F.min("txn_id").alias("first_txn")).filter("n > 1")


@query("""SELECT txn_id, a.payment_id AS before, c.payment_id AS after FROM (SELECT txn_id, payment_id FROM t1 WHERE hits = 1 AND abs(residual) <= 100) a
FULL JOIN (SELECT txn_id, payment_id FROM cascade WHERE verdict = 'assign') c USING (txn_id) WHERE a.payment_id IS DISTINCT FROM c.payment_id""")
def verdict_diff(spark, sf_dir):
    """What the amount tier changes against references alone."""
    t1 = M.tier1(_credits(spark, sf_dir), _intervals(spark, sf_dir)).filter((F.col("t1_hits") == 1) & (F.abs("t1_residual") <= P.TOLERANCE))
    after = _cascade(spark, sf_dir).filter("verdict = 'assign'").select("txn_id", F.col("payment_id").alias("after"))
    both = t1.select("txn_id", F.col("t1_payment").alias("before")).join(after, "txn_id", "full")
    return both.filter(~F.col("before").eqNullSafe(F.col("after")))


@query(f"SELECT txn_id, credit, CASE WHEN credit >= {P.MATERIALITY} THEN 'examined' ELSE 'sampled' END AS stratum FROM cascade WHERE verdict = 'assign' AND (credit >= {P.MATERIALITY} OR substr(md5('991' || txn_id), 1, 8) < '40000000')")
def materiality_plan(spark, sf_dir):
    """All material assignments and a quarter of the others, drawn by a hash of the id: no order over all rows."""
    cut = f"{int(P.SAMPLED_SHARE * 2**32):08x}"
    large = F.col("credit") >= P.MATERIALITY
    drawn = F.substring(F.md5(F.concat(F.lit("991"), F.col("txn_id")).cast("binary")), 1, 8) < cut
    return _cascade(spark, sf_dir).filter("verdict = 'assign'").filter(large | drawn).select("txn_id", "credit", F.when(large, "examined").otherwise("sampled").alias("stratum"))


@query("SELECT txn_id, string_agg(t, ',' ORDER BY t) AS tokens FROM (SELECT DISTINCT txn_id, unnest(regexp_extract_all(upper(narration), '[A-Z0-9]{6,}')) AS t FROM debits) WHERE regexp_matches(t, '[A-Z]') AND regexp_matches(t, '[0-9]') GROUP BY 1")
def debit_tokens(spark, sf_dir):
    """Tokens of a debit that look like references: letters and digits, six at least."""
    runs = F.array_distinct(F.regexp_extract_all(F.upper("narration"), F.lit("([A-Z0-9]{6,})"), 1))
    shaped = F.filter(runs, lambda t: t.rlike("[A-Z]") & t.rlike("[0-9]"))
    return M.debit_lines(bank_lines(spark, sf_dir)).select("txn_id", F.array_join(F.array_sort(shaped), ",").alias("tokens")).filter("tokens <> ''")


@query("SELECT invoice_no, customer_name, gross FROM inv WHERE contains(lower(customer_name), 'orbit') OR contains(lower(invoice_no), 'orbit')")
def invoice_search(spark, sf_dir):
    return search_invoices(invoices(spark, sf_dir), "Orbit").select("invoice_no", "customer_name", "gross")


def search_invoices(ledger: DataFrame, text: str) -> DataFrame:
    """Invoices whose number or customer holds ``text``, in any case."""
    t = F.lit(text.lower())
    return ledger.filter(F.contains(F.lower("customer_name"), t) | F.contains(F.lower("invoice_no"), t))


@query("""SELECT txn_id, CASE verdict WHEN 'assign' THEN 'Rs ' || credit // 100 || '.' || lpad((credit % 100)::VARCHAR, 2, '0') || ' settles ' || payment_id || ', ' || abs(residual) || ' off'
WHEN 'multiple_candidates' THEN 'several payments fit' WHEN 'unexplained_residual' THEN 'the quoted invoice settles for another amount' ELSE 'no single payment fits' END AS sentence FROM cascade""")
def verdict_sentences(spark, sf_dir):
    assigned = F.concat(F.lit("Rs "), fees.rupees(F.col("credit")), F.lit(" settles "), F.col("payment_id"), F.lit(", "), F.abs("residual").cast("string"), F.lit(" off"))
    v = F.col("verdict")
    text = (
        F.when(v == "assign", assigned).when(v == "multiple_candidates", "several payments fit")
        .when(v == "unexplained_residual", "the quoted invoice settles for another amount").otherwise("no single payment fits")
    )
    return _cascade(spark, sf_dir).select("txn_id", text.alias("sentence"))


@query("""SELECT txn_id, '{"txn_id":"' || txn_id || '","credit":' || credit || ',"payment_id":"' || payment_id || '","tier":"' || tier || '"}' AS payload FROM cascade WHERE verdict = 'assign'""")
def run_payload(spark, sf_dir):
    return _cascade(spark, sf_dir).filter("verdict = 'assign'").select("txn_id", F.to_json(F.struct("txn_id", "credit", "payment_id", "tier")).alias("payload"))




def audit_claims(claims: DataFrame, pay: DataFrame, lines: DataFrame) -> DataFrame:
    """Flags of single-payment claims (txn_id, payment_id) against the books; ``verify.audit`` has all checks."""
    x = claims.join(lines.select("txn_id", "credit", "txn_date"), "txn_id", "left").join(pay.select("payment_id", "pay_date", "lo", "hi"), "payment_id", "left")
    days = F.datediff("txn_date", "pay_date")
    n = F.count("*").over(Window.partitionBy("payment_id"))
    return x.select(
        "txn_id", "payment_id", "credit", (F.col("credit").isNull() | F.col("lo").isNull()).alias("unknown_id"), (n > 1).alias("double_posted"),
        F.coalesce(~fees.fits(F.col("credit"), F.col("lo"), F.col("hi")), F.lit(False)).alias("unbalanced"),
        F.coalesce((days < 0) | (days > P.LOOKBACK_DAYS), F.lit(False)).alias("out_of_window"),
    )


# The statement as one table of the whole match


def statement(spark, sf_dir) -> DataFrame:
    """Every bank line with its status, category, payments, customers, bank and desk: assignment, group, exception or debit, in that order."""

    def make() -> DataFrame:
        out, pay = outcome(spark, sf_dir), payments(spark, sf_dir)
        v = out.verdicts.select("txn_id", "verdict", "tier", "payment_ids")
        d = out.debits.select(F.col("debit_id").alias("txn_id"), F.col("outcome").alias("d_outcome"), F.col("payment_ids").alias("d_ids"))
        x = bank_lines(spark, sf_dir).join(v, "txn_id", "left").join(d, "txn_id", "left")
        settled, back = F.col("verdict").isin("assign", "grouped"), F.col("d_outcome").isin("reversed", "partially_reversed")
        category = F.when(F.col("debit") > 0, F.when(~back, F.col("d_outcome"))).when(~settled, F.col("verdict"))
        status = F.when(F.col("debit") > 0, F.when(back, "reversed").otherwise("unmatched")).when(settled, "assigned").when(F.col("verdict") == "no_candidate", "unmatched").otherwise("refused")
        bank, how = narration.bank_of(F.col("ref_no"))
        x = x.select(
            "txn_id", "merchant_id", "txn_date", F.when(F.col("credit") > 0, "credit").otherwise("debit").alias("direction"), F.greatest("credit", "debit").alias("amount"), status.alias("status"),
            F.coalesce(category, F.lit("")).alias("category"), F.when(settled, F.col("tier")).otherwise("").alias("tier"), F.coalesce("payment_ids", F.when(back, F.col("d_ids")), F.lit("")).alias("payment_ids"),
            ((F.col("verdict") == "grouped") | (F.col("d_outcome") == "partially_reversed")).alias("split"), bank.alias("bank"), how.alias("bank_known_by"), "narration", "ref_no",
        )
        names = x.select("txn_id", F.explode(F.split("payment_ids", ",")).alias("payment_id")).join(pay.select("payment_id", "customer_name", "invoice_no"), "payment_id")
        names = names.groupBy("txn_id").agg(F.array_join(F.array_sort(F.collect_set("customer_name")), ",").alias("customers"), F.array_join(F.array_sort(F.collect_set("invoice_no")), ",").alias("invoices"))
        x = x.join(names, "txn_id", "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("customers", "invoices")})
        x = x.withColumn("split", F.coalesce("split", F.lit(False))).withColumn("desk", F.coalesce(_lookup(P.DESK_OF, F.col("category")), F.lit("")))
        open_ = F.col("status").isin("refused", "unmatched")
        return checkpoint(x.withColumn("at_risk", F.when(open_, F.col("amount")).otherwise(0)))

    return once(spark, sf_dir, "statement", make)


_BANK_SQL = "CASE upper(regexp_extract(ref_no, '^([A-Za-z]{4})', 1)) " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in P.BANK_OF_CODE.items()) + " ELSE upper(regexp_extract(ref_no, '^([A-Za-z]{4})', 1)) END"
_DESK_SQL = "CASE category " + " ".join(f"WHEN '{c}' THEN '{d}'" for c, d in P.DESK_OF.items()) + " ELSE '' END"
_STATEMENT = MATCH + f""", st0 AS (SELECT b.*, v.verdict, v.tier, v.payment_ids, d.outcome AS d_outcome, d.payment_ids AS d_ids, coalesce(v.verdict IN ('assign', 'grouped'), false) AS settled, coalesce(d.outcome IN ('reversed', 'partially_reversed'), false) AS back
  FROM bank b LEFT JOIN verdicts v USING (txn_id) LEFT JOIN debit_class d ON d.debit_id = b.txn_id),
st1 AS (SELECT txn_id, merchant_id, txn_date, narration, ref_no, CASE WHEN credit > 0 THEN 'credit' ELSE 'debit' END AS direction, greatest(credit, debit) AS amount,
    CASE WHEN debit > 0 THEN CASE WHEN back THEN 'reversed' ELSE 'unmatched' END WHEN settled THEN 'assigned' WHEN verdict = 'no_candidate' THEN 'unmatched' ELSE 'refused' END AS status,
    coalesce(CASE WHEN debit > 0 THEN CASE WHEN NOT back THEN d_outcome END WHEN NOT settled THEN verdict END, '') AS category, CASE WHEN settled THEN tier ELSE '' END AS tier,
    coalesce(payment_ids, CASE WHEN back THEN d_ids END, '') AS payment_ids, coalesce(verdict = 'grouped', false) OR coalesce(d_outcome = 'partially_reversed', false) AS split, {_BANK_SQL} AS bank FROM st0),
st2 AS (SELECT s.txn_id, array_to_string(list_sort(list(DISTINCT p.customer_name)), ',') AS customers, array_to_string(list_sort(list(DISTINCT p.invoice_no) FILTER (p.invoice_no IS NOT NULL)), ',') AS invoices
  FROM (SELECT txn_id, unnest(string_split(payment_ids, ',')) AS payment_id FROM st1) s JOIN pay p USING (payment_id) GROUP BY 1),
st AS MATERIALIZED (SELECT s.*, coalesce(n.customers, '') AS customers, coalesce(n.invoices, '') AS invoices, {_DESK_SQL} AS desk, CASE WHEN status IN ('refused', 'unmatched') THEN amount ELSE 0 END AS at_risk FROM st1 s LEFT JOIN st2 n USING (txn_id)) """


@query("SELECT txn_id, direction, amount, status, category, tier, payment_ids, split, bank, customers, invoices, desk, at_risk FROM st", _STATEMENT)
def flat_transactions(spark, sf_dir):
    return statement(spark, sf_dir).select("txn_id", "direction", "amount", "status", "category", "tier", "payment_ids", "split", "bank", "customers", "invoices", "desk", "at_risk")


@query("""SELECT 'direction' AS facet, direction AS value, count(*) AS n FROM st GROUP BY ALL UNION ALL SELECT 'status', status, count(*) FROM st GROUP BY ALL
UNION ALL SELECT 'category', category, count(*) FROM st WHERE category <> '' GROUP BY ALL UNION ALL SELECT 'bank', bank, count(*) FROM st WHERE bank <> '' GROUP BY ALL""", _STATEMENT)
def transaction_facets(spark, sf_dir):
    """Values present in each of the four facets, counted in one pass over the lines."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("direction", "status", "category", "bank"))))
    return statement(spark, sf_dir).select(pairs.alias("f")).select("f.*").filter("value <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))


@query("SELECT txn_id, amount, category, total, (SELECT sum(at_risk) FROM st WHERE status = 'refused')::BIGINT AS at_risk_in_all FROM (SELECT *, count(*) OVER () AS total FROM st WHERE status = 'refused') ORDER BY amount DESC, txn_id LIMIT 20 OFFSET 3", _STATEMENT)
def transactions_page(spark, sf_dir):
    """One page of refusals by money at risk, with totals over all of them: a limit that is the feature."""
    x = statement(spark, sf_dir).filter("status = 'refused'")
    totals = x.agg(F.count("*").alias("total"), F.sum("at_risk").alias("at_risk_in_all"))  # one row
    return x.orderBy(F.desc("amount"), "txn_id").offset(3).limit(20).join(F.broadcast(totals), F.lit(True)).select("txn_id", "amount", "category", "total", "at_risk_in_all")


@query("SELECT txn_id, amount, customers FROM st WHERE direction = 'credit' AND status IN ('assigned', 'refused') AND (contains(lower(customers), 'lotus') OR contains(lower(invoices), 'lotus')) AND (contains(lower(bank), 'hdfc') OR contains(lower(ref_no), 'hdfc'))", _STATEMENT)
def transactions_filter(spark, sf_dir):
    return filter_transactions(statement(spark, sf_dir), "credit", ("assigned", "refused"), (), "LOTUS", "hdfc").select("txn_id", "amount", "customers")


def filter_transactions(
    rows: DataFrame, direction: str = "", status: tuple[str, ...] = (), category: tuple[str, ...] = (), customer: str = "", bank: str = ""
) -> DataFrame:
    """Rows of a statement; customers are searched with invoice numbers, banks with references, without regard to case.  Unknown directions or statuses are errors."""
    for given, known, what in (((direction,) if direction else (), ("credit", "debit"), "direction"), (status, ("assigned", "refused", "unmatched", "reversed"), "status")):
        if bad := [x for x in given if x.lower() not in known]:
            raise ValueError(f"unknown {what}: {bad[0]}")
    tests = []
    has = set(rows.columns)
    if direction:  # a statement says it, bare lines show it
        tests.append(F.col("direction") == direction.lower() if "direction" in has else F.col(direction.lower()) > 0)
    if status:
        tests.append(F.col("status").isin(*[x.lower() for x in status]))
    if category:
        tests.append(F.col("category").isin(*[x.lower() for x in category]))
    for text, columns in ((customer, ("customers", "invoices", "customer_name")), (bank, ("bank", "ref_no"))):
        if text:
            tests.append(reduce(lambda a, b: a | b, (F.contains(F.lower(c), F.lit(text.lower())) for c in columns if c in has)))
    return rows.filter(reduce(lambda a, b: a & b, tests, F.lit(True)))


# Fixed texts: why a refusal stands, and what to do next.
WHY = {
    "multiple_candidates": ("several sets of payments explain the credit equally well", "compare them with the remittance advice"),
    "solution_cap_reached": ("too many combinations fit for the amount to mean anything", "ask the payer which invoices this covers"),
    "order_dependent_assignment": ("the match changes with the order of the records", "assign by hand and report it"),
    "no_subset_fits": ("no combination of the window's payments adds up to the credit", "look for a missing payment, refund or deduction"),
    "pool_exceeded": ("the window holds too many payments to try every combination", "narrow the window or get the remittance advice"),
    "unexplained_residual": ("the quoted payment settles for another amount", "check for a part payment or a charge"),
    "amount_name_conflict": ("the amount fits, but the name or reference speaks against it", "verify the counterparty"),
    "narration_count_conflict": ("the bank states another number of payments", "get the settlement report of this reference"),
    "contested_payment": ("another credit has as good a claim on the payment", "find whose it is from the remittance advice"),
    "ambiguous_grouping": ("the credit fits several groups of lines", "get the settlement advice of these lines"),
    "no_candidate": ("no payment lies in the window", "look in another period"),
}
_WHY_SQL, _NEXT_SQL = ("CASE verdict " + " ".join("WHEN '{}' THEN '{}'".format(c, w[i].replace("'", "''")) for c, w in WHY.items()) + " END" for i in (0, 1))


@query(f"""SELECT txn_id, verdict AS category, credit AS at_risk, {_WHY_SQL} AS why, {_NEXT_SQL} AS next_step, {_DESK_SQL.replace("CASE category", "CASE verdict")} AS desk, credit >= {P.MATERIALITY} AS material, coalesce(c.n, 0) AS candidates, c.nearest
FROM verdicts v LEFT JOIN (SELECT txn_id, count(*) AS n, arg_min(payment_id, (abs(residual), payment_id)) AS nearest FROM pool GROUP BY 1) c USING (txn_id) WHERE verdict NOT IN ('assign', 'grouped')""", MATCH)
def exception_list(spark, sf_dir):
    """Every refusal with why it stands, the next step, its desk, and the nearest payment of its window."""
    x = outcome(spark, sf_dir).verdicts.filter("verdict not in ('assign', 'grouped')").select("txn_id", F.col("verdict").alias("category"), F.col("credit").alias("at_risk"))
    open_ = _credits(spark, sf_dir).join(x.select("txn_id"), "txn_id", "left_semi")
    pool = M.candidate_pool(open_, _intervals(spark, sf_dir))
    near = pool.groupBy("txn_id").agg(F.count("*").alias("candidates"), F.min_by("payment_id", F.struct(F.abs("residual"), F.col("payment_id"))).alias("nearest"))
    why, then = ({k: v[i] for k, v in WHY.items()} for i in (0, 1))
    return x.join(near, "txn_id", "left").select(
        "txn_id", "category", "at_risk", _lookup(why, F.col("category")).alias("why"), _lookup(then, F.col("category")).alias("next_step"), _lookup(P.DESK_OF, F.col("category")).alias("desk"),
        (F.col("at_risk") >= P.MATERIALITY).alias("material"), F.coalesce("candidates", F.lit(0)).alias("candidates"), "nearest",
    )


@query("""SELECT txn_id, array_to_string([CASE WHEN merchant_ref IS NULL THEN 'no invoice quoted' ELSE 'quotes ' || merchant_ref END, 'window holds ' || coalesce(q.n, 0) || CASE WHEN coalesce(q.n, 0) = 1 THEN ' payment' ELSE ' payments' END,
  CASE WHEN verdict IN ('assign', 'grouped') THEN 'settled by ' || tier || ': ' || replace(payment_ids, ',', ' and ') ELSE 'refused: ' || verdict END], '; ') AS steps
FROM verdicts JOIN parsed USING (txn_id) LEFT JOIN (SELECT txn_id, count(*) AS n FROM pool GROUP BY 1) q USING (txn_id)""", MATCH)
def explanations(spark, sf_dir):
    """One record for each credit of how it was decided; the last round's."""
    n = _pool(spark, sf_dir).groupBy("txn_id").agg(F.count("*").alias("n"))
    x = outcome(spark, sf_dir).verdicts.join(_credits(spark, sf_dir).select("txn_id", "merchant_ref"), "txn_id").join(n, "txn_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    quoted = F.when(F.col("merchant_ref").isNull(), "no invoice quoted").otherwise(F.concat(F.lit("quotes "), "merchant_ref"))
    held = F.concat(F.lit("window holds "), F.col("n").cast("string"), F.when(F.col("n") == 1, " payment").otherwise(" payments"))
    end = F.when(F.col("verdict").isin("assign", "grouped"), F.concat(F.lit("settled by "), "tier", F.lit(": "), F.replace(F.col("payment_ids"), F.lit(","), F.lit(" and ")))).otherwise(F.concat(F.lit("refused: "), "verdict"))
    return x.select("txn_id", F.concat_ws("; ", quoted, held, end).alias("steps"))


@query("""SELECT t1.txn_id, CASE WHEN p.amount <= 0 THEN '' WHEN (p.amount - c.credit) / p.amount > 0.025 THEN 'above' WHEN (p.amount - c.credit) / p.amount < 0.018 THEN 'below' ELSE '' END AS side
FROM t1 JOIN credits c USING (txn_id) JOIN ivl p ON p.payment_id = t1.payment_id WHERE t1.hits = 1 AND abs(t1.residual) > 100""")
def implied_rates(spark, sf_dir):
    """Which side of the fee band a quoted payment's residual implies."""
    t = M.tier1(_credits(spark, sf_dir), _intervals(spark, sf_dir)).filter((F.col("t1_hits") == 1) & (F.abs("t1_residual") > P.TOLERANCE)).select("txn_id", F.col("t1_payment").alias("payment_id"))
    x = t.join(_credits(spark, sf_dir).select("txn_id", "credit"), "txn_id").join(payments(spark, sf_dir).select("payment_id", "amount"), "payment_id")
    return x.select("txn_id", F.regexp_extract(fees.implied_rate_note(F.col("credit"), F.col("amount")), "(above|below)", 1).alias("side"))


@query("SELECT payment_id, amount - true_fee AS net, amount AS gross FROM pay WHERE key % 10 = 3")
def fee_inverse(spark, sf_dir):
    """The fee model turned round: the gross amount that leaves a net, here always the payment's own or one with the same net."""
    net = F.col("amount") - F.col("true_fee")
    found = fees.gross_for(net)
    base, tax = fees.fee_and_tax(found)
    same = F.when(found - base - tax == net, F.col("amount")).otherwise(found)
    return payments(spark, sf_dir).filter("key % 10 = 3").select("payment_id", net.alias("net"), same.alias("gross"))


@query("""SELECT tier, count(*) AS n, count(DISTINCT payment_id) AS n_payments, sum(credit)::BIGINT AS net, sum(amount)::BIGINT AS gross, bool_and(stable) AS stable, count(DISTINCT gid) AS n_groups, sum(back) AS n_reversed
FROM (SELECT v.tier, v.txn_id, p.payment_id, CASE WHEN row_number() OVER (PARTITION BY v.txn_id ORDER BY p.payment_id) = 1 THEN v.credit ELSE 0 END AS credit, CASE WHEN row_number() OVER (PARTITION BY p.payment_id ORDER BY v.txn_id) = 1 THEN p.amount ELSE 0 END AS amount,
  true AS stable, CASE WHEN v.verdict = 'grouped' THEN v.payment_ids END AS gid, CASE WHEN d.credit_id IS NOT NULL AND row_number() OVER (PARTITION BY v.txn_id ORDER BY p.payment_id) = 1 THEN 1 ELSE 0 END AS back
  FROM verdicts v JOIN (SELECT txn_id, unnest(ids) AS payment_id FROM posted) s USING (txn_id) JOIN ivl p USING (payment_id) LEFT JOIN (SELECT DISTINCT credit_id FROM debit_class WHERE credit_id IS NOT NULL) d ON d.credit_id = v.txn_id) GROUP BY 1""".replace("count(*) AS n,", "count(DISTINCT txn_id) AS n,"), MATCH)
def reconciled_summary(spark, sf_dir):
    """What each tier settled: lines, payments, money in and before deductions, groups, and lines taken back since."""
    out = outcome(spark, sf_dir)
    back = out.debits.filter("credit_id is not null").select(F.col("credit_id").alias("txn_id")).distinct().withColumn("back", F.lit(1))
    v = out.verdicts.filter("verdict in ('assign', 'grouped')").join(back, "txn_id", "left")
    lines = v.groupBy("tier").agg(
        F.count("*").alias("n"), F.sum("credit").alias("net"), F.countDistinct(F.when(F.col("verdict") == "grouped", F.col("payment_ids"))).alias("n_groups"), F.sum(F.coalesce("back", F.lit(0))).alias("n_reversed")
    )
    paid = v.select("tier", F.explode(F.split("payment_ids", ",")).alias("payment_id")).distinct().join(_intervals(spark, sf_dir).select("payment_id", "amount"), "payment_id")
    return lines.join(paid.groupBy("tier").agg(F.count("*").alias("n_payments"), F.sum("amount").alias("gross")), "tier").select("tier", "n", "n_payments", "net", "gross", F.lit(True).alias("stable"), "n_groups", "n_reversed")


@query("SELECT txn_id, round(credit / 100.0, 2) AS rupees, payment_ids, tier, verdict FROM verdicts WHERE verdict IN ('assign', 'grouped')", MATCH)
def assignments_payload(spark, sf_dir):
    """The assignments as a run's payload has them."""
    v = outcome(spark, sf_dir).verdicts.filter("verdict in ('assign', 'grouped')")
    return v.select("txn_id", F.round(F.col("credit") / 100.0, 2).alias("rupees"), "payment_ids", "tier", "verdict")


@query("SELECT count(*) AS credits, count(utr) AS with_reference, count(quoted) AS with_invoice, count(txns) AS with_count, count(clean_name) AS with_name, sum(needs_recovery::INT)::BIGINT AS sent_on, sum((needs_recovery AND (recovered_ref IS NOT NULL OR recovered_name IS NOT NULL))::INT)::BIGINT AS recovered FROM parsed")
def parse_yield(spark, sf_dir):
    """What the patterns read, what is sent on to the offline tier, and what that recovers."""
    raw = M.parse(M.credit_lines(bank_lines(spark, sf_dir)), recover=False)
    n = F.col("narration")
    got = F.col("needs_recovery") & (narration.recovered_ref(n).isNotNull() | narration.recovered_name(n).isNotNull())
    return raw.agg(
        F.count("*").alias("credits"), F.count("utr").alias("with_reference"), F.count("merchant_ref").alias("with_invoice"), F.count("txns").alias("with_count"), F.count("payer").alias("with_name"),
        F.sum(F.col("needs_recovery").cast("int")).alias("sent_on"), F.sum(got.cast("int")).alias("recovered"),
    )
