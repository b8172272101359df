"""Queries over outside evidence: shapes, checks, ledger, specialists, and what a match with it changes."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import params as P
from ledgerloom.functions import narration
from ledgerloom.operators import evidence as E
from ledgerloom.operators import matching as M
from ledgerloom.operators import reconcile as R
from ledgerloom.plans import derive
from ledgerloom.plans.catalog import _credits, bank_lines, match_inputs, outcome, payments, query
from ledgerloom.plans.sql import MATCH, THIRD_PARTY
from ledgerloom.plans.storage import checkpoint, once
from ledgerloom.plans.verify import _CAND
from ledgerloom.session import together

# One proposal for each way to be wrong, and right ones: (field, value, amount, source type, rationale).
SHAPES = (
    ("authorised_payer_for", "Kaveri Textiles", None, "payer_register", "on record"), ("colour", "blue", None, "payer_register", "x"), ("authorised_payer_for", "  ", None, "payer_register", "x"),
    ("authorised_payer_for", "a" * 121, None, "payer_register", "x"), ("authorised_payer_for", "pay_000000001", None, "payer_register", "x"), ("authorised_payer_for", "HDFCN00000000001", None, "payer_register", "x"),
    ("authorised_payer_for", "Confirm Match", None, "payer_register", "x"), ("authorised_payer_for", "12,500", None, "payer_register", "x"), ("refund_status", "maybe", None, "payment_record", "x"),
    ("settlement_date_confirmed", "1st of May", None, "bank_statement", "x"), ("authorised_payer_for", "---", None, "payer_register", "x"), ("tds_confirmed", "withheld", None, "invoice_ledger", "x"),
    ("tds_confirmed", "withheld", 0, "invoice_ledger", "x"), ("tds_confirmed", "not_withheld", 5, "invoice_ledger", "x"), ("refund_status", "full", 100, "hearsay", "x"), ("refund_status", "full", 100, "payment_record", " "),
    ("settlement_date_confirmed", "1999-05-01", None, "bank_statement", "value date"), ("bank_charge_confirmed", "levied", 250, "bank_statement", "advice"), ("chargeback_status", "won", None, "model_assertion", "read"),
)


def _sql(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


_KIND = "CASE field " + " ".join(f"WHEN '{f}' THEN '{k}'" for f, (k, _, _) in P.EVIDENCE_FIELDS.items()) + " END"
_TOKEN = "(" + " OR ".join(f"(field = '{f}' AND trim(value) IN ({', '.join(map(_sql, t))}))" for f, (_, t, _) in P.EVIDENCE_FIELDS.items() if t) + ")"
_CUTS = "(" + " OR ".join(f"(field = '{f}' AND value IN ({', '.join(map(_sql, t))}))" for f, (_, _, t) in P.EVIDENCE_FIELDS.items() if t) + ")"
_SHAPE = f"""CASE WHEN {_KIND} IS NULL THEN 'unknown_field' WHEN trim(coalesce(value, '')) = '' THEN 'empty_value' WHEN length(trim(value)) > 120 THEN 'too_long' WHEN regexp_matches(trim(value), '{P.ID_SHAPES}') THEN 'names_a_record'
WHEN replace(lower(trim(value)), ' ', '_') IN ({", ".join(map(_sql, P.VERDICT_WORDS))}) THEN 'verdict_word' WHEN regexp_matches(trim(value), '{P.BARE_NUMBER}') THEN 'bare_number'
WHEN {_KIND} = 'token' AND NOT {_TOKEN} THEN 'not_a_token' WHEN {_KIND} = 'date' AND NOT regexp_matches(trim(value), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN 'not_a_date' WHEN {_KIND} = 'name' AND NOT regexp_matches(value, '[A-Za-z]') THEN 'not_a_name'
WHEN {_CUTS} AND amount IS NULL THEN 'amount_missing' WHEN {_CUTS} AND amount <= 0 THEN 'amount_not_positive' WHEN NOT {_CUTS} AND amount IS NOT NULL THEN 'amount_unread'
WHEN source_type NOT IN ({", ".join(map(_sql, P.EVIDENCE_SOURCES))}) THEN 'unknown_source' WHEN trim(coalesce(rationale, '')) = '' THEN 'no_rationale' END"""


@query(f", shapes(field, value, amount, source_type, rationale) AS (VALUES {', '.join('(' + ', '.join(map(_sql, s)) + ')' for s in SHAPES)}) SELECT field, value, amount::BIGINT AS amount, source_type, rationale, {_SHAPE} AS reason FROM shapes")
def evidence_shapes(spark, sf_dir):
    """What a proposal may look like: the first rule that each of these breaks."""
    rows = spark.createDataFrame(list(SHAPES), "field string, value string, amount long, source_type string, rationale string")
    return rows.withColumn("reason", E.shape_error())


_REGISTER = ", ".join(f"('{THIRD_PARTY} PVT LTD', '{f}')" for f in derive.FAMILIES[::2]) + f", ('SUNSET HOLDINGS', '{derive.FAMILIES[1]}')"


def _folds(name: str) -> list[str]:
    base = f"regexp_replace(upper({name}), '[^A-Z0-9 ]', '', 'g')"
    cut = base
    for e in P.COMPANY_ENDINGS:
        cut = f"regexp_replace({cut}, '{e}$', '')"
    return [f"trim(regexp_replace({x}, ' +', ' ', 'g'))" for x in (cut, base)]


def _same(a: str, b: str) -> str:
    """SQL of ``same_entity``."""

    def one(x: str, y: str) -> str:
        s, g = f"(CASE WHEN length({x}) > length({y}) THEN {y} ELSE {x} END)", f"(CASE WHEN length({x}) > length({y}) THEN {x} ELSE {y} END)"
        p, q = f"string_split({s}, ' ')", f"string_split({g}, ' ')"
        heads = f"list_slice({p}, 1, len({p}) - 1) = list_slice({q}, 1, len({p}) - 1)"
        return f"({x} <> '' AND {y} <> '' AND ({x} = {y} OR (length({s}) >= {P.ENTITY_FLOOR} AND len({p}) <= len({q}) AND {heads} AND starts_with({q}[len({p})], {p}[len({p})]))))"

    return "(" + " OR ".join(one(x, y) for x in _folds(a) for y in _folds(b)) + ")"


_NAMES = ("SUNRISE HOLDINGS", "SUNRISE HOLDING", "Sunrise Holdings Private Limited", "SUNRIS", "SUNSET HOLD", "BHARAT TRADERS", "BHARATI TRADERS LLP", "ACME RETAIL", "ACME RETAIL STORES PVT LTD", "ACME INDUSTRIAL", "VERTEX ENGINEERIN", "Vertex Engineering and Co", "")


@query(f"SELECT a.n AS a, b.n AS b, coalesce({_same('a.n', 'b.n')}, false) AS same FROM (SELECT unnest({list(_NAMES)}) AS n) a, (SELECT unnest({list(_NAMES)}) AS n) b")
def entity_equality(spark, sf_dir):
    """Names cut short by a bank against whole ones, near-namesakes among them: a short fixed list against itself."""
    rows = [(a, b) for a in _NAMES for b in _NAMES]
    return spark.createDataFrame(rows, "a string, b string").withColumn("same", narration.same_entity(F.col("a"), F.col("b")))


_LOOKUP = f""", reg(payer_name, customer) AS (VALUES {_REGISTER}), payers AS (SELECT DISTINCT payer FROM parsed WHERE payer IS NOT NULL),
hit AS (SELECT DISTINCT p.payer, r.payer_name, r.customer FROM payers p, reg r WHERE {_same("p.payer", "r.payer_name")}),
found AS MATERIALIZED (SELECT p.payer, count(DISTINCT h.payer_name) AS n_registered, CASE WHEN count(DISTINCT h.payer_name) = 1 THEN min(h.payer_name) END AS registered,
  CASE WHEN count(DISTINCT h.payer_name) = 1 THEN list_sort(list(DISTINCT h.customer)) END AS customers FROM payers p LEFT JOIN hit h USING (payer) GROUP BY 1)"""


def _found(spark, sf_dir) -> DataFrame:
    return E.lookup(_credits(spark, sf_dir).filter("payer is not null"), derive.register(spark))


@query(_LOOKUP + " SELECT payer, n_registered, registered, array_to_string(customers, ',') AS customers FROM found")
def register_lookup(spark, sf_dir):
    """Every payer on the statement against the register of who may pay for whom."""
    return _found(spark, sf_dir).withColumn("customers", F.array_join("customers", ","))


_CONFLICT = ", conflict AS MATERIALIZED (SELECT c.txn_id, c.payment_id, d.payer, p.customer_name AS customer FROM cascade c JOIN ev e USING (txn_id) JOIN parsed d USING (txn_id) JOIN ivl p USING (payment_id) WHERE (coalesce(e.name_level = 0, false) OR coalesce(e.ref_level = 0, false)) AND e.field_weight < 0)"
_READ = "((SELECT max(txn_date) FROM bank) - 30)::VARCHAR"


def _conflicts(spark, sf_dir) -> DataFrame:
    """Credits whose single fit the names or references speak against."""
    w = match_inputs(spark, sf_dir).proposed.filter("verdict = 'amount_name_conflict' and tier <> 'tier3_subsetsum'")
    known = _credits(spark, sf_dir).select("txn_id", "payer")
    return w.select("txn_id", F.col("payment_ids").alias("payment_id")).join(known, "txn_id").join(payments(spark, sf_dir).select("payment_id", F.col("customer_name").alias("customer")), "payment_id")


def _read_at(spark, sf_dir):
    """When the records were read: a month before the statement ends."""
    last = bank_lines(spark, sf_dir).agg(F.date_sub(F.max("txn_date"), 30).cast("string").alias("d")).first()["d"]
    return F.lit(last)


def _proposals(spark, sf_dir) -> DataFrame:
    def make() -> DataFrame:
        read = _read_at(spark, sf_dir)
        dates = match_inputs(spark, sf_dir).proposed.filter("verdict = 'unexplained_residual'").select("txn_id").join(bank_lines(spark, sf_dir), "txn_id")
        return checkpoint(E.investigate(_conflicts(spark, sf_dir), _found(spark, sf_dir), read).unionByName(E.investigate_dates(dates, read)))

    return once(spark, sf_dir, "proposals", make)


@query(_CAND + _CONFLICT + _LOOKUP + f""" SELECT c.txn_id, CASE WHEN d IS NULL THEN 'authorised_payer_for' END AS field, CASE WHEN d IS NULL THEN customer END AS value, CASE WHEN d IS NULL THEN registered END AS source_ref, CASE WHEN d IS NULL THEN {_READ} END AS retrieved_at, d AS declined
FROM (SELECT c.*, f.registered, CASE WHEN f.n_registered = 0 THEN 'payer_not_registered' WHEN f.n_registered > 1 THEN 'several_payers' WHEN NOT list_contains(f.customers, c.customer) AND len(list_filter(f.customers, lambda v: regexp_replace(v, ' (PVT LTD|LLP)$', '') = regexp_replace(c.customer, ' (PVT LTD|LLP)$', ''))) = 0 THEN 'registered_for_others' END AS d FROM conflict c JOIN found f USING (payer)) c
UNION ALL SELECT b.txn_id, CASE WHEN b.value_date <> b.txn_date THEN 'settlement_date_confirmed' END, CASE WHEN b.value_date <> b.txn_date THEN b.value_date::VARCHAR END, CASE WHEN b.value_date <> b.txn_date THEN b.ref_no END, CASE WHEN b.value_date <> b.txn_date THEN {_READ} END, CASE WHEN b.value_date = b.txn_date THEN 'same_date' END
FROM cascade v JOIN credits b USING (txn_id) WHERE v.verdict = 'unexplained_residual'""")
def specialist_proposals(spark, sf_dir):
    """What the deterministic specialists propose, and where they decline."""
    return _proposals(spark, sf_dir).select("txn_id", "field", "value", "source_ref", "retrieved_at", "declined")


# Proposals of every kind, right and wrong, by the key of a credit.
_MADE = f"""made0 AS (SELECT key, key % 12 AS r, txn_id, txn_date, ref_no, credit FROM credits WHERE length(txn_id) = 12),
made1 AS (SELECT *, 1 AS turn FROM made0 UNION ALL SELECT *, 2 FROM made0 WHERE key % 24 = 0),
made AS MATERIALIZED (SELECT key * 10 + turn AS at_, CASE WHEN r = 10 THEN 'bt_missing' || key ELSE txn_id END AS txn_id,
  CASE WHEN r IN (0, 1, 8, 9, 10) THEN 'authorised_payer_for' WHEN r IN (2, 3, 4) THEN 'settlement_date_confirmed' WHEN r = 5 THEN 'tds_confirmed' WHEN r = 6 THEN 'refund_status' WHEN r = 7 THEN 'bank_charge_confirmed' ELSE 'credit_note_confirmed' END AS field,
  CASE WHEN r IN (0, 1, 9, 10) THEN 'KAVERI TEXTILES' WHEN r = 8 THEN 'assigned' WHEN r = 2 THEN (txn_date - 2)::VARCHAR WHEN r = 3 THEN (txn_date + 3)::VARCHAR WHEN r = 4 THEN (txn_date - 30)::VARCHAR WHEN r = 5 THEN 'withheld' WHEN r = 6 THEN 'partial' WHEN r = 7 THEN 'levied' ELSE 'issued' END AS value,
  CASE WHEN r IN (5, 6) THEN 100 WHEN r IN (7, 11) THEN 500 END::BIGINT AS amount,
  CASE WHEN r IN (0, 1, 8, 9, 10) THEN 'payer_register' WHEN r IN (2, 3, 4, 11) THEN 'bank_statement' WHEN r = 5 THEN 'invoice_ledger' WHEN r = 6 THEN 'payment_record' ELSE 'model_assertion' END AS source_type,
  CASE WHEN r = 1 THEN 'NOBODY' WHEN r IN (0, 8, 9, 10) THEN '{THIRD_PARTY} PVT LTD' WHEN r IN (2, 3, 4, 11) THEN ref_no WHEN r = 5 THEN 'INV-NONE' WHEN r = 6 THEN 'pay_' || lpad(key::VARCHAR, 9, '0') ELSE '' END AS source_ref,
  CASE WHEN r = 9 THEN ((SELECT max(txn_date) FROM bank) - 500)::VARCHAR ELSE {_READ} END AS retrieved_at, 'read' AS rationale FROM made1)"""
_CHECKED = ", " + _MADE + f""", reg(payer_name, customer) AS (VALUES {_REGISTER}), shaped AS (SELECT *, {_SHAPE} AS shape, {_CUTS} AS cuts FROM made), seen AS (SELECT m.*, c.credit AS c_credit, c.txn_date AS c_date, p.refunded, p.amount AS gross, o.payment_id AS near FROM shaped m LEFT JOIN credits c USING (txn_id)
  LEFT JOIN pay p ON p.payment_id = m.source_ref LEFT JOIN pool o ON o.txn_id = m.txn_id AND o.payment_id = m.source_ref),
ruled AS (SELECT *, CASE WHEN shape IS NOT NULL THEN shape WHEN c_credit IS NULL THEN 'unknown_txn' WHEN source_type = 'model_assertion' AND cuts THEN 'needs_external_source'
  WHEN source_type = 'invoice_ledger' AND source_ref NOT IN (SELECT invoice_no FROM inv) THEN 'no_such_record' WHEN source_type = 'payment_record' AND gross IS NULL THEN 'no_such_record' WHEN source_type = 'payment_record' AND near IS NULL THEN 'unreachable_record'
  WHEN source_type = 'bank_statement' AND source_ref NOT IN (SELECT ref_no FROM bank) THEN 'no_such_record' WHEN source_type = 'payer_register' AND source_ref NOT IN (SELECT payer_name FROM reg) THEN 'no_such_record'
  WHEN retrieved_at::DATE < (SELECT max(txn_date) FROM bank) - {P.EVIDENCE_STALE_DAYS} THEN 'stale_source' WHEN field = 'refund_status' AND refunded NOT IN (0, amount) THEN 'contradicts_ledger' WHEN field = 'refund_status' AND amount > gross THEN 'exceeds_payment'
  WHEN field = 'settlement_date_confirmed' AND value::DATE > c_date THEN 'after_the_credit' WHEN field = 'settlement_date_confirmed' AND c_date - value::DATE > {P.LOOKBACK_DAYS + P.EVIDENCE_SLACK_DAYS} THEN 'outside_the_window'
  WHEN cuts AND source_type = 'payment_record' AND refunded = 0 THEN 'no_amount_named' WHEN cuts AND source_type = 'payment_record' THEN 'already_subtracted' WHEN cuts THEN 'no_amount_named' END AS reason0 FROM seen),
checked AS MATERIALIZED (SELECT *, CASE WHEN reason0 IS NULL AND row_number() OVER (PARTITION BY txn_id, field, reason0 IS NULL ORDER BY at_) > 1 THEN 'duplicate' ELSE reason0 END AS reason FROM ruled) """


def _made(spark, sf_dir) -> DataFrame:
    c = _credits(spark, sf_dir).filter(F.length("txn_id") == 12).withColumn("r", F.col("key") % 12).withColumn("turn", F.lit(1))
    c = c.unionByName(c.filter("key % 24 = 0").withColumn("turn", F.lit(2)))
    r, read = F.col("r"), _read_at(spark, sf_dir)
    last = bank_lines(spark, sf_dir).agg(F.date_sub(F.max("txn_date"), 500).cast("string").alias("d")).first()["d"]
    payer, dated = r.isin(0, 1, 8, 9, 10), r.isin(2, 3, 4)
    value = (
        F.when(r == 8, "assigned").when(payer, "KAVERI TEXTILES").when(r == 2, F.date_sub("txn_date", 2).cast("string")).when(r == 3, F.date_add("txn_date", 3).cast("string"))
        .when(r == 4, F.date_sub("txn_date", 30).cast("string")).when(r == 5, "withheld").when(r == 6, "partial").when(r == 7, "levied").otherwise("issued")
    )
    field = F.when(payer, "authorised_payer_for").when(dated, "settlement_date_confirmed").when(r == 5, "tds_confirmed").when(r == 6, "refund_status").when(r == 7, "bank_charge_confirmed").otherwise("credit_note_confirmed")
    source = F.when(payer, "payer_register").when(dated | (r == 11), "bank_statement").when(r == 5, "invoice_ledger").when(r == 6, "payment_record").otherwise("model_assertion")
    ref = (
        F.when(r == 1, "NOBODY").when(payer, THIRD_PARTY + " PVT LTD").when(dated | (r == 11), F.col("ref_no")).when(r == 5, "INV-NONE")
        .when(r == 6, F.concat(F.lit("pay_"), F.lpad(F.col("key").cast("string"), 9, "0"))).otherwise("")
    )
    return c.select(
        (F.col("key") * 10 + F.col("turn")).alias("at"), F.when(r == 10, F.concat(F.lit("bt_missing"), F.col("key").cast("string"))).otherwise(F.col("txn_id")).alias("txn_id"), field.alias("field"), value.alias("value"),
        F.when(r.isin(5, 6), 100).when(r.isin(7, 11), 500).cast("long").alias("amount"), source.alias("source_type"), ref.alias("source_ref"), F.when(r == 9, F.lit(last)).otherwise(read).alias("retrieved_at"), F.lit("read").alias("rationale"),
    )


def _checked(spark, sf_dir) -> DataFrame:
    def make() -> DataFrame:
        made, pay = _made(spark, sf_dir), payments(spark, sf_dir)
        named = M.named_candidates(made.filter("source_type in ('invoice_ledger', 'payment_record')"), _credits(spark, sf_dir), pay.filter("captured"))
        return checkpoint(E.validate(made, bank_lines(spark, sf_dir), pay, named, derive.register(spark)))

    return once(spark, sf_dir, "checked-evidence", make)


@query(_CHECKED + "SELECT at_ AS at, txn_id, field, reason FROM checked")
def evidence_checks(spark, sf_dir):
    """The first check that each proposal fails against the batch, or none."""
    return _checked(spark, sf_dir).select("at", "txn_id", "field", "reason")


@query(_CHECKED + "SELECT txn_id, field, value, source_type FROM checked WHERE reason IS NULL")
def evidence_ledger(spark, sf_dir):
    """The accepted evidence: the first of each credit and field."""
    return E.ledger(_checked(spark, sf_dir))[0].select("txn_id", "field", "value", "source_type")


@query(_CHECKED + "SELECT txn_id, 0::BIGINT AS declared, max(CASE WHEN field = 'settlement_date_confirmed' THEN value::DATE END) AS settled_on, max(CASE WHEN field = 'authorised_payer_for' THEN value END) AS authorised_for FROM checked WHERE reason IS NULL GROUP BY 1")
def evidence_facts(spark, sf_dir):
    """What the matcher reads of the ledger: declared deductions, settlement date, customer that the payer may pay for."""
    return E.facts(E.ledger(_checked(spark, sf_dir))[0])


_ROLES = "CASE category " + " ".join(f"WHEN '{c}' THEN '{','.join(r)}'" for c, r in P.SPECIALISTS.items()) + " ELSE '' END"


@query(f"SELECT category, count(*) AS n, sum(credit)::BIGINT AS at_risk, {_ROLES} AS roles, category IN ({', '.join(map(_sql, P.NEVER_INVESTIGATED))}) AS never FROM (SELECT verdict AS category, credit FROM verdicts WHERE verdict NOT IN ('assign', 'grouped')) GROUP BY 1", MATCH)
def specialist_routing(spark, sf_dir):
    """Who may look into what the match refused."""
    x = outcome(spark, sf_dir).verdicts.filter("verdict not in ('assign', 'grouped')").groupBy(F.col("verdict").alias("category"))
    return E.route(x.agg(F.count("*").alias("n"), F.sum("credit").alias("at_risk")))


def orchestrate(
    base: R.Outcome | Callable[[], R.Outcome], proposals: DataFrame, rerun: Callable[[DataFrame], R.Outcome], checkpoint_: Callable[[DataFrame], DataFrame], budget: int | None = None, hold: int = P.MATERIALITY,
    beside: Callable[[DataFrame], object] | None = None,
) -> tuple[R.Outcome, DataFrame, DataFrame]:
    """(match with evidence, accepted evidence, credits held back).

    Proposals rank by the credit at risk; ``budget`` limits how many credits
    are looked into.  A credit of ``hold`` or more that only evidence settles
    is held for approval: its evidence is withheld and the match runs
    again without it.  A ``base`` that is still to be made (a function) is
    matched beside the first match with evidence; ``beside`` is called with the
    evidence that is left, beside the last match, if there is a second one.
    """
    make = base if callable(base) else lambda: base
    accepted = proposals.filter("declined is null").drop("declined")
    if budget is not None:
        made = make()
        make = lambda: made
        first = accepted.join(made.verdicts.select("txn_id", "credit"), "txn_id").orderBy(F.desc("credit"), "txn_id").select("txn_id").limit(budget)
        accepted = accepted.join(first, "txn_id", "left_semi")
    accepted = checkpoint_(accepted)
    settled = "verdict in ('assign', 'grouped')"
    base, after = together(make, lambda: rerun(E.facts(accepted)))
    new = after.verdicts.filter(settled).join(base.verdicts.filter(settled).select("txn_id"), "txn_id", "left_anti")
    held = checkpoint_(new.filter(F.col("credit") >= hold).select("txn_id").join(accepted.select("txn_id").distinct(), "txn_id", "left_semi"))
    if not held.isEmpty():
        accepted = checkpoint_(E.without(accepted, held))
        after = together(lambda: rerun(E.facts(accepted)), *([partial(beside, accepted)] if beside else []))[0]
    return after, accepted, held


def withdraw(base: R.Outcome, after: R.Outcome, accepted: DataFrame, truth: DataFrame, rerun: Callable[[DataFrame], R.Outcome]) -> R.Outcome:
    """The match with evidence, or without the evidence of wrong new assignments where precision fell: (truth: txn_id, payment_ids)."""
    settled = "verdict in ('assign', 'grouped')"

    def right(o: R.Outcome) -> DataFrame:
        x = o.verdicts.filter(settled).select("txn_id", F.col("payment_ids").alias("got")).join(truth, "txn_id")
        return x.withColumn("right", F.array_sort(F.split("got", ",")) == F.array_sort(F.split("payment_ids", ",")))

    share = [right(o).agg(F.avg(F.col("right").cast("int")).alias("p")).first()["p"] or 0.0 for o in (base, after)]
    if share[1] >= share[0]:
        return after
    wrong = right(after).filter("not right").join(base.verdicts.filter(settled).select("txn_id"), "txn_id", "left_anti")
    return rerun(E.facts(E.without(accepted, wrong)))


def verdict_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Full outer difference of two sets of verdicts by credit."""
    a = before.select("txn_id", F.col("verdict").alias("before"), F.col("payment_ids").alias("ids_before"))
    b = after.select("txn_id", F.col("verdict").alias("after"), F.col("payment_ids").alias("ids_after"))
    return a.join(b, "txn_id", "full").filter(~F.col("before").eqNullSafe(F.col("after")) | ~F.col("ids_before").eqNullSafe(F.col("ids_after")))


#: Credits below this are taken as approved in the queries: the derived amounts are far above the usual bound.
APPROVED = 30_000_000


def _with_evidence(spark, sf_dir, beside: Callable[[DataFrame], object] | None = None) -> tuple[R.Outcome, DataFrame, DataFrame]:
    given = match_inputs(spark, sf_dir)
    rerun = lambda facts: R.match(given, checkpoint, facts)
    return once(spark, sf_dir, "with-evidence", lambda: orchestrate(lambda: outcome(spark, sf_dir), _proposals(spark, sf_dir), rerun, checkpoint, hold=APPROVED, beside=beside))


@query()
def evidence_changes(spark, sf_dir):
    """Verdicts that the specialists' evidence changes, large credits held back; tested for what may change at all."""
    after = _with_evidence(spark, sf_dir)[0]
    return verdict_changes(outcome(spark, sf_dir).verdicts, after.verdicts)


@query()
def source_contributions(spark, sf_dir):
    """Verdicts that each kind of source changes: the match with all evidence against one without that source."""

    def without(accepted: DataFrame) -> list[tuple[str, R.Outcome]]:
        """The matches less one source each, side by side."""
        sources = sorted(r["source_type"] for r in accepted.select("source_type").distinct().collect())  # five kinds at most
        rest = lambda s: E.facts(accepted.filter(F.col("source_type") != s))
        less = [partial(once, spark, sf_dir, f"without-{s}", lambda s=s: R.match(match_inputs(spark, sf_dir), checkpoint, rest(s))) for s in sources]
        return list(zip(sources, together(*less) if less else (), strict=True))

    after, accepted, _ = _with_evidence(spark, sf_dir, without)
    out = spark.createDataFrame([], "source_type string, proposals long, changed long")
    for s, less in without(accepted):
        n = accepted.filter(F.col("source_type") == s).agg(F.count("*").alias("proposals"))
        changed = verdict_changes(less.verdicts, after.verdicts).agg(F.count("*").alias("changed"))
        out = out.unionByName(n.join(changed, F.lit(True)).select(F.lit(s).alias("source_type"), "proposals", "changed"))
    return out


def source_of(tool_calls: DataFrame) -> DataFrame:
    """Adds the record that a logged tool call read, by the call's name."""
    names = {"lookup_payer": "payer_register", "invoice": "invoice_ledger", "payment": "payment_record", "statement": "bank_statement"}
    call = F.lower(F.regexp_extract("call", r"^(\w+)", 1))
    out = F.lit("model_assertion")
    for word, source in reversed(names.items()):
        out = F.when(F.contains(call, F.lit(word)), source).otherwise(out)
    return tool_calls.withColumn("source_type", out)


