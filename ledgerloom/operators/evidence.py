"""Outside evidence about single credits: proposals, their checks, an append-only ledger, and what the matcher reads of it.

A proposal is (at, txn_id, field, value, amount, source_type, source_ref,
retrieved_at, rationale); ``at`` orders them.  Evidence never names a payment
and never decides: it changes what the next match has to explain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import params as P
from ledgerloom.functions import narration
from ledgerloom.operators import matching as M


def _deducting() -> Column:
    """Whether a proposal says that money was kept back."""
    out = F.lit(False)
    for field, (_, _, tokens) in P.EVIDENCE_FIELDS.items():
        if tokens:
            out = out | ((F.col("field") == field) & F.col("value").isin(*tokens))
    return F.coalesce(out, F.lit(False))


def shape_error() -> Column:
    """The first thing wrong with a proposal by itself, or null: cheap checks that need no other table."""
    value = F.trim(F.coalesce("value", F.lit("")))
    kind = F.lit(None).cast("string")
    known = F.lit(False)
    for field, (k, tokens, _) in P.EVIDENCE_FIELDS.items():
        kind = F.when(F.col("field") == field, k).otherwise(kind)
        if k == "token":
            known = known | ((F.col("field") == field) & value.isin(*tokens))
    return (
        F.when(kind.isNull(), "unknown_field").when(value == "", "empty_value").when(F.length(value) > 120, "too_long").when(value.rlike(P.ID_SHAPES), "names_a_record")
        .when(F.translate(F.lower(value), " ", "_").isin(*P.VERDICT_WORDS), "verdict_word").when(value.rlike(P.BARE_NUMBER), "bare_number")
        .when((kind == "token") & ~known, "not_a_token").when((kind == "date") & ~value.rlike(r"^\d{4}-\d{2}-\d{2}$"), "not_a_date").when((kind == "name") & ~value.rlike("[A-Za-z]"), "not_a_name")
        .when(_deducting() & F.col("amount").isNull(), "amount_missing").when(_deducting() & (F.col("amount") <= 0), "amount_not_positive").when(~_deducting() & F.col("amount").isNotNull(), "amount_unread")
        .when(~F.coalesce(F.col("source_type").isin(*P.EVIDENCE_SOURCES), F.lit(False)), "unknown_source").when(F.trim(F.coalesce("rationale", F.lit(""))) == "", "no_rationale")
    )


def validate(proposals: DataFrame, bank: DataFrame, payments: DataFrame, pool: DataFrame, register: DataFrame) -> DataFrame:
    """Adds ``reason``, the first check that a proposal fails, or null.

    ``pool`` is (txn_id, payment_id) of candidates.  A later proposal for a
    credit and field that has an accepted one is a duplicate.
    """
    credit = M.credit_lines(bank).select("txn_id", F.col("credit").alias("_credit"), F.col("txn_date").alias("_date"))
    horizon = bank.agg(F.max("txn_date").alias("_horizon"))
    inv = payments.filter("invoice_no is not null").groupBy("invoice_no").agg(F.max("tds").alias("_tds")).withColumnRenamed("invoice_no", "source_ref")
    pay = payments.select(F.col("payment_id").alias("source_ref"), F.col("refunded").alias("_refunded"), F.col("amount").alias("_gross"))
    reach = pool.join(payments.select("payment_id", "invoice_no"), "payment_id")
    by_inv = reach.filter("invoice_no is not null").select("txn_id", F.col("invoice_no").alias("source_ref")).distinct().withColumn("_inv_near", F.lit(True))
    by_pay = reach.select("txn_id", F.col("payment_id").alias("source_ref")).distinct().withColumn("_pay_near", F.lit(True))
    refs = bank.select(F.col("ref_no").alias("source_ref")).distinct().withColumn("_line", F.lit(True))
    payers = register.select(F.col("payer_name").alias("source_ref")).distinct().withColumn("_payer", F.lit(True))
    x = proposals.withColumn("_shape", shape_error()).join(credit, "txn_id", "left").join(horizon, F.lit(True))
    for t in (inv, pay, refs, payers):
        x = x.join(t, "source_ref", "left")
    x = x.join(by_inv, ["txn_id", "source_ref"], "left").join(by_pay, ["txn_id", "source_ref"], "left")
    source, amount, cut = F.col("source_type"), F.col("amount"), _deducting()
    ref = F.trim(F.coalesce("source_ref", F.lit("")))
    read, settled = F.try_to_date("retrieved_at"), F.try_to_date("value")
    is_date, outside = F.col("field") == "settlement_date_confirmed", source != "model_assertion"
    lag = F.datediff("_date", settled)
    found = (
        F.when(F.col("_shape").isNotNull(), F.col("_shape")).when(F.col("_credit").isNull(), "unknown_txn")
        .when(~outside & cut, "needs_external_source").when(outside & (ref == ""), "source_ref_missing")
        .when((source == "invoice_ledger") & F.col("_tds").isNull(), "no_such_record").when((source == "invoice_ledger") & F.col("_inv_near").isNull(), "unreachable_record")
        .when((source == "payment_record") & F.col("_gross").isNull(), "no_such_record").when((source == "payment_record") & F.col("_pay_near").isNull(), "unreachable_record")
        .when((source == "bank_statement") & F.col("_line").isNull(), "no_such_record").when((source == "payer_register") & F.col("_payer").isNull(), "no_such_record")
        .when(outside & F.col("retrieved_at").isNull(), "undated_source").when(F.col("retrieved_at").isNotNull() & read.isNull(), "undated_source")
        .when(read < F.date_sub("_horizon", P.EVIDENCE_STALE_DAYS), "stale_source")
        .when((F.col("field") == "tds_confirmed") & amount.isNotNull() & (F.col("_tds") != amount), "contradicts_ledger")
        .when((F.col("field") == "refund_status") & amount.isNotNull() & ~F.col("_refunded").isin(0) & (F.col("_refunded") != amount), "contradicts_ledger")
        .when((F.col("field") == "refund_status") & (amount > F.col("_gross")), "exceeds_payment")
        .when(is_date & settled.isNull(), "not_a_date").when(is_date & (lag < 0), "after_the_credit").when(is_date & (lag > P.LOOKBACK_DAYS + P.EVIDENCE_SLACK_DAYS), "outside_the_window")
        .when(cut & (source == "payment_record") & (F.col("_refunded") == 0), "no_amount_named")
        .when(cut & (source == "payment_record"), "already_subtracted").when(cut & (source == "invoice_ledger") & (F.col("field") == "tds_confirmed"), "already_subtracted")
        .when(cut, "no_amount_named")
    )
    x = x.withColumn("reason", found)
    first = Window.partitionBy("txn_id", "field", F.col("reason").isNull()).orderBy("at")
    x = x.withColumn("reason", F.when(F.col("reason").isNull() & (F.row_number().over(first) > 1), "duplicate").otherwise(F.col("reason")))
    return x.select(*proposals.columns, "reason")


def ledger(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): the accepted are one for each credit and field; the rejected keep their reasons."""
    return validated.filter("reason is null").drop("reason"), validated.filter("reason is not null")


def without(accepted: DataFrame, txns: DataFrame) -> DataFrame:
    """The ledger less what it says of some credits."""
    return accepted.join(txns.select("txn_id").distinct(), "txn_id", "left_anti")


def facts(accepted: DataFrame) -> DataFrame:
    """(txn_id, declared, settled_on, authorised_for): what the matcher reads; anything else says nothing."""
    declared = F.sum(F.when(_deducting(), F.greatest(F.coalesce("amount", F.lit(0)), F.lit(0))).otherwise(0)).cast("long")
    on = F.max(F.when(F.col("field") == "settlement_date_confirmed", F.try_to_date("value")))
    payer = F.max(F.when(F.col("field") == "authorised_payer_for", F.col("value")))
    out = accepted.groupBy("txn_id").agg(declared.alias("declared"), on.alias("settled_on"), payer.alias("authorised_for"))
    return out.filter("declared > 0 or settled_on is not null or authorised_for is not null")


def _starts(name: Column) -> Column:
    """Keys that two spellings of one entity share: eight letters from the front, with and without the company form."""
    return F.explode(F.array_distinct(F.array(*(F.substring(narration._folded(name, s), 1, P.ENTITY_FLOOR) for s in (True, False)))))


def lookup(payers: DataFrame, register: DataFrame) -> DataFrame:
    """(payer, n_registered, registered, customers) of distinct bank payers: more than one registered payer leaves it open.

    Equal or cut-short names share their first letters, so the comparison is
    an equi-join on those, decided by the whole names.
    """
    a = payers.select("payer").distinct().withColumn("start", _starts(F.col("payer")))
    b = register.withColumn("start", _starts(F.col("payer_name")))
    hit = a.join(b, "start").filter(narration.same_entity(F.col("payer"), F.col("payer_name"))).select("payer", "payer_name", "authorised_for_customer").distinct()
    found = hit.groupBy("payer").agg(
        F.countDistinct("payer_name").alias("n_registered"), F.min("payer_name").alias("registered"), F.array_sort(F.collect_set("authorised_for_customer")).alias("customers")
    )
    one = F.col("n_registered") == 1
    return payers.select("payer").distinct().join(found, "payer", "left").select(
        "payer", F.coalesce("n_registered", F.lit(0)).alias("n_registered"), F.when(one, F.col("registered")).alias("registered"), F.when(one, F.col("customers")).alias("customers")
    )


def route(refusals: DataFrame) -> DataFrame:
    """Adds who may look into a refusal's category, in order, and whether nobody may."""
    roles = F.try_element_at(F.create_map(*[x for k, v in P.SPECIALISTS.items() for x in (F.lit(k), F.lit(",".join(v)))]), F.col("category"))
    return refusals.withColumns({"roles": F.coalesce(roles, F.lit("")), "never": F.col("category").isin(*P.NEVER_INVESTIGATED)})


def investigate(conflicts: DataFrame, found: DataFrame, retrieved_at: Column) -> DataFrame:
    """The invoice specialist: proposes the ledger's customer where the register lets the bank's payer pay for it, else declines.

    ``conflicts``: (txn_id, payer, customer); ``found`` comes from :func:`lookup`.
    """
    allowed = F.exists("customers", lambda c: narration.normalise_name(c) == narration.normalise_name(F.col("customer")))
    why = F.when(F.col("n_registered") == 0, "payer_not_registered").when(F.col("n_registered") > 1, "several_payers").when(~allowed, "registered_for_others")
    x = conflicts.join(found, "payer").withColumn("declined", why)
    asks = F.col("declined").isNull()
    return x.select(
        "txn_id", F.when(asks, "authorised_payer_for").alias("field"), F.when(asks, F.col("customer")).alias("value"), F.lit(None).cast("long").alias("amount"),
        F.when(asks, "payer_register").alias("source_type"), F.when(asks, F.col("registered")).alias("source_ref"), F.when(asks, retrieved_at).alias("retrieved_at"),
        F.when(asks, "the register lets this payer settle for the customer").alias("rationale"), "declined",
    )


def investigate_dates(lines: DataFrame, retrieved_at: Column) -> DataFrame:
    """The bank specialist: a value date other than the booking date is when the money was settled; without one it declines."""
    asks = F.col("value_date") != F.col("txn_date")
    return lines.select(
        "txn_id", F.when(asks, "settlement_date_confirmed").alias("field"), F.when(asks, F.col("value_date").cast("string")).alias("value"), F.lit(None).cast("long").alias("amount"),
        F.when(asks, "bank_statement").alias("source_type"), F.when(asks, F.col("ref_no")).alias("source_ref"), F.when(asks, retrieved_at).alias("retrieved_at"),
        F.when(asks, "the statement gives another value date").alias("rationale"), F.when(~asks, "same_date").alias("declined"),
    )
