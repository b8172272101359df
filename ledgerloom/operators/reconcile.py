"""One set of verdicts: rounds, settlement groups on what they leave, and what debits take back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators import groups as G
from ledgerloom.operators import matching as M
from ledgerloom.session import together

BATCH = ("merchant_id", "month")
#: Refusals that a group may still explain.
OPEN_TO_GROUPS = ("no_subset_fits", "no_candidate")


@dataclass(frozen=True)
class Outcome:
    verdicts: DataFrame  # (txn_id, merchant_id, credit, verdict, tier, payment_ids, residual, margin, weight), one for each credit
    groups: DataFrame  # (merchant_id, month, txn_ids, payment_ids, credit, outcome)
    classify: Callable[[], DataFrame] | None  # makes ``debits``, which most questions don't need
    unassigned: DataFrame  # (payment_id, amount) of captured payments that nothing claimed

    @cached_property
    def debits(self) -> DataFrame:
        """(debit_id, debit, outcome, credit_id, payment_ids, depends_on), one for each debit."""
        return self.classify()


@dataclass(frozen=True)
class Inputs:
    """What a match is made of before any evidence from outside: several matches of the same rows share it."""

    lines: DataFrame
    credits: DataFrame  # parsed
    payments: DataFrame  # captured, with intervals
    u: DataFrame
    refs: DataFrame
    fitting: DataFrame
    sizes: DataFrame  # of credits' pools
    proposed: DataFrame  # what the first round's credits ask for


def prepare(bank: DataFrame, payments: DataFrame, checkpoint: Callable[[DataFrame], DataFrame], recover: bool = True, u: DataFrame | None = None, parsed: DataFrame | None = None) -> Inputs:
    """``parsed``: the credits among ``bank``'s lines, where their narrations have been read already."""
    lines = checkpoint(bank)
    credits, pay, u = together(
        lambda: checkpoint(M.parse(M.credit_lines(lines), recover) if parsed is None else parsed), lambda: checkpoint(M.intervals(payments)),
        lambda: checkpoint(M.chance_agreement(payments, lines)) if u is None else u,
    )
    found = together(lambda: checkpoint(M.reference_hits(credits, pay)), lambda: checkpoint(M.amount_hits(credits, pay)), lambda: checkpoint(M.pool_sizes(credits, pay)))
    return ready(lines, credits, pay, u, *found, checkpoint)


def ready(lines: DataFrame, credits: DataFrame, pay: DataFrame, u: DataFrame, refs: DataFrame, fitting: DataFrame, sizes: DataFrame, checkpoint: Callable[[DataFrame], DataFrame]) -> Inputs:
    """Inputs with the first round's proposals, which need no rival and no fact."""
    return Inputs(lines, credits, pay, u, refs, fitting, sizes, checkpoint(M.proposals(M.with_facts(credits), pay, pay, u, sizes, refs, fitting, checkpoint)))


def month_of(date: Column) -> Column:
    return (F.year(date) * 12 + F.month(date)).cast("int")


def reconcile(
    bank: DataFrame, payments: DataFrame, checkpoint: Callable[[DataFrame], DataFrame], facts: DataFrame | None = None, recover: bool = True, u: DataFrame | None = None,
    parsed: DataFrame | None = None,
) -> Outcome:
    """Matches a bank's lines and payments by merchant; a merchant's month is the batch that groups are looked for in.

    ``u`` is the chance agreement to go by; without it, that of these very rows.
    """
    return match(prepare(bank, payments, checkpoint, recover, u, parsed), checkpoint, facts)


def match(given: Inputs, checkpoint: Callable[[DataFrame], DataFrame], facts: DataFrame | None = None) -> Outcome:
    """The match of what is prepared; ``facts`` change what some credits have to be explained by, so their fits and first proposals are found again."""
    lines, pay, refs, fitting, sizes, proposed = given.lines, given.payments, given.refs, given.fitting, given.sizes, given.proposed
    credits = M.with_facts(given.credits, facts)
    if facts is not None:
        credits = checkpoint(credits)
        own = checkpoint(credits.join(facts.select("txn_id"), "txn_id", "left_semi"))
        moved, ids = own.filter("declared <> 0 or settled_on is not null"), own.select("txn_id")
        fitting = checkpoint(fitting.join(moved.select("txn_id"), "txn_id", "left_anti").unionByName(M.amount_hits(moved, pay)))
        sizes = sizes.join(ids, "txn_id", "left_anti").unionByName(checkpoint(M.pool_sizes(own, pay)))
        again = M.proposals(own, pay, pay, given.u, sizes, *(h.join(ids, "txn_id", "left_semi") for h in (refs, fitting)), checkpoint)
        proposed = checkpoint(proposed.join(ids, "txn_id", "left_anti").unionByName(again))
    rounds = checkpoint(M.match_rounds(credits, pay, given.u, checkpoint, refs, fitting, sizes, proposed))
    claimed = rounds.filter("verdict = 'assign'").select(F.explode(F.split("payment_ids", ",")).alias("payment_id"))
    free = pay.join(claimed, "payment_id", "left_anti")
    # Groups don't see outside evidence.
    plain = credits.withColumn("declared", F.lit(0).cast("long")).withColumn("settled_on", F.lit(None).cast("date"))
    residue = plain.join(rounds.filter(F.col("verdict").isin(*OPEN_TO_GROUPS)).select("txn_id"), "txn_id", "left_semi").withColumn("month", month_of(F.col("txn_date")))
    residue = checkpoint(residue)
    groups = checkpoint(G.settlement_groups(residue.select("txn_id", *BATCH, "txn_date", "credit"), checkpoint(M.candidate_pool(residue, free)), BATCH))
    member = groups.filter("outcome <> 'truncated'").select(F.explode(F.split("txn_ids", "\\+")).alias("txn_id"), "outcome", "payment_ids", F.col("credit").alias("total"))
    member = member.groupBy("txn_id").agg(F.min("outcome").alias("g"), F.min("payment_ids").alias("g_ids"))  # a granted member stands in one group only
    grouped = F.col("g") == "granted"
    x = rounds.join(member, "txn_id", "left")
    verdicts = checkpoint(
        x.select(
            "txn_id", "merchant_id", "credit", F.when(grouped, "grouped").when(F.col("g").isNotNull(), "ambiguous_grouping").otherwise(F.col("verdict")).alias("verdict"),
            F.when(F.col("g").isNotNull(), "layer2b_group").otherwise(F.col("tier")).alias("tier"), F.when(grouped, F.col("g_ids")).otherwise(F.col("payment_ids")).alias("payment_ids"),
            F.when(F.col("g").isNull(), F.col("residual")).alias("residual"), F.when(grouped, 1.0).when(F.col("g").isNotNull(), 0.0).otherwise(F.col("margin")).alias("margin"), "weight",
        )
    )
    used = verdicts.filter("verdict in ('assign', 'grouped')").select(F.explode(F.split("payment_ids", ",")).alias("payment_id"))
    return Outcome(verdicts, groups, lambda: checkpoint(classify_debits(lines, verdicts, pay)), pay.join(used, "payment_id", "left_anti").select("payment_id", "amount"))


def classify_debits(bank: DataFrame, verdicts: DataFrame, payments: DataFrame) -> DataFrame:
    """Every debit: whole or partial claw-back, tied to a refusal, of another statement, ambiguous, or naming none."""
    debits, credits = M.debit_lines(bank), M.credit_lines(bank)
    posted = verdicts.filter("verdict in ('assign', 'grouped')").select("txn_id", "payment_ids")
    full = M.full_reversals(bank, posted)
    open_ = M.debit_tokens(debits).join(full.filter("exact = 0").select("debit_id"), "debit_id", "left_semi")
    gone = full.filter("exact = 1").join(posted, F.col("credit_id") == posted["txn_id"]).select(F.explode(F.split("payment_ids", ",")).alias("payment_id"))
    parts = posted.join(credits.select("txn_id", "ref_no", "credit", "txn_date"), "txn_id").withColumn("payment_id", F.explode(F.split("payment_ids", ",")))
    parts = parts.join(payments.select("payment_id", "lo", "hi"), "payment_id").join(gone, "payment_id", "left_anti")
    partial = G.partial_reversals(open_, parts.drop("payment_ids")).filter("outcome <> 'no_subset_fits'")
    named = M.debit_tokens(debits).join(credits.select(F.col("txn_id").alias("named"), F.upper("ref_no").alias("token")), "token").select("debit_id", "named").distinct()
    refused = verdicts.filter("verdict not in ('assign', 'grouped', 'no_candidate')").select(F.col("txn_id").alias("named"), F.lit(1).alias("is_refused"))
    link = named.join(refused, "named", "left").groupBy("debit_id").agg(F.min(F.when(F.col("is_refused") == 1, F.col("named"))).alias("depends_on"), F.count("*").alias("n_named"))
    shaped = M.debit_tokens(debits).filter(F.col("token").rlike("[A-Z]") & F.col("token").rlike("[0-9]")).select("debit_id").distinct().withColumn("shaped", F.lit(True))
    x = full.join(partial.select("debit_id", F.col("outcome").alias("p"), F.col("credit_id").alias("p_credit"), F.col("payment_ids").alias("p_ids")), "debit_id", "left")
    x = x.join(link, "debit_id", "left").join(shaped, "debit_id", "left").join(posted.select(F.col("txn_id").alias("credit_id"), F.col("payment_ids").alias("f_ids")), "credit_id", "left")
    outcome = (
        F.when(F.col("exact") == 1, "reversed").when(F.col("exact") > 1, "ambiguous_reversal").when(F.col("p").isNotNull(), F.col("p"))
        .when(F.col("depends_on").isNotNull(), "reverses_a_settlement_this_engine_refused")
        .when(F.col("n_named").isNull() & F.col("shaped"), "reverses_a_settlement_outside_this_batch").otherwise("no_settlement_named")
    )
    settled = outcome.isin("reversed", "partially_reversed")
    return x.select(
        "debit_id", "debit", outcome.alias("outcome"), F.when(settled, F.coalesce("credit_id", "p_credit")).alias("credit_id"),
        F.when(settled, F.coalesce("f_ids", "p_ids")).alias("payment_ids"),
        F.when(outcome == "reverses_a_settlement_this_engine_refused", F.col("depends_on")).alias("depends_on"),
    )


def gate(base: Outcome, runs: DataFrame, passes: int) -> DataFrame:
    """The base verdicts without what some pass decides otherwise: such credits are refused as order-dependent.

    ``runs``: (pass, txn_id, payment_ids) of settled credits in every pass.  A
    group falls as a whole; a credit settled only in other passes is refused
    too, unless it already is.
    """
    shares = G.stability(runs, passes).select("txn_id", "stability")
    member = base.groups.filter("outcome = 'granted'").select("txn_ids", F.explode(F.split("txn_ids", "\\+")).alias("txn_id"))
    x = base.verdicts.join(shares, "txn_id", "left").join(member, "txn_id", "left").withColumn("stability", F.coalesce("stability", F.lit(0.0)))
    whole = F.min("stability").over(Window.partitionBy(F.coalesce("txn_ids", "txn_id")))
    x = x.withColumn("stability", F.when(F.col("verdict") == "grouped", whole).otherwise(F.col("stability")))
    settled = F.col("verdict").isin("assign", "grouped")
    shaky = (settled & (F.col("stability") < 1)) | ((F.col("verdict") == "no_candidate") & (F.col("stability") > 0))
    return x.select(
        "txn_id", "merchant_id", "credit", F.when(shaky, "order_dependent_assignment").otherwise(F.col("verdict")).alias("verdict"), F.when(shaky, "").otherwise(F.col("tier")).alias("tier"),
        F.when(~shaky, F.col("payment_ids")).alias("payment_ids"), F.when(~shaky, F.col("residual")).alias("residual"), F.when(shaky, 0.0).otherwise(F.col("margin")).alias("margin"), "weight",
        F.when(settled, F.col("stability")).alias("stability"),
    )


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """The same rows in another order and other partitions; a seed of 0 leaves them as they are."""
    return df if not seed else df.repartition(max(3, df.sparkSession.sparkContext.defaultParallelism) + seed % 5, F.xxhash64(key, F.lit(seed))).sortWithinPartitions(F.xxhash64(key, F.lit(seed)))


def ensemble(bank: DataFrame, payments: DataFrame, passes: int, seed: int, checkpoint: Callable[[DataFrame], DataFrame]) -> tuple[Outcome, DataFrame]:
    """The base pass, over rows as they are, and what each of ``passes`` passes settles."""
    base, runs = None, None
    for i in range(passes):
        mix = seed + i if i else 0
        out = reconcile(shuffled(bank, "txn_id", mix), shuffled(payments, "payment_id", mix), checkpoint)
        base = out if base is None else base
        one = checkpoint(out.verdicts.filter("verdict in ('assign', 'grouped')").select(F.lit(i).alias("pass"), "txn_id", "payment_ids"))
        runs = one if runs is None else runs.unionByName(one)
    return base, runs


def passes_summary(runs: DataFrame, passes: int) -> DataFrame:
    """(passes, txns, unstable, least, mean) of an ensemble."""
    s = G.stability(runs, passes)
    return s.agg(
        F.lit(passes).alias("passes"), F.count("*").alias("txns"), F.count_if(F.col("stability") < 1).alias("unstable"),
        F.round(F.min("stability"), 6).alias("least"), F.round(F.avg("stability"), 6).alias("mean"),
    )


def as_claims(outcome: Outcome) -> DataFrame:
    """What was settled as a third party would claim it: (txn_id, group_key, payment_ids)."""
    settled = outcome.verdicts.filter("verdict in ('assign', 'grouped')").select("txn_id", "payment_ids")
    member = outcome.groups.filter("outcome = 'granted'").select(F.col("txn_ids").alias("group_key"), F.explode(F.split("txn_ids", "\\+")).alias("txn_id"))
    return settled.join(member, "txn_id", "left").select("txn_id", F.coalesce("group_key", "txn_id").alias("group_key"), F.split("payment_ids", ",").alias("payment_ids"))


