"""Rounds that ask only the credits again which could have used what was claimed."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import params as P
from ledgerloom.operators import matching as M
from ledgerloom.operators import reconcile as R
from ledgerloom.plans import catalog
from ledgerloom.plans.storage import checkpoint

SF = "/root/testdata/sf0.001"


def _all_again(credits, pay, u):
    """The rounds with every credit that is left asked in every round."""
    sizes, left, free, granted, asked = M.pool_sizes(credits, pay), credits, pay, [], 0
    refs, fitting = M.reference_hits(credits, pay), M.amount_hits(credits, pay)
    rank = F.when(F.col("tier") == "tier1_reference", 2).when(F.col("tier") == "tier2_amount_date", 1).otherwise(0)
    for _ in range(P.MAX_ROUNDS):
        state = checkpoint(M.proposals(left, free, pay, u, sizes, refs, fitting, checkpoint))
        asked += state.count()
        strength = F.struct(rank.alias("rank"), F.coalesce(F.round("weight", 6), F.lit(M.NOTHING)).alias("w"))
        ruled = checkpoint(state.join(M.resolve_contests(state.filter("verdict = 'assign'").select("txn_id", "payment_ids", strength.alias("strength"))), "txn_id", "left"))
        new = ruled.filter("verdict = 'assign' and granted").select(M.VERDICT)
        if new.isEmpty():
            break
        granted.append(new)
        used, done = new.select(F.explode(F.split("payment_ids", ",")).alias("payment_id")), new.select("txn_id")
        left, free = checkpoint(left.join(done, "txn_id", "left_anti")), checkpoint(free.join(used, "payment_id", "left_anti"))
        refs, fitting = (checkpoint(h.join(done, "txn_id", "left_anti").join(used, "payment_id", "left_anti")) for h in (refs, fitting))
    verdict = F.when(F.col("verdict") == "assign", "contested_payment").otherwise(F.col("verdict"))
    rest = ruled.filter("verdict <> 'assign' or not granted").withColumn("verdict", verdict).withColumn("payment_ids", F.lit(None).cast("string")).select(M.VERDICT)
    return reduce(DataFrame.unionByName, granted, rest), asked


def _rows(df):
    return sorted(str((*r[:8], None if r["weight"] is None else round(r["weight"], 9))) for r in df.select(M.VERDICT).collect())


def test_rounds_agree_with_asking_everyone_again(spark, monkeypatch):
    given = catalog.match_inputs(spark, SF)
    facts = given.credits.filter("key % 7 = 0").selectExpr("txn_id", "key % 3 * 40000L as declared", "case when key % 2 = 0 then date_sub(txn_date, 2) end as settled_on", "'KAVERI TEXTILES' as authorised_for")
    credits = checkpoint(M.with_facts(given.credits, facts))
    want, all_asked = _all_again(credits, given.payments, given.u)
    plain, inner = [], M.proposals
    monkeypatch.setattr(M, "proposals", lambda c, *a: plain.append(c.count()) or inner(c, *a))
    assert _rows(M.match_rounds(credits, given.payments, given.u, checkpoint)) == _rows(want)
    assert len(plain) > 1 and sum(plain) < all_asked
    # With facts, a match asks for the first round only the credits that they are of.
    plain.clear()
    out = R.match(given, checkpoint, facts)
    assert plain[0] == facts.count()
    settled = "verdict = 'assign'"
    assert _rows(out.verdicts.filter(settled)) == _rows(want.filter(settled))


def test_debits_are_classified_when_asked_for(spark):
    made = []
    out = R.match(catalog.match_inputs(spark, SF), lambda df: made.append(df.columns) or checkpoint(df))
    assert not any("depends_on" in c for c in made)
    assert out.debits.count() and sum("depends_on" in c for c in made) == 1
