"""A match of prepared inputs, and what evidence changes of them."""

import threading

from ledgerloom.operators import evidence as E
from ledgerloom.operators import matching as M
from ledgerloom.operators import reconcile as R
from ledgerloom.plans import catalog, evidence
from ledgerloom.plans.storage import checkpoint
from ledgerloom.session import together

SF = "/root/testdata/sf0.001"


def test_evidence_finds_only_its_own_fits_again(spark):
    """Fits of credits with facts are found anew, all others are kept: the same as finding all of them."""
    given = catalog.match_inputs(spark, SF)
    facts = given.credits.filter("key % 5 = 0").selectExpr("txn_id", "key % 3 * 40000L as declared", "case when key % 2 = 0 then date_sub(txn_date, 2) end as settled_on", "cast(null as string) as authorised_for")
    seen = []

    def note(df):
        seen.append(checkpoint(df))
        return seen[-1]

    R.match(given, note, facts)
    whole = M.amount_hits(M.with_facts(given.credits, facts), given.payments)
    got = next(x for x in seen if x.columns == ["txn_id", "payment_id", "residual"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    pool = M.candidate_pool(given.credits, given.payments).filter("abs(residual) <= 100").select("txn_id", "payment_id", "residual")
    assert sorted(map(tuple, given.fitting.collect())) == sorted(map(tuple, pool.collect()))


def test_sources_are_left_out_side_by_side(spark, monkeypatch):
    """The last match with evidence and those less one source each wait for each other here, so one after the other would break."""
    out, given = catalog.outcome(spark, SF), catalog.match_inputs(spark, SF)
    rows = [(t["txn_id"], f, v, s) for t, (f, v, s) in zip(out.verdicts.limit(2).collect(), (("authorised_payer_for", "X", "payer_register"), ("settlement_date_confirmed", "2020-01-01", "bank_statement")), strict=True)]
    accepted = spark.createDataFrame([(*r, None, None) for r in rows], "txn_id string, field string, value string, source_type string, amount long, declined string")
    meet, seen = threading.Barrier(3), []

    def match(given, checkpoint, facts):
        meet.wait(timeout=60)
        seen.append(facts.count())
        return out

    def orchestrate(base, proposals, rerun, checkpoint, hold, beside):
        return together(lambda: rerun(E.facts(accepted)), lambda: beside(accepted))[0], accepted, None

    monkeypatch.setattr(evidence.R, "match", match)
    monkeypatch.setattr(evidence, "orchestrate", orchestrate)
    monkeypatch.setattr(evidence, "_proposals", lambda *_: accepted)
    monkeypatch.setattr(evidence, "once", lambda _, __, name, make, made={}: made[name] if name in made else made.setdefault(name, make()))
    assert sorted(map(tuple, evidence.source_contributions(spark, SF).collect())) == [("bank_statement", 1, 0), ("payer_register", 1, 0)]
    assert sorted(seen) == [1, 1, 2]


def test_what_runs_beside_the_last_match_gets_the_evidence_left(spark):
    """A held credit's evidence is taken away before the last match, and from what runs beside it."""
    verdict = lambda v: spark.createDataFrame([("a", v, 900), ("b", v, 5)], "txn_id string, verdict string, credit long")
    outs = [R.Outcome(verdict(v), None, None, None) for v in ("no_candidate", "assign")]
    proposals = spark.createDataFrame([(t, "authorised_payer_for", "X", None, "payer_register", None) for t in "ab"], "txn_id string, field string, value string, amount long, source_type string, declined string")
    got = []
    _, accepted, held = evidence.orchestrate(outs[0], proposals, lambda facts: outs[1], checkpoint, hold=100, beside=lambda x: got.extend(r["txn_id"] for r in x.collect()))
    assert got == [r["txn_id"] for r in accepted.collect()] == ["b"] and [r["txn_id"] for r in held.collect()] == ["a"]
