"""Settlement groups, partial claw-backs and stability against brute force and small fixtures."""

import itertools
import random

import pytest

from ledgerloom import params as P
from ledgerloom.operators import groups as G
from ledgerloom.plans import reports

POOL = "txn_id string, payment_id string, lo long, hi long"


def brute_groups(credits):
    """Every set of credits within the span, every subset of its joint pool, every part of both."""
    def fit(total, items):
        return max(sum(x[0] for x in items) - total, total - sum(x[1] for x in items), 0) <= P.TOLERANCE

    def parts(xs):
        return [c for k in range(1, len(xs)) for c in itertools.combinations(xs, k)]

    out = set()
    for k in range(2, P.MAX_GROUP_CREDITS + 1):
        for group in itertools.combinations(credits, k):
            days = [g[0] for g in group]
            pool = sorted({x for g in group for x in g[3]})
            if max(days) - min(days) > P.GROUP_SPAN_DAYS or not pool or len(pool) > P.MAX_POOL:
                continue
            total = sum(g[1] for g in group)
            hits = [c for n in range(1, P.MAX_SUBSET + 1) for c in itertools.combinations(pool, n) if fit(total, c)]
            if len(hits) != 1 or any(fit(sum(g[1] for g in a), b) for a in parts(group) for b in parts(hits[0])):
                continue
            out.add((tuple(sorted(g[2] for g in group)), tuple(sorted(x[2] for x in hits[0]))))
    return out


def test_groups_are_those_of_brute_force():
    met = 0
    for seed in range(60):
        rng = random.Random(seed)
        pay = [(v - 2, v + 2, f"p{i}") for i, v in enumerate(rng.sample(range(10_000, 90_000, 331), 5))]
        total = sum(x[0] + 2 for x in rng.sample(pay, rng.randint(1, 3)))
        cut = rng.randint(1, total - 1)
        amounts = [cut, total - cut, rng.randint(5_000, 90_000)]
        credits = [(rng.randint(0, 3), a, f"t{i}", [x for x in pay if rng.random() < 0.9]) for i, a in enumerate(amounts)]
        got = {(tuple(t), tuple(p)) for t, p, _ in G.candidate_groups(credits)}
        assert got == brute_groups(credits)
        met += bool(got)
    assert met > 10


def test_groups_table(spark):
    credits = [("a", 1, "2026-01-01", 40_000), ("b", 1, "2026-01-02", 60_000), ("c", 2, "2026-01-01", 40_000), ("d", 2, "2026-01-09", 60_000)]
    credits += [("e", 4, "2026-01-01", 30_000), ("f", 4, "2026-01-01", 30_000), ("g", 4, "2026-01-01", 70_000)]
    credits += [(f"x{i:02}", 3, "2026-01-01", 5) for i in range(P.MAX_GROUP_RESIDUE + 1)]
    residue = spark.createDataFrame(credits, "txn_id string, merchant_id int, day string, credit long").selectExpr("*", "cast(day as date) as txn_date")
    pool = [(t, f"p{m}", 100_000, 100_000) for t, m, _, _ in credits if m != 3]
    out = G.settlement_groups(residue, spark.createDataFrame(pool, POOL)).collect()
    got = {(r["merchant_id"], r["txn_ids"]): r["outcome"] for r in out}
    assert got == {(1, "a+b"): "granted", (3, None): "truncated", (4, "e+g"): "ambiguous_grouping", (4, "f+g"): "ambiguous_grouping"}


def test_a_pool_beyond_the_bound_joins_no_group(spark):
    residue = spark.sql("select * from values ('a', 1, date'2026-01-01', 40000L), ('b', 1, date'2026-01-01', 60000L) t(txn_id, merchant_id, txn_date, credit)")
    pool = [("a", f"p{i}", 1_000_000 + i, 1_000_000 + i) for i in range(P.MAX_POOL)] + [("a", "q", 100_000, 100_000), ("b", "q", 100_000, 100_000)]
    assert G.settlement_groups(residue, spark.createDataFrame(pool, POOL)).count() == 0
    assert G.settlement_groups(residue.limit(0), spark.createDataFrame([], POOL)).count() == 0


def test_partial_reversals_reopen_a_payment_once(spark):
    posted = spark.sql("""select 'c' as txn_id, 'UTRAB1' as ref_no, 60000L as credit, date'2026-01-01' as txn_date, * from values ('p', 10000L, 10000L), ('q', 20000L, 20000L), ('r', 30000L, 30000L) t(payment_id, lo, hi)""")
    debits = spark.sql("""select *, 'UTRAB1' as token from values ('d1', 20000L, date'2026-01-02'), ('d2', 20000L, date'2026-01-03'), ('d3', 40000L, date'2026-01-03'),
        ('d4', 10000L, date'2025-12-31'), ('d5', 60000L, date'2026-01-03') t(debit_id, debit, debit_date)""")
    got = {r["debit_id"]: (r["outcome"], r["payment_ids"]) for r in G.partial_reversals(debits, posted).collect()}
    assert got == {"d1": ("partially_reversed", "q"), "d2": ("no_subset_fits", None), "d3": ("partially_reversed", "p,r")}


def test_stability_counts_missing_passes(spark):
    runs = spark.createDataFrame([(0, "a", "p"), (1, "a", "p"), (2, "a", "q"), (0, "b", "r")], "pass int, txn_id string, payment_ids string")
    got = {r["txn_id"]: (r["modal"], round(r["stability"], 3)) for r in G.stability(runs, 3).collect()}
    assert got == {"a": ("p", 0.667), "b": ("r", 0.333)}


def test_audit_and_filters(spark):
    claims = spark.createDataFrame([("t1", "p1"), ("t2", "p1"), ("t3", "zz"), ("t4", "p2")], "txn_id string, payment_id string")
    pay = spark.sql("select * from values ('p1', date'2026-01-01', 100L, 100L), ('p2', date'2026-01-01', 900L, 900L) t(payment_id, pay_date, lo, hi)")
    lines = spark.sql("select *, '' as narration, '' as ref_no, 'x' as status, 'N' as customer_name, 0L as debit from values ('t1', date'2026-01-02', 100L), ('t2', date'2026-01-03', 500L), ('t3', date'2026-01-03', 5L), ('t4', date'2026-01-09', 900L) t(txn_id, txn_date, credit)")
    got = {r["txn_id"]: tuple(r[c] for c in ("unknown_id", "double_posted", "unbalanced", "out_of_window")) for r in reports.audit_claims(claims, pay, lines).collect()}
    assert got == {"t1": (False, True, False, False), "t2": (False, True, True, False), "t3": (True, False, False, False), "t4": (False, False, False, True)}
    assert reports.filter_transactions(lines, "credit", customer="n").count() == 4
    assert reports.filter_transactions(lines, "debit").count() == 0
    with pytest.raises(ValueError):
        reports.filter_transactions(lines, "sideways")
