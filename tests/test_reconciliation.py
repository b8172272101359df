"""Every query with SQL gives the rows of its SQL; searches agree with brute force."""

import itertools
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from ledgerloom import params as P
from ledgerloom.operators.matching import resolve_contests, subset_solutions, subset_sum
from ledgerloom.plans import catalog
from ledgerloom.sources import readers

SF = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if pd.isna(x):
            return ""
        if isinstance(x, float):
            return str(int(x)) if x.is_integer() else str(round(x, 9))
        return str(x)[:19].replace(" 00:00:00", "")

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(catalog.ORACLES[name]).df())


def test_subset_search_is_exhaustive():
    for seed in range(200):
        rng = random.Random(seed)
        items = [(v - 2, v + 2, f"p{i}") for i, v in enumerate(rng.sample(range(1000, 9000, 7), rng.randint(0, 9)))]
        target = rng.randint(2000, 20000)
        want = {
            tuple(sorted(x[2] for x in c))
            for k in range(1, P.MAX_SUBSET + 1)
            for c in itertools.combinations(items, k)
            if max(sum(x[0] for x in c) - target, target - sum(x[1] for x in c), 0) <= P.TOLERANCE
        }
        found, capped, _ = subset_solutions(items, target)
        assert capped or {tuple(f) for f in found} == want


def test_stated_count_is_no_part_of_the_search(spark):
    pools = {"rivals": (3, [3000, 2000, 4000, 1000], 6000), "other": (3, [30000, 20000, 90000], 50000), "same": (2, [30000, 20000, 90000], 50000)}
    items = [(t, credit, n, f"{t}{i}", v, v) for t, (n, values, credit) in pools.items() for i, v in enumerate(values)]
    pool = spark.createDataFrame(items, "txn_id string, credit bigint, txns int, payment_id string, lo bigint, hi bigint")
    got = {r["txn_id"]: (r["verdict"], r["solutions"], r["payment_ids"]) for r in subset_sum(pool.select("txn_id").distinct(), pool).collect()}
    assert got == {"rivals": ("multiple_candidates", 2, None), "other": ("narration_count_conflict", 1, None), "same": ("assign", 1, "same0,same1")}


def test_contests_grant_only_a_strict_winner(spark):
    p = spark.createDataFrame([("a", "x", 3), ("b", "x,y", 2), ("c", "z", 1), ("d", "w", 2), ("e", "w", 2)], "txn_id string, payment_ids string, strength int")
    got = {r["txn_id"]: r["granted"] for r in resolve_contests(p).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": False, "e": False}


def test_fixpoint_gives_each_credit_one_verdict(spark):
    out = catalog.QUERIES["match_fixpoint"](spark, SF).toPandas()
    assert out.txn_id.is_unique
    used = [(p, v.payment_ids) for v in out[out.verdict.isin(["assign", "grouped"])].itertuples() for p in v.payment_ids.split(",")]
    assert len({p for p, _ in used}) == len(set(used))


def test_many_groups_are_searched_side_by_side(monkeypatch):
    from ledgerloom.operators import matching

    rng = random.Random(4)
    pools = [sorted((v - 2, f"p{i:02}", v + 2) for i, v in enumerate(rng.sample(range(1000, 9000, 7), rng.randint(0, 12)))) for _ in range(60)]
    targets = [rng.randint(2000, 30000) for _ in pools]
    lo, hi = (np.array([x[i] for p in pools for x in p], dtype=np.int64) for i in (0, 2))
    start = np.cumsum([0, *map(len, pools)])
    one = matching.subsets(lo, hi, start, np.array(targets))
    monkeypatch.setattr(matching, "CHUNK", 500)
    many = matching.subsets(lo, hi, start, np.array(targets))
    assert all((a == b).all() for a, b in zip(one, many, strict=True))
    for g, (pool, target) in enumerate(zip(pools, targets, strict=True)):
        want = {
            sum(1 << i for i in c)
            for k in range(1, P.MAX_SUBSET + 1)
            for c in itertools.combinations(range(len(pool)), k)
            if max(sum(pool[i][0] for i in c) - target, target - sum(pool[i][2] for i in c), 0) <= P.TOLERANCE
        }
        assert set(one[1][one[0] == g].tolist()) == want


def test_gate_refuses_what_passes_disagree_on(spark):
    from ledgerloom.operators import reconcile as R

    v = [("a", "assign", "x"), ("b", "assign", "y"), ("c", "grouped", "z"), ("d", "grouped", "z"), ("e", "no_candidate", None), ("f", "multiple_candidates", None)]
    verdicts = spark.createDataFrame([(t, 1, 10, s, "tier", p, 0, 1.0, None) for t, s, p in v], "txn_id string, merchant_id int, credit long, verdict string, tier string, payment_ids string, residual long, margin double, weight double")
    groups = spark.createDataFrame([(1, 1, "c+d", "z", 20, "granted")], "merchant_id int, month int, txn_ids string, payment_ids string, credit long, outcome string")
    runs = [(i, "a", "x") for i in range(3)] + [(0, "b", "y"), (1, "b", "w"), (2, "b", "y"), (0, "c", "z"), (1, "c", "z"), (2, "c", "z"), (0, "d", "z"), (1, "d", "z"), (2, "e", "q"), (2, "f", "q")]
    base = R.Outcome(verdicts, groups, None, None)
    got = {r["txn_id"]: (r["verdict"], r["payment_ids"]) for r in R.gate(base, spark.createDataFrame(runs, "pass int, txn_id string, payment_ids string"), 3).collect()}
    shaky = ("order_dependent_assignment", None)
    assert got == {"a": ("assign", "x"), "b": shaky, "c": shaky, "d": shaky, "e": shaky, "f": ("multiple_candidates", None)}


def test_evidence_changes_only_what_it_is_about(spark):
    from ledgerloom.plans import evidence

    after, accepted, held = evidence._with_evidence(spark, SF)
    about = {r["txn_id"] for r in accepted.collect()}
    changes = catalog.QUERIES["evidence_changes"](spark, SF).collect()
    assert changes and {r["txn_id"] for r in changes} <= about
    assert all(r["before"] == "amount_name_conflict" and r["after"] == "assign" for r in changes)
    assert not about & {r["txn_id"] for r in held.collect()}
    parts = {r["source_type"]: (r["proposals"], r["changed"]) for r in catalog.QUERIES["source_contributions"](spark, SF).collect()}
    assert parts["payer_register"][1] == len(changes)
    # Where every new assignment is wrong, all their evidence is withdrawn.
    base = catalog.outcome(spark, SF)
    right = base.verdicts.filter("verdict in ('assign', 'grouped')").select("txn_id", "payment_ids")
    wrong = spark.createDataFrame([(r["txn_id"], "none") for r in changes], "txn_id string, payment_ids string")
    seen = []
    assert evidence.withdraw(base, after, accepted, right.unionByName(wrong), lambda facts: seen.append({r["txn_id"] for r in facts.collect()}) or base) is base
    assert seen == [about - {r["txn_id"] for r in changes}]


def test_declared_deductions_and_dates_reach_the_search(spark):
    from ledgerloom.operators import matching as M

    c = spark.createDataFrame([("t", 1, 9000, "2020-01-10", None)], "txn_id string, merchant_id int, credit long, txn_date string, txns int").selectExpr("txn_id", "merchant_id", "credit", "cast(txn_date as date) txn_date", "txns")
    pay = spark.createDataFrame([("p", 1, "2020-01-01", 10000, 10000, True)], "payment_id string, merchant_id int, pay_date string, lo long, hi long, certain boolean").selectExpr("payment_id", "merchant_id", "cast(pay_date as date) pay_date", "lo", "hi", "certain")
    facts = spark.createDataFrame([("t", 1000, "2020-01-03", None)], "txn_id string, declared long, settled_on string, authorised_for string").selectExpr("txn_id", "declared", "cast(settled_on as date) settled_on", "authorised_for")
    assert M.amount_hits(M.with_facts(c), pay).count() == 0
    assert [r["residual"] for r in M.amount_hits(M.with_facts(c, facts), pay).collect()] == [0]


def test_guards(spark, tmp_path):
    f = tmp_path / "bank.csv"
    f.write_text('txn_date,value_date,description,ref_no,debit,credit,balance\n2026-01-01,,A,R1,,"1,000.50",1000.50\n2026-01-02,2026-01-03,B,R2,0.25,,1000.25\n2026-01-03,,C,R3,,1.00,1002.25\n')
    lines = readers.read_statement(spark, str(f)).withColumnRenamed("line_no", "n").selectExpr("*", "1 as account")
    got = lines.orderBy("n").collect()
    assert [r["id"] for r in got] == ["bank_txn_0001", "bank_txn_0002", "bank_txn_0003"]
    assert (got[0]["credit"], got[0]["debit"], str(got[0]["value_date"]), str(got[1]["value_date"])) == (100050, 0, "2026-01-01", "2026-01-03")
    assert [r["id"] for r in readers.balance_breaks(lines, "account", "n").collect()] == ["bank_txn_0003"]
    good, bad = readers.currency_gate(spark.createDataFrame([("a", " inr "), ("b", "USD"), ("c", None)], "id string, currency string"))
    assert good.count() == 1 and bad.count() == 2


def test_strict_reads_name_the_place(spark, tmp_path):
    f = tmp_path / "bank.csv"
    f.write_text("txn_date,value_date,description,ref_no,debit,credit,balance\n2026-01-01,,A,R1,,1.00,1.00\n2026-01-02,,B,R2,,(5),6.00\n")
    with pytest.raises(ValueError, match="row 3, column 'credit'"):
        readers.read_statement(spark, str(f), strict=True)
    f.write_text("txn_date,value_date,description,ref_no,credit,balance\n")
    with pytest.raises(ValueError, match="debit"):
        readers.read_statement(spark, str(f))
    f.write_text("bank_txn_id,payment_ids\nb1,p1;p2\n,\nb2,\n")
    with pytest.raises(ValueError, match="row 4 has no payment ids"):
        readers.read_claims(spark, str(f))
    f.write_text('bank_txn_id,payment_ids\nb1,"p1; p2,p3"\n')
    assert [tuple(r) for r in readers.read_claims(spark, str(f)).collect()] == [("b1", ["p1", "p2", "p3"])]
    assert readers.check_manifest(spark, str(tmp_path), 7) == {}
    (tmp_path / "manifest.json").write_text('{"seed": 7, "payments_per_window": 6}')
    assert readers.check_manifest(spark, str(tmp_path), 7)["payments_per_window"] == 6
    with pytest.raises(ValueError, match="seed 8"):
        readers.check_manifest(spark, str(tmp_path), 8, 6)


def test_lines_are_numbered_across_pieces_of_a_file(spark, tmp_path):
    f = tmp_path / "bank.csv"
    lines = "".join(f"2026-01-01,,line {i},R{i},,1.00,{i + 1}.00\n" for i in range(3000))
    f.write_text("txn_date,value_date,description,ref_no,debit,credit,balance\n" + lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        assert spark.read.csv(str(f)).rdd.getNumPartitions() > 1
        got = readers.read_statement(spark, str(f))
        assert all(r["description"] == f"line {r['line_no'] - 1}" for r in got.collect())
        assert readers.assert_continuity(got.selectExpr("*", "1 as account"), "account", "line_no") == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_gateway_orders_become_payments_that_say_so(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"items": [{"id": "pay_1", "amount": 1000, "status": "failed", "captured": false, "created_at": 1}]}')
    (tmp_path / "o.json").write_text('{"items": [{"id": "order_77", "amount": 100000, "receipt": "R9", "created_at": 2, "notes": {"invoice_no": "INV-1"}}]}')
    got = {r["provenance"]: r for r in readers.read_gateway(spark, str(tmp_path / "p.json"), str(tmp_path / "o.json")).collect()}
    assert (got["R1"]["id"], got["R1"]["captured"], got["R1"]["fee"]) == ("pay_1", False, None)
    assert (got["R2"]["id"], got["R2"]["captured"], got["R2"]["fee"], got["R2"]["description"], got["R2"]["notes"]) == ("pay_R2X77", True, 2596, "#R9", {"invoice_no": "INV-1"})


def test_ledgers_keep_versions_and_evidence_its_first_word(spark, tmp_path):
    from ledgerloom.plans.serve import Ledger
    from ledgerloom.sources import writers

    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    f = tmp_path / "inv.csv"
    row = "{},Kaveri,G,2026-01-01,2026-02-01,{},0,INR,open,\n"
    f.write_text(Ledger.template() + row.format("INV-1", "10.00"))
    ledger.upload(str(f))
    f.write_text(Ledger.template() + row.format("INV-1", "10.00") + row.format("INV-2", "20.00"))
    ledger.upload(str(f))
    assert ledger.list().count() == 2 and ledger.list("inv-2").count() == 1
    f.write_text(Ledger.template() + row.format("INV-3", "-1.00") + row.format("INV-3", "1.00"))
    with pytest.raises(ValueError, match="repeated invoice_no"):
        ledger.upload(str(f))
    ledger.revert()
    assert [r["invoice_no"] for r in ledger.list().collect()] == ["INV-1"]
    with pytest.raises(ValueError, match="no earlier version"):
        ledger.revert()

    def word(value):
        return spark.createDataFrame([("t", "authorised_payer_for", value)], "txn_id string, field string, value string")

    no = word("x").limit(0).selectExpr("*", "'' as reason")
    path = str(tmp_path / "evidence")
    for value in ("first", "second"):
        writers.append_evidence(path, word(value), no)
    accepted, rejected = writers.read_evidence(spark, path)
    assert [r["value"] for r in accepted.collect()] == ["first"] and [(r["value"], r["reason"]) for r in rejected.collect()] == [("second", "duplicate")]


def test_batches_and_scorecards_are_written(spark, tmp_path):
    from ledgerloom.plans import derive
    from ledgerloom.sources import writers

    pay, bank = catalog.payments(spark, SF), catalog.statement_balances(catalog.bank_lines(spark, SF))
    meta = writers.write_batch(str(tmp_path / "batch"), pay, bank, catalog.invoices(spark, SF), derive.truth(pay), 7, 6)
    assert readers.check_manifest(spark, str(tmp_path / "batch"), 7, 6)["payments"] == meta["payments"] == 1500
    card = writers.write_scorecard(str(tmp_path / "card.json"), *(catalog.QUERIES[q](spark, SF) for q in ("scorecard", "precision_by_tier", "precision_bounds")))
    assert 0 < card["headline"]["match_rate"] <= 1 and len(card["tiers"]) == len(card["lower_bounds"])


def test_routes(spark):
    from ledgerloom.plans.serve import Run

    run = Run(spark, SF)
    page, totals = run.transactions(limit=5, direction="credit", status=("refused",))
    rows, n = page.collect(), totals.first()
    assert len(rows) == 5 <= n["n"] and [r["amount"] for r in rows] == sorted((r["amount"] for r in rows), reverse=True)
    with pytest.raises(ValueError, match="unknown status"):
        run.transactions(status=("lost",))
    assert run.explain(rows[0]["txn_id"]).count() == 1 and "match_rate" in run.text()
    assert run.throughput(lambda: None)["records"] > 4000 and run.health()["ok"] and set(run.run()) == {"scorecard", "summary", "worklist", "assignments", "exceptions"}


def test_truth_takes_no_part_in_matching():
    import inspect

    from ledgerloom.operators import groups, matching, reconcile

    assert not any("truth" in inspect.getsource(m) for m in (groups, matching, reconcile))


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
