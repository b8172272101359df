"""Questions about whole pools, answered without a row for each pair."""

import numpy as np
import pandas as pd
import pytest

from ledgerloom import params as P
from ledgerloom.operators import matching as M
from ledgerloom.plans import catalog

SF = "/root/testdata/sf0.001"


def _pool(rng, n, odd):
    lo = rng.integers(-500, 9000, n)
    pool = pd.DataFrame({"payment_id": [f"p{i:03d}" for i in range(n)], "lo": lo, "hi": lo + rng.integers(0, 400, n)})
    if odd == "reversed":
        pool.loc[0, "hi"] = pool.loc[0, "lo"] - 900
    if odd == "unknown":
        pool = pool.astype({"lo": "float64", "hi": "float64"})
        pool.loc[0, ["lo", "hi"]] = np.nan
    if odd == "repeated":
        pool.loc[1, "payment_id"] = "p000"
    return pool.sort_values("payment_id", kind="stable")


@pytest.mark.parametrize("odd", ["", "reversed", "unknown", "repeated"])
def test_counts_and_nearest_agree_with_brute_force(odd):
    rng = np.random.default_rng(5)
    for n in (2, 3, 17, 40):
        pool, target = _pool(rng, n, odd), rng.integers(-500, 18000, 25)
        rows = list(pool.itertuples(index=False))

        def fits(t, a, b):
            gaps = [g for g in (a.lo + b.lo - t, t - a.hi - b.hi) if g == g]
            return max([*gaps, 0]) <= P.TOLERANCE

        want = [sum(fits(t, a, b) for i, a in enumerate(rows) for b in rows[i + 1 :] if a.payment_id != b.payment_id) for t in target]
        assert M.fitting_pairs(target, pool)["pairs"].tolist() == want
        if odd != "reversed":
            gap = lambda t, r: 0 if r.lo != r.lo else max(r.lo - t, t - r.hi, 0)
            got = M.nearest(target, pool)
            assert got["payment_id"].tolist() == [min(rows, key=lambda r: (gap(t, r), r.payment_id)).payment_id for t in target]
            assert np.abs(got["residual"]).tolist() == [min(gap(t, r) for r in rows) for t in target]


@pytest.mark.parametrize("name", ["subset_sum_pairs", "double_posted", "naive_matcher"])
def test_pools_are_never_joined(spark, name):
    """Credits and payments meet in tasks of a merchant's days, not as rows."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan


def test_evidence_meets_only_the_records_it_names(spark):
    credits, pay = catalog._credits(spark, SF), catalog._intervals(spark, SF)
    pool = M.candidate_pool(credits, pay)
    names = pool.groupBy("txn_id").agg({"payment_id": "min"}).toDF("txn_id", "source_ref").limit(40)
    far = names.selectExpr("txn_id", "'pay_none' as source_ref")
    got = M.named_candidates(names.unionByName(far), credits, pay)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in names.collect()}


def test_only_pools_that_are_searched_are_formed(spark):
    day = "date'2020-01-10'"
    pay = spark.range(P.MAX_POOL + 5).selectExpr("concat('p', id) as payment_id", "cast(id % 2 as int) as merchant_id", f"{day} as pay_date", "id * 1000 as lo", "id * 1000 as hi", "true as certain")
    pay = pay.unionByName(pay.withColumns({"merchant_id": pay["merchant_id"] * 0, "payment_id": pay["payment_id"].substr(1, 9)}).selectExpr("concat(payment_id, 'x') as payment_id", "merchant_id", "pay_date", "lo", "hi", "certain"))
    credits = spark.sql(f"select 'big' as txn_id, 0 as merchant_id, 3000L as credit, {day} as txn_date, cast(null as int) as txns union all select 'small', 1, 7000L, {day}, 1 union all select 'none', 7, 7000L, {day}, 1")
    assert {r["txn_id"]: r["pool_size"] for r in M.pool_counts(credits, pay).collect()} == {"big": 38, "small": 12}
    got = {r["txn_id"]: (r["verdict"], r["pool_size"]) for r in M.open_search(credits, pay).collect()}
    old = {r["txn_id"]: (r["verdict"], r["pool_size"]) for r in M.subset_sum(credits, M.candidate_pool(credits, pay)).collect()}
    assert got == old and got["big"] == ("pool_exceeded", 38) and got["none"] == ("no_candidate", 0)


def test_pools_of_several_days_come_back_as_one_column(spark):
    """Where pandas keeps strings in Arrow, what days' columns are joined to must not come in pieces."""
    env = spark.sparkContext.environment
    env["PANDAS_FUTURE_INFER_STRING"] = "1"
    try:
        days = "date_add(date'2020-01-10', cast(id as int))"
        pay = spark.range(9).selectExpr("concat('p', id) as payment_id", "1 as merchant_id", f"{days} as pay_date", "id * 1000 as lo", "id * 1000 as hi")
        credits = spark.range(9).selectExpr("concat('c', id) as txn_id", "1 as merchant_id", "id * 1000 as credit", f"{days} as txn_date")
        got = M.over_pools(credits, pay, M.nearest, "txn_id string, payment_id string, residual long").collect()
    finally:
        del env["PANDAS_FUTURE_INFER_STRING"]
    assert sorted(map(tuple, got)) == [(f"c{i}", f"p{i}", 0) for i in range(9)]
