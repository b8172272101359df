"""Lines that amounts alone don't tell apart, and jobs of independent passes side by side."""

import datetime
import threading

import duckdb
import pandas as pd
import pytest

from ledgerloom.operators import matching as M
from ledgerloom.plans import catalog, derive
from ledgerloom.session import together
from tests.test_reconciliation import rows


def test_passes_run_side_by_side():
    meet = threading.Barrier(3)
    assert together(*(lambda i=i: (meet.wait(20), i)[1] for i in range(3))) == [0, 1, 2]


def test_bank_lines_are_derived_once(spark):
    """The plan has no branch for each kind of line, each of which would derive all lines anew."""
    pay = catalog.payments(spark, "/root/testdata/sf0.001")
    plan = derive.bank_lines(pay)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Relation [") == 1
    assert "is_debit" in M.credit_lines(derive.bank_lines(pay)).columns


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    """Order 37 settles for nothing and is clawed back; order 118 (= 2 * 59) is split below zero."""
    path = tmp_path_factory.mktemp("sf")
    start = datetime.datetime(1970, 1, 1) + datetime.timedelta(days=3 * 2675)
    keys = [22, 37, 44, 118]
    orders = pd.DataFrame({
        "o_orderkey": keys, "o_custkey": [0, 1, 2, 2], "o_totalprice": [400000.0, 0.0, 400000.01, 10.0], "o_orderpriority": ["1-URGENT"] * 4,
        "o_orderdate": [start + datetime.timedelta(days=d) for d in (30, 60, 0, 0)],
    })
    customer = pd.DataFrame({"c_custkey": range(3), "c_nationkey": pd.array([0] * 3, dtype="int32")})
    orders.astype({"o_orderdate": "datetime64[us]"}).to_parquet(path / "orders.parquet")
    customer.to_parquet(path / "customer.parquet")
    return str(path)


@pytest.mark.parametrize("name", ("bank_line_projection", "narration_parse", "parse_yield", "tier12_cascade", "flat_transactions", "explanations"))
def test_lines_of_nothing_and_below_zero(spark, sf, name):
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    bank = con.execute(catalog.ORACLES["bank_line_projection"]).df()
    assert ((bank["credit"] == 0) & (bank["debit"] == 0)).sum() == 2 and (bank["credit"] < 0).sum() == 2
    assert rows(catalog.QUERIES[name](spark, sf).toPandas()) == rows(con.execute(catalog.ORACLES[name]).df())
