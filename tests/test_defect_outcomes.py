"""A settlement below zero that carries a planted defect counts in that defect's outcome."""

import datetime

import duckdb
import pandas as pd
import pytest

from ledgerloom.plans import catalog
from tests.test_reconciliation import rows


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    """Order 31 has a garbled narration, and stands on the invoice of order 22, whose tax is far above its amount."""
    path = tmp_path_factory.mktemp("sf")
    start = datetime.datetime(1970, 1, 1) + datetime.timedelta(days=3 * 2675)
    keys = [22, 31, *range(100, 130)]
    orders = pd.DataFrame({
        "o_orderkey": keys, "o_custkey": [k % 7 for k in keys], "o_totalprice": [400000.0 if k == 22 else 10.0 if k == 31 else 1000.0 + 7 * k for k in keys],
        "o_orderdate": [start + datetime.timedelta(days=0 if k < 100 else 9 + k % 11) for k in keys], "o_orderpriority": ["1-URGENT"] * len(keys),
    })
    customer = pd.DataFrame({"c_custkey": range(7), "c_nationkey": pd.array([0] * 7, dtype="int32")})
    orders.astype({"o_orderdate": "datetime64[us]"}).to_parquet(path / "orders.parquet")
    customer.to_parquet(path / "customer.parquet")
    return str(path)


def test_a_defect_below_zero_is_counted(spark, sf):
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    bank = con.execute(catalog.ORACLES["bank_line_projection"]).df()
    assert bank.loc[bank["credit"] < 0, "txn_id"].tolist() == ["bt_000000031"]
    got = catalog.QUERIES["outcome_by_defect"](spark, sf).toPandas()
    assert rows(got) == rows(con.execute(catalog.ORACLES["outcome_by_defect"]).df())
    counts = got.set_index("label").loc["garbled_narration", ["matched", "wrong", "refused", "silent"]]
    assert counts.sum() == 1  # order 124 is settled in a batch, whose narration stays whole
