"""Settlements whose deductions exceed their payments are credits too, as SQL has them."""

import datetime

import duckdb
import pandas as pd
import pytest

from ledgerloom.plans import catalog
from tests.test_reconciliation import rows

QUERIES = (
    "assignment_digest", "assignments_payload", "explanations", "flat_transactions", "fs_evidence", "narration_parse", "narration_recovery", "outcome_by_defect", "parse_yield",
    "tier12_cascade", "tier1_reference", "tier2_amount_date", "transaction_facets", "unassigned_after_match", "debit_classification", "mr5_closure",
)


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    """Orders 22 and 37 share an invoice, whose tax is far above the second payment; that line is also clawed back."""
    path = tmp_path_factory.mktemp("sf")
    start = datetime.datetime(1970, 1, 1) + datetime.timedelta(days=3 * 2675)
    keys = [22, 37, *range(100, 130)]
    orders = pd.DataFrame({
        "o_orderkey": keys, "o_custkey": [k % 7 for k in keys], "o_totalprice": [400000.0 if k == 22 else 10.0 if k == 37 else 1000.0 + 7 * k for k in keys],
        "o_orderdate": [start + datetime.timedelta(days=0 if k < 100 else 9 + k % 11) for k in keys], "o_orderpriority": ["5-LOW" if k % 3 == 0 else "1-URGENT" for k in keys],
    })
    customer = pd.DataFrame({"c_custkey": range(7), "c_nationkey": pd.array([0] * 7, dtype="int32")})
    orders.astype({"o_orderdate": "datetime64[us]"}).to_parquet(path / "orders.parquet")
    customer.to_parquet(path / "customer.parquet")
    return str(path)


@pytest.mark.parametrize("name", QUERIES)
def test_a_negative_settlement_is_a_credit(spark, sf, name):
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert con.execute(catalog.ORACLES["bank_line_projection"]).df()["credit"].min() < 0
    assert rows(catalog.QUERIES[name](spark, sf).toPandas()) == rows(con.execute(catalog.ORACLES[name]).df())
