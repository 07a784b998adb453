"""Some queries of each kind next to their SQL twins on the smallest data; ``python -m checks.verify`` runs them all."""

import pytest

import __spark_entry__ as entry
from checks.registry import ORACLES, QUERIES
from checks.verify import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = ["price_returns", "rebalance_calendar", "backtest_selection", "rank_weights_overlap", "backtest_daily", "asset_history",
         "sweep_results", "mark_to_market", "forced_closes", "stop_levels", "order_outcomes", "pnl_totals", "stream_running_pnl"]


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, connection, name):
    rows, _, _, problem = compare(spark, connection, name, SF)
    assert not problem and rows > 0


def test_every_query_has_a_twin():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.keys() <= entry.queries().keys()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
