"""Every query runs on the smallest tables, and equals its SQL where it has one."""

import glob
import importlib
import inspect
import math
import os
import sys

import duckdb
import pytest

from tideline import frame_queries  # noqa: F401  registers further queries
from tideline.operators import evaluation
from tideline.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
#: These take long and are covered by tests of their own.
SLOW = {"optimal_d", "monte_carlo", "extended_features", "garch_volatility", "ensemble_predictions", "models_by_regime"}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def norm(rows):
    out = []
    for r in rows:
        out.append(tuple("none" if v is None else f"{v:.6g}" if isinstance(v, float) and math.isfinite(v) else str(v) for v in r))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_query_equals_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = db.sql(SQL[name])
    assert sorted(want.columns) == names
    rows = [tuple(r[c] for c in names) for r in got.collect()]
    assert norm(rows) == norm(want.select(", ".join(f'"{c}"' for c in names)).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["forest_predictions", "gated_predictions"])
def test_predictions_are_of_every_symbol(spark, db, name):
    b = QUERIES["triple_barrier"](spark, SF)
    got = {r.symbol: r["count"] for r in QUERIES[name](spark, SF).groupBy("symbol").count().collect()}
    every = {r.symbol: r["count"] for r in b.groupBy("symbol").count().collect()}
    assert len(got) == 5 and got.keys() == every.keys()
    assert all(every[s] - 30 < n <= every[s] for s, n in got.items())  # features are missing at the head only


def test_replay_of_all_outcomes(spark):
    pulls = QUERIES["bandit_replay"](spark, SF).agg({"pulls": "sum"}).first()[0]
    assert pulls == QUERIES["bandit_batch"](spark, SF).agg({"pulls": "sum"}).first()[0]


def test_prices_as_of_all_ticks(spark, db):
    assert QUERIES["as_of_prices"](spark, SF).count() == db.sql("select count(*) from (select distinct event_type, ts from events)").fetchall()[0][0]


def test_monte_carlo_is_of_every_symbol_and_a_thousand_draws(spark, monkeypatch):
    real, said = evaluation.monte_carlo, []

    def few(signals, bars, simulations=inspect.signature(real).parameters["simulations"].default):
        said.append(simulations)
        return real(signals, bars, 2)

    monkeypatch.setattr(evaluation, "monte_carlo", few)
    assert QUERIES["monte_carlo"](spark, SF).count() == 5 and said == [1000]
