"""Registered queries over small tables: what they hand to their operators."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import backtest, metrics
from tidemark.plans import research


class Handed(Exception):
    """Carries what an operator was given."""


def handed(monkeypatch, module, name, query, *args):
    def stop(*given, **named):
        raise Handed(given, named)

    monkeypatch.setattr(module, name, stop)
    with pytest.raises(Handed) as caught:
        query(*args)
    return caught.value.args


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("tables")
    days = [x.date() for x in pd.bdate_range("2024-01-01", periods=15)]
    bars = [(day, t, c, c, c, c, 100, 1, dt.datetime(2024, 2, 1)) for t, c in (("A", 10.0), ("B", 20.0)) for day in days]
    spark.createDataFrame(bars, "date date, ticker string, open double, high double, low double, close double, volume bigint, cik bigint, ingested_at timestamp").write.parquet(f"{out}/panel.parquet")
    records = [(1, "a", dt.date(2023, 12, 1), dt.date(2023, 12, 1), dt.date(2023, 12, 1), True, "Tech"), (2, "A", dt.date(2024, 1, 10), dt.date(2024, 1, 15), dt.date(2024, 1, 15), True, "Energy")]
    spark.createDataFrame(records, "record_id bigint, ticker string, effective_date date, metadata_available_date date, as_of date, in_universe boolean, sector string").write.parquet(f"{out}/universe_history.parquet")
    return str(out)


def test_books_take_sectors_as_of_each_date(spark, folder, monkeypatch):
    given = [
        handed(monkeypatch, research.portfolio, "optimized_portfolios", research.optimized_portfolio, spark, folder)[0][0],
        handed(monkeypatch, research.backtest, "evaluate_signals", research.signal_evaluation, spark, folder)[0][0],
        handed(monkeypatch, research.signals, "neutralize", research.neutral_two_factors, spark, folder)[0][0],
        handed(monkeypatch, research.portfolio, "projection_portfolio", research.attribution, spark, folder)[0][0],
        handed(monkeypatch, research.portfolio, "projection_portfolio", research.deflated_sharpe, spark, folder)[0][0],
        handed(monkeypatch, research.models, "walk_forward", research.pipeline, spark, folder)[0][0],
    ]
    for frame in given:
        got = {(r["ticker"], r["date"].day): r["sector"] for r in frame.collect()}
        fridays = {k: s for k, s in got.items() if k[1] in (5, 12, 19)}
        assert fridays == {("A", 5): "Tech", ("A", 12): None, ("A", 19): "Energy", ("B", 5): None, ("B", 12): None, ("B", 19): None}


def test_every_signal_is_evaluated(spark, folder, monkeypatch):
    given, _ = handed(monkeypatch, research.backtest, "evaluate_signals", research.signal_evaluation, spark, folder)
    assert list(given[1]) == list(research.signals.TECHNICAL_SIGNALS) and len(given[1]) == 4


def test_boosted_trees_are_not_cut(spark, folder, monkeypatch):
    _, named = handed(monkeypatch, research.models, "walk_forward", research.boosted_trees, spark, folder)
    assert (named["model"], named["train"], named["test"]) == ("gbt", research.TRAIN, research.TEST)
    assert "max_iter" not in (named.get("parameters") or {})


@pytest.mark.parametrize("query", [research.ridge_many, research.pipeline])
def test_models_take_every_feature(spark, folder, monkeypatch, query):
    given, _ = handed(monkeypatch, research.models, "walk_forward", query, spark, folder)
    assert list(given[1]) == [f"{f}_zscore" for f in research.features.RAW_FEATURES] and set(given[1]) <= set(given[0].columns)


def test_signals_under_liquidity_costs(spark):
    rng = np.random.default_rng(3)
    days = [x.date() for x in pd.bdate_range("2024-01-01", periods=40)][4::5]
    rows = [(day, f"t{i:03d}", "ABC"[i % 3], float(rng.uniform(0.5, 1.5)), float(rng.normal() * 0.02), float(rng.normal() * 0.02), float(rng.normal()), 1e6, 0.02) for day in days for i in range(60)]
    df = spark.createDataFrame(rows, "date date, ticker string, sector string, beta double, stock_forward_return double, target double, s double, dollar_volume_20d double, volatility_20d double")
    book = backtest.projection_portfolio(df.withColumn("prediction", df["s"]), quantile=0.1, max_weight=0.5)
    want = metrics.performance(backtest.run_backtest(book, cost_model="liquidity"), "net_return").first()
    got = backtest.evaluate_signals(df, ["s"], max_weight=0.5, cost_model="liquidity").first()
    assert got["annualized_return"] == pytest.approx(want["annualized_return"]) and got["periods"] == want["periods"] == 8
    assert got["annualized_return"] != pytest.approx(backtest.evaluate_signals(df, ["s"], max_weight=0.5).first()["annualized_return"])
