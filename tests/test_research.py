"""Scenarios of the research operators on small literal frames."""

import datetime as dt
import io
import json
import math
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import exprs
from tidemark.operators import asof, backtest, diagnostics, factors, features, fundamentals, grids, labels, metrics, models, panel, portfolio, signals
from tidemark.sources import provenance, tables
from tidemark.streaming import daily


def d(text):
    return dt.date.fromisoformat(text)


def weekdays(n, start="2024-01-01"):
    return [x.date() for x in pd.bdate_range(start, periods=n)]


def bars(spark, data):
    """(ticker, closes): flat bars on business days."""
    rows = [(day, t, c, c, c, c, 100) for t, closes in data.items() for day, c in zip(weekdays(len(closes)), closes)]
    return spark.createDataFrame(rows, "date date, ticker string, open double, high double, low double, close double, volume bigint")


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*(order or ("date",))).collect()]


def test_panel_contracts(spark):
    good = bars(spark, {"a": [10.0, 11.0]})
    assert column(panel.validate_panel(good), "ticker") == ["A", "A"]
    with pytest.raises(ValueError, match="duplicate"):
        panel.validate_panel(good.unionByName(good))
    with pytest.raises(ValueError, match="positive"):
        panel.validate_panel(good.withColumn("close", F.lit(0.0)))
    with pytest.raises(ValueError, match="negative"):
        panel.validate_panel(good.withColumn("volume", F.lit(-1)))
    with pytest.raises(ValueError, match="lacks"):
        panel.validate_panel(good.drop("open"))
    assert panel.validate_panel(good.limit(0)).count() == 0


def test_screen_uses_rows_before_only(spark):
    df = bars(spark, {"A": [10.0, 10.0, 1.0]})
    assert column(panel.lagged_screen(df, 5.0, 1.0, 1), "eligible") == [False, True, True]
    member = df.withColumn("in_universe", F.col("date") == weekdays(3)[1])
    assert column(panel.lagged_screen(member, 5.0, 1.0, 1, "in_universe"), "eligible") == [False, True, False]
    with pytest.raises(ValueError):
        panel.lagged_screen(df, 5.0, 1.0, 0)


def test_metadata_must_not_come_from_the_future(spark):
    schema = "date string, ticker string, in_universe boolean, metadata_available_date string"
    late = spark.createDataFrame([("2024-01-01", "A", True, "2024-01-02")], schema)
    with pytest.raises(ValueError, match="after"):
        panel.validate_point_in_time(late)
    with pytest.raises(ValueError, match="valid"):
        panel.validate_point_in_time(spark.createDataFrame([("2024-01-01", "A", True, "no date")], schema))
    with pytest.raises(ValueError, match="stated"):
        panel.validate_point_in_time(spark.createDataFrame([("2024-01-01", "A", None, "2024-01-01")], schema))
    panel.validate_point_in_time(spark.createDataFrame([("2024-01-01", "A", False, "2024-01-01")], schema))


HISTORY = "ticker string, effective_date date, metadata_available_date date, in_universe boolean, sector string"


def test_membership_as_of(spark):
    df = bars(spark, {"A": [1.0, 2.0, 3.0], "Z": [1.0, 1.0, 1.0]})
    history = spark.createDataFrame([("a", d("2023-12-01"), d("2023-12-01"), True, "Tech"), ("A", d("2024-01-03"), d("2024-01-03"), False, None)], HISTORY)
    out = asof.attach_membership(df, history)
    assert column(out, "in_universe", "ticker", "date") == [True, True, False, False, False, False]
    assert column(out, "sector", "ticker", "date") == ["Tech", "Tech", None, None, None, None]
    assert column(out.filter("ticker = 'Z'"), "metadata_available_date") == weekdays(3)
    late = spark.createDataFrame([("A", d("2024-01-01"), d("2024-01-02"), True, "Tech")], HISTORY)
    with pytest.raises(ValueError, match="after"):
        asof.attach_membership(df, late)
    assert column(asof.attach_membership(df, late, check=False).filter("ticker = 'A'"), "in_universe") == [None, True, True]
    before = spark.createDataFrame([("A", d("2024-01-03"), d("2024-01-03"), True, "Tech")], HISTORY)
    assert column(asof.attach_membership(df, before).filter("ticker = 'A'"), "in_universe") == [False, False, True]


def test_facts_are_carried_by_record(spark):
    df = bars(spark, {"A": [1.0] * 4}).withColumn("cik", F.lit(1).cast("bigint"))
    facts = spark.createDataFrame(
        [(1, "assets", 100.0, d("2024-01-02")), (1, "net_income", 10.0, d("2024-01-02")), (1, "operating_cash_flow", 15.0, d("2024-01-02")), (1, "net_income", 20.0, d("2024-01-04"))], "cik bigint, feature string, value double, available_date date"
    )
    out = fundamentals.fundamental_ratios(asof.align_facts(df, facts, ["assets", "net_income", "operating_cash_flow"]))
    assert column(out, "assets") == [None, 100.0, 100.0, None] and column(out, "net_income") == [None, 10.0, 10.0, 20.0]
    r = out.orderBy("date").collect()[1]
    assert (r["return_on_assets"], r["cashflow_to_assets"], r["cashflow_to_income"]) == (0.1, 0.15, 1.5) and math.isclose(r["accruals_to_assets"], -0.05)
    by_ticker = asof.align_facts(df.drop("cik"), facts.withColumn("ticker", F.lit("A")).drop("cik"), ["assets"], "ticker", salts=3)
    assert column(by_ticker, "assets") == [None, 100.0, 100.0, None]


def test_change_log(spark):
    schema = "as_of date, ticker string, gics_sector string, cik bigint"
    first = [(d("2024-01-01"), "AAA", "Tech", 1), (d("2024-01-01"), "BBB", "Energy", 2)]
    log = asof.change_log(spark.createDataFrame([*first, (d("2024-02-01"), "AAA", "Tech", 1), (d("2024-02-01"), "C.C", "Tech", 3)], schema))
    got = sorted((str(r["effective_date"]), r["ticker"], r["in_universe"], r["sector"]) for r in log.collect())
    assert got == [("2024-01-01", "AAA", True, "Tech"), ("2024-01-01", "BBB", True, "Energy"), ("2024-02-01", "BBB", False, "Energy"), ("2024-02-01", "C-C", True, "Tech")]
    same = [(d("2024-01-01"), "AAA", None, None), (d("2024-02-01"), "AAA", None, None)]
    assert asof.change_log(spark.createDataFrame(same, schema)).count() == 1
    with pytest.raises(ValueError, match="duplicate"):
        asof.change_log(spark.createDataFrame([*first, first[0]], schema))


def test_coverage_keeps_members_without_prices(spark):
    history = spark.createDataFrame([("AAA", d("2019-01-01"), True), ("BBB", d("2020-01-01"), True), ("BBB", d("2021-01-01"), False)], "ticker string, effective_date date, in_universe boolean")
    prices = spark.createDataFrame([(d("2020-01-03"), "aaa")], "date date, ticker string")
    a, b = panel.price_coverage(history, prices).collect()
    assert (a["ticker"], a["missing_all_prices"], a["price_observations"]) == ("BBB", True, 0)
    assert (b["ticker"], b["price_starts_after_membership"], b["membership_add_events"]) == ("AAA", True, 1)


def test_features_have_warm_up_and_no_fill(spark):
    out = features.raw_features(bars(spark, {"A": [float(x) for x in range(10, 140)]}))
    got = column(out, "return_120d")
    assert got[:120] == [None] * 120 and math.isclose(got[120], 130 / 10 - 1)
    assert column(out, "volatility_20d")[:20] == [None] * 20 and column(out, "volatility_20d")[20] is not None
    gap = features.raw_features(bars(spark, {"A": [10.0, 11.0, None, 12.0]}))
    assert column(gap, "return_1d")[2:] == [None, None]
    assert set(column(out, "volume_zscore_20d")) == {None} and column(out, "relative_volume_20d")[25] == 1.0


def test_features_match_pandas(spark):
    rng = np.random.default_rng(0)
    close = np.round(100 * np.exp(np.cumsum(rng.normal(0, 0.02, 90))), 2)
    pdf = pd.DataFrame({"date": weekdays(90), "ticker": "A", "open": close, "high": close * 1.01, "low": close * 0.98, "close": close, "volume": rng.integers(1000, 9000, 90)})
    got = features.raw_features(spark.createDataFrame(pdf)).toPandas().sort_values("date").reset_index(drop=True)
    r = pdf.close.pct_change()
    want = {
        "return_20d": pdf.close / pdf.close.shift(20) - 1, "skip_momentum_20d": pdf.close.shift(5) / pdf.close.shift(25) - 1, "distance_ma_20d": pdf.close / pdf.close.rolling(20).mean() - 1, "volatility_20d": r.rolling(20).std(),
        "downside_volatility_20d": r.where(r < 0).rolling(20, min_periods=10).std(), "relative_volume_20d": pdf.volume / pdf.volume.rolling(20).mean(), "dollar_volume_20d": (pdf.close * pdf.volume).rolling(20).median(),
    }
    for name, series in want.items():
        assert np.allclose(got[name].astype(float), series, rtol=1e-9, equal_nan=True), name


def test_cross_section_ranks_ties_and_nulls(spark):
    values = [("a", 1.0, "x"), ("b", 2.0, "x"), ("c", 2.0, "y"), ("e", None, "y"), ("f", 9.0, None)]
    df = spark.createDataFrame([(d("2024-01-01"), t, v, s) for t, v, s in values], "date date, ticker string, f double, sector string")
    out = features.cross_section(df, ["f"], "sector", winsor=0.0).orderBy("ticker").collect()
    assert [r["f_rank"] for r in out] == [0.25, 0.625, 0.625, None, 1.0]
    assert [r["f_sector_rank"] for r in out] == [0.5, 1.0, 1.0, None, None]
    z = np.array([1, 2, 2, 9.0])
    assert np.allclose([r["f_zscore"] for r in out if r["f"] is not None], (z - z.mean()) / z.std(ddof=1))
    flat = features.cross_section(df.withColumn("f", F.lit(3.0)), ["f"]).collect()
    assert {r["f_zscore"] for r in flat} == {None} and {r["f_rank"] for r in flat} == {0.6}
    clipped = features.cross_section(df, ["f"], winsor=0.25).orderBy("ticker").collect()
    assert clipped[0]["f_zscore"] is not None and clipped[3]["f_rank"] is None


@pytest.mark.parametrize("delay", [1, 2])
def test_forward_labels(spark, delay):
    closes = [10.0, 11.0, 13.0, 12.0, 15.0, 16.0, 18.0, 17.0]
    df = bars(spark, {"A": closes}).withColumn("open", F.col("close") - 0.5)
    bench = df.select("date", "open", (F.col("close") * 2).alias("close"))
    out = labels.residual_return_target(df, bench, horizon=2, beta_lookback=2, delay=delay)
    assert math.isclose(column(out, "stock_forward_return")[0], closes[delay + 1] / (closes[delay] - 0.5) - 1)
    got = column(out, "target")
    assert got[-(delay + 1) :] == [None] * (delay + 1) and got[-(delay + 2)] is not None
    assert math.isclose(column(out, "beta")[5], 1.0) and column(out, "beta")[1] is None
    with pytest.raises(ValueError):
        labels.residual_return_target(df, bench, horizon=0)


def test_signals(spark):
    rng = np.random.default_rng(1)
    names = ["return_1d", "return_5d", "return_60d", "volatility_20d", "downside_volatility_20d", "atr_proxy_20d", "dollar_volume_20d", "relative_volume_20d"]
    pdf = pd.DataFrame({f"{n}_zscore": rng.normal(size=12) for n in names}).assign(date=d("2024-01-01"), ticker=[f"t{i:02d}" for i in range(12)], beta=np.linspace(0.5, 1.5, 12), sector=["x", "y", "z"] * 4)
    df = spark.createDataFrame(pdf).withColumn("atr_proxy_20d_zscore", F.when(F.col("ticker") != "t03", F.col("atr_proxy_20d_zscore")))
    out = signals.technical_signals(df)
    both = signals.combine_signals(out, {"low_risk": 0.5, "liquidity_quality": 0.5}).toPandas().set_index("ticker")
    assert both.combined_signal_rank.between(0, 1).all()
    assert math.isclose(both.low_risk["t03"], -pdf.loc[3, ["volatility_20d_zscore", "downside_volatility_20d_zscore"]].astype(float).mean())
    with pytest.raises(ValueError):
        signals.combine_signals(out, {"low_risk": 0.0})
    no_sector = signals.neutralize(df.withColumn("s", F.col("beta") * 2), "s", ["beta"], None).toPandas()
    assert no_sector.s_neutral.abs().max() < 1e-10
    for fs in (["beta"], ["beta", "return_1d_zscore"]):
        got = signals.neutralize(out.withColumn("low_risk", F.when(F.col("ticker") != "t05", F.col("low_risk"))), "low_risk", fs, "sector").toPandas().set_index("ticker").sort_index()
        keep = got.low_risk.notna()
        design = np.column_stack([np.ones(keep.sum()), *(got[f][keep] for f in fs), *((got.sector[keep] == s).astype(float) for s in "yz")])
        y = got.low_risk[keep].astype(float)
        assert np.allclose(got.low_risk_neutral[keep].astype(float), y - design @ np.linalg.lstsq(design, y, rcond=None)[0], atol=1e-10) and np.isnan(got.low_risk_neutral["t05"])
    few = signals.neutralize(df.limit(2).withColumn("s", F.col("beta") * 2), "s", ["beta"], None)
    assert column(few, "s_neutral", "ticker") == [None, None]


def ic_frame(spark):
    rows = [(day, f"t{i}", float(i), float(-i), i * 0.01, 1.0) for day in weekdays(4) for i in range(6)]
    return spark.createDataFrame(rows, "date date, ticker string, a double, b double, target double, c double").withColumn("year", F.year("date"))


def test_information_coefficients(spark):
    df = ic_frame(spark)
    out = {r["signal"]: r for r in diagnostics.signal_summary(df, ["a", "b", "c"]).collect()}
    assert (out["a"]["rank_ic"], out["b"]["rank_ic"], out["a"]["ic_days"], out["a"]["coverage"]) == (1.0, -1.0, 4, 1.0)
    assert out["c"]["rank_ic"] is None and out["c"]["ic_days"] == 4  # a constant signal is undefined, not an error
    corr = {(r["signal_a"], r["signal_b"]): r["correlation"] for r in diagnostics.signal_correlation(df, ["a", "b"]).collect()}
    assert np.isclose(corr["a", "b"], -1) and np.isclose(corr["b", "a"], -1) and np.isclose(corr["a", "a"], 1)
    decay = {(r["signal"], r["horizon_days"]): r["rank_ic"] for r in diagnostics.signal_decay(df, ["a"], {5: "target", 10: "b"}).collect()}
    assert np.isclose(decay["a", 5], 1) and np.isclose(decay["a", 10], -1)
    assert np.isclose(diagnostics.grouped_stability(df, ["a"], "year").first()["mean_rank_ic"], 1)
    daily, summary = metrics.prediction_metrics(df, "a", "target")
    assert daily.count() == 4 and summary.first()["observations"] == 24 and summary.first()["rank_ic_ir"] is None
    assert metrics.prediction_metrics(df.limit(4), "a", "target")[0].count() == 0
    scores = metrics.strict_mean_rank_ic(df.withColumn("k", F.lit(1)), ["k"], "c", "target").first()["score"]
    assert math.isnan(scores)
    assert features.feature_ics(df, ["a", "b"], "target").count() == 8
    assert features.feature_coverage(df.withColumn("n", F.lit(None).cast("double")), ["a", "n"]).filter("feature = 'n'").first()["missing_count"] == 24
    pooled = {(r["feature_a"], r["feature_b"]): r["correlation"] for r in features.pooled_correlation(df, ["a", "b", "c"]).collect()}
    assert np.isclose(pooled["a", "b"], -1) and pooled["a", "c"] is None


def test_overfitting_probability(spark):
    rng = np.random.default_rng(2)
    from itertools import combinations

    for n, parts in ((8, 4), (43, 6)):
        x = rng.normal(size=(n, 3))
        df = spark.createDataFrame([(day, *map(float, r)) for day, r in zip(weekdays(n), x)], "date date, a double, b double, c double")
        blocks = np.array_split(np.arange(n), parts)
        bad = []
        for train in combinations(range(parts), parts // 2):
            inside = x[np.concatenate([blocks[i] for i in train])].mean(0)
            outside = x[np.concatenate([blocks[i] for i in range(parts) if i not in train])].mean(0)
            bad.append(((outside < outside[inside.argmax()]).sum() + 1) / 3 <= 0.5)
        assert math.isclose(diagnostics.overfitting_probability(df, ["a", "b", "c"], partitions=parts).first()["pbo"], np.mean(bad))
    with pytest.raises(ValueError):
        diagnostics.overfitting_probability(df, ["a"])


def test_performance_and_deflated_sharpe(spark):
    r = [0.02, -0.01, 0.03, -0.04, 0.01, 0.02]
    df = spark.createDataFrame([(day, x) for day, x in zip(weekdays(6), r)] + [(weekdays(9)[8], None)], "date date, r double")
    out = metrics.performance(df, "r").first()
    curve = np.cumprod(1 + np.array(r))
    annual, vol = curve[-1] ** (52 / 6) - 1, np.std(r, ddof=1) * math.sqrt(52)
    assert np.allclose([out["annualized_return"], out["annualized_volatility"], out["sharpe"], out["maximum_drawdown"], out["periods"]], [annual, vol, annual / vol, (curve / np.maximum.accumulate(curve) - 1).min(), 6])
    s = pd.Series(r)
    sharpe = s.mean() / s.std()
    z = sharpe * math.sqrt(5) / math.sqrt(1 - s.skew() * sharpe + s.kurt() / 4 * sharpe**2)
    assert math.isclose(metrics.deflated_sharpe(df, "r"), 0.5 * math.erfc(-z / math.sqrt(2)), rel_tol=1e-9)
    assert metrics.deflated_sharpe(df, "r", 10) < metrics.deflated_sharpe(df, "r") and math.isnan(metrics.deflated_sharpe(df.limit(3), "r"))
    regime = diagnostics.regime_performance(df.withColumn("g", F.lit("all")), "g", "r").first()
    assert regime["observations"] == 6 and math.isclose(regime["sharpe_per_period"], sharpe)


def predictions(spark, n=40, days=1):
    rows = [(day, f"t{i:02d}", float((i * 7 + k) % n), "AB"[i % 2], 0.6 + 0.8 * i / n, 0.01 * ((i * 3) % 5 - 2)) for k, day in enumerate(weekdays(days)) for i in range(n)]
    return spark.createDataFrame(rows, "date date, ticker string, prediction double, sector string, beta double, ret double")


def test_projection_portfolio_is_neutral(spark):
    book = portfolio.projection_portfolio(predictions(spark), quantile=0.2, max_weight=0.5)
    e = portfolio.exposures(book).first()
    assert abs(e["gross"] - 1) < 1e-12 and max(abs(e["net"]), abs(e["beta"]), e["max_abs_sector_exposure"]) < 1e-10
    assert book.count() == 16 and portfolio.projection_portfolio(predictions(spark), quantile=0.2, max_weight=0.01).count() == 0
    missing = predictions(spark, 10).withColumn("beta", F.when(F.col("ticker") != "t00", F.col("beta")))
    assert portfolio.projection_portfolio(missing, quantile=0.4, max_weight=1.0).filter("ticker = 't00'").count() == 0
    alone = predictions(spark, 4).withColumn("sector", F.col("ticker"))
    assert portfolio.projection_portfolio(alone, quantile=0.4, max_weight=1.0).count() == 0
    tied = predictions(spark, 10).withColumn("prediction", F.lit(1.0))
    assert sorted(column(portfolio.pick_legs(tied, "prediction", 0.2, ["date"], ["sector", "beta"]).filter("leg = 1"), "ticker", "ticker")) == ["t00", "t01"]
    with pytest.raises(ValueError):
        portfolio.projection_portfolio(predictions(spark), quantile=0.7)
    with pytest.raises(ValueError):
        portfolio.projection_portfolio(predictions(spark), max_weight=0)


@pytest.mark.parametrize("options", [{}, {"turnover_penalty": 0.5, "max_turnover": 1.2}])
def test_optimizer_keeps_its_constraints(spark, options):
    df = predictions(spark, days=3).withColumn("size", F.sin(F.col("prediction")))
    out = portfolio.optimized_portfolios(df, quantile=0.2, factors=["beta", "size"], max_weight=0.2, risk_aversion=0.1, **options).toPandas()
    assert out.feasible.all() and out.date.nunique() == 3
    for _, day in out.groupby("date"):
        assert abs(day.weight.abs().sum() - 1) < 1e-6 and day.weight.abs().max() < 0.2 + 1e-6 and day.max_abs_constraint_residual.max() < 1e-6
    none = portfolio.optimized_portfolios(predictions(spark, 3), quantile=0.2).collect()
    assert [r["status"] for r in none] == ["too_few_names"] and none[0]["ticker"] is None


def test_optimizer_reports_what_it_did():
    rng = np.random.default_rng(2)
    n, cap = 30, 0.1
    a = np.vstack([np.ones(n), rng.uniform(0.5, 1.5, n)])
    scores, legs = np.sort(rng.normal(size=n))[::-1], np.repeat([1.0, -1.0], n // 2)
    w, status = portfolio.solve_book(scores, [legs, legs], a, np.zeros(n), cap, 1.0, 0.05, 0.0, None)
    assert status == "solved" and np.abs(a @ w).max() < 1e-8 and abs(np.abs(w).sum() - 1) < 1e-8 and np.abs(w).max() <= cap + 1e-12
    # no feasible neighbour within the signs is better
    signs, basis = np.sign(np.where(w == 0, legs, w)), np.linalg.svd(np.vstack([a, np.sign(np.where(w == 0, legs, w))]))[2][3:]
    value = lambda x: 0.05 * x @ x - scores @ x
    for _ in range(300):
        x = w + 0.02 * rng.normal(size=len(basis)) @ basis
        x = w + (x - w) * rng.uniform()
        if np.abs(x).max() <= cap and (x * signs >= 0).all():
            assert value(x) >= value(w) - 1e-7
    assert portfolio.solve_book(scores, [legs], a, np.zeros(n), 0.01, 1.0, 0.05, 0.0, None)[1] == "infeasible"
    sides = np.ones(n)  # all long can't be neutral: the relaxed program's signs can
    turned, status = portfolio.solve_book(scores, [sides], a, np.zeros(n), cap, 1.0, 0.05, 0.0, None)
    assert status == "solved" and (turned < 0).any() and np.abs(a @ turned).max() < 1e-8
    held, status = portfolio.solve_book(-scores, [-legs], a, w, cap, 1.0, 0.05, 0.0, 0.6)
    assert status == "solved" and np.abs(held - w).sum() / 2 <= 0.6 + 1e-9


def weights(spark, *books):
    rows = [(day, t, w, r, 1e6, 0.02) for day, book in zip(weekdays(len(books)), books) for t, w, r in book]
    return spark.createDataFrame(rows, "date date, ticker string, weight double, stock_forward_return double, dollar_volume_20d double, volatility_20d double")


def test_backtest_costs_and_turnover(spark):
    one = weights(spark, [("A", 0.5, 0.02), ("B", -0.5, -0.02)])
    out = backtest.run_backtest(one, cost_bps=10).first()
    assert math.isclose(out["gross_return"], 0.02) and out["net_return"] < out["gross_return"] and out["turnover"] == 0.5 and out["n_positions"] == 2
    small, large = (backtest.run_backtest(one, cost_model="liquidity", notional=n, annual_borrow_bps=52).first() for n in (1e5, 1e7))
    assert large["trading_cost"] > small["trading_cost"] > 0 and math.isclose(small["borrow_cost"], 0.5 * 52 / 1e4 / 52)
    want = 2 * (0.25 * (2 + 0.1 * 0.02 * math.sqrt(0.5 * 1e7 / 1e6) * 1e4) / 1e4)
    assert math.isclose(large["trading_cost"], want)
    two = weights(spark, [("A", 0.5, 0.0), ("B", -0.5, 0.0)], [("A", 1.0, 0.0)])
    assert column(backtest.turnover(two), "turnover") == [0.5, 0.5]
    gap = weights(spark, [("A", 0.5, 0.0)], [("B", 0.5, 0.0)], [("A", 0.5, 0.0)])
    assert column(backtest.turnover(gap), "turnover") == [0.25, 0.5, 0.5]  # A was absent in between
    idle = weights(spark, [("A", 0.5, 0.0)], [("B", 0.5, None)], [("A", 0.5, 0.0)])
    assert column(backtest.run_backtest(idle), "turnover") == [0.25, 0.0]
    with pytest.raises(ValueError, match="liquidity"):
        backtest.run_backtest(one.withColumn("dollar_volume_20d", F.lit(0.0)), cost_model="liquidity")
    with pytest.raises(ValueError):
        backtest.run_backtest(one, cost_model="other")
    joined = backtest.run_backtest(one.drop("stock_forward_return"), one.select("date", "ticker", "stock_forward_return")).first()
    assert math.isclose(joined["gross_return"], 0.02)


def test_sensitivity_grid(spark):
    book = weights(spark, *[[("A", 0.5, 0.01 * k), ("B", -0.5, -0.01)] for k in range(5)])
    out = backtest.cost_sensitivity(book, cost_bps=[5.0, 50.0], notionals=[1e5, 1e6]).collect()
    by = {(r["cost_assumption_bps"], r["portfolio_notional"]): r for r in out}
    assert len(by) == 4 and by[50.0, 1e5]["annualized_return"] < by[5.0, 1e5]["annualized_return"] and by[5.0, 1e5]["cost_assumption_type"] == "flat_turnover_cost"
    alone = metrics.performance(backtest.run_backtest(book, cost_model="liquidity", half_spread_bps=5.0, notional=1e6), "net_return").first()
    grid = backtest.cost_sensitivity(book, cost_model="liquidity", cost_bps=[5.0], notionals=[1e6]).first()
    assert math.isclose(grid["annualized_return"], alone["annualized_return"]) and grid["cost_assumption_type"] == "half_spread"


def test_weekly_and_monthly(spark):
    df = spark.createDataFrame([(day, float(i)) for i, day in enumerate(weekdays(30))] + [(None, 1.0)], "date date, v double")
    want = pd.Series(pd.to_datetime(weekdays(30))).groupby(pd.PeriodIndex(weekdays(30), freq="W-FRI")).max().dt.date.tolist()
    assert column(backtest.weekly_dates(df), "date") == want
    assert column(backtest.monthly_last(df.na.drop(), "v"), "v", "month_end") == [22.0, 29.0]


def model_frame(spark, dates, names, p=2, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for day in weekdays(dates):
        for i in range(names):
            x = rng.normal(size=p)
            y = float(x[0] * 0.5 + rng.normal() * 0.1)
            rows.append((day, f"t{i}", *[None if rng.random() < 0.1 else float(v) for v in x], None if rng.random() < 0.05 else y))
    return spark.createDataFrame(rows, "date date, ticker string, " + ", ".join(f"f{k} double" for k in range(p)) + ", target double")


def fit_ridge(train, test, alpha):
    x, y = train[["f0", "f1"]], train["target"]
    med = x.median()
    x, z = x.fillna(med), test[["f0", "f1"]].fillna(med)
    mean, sd = x.mean(), x.std(ddof=0)
    a = ((x - mean) / sd).to_numpy()
    coef = np.linalg.solve(a.T @ a + alpha * np.eye(2), a.T @ (y - y.mean()).to_numpy())
    return ((z - mean) / sd).to_numpy() @ coef + y.mean()


@pytest.mark.parametrize("expanding", [True, False])
def test_walk_forward_ridge_matches_numpy(spark, expanding):
    df = model_frame(spark, 30, 5)
    pdf = df.toPandas()
    out = models.walk_forward(df, ["f0", "f1"], train=10, test=5, embargo=2, expanding=expanding).toPandas()
    dates = sorted(pdf.date.unique())
    assert out.date.min() == dates[12] and out.fold.nunique() == 4
    for fold, own in out.groupby("fold"):
        start = 12 + 5 * fold
        lo = 0 if expanding else start - 12
        train = pdf[pdf.date.isin(dates[lo : start - 2])].dropna(subset=["target"])
        test = pdf.merge(own[["date", "ticker", "prediction"]], on=["date", "ticker"])
        assert np.allclose(fit_ridge(train, test, 10.0), test.prediction, atol=1e-10)
    with pytest.raises(ValueError, match="unknown"):
        models.walk_forward(df, ["f0"], train=10, test=5, parameters={"beta": 1})
    with pytest.raises(ValueError, match="model"):
        models.walk_forward(df, ["f0"], model="other", train=10, test=5)
    assert models.walk_forward(df, ["f0"], train=100, test=5).count() == 0


def test_nested_selection_and_ablation(spark):
    df = model_frame(spark, 45, 6)
    out, chosen = models.nested_walk_forward(df, ["f0", "f1"], {"light": 0.1, "heavy": 100.0}, train=15, test=5, embargo=2, inner=5)
    pdf = out.toPandas()
    dates = weekdays(45)
    assert pdf.date.min() == dates[17] and chosen.count() == pdf.fold.nunique() == 6
    first = chosen.orderBy("fold").first()
    assert first["selected_candidate"] in ("light", "heavy") and first["test_start"] == dates[17] and first["test_end"] == dates[21]
    drop = models.ablation(df, {"a": ["f0"], "b": ["f1"]}, train=15, test=10, embargo=2)
    assert {r["experiment"] for r in drop.select("experiment").distinct().collect()} == {"full", "without_a", "without_b"}
    ics = {r["experiment"]: r["score"] for r in metrics.strict_mean_rank_ic(drop, ["experiment"], "prediction", "target").collect()}
    assert ics["full"] > ics["without_a"]
    with pytest.raises(ValueError):
        models.nested_walk_forward(df, ["f0"], {})


def test_boosted_trees(spark):
    df = model_frame(spark, 30, 8)
    out = models.walk_forward(df, ["f0", "f1"], model="gbt", train=20, test=10, embargo=0, parameters={"max_iter": 3, "feature_subset": "all"})
    assert out.count() == 80 and out.filter("prediction is null").count() == 0


def test_trees_on_a_grid_match_spark_ml(spark):
    rng = np.random.default_rng(11)
    rows = []
    for day in weekdays(40):
        for i in range(25):
            a, b = float(rng.integers(9)) / 4, float(rng.integers(6)) - 2
            gap = rng.random()
            rows.append((day, f"t{i}", None if gap < 0.05 else a, float("nan") if gap > 0.97 else b, None if 0.5 < gap < 0.52 else float(a * b + (a > 1) + rng.normal())))
    df = spark.createDataFrame(rows, "date date, ticker string, f0 double, f1 double, target double")
    options = {"max_iter": 12, "max_depth": 3, "step_size": 0.1, "subsample": 1.0, "feature_subset": "all", "seed": 7}
    dates = models.date_axis(df)
    for expanding in (True, False):
        spans = models.folds(len(dates), 15, 10, 2, expanding)
        schema = "date date, ticker string, target double, prediction double, fold int"
        want, got = (f(df, ["f0", "f1"], "target", dates, spans, options, schema).toPandas().set_index(["date", "ticker"]) for f in (models._ml_trees, models._grid_trees))
        assert len(got) == len(want) == 23 * 25 and got.fold.nunique() == 3 and list(got.columns) == list(want.columns)
        both = got.join(want, rsuffix="_ml")
        assert (both.fold == both.fold_ml).all() and np.allclose(both.prediction, both.prediction_ml, atol=1e-9) and both.target.isna().sum() == both.target_ml.isna().sum() > 0


def test_trees_on_a_grid(spark):
    df = model_frame(spark, 60, 8)
    sc = spark.sparkContext
    sc.setJobGroup("grid trees", "")
    try:
        out = models.walk_forward(df, ["f0", "f1"], model="gbt", train=30, test=10, embargo=0).toPandas()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(sc.statusTracker().getJobIdsForGroup("grid trees")) < 40  # 300 trees in each of three folds, without a job for each
    assert len(out) == 30 * 8 and out.prediction.notna().all() and out.fold.nunique() == 3
    again = models.walk_forward(df.repartition(7), ["f0", "f1"], model="gbt", train=30, test=10, embargo=0).toPandas()
    both = out.merge(again, on=["date", "ticker"])
    assert np.allclose(both.prediction_x, both.prediction_y)
    whole = models.walk_forward(df, ["f0", "f1"], model="gbt", train=30, test=10, embargo=0, parameters={"subsample": 1.0}).toPandas().merge(out, on=["date", "ticker"])
    assert not np.allclose(whole.prediction_x, whole.prediction_y)
    one = models.walk_forward(df.withColumn("f1", F.lit(None).cast("double")), ["f0", "f1"], model="gbt", train=30, test=10, embargo=0, parameters={"max_iter": 5}).toPandas()
    alone = models.walk_forward(df, ["f0"], model="gbt", train=30, test=10, embargo=0, parameters={"max_iter": 5}).toPandas().merge(one, on=["date", "ticker"])
    assert len(alone) == 240 and np.allclose(alone.prediction_x, alone.prediction_y)
    assert models.walk_forward(df.withColumn("target", F.lit(None).cast("double")), ["f0", "f1"], model="gbt", train=30, test=10).count() == 0
    for bad in ({"subsample": 0.0}, {"feature_subset": "1.5"}, {"trees": 3}):
        with pytest.raises(ValueError):
            models.walk_forward(df, ["f0", "f1"], model="gbt", train=30, test=10, parameters=bad)


def test_a_tree_takes_its_share_of_the_rows():
    trees = grids.GridTrees(2, 300, 3, 0.03, 0.8, "0.8", 7)
    assert trees.taken == (16, 20) and trees.subset(2) == 2
    assert [grids.GridTrees(2, 1, 1, 0.1, x, "0.5", 7).taken for x in (1.0, 0.5, 0.33, 0.01)] == [(1, 1), (10, 20), (33, 100), (1, 100)]
    assert [grids.GridTrees(2, 1, 1, 0.1, 1.0, x, 7).subset(5) for x in ("all", "sqrt", "log2", "onethird", "2", "0.3", "1.0", "1")] == [5, 3, 3, 2, 2, 2, 5, 1]


def factor_zip():
    text = "preamble\nmore\n,Mkt-RF,SMB,HML,RMW,CMA,RF\n20240102,1.0,0.5,-0.5,0,0,0.01\n20240103,  2.0,0.5,,0,0,0.01\n\nCopyright\n"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("factors.CSV", text)
    return buffer.getvalue()


def test_factors(spark, tmp_path):
    (tmp_path / "f.zip").write_bytes(factor_zip())
    assert factors.read_factor_zip(spark, str(tmp_path / "f.zip")).count() == 2
    parsed = factors.read_factor_zip(spark, factor_zip()).collect()
    assert len(parsed) == 2 and parsed[0]["Mkt-RF"] == 0.01 and parsed[1]["HML"] is None and parsed[0]["date"] == d("2024-01-02")
    days = weekdays(8)
    daily = spark.createDataFrame([(x, *[0.01] * 6) for x in days], "date date, " + ", ".join(f"`{c}` double" for c in factors.FACTORS))
    held = factors.holding_period_factors(daily, spark.createDataFrame([(days[0],), (days[6],), (d("2030-01-01"),)], "date date"), horizon=2).collect()
    assert len(held) == 1 and held[0]["date"] == days[0] and math.isclose(held[0]["SMB"], 1.01**2 - 1)
    with pytest.raises(ValueError, match="duplicate"):
        factors.holding_period_factors(daily.unionByName(daily), daily.select("date"))
    rng = np.random.default_rng(0)
    market = rng.normal(size=12)
    fs = spark.createDataFrame([(x, float(m), 0.0, 0.0, 0.0, 0.0, 0.0) for x, m in zip(weekdays(12), market)], "date date, " + ", ".join(f"`{c}` double" for c in factors.FACTORS))
    out = factors.factor_attribution(fs.select("date", (0.001 + 2 * F.col("`Mkt-RF`")).alias("net_return")), fs)
    assert abs(out["alpha_per_period"] - 0.001) < 1e-9 and abs(out["beta_Mkt-RF"] - 2) < 1e-9 and out["observations"] == 12 and out["residual_volatility"] < 1e-6
    with pytest.raises(ValueError, match="few"):
        factors.factor_attribution(fs.limit(4).select("date", F.lit(0.1).alias("net_return")), fs)


def test_company_facts(spark):
    usd = [
        {"form": "10-K", "filed": "2024-02-01", "end": "2023-12-31", "val": 100, "accn": "a"}, {"form": "8-K", "filed": "2024-02-01", "end": "2023-12-31", "val": 1}, {"form": "10-Q", "filed": "bad", "end": "2023-12-31", "val": 1},
        {"form": "10-Q", "filed": "2024-02-02", "end": "2023-12-31", "val": 101}, {"form": "10-Q", "filed": "2024-02-03", "end": "2023-12-31", "val": 102}, {"form": "10-K", "filed": "2024-02-01", "end": "2023-12-31"},
    ]
    revenue = {"SalesRevenueNet": {"units": {"USD": [{"form": "8-K", "filed": "2024-02-01", "end": "2023-12-31", "val": 5}]}}, "Revenues": {"units": {"USD": usd}}}
    payload = {"facts": {"us-gaap": {"Assets": {"units": {"USD": usd}}, **revenue}}}
    df = spark.createDataFrame([(1, json.dumps(payload)), (2, "{}"), (3, "not json"), (4, None)], "cik bigint, payload string")
    got = sorted((r["feature"], str(r["available_date"]), r["value"], r["source_tag"]) for r in fundamentals.company_facts(df).collect())
    # Friday's and Saturday's filings are both available on Monday; the later one counts. Unusable first alternatives still win.
    assert got == [("assets", "2024-02-02", 100.0, "us-gaap:Assets"), ("assets", "2024-02-05", 102.0, "us-gaap:Assets")]
    tickers = fundamentals.ticker_ciks(spark.createDataFrame([('{"0": {"ticker": "aa", "cik_str": 1}, "1": {"ticker": "AA", "cik_str": 2}, "2": {"cik_str": 3}}',)], "payload string"))
    assert [tuple(r) for r in tickers.collect()] == [("AA", 2)]


def test_business_days_match_pandas(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=n) for n in range(60)]
    df = spark.createDataFrame([(x,) for x in days], "x date")
    for n in (0, 1, 2, 5, 7, 11):
        got = column(df.withColumn("y", exprs.add_business_days(F.col("x"), n)), "y", "x")
        assert got == [(pd.Timestamp(x) + pd.offsets.BDay(n)).date() for x in days]


def test_sources_and_provenance(spark, tmp_path):
    df = spark.createDataFrame([(d("2024-01-01"), "A", 1.5)], "date date, ticker string, v double")
    tables.write_parquet(df, f"{tmp_path}/t.parquet")
    tables.write_csv(df, f"{tmp_path}/t.csv")
    assert tables.read_table(spark, f"{tmp_path}/t.parquet").count() == 1 and tables.read_table(spark, f"{tmp_path}/t.csv").first()["v"] == 1.5
    with pytest.raises(ValueError):
        tables.read_table(spark, f"{tmp_path}/t.txt")
    loaded = []

    def load(keys):
        loaded.append(list(keys))
        return spark.createDataFrame([(k,) for k in keys], "k string")

    for _ in range(2):
        assert tables.ingest_batches(spark, ["c", "a", "b"], 2, load, f"{tmp_path}/b").count() == 3
    assert loaded == [["a", "b"], ["c"]]
    wide = spark.createDataFrame([(d("2024-01-01"), 1.0, None)], "date date, close_a double, close_b double")
    assert [tuple(r) for r in tables.wide_prices_to_panel(wide, ["a", "b"], ["close"]).collect()] == [(d("2024-01-01"), "A", 1.0)]
    (tmp_path / "x.csv").write_text("a\n1\n")
    made = provenance.manifest({"alpha": 1}, {"x": tmp_path / "x.csv"}, tmp_path)
    import hashlib

    assert made["inputs"]["x"]["sha256"] == hashlib.sha256(b"a\n1\n").hexdigest() and made["git_revision"] is None
    provenance.write_provenance(made, tmp_path / "x.csv")
    text = (tmp_path / "x.csv.provenance.json").read_text()
    assert text.endswith("}\n") and json.loads(text)["parameters"] == {"alpha": 1}


def test_streaming_bars(spark, tmp_path):
    row = (d("2024-01-01"), "a.b", 1.0, 1.0, 1.0, 1.0, 5, dt.datetime(2024, 1, 1, 20))
    schema = "date date, ticker string, open double, high double, low double, close double, volume bigint, ingested_at timestamp"
    spark.createDataFrame([row, row, (*row[:6], 6, row[7])], schema).write.parquet(f"{tmp_path}/in")
    query = daily.append_bars(daily.read_bars(spark, f"{tmp_path}/in", schema), "ingested_at", f"{tmp_path}/out", f"{tmp_path}/cp")
    query.awaitTermination(60)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 2 and got.first()["ticker"] == "A-B"


def test_signal_evaluation(spark):
    rng = np.random.default_rng(3)
    rows = [(day, f"t{i:03d}", "ABC"[i % 3], float(rng.uniform(0.5, 1.5)), float(rng.normal() * 0.02), float(rng.normal() * 0.02), float(rng.normal()), None) for day in weekdays(40)[4::5] for i in range(60)]
    df = spark.createDataFrame(rows, "date date, ticker string, sector string, beta double, stock_forward_return double, target double, s double, empty double")
    out = {r["signal"]: r for r in backtest.evaluate_signals(df, ["s", "empty"], max_weight=0.5).collect()}
    assert out["s"]["status"] == "evaluated" and out["s"]["periods"] == 8 and 0 <= out["s"]["deflated_sharpe_probability"] <= 1 and out["empty"]["status"] == "no_feasible_portfolios"


def test_window_medians(spark):
    rng = np.random.default_rng(8)
    days = [x.date() for x in pd.bdate_range("2024-01-01", periods=40)]
    data = [(day, f"t{i}", None if rng.random() < 0.2 else float(rng.normal()), float(rng.integers(0, 5)), None, float(rng.normal()) if k < 35 and k != 7 else None) for k, day in enumerate(days) for i in range(30)]
    df = spark.createDataFrame(data, "date date, ticker string, a double, b double, c double, target double")
    windows = [(0, 1), (3, 5), (0, 10), (0, 25), (0, 38), (5, 15), (10, 20), (28, 38), (35, 38), (7, 8), (0, 40)]
    exact = models.window_medians(df, ["a", "b", "c"], "target", days, windows, None)
    assert models.window_medians(df, ["a", "b", "c"], "target", days, windows) == exact and exact[0, 40][2] is None and exact[7, 8] == [None] * 3 == exact[35, 38]
    rough = models.window_medians(df, ["a"], "target", days, windows, 64)
    assert all(r[0] is None if exact[w][0] is None else abs(r[0] - exact[w][0]) < 0.2 for w, r in rough.items())
    assert models.window_medians(df, ["a"], "target", days, []) == {}


def test_repeated_dates_and_returns_are_refused(spark):
    days = [x.date() for x in pd.bdate_range("2024-01-01", periods=10)]
    bars = spark.createDataFrame([(day, "A", 1.0, 1.0 + k) for k, day in enumerate(days)], "date date, ticker string, open double, close double")
    market = bars.select("date", "open", "close")
    assert labels.residual_return_target(bars, market, 2, 2).count() == 10
    void = spark.createDataFrame([(None, 1.0, 1.0)] * 2, "date date, open double, close double")
    assert labels.residual_return_target(bars, market.unionByName(void), 2, 2).count() == 10
    with pytest.raises(Exception, match="duplicate dates"):
        labels.residual_return_target(bars, market.unionByName(market.limit(1)), 2, 2).collect()
    book = spark.createDataFrame([(days[0], "A", 0.5), (days[0], "B", -0.5)], "date date, ticker string, weight double")
    returns = spark.createDataFrame([(days[0], "A", 0.05), (days[0], "B", 0.01)], "date date, ticker string, stock_forward_return double")
    assert backtest.run_backtest(book, returns, cost_bps=0.0).first()["gross_return"] == pytest.approx(0.02)
    with pytest.raises(Exception, match="returns have duplicate"):
        backtest.run_backtest(book, returns.unionByName(returns.limit(1)))
    with pytest.raises(Exception, match="weights have duplicate"):
        backtest.run_backtest(book.unionByName(book.limit(1)), returns)


def test_table_digests_and_key_slices(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, 3.0), (2, None, 3.0)], "k int, t string, x double")
    same = provenance.table_digest(df.select("x", "t", "k").repartition(3, "k"))
    assert provenance.table_digest(df) == same and same["rows"] == 3
    others = [df.distinct(), df.withColumn("x", F.coalesce("x", F.lit(0.0))), df.select(F.col("t").alias("u"), "k", "x"), df.limit(0)]
    assert len({provenance.table_digest(o)["sha256"] for o in others} | {same["sha256"]}) == 5
    df.write.parquet(f"{tmp_path}/t.parquet")
    assert provenance.manifest({}, {"t": f"{tmp_path}/t.parquet"}, ".", spark)["inputs"]["t"]["sha256"] == same["sha256"]
    assert tables.key_slice(["c", "a", "b", "a"], 1) == ["b", "c"] and tables.key_slice("abc", 0, 2) == ["a", "b"] and tables.key_slice("abc", 5, 2) == []
    with pytest.raises(ValueError):
        tables.key_slice("abc", -1)


def test_daily_activity_closes_windows(spark, tmp_path):
    schema = "date date, ticker string, open double, high double, low double, close double, volume bigint, ingested_at timestamp"
    bar = lambda n, t, at: (d("2024-01-02"), t, 1.0, 1.0, 1.0, 1.0, n, at)
    for k, batch in enumerate([[bar(5, "a", dt.datetime(2024, 1, 2, 9)), bar(7, "b.c", dt.datetime(2024, 1, 2, 23))], [bar(1, "a", dt.datetime(2024, 1, 3, 1)), bar(2, "a", dt.datetime(2024, 1, 9, 1))], [bar(9, "late", dt.datetime(2024, 1, 2, 5))]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        activity = daily.daily_activity(daily.read_bars(spark, f"{tmp_path}/in", schema), "ingested_at")
        query = activity.writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(d("2024-01-02"), 2, 12), (d("2024-01-03"), 1, 1)]  # the last day is still open, the late bar is left out


def test_trees_are_candidates_and_ablated(spark):
    df = model_frame(spark, 30, 8)
    few = {"max_iter": 2, "feature_subset": "all"}
    out, chosen = models.nested_walk_forward(df, ["f0", "f1"], {"ridge": 1.0, "trees": ("gbt", few), "named": ("ridge", {"alpha": 1.0})}, train=16, test=7, embargo=0, inner=6)
    picks = {r["fold"]: r["selected_candidate"] for r in chosen.collect()}
    rows = out.collect()
    assert len(rows) == 8 * 14 and {r["fold"]: r["selected_candidate"] for r in rows} == picks and set(picks.values()) <= {"ridge", "trees"}
    assert all(r["inner_rank_ic_ridge"] == r["inner_rank_ic_named"] for r in chosen.collect())
    only, _ = models.nested_walk_forward(df, ["f0", "f1"], {"trees": ("gbt", few)}, train=16, test=7, embargo=0, inner=6)
    plain = models.walk_forward(df, ["f0", "f1"], model="gbt", train=16, test=7, embargo=0, parameters=few)
    key = lambda r: (r["date"], r["ticker"])
    assert {key(r): r["prediction"] for r in only.collect()} == {key(r): r["prediction"] for r in plain.collect()}
    dropped = models.ablation(df, {"a": ["f0"], "b": ["f1"]}, train=16, test=7, embargo=0, expanding=False, model="gbt", parameters=few)
    assert {r["experiment"]: r["count"] for r in dropped.groupBy("experiment").count().collect()} == {"full": 112, "without_a": 112, "without_b": 112}
    with pytest.raises(ValueError):
        models.nested_walk_forward(df, ["f0"], {"x": ("forest", {})}, train=16, test=7, embargo=0, inner=6)


def test_zscores_without_ranks_are_the_same(spark):
    rng = np.random.default_rng(4)
    data = [(day, f"t{i}", None if rng.random() < 0.1 else float("nan") if rng.random() < 0.1 else float(rng.normal()), 1.0, int(rng.integers(0, 9))) for day in [*weekdays(3), None] for i in range(40)]
    df = spark.createDataFrame(data, "date date, ticker string, a double, b double, cs_x_0 int")
    both = features.cross_section(df, ["a", "b", "cs_x_0"]), features.cross_section(df, ["a", "b", "cs_x_0"], ranks=False)
    assert both[1].columns == [*df.columns, "a_zscore", "b_zscore", "cs_x_0_zscore"]
    got = [{(r["date"], r["ticker"]): (r["a_zscore"], r["b_zscore"], r["cs_x_0_zscore"]) for r in df.collect() if r["date"] is not None} for df in both]
    assert got[0].keys() == got[1].keys() and all(x == y or abs(x - y) < 1e-12 for k in got[0] for x, y in zip(got[0][k], got[1][k], strict=True) if x is not None or y is not None)
    assert both[1].filter("date is null and (a_zscore is not null or cs_x_0_zscore is not null)").count() == 0 and both[1].count() == 160
    assert features.cross_section(df.limit(0), ["a"], ranks=False).count() == 0
