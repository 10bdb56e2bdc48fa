"""End-to-end runs of the command line on a small simulated panel."""

import json

import numpy as np
import pandas as pd
import pytest

from tidemark import cli
from tidemark.plans import report


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("inputs")
    rng = np.random.default_rng(5)
    days = pd.bdate_range("2024-01-01", periods=190)
    market = rng.normal(0, 0.01, len(days))
    rows = []
    for i in range(24):
        close = 50 * np.exp(np.cumsum(market * rng.uniform(0.5, 1.5) + rng.normal(0, 0.01, len(days))))
        rows.append(pd.DataFrame({"date": days.date, "ticker": f"T{i:02d}", "open": close * 0.999, "high": close * 1.01, "low": close * 0.99, "close": close, "volume": rng.integers(10**5, 10**6, len(days)), "sector": "ABC"[i % 3]}))
    panel = pd.concat(rows)
    spark.createDataFrame(panel).write.parquet(f"{folder}/panel.parquet")
    level = 100 * np.exp(np.cumsum(market))
    spark.createDataFrame(pd.DataFrame({"date": days.date, "open": level, "close": level})).write.parquet(f"{folder}/benchmark.parquet")
    factors = pd.DataFrame({"date": days.date, "Mkt-RF": market, **{c: rng.normal(0, 0.005, len(days)) for c in ("SMB", "HML", "RMW", "CMA")}, "RF": 0.0})
    spark.createDataFrame(factors).write.parquet(f"{folder}/factors.parquet")
    snapshots = [(days[0].date(), f"T{i:02d}", "ABC"[i % 3]) for i in range(24)] + [(days[100].date(), f"T{i:02d}", "ABC"[i % 3]) for i in range(22)] + [(days[100].date(), "NEW", "A")]
    spark.createDataFrame(snapshots, "as_of date, ticker string, gics_sector string").write.parquet(f"{folder}/snapshots.parquet")
    return folder


def test_universe_then_research(spark, inputs, tmp_path):
    log = cli.main(["universe", "--snapshots", f"{inputs}/snapshots.parquet", "--prices", f"{inputs}/panel.parquet", "--output", str(tmp_path / "u")], spark)
    assert log.count() == 24 + 3 and (tmp_path / "u/universe_history.parquet.provenance.json").exists()
    out = tmp_path / "r"
    summary = cli.main(
        ["research", "--panel", f"{inputs}/panel.parquet", "--benchmark", f"{inputs}/benchmark.parquet", "--history", str(tmp_path / "u/universe_history.parquet"), "--factors", f"{inputs}/factors.parquet", "--output", str(out), "--train", "60", "--test", "20",
         "--embargo", "5", "--alphas", "1", "100", "--inner", "20", "--quantile", "0.25", "--max-weight", "0.5", "--grid-bps", "2", "20"], spark,
    )
    assert summary["periods"] > 10 and 0 <= summary["deflated_sharpe_probability"] <= 1
    for name in ("labeled_panel.parquet", "oos_predictions.parquet", "portfolio_weights.parquet", "backtest.csv", "daily_ic.csv", "exposures.csv", "summary.csv", "nested_model_selections.csv", "factor_attribution.csv", "report/report.html", "report/costs.svg"):
        assert (out / name).exists(), name
    assert json.loads((out / "run_manifest.json").read_text())["inputs"].keys() == {"panel", "benchmark", "history", "factors"}
    assert spark.read.csv(f"{out}/execution_cost_capacity_sensitivity.csv", header=True).count() == 2


def test_signal_screen(spark, inputs, tmp_path):
    table = cli.main(["signals", "--panel", f"{inputs}/panel.parquet", "--benchmark", f"{inputs}/benchmark.parquet", "--output", str(tmp_path), "--quantile", "0.25", "--max-weight", "0.5", "--neutral"], spark)
    assert table.count() == 8 and table.filter("status = 'evaluated'").count() == 8
    one = cli.main(["signals", "--panel", f"{inputs}/panel.parquet", "--benchmark", f"{inputs}/benchmark.parquet", "--output", str(tmp_path / "one"), "--quantile", "0.25", "--max-weight", "0.5", "--signals", "low_risk", "--cost-model", "liquidity",
         "--half-spread-bps", "20", "--annual-borrow-bps", "100"], spark)
    assert [r["signal"] for r in one.collect()] == ["low_risk"] and one.first()["annualized_return"] < table.filter("signal = 'low_risk'").first()["annualized_return"]
    pbo = float(spark.read.csv(f"{tmp_path}/overfitting_probability.csv", header=True).first()[0])
    assert 0 <= pbo <= 1 and (tmp_path / "stability_by_sector.csv").exists()


def test_facts_by_ticker_delay_and_comparison(spark, inputs, tmp_path):
    panel = spark.read.parquet(f"{inputs}/panel.parquet")
    day = panel.agg({"date": "min"}).first()[0]
    facts = [(f"t{i:02d}", f, float(i + k + 1), day) for i in range(24) for k, f in enumerate(("assets", "net_income", "equity", "operating_cash_flow", "revenue", "shares_outstanding"))]
    spark.createDataFrame(facts, "ticker string, feature string, value double, available_date date").write.mode("overwrite").parquet(f"{tmp_path}/facts.parquet")
    common = ["research", "--panel", f"{inputs}/panel.parquet", "--benchmark", f"{inputs}/benchmark.parquet", "--facts", f"{tmp_path}/facts.parquet", "--train", "60", "--test", "40", "--quantile", "0.25", "--max-weight", "0.5"]
    prompt = cli.main([*common, "--output", str(tmp_path / "a"), "--optimizer", "--max-turnover", "0.9", "--cost-model", "liquidity", "--portfolio-notional", "2e6"], spark)
    late = cli.main([*common, "--output", str(tmp_path / "b"), "--entry-delay-days", "2", "--neutral", "--annual-borrow-bps", "50"], spark)
    assert prompt["periods"] > 3 and late["periods"] > 3 and prompt["annualized_return"] != late["annualized_return"]
    assert spark.read.csv(f"{tmp_path}/b/signal_library_summary.csv", header=True).count() == 8 and "return_on_assets" in spark.read.parquet(f"{tmp_path}/a/labeled_panel.parquet").columns
    cli.main(["compare", "--runs", f"prompt={tmp_path}/a", f"late={tmp_path}/b", "--output", str(tmp_path / "c")], spark)
    page = (tmp_path / "c/comparison.html").read_text()
    assert page.count("data-run=") == 2 and page.count("<svg") == 2 and "addEventListener" in page and (tmp_path / "c/comparison.md").read_text().count("| late |") == 1


def test_repeated_benchmark_dates_stop_a_run(spark, inputs, tmp_path):
    market = spark.read.parquet(f"{inputs}/benchmark.parquet")
    market.unionByName(market.limit(1)).write.parquet(f"{tmp_path}/twice.parquet")
    with pytest.raises(Exception, match="duplicate dates"):
        cli.main(["signals", "--panel", f"{inputs}/panel.parquet", "--benchmark", f"{tmp_path}/twice.parquet", "--output", str(tmp_path)], spark)


def test_charts():
    assert report.percent(0.1234) == "12.34%" and report.percent(None) == "n/a" and report.place([1, 1], (1, 1), (0, 4)) == [2, 2] and report.place([0, 5, 10], (0, 10), (0, 1)) == [0, 0.5, 1] and report.round_ticks(-0.4, 1.1) == [0, 0.5, 1.0]
    svg = report.line_chart("a < b", ["x", "y"], {"l": [1.0, 2.0]})
    assert "a &lt; b" in svg and svg.count("polyline") == 1 and report.line_chart("none", [], {}).startswith("<svg")
    assert report.bar_chart("t", {"a": 1.0, "b": -0.5}).count("<rect") == 2
