"""Command line: ``python -m tidemark.cli research|signals|universe|compare ...``."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.common import checkpointed
from tidemark.operators import asof, backtest, diagnostics, factors, features, fundamentals, labels, metrics, models, panel, portfolio, signals
from tidemark.plans.report import write_comparison, write_report
from tidemark.sources import provenance
from tidemark.sources.tables import read_table, write_csv, write_parquet


def _common(sub: argparse.ArgumentParser) -> None:
    sub.add_argument("--panel", required=True, help="daily bars: date, ticker, open, high, low, close, volume (and sector)")
    sub.add_argument("--benchmark", required=True, help="date, open, close")
    sub.add_argument("--output", required=True)
    sub.add_argument("--max-weight", type=float, default=0.05)
    sub.add_argument("--quantile", type=float, default=0.1)
    sub.add_argument("--cost-model", choices=["flat", "liquidity"], default="flat")
    sub.add_argument("--cost-bps", type=float, default=10.0, help="flat model: cost of turnover")
    sub.add_argument("--half-spread-bps", type=float, default=2.0, help="liquidity model: half-spread")
    sub.add_argument("--impact-coefficient", type=float, default=0.1, help="liquidity model: of square-root impact")
    sub.add_argument("--portfolio-notional", type=float, default=1_000_000.0, help="liquidity model: traded amount")
    sub.add_argument("--annual-borrow-bps", type=float, default=0.0)
    sub.add_argument("--entry-delay-days", type=int, default=1, help="rows between a signal and its entry")


def parser() -> argparse.ArgumentParser:
    """All commands and their options."""
    top = argparse.ArgumentParser(prog="tidemark")
    subs = top.add_subparsers(dest="command", required=True)
    research = subs.add_parser("research", help="features, walk-forward model, neutral books, backtest")
    _common(research)
    research.add_argument("--history", help="membership records, attached as of each date")
    research.add_argument("--facts", help="filed figures, attached as of each date")
    research.add_argument("--factors", help="daily factor returns for attribution")
    research.add_argument("--min-price", type=float, default=0.0)
    research.add_argument("--min-dollar-volume", type=float, default=0.0)
    research.add_argument("--train", type=int, default=504)
    research.add_argument("--test", type=int, default=21)
    research.add_argument("--embargo", type=int, default=5)
    research.add_argument("--alphas", type=float, nargs="+", default=[10.0], help="several: chosen inside each training window")
    research.add_argument("--inner", type=int, default=63)
    research.add_argument("--model", choices=["ridge", "gbt"], default="ridge")
    research.add_argument("--optimizer", action="store_true")
    research.add_argument("--max-turnover", type=float, help="optimiser: largest turnover against the book before")
    research.add_argument("--neutral", action="store_true", help="add the technical signals' neutral versions to the signal tables")
    research.add_argument("--grid-bps", type=float, nargs="*", default=[])
    research.add_argument("--grid-notionals", type=float, nargs="*", default=[1_000_000.0])
    screen = subs.add_parser("signals", help="evaluate each technical signal by itself")
    _common(screen)
    screen.add_argument("--signals", nargs="+", choices=signals.TECHNICAL_SIGNALS, default=list(signals.TECHNICAL_SIGNALS))
    screen.add_argument("--neutral", action="store_true", help="evaluate the neutral versions beside the signals")
    compare = subs.add_parser("compare", help="one report of several finished research runs, such as entries with and without a delay")
    compare.add_argument("--runs", nargs="+", required=True, metavar="NAME=FOLDER")
    compare.add_argument("--output", required=True)
    universe = subs.add_parser("universe", help="change log and coverage from constituent snapshots")
    universe.add_argument("--snapshots", required=True)
    universe.add_argument("--prices", required=True)
    universe.add_argument("--output", required=True)
    return top


def _costs(o: argparse.Namespace) -> dict[str, object]:
    return {"cost_model": o.cost_model, "cost_bps": o.cost_bps, "half_spread_bps": o.half_spread_bps, "impact_coefficient": o.impact_coefficient, "notional": o.portfolio_notional, "annual_borrow_bps": o.annual_borrow_bps}


def _with_neutral(frame: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    for s in names:
        frame = signals.neutralize(frame, s)
    return frame, [*names, *(f"{s}_neutral" for s in names)]


def _summary(frame: DataFrame) -> dict[str, float | None]:
    row = frame.first()
    return {} if row is None else {k: None if v is None else float(v) for k, v in row.asDict().items()}


def research(spark: SparkSession, o: argparse.Namespace) -> dict[str, float | None]:
    """The full run: files under ``output``, the manifest last; the summary."""
    out = Path(o.output)
    out.mkdir(parents=True, exist_ok=True)
    inputs = {k: getattr(o, k) for k in ("panel", "benchmark", "history", "facts", "factors") if getattr(o, k)}
    record = provenance.manifest({k: v for k, v in vars(o).items()}, inputs, ".", spark)
    raw = read_table(spark, o.panel)
    prices = panel.validate_panel(raw)
    kept = [c for c in ("sector", "cik") if c in raw.columns]
    if kept:
        prices = prices.join(raw.select(F.col("date").cast("date").alias("date"), F.upper("ticker").alias("ticker"), *kept), ["date", "ticker"])
    if o.history:
        history = read_table(spark, o.history)
        write_csv(panel.price_coverage(history, prices), f"{out}/universe_price_coverage.csv")
        prices = asof.attach_membership(prices.drop("sector"), history)
    if "sector" not in prices.columns:
        raise ValueError("the panel or the history needs a sector")
    screened = panel.lagged_screen(prices, o.min_price, o.min_dollar_volume, 20, "in_universe" if o.history else None)
    labeled = labels.residual_return_target(screened, read_table(spark, o.benchmark), delay=o.entry_delay_days)
    extra: list[str] = []
    if o.facts:
        facts = read_table(spark, o.facts)
        labeled = fundamentals.fundamental_ratios(asof.align_facts(labeled, facts, list(fundamentals.CONCEPTS)))
        extra = [c for c in ("return_on_assets", "cashflow_to_assets", "equity_to_assets", "accruals_to_assets") if c in labeled.columns]
    write_parquet(labeled, f"{out}/labeled_panel.parquet")
    featured = features.cross_section(features.raw_features(labeled), [*features.RAW_FEATURES, *extra], "sector")
    made, names = signals.technical_signals(featured), list(signals.TECHNICAL_SIGNALS)
    if o.neutral:
        made, names = _with_neutral(made, names)
    frame = checkpointed(made)
    write_csv(diagnostics.signal_summary(frame, names), f"{out}/signal_library_summary.csv")
    write_csv(diagnostics.signal_correlation(frame, names), f"{out}/signal_correlation.csv")
    eligible = frame.filter("eligible")
    columns = [f"{f}_zscore" for f in [*features.RAW_FEATURES, *extra]]
    spans = {"train": o.train, "test": o.test, "embargo": o.embargo}
    if len(o.alphas) > 1:
        scored, chosen = models.nested_walk_forward(eligible, columns, {f"alpha_{a:g}": a for a in o.alphas}, inner=o.inner, **spans)
        write_csv(chosen, f"{out}/nested_model_selections.csv")
    else:
        scored = models.walk_forward(eligible, columns, model=o.model, parameters={"alpha": o.alphas[0]} if o.model == "ridge" else None, **spans)
    write_parquet(scored, f"{out}/oos_predictions.parquet")
    scored = spark.read.parquet(f"{out}/oos_predictions.parquet")
    context = frame.select("date", "ticker", "sector", "beta", "stock_forward_return", "dollar_volume_20d", "volatility_20d")
    weekly = scored.join(backtest.weekly_dates(scored), "date", "left_semi").join(context, ["date", "ticker"])
    if o.optimizer:
        solved = checkpointed(portfolio.optimized_portfolios(weekly, quantile=o.quantile, max_weight=o.max_weight, max_turnover=o.max_turnover))
        write_csv(solved.select("date", "feasible", "status", "objective", "gross", "turnover", "max_abs_constraint_residual", "gross_residual", "bound_violation").distinct(), f"{out}/optimizer_diagnostics.csv")
        book = solved.filter("feasible").select("date", "ticker", "weight", "post_optimization_sign_changed").join(weekly, ["date", "ticker"])
    else:
        book = portfolio.projection_portfolio(weekly, quantile=o.quantile, max_weight=o.max_weight)
    write_parquet(book, f"{out}/portfolio_weights.parquet")
    book = spark.read.parquet(f"{out}/portfolio_weights.parquet")
    if book.isEmpty():
        raise RuntimeError("no date has a feasible portfolio")
    tested = checkpointed(backtest.run_backtest(book, **_costs(o)))
    grid = {}
    if o.grid_bps:
        table = backtest.cost_sensitivity(book, cost_model=o.cost_model, cost_bps=o.grid_bps, notionals=o.grid_notionals, impact_coefficient=o.impact_coefficient, annual_borrow_bps=o.annual_borrow_bps)
        write_csv(table, f"{out}/execution_cost_capacity_sensitivity.csv")
        grid = {f"{r['cost_assumption_bps']:g}": r["sharpe"] or 0.0 for r in table.orderBy("cost_assumption_bps").collect()}
    if o.factors:
        held = factors.holding_period_factors(read_table(spark, o.factors), tested, delay=o.entry_delay_days)
        write_csv(held, f"{out}/holding_period_factors.csv")
        found = factors.factor_attribution(tested, held)
        write_csv(spark.createDataFrame([(k, float(v)) for k, v in found.items()], "metric string, value double"), f"{out}/factor_attribution.csv")
    daily, totals = metrics.prediction_metrics(scored)
    write_csv(tested.orderBy("date"), f"{out}/backtest.csv")
    write_csv(daily.orderBy("date"), f"{out}/daily_ic.csv")
    write_csv(portfolio.exposures(book).orderBy("date"), f"{out}/exposures.csv")
    summary = {**_summary(totals), **_summary(metrics.performance(tested, "net_return")), "deflated_sharpe_probability": metrics.deflated_sharpe(tested, "net_return", len(o.alphas))}
    write_csv(spark.createDataFrame(list(summary.items()), "metric string, value double"), f"{out}/summary.csv")
    write_report(f"{out}/report", tested, daily, summary, grid)
    provenance.write_json(record, out / "run_manifest.json")
    return summary


def screen(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    """Each signal's own book; stability by year and sector; overfitting probability."""
    out = Path(o.output)
    out.mkdir(parents=True, exist_ok=True)
    raw = read_table(spark, o.panel)
    prices = panel.validate_panel(raw).join(raw.select(F.col("date").cast("date").alias("date"), F.upper("ticker").alias("ticker"), "sector"), ["date", "ticker"])
    labeled = labels.residual_return_target(prices, read_table(spark, o.benchmark), delay=o.entry_delay_days)
    frame = signals.technical_signals(features.add_features(labeled, "sector"))
    names = list(o.signals)
    if o.neutral:
        frame, names = _with_neutral(frame, names)
    frame = checkpointed(frame.withColumn("year", F.year("date")))
    table = backtest.evaluate_signals(frame, names, quantile=o.quantile, max_weight=o.max_weight, **_costs(o))
    write_csv(table, f"{out}/signal_evaluation.csv")
    write_csv(diagnostics.signal_summary(frame, names), f"{out}/signal_library_summary.csv")
    write_csv(diagnostics.signal_correlation(frame, names), f"{out}/signal_correlation.csv")
    for group in ("year", "sector"):
        write_csv(diagnostics.grouped_stability(frame, names, group), f"{out}/stability_by_{group}.csv")
    weekly = frame.join(backtest.weekly_dates(frame), "date", "left_semi")
    returns = None
    for s in names:
        book = portfolio.projection_portfolio(weekly.withColumn("prediction", F.col(s)), quantile=o.quantile, max_weight=o.max_weight)
        one = backtest.run_backtest(book, **_costs(o))
        write_csv(one, f"{out}/backtest_{s}.csv")
        one = one.select("date", F.col("net_return").alias(s))
        returns = one if returns is None else returns.join(one, "date", "full_outer")
    complete = checkpointed(returns.na.drop())
    n = min(8, complete.count())
    if n >= 2 and len(names) > 1:
        write_csv(diagnostics.overfitting_probability(complete, names, partitions=n - n % 2), f"{out}/overfitting_probability.csv")
    provenance.write_json(provenance.manifest(dict(vars(o)), {"panel": o.panel, "benchmark": o.benchmark}, ".", spark), out / "run_manifest.json")
    return table


def universe(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    """The change log with its provenance, and the price coverage of all members."""
    log = asof.change_log(read_table(spark, o.snapshots))
    write_parquet(log, f"{o.output}/universe_history.parquet")
    provenance.write_provenance(provenance.manifest({"snapshots": o.snapshots}, {"snapshots": o.snapshots}, ".", spark), f"{o.output}/universe_history.parquet")
    history = spark.read.parquet(f"{o.output}/universe_history.parquet")
    write_csv(panel.price_coverage(history, read_table(spark, o.prices)), f"{o.output}/universe_price_coverage.csv")
    return history


def compare(spark: SparkSession, o: argparse.Namespace) -> list[str]:
    """A report of several finished runs side by side; the files' names."""
    runs = {}
    for run in o.runs:
        name, _, folder = run.partition("=")
        if not name or not folder:
            raise ValueError("give runs as NAME=FOLDER")
        rows = read_table(spark, f"{folder}/summary.csv").collect()
        runs[name] = (read_table(spark, f"{folder}/backtest.csv"), read_table(spark, f"{folder}/daily_ic.csv"), {r["metric"]: r["value"] for r in rows})
    return write_comparison(o.output, runs)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> object:
    """Run a command."""
    o = parser().parse_args(argv)
    session = spark or SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return {"research": research, "signals": screen, "universe": universe, "compare": compare}[o.command](session, o)


if __name__ == "__main__":
    main()
