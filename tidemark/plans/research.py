"""The research pipeline's operators as queries over the dataset's panel, history, snapshot, fact and prediction tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.common import canonical_ticker, checkpointed, finite, latest_rows, not_nan, table
from tidemark.functions.exprs import add_business_days, percentile_rank
from tidemark.operators import asof, backtest, diagnostics, factors, features, fundamentals, labels, metrics, models, panel, portfolio, signals
from tidemark.plans import report

PRICES = ("open", "high", "low", "close")
FIGURES = ("assets", "equity", "net_income", "operating_cash_flow", "revenue", "shares_outstanding")
SIGNALS = list(signals.TECHNICAL_SIGNALS)
SCORED = ("return_1d", "return_5d", "return_60d", "volatility_20d", "downside_volatility_20d", "atr_proxy_20d", "dollar_volume_20d", "relative_volume_20d")
TRAIN, TEST, EMBARGO, INNER = 80, 20, 5, 25


def clean_panel(spark: SparkSession, d: str) -> DataFrame:
    """The bars that count, with positive finite prices and a volume."""
    rows = table(spark, d, "panel").select("date", canonical_ticker("ticker").alias("ticker"), *[finite(c).alias(c) for c in PRICES], "volume", "cik", "ingested_at")
    bars = latest_rows(rows, ["ticker", "date"], ["ingested_at"], [*PRICES, "volume", "cik"])
    return bars.filter(" and ".join(f"{c} > 0" for c in PRICES) + " and volume >= 0").select("date", "ticker", *PRICES, "volume", "cik")


def memberships(spark: SparkSession, d: str) -> DataFrame:
    """The membership record that counts of each ticker and effective date."""
    history = table(spark, d, "universe_history").withColumn("ticker", canonical_ticker("ticker"))
    return latest_rows(history, ["ticker", "effective_date"], ["as_of", "record_id"], ["metadata_available_date", "in_universe", "sector"])


def dated_panel(spark: SparkSession, d: str) -> DataFrame:
    """The clean panel with the sector in force on each bar's date, null while it wasn't available."""
    return asof.attach_membership(clean_panel(spark, d), memberships(spark, d), check=False).drop("in_universe", "metadata_available_date")


def benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Mean open and close of each date."""
    return clean_panel(spark, d).groupBy("date").agg(F.avg("open").alias("open"), F.avg("close").alias("close"))


def labeled(spark: SparkSession, d: str, dated: bool = False) -> DataFrame:
    """The clean panel, with ``dated`` also its sectors as of each date, with beta and forward residual returns."""
    return labels.residual_return_target((dated_panel if dated else clean_panel)(spark, d), benchmark(spark, d))


def research_frame(spark: SparkSession, d: str, names: tuple[str, ...] = SCORED, dated: bool = False) -> DataFrame:
    """Labels, features, standardised values of ``names``; with ``dated`` sectors as of each date."""
    return features.cross_section(features.raw_features(labeled(spark, d, dated)), list(names), ranks=False)


def signal_frame(spark: SparkSession, d: str, dated: bool = False) -> DataFrame:
    """The research frame with the four technical signals."""
    return signals.technical_signals(research_frame(spark, d, dated=dated), ranks=False)


def reversal_frame(spark: SparkSession, d: str) -> DataFrame:
    """Features and labels with sectors as of each date; the day's losers are expected to win."""
    return features.raw_features(labeled(spark, d, dated=True)).withColumn("signal", -F.col("return_1d"))


def reversal_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Weekly predictions of the reversal. Every clean bar has its row in the frame, so the weeks' dates are read from the bars."""
    weekly = reversal_frame(spark, d).join(backtest.weekly_dates(clean_panel(spark, d)), "date", "left_semi")
    return weekly.select("date", "ticker", F.col("signal").alias("prediction"), "sector", "beta", "stock_forward_return", "target", "dollar_volume_20d", "volatility_20d")


def reversal_book(spark: SparkSession, d: str) -> DataFrame:
    """Its neutral weekly books."""
    return portfolio.projection_portfolio(reversal_predictions(spark, d), quantile=0.2, max_weight=0.5)


def rounded(df: DataFrame, digits: int = 7) -> DataFrame:
    """Doubles rounded; -0.0 as 0.0, NaN as null."""
    return df.withColumns({c: F.round(not_nan(c), digits) + 0.0 for c, kind in df.dtypes if kind == "double"})


#: Added before dollar volumes are rounded to 2 digits: far above their last bits, and no multiple of their steps, so exact ties go one way.
NUDGE = 1.3e-5


def panel_validated(spark: SparkSession, d: str) -> DataFrame:
    """The seven columns after the panel's contracts."""
    return panel.validate_panel(clean_panel(spark, d))


def universe_screen(spark: SparkSession, d: str) -> DataFrame:
    """Lagged liquidity screen."""
    screened = panel.lagged_screen(clean_panel(spark, d), 20.0, 5_000_000.0, 20)
    return rounded(screened.select("date", "ticker", (F.col("median_dollar_volume") + NUDGE).alias("median_dollar_volume"), "eligible"), 2)


def membership_asof(spark: SparkSession, d: str) -> DataFrame:
    """The membership record in force on each bar's date, nulled while it wasn't available."""
    return asof.attach_membership(clean_panel(spark, d).select("date", "ticker", "close"), memberships(spark, d), check=False)


def facts_asof(spark: SparkSession, d: str) -> DataFrame:
    """The figures of the latest available filing, and their ratios."""
    rows = table(spark, d, "fundamental_facts").select("cik", "feature", "value", "available_date", "report_end", "filed_date").distinct()
    aligned = asof.align_facts(clean_panel(spark, d).select("date", "ticker", "cik"), rows, FIGURES)
    ratios = ("return_on_assets", "cashflow_to_assets", "equity_to_assets", "accruals_to_assets", "cashflow_to_income", "asset_growth")
    return rounded(fundamentals.fundamental_ratios(aligned).select("date", "ticker", *FIGURES, *ratios), 6)


def clean_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The replaced snapshots, one row per (as_of, ticker)."""
    rows = table(spark, d, "snapshots").withColumns({"ticker": canonical_ticker("ticker"), "gics_sector": F.initcap(F.btrim("gics_sector"))})
    last = rows.groupBy("as_of").agg(F.max("delivered_at").alias("delivered_at"))
    counted = rows.join(last, ["as_of", "delivered_at"])
    return latest_rows(counted, ["as_of", "ticker"], ["delivered_at"], ["gics_sector", "cik"])


def snapshot_change_log(spark: SparkSession, d: str) -> DataFrame:
    """Additions, removals and reclassifications."""
    return asof.change_log(clean_snapshots(spark, d))


def price_coverage(spark: SparkSession, d: str) -> DataFrame:
    """A1: price coverage of every ticker that was ever a member."""
    history = table(spark, d, "universe_history").withColumn("ticker", canonical_ticker("ticker")).select("record_id", "ticker", "effective_date", "in_universe").distinct()
    return panel.price_coverage(history, clean_panel(spark, d))


def rolling_features(spark: SparkSession, d: str) -> DataFrame:
    """Thirteen rolling features."""
    made = features.raw_features(clean_panel(spark, d)).select("date", "ticker", *features.RAW_FEATURES)
    return rounded(made.withColumn("dollar_volume_20d", F.round(F.col("dollar_volume_20d") + NUDGE, 2)), 6)


def cross_sections(spark: SparkSession, d: str) -> DataFrame:
    """Winsorised ranks, z-scores and sector ranks of all features, sectors as of each date."""
    names = list(features.RAW_FEATURES)
    raw = features.raw_features(dated_panel(spark, d)).select("date", "ticker", "sector", *names)
    return rounded(features.cross_section(raw, names, "sector").drop("sector", *names), 6)


def eligible_cross_sections(spark: SparkSession, d: str) -> DataFrame:
    """Cross-sections over all names, of which only the eligible ones are kept afterwards."""
    names = ["return_5d", "volatility_20d"]
    screened = panel.lagged_screen(clean_panel(spark, d), 20.0, 5_000_000.0, 20)
    made = features.cross_section(features.raw_features(screened), names).filter("eligible")
    return rounded(made.select("date", "ticker", *[f"{n}_{kind}" for n in names for kind in ("rank", "zscore")]), 6)


def residual_labels(spark: SparkSession, d: str) -> DataFrame:
    """Beta and forward residual returns."""
    return rounded(labeled(spark, d).select("date", "ticker", "stock_forward_return", "benchmark_forward_return", "beta", "target"), 6)


def technical_signals(spark: SparkSession, d: str) -> DataFrame:
    """Four signals and their ranks."""
    out = signals.technical_signals(research_frame(spark, d))
    return rounded(out.select("date", "ticker", *SIGNALS, *[f"{s}_rank" for s in SIGNALS]), 6)


def combined_signal(spark: SparkSession, d: str) -> DataFrame:
    """A weighted combination and its rank."""
    out = signals.combine_signals(signal_frame(spark, d), {"short_horizon_reversal": 2.0, "low_risk": -1.0})
    return rounded(out.select("date", "ticker", "combined_signal", "combined_signal_rank"), 6)


def neutral_signal(spark: SparkSession, d: str) -> DataFrame:
    """M1: a signal's residual on beta and sectors as of each date."""
    frame = reversal_frame(spark, d)
    return rounded(signals.neutralize(frame, "signal", ["beta"], "sector").select("date", "ticker", "signal_neutral"), 7)


def neutral_two_factors(spark: SparkSession, d: str) -> DataFrame:
    """M1 with several factors, sectors as of each date."""
    frame = reversal_frame(spark, d)
    return rounded(signals.neutralize(frame, "signal", ["beta", "volatility_20d"], "sector").select("date", "ticker", "signal_neutral"), 7)


def feature_coverage(spark: SparkSession, d: str) -> DataFrame:
    """A2: coverage."""
    return rounded(features.feature_coverage(features.raw_features(clean_panel(spark, d)), features.RAW_FEATURES))


def feature_correlation(spark: SparkSession, d: str) -> DataFrame:
    """A2: pooled pairwise correlation."""
    return rounded(features.pooled_correlation(features.raw_features(clean_panel(spark, d)), features.RAW_FEATURES))


def feature_ics(spark: SparkSession, d: str) -> DataFrame:
    """A2: daily correlations with the target."""
    return rounded(features.feature_ics(features.raw_features(labeled(spark, d)), features.RAW_FEATURES, "target"))


def daily_ics(spark: SparkSession, d: str) -> DataFrame:
    """A3: daily correlations of the reversal with the target."""
    return rounded(metrics.prediction_metrics(reversal_predictions(spark, d))[0])


def prediction_summary(spark: SparkSession, d: str) -> DataFrame:
    """A3: their summary."""
    return rounded(metrics.prediction_metrics(reversal_predictions(spark, d))[1])


def rolling_ics(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of the reversal averaged over the last 13 weeks."""
    return rounded(report.rolling_ic(metrics.prediction_metrics(reversal_predictions(spark, d))[0]))


def signal_summary(spark: SparkSession, d: str) -> DataFrame:
    """Coverage and rank correlation of each signal."""
    return rounded(diagnostics.signal_summary(signal_frame(spark, d), SIGNALS))


def signal_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Mean within-date rank correlation of signals."""
    return rounded(diagnostics.signal_correlation(signal_frame(spark, d), SIGNALS))


def signal_decay(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of each signal with two forward horizons."""
    longer = labels.residual_return_target(clean_panel(spark, d), benchmark(spark, d), horizon=10, target="target_10d").select("date", "ticker", "target_10d")
    return rounded(diagnostics.signal_decay(signal_frame(spark, d).join(longer, ["date", "ticker"]), SIGNALS, {5: "target", 10: "target_10d"}))


def signal_stability(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of each signal by sector as of each date."""
    return rounded(diagnostics.grouped_stability(signal_frame(spark, d, dated=True), SIGNALS, "sector", minimum=3))


def signal_years(spark: SparkSession, d: str) -> DataFrame:
    """The same by year."""
    return rounded(diagnostics.grouped_stability(signal_frame(spark, d).withColumn("year", F.year("date")), SIGNALS, "year"))


def neutral_portfolio(spark: SparkSession, d: str) -> DataFrame:
    """Neutral weekly books."""
    return rounded(reversal_book(spark, d).select("date", "ticker", "prediction", "weight"))


def exposures(spark: SparkSession, d: str) -> DataFrame:
    """Exposures of the books."""
    return rounded(portfolio.exposures(reversal_book(spark, d)))


def turnover(spark: SparkSession, d: str) -> DataFrame:
    """Turnover of the books."""
    return rounded(backtest.turnover(reversal_book(spark, d)))


def flat_backtest(spark: SparkSession, d: str) -> DataFrame:
    """Backtest with flat costs and borrow."""
    return rounded(backtest.run_backtest(reversal_book(spark, d), annual_borrow_bps=50.0))


def liquidity_backtest(spark: SparkSession, d: str) -> DataFrame:
    """Backtest with spread and impact."""
    return rounded(backtest.run_backtest(reversal_book(spark, d), cost_model="liquidity", notional=1e7))


def cost_grid(spark: SparkSession, d: str) -> DataFrame:
    """The books under a grid of costs and notionals."""
    return rounded(backtest.cost_sensitivity(reversal_book(spark, d), cost_model="liquidity", cost_bps=[2.0, 10.0], notionals=[1e6, 1e8]), 6)


def performance(spark: SparkSession, d: str) -> DataFrame:
    """Performance of the net returns."""
    return rounded(metrics.performance(backtest.run_backtest(reversal_book(spark, d)), "net_return"), 6)


def regimes(spark: SparkSession, d: str) -> DataFrame:
    """A10: performance by month."""
    tested = backtest.run_backtest(reversal_book(spark, d)).withColumn("regime", F.date_format("date", "yyyy-MM"))
    return rounded(diagnostics.regime_performance(tested, "regime"))


def monthly_equity(spark: SparkSession, d: str) -> DataFrame:
    """Month-end equity."""
    return rounded(backtest.monthly_last(metrics.equity_curve(backtest.run_backtest(reversal_book(spark, d)), "net_return"), "equity"))


def rebalance_dates(spark: SparkSession, d: str) -> DataFrame:
    """Last date of each week ending on Friday, over order dates."""
    return backtest.weekly_dates(table(spark, d, "orders"), "o_orderdate")


def business_days(spark: SparkSession, d: str) -> DataFrame:
    """Scalar date arithmetic: filing lags of 0, 1 and 3 business days."""
    days = table(spark, d, "fundamental_facts").select(F.col("filed_date").cast("date").alias("filed")).distinct()
    return days.select("filed", *[add_business_days(F.col("filed"), n).alias(f"plus_{n}") for n in (0, 1, 3)])


def prediction_ranks(spark: SparkSession, d: str) -> DataFrame:
    """X2 over the predictions: mean score of each ticker and date over runs, ranked within the date."""
    scores = table(spark, d, "predictions").select("run_id", "date", canonical_ticker("ticker").alias("ticker"), "scored_at", "prediction")
    best = latest_rows(scores, ["run_id", "date", "ticker"], ["scored_at"], ["prediction"]).withColumn("score", not_nan("prediction"))
    mean = best.groupBy("date", "ticker").agg(F.round(F.avg("score") + 1e-12, 9).alias("score"))
    return rounded(mean.withColumn("score_rank", percentile_rank(F.col("score"), ["date"])), 7)


def factor_series(spark: SparkSession, d: str) -> DataFrame:
    """Daily factors in the public file's columns, made of the panel: mean return, and differences of means between halves by feature."""
    raw = features.raw_features(clean_panel(spark, d)).select("date", "ticker", "return_1d", "dollar_volume_20d", "volatility_20d", "return_20d", "distance_ma_20d")
    ranked = raw.withColumns({f"r_{c}": percentile_rank(F.col(c), ["date"]) for c in ("dollar_volume_20d", "volatility_20d", "return_20d", "distance_ma_20d")})
    spread = lambda c: F.coalesce(F.avg(F.when(F.col(f"r_{c}") > 0.5, F.col("return_1d"))) - F.avg(F.when(F.col(f"r_{c}") <= 0.5, F.col("return_1d"))), F.lit(0.0))
    return ranked.groupBy("date").agg(
        F.coalesce(F.avg("return_1d"), F.lit(0.0)).alias("Mkt-RF"), spread("dollar_volume_20d").alias("SMB"), spread("volatility_20d").alias("HML"), spread("return_20d").alias("RMW"), spread("distance_ma_20d").alias("CMA"), F.lit(0.0001).alias("RF")
    )


def holding_factors(spark: SparkSession, d: str) -> DataFrame:
    """All factors compounded over holding periods."""
    return rounded(held_factors(spark, d), 6)


def held_factors(spark: SparkSession, d: str) -> DataFrame:
    """The factors compounded over the weekly holding periods."""
    return factors.holding_period_factors(factor_series(spark, d), backtest.weekly_dates(clean_panel(spark, d)))


def attribution(spark: SparkSession, d: str) -> DataFrame:
    """Attribution of the net returns to all factors."""
    found = factors.factor_attribution(backtest.run_backtest(reversal_book(spark, d)), held_factors(spark, d))
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in found.items()], "metric string, value double"), 6)


def market_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Attribution to the market alone."""
    found = factors.factor_attribution(backtest.run_backtest(reversal_book(spark, d)), held_factors(spark, d), columns=["Mkt-RF"])
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in found.items()], "metric string, value double"))


def deflated_sharpe(spark: SparkSession, d: str) -> DataFrame:
    """Probability after correction for four trials."""
    p = metrics.deflated_sharpe(backtest.run_backtest(reversal_book(spark, d)), "net_return", 4)
    return rounded(spark.createDataFrame([(p,)], "deflated_sharpe_probability double"), 6)


def overfitting(spark: SparkSession, d: str) -> DataFrame:
    """Overfitting probability over the daily mean returns of five groups of tickers, by their first two letters."""
    letters = F.ascii("ticker") + F.ascii(F.substring("ticker", 2, 1))
    frame = clean_panel(spark, d).withColumn("bucket", F.pmod(letters, F.lit(5)))
    daily = features.raw_features(frame).groupBy("date").agg(*[F.round(F.avg(F.when(F.col("bucket") == i, F.col("return_1d"))) + 1e-13, 9).alias(f"s{i}") for i in range(5)])
    return rounded(diagnostics.overfitting_probability(daily, [f"s{i}" for i in range(5)]))


def ridge_one_feature(spark: SparkSession, d: str) -> DataFrame:
    """M7: walk-forward ridge on one feature."""
    frame = checkpointed(features.raw_features(labeled(spark, d)).select("date", "ticker", "return_5d", "target"))
    return rounded(models.walk_forward(frame, ["return_5d"], train=TRAIN, test=TEST, embargo=EMBARGO).drop("target"))


def ridge_rolling(spark: SparkSession, d: str) -> DataFrame:
    """M7: the same with a rolling training window."""
    frame = checkpointed(features.raw_features(labeled(spark, d)).select("date", "ticker", "return_5d", "target"))
    return rounded(models.walk_forward(frame, ["return_5d"], train=TRAIN, test=TEST, embargo=EMBARGO, expanding=False).drop("target"))


def ridge_many(spark: SparkSession, d: str) -> DataFrame:
    """M7: walk-forward ridge on all standardised features."""
    columns = [f"{f}_zscore" for f in features.RAW_FEATURES]
    frame = checkpointed(research_frame(spark, d, features.RAW_FEATURES).select("date", "ticker", "target", *columns))
    return rounded(models.walk_forward(frame, columns, train=TRAIN, test=TEST, embargo=EMBARGO))


def nested_ridge(spark: SparkSession, d: str) -> DataFrame:
    """M8: predictions with the penalty chosen inside each training window."""
    frame = checkpointed(features.raw_features(labeled(spark, d)).select("date", "ticker", "return_5d", "volatility_20d", "target"))
    return rounded(models.nested_walk_forward(frame, ["return_5d", "volatility_20d"], {"light": 1.0, "heavy": 1e5}, train=TRAIN, test=TEST, embargo=EMBARGO, inner=INNER)[0])


def nested_selections(spark: SparkSession, d: str) -> DataFrame:
    """M8: what was chosen and why."""
    frame = checkpointed(features.raw_features(labeled(spark, d)).select("date", "ticker", "return_5d", "volatility_20d", "target"))
    return rounded(models.nested_walk_forward(frame, ["return_5d", "volatility_20d"], {"light": 1.0, "heavy": 1e5}, train=TRAIN, test=TEST, embargo=EMBARGO, inner=INNER)[1])


def ablation(spark: SparkSession, d: str) -> DataFrame:
    """M9: leave one feature family out."""
    frame = checkpointed(features.raw_features(labeled(spark, d)).select("date", "ticker", "return_5d", "return_20d", "volatility_20d", "relative_volume_20d", "target"))
    return rounded(models.ablation(frame, {"trend": ["return_5d", "return_20d"], "risk": ["volatility_20d"], "volume": ["relative_volume_20d"]}, train=TRAIN, test=TEST, embargo=EMBARGO))


def boosted_trees(spark: SparkSession, d: str) -> DataFrame:
    """M6: walk-forward boosted trees, 300 per fold."""
    frame = checkpointed(features.raw_features(labeled(spark, d)).select("date", "ticker", "return_5d", "volatility_20d", "target"))
    return models.walk_forward(frame, ["return_5d", "volatility_20d"], model="gbt", train=TRAIN, test=TEST, embargo=EMBARGO)


def optimized_portfolio(spark: SparkSession, d: str) -> DataFrame:
    """M4, M5: optimised books, sectors as of each date."""
    return portfolio.optimized_portfolios(reversal_predictions(spark, d), quantile=0.2, factors=["beta"], max_weight=0.3)


def signal_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Each signal's own book and backtest, sectors as of each date. Books are weekly and cross-sections within a date, so other dates are left out first."""
    raw = features.raw_features(labeled(spark, d, dated=True)).select("date", "ticker", "sector", "beta", "stock_forward_return", "target", *SCORED)
    weekly = checkpointed(raw.join(backtest.weekly_dates(raw), "date", "left_semi"))
    frame = signals.technical_signals(features.cross_section(weekly, list(SCORED), ranks=False), ranks=False)
    return rounded(backtest.evaluate_signals(frame, SIGNALS, quantile=0.2, max_weight=0.5), 6)


def json_facts(spark: SparkSession, d: str) -> DataFrame:
    """SEC-shaped JSON: the facts table written as one document per company, and read back."""
    rows = table(spark, d, "fundamental_facts").filter("value is not null").distinct()
    filing = F.struct("form", F.col("filed_date").cast("string").alias("filed"), F.col("report_end").cast("string").alias("end"), F.col("value").alias("val"), F.col("accession").alias("accn"))
    split = F.split("source_tag", ":")
    unit = F.when(F.col("feature") == "shares_outstanding", "shares").otherwise("USD")
    per_tag = rows.groupBy("cik", split[0].alias("taxonomy"), split[1].alias("tag"), unit.alias("unit")).agg(F.sort_array(F.collect_list(filing)).alias("list"))
    tags = per_tag.groupBy("cik", "taxonomy").agg(F.map_from_entries(F.collect_list(F.struct("tag", F.struct(F.map_from_arrays(F.array("unit"), F.array("list")).alias("units"))))).alias("tags"))
    payloads = tags.groupBy("cik").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("taxonomy", "tags"))).alias("facts"))).alias("payload"))
    return fundamentals.company_facts(payloads).drop("accession")


def json_tickers(spark: SparkSession, d: str) -> DataFrame:
    """SEC-shaped JSON: the panel's (ticker, company) pairs written as documents of the entries 0, 1, ..., one per company, and read back."""
    pairs = table(spark, d, "panel").select(F.lower(canonical_ticker("ticker")).alias("ticker"), "cik").filter("ticker is not null and cik is not null").distinct()
    entries = pairs.groupBy("cik").agg(F.sort_array(F.collect_set("ticker")).alias("tickers"))
    entry = lambda t, i: F.struct(i.cast("string").alias("key"), F.struct(t.alias("ticker"), F.col("cik").alias("cik_str")).alias("value"))
    return fundamentals.ticker_ciks(entries.select(F.to_json(F.map_from_entries(F.transform("tickers", entry))).alias("payload")))


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The whole run: sectors as of each date, labels, features, walk-forward ridge, weekly books, backtest, summary as (metric, value)."""
    columns = [f"{f}_zscore" for f in features.RAW_FEATURES]
    frame = checkpointed(research_frame(spark, d, features.RAW_FEATURES, dated=True).select("date", "ticker", "target", "sector", "beta", "stock_forward_return", *columns))
    scored = models.walk_forward(frame, columns, train=TRAIN, test=TEST, embargo=EMBARGO)
    context = frame.select("date", "ticker", "sector", "beta", "stock_forward_return")
    weekly = scored.join(backtest.weekly_dates(scored), "date", "left_semi").join(context, ["date", "ticker"])
    tested = backtest.run_backtest(portfolio.projection_portfolio(weekly, quantile=0.2, max_weight=0.5))
    summaries = [metrics.prediction_metrics(scored)[1], metrics.performance(tested, "net_return")]
    long = [s.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in s.columns])).alias("e")).select("e.*") for s in summaries]
    return reduce(DataFrame.unionByName, long)


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        panel_validated, universe_screen, membership_asof, facts_asof, snapshot_change_log, price_coverage, rolling_features, cross_sections, eligible_cross_sections, residual_labels, technical_signals, combined_signal, neutral_signal, neutral_two_factors,
        feature_coverage, feature_correlation, feature_ics, daily_ics, prediction_summary, rolling_ics, signal_summary, signal_correlation, signal_decay, signal_stability, signal_years, neutral_portfolio, exposures, turnover, flat_backtest, liquidity_backtest,
        cost_grid, performance, regimes, monthly_equity, rebalance_dates, business_days, prediction_ranks, holding_factors, attribution, market_attribution, deflated_sharpe, overfitting, ridge_one_feature, ridge_rolling, ridge_many, nested_ridge,
        nested_selections, ablation, boosted_trees, optimized_portfolio, signal_evaluation, json_facts, json_tickers, pipeline,
    )
}
