"""Rebalance dates, turnover, costs and periodic backtests."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import checkpointed, require_columns
from tidemark.functions.exprs import week_ending_friday
from tidemark.operators.metrics import performance, prediction_metrics, return_moments, sharpe_probability
from tidemark.operators.panel import only_rows, refuse
from tidemark.operators.portfolio import projection_portfolio


def weekly_dates(frame: DataFrame, date: str = "date") -> DataFrame:
    """(date): the last date present in each week ending on Friday; null dates are ignored."""
    day = F.col(date).cast("date")
    return frame.filter(day.isNotNull()).groupBy(week_ending_friday(day).alias("week")).agg(F.max(day).alias("date")).select("date")


def monthly_last(frame: DataFrame, value: str, date: str = "date") -> DataFrame:
    """(month_end, value): the value of the last date of each month."""
    return frame.groupBy(F.last_day(date).alias("month_end")).agg(F.max_by(value, date).alias(value))


def rebalance_sums(weights: DataFrame, value: str, keys: Sequence[str] = (), liquidity: bool = False, dollar_volume: str = "dollar_volume_20d", volatility: str = "volatility_20d") -> DataFrame:
    """Everything a backtest needs, per (keys, date): gross, long_leg, short_leg, short_weight, turnover, impact, n_positions.

    Names without a return are not traded; a date without any is skipped, and the book before is the last date's that has one. Turnover is half the sum of absolute
    changes over the union of both books (the first book against nothing). ``impact`` is the sum over current names of half the traded weight times
    volatility times the root of traded weight per unit of dollar volume, so that costs at any notional follow without another pass.

    The books are numbered per key by distinct date and joined with themselves, so a name that is absent for one date counts as weight 0 there. The chosen
    names are written to the checkpoint folder first, so whatever made them runs once and not for each side of the join.
    """
    extra = [dollar_volume, volatility] if liquidity else []
    require_columns(weights, [*keys, "date", "ticker", "weight", value, *extra], "weights")
    held = weights.select(*keys, "date", "ticker", F.col("weight").cast("double").alias("weight"), F.col(value).cast("double").alias("ret"), *extra).filter("ret is not null and not isnan(ret)")
    held = checkpointed(held)
    w = Window.partitionBy(*keys).orderBy("date")
    days = held.select(*keys, "date").distinct().withColumns({"k": F.row_number().over(w), "later": F.lead("date").over(w)})
    numbered = held.join(days, [*keys, "date"])
    now = numbered.drop("later")
    was = numbered.filter("later is not null").select(*keys, (F.col("k") + 1).alias("k"), "ticker", F.col("weight").alias("before"), "later")
    both = now.join(was, [*keys, "k", "ticker"], "full_outer")
    move = F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))
    gain = F.col("weight") * F.col("ret")
    impact = F.when(F.col("weight").isNotNull(), move / 2 * F.col(volatility) * F.sqrt(move / F.col(dollar_volume))) if liquidity else F.lit(None).cast("double")
    return both.groupBy(*keys, F.coalesce("date", "later").alias("date")).agg(
        F.sum(gain).alias("gross"), F.coalesce(F.sum(F.when(F.col("weight") > 0, gain)), F.lit(0.0)).alias("long_leg"), F.coalesce(F.sum(F.when(F.col("weight") < 0, gain)), F.lit(0.0)).alias("short_leg"),
        F.coalesce(F.sum(F.when(F.col("weight") < 0, -F.col("weight"))), F.lit(0.0)).alias("short_weight"), F.sum(move / 2).alias("turnover"), F.sum(impact).alias("impact"), F.count("weight").alias("n_positions"),
    )


def trading_cost(model: str, bps: F.Column, notional: F.Column, impact_coefficient: float) -> F.Column:
    """Cost of a rebalance from its sums: turnover times ``bps``, plus, in the liquidity model, square-root impact."""
    flat = F.col("turnover") * bps / 10_000
    return flat if model == "flat" else flat + F.lit(impact_coefficient) * F.sqrt(notional) * F.col("impact")


def turnover(weights: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., date, turnover) of every book against the one before."""
    return rebalance_sums(weights.withColumn("ret", F.lit(0.0)), "ret", keys).select(*keys, "date", "turnover")


def check_costs(weights: DataFrame, value: str, model: str, numbers: Sequence[float], dollar_volume: str, volatility: str) -> None:
    """Raise for an unknown model, negative parameters, or liquidity inputs that are missing or not positive on a traded row."""
    if model not in ("flat", "liquidity"):
        raise ValueError("the cost model is 'flat' or 'liquidity'")
    if min(numbers) < 0:
        raise ValueError("cost parameters must not be negative")
    if model == "liquidity":
        require_columns(weights, [dollar_volume, volatility], "weights")
        adv, vol = F.col(dollar_volume), F.col(volatility)
        bad = adv.isNull() | vol.isNull() | F.isnan(adv) | F.isnan(vol) | (adv <= 0) | (vol < 0)
        refuse(weights.filter(F.col(value).isNotNull()), {"liquidity inputs must be present, dollar volume positive": bad})


def with_returns(weights: DataFrame, returns: DataFrame | None, value: str, keys: Sequence[str]) -> DataFrame:
    """The weights with the return column, joined one to one unless they have it already; a repeated (keys..., date, ticker) on either side raises when the plan runs."""
    if value in weights.columns or returns is None:
        return weights
    on = [*keys, "date", "ticker"]
    single = only_rows(weights, on, "weights have duplicate (date, ticker) rows")
    return single.join(only_rows(returns.select(*on, value), on, "returns have duplicate (date, ticker) rows"), on, "left")


def run_backtest(
    weights: DataFrame, returns: DataFrame | None = None, value: str = "stock_forward_return", keys: Sequence[str] = (), cost_model: str = "flat", cost_bps: float = 10.0, half_spread_bps: float = 2.0, impact_coefficient: float = 0.1,
    notional: float = 1_000_000.0, annual_borrow_bps: float = 0.0, periods_per_year: int = 52, dollar_volume: str = "dollar_volume_20d", volatility: str = "volatility_20d",
) -> DataFrame:
    """Gross and net return, legs, turnover and costs of each rebalance (per key). Weights are those of the signal date, returns start after it."""
    check_costs(weights, value, cost_model, [cost_bps, half_spread_bps, impact_coefficient, notional, annual_borrow_bps], dollar_volume, volatility)
    sums = rebalance_sums(with_returns(weights, returns, value, keys), value, keys, cost_model == "liquidity", dollar_volume, volatility)
    bps = half_spread_bps if cost_model == "liquidity" else cost_bps
    costed = sums.withColumns({"trading_cost": trading_cost(cost_model, F.lit(float(bps)), F.lit(float(notional)), impact_coefficient), "borrow_cost": F.col("short_weight") * (annual_borrow_bps / 10_000 / periods_per_year)})
    cost = F.col("trading_cost") + F.col("borrow_cost")
    return costed.select(
        *keys, "date", F.col("gross").alias("gross_return"), (F.col("gross") - cost).alias("net_return"), F.col("long_leg").alias("long_leg_return"), F.col("short_leg").alias("short_leg_return"), "turnover", "trading_cost", "borrow_cost",
        cost.alias("transaction_cost"), "n_positions",
    )


def cost_sensitivity(
    weights: DataFrame, returns: DataFrame | None = None, value: str = "stock_forward_return", cost_model: str = "flat", cost_bps: Sequence[float] = (10.0,), notionals: Sequence[float] = (1_000_000.0,), impact_coefficient: float = 0.1, annual_borrow_bps: float = 0.0,
    dollar_volume: str = "dollar_volume_20d", volatility: str = "volatility_20d",
) -> DataFrame:
    """Performance of the same books under each combination of cost and notional. The books are joined once; the grid is applied to the sums per date."""
    if not cost_bps or not notionals or min(cost_bps) < 0 or min(notionals) <= 0:
        raise ValueError("costs must not be negative, notionals positive, and neither empty")
    check_costs(weights, value, cost_model, [impact_coefficient, annual_borrow_bps], dollar_volume, volatility)
    sums = rebalance_sums(with_returns(weights, returns, value, ()), value, (), cost_model == "liquidity", dollar_volume, volatility)
    grid = [F.struct(F.lit(float(c)).alias("cost_assumption_bps"), F.lit(float(n)).alias("portfolio_notional")) for c in cost_bps for n in notionals]
    points = sums.withColumn("point", F.explode(F.array(*grid))).select("*", "point.*").drop("point")
    borrow = F.col("short_weight") * (annual_borrow_bps / 10_000 / 52)
    costed = points.withColumn("trading_cost", trading_cost(cost_model, F.col("cost_assumption_bps"), F.col("portfolio_notional"), impact_coefficient)).withColumn("net_return", F.col("gross") - F.col("trading_cost") - borrow)
    keys = ["cost_assumption_bps", "portfolio_notional"]
    means = costed.groupBy(*keys).agg(F.avg("turnover").alias("mean_turnover"), F.avg("trading_cost").alias("mean_trading_cost"))
    kind = "half_spread" if cost_model == "liquidity" else "flat_turnover_cost"
    return means.join(performance(costed, "net_return", keys), keys, "left").withColumns({"cost_model": F.lit(cost_model), "cost_assumption_type": F.lit(kind)})


def evaluate_signals(
    frame: DataFrame, signals: Sequence[str], target: str = "target", value: str = "stock_forward_return", cost_bps: float = 10.0, quantile: float = 0.1, max_weight: float = 0.05, cost_model: str = "flat", **costs: float
) -> DataFrame:
    """One row per signal: its book on weekly dates backtested under the same rules, with its correlations and deflated Sharpe probability.

    All signals go through one plan, the signal being part of every key. ``cost_model`` and ``costs`` are those of the backtest; ``liquidity`` needs dollar_volume_20d and volatility_20d. ``status`` is ``no_feasible_portfolios`` where no date has a book.
    """
    context = ["date", "ticker", "sector", "beta", value, target, *(["dollar_volume_20d", "volatility_20d"] if cost_model == "liquidity" else [])]
    require_columns(frame, [*context, *signals], "frame")
    spark = frame.sparkSession
    used = frame.select(*context, *signals)
    weekly = checkpointed(used.join(weekly_dates(frame), "date", "left_semi"))
    entries = [F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("prediction")) for s in signals]
    long = weekly.select(*context, F.explode(F.array(*entries)).alias("e")).select("*", "e.*").drop("e").filter("prediction is not null")
    books = projection_portfolio(long, "prediction", quantile, "sector", "beta", max_weight, ["signal", "date"])
    tests = checkpointed(run_backtest(books, None, value, ["signal"], cost_model=cost_model, cost_bps=cost_bps, **costs))
    perf = tests.groupBy("signal").agg(F.avg("turnover").alias("mean_turnover")).join(performance(tests, "net_return", ["signal"]), "signal")
    chances = {s: math.nan for s in signals} | {r["signal"]: sharpe_probability(*r[1:], len(signals)) for r in return_moments(tests, "net_return", ["signal"]).collect()}
    dsr = spark.createDataFrame([(s, None if math.isnan(p) else p) for s, p in chances.items()], "signal string, deflated_sharpe_probability double")
    ics = prediction_metrics(long, "prediction", target, ["signal"])[1]
    out = dsr.join(perf, "signal", "left").join(ics, "signal", "left")
    there = F.col("periods").isNotNull()
    shown = [F.when(there, F.col(c)).alias(c) for c in out.columns if c != "signal"]
    return out.select("signal", F.when(there, "evaluated").otherwise("no_feasible_portfolios").alias("status"), *shown)
