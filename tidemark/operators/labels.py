"""Forward labels relative to a benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import require_columns
from tidemark.functions.exprs import by_entity, change, ratio, trailing
from tidemark.operators.panel import only_rows


def benchmark_returns(benchmark: DataFrame, horizon: int, delay: int) -> DataFrame:
    """(date, benchmark_open, benchmark_close, benchmark_return_1d, benchmark_forward_return) on the benchmark's own calendar.

    The series has one row per date, so its window, though without a key, is bounded by the calendar. A repeated date raises when the plan runs.
    """
    w = Window.orderBy("date")
    o, c = F.col("benchmark_open"), F.col("benchmark_close")
    market = only_rows(benchmark.select(F.col("date").cast("date").alias("date"), F.col("open").alias("benchmark_open"), F.col("close").alias("benchmark_close")), ["date"], "benchmark has duplicate dates")
    return market.withColumns({"benchmark_return_1d": ratio(c, F.lag(c).over(w)) - 1, "benchmark_forward_return": ratio(F.lead(c, delay + horizon - 1).over(w), F.lead(o, delay).over(w)) - 1})


def residual_return_target(panel: DataFrame, benchmark: DataFrame, horizon: int = 5, beta_lookback: int = 60, delay: int = 1, target: str = "target") -> DataFrame:
    """Add stock and benchmark returns, ``beta``, forward returns and ``target`` = stock forward return - beta * benchmark forward return.

    The forward return opens ``delay`` rows after the signal row and closes ``horizon`` rows later, counting the ticker's own rows (the benchmark's on its own
    calendar). Beta is the population slope over the last ``beta_lookback`` rows, null unless all of them have both returns, and null without benchmark
    variance. The last rows of a ticker have null labels. Dates missing from the benchmark keep null benchmark columns; a benchmark with a repeated date is
    refused when the plan runs, as each panel row must meet at most one of its rows. That contract also bounds its size by the calendar (a century is 1.5 MB), so it is
    broadcast, and the panel keeps its partitioning by ticker.
    """
    require_columns(panel, ["date", "ticker", "open", "close"], "panel")
    require_columns(benchmark, ["date", "open", "close"], "benchmark")
    if horizon < 1 or delay < 1 or beta_lookback < 2:
        raise ValueError("horizon and delay must be positive, beta_lookback at least 2")
    o, c, w = F.col("open"), F.col("close"), by_entity()
    joined = panel.withColumn("date", F.col("date").cast("date")).join(F.broadcast(benchmark_returns(benchmark, horizon, delay)), "date", "left")
    forward = joined.withColumns({"stock_return_1d": change(c), "stock_forward_return": ratio(F.lead(c, delay + horizon - 1).over(w), F.lead(o, delay).over(w)) - 1})
    y, x = F.col("stock_return_1d"), F.col("benchmark_return_1d")
    span = trailing(beta_lookback)
    variance = F.var_pop(x).over(span)
    beta = F.when(F.count(y * x).over(span) == beta_lookback, F.covar_pop(y, x).over(span) / F.when(variance > 0, variance))
    return forward.withColumn("beta", beta).withColumn(target, F.col("stock_forward_return") - F.col("beta") * F.col("benchmark_forward_return"))
