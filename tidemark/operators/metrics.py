"""Prediction and return metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import require_columns
from tidemark.functions.exprs import average_rank, correlation, sample_kurtosis, sample_skewness


def daily_ic(frame: DataFrame, keys: Sequence[str], x: str, y: str, minimum: int = 5, coverage: bool = False) -> DataFrame:
    """Per key: (keys..., pearson_ic, rank_ic, directional_accuracy, n) of rows where x and y are present.

    Ranks are taken over complete rows only, ties averaged. Keys with fewer than ``minimum`` complete rows are left out; a constant side gives a
    null correlation and keeps its row. All windows share one shuffle on the keys. With ``coverage`` all keys stay, and ``present`` and ``rows`` count the
    rows with x and all rows, in the same pass; correlations of small keys are null then.
    """
    require_columns(frame, [*keys, x, y])
    a, b = F.col("ic_x"), F.col("ic_y")
    clean = frame.select(*keys, *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(n) for c, n in ((x, "ic_x"), (y, "ic_y"))])
    if coverage:
        whole = a.isNotNull() & b.isNotNull()
        marked = clean.withColumn("ic_present", a.isNotNull())
        both = marked.withColumns({"ic_x": F.when(whole, a), "ic_y": F.when(whole, b)})
    else:
        both = clean.filter("ic_x is not null and ic_y is not null")
    ranked = both.withColumns({"rank_x": average_rank(a, keys), "rank_y": average_rank(b, keys)})
    same = F.avg((F.signum(a) == F.signum(b)).cast("double"))
    aggs = [correlation(a, b).alias("pearson_ic"), correlation(F.col("rank_x"), F.col("rank_y")).alias("rank_ic"), same.alias("directional_accuracy"), F.count(a).alias("n")]
    if not coverage:
        return ranked.groupBy(*keys).agg(*aggs).filter(F.col("n") >= minimum)
    out = ranked.groupBy(*keys).agg(*aggs, F.count(F.when(F.col("ic_present"), 1)).alias("present"), F.count(F.lit(1)).alias("rows"))
    return out.withColumns({c: F.when(F.col("n") >= minimum, F.col(c)) for c in ("pearson_ic", "rank_ic", "directional_accuracy")})


def prediction_metrics(predictions: DataFrame, prediction: str = "prediction", target: str = "target", keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(daily, summary): correlations per (keys, date), and their means in one row (per key); undefined days are skipped in means."""
    daily = daily_ic(predictions, [*keys, "date"], prediction, target)
    spread = F.stddev_samp("rank_ic")
    summary = daily.groupBy(*keys).agg(
        F.avg("pearson_ic").alias("mean_pearson_ic"), F.avg("rank_ic").alias("mean_rank_ic"), (F.avg("rank_ic") / F.when(spread > 0, spread)).alias("rank_ic_ir"),
        F.avg("directional_accuracy").alias("directional_accuracy"), F.sum("n").alias("observations"),
    )
    return daily, summary


def strict_mean_rank_ic(predictions: DataFrame, keys: Sequence[str], prediction: str, target: str) -> DataFrame:
    """(keys..., score): mean daily rank correlation, NaN if any day's is undefined, for model selection; keys without a day have no row."""
    daily = daily_ic(predictions, [*keys, "date"], prediction, target)
    score = F.when(F.max(F.col("rank_ic").isNull()), F.lit(float("nan"))).otherwise(F.avg("rank_ic"))
    return daily.groupBy(*keys).agg(score.alias("score"))


def equity_curve(returns: DataFrame, value: str, keys: Sequence[str] = (), order: str = "date") -> DataFrame:
    """Add ``equity`` (compounded from 1) and ``drawdown`` against the peak so far, the first peak being the first equity. Null returns are dropped."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    kept = returns.filter(F.col(value).isNotNull() & ~F.isnan(value))
    return kept.withColumn("equity", F.product(1 + F.col(value)).over(so_far)).withColumn("drawdown", F.col("equity") / F.max("equity").over(so_far) - 1)


def performance(returns: DataFrame, value: str, keys: Sequence[str] = (), order: str = "date", periods_per_year: int = 52) -> DataFrame:
    """Per key: annualised return (geometric), volatility, their ratio, deepest drawdown and number of periods. No periods, no row (or nulls without keys).

    The window runs over one series of periods per key, after aggregation of whatever lies below it.
    """
    curve = equity_curve(returns, value, keys, order)
    grouped = curve.groupBy(*keys).agg(
        F.max_by("equity", order).alias("last"), (F.stddev_samp(value) * math.sqrt(periods_per_year)).alias("annualized_volatility"), F.min("drawdown").alias("maximum_drawdown"), F.count(F.lit(1)).alias("periods")
    )
    annual = F.pow(F.col("last"), F.lit(periods_per_year) / F.when(F.col("periods") > 0, F.col("periods"))) - 1
    vol = F.col("annualized_volatility")
    return grouped.withColumn("annualized_return", annual).select(*keys, "annualized_return", "annualized_volatility", (F.col("annualized_return") / F.when(vol > 0, vol)).alias("sharpe"), "maximum_drawdown", "periods")


def return_moments(returns: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per key: n, mean, std, skew and kurt (bias-corrected) of the non-missing returns."""
    x = F.when(~F.isnan(value), F.col(value))
    return returns.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), sample_skewness(x).alias("skew"), sample_kurtosis(x).alias("kurt"))


def sharpe_probability(n: int, mean: float | None, std: float | None, skew: float | None, kurt: float | None, trials: int = 1) -> float:
    """Probability that a per-period Sharpe ratio with these moments exceeds the best of ``trials`` skill-less ones; NaN below four periods or without spread."""
    if n < 4 or trials < 1 or not std:
        return math.nan
    sharpe, normal, best = mean / std, NormalDist(), 0.0
    if trials > 1:
        gamma = 0.5772156649
        best = (1 - gamma) * normal.inv_cdf(1 - 1 / trials) + gamma * normal.inv_cdf(1 - 1 / (trials * math.e))
    variance = 1 - skew * sharpe + kurt / 4 * sharpe**2
    return normal.cdf((sharpe - best) * math.sqrt(n - 1) / math.sqrt(variance)) if variance > 0 else math.nan


def deflated_sharpe(returns: DataFrame, value: str, trials: int = 1) -> float:
    """``sharpe_probability`` of a series: the cluster aggregates five moments, the normal distribution is evaluated here."""
    return sharpe_probability(*return_moments(returns, value).first(), trials)
