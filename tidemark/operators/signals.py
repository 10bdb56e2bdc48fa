"""Cross-sectional signals: library, combination and neutralisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import fresh, require_columns
from tidemark.functions.exprs import mean_of_present, percentile_rank

TECHNICAL_SIGNALS = ("intermediate_momentum", "short_horizon_reversal", "low_risk", "liquidity_quality")
RISK = ("volatility_20d_zscore", "downside_volatility_20d_zscore", "atr_proxy_20d_zscore")
LIQUIDITY = ("dollar_volume_20d_zscore", "relative_volume_20d_zscore")


def technical_signals(frame: DataFrame, ranks: bool = True) -> DataFrame:
    """Add four signals made of standardised features and, with ``ranks``, each one's percentile rank per date.

    Differences are null if a part is null; means take what is present.
    """
    require_columns(frame, ["date", "return_1d_zscore", "return_5d_zscore", "return_60d_zscore", *RISK, *LIQUIDITY], "frame")
    made = frame.withColumns(
        {
            "intermediate_momentum": F.col("return_60d_zscore") - F.col("return_5d_zscore"),
            "short_horizon_reversal": -F.col("return_1d_zscore"),
            "low_risk": -mean_of_present([F.col(c) for c in RISK]),
            "liquidity_quality": mean_of_present([F.col(c) for c in LIQUIDITY]),
        }
    )
    return made.withColumns({f"{s}_rank": percentile_rank(F.col(s), ["date"]) for s in TECHNICAL_SIGNALS}) if ranks else made


def combine_signals(frame: DataFrame, weights: Mapping[str, float], output: str = "combined_signal") -> DataFrame:
    """Weighted sum over the sum of absolute weights, null if any part is null, and its rank per date."""
    require_columns(frame, ["date", *weights], "frame")
    total = sum(abs(w) for w in weights.values())
    if not total:
        raise ValueError("give at least one signal a weight that isn't zero")
    value = sum((F.col(s) * F.lit(float(w)) for s, w in weights.items()), F.lit(0.0)) / F.lit(float(total))
    return frame.withColumn(output, value).withColumn(f"{output}_rank", percentile_rank(F.col(output), ["date"]))


def projected_residual(frame: DataFrame, x: str, factors: Sequence[str], keys: Sequence[str], sector: str | None, output: str) -> DataFrame:
    """Add the residual of x on a constant, sector dummies and factors, per key: all are demeaned within sectors, then each factor in turn is projected out of x and of the factors
    after it.

    Equal to the least-squares residual, also where a factor is constant within sectors or depends on those before it (then nothing more is subtracted). All columns must be
    non-null in keys whose residual is used. Every step is window sums over the same keys, so there is one shuffle, whatever the number of factors.
    """
    inner, whole = Window.partitionBy(*keys, *([sector] if sector else [])), Window.partitionBy(*keys)
    names = [fresh(frame.columns, f"res_{i}") for i in range(len(factors) + 1)]
    size = [fresh(frame.columns, f"res_size_{i}") for i in range(len(factors))]
    step = frame.withColumns({**{n: F.col(c) - F.avg(c).over(inner) for n, c in zip(names, [*factors, x], strict=True)}, **{n: F.sum(F.col(f) * F.col(f)).over(whole) for n, f in zip(size, factors, strict=True)}})
    for i in range(len(factors)):
        f = F.col(names[i])
        own = F.sum(f * f).over(whole)
        slope = lambda c, f=f, own=own, i=i: F.when(own > 1e-20 * F.col(size[i]), F.sum(F.col(c) * f).over(whole) / F.when(own > 0, own)).otherwise(0.0)
        step = step.withColumns({c: F.col(c) - slope(c) * f for c in names[i + 1 :]})
    return step.withColumn(output, F.col(names[-1])).drop(*names, *size)


def neutralize(frame: DataFrame, signal: str, factors: Sequence[str] = ("beta",), sector: str | None = "sector", output: str | None = None) -> DataFrame:
    """Add the signal's residual per date on factors and sectors.

    Rows with a null in the signal, a factor or the sector, and dates with no more complete rows than factors plus one, get null. All is window arithmetic over complete and other rows of a date apart, in one pass.
    """
    factors = list(factors)
    name = output or f"{signal}_neutral"
    used = list(dict.fromkeys([signal, *factors, *([sector] if sector else [])]))
    require_columns(frame, ["date", "ticker", *used], "frame")
    kinds, whole, size = dict(frame.dtypes), fresh(frame.columns, "res_complete"), fresh(frame.columns, "res_n")
    there = reduce(lambda x, y: x & y, [F.col(c).isNotNull() & (~F.isnan(c) if kinds[c] in ("double", "float") else F.lit(True)) for c in used])
    marked = frame.withColumn(whole, there).withColumn(size, F.count(F.lit(1)).over(Window.partitionBy("date", whole)))
    residual = fresh(frame.columns, "res_out")
    done = projected_residual(marked, signal, factors, ["date", whole], sector, residual)
    return done.withColumn(name, F.when(F.col(whole) & (F.col(size) > len(factors) + 1), F.col(residual))).drop(whole, size, residual)
