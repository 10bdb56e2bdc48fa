"""Per-entity rolling features and per-date cross-sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import fresh, require_columns
from tidemark.functions.exprs import by_entity, change, clip, correlation, middle, percentile_rank, pivot, ratio, rolling, unpivot
from tidemark.operators.metrics import daily_ic

RAW_FEATURES = (
    "return_1d", "return_5d", "return_20d", "return_60d", "return_120d", "skip_momentum_20d", "distance_ma_20d", "volatility_20d",
    "downside_volatility_20d", "atr_proxy_20d", "relative_volume_20d", "volume_zscore_20d", "dollar_volume_20d",
)


def raw_features(panel: DataFrame) -> DataFrame:
    """Thirteen features of each ticker's own rows up to and including the current one; one shuffle and one sort by (ticker, date).

    Rolling values are null until their window is full (the downside deviation needs ten negative returns); nothing is filled. Null prices make the
    values that need them null.
    """
    require_columns(panel, ["date", "ticker", "high", "low", "close", "volume"], "panel")
    c, v, w = F.col("close"), F.col("volume").cast("double"), by_entity()
    first = panel.withColumns({"return_1d": change(c), "true_range": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.lag(c).over(w)), F.abs(F.col("low") - F.lag(c).over(w)))})
    r = F.col("return_1d")
    mean_v, std_v = rolling(F.avg, v, 20), rolling(F.stddev_samp, v, 20)
    return first.withColumns(
        {
            **{f"return_{k}d": change(c, k) for k in (5, 20, 60, 120)},
            "skip_momentum_20d": ratio(F.lag(c, 5).over(w), F.lag(c, 25).over(w)) - 1,
            "distance_ma_20d": ratio(c, rolling(F.avg, c, 20)) - 1,
            "volatility_20d": rolling(F.stddev_samp, r, 20),
            "downside_volatility_20d": rolling(F.stddev_samp, F.when(r < 0, r), 20, 10),
            "atr_proxy_20d": ratio(rolling(F.avg, F.col("true_range"), 20), c),
            "relative_volume_20d": ratio(v, mean_v),
            "volume_zscore_20d": ratio(v - mean_v, std_v),
            "dollar_volume_20d": rolling(middle, c * v, 20),
        }
    ).drop("true_range")


def zscores(frame: DataFrame, features: Sequence[str], winsor: float = 0.01) -> DataFrame:
    """Add ``f_zscore`` for each feature, as ``cross_section`` does. Without ranks nothing needs an order, so all features stay in one row: one shuffle on the date and unordered windows."""
    whole = Window.partitionBy("date")
    x, bound, c, mean, spread = ([fresh(frame.columns, f"{part}_{i}") for i in range(len(features))] for part in ("cs_x", "cs_bound", "cs_clipped", "cs_mean", "cs_spread"))
    step = frame.withColumns({a: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for a, f in zip(x, features, strict=True)})
    step = step.withColumns({b: F.percentile(a, F.array(F.lit(winsor), F.lit(1 - winsor))).over(whole) for a, b in zip(x, bound, strict=True)})
    step = step.withColumns({k: clip(F.col(a), F.col(b)[0], F.col(b)[1]) for k, a, b in zip(c, x, bound, strict=True)}).drop(*x, *bound)
    step = step.withColumns({**{m: F.avg(k).over(whole) for m, k in zip(mean, c, strict=True)}, **{s: F.stddev_samp(k).over(whole) for s, k in zip(spread, c, strict=True)}})
    made = {f"{f}_zscore": F.when(F.col("date").isNotNull() & (F.col(s) > 0), (F.col(k) - F.col(m)) / F.when(F.col(s) > 0, F.col(s))) for f, k, m, s in zip(features, c, mean, spread, strict=True)}
    return step.withColumns(made).drop(*c, *mean, *spread)


def cross_section(frame: DataFrame, features: Sequence[str], sector: str | None = None, winsor: float = 0.01, ranks: bool = True) -> DataFrame:
    """Add ``f_rank``, ``f_zscore`` and, with ``sector``, ``f_sector_rank`` for each feature, per date; without ``ranks`` only ``f_zscore``.

    Values are clipped to the date's [winsor, 1 - winsor] percentiles (linear interpolation), then ranked (average ties, part of the non-null count) and
    standardised (sample deviation; null where it is 0). Nulls stay null; rows of a null sector have no sector rank. The frame has one row per (date, ticker). In long
    layout all features share one shuffle on (date, feature) and one sort; the wide layout would sort each date once per feature.
    """
    require_columns(frame, ["date", "ticker", *features, *([sector] if sector else [])], "frame")
    if not 0 <= winsor < 0.5:
        raise ValueError("winsor must be in [0, 0.5)")
    if not ranks:
        return zscores(frame, features, winsor)
    keys = ["date", "ticker", *([sector] if sector else [])]
    long = unpivot(frame, keys, features, "feature", "x").filter("x is not null and not isnan(x)")
    whole = Window.partitionBy("date", "feature")
    bounds = {"lo": F.percentile("x", F.lit(winsor)).over(whole), "hi": F.percentile("x", F.lit(1 - winsor)).over(whole)}
    clipped = long.withColumns(bounds).withColumn("c", clip(F.col("x"), F.col("lo"), F.col("hi")))
    c = F.col("c")
    spread = F.stddev_samp(c).over(whole)
    done = clipped.withColumns({"rank": percentile_rank(c, ["date", "feature"]), "zscore": (c - F.avg(c).over(whole)) / F.when(spread > 0, spread)})
    kinds = ["rank", "zscore"]
    if sector:
        done = done.withColumn("sector_rank", F.when(F.col(sector).isNotNull(), percentile_rank(c, ["date", "feature", sector])))
        kinds.append("sector_rank")
    wide = pivot(done, ["date", "ticker"], "feature", {f"{f}_{k}": (f, k) for f in features for k in kinds})
    return frame.join(wide, ["date", "ticker"], "left")


def add_features(panel: DataFrame, sector: str | None = None) -> DataFrame:
    """``raw_features`` and their ``cross_section``."""
    return cross_section(raw_features(panel), RAW_FEATURES, sector)


def feature_coverage(frame: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, coverage, missing_count)."""
    long = unpivot(frame, [], features, "feature", "x")
    there = F.col("x").isNotNull() & ~F.isnan("x")
    return long.groupBy("feature").agg(F.avg(there.cast("double")).alias("coverage"), F.sum((~F.coalesce(there, F.lit(False))).cast("bigint")).alias("missing_count"))


def pooled_correlation(frame: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature_a, feature_b, correlation) over all rows where both are present, null for a constant side; one pass, each pair once, no shuffle of rows."""
    require_columns(frame, features, "frame")
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    clean = frame.select(*[F.when(~F.isnan(f), F.col(f)).cast("double").alias(f) for f in features])
    there = lambda x, y: F.when(F.col(y).isNotNull(), F.col(x))
    found = clean.agg(*[correlation(there(a, b), there(b, a)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    entry = lambda a, b, i: F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"c{i}").alias("correlation"))
    entries = [entry(*sides, i) for i, (a, b) in enumerate(pairs) for sides in ([(a, b)] if a == b else [(a, b), (b, a)])]
    return found.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def feature_ics(frame: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(date, feature, pearson_ic, rank_ic) of each date with at least five complete rows."""
    long = unpivot(frame, ["date", target], features, "feature", "x")
    return daily_ic(long, ["date", "feature"], "x", target, 5).select("date", "feature", "pearson_ic", "rank_ic")
