"""Diagnostics of signals and strategies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import require_columns
from tidemark.functions.exprs import unpivot
from tidemark.operators.metrics import daily_ic


def _ir(x: str) -> F.Column:
    spread = F.stddev_samp(x)
    return F.avg(x) / F.when(spread > 0, spread)


def signal_summary(frame: DataFrame, signals: Sequence[str], target: str = "target", minimum: int = 5) -> DataFrame:
    """(signal, coverage, rank_ic, rank_ic_ir, ic_days), best first; all signals in one pass over an unpivoted frame."""
    long = unpivot(frame, ["date", target], signals, "signal", "x")
    days = daily_ic(long, ["signal", "date"], "x", target, minimum, coverage=True)
    enough = F.col("n") >= minimum
    out = days.groupBy("signal").agg((F.sum("present") / F.sum("rows")).alias("coverage"), F.avg("rank_ic").alias("rank_ic"), _ir("rank_ic").alias("rank_ic_ir"), F.count(F.when(enough, 1)).alias("ic_days"))
    return out.orderBy(F.desc_nulls_last("rank_ic"), "signal")


def signal_correlation(frame: DataFrame, signals: Sequence[str], method: str = "spearman") -> DataFrame:
    """(signal_a, signal_b, correlation): mean over dates of the correlation within each date, over rows where both are present.

    Each unordered pair is made once and mirrored. Dates on which a pair is undefined (a constant side) are skipped; a pair that never is defined has null.
    """
    require_columns(frame, ["date", *signals], "frame")
    names = list(signals)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    entries = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs]
    long = frame.select("date", F.explode(F.array(*entries)).alias("e")).select("date", "e.*")
    which = "rank_ic" if method == "spearman" else "pearson_ic"
    mean = daily_ic(long, ["date", "a", "b"], "x", "y", 1).groupBy("a", "b").agg(F.avg(which).alias("correlation"))
    both = mean.select(F.col("a").alias("signal_a"), F.col("b").alias("signal_b"), "correlation")
    return both.unionByName(mean.filter("a <> b").select(F.col("b").alias("signal_a"), F.col("a").alias("signal_b"), "correlation"))


def signal_decay(frame: DataFrame, signals: Sequence[str], targets: Mapping[int, str], minimum: int = 5) -> DataFrame:
    """(signal, horizon_days, rank_ic, ic_days) for each signal and forward horizon."""
    entries = [F.struct(F.lit(s).alias("signal"), F.lit(h).alias("horizon_days"), F.col(s).cast("double").alias("x"), F.col(t).cast("double").alias("y")) for s in signals for h, t in sorted(targets.items())]
    long = frame.select("date", F.explode(F.array(*entries)).alias("e")).select("date", "e.*")
    ics = daily_ic(long, ["signal", "horizon_days", "date"], "x", "y", minimum)
    found = ics.groupBy("signal", "horizon_days").agg(F.avg("rank_ic").alias("rank_ic"), F.count(F.lit(1)).alias("ic_days"))
    grid = frame.sparkSession.createDataFrame([(s, h) for s in signals for h in sorted(targets)], "signal string, horizon_days int")
    return grid.join(found, ["signal", "horizon_days"], "left").withColumn("ic_days", F.coalesce("ic_days", F.lit(0).cast("bigint")))


def regime_performance(returns: DataFrame, regime: str, value: str = "net_return") -> DataFrame:
    """Count, mean, deviation and their ratio per regime; rows with a null regime or return are dropped."""
    require_columns(returns, [regime, value], "returns")
    out = returns.na.drop(subset=[regime, value]).groupBy(regime).agg(F.count(F.lit(1)).alias("observations"), F.avg(value).alias("mean_return"), F.stddev_samp(value).alias("volatility"))
    return out.withColumn("sharpe_per_period", F.col("mean_return") / F.when(F.col("volatility") > 0, F.col("volatility")))


def grouped_stability(frame: DataFrame, signals: Sequence[str], group: str, target: str = "target", minimum: int = 5) -> DataFrame:
    """(signal, group, mean_rank_ic, rank_ic_ir, ic_observations): correlation per (group, date), then per group; null groups are dropped."""
    long = unpivot(frame.filter(F.col(group).isNotNull()), ["date", group, target], signals, "signal", "x")
    ics = daily_ic(long, ["signal", group, "date"], "x", target, minimum)
    return ics.groupBy("signal", group).agg(F.avg("rank_ic").alias("mean_rank_ic"), _ir("rank_ic").alias("rank_ic_ir"), F.count(F.lit(1)).alias("ic_observations"))


def overfitting_probability(returns: DataFrame, strategies: Sequence[str], order: str = "date", partitions: int = 8) -> DataFrame:
    """One row (pbo): the part of all half-and-half splits of the blocks whose in-sample winner is at or below the median out of sample.

    Rows with any null are dropped; fewer rows than ``partitions`` raise when the plan runs. The rest is cut into ``partitions`` contiguous blocks, the first ones a row longer. The rows are reduced to sums per (block,
    strategy) before they meet the splits, of which there are at most 12,870.
    """
    require_columns(returns, [order, *strategies], "returns")
    if len(strategies) < 2:
        raise ValueError("at least two strategies are needed")
    if partitions < 2 or partitions % 2 or partitions > 16:
        raise ValueError("partitions must be even, from 2 to 16")
    clean = returns.select(order, *strategies).na.drop()
    enough = F.when(F.count(F.lit(1)).over(Window.partitionBy()) < partitions, F.raise_error(F.lit("fewer complete periods than partitions")).cast("boolean")).otherwise(True)
    clean = clean.withColumn("enough", enough).filter("enough").drop("enough")
    numbered = clean.withColumns({"i": F.row_number().over(Window.orderBy(order)) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy())})
    small, longer = F.floor(F.col("n") / partitions), F.col("n") % partitions
    edge = longer * (small + 1)
    block = F.when(F.col("i") < edge, F.floor(F.col("i") / (small + 1))).otherwise(longer + F.floor((F.col("i") - edge) / F.when(small > 0, small)))
    long = unpivot(numbered.withColumn("block", block.cast("int")), ["block"], strategies, "strategy", "r")
    sums = long.groupBy("block", "strategy").agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("n"))
    spark = returns.sparkSession
    splits = [(k, b, b in chosen) for k, chosen in enumerate(combinations(range(partitions), partitions // 2)) for b in range(partitions)]
    sides = spark.createDataFrame(splits, "split int, block int, train boolean").join(sums, "block").groupBy("split", "strategy", "train").agg((F.sum("s") / F.sum("n")).alias("mean"))
    place = spark.createDataFrame([(s, i) for i, s in enumerate(strategies)], "strategy string, place int")
    both = sides.groupBy("split", "strategy").agg(F.max(F.when(F.col("train"), F.col("mean"))).alias("inside"), F.max(F.when(~F.col("train"), F.col("mean"))).alias("outside")).join(place, "strategy")
    each = Window.partitionBy("split")
    ranked = both.withColumns(
        {
            "best": F.row_number().over(each.orderBy(F.desc("inside"), "place")),
            "rank": F.rank().over(each.orderBy("outside")) + (F.count(F.lit(1)).over(Window.partitionBy("split", "outside")) - 1) / 2,
            "of": F.count(F.lit(1)).over(each),
        }
    )
    return ranked.filter("best = 1").agg(F.avg((F.col("rank") / F.col("of") <= 0.5).cast("double")).alias("pbo"))

