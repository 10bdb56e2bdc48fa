"""Totals and averages over trailing calendar periods."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.common import require_columns


def trailing_totals(daily: DataFrame, entity: str, day: str, active: str, measures: Mapping[str, str], periods: Sequence[int] = (7, 30), bucket_days: int | None = None) -> DataFrame:
    """Totals and averages over trailing calendar days, one row per entity and day from its first to its last active day.

    ``daily`` has at most one row per (entity, day). ``active`` is a boolean column: days on which the entity was
    active (they bound its calendar). ``measures`` maps an output name to a numeric column. For each period n and measure x:
    ``x_sum_nd`` (0 where nothing was measured), ``x_days_nd`` (days with a reading) and ``x_avg_nd`` (per day with a
    reading, null without one); and ``active_days_nd``, ``days_nd`` (calendar days of the period since the first active day).

    The calendar is joined with the daily rows by range, candidates being restricted by equality of (entity, bucket),
    buckets being ``bucket_days`` wide (default: twice the longest period); a daily row is repeated in the next bucket
    only if that bucket still sees it. The aggregation after the join reuses its partitioning. A hot entity
    is spread over its buckets. Days are generated inside the buckets, after the shuffle.

    Null measures count as no reading. Rows with a null entity or day are left out; entities without an active day have
    no calendar. Empty input gives an empty result.
    """
    require_columns(daily, [entity, day, active, *measures.values()])
    longest = max(periods)
    width = bucket_days or 2 * longest
    names = list(measures)
    rows = daily.select(
        F.col(entity).alias("e"), F.datediff(F.col(day), F.lit("1970-01-01").cast("date")).alias("d"), F.coalesce(F.col(active), F.lit(False)).alias("act"), *[F.col(c).alias(f"m{i}") for i, c in enumerate(measures.values())]
    ).filter("e is not null and d is not null")
    bucket = F.expr(f"cast(floor(d / {width}) as int)")
    spans = rows.filter("act").groupBy("e").agg(F.min("d").alias("d0"), F.max("d").alias("d1"))
    days = (
        spans.select("e", "d0", "d1", F.explode(F.expr(f"sequence(cast(floor(d0 / {width}) as int), cast(floor(d1 / {width}) as int))")).alias("b"))
        .repartition("e", "b")
        .select("e", "b", "d0", F.explode(F.expr(f"sequence(greatest(d0, b * {width}), least(d1, b * {width} + {width - 1}))")).alias("day"))
    )
    reach = F.when(F.pmod(F.col("d"), F.lit(width)) > width - longest, F.array(bucket, bucket + 1)).otherwise(F.array(bucket))
    facts = rows.withColumn("b", F.explode(reach)).withColumnRenamed("e", "fe").withColumnRenamed("b", "fb")
    near = (F.col("fe") == F.col("e")) & (F.col("fb") == F.col("b")) & (F.col("d") <= F.col("day")) & (F.col("d") > F.col("day") - longest)
    joined = days.join(facts, near, "left")
    aggs = []
    for n in periods:
        within = F.col("d") > F.col("day") - n
        aggs.append(F.count(F.when(within & F.col("act"), 1)).alias(f"active_days_{n}d"))
        for i, name in enumerate(names):
            x = F.when(within, F.col(f"m{i}"))
            aggs += [F.sum(x).alias(f"{name}_sum_{n}d"), F.count(x).alias(f"{name}_days_{n}d")]
    totals = joined.groupBy("e", "b", "day", "d0").agg(*aggs)
    out = [F.col("e").alias(entity), F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).alias(day)]
    for n in periods:
        out += [F.least(F.lit(n), F.col("day") - F.col("d0") + 1).alias(f"days_{n}d"), F.col(f"active_days_{n}d")]
        for name in names:
            total, count = F.col(f"{name}_sum_{n}d"), F.col(f"{name}_days_{n}d")
            out += [F.coalesce(total, F.lit(0).cast(dict(totals.dtypes)[f"{name}_sum_{n}d"])).alias(f"{name}_sum_{n}d"), count, (total / F.when(count > 0, count)).alias(f"{name}_avg_{n}d")]
    return totals.select(*out)
