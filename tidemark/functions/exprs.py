"""Column expressions with exactly defined null, tie and warm-up behaviour."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_entity(entity: str = "ticker", order: str = "date") -> WindowSpec:
    """An entity's own rows in time order."""
    return Window.partitionBy(entity).orderBy(order)


def trailing(n: int, entity: str = "ticker", order: str = "date", end: int = 0) -> WindowSpec:
    """The last ``n`` rows of an entity up to the row ``end`` rows ahead of the current one (``end`` <= 0)."""
    return by_entity(entity, order).rowsBetween(end - n + 1, end)


def rolling(agg: Callable[[Column], Column], x: Column, n: int, min_periods: int | None = None, entity: str = "ticker", order: str = "date", end: int = 0) -> Column:
    """An aggregate of the last ``n`` rows, null unless at least ``min_periods`` (default ``n``) of them are non-null.

    The non-null rows are counted as the difference of two running counts, which cost one step a row and not ``n``.
    """
    upto = by_entity(entity, order)
    there = F.count(x).over(upto.rowsBetween(Window.unboundedPreceding, end)) - F.count(x).over(upto.rowsBetween(Window.unboundedPreceding, end - n))
    return F.when(there >= (n if min_periods is None else min_periods), agg(x).over(trailing(n, entity, order, end)))


def middle(x: Column) -> Column:
    """Exact median, also over a window frame."""
    return F.percentile(x, F.lit(0.5))


def ratio(x: Column, y: Column) -> Column:
    """x / y, null where y is 0."""
    return x / F.when(y != 0, y)


def change(x: Column, k: int = 1, entity: str = "ticker", order: str = "date") -> Column:
    """Relative change to the k-th row before; nothing is filled forward."""
    return ratio(x, F.lag(x, k).over(by_entity(entity, order))) - 1


def average_rank(x: Column, keys: Sequence[str | Column]) -> Column:
    """Rank from 1 within the keys, ties averaged, null for null; only non-null values are ranked."""
    ordered = Window.partitionBy(*keys).orderBy(x.asc_nulls_last())
    ties = Window.partitionBy(*keys, x)
    return F.when(x.isNotNull(), F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / 2)


def percentile_rank(x: Column, keys: Sequence[str | Column]) -> Column:
    """Average rank divided by the number of non-null values."""
    return average_rank(x, keys) / F.count(x).over(Window.partitionBy(*keys))


def correlation(x: Column, y: Column) -> Column:
    """Aggregate Pearson correlation, null for a constant side; both sides must be null together."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.covar_pop(x, y) / F.when(spread > 0, spread)


def clip(x: Column, low: Column, high: Column) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def mean_of_present(columns: Sequence[Column]) -> Column:
    """Row-wise mean of the non-null values, null if there are none."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    n = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return total / F.when(n > 0, n)


def add_business_days(day: Column, n: int) -> Column:
    """``n`` >= 0 weekdays later; from a weekend, n = 0 goes to Monday and counting starts at the Friday before."""
    w = F.weekday(day)
    if n == 0:
        return F.when(w > 4, F.date_add(day, F.lit(7) - w)).otherwise(day)
    start, w0 = F.date_sub(day, F.greatest(w - 4, F.lit(0))), F.least(w, F.lit(4))
    return F.date_add(start, (F.lit(n) + 2 * F.floor((w0 + n) / 5)).cast("int"))


def week_ending_friday(day: Column) -> Column:
    """The Friday on or after the day."""
    return F.next_day(F.date_sub(day, 1), "Fri")


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness (aggregate); null below 3 values."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis (aggregate); null below 4 values."""
    n = F.count(x)
    return F.when(n > 3, ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)))


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    """One row per key and column, values as double."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keys), list(columns), name, value)


def pivot(df: DataFrame, keys: Sequence[str], name: str, columns: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Back to one row per key: output column -> (name's value, value column). One value per key and name."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(name) == which, F.col(value))).alias(out) for out, (which, value) in columns.items()])
