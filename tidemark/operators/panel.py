"""Daily panels: contracts, lagged screens and coverage audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import fresh, require_columns
from tidemark.functions.exprs import by_entity, middle, rolling

PANEL_COLUMNS = ("date", "ticker", "open", "high", "low", "close", "volume")


def refuse(df: DataFrame, rules: dict[str, F.Column]) -> None:
    """Check all rules in one pass and raise ``ValueError`` with the message of the first that any row breaks."""
    found = df.agg(*[F.max(F.coalesce(bad, F.lit(False))).alias(str(i)) for i, bad in enumerate(rules.values())]).first()
    for i, message in enumerate(rules):
        if found is not None and found[str(i)]:
            raise ValueError(message)


def refuse_duplicates(df: DataFrame, keys: list[str], message: str) -> None:
    """Raise if a key stands on more than one row; combines on the map side and stops at the first."""
    if df.groupBy(*keys).count().filter("count > 1").limit(1).collect():
        raise ValueError(message)


def only_rows(df: DataFrame, keys: list[str], message: str) -> DataFrame:
    """The same rows; a key that stands on more than one raises ``message`` when the plan runs. No job of its own: the count is a window on the keys. Keys with a null part match nothing
    and may repeat."""
    n = fresh(df.columns, "rows_of_key")
    whole = F.when(reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys]), 1)
    counted = df.withColumn(n, F.count(whole).over(Window.partitionBy(*keys)))
    return counted.filter(F.when(F.col(n) > 1, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True)).drop(n)


def standard_panel(panel: DataFrame) -> DataFrame:
    """The seven panel columns, dates as dates, tickers upper case, NaN as null. Lazy; nothing is filled or dropped."""
    require_columns(panel, PANEL_COLUMNS, "panel")
    kinds = dict(panel.dtypes)
    prices = [(F.when(~F.isnan(c), F.col(c)) if kinds[c] in ("double", "float") else F.col(c)).alias(c) for c in ("open", "high", "low", "close")]
    return panel.select(F.col("date").cast("date").alias("date"), F.upper("ticker").alias("ticker"), *prices, "volume")


def validate_panel(panel: DataFrame) -> DataFrame:
    """``standard_panel`` after its contracts: unique (date, ticker), positive close, volume not negative.

    Null prices pass (a missing close is not a wrong one). Raises ``ValueError``; an empty panel is valid.
    """
    clean = standard_panel(panel)
    refuse_duplicates(clean, ["date", "ticker"], "panel has duplicate (date, ticker) rows")
    refuse(clean, {"close must be positive": F.col("close") <= 0, "volume must not be negative": F.col("volume") < 0})
    return clean


def validate_point_in_time(panel: DataFrame, membership: str = "in_universe", available: str = "metadata_available_date") -> None:
    """Raise unless every row has valid dates, metadata known on or before its date, and a stated membership."""
    require_columns(panel, ["date", "ticker", membership, available], "panel")
    day, known = (F.expr(f"try_cast(`{c}` as date)") for c in ("date", available))
    refuse(
        panel,
        {
            "metadata dates must be valid": day.isNull() | known.isNull(),
            "metadata is available only after its date": known > day,
            "membership must be stated": F.col(membership).isNull(),
        },
    )


def lagged_screen(panel: DataFrame, min_price: float, min_median_dollar_volume: float, lookback: int, membership: str | None = None) -> DataFrame:
    """Add ``dollar_volume``, ``median_dollar_volume`` and ``eligible``, from data before each row only.

    The median runs over the ``lookback`` rows before the current one and is null unless all of them have a value; the price is that of the row
    before. A condition on a null is not met. With ``membership`` that boolean column must hold as well. All columns are kept.
    """
    require_columns(panel, [*PANEL_COLUMNS, *([membership] if membership else [])], "panel")
    if lookback < 1:
        raise ValueError("lookback must be at least one row")
    valued = panel.withColumn("dollar_volume", F.col("close") * F.col("volume"))
    median = rolling(middle, F.col("dollar_volume"), lookback, end=-1)
    passed = (F.lag("close").over(by_entity()) >= min_price) & (F.col("median_dollar_volume") >= min_median_dollar_volume)
    if membership:
        passed = passed & F.col(membership)
    return valued.withColumn("median_dollar_volume", median).withColumn("eligible", F.coalesce(passed, F.lit(False)))


def price_coverage(history: DataFrame, prices: DataFrame) -> DataFrame:
    """Every ticker that was ever a member, with its price coverage; those without any price first."""
    require_columns(history, ["ticker", "effective_date", "in_universe"], "history")
    require_columns(prices, ["ticker", "date"], "prices")
    members = (
        history.filter("in_universe").groupBy(F.upper("ticker").alias("ticker")).agg(F.min(F.col("effective_date").cast("date")).alias("first_membership_date"), F.count("*").alias("membership_add_events"))
    )
    seen = prices.groupBy(F.upper("ticker").alias("ticker")).agg(F.count("*").alias("price_observations"), F.min(F.col("date").cast("date")).alias("first_price_date"), F.max(F.col("date").cast("date")).alias("last_price_date"))
    out = members.join(seen, "ticker", "left").withColumn("price_observations", F.coalesce("price_observations", F.lit(0).cast("bigint")))
    late = F.coalesce(F.col("first_price_date") > F.col("first_membership_date"), F.lit(False))
    return out.withColumn("missing_all_prices", F.col("price_observations") == 0).withColumn("price_starts_after_membership", late).orderBy(F.desc("missing_all_prices"), "ticker")
