"""Backward as-of joins of whole records, and change logs from snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import fresh, require_columns
from tidemark.operators.panel import refuse, refuse_duplicates


def asof_join(left: DataFrame, right: DataFrame, entity: str, left_time: str, right_time: str, output: str, salts: int = 1) -> DataFrame:
    """Add to each left row, as struct ``output``, the last right row of its entity with ``right_time`` <= ``left_time``.

    One shuffle and one sort by (entity, time): both sides are stacked, right rows first at equal times, and the last record so far is
    carried. It is carried as a whole, so a null in the latest record is not filled from an older one. Left rows without an
    entity, a time or a record keep a null struct. ``salts`` > 1 spreads a hot entity's left rows and repeats its (few)
    records; the right side has at most one row per (entity, time), else the one greatest by all columns is taken.
    """
    require_columns(left, [entity, left_time], "left")
    require_columns(right, [entity, right_time], "right")
    e, t, side, rec, row, salt = "asof_entity", "asof_time", "asof_side", "asof_record", "asof_row", "asof_salt"
    records = right.select(F.col(entity).alias(e), F.col(right_time).cast("date").alias(t), F.lit(0).alias(side), F.struct(*right.columns).alias(rec)).filter(f"{e} is not null and {t} is not null")
    events = left.select(F.col(entity).alias(e), F.col(left_time).cast("date").alias(t), F.lit(1).alias(side), F.struct(*left.columns).alias(row))
    keys = [e]
    if salts > 1:
        keys = [e, salt]
        events = events.withColumn(salt, F.pmod(F.xxhash64(t), F.lit(salts)))
        records = records.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    both = events.unionByName(records, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col(t).asc_nulls_first(), side, F.col(rec).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn(output, F.last(rec, ignorenulls=True).over(w)).filter(f"{side} = 1")
    usable = F.when(F.col(e).isNotNull() & F.col(t).isNotNull(), F.col(output))
    # The entity is handed on as the window's own key, so what follows by entity needs no other shuffle.
    return carried.select(*[F.col(e).alias(c) if c == entity else F.col(row)[c].alias(c) for c in left.columns], usable.alias(output))


def attach_membership(panel: DataFrame, history: DataFrame, effective: str = "effective_date", available: str = "metadata_available_date", check: bool = True) -> DataFrame:
    """Attach to each price row the membership record in force on its date.

    Before a ticker's first record, and for tickers without any, ``in_universe`` is false, ``available`` is the row's date and the other attributes are
    null. Attributes of a record that is available only after the row's date are null. With ``check`` the history's contracts are
    verified first (valid dates, availability not after the effective date, unique (ticker, effective)).
    """
    require_columns(history, ["ticker", "in_universe", effective, available], "history")
    source = history.withColumns({"ticker": F.upper("ticker"), effective: F.col(effective).cast("date"), available: F.col(available).cast("date")})
    if check:
        refuse(source, {"history dates must be valid": F.col(effective).isNull() | F.col(available).isNull(), "history is known only after its effective date": F.col(available) > F.col(effective)})
        refuse_duplicates(source, ["ticker", effective], "history has duplicate (ticker, effective date) records")
    name = fresh([*panel.columns, *history.columns], "record")
    joined = asof_join(panel.withColumn("ticker", F.upper("ticker")), source, "ticker", "date", effective, name)
    record, day = F.col(name), F.col("date").cast("date")
    unknown = record.isNull() | record["in_universe"].isNull()
    known = unknown | (record[available] <= day)
    kept = [c for c in history.columns if c not in ("ticker", effective, available, "in_universe")]
    return joined.select(
        *[c for c in panel.columns if c not in (*kept, "in_universe", available)],
        F.when(known, F.when(unknown, F.lit(False)).otherwise(record["in_universe"])).alias("in_universe"),
        F.when(known, F.when(unknown, day).otherwise(record[available])).alias(available),
        *[F.when(known, record[c]).alias(c) for c in kept],
    )


def align_facts(panel: DataFrame, facts: DataFrame, features: Sequence[str], entity: str | None = None, salts: int = 1) -> DataFrame:
    """Attach, as one column per feature, the facts of the latest ``available_date`` on or before each row's date.

    Facts of one (entity, available_date) form a record; of several values of a feature the last non-null one by (report_end, filed_date) counts. A
    feature that the latest record lacks is null even if an older record has it. Rows without an entity or history keep nulls. ``entity`` defaults to what both sides have: the company
    number, else the ticker (upper case); ``ValueError`` without either.
    """
    if entity is None:
        shared = [c for c in ("cik", "ticker") if c in panel.columns and c in facts.columns]
        if not shared:
            raise ValueError("panel and facts share neither cik nor ticker")
        entity = shared[0]
    if entity == "ticker":
        panel, facts = panel.withColumn("ticker", F.upper("ticker")), facts.withColumn("ticker", F.upper("ticker"))
    require_columns(panel, ["date", entity], "panel")
    require_columns(facts, [entity, "feature", "value", "available_date"], "facts")
    order = [c for c in ("report_end", "filed_date") if c in facts.columns]
    value = F.when(~F.isnan("value"), F.col("value"))
    key = F.struct(*order, value) if order else F.struct(value)
    last = [F.max_by(value, F.when(value.isNotNull() & (F.col("feature") == f), key)).alias(f) for f in features]
    wide = facts.filter("value is not null and not isnan(value)").groupBy(entity, F.col("available_date").cast("date").alias("available_date")).agg(*last)
    name = fresh([*panel.columns, *features], "record")
    joined = asof_join(panel, wide, entity, "date", "available_date", name, salts)
    return joined.select(*[c for c in panel.columns if c not in features], *[F.col(name)[f].alias(f) for f in features])


def change_log(snapshots: DataFrame, metadata: Sequence[str] = ("gics_sector", "cik", "name", "gics_sub_industry"), check: bool = True) -> DataFrame:
    """Additions, removals and reclassifications between consecutive snapshots, as membership records.

    ``effective_date`` and ``metadata_available_date`` are the later snapshot's date; a removal keeps the last known attributes; null and null are
    unchanged. The first snapshot adds all its members. Snapshots are numbered by distinct date, so a ticker's absence from the very next snapshot is
    a removal whenever it returns. ``gics_sector`` is named ``sector``.
    """
    require_columns(snapshots, ["as_of", "ticker"], "snapshots")
    kept = [c for c in metadata if c in snapshots.columns]
    rows = snapshots.select(F.col("as_of").cast("date").alias("as_of"), F.replace(F.upper("ticker"), F.lit("."), F.lit("-")).alias("ticker"), *kept)
    if check:
        refuse(rows, {"snapshots need valid dates and tickers": F.col("as_of").isNull() | F.col("ticker").isNull() | (F.col("ticker") == "")})
        refuse_duplicates(rows, ["as_of", "ticker"], "snapshots have duplicate (date, ticker) rows")
    days = rows.select("as_of").distinct().withColumns({"k": F.row_number().over(Window.orderBy("as_of")), "next": F.lead("as_of").over(Window.orderBy("as_of"))})
    numbered = rows.join(days, "as_of")
    now = numbered.select("k", "ticker", "as_of", F.struct(F.lit(1).alias("there"), *kept).alias("now"))
    was = numbered.filter("next is not null").select((F.col("k") + 1).alias("k"), "ticker", F.col("next").alias("later"), F.struct(F.lit(1).alias("there"), *kept).alias("was"))
    both = now.join(was, ["k", "ticker"], "full_outer").filter(~F.col("now").eqNullSafe(F.col("was")))
    day, seen = F.coalesce("as_of", "later"), F.coalesce("now", "was")
    names = {"gics_sector": "sector"}
    return both.select("ticker", day.alias("effective_date"), day.alias("metadata_available_date"), F.col("now").isNotNull().alias("in_universe"), *[seen[c].alias(names.get(c, c)) for c in kept])
