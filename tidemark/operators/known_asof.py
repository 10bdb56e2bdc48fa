"""Attributes as they were known at an event's time, by version numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import checkpointed, fresh, require_columns


def version_points(records: DataFrame, order: Sequence[str], record_id: str, known_from: Column, valid_from: Column) -> DataFrame:
    """Days on which the record in force changes: (entity, feature, ts, known, plain).

    ``records`` has columns ``entity`` and ``feature``. A record may be attached from ``known_from`` on (availability
    respected) and, in the plain view, from ``valid_from`` on. Of all records that may be attached, the one greatest by
    (order..., record_id) is in force: ``known`` and ``plain`` are those records' ids, null where there is none yet.
    Only points at which one of the two differs from the point before remain. The input is the history, not the
    events, so it is the small side.
    """
    key = F.struct(*order, record_id)
    base = records.filter("entity is not null and feature is not null")
    none = F.lit(None)
    points = base.select("entity", "feature", known_from.alias("ts"), key.alias("known_key"), none.alias("plain_key")).unionByName(
        base.select("entity", "feature", valid_from.alias("ts"), none.alias("known_key"), key.alias("plain_key"))
    )
    so_far = Window.partitionBy("entity", "feature").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    by_day = Window.partitionBy("entity", "feature").orderBy("ts")
    forced = (
        points.filter("ts is not null")
        .groupBy("entity", "feature", "ts")
        .agg(F.max("known_key").alias("known_key"), F.max("plain_key").alias("plain_key"))
        .select("entity", "feature", "ts", F.max("known_key").over(so_far)[record_id].alias("known"), F.max("plain_key").over(so_far)[record_id].alias("plain"))
    )
    state = F.struct("known", "plain")
    return forced.withColumn("was", F.lag(state).over(by_day)).filter(F.col("was").isNull() | (F.col("was") != state)).drop("was")


def every_salt(salts: int) -> Column:
    """One row for each salt."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))


def number_events(events: DataFrame, points: DataFrame, salts: int) -> DataFrame:
    """Events with ``version``, the number of change days of their entity up to and including theirs, and ``flag``.

    ``events`` has ``entity``, ``ts``, ``salt`` and ``row`` (a struct that is carried along); ``points`` has ``entity``, ``ts`` and
    ``flag``, one row for each change day of an entity. The numbering is a cumulative count over narrow rows; ``flag``
    is that of the last change day. Events before the first change day have version 0. An entity's events are
    spread over ``salts`` windows, and its few change days repeated for each, so one entity with a third of all
    events isn't sorted in one task.
    """
    narrow = events.unionByName(points.select("entity", "ts", every_salt(salts).alias("salt"), F.lit(1).alias("step"), "flag"), allowMissingColumns=True)
    w = Window.partitionBy("entity", "salt").orderBy(F.col("ts"), F.col("step").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = narrow.withColumns({"version": F.coalesce(F.sum("step").over(w), F.lit(0)), "flag": F.last("flag", ignorenulls=True).over(w)})
    return counted.filter("step is null").select("entity", "ts", "salt", "row", "version", "flag")


def change_days(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(days, wide): numbered change days of each entity, and per (entity, version, feature) the record ids in force.

    Each change day meets each of its entity's features once, and the state is filled forward: as many rows as the result has, and those before a feature's first change.
    """
    days = points.groupBy("entity", "ts").agg(F.lit(1).alias("one")).select("entity", "ts", F.row_number().over(Window.partitionBy("entity").orderBy("ts")).alias("version"))
    grid = days.join(points.select("entity", "feature").distinct(), "entity")
    at_day = points.select("entity", "feature", "ts", F.struct("known", "plain").alias("change"))
    so_far = Window.partitionBy("entity", "feature").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = grid.join(at_day, ["entity", "feature", "ts"], "left").withColumn("state", F.last("change", ignorenulls=True).over(so_far))
    return days, filled.filter("state is not null").select("entity", "version", "feature", "state.known", "state.plain")


def attach_known(events: DataFrame, records: DataFrame, order: Sequence[str], record_id: str, known_from: Column, valid_from: Column, spread: Column, differing_only: bool = False, salts: int = 8) -> DataFrame:
    """Join each event with the record that was valid and already known at its time, per feature.

    ``events``: ``entity``, ``ts`` (date) and columns to keep. ``records``: ``entity``, ``feature`` and the columns of
    ``order``, ``record_id``. Each event gets a version number by a cumulative change count over narrow rows and is
    equi-joined with the history on (entity, version); a record that became known later is never attached. Events of an entity, also those of one long-lived version,
    are spread over ``salts`` tasks by the hash of ``spread``, in the count and in the join; the history, the small side, is repeated for each.

    Result: the events' columns, ``feature``, ``known`` (the record id to attach, null if none is known yet) and
    ``plain`` (the one without regard to availability); a name that the events have already gets a number. An event yields a row for each feature of its entity
    that has any record in force; events of a null entity, of an unknown one, with a null ``ts``, or before the entity's first record yield none.
    With ``differing_only`` only rows with known <> plain result, and other events are dropped before the join.
    Records that are never available (null ``known_from``) count in the plain view only. Repeated records change
    nothing, repeated events stay repeated; ties in ``order`` fall to the greatest record id.
    """
    require_columns(events, ["entity", "ts"], "events")
    require_columns(records, ["entity", "feature", *order, record_id], "records")
    points = checkpointed(version_points(records, order, record_id, known_from, valid_from))  # read several times below
    days, wide = change_days(points)
    if differing_only:
        wide = wide.filter(~F.coalesce(F.col("known"), F.lit(0)).eqNullSafe(F.coalesce(F.col("plain"), F.lit(0))))
        open_days = wide.groupBy("entity", "version").agg(F.lit(True).alias("flag"))
        days = days.join(open_days, ["entity", "version"], "left")
        days = days.withColumn("flag", F.coalesce("flag", F.lit(False)))
    else:
        days = days.withColumn("flag", F.lit(True))
    carried = [c for c in events.columns if c not in ("entity", "ts")]
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)]) if carried else F.lit(True)
    timed = events.filter("entity is not null and ts is not null").select("entity", "ts", F.pmod(F.xxhash64(spread), F.lit(salts)).alias("salt"), row.alias("row"))
    numbered = number_events(timed, days.select("entity", "ts", "flag"), salts).filter("version > 0 and flag").drop("flag")
    joined = numbered.join(wide.withColumn("salt", every_salt(salts)), ["entity", "version", "salt"])
    return joined.select("entity", "ts", *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(carried)], *[F.col(c).alias(fresh(events.columns, c)) for c in ("feature", "known", "plain")])
