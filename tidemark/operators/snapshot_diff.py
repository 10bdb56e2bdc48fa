"""What changed between consecutive full snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import require_columns, row_hash


def snapshot_axis(df: DataFrame, snapshot: str, delivered: str | None) -> DataFrame:
    """(snapshot, delivered, k, next_snapshot): each snapshot's counting delivery and its successor.

    The window has no key, but it runs over distinct snapshots, after an aggregate that combines on the map side. It is joined as a table.
    """
    order = Window.orderBy(snapshot)
    known = df.filter(F.col(snapshot).isNotNull())
    axis = known.groupBy(snapshot).agg(F.max(delivered).alias("axis_delivered")) if delivered else known.select(snapshot).distinct()
    return axis.withColumn("axis_k", F.row_number().over(order)).withColumn("axis_next", F.lead(snapshot).over(order))


def snapshot_diff(df: DataFrame, snapshot: str, key: Mapping[str, Column], compare: Sequence[Column], delivered: str | None = None) -> DataFrame:
    """Records added, removed or changed between each two consecutive snapshots.

    ``key`` names the primary key's columns and their canonical expressions; ``compare`` are the canonical values
    whose change counts. If a snapshot was delivered more than once, the delivery with the greatest ``delivered``
    replaces the others as a whole. Each record becomes (snapshot ordinal, key, 128-bit hash of the values); a full
    outer join of ordinal k with ordinal k-1 on the key gives additions and removals by the missing side and changes by
    unequal hashes.

    Result: (snapshot, key..., change). The first snapshot yields nothing. Null equals null and differs from every
    value. Rows with a null snapshot or a null key part are no records and are left out. Exact repetitions count once;
    if a key stands in a snapshot with several values, the greatest hash counts. Empty input gives an empty result.
    """
    require_columns(df, [snapshot, *([delivered] if delivered else [])])
    names = list(key)
    axis = snapshot_axis(df, snapshot, delivered).withColumnRenamed(snapshot, "axis_snapshot")
    rows = df.select(
        F.col(snapshot).alias("snap"),
        (F.col(delivered) if delivered else F.lit(None)).alias("snap_delivered"),
        *[c.alias(f"key_{i}") for i, c in enumerate(key.values())],
        row_hash(compare).alias("hash"),
    )
    match = F.col("snap") == F.col("axis_snapshot")
    if delivered:
        match = match & F.col("snap_delivered").eqNullSafe(F.col("axis_delivered"))
    keys = [f"key_{i}" for i in range(len(names))]
    counted = (
        rows.filter(" and ".join(f"{k} is not null" for k in keys)).join(axis, match).groupBy("axis_k", "snap", "axis_next", *keys).agg(F.max("hash").alias("hash"))
    )
    now = counted.select(F.col("axis_k").alias("k"), "snap", *keys, "hash")
    before = counted.filter(F.col("axis_next").isNotNull()).select((F.col("axis_k") + 1).alias("k"), F.col("axis_next").alias("snap_after"), *keys, F.col("hash").alias("hash_before"))
    both = now.join(before, ["k", *keys], "full_outer")
    change = F.when(F.col("hash_before").isNull(), "added").when(F.col("hash").isNull(), "removed").when(F.col("hash") != F.col("hash_before"), "changed")
    return (
        both.filter(F.col("k") > 1)
        .select(F.coalesce("snap", "snap_after").alias(snapshot), *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], change.alias("change"))
        .filter(F.col("change").isNotNull())
    )
