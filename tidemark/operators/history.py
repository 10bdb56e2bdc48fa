"""Full history of changing attributes, from presence bitmaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import latest_rows, require_columns, row_hash

WORD = 64


def version_history(updates: DataFrame, entity: str, effective: str, attributes: Sequence[str], delivered: str) -> DataFrame:
    """Versions of ``attributes`` with the period in which each was valid: (entity, attributes..., valid_from, valid_to).

    Of the updates of one (entity, effective) the one with the greatest ``delivered`` counts. An entity's updates are
    numbered in order of ``effective``; every (entity, hash of the attributes) gets a bitmap, in words of 64 bits, with
    one bit set per number at which the entity had those attributes. A run of consecutive set bits is one version: it
    begins at each bit whose lower neighbour is clear, ``bits & ~(bits << 1 | carry)``. Gaps end a run of themselves,
    and an attribute set that comes back later begins a new one. ``valid_to`` is the next version's start, null for
    the last.

    Null attributes are values (null equals null). Updates with a null entity or a null ``effective`` are left out.
    Repeated rows count once; equal ``delivered`` falls to the greatest attributes. After the first step an
    entity has at most one row per effective date, which bounds the window by the calendar. Empty input gives an empty
    result.
    """
    require_columns(updates, [entity, effective, delivered, *attributes])
    attrs = [f"a{i}" for i in range(len(attributes))]
    base = updates.select(F.col(entity).alias("e"), F.col(effective).alias("d"), F.col(delivered).alias("at"), *[F.col(c).alias(a) for c, a in zip(attributes, attrs, strict=True)])
    counted = latest_rows(base.filter("e is not null and d is not null"), ["e", "d"], ["at"], attrs)
    numbered = counted.withColumn("n", F.row_number().over(Window.partitionBy("e").orderBy("d")) - 1)
    bit = F.expr(f"cast(n % {WORD} as int)")
    marks = numbered.select("e", "d", *attrs, row_hash([F.col(a) for a in attrs]).alias("h"), F.expr(f"cast(n div {WORD} as int)").alias("word"), bit.alias("bit"))
    maps = marks.groupBy("e", "h", "word").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"),
        F.collect_list(F.struct("bit", "d")).alias("days"),
        *[F.any_value(a).alias(a) for a in attrs],
    )
    by_word = Window.partitionBy("e", "h").orderBy("word")
    carry = F.when(F.lag("word").over(by_word) == F.col("word") - 1, F.expr("shiftrightunsigned(before, 63)")).otherwise(F.lit(0).cast("bigint"))
    starts = (
        maps.withColumn("before", F.lag("bits").over(by_word))
        .withColumn("carry", carry)
        .withColumn("starts", F.expr("bits & ~(shiftleft(bits, 1) | carry)"))
        .select("e", *attrs, F.explode(F.expr("filter(days, x -> (shiftrightunsigned(starts, x.bit) & 1L) = 1L)")).alias("x"))
        .select("e", *attrs, F.col("x.d").alias("valid_from"))
    )
    versions = starts.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("e").orderBy("valid_from")))
    return versions.select(F.col("e").alias(entity), *[F.col(a).alias(c) for c, a in zip(attributes, attrs, strict=True)], "valid_from", "valid_to")
