"""The N best rows of every group, in two salted stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import fresh, require_columns


def top_n(df: DataFrame, groups: Sequence[str], score: str, identifier: str, n: int, salts: int = 64) -> DataFrame:
    """Keep, for each group, the ``n`` rows with the highest ``score``, ties by ``identifier`` ascending (bytes).

    Stage one hashes the identifier into ``salts`` subgroups, ranks within (group, subgroup) and keeps ``n``; the
    planner also limits each map task to ``n`` rows per subgroup before the shuffle. Stage two ranks the at most
    ``salts * n`` survivors of a group. A group of any size is thus spread over ``salts`` tasks.

    Null and NaN scores are missing and never kept; -0.0 equals 0.0. Groups with fewer rows keep all of them. A null
    group key is a group of its own; a null identifier sorts first. Repeated rows are separate rows (remove them
    before if they shouldn't count). An empty table, or n < 1, gives an empty result. All columns are kept, and a
    column ``rank`` (or ``rank_1`` ... where the name is taken) is added.
    """
    require_columns(df, [*groups, score, identifier])
    salt, first, key = (fresh(df.columns, x) for x in ("topn_salt", "topn_stage", "topn_key"))
    rank = fresh(df.columns, "rank")
    kind = dict(df.dtypes)[score]
    value = F.col(score)
    present = value.isNotNull()
    if kind in ("double", "float"):
        present, value = present & ~F.isnan(value), value + F.lit(0.0).cast(kind)
    scored = df.filter(present).withColumn(key, value).withColumn(salt, F.pmod(F.xxhash64(F.col(identifier)), F.lit(salts)))
    order = [F.col(key).desc(), F.col(identifier).asc_nulls_first()]
    inner = Window.partitionBy(*groups, salt).orderBy(*order)
    outer = Window.partitionBy(*groups).orderBy(*order)
    survivors = scored.withColumn(first, F.row_number().over(inner)).filter(F.col(first) <= n).drop(first, salt)
    return survivors.withColumn(rank, F.row_number().over(outer)).filter(F.col(rank) <= n).drop(key)
