"""Small helpers shared by every operator: names, keys, canonical forms, checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "input") -> None:
    """Raise ``ValueError`` at analysis time if a column is absent; no job runs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns: {', '.join(sorted(missing))}")


def fresh(columns: Iterable[str], base: str) -> str:
    """A column name starting with ``base`` that clashes with none of ``columns``."""
    taken = {c.lower() for c in columns}
    name, n = base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    return name


def canonical_ticker(col: Column | str) -> Column:
    """Trimmed, upper case, ``-`` before the share class."""
    c = F.col(col) if isinstance(col, str) else col
    return F.upper(F.replace(F.btrim(c, F.lit(" \t\r\n")), F.lit("."), F.lit("-")))


def finite(col: Column | str) -> Column:
    """The value, or NULL for NaN and the infinities; -0.0 becomes 0.0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c + F.lit(0.0))


def not_nan(col: Column | str) -> Column:
    """The value, or NULL for NaN; -0.0 becomes 0.0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(~F.isnan(c), c + F.lit(0.0))


def day_string(col: Column | str) -> Column:
    """``yyyy-MM-dd``."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("date").cast("string")


def null_safe_token(col: Column) -> Column:
    """A string that is equal for two values exactly if they are equal, null being a value of its own."""
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit("~"))


def row_hash(cols: Sequence[Column]) -> Column:
    """128-bit hash of the values in order; null differs from every value and equals null."""
    tokens = [null_safe_token(c) for c in cols]
    return F.struct(F.xxhash64(*tokens).alias("h1"), F.xxhash64(F.lit("#"), *tokens).alias("h2"))


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key: the one greatest by (order..., values...).

    The aggregate combines on the map side, so a key delivered over and over never gathers its raw rows in one
    task. Nulls in ``order`` sort first; ties in ``order`` fall to the greatest values, so the result is always
    the same. Rows with null keys form a key of their own. An empty table stays empty.
    """
    require_columns(df, [*keys, *order, *values])
    names = list(dict.fromkeys([*order, *values]))
    best = fresh(df.columns, "best")
    agg = df.groupBy(*keys).agg(F.max(F.struct(*names)).alias(best))
    return agg.select(*keys, *[F.col(best)[c].alias(c) for c in names if c in values])


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's ``spark.checkpoint.dir``; only a local master without one gets a temporary folder, removed at exit."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute once into the shared checkpoint folder, which survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a dataset folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
