"""Readers and writers: Parquet, CSV, resumable batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None, strict: bool = True) -> DataFrame:
    """A table by its extension: ``.parquet`` or ``.csv`` (with a header; types inferred unless ``schema`` is given).

    Other extensions raise ``ValueError``, or are read as CSV with ``strict=False``.
    """
    name = path.rstrip("/").lower()
    if name.endswith(".parquet"):
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if strict and not name.endswith(".csv"):
        raise ValueError("a table must be .parquet or .csv")
    return spark.read.csv(path, header=True, schema=schema, inferSchema=None if schema else True)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Write a Parquet folder."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a small result as a CSV folder with a header, one file."""
    df.coalesce(1).write.mode(mode).csv(path, header=True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished Parquet folder is there."""
    try:
        spark.read.parquet(f"{path}/").schema  # noqa: B018
    except AnalysisException:
        return False
    return True


def key_slice(keys: Iterable[str], offset: int = 0, limit: int | None = None) -> list[str]:
    """``limit`` of the distinct keys in order, from ``offset`` on; all that follow without a limit."""
    if offset < 0 or (limit is not None and limit < 0):
        raise ValueError("offset and limit must not be negative")
    listed = sorted(set(keys))[offset:]
    return listed if limit is None else listed[:limit]


def ingest_batches(spark: SparkSession, keys: Sequence[str], size: int, load: Callable[[Sequence[str]], DataFrame], folder: str) -> DataFrame:
    """Load keys in batches of ``size``, one Parquet folder per batch, and skip batches that are finished; then all together.

    Interrupted runs resume: a folder counts only once its write is committed.
    """
    listed = sorted(set(keys))
    paths = []
    for n, at in enumerate(range(0, len(listed), size)):
        path = f"{folder}/batch_{n:05d}.parquet"
        if not exists(spark, path):
            write_parquet(load(listed[at : at + size]), path)
        paths.append(path)
    if not paths:
        raise ValueError("there are no keys to load")
    return spark.read.parquet(*paths)


def wide_prices_to_panel(wide: DataFrame, tickers: Iterable[str], measures: Sequence[str] = ("open", "high", "low", "close", "volume")) -> DataFrame:
    """Columns ``<measure>_<ticker>`` beside ``date`` as rows (date, ticker, measures...); a ticker's rows without any value are left out."""
    entries = [F.struct(F.lit(t.upper()).alias("ticker"), *[F.col(f"`{m}_{t}`").cast("double").alias(m) for m in measures]) for t in tickers]
    rows = wide.select("date", F.explode(F.array(*entries)).alias("e")).select("date", "e.*")
    return rows.na.drop(how="all", subset=list(measures))
