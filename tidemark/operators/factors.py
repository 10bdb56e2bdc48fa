"""Factor returns over holding periods, and attribution."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.common import require_columns
from tidemark.operators.panel import refuse_duplicates

# Columns of the public daily five-factor file.
FACTORS = ("Mkt-RF", "SMB", "HML", "RMW", "CMA", "RF")


def read_factor_zip(spark: SparkSession, source: bytes | str) -> DataFrame:
    """(date, factors...) from a zipped CSV of daily factors in percent, as decimals; ``source`` is its bytes or its path on any file system.

    Rows that begin with an eight-digit date are data, whatever stands before, between and after them; the row that names all factors tells their columns. Cells that are no number are null.
    """
    archives = spark.createDataFrame([(source,)], "content binary") if isinstance(source, bytes) else spark.read.format("binaryFile").load(source).select("content")

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(blob)) as archive:
                    for entry in archive.infolist():
                        if entry.filename.lower().endswith(".csv"):
                            yield pa.RecordBatch.from_pydict({"line": archive.read(entry).decode("latin-1").splitlines()})

    cells = archives.mapInArrow(unzip, "line string").select(F.transform(F.split("line", ","), lambda x: F.trim(x)).alias("cell"))
    header = cells.filter(F.array_size(F.array_intersect("cell", F.lit(list(FACTORS)))) == len(FACTORS)).first()
    if header is None:
        raise ValueError("no row names the factors")
    value = lambda c: F.expr(f"try_cast(get(cell, {header['cell'].index(c)}) as double)") / 100
    days = cells.filter(F.col("cell")[0].rlike("^[0-9]{8}$")).select(F.expr("try_to_date(cell[0], 'yyyyMMdd')").alias("date"), *[value(c).alias(c) for c in FACTORS])
    return days.filter("date is not null").orderBy("date")


def holding_period_factors(factors: DataFrame, signal_dates: DataFrame, columns: Sequence[str] = FACTORS, horizon: int = 5, delay: int = 1, check: bool = True) -> DataFrame:
    """Each factor compounded over the ``horizon`` rows that begin ``delay`` rows after each signal date; incomplete windows and unknown dates have no row. One row per
    date, so the window is bounded by the calendar."""
    if horizon < 1 or delay < 1:
        raise ValueError("horizon and delay must be positive")
    require_columns(factors, ["date", *columns], "factors")
    if check:
        refuse_duplicates(factors, ["date"], "factors have duplicate dates")
    ahead = Window.orderBy("date").rowsBetween(delay, delay + horizon - 1)
    compounded = factors.withColumn("ahead", F.count(F.lit(1)).over(ahead)).select("date", "ahead", *[(F.product(1 + F.col(f"`{c}`")).over(ahead) - 1).alias(c) for c in columns])
    return compounded.filter(F.col("ahead") == horizon).drop("ahead").join(signal_dates.select("date").distinct(), "date", "left_semi")


def factor_attribution(returns: DataFrame, factors: DataFrame, value: str = "net_return", columns: Sequence[str] = FACTORS[:-1], risk_free: str = "RF") -> dict[str, float]:
    """Least squares of return less risk-free rate on a constant and the factors (minimum norm if they are dependent).

    The cluster sums products; the small system is solved here. Rows with any null are dropped; too few rows raise ``ValueError``.
    """
    require_columns(returns, ["date", value], "returns")
    require_columns(factors, ["date", *columns, risk_free], "factors")
    joined = returns.select("date", F.col(value).alias("r")).join(factors.select("date", *[F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate([*columns, risk_free])]), "date").na.drop()
    k = len(columns)
    terms = [F.lit(1.0), *[F.col(f"f{i}") for i in range(k)], F.col("r") - F.col(f"f{k}")]
    pairs = [(i, j) for i in range(k + 2) for j in range(i, k + 2)]
    row = joined.agg(*[F.sum(terms[i] * terms[j]).alias(f"s{i}_{j}") for i, j in pairs]).first()
    gram = np.zeros((k + 2, k + 2))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = row[f"s{i}_{j}"] or 0.0
    n = gram[0, 0]
    if n <= k + 1:
        raise ValueError("too few aligned observations")
    coef = np.linalg.pinv(gram[:-1, :-1], rcond=1e-13) @ gram[:-1, -1]
    total = gram[-1, -1] - 2 * coef @ gram[:-1, -1] + coef @ gram[:-1, :-1] @ coef
    mean = (gram[0, -1] - coef @ gram[0, :-1]) / n
    deviation = float(np.sqrt(max(total - n * mean**2, 0.0) / (n - 1)))
    return {"observations": int(n), "alpha_per_period": float(coef[0]), "residual_volatility": deviation, **{f"beta_{c}": float(b) for c, b in zip(columns, coef[1:], strict=True)}}
