"""What a run was made of: digests, versions, manifests."""

from __future__ import annotations

import hashlib
import json
import platform
import subprocess
import sys
from collections.abc import Iterable, Mapping
from datetime import datetime, timezone
from importlib import metadata
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import read_table


def table_digest(table: DataFrame) -> dict[str, object]:
    """(rows, sha256) of a table's content, computed in the cluster: equal for equal rows in any order and layout, wherever the files lie.

    Each row is hashed with its column names and nulls; counts, sums and exclusive ors of the hashes combine on the map side, and only those three numbers reach the driver.
    """
    row = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(table.columns)]), {"ignoreNullFields": "false"}))
    n, total, mixed = table.select(row.alias("h")).agg(F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).first()
    return {"rows": n, "sha256": hashlib.sha256(f"{sorted(table.columns)} {n} {total} {mixed}".encode()).hexdigest()}


def file_hash(path: str | Path) -> str:
    """SHA-256 of a small local file's bytes, or of a folder's files in order of their names; for tables see ``table_digest``."""
    digest = hashlib.sha256()
    target = Path(path)
    for part in sorted(p for p in target.rglob("*") if p.is_file()) if target.is_dir() else [target]:
        with part.open("rb") as f:
            while block := f.read(1 << 20):
                digest.update(block)
    return digest.hexdigest()


def revision(repository: str | Path) -> str | None:
    """The commit that is checked out, or None outside of a repository."""
    done = subprocess.run(["git", "-C", str(repository), "rev-parse", "HEAD"], capture_output=True, text=True, check=False)
    return done.stdout.strip() or None if done.returncode == 0 else None


def versions(packages: Iterable[str] = ("numpy", "pandas", "pyarrow", "pyspark")) -> dict[str, str | None]:
    """Installed versions, None for what is missing."""
    found: dict[str, str | None] = {}
    for name in packages:
        try:
            found[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            found[name] = None
    return found


def manifest(parameters: Mapping[str, object], inputs: Mapping[str, str | Path], repository: str | Path, spark: SparkSession | None = None) -> dict[str, object]:
    """A serialisable record of a run, made before its results are written. With ``spark`` inputs are tables, digested in the cluster; without, small local files."""
    if spark is None:
        digests = {name: {"path": str(p), "sha256": file_hash(p)} for name, p in inputs.items()}
    else:
        digests = {name: {"path": str(p), **table_digest(read_table(spark, str(p)))} for name, p in inputs.items()}
    return {
        "created_at_utc": datetime.now(timezone.utc).isoformat(),
        "git_revision": revision(repository),
        "parameters": dict(parameters),
        "inputs": digests,
        "environment": {"python": sys.version, "platform": platform.platform(), "packages": versions()},
    }


def write_json(content: Mapping[str, object], path: str | Path) -> None:
    """Indented, keys sorted, newline at the end."""
    Path(path).write_text(json.dumps(content, indent=2, sort_keys=True) + "\n", encoding="utf-8")


def write_provenance(content: Mapping[str, object], table: str | Path) -> None:
    """The sidecar ``<table>.provenance.json``."""
    write_json(content, f"{table}.provenance.json")
