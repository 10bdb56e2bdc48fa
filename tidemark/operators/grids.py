"""Boosted trees on few features: a fold's rows become sums on a grid of bins, from which every tree is grown.

Rows of equal bins are alike to every split, so a tree needs only their number and the sum of their residuals, and the residuals' sum is that of the targets less their number times the
prediction so far. One reading of the rows gives these sums for all folds; growing trees reads no rows again. Rules as in Spark ML's gradient boosting under squared error: the first tree
has weight 1, the others the step; they are fitted to the loss's slope, twice the residual; splits lie at the 32-quantiles of the fold's values, the rightmost value going left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 32
#: Random groups of rows, at least; each tree takes a random part of them.
GROUPS = 20
Cut = tuple[float, np.ndarray] | None


def bins_of(x: Sequence[np.ndarray], cuts: Sequence[Cut]) -> np.ndarray:
    """The cell of each row: ``cuts`` has the median, for values that are missing, and the upper ends of the bins of every feature, or None for one without values."""
    cell = np.zeros(len(x[0]), np.int64)
    for values, cut in zip(x, cuts, strict=True):
        cell *= BINS
        if cut is not None:
            cell += np.searchsorted(cut[1], np.where(np.isnan(values), cut[0], values), side="left")
    return cell


@dataclass(frozen=True)
class GridTrees:
    """The trees' parameters. ``feature_subset``: all, auto, sqrt, log2, onethird, a number or a share of features, drawn anew at each node.

    ``subsample``: every row falls into one of ``groups`` groups by its hash, and a tree takes the share ``subsample`` (to a hundredth) of the groups, so it sees a random part of the rows, whatever their order.
    """

    features: int
    max_iter: int
    max_depth: int
    step_size: float
    subsample: float
    feature_subset: str
    seed: int

    def __post_init__(self) -> None:
        if not 0.01 <= self.subsample <= 1:
            raise ValueError("subsample is between 0.01 and 1")
        self.subset(self.features)

    @property
    def taken(self) -> tuple[int, int]:
        """(groups that a tree takes, groups)."""
        share = Fraction(self.subsample).limit_denominator(100)
        times = -(-GROUPS // share.denominator) if share < 1 else 1
        return share.numerator * times, share.denominator * times

    @property
    def groups(self) -> int:
        return self.taken[1]

    def subset(self, n: int) -> int:
        """How many of ``n`` features a node may split on."""
        named = {"all": n, "auto": n, "sqrt": math.ceil(math.sqrt(n)), "log2": max(1, math.ceil(math.log2(max(n, 1)))), "onethird": math.ceil(n / 3)}
        if self.feature_subset in named:
            return named[self.feature_subset]
        number = float(self.feature_subset)
        if not number > 0 or (number > 1 and number != int(number)):
            raise ValueError("feature_subset is a name, a number of features or a share of them")
        return min(n, int(number)) if "." not in self.feature_subset and number >= 1 else math.ceil(min(number, 1.0) * n)

    def grow(self, n: np.ndarray, s: np.ndarray, use: Sequence[int]) -> np.ndarray:
        """The prediction of every cell from (groups, cells) numbers and sums of targets; ``use``: the features that have values."""
        cells = n.shape[1]
        at = np.unravel_index(np.arange(cells), (BINS,) * self.features)
        bins = [at[f] for f in use]
        rng, out = np.random.default_rng(self.seed), np.zeros(cells)
        for t in range(self.max_iter):
            part = np.zeros(self.groups)
            part[rng.permutation(self.groups)[: self.taken[0]]] = 1.0
            count, total = part @ n, part @ s
            if not count.any():
                continue
            rest = 2 * (total - count * out) if t else total
            out = out + (self.step_size if t else 1.0) * self.tree(count, rest, bins, rng)
        return out

    def tree(self, count: np.ndarray, total: np.ndarray, bins: Sequence[np.ndarray], rng: np.random.Generator) -> np.ndarray:
        """The value of every cell by one tree: level by level each node takes the split that lowers the squared error most, the first on ties."""
        node, closed = np.zeros(len(count), np.int64), np.zeros(len(count), bool)
        for _ in range(self.max_depth):
            _, first, node = np.unique(node, return_index=True, return_inverse=True)
            nodes = len(first)
            gains = []
            for b in bins:
                at = node * BINS + b
                left, low = (np.cumsum(np.bincount(at, w, nodes * BINS).reshape(nodes, BINS), 1) for w in (count, total))
                n, s = left[:, -1:], low[:, -1:]
                right, high = n - left, s - low
                fit = (left > 0.5) & (right > 0.5)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = low**2 / left + high**2 / right - s**2 / n
                gains.append(np.where(fit, gain, 0.0)[:, :-1])
            every = np.stack(gains, 1)
            if (k := self.subset(len(bins))) < len(bins):
                every[np.argsort(rng.random((nodes, len(bins))), 1).argsort(1) >= k] = 0.0
            flat = every.reshape(nodes, -1)
            best = flat.argmax(1)
            splits = (flat[np.arange(nodes), best] > 0) & ~closed[first]
            if not splits.any():
                break
            feature, edge = best // (BINS - 1), best % (BINS - 1)
            beyond = np.stack(bins)[feature[node], np.arange(len(node))] > edge[node]
            closed = ~splits[node]
            node = node * 2 + (beyond & ~closed)
        _, node = np.unique(node, return_inverse=True)
        return (np.bincount(node, total) / np.bincount(node, count))[node]


def grid_folds(rows: DataFrame, axis: np.ndarray, windows: Sequence[tuple[int, int]], cuts: Sequence[Sequence[Cut]], trees: GridTrees) -> dict[int, np.ndarray]:
    """Predictions of the cells by window, for windows with rows. ``rows``: (date, y, g, f0, f1, ...), all labelled; ``windows``: [from, to) by position in ``axis``.

    A task adds up the rows that it reads, at 16 bytes for each window, group and cell; these sums are merged group by group, then each window's trees grow in a task of its own. One number per window and cell is collected.
    """
    cells, groups, many = BINS**trees.features, trees.groups, len(windows)
    names = [f"f{i}" for i in range(trees.features)]
    lists = pa.list_(pa.float64())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, part = np.zeros((many, groups * cells)), np.zeros((many, groups * cells)), 0
        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            place = np.searchsorted(axis, batch.column("date").to_numpy(zero_copy_only=False).astype("datetime64[D]"))
            y, g = batch.column("y").to_numpy(), batch.column("g").to_numpy()
            x = [batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in names]
            for k, (lo, hi) in enumerate(windows):
                own = np.flatnonzero((place >= lo) & (place < hi))
                if len(own):
                    at = g[own] * cells + bins_of([c[own] for c in x], cuts[k])
                    n[k] += np.bincount(at, minlength=groups * cells)
                    s[k] += np.bincount(at, y[own], groups * cells)
        for k in range(many):
            by = [v[k].reshape(groups, cells) for v in (n, s)]
            held = np.flatnonzero(by[0].any(1))
            if len(held):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), k, np.int32)), pa.array(held.astype(np.int32)), pa.array(np.full(len(held), part, np.int32)), *(pa.array(list(v[held]), lists) for v in by)], ["w", "g", "part", "n", "s"])

    def merge(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("part").to_numpy(), kind="stable")  # always the same last bits
        sums = [pa.array([np.sum(_stacked(table, c)[order], 0)], lists) for c in ("n", "s")]
        return pa.table([*(table.column(c).slice(0, 1) for c in ("w", "g", "part")), *sums], names=["w", "g", "part", "n", "s"])

    def grow(table: pa.Table) -> pa.Table:
        w = table.column("w")[0].as_py()
        n, s = np.zeros((groups, cells)), np.zeros((groups, cells))
        at = table.column("g").to_numpy()
        n[at], s[at] = _stacked(table, "n"), _stacked(table, "s")
        use = [f for f, cut in enumerate(cuts[w]) if cut is not None]
        return pa.table([pa.array([w], pa.int32()), pa.array([trees.grow(n, s, use)], lists)], names=["w", "cells"])

    sums = "w int, g int, part int, n array<double>, s array<double>"
    merged = rows.withColumn("part", F.spark_partition_id()).mapInArrow(add, sums).groupBy("w", "g").applyInArrow(merge, sums)
    return {r["w"]: np.array(r["cells"]) for r in merged.groupBy("w").applyInArrow(grow, "w int, cells array<double>").collect()}


def _stacked(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
