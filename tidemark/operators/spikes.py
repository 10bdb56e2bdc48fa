"""Implausible readings of many sources: isolation forests, physical limits and flat lines."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.common import require_columns


@dataclass(frozen=True)
class Field:
    """What is known about one measurement.

    ``positive``: zero is impossible too (prices), else only negative values are (counts). ``spread``: the scale of departures is the
    source's usual distance from its level (volumes), else its usual change from one reading to the next (prices).
    ``factor``: how many scales a candidate must lie from the level before or after it, and two thirds of that from the other, to be confirmed.
    """

    name: str
    positive: bool = True
    spread: bool = False
    factor: float = 9.0


@dataclass(frozen=True)
class Settings:
    """Documented parameters of the forest and the rules.

    ``sample``: readings that each tree of a source is grown on, drawn at random for each tree; every reading is scored. ``gate``: a candidate's score exceeds its
    source's median score by so many of the source's own (scaled) median deviations. ``half_window``: rows on either side that make the surrounding level.
    ``back_within``: a departure must be back near its former level after at most so many rows. ``neighbours``: readings before and after a departure that tell the
    level, none of them a candidate, at most ``reach`` rows away. ``flat_run``: from so many equal readings in consecutive rows on it is a flat line. ``season``: length of the seasonal cycle in days.
    """

    trees: int = 16
    sample: int = 256
    gate: float = 2.0
    half_window: int = 5
    back_within: int = 3
    neighbours: int = 3
    reach: int = 12
    flat_run: int = 6
    season: int = 7
    seed: int = 11


#: Levels of a tree; what stands out is alone long before.
DEPTH = 6
#: Features that cuts are drawn from, evenly: level thrice, change before, change after, seasonal twice, run length.
DRAWN = np.array([0, 0, 0, 1, 2, 3, 3, 4])


def mix(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit hashes, so random choices depend on source, tree and node and not on how rows are batched."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def group_median(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Median of the non-NaN values of each group; NaN without any."""
    fit = ~np.isnan(values)
    v, g = values[fit], group[fit]
    order = np.lexsort((v, g))
    v, counts = v[order], np.bincount(g, minlength=groups)
    start = np.concatenate([[0], np.cumsum(counts)[:-1]])
    out = np.full(groups, np.nan)
    some = counts > 0
    lo, hi = start[some] + (counts[some] - 1) // 2, start[some] + counts[some] // 2
    out[some] = (v[lo] + v[hi]) / 2
    return out


def rolling_level(values: np.ndarray, group: np.ndarray, half: int) -> np.ndarray:
    """Median of the readings up to ``half`` rows before and after within the source, the row itself included."""
    n = len(values)
    stack = np.full((2 * half + 1, n), np.nan)
    stack[half] = values
    for k in range(1, min(half, n - 1) + 1):
        same = group[k:] == group[:-k]
        stack[half - k, k:][same] = values[:-k][same]
        stack[half + k, :-k][same] = values[k:][same]
    stack.sort(axis=0)  # NaN last
    count = (~np.isnan(stack)).sum(0)
    cols = np.arange(n)
    return (stack[np.maximum(count - 1, 0) // 2, cols] + stack[np.minimum(count // 2, 2 * half), cols]) / 2


def run_positions(values: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place within the run of equal readings (0 for its first), and the run's length."""
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (group[1:] != group[:-1])
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    return np.arange(len(values)) - first[run], np.diff(np.append(first, len(values)))[run]


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search in a random tree of n points."""
    n = np.maximum(n, 1).astype(np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def forest_scores(x: np.ndarray, group: np.ndarray, identity: np.ndarray, s: Settings) -> np.ndarray:
    """Isolation scores of all rows, from one forest per group; rows are sorted by group.

    ``x``: (features, rows). ``identity``: a 64-bit hash per group. Each tree is grown on a random sample of its group, drawn by hash, of ``s.sample`` rows on average (all rows
    of a smaller group). All groups' trees are grown together, level by level, while every row travels down every tree; each node cuts a random feature at a random
    place within its sample's range. A row that ends among several sampled ones adds the mean further path among so many.
    """
    groups, n, t = len(identity), len(group), s.trees
    counts = np.bincount(group, minlength=groups)
    key = mix(identity[:, None] ^ mix(np.arange(t, dtype=np.uint64) + np.uint64(s.seed))[None, :])
    node = (group * t + np.arange(t)[:, None]).reshape(-1)
    row = np.tile(np.arange(n), t)
    inside = slice(None)
    if n and counts.max() > s.sample:
        place = (np.arange(n) - (np.cumsum(counts) - counts)[group]).astype(np.uint64)
        inside = np.flatnonzero(((mix(key.T[:, group] + mix(place)) >> np.uint64(11)) < (s.sample / counts * (1 << 53))[group]).reshape(-1))
    flat, path, hashes = x.reshape(-1), np.zeros(t * n, np.float32), key.reshape(-1)
    for _ in range(DEPTH):
        size = len(hashes)
        value = flat[(DRAWN[(hashes >> np.uint64(32)).astype(np.int64) % len(DRAWN)] * n)[node] + row]
        low, high = np.full(size, np.inf, np.float32), np.full(size, -np.inf, np.float32)
        np.minimum.at(low, node[inside], value[inside])
        np.maximum.at(high, node[inside], value[inside])
        path += (np.bincount(node[inside], minlength=size) > 1)[node]
        place = (mix(hashes) >> np.uint64(40)).astype(np.float32) / (1 << 24)
        splits = high > low
        cut = np.full(size, np.inf, np.float32)
        cut[splits] = low[splits] + place[splits] * (high[splits] - low[splits])
        node = 2 * node + (value > cut[node])
        hashes = mix(np.repeat(hashes, 2) + np.tile(np.arange(2, dtype=np.uint64), size))
    path += average_path(np.bincount(node[inside], minlength=len(hashes)))[node]
    usual = average_path(np.minimum(counts, s.sample))[group]
    return np.where(usual > 0, 2.0 ** (-path.reshape(t, n).mean(0) / np.where(usual > 0, usual, 1)), 0.0)


def side_level(values: np.ndarray, group: np.ndarray, calm: np.ndarray, at: np.ndarray, side: int, s: Settings) -> np.ndarray:
    """Median of the ``s.neighbours`` calm rows nearest to each row in ``at`` on one side (-1 before, 1 after), NaN without any within reach."""
    first = np.searchsorted(calm, at, "left" if side < 0 else "right") - (side < 0)
    picked = np.full((s.neighbours, len(at)), np.nan)
    for k in range(s.neighbours):
        i = first + side * k
        there = (i >= 0) & (i < len(calm))
        row = calm[np.where(there, i, 0)] if len(calm) else np.zeros(len(at), np.int64)
        there &= (np.abs(row - at) <= s.reach) & (group[row] == group[at])
        picked[k] = np.where(there, values[row], np.nan)
    picked.sort(axis=0)  # NaN last
    count, column = (~np.isnan(picked)).sum(0), np.arange(len(at))
    return (picked[np.maximum(count - 1, 0) // 2, column] + picked[np.minimum(count // 2, s.neighbours - 1), column]) / 2


def departures(values: np.ndarray, group: np.ndarray, candidate: np.ndarray, least: np.ndarray, s: Settings) -> np.ndarray:
    """Rows of the forest's candidates' departures that return: the explicit check.

    A departure is the stretch of consecutive rows around a candidate that lie as far from the level of the calm rows before as half the candidate does, and at least two thirds of
    ``least`` (per row), a calm row being one that is no candidate. It is a spike if it has at most ``back_within`` rows, the calm rows after it differ from the ones before by at most
    half the departure, and its rows lie more than ``least`` from one of the two levels and two thirds of that from the other. Without calm rows on both sides there is no former
    level to return to.
    """
    out, calm = np.zeros(len(values), bool), np.flatnonzero(~candidate)
    at = np.flatnonzero(candidate)
    was = side_level(values, group, calm, at, -1, s)
    for i, level in zip(at.tolist(), was.tolist(), strict=True) if len(at) else ():
        far = abs(values[i] - level)
        if out[i] or not far > least[i] * 2 / 3:
            continue
        a = b = i
        edge = max(least[i] * 2 / 3, far / 2)
        while a > 0 and group[a - 1] == group[i] and abs(values[a - 1] - level) > edge and b - a < s.back_within:
            a -= 1
        while b + 1 < len(values) and group[b + 1] == group[i] and abs(values[b + 1] - level) > edge and b - a < s.back_within:
            b += 1
        if b - a >= s.back_within:
            continue
        after = side_level(values, group, calm, np.array([b]), 1, s)[0]
        sides = np.abs(values[a : b + 1] - np.array([[level], [after]]))
        if abs(after - level) <= sides[0].min() / 2:
            out[a : b + 1] |= (sides.max(0) > least[i]) & (sides.min(0) > least[i] * 2 / 3)
    return out


def judge(values: np.ndarray, days: np.ndarray, group: np.ndarray, identity: np.ndarray, field: Field, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(score, reason) of each reading of one field: reason 0 none, 1 impossible, 2 spike, 3 flat line. Rows sorted by (source, day)."""
    n, groups = len(values), len(identity)
    reason = np.zeros(n, np.int8)
    impossible = ~np.isfinite(values) | ((values <= 0) if field.positive else (values < 0))
    place, length = run_positions(values, group)
    flat = (length >= s.flat_run) & (place > 0)
    log = np.full(n, np.nan)
    ok = ~impossible
    log[ok] = np.log(values[ok]) if field.positive else np.log1p(values[ok])
    # rows without the impossible ones
    lv, lg, ld = log[ok], group[ok], days[ok]
    score = np.ones(n)
    if len(lv):
        away = lv - rolling_level(lv, lg, s.half_window)
        step = np.full(len(lv), np.nan)
        step[1:] = np.where(lg[1:] == lg[:-1], lv[1:] - lv[:-1], np.nan)
        moved = np.where(step == 0, np.nan, step)  # repeated readings say nothing about usual changes
        step_scale = 1.4826 * group_median(np.abs(moved), lg, groups)
        away_scale = 1.4826 * group_median(np.where(away == 0, np.nan, np.abs(away)), lg, groups)
        scale = away_scale if field.spread else step_scale
        tiny = 1e-6
        scale = np.where(np.isnan(scale) | (scale < tiny), tiny, scale)
        step_scale = np.where(np.isnan(step_scale) | (step_scale < tiny), tiny, step_scale)
        z = away / scale[lg]
        dz = np.where(np.isnan(step), 0.0, step) / step_scale[lg]
        leave = np.zeros(len(lv))
        leave[:-1] = np.where(lg[1:] == lg[:-1], dz[1:], 0.0)
        season_key = lg * s.season + ld % s.season
        season = z - np.nan_to_num(group_median(z, season_key, groups * s.season))[season_key]
        clip = lambda a: np.clip(a, -15, 15)
        x = np.stack([clip(z), clip(dz), clip(leave), clip(season), np.log1p(length[ok] - 1.0) * 4]).astype(np.float32)
        score_ok = forest_scores(x, lg, identity, s)
        score[ok] = score_ok
        usual = group_median(score_ok, lg, groups)
        gate = usual + s.gate * 1.4826 * group_median(np.abs(score_ok - usual[lg]), lg, groups)
        reason[ok] = np.where(departures(lv, lg, score_ok > gate[lg], (field.factor * scale)[lg], s), 2, 0)
    reason[flat] = 3
    reason[impossible] = 1
    return score, reason


REASONS = ("", "impossible", "spike", "flat")


def implausible_readings(rows: DataFrame, source: str, day: str, fields: Sequence[Field], settings: Settings = Settings(), flagged_only: bool = False) -> DataFrame:
    """Score every reading of every source and flag those that can't be right: (source, day, field, value, score, reason).

    ``rows`` has at most one row per (source, day); fields are numeric. Of each (source, field) an isolation forest is grown on five
    features, relative to the source's own behaviour: distance from the surrounding level (median of 11 readings), change to this reading and to
    the next, distance from the level after the usual deviation of that day of the cycle, and length of the run of equal readings. Every reading is scored, and the readings whose
    score stands out among their source's own scores are candidates; without the forest there are none. A reading is flagged as ``impossible`` (a price that is zero, negative, NaN or
    infinite, a negative count; score 1), ``flat`` (all but the first of six or more equal readings in a row) or ``spike``: part of a candidate's departure, of at most three rows, that lies
    more than ``factor`` scales from the calm readings before or after it and two thirds of that from the others, which are near each other; a lasting move is none.

    Null readings are left out, the next row being the next reading. Null sources or days are left out. Sources with few readings get a forest on what there is; one or
    two readings can only be impossible. Rows are co-partitioned by source and sorted once; a source has at most one row per day, which bounds what a
    task holds of one source at a time. Empty input gives an empty result.
    """
    require_columns(rows, [source, day, *(f.name for f in fields)])
    kind = dict(rows.dtypes)[source]
    fields = tuple(fields)
    flat = rows.select(F.col(source).alias("s"), F.col(day).cast("date").alias("d"), F.xxhash64(source).alias("h"), *[F.col(f.name).cast("double").alias(f"v{i}") for i, f in enumerate(fields)])
    ordered = flat.filter("s is not null and d is not null").repartition("s").sortWithinPartitions("s", "d")

    def work(part: pa.Table) -> Iterator[pa.RecordBatch]:
        part = part.combine_chunks()
        coded = part.column("s").combine_chunks().dictionary_encode() if part.num_rows else None
        codes = coded.indices.to_numpy()
        new = np.ones(len(codes), bool)
        new[1:] = codes[1:] != codes[:-1]
        group = np.cumsum(new) - 1
        identity = part.column("h").to_numpy()[new].view(np.uint64)
        days = part.column("d").cast(pa.int32()).to_numpy().astype(np.int64)
        for i, field in enumerate(fields):
            column = part.column(f"v{i}")
            there = np.flatnonzero(~np.asarray(column.is_null()))  # NaN is a reading, null is none
            if not len(there):
                continue
            values = column.to_numpy()[there]
            score, reason = judge(values, days[there], group[there], mix(identity ^ np.uint64(i + 1)), field, settings)
            keep = np.flatnonzero(reason) if flagged_only else np.arange(len(there))
            taken = part.take(pa.array(there[keep]))
            yield pa.RecordBatch.from_arrays(
                [taken.column("s").combine_chunks(), taken.column("d").combine_chunks(), pa.array([field.name] * len(keep), pa.string()), pa.array(values[keep]), pa.array(score[keep]), pa.array([REASONS[r] or None for r in reason[keep].tolist()], pa.string())],
                ["source", "day", "field", "value", "score", "reason"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            column = held.column("s")
            last = column[held.num_rows - 1].as_py()
            begin = int(np.flatnonzero(np.asarray(pc.equal(column, last)))[0])  # the last source may go on in the next batch
            if begin:
                yield from work(held.slice(0, begin))
                held = held.slice(begin)
        if held is not None and held.num_rows:
            yield from work(held)

    return ordered.mapInArrow(run, f"source {kind}, day date, field string, value double, score double, reason string")
