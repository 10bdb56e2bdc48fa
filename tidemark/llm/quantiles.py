"""Mergeable percentiles with multiplicative rank error: relative-rank compactors."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.common import require_columns

SECTION = 64
#: Bytes of a sketch besides its values.
OVERHEAD = 1000


class RelativeSketch:
    """A stack of relative compactors. Level h holds values that stand for 2**h readings each.

    A full level is sorted; the part nearest to the protected tail stays untouched, and of the rest every second value, beginning
    at a coin flip, moves up. How much is protected follows a schedule: of the sections before the half nearest the tail, as many are compacted as the
    number of compactions so far has trailing one bits, plus one; when the sections are used up, their number doubles, so the level's
    capacity grows with the logarithm of the input. The error in rank is a small multiple of the distance to the
    protected end: see ``rank_error``. ``high`` protects the greatest values, else the least. Merging joins levels of the same
    height and compacts what is overfull, in any order. Up to ``6 * section`` values nothing is compacted and the result is exact.
    """

    def __init__(self, section: int = SECTION, high: bool = True, salt: int = 0):
        self.section, self.high, self.salt = section, high, salt
        self.levels: list[np.ndarray] = [np.zeros(0)]
        self.state: list[int] = [0]
        self.n = 0

    def sections(self, h: int) -> int:
        """Sections of a level: 3, doubled whenever the compactions would use them up."""
        count = 3
        while self.state[h] >= 1 << (count - 1):
            count *= 2
        return count

    def capacity(self, h: int) -> int:
        """Values a level may hold."""
        return 2 * self.section * self.sections(h)

    def update(self, values: np.ndarray) -> None:
        """Add readings; NaN must be removed before."""
        self.n += len(values)
        self.levels[0] = np.concatenate([self.levels[0], values])
        self._settle()

    def merge(self, other: RelativeSketch) -> None:
        """Add another sketch of the same kind."""
        if (other.section, other.high) != (self.section, self.high):
            raise ValueError("sketches of different kinds can't be merged")
        self.n += other.n
        while len(self.levels) < len(other.levels):
            self.levels.append(np.zeros(0))
            self.state.append(0)
        for h, level in enumerate(other.levels):
            self.levels[h] = np.concatenate([self.levels[h], level])
            self.state[h] |= other.state[h]
        self._settle()

    def _settle(self) -> None:
        h = 0
        while h < len(self.levels):
            if len(self.levels[h]) > self.capacity(h):
                self._compact(h)
            h += 1

    def _compact(self, h: int) -> None:
        level = np.sort(self.levels[h])
        if self.high:
            level = level[::-1]  # the protected end first
        trailing = 0
        while self.state[h] >> trailing & 1:
            trailing += 1
        half = self.section * self.sections(h)
        keep = 2 * half - min(half, (trailing + 1) * self.section)
        keep += (len(level) - keep) % 2  # an even number moves, so the weights add up
        rest = level[keep:]
        coin = xxhash.xxh64_intdigest(struct.pack("<qqqd", self.salt, h, self.state[h], rest[0])) & 1
        self.levels[h] = level[:keep]
        self.state[h] += 1
        if h + 1 == len(self.levels):
            self.levels.append(np.zeros(0))
            self.state.append(0)
        self.levels[h + 1] = np.concatenate([self.levels[h + 1], rest[coin::2]])

    def quantiles(self, ps: Sequence[float]) -> list[float | None]:
        """For each p the least value whose estimated rank is at least p times n (the value of rank 1 for p = 0)."""
        values = np.concatenate(self.levels)
        if not len(values):
            return [None] * len(ps)
        weights = np.concatenate([np.full(len(x), 1 << h, np.int64) for h, x in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        ranks = np.cumsum(weights[order])
        at = [min(int(np.searchsorted(ranks, max(1, np.ceil(p * self.n - 1e-9)))), len(values) - 1) for p in ps]
        return [float(values[order[k]]) for k in at]

    def rank_error(self) -> float:
        """Stated error: estimated and true rank, counted from the protected end, differ by at most this part of the true
        one (three standard deviations)."""
        return 0.0 if len(self.levels) == 1 else 3 / self.section

    def footprint(self) -> int:
        """Memory held, roughly."""
        return OVERHEAD + 8 * sum(map(len, self.levels))

    def pack(self) -> bytes:
        """Bytes that ``unpack`` reads."""
        head = struct.pack("<qqqqq", self.section, self.high, self.salt, self.n, len(self.levels))
        return head + b"".join(struct.pack("<qq", s, len(x)) + x.astype("<f8").tobytes() for s, x in zip(self.state, self.levels, strict=True))

    @classmethod
    def unpack(cls, blob: bytes) -> RelativeSketch:
        """A sketch from its bytes."""
        section, high, salt, n, levels = struct.unpack_from("<qqqqq", blob)
        out, at = cls(section, bool(high), salt), 40
        out.n, out.levels, out.state = n, [], []
        for _ in range(levels):
            state, size = struct.unpack_from("<qq", blob, at)
            out.state.append(state)
            out.levels.append(np.frombuffer(blob, "<f8", size, at + 16).copy())
            at += 16 + 8 * size
        return out


def sketch_groups(df: DataFrame, group: str, fields: Sequence[str], section: int = SECTION, budget: int = 64 << 20) -> DataFrame:
    """(group, field, part, low, high): sketches per group and field, protecting the least and the greatest values; one or more of each task.

    No shuffle: a hot group is sketched wherever its rows lie. Null and NaN values are missing and not counted; infinite values are ordered as
    such. A task holds the sketches of the groups it sees up to about ``budget`` bytes; then it passes them on and begins anew, as merging doesn't mind how many parts there are.
    """
    require_columns(df, [group, *fields])

    def flush(held: dict[tuple, tuple[RelativeSketch, RelativeSketch]], part: int) -> pa.RecordBatch:
        keys = list(held)
        cols = [pa.array([k[0] for k in keys], kind), pa.array([k[1] for k in keys], pa.string()), pa.array([part] * len(keys), pa.int64())]
        return pa.RecordBatch.from_arrays([*cols, *(pa.array([held[k][i].pack() for k in keys], pa.binary()) for i in (0, 1))], ["grp", "field", "part", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[RelativeSketch, RelativeSketch]] = {}
        part, size = None, 0
        for batch in batches:
            if held and size > budget:
                size = sum(sketch.footprint() for pair in held.values() for sketch in pair)  # after compaction
                if size > budget:
                    yield flush(held, part)
                    held, part, size = {}, None, 0
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            names = coded.dictionary.to_pylist()
            codes = coded.indices.fill_null(len(names)).to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            cuts = np.flatnonzero(np.diff(codes[order])) + 1
            for k, field in enumerate(fields):
                column = batch.column(k + 1).cast(pa.float64()).to_numpy(zero_copy_only=False)
                for rows in np.split(order, cuts):
                    values = column[rows]
                    values = values[~np.isnan(values)] + 0.0
                    if not len(values):
                        continue
                    code = codes[rows[0]]
                    key = (names[code] if code < len(names) else None, field)
                    if part is None:
                        part = xxhash.xxh64_intdigest(repr(key).encode() + values.tobytes()) >> 2
                    if key not in held:
                        held[key] = (RelativeSketch(section, False, part), RelativeSketch(section, True, part))
                        size += 2 * OVERHEAD
                    for sketch in held[key]:
                        sketch.update(values)
                        size += 8 * len(values)
        if held:
            yield flush(held, part)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(df.schema[group].dataType)
    return df.select(F.col(group).alias("grp"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(fields)]).mapInArrow(run, f"grp {dict(df.dtypes)[group]}, field string, part bigint, low binary, high binary")


def merge_sketches(sketches: DataFrame, by: Mapping[str, F.Column] | Sequence[str], fan_in: int = 1024) -> DataFrame:
    """Merge sketches of parts, days or whatever shares the key ``by``: (by..., low, high).

    First within ``fan_in`` subgroups of the parts of each key, then those, so that no task merges more than a fraction of a key's parts.
    """
    keys = dict(by) if isinstance(by, Mapping) else {c: F.col(c) for c in by}
    names = list(keys)
    dtypes = sketches.select(*[c.alias(n) for n, c in keys.items()]).dtypes
    schema = ", ".join(f"{n} {t}" for n, t in dtypes) + ", part bigint, low binary, high binary"

    def fold(table: pa.Table) -> pa.Table:
        sums = []
        for side in ("low", "high"):
            blobs = sorted(table.column(side).to_pylist())  # an order of its own, so the result doesn't depend on that of arrival
            total = RelativeSketch.unpack(blobs[0])
            for blob in blobs[1:]:
                total.merge(RelativeSketch.unpack(blob))
            sums.append(pa.array([total.pack()], pa.binary()))
        first = table.slice(0, 1)
        return pa.table([*(first.column(n) for n in names), pa.array([0], pa.int64()), *sums], names=[*names, "part", "low", "high"])

    rows = sketches.select(*[c.alias(n) for n, c in keys.items()], F.pmod(F.xxhash64("part"), F.lit(fan_in)).alias("part"), "low", "high")
    return rows.groupBy(*names, "part").applyInArrow(fold, schema).groupBy(*names).applyInArrow(fold, schema).drop("part")


def read_percentiles(sketches: DataFrame, keys: Sequence[str], percentiles: Mapping[str, float]) -> DataFrame:
    """(keys..., n, percentiles..., rank_error): percentiles below the median from the low sketch, others from the high one."""
    kinds = dict(sketches.dtypes)
    names = list(percentiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(len(names) + 2)]
            low, high = (batch.column(batch.schema.get_field_index(s)).to_pylist() for s in ("low", "high"))
            for a, b in zip(low, high, strict=True):
                lo, hi = RelativeSketch.unpack(a), RelativeSketch.unpack(b)
                out[0].append(lo.n)
                for k, p in enumerate(percentiles.values()):
                    out[k + 1].append((lo if p < 0.5 else hi).quantiles([p])[0])
                out[-1].append(max(lo.rank_error(), hi.rank_error()))
            cols = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out[0], pa.int64()), *(pa.array(x, pa.float64()) for x in out[1:])], [*keys, "n", *names, "rank_error"])

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n bigint", *(f"{n} double" for n in names), "rank_error double"])
    return sketches.select(*keys, "low", "high").mapInArrow(run, schema)


def group_percentiles(df: DataFrame, group: str, fields: Sequence[str], percentiles: Mapping[str, float], section: int = SECTION) -> DataFrame:
    """Percentiles of each field per group, with bounded relative rank error: (grp, field, n, percentiles..., rank_error), ``grp`` being
    the value of ``group``.

    Sketches are made where the rows lie and only they are shuffled; a group of any size is merged from its parts. Null and NaN are missing; a
    group without any value of a field has no row; a null group is a group. Repeated rows count as often as they stand (remove them before if they
    shouldn't). Empty input gives an empty result. Extra columns are ignored.
    """
    merged = merge_sketches(sketch_groups(df, group, fields, section), ["grp", "field"])
    return read_percentiles(merged, ["grp", "field"], percentiles)
