"""Draw a training mix whose sources have target shares of all tokens."""

from __future__ import annotations

import base64
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import checkpointed, require_columns

# Fixed value: the split pattern that belongs to the public byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKETS = 4096
EPS = 1e-7
SEPARATOR = "\x1f"
#: Membership patterns that are planned as such; texts of rarer ones are planned for one of their sources.
MOST_PATTERNS = 4096


def token_sizes(docs: DataFrame, identifier: str, text: str, source: str, vocabulary: str) -> DataFrame:
    """(id, source, t1, t2, tokens): tokens of the whole text, and a 128-bit hash that tells equal texts. Null texts have none.

    ``vocabulary``: path of the ranks of the public byte-level vocabulary of 50,256 entries. The file (under a megabyte) is read on the driver and sent along, so executors need no copy.
    """
    with open(vocabulary, "rb") as f:
        ranks = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            sums = np.frombuffer(b"".join(xxhash.xxh128_digest(t.encode("utf-8", "surrogatepass")) for t in texts), "<i8").reshape(-1, 2)
            tokens = pa.array([len(coder.encode_ordinary(t)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(sums[:, k])) for k in (0, 1)), tokens], ["id", "source", "t1", "t2", "tokens"])

    kind = dict(docs.dtypes)[identifier]
    return docs.select(F.col(identifier).alias("id"), F.col(source).alias("source"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, source string, t1 bigint, t2 bigint, tokens bigint")


class Flow:
    """Maximum flow by levelled augmentation; capacities may be raised between runs, and flow once sent stays."""

    def __init__(self, nodes: int):
        self.nodes = nodes
        self.head: list[int] = []  # arc k ^ 1 is the reverse of arc k
        self.left: list[float] = []
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def arc(self, a: int, b: int, capacity: float) -> int:
        """Add an arc; its number."""
        for tail, head, room in ((a, b, capacity), (b, a, 0.0)):
            self.out[tail].append(len(self.head))
            self.head.append(head)
            self.left.append(room)
        return len(self.head) - 2

    def levels(self, start: int) -> list[int]:
        """Arcs from ``start`` to each node over arcs with room, -1 where none lead."""
        level, reached = [-1] * self.nodes, [start]
        level[start] = 0
        for a in reached:
            for k in self.out[a]:
                if self.left[k] > EPS and level[self.head[k]] < 0:
                    level[self.head[k]] = level[a] + 1
                    reached.append(self.head[k])
        return level

    def run(self, start: int, end: int) -> float:
        """Send as much more as can be sent; the amount."""
        sent = 0.0
        while (level := self.levels(start))[end] >= 0:
            turn = [0] * self.nodes
            path: list[int] = []
            at = start
            while True:
                if at == end:
                    amount = min(self.left[k] for k in path)
                    sent += amount
                    for k in path:
                        self.left[k] -= amount
                        self.left[k ^ 1] += amount
                    cut = next(i for i, k in enumerate(path) if self.left[k] <= EPS)
                    at = self.head[path[cut] ^ 1]
                    del path[cut:]
                while turn[at] < len(self.out[at]):
                    k = self.out[at][turn[at]]
                    if self.left[k] > EPS and level[self.head[k]] == level[at] + 1:
                        break
                    turn[at] += 1
                if turn[at] < len(self.out[at]):
                    path.append(k)
                    at = self.head[k]
                elif path:
                    at = self.head[path.pop() ^ 1]
                    turn[at] += 1
                else:
                    break
        return sent


@dataclass(frozen=True)
class MixPlan:
    """How many tokens each membership pattern gives to each source; ``total`` tokens in all."""

    total: float
    quotas: dict[str, float]
    flows: dict[tuple[str, ...], dict[str, float]]
    sizes: dict[tuple[str, ...], int]


class Network:
    """Patterns routed to sources. Repetition r of a pattern's tokens costs r, so costs rise on the arcs into patterns only, and cheapest paths are those of the least repetition
    that has room: capacity is opened repetition by repetition, and flow sent before is never called back."""

    def __init__(self, sizes: Mapping[tuple[str, ...], int], shares: Mapping[str, float], repeats: Mapping[str, int], total: float):
        self.sizes, self.shares, self.total = sizes, shares, total
        self.flow = Flow(2 + len(sizes) + len(shares))
        self.at = {s: 2 + len(sizes) + i for i, s in enumerate(shares)}
        self.rounds = {p: max(repeats[s] for s in p) for p in sizes}
        self.enter = {p: self.flow.arc(0, 2 + i, 0.0) for i, p in enumerate(sizes)}
        self.route = {(p, s): self.flow.arc(2 + i, self.at[s], sizes[p] * repeats[s]) for i, p in enumerate(sizes) for s in p}
        for s in shares:
            self.flow.arc(self.at[s], 1, shares[s] * total)

    def send(self) -> float:
        """Fill the quotas at least cost; the amount sent."""
        sent = 0.0
        for r in range(max(self.rounds.values(), default=0)):
            for p, k in self.enter.items():
                if r < self.rounds[p]:
                    self.flow.left[k] += self.sizes[p]
            sent += self.flow.run(0, 1)
            if sent >= self.total - EPS:
                break
        return sent

    def flows(self) -> dict[tuple[tuple[str, ...], str], float]:
        """Tokens that each pattern gives to each source."""
        return {key: self.flow.left[k ^ 1] for key, k in self.route.items()}

    def cost(self) -> float:
        """Sum over repetitions of their number times their tokens."""
        used = {p: self.flow.left[k ^ 1] for p, k in self.enter.items()}
        return sum(r * max(0.0, min(used[p] - r * n, n)) for p, n in self.sizes.items() for r in range(self.rounds[p]))

    def short(self) -> float:
        """After ``send``: the share of the sources whose quotas are cut off from the patterns with room, 1 less that share being what limits the total."""
        level = self.flow.levels(0)
        return sum(x for s, x in self.shares.items() if level[self.at[s]] >= 0)


def largest_total(sizes: Mapping[tuple[str, ...], int], shares: Mapping[str, float], repeats: Mapping[str, int]) -> float:
    """The largest total at which every quota can be filled: from above, each minimal cut gives the total that it allows, until one fits."""
    total = float(sum(n * max(repeats[s] for s in p) for p, n in sizes.items()))
    for _ in range(2 + 2 ** min(len(shares), 20)):
        network = Network(sizes, shares, repeats, total)
        sent = network.send()
        if sent >= total * (1 - 1e-9) - 1e-3:
            break
        share = network.short()  # sent = constant + share * total
        total = (sent - share * total) / (1 - share)
    return total


def plan_mix(sizes: Mapping[tuple[str, ...], int], targets: Mapping[str, tuple[float, int]], total: float | None = None) -> MixPlan:
    """Route token capacity of membership patterns to source quotas.

    ``sizes``: tokens of the distinct texts that stand in exactly these sources. ``targets``: share and most repetitions of each
    source. Sources without any text can't be drawn; the others keep their proportions and fill the whole. ``total``
    defaults to the largest size at which every such source reaches its share; a larger one is reduced to that.
    """
    live = sorted({s for p, n in sizes.items() if n > 0 for s in p if targets[s][0] > 0 and targets[s][1] > 0})
    kept: dict[tuple[str, ...], int] = {}
    for p, n in sizes.items():
        q = tuple(sorted(s for s in p if s in live))
        if q and n > 0:
            kept[q] = kept.get(q, 0) + n
    whole = sum(targets[s][0] for s in live)
    if not live:
        return MixPlan(0.0, {}, {}, {})
    shares = {s: targets[s][0] / whole for s in live}
    repeats = {s: int(targets[s][1]) for s in live}
    most = largest_total(kept, shares, repeats)
    size = most if total is None else min(most, total)
    network = Network(kept, shares, repeats, size)
    network.send()
    flows = network.flows()
    return MixPlan(size, {s: shares[s] * size for s in live}, {p: {s: flows[p, s] for s in p} for p in kept}, kept)


def pattern_sizes(texts: DataFrame, targets: Mapping[str, tuple[float, int]], most: int) -> tuple[DataFrame, dict[tuple[str, ...], int], dict[str, int]]:
    """(texts, sizes, available): tokens of each membership pattern, and of each source. At most ``most`` patterns, the largest, reach the driver, and one more for each source.

    Texts of rarer patterns stay, each under the pattern of one of its sources: drawn by the text's hash, the likelier the fewer tokens a source has for its share.
    """
    counted = lambda df: df.groupBy("pattern").agg(F.sum("tokens").alias("n"))
    split = lambda rows: {tuple(r["pattern"].split(SEPARATOR)): r["n"] for r in rows}
    rows = counted(texts).orderBy(F.desc("n"), "pattern").limit(most + 1).collect()
    if len(rows) <= most:
        sizes = split(rows)
        return texts, sizes, {s: sum(n for p, n in sizes.items() if s in p) for s in targets}
    own = texts.select(F.explode("members.source").alias("source"), "tokens").groupBy("source").agg(F.sum("tokens").alias("n")).collect()
    available = {r["source"]: r["n"] for r in own}
    need = F.create_map(*[x for s, n in available.items() for x in (F.lit(s), F.lit(max(targets[s][0], 1e-9) / n))])
    listed = texts.sparkSession.createDataFrame([(r["pattern"], True) for r in rows[:most]], "pattern string, listed boolean")
    chance = lambda s: (F.pmod(F.xxhash64("t1", "t2", s), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    one = F.array_min(F.transform("members.source", lambda s: F.struct((-F.ln(chance(s)) / F.element_at(need, s)).alias("wait"), s.alias("source"))))["source"]
    kept = checkpointed(texts.join(listed, "pattern", "left").withColumn("pattern", F.when(F.col("listed"), F.col("pattern")).otherwise(one)).drop("listed"))
    return kept, split(counted(kept).collect()), {s: available.get(s, 0) for s in targets}


def draw_mix(
    docs: DataFrame, targets: DataFrame, identifier: str, text: str, source: str, share: str = "target_share", max_repeats: str = "max_repeats", total_tokens: float | None = None, seed: int = 7, *, vocabulary: str, most_patterns: int = MOST_PATTERNS,
) -> tuple[DataFrame, DataFrame]:
    """(mix, report): documents with the number of times each is used for its source, and the shares reached.

    A document is a distinct text; it may stand in several sources (copies), and the set of them is its membership pattern. Documents are
    added up by pattern; a min-cost flow routes the patterns' tokens to the sources' quotas, a repetition costing
    more the more often the text is repeated; the flow's result is realised by documents in an order drawn from ``seed``. A text's
    use for a source never exceeds the source's ``max_repeats``, nor its use in all the greatest among its sources. Shares are reached up to
    one document per pattern and source. Of copies within a source the least id is drawn.

    The order is laid out as a prefix sum in two levels, 4096 hash buckets per pattern and rows within a bucket, so no pattern is sorted in one
    task. Only pattern totals reach the driver, at most ``most_patterns`` and one per source; a text of a rarer pattern is drawn for one of its sources only.

    ``vocabulary``: path of the token ranks. mix: (id, source, repeats, tokens). report: (source, target_share, reachable_share, max_repeats, available_tokens, quota_tokens, drawn_tokens,
    drawn_documents, most_repeats, actual_share), a row per target source, also for those without documents; ``reachable_share`` is the target's part of the targets of sources that have
    documents, which ``actual_share`` approaches, and 0 for those without. Sources absent from ``targets``, null
    sources, null and empty texts aren't drawn. Rows of ``targets`` with a null source, share or repetition count are left out; if a source is
    targeted twice, the greatest share counts. Empty documents or targets give an empty mix.
    """
    require_columns(docs, [identifier, text, source], "documents")
    require_columns(targets, [source, share, max_repeats], "targets")
    spark = docs.sparkSession
    wanted = {r["s"]: (float(r["x"]), int(r["m"])) for r in targets.select(F.col(source).alias("s"), F.col(share).alias("x"), F.col(max_repeats).alias("m")).na.drop().orderBy("x", "m").collect()}
    sized = token_sizes(docs.filter(F.col(source).isin(list(wanted))), identifier, text, source, vocabulary).filter("tokens > 0")
    per_source = sized.groupBy("t1", "t2", "source").agg(F.min("id").alias("id"), F.max("tokens").alias("tokens"))
    texts = per_source.groupBy("t1", "t2").agg(F.sort_array(F.collect_list(F.struct("source", "id"))).alias("members"), F.max("tokens").alias("tokens"))
    spot = F.xxhash64("t1", "t2", F.lit(seed))
    texts = checkpointed(texts.select("members", "tokens", F.array_join("members.source", SEPARATOR).alias("pattern"), F.pmod(spot, F.lit(BUCKETS)).cast("int").alias("bucket"), spot.alias("spot"), "t1", "t2"))
    texts, sizes, available = pattern_sizes(texts, wanted, most_patterns)
    by_bucket = texts.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("size"))
    plan = plan_mix(sizes, wanted, total_tokens)
    # A pattern's uses are laid end to end on a circle of its documents: source by source, each an interval.
    parts = []
    for pattern in sizes:
        live = tuple(sorted(s for s in pattern if s in plan.quotas))
        if live not in plan.flows:
            continue
        fraction, start = sizes[pattern] / plan.sizes[live], 0.0  # patterns that differ in dead sources only share their flow
        for s, amount in plan.flows[live].items():
            parts.append((SEPARATOR.join(pattern), s, float(sizes[pattern]), start, start + amount * fraction))
            start += amount * fraction
    cuts = spark.createDataFrame(parts, "pattern string, use string, circle double, lo double, hi double")
    before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("pattern", "bucket").orderBy("spot", "t1", "t2").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.select("pattern", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    placed = texts.join(offsets, ["pattern", "bucket"]).withColumn("pos", F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    uses = F.ceil((F.col("hi") - F.col("pos")) / F.col("circle")) - F.ceil((F.col("lo") - F.col("pos")) / F.col("circle"))
    mix = (
        placed.join(cuts, "pattern")
        .select(F.expr("filter(members, m -> m.source = use)[0].id").alias("id"), F.col("use").alias("source"), uses.cast("int").alias("repeats"), "tokens")
        .filter("repeats > 0")
    )
    whole = sum(wanted[s][0] for s in plan.quotas) or 1.0
    rows = [(s, x, x / whole if s in plan.quotas else 0.0, m, int(available[s]), float(plan.quotas.get(s, 0.0))) for s, (x, m) in sorted(wanted.items())]
    base = spark.createDataFrame(rows, "source string, target_share double, reachable_share double, max_repeats int, available_tokens bigint, quota_tokens double")
    drawn = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("drawn_tokens"), F.count("*").alias("drawn_documents"), F.max("repeats").alias("most_repeats"))
    report = base.join(drawn, "source", "left").na.fill(0, ["drawn_tokens", "drawn_documents", "most_repeats"])
    all_tokens = F.sum("drawn_tokens").over(Window.partitionBy())
    report = report.withColumn("actual_share", F.col("drawn_tokens") / F.when(all_tokens > 0, all_tokens))
    return mix, report
