"""Held-out test items whose passages stand in a training corpus."""

from __future__ import annotations

import math
import re
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.common import checkpointed, ensure_checkpoint_dir, require_columns
from tidemark.llm.lookalike import fold_key, strip_compat

# A combining mark belongs to its word: a look-alike base letter has no composed form with it.
WORDS = re.compile("[^\\W_](?:[^\\W_]|[̀-ͯ])*")
K1, B = 1.2, 0.75
#: Sums of single-precision impacts in another order differ by less.
SLACK = 1e-3
#: Items of a block, as many as a word has bits.
BLOCK = 64
#: Times an item's number: tells equal runs of different items apart.
SALT = np.uint64(0xD1B54A32D192ED03)


def words_of(text: str) -> list[str]:
    """Maximal runs of letters and digits after unification, keyed without regard to case and look-alike letters."""
    return [fold_key(w) for w in WORDS.findall(strip_compat(text))]


class _Hashes(dict):
    """Raw word to the 64-bit hash of its key; keeps what it has seen."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(fold_key(word).encode("utf-8", "surrogatepass"))
        return h


_HASHES = _Hashes()


def word_hashes(text: str) -> np.ndarray:
    """Hashes of ``words_of``."""
    return np.fromiter(map(_HASHES.__getitem__, WORDS.findall(strip_compat(text))), np.uint64)


def run_hashes(words: np.ndarray, run: int) -> np.ndarray:
    """A hash of each ``run`` consecutive words, by position of the first."""
    n = max(0, len(words) - run + 1)
    odd = (np.arange(1, run + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    out = np.zeros(n, np.uint64)
    for k in range(run):
        out = out * odd[k] + words[k : k + n]
    return out


class Shard:
    """Part of a BM25 inverted index of test items: posting lists with block maxima, thresholds, and the items' words for verification.

    An item's threshold is the least score that any ``run`` consecutive words of it give: a passage holding such a run scores no less, so
    retrieving everything at or above the threshold loses nothing. Items are numbered by rising threshold, so a bound that fails for one item fails for all
    after it that the same lists could reach. Arrays only; a posting list is a stretch of ``item`` and ``impact``, in order of item. For each list and block of ``BLOCK`` items
    there are the place where the block begins, the items present as bits, and the greatest impact.
    """

    NAMES = (("vocabulary", "<u8"), ("first", "<i8"), ("item", "<i8"), ("impact", "<f4"), ("block_at", "<i4"), ("block_has", "<u8"), ("block_max", "<f4"), ("threshold", "<f4"), ("words", "<i4"), ("run_key", "<u8"), ("run_at", "<i8"))

    def __init__(self, ids: list, arrays: dict[str, np.ndarray], run: int):
        self.ids, self.run, self.n = ids, run, len(ids)
        self.__dict__.update(arrays)
        self.blocks = -(-self.n // BLOCK)
        self.top = np.append(np.maximum.reduceat(self.impact, self.first[:-1]), np.float32(0)) if self.n else np.zeros(1, np.float32)
        self.limit = np.append(self.threshold, np.float32(np.inf))
        self.bytes = sum(a.nbytes for a in arrays.values())

    @classmethod
    def build(cls, ids: list, texts: list[np.ndarray], frequency: dict[int, int], items: int, mean: float, run: int) -> Shard:
        """Index of items given by word hashes (each of at least ``run``); ``frequency``, ``items`` and ``mean`` are those of all items."""
        vocabulary = np.unique(np.concatenate(texts))
        idf = np.array([math.log(1 + (items - frequency[w] + 0.5) / (frequency[w] + 0.5)) for w in vocabulary.tolist()])
        numbered, impacts, least = [np.searchsorted(vocabulary, t) for t in texts], [], []
        for x in numbered:
            terms, back, tf = np.unique(x, return_inverse=True, return_counts=True)
            weight = (idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(x) / mean))).astype(np.float32)
            seen = np.sort(np.lib.stride_tricks.sliding_window_view(back, run), axis=1)
            own = weight[seen]
            own[:, 1:][seen[:, 1:] == seen[:, :-1]] = 0  # a word counts once
            impacts.append((terms, weight))
            least.append(float(own.sum(1).min()) - SLACK)
        order = np.argsort(np.array(least), kind="stable")
        term = np.concatenate([impacts[i][0] for i in order])
        item = np.repeat(np.arange(len(order)), [len(impacts[i][0]) for i in order])
        impact = np.concatenate([impacts[i][1] for i in order])
        by_list = np.lexsort((item, term))
        term, item, impact = term[by_list], item[by_list], impact[by_list]
        blocks = -(-len(order) // BLOCK)
        cell, cells = term * blocks + item // BLOCK, len(vocabulary) * blocks
        block_has, block_max = np.zeros(cells, np.uint64), np.zeros(cells, np.float32)
        np.bitwise_or.at(block_has, cell, np.uint64(1) << (item % BLOCK).astype(np.uint64))
        np.maximum.at(block_max, cell, impact)
        lengths = [len(numbered[i]) for i in order]
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        runs = [run_hashes(texts[i], run) + salt for i, salt in zip(order, np.arange(1, len(order) + 1, dtype=np.uint64) * SALT, strict=True)]
        run_key, run_at = np.concatenate(runs), np.concatenate([at + np.arange(len(r)) for at, r in zip(begin, runs, strict=True)])
        sorted_runs = np.argsort(run_key, kind="stable")
        arrays = {
            "vocabulary": vocabulary, "first": np.searchsorted(term, np.arange(len(vocabulary) + 1)), "item": item, "impact": impact, "block_at": np.searchsorted(cell, np.arange(cells)).astype(np.int32), "block_has": block_has, "block_max": block_max,
            "threshold": np.array(least, np.float32)[order], "words": np.concatenate([numbered[i] for i in order]).astype(np.int32), "run_key": run_key[sorted_runs], "run_at": run_at[sorted_runs],
        }
        return cls([ids[i] for i in order], arrays, run)

    def pack(self) -> list[bytes]:
        """The arrays as bytes, in order of ``NAMES``."""
        return [np.ascontiguousarray(getattr(self, name), kind).tobytes() for name, kind in self.NAMES]

    @classmethod
    def unpack(cls, ids: list, blobs: list[bytes], run: int) -> Shard:
        """The reverse of ``pack``."""
        return cls(ids, {name: np.frombuffer(blob, kind) for (name, kind), blob in zip(cls.NAMES, blobs, strict=True)}, run)

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Word hashes to list numbers, -1 for words of no item."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at, -1)

    def retrieve(self, terms: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item) numbers whose BM25 score reaches the item's threshold; passages are stretches of ``terms``."""
        total = np.concatenate([[0.0], np.cumsum(self.top[terms], dtype=np.float64)])
        alive = np.flatnonzero(total[ends] - total[starts] >= self.limit[0])
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for at in range(0, len(alive), chunk):
            part = alive[at : at + chunk]
            where = starts[part][:, None] + np.arange(int((ends[part] - starts[part]).max()))
            grid = np.where(where < ends[part][:, None], terms[np.minimum(where, len(terms) - 1)], -1)
            grid = -np.sort(-grid, axis=1)
            grid[:, 1:][grid[:, 1:] == grid[:, :-1]] = -1
            grid = -np.sort(-grid, axis=1)
            found += self._walk(part, grid[:, : int((grid >= 0).sum(1).max())])
        return np.concatenate([p for p, _ in found]), np.concatenate([d for _, d in found])

    def _walk(self, passage: np.ndarray, lists: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Block-max WAND of many passages side by side, one pivot each a round.

        ``lists``: the posting lists of each passage, -1 for none. The pivot is the first item at which the lists that have come no further could reach the item's
        threshold by their maxima. If their block maxima can't, they skip to the end of the block or to where the next list stands; else they move to
        the pivot and are added up.
        """
        n, item, impact = self.n, np.append(self.item, self.n).astype(np.int32), self.impact
        bound, stop = self.top[lists], np.where(lists >= 0, self.first[lists + 1], 0).astype(np.int32)
        begin = np.where(lists >= 0, self.first[lists], 0).astype(np.int32)
        now = np.where(begin < stop, item[begin], n).astype(np.int32)
        lists = lists.astype(np.int32)
        while len(passage):
            order = np.argsort(now, axis=1)
            rows = np.arange(len(now))[:, None]
            at = now[rows, order]
            could = np.cumsum(bound[rows, order], axis=1) >= self.limit[at]
            first = could.argmax(1)
            live = could[rows[:, 0], first]
            pivot = at[rows[:, 0], first]
            if not live.all():
                passage, lists, bound, stop, now, pivot = (a[live] for a in (passage, lists, bound, stop, now, pivot))
                if not len(passage):
                    return
            behind = now <= pivot[:, None]
            where = np.flatnonzero(behind)
            row = where // now.shape[1]
            block = pivot // BLOCK
            cell = lists.reshape(-1)[where] * np.int32(self.blocks) + block[row]
            inside = np.bincount(row, self.block_max[cell], len(pivot))
            worth = inside >= self.limit[pivot]
            target = np.where(worth, pivot, np.minimum((block + 1) * BLOCK, np.where(behind, n, now).min(1)))
            goal = target[row]
            far = goal // BLOCK >= self.blocks  # beyond the last block
            cell = cell + np.where(far, 0, goal // BLOCK - block[row])
            before = (np.uint64(1) << (goal % BLOCK).astype(np.uint64)) - np.uint64(1)
            to = self.block_at[cell] + np.bitwise_count(self.block_has[cell] & before)
            last = stop.reshape(-1)[where]
            to = np.where(far, last, to)
            there = np.where(to < last, item[to], n)
            hit = np.flatnonzero(worth[row] & (there == goal))
            if len(hit):
                score = np.bincount(row[hit], impact[to[hit]], len(pivot))
                good = worth & (score >= self.limit[pivot])
                if good.any():
                    yield passage[good], pivot[good]
                beyond = to[hit] + 1
                there[hit] = np.where(beyond < last[hit], item[beyond], n)
            now.reshape(-1)[where] = there

    def passages(self, terms: np.ndarray, cuts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the passages to query: ``window`` words, overlapping by ``run - 1``, of every stretch of known words of a document.

        A word of no item can't be part of a shared run, so texts are cut there, as they are at ``cuts``, the documents' ends; a stretch shorter than a run holds none.
        """
        known = np.append(terms >= 0, False)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], known]).astype(np.int8)))
        begin, end = edge[0::2], edge[1::2]
        inner = cuts[known[cuts - 1] & known[np.minimum(cuts, len(terms))]]  # a document's end within a stretch
        begin, end = np.sort(np.append(begin, inner)), np.sort(np.append(end, inner))
        long = end - begin >= self.run
        begin, end = begin[long], end[long]
        stride = window - self.run + 1
        count = (end - begin - self.run) // stride + 1
        starts = np.repeat(begin, count) + stride * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
        return starts, np.minimum(starts + window, np.repeat(end, count))

    def leaks(self, words: np.ndarray, runs: np.ndarray, cuts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of a word, item) numbers of texts, ending at ``cuts``, that share ``run`` consecutive words: retrieved by score, then verified word for word."""
        terms = self.numbers(words)
        starts, ends = self.passages(terms, cuts, window)
        passage, item = self.retrieve(terms, starts, ends)
        if not len(passage):
            return passage, item
        span = np.arange(int((ends[passage] - starts[passage]).max()) - self.run + 1)
        pair, shift = np.nonzero(starts[passage][:, None] + span <= ends[passage][:, None] - self.run)
        at = starts[passage][pair] + shift
        key = runs[at] + (item[pair] + 1).astype(np.uint64) * SALT
        place = np.minimum(np.searchsorted(self.run_key, key), len(self.run_key) - 1)
        same = self.run_key[place] == key
        pair, at, begin = pair[same], at[same], self.run_at[place[same]]
        step = np.arange(self.run)
        kept = np.unique(pair[(terms[at[:, None] + step] == self.words[begin[:, None] + step]).all(1)])
        return starts[passage[kept]], item[kept]


_LOADED: OrderedDict[tuple[str, int], Shard] = OrderedDict()


def load_shard(folder: str, number: int, run: int, budget: int = 256 << 20) -> Shard:
    """A shard from the shared folder; a worker keeps the last ones used, up to ``budget`` bytes."""
    key = (folder, number)
    if key in _LOADED:
        _LOADED.move_to_end(key)
        return _LOADED[key]
    uri = re.sub("^file:/+", "file:///", folder)
    files, root = pyarrow.fs.FileSystem.from_uri(uri) if ":" in uri else (pyarrow.fs.LocalFileSystem(), uri)
    row = pyarrow.parquet.read_table(f"{root}/shard={number}", filesystem=files)
    shard = Shard.unpack(row.column("ids")[0].as_py(), [row.column(name)[0].as_py() for name, _ in Shard.NAMES], run)
    _LOADED[key] = shard
    while len(_LOADED) > 1 and sum(s.bytes for s in _LOADED.values()) > budget:
        _LOADED.popitem(last=False)
    return shard


def write_index(items: DataFrame, item_id: str, item_text: str, run: int, shard_words: int) -> tuple[str, list[int]]:
    """Build the index in the cluster and write it to the shared folder: (folder, numbers of its shards).

    The driver sees the count of items and of their words and the shards' numbers; document frequencies are aggregated and joined as a table, and each shard, of about
    ``shard_words`` words, is built in a task of its own.
    """
    spark = items.sparkSession
    kind = dict(items.dtypes)[item_id]

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [word_hashes(t).view(np.int64) for t in batch.column(1).to_pylist()]
            kept = [i for i, x in enumerate(lists) if len(x) >= run]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array([lists[i] for i in kept], pa.list_(pa.int64()))], ["item", "words"])

    texts = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("t")).filter("item is not null and t is not null").distinct()
    entries = checkpointed(texts.mapInArrow(tokens, f"item {kind}, words array<bigint>"))
    count, total = entries.agg(F.count("*"), F.sum(F.size("words"))).first()
    if not count:
        return "", []
    shards, mean = -(-total // shard_words), total / count
    placed = entries.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int"))
    own = placed.select("shard", F.explode(F.array_distinct("words")).alias("word")).groupBy("shard", "word").agg(F.count(F.lit(1)).alias("n"))
    frequency = own.join(own.groupBy("word").agg(F.sum("n").alias("frequency")), "word").select(F.col("shard").alias("part"), "word", "frequency")

    def build(key: tuple, texts: pa.Table, words: pa.Table) -> pa.Table:
        known = dict(zip(words.column("word").to_numpy().view(np.uint64).tolist(), words.column("frequency").to_pylist(), strict=True))
        made = Shard.build(texts.column("item").to_pylist(), [np.array(x, np.int64).view(np.uint64) for x in texts.column("words").to_pylist()], known, count, mean, run)
        ids = pa.array([made.ids], pa.list_(texts.schema.field("item").type))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), ids, *(pa.array([x], pa.binary()) for x in made.pack())], names=["shard", "ids", *(name for name, _ in Shard.NAMES)])

    schema = f"shard int, ids array<{kind}>, " + ", ".join(f"{name} binary" for name, _ in Shard.NAMES)
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/leakage-{uuid.uuid4().hex}"
    index = placed.groupBy("shard").cogroup(frequency.groupBy("part")).applyInArrow(build, schema)
    index.write.partitionBy("shard").parquet(folder)
    return folder, sorted(r["shard"] for r in spark.read.parquet(folder).select("shard").distinct().collect())


def leaked_items(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, run: int = 12, window: int = 24, shard_words: int = 50_000, chars: int = 4_000_000) -> DataFrame:
    """Pairs (item_id, doc_id): the document holds ``run`` or more consecutive words of the item.

    Every document is cut at words of no item and into passages of ``window`` words that overlap by ``run - 1``, and every passage that can hold a run is a query
    against the items' BM25 index by block-max WAND; all items reaching their threshold are retrieved and then verified word for word. The corpus is scanned once and not shuffled. The index is built in the
    cluster and written to the shared folder in shards of about ``shard_words`` words; tasks tokenise documents in groups of about ``chars`` characters and hold each group against
    one shard after the other, so neither the driver's nor a task's memory grows with the number of items. Nothing is capped. Words are told apart by 64-bit hashes.

    Null and empty texts and those with fewer than ``run`` words match nothing; repeated rows give one pair. Items repeated under
    another id are found under each; an id with several texts stands for all of them.
    """
    require_columns(docs, [doc_id, doc_text], "documents")
    require_columns(items, [item_id, item_text], "items")
    if not run <= window:
        raise ValueError("window must hold at least one run")
    item_kind = items.schema[item_id].dataType
    schema = f"item_id {item_kind.simpleString()}, doc_id {dict(docs.dtypes)[doc_id]}"
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("t"))
    folder, shards = write_index(items, item_id, item_text, run, shard_words)
    if not shards:
        return source.select(F.lit(None).cast(item_kind).alias("item_id"), "doc_id").filter(F.lit(False))
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(item_kind)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for n, text in enumerate(batch.column(1)):
                held.append((n, text.as_py() or ""))
                size += len(held[-1][1])
                if size >= chars:
                    yield from look_up(batch, held)
                    held, size = [], 0
            if held:
                yield from look_up(batch, held)

    def look_up(batch: pa.RecordBatch, held: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
        lists = [(n, w) for n, w in ((n, word_hashes(t)) for n, t in held) if len(w) >= run]
        if not lists:
            return
        words, owner, cuts = np.concatenate([w for _, w in lists]), np.array([n for n, _ in lists]), np.cumsum([len(w) for _, w in lists])
        runs = run_hashes(words, run)
        for number in shards:
            shard = load_shard(folder, number, run)
            place, item = shard.leaks(words, runs, cuts, window)
            pairs = np.unique(np.stack([owner[np.searchsorted(cuts, place, "right")], item]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([shard.ids[i] for i in pairs[1].tolist()], id_type), batch.column(0).take(pa.array(pairs[0], pa.int64()))], ["item_id", "doc_id"])

    return source.mapInArrow(search, schema).distinct()
