"""Bring texts that look alike to one form, and keep texts that look different apart."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.common import checkpointed, fresh, require_columns

# Characters without width (general category Cf, joiners, fillers and variation selectors).
IGNORABLE = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￹-￻\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
# All single spaces (general category Zs).
SPACES = "   -   　"
# Latin letters with the Cyrillic and Greek letters of the same shape.
LOOKALIKES = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "ЈͿ", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "Q": "Ԛ",
    "S": "Ѕ", "T": "ТΤ", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "УΥҮ", "Z": "Ζ",
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "јϳ", "o": "оο", "p": "р", "q": "ԛ", "s": "ѕ", "v": "ѵν", "w": "ԝ", "x": "х", "y": "у",
}

LATIN, CYRILLIC, GREEK = 0, 1, 2
_REMOVE = re.compile(f"[{IGNORABLE}]+")
_COMPAT = re.compile(f"[{SPACES}！-～]+")
_COMPAT_MAP = {**{c: 0x20 for c in (0xA0, 0x1680, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B))}, **{c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}}
_BEYOND_LATIN = re.compile("[Ͱ-ԯᲀ-᲏ἀ-῿ⷠ-ⷿꙀ-ꚟ]")
_WORD = re.compile("(?:[^\\W\\d_]|[̀-ͯ])+")
_SKELETON = {ord(x): latin for latin, others in LOOKALIKES.items() for x in others}
_CHOICES = {latin: latin + others for latin, others in LOOKALIKES.items()}
#: Letters that the bigram model counts: those of the three scripts below U+0530.
ALPHABET = 0x530


def script(ch: str) -> int | None:
    """The script of a letter, or None for other characters and scripts."""
    if not ch.isalpha():
        return None
    code = ord(ch)
    if code < 0x2B0 or 0x1E00 <= code < 0x1F00:
        return LATIN
    if 0x400 <= code < 0x530:
        return CYRILLIC
    if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000:
        return GREEK
    return None


def strip_compat(text: str, compatibility: str = "width") -> str:
    """Delete characters without width, unify spaces, compatibility forms, canonical composition.

    ``width``: full-width forms become ASCII; raised digits, ligatures and other compatibility characters look different and stay.
    ``full``: every compatibility character is replaced (half-width kana, ligatures, raised digits), for texts compared by content and not by looks.
    """
    if text.isascii():
        return text
    text = _REMOVE.sub("", text)
    text = _COMPAT.sub(lambda m: m[0].translate(_COMPAT_MAP), text)
    return unicodedata.normalize("NFKC" if compatibility == "full" else "NFC", text)


def _certain(lo: int, hi: int, which: int) -> re.Pattern[str]:
    """Runs of the letters in [lo, hi) of one script whose base letter has no look-alike."""
    bases = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, range(lo, hi)) if script(c) == which}
    return re.compile("[" + "".join(c for c, base in bases.items() if base not in LOOKALIKES and ord(base) not in _SKELETON) + "]+")


_CERTAIN = {LATIN: _certain(0x41, 0x7B, LATIN), CYRILLIC: _certain(0x400, 0x530, CYRILLIC), GREEK: _certain(0x370, 0x400, GREEK)}
_BEYOND_CYRILLIC = re.compile("[A-Za-zÀ-ʯͰ-ϿḀ-῿]")


def leading_script(text: str) -> int | None:
    """The script with the most letters that have no look-alike in another, or None if there are none."""
    seen = [sum(map(len, _CERTAIN[s].findall(text))) for s in (LATIN, CYRILLIC, GREEK)]
    return seen.index(max(seen)) if any(seen) else None


def _open_tokens() -> re.Pattern[str]:
    """Tokens with look-alikes and without a letter that is certain of its script, so that more than one script can spell them."""
    letters = [c for c in map(chr, range(0x41, 0x2000)) if script(c) is not None]
    bases = {c: unicodedata.normalize("NFD", c)[0] for c in letters}
    some, marks = "".join(c for c, base in bases.items() if base in LOOKALIKES or ord(base) in _SKELETON), "̀-ͯ"
    other = f"[^\\W\\d_{''.join(letters)}]"  # letters of scripts without look-alikes
    run = f"(?:{other}|[{marks}])*[{some}](?:[{some}{marks}]|{other})*"
    return re.compile(f"(?<![^\\W\\d_])(?<![{marks}]){run}(?![^\\W\\d_])(?![{marks}])")


def _twins() -> re.Pattern[str]:
    """Letters that look like another one of their own script, so that no script alone tells their spelling."""
    twins = {x for choice in _CHOICES.values() for x in choice if sum(script(x) == script(y) for y in choice) > 1}
    return re.compile("[" + "".join(c for c in map(chr, range(0x41, 0x2000)) if unicodedata.normalize("NFD", c)[0] in twins) + "]")


_OPEN, _TWINS = _open_tokens(), _twins()
#: Cost (natural log) of a stretch outside the leading script: a prior that n-gram scores have to outweigh.
STRANGE = 4.0
Step = tuple[tuple[int, float], str, "int | None", int]


class Unifier:
    """Maps texts to one form; two texts get the same form exactly if they look alike.

    A token becomes a lattice: at each letter, all letters of the same shape. Viterbi takes, among the script-consistent paths (those with
    the fewest changes of script), the one with the best score: the sum of log probabilities of character bigrams within a script, less
    ``STRANGE`` for each stretch outside the line's leading script. The leading script is that of the letters without look-alikes in the line, else in
    the text. All this depends on shapes only, so texts of equal shape get the same path, and each path's letters tell the shape, so texts of different
    shape stay different, whatever the bigrams: they choose which of the equal-looking spellings stands for all.

    ``bigrams`` maps (previous, next) character codes to counts over the corpus (0 stands for a token's edge); without any all letters are
    equally likely, and the leading script decides. ``compatibility``: see ``strip_compat``.
    """

    def __init__(self, bigrams: dict[tuple[int, int], int] | None = None, compatibility: str = "width"):
        if compatibility not in ("width", "full"):
            raise ValueError("compatibility is 'width' or 'full'")
        self.bigrams, self.compatibility = bigrams or {}, compatibility
        self.totals: dict[int, int] = {}
        for (a, _), n in self.bigrams.items():
            self.totals[a] = self.totals.get(a, 0) + n
        self.cache: dict[tuple[str, int | None], str] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def cost(self, a: int, b: int) -> float:
        """Minus the log probability of ``b`` after ``a``, add-one smoothed over the alphabet."""
        return -math.log((self.bigrams.get((a, b), 0) + 1) / (self.totals.get(a, 0) + ALPHABET))

    def path(self, skeleton: str, lead: int | None) -> str:
        """The best spelling of a decomposed token whose look-alike letters are given by their Latin shape."""
        best: list[Step] = [((0, 0.0), "", None, 0)]
        for ch in skeleton:
            step: dict[tuple[int | None, int], Step] = {}
            for choice in _CHOICES.get(ch, ch):
                own, code = script(choice), ord(choice)
                for (changes, cost), text, before, last in best:
                    entry: Step
                    if own is None:  # a mark or a letter of a script without look-alikes
                        entry = ((changes, cost), text + choice, before, last)
                    elif own == before:
                        entry = ((changes, cost + self.cost(last, code)), text + choice, own, code)
                    else:  # a stretch of another script begins, with an edge of its own
                        prior = STRANGE if lead is not None and own != lead else 0.0
                        entry = ((changes + (before is not None), cost + self.cost(0, code) + prior), text + choice, own, code)
                    key = entry[2], entry[3]
                    if key not in step or entry < step[key]:
                        step[key] = entry
            best = list(step.values())
        return min(best, key=lambda e: e[:2])[1]

    def token(self, word: str, lead: int | None) -> str:
        """The unified spelling of a token within a text led by a script."""
        skeleton = unicodedata.normalize("NFD", word).translate(_SKELETON)
        key = (skeleton, lead)
        if (out := self.cache.get(key)) is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            out = self.cache[key] = unicodedata.normalize("NFC", self.path(skeleton, lead))
        return out

    def __call__(self, text: str) -> str:
        """The unified text."""
        text = strip_compat(text, self.compatibility)
        lines, whole = text.split("\n"), -1
        for i, line in enumerate(lines):
            foreign = _BEYOND_LATIN.search(line) is not None
            alone = None  # the only script in the line, if some letter is certain of it: other tokens can't change then
            if not foreign and _CERTAIN[LATIN].search(line):
                alone = LATIN
            elif foreign and not _BEYOND_CYRILLIC.search(line) and not _TWINS.search(line) and _CERTAIN[CYRILLIC].search(line):
                alone = CYRILLIC
            if alone is not None:
                if self.bigrams:
                    lines[i] = _OPEN.sub(lambda m, lead=alone: self.token(m[0], lead), line)
                continue
            if not _WORD.search(line):
                continue
            lead = leading_script(line)
            if lead is None:
                whole = leading_script(text) if whole == -1 else whole
                lead = whole
            lines[i] = _WORD.sub(lambda m, lead=lead: self.token(m[0], lead), line)
        return "\n".join(lines)


def fold_key(word: str) -> str:
    """A key equal for words that look alike in either case; for matching words without regard to case."""
    return unicodedata.normalize("NFD", word).translate(_SKELETON).casefold().translate(_FOLD_AFTER)


# Lower-case letters whose capitals look alike belong together once case is disregarded.
_FOLD_AFTER = {ord(x.lower()): latin.lower() for latin, others in LOOKALIKES.items() for x in others}


def _count_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(ALPHABET * ALPHABET, np.int64)
    kind = np.full(ALPHABET + 1, -1, np.int8)
    for code in range(ALPHABET):
        s = script(chr(code))
        kind[code] = -1 if s is None else s
    for batch in batches:
        texts = [t for t in batch.column(0).to_pylist() if t]
        if not texts:
            continue
        codes = np.frombuffer("\n".join(["", *map(strip_compat, texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.minimum(codes, ALPHABET).astype(np.int64)
        kinds = kind[codes]
        letter = kinds >= 0
        a, b = np.where(letter, codes, 0)[:-1], np.where(letter, codes, 0)[1:]
        fit = (letter[:-1] & letter[1:] & (kinds[:-1] == kinds[1:])) | (letter[1:] & ~letter[:-1])
        found, n = np.unique(a[fit] * ALPHABET + b[fit], return_counts=True)
        counts[found] += n
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at // ALPHABET), pa.array(at % ALPHABET), pa.array(counts[at])], ["a", "b", "n"])


def train_unifier(texts: DataFrame, column: str) -> Unifier:
    """Count the character bigrams of all texts. Only the counts, at most one per pair of alphabet letters, are collected."""
    require_columns(texts, [column])
    parts = texts.select(F.col(column).cast("string").alias("t")).mapInArrow(_count_bigrams, "a bigint, b bigint, n bigint")
    rows = parts.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    return Unifier({(r["a"], r["b"]): r["n"] for r in rows})


def unify_texts(df: DataFrame, column: str, unifier: Unifier, output: str = "unified") -> DataFrame:
    """Add the unified form of a text column (null stays null, the empty text empty). Narrow, no shuffle.

    All other columns stay; if ``output`` is taken, a number is added to it. Texts of any length are processed whole.
    """
    require_columns(df, [column])
    name = fresh(df.columns, output)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
            out = pa.array([None if t is None else unifier(t) for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, name])

    return df.mapInArrow(run, df.select("*", F.lit(None).cast("string").alias(name)).schema)


def look_keys(df: DataFrame, identifier: str, column: str, unifier: Unifier) -> DataFrame:
    """(id, c1, c2, t1, t2): 128-bit hashes of the unified text and of the text as it is; rows with a null text are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            kept = [i for i, t in enumerate(texts.is_valid().to_pylist()) if t]
            raw = [texts[i].as_py() for i in kept]
            sums = [xxhash.xxh128_digest(s.encode("utf-8", "surrogatepass")) for t in raw for s in (unifier(t), t)]
            parts = np.frombuffer(b"".join(sums), "<i8").reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(kept, pa.int64())), *(pa.array(np.ascontiguousarray(parts[:, k])) for k in range(4))], ["id", "c1", "c2", "t1", "t2"])

    kind = dict(df.dtypes)[identifier]
    return df.select(F.col(identifier).alias("id"), F.col(column).alias("t")).mapInArrow(run, f"id {kind}, c1 bigint, c2 bigint, t1 bigint, t2 bigint")


CLASS, TEXT = ["c1", "c2"], ["t1", "t2"]


def lookalike_members(df: DataFrame, identifier: str, column: str, unifier: Unifier | None = None, salts: int = 32) -> DataFrame:
    """(id, c1, c2, t1, t2) of every document that has a look-alike which isn't an exact copy, computed once.

    (c1, c2) names the class of texts that look alike, (t1, t2) the exact text. Only hashes are shuffled; texts are counted with partial aggregates, and the documents meet the
    (few) texts of classes with several spread over ``salts`` tasks a text, so a text or class holding a third of all rows does no harm. Without ``unifier`` the bigrams
    that score its paths are counted over ``column``.
    """
    require_columns(df, [identifier, column])
    keys = checkpointed(look_keys(df, identifier, column, train_unifier(df, column) if unifier is None else unifier))
    texts = keys.select(*CLASS, *TEXT).distinct()
    several = texts.groupBy(*CLASS).agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select(*CLASS)
    wanted = texts.join(several, CLASS, "left_semi").select(*TEXT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    spread = keys.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    return checkpointed(spread.join(wanted, [*TEXT, "salt"], "left_semi").select("id", *CLASS, *TEXT).distinct())


def _counted(members: DataFrame) -> DataFrame:
    return members.groupBy(*CLASS, *TEXT).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))


def lookalike_classes(df: DataFrame, identifier: str, column: str, unifier: Unifier | None = None, salts: int = 32) -> DataFrame:
    """(id, class_id, links), one row per document that has a look-alike: the least id of those that look like it, and how many of them differ from it in their text.

    Size is that of the documents, however many pairs they make. Null texts have no look-alike; a repeated row is one document; empty texts look like texts of characters without width.
    """
    members = lookalike_members(df, identifier, column, unifier, salts)
    texts = _counted(members)
    classes = texts.groupBy(*CLASS).agg(F.sum("n").alias("all"), F.min("least").alias("class_id"))
    linked = texts.join(classes, CLASS).select(*TEXT, "class_id", (F.col("all") - F.col("n")).alias("links"))
    salted = linked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    return spread.join(salted, [*TEXT, "salt"]).select("id", "class_id", "links")


def lookalike_pairs(df: DataFrame, identifier: str, column: str, unifier: Unifier | None = None, salts: int = 32, chunk: int = 1024) -> DataFrame:
    """Pairs (a, b), smaller id first, of documents whose texts look alike but aren't equal.

    The distinct texts of a class are paired first, then ids are attached to both sides, so copies of one text never meet and every candidate is a result. A text's documents are cut
    into chunks of about ``chunk`` by hash, and a pair of texts into cells of one chunk on either side: no task holds more than single cells, whatever the number of copies. Null texts
    have no pairs; empty texts are equal to each other, and look like texts of characters without width. A repeated row is one document.
    """
    members = lookalike_members(df, identifier, column, unifier, salts)
    texts = _counted(members).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")).drop("n", "least")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    one = texts.select(*CLASS, F.struct(*TEXT).alias("ta"), F.col("chunks").alias("ca"), F.pmod(F.xxhash64(*TEXT), F.lit(salts)).cast("int").alias("salt"))
    two = texts.select(*CLASS, F.struct(*TEXT).alias("tb"), F.col("chunks").alias("cb"), every.alias("salt"))
    pairs = one.join(two, [*CLASS, "salt"]).filter(F.col("ta") < F.col("tb"))
    cells = pairs.select("ta", "tb", "cb", F.explode(F.sequence(F.lit(0), F.col("ca") - 1)).alias("i")).select("ta", "tb", "i", F.explode(F.sequence(F.lit(0), F.col("cb") - 1)).alias("j"))
    salted = texts.select(*TEXT, "chunks", every.alias("salt"))
    spread = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(salted, [*TEXT, "salt"])
    chunked = spread.select("id", F.struct(*TEXT).alias("t"), F.pmod(F.xxhash64("id", F.lit("chunk")), F.col("chunks")).cast("int").alias("k"))
    left = cells.join(chunked.select(F.col("id").alias("x"), F.col("t").alias("ta"), F.col("k").alias("i")), ["ta", "i"])
    right = cells.join(chunked.select(F.col("id").alias("y"), F.col("t").alias("tb"), F.col("k").alias("j")), ["tb", "j"])
    met = left.join(right, ["ta", "i", "tb", "j"]).filter(F.col("x") != F.col("y"))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
