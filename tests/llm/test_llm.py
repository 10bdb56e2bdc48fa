"""Top N, percentile sketches, look-alikes, leakage and mixing against brute force."""

import datetime as dt
import itertools
import random
import time
import unicodedata
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import leakage, lookalike, mixture, quantiles, queries
from tidemark.llm.queries import VOCABULARY
from tidemark.llm.top_n import top_n


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_top_n_matches_brute_force(spark):
    rng = random.Random(1)
    data = [(0 if rng.random() < 0.4 else rng.randrange(9), rng.choice([None, float("nan"), -0.0, 0.0, 1.0, 2.5, float("inf"), rng.random()]), f"t{rng.randrange(400)}") for _ in range(3000)]
    data += [(None, 1.0, "a"), (3, 9.0, None)]
    df = spark.createDataFrame(data, "g int, s double, i string").withColumn("rank", F.lit("taken"))
    out = top_n(df, ["g"], "s", "i", 5, salts=7)
    assert "rank_1" in out.columns
    want = []
    for g in {x[0] for x in data}:
        own = [x for x in data if x[0] == g and x[1] is not None and x[1] == x[1]]
        own.sort(key=lambda x: (-x[1], x[2] is not None, x[2] or ""))
        want += [(x[0], x[2]) for x in own[:5]]
    assert rows(out, "g", "i") == sorted(want, key=str)
    assert top_n(df.limit(0), ["g"], "s", "i", 5).count() == 0 and top_n(df, ["g"], "s", "i", 0).count() == 0


def rank_errors(sketch, values, ps):
    ordered = np.sort(values)
    for p in ps:
        q = sketch.quantiles([p])[0]
        true = np.searchsorted(ordered, q, "right") / len(ordered)
        tail = (1 - p) if sketch.high else p
        yield abs(true - p) / max(tail, 1 / len(ordered))


@pytest.mark.parametrize("high", [True, False])
@pytest.mark.parametrize("shape", ["normal", "sorted", "ties", "heavy"])
def test_sketch_error_is_relative_to_the_tail(high, shape):
    rng = np.random.default_rng(4)
    values = {"normal": rng.normal(size=200_000), "sorted": np.arange(200_000.0), "ties": rng.integers(0, 50_000, 200_000).astype(float), "heavy": np.exp(4 * rng.normal(size=200_000))}[shape]
    whole = quantiles.RelativeSketch(high=high)
    parts = [quantiles.RelativeSketch(high=high, salt=i) for i in range(37)]
    for i, part in enumerate(np.array_split(values, 37)):
        for chunk in np.array_split(part, 3):
            parts[i].update(chunk)
    for part in parts:
        whole.merge(quantiles.RelativeSketch.unpack(part.pack()))
    assert whole.n == len(values) and sum(len(x) << h for h, x in enumerate(whole.levels)) == len(values)
    assert sum(map(len, whole.levels)) < 20_000
    ps = (0.9, 0.95, 0.99, 0.999) if high else (0.1, 0.05, 0.01, 0.001)
    assert max(rank_errors(whole, values, ps)) <= whole.rank_error() + 1e-3


@pytest.mark.parametrize("high", [True, False])
def test_sketch_error_of_published_percentiles(high):
    values = np.exp(3 * np.random.default_rng(5).normal(size=150_000))
    whole = quantiles.RelativeSketch(high=high)
    for i, part in enumerate(np.array_split(values, 50)):
        one = quantiles.RelativeSketch(high=high, salt=i)
        one.update(part)
        whole.merge(one)
    assert whole.rank_error() > 0
    assert max(rank_errors(whole, values, (0.5, 0.75, 0.95, 0.99) if high else (0.5, 0.25, 0.05, 0.01))) <= whole.rank_error() + 1e-4


def test_sketches_are_passed_on_within_a_budget(spark):
    data = [(i % 400, float(i)) for i in range(20_000)]
    df = spark.createDataFrame(data, "g int, x double").coalesce(1)
    with_budget = quantiles.sketch_groups(df, "g", ["x"], budget=100_000)
    assert with_budget.count() > quantiles.sketch_groups(df, "g", ["x"]).count() == 400
    out = quantiles.read_percentiles(quantiles.merge_sketches(with_budget, ["grp", "field"], 3), ["grp", "field"], {"p50": 0.5})
    assert out.count() == 400 and {r["grp"]: r["p50"] for r in out.collect()} == {g: float(g + 400 * 24) for g in range(400)}


def test_small_sketches_are_exact():
    values = np.random.default_rng(1).normal(size=300)
    sketch = quantiles.RelativeSketch()
    for chunk in np.array_split(values, 11):
        sketch.update(chunk)
    assert sketch.rank_error() == 0 and sketch.quantiles([0.5, 0.99, 0, 1]) == [np.sort(values)[i] for i in (149, 296, 0, 299)]
    assert quantiles.RelativeSketch().quantiles([0.5]) == [None]
    with pytest.raises(ValueError, match="different"):
        sketch.merge(quantiles.RelativeSketch(high=False))


def test_group_percentiles(spark):
    rng = random.Random(2)
    data = [(dt.date(2023, 1, 1 + rng.choice([0, 0, 1, 2])), rng.choice([None, float("nan"), rng.random()]), float(n)) for n in range(2000)]
    data.append((None, 0.5, 1.0))
    df = spark.createDataFrame(data, "d date, a double, b double").withColumn("field", F.lit("clash")).withColumn("grp", F.lit("clash")).repartition(5)
    out = quantiles.group_percentiles(df, "d", ["a", "b"], {"p10": 0.1, "p50": 0.5})
    for r in out.collect():
        own = sorted(x[1 if r["field"] == "a" else 2] for x in data if x[0] == r["grp"] and x[1 if r["field"] == "a" else 2] is not None and not np.isnan(x[1 if r["field"] == "a" else 2]))
        assert r["n"] == len(own)
        for name, p in (("p10", 0.1), ("p50", 0.5)):
            assert abs(np.searchsorted(own, r[name], "right") - p * len(own)) <= max(1, 0.05 * p * len(own))
    assert out.count() == 8
    assert quantiles.group_percentiles(df.limit(0), "d", ["a"], {"p50": 0.5}).count() == 0


def disguise(text, rng):
    out = []
    for ch in text:
        options = [ch]
        if "!" <= ch <= "~":
            options.append(chr(ord(ch) + 0xFEE0))
        if ch == " ":
            options += [" ", " ", "　"]
        options += list(lookalike.LOOKALIKES.get(ch, ""))
        for latin, others in lookalike.LOOKALIKES.items():
            if ch in others:
                options += [latin, *others]
        out.append(rng.choice(options))
        if rng.random() < 0.1:
            out.append(rng.choice("​‍­⁠﻿"))
    return unicodedata.normalize(rng.choice(["NFC", "NFD"]), "".join(out))


LETTERS = "aceopxyABCEHKMOPTXnrtlмшбд ёйéüñ.,12²\nаеосрху"


@settings(max_examples=150, deadline=None)
@given(st.text(LETTERS, max_size=40), st.text(LETTERS, max_size=40), st.integers(0, 10**6))
def test_unified_texts_are_equal_exactly_if_they_look_alike(a, b, seed):
    unify = lookalike.Unifier({(97, 98): 5, (0x430, 0x431): 7})
    assert unify(a) == unify(disguise(a, random.Random(seed)))
    assert unify(unify(a)) == unify(a)
    look = lambda t: unicodedata.normalize("NFD", lookalike.strip_compat(t)).translate(lookalike._SKELETON)
    assert (look(a) == look(b)) == (unify(a) == unify(b))


def test_unifier_prefers_one_script():
    unify = lookalike.Unifier()
    assert unify("Thе rооf") == "The roof" and unify("сорт вcex") == "сорт всех" and unify("HAM and НАМ") == "HAM and HAM" and unify("мы НAM") == "мы НАМ"
    assert unify("m²") != unify("m2") and unify("café") != unify("cafe") and unify("a b") != unify("a  b") and unify("") == "" and unify("a\nb") != unify("a b")
    assert unify("x" * 100_000 + "а") == "x" * 100_000 + "a"


def test_ngram_scores_choose_the_path(spark):
    plain, latin = lookalike.Unifier(), lookalike.Unifier({(0, ord("a")): 50, (ord("a"), ord("c")): 50, (ord("c"), ord("e")): 50})
    russian = lookalike.train_unifier(spark.createDataFrame([("сорт всех сор " * 200,)], "t string"), "t")
    assert plain("the cop sees") == "the cop sees" == plain("the сор sees") and latin("мы асе") == "мы ace" and plain("мы асе") == "мы асе"
    assert russian("the cop sees") == russian("the сор sees") == "the сор sees" and russian("the copper helps") == "the copper helps"
    assert latin("мы ace") == latin("мы асе") != plain("мы асе")


@pytest.mark.parametrize("query", [queries.p10_found, queries.p10_classes])
def test_pairs_and_classes_search_by_counted_bigrams(spark, tmp_path, monkeypatch, query):
    data = [(1, "сорт всех сор " * 200), (2, "the cop sees"), (3, "the сор sees"), (4, None)]
    spark.createDataFrame(data, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    given, keys = [], lookalike.look_keys
    monkeypatch.setattr(lookalike, "look_keys", lambda df, i, c, unifier: given.append(unifier) or keys(df, i, c, unifier))
    out = query(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in out] == [(2, 3)] if query is queries.p10_found else len(out) == 2
    counts = lookalike.train_unifier(spark.createDataFrame(data, "doc_id bigint, text string"), "text").bigrams
    assert [u.bigrams for u in given] == [counts] and counts and given[0]("the cop sees") == "the сор sees"


def test_unified_forms_do_not_hang_on_the_line():
    scored = lookalike.Unifier({(0, 0x410): 10**6, (0x410, 0x436): 5, (0, 0x4AE): 9, (0x4AE, 0x436): 9})
    for unify in (lookalike.Unifier(), scored):
        assert unify("hello A中") == unify("hello А中") and unify("hello 中A") == unify("hello 中А") and unify("hello 中A") != unify("hello 中B")
        assert unify("Ужас") == unify("Үжас") != unify("ужас") and unify("Ӱж") == unify("Ү\u0308ж") != unify("Уж")


@settings(max_examples=150, deadline=None)
@given(st.text(LETTERS + "УҮӲ中あב", max_size=40), st.text(LETTERS + "УҮӲ中あב", max_size=40), st.integers(0, 10**6), st.dictionaries(st.tuples(st.sampled_from([0, *map(ord, "aceopxACEасеорАСЕУҮ")]), st.sampled_from(list(map(ord, "aceopxACEасеорАСЕУҮ")))), st.integers(1, 10**6)))
def test_no_bigrams_change_which_texts_look_alike(a, b, seed, bigrams):
    unify = lookalike.Unifier(bigrams)
    assert unify(a) == unify(disguise(a, random.Random(seed))) == unify(unify(a))
    look = lambda t: unicodedata.normalize("NFD", lookalike.strip_compat(t)).translate(lookalike._SKELETON)
    assert (look(a) == look(b)) == (unify(a) == unify(b))


def test_compatibility_is_a_parameter():
    assert lookalike.Unifier(compatibility="full")("ﬁn ｶ m²") == "fin カ m2" and lookalike.Unifier()("ﬁn ｶ m² Ａ") == "ﬁn ｶ m² A"
    with pytest.raises(ValueError, match="compatibility"):
        lookalike.Unifier(compatibility="some")


def brute_classes(data):
    unify, ids = lookalike.Unifier(), {}
    for i, t in {(i, t) for i, t in data if t is not None}:
        ids.setdefault(unify(t), []).append((i, t))
    return sorted((i, min(j for j, _ in own), n) for own in ids.values() for i, t in own if (n := sum(u != t for _, u in own)))


def test_copies_of_a_text_are_not_multiplied(spark):
    data = [(i, "one roof") for i in range(9000)] + [(9001, "оne roof"), (9002, "one\u00a0roof"), (9003, "two")]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    pairs = lookalike.lookalike_pairs(df, "doc_id", "text", chunk=700)
    assert set(map(tuple, pairs.collect())) == {(i, j) for i in range(9000) for j in (9001, 9002)} | {(9001, 9002)}
    assert rows(lookalike.lookalike_classes(df, "doc_id", "text"), "id", "class_id", "links") == sorted(brute_classes(data), key=str)


def test_lookalike_classes(spark):
    data = [(1, "one roof"), (2, "one roof"), (3, "оne roof"), (5, "one rooF"), (6, None), (7, ""), (8, "\u200b"), (9, "other"), (3, "оne roof")]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("links", F.lit(1))
    out = lookalike.lookalike_classes(df, "doc_id", "text")
    assert rows(out, "id", "class_id", "links") == sorted(brute_classes(data), key=str) == sorted([(1, 1, 1), (2, 1, 1), (3, 1, 2), (7, 7, 1), (8, 7, 1)], key=str)
    assert lookalike.lookalike_classes(df.limit(0), "doc_id", "text").count() == 0


def test_lookalike_pairs(spark):
    data = [(1, "one roof"), (2, "one roof"), (3, "оne roof"), (4, "one roof"), (5, "one rooF"), (6, None), (7, ""), (8, "​"), (9, "other"), (10, "one  roof"), (3, "оne roof")]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("c1", F.lit(1))
    out = lookalike.lookalike_pairs(df, "doc_id", "text")
    assert rows(out, "a", "b") == sorted([(1, 3), (2, 3), (1, 4), (2, 4), (3, 4), (7, 8)], key=str)
    assert lookalike.lookalike_pairs(df.limit(0), "doc_id", "text").count() == 0
    added = lookalike.unify_texts(df.withColumn("unified", F.lit(1)), "text", lookalike.train_unifier(df, "text"))
    assert added.columns[-1] == "unified_1" and added.filter("doc_id = 6").first()["unified_1"] is None


def test_bigram_counts_cover_all_texts(spark):
    df = spark.createDataFrame([("ab ab",), (None,), ("",), ("аб",)], "t string")
    counts = lookalike.train_unifier(df, "t").bigrams
    assert counts[ord("a"), ord("b")] == 2 and counts[0, ord("a")] == 2 and counts[ord("а"), ord("б")] == 1 and len(counts) == 4


def brute_words(text):
    """Words by characters: of the same look, in one case; a mark belongs to the letter before it."""
    look = unicodedata.normalize("NFD", lookalike.strip_compat(text)).translate(lookalike._SKELETON)
    words, word = [], ""
    for ch in look + " ":
        if ch.isalnum() or (word and "\u0300" <= ch <= "\u036f"):
            word += ch
        else:
            words += [word] if word else []
            word = ""
    return [w.casefold().translate(lookalike._FOLD_AFTER) for w in words]


def brute_leaks(docs, items, run):
    grams = {}
    for i, t in items:
        w = brute_words(t or "")
        for s in range(len(w) - run + 1):
            grams.setdefault(tuple(w[s : s + run]), set()).add(i)
    return {(i, d) for d, t in docs for w in [brute_words(t or "")] for s in range(len(w) - run + 1) for i in grams.get(tuple(w[s : s + run]), ())}


def planted(seed, n_items, n_docs):
    rng = random.Random(seed)
    vocab = ["the", "of", "a"] * 6 + [f"w{i}" for i in range(60)] + ["soufflé", "façade", "Straße", "naïve", "über", "cliché"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 40)))) for i in range(n_items)]
    docs = []
    for d in range(n_docs):
        words = [rng.choice(vocab) for _ in range(rng.randrange(0, 120))]
        if rng.random() < 0.5:
            part = rng.choice(items)[1].split()
            n = rng.randrange(8, 20)
            s = rng.randrange(max(1, len(part) - n + 1))
            at = rng.randrange(len(words) + 1)
            words[at:at] = [disguise(w.upper() if rng.random() < 0.2 else w, rng) for w in part[s : s + n]]
        docs.append((d, rng.choice([" ", "\n", ", "]).join(words)))
    return items, docs


def test_words_keep_marks_and_disregard_case():
    words = leakage.words_of
    assert words("un soufflé, STRASSE") == words("un souffl\u0435\u0301, Straße") and words("fa\u0441\u0327ade") == words("façade") != words("facade")
    assert words("na\u0456\u0308ve x_y 3.5%'s") == [*words("naïve"), "x", "y", "3", "5", "s"] and words("") == [] == words(" \u0301 ")


def test_leaks_match_brute_force(spark):
    items, docs = planted(9, 60, 300)
    items += [(100, items[3][1]), (101, None), (102, ""), (103, "the the " * 10), (5, items[8][1])]
    docs += [(1000, None), (1001, ""), (1002, " ".join(["the"] * 50)), (1003, ("x " * 30_000) + items[0][1] + " " + items[1][1]), (3, docs[3][1])]
    a = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(1)).repartition(3)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_leaks(docs, items, 12)
    assert len(want) > 40
    assert set(rows(leakage.leaked_items(a, "doc_id", "text", b, "item_id", "text"), "item_id", "doc_id")) == want
    assert set(rows(leakage.leaked_items(a, "doc_id", "text", b, "item_id", "text", shard_words=200, chars=5000), "item_id", "doc_id")) == want
    assert leakage.leaked_items(a.limit(0), "doc_id", "text", b, "item_id", "text").count() == 0
    assert leakage.leaked_items(a, "doc_id", "text", b.limit(0), "item_id", "text").count() == 0
    named = leakage.leaked_items(a, "doc_id", "text", b.select(F.concat(F.lit("i"), "item_id").alias("item_id"), "text"), "item_id", "text")
    assert set(rows(named, "item_id", "doc_id")) == {(f"i{i}", d) for i, d in want}


def test_retrieval_skips_and_misses_nothing():
    rng = np.random.default_rng(3)
    texts = [rng.choice(400, int(rng.integers(12, 60)), p=np.arange(400, 0, -1) / 80200).astype(np.uint64) for _ in range(300)]
    frequency = Counter(w for t in texts for w in set(t.tolist()))
    shard = leakage.Shard.build(list(range(300)), texts, frequency, 300, float(np.mean([len(t) for t in texts])), 12)
    again = leakage.Shard.unpack(shard.ids, shard.pack(), 12)
    words = np.concatenate([texts[i][:24] if rng.random() < 0.3 else rng.choice(500, 24).astype(np.uint64) for i in range(200)])
    starts = np.arange(0, len(words) - 23, 24)
    terms = again.numbers(words)
    got = set(zip(*map(np.ndarray.tolist, again.retrieve(terms, starts, starts + 24, chunk=37)), strict=True))
    impact = np.zeros((len(shard.vocabulary) + 1, shard.n), np.float32)
    impact[np.repeat(np.arange(len(shard.vocabulary)), np.diff(shard.first)), shard.item] = shard.impact
    scores = np.stack([impact[np.unique(terms[s : s + 24])].sum(0) for s in starts])
    sure, never = scores >= shard.threshold + 1e-4, scores < shard.threshold - 1e-4
    assert {(p, d) for p, d in zip(*np.nonzero(sure), strict=True)} <= got and not any(never[p, d] for p, d in got) and len(got) < 0.1 * scores.size


def test_index_stays_off_the_driver(spark, monkeypatch):
    from pyspark.serializers import CloudPickleSerializer

    sizes, plans = [], []
    for n in (240, 6000):
        items, docs = planted(4, n, 40)
        a, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
        made = DataFrame.mapInArrow
        monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, schema: (sizes.append(len(CloudPickleSerializer().dumps(f))), made(self, f, schema))[1])
        out = leakage.leaked_items(a, "doc_id", "text", b, "item_id", "text", shard_words=20_000)
        monkeypatch.setattr(DataFrame, "mapInArrow", made)
        plans.append(out._jdf.queryExecution().executedPlan().toString().count("MapInArrow"))
        assert set(rows(out, "item_id", "doc_id")) == brute_leaks(docs, items, 12)
    assert plans == [1, 1] and max(sizes) < min(sizes) + 10_000


def test_flow_routes_overlaps():
    plan = mixture.plan_mix({("a",): 100, ("a", "b"): 100, ("z",): 0}, {"a": (0.5, 1), "b": (0.5, 1), "z": (0.2, 3), "q": (0.1, 2)})
    assert abs(plan.total - 200) < 1 and abs(plan.flows["a", "b"]["b"] - 100) < 1 and plan.quotas.keys() == {"a", "b"}
    few = mixture.plan_mix({("a",): 1000, ("b",): 10}, {"a": (0.9, 1), "b": (0.1, 4)})
    assert abs(few.total - 400) < 1
    assert mixture.plan_mix({}, {"a": (1.0, 1)}).total == 0


def brute_cost(sizes, quotas, repeats):
    """Least cost of integer flows that fill the quotas, by trying all; None if none does."""
    states = {tuple(0 for _ in quotas): 0}
    for p, n in sizes.items():
        limit = max(repeats[s] for s in p)
        steps = []
        for amounts in itertools.product(*[range(n * repeats[s] + 1 if s in p else 1) for s in quotas]):
            used = sum(amounts)
            if used <= n * limit:
                steps.append((amounts, sum(r * max(0, min(used - r * n, n)) for r in range(limit))))
        after = {}
        for got, cost in states.items():
            for amounts, more in steps:
                total = tuple(map(sum, zip(got, amounts, strict=True)))
                if all(t <= q for t, q in zip(total, quotas.values(), strict=True)):
                    after[total] = min(after.get(total, 10**9), cost + more)
        states = after
    return states.get(tuple(quotas.values()))


@pytest.mark.parametrize("seed", range(12))
def test_flow_is_optimal(seed):
    rng = random.Random(seed)
    sources = ["a", "b", "c"]
    repeats = {s: rng.randrange(1, 4) for s in sources}
    sizes = {p: rng.randrange(1, 4) for p in [("a",), ("b", "c"), ("a", "b"), ("c",)] if rng.random() < 0.9}
    quotas = {s: rng.randrange(1, 5) for s in sources}
    network = mixture.Network(sizes, {s: q / sum(quotas.values()) for s, q in quotas.items()}, repeats, sum(quotas.values()))
    sent, want = network.send(), brute_cost(sizes, quotas, repeats)
    assert (want is None) == (sent < sum(quotas.values()) - 1e-6)
    if want is not None:
        assert abs(network.cost() - want) < 1e-6
    live = {s: quotas[s] for s in sources if any(s in p for p in sizes)}
    shares = {s: q / sum(live.values()) for s, q in live.items()}
    most = mixture.largest_total(sizes, shares, repeats)
    assert mixture.Network(sizes, shares, repeats, most).send() >= most - 1e-3 and mixture.Network(sizes, shares, repeats, most * 1.001 + 0.01).send() < most * 1.001 + 0.009
    assert all(most * sum(shares[s] for s in g) <= sum(n * min(max(repeats[s] for s in p), sum(repeats[s] for s in p if s in g)) for p, n in sizes.items()) + 1e-3 for k in range(1, 4) for g in itertools.combinations(live, k))


def test_flow_of_many_patterns_is_quick():
    rng = random.Random(0)
    sources = [f"s{i}" for i in range(24)]
    sizes = {tuple(sorted(rng.sample(sources, rng.randrange(1, 6)))): rng.randrange(1, 10**9) for _ in range(4000)}
    started = time.time()
    plan = mixture.plan_mix(sizes, {s: (1 / 24, 4) for s in sources})
    assert time.time() - started < 60 and all(abs(sum(f.get(s, 0) for f in plan.flows.values()) - q) < 1e-3 * q for s, q in plan.quotas.items())


def test_rare_patterns_stay_drawable(spark):
    docs = [(n, f"text {n} " * (1 + n % 5), s) for n in range(300) for s in ("a", "b", "c")[: 1 + n % 3]]
    a = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 2)], "source string, target_share double, max_repeats int")
    own = {"a": 2100, "b": 1400, "c": 700}
    for most in (1, 2, 10):
        got = {r["source"]: r for r in mixture.draw_mix(a, t, "doc_id", "text", "source", vocabulary=VOCABULARY, most_patterns=most)[1].collect()}
        assert all(abs(got[s]["actual_share"] - x) < 0.03 and got[s]["available_tokens"] == own[s] for s, x in (("a", 0.5), ("b", 0.3), ("c", 0.2)))


def test_mix_reaches_its_shares(spark):
    rng = random.Random(6)
    words = ["roof", "pays", "the", "quarter", "lends", "some", "valve"]
    docs = [(n, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 60))), rng.choice(["big", "big", "big", "big", "small", "none", None])) for n in range(1500)]
    docs += [(5000 + n, docs[n][1], "copy") for n in range(300)] + [(9000, None, "big"), (9001, "", "big"), (9002, "twice", "big"), (9003, "twice", "big")]
    a = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumn("tokens", F.lit(1))
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 3), ("copy", 0.1, 2), ("absent", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mix, report = mixture.draw_mix(a, t, "doc_id", "text", "source", vocabulary=VOCABULARY)
    got = {r["source"]: r for r in report.collect()}
    assert got["absent"]["drawn_tokens"] == 0 and got.keys() == {"big", "small", "copy", "absent"}
    for s, share in (("big", 5 / 9), ("small", 3 / 9), ("copy", 1 / 9)):
        assert abs(got[s]["actual_share"] - share) < 0.015 and got[s]["reachable_share"] == pytest.approx(share) and got[s]["target_share"] == pytest.approx(share * 0.9)
    drawn = mix.collect()
    source_of = {d: s for d, _, s in docs}
    caps = {"big": 1, "small": 3, "copy": 2}
    assert all(source_of[r["id"]] == r["source"] and 1 <= r["repeats"] <= caps[r["source"]] for r in drawn)
    assert max(Counter((r["id"], r["source"]) for r in drawn).values()) == 1
    small = sum(r["tokens"] * r["repeats"] for r in drawn if r["source"] == "small")
    assert small == got["small"]["drawn_tokens"] and got["small"]["most_repeats"] <= 3
    assert sorted(map(tuple, mixture.draw_mix(a, t, "doc_id", "text", "source", vocabulary=VOCABULARY)[0].collect())) == sorted(map(tuple, drawn))
    limited = mixture.draw_mix(a, t, "doc_id", "text", "source", total_tokens=2000, vocabulary=VOCABULARY)[1].agg(F.sum("drawn_tokens")).first()[0]
    assert abs(limited - 2000) < 400
    assert mixture.draw_mix(a.limit(0), t, "doc_id", "text", "source", vocabulary=VOCABULARY)[0].count() == 0
