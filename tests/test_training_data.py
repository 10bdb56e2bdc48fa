"""Spikes, history, as-known attributes, trailing totals and snapshot differences against literals and brute force."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.common import checkpointed, fresh, latest_rows
from tidemark.operators.history import version_history
from tidemark.operators.known_asof import attach_known
from tidemark.operators.snapshot_diff import snapshot_diff
from tidemark.operators.spikes import Field, Settings, forest_scores, implausible_readings, mix
from tidemark.operators.trailing import trailing_totals

D = dt.date


def day(n):
    return D(2023, 1, 1) + dt.timedelta(days=n)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_latest_rows_breaks_ties_and_keeps_nulls(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None), ("a", 2, None), ("b", None, 1.0), ("b", None, 3.0), (None, 1, 2.0)], "k string, at int, v double")
    assert rows(latest_rows(df, ["k"], ["at"], ["v"]), "k", "v") == sorted([("a", None), ("b", 3.0), (None, 2.0)], key=str)
    assert latest_rows(df.limit(0), ["k"], ["at"], ["v"]).count() == 0
    with pytest.raises(ValueError, match="lacks"):
        latest_rows(df, ["nope"], ["at"], ["v"])


def test_versions_by_bitmaps(spark):
    data = [
        ("A", day(0), day(0), True, "x"), ("A", day(5), day(5), True, "x"), ("A", day(9), day(9), False, "x"), ("A", day(9), day(12), True, None), ("A", day(20), day(20), True, None), ("A", day(30), day(30), True, "x"),
        ("A", day(30), day(30), True, "x"), ("B", day(1), day(1), None, None), (None, day(1), day(1), True, "x"), ("C", None, day(1), True, "x"),
    ]
    df = spark.createDataFrame(data, "ticker string, eff date, at date, member boolean, sector string")
    out = version_history(df, "ticker", "eff", ["member", "sector"], "at")
    assert rows(out, "ticker", "member", "sector", "valid_from", "valid_to") == sorted(
        [("A", True, "x", day(0), day(9)), ("A", True, None, day(9), day(30)), ("A", True, "x", day(30), None), ("B", None, None, day(1), None)], key=str
    )
    assert version_history(df.limit(0), "ticker", "eff", ["member", "sector"], "at").count() == 0


def test_versions_over_many_words_match_brute_force(spark):
    rng = random.Random(3)
    data = [("T", day(3 * i), day(3 * i), rng.random() < 0.5, rng.choice(["x", "x", "y", None])) for i in range(300)]
    data += [("Z", day(i), day(i), True, "same") for i in range(200)]
    df = spark.createDataFrame(data, "ticker string, eff date, at date, member boolean, sector string")
    want, last = [], {}
    for t, d, _, m, s in data:
        if t not in last or last[t] != (m, s):
            want.append((t, m, s, d))
        last[t] = (m, s)
    assert rows(version_history(df, "ticker", "eff", ["member", "sector"], "at"), "ticker", "member", "sector", "valid_from") == sorted(want, key=str)


def test_attach_known_matches_brute_force(spark):
    rng = random.Random(5)
    records = [(rng.choice("ABC"), rng.choice("fg"), day(rng.randrange(60)), day(rng.randrange(80)) if rng.random() < 0.9 else None, n + 1) for n in range(120)]
    events = [(e, day(n), f"x{n % 7}") for e in "ABCD" for n in range(0, 90, 2)] + [(None, day(3), "n"), ("A", None, "n")]
    r = spark.createDataFrame([*records, *records[:9]], "entity string, feature string, eff date, av date, id bigint")
    e = spark.createDataFrame(events, "entity string, ts date, ticker string")
    known = F.when(F.col("av").isNotNull(), F.greatest("eff", "av"))
    out = attach_known(e, r, ["eff", "av"], "id", known, F.col("eff"), F.col("ticker"))
    want = []
    for en, ts, tk in events:
        for f in "fg":
            own = [x for x in records if x[0] == en and x[1] == f and ts is not None and x[2] <= ts]
            key = lambda x: (x[2], x[3] or D(1, 1, 1), x[4])
            seen = [x for x in own if x[3] is not None and x[3] <= ts]
            if own:
                want.append((en, ts, tk, f, max(seen, key=key)[4] if seen else None, max(own, key=key)[4]))
    assert rows(out, "entity", "ts", "ticker", "feature", "known", "plain") == sorted(want, key=str)
    differing = attach_known(e, r, ["eff", "av"], "id", known, F.col("eff"), F.col("ticker"), differing_only=True)
    assert rows(differing, "entity", "ts", "ticker", "feature", "known", "plain") == sorted([w for w in want if w[4] != w[5]], key=str)
    clash = e.withColumns({c: F.lit(1) for c in ("flag", "version", "salt", "step", "row", "known", "feature")})
    again = attach_known(clash, r, ["eff", "av"], "id", known, F.col("eff"), F.col("ticker"))
    assert rows(again, "entity", "ts", "ticker", "feature_1", "known_1", "plain") == sorted(want, key=str)
    assert attach_known(e.limit(0), r, ["eff", "av"], "id", known, F.col("eff"), F.col("ticker")).count() == 0
    assert attach_known(e, r.limit(0), ["eff", "av"], "id", known, F.col("eff"), F.col("ticker")).count() == 0


def test_trailing_totals_match_brute_force(spark):
    rng = random.Random(7)
    data = [(t, day(n), rng.random() < 0.8, rng.randrange(100), rng.choice([None, rng.random()])) for t in "AB" for n in range(0, 200) if rng.random() < 0.5]
    data += [("C", day(5), False, 1, 1.0), (None, day(1), True, 1, 1.0), ("A", None, True, 1, 1.0)]
    df = spark.createDataFrame(data, "ticker string, date date, act boolean, v bigint, x double").withColumn("e", F.lit("clash"))
    out = trailing_totals(df, "ticker", "date", "act", {"v": "v", "x": "x"})
    got = {(r["ticker"], r["date"]): r for r in out.collect()}
    want = {}
    for t in "AB":
        own = [x for x in data if x[0] == t and x[1] is not None]
        active = [x[1] for x in own if x[2]]
        for i in range((max(active) - min(active)).days + 1):
            d = min(active) + dt.timedelta(days=i)
            want[t, d] = [[x for x in own if d - dt.timedelta(days=n) < x[1] <= d] for n in (7, 30)]
    assert got.keys() == want.keys()
    for key, parts in want.items():
        for n, part in zip((7, 30), parts):
            xs = [x[4] for x in part if x[4] is not None]
            r = got[key]
            assert r[f"v_sum_{n}d"] == sum(x[3] for x in part) and r[f"active_days_{n}d"] == sum(x[2] for x in part) and r[f"x_days_{n}d"] == len(xs)
            assert (r[f"x_avg_{n}d"] is None) == (not xs) and (not xs or math.isclose(r[f"x_avg_{n}d"], sum(xs) / len(xs)))
    assert trailing_totals(df.limit(0), "ticker", "date", "act", {"v": "v"}).count() == 0


def test_snapshot_diff(spark):
    data = [
        (day(0), "A", "x", 1), (day(0), "B", None, 1), (day(0), "C", "x", 1), (day(0), "C", "x", 1), (day(7), "a", " X", 2), (day(7), "B", "y", 2), (day(7), "D", "z", 2), (day(7), "Q", "old", 1), (day(9), "A", None, 1),
        (day(9), None, "x", 1), (None, "A", "x", 1),
    ]
    df = spark.createDataFrame(data, "as_of date, ticker string, sector string, at int").withColumn("k", F.lit(1))
    out = snapshot_diff(df, "as_of", {"ticker": F.upper("ticker")}, [F.lower(F.trim("sector"))], "at")
    assert rows(out, "as_of", "ticker", "change") == sorted(
        [(day(7), "C", "removed"), (day(7), "B", "changed"), (day(7), "D", "added"), (day(9), "A", "changed"), (day(9), "B", "removed"), (day(9), "D", "removed")], key=str
    )
    assert snapshot_diff(df.limit(0), "as_of", {"ticker": F.col("ticker")}, [F.col("sector")], "at").count() == 0
    assert rows(snapshot_diff(df.filter("as_of is not null"), "as_of", {"ticker": F.upper("ticker")}, [F.lower(F.trim("sector"))]).filter("ticker = 'Q'"), "change") == [("added",), ("removed",)]


def series(ticker, seed, n=200):
    rng = np.random.default_rng(seed)
    price = np.round(100 * np.exp(np.cumsum(rng.normal(0, 0.012, n))), 4)
    volume = np.round(1e6 * np.exp(rng.normal(0, 0.3, n)))
    return [[ticker, day(i), float(price[i]), float(volume[i])] for i in range(n)]


def test_spikes_flat_lines_and_limits(spark):
    a, b = series("A", 1), series("B", 2)
    a[50][2] *= 100
    for i in (90, 91, 92):
        a[i][2] *= 0.2
    for i in range(120, 200):
        a[i][2] *= 1.6  # a lasting move
    a[30][2] = -1.0
    a[31][2] = float("nan")
    a[32][2] = None
    for i in range(140, 148):
        b[i][2] = b[140][2]
    b[143][2] = None  # a null doesn't end the run
    for i in range(160, 165):
        b[i][2] = b[160][2]  # too short
    b[70][3] *= 300
    b[71][3] = -5.0
    b[72][3] *= 5  # a busy day
    df = spark.createDataFrame([*a, *b, [None, day(1), 1.0, 1.0], ["C", day(1), float("inf"), None]], "ticker string, date date, close double, volume double").withColumn("s", F.lit(1))
    fields = [Field("close"), Field("volume", positive=False, spread=True, factor=10.0)]
    scored = implausible_readings(df, "ticker", "date", fields)
    assert scored.count() == 2 * 400 + 1 - 2 and scored.filter("score is null").count() == 0
    want = [("A", 50, "close", "spike"), *(("A", i, "close", "spike") for i in (90, 91, 92)), ("A", 30, "close", "impossible"), ("A", 31, "close", "impossible"), ("C", 1, "close", "impossible")]
    want += [*(("B", i, "close", "flat") for i in (141, 142, 144, 145, 146, 147)), ("B", 70, "volume", "spike"), ("B", 71, "volume", "impossible")]
    flagged = implausible_readings(df, "ticker", "date", fields, flagged_only=True)
    assert rows(flagged, "source", "day", "field", "reason") == sorted([(t, day(i), f, r) for t, i, f, r in want], key=str)
    assert implausible_readings(df.limit(0), "ticker", "date", fields).count() == 0


@pytest.mark.parametrize("sample", [256, 40])
def test_forest_scores_do_not_depend_on_batching(sample):
    rng = np.random.default_rng(0)
    group = np.repeat(np.arange(4), [150, 5, 1, 90])
    x = rng.normal(size=(5, len(group))).astype(np.float32)
    x[:, 20] = 15
    identity = mix(np.arange(4, dtype=np.uint64))
    s = Settings(sample=sample)
    whole = forest_scores(x, group, identity, s)
    for g in range(4):
        own = group == g
        assert np.allclose(forest_scores(x[:, own], np.zeros(own.sum(), int), identity[g : g + 1], s), whole[own])
    assert whole[:150].argmax() == 20 and whole[20] > 0.65 and np.median(whole[:150]) < 0.5


def test_the_forest_decides_which_readings_are_candidates(spark):
    a = series("A", 3)
    for i in (50, 120, 121):
        a[i][2] *= 3
    df = spark.createDataFrame(a, "ticker string, date date, close double, volume double")
    found = {gate: rows(implausible_readings(df, "ticker", "date", [Field("close")], Settings(gate=gate), flagged_only=True), "day") for gate in (-1e9, 2.0, 1e9)}
    assert found[2.0] == sorted([(day(i),) for i in (50, 120, 121)], key=str) and found[-1e9] == found[1e9] == []
    scores = {r["day"]: r["score"] for r in implausible_readings(df, "ticker", "date", [Field("close")]).collect()}
    assert min(scores[day(i)] for i in (50, 120, 121)) > sorted(scores.values())[-20]


def test_sources_of_few_or_constant_readings(spark):
    data = [("one", day(0), 5.0), ("two", day(0), 5.0), ("two", day(1), 50.0)] + [("same", day(i), 7.0) for i in range(5)] + [("edge", day(i), 900.0 if i in (0, 39) else 10.0 + i % 3) for i in range(40)]
    df = spark.createDataFrame(data, "ticker string, date date, close double")
    assert rows(implausible_readings(df, "ticker", "date", [Field("close")], flagged_only=True), "source") == []  # no level on both sides
