"""Walk-forward models: ridge from prefix-summed Gram matrices, boosted trees, nested selection and ablation."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.common import require_columns
from tidemark.operators.grids import BINS, GridTrees, bins_of, grid_folds
from tidemark.operators.metrics import strict_mean_rank_ic


@dataclass(frozen=True)
class Span:
    """Dates by position: fit on [fit_from, fit_to), predict on [from_, to)."""

    fold: int
    fit_from: int
    fit_to: int
    from_: int
    to: int


def folds(n: int, train: int, test: int, embargo: int, expanding: bool = True) -> list[Span]:
    """Walk-forward folds over ``n`` dates; ``embargo`` dates lie between fit and prediction."""
    if min(train, test) < 1 or embargo < 0:
        raise ValueError("train and test must be positive, embargo not negative")
    out, at = [], train + embargo
    while at < n:
        end = at - embargo
        out.append(Span(len(out), 0 if expanding else max(0, end - train), end, at, min(at + test, n)))
        at += test
    return out


def date_axis(frame: DataFrame) -> list:
    """The distinct dates in order. One value per trading day, so it is the calendar that bounds what the driver holds."""
    return [r["date"] for r in frame.select(F.col("date").cast("date").alias("date")).distinct().filter("date is not null").orderBy("date").collect()]


class Grams:
    """Per-date sums of products of [x with null as 0, null mask, 1, y], prefix-summed over dates, on the driver.

    Any training window, any imputation by feature medians and any ridge penalty follow from differences of two prefixes, so the data are read once for all
    folds and candidates. Size: dates times (2p + 2) squared.
    """

    def __init__(self, frame: DataFrame, features: Sequence[str], target: str, dates: list):
        self.p, self.n_dates = len(features), len(dates)
        p, size = self.p, 2 * self.p + 2

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[object, np.ndarray] = {}
            for batch in batches:
                days = batch.column(0).to_pylist()
                cols = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False).astype(float) for i in range(p + 1)], 1)
                x, y = cols[:, :p], cols[:, p]
                miss = np.isnan(x)
                z = np.column_stack([np.where(miss, 0.0, x), miss, np.ones(len(y)), y])
                codes, which = np.unique(np.array(days, "datetime64[D]"), return_inverse=True)
                for k, day in enumerate(codes):
                    own = z[which == k]
                    held[day] = held.get(day, 0) + own.T @ own
            if held:
                days = list(held)
                yield pa.RecordBatch.from_arrays([pa.array([d.astype(object) for d in days], pa.date32()), pa.array([held[d].ravel().tolist() for d in days], pa.list_(pa.float64()))], ["date", "gram"])

        def add(table: pa.Table) -> pa.Table:
            total = np.sum([np.array(g) for g in table.column("gram").to_pylist()], 0)
            return pa.table([table.column("date").slice(0, 1), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["date", "gram"])

        rows = frame.select(F.col("date").cast("date").alias("date"), *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)], F.col(target).cast("double").alias("y")).filter("y is not null and not isnan(y) and date is not null")
        schema = "date date, gram array<double>"
        at = {d: i for i, d in enumerate(dates)}
        per_date = np.zeros((len(dates), size, size))
        for r in rows.mapInArrow(partial, schema).groupBy("date").applyInArrow(add, schema).collect():
            per_date[at[r["date"]]] = np.array(r["gram"]).reshape(size, size)
        self.prefix = np.concatenate([np.zeros((1, size, size)), np.cumsum(per_date, 0)])

    def rows(self, lo: int, hi: int) -> int:
        """Labelled rows in the window."""
        return int(round(self.window(lo, hi)[2 * self.p, 2 * self.p]))

    def window(self, lo: int, hi: int) -> np.ndarray:
        """Sums over dates [lo, hi)."""
        return self.prefix[hi] - self.prefix[lo]

    def ridge(self, lo: int, hi: int, medians: Sequence[float | None], alpha: float, use: Sequence[int] | None = None) -> tuple[float, list[float]]:
        """(intercept, weights) on imputed raw features: standardised with population deviations, penalised by ``alpha``. Features without any value get weight 0."""
        p, g = self.p, self.window(lo, hi)
        use = [i for i in (range(p) if use is None else use) if medians[i] is not None]
        t = np.zeros((2 * p + 2, len(use) + 2))
        for k, i in enumerate(use):
            t[i, k], t[p + i, k] = 1.0, medians[i]
        t[2 * p, -2] = t[2 * p + 1, -1] = 1.0
        m = t.T @ g @ t
        n = m[-2, -2]
        mean, ybar = m[-2, :-2] / n, m[-2, -1] / n
        cov = m[:-2, :-2] - n * np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 0) / n)
        sd = np.where(sd > 1e-14 * np.maximum(1, np.abs(mean)), sd, 1.0)
        coef = np.linalg.solve(cov / np.outer(sd, sd) + alpha * np.eye(len(use)), (m[:-2, -1] - n * mean * ybar) / sd) / sd if use else np.zeros(0)
        weights = [0.0] * p
        for k, i in enumerate(use):
            weights[i] = float(coef[k])
        return float(ybar - coef @ mean), weights


#: Values that a median's sketch holds before it approximates; beyond them the rank is off by some 0.03 % of their number.
SKETCH = 16_384


def _sketch_median(sketch: F.Column) -> F.Column:
    """Mean of the two middle values."""
    halves = F.kll_sketch_get_quantile_double(sketch, F.lit(0.5)) + F.kll_sketch_get_quantile_double(sketch, F.lit(0.5 + 1e-6))
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, halves / 2)


def window_medians(frame: DataFrame, features: Sequence[str], target: str, dates: list, windows: Sequence[tuple[int, int]], sketch: int | None = SKETCH) -> dict[tuple[int, int], list[float | None]]:
    """Median of every feature over the labelled rows of every date window; None without a value.

    The windows' ends cut the calendar into blocks. Each row is added once, to its block's sketch, where it lies; then, per feature, the blocks' sketches are merged
    along the calendar, as prefixes for windows from the first date on and as sliding frames for the others, so neither rows nor sketches are multiplied by windows.
    Up to ``sketch`` values a median is exact. With ``sketch=None`` all are exact, but each row takes part in every window that holds it.
    """
    listed = sorted(set(windows))
    if not listed:
        return {}
    none: list[float | None] = [None] * len(features)
    if sketch is None:
        rows = _labelled(frame, features, target)
        within = frame.sparkSession.createDataFrame([(k, dates[i]) for k, (lo, hi) in enumerate(listed) for i in range(lo, hi)], "window int, date date")
        got = rows.join(within, "date").groupBy("window").agg(*[F.percentile(f"f{i}", F.lit(0.5)).alias(f"f{i}") for i in range(len(features))]).collect()
        found = {r["window"]: [r[f"f{i}"] for i in range(len(features))] for r in got}
        return {w: found.get(k, none) for k, w in enumerate(listed)}
    return _window_values(frame, features, target, dates, listed, sketch, _sketch_median)


def _labelled(frame: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(date, f0, f1, ...) of the labelled rows, NaN as null."""
    clean = [F.when(~F.isnan(f), F.col(f)).cast("double") for f in features]
    return frame.filter(F.col(target).isNotNull() & ~F.isnan(target)).select(F.col("date").cast("date").alias("date"), *[c.alias(f"f{i}") for i, c in enumerate(clean)])


def _window_values(frame: DataFrame, features: Sequence[str], target: str, dates: list, listed: Sequence[tuple[int, int]], sketch: int, read: Callable[[F.Column], F.Column]) -> dict[tuple[int, int], list]:
    """What ``read`` takes from the sketch of every window and feature; None without a value."""
    spark = frame.sparkSession
    cuts = sorted({at for w in listed for at in w})
    blocks = spark.createDataFrame([(dates[i], hi) for lo, hi in zip(cuts, cuts[1:], strict=False) for i in range(lo, hi)], "date date, until int")
    made = _labelled(frame, features, target).join(blocks, "date").groupBy("until").agg(*[F.kll_sketch_agg_double(f"f{i}", F.lit(sketch)).alias(f"f{i}") for i in range(len(features))])
    every = spark.createDataFrame([(hi,) for hi in cuts[1:]], "until int").join(made, "until", "left")  # a block may hold no row
    long = every.select("until", F.posexplode(F.array(*[f"f{i}" for i in range(len(features))])).alias("feature", "block"))
    ordered = Window.partitionBy("feature").orderBy("until")
    lengths = sorted({hi - lo for lo, hi in listed if lo > cuts[0]})
    merged = lambda frame: F.kll_merge_agg_double("block", F.lit(sketch)).over(frame)
    along = long.select("feature", "until", merged(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("all"), *[merged(ordered.rangeBetween(1 - n, 0)).alias(f"last{n}") for n in lengths])
    kinds = ["all", *(f"last{n}" for n in lengths)]
    got = along.select("feature", "until", *[read(F.col(k)).alias(k) for k in kinds]).collect()
    out: dict[tuple[int, int], list] = {w: [None] * len(features) for w in listed}
    for r in got:
        for lo, hi in listed:
            if hi == r["until"]:
                out[lo, hi][r["feature"]] = r["all" if lo == cuts[0] else f"last{hi - lo}"]
    return out


def score_rows(frame: DataFrame, features: Sequence[str], models: list[tuple], keys: str, keep: Sequence[str]) -> DataFrame:
    """Linear predictions: ``models`` are (date, key values..., intercept, weights, medians); each row is scored by each model of its date."""
    spark = frame.sparkSession
    table = spark.createDataFrame(models, f"date date, {keys}, intercept double, weights array<double>, medians array<double>")
    names = [k.split()[0] for k in keys.split(", ")]
    value = F.col("intercept")
    for i, f in enumerate(features):
        x = F.coalesce(F.when(~F.isnan(f), F.col(f).cast("double")), F.element_at("medians", i + 1), F.lit(0.0))
        value = value + F.element_at("weights", i + 1) * x
    return frame.withColumn("date", F.col("date").cast("date")).join(table, "date").select(*keep, value.alias("prediction"), *names)


def walk_forward(frame: DataFrame, features: Sequence[str], target: str = "target", model: str = "ridge", train: int = 504, test: int = 21, embargo: int = 5, expanding: bool = True, parameters: Mapping[str, float] | None = None) -> DataFrame:
    """Out-of-sample predictions (date, ticker, target, prediction, fold), each fold fitted on earlier dates only.

    ``ridge`` (parameter alpha, default 10): median imputation and standardisation per fold. ``gbt``: boosted trees (max_iter, max_depth, step_size, subsample, feature_subset, seed),
    medians imputed: on one or two features all trees of all folds from the sums of their grids of bins (``grids``), on more by Spark ML. Folds without labelled training rows or without rows to predict are skipped but counted.
    """
    features = list(features)
    require_columns(frame, ["date", "ticker", target, *features], "frame")
    dates = date_axis(frame)
    spans = folds(len(dates), train, test, embargo, expanding)
    options = dict(parameters or {})
    keep = ["date", "ticker", target]
    schema = f"date date, ticker string, {target} double, prediction double, fold int"
    if model == "ridge":
        alpha = options.pop("alpha", 10.0)
        if options:
            raise ValueError(f"unknown ridge parameters: {sorted(options)}")
        grams = Grams(frame, features, target, dates)
        spans = [s for s in spans if grams.rows(s.fit_from, s.fit_to)]
        medians = window_medians(frame, features, target, dates, [(s.fit_from, s.fit_to) for s in spans])
        models = []
        for s in spans:
            mid = medians[s.fit_from, s.fit_to]
            b, w = grams.ridge(s.fit_from, s.fit_to, mid, alpha)
            models += [(dates[i], s.fold, b, w, mid) for i in range(s.from_, s.to)]
        return score_rows(frame, features, models, "fold int", keep) if models else frame.sparkSession.createDataFrame([], schema)
    if model == "gbt":
        return _walk_forward_trees(frame, features, target, dates, spans, options, schema)
    raise ValueError("the model is 'ridge' or 'gbt'")


def _walk_forward_trees(frame: DataFrame, features: list[str], target: str, dates: list, spans: list[Span], options: dict, schema: str) -> DataFrame:
    known = {"max_iter": 300, "max_depth": 3, "step_size": 0.03, "subsample": 0.8, "feature_subset": "0.8", "seed": 7}
    if unknown := set(options) - set(known):
        raise ValueError(f"unknown tree parameters: {sorted(unknown)}")
    o = known | options
    return (_grid_trees if 1 <= len(features) <= GRID else _ml_trees)(frame, features, target, dates, spans, o, schema)


#: Features up to which trees are grown on a grid of their bins.
GRID = 2


def _grid_trees(frame: DataFrame, features: list[str], target: str, dates: list, spans: list[Span], o: dict, schema: str) -> DataFrame:
    """Boosted trees of all spans from three readings of the frame: the windows' quantiles, the grids' sums, the rows to predict."""
    spark, windows = frame.sparkSession, sorted({(s.fit_from, s.fit_to) for s in spans})
    if not windows:
        return spark.createDataFrame([], schema)
    levels = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    read = lambda s: F.when(F.kll_sketch_get_n_double(s) > 0, F.concat(F.array(_sketch_median(s)), F.kll_sketch_get_quantile_double(s, levels)))
    cut = {w: [None if v is None else (v[0], np.unique(v[1:])) for v in per] for w, per in _window_values(frame, features, target, dates, windows, SKETCH, read).items()}
    windows = [w for w in windows if any(c is not None for c in cut[w])]
    cuts, axis = [cut[w] for w in windows], np.array(dates, "datetime64[D]")
    trees = GridTrees(len(features), o["max_iter"], o["max_depth"], o["step_size"], o["subsample"], str(o["feature_subset"]), o["seed"])
    values = [F.when(~F.isnan(f), F.col(f)).cast("double").alias(f"f{i}") for i, f in enumerate(features)]
    day = F.col("date").cast("date").alias("date")
    group = F.pmod(F.xxhash64(day, F.col("ticker").cast("string"), F.lit(o["seed"])), F.lit(trees.groups)).cast("int").alias("g")
    rows = frame.filter(F.col(target).isNotNull() & ~F.isnan(target)).select(day, F.col(target).cast("double").alias("y"), group, *values).filter("date is not null")
    grids = grid_folds(rows, axis, windows, cuts, trees)

    number = {w: k for k, w in enumerate(windows)}
    asked = [(dates[i], s.fold, number[s.fit_from, s.fit_to]) for s in spans if number.get((s.fit_from, s.fit_to)) in grids for i in range(s.from_, s.to)]
    if not asked:
        return spark.createDataFrame([], schema)
    wanted = frame.select(day, "ticker", F.col(target).cast("double").alias(target), *values).join(spark.createDataFrame(asked, "date date, fold int, w_ int"), "date")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = batch.column("w_").to_numpy()
            x = [batch.column(f"f{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))]
            out = np.zeros(len(which))
            for w in np.unique(which):
                own = which == w
                out[own] = grids[w][bins_of([c[own] for c in x], cuts[w])]
            yield pa.RecordBatch.from_arrays([batch.column("date"), batch.column("ticker"), batch.column(target), pa.array(out), batch.column("fold")], ["date", "ticker", target, "prediction", "fold"])

    return wanted.mapInArrow(predict, wanted.select("date", "ticker", target, F.lit(0.0).alias("prediction"), "fold").schema)


def _ml_trees(frame: DataFrame, features: list[str], target: str, dates: list, spans: list[Span], o: dict, schema: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    day = F.col("date").cast("date")
    out = frame.sparkSession.createDataFrame([], schema)
    medians = window_medians(frame, features, target, dates, [(s.fit_from, s.fit_to) for s in spans])

    def scored(s: Span) -> DataFrame | None:
        mid = medians[s.fit_from, s.fit_to]
        used = [f for f, m in zip(features, mid, strict=True) if m is not None]
        fill = {f: F.coalesce(F.when(~F.isnan(f), F.col(f).cast("double")), F.lit(m)) for f, m in zip(features, mid, strict=True) if m is not None}
        if not used:
            return None
        rows = VectorAssembler(inputCols=used, outputCol="gbt_features").transform(frame.withColumns(fill))
        fit = rows.filter((day >= F.lit(dates[s.fit_from])) & (day < F.lit(dates[s.fit_to]))).filter(F.col(target).isNotNull() & ~F.isnan(target))
        gbt = GBTRegressor(featuresCol="gbt_features", labelCol=target, maxIter=o["max_iter"], maxDepth=o["max_depth"], stepSize=o["step_size"], subsamplingRate=o["subsample"], featureSubsetStrategy=str(o["feature_subset"]), seed=o["seed"])
        predicted = gbt.fit(fit).transform(rows.filter((day >= F.lit(dates[s.from_])) & (day <= F.lit(dates[s.to - 1]))))
        return predicted.select(day.alias("date"), "ticker", F.col(target).cast("double").alias(target), "prediction", F.lit(s.fold).alias("fold"))

    with ThreadPool(4) as pool:  # a tree is many short jobs; folds don't depend on each other
        done = pool.map(inheritable_thread_target(frame.sparkSession)(scored), spans, 1)
    for one in done:
        out = out if one is None else out.unionByName(one)
    return out


Candidate = float | tuple[str, Mapping[str, float]]


def _chosen_model(candidate: Candidate) -> tuple[str, dict[str, float]]:
    model, options = ("ridge", {"alpha": candidate}) if isinstance(candidate, int | float) else (candidate[0], dict(candidate[1]))
    if model not in ("ridge", "gbt"):
        raise ValueError("the model is 'ridge' or 'gbt'")
    return model, options


def _predictions(frame: DataFrame, features: list[str], target: str, dates: list, fits: Sequence[tuple[Span, Candidate, tuple]], keys: str, use: Sequence[int] | None = None) -> DataFrame:
    """(date, ticker, target, prediction, keys...) of many fits, each a span, a candidate and its values for ``keys``; ridge fits are one plan, of shared Gram matrices."""
    spark = frame.sparkSession
    names = [k.split()[0] for k in keys.split(", ")]
    out = spark.createDataFrame([], f"date date, ticker string, `{target}` double, prediction double, {keys}")
    linear = [(s, _chosen_model(c)[1], k) for s, c, k in fits if _chosen_model(c)[0] == "ridge"]
    trees: dict[tuple, list[tuple[Span, tuple]]] = {}
    for s, c, k in fits:
        if _chosen_model(c)[0] == "gbt":
            trees.setdefault(tuple(sorted(_chosen_model(c)[1].items())), []).append((s, k))
    if linear:
        grams = Grams(frame, features, target, dates)
        linear = [f for f in linear if grams.rows(f[0].fit_from, f[0].fit_to)]
        medians = window_medians(frame, features, target, dates, [(s.fit_from, s.fit_to) for s, _, _ in linear])
        models = []
        for s, options, k in linear:
            mid = medians[s.fit_from, s.fit_to]
            bias, w = grams.ridge(s.fit_from, s.fit_to, mid, options.get("alpha", 10.0), use)
            models += [(dates[i], *k, bias, w, mid) for i in range(s.from_, s.to)]
        if models:
            out = score_rows(frame, features, models, keys, ["date", "ticker", target])
    for options, own in trees.items():
        used = features if use is None else [features[i] for i in use]
        numbered = [Span(n, s.fit_from, s.fit_to, s.from_, s.to) for n, (s, _) in enumerate(own)]
        which = spark.createDataFrame([(n, *k) for n, (_, k) in enumerate(own)], f"fold_ int, {keys}")
        made = _walk_forward_trees(frame, used, target, dates, numbered, dict(options), f"date date, ticker string, `{target}` double, prediction double, fold int")
        out = out.unionByName(made.withColumnRenamed("fold", "fold_").join(which, "fold_").select("date", "ticker", target, "prediction", *names))
    return out


def nested_walk_forward(frame: DataFrame, features: Sequence[str], candidates: Mapping[str, Candidate], target: str = "target", train: int = 504, test: int = 21, embargo: int = 5, inner: int = 63) -> tuple[DataFrame, DataFrame]:
    """(predictions, selections): before each outer fold the candidate is chosen on the tail of its own training dates.

    ``candidates`` maps a name to a ridge penalty or to (model, parameters) as in ``walk_forward``. The inner validation begins ``inner`` dates before the end of training (not before
    ``inner + embargo`` dates) and is separated from its fit by the embargo. The candidate with the highest mean daily rank correlation wins, the first on ties. Every ridge fit is a
    difference of the same prefix sums; the validation of all folds and candidates is one plan.
    """
    if not candidates:
        raise ValueError("give at least one candidate")
    if inner < 1:
        raise ValueError("the inner window must be positive")
    features = list(features)
    require_columns(frame, ["date", "ticker", target, *features], "frame")
    spark, dates = frame.sparkSession, date_axis(frame)
    outer, names = folds(len(dates), train, test, embargo), list(candidates)
    blocks: list[tuple[int, Span]] = []
    for s in outer:
        at = max(inner + embargo, s.fit_to - inner)
        while at < s.fit_to:
            blocks.append((s.fold, Span(0, 0, at - embargo, at, min(at + inner, s.fit_to))))
            at += inner
    trials = [(b, candidates[name], (fold, c)) for fold, b in blocks for c, name in enumerate(names)]
    validated = _predictions(frame, features, target, dates, trials, "fold int, candidate int")
    scores = {(r["fold"], r["candidate"]): r["score"] for r in strict_mean_rank_ic(validated, ["fold", "candidate"], "prediction", target).collect()}
    final, chosen = [], []
    for s in outer:
        own = [scores.get((s.fold, c), -math.inf) for c in range(len(names))]
        best = 0
        for c in range(1, len(names)):
            best = c if own[c] > own[best] else best
        final.append((s, candidates[names[best]], (s.fold, names[best])))
        chosen.append((s.fold, dates[s.from_], dates[s.to - 1], names[best], *own))
    inner_columns = ", ".join(f"`inner_rank_ic_{n}` double" for n in names)
    selections = spark.createDataFrame(chosen, f"fold int, test_start date, test_end date, selected_candidate string, {inner_columns}")
    return _predictions(frame, features, target, dates, final, "fold int, selected_candidate string"), selections


def ablation(
    frame: DataFrame, groups: Mapping[str, Sequence[str]], target: str = "target", train: int = 504, test: int = 21, embargo: int = 5, alpha: float = 10.0, expanding: bool = True, model: str = "ridge", parameters: Mapping[str, float] | None = None
) -> DataFrame:
    """Walk-forward with all features (experiment ``full``) and without each group (``without_<group>``); ``model``, ``parameters`` and ``expanding`` as in ``walk_forward``, ``alpha`` being
    the ridge penalty."""
    features = [f for g in groups.values() for f in g]
    require_columns(frame, ["date", "ticker", target, *features], "frame")
    dates = date_axis(frame)
    spans = folds(len(dates), train, test, embargo, expanding)
    candidate: Candidate = alpha if model == "ridge" and not parameters else (model, dict(parameters or {}))
    sets = {"full": list(range(len(features))), **{f"without_{g}": [i for i, f in enumerate(features) if f not in fs] for g, fs in groups.items()}}
    if model == "ridge":
        return _ridge_subsets(frame, features, target, dates, spans, _chosen_model(candidate)[1].get("alpha", 10.0), sets)
    made = [_predictions(frame, features, target, dates, [(s, candidate, (s.fold, name)) for s in spans], "fold int, experiment string", use) for name, use in sets.items()]
    return reduce(DataFrame.unionByName, made)


def _ridge_subsets(frame: DataFrame, features: list[str], target: str, dates: list, spans: list[Span], alpha: float, sets: Mapping[str, list[int]]) -> DataFrame:
    """Every span and feature subset from one set of Gram matrices, as one plan."""
    grams = Grams(frame, features, target, dates)
    spans = [s for s in spans if grams.rows(s.fit_from, s.fit_to)]
    medians = window_medians(frame, features, target, dates, [(s.fit_from, s.fit_to) for s in spans])
    models = []
    for name, use in sets.items():
        for s in spans:
            mid = medians[s.fit_from, s.fit_to]
            bias, w = grams.ridge(s.fit_from, s.fit_to, mid, alpha, use)
            models += [(dates[i], s.fold, name, bias, w, mid) for i in range(s.from_, s.to)]
    return score_rows(frame, features, models, "fold int, experiment string", ["date", "ticker", target])
