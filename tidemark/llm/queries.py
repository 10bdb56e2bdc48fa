"""Queries of the llm operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.common import canonical_ticker, day_string, latest_rows, not_nan, table
from tidemark.llm.leakage import leaked_items
from tidemark.llm.lookalike import lookalike_classes, lookalike_pairs, train_unifier, unify_texts
from tidemark.llm.mixture import draw_mix
from tidemark.llm.quantiles import group_percentiles, merge_sketches, read_percentiles, sketch_groups
from tidemark.llm.sql import ORACLE as TEXT_ORACLE
from tidemark.llm.top_n import top_n

PERCENTILES = {"p01": 0.01, "p50": 0.5, "p95": 0.95, "p99": 0.99}
#: The public byte-level vocabulary that sizes of texts are counted in.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MEASURES = ["dollar_volume_20d", "volatility_20d"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 3 best tickers of every run and date."""
    keys = ["run_id", "date", "ticker"]
    scores = table(spark, sf_dir, "predictions").select("run_id", "date", canonical_ticker("ticker").alias("ticker"), "scored_at", "prediction")
    best = top_n(latest_rows(scores, keys, ["scored_at"], ["prediction"]), ["run_id", "date"], "prediction", "ticker", 3)
    return best.select("run_id", day_string("date").alias("date"), "ticker")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows, exact duplicates once."""
    rows = table(spark, sf_dir, "features").withColumn("ticker", canonical_ticker("ticker"))
    return rows.select("date", "ticker", *[not_nan(c).alias(c) for c in ("return_1d", *MEASURES)]).distinct()


def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of dollar volume and volatility of every date."""
    return group_percentiles(_features(spark, sf_dir), "date", MEASURES, PERCENTILES)


def p6_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of every month, from the sketches of its days."""
    days = merge_sketches(sketch_groups(_features(spark, sf_dir), "date", MEASURES), ["grp", "field"])
    by_day = days.select("grp", "field", F.xxhash64("grp").alias("part"), "low", "high")
    months = merge_sketches(by_day, {"month": F.trunc("grp", "month"), "field": F.col("field")})
    return read_percentiles(months, ["month", "field"], PERCENTILES)


def p6_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the percentiles of all rows together, far more than a sketch holds uncompacted, keep the stated error: ranks counted in the whole table."""
    rows = _features(spark, sf_dir).select(F.lit(True).alias("all"), *MEASURES)
    found = {r["field"]: r for r in group_percentiles(rows, "all", MEASURES, PERCENTILES).collect()}  # a row per measure
    counts = [
        F.struct(F.lit(f).alias("field"), F.lit(name).alias("percentile"), F.lit(p).alias("p"), F.lit(found[f]["rank_error"] if f in found else 0.0).alias("error"), F.count(f).alias("n"),
                 F.count(F.when(F.col(f) < F.lit(found[f][name] if f in found else None).cast("double"), 1)).alias("below"), F.count(F.when(F.col(f) <= F.lit(found[f][name] if f in found else None).cast("double"), 1)).alias("upto"))
        for f in MEASURES for name, p in PERCENTILES.items()
    ]
    rank, tail = F.ceil(F.col("p") * F.col("n")), F.least(F.col("p"), 1 - F.col("p")) * F.col("n")
    away = F.greatest(F.col("below") + 1 - rank, rank - F.col("upto"), F.lit(0))
    return rows.agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.*").select("field", "percentile", "n", (F.col("error") > 0).alias("compacted"), (away <= F.col("error") * tail + 1).alias("within"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items and the pages that hold a passage of them."""
    return leaked_items(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item with the number of pages that leak it."""
    items = table(spark, sf_dir, "eval_items").select("item_id", "task", "split")
    pages = p8_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("pages"))
    return items.join(pages, "item_id", "left").na.fill(0, ["pages"])


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn pages, with the number of times each is used."""
    mix, _ = draw_mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), "doc_id", "text", "source", vocabulary=VOCABULARY)
    return mix.withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of tokens that the mix reaches."""
    return draw_mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), "doc_id", "text", "source", vocabulary=VOCABULARY)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of pages that look identical but aren't."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = lookalike_pairs(docs, "doc_id", "text", train_unifier(docs, "text"))
    return pairs.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page that has a look-alike with its class, and the number of pages it is linked with."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lookalike_classes(docs, "doc_id", "text", train_unifier(docs, "text")).withColumnRenamed("id", "doc_id")


def p10_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's text in its unified form."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return unify_texts(docs, "text", train_unifier(docs, "text")).select("doc_id", "unified")


QUERIES = {
    "p2_found": p2_found, "p6_percentiles": p6_percentiles, "p6_monthly": p6_monthly, "p6_bounds": p6_bounds, "p8_found": p8_found, "p8_items": p8_items, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_classes": p10_classes, "p10_unified": p10_unified,
}

TICKER = "upper(replace(trim(ticker, ' ' || chr(9) || chr(10) || chr(13)), '.', '-'))"

ORACLE = {
    **TEXT_ORACLE,
    "p2_found": f"""
with c as (select run_id, date, t, case when isnan(prediction) then null else prediction + 0.0 end as p from (
  select run_id, date, {TICKER} as t, prediction,
         row_number() over (partition by run_id, date, {TICKER} order by scored_at desc nulls last, isnan(prediction) desc, prediction desc nulls last) as rn from predictions) where rn = 1)
select run_id, strftime(date, '%Y-%m-%d') as date, t as ticker from (
  select *, row_number() over (partition by run_id, date order by p desc, t) as rk from c where p is not null) where rk <= 3""",
    "p6_bounds": f"""
with f as (select distinct date, {TICKER} as t, case when not isnan(return_1d) then return_1d end as r, case when not isnan(dollar_volume_20d) then dollar_volume_20d end as dv,
                  case when not isnan(volatility_20d) then volatility_20d end as vo from features),
n as (select 'dollar_volume_20d' as field, count(dv) as n from f union all select 'volatility_20d', count(vo) from f)
select field, p as percentile, n, n > 384 as compacted, true as within from n, (select unnest(['p01', 'p50', 'p95', 'p99']) as p)""",
    # At scale 0.01 no day has more values than a sketch holds uncompacted, so the percentiles are exact there.
    "p6_percentiles": f"""
with f as (select distinct date, {TICKER} as t, case when not isnan(return_1d) then return_1d end as r, case when not isnan(dollar_volume_20d) then dollar_volume_20d end as dv,
                  case when not isnan(volatility_20d) then volatility_20d end as vo from features),
v as (select date, 'dollar_volume_20d' as field, dv as x from f where dv is not null union all select date, 'volatility_20d', vo from f where vo is not null),
k as (select *, row_number() over (partition by date, field order by x) as i, count(*) over (partition by date, field) as n from v)
select date as grp, field, max(n) as n, max(x) filter (where i = greatest(1, cast(ceil(0.01::double * n - 1e-9) as bigint))) as p01,
       max(x) filter (where i = greatest(1, cast(ceil(0.5::double * n - 1e-9) as bigint))) as p50, max(x) filter (where i = greatest(1, cast(ceil(0.95::double * n - 1e-9) as bigint))) as p95,
       max(x) filter (where i = greatest(1, cast(ceil(0.99::double * n - 1e-9) as bigint))) as p99, 0.0::double as rank_error
from k group by date, field""",
}
