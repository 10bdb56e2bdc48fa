"""Queries of the general training-data operators over the dataset's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.common import canonical_ticker, day_string, finite, latest_rows, table
from tidemark.operators.history import version_history
from tidemark.operators.known_asof import attach_known
from tidemark.operators.snapshot_diff import snapshot_diff
from tidemark.operators.spikes import Field, implausible_readings
from tidemark.operators.trailing import trailing_totals


def counting_bars(spark: SparkSession, sf_dir: str, *values: str) -> DataFrame:
    """The bar that counts for each (ticker, date): the one ingested last."""
    panel = table(spark, sf_dir, "panel").select(canonical_ticker("ticker").alias("ticker"), "date", "ingested_at", *values)
    return latest_rows(panel, ["ticker", "date"], ["ingested_at"], values)


#: Prices depart by changes, volumes by their spread.
READINGS = (Field("open"), Field("close"), Field("volume", positive=False, spread=True, factor=10.0))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open, close and volume readings that can't be right for their ticker."""
    bars = counting_bars(spark, sf_dir, "open", "close", "volume")
    flagged = implausible_readings(bars, "ticker", "date", READINGS, flagged_only=True)
    return flagged.select(F.col("source").alias("ticker"), day_string("day").alias("date"), "field")


def p1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading with its isolation score and the reason why it is flagged, if it is."""
    scored = implausible_readings(counting_bars(spark, sf_dir, "open", "close", "volume"), "ticker", "date", READINGS)
    return scored.withColumnRenamed("source", "ticker").withColumnRenamed("day", "date")


def p1_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of p1_found that explicit rules decide: impossible values and flat lines, with the reason."""
    bars = counting_bars(spark, sf_dir, "open", "close", "volume")
    flagged = implausible_readings(bars, "ticker", "date", READINGS, flagged_only=True).filter("reason <> 'spike'")
    return flagged.select(F.col("source").alias("ticker"), day_string("day").alias("date"), "field", "reason")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity periods of membership and sector."""
    updates = table(spark, sf_dir, "universe_history").withColumn("ticker", canonical_ticker("ticker"))
    versions = version_history(updates, "ticker", "effective_date", ["in_universe", "sector"], "as_of")
    return versions.select("ticker", day_string("valid_from").alias("valid_from"), F.coalesce(day_string("valid_to"), F.lit("9999-12-31")).alias("valid_to"))


def p3_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same versions with their attributes."""
    updates = table(spark, sf_dir, "universe_history").withColumn("ticker", canonical_ticker("ticker"))
    return version_history(updates, "ticker", "effective_date", ["in_universe", "sector"], "as_of")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Universe records by ticker and facts by company as one history: entity, feature, two order columns, and the days from which a record is valid and known."""
    effective, available = F.col("effective_date"), F.col("metadata_available_date")
    both = F.when(available.isNotNull() & effective.isNotNull(), F.greatest(effective, available))
    universe = table(spark, sf_dir, "universe_history").select(
        F.concat(F.lit("t"), canonical_ticker("ticker")).alias("entity"), F.lit("universe").alias("feature"), effective.alias("first"), available.alias("second"), "record_id", both.alias("known_from"), effective.alias("valid_from")
    )
    facts = table(spark, sf_dir, "fundamental_facts").select(
        F.concat(F.lit("c"), F.col("cik").cast("string")).alias("entity"), "feature", F.col("available_date").alias("first"), F.col("report_end").alias("second"), "record_id", F.col("available_date").alias("known_from"), F.col("filed_date").alias("valid_from")
    )
    return universe.unionByName(facts)


def _attached(spark: SparkSession, sf_dir: str, differing_only: bool) -> DataFrame:
    """Each bar is an event of its ticker and one of its company; both go through one numbering and one join."""
    bars = counting_bars(spark, sf_dir, "cik").withColumnRenamed("date", "ts")
    keys = F.array(F.concat(F.lit("t"), F.col("ticker")), F.concat(F.lit("c"), F.col("cik").cast("string")))
    events = bars.select("ticker", "ts", F.explode(keys).alias("entity"))
    return attach_known(events, _records(spark, sf_dir), ["first", "second"], "record_id", F.col("known_from"), F.col("valid_from"), F.xxhash64("ticker", "ts"), differing_only).drop("entity")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars whose known record is not the one valid without regard to availability."""
    cases = _attached(spark, sf_dir, differing_only=True)
    return cases.select("ticker", day_string("ts").alias("date"), F.col("feature").alias("subject"), F.coalesce("known", F.lit(0).cast("bigint")).alias("record_id"))


def p4_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bar with the universe record and, per feature, the fact known on its date."""
    rows = _attached(spark, sf_dir, differing_only=False).filter("known is not null")
    return rows.select("ticker", F.col("ts").cast("date").alias("date"), F.col("feature").alias("subject"), F.col("known").alias("record_id"))


#: Digits of the results of p5, and a term far below them that keeps an exact tie from being rounded either way.
ROUNDING = (("volume", 3, 1e-6), ("close", 6, 1e-9), ("return", 9, 1e-13))


def p5_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing 7 and 30 day totals and averages of volume, close and return."""
    void = F.lit(None)
    bars = table(spark, sf_dir, "panel").select(
        canonical_ticker("ticker").alias("ticker"), F.col("date").cast("date").alias("date"), F.struct("ingested_at", "volume", finite("close").alias("close")).alias("bar"), void.cast("double").alias("ret")
    )
    returns = table(spark, sf_dir, "features").select(canonical_ticker("ticker").alias("ticker"), F.col("date").cast("date").alias("date"), void.cast(dict(bars.dtypes)["bar"]).alias("bar"), finite("return_1d").alias("ret"))
    both = bars.unionByName(returns).groupBy("ticker", "date").agg(F.max("bar").alias("bar"), F.max("ret").alias("ret"))
    daily = both.select("ticker", "date", F.col("bar").isNotNull().alias("has_bar"), F.col("bar.volume").alias("volume"), F.col("bar.close").alias("close"), "ret")
    wide = trailing_totals(daily, "ticker", "date", "has_bar", {"volume": "volume", "close": "close", "return": "ret"})
    rounded = {c: F.round(F.col(c) + ties, digits) for c, kind in wide.dtypes if kind == "double" for name, digits, ties in ROUNDING if c.startswith(name)}
    return wide.withColumns(rounded)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickers added, removed or moved to another sector at each snapshot."""
    snapshots = table(spark, sf_dir, "snapshots")
    sector = F.lower(F.btrim("gics_sector", F.lit(" \t\r\n")))
    diff = snapshot_diff(snapshots, "as_of", {"ticker": canonical_ticker("ticker")}, [sector], "delivered_at")
    return diff.select(day_string("as_of").alias("as_of"), "ticker", "change")


QUERIES = {"p1_found": p1_found, "p1_scores": p1_scores, "p1_rules": p1_rules, "p3_found": p3_found, "p3_history": p3_history, "p4_found": p4_found, "p4_attached": p4_attached, "p5_trailing": p5_trailing, "p7_found": p7_found}

TICKER = "upper(replace(trim(ticker, ' ' || chr(9) || chr(10) || chr(13)), '.', '-'))"

_UNIVERSE = f"u as (select distinct {TICKER} as t, effective_date as eff, metadata_available_date as av, record_id as rid from universe_history where effective_date is not null)"
_BARS = f"""bars as (select t, date, cik from (select {TICKER} as t, date, cik, row_number() over (partition by {TICKER}, date order by ingested_at desc nulls last, cik desc nulls last) as rn from panel) where rn = 1)"""

_VERSIONS = f"""
with c as (
  select t, e, in_universe, sector from (
    select {TICKER} as t, effective_date as e, in_universe, sector,
           row_number() over (partition by {TICKER}, effective_date order by as_of desc nulls last, in_universe desc nulls last, sector desc nulls last) as rn
    from universe_history where ticker is not null and effective_date is not null) where rn = 1),
s as (
  select *, row_number() over (partition by t order by e) as n,
         lag(in_universe) over (partition by t order by e) as u0, lag(sector) over (partition by t order by e) as s0 from c),
v as (select t, e, in_universe, sector from s where n = 1 or in_universe is distinct from u0 or sector is distinct from s0)
"""

_KNOWN = f"""
with {_BARS}, {_UNIVERSE},
f as (select distinct cik as c, feature, filed_date as fd, available_date as av, report_end as re, record_id as rid from fundamental_facts),
uk as (select b.t, b.date, arg_max(u.rid, row(u.eff, u.av, u.rid)) filter (where u.av <= b.date) as known, arg_max(u.rid, row(u.eff, u.av, u.rid)) as plain
       from bars b join u on u.t = b.t and u.eff <= b.date group by b.t, b.date),
fk as (select b.t, b.date, f.feature,
              arg_max(f.rid, row(f.av, f.re, f.rid)) filter (where f.av <= b.date) as known,
              arg_max(f.rid, row(f.av, f.re, f.rid)) filter (where f.fd <= b.date) as plain
       from bars b join f on f.c = b.cik and (f.av <= b.date or f.fd <= b.date) group by b.t, b.date, f.feature),
k as (select t, date, 'universe' as subject, known, plain from uk union all select t, date, feature, known, plain from fk)
"""

_PERIODS = "".join(
    f""", least({n}, cast(date_diff('day', d0, day) as bigint) + 1)::int as days_{n}d, count(act) filter (where act) over w{n} as active_days_{n}d"""
    + "".join(
        f""", coalesce({'cast(sum(' + c + ') over w' + str(n) + ' as bigint)' if c == 'volume' else 'round(sum(' + c + ') over w' + str(n) + ' + ' + tie + ', ' + str(digits) + ')'}, 0) as {name}_sum_{n}d,
        count({c}) over w{n} as {name}_days_{n}d, round(sum({c}) over w{n} / nullif(count({c}) over w{n}, 0) + {tie}, {digits}) as {name}_avg_{n}d"""
        for name, c, digits, tie in (("volume", "volume", 3, "1e-6"), ("close", "close", 6, "1e-9"), ("return", "ret", 9, "1e-13"))
    )
    for n in (7, 30)
)

ORACLE = {
    "p1_rules": f"""
with b as (select t, date, open, close, volume::double as volume from (
  select {TICKER} as t, date, open, close, volume,
         row_number() over (partition by {TICKER}, date order by ingested_at desc nulls last, open desc nulls last, close desc nulls last, volume desc nulls last) as rn
  from panel where ticker is not null and date is not null) where rn = 1),
l as (select t, date, 'open' as field, open as v from b union all select t, date, 'close', close from b union all select t, date, 'volume', volume from b),
c as (select *, coalesce(v <> lag(v) over w or isnan(v), true)::int as fresh from l where v is not null window w as (partition by t, field order by date)),
g as (select *, sum(fresh) over (partition by t, field order by date rows unbounded preceding) as g from c),
r as (select *, count(*) over (partition by t, field, g) as n, row_number() over (partition by t, field, g order by date) as i from g),
j as (select *, case when isnan(v) or isinf(v) or v < 0 or (v = 0 and field <> 'volume') then 'impossible' when n >= 6 and i > 1 then 'flat' end as reason from r)
select t as ticker, strftime(date, '%Y-%m-%d') as date, field, reason from j where reason is not null""",
    "p3_found": _VERSIONS
    + "select t as ticker, strftime(e, '%Y-%m-%d') as valid_from, coalesce(strftime(lead(e) over (partition by t order by e), '%Y-%m-%d'), '9999-12-31') as valid_to from v",
    "p3_history": _VERSIONS + "select t as ticker, in_universe, sector, e as valid_from, lead(e) over (partition by t order by e) as valid_to from v",
    "p4_found": _KNOWN
    + "select t as ticker, strftime(date, '%Y-%m-%d') as date, subject, coalesce(known, 0) as record_id from k where coalesce(known, 0) <> coalesce(plain, 0)",
    "p4_attached": _KNOWN + "select t as ticker, date, subject, known as record_id from k where known is not null",
    "p5_trailing": f"""
with b as (select t, d, volume, close from (
  select {TICKER} as t, date as d, volume, case when isfinite(close) then close end as close,
         row_number() over (partition by {TICKER}, date order by ingested_at desc nulls last, volume desc nulls last, case when isfinite(close) then close end desc nulls last) as rn from panel) where rn = 1),
r as (select {TICKER} as t, date as d, max(case when isfinite(return_1d) then return_1d end) as ret from features group by 1, 2),
span as (select t, min(d) as d0, max(d) as d1 from b group by t),
cal as (select t, d0, d1, cast(unnest(generate_series(d0, d1, interval 1 day)) as date) as day from span),
pre as (select r.t, s.d0, s.d1, r.d as day from r join span s on s.t = r.t where r.d < s.d0),
x as (select c.t, c.d0, c.d1, c.day, b.t is not null as act, b.volume, b.close, r.ret
      from (select * from cal union all select * from pre) c left join b on b.t = c.t and b.d = c.day left join r on r.t = c.t and r.d = c.day),
y as (select t as ticker, day as date, d0{_PERIODS} from x
      window w7 as (partition by t order by day range between interval 6 day preceding and current row),
             w30 as (partition by t order by day range between interval 29 day preceding and current row))
select * exclude (d0) from y where date >= d0""",
    "p7_found": f"""
with d as (select as_of, max(delivered_at) as dat from snapshots where as_of is not null group by as_of),
a as (select as_of, dat, row_number() over (order by as_of) as k, lead(as_of) over (order by as_of) as nxt from d),
s as (select a.k, a.as_of, a.nxt, {TICKER} as t, max(lower(trim(gics_sector, ' ' || chr(9) || chr(10) || chr(13)))) as sec
      from snapshots s join a on s.as_of = a.as_of and s.delivered_at is not distinct from a.dat where ticker is not null group by 1, 2, 3, 4),
j as (select coalesce(n.as_of, p.nxt) as as_of, coalesce(n.t, p.t) as t, n.t as nt, p.t as pt, n.sec as ns, p.sec as ps, coalesce(n.k, p.k + 1) as k
      from s n full join (select * from s where nxt is not null) p on n.k = p.k + 1 and n.t = p.t)
select strftime(as_of, '%Y-%m-%d') as as_of, t as ticker, case when pt is null then 'added' when nt is null then 'removed' else 'changed' end as change
from j where k > 1 and (pt is null or nt is null or ns is distinct from ps)""",
}
