"""SQL of the research queries, composed of shared common table expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

from tidemark.operators.features import RAW_FEATURES

TICKER = "upper(replace(trim(ticker, ' ' || chr(9) || chr(10) || chr(13)), '.', '-'))"
W = "(partition by ticker order by date)"


def _frame(n: int, last: int = 0) -> str:
    end = "current row" if last == 0 else f"{-last} preceding"
    return f"(partition by ticker order by date rows between {n - 1 - last} preceding and {end})"


def _roll(agg: str, x: str, n: int, least: int | None = None, last: int = 0) -> str:
    f = _frame(n, last)
    return f"case when count({x}) over {f} >= {n if least is None else least} then {agg}({x}) over {f} end"


def _pct(x: str, *keys: str) -> str:
    by = ", ".join(keys)
    return f"case when {x} is not null then (rank() over (partition by {by} order by {x} nulls last) + (count(*) over (partition by {by}, {x}) - 1) / 2.0) / count({x}) over (partition by {by}) end"


def _corr(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def _ic(source: str, x: str, y: str, *keys: str) -> str:
    """Rows of ``source`` reduced to per-key correlations: ic(keys..., pearson_ic, rank_ic, directional_accuracy, n)."""
    by = ", ".join(keys)
    rank = lambda c: f"rank() over (partition by {by} order by {c}) + (count(*) over (partition by {by}, {c}) - 1) / 2.0"
    return f"""(select {by}, {_corr("x", "y")} as pearson_ic, {_corr("rx", "ry")} as rank_ic, avg((sign(x) = sign(y))::int::double) as directional_accuracy, count(*) as n
      from (select {by}, x, y, {rank("x")} as rx, {rank("y")} as ry from (select {by}, {x} as x, {y} as y from {source} where {x} is not null and {y} is not null)) group by {by})"""


def _r(x: str, digits: int = 7) -> str:
    return f"round({x}, {digits}) + 0.0"


def _z(f: str) -> str:
    return f"(c_{f} - avg(c_{f}) over (partition by date)) / nullif(stddev_samp(c_{f}) over (partition by date), 0)"


_POSITIVE = " and ".join(f"isfinite({c}) and {c} > 0" for c in ("open", "high", "low", "close"))
_Z = ("return_1d", "return_5d", "return_60d", "volatility_20d", "downside_volatility_20d", "atr_proxy_20d", "dollar_volume_20d", "relative_volume_20d")


_SPREADS = (("SMB", "dollar_volume_20d"), ("HML", "volatility_20d"), ("RMW", "return_20d"), ("CMA", "distance_ma_20d"))
_FACTORS = ("Mkt-RF", *(name for name, _ in _SPREADS), "RF")


def _cross(source: str, names: tuple[str, ...], extra: str = "") -> str:
    bounds = ", ".join(f"quantile_cont({f}, 0.01) over (partition by date) as lo_{f}, quantile_cont({f}, 0.99) over (partition by date) as hi_{f}" for f in names)
    clipped = ", ".join(f"case when {f} is not null then least(greatest({f}, lo_{f}), hi_{f}) end as c_{f}" for f in names)
    return f"(select *, {clipped} {extra} from (select *, {bounds} from {source}))"


_SIG = ("intermediate_momentum", "short_horizon_reversal", "low_risk", "liquidity_quality")


def _books(tag: str, source: str, by: str = "") -> dict[str, tuple[tuple[str, ...], str]]:
    """From predictions to sums per rebalance, per date or per (by, date)."""
    k = f"{by}, date" if by else "date"
    each, series = f"partition by {k}", f"partition by {by} order by date" if by else "order by date"
    own, shown = (f"a.{by} = b.{by} and ", f"d.{by}, ") if by else ("", "")
    return {
        f"leg{tag}": ((source,), f"""select * from (select *, case when up <= k then 1.0 when down <= k then -1.0 end as leg from (
            select *, floor(count(*) over ({each}) * 0.2) as k, row_number() over ({each} order by prediction desc, ticker) as up, row_number() over ({each} order by prediction, ticker) as down
            from {source} where prediction is not null and sector is not null and beta is not null)) where leg is not null"""),
        f"dm{tag}": ((f"leg{tag}",), f"select *, leg - avg(leg) over ({each}, sector) as x0, beta - avg(beta) over ({each}, sector) as f0 from leg{tag}"),
        f"rw{tag}": ((f"dm{tag}",), f"""select *, x0 - case when ff > 1e-20 * bb then xf / nullif(ff, 0) else 0 end * f0 as w from (
            select *, sum(f0 * f0) over ({each}) as ff, sum(beta * beta) over ({each}) as bb, sum(x0 * f0) over ({each}) as xf from dm{tag})"""),
        f"bk{tag}": ((f"rw{tag}",), f"""select * from (select *, max(abs(weight)) over ({each}) as widest from (
            select *, w / nullif(gross, 0) as weight from (select *, sum(abs(w)) over ({each}) as gross from rw{tag}) where gross > 1e-12)) where widest <= 0.5"""),
        f"td{tag}": ((f"bk{tag}",), f"select b.*, k2 from bk{tag} b join (select {k}, row_number() over ({series}) as k2 from (select distinct {k} from bk{tag} where sf is not null)) using ({k}) where sf is not null"),
        f"sm{tag}": ((f"td{tag}",), f"""select {shown}d.date, sum(w * r) as gross, coalesce(sum(w * r) filter (where w > 0), 0) as long_leg, coalesce(sum(w * r) filter (where w < 0), 0) as short_leg, coalesce(sum(-w) filter (where w < 0), 0) as short_weight,
            sum(m / 2) as turnover, sum(case when w is not null then m / 2 * vol * sqrt(m / adv) end) as impact, count(w) as n from (
              select {f"coalesce(a.{by}, b.{by}) as {by}, " if by else ""}coalesce(a.k2, b.k2 + 1) as k2, a.weight as w, a.sf as r, abs(coalesce(a.weight, 0) - coalesce(b.weight, 0)) as m, a.volatility_20d as vol, a.dollar_volume_20d as adv
              from td{tag} a full join td{tag} b on {own}a.k2 = b.k2 + 1 and a.ticker = b.ticker) x join (select distinct {by + ", " if by else ""}k2, date from td{tag}) d using ({by + ", " if by else ""}k2) group by {shown}d.date"""),
    }


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "px": ((), f"""select ticker, date, open, high, low, close, volume, cik from (
        select {TICKER} as ticker, date, open, high, low, close, volume, cik, row_number() over (partition by {TICKER}, date order by ingested_at desc nulls last) as rn from panel)
      where rn = 1 and {_POSITIVE} and volume >= 0"""),
    "mh": ((), f"""select ticker, effective_date as e, metadata_available_date as av, in_universe as u, sector from (
        select {TICKER} as ticker, effective_date, metadata_available_date, in_universe, sector, row_number() over (partition by {TICKER}, effective_date order by as_of desc, record_id desc) as rn from universe_history) where rn = 1"""),
    "bm": (("px",), """select date, close / lag(close) over (order by date) - 1 as br, lead(close, 5) over (order by date) / lead(open, 1) over (order by date) - 1 as bf,
        lead(close, 10) over (order by date) / lead(open, 1) over (order by date) - 1 as bf10 from (select date, avg(open) as open, avg(close) as close from px group by date)"""),
    "lab0": (("px", "bm"), f"""select px.*, br, bf, bf10, close / lag(close) over {W} - 1 as sr, lead(close, 5) over {W} / lead(open, 1) over {W} - 1 as sf, lead(close, 10) over {W} / lead(open, 1) over {W} - 1 as sf10
        from px left join bm using (date)"""),
    "lab": (("lab0",), f"""select *, sf - beta * bf as target, sf10 - beta * bf10 as target_10d from (
        select *, case when count(sr * br) over {_frame(60)} = 60 then covar_pop(sr, br) over {_frame(60)} / nullif(var_pop(br) over {_frame(60)}, 0) end as beta from lab0)"""),
    "ft0": (("lab",), f"""select *, sr as return_1d, greatest(high - low, abs(high - lag(close) over {W}), abs(low - lag(close) over {W})) as tr, close * volume as dv, case when sr < 0 then sr end as dn from lab"""),
    "ft": (("ft0",), "select *, " + ", ".join(f"close / lag(close, {k}) over {W} - 1 as return_{k}d" for k in (5, 20, 60, 120)) + f""",
        lag(close, 5) over {W} / lag(close, 25) over {W} - 1 as skip_momentum_20d, close / ({_roll("avg", "close", 20)}) - 1 as distance_ma_20d, {_roll("stddev_samp", "return_1d", 20)} as volatility_20d,
        {_roll("stddev_samp", "dn", 20, 10)} as downside_volatility_20d, ({_roll("avg", "tr", 20)}) / close as atr_proxy_20d, volume / nullif({_roll("avg", "volume", 20)}, 0) as relative_volume_20d,
        (volume - ({_roll("avg", "volume", 20)})) / nullif({_roll("stddev_samp", "volume", 20)}, 0) as volume_zscore_20d, {_roll("median", "dv", 20)} as dollar_volume_20d from ft0"""),
    "fr": (("ft", "mh"), "select ft.*, case when mh.u is null or mh.av <= ft.date then mh.sector end as sector from ft asof left join mh on mh.ticker = ft.ticker and mh.e <= ft.date"),
    "zs": (("fr",), "select *, " + ", ".join(f"{_z(f)} as {f}_zscore" for f in _Z) + f" from {_cross('fr', _Z)}"),
    "sg": (("zs",), """select *, return_60d_zscore - return_5d_zscore as intermediate_momentum, -return_1d_zscore as short_horizon_reversal,
        -(coalesce(volatility_20d_zscore, 0) + coalesce(downside_volatility_20d_zscore, 0) + coalesce(atr_proxy_20d_zscore, 0))
          / nullif((volatility_20d_zscore is not null)::int + (downside_volatility_20d_zscore is not null)::int + (atr_proxy_20d_zscore is not null)::int, 0) as low_risk,
        (coalesce(dollar_volume_20d_zscore, 0) + coalesce(relative_volume_20d_zscore, 0)) / nullif((dollar_volume_20d_zscore is not null)::int + (relative_volume_20d_zscore is not null)::int, 0) as liquidity_quality from zs"""),
    "wk": (("px",), "select max(date) as date from px group by date + ((12 - isodow(date)) % 7)::int"),
    "fs": (("ft",), "select date, coalesce(avg(return_1d), 0) as \"Mkt-RF\", " + ", ".join(
        f"coalesce(avg(return_1d) filter (where r_{f} > 0.5) - avg(return_1d) filter (where r_{f} <= 0.5), 0) as {name}" for name, f in _SPREADS) + ", 0.0001::double as RF from (select *, "
        + ", ".join(f"{_pct(f, 'date')} as r_{f}" for _, f in _SPREADS) + " from ft) group by date"),
    "pr": (("fr", "wk"), "select date, ticker, -return_1d as prediction, sector, beta, sf, target, dollar_volume_20d, volatility_20d from fr where date in (select date from wk)"),
    **_books("", "pr"),
    "es": (("sg", "wk"), " union all ".join(f"select '{x}' as signal, date, ticker, {x} as prediction, sector, beta, sf, target, dollar_volume_20d, volatility_20d from sg where {x} is not null and date in (select date from wk)" for x in _SIG)),
    **_books("_s", "es", "signal"),
    "nt": (("sm",), "select date, gross - turnover * 10 / 10000 as net_return, turnover from sm"),
    "cv": (("nt",), "select *, equity / max(equity) over (order by date) - 1 as drawdown from (select *, product(1 + net_return) over (order by date rows unbounded preceding) as equity from nt)"),
    "dx": (("ft",), "select date, row_number() over (order by date) - 1 as i from (select distinct date from ft)"),
    "fd": (("dx",), "select f as fold, 85 + 20 * f as t0, 80 + 20 * f as hi from (select unnest(range(0, 20)) as f) where 85 + 20 * f < (select count(*) from dx)"),
}


def _with(tail: str, *names: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        for n in CTES[name][0]:
            visit(n)
        if name not in order:
            order.append(name)

    for n in names:
        visit(n)
    return "with " + ",\n".join(f"{n} as ({CTES[n][1]})" for n in order) + "\n" + tail


def _ridge(lowest: str) -> str:
    """Ridge on one feature, by fold: imputed by the training median, standardised, penalty 10."""
    return f"""
tr as (select fold, return_5d as x, target as y from ft join dx using (date) join fd on i < hi and i >= {lowest} where target is not null),
md as (select fold, median(x) as m from tr group by fold),
st as (select fold, any_value(m) as m, avg(coalesce(x, m)) as mx, stddev_pop(coalesce(x, m)) as sx, avg(y) as my, count(*) as n from tr join md using (fold) group by fold),
co as (select fold, any_value(st.m) as m, any_value(mx) as mx, any_value(my) as my, sum((coalesce(x, st.m) - mx) / sx * (y - my)) / (any_value(n) + 10) / any_value(sx) as b from tr join st using (fold) group by fold)
select date, ticker, {_r("my + b * (coalesce(return_5d, m) - mx)")} as prediction, fold::int as fold from ft join dx using (date) join fd on i >= t0 and i < t0 + 20 join co using (fold)"""


def _phi(x: str) -> str:
    """The normal distribution function by its series around 0."""
    terms = f"list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln(abs({x})) - (lgamma(2 * k + 2.0) - k * ln(2.0) - lgamma(k + 1.0)))))"
    return f"(0.5 + sign({x}) * exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * case when {x} = 0 then 0 else {terms} end)"


def _chance(trials: int) -> str:
    """Probability of a Sharpe ratio beyond the best of so many trials, from n, mean m, deviation s, skewness g and excess kurtosis q of net_return."""
    normal = NormalDist()
    best = (1 - 0.5772156649) * normal.inv_cdf(1 - 1 / trials) + 0.5772156649 * normal.inv_cdf(1 - 1 / (trials * math.e))
    return _phi(f"((m / s - {best!r}) * sqrt(n - 1) / sqrt(1 - g * m / s + q / 4 * (m / s) * (m / s)))")


_MOMENTS = "count(net_return) as n, avg(net_return) as m, stddev_samp(net_return) as s, skewness(net_return) as g, kurtosis(net_return) as q"
_NESTED = f"""
fits as (select fold, 'inner' as kind, hi - 30 as upto from fd union all select fold, 'outer', hi from fd),
tr as (select fold, kind, return_5d as x1, volatility_20d as x2, target as y from ft join dx using (date) join fits on i < upto where target is not null),
md as (select fold, kind, median(x1) as m1, median(x2) as m2 from tr group by all),
im as (select fold, kind, m1, m2, coalesce(x1, m1) as x1, coalesce(x2, m2) as x2, y from tr join md using (fold, kind)),
st as (select fold, kind, any_value(m1) as m1, any_value(m2) as m2, avg(x1) as a1, avg(x2) as a2, stddev_pop(x1) as s1, stddev_pop(x2) as s2, avg(y) as my, count(*) as n from im group by all),
gr as (select fold, kind, sum((x1 - a1) / s1 * (x2 - a2) / s2) as r, sum((x1 - a1) / s1 * (y - my)) as c1, sum((x2 - a2) / s2 * (y - my)) as c2 from im join st using (fold, kind) group by all),
co as (select fold, kind, name, st.m1, st.m2, a1, a2, my, ((n + alpha) * c1 - r * c2) / ((n + alpha) * (n + alpha) - r * r) / s1 as b1, ((n + alpha) * c2 - r * c1) / ((n + alpha) * (n + alpha) - r * r) / s2 as b2
       from st join gr using (fold, kind), (values ('light', 1.0), ('heavy', 1e5)) c(name, alpha)),
va as (select fold, name, date, my + b1 * (coalesce(return_5d, m1) - a1) + b2 * (coalesce(volatility_20d, m2) - a2) as x, target as y from ft join dx using (date) join fd on i >= hi - 25 and i < hi join co using (fold) where kind = 'inner'),
sc as (select fold, name, case when bool_or(rank_ic is null) then null else avg(rank_ic) end as score from {_ic("va", "x", "y", "fold", "name", "date")} where n >= 5 group by fold, name),
ch as (select fd.fold, case when l.fold is null then '-infinity'::double else l.score end as light, case when h.fold is null then '-infinity'::double else h.score end as heavy, case when h.score > l.score then 'heavy' else 'light' end as name from fd left join sc l on l.fold = fd.fold and l.name = 'light' left join sc h on h.fold = fd.fold and h.name = 'heavy')
"""

def _regression(names: tuple[str, ...]) -> tuple[str, str]:
    """(tables, rows): least squares of y on a constant and columns f0, f1, ... of table j, by successive projections and substitution from the last."""
    k = range(len(names))
    parts = ["g0 as (select y, y - avg(y) over () as e, " + ", ".join(f"f{i} as o{i}, f{i} - avg(f{i}) over () as p{i}" for i in k) + " from j)"]
    for i in k:
        later = [j for j in k if j > i]
        slopes = ", ".join([f"sum(p{i} * e) over () / sum(p{i} * p{i}) over () as c{i}", *(f"sum(p{i} * p{j}) over () / sum(p{i} * p{i}) over () as r{i}_{j}" for j in later)])
        parts.append(f"g{i + 1} as (select * replace (e - c{i} * p{i} as e" + "".join(f", p{j} - r{i}_{j} * p{i} as p{j}" for j in later) + f") from (select *, {slopes} from g{i}))")
    last = len(names)
    one = ", ".join([*(f"any_value(c{i}) as c{i}" for i in k), *(f"any_value(r{i}_{j}) as r{i}_{j}" for i in k for j in k if j > i), *(f"avg(o{i}) as m{i}" for i in k)])
    parts.append(f"b{last} as (select count(*) as n, avg(y) as my, stddev_samp(e) as s, {one} from g{last})")
    for i in reversed(k):
        parts.append(f"b{i} as (select *, c{i}" + "".join(f" - r{i}_{j} * b_{j}" for j in k if j > i) + f" as b_{i} from b{i + 1})")
    alpha = "my" + "".join(f" - b_{i} * m{i}" for i in k)
    values = {"observations": "n::double", "alpha_per_period": _r(alpha, 6), "residual_volatility": _r("s", 6), **{f"beta_{x}": _r(f"b_{i}", 6) for i, x in enumerate(names)}}
    return ", ".join(parts), " union all ".join(f"select '{m}' as metric, {v} as value from b0" for m, v in values.items())


_LINES = _regression(_FACTORS[:-1])
_PERF = """select product(1 + net_return) as last, stddev_samp(net_return) * sqrt(52) as vol, min(drawdown) as dd, count(*) as n from cv"""
_FIGURES = ("assets", "equity", "net_income", "operating_cash_flow", "revenue", "shares_outstanding")
_LONG = lambda names, source, keep: " union all ".join(f"select '{n}' as signal, {n} as x, {keep} from {source}" for n in names)
_SNAP = f"""sn as (select as_of, t as ticker, gics_sector, cik from (
   select s.as_of, {TICKER} as t, array_to_string(list_transform(string_split(lower(trim(gics_sector)), ' '), lambda w: upper(w[1]) || w[2:]), ' ') as gics_sector, cik,
          row_number() over (partition by s.as_of, {TICKER} order by array_to_string(list_transform(string_split(lower(trim(gics_sector)), ' '), lambda w: upper(w[1]) || w[2:]), ' ') desc nulls last, cik desc nulls last) as rn
   from snapshots s join (select as_of, max(delivered_at) as dat from snapshots group by as_of) l on l.as_of = s.as_of and l.dat = s.delivered_at) where rn = 1),
ax as (select as_of, row_number() over (order by as_of) as k, lead(as_of) over (order by as_of) as nxt from (select distinct as_of from sn))"""


def _business(n: int) -> str:
    if n == 0:
        return "case isodow(filed) when 6 then filed + 2 when 7 then filed + 1 else filed end"
    start, w0 = "(filed - greatest(isodow(filed) - 5, 0)::int)", "least(isodow(filed) - 1, 4)"
    return f"{start} + ({n} + 2 * (({w0} + {n}) // 5))::int"


ORACLE: dict[str, str] = {
    "panel_validated": _with("select date, ticker, open, high, low, close, volume from px", "px"),
    "universe_screen": _with(f"""select date, ticker, {_r("m + 1.3e-5", 2)} as median_dollar_volume, coalesce(lag(close) over {W} >= 20 and m >= 5000000, false) as eligible
        from (select *, {_roll("median", "dv", 20, last=-1)} as m from (select *, close * volume as dv from px))""", "px"),
    "membership_asof": _with(""", j as (select p.date, p.ticker, p.close, h.u, h.av, h.sector from px p asof left join mh h on h.ticker = p.ticker and h.e <= p.date)
select date, ticker, close, case when u is null then false when av <= date then u end as in_universe, case when u is null then date when av <= date then av end as metadata_available_date,
       case when u is null or av <= date then sector end as sector from j""", "px", "mh"),
    "facts_asof": _with(f""", f as (select cik, feature, available_date as a, value, row_number() over (partition by cik, feature, available_date order by report_end desc, filed_date desc, value desc) as rn
        from (select distinct cik, feature, value, available_date, report_end, filed_date from fundamental_facts) where value is not null and not isnan(value)),
p as (select cik, a, {", ".join(f"max(value) filter (where feature = '{x}' and rn = 1) as {x}" for x in _FIGURES)} from f group by cik, a),
j as (select x.date, x.ticker, {", ".join(_FIGURES)} from px x asof left join p on p.cik = x.cik and p.a <= x.date)
select date, ticker, {", ".join(f"{_r(x, 6)} as {x}" for x in _FIGURES)}, {_r("net_income / nullif(assets, 0)", 6)} as return_on_assets, {_r("operating_cash_flow / nullif(assets, 0)", 6)} as cashflow_to_assets,
  {_r("equity / nullif(assets, 0)", 6)} as equity_to_assets, {_r("(net_income - operating_cash_flow) / nullif(assets, 0)", 6)} as accruals_to_assets, {_r("operating_cash_flow / nullif(net_income, 0)", 6)} as cashflow_to_income,
  {_r(f"assets / nullif(lag(assets) over {W}, 0) - 1", 6)} as asset_growth from j""", "px"),
    "snapshot_change_log": f"""with {_SNAP},
n as (select ax.k, ax.as_of, ax.nxt, ticker, gics_sector as s, cik from sn join ax using (as_of)),
j as (select coalesce(a.as_of, b.nxt) as d, coalesce(a.ticker, b.ticker) as ticker, a.ticker is not null as u, case when a.ticker is not null then a.s else b.s end as s, case when a.ticker is not null then a.cik else b.cik end as cik,
             a.ticker as at, b.ticker as bt, a.s as as_, b.s as bs, a.cik as ac, b.cik as bc
      from n a full join (select * from n where nxt is not null) b on a.k = b.k + 1 and a.ticker = b.ticker)
select ticker, d as effective_date, d as metadata_available_date, u as in_universe, s as sector, cik from j where at is null or bt is null or as_ is distinct from bs or ac is distinct from bc""".replace("a.ticker as at", "a.ticker as nt").replace("where at is null", "where nt is null"),
    "price_coverage": _with(f""", m as (select t as ticker, min(e) as first_membership_date, count(*) as membership_add_events from (select distinct record_id, {TICKER} as t, effective_date as e, in_universe from universe_history) where in_universe group by t),
s as (select ticker, count(*) as price_observations, min(date) as first_price_date, max(date) as last_price_date from px group by ticker)
select ticker, first_membership_date, membership_add_events, coalesce(price_observations, 0) as price_observations, first_price_date, last_price_date, price_observations is null as missing_all_prices,
  coalesce(first_price_date > first_membership_date, false) as price_starts_after_membership from m left join s using (ticker)""", "px"),
    "rolling_features": _with("select date, ticker, " + ", ".join(f"{_r(f, 6) if f != 'dollar_volume_20d' else _r(f + ' + 1.3e-5', 2)} as {f}" for f in RAW_FEATURES) + " from ft", "ft"),
    "cross_sections": _with("select date, ticker, " + ", ".join(
        f"{_r(_pct('c_' + f, 'date'), 6)} as {f}_rank, {_r(_z(f), 6)} as {f}_zscore, {_r('case when sector is not null then ' + _pct('c_' + f, 'date', 'sector') + ' end', 6)} as {f}_sector_rank"
        for f in RAW_FEATURES) + f" from {_cross('fr', RAW_FEATURES)}", "fr"),
    "eligible_cross_sections": _with(f""", el as (select *, coalesce(lag(close) over {W} >= 20 and {_roll("median", "dv", 20, last=-1)} >= 5000000, false) as eligible from ft)
select date, ticker, {", ".join(f"{f}_rank, {f}_zscore" for f in ("return_5d", "volatility_20d"))} from (select date, ticker, eligible, """ + ", ".join(f"{_r(_pct('c_' + f, 'date'), 6)} as {f}_rank, {_r(_z(f), 6)} as {f}_zscore" for f in ("return_5d", "volatility_20d"))
        + f" from {_cross('el', ('return_5d', 'volatility_20d'))}) where eligible", "ft"),
    "rolling_ics": _with(f"select date, {_r('case when count(rank_ic) over w >= 4 then avg(rank_ic) over w end')} as rank_ic from {_ic('pr', 'prediction', 'target', 'date')} where n >= 5 window w as (order by date rows between 12 preceding and current row)", "pr"),
    "residual_labels": _with(f"select date, ticker, {_r('sf', 6)} as stock_forward_return, {_r('bf', 6)} as benchmark_forward_return, {_r('beta', 6)} as beta, {_r('target', 6)} as target from lab", "lab"),
    "technical_signals": _with("select date, ticker, " + ", ".join(f"{_r(s, 6)} as {s}, {_r(_pct(s, 'date'), 6)} as {s}_rank" for s in _SIG) + " from sg", "sg"),
    "combined_signal": _with(f"select date, ticker, {_r('c', 6)} as combined_signal, {_r(_pct('c', 'date'), 6)} as combined_signal_rank from (select *, (0.0 + short_horizon_reversal * 2.0 + low_risk * -1.0) / 3.0 as c from sg)", "sg"),
    "neutral_signal": _with(f""", g as (select date, ticker, -return_1d as x, beta, sector, count(*) over (partition by date) as n from fr where return_1d is not null and beta is not null and sector is not null),
g0 as (select *, x - avg(x) over (partition by date, sector) as x0, beta - avg(beta) over (partition by date, sector) as f0 from g where n > 2),
g1 as (select date, ticker, x0 - case when ff > 1e-20 * bb then xf / nullif(ff, 0) else 0 end * f0 as r from (select *, sum(f0 * f0) over (partition by date) as ff, sum(beta * beta) over (partition by date) as bb, sum(x0 * f0) over (partition by date) as xf from g0))
select date, ticker, {_r("r")} as signal_neutral from fr left join g1 using (date, ticker)""", "fr"),
    "neutral_two_factors": _with(f""", g as (select date, ticker, -return_1d as x, beta, volatility_20d as vol, sector, count(*) over (partition by date) as n from fr where return_1d is not null and beta is not null and volatility_20d is not null and sector is not null),
g0 as (select *, x - avg(x) over v as x0, beta - avg(beta) over v as f0, vol - avg(vol) over v as h0 from g where n > 3 window v as (partition by date, sector)),
g1 as (select *, x0 - case when ff > 1e-20 * bb then xf / nullif(ff, 0) else 0 end * f0 as x1, h0 - case when ff > 1e-20 * bb then hf / nullif(ff, 0) else 0 end * f0 as h1 from (
  select *, sum(f0 * f0) over w as ff, sum(beta * beta) over w as bb, sum(x0 * f0) over w as xf, sum(h0 * f0) over w as hf, sum(vol * vol) over w as vv from g0 window w as (partition by date))),
g2 as (select date, ticker, x1 - case when hh > 1e-20 * vv then xh / nullif(hh, 0) else 0 end * h1 as r from (select *, sum(h1 * h1) over w as hh, sum(x1 * h1) over w as xh from g1 window w as (partition by date)))
select date, ticker, {_r("r")} as signal_neutral from fr left join g2 using (date, ticker)""", "fr"),
    "attribution": _with(f""", a as (select date, {", ".join(f'product(1 + "{c}") over w - 1 as "{c}"' for c in _FACTORS)}, count(*) over w as n from fs window w as (order by date rows between 1 following and 5 following)),
j as (select net_return - RF as y, {", ".join(f'"{c}" as f{i}' for i, c in enumerate(_FACTORS[:-1]))} from nt join a using (date) where n = 5), {_LINES[0]} {_LINES[1]}""", "fs", "nt"),
    "market_attribution": _with(f""", a as (select date, product(1 + "Mkt-RF") over w - 1 as x, product(1 + RF) over w - 1 as rf, count(*) over w as n from fs window w as (order by date rows between 1 following and 5 following)),
j as (select net_return - rf as y, x from nt join a using (date) where n = 5), l as (select regr_intercept(y, x) as a, regr_slope(y, x) as b, count(*) as n from j),
e as (select stddev_samp(y - l.a - l.b * x) as s from j, l)
select * from (select 'observations' as metric, n::double as value from l union all select 'alpha_per_period', {_r("a")} from l union all select 'residual_volatility', {_r("s")} from e union all select 'beta_Mkt-RF', {_r("b")} from l)""", "fs", "nt"),
    "deflated_sharpe": _with(f"select {_r(_chance(4), 6)} as deflated_sharpe_probability from (select {_MOMENTS} from nt)", "nt"),
    "overfitting": _with(f""", g as (select date, {", ".join(f"round(avg(return_1d) filter (where (ascii(ticker) + ascii(ticker[2])) % 5 = {i}) + 1e-13, 9) as s{i}" for i in range(5))} from ft group by date),
o as (select *, row_number() over (order by date) - 1 as i, count(*) over () as n from g where {" and ".join(f"s{i} is not null" for i in range(5))}),
b as (select *, case when i < (n % 8) * (n // 8 + 1) then i // (n // 8 + 1) else n % 8 + (i - (n % 8) * (n // 8 + 1)) // (n // 8) end as b from o),
l as ({" union all ".join(f"select {i} as place, b, sum(s{i}) as s, count(*) as n from b group by b" for i in range(5))}),
c as (select m from (select unnest(range(0, 256)) as m) where bit_count(m::int) = 4),
x as (select m, place, sum(s) filter (where (m >> b) & 1 = 1) / sum(n) filter (where (m >> b) & 1 = 1) as a, sum(s) filter (where (m >> b) & 1 = 0) / sum(n) filter (where (m >> b) & 1 = 0) as z from c, l group by m, place),
r as (select *, row_number() over (partition by m order by a desc, place) as best, rank() over (partition by m order by z) + (count(*) over (partition by m, z) - 1) / 2.0 as rk from x)
select {_r("avg((rk / 5 <= 0.5)::int::double)")} as pbo from r where best = 1""", "ft"),
    "nested_ridge": _with("," + _NESTED + f"""select date, ticker, {_r("target")} as target, {_r("my + b1 * (coalesce(return_5d, m1) - a1) + b2 * (coalesce(volatility_20d, m2) - a2)")} as prediction, fd.fold::int as fold, name as selected_candidate
from ft join dx using (date) join fd on i >= t0 and i < t0 + 20 join ch using (fold) join co using (fold, name) where kind = 'outer'""", "fd", "ft"),
    "nested_selections": _with("," + _NESTED + f"""select fold::int as fold, min(date) as test_start, max(date) as test_end, any_value(name) as selected_candidate, {_r("any_value(light)")} as inner_rank_ic_light, {_r("any_value(heavy)")} as inner_rank_ic_heavy
from ch join fd using (fold) join dx on i >= t0 and i < t0 + 20 group by fold""", "fd", "ft"),
    "signal_evaluation": _with(f""", nt_s as (select signal, date, gross - turnover * 10 / 10000 as net_return, turnover from sm_s),
cv_s as (select *, equity / max(equity) over (partition by signal order by date) - 1 as drawdown from (select *, product(1 + net_return) over (partition by signal order by date rows unbounded preceding) as equity from nt_s)),
pf as (select signal, avg(turnover) as mean_turnover, product(1 + net_return) as last, stddev_samp(net_return) * sqrt(52) as vol, min(drawdown) as dd, count(*) as n from cv_s group by signal),
mo as (select signal, {_r(_chance(4), 6)} as chance from (select signal, {_MOMENTS} from nt_s group by signal)),
ic as (select signal, avg(pearson_ic) as p, avg(rank_ic) as r, avg(rank_ic) / nullif(stddev_samp(rank_ic), 0) as ir, avg(directional_accuracy) as d, sum(n)::bigint as o from {_ic("es", "prediction", "target", "signal", "date")} where n >= 5 group by signal)
select signal, 'evaluated' as status, chance as deflated_sharpe_probability, {_r("mean_turnover", 6)} as mean_turnover, {_r("pow(last, 52.0 / pf.n) - 1", 6)} as annualized_return, {_r("vol", 6)} as annualized_volatility,
  {_r("(pow(last, 52.0 / pf.n) - 1) / nullif(vol, 0)", 6)} as sharpe, {_r("dd", 6)} as maximum_drawdown, pf.n as periods, {_r("p", 6)} as mean_pearson_ic, {_r("r", 6)} as mean_rank_ic, {_r("ir", 6)} as rank_ic_ir, {_r("d", 6)} as directional_accuracy, o as observations
from pf join mo using (signal) join ic using (signal)""", "sm_s", "es"),
    "feature_coverage": _with(" union all ".join(f"select '{f}' as feature, {_r(f'avg(({f} is not null)::int::double)')} as coverage, count(*) filter (where {f} is null) as missing_count from ft" for f in RAW_FEATURES), "ft"),
    "feature_correlation": _with(" union all ".join(f"select '{a}' as feature_a, '{b}' as feature_b, {_r(_corr(a, b))} as correlation from ft where {a} is not null and {b} is not null"
        for a in RAW_FEATURES for b in RAW_FEATURES), "ft"),
    "feature_ics": _with(f", l as ({' union all '.join(f'''select date, '{f}' as feature, {f} as x, target from ft''' for f in RAW_FEATURES)}) select date, feature, {_r('pearson_ic')} as pearson_ic, {_r('rank_ic')} as rank_ic from {_ic('l', 'x', 'target', 'date', 'feature')} where n >= 5", "ft"),
    "daily_ics": _with(f"select date, {_r('pearson_ic')} as pearson_ic, {_r('rank_ic')} as rank_ic, {_r('directional_accuracy')} as directional_accuracy, n from {_ic('pr', 'prediction', 'target', 'date')} where n >= 5", "pr"),
    "prediction_summary": _with(f"select {_r('avg(pearson_ic)')} as mean_pearson_ic, {_r('avg(rank_ic)')} as mean_rank_ic, {_r('avg(rank_ic) / nullif(stddev_samp(rank_ic), 0)')} as rank_ic_ir, {_r('avg(directional_accuracy)')} as directional_accuracy, sum(n)::bigint as observations from {_ic('pr', 'prediction', 'target', 'date')} where n >= 5", "pr"),
    "signal_summary": _with(f""", l as ({_LONG(_SIG, "sg", "date, target")}), c as (select signal, avg((x is not null)::int::double) as coverage from l group by signal),
i as (select signal, avg(rank_ic) as rank_ic, avg(rank_ic) / nullif(stddev_samp(rank_ic), 0) as ir, count(*) as n from {_ic("l", "x", "target", "signal", "date")} where n >= 5 group by signal)
select signal, {_r("coverage")} as coverage, {_r("rank_ic")} as rank_ic, {_r("ir")} as rank_ic_ir, coalesce(n, 0) as ic_days from c left join i using (signal)""", "sg"),
    "signal_correlation": _with(f""", l as ({" union all ".join(f"select '{a}' as signal_a, '{b}' as signal_b, date, {a} as x, {b} as y from sg" for a in _SIG for b in _SIG)})
select signal_a, signal_b, {_r("avg(rank_ic)")} as correlation from {_ic("l", "x", "y", "signal_a", "signal_b", "date")} group by signal_a, signal_b""", "sg"),
    "signal_decay": _with(f""", l as ({" union all ".join(f"select '{s}' as signal, {h} as horizon_days, date, {s} as x, {t} as y from sg" for s in _SIG for h, t in ((5, "target"), (10, "target_10d")))})
select signal, horizon_days, {_r("avg(rank_ic)")} as rank_ic, count(*) as ic_days from {_ic("l", "x", "y", "signal", "horizon_days", "date")} where n >= 5 group by 1, 2""", "sg"),
    **{name: _with(f""", l as ({_LONG(_SIG, "sg", f"date, {group}, target")})
select signal, {out}, {_r("avg(rank_ic)")} as mean_rank_ic, {_r("avg(rank_ic) / nullif(stddev_samp(rank_ic), 0)")} as rank_ic_ir, count(*) as ic_observations from {_ic("l", "x", "target", "signal", out, "date")} where n >= {least} and {out} is not null group by signal, {out}""", "sg")
        for name, group, out, least in (("signal_stability", "sector", "sector", 3), ("signal_years", "year(date)::int as year", "year", 5))},
    "neutral_portfolio": _with(f"select date, ticker, {_r('prediction')} as prediction, {_r('weight')} as weight from bk", "bk"),
    "exposures": _with(f"""select date, {_r("sum(g)")} as gross, {_r("sum(n)")} as net, {_r("sum(b)")} as beta, {_r("max(abs(n))")} as max_abs_sector_exposure
        from (select date, sector, sum(abs(weight)) as g, sum(weight) as n, sum(weight * beta) as b from bk group by date, sector) group by date""", "bk"),
    "turnover": _with(f""", t as (select bk.*, k3 from bk join (select date, row_number() over (order by date) as k3 from (select distinct date from bk)) using (date))
select d.date, {_r("sum(m / 2)")} as turnover from (select coalesce(a.k3, b.k3 + 1) as k3, abs(coalesce(a.weight, 0) - coalesce(b.weight, 0)) as m from t a full join t b on a.k3 = b.k3 + 1 and a.ticker = b.ticker) x
join (select distinct k3, date from t) d using (k3) group by d.date""", "bk"),
    "flat_backtest": _with(f"""select date, {_r("gross")} as gross_return, {_r("gross - turnover / 1000 - short_weight * 0.005 / 52")} as net_return, {_r("long_leg")} as long_leg_return, {_r("short_leg")} as short_leg_return, {_r("turnover")} as turnover,
        {_r("turnover / 1000")} as trading_cost, {_r("short_weight * 0.005 / 52")} as borrow_cost, {_r("turnover / 1000 + short_weight * 0.005 / 52")} as transaction_cost, n as n_positions from sm""", "sm"),
    "liquidity_backtest": _with(f"""select date, {_r("gross")} as gross_return, {_r("gross - cost")} as net_return, {_r("long_leg")} as long_leg_return, {_r("short_leg")} as short_leg_return, {_r("turnover")} as turnover,
        {_r("cost")} as trading_cost, {_r("0.0 * cost")} as borrow_cost, {_r("cost")} as transaction_cost, n as n_positions from (select *, turnover * 2 / 10000 + 0.1 * sqrt(1e7) * impact as cost from sm)""", "sm"),
    "cost_grid": _with(f""", g as (select *, turnover * b / 10000 + 0.1 * sqrt(v) * impact as cost from sm, (select unnest([2.0, 10.0])::double as b), (select unnest([1e6, 1e8])::double as v)),
e as (select *, product(1 + net) over (partition by b, v order by date rows unbounded preceding) as eq from (select *, gross - cost as net from g)),
f as (select *, eq / max(eq) over (partition by b, v order by date) - 1 as dd from e),
h as (select b, v, avg(turnover) as mt, avg(cost) as mc, product(1 + net) as last, stddev_samp(net) * sqrt(52) as vol, min(dd) as dd, count(*) as n from f group by b, v)
select b as cost_assumption_bps, v as portfolio_notional, {_r("mt", 6)} as mean_turnover, {_r("mc", 6)} as mean_trading_cost, {_r("pow(last, 52.0 / n) - 1", 6)} as annualized_return, {_r("vol", 6)} as annualized_volatility,
  {_r("(pow(last, 52.0 / n) - 1) / nullif(vol, 0)", 6)} as sharpe, {_r("dd", 6)} as maximum_drawdown, n as periods, 'liquidity' as cost_model, 'half_spread' as cost_assumption_type from h""", "sm"),
    "performance": _with(f"select {_r('pow(last, 52.0 / n) - 1', 6)} as annualized_return, {_r('vol', 6)} as annualized_volatility, {_r('(pow(last, 52.0 / n) - 1) / nullif(vol, 0)', 6)} as sharpe, {_r('dd', 6)} as maximum_drawdown, n as periods from ({_PERF})", "cv"),
    "regimes": _with(f"select strftime(date, '%Y-%m') as regime, count(*) as observations, {_r('avg(net_return)')} as mean_return, {_r('stddev_samp(net_return)')} as volatility, {_r('avg(net_return) / nullif(stddev_samp(net_return), 0)')} as sharpe_per_period from nt group by 1", "nt"),
    "monthly_equity": _with(f"select last_day(date) as month_end, {_r('arg_max(equity, date)')} as equity from cv group by 1", "cv"),
    "rebalance_dates": "select max(d) as date from (select o_orderdate::date as d from orders) where d is not null group by d + ((12 - isodow(d)) % 7)::int",
    "business_days": f"select filed, {', '.join(f'({_business(n)})::date as plus_{n}' for n in (0, 1, 3))} from (select distinct filed_date::date as filed from fundamental_facts)",
    "prediction_ranks": f"""with b as (select date, t, case when not isnan(prediction) then prediction + 0.0 end as p from (
  select run_id, date, {TICKER} as t, prediction, row_number() over (partition by run_id, date, {TICKER} order by scored_at desc nulls last, isnan(prediction) desc, prediction desc nulls last) as rn from predictions) where rn = 1),
m as (select date, t as ticker, round(avg(p) + 1e-12, 9) as score from b group by date, t)
select date, ticker, {_r("score")} as score, {_r(_pct("score", "date"))} as score_rank from m""",
    "holding_factors": _with(f""", a as (select date, count(*) over w as n, {", ".join(f'product(1 + "{c}") over w - 1 as "{c}"' for c in _FACTORS)} from fs window w as (order by date rows between 1 following and 5 following))
select date, {", ".join(f'{_r(chr(34) + c + chr(34), 6)} as "{c}"' for c in _FACTORS)} from a where n = 5 and date in (select date from wk)""", "fs", "wk"),
    "ridge_one_feature": _with("," + _ridge("0"), "fd", "ft"),
    "ridge_rolling": _with("," + _ridge("hi - 80"), "fd", "ft"),
    "json_tickers": f"select {TICKER} as ticker, max(cik) as cik from panel where cik is not null and ticker is not null group by 1",
}

_COMPANY_FACTS = f"""with r as (select distinct cik, feature, value, report_end, filed_date as filed, form, source_tag, accession from fundamental_facts where value is not null and filed_date is not null and report_end is not null),
f as (select cik, feature, value, report_end, ({_business(1)})::date as available_date, filed as filed_date, form, source_tag, accession from r where form in ('10-K', '10-Q')),
o as (select *, row_number() over (partition by cik, feature, available_date, report_end order by filed_date desc, form desc, report_end desc, value desc, accession desc) as rn from f)
select cik, feature, value, report_end, available_date, filed_date, form, source_tag from o where rn = 1"""
ORACLE["json_facts"] = _COMPANY_FACTS
