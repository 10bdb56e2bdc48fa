"""Small charts and summaries of finished runs, rendered on the driver from results of a row per period."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from html import escape
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import rolling
from tidemark.operators.backtest import monthly_last
from tidemark.operators.metrics import equity_curve

WIDTH, HEIGHT, MARGIN = 720, 300, 48
INK, GRID, COLOURS = "#333333", "#dddddd", ("#1b6ca8", "#c8553d", "#3a7d44", "#7a5195")
#: A chart holds at most so many points per line; results of a row per period stay below it or are refused.
MAX_POINTS = 50_000


def percent(x: float | None, digits: int = 2) -> str:
    """A share as text."""
    return "n/a" if x is None or x != x else f"{100 * x:.{digits}f}%"


def round_ticks(low: float, high: float, about: int = 4) -> list[float]:
    """Multiples of 1, 2 or 5 times a power of ten within [low, high], about as many as asked."""
    raw = (high - low) / about
    unit = 10.0 ** math.floor(math.log10(raw))
    step = next(m * unit for m in (1, 2, 5, 10) if m * unit >= raw * (1 - 1e-9))
    return [k * step for k in range(math.ceil(low / step - 1e-9), math.floor(high / step + 1e-9) + 1)]


def place(values: Sequence[float], span: tuple[float, float], edges: tuple[float, float]) -> list[float]:
    """Positions of values between the edges, ``span`` being what the edges stand for; an empty span is widened, so its value is in the middle."""
    low, high = span if span[1] > span[0] else (span[0] - 0.5, span[0] + 0.5)
    return [float(x) for x in edges[0] + (np.asarray(values, float) - low) * ((edges[1] - edges[0]) / (high - low))]


def line_chart(title: str, labels: Sequence[str], lines: Mapping[str, Sequence[float | None]]) -> str:
    """An SVG of lines over common labels; a missing value breaks no line. Each line carries its name for pages that show and hide it."""
    every = [v for line in lines.values() for v in line if v is not None]
    body = [f'<text x="{WIDTH / 2}" y="20" text-anchor="middle" fill="{INK}">{escape(title)}</text>']
    if every and labels:
        span = (min(every), max(every))
        across, down = (MARGIN, WIDTH - MARGIN), (HEIGHT - MARGIN, MARGIN)
        ticks = round_ticks(*span) if span[1] > span[0] else [span[0]]
        for tick, y in zip(ticks, place(ticks, span, down), strict=True):
            body.append(f'<path d="M{across[0]} {y:.1f}H{across[1]}" stroke="{GRID}"/><text x="{across[0] - 4}" y="{y:.1f}" text-anchor="end" font-size="10" fill="{INK}">{tick:.4g}</text>')
        xs = place(range(len(labels)), (0, len(labels) - 1), across)
        for k, (name, line) in enumerate(lines.items()):
            shown = [(x, v) for x, v in zip(xs, line, strict=True) if v is not None]
            points = " ".join(f"{x:.1f},{y:.1f}" for (x, _), y in zip(shown, place([v for _, v in shown], span, down), strict=True))
            colour = COLOURS[k % len(COLOURS)]
            body.append(f'<g data-line="{escape(name, True)}"><polyline fill="none" stroke="{colour}" stroke-width="1.5" points="{points}"/><text x="{across[1]}" y="{36 + 14 * k}" text-anchor="end" font-size="11" fill="{colour}">{escape(name)}</text></g>')
        for i in dict.fromkeys((0, len(labels) - 1)):
            body.append(f'<text x="{xs[i]:.1f}" y="{HEIGHT - MARGIN + 16}" text-anchor="middle" font-size="10" fill="{INK}">{escape(labels[i])}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {HEIGHT}" font-family="sans-serif">{"".join(body)}</svg>'


def bar_chart(title: str, bars: Mapping[str, float]) -> str:
    """An SVG of one bar per name, from zero."""
    top, low = max([0.0, *bars.values()]), min([0.0, *bars.values()])
    reach = (top - low) or 1.0
    y = lambda v: HEIGHT - MARGIN - (v - low) / reach * (HEIGHT - 2 * MARGIN)
    step = (WIDTH - 2 * MARGIN) / max(len(bars), 1)
    body = [f'<text x="{WIDTH / 2}" y="20" text-anchor="middle" fill="{INK}">{escape(title)}</text>']
    for i, (name, v) in enumerate(bars.items()):
        x = MARGIN + i * step
        body.append(f'<rect x="{x + step * 0.15:.1f}" width="{step * 0.7:.1f}" y="{min(y(v), y(0)):.1f}" height="{abs(y(v) - y(0)):.1f}" fill="{COLOURS[0 if v >= 0 else 1]}"/>')
        body.append(f'<text x="{x + step / 2:.1f}" y="{HEIGHT - MARGIN + 16}" text-anchor="middle" font-size="10" fill="{INK}">{escape(name)}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {HEIGHT}" font-family="sans-serif">{"".join(body)}</svg>'


def held(df: DataFrame, order: str) -> list:
    """A result of a row per period as driver rows; refuses more than a chart can hold."""
    rows = df.orderBy(order).limit(MAX_POINTS + 1).collect()
    if len(rows) > MAX_POINTS:
        raise ValueError("too many periods for a chart")
    return rows


def rolling_ic(daily: DataFrame, weeks: int = 13, least: int = 4) -> DataFrame:
    """(date, rank_ic) averaged over the last rows of a series of one row per date."""
    one = daily.withColumn("series", F.lit(0))
    return one.select("date", rolling(F.avg, F.col("rank_ic"), weeks, least, "series", "date").alias("rank_ic"))


def write_report(folder: str, backtest: DataFrame, daily_ic: DataFrame, summary: Mapping[str, float | None], costs: Mapping[str, float] | None = None) -> list[str]:
    """Charts (SVG), ``report.md`` and ``report.html`` of one run; the files' names."""
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    curve = held(equity_curve(backtest, "net_return").select("date", "equity", "drawdown"), "date")
    monthly = held(monthly_last(equity_curve(backtest, "net_return"), "equity"), "month_end")
    ics = [r for r in held(rolling_ic(daily_ic), "date") if r["rank_ic"] is not None]
    charts = {
        "equity.svg": line_chart("Net equity", [str(r["date"]) for r in curve], {"equity": [r["equity"] for r in curve]}),
        "drawdown.svg": line_chart("Drawdown", [str(r["date"]) for r in curve], {"drawdown": [r["drawdown"] for r in curve]}),
        "rank_ic.svg": line_chart("Rolling rank correlation", [str(r["date"]) for r in ics], {"rank_ic": [r["rank_ic"] for r in ics]}),
    }
    if costs:
        charts["costs.svg"] = bar_chart("Ratio of return to volatility by cost", costs)
    for name, svg in charts.items():
        (target / name).write_text(svg, encoding="utf-8")
    share = {"annualized_return", "annualized_volatility", "maximum_drawdown", "directional_accuracy"}
    lines = [(k, percent(v) if k in share else "n/a" if v is None else f"{v:.4g}") for k, v in summary.items()]
    table = "\n".join(["| metric | value |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in lines)])
    months = "\n".join(["| month end | equity |", "| --- | --- |", *(f"| {r['month_end']} | {r['equity']:.4f} |" for r in monthly)])
    (target / "report.md").write_text("# Run\n\n" + table + "\n\n" + months + "\n\n" + "\n".join(f"![{n}]({n})" for n in charts) + "\n", encoding="utf-8")
    rows = "".join(f"<tr><td>{escape(k)}</td><td>{escape(v)}</td></tr>" for k, v in lines)
    (target / "report.html").write_text(f"<!doctype html><meta charset='utf-8'><title>Run</title><table>{rows}</table>{''.join(charts.values())}", encoding="utf-8")
    return [*charts, "report.md", "report.html"]


Run = tuple[DataFrame, DataFrame, Mapping[str, float | None]]
# Shows a run's lines and table column only while its box is ticked.
TOGGLE = "document.querySelectorAll('input[data-run]').forEach(b=>b.addEventListener('change',()=>document.querySelectorAll('[data-line=\"'+b.dataset.run+'\"]').forEach(e=>{e.style.display=b.checked?'':'none'})))"


def write_comparison(folder: str, runs: Mapping[str, Run]) -> list[str]:
    """Several runs, each (backtest, daily_ic, summary), over common dates: charts (SVG), ``comparison.md`` and an interactive ``comparison.html``; the files' names."""
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    curves = {name: {str(r["date"]): r["equity"] for r in held(equity_curve(tested, "net_return").select("date", "equity"), "date")} for name, (tested, _, _) in runs.items()}
    ics = {name: {str(r["date"]): r["rank_ic"] for r in held(rolling_ic(daily), "date")} for name, (_, daily, _) in runs.items()}
    charts = {}
    for file, title, series in (("equity.svg", "Net equity", curves), ("rank_ic.svg", "Rolling rank correlation", ics)):
        dates = sorted({d for one in series.values() for d in one})
        charts[file] = line_chart(title, dates, {name: [one.get(d) for d in dates] for name, one in series.items()})
        (target / file).write_text(charts[file], encoding="utf-8")
    metrics = list(dict.fromkeys(k for _, _, summary in runs.values() for k in summary))
    cell = lambda summary, k: "n/a" if summary.get(k) is None else f"{float(summary[k]):.4g}"
    head = ["metric", *runs]
    rows = [[k, *(cell(summary, k) for _, _, summary in runs.values())] for k in metrics]
    table = "\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * len(head), *rows])
    (target / "comparison.md").write_text("# Runs\n\n" + table + "\n\n" + "\n".join(f"![{n}]({n})" for n in charts) + "\n", encoding="utf-8")
    boxes = "".join(f'<label><input type="checkbox" checked data-run="{escape(n, True)}"> {escape(n)}</label> ' for n in runs)
    lines = "".join("<tr>" + "".join(f"<td{'' if i == 0 else f' data-line={chr(34)}{escape(head[i], True)}{chr(34)}'}>{escape(c)}</td>" for i, c in enumerate(r)) + "</tr>" for r in [head, *rows])
    (target / "comparison.html").write_text(f"<!doctype html><meta charset='utf-8'><title>Runs</title>{boxes}<table>{lines}</table>{''.join(charts.values())}<script>{TOGGLE}</script>", encoding="utf-8")
    return [*charts, "comparison.md", "comparison.html"]
