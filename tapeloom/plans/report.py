"""Reports as Markdown: a backtest, and a scan. Only summary rows, counters and a few trades come to the driver."""

from __future__ import annotations

import math
from collections.abc import Iterable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import ordered, run_counters, summarize, top_trades
from ..schema import StopRule

if TYPE_CHECKING:
    from .backtest import Result


def number(x: float | None, form: str = ".2f") -> str:
    """A cell; a dash for what isn't there."""
    if x is None or math.isnan(x):
        return "–"
    return "∞" if x == math.inf else format(x, form)


def table(head: list[str], rows: Iterable[list[str]]) -> list[str]:
    """A Markdown table, all but its first column to the right."""
    line = lambda cells: "| " + " | ".join(c.replace("|", "/") for c in cells) + " |"
    return [line(head), "|" + "|".join([" :- ", *[" -: "] * (len(head) - 1)]) + "|", *map(line, rows), ""]


def stop_text(stop: StopRule) -> str:
    """How a trade may end early, in words; empty without a stop."""
    ways = []
    if stop.sma > 0 and stop.trail:
        ways.append(f"{'price touches' if stop.intraday else 'the close passes'} the extreme of the last session that closed through its {stop.sma}-session average")
    elif stop.sma > 0:
        ways.append(f"the close passes its {stop.sma}-session average")
    if stop.max_loss_pct > 0:
        ways.append(f"price touches a level {stop.max_loss_pct:g} % against the entry")
    return " or ".join(ways)


def _facts(result: Result, counters: dict, total: dict | None) -> list[str]:
    config = result.config
    day = lambda x: f"{x:%Y-%m-%d}" if x else "–"
    facts = [
        ("Tokens", f"{counters['universe']:,}, of which {counters['replayed']:,} had enough bars and {counters['skipped']:,} too few"),
        ("Bars", f"{day(counters['data_start'])} to {day(counters['data_end'])}; {counters['sessions']:,} sessions evaluated"),
        ("Signals", f"{total['signals']:,} ({total['longs']:,} long, {total['shorts']:,} short), {day(counters['first_signal'])} to {day(counters['last_signal'])}" if total else "none"),
        ("Costs", f"{config.cost_bps:g} basis points a trade, taken off each return"),
    ]
    if config.max_move_pct > 0:
        facts.append(("Outliers", f"{counters['outliers']:,} legs beyond ±{config.max_move_pct:g} % left out"))
    if config.cooldown > 0:
        facts.append(("Cooldown", f"{config.cooldown} sessions for each token and signal"))
    return [*(f"- {name}: {text}" for name, text in facts), *(f"- {n}" for n in result.notes), ""]


def render(result: Result, primary: str, top: int = 10, min_signals: int = 1, by_direction: bool = True, by_year: bool = True) -> str:
    """The report of a run. ``primary`` is the horizon that groups and trades are ordered by."""
    horizons = result.config.horizons
    counters = run_counters(result.candles, result.legs, result.strategy.warmup).first().asDict()
    rows = [r.asDict() for r in ordered(summarize(result.legs), primary).collect()]
    by = {(r["group_type"], r["group"], r["horizon"]): r for r in rows}
    whole = {h.label: by.get(("overall", "ALL SIGNALS", h.label)) for h in horizons}
    out = [f"# {result.strategy.name}: what followed its signals", "", *_facts(result, counters, whole[horizons[0].label])]
    if not rows:
        return "\n".join([*out, "Nothing to measure: no signal in the chosen tokens and dates.", ""])

    seen = [(h, r) for h in horizons if (r := whole[h.label])["n"]]
    short = [h.label for h in horizons if not whole[h.label]["n"]]
    out += ["## Returns by horizon", ""]
    parts = {"won %": "win_pct", "mean %": "avg_pct", "median %": "median_pct", "mean win %": "avg_win_pct", "mean loss %": "avg_loss_pct", "profit factor": "profit_factor", "payoff": "payoff_ratio", "Sharpe": "sharpe", "best %": "best_pct", "worst %": "worst_pct", "up to %": "avg_mfe_pct", "down to %": "avg_mae_pct"}
    out += table(["horizon", "legs", *parts], ([f"{h.label} ({h.days} sessions)", f"{r['n']:,}", *(number(r[c]) for c in parts.values())] for h, r in seen))
    if short:
        out += [f"The data end before a signal is as old as {', '.join(short)}.", ""]

    for kind, title, on in (("signal", "By signal", True), ("direction", "By side", by_direction), ("year", "By year", by_year)):
        groups = list(dict.fromkeys(r["group"] for r in rows if r["group_type"] == kind)) if on else []
        shown = [g for g in groups if by[kind, g, horizons[0].label]["signals"] >= (min_signals if kind == "signal" else 1)]
        if not groups:
            continue
        out += [f"## {title}", ""]
        cells = lambda r: [f"{r['n']:,}", number(r["win_pct"]), number(r["avg_pct"])] if r["n"] else ["–"] * 3
        out += table(["group", "signals", *(f"{h.label} {c}" for h in horizons for c in ("legs", "won %", "mean %"))], ([g, f"{by[kind, g, horizons[0].label]['signals']:,}", *(c for h in horizons for c in cells(by[kind, g, h.label]))] for g in shown))
        if len(shown) < len(groups):
            out += [f"Not shown: {len(groups) - len(shown)} with fewer than {min_signals} signals.", ""]

    for best in (True, False) if top > 0 else ():
        found = top_trades(result.legs, primary, top, best).collect()
        if found:
            out += [f"## {'Best' if best else 'Worst'} of {primary}", ""]
            name = lambda r: r["symbol"] if "symbol" in r else f"T{r['token']}"
            out += table(["token", "side", "in", "at", "out", "at", "return %", "signal"], ([name(r), r["direction"].lower(), f"{r['date']:%Y-%m-%d}", number(r["entry_price"]), f"{r['exit_date']:%Y-%m-%d}", number(r["exit_price"]), number(r["return_pct"]), r["variant"]] for r in found))
    return "\n".join([*out, *_closing(result, primary, whole[primary])])


def _closing(result: Result, primary: str, r: dict) -> list[str]:
    """The outcome at the primary horizon, and what the figures leave out."""
    out = ["## Outcome", ""]
    if r["n"]:
        out.append(f"{r['n']:,} legs ended within {primary}: {number(r['win_pct'])} % of them gained, {number(r['avg_pct'])} % on average and {number(r['median_pct'])} % in the middle (profit factor {number(r['profit_factor'])}, payoff {number(r['payoff_ratio'])}, Sharpe {number(r['sharpe'])} a trade).")
    else:
        out.append(f"No leg of {primary} has ended yet.")
    stop = stop_text(result.config.stop)
    ends = f"at the horizon's close, or before it when {stop}" if stop else "at the horizon's close, with no stop"
    return [
        *out, "",
        f"- A trade begins at the close of its signal's session and ends {ends}. Sizes, targets and compounding are not modelled.",
        "- Every signal counts. Alerts are one a day for each token and strategy, and fire on running bars, so real entries are fewer and at other prices.",
        "- Tokens that were removed from the store have no trades here, which favours survivors. Splits are as the source has them.", "",
    ]


def scan_text(found: DataFrame, scanned: int, skipped: int) -> str:
    """A scan's tokens as a table, by symbol; ``scanned`` and ``skipped`` are counted by the caller."""
    columns = {"close": "close", "conversion": "conversion", "base": "base", "cloud top": "cloud_top", "cloud bottom": "cloud_bottom", "opened at": "open", "closed before at": "prev_close"}
    rows = found.orderBy("symbol", "date").select("symbol", *(F.col(c) for c in columns.values()), "scenario").collect()
    head = f"{len(rows)} of {scanned} tokens meet the rule; {skipped} have too few bars."
    if not rows:
        return f"{head}\n"
    return "\n".join([head, "", *table(["symbol", *columns, "scenario"], ([r["symbol"], *(number(r[c]) for c in columns.values()), r["scenario"]] for r in rows))])
