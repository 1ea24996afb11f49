"""Strategies: rules over indicator columns, first match wins.

A strategy is a name, a warm-up and a function from candles to candles with
``idx`` (the 0-based session) and ``variant`` (null where nothing fires).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import folds
from ..functions import recurrences as rec
from ..functions.indicators import ICHIMOKU_BARS, MIDPOINTS, by_bar, gathered, session_index, with_hilega, with_ichimoku, with_mtf_rsi
from ..schema import LONG, SHORT, Horizon


@dataclass(frozen=True)
class Strategy:
    name: str
    warmup: int
    rules: Callable[[DataFrame], DataFrame]
    #: The same rules over a batch's gathered bars, with dates in a zone: each bar's number of a variant, and their names (``folds.found``).
    folded: Callable[[folds.Bars, str], tuple[np.ndarray, list[str]]] | None = None


def ichimoku_conditions(c: Callable[[str], Column | folds.Reading]) -> dict[str, Column | np.ndarray]:
    """Each variant's rule over a bar's lines, as columns or as readings, the first that is met first."""
    close, base, conversion, prev = c("close"), c("base"), c("conversion"), c("prev_close")
    above = (close > c("cloud_top")) & (close > c("high_26")) & (conversion >= base) & (close > conversion) & (close > c("cloud_top_52"))
    below = (base > conversion) & (conversion > close) & (c("cloud_bottom_52") > close) & (close < c("low_26")) & (close < c("cloud_bottom"))
    breaks_up = ((c("open") <= c("cloud_top")) & (close > c("cloud_top"))) | ((prev <= c("cloud_top")) & (c("open") > c("cloud_top")))
    breaks_down = ((c("open") >= c("cloud_bottom")) & (close < c("cloud_bottom"))) | ((prev >= c("cloud_bottom")) & (c("open") < c("cloud_bottom")))
    past, past_prev = c("past_conversion"), c("past_prev_conversion")
    name = "IchimokuKinkoHyo"
    return {
        f"{name} (BUY)": above & breaks_up,
        f"{name} (BUY) 1A": above & (prev < c("high_27")),
        f"{name} (BUY) Gold Cross": (c("prev_base") >= c("prev_conversion")) & (base < conversion) & (close > c("high_26")) & (close > past) & (close > conversion),
        f"{name} (BUY) Gold Cross A": (conversion >= base) & (close > c("high_26")) & (close > conversion) & (prev < past_prev) & (close > past),
        f"{name} (SELL)": breaks_down & below,
        f"{name} (SELL) 1A": below & (prev > c("low_27")),
        f"{name} (SELL) Death Cross": (c("prev_conversion") >= c("prev_base")) & (base > conversion) & (conversion > close) & (close < c("low_26")) & (past > close),
        f"{name} (SELL) Death Cross A": (prev >= past_prev) & (close < past) & (conversion > close) & (base > conversion),
    }


def ichimoku_variant() -> Column:
    """The first Ichimoku rule that a bar's lines meet, or null."""
    return _first_met(ichimoku_conditions(F.col))


def _first_met(rules: dict[str, Column]) -> Column:
    return F.coalesce(*(F.when(rule, name) for name, rule in rules.items()))


def _numbered(rules: dict[str, np.ndarray]) -> tuple[np.ndarray, list[str]]:
    """The number (from 1) of the first rule that each bar meets, and the rules' names."""
    return np.select(list(rules.values()), range(1, len(rules) + 1), 0), list(rules)


def ichimoku_folded(bars: folds.Bars, zone: str) -> tuple[np.ndarray, list[str]]:
    lines = {k: folds.Reading(v) for k, v in folds.ichimoku_lines(bars, MIDPOINTS, ICHIMOKU_BARS - 1).items()}
    return _numbered(ichimoku_conditions(lines.__getitem__))


def ichimoku_rules(candles: DataFrame, live: bool = False) -> DataFrame:
    return with_ichimoku(candles, live).withColumn("variant", ichimoku_variant())



@dataclass(frozen=True)
class Band:
    """A turn up: yesterday's RSI within ``[low, high]``, today's higher and above ``level``."""

    low: float
    high: float
    level: float


GFS, ADVANCED_GFS = Band(37, 44, 40), Band(57, 63, 60)


def turned_up(prev: Column, now: Column, band: Band) -> Column:
    return prev.between(band.low, band.high) & (now > prev) & (now > band.level)


def gfs_conditions(prev, rsi, weekly, monthly, mtf_level: float = 60.0) -> dict[str, Column | np.ndarray]:
    """Each turn-up's rule, over columns or readings."""
    confirmed = (weekly > mtf_level) & (monthly > mtf_level)
    return {"RSI (Advanced GFS)": turned_up(prev, rsi, ADVANCED_GFS) & confirmed, "RSI (GFS)": turned_up(prev, rsi, GFS) & confirmed}


def gfs_variant(prev: Column, rsi: Column, weekly: Column, monthly: Column, mtf_level: float = 60.0) -> Column:
    """The turn-up that a bar makes, confirmed by both coarser readings, or null."""
    return _first_met(gfs_conditions(prev, rsi, weekly, monthly, mtf_level))


def gfs_folded(bars: folds.Bars, zone: str) -> tuple[np.ndarray, list[str]]:
    lines = {k: folds.Reading(v) for k, v in folds.mtf_lines(bars, zone).items()}
    return _numbered(gfs_conditions(*(lines[k] for k in ("was_rsi", "rsi", "rsi_weekly", "rsi_monthly"))))


def gfs_rules(period: int = 14, mtf_level: float = 60.0) -> Callable[[DataFrame], DataFrame]:
    """A daily RSI turn-up, confirmed by weekly and monthly RSI above ``mtf_level``."""

    def rules(candles: DataFrame) -> DataFrame:
        rows = with_mtf_rsi(candles, period).withColumns({"idx": session_index(), "prev_rsi": F.lag("rsi", 1).over(by_bar())})
        return rows.withColumn("variant", gfs_variant(F.col("prev_rsi"), F.col("rsi"), F.col("rsi_weekly"), F.col("rsi_monthly"), mtf_level))

    return rules


def tier_conditions(rsi, ema, wma, prev_wma, buy: float = 55.0, sell: float = 48.0, mid: float = 50.0) -> dict[str, Column | np.ndarray]:
    """Each tier's rule, over columns or readings."""
    up = (rsi > buy) & (ema < rsi) & (wma < ema) & (wma > prev_wma)
    down = (rsi < sell) & (ema > rsi) & (wma > ema) & (wma < prev_wma)
    return {"BUY-2": up & (wma > mid), "BUY-1": up, "SELL-2": down & (wma < mid), "SELL-1": down}


def tier(rsi: Column, ema: Column, wma: Column, prev_wma: Column, buy: float = 55.0, sell: float = 48.0, mid: float = 50.0) -> Column:
    """The tier that a bar is in, or null: buying tiers need a rising, stacked set of lines above ``buy``, selling ones the mirror."""
    return _first_met(tier_conditions(rsi, ema, wma, prev_wma, buy, sell, mid))


def hilega_folded(bars: folds.Bars, zone: str, long_only: bool = False) -> tuple[np.ndarray, list[str]]:
    lines = {k: folds.Reading(v) for k, v in folds.hilega_lines(bars).items()}
    now, names = _numbered(tier_conditions(*(lines[k] for k in ("rsi", "ema", "wma", "was_wma"))))
    before, _ = _numbered(tier_conditions(*(lines[k] for k in ("was_rsi", "was_ema", "was_wma", "past_wma"))))
    fires = (now != before) & lines["past_wma"].ok & ((now <= 2) | (not long_only))
    return np.where(fires, now, 0), [f"HilegaMilega ({n})" for n in names]


def hilega_variant(tier: Column, before: Column, past_wma: Column, long_only: bool = False) -> Column:
    """A signal where the tier is one and differs from the bar before, whose own weighted average had one before it (``past_wma``)."""
    edge = tier.isNotNull() & ~tier.eqNullSafe(before) & past_wma.isNotNull()
    return F.when(edge & tier.startswith("BUY") if long_only else edge, F.format_string("HilegaMilega (%s)", tier))


def hilega_rules(long_only: bool = False) -> Callable[[DataFrame], DataFrame]:
    """A signal where the tier is one and differs from the bar before; ``long_only`` drops selling tiers after that test."""

    def rules(candles: DataFrame) -> DataFrame:
        rows = with_hilega(candles).withColumns({"idx": session_index(), "__w": F.lag("wma", 1).over(by_bar()), "__w2": F.lag("wma", 2).over(by_bar())})
        rows = rows.withColumn("tier", tier(F.col("rsi"), F.col("ema"), F.col("wma"), F.col("__w")))
        return rows.withColumn("variant", hilega_variant(F.col("tier"), F.lag("tier", 1).over(by_bar()), F.col("__w2"), long_only)).drop("__w", "__w2")

    return rules


STRATEGIES: dict[str, Strategy] = {
    "ichimoku": Strategy("IchimokuKinkoHyo", 110, ichimoku_rules, ichimoku_folded),
    "rsi": Strategy("RSI", 18, gfs_rules(), gfs_folded),
    "hilega": Strategy("HilegaMilega", 60, hilega_rules(), hilega_folded),
    "hilega-long": Strategy("HilegaMilega", 60, hilega_rules(long_only=True), partial(hilega_folded, long_only=True)),
}
#: As bars are evaluated during the session: the previous lines reach one bar further back.
LIVE_ICHIMOKU = Strategy("IchimokuKinkoHyo", 110, partial(ichimoku_rules, live=True))


def register(name: str, strategy: Strategy) -> None:
    STRATEGIES[name] = strategy


def resolve(names: str) -> list[Strategy]:
    """Strategies by comma-separated name; ``all`` stands for all but the long-only one, whatever else is listed."""
    wanted = [n.strip().lower() for n in names.split(",") if n.strip()]
    if "all" in wanted:
        wanted = [n for n in STRATEGIES if n != "hilega-long"]
    if not wanted or any(n not in STRATEGIES for n in wanted):
        raise ValueError(f"unknown strategy in {names!r}; there are {sorted(STRATEGIES)}")
    return [STRATEGIES[n] for n in wanted]


def direction(variant: Column) -> Column:
    return F.when(F.upper(variant).rlike("SELL|BEARISH|DEATH|SHORT"), SHORT).otherwise(LONG)


def evaluated(candles: DataFrame, strategy: Strategy) -> DataFrame:
    """A strategy's ``variant`` for every bar, and ``idx``.

    The session is numbered after the rules. It costs no shuffle or sort, and it
    keeps filters on ``variant`` above a window: pushed through the dozen derived
    lines that the rules read, such a filter makes the optimizer's inferred
    constraints double with each line.
    """
    return strategy.rules(candles).withColumn("idx", session_index())


def fired(candles: DataFrame, strategy: Strategy, keep: list[str] | None = None) -> DataFrame:
    """A strategy's signals: past its warm-up, with direction and entry (the close)."""
    rows = evaluated(candles, strategy).where(F.col("variant").isNotNull() & (F.col("idx") >= strategy.warmup))
    return rows.select("token", "date", F.col("idx").cast("int").alias("session_idx"), F.lit(strategy.name).alias("strategy"), "variant", direction(F.col("variant")).alias("direction"), F.col("close").alias("entry_price"), *(keep or []))


def allow(signals: DataFrame, names: list[str]) -> DataFrame:
    """Signals whose whole name is listed, whatever its case or outer spaces. An empty list lets nothing through."""
    return signals.where(F.lower(F.trim("variant")).isin([n.strip().lower() for n in names]) if names else F.lit(False))


def matching(signals: DataFrame, fragments: list[str]) -> DataFrame:
    """Signals whose name holds any of the fragments, whatever its case. An empty list lets all through."""
    any_of = None
    for f in filter(None, (x.strip().upper() for x in fragments)):
        hit = F.contains(F.upper("variant"), F.lit(f))
        any_of = hit if any_of is None else any_of | hit
    return signals if any_of is None else signals.where(any_of)


def within(start: str | None, end: str | None) -> Column:
    """Whether ``date`` lies within whole days ``start`` to ``end``."""
    ok = F.lit(True)
    if start:
        ok &= F.col("date") >= F.lit(start).cast("timestamp")
    if end:
        ok &= F.col("date") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp")
    return ok


def in_window(signals: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Signals dated within whole days ``start`` to ``end``. Apply it to signals, never to the bars beneath."""
    return signals.where(within(start, end)) if start or end else signals


def closed_bars(candles: DataFrame, as_of: Column, zone: str = "Asia/Kolkata") -> DataFrame:
    """Bars before the day ``as_of`` in a zone: drops the unfinished one."""
    return candles.where(F.to_date(F.from_utc_timestamp("date", zone)) < as_of)


def _last_kept(rows: Column, sessions: int, index: str) -> Column:
    """For each of an array of structs in order of ``index``: the session of the last that stayed so far. One stays where that moves."""
    return rec.scan(rows, F.lit(None).cast("int"), lambda held, x: F.when(held.isNull() | (x[index] - held >= sessions), x[index]).otherwise(held))


def cooled_within(rows: Column, sessions: int, index: str = "session_idx") -> Column:
    """Those of an array of structs, in order of ``index``, that the greedy cooldown leaves."""
    last = _last_kept(rows, sessions, index)
    pairs = F.arrays_zip(rows.alias("x"), last.alias("now"), F.concat(F.array(F.lit(None).cast("int")), last).alias("before"))
    return F.transform(F.filter(pairs, lambda p: p["x"].isNotNull() & (p["now"] == p["x"][index]) & ~p["now"].eqNullSafe(p["before"])), lambda p: p["x"])


def cooled(signals: DataFrame, sessions: int, keys: tuple[str, ...] = ("token", "variant"), index: str = "session_idx") -> DataFrame:
    """Greedy cooldown: a signal stays when ``sessions`` or more passed since the last one that stayed.

    Only accepted signals start the clock, so this is a fold over each key's
    signals in order (a token's signals of one kind; bounded by its sessions).
    Of equal sessions of a key the first by the other columns stays. The rows
    ride along in the fold, so nothing is joined back.
    """
    if sessions <= 0:
        return signals
    rest = [c for c in signals.columns if c not in (*keys, index)]
    rows = signals.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(index, *rest))).alias("__all"))
    rows = rows.select(*keys, F.explode(cooled_within(F.col("__all"), sessions, index)).alias("__x"))
    return rows.select(*(F.col(c) if c in keys else F.col(f"__x.{c}") for c in signals.columns))


def fired_together(candles: DataFrame, strategies: list[Strategy], horizons: tuple[Horizon, ...] = ()) -> DataFrame:
    """The signals of several strategies, as ``fired`` gives each one's, from one pass over the candles.

    Strategies with folded rules run side by side in one Arrow function over each
    token's bars (candles may come gathered), which gives out the bars that fire,
    with the columns of ``trades.looks`` for ``horizons``. Else each strategy's
    variant is a column of the same ordering by token.
    """
    if all(s.folded for s in strategies):
        zone = candles.sparkSession.conf.get("spark.sql.session.timeZone")
        hits = folds.found(F.col("bars"), [(s.name, s.warmup, s.folded) for s in strategies], [h.days for h in horizons], zone)
        # For explode Spark would infer a filter that there are elements, and run the functions a second time for it.
        rows = gathered(candles).select("token", hits.alias("x")).select("token", F.explode_outer("x").alias("x")).where("x is not null").select("token", "x.*")
        rest = [c for c in rows.columns if c.startswith("__")]
        return rows.select("token", "date", "session_idx", "strategy", "variant", direction(F.col("variant")).alias("direction"), "entry_price", *rest)
    if horizons:
        raise ValueError("only strategies with folded rules look ahead")
    rows = candles
    for k, s in enumerate(strategies):
        rows = s.rules(rows).select(*rows.columns, F.col("variant").alias(f"__v{k}"))
    rows = rows.withColumn("idx", session_index())
    found = [F.struct(F.lit(s.name).alias("strategy"), F.when(F.col("idx") >= s.warmup, F.col(f"__v{k}")).alias("variant")) for k, s in enumerate(strategies)]
    rows = rows.select("token", "date", F.col("idx").cast("int").alias("session_idx"), "close", F.explode(F.filter(F.array(*found), lambda x: x["variant"].isNotNull())).alias("x"))
    return rows.select("token", "date", "session_idx", "x.strategy", "x.variant", direction(F.col("x.variant")).alias("direction"), F.col("close").alias("entry_price"))
