"""Indicators over a token's ordered bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import folds


def by_bar() -> WindowSpec:
    """A token's bars by date. All row frames share this order, so Catalyst plans them as one window operator."""
    return Window.partitionBy("token").orderBy("date")


def frame(first: int, last: int) -> WindowSpec:
    return by_bar().rowsBetween(first, last)


def session_index() -> Column:
    return F.row_number().over(by_bar()) - 1


#: Rows of the widest frame that is taken as it is: a frame is read anew for each bar, so its cost grows with its rows.
NARROW = 8
_SIDES = {"hi": ("high", F.max, F.greatest), "lo": ("low", F.min, F.least)}


def _shifted(c: str, n: int, ahead: bool = False) -> Column:
    return (F.lead if ahead else F.lag)(c, n).over(by_bar()) if n else F.col(c)


def _with_widths(rows: DataFrame, widths: set[int], ahead: bool = False) -> DataFrame:
    """Add ``__hi<n>`` and ``__lo<n>``, the highest high and lowest low of the last (``ahead``: next) n bars with the bar itself.

    A wide frame is two overlapping ones of a width that doubles from ``NARROW``
    on, so that a bar costs a few looks at other rows, however wide its frames are.
    """
    names, widest, width = list(rows.columns), max(widths), NARROW
    first = {w for w in widths if w <= NARROW} | ({NARROW} if widest > NARROW else set())
    rows = rows.withColumns({f"__{s}{w}": of(value).over(frame(0, w - 1) if ahead else frame(1 - w, 0)) for w in sorted(first) for s, (value, of, _) in _SIDES.items()})
    steps = [NARROW]
    while 2 * width <= widest:  # twice and four times the width are of one look
        rows = rows.withColumns({f"__{s}{n * width}": pick(*(_shifted(f"__{s}{width}", k * width, ahead) for k in range(n))) for s, (_, _, pick) in _SIDES.items() for n in (2, 4)})
        steps, width = [*steps, 2 * width, 4 * width], 4 * width
    part = {w: max(x for x in steps if x <= w) for w in widths - first - set(steps)}
    rows = rows.withColumns({f"__{s}{w}": pick(f"__{s}{x}", _shifted(f"__{s}{x}", w - x, ahead)) for w, x in part.items() for s, (_, _, pick) in _SIDES.items()})
    return rows.select(*names, *(f"__{s}{w}" for w in sorted(widths) for s in _SIDES))


def with_extremes(rows: DataFrame, frames: dict[str, tuple[int, int]], ahead: bool = False) -> DataFrame:
    """Add ``<name>_hi`` and ``<name>_lo``, the highest high and lowest low over rows first to last of each frame.

    Frames end at the bar or before it; with ``ahead`` they begin at it or after it.
    """
    names = rows.columns
    rows = _with_widths(rows, {last - first + 1 for first, last in frames.values()}, ahead)
    return rows.select(*names, *(_shifted(f"__{s}{last - first + 1}", first if ahead else -last, ahead).alias(f"{k}_{s}") for k, (first, last) in frames.items() for s in _SIDES))


def sma(period: int, value: str = "close") -> Column:
    """The simple average of the last ``period`` values; null before there are as many, and for a period below 1."""
    if period < 1:
        return F.lit(None).cast("double")
    return F.when(F.row_number().over(by_bar()) >= period, F.avg(value).over(frame(1 - period, 0)))


def wma(period: int, value: str = "close") -> Column:
    """The linearly weighted average, newest weight ``period``; null before there are as many values."""
    terms = None
    for k in range(period):
        term = F.lag(value, period - 1 - k).over(by_bar()) * float(k + 1)
        terms = term if terms is None else terms + term
    return terms / (period * (period + 1) / 2)


#: Ichimoku lines by name: midpoints of closed-market frames (rows back from the bar).
MIDPOINTS: dict[str, tuple[int, int]] = {
    "conversion": (-8, 0),
    "base": (-25, 0),
    "prev_conversion": (-8, -1),
    "prev_base": (-25, -1),
    "past_conversion": (-33, -25),
    "past_prev_conversion": (-34, -26),
    "past_base": (-50, -25),
    "past_conversion_52": (-59, -51),
    "past_base_52": (-76, -51),
    "span_b": (-76, -25),
    "span_b_52": (-102, -51),
}
#: In a live session the previous lines reach one bar further back.
LIVE_MIDPOINTS = MIDPOINTS | {"prev_conversion": (-9, -1), "prev_base": (-26, -1)}
ICHIMOKU_BARS = 105


def with_ichimoku(candles: DataFrame, live: bool = False) -> DataFrame:
    """Add every Ichimoku line and reference, null before bar 105. All frames share one shuffle and order (``with_extremes``)."""
    lines = LIVE_MIDPOINTS if live else MIDPOINTS
    extra = {f"{c}_{n}": F.lag(c, n).over(by_bar()) for c in ("high", "low") for n in (26, 27)} | {"prev_close": F.lag("close", 1).over(by_bar()), "idx": session_index()}
    widths = {last - first + 1 for first, last in lines.values()}
    rows = _with_widths(candles, widths).select(*candles.columns, *(((F.col(f"__hi{w}") + F.col(f"__lo{w}")) / 2).alias(f"__{w}") for w in sorted(widths)))
    rows = rows.withColumns({k: _shifted(f"__{last - first + 1}", -last) for k, (first, last) in lines.items()} | extra).drop(*(f"__{w}" for w in widths))
    return ichimoku_clouds(rows.withColumns({k: F.when(F.col("idx") >= ICHIMOKU_BARS - 1, F.col(k)) for k in lines}))


def ichimoku_clouds(rows: DataFrame) -> DataFrame:
    """The leading spans and the edges of both clouds, from the midpoints."""
    spans = {"span_a": (F.col("past_conversion") + F.col("past_base")) / 2, "span_a_52": (F.col("past_conversion_52") + F.col("past_base_52")) / 2}
    rows = rows.withColumns(spans)
    return rows.withColumns({f"cloud_{e}{s}": f(f"span_a{s}", f"span_b{s}") for e, f in (("top", F.greatest), ("bottom", F.least)) for s in ("", "_52")})


def _folded(candles: DataFrame, fold: Callable[[Callable[[str], Column]], Column], **more: Column) -> DataFrame:
    """Every bar with ``s``, what ``fold`` gives for it; it reads a token's bars as arrays, by column.

    A token's bars are gathered once, in order of date (its sessions bound them);
    they ride along beside the fold (``folds``), so that nothing is joined back
    and the partitioning by token stays. ``more`` are columns for the fold alone.
    """
    rest = [c for c in candles.columns if c not in ("token", "date")]
    extra = [c.alias(f"__{k}") for k, c in more.items()]
    rows = candles.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("date", *rest, *extra))).alias("b"))
    rows = rows.withColumn("s", fold(lambda c: F.col(f"b.{c}"))).select("token", F.explode(F.arrays_zip("b", "s")).alias("x"))
    return rows.select(*(F.col(c) if c == "token" else F.col(f"x.b.{c}").alias(c) for c in candles.columns), F.col("x.s").alias("s"))


def gathered(candles: DataFrame) -> DataFrame:
    """Each ``token`` with its ``bars``, an array of structs in order of date (its sessions bound it). Candles that are so already stay."""
    if candles.columns == ["token", "bars"]:
        return candles
    rest = [c for c in candles.columns if c not in ("token", "date")]
    return candles.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("date", *rest))).alias("bars"))


def with_hilega(candles: DataFrame, rsi: int = 9, ema: int = 3, weighted: int = 21, state: bool = False) -> DataFrame:
    """Add ``rsi``, ``ema`` and ``wma`` (both of the RSI), null where not defined; with ``state`` also the recurrences' ``day_state`` and ``ema_state``."""
    rows = _folded(candles, lambda of: folds.hilega(of("close"), rsi, ema, state))
    rows = rows.select(*candles.columns, "s.rsi", "s.ema", *(["s.day_state", "s.ema_state"] if state else []))
    return rows.withColumn("wma", wma(weighted, "rsi"))


def week_of(date: Column) -> Column:
    """The ISO week's first day."""
    return F.trunc(date, "week")


def month_of(date: Column) -> Column:
    return F.trunc(date, "month")


def with_mtf_rsi(candles: DataFrame, period: int = 14, state: bool = False) -> DataFrame:
    """Add ``rsi``, ``rsi_weekly`` and ``rsi_monthly`` at every bar, null where not defined; with ``state`` also ``day_state``, ``week_state`` and ``month_state``.

    The coarser two are of the last closes of completed buckets, then the bar's
    own close. Weeks are ISO weeks and months calendar months of the stored (UTC)
    date. The averages after each completed bucket are kept, and a bar takes one
    provisional step from those before its own bucket.
    """
    buckets = {"week": week_of(F.col("date")), "month": month_of(F.col("date"))}
    rows = _folded(candles, lambda of: folds.multi_timeframe(of("close"), {k: of(f"__{k}") for k in buckets}, period, state), **buckets)
    return rows.select(*candles.columns, "s.rsi", *(f"s.rsi_{k}ly" for k in buckets), *([f"s.{k}_state" for k in ("day", *buckets)] if state else []))


def resampled(candles: DataFrame, unit: str) -> DataFrame:
    """The last close of each ``week`` (ISO) or ``month``: ``(token, bucket, close)``."""
    return candles.groupBy("token", F.to_date(F.date_trunc(unit, "date")).alias("bucket")).agg(F.max_by("close", "date").alias("close"))
